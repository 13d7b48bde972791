"""What the tables of a source tree are looked at through: map, cross-tab, treemap, graphs, dossiers, save tree.

Each plan takes the tables and views by name. Values that a reader picks (a level,
a behaviour) are compared as literals and reach the scan as filters; nothing is
put together as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .views import Tables

#: Horizontal and vertical axis of each plane of the map.
PLANES = {"xz": ("x", "z"), "xy": ("x", "y"), "zy": ("z", "y")}
# What starts the names of each kind of flag.
FLAG_KINDS = {"HAVE_": "caps & keys", "UNLOCKED_": "doors", "CAP_ON_": "lost-cap thieves", "COLLECTED_": "secret stars"}
PREFIXES = ("bhv", "COURSE_", "OBJ_LIST_", "ACT_", "SAVE_FLAG_")
NO_LIST = "(none)"


def short_name(name: Column) -> Column:
    """A label: without the prefix that all names of its kind share, in lower case."""
    return F.lower(reduce(lambda out, p: F.when(name.startswith(p), F.substring(name, F.lit(len(p) + 1), F.length(name))).otherwise(out), PREFIXES, name))


def flag_kind(name: Column) -> Column:
    bare = F.regexp_replace(name, "^SAVE_FLAG_", "")
    return reduce(lambda out, p: F.when(bare.startswith(p), FLAG_KINDS[p]).otherwise(out), FLAG_KINDS, F.lit("world state"))


def degrees(yaw: Column) -> Column:
    """Of an angle whose full turn is 65536."""
    return yaw / 65536 * 360


def heat(n: Column, most: Column) -> Column:
    """0 to 1, by the square root."""
    return F.when(most > 0, F.sqrt(n / most)).otherwise(0.0)


def radius(n: Column, base: float, step: float, least: float, most: float) -> Column:
    return F.least(F.greatest(base + F.sqrt(n.cast("double")) * step, F.lit(least)), F.lit(most))


def placements(t: Tables, special_key: str = "preset_id", outer: bool = True) -> DataFrame:
    """(kind, level, area, x, y, z, behavior, label, model) of all three placement tables.

    special_key: preset_id also finds presets through other names of their number,
    preset_name only under their own. Without `outer`, what has no preset is left out.
    """
    how = "left" if outer else "inner"
    at = lambda prefix: [F.col(f"{prefix}_{axis}").alias(axis) for axis in "xyz"]
    own = t["object"].select(F.lit("object").alias("kind"), "level", "area", *at("initial"), "behavior", F.col("behavior").alias("label"), F.col("model_name").alias("model"))
    preset = t["macro_preset"].select("macro_name", "behavior", "model_name")
    macro = t["macro_object"].join(preset, "macro_name", how)
    macro = macro.select(F.lit("macro"), "level", "area", *at("pos"), "behavior", F.coalesce("behavior", "macro_name"), "model_name")
    preset = t["special_preset"].select(F.col(special_key), "behavior", "model_name")
    special = t["special_object"].join(preset, special_key, how)
    special = special.select(F.lit("special"), "level", "area", *at("pos"), "behavior", F.coalesce("behavior", t["special_object"]["preset_name"]), "model_name")
    return own.union(macro).union(special)


def levels_with_placements(t: Tables) -> DataFrame:
    return reduce(DataFrame.union, (t[n].select("level") for n in ("object", "macro_object", "special_object"))).distinct().orderBy("level")


def areas(t: Tables, level: str) -> DataFrame:
    return reduce(DataFrame.union, (t[n].filter(F.col("level") == level).select("area") for n in ("object", "macro_object", "special_object"))).distinct().orderBy("area")


def points(t: Tables, level: str, area: int | None = None) -> DataFrame:
    """The level's placements for the map; of one area if given."""
    found = placements(t).filter(F.col("level") == level).drop("level", "behavior")
    return found if area is None else found.filter(F.col("area") == area)


def points_by_kind(t: Tables, level: str, area: int | None = None, plane: str = "xz") -> DataFrame:
    """(kind, n, and how far its points reach along the plane's axes)."""
    ends = [f(axis).alias(f"{name}_{axis}") for axis in PLANES[plane] for f, name in ((F.min, "least"), (F.max, "most"))]
    return points(t, level, area).groupBy("kind").agg(F.count("*").alias("n"), *ends).orderBy("kind")


def camera_zones(t: Tables, level: str, area: int | None = None, plane: str = "xz") -> DataFrame:
    """Boxes as rectangles of the plane: centre, half extents, turn in degrees. An area of -1 is every area; flat boxes are left out."""
    h, v = PLANES[plane]
    zones = t["camera_trigger"].filter((F.col("level") == level) & (F.col("bounds_x") > 0))
    zones = zones if area is None else zones.filter(F.col("area").isin(area, -1))
    turn = degrees(F.col("bounds_yaw")) if plane == "xz" else F.lit(0.0)
    found = zones.select(
        "area", "event", F.col(f"center_{h}").alias("center_h"), F.col(f"center_{v}").alias("center_v"), F.col(f"bounds_{h}").alias("half_h"), F.col(f"bounds_{v}").alias("half_v"), turn.alias("turn"), "doc", "file", "line"
    )
    return found.filter("half_h > 0 and half_v > 0")


def _listed(t: Tables, dim: str) -> DataFrame:
    """Objects with their object list, and in `key` the level or the course that they stand in."""
    lists = t["behavior"].select(F.col("behavior_name").alias("behavior"), "obj_list")
    rows = t["object"].join(lists, "behavior", "left").withColumn("category", F.coalesce(F.nullif("obj_list", F.lit("")), F.lit(NO_LIST)))
    if dim == "course":
        return rows.join(t["level"].select(F.col("folder").alias("level"), F.col("course_name").alias("key")), "level").filter("key is not null")
    return rows.withColumn("key", F.col("level")).filter("key is not null")


def crosstab(t: Tables, dim: str = "level") -> DataFrame:
    """(category, behavior, key, n); behavior is null in the rows of a whole category, and key in those of all columns."""
    sets = F.expr("grouping_id(category, behavior, key)")
    counted = _listed(t, dim).cube("category", "behavior", "key").agg(F.count("*").alias("n"), sets.alias("level_of"))
    return counted.filter("level_of in (0, 1, 2, 3, 6)").select("category", "behavior", "key", "n")


def crosstab_wide(t: Tables, dim: str = "level") -> DataFrame:
    """A row for each behaviour, a column for each level or course."""
    return _listed(t, dim).groupBy("category", "behavior").pivot("key").count().fillna(0)


def category_row(t: Tables, category: str, dim: str = "level") -> DataFrame:
    return _listed(t, dim).filter(F.col("category") == category).groupBy(F.col("key").alias(dim)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), dim)


def category_cell(t: Tables, category: str, key: str, dim: str = "level") -> DataFrame:
    return _listed(t, dim).filter((F.col("category") == category) & (F.col("key") == key)).groupBy("behavior").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "behavior")


def behavior_row(t: Tables, behavior: str) -> DataFrame:
    return t["object"].filter(F.col("behavior") == behavior).groupBy("level").agg(F.count("*").alias("placements")).orderBy(F.desc("placements"), "level")


def behavior_cell(t: Tables, behavior: str, key: str, dim: str = "level") -> DataFrame:
    rows = _listed(t, dim).filter((F.col("behavior") == behavior) & (F.col("key") == key))
    return rows.select("level", *(F.col(f"initial_{a}").alias(a) for a in "xyz"), "model_name", "bhv_param").orderBy("level")


def placement_counts(t: Tables) -> DataFrame:
    """(level, behavior, obj_list, n) over all placements that have a preset of their own name."""
    lists = t["behavior"].select(F.col("behavior_name").alias("behavior"), "obj_list")
    counted = placements(t, "preset_name", outer=False).groupBy("level", "behavior").agg(F.count("*").alias("n"))
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("level", "behavior", "obj_list")]
    return counted.join(lists, "behavior", "left").select(*named, "n")


def nested(t: Tables, order: tuple[str, str, str] = ("obj_list", "level", "behavior"), colour: str = "obj_list") -> DataFrame:
    """A treemap's nodes: the values of `order` down to it, its count, and the one value of `colour` below it, empty if there are several."""
    rows = placement_counts(t)
    shared = F.when(F.min(F.col("tint")) == F.max("tint"), F.min("tint")).otherwise("")
    rows = rows.withColumn("tint", F.col(colour))
    return reduce(
        DataFrame.unionByName,
        (rows.groupBy(*order[:n]).agg(F.sum("n").alias("n"), shared.alias("colour")).select(F.lit(n).alias("depth"), *(F.col(c) if i < n else F.lit(None).cast("string").alias(c) for i, c in enumerate(order)), "n", "colour") for n in (1, 2, 3)),
    )


def placed_in(t: Tables, level: str, behavior: str) -> DataFrame:
    rows = placements(t, "preset_name", outer=False).filter((F.col("level") == level) & (F.col("behavior") == behavior))
    return rows.select(F.col("kind").alias("source"), "level", "x", "y", "z", "behavior")


def relation_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of behaviours: who spawns, becomes or seeks whom. An edge's origin tells scripts from code."""
    spawns = t["behavior_all_spawns"].groupBy(F.col("behavior_name").alias("source"), F.col("spawned_behavior").alias("target"))
    script, code = F.bool_or(F.col("origin") == "script"), F.bool_or(F.col("origin") != "script")
    spawns = spawns.agg(F.when(script & code, "both").when(script, "script").otherwise("code").alias("origin")).withColumn("relation", F.lit("spawn"))
    of = lambda view, target, relation: t[view].select(F.col("behavior_name").alias("source"), F.col(target).alias("target"), F.lit(None).cast("string").alias("origin"), F.lit(relation).alias("relation")).distinct()
    edges = spawns.unionByName(of("behavior_calls_morph", "becomes_behavior", "morph")).unionByName(of("behavior_calls_seek", "target_behavior", "seek"))
    placed = placements(t, "preset_name", outer=False).filter("behavior is not null").groupBy(F.col("behavior").alias("id")).agg(F.count("*").alias("placements"))
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).union(placed.select("id")).distinct()
    lists = t["behavior"].select(F.col("behavior_name").alias("id"), "obj_list")
    nodes = ids.join(placed, "id", "left").join(lists, "id", "left").select("id", F.coalesce("obj_list", F.lit("")).alias("list"), F.coalesce("placements", F.lit(0)).alias("placements"))
    return nodes.withColumn("r", F.when(F.col("placements") > 0, radius(F.col("placements"), 4, 1.1, 0, 24)).otherwise(3.5)), edges


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other): both ways, each once."""
    return edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source")).distinct()


def dossier(t: Tables, behavior: str) -> DataFrame:
    """(part, item, detail, file, line, n): all that the tables know of a behaviour."""
    null = lambda kind="string": F.lit(None).cast(kind)
    mine = lambda name: t[name].filter(F.col("behavior_name") == behavior)

    def part(rows: DataFrame, name: str, item: Column | str, detail: Column | None = None, placed: bool = False, n: Column | None = None) -> DataFrame:
        item = F.col(item) if isinstance(item, str) else item
        where = [F.col("file"), F.col("line").cast("int")] if placed else [null(), null("int")]
        return rows.select(F.lit(name).alias("part"), item.alias("item"), (null() if detail is None else detail).alias("detail"), where[0].alias("file"), where[1].alias("line"), (null("long") if n is None else n).alias("n"))

    levels = placements(t, "preset_name", outer=False).filter(F.col("behavior") == behavior).groupBy("level").count()
    spawn = lambda rows, rank, place: rows.filter("spawned_behavior is not null").select(F.lit(rank).alias("rank"), "spawned_behavior", "spawned_model", *place)
    at = [F.col("file"), F.col("line").cast("int").alias("line")]
    called = spawn(mine("behavior_calls_spawn"), 0, [*at, F.lit("c").alias("source")])
    told = spawn(mine("behavior_data_spawn"), 1, [*at, F.col("source")])
    scripted = spawn(mine("behavior_spawn"), 2, [null().alias("file"), null("int").alias("line"), F.lit("script").alias("source")])
    # Of a child the code counts before the tables and these before the script.
    first = F.row_number().over(Window.partitionBy("spawned_behavior").orderBy("rank", "file", "line", "spawned_model"))
    spawns = called.union(told).union(scripted).withColumn("first", first).filter("first = 1")
    by = lambda name: t[name].filter(F.col("spawned_behavior") == behavior).select("behavior_name")
    parents = by("behavior_calls_spawn").union(by("behavior_spawn")).union(by("behavior_data_spawn")).distinct()
    spoken = mine("behavior_calls_dialog").join(t["dialog"].select(F.col("dialog_name").alias("dialog"), F.col("text").alias("said")), "dialog", "left")
    parts = [
        part(t["behavior"].filter(F.col("behavior_name") == behavior), "list", "obj_list"),
        part(levels, "level", "level", n=F.col("count")),
        part(spawns, "spawn", "spawned_behavior", F.concat_ws(" ", "source", "spawned_model"), True),
        part(parents, "parent", "behavior_name"),
        part(mine("behavior_calls_sound").select("sound", "file", "line").distinct(), "sound", "sound", placed=True),
        part(spoken, "dialog", "dialog", F.col("said"), True),
        part(mine("behavior_calls_morph").select("becomes_behavior", "file", "line").distinct(), "morph", "becomes_behavior", placed=True),
        part(mine("behavior_calls_seek").select("target_behavior", "file", "line").distinct(), "seek", "target_behavior", placed=True),
        part(mine("behavior_native").select("func").distinct(), "native", "func"),
    ]
    return reduce(DataFrame.union, parts)


def _representatives(t: Tables) -> DataFrame:
    """(source, target, condition): of each edge one condition, the least; refuted calls count too."""
    known = t["mario_action"].select(F.col("action_name").alias("target"))
    said = t["mario_action_call"].join(known, "target", "left_semi").select(F.col("action_name").alias("source"), "target", "condition")
    said = said.union(t["mario_action_data_transition"].select("action_name", "to_action", "condition"))
    return said.filter("condition is not null").groupBy("source", "target").agg(F.min("condition").alias("condition"))


def action_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the state machine; a loop counts once in a node's degree."""
    edges = t["mario_all_transitions"].select(F.col("action_name").alias("source"), F.col("to_action").alias("target")).join(_representatives(t), ["source", "target"], "left")
    ends = edges.select(F.col("source").alias("action_name")).union(edges.filter("source <> target").select("target"))
    degree = ends.groupBy("action_name").agg(F.count("*").alias("degree"))
    nodes = t["mario_action"].join(degree, "action_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    nodes = nodes.select(F.col("action_name").alias("id"), F.coalesce("group_name", F.lit("")).alias("group"), F.from_json("flags_json", "array<string>").alias("flags"), "handler", "degree", radius(F.col("degree"), 4, 1.5, 3.5, 22).alias("r"))
    return nodes, edges


def action_dossier(t: Tables, action: str) -> DataFrame:
    """(part, item, condition, source, file, line): ways out, literal ones first, ways in, and targets that stay open.

    Ways out by literals include the refuted ones, as the call is there to see.
    """
    known = t["mario_action"].select(F.col("action_name").alias("target"))
    calls = t["mario_action_call"].filter(F.col("action_name") == action)
    data = t["mario_action_data_transition"].filter(F.col("action_name") == action)
    literal = calls.join(known, "target", "left_semi").select(F.lit(0).alias("rank"), F.col("target").alias("item"), "condition", F.lit(None).cast("string").alias("source"), "file", "line")
    told = data.select(F.lit(1), "to_action", "condition", "source", "file", "line")
    first = F.row_number().over(Window.partitionBy("item").orderBy("rank", "line", "file"))
    out = literal.union(told).withColumn("first", first).filter("first = 1").select(F.lit("out").alias("part"), "item", "condition", "source", "file", "line")
    into = t["mario_all_transitions"].filter(F.col("to_action") == action).select(F.col("action_name").alias("item")).distinct()
    into = into.join(_representatives(t).filter(F.col("target") == action).select(F.col("source").alias("item"), "condition"), "item", "left")
    into = into.select(F.lit("in"), "item", "condition", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    open_ = calls.filter(F.col("target").isNotNull() & ~F.col("target").contains("ACT_")).join(known, "target", "left_anti")
    open_ = open_.join(data.select(F.col("source").alias("target")), "target", "left_anti").select("target", "file", "line").distinct()
    return out.union(into).union(open_.select(F.lit("open"), "target", F.lit(None).cast("string"), F.lit(None).cast("string"), "file", "line"))


#: How deep structs may lie in one another.
DEEPEST = 6


def save_tree(t: Tables, root: str = "SaveBuffer") -> DataFrame:
    """Every struct, field, array element and bit below root: (path, depth, label, kind, type, offset, size).

    `offset` counts from the root's first byte. Elements of per-course arrays are
    labelled by the course of that number, an array of two dimensions by both; a
    word of flags has a row for each of its 32 bits, named or not, and a byte of
    stars one for each of its eight.
    """
    fields = t["save_field"].select(F.col("struct_name").alias("owner"), "field_name", "type_name", "dims", F.col("count").cast("int").alias("n"), F.col("elem_size").cast("int").alias("each"), F.col("offset").cast("int").alias("at"), F.col("size").cast("int").alias("bytes"), "is_struct")
    open_ = t["save_struct"].filter(F.col("struct_name") == root).select(F.col("struct_name").alias("owner"), F.array(F.lit(root)).alias("path"), F.lit(0).alias("base"))
    found = []
    for _ in range(DEEPEST):  # one join for each depth of structs
        inside = open_.join(fields, "owner")
        rows = inside.select(F.concat("path", F.array("field_name")).alias("path"), (F.col("base") + F.col("at")).alias("offset"), "field_name", "type_name", "dims", "n", "each", F.col("bytes").alias("size"), "is_struct")
        found.append(rows.withColumn("kind", F.lit("field")))
        parts = rows.filter("n > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        inner = F.coalesce(F.element_at(F.split("dims", ","), -1).try_cast("int"), F.lit(1))
        several = F.size(F.split("dims", ",")) > 1
        index = F.when(several, F.concat(F.lit("["), (F.col("i") / inner).cast("int"), F.lit("]["), F.col("i") % inner, F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("i"), F.lit("]")))
        parts = parts.withColumns({"path": F.concat("path", F.array(index)), "offset": F.col("offset") + F.col("i") * F.col("each"), "size": F.col("each"), "kind": F.lit("element")})
        found.append(parts.select(*found[0].columns))
        whole = rows.filter("is_struct and n = 1").select("type_name", "path", "offset").union(parts.filter("is_struct").select("type_name", "path", "offset"))
        open_ = whole.select(F.col("type_name").alias("owner"), "path", F.col("offset").alias("base"))
        if open_.isEmpty():
            break
    nodes = reduce(DataFrame.union, found)
    courses = t["course"].select(F.row_number().over(Window.orderBy("ord")).alias("number"), "course_name", "display_name")  # a few dozen
    place = F.regexp_extract(F.element_at("path", -1), r"^\[(\d+)\]$", 1).try_cast("int")
    by_course = (F.col("kind") == "element") & F.col("field_name").isin("courseStars", "courseCoinScores")
    labelled = nodes.withColumn("number", F.when(by_course, place + 2)).join(courses, "number", "left")  # the first course is none
    labelled = labelled.withColumn("label", F.coalesce("display_name", F.element_at("path", -1)))
    plain = labelled.select("path", "offset", "size", "label", "kind", F.col("type_name").alias("type"))
    groups = t["save_flag"].select(F.col("flag_group").alias("field_name"), "bit", "flag_name")
    words = labelled.join(groups.select("field_name").distinct(), "field_name", "left_semi").filter("kind = 'field'").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(31))))
    flags = words.join(groups, ["field_name", "bit"], "left").select("path", "offset", "bit", F.coalesce("flag_name", F.lit("unused")).alias("label"))
    stars = labelled.filter(by_course & (F.col("field_name") == "courseStars")).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    named = t["star"].filter("kind = 'main'").select("course_name", (F.col("act") - 1).cast("int").alias("bit"), F.col("name").alias("star_name"))
    before = courses.select((F.col("number") + 1).alias("number"), F.when(F.col("course_name") != "COURSE_NONE", F.col("display_name")).alias("cannon_of"))
    stars = stars.join(named, ["course_name", "bit"], "left").join(before, "number", "left")
    star = F.when(F.col("bit") == 6, "100-coin star").when(F.col("bit") < 6, F.coalesce("star_name", F.concat(F.lit("star "), F.col("bit") + 1)))
    # The highest bit is the cannon of the course before.
    stars = stars.select("path", "offset", "bit", F.coalesce(star, F.concat(F.lit("cannon: "), F.coalesce("cannon_of", F.lit("unused")))).alias("label"))
    bits = flags.union(stars).select(F.concat("path", F.array(F.concat(F.lit("bit "), F.col("bit")))).alias("path"), "offset", F.lit(0).alias("size"), "label", F.lit("bit"), F.lit("bit"))
    return plain.union(bits).select(F.array_join("path", ".").alias("path"), (F.size("path") - 1).alias("depth"), "label", "kind", "type", "offset", "size")
