"""Tables of placements, presets, scripts and names, read out of a tree of source files.

Every table starts from the lines or texts of the files it needs; a filter on the
path reaches the scan, so other files are not read. State that a script carries
from line to line (the open area, the script a command stands in) is a window per
file. A file that is missing gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import defines_of, enum_of, int_token, packed
from ..functions.layout import active_text, layout_of
from ..functions.text import acts, c_string, call_of, json_list, split_top_level, without_comments
from ..operators.state import first_row, last_seen
from .lines import files, lines, with_level_and_area

BUILDERS: dict[str, Callable[[Tree], DataFrame]] = {}


def builder(make: Callable[[Tree], DataFrame]) -> Callable[[Tree], DataFrame]:
    BUILDERS[make.__name__] = make
    return make


class Tree:
    """The files under root, by their path from there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        inside = F.regexp_replace("path", "^.*?" + re.escape(self.root) + "/", "")
        self.files = files(spark, self.root, "*.{c,h}").withColumn("path", inside)

    def texts(self, pattern: str) -> DataFrame:
        """(path, text) of the files whose path fits the pattern."""
        return self.files.filter(F.col("path").rlike(f"^(?:{pattern})$"))

    def lines(self, pattern: str) -> DataFrame:
        return lines(self.texts(pattern)).withColumn("text", F.trim("text"))

    def calls(self, pattern: str) -> DataFrame:
        """(path, line, text, name, args, level, area of the path); name is null where no call stands."""
        rows = with_level_and_area(self.lines(pattern)).withColumn("call", call_of(F.col("text")))
        return rows.select("path", "line", "text", "level", "area", F.col("call.name").alias("name"), F.col("call.args").alias("args"))

    def enum(self, pattern: str, name: str) -> DataFrame:
        """(ord, name, value)."""
        members = self.texts(pattern).select(F.posexplode(enum_of(F.col("text"), name)).alias("ord", "member"))
        return members.select("ord", "member.name", "member.value")

    def array_rows(self, pattern: str, declared: str) -> DataFrame:
        """(line, parts) of the lines { a, b, ... } between a declaration and the brace that closes it."""
        rows = self.lines(pattern).withColumn("text", without_comments(F.col("text")))
        event = F.when(F.col("text").rlike(declared), True).when(F.col("text").startswith("};"), False)
        rows = rows.withColumn("inside", last_seen(event, ["path"], ["line"])).filter(F.col("inside") & ~F.col("text").rlike(declared))
        inner = F.regexp_extract("text", r"\{(.*)\}", 1)
        return rows.filter(F.col("text").rlike(r"\{.*\}")).select("path", "line", F.transform(split_top_level(inner), lambda p: F.trim(p)).alias("parts"))


def _array_named(kind: str, prefix: str = "") -> Column:
    """The name of the array of that type that a line declares or defines, else an empty string."""
    words = F.split("text", r"[^\w\[\]]+")
    name = F.get(words, F.array_position(words, kind).cast("int"))  # what stands behind the type
    named = F.array_contains(words, kind) & name.startswith(prefix) & name.endswith("[]")
    return F.when(named, F.regexp_replace(name, r"\[\]$", "")).otherwise("")


SCRIPTS = r"levels/[^/]+/script\.c"


def _arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def _ints(names: str, start: int) -> list[Column]:
    return [_arg(start + k).cast("int").alias(name) for k, name in enumerate(names.split())]


def _needs(least: Column, what: str) -> Column:
    """Stops the query where a macro has another number of arguments than it should."""
    return F.when(~least, F.raise_error(F.concat(F.lit(f"wrong number of arguments in {what}: "), F.col("text")))).otherwise(F.lit(True))


def _in_areas(calls: DataFrame) -> DataFrame:
    """Sets area to the AREA that is open at a line, 0 outside of any."""
    opened = F.when(F.col("name") == "AREA", F.coalesce(_arg(0).try_cast("int"), F.lit(0))).when(F.col("text").startswith("END_AREA"), 0)
    return calls.withColumn("area", F.coalesce(last_seen(opened, ["path"], ["line"]), F.lit(0)))


@builder
def object(tree: Tree) -> DataFrame:
    """Objects of level scripts. One in a script array belongs to the area that links to the array, the last such one; unlinked ones to 0."""
    array = F.when(F.col("text").startswith("static"), _array_named("LevelScript")).otherwise("")
    calls = tree.calls(SCRIPTS)
    opened = F.when(array != "", array).when(F.col("name") == "AREA", F.concat(F.lit("@"), F.coalesce(_arg(0).try_cast("int"), F.lit(0)))).when(F.col("text").startswith("END_AREA"), "")
    calls = calls.withColumn("within", last_seen(opened, ["path"], ["line"]))
    own = F.regexp_extract("within", r"^@(-?\d+)$", 1).try_cast("int")
    links = calls.filter((F.col("name") == "JUMP_LINK") & own.isNotNull()).groupBy("path", _arg(0).alias("within")).agg(F.max_by(own, "line").alias("linked"))
    plain = F.col("name") == "OBJECT"
    placed = calls.filter(F.col("name").isin("OBJECT", "OBJECT_WITH_ACTS")).filter(_needs(F.size("args") == F.when(plain, 9).otherwise(10), "an object"))
    placed = placed.withColumns({"param": packed(_arg(7)), "acts": acts(F.when(plain, "ALL_ACTS").otherwise(_arg(9)))}).join(links, ["path", "within"], "left")
    return placed.select(
        _arg(0).alias("model_name"), "level", F.coalesce(own, "linked", F.lit(0)).alias("area"),
        *_ints("initial_x initial_y initial_z initial_rot_x initial_rot_y initial_rot_z", 1),
        F.col("param.raw").alias("bhv_param"), F.col("param.value").alias("bhv_param_value"), *(F.get("param.slots", F.lit(i)).alias(f"bhv_param_{i + 1}") for i in range(4)),
        _arg(8).alias("behavior"), *(F.get("acts", F.lit(i)).alias(f"in_act_{i + 1}") for i in range(6)),
    )


@builder
def macro_object(tree: Tree) -> DataFrame:
    rows = tree.calls(r"levels/[^/]+/.*macro\.inc\.c").filter(F.col("name").isin("MACRO_OBJECT", "MACRO_OBJECT_WITH_BHV_PARAM"))
    rows = rows.filter(_needs(F.size("args") == F.when(F.col("name") == "MACRO_OBJECT", 5).otherwise(6), "a macro object"))
    rows = rows.withColumn("param", packed(F.coalesce(_arg(5), F.lit("0"))))
    return rows.select(_arg(0).alias("macro_name"), "level", "area", *_ints("yaw pos_x pos_y pos_z", 1), F.col("param.raw").alias("bhv_param"), F.col("param.value").alias("bhv_param_value"))


@builder
def special_object(tree: Tree) -> DataFrame:
    rows = tree.calls(r"levels/[^/]+/.*collision\.inc\.c").filter(F.col("name").isin("SPECIAL_OBJECT", "SPECIAL_OBJECT_WITH_YAW", "SPECIAL_OBJECT_WITH_YAW_AND_PARAM"))
    rows = rows.filter(_needs(F.size("args") >= 4, "a special object")).withColumns({"param": packed(F.coalesce(_arg(5), F.lit("0"))), "preset_name": _arg(0)})
    ids = tree.enum(r"include/special_presets\.h", "SpecialPresets").select(F.col("name").alias("preset_name"), "value")
    return rows.join(ids, "preset_name", "left").select(
        "preset_name", F.coalesce("value", F.lit(-1)).alias("preset_id"), "level", "area", *_ints("pos_x pos_y pos_z", 1), F.coalesce(_arg(4).cast("int"), F.lit(0)).alias("yaw"),
        F.col("param.raw").alias("bhv_param"), F.col("param.value").alias("bhv_param_value"),
    )


def _preferred(tree: Tree, stem: str, declared: str) -> DataFrame:
    """Rows of an array in stem.inc.c, or in stem.h of older trees."""
    rows = tree.array_rows(rf"include/{stem}\.(?:inc\.c|h)", declared)
    newest = tree.texts(rf"include/{stem}\.(?:inc\.c|h)").agg(F.min_by("path", F.col("path").endswith(".h")).alias("path"))
    return rows.join(newest, "path", "left_semi")


@builder
def macro_preset(tree: Tree) -> DataFrame:
    """The n-th row of the array has the n-th name of the enum; rows beyond the names are an error."""
    number = lambda df, by: df.withColumn("place", F.row_number().over(Window.orderBy(by)))  # noqa: E731  two lists of a few hundred
    names = tree.enum(r"include/macro_presets\.h", "MacroPresets").filter("name like 'macro\\\\_%' and name <> 'macro_count'")
    rows = number(_preferred(tree, "macro_presets", r"MacroObjectPresets\[\].*\{"), "line")
    rows = rows.join(number(names, "ord"), "place", "left").filter(F.when(F.col("name").isNull(), F.raise_error("more preset rows than names")).otherwise(F.lit(True)))
    part = lambda i: F.get("parts", F.lit(i))
    return rows.withColumn("param", packed(part(2))).select(F.col("name").alias("macro_name"), part(0).alias("behavior"), part(1).alias("model_name"), F.col("param.raw").alias("param"), F.col("param.value").alias("param_value"))


@builder
def special_preset(tree: Tree) -> DataFrame:
    part = lambda i: F.get("parts", F.lit(i))
    rows = _preferred(tree, "special_presets", r"SpecialObjectPresets\[\].*\{").withColumn("preset_name", part(0))
    ids = tree.enum(r"include/special_presets\.h", "SpecialPresets").select(F.col("name").alias("preset_name"), "value")
    return rows.join(ids, "preset_name", "left").select(
        "preset_name", F.coalesce("value", F.lit(-1)).alias("preset_id"), part(1).alias("preset_type"), int_token(part(2)).alias("default_param"), part(3).alias("model_name"), part(4).alias("behavior")
    )


@builder
def level(tree: Tree) -> DataFrame:
    rows = tree.calls(r"levels/level_defines\.h").filter(F.col("name").isin("DEFINE_LEVEL", "STUB_LEVEL"))
    stub = F.col("name") == "STUB_LEVEL"
    rows = rows.filter(_needs(F.size("args") >= F.when(stub, 3).otherwise(4), "a level"))
    return rows.select(_arg(1).alias("level_name"), _arg(2).alias("course_name"), F.when(~stub, _arg(3)).alias("folder"), F.regexp_replace(_arg(0), '^"|"$', "").alias("internal_name"), stub.alias("is_stub"))


def _numbered_remark(text: Column) -> Column:
    """What a line's remark says behind its number in brackets."""
    remark = F.trim(F.get(F.split(text, "//", 2), F.lit(1)))
    numbered = F.substring_index(remark, ")", 1).rlike("^[(][0-9]+$")
    return F.when(numbered, F.trim(F.array_join(F.slice(F.split(remark, "[)]"), 2, F.size(F.split(remark, "[)]"))), ")"))).otherwise("")


@builder
def course(tree: Tree) -> DataFrame:
    """In the order of the file; ord keeps it."""
    rows = tree.calls(r"levels/course_defines\.h").filter(F.col("name").isin("DEFINE_COURSE", "DEFINE_BONUS_COURSE")).filter(_needs(F.size("args") >= 2, "a course"))
    return rows.select(
        _arg(0).alias("course_name"), _numbered_remark(F.col("text")).alias("display_name"),
        F.conv(F.regexp_replace(_arg(1), "^0[xX]", ""), 16, 10).cast("bigint").alias("dance_cutscene"), (F.col("name") == "DEFINE_BONUS_COURSE").alias("is_bonus"), F.col("line").alias("ord"),
    )


def _course_texts(tree: Tree) -> DataFrame:
    """(macro, args) of calls that may span lines."""
    text = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"(?m)//.*$", "")
    called = F.regexp_extract_all(text, F.lit(r'\b((?:COURSE_ACTS|SECRET_STAR)\s*\((?:"(?:[^"\\]++|\\.)*+"|[^()"]++|\((?:"(?:[^"\\]++|\\.)*+"|[^()"]++)*\))*\))'), 1)
    rows = tree.texts(r"text/us/courses\.h").select(F.explode(called).alias("text"))
    macro, inner = F.regexp_extract("text", r"^(\w+)", 1), F.regexp_extract("text", r"(?s)^\w+\s*\((.*)\)$", 1)
    rows = rows.withColumns({"macro": macro, "args": F.transform(split_top_level(inner), lambda a: F.trim(a))})
    return rows.filter(_needs(F.size("args") == F.when(F.col("macro") == "SECRET_STAR", 2).otherwise(8), "a course's text"))


@builder
def course_name(tree: Tree) -> DataFrame:
    main, text = F.col("macro") == "COURSE_ACTS", F.trim(c_string(_arg(1)))
    number = F.when(main, F.regexp_extract(text, r"^(\d+)(?: |$)", 1).try_cast("int"))
    rows = _course_texts(tree).select(_arg(0).alias("course_name"), F.coalesce(number, F.lit(0)).alias("number"), F.when(number.isNotNull(), F.trim(F.regexp_replace(text, r"^\d+", ""))).otherwise(text).alias("name"), main.alias("main"))
    return rows.filter("main or name <> ''").drop("main")


@builder
def star(tree: Tree) -> DataFrame:
    main = F.col("macro") == "COURSE_ACTS"
    rows = _course_texts(tree).select(_arg(0).alias("course_name"), F.when(main, "main").otherwise("secret").alias("kind"), F.posexplode("args").alias("act", "name")).filter("act > 0")
    rows = rows.withColumns({"act": F.when(F.col("kind") == "main", F.col("act") - 1).otherwise(0), "name": F.trim(c_string(F.col("name")))})
    return rows.filter("(kind = 'secret' or act > 0) and name <> ''")


@builder
def model(tree: Tree) -> DataFrame:
    """Ids given as a number or as a name that stands before; others are left out."""
    rows = tree.texts(r"include/model_ids\.h").select(F.explode(defines_of(F.col("text"))).alias("d"))
    return rows.filter("startswith(d.name, 'MODEL_')").select(F.col("d.name").alias("model_name"), F.col("d.value").alias("model_id"))


@builder
def sequence(tree: Tree) -> DataFrame:
    return tree.enum(r"include/seq_ids\.h", "SeqId").filter("name <> 'SEQ_COUNT'").select(F.col("name").alias("seq_name"), F.col("value").alias("seq_id"))


@builder
def mario_animation(tree: Tree) -> DataFrame:
    return tree.enum(r"include/mario_animation_ids\.h", "MarioAnimID").select(F.col("name").alias("anim_name"), F.col("value").alias("anim_id"))


@builder
def sound(tree: Tree) -> DataFrame:
    rows = tree.lines(r"include/sounds\.h").filter(F.col("text").rlike(r"^#define SOUND_.*/\*\s*0x[0-9A-Fa-f]+\s*\*/") & F.col("text").contains("SOUND_ARG_LOAD("))
    return rows.select(
        F.regexp_extract("text", r"^#define\s+(\w+)", 1).alias("sound_name"), F.conv(F.regexp_extract("text", r"/\*\s*0x([0-9A-Fa-f]+)", 1), 16, 10).cast("bigint").alias("sound_id"),
        F.trim(F.regexp_extract("text", r"SOUND_ARG_LOAD\(\s*([^,)]*)", 1)).alias("bank"),
    )


@builder
def dialog(tree: Tree) -> DataFrame:
    """Of a string macro that is defined twice the later text counts."""
    define = r'(?m)^[ \t]*(#define[ \t]+\w+[ \t]+"(?:[^"\\\n]++|\\.)*+".*)$'
    given = F.transform(F.regexp_extract_all("text", F.lit(define), 1), lambda d: F.named_struct(F.lit("name"), F.regexp_extract(d, r"^#define\s+(\w+)", 1), F.lit("value"), F.regexp_extract(d, r"^#define\s+\w+\s+(.*)$", 1)))
    none = F.array().cast("array<struct<name:string,value:string>>")
    macros = F.aggregate(given, none, lambda known, d: F.concat(known, F.array(F.named_struct(F.lit("name"), d["name"], F.lit("value"), c_string(d["value"], known)))))
    block = r'(?s)(DEFINE_DIALOG\s*\([^"()]*_\((?:"(?:[^"\\]++|\\.)*+"|[^"()]++)*\)\s*\))'
    rows = tree.texts(r"text/us/dialogs\.h").select(macros.alias("macros"), F.explode(F.regexp_extract_all("text", F.lit(block), 1)).alias("text"))
    rows = rows.withColumn("args", F.transform(F.split(F.regexp_extract("text", r"\(([^()]*)_\(", 1), ","), lambda a: F.trim(a))).filter(_needs(F.size("args") >= 5, "a dialog"))
    rows = rows.select(_arg(0).alias("dialog_name"), *_ints("lines_per_box left_offset width", 2), c_string(F.regexp_extract("text", r"(?s)_\((.*)\)\s*\)$", 1), F.col("macros")).alias("text"))
    ids = tree.enum(r"include/dialog_ids\.h", "DialogID").select(F.col("name").alias("dialog_name"), "value")
    return rows.join(ids, "dialog_name", "left").select("dialog_name", F.coalesce("value", F.lit(-1)).alias("dialog_id"), "lines_per_box", "left_offset", "width", "text")


def _script_commands(tree: Tree) -> DataFrame:
    """Calls with the behaviour script they stand in, and the line where it starts."""
    defined = _array_named("BehaviorScript", "bhv")
    event = F.when(defined != "", F.struct(defined.alias("name"), F.col("line").alias("start"))).when(F.col("text").startswith("};"), F.struct(F.lit("").alias("name"), F.col("line").alias("start")))
    rows = tree.calls(r"data/behavior_data\.c").withColumn("script", last_seen(event, ["path"], ["line"]))
    return rows.filter("name is not null and script.name <> ''")


@builder
def behavior(tree: Tree) -> DataFrame:
    """Behaviours that the header declares, with the first argument of their script's first BEGIN."""
    declared = tree.lines(r"include/behavior_data\.h").filter(F.col("text").startswith("extern")).select(_array_named("BehaviorScript", "bhv").alias("behavior_name")).filter("behavior_name <> ''").distinct()
    begun = _script_commands(tree).filter("name = 'BEGIN' and size(args) > 0").groupBy(F.col("script.name").alias("behavior_name")).agg(F.min_by(_arg(0), "line").alias("obj_list"))
    return declared.join(begun, "behavior_name", "left").withColumn("obj_list", F.coalesce("obj_list", F.lit("")))


@builder
def behavior_command(tree: Tree) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("path", "script.start").orderBy("line")) - 1
    return _script_commands(tree).select(F.col("script.name").alias("behavior_name"), seq.alias("seq"), F.col("name").alias("command"), F.array_join("args", ", ").alias("args"), json_list(F.col("args")).alias("args_json"))


@builder
def warp(tree: Tree) -> DataFrame:
    rows = _in_areas(tree.calls(SCRIPTS)).filter(F.col("name").isin("WARP_NODE", "PAINTING_WARP_NODE")).filter(_needs(F.size("args") == 5, "a warp"))
    return rows.select("level", "area", _arg(0).alias("node_id"), _arg(1).alias("dest_level"), _arg(2).cast("int").alias("dest_area"), _arg(3).alias("dest_node"), _arg(4).alias("flags"), (F.col("name") == "PAINTING_WARP_NODE").alias("is_painting"))


@builder
def instant_warp(tree: Tree) -> DataFrame:
    rows = _in_areas(tree.calls(SCRIPTS)).filter("name = 'INSTANT_WARP'").filter(_needs(F.size("args") == 5, "an instant warp"))
    return rows.select("level", "area", *_ints("warp_index dest_area displace_x displace_y displace_z", 0))


@builder
def area(tree: Tree) -> DataFrame:
    """One row for each AREA that an END_AREA closes, with the last terrain, music and dialog between them."""
    rows = tree.calls(SCRIPTS)
    opens, closes = F.col("name") == "AREA", F.col("text").startswith("END_AREA")
    rows = rows.withColumn("block", F.count(F.when(opens | closes, 1)).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("ends", F.lead(F.coalesce(closes, F.lit(False)), 1).over(Window.partitionBy("path").orderBy("line")))
    last = lambda macro, i: F.max_by(F.when((F.col("name") == macro) & (F.size("args") > i), _arg(i)), F.when((F.col("name") == macro) & (F.size("args") > i), F.col("line")))
    first = lambda i: F.max(F.when(opens, F.coalesce(_arg(i), F.lit(""))))
    blocks = rows.groupBy("level", "path", "block").agg(
        F.bool_or(opens).alias("opened"), F.bool_or("ends").alias("ended"), first(0).alias("index"), first(1).alias("geo"),
        last("TERRAIN_TYPE", 0).alias("terrain_type"), last("SET_BACKGROUND_MUSIC", 1).alias("background_music"), last("SHOW_DIALOG", 1).alias("dialog"),
    )
    blocks = blocks.filter("opened and ended")
    return blocks.select("level", F.coalesce(F.col("index").try_cast("int"), F.lit(0)).alias("area"), "geo", F.coalesce("terrain_type", F.lit("")).alias("terrain_type"), "background_music", "dialog")


@builder
def model_load(tree: Tree) -> DataFrame:
    """The script that all levels share counts as the level common."""
    rows = tree.calls(SCRIPTS + r"|levels/scripts\.c").filter(F.col("name").isin("LOAD_MODEL_FROM_GEO", "LOAD_MODEL_FROM_DL"))
    geo = F.col("name") == "LOAD_MODEL_FROM_GEO"
    rows = rows.filter(_needs(F.size("args") >= F.when(geo, 2).otherwise(3), "a model load"))
    return rows.select(F.when(F.col("level") == "", "common").otherwise(F.col("level")).alias("level"), _arg(0).alias("model_name"), _arg(1).alias("geo"), F.when(~geo, _arg(2)).alias("layer"), F.when(geo, "geo").otherwise("dl").alias("kind"))


@builder
def constant(tree: Tree) -> DataFrame:
    """Of a name that is given twice the first counts, the enum before the defines."""
    nodes = tree.enum(r"src/game/level_update\.h", "WarpNodes").select("name", F.lit(0).alias("rank"), "ord", "value", F.lit("warp_nodes").alias("source"))
    defines = tree.texts(r"include/object_constants\.h").select(F.posexplode(defines_of(F.col("text"))).alias("ord", "d"))
    rows = nodes.union(defines.select("d.name", F.lit(1), "ord", "d.value", F.lit("object_constants")))
    return first_row(rows, ["name"], ["rank", "ord"]).select("name", "value", "source")


@builder
def camera_trigger(tree: Tree) -> DataFrame:
    """Rows of the trigger tables; a table that no level names keeps a null level. Rows of another shape are left out."""
    path = r"src/game/camera\.c"
    started = F.when(F.col("text").startswith("struct") & F.col("text").contains("="), _array_named("CameraTrigger", "sCam")).otherwise("")
    event = F.when(started != "", started).when(F.col("text").startswith("}"), "")
    rows = tree.lines(path).withColumn("camera_table", last_seen(event, ["path"], ["line"]))
    bare = without_comments(F.col("text"))
    rows = rows.filter(bare.rlike(r"^\{.*\}") & ~bare.contains("NULL_TRIGGER") & (F.col("camera_table") != ""))
    rows = rows.withColumn("args", F.transform(split_top_level(F.regexp_extract(bare, r"^\{(.*)\}", 1)), lambda p: F.trim(p))).filter("size(args) = 9")
    names = ["area", None, "center_x", "center_y", "center_z", "bounds_x", "bounds_y", "bounds_z", "bounds_yaw"]
    numbers = {name: int_token(_arg(i)).cast("int") for i, name in enumerate(names) if name}
    rows = rows.withColumns({**numbers, "event": _arg(1)}).dropna(subset=list(numbers))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("path", "camera_table").orderBy("line")) - 1)
    wired = tree.calls(r"levels/level_defines\.h").filter("name = 'DEFINE_LEVEL' and size(args) >= 5")
    wired = wired.groupBy(F.element_at("args", -1).alias("camera_table")).agg(F.max_by(_arg(3), "line").alias("level")).filter("camera_table not in ('', '_')")
    above = r"(?s)((?:/\*(?:(?!\*/).)*+\*/|//[^\n]*)[ \t]*\n(?:[ \t]*//[^\n]*\n)*)[ \t]*struct CameraTrigger "
    heads = F.regexp_extract_all("text", F.lit(above + r"sCam\w+\[\]"), 0)
    docs = tree.texts(path).select(F.explode(heads).alias("head"))
    words = F.regexp_replace(F.regexp_extract("head", above, 1), r"(?m)^[ \t]*(?:/+\**|\*+/?)|\*+/", " ")
    docs = docs.select(F.regexp_extract("head", r"(sCam\w+)\[\]$", 1).alias("camera_table"), F.trim(F.regexp_replace(words, r"\s+", " ")).alias("doc"))
    rows = rows.join(wired, "camera_table", "left").join(docs, "camera_table", "left")
    return rows.select("level", "camera_table", "seq", "area", "event", *[n for n in names[2:]], "doc", F.col("path").alias("file"), "line")


def _save_layout(tree: Tree, part: str) -> DataFrame:
    """The three short files that tell the layout, side by side in one row."""
    told = tree.texts(r"src/game/save_file\.h|include/types\.h|levels/course_defines\.h")
    row = told.agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("files"))
    return row.select(F.inline(layout_of(F.col("files"))[part]))


@builder
def save_struct(tree: Tree) -> DataFrame:
    return _save_layout(tree, "structs")


@builder
def save_field(tree: Tree) -> DataFrame:
    return _save_layout(tree, "fields")


@builder
def save_flag(tree: Tree) -> DataFrame:
    """Flags of a single bit."""
    rows = tree.texts(r"src/game/save_file\.h").select(F.explode(defines_of(active_text(F.col("text")))).alias("d"))
    rows = rows.filter((F.col("d.value") > 0) & (F.bit_count("d.value") == 1) & F.col("d.name").startswith("SAVE_FLAG_"))
    return rows.select(F.lit("flags").alias("flag_group"), F.bit_count(F.col("d.value") - 1).alias("bit"), F.col("d.name").alias("flag_name"), F.col("d.value").alias("mask"))
