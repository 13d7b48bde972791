"""Questions that join several relations of a source tree, each a plan over the tables and views by name.

`QUESTIONS[name](t, ...)` answers one; what a reader picks is an argument and reaches
the plan as a literal. `ask` is for texts of one's own: Spark SQL whose `:name`
parameters are bound, never pasted in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import reachable
from .invariants import CALLS
from .tabs import placements
from .views import Tables

QUESTIONS: dict[str, Callable[..., DataFrame]] = {}
#: How many acts a main course has.
ACTS = 6


def question(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    QUESTIONS[plan.__name__] = plan
    return plan


def ask(spark: SparkSession, sql: str, **values: object) -> DataFrame:
    """The answer to a text with `:name` parameters; a value that no parameter takes is an error."""
    if unknown := [v for v in values if f":{v}" not in sql]:
        raise ValueError(f"the text has no parameter {', '.join(unknown)}")
    return spark.sql(sql, args=values)


@question
def crowding(t: Tables, least: int = 1) -> DataFrame:
    """(level, area, things, share_of_level, kinds): how a level's placements are spread over its areas."""
    each = placements(t).groupBy("level", "area").agg(F.count("*").alias("things"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    whole = each.groupBy("level").agg(F.sum("things").alias("whole"))
    return each.join(whole, "level").filter(F.col("things") >= least).select("level", "area", "things", (F.col("things") / F.col("whole")).alias("share_of_level"), "kinds")


@question
def acts_shown(t: Tables) -> DataFrame:
    """(level, act, objects, only_then): how many objects an act shows, and how many of them no other act does."""
    shown = F.array_compact(F.array(*(F.when(F.col(f"in_act_{i}"), F.lit(i)) for i in range(1, ACTS + 1))))
    rows = t["object"].select("level", shown.alias("acts"), F.explode(shown).alias("act"))
    return rows.groupBy("level", "act").agg(F.count("*").alias("objects"), F.count_if(F.size("acts") == 1).alias("only_then"))


@question
def progeny(t: Tables, behavior: str) -> DataFrame:
    """(descendant, direct, lists): everything that a behaviour can bring forth through others, by scripts, code or tables."""
    edges = t["behavior_all_spawns"].filter("spawned_behavior IS NOT NULL").select(F.col("behavior_name").alias("src"), F.col("spawned_behavior").alias("dst"))
    root = t["behavior_all_spawns"].sparkSession.createDataFrame([(behavior,)], "root string")
    found = reachable(edges, root).filter(F.col("node") != behavior).select(F.col("node").alias("descendant"))
    children = edges.filter(F.col("src") == behavior).select(F.col("dst").alias("descendant"), F.lit(True).alias("own")).distinct()
    lists = t["behavior"].select(F.col("behavior_name").alias("descendant"), F.col("obj_list").alias("lists"))
    return found.join(children, "descendant", "left").join(lists, "descendant", "left").select("descendant", F.coalesce("own", F.lit(False)).alias("direct"), "lists")


@question
def roles(t: Tables) -> DataFrame:
    """(behavior, spawns, sounds, models, dialogs, morphs, seeks, placed): what each behaviour's code does, and how often it stands in a level."""
    ones = reduce(DataFrame.union, (t[f"behavior_calls_{name}"].select(F.col("behavior_name").alias("behavior"), F.lit(f"{name}s").alias("does")) for name in CALLS))
    placed = placements(t, "preset_name", outer=False).filter("behavior IS NOT NULL").select("behavior", F.lit("placed"))
    return ones.union(placed).groupBy("behavior").pivot("does", [*(f"{n}s" for n in CALLS), "placed"]).count().fillna(0)


@question
def mute(t: Tables) -> DataFrame:
    """(behavior, placed): placed behaviours with native code of their own that neither sound nor speak."""
    heard = t["behavior_calls_sound"].select("behavior_name").union(t["behavior_calls_dialog"].select("behavior_name"))
    own = t["behavior_native"].select("behavior_name").distinct().join(heard, "behavior_name", "left_anti").withColumnRenamed("behavior_name", "behavior")
    return placements(t, "preset_name", outer=False).join(own, "behavior", "left_semi").groupBy("behavior").agg(F.count("*").alias("placed"))


@question
def unheard_dialogs(t: Tables) -> DataFrame:
    """(dialog_name, words): dialogs that no code, no area and no placed parameter names."""
    named = [t["behavior_calls_dialog"].select("dialog"), t["area"].select("dialog"), t["object"].select("bhv_param"), t["macro_object"].select("bhv_param"), t["macro_preset"].select("param")]
    used = reduce(DataFrame.union, named).toDF("dialog_name").filter("dialog_name IS NOT NULL")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return t["dialog"].join(used, "dialog_name", "left_anti").select("dialog_name", words.alias("words"))


@question
def one_way_warps(t: Tables) -> DataFrame:
    """(source, target, nodes): pairs of levels of which only the first leads to the second."""
    names = t["level"].select("level_name", "folder")
    ways = t["warp"].join(names.withColumnRenamed("folder", "level"), "level").select(F.col("level_name").alias("source"), F.col("dest_level").alias("target"))
    ways = ways.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("nodes"))
    back = ways.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return ways.join(back, ["source", "target"], "left_anti")


@question
def twin_presets(t: Tables) -> DataFrame:
    """(behavior, model_name, names): presets that differ in nothing but name and parameter."""
    names = F.array_sort(F.collect_set("macro_name"))
    return t["macro_preset"].groupBy("behavior", "model_name").agg(names.alias("names")).filter(F.size("names") > 1)


@question
def dead_ends(t: Tables) -> DataFrame:
    """(action, ways_in): actions that some other leads to and that lead to none but themselves."""
    ways = t["mario_all_transitions"].filter("action_name <> to_action")
    return ways.groupBy(F.col("to_action").alias("action")).agg(F.count_distinct("action_name").alias("ways_in")).join(ways.select(F.col("action_name").alias("action")), "action", "left_anti")


@question
def flag_company(t: Tables, flag: str) -> DataFrame:
    """(other, together, share): flags that actions with this one have beside it, and in what share of those actions."""
    flags = t["mario_action"].select("action_name", F.array_distinct(F.from_json("flags_json", "array<string>")).alias("flags")).filter(F.array_contains("flags", flag))
    both = flags.select(F.explode("flags").alias("other")).groupBy("other").agg(F.count("*").alias("together"))
    all_ = both.filter(F.col("other") == flag).select(F.col("together").alias("n"))  # one row
    return both.filter(F.col("other") != flag).join(F.broadcast(all_)).select("other", "together", (F.col("together") / F.col("n")).alias("share"))


@question
def holes(t: Tables) -> DataFrame:
    """(struct_name, after, at, bytes): bytes of a save structure that no field fills, and the field before them."""
    fields = t["save_field"].select("struct_name", F.struct(F.col("offset").cast("long").alias("at"), F.col("size").cast("long").alias("size"), F.col("field_name").alias("name")).alias("f"))
    all_ = fields.groupBy("struct_name").agg(F.array_sort(F.collect_list("f")).alias("fields")).join(t["save_struct"].select("struct_name", F.col("size").cast("long").alias("whole")), "struct_name")
    nexts = F.concat(F.transform(F.slice("fields", 2, F.size("fields")), lambda f: f["at"]), F.array("whole"))  # a struct's few fields
    gaps = F.zip_with("fields", nexts, lambda f, n: F.struct(f["name"].alias("after"), (f["at"] + f["size"]).alias("at"), (n - f["at"] - f["size"]).alias("bytes")))
    return all_.select("struct_name", F.explode(gaps).alias("g")).select("struct_name", "g.*").filter("bytes > 0")


@question
def shared_music(t: Tables) -> DataFrame:
    """(background_music, levels): tunes of more than one level, with their levels' folders in order."""
    rows = t["area"].filter("background_music IS NOT NULL").groupBy("background_music").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    return rows.filter(F.size("levels") > 1)
