"""Relations and audits over the tables of a source tree.

Each view takes the tables by name and is a plan over them; nothing is computed
before it is read. Audits show what no relation covers, so that nothing is lost
unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]
VIEWS: dict[str, Callable[[Tables], DataFrame]] = {}

# The calls that each relation reads.
SPAWN_CALLS = (
    "spawn_object", "spawn_object_relative", "spawn_object_relative_with_scale", "spawn_object_abs_with_rot",
    "spawn_object_at_origin", "spawn_object_rel_with_rot", "spawn_object_with_scale", "spawn_child_obj_relative",
)
SOUND_CALLS = ("cur_obj_play_sound_1", "cur_obj_play_sound_2", "cur_obj_play_sound_at_anim_range", "play_sound", "create_sound_spawner")
MODEL_CALLS = ("cur_obj_set_model",)
DIALOG_CALLS = ("cur_obj_update_dialog", "cur_obj_update_dialog_with_cutscene", "cutscene_object_with_dialog", "create_dialog_box_with_response")
MORPH_CALLS = ("cur_obj_set_behavior", "obj_set_behavior")
SEEK_CALLS = ("cur_obj_nearest_object_with_behavior", "obj_nearest_object_with_behavior", "cur_obj_has_behavior", "obj_has_behavior")
BEHAVIOR, MODEL, SOUND, DIALOG = "^bhv[A-Z0-9]", "^MODEL_", "^SOUND_", "^DIALOG_[0-9]"


def view(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    VIEWS[plan.__name__] = plan
    return plan


def _args() -> Column:
    return F.from_json("args_json", "array<string>")


def _at(i: int) -> Column:
    return F.get(_args(), F.lit(i))


def _first(pattern: str) -> Column:
    return F.get(F.filter(_args(), lambda a: a.rlike(pattern)), F.lit(0))


def _counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


@view
def behavior_spawn(t: Tables) -> DataFrame:
    """What scripts spawn; a command with a parameter carries it first."""
    rows = t["behavior_command"].filter(F.col("command").isin("SPAWN_CHILD", "SPAWN_OBJ", "SPAWN_CHILD_WITH_PARAM"))
    more = F.col("command") == "SPAWN_CHILD_WITH_PARAM"
    kind = F.when(more, "child_with_param").when(F.col("command") == "SPAWN_OBJ", "obj").otherwise("child")
    return rows.select(
        "behavior_name", "seq", kind.alias("kind"), F.when(more, _at(1)).otherwise(_at(0)).alias("spawned_model"),
        F.when(more, _at(2)).otherwise(_at(1)).alias("spawned_behavior"), F.when(more, _at(0)).alias("bhv_param"),
    )


@view
def behavior_native(t: Tables) -> DataFrame:
    return t["behavior_command"].filter("command = 'CALL_NATIVE'").select("behavior_name", "seq", _at(0).alias("func"))


@view
def behavior_resource(t: Tables) -> DataFrame:
    command = F.col("command")
    kind = F.when(command == "LOAD_ANIMATIONS", "animation").when(command == "LOAD_COLLISION_DATA", "collision").when(command == "SET_MODEL", "model")
    return t["behavior_command"].withColumn("kind", kind).filter("kind is not null").select("behavior_name", "seq", "kind", F.when(F.col("kind") == "animation", _at(1)).otherwise(_at(0)).alias("symbol"))


def _relation(t: Tables, calls: tuple[str, ...], pattern: str, target: str, **more: str) -> DataFrame:
    """Calls whose target stands there as a literal."""
    rows = t["behavior_call"].filter(F.col("call").isin(*calls)).withColumn(target, _first(pattern)).filter(F.col(target).isNotNull())
    return rows.select("behavior_name", "function", "file", "line", "call", target, *(_first(p).alias(name) for name, p in more.items()))


@view
def behavior_calls_spawn(t: Tables) -> DataFrame:
    return _relation(t, SPAWN_CALLS, BEHAVIOR, "spawned_behavior", spawned_model=MODEL)


@view
def behavior_calls_sound(t: Tables) -> DataFrame:
    return _relation(t, SOUND_CALLS, SOUND, "sound")


@view
def behavior_calls_model(t: Tables) -> DataFrame:
    return _relation(t, MODEL_CALLS, MODEL, "model")


@view
def behavior_calls_dialog(t: Tables) -> DataFrame:
    return _relation(t, DIALOG_CALLS, DIALOG, "dialog")


@view
def behavior_calls_morph(t: Tables) -> DataFrame:
    return _relation(t, MORPH_CALLS, BEHAVIOR, "becomes_behavior")


@view
def behavior_calls_seek(t: Tables) -> DataFrame:
    return _relation(t, SEEK_CALLS, BEHAVIOR, "target_behavior")


@view
def behavior_call_unclassified(t: Tables) -> DataFrame:
    """Calls that no relation reads, the most frequent first."""
    known = SPAWN_CALLS + SOUND_CALLS + MODEL_CALLS + DIALOG_CALLS + MORPH_CALLS + SEEK_CALLS
    return _counted(t["behavior_call"].filter(~F.col("call").isin(*known)), "call")


@view
def behavior_all_spawns(t: Tables) -> DataFrame:
    part = lambda rows, origin: rows.select("behavior_name", "spawned_behavior", "spawned_model", F.lit(origin).alias("origin"))
    script = behavior_spawn(t).filter("spawned_behavior is not null")
    return part(script, "script").unionAll(part(behavior_calls_spawn(t), "c")).unionAll(part(t["behavior_data_spawn"], "data"))


@view
def mario_transition(t: Tables) -> DataFrame:
    actions = t["mario_action"].select(F.col("action_name").alias("to_action"))
    rows = t["mario_action_call"].filter("gated_by is null").select("action_name", F.col("target").alias("to_action"))
    return rows.join(actions, "to_action", "left_semi").select("action_name", "to_action").distinct()


@view
def mario_transition_refuted(t: Tables) -> DataFrame:
    rows = t["mario_action_call"].filter("gated_by is not null")
    return rows.select("action_name", F.col("target").alias("to_action"), "gated_by").distinct().orderBy("to_action", "action_name")


@view
def mario_action_call_unclassified(t: Tables) -> DataFrame:
    actions = t["mario_action"].select(F.col("action_name").alias("target"))
    return _counted(t["mario_action_call"].filter("target is not null").join(actions, "target", "left_anti"), "target")


@view
def mario_all_transitions(t: Tables) -> DataFrame:
    return mario_transition(t).union(t["mario_action_data_transition"].select("action_name", "to_action")).distinct()


@view
def camera_trigger_unused(t: Tables) -> DataFrame:
    return _counted(t["camera_trigger"].filter("level is null"), "camera_table")


@view
def save_struct_coverage(t: Tables) -> DataFrame:
    """How much of each struct its fields fill; padding is the rest."""
    sizes = t["save_field"].groupBy("struct_name").agg(F.sum("size").alias("fields_size"))
    filled = F.coalesce("fields_size", F.lit(0))
    rows = t["save_struct"].join(sizes, "struct_name", "left")
    return rows.select("struct_name", "size", filled.alias("fields_size"), (F.col("size") - filled).alias("padding_bytes")).orderBy("struct_name")
