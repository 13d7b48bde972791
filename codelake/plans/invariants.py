"""What must hold between the tables and views of a source tree: a report with a row for each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import check, coverage, disjoint, partition, subset, union_of
from .views import DIALOG_CALLS, MODEL_CALLS, MORPH_CALLS, SEEK_CALLS, SOUND_CALLS, SPAWN_CALLS, Tables

#: Calls that each relation reads.
CALLS = {"spawn": SPAWN_CALLS, "sound": SOUND_CALLS, "model": MODEL_CALLS, "dialog": DIALOG_CALLS, "morph": MORPH_CALLS, "seek": SEEK_CALLS}
#: The column that says what a relation's call is about.
TARGETS = {"spawn": "spawned_behavior", "sound": "sound", "model": "model", "dialog": "dialog", "morph": "becomes_behavior", "seek": "target_behavior"}


def call_space(t: Tables) -> DataFrame:
    """(parts, n): every call is read by one relation or counted as residue; read off behavior_call alone, in one pass."""
    parts = {name: F.col("call").isin(*calls) for name, calls in CALLS.items()}
    residue = reduce(lambda out, holds: out & ~holds, parts.values(), F.lit(True))
    return coverage(t["behavior_call"], parts | {"residue": residue})


def call_report(t: Tables) -> DataFrame:
    """(claim, broken): calls that several relations read, that none does, and the residue against its view."""
    space = call_space(t)
    listed = t["behavior_call_unclassified"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("listed"))
    rows = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    counts = space.agg(rows(F.size("parts") > 1).alias("twice"), rows(F.size("parts") == 0).alias("nowhere"), rows(F.array_contains("parts", "residue")).alias("residue"))
    own = counts.crossJoin(F.broadcast(listed))  # one row each
    claims = {"each call in one relation at most": F.col("twice"), "each call in a relation or in the residue": F.col("nowhere"), "the residue is listed": F.abs(F.col("residue") - F.col("listed"))}
    return own.select(F.explode(F.array(*(F.struct(F.lit(k).alias("claim"), v.alias("broken")) for k, v in claims.items()))).alias("c")).select("c.*")


def target_report(t: Tables) -> DataFrame:
    """(claim, broken): rows of each relation without a target."""
    one = lambda name: t[f"behavior_calls_{name}"].agg(F.lit(f"targets of {name}").alias("claim"), F.count_if(F.col(TARGETS[name]).isNull()).alias("broken"))
    return reduce(DataFrame.union, (one(name) for name in CALLS))


def transition_report(t: Tables) -> DataFrame:
    """(claim, broken): all transitions are the literal ones and those of values, nothing more, and no refuted one is a live one."""
    data = t["mario_action_data_transition"].select("action_name", "to_action").distinct()
    refuted = t["mario_transition_refuted"].select("action_name", "to_action").distinct()
    known = {"all": t["mario_all_transitions"], "literal": t["mario_transition"], "data": data, "refuted": refuted}
    claims = [union_of("all", "literal", "data"), subset("literal", "all"), subset("data", "all"), partition("all", "literal", "data"), disjoint("literal", "refuted")]
    return check(known, claims)


def report(t: Tables) -> DataFrame:
    """(claim, broken) of everything above; all is well where broken is 0."""
    return call_report(t).union(target_report(t)).union(transition_report(t))
