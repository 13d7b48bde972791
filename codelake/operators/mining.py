"""Whose code calls what: call sites, their owners by reachability, and spawns that data decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import functions_of, tables_of
from ..functions.text import json_list
from ..plans.views import SPAWN_CALLS
from .graph import cut, reachable
from .state import first_row

#: Fixed value: calls f(table, ...) of it reach every function that the table lists.
DISPATCHER = "cur_obj_call_action_function"
LITERAL = r"^bhv[A-Z0-9]\w*$"


def defined(texts: DataFrame) -> DataFrame:
    """(path, def_index, function, line, params, calls, returns, switch, words) of the files (path, text)."""
    rows = texts.select("path", F.posexplode(functions_of(F.col("text"))).alias("def_index", "f"))
    return rows.select("path", "def_index", F.col("f.name").alias("function"), *(F.col(f"f.{c}").alias(c) for c in ("line", "params", "calls", "returns", "switch", "words")))


def one_each(functions: DataFrame, pick: Callable[[Column], Column]) -> DataFrame:
    """Of the definitions of a function the first (F.min) or the last (F.max)."""
    return functions.groupBy("function").agg(pick(F.struct("path", "def_index", *(c for c in functions.columns if c not in ("path", "def_index", "function")))).alias("d")).select("function", "d.*")


def listed(texts: DataFrame) -> DataFrame:
    """(table, place, model, behavior, function): what arrays list; of two arrays of a name the last counts."""
    rows = texts.select("path", F.posexplode(tables_of(F.col("text"))).alias("def_index", "t"))
    rows = rows.groupBy(F.col("t.name").alias("table")).agg(F.max_by("t.rows", F.struct("path", "def_index")).alias("rows"))
    return rows.select("table", F.posexplode("rows").alias("place", "r")).select("table", "place", "r.*")


def mentioning(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The files that mention a name of names (function) before a parenthesis."""
    said = texts.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)\("), 1))).alias("function"))
    return texts.join(said.join(names, "function", "left_semi").select("path").distinct(), "path", "left_semi")


def call_sites(functions: DataFrame) -> DataFrame:
    """(path, def_index, function, params, seq, call, args, line, condition)."""
    return functions.select("path", "def_index", "function", "params", F.explode("calls").alias("c")).select("path", "def_index", "function", "params", "c.*")


def edges_of(sites: DataFrame, tables: DataFrame, followed: DataFrame) -> DataFrame:
    """(src, dst): calls, and those through a dispatched table, of functions in followed (function)."""
    direct = sites.select(F.col("function").alias("src"), F.col("call").alias("dst"))
    through = sites.filter(F.col("call") == DISPATCHER).select(F.col("function").alias("src"), F.get("args", F.lit(0)).alias("table"))
    through = through.join(tables.filter("function is not null").select("table", F.col("function").alias("dst")), "table").select("src", "dst")
    return direct.union(through).join(followed.select(F.col("function").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def behavior_code(inside: DataFrame, outside: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(behavior_call, behavior_data_spawn) from behaviour files, other files, and script commands.

    Functions of behaviour files are followed; a native root that only another
    file defines gives its own calls alone. Of two definitions of a behaviour
    function the last counts, of two outside the first.
    """
    roots = commands.filter("command = 'CALL_NATIVE' and args <> ''").select(F.col("args").alias("function"), "behavior_name").distinct()
    own = cut(one_each(defined(inside), F.max))
    names = own.select("function")
    others = mentioning(outside, roots.select("function").distinct().join(names, "function", "left_anti"))
    foreign = one_each(defined(others).join(roots, "function", "left_semi").join(names, "function", "left_anti"), F.min)
    functions = cut(own.unionByName(foreign))
    tables = cut(listed(inside.unionByName(others)))
    sites = call_sites(functions)
    started = roots.join(functions.select("function"), "function", "left_semi")
    reach = reachable(edges_of(sites, tables, names), started.select(F.col("function").alias("root")))
    owners = cut(reach.join(started.withColumnRenamed("function", "root"), "root").select(F.col("node").alias("function"), "behavior_name").distinct())
    calls = sites.join(owners, "function").select(
        "behavior_name", "function", "seq", "call", F.array_join("args", ", ").alias("args"), json_list(F.col("args")).alias("args_json"), F.col("path").alias("file"), "line"
    )
    return calls, _data_spawns(sites, tables, owners)


def _literal(args: Column, pattern: str) -> Column:
    return F.get(F.filter(args, lambda a: a.rlike(pattern)), F.lit(0))


def _data_spawns(sites: DataFrame, tables: DataFrame, owners: DataFrame) -> DataFrame:
    """Spawns whose behaviour stands in a table, or comes in by a parameter: from every caller's argument, for the caller's owners."""
    rows = tables.filter("behavior is not null").select("table", "place", F.col("model").alias("spawned_model"), F.col("behavior").alias("spawned_behavior"))
    named = F.filter("args", lambda a: (a == "bhv") | F.lower(a).contains("behavior"))
    spawns = sites.filter(F.col("call").isin(*SPAWN_CALLS) & ~F.col("function").isin(*SPAWN_CALLS) & _literal(F.col("args"), LITERAL).isNull())
    base = F.regexp_extract(F.try_element_at(named, F.lit(-1)), r"^([A-Za-z_]\w*)", 1)
    spawns = spawns.select("path", "def_index", "function", "seq", "line", "params", base.alias("base")).filter("base <> ''")
    nothing = F.lit(None)
    here = spawns.join(rows, spawns["base"] == rows["table"]).select(
        "path", "def_index", "seq", "line", "function", F.col("function").alias("payer"), F.col("base").alias("source"),
        nothing.cast("string").alias("from_path"), nothing.cast("int").alias("from_def"), nothing.cast("int").alias("from_seq"), "place", "spawned_model", "spawned_behavior",
    )
    # array_position is 0 for a name that is no parameter.
    open_ = spawns.join(rows.select(F.col("table").alias("base")).distinct(), "base", "left_anti").withColumn("at", F.array_position("params", F.col("base"))).filter("at > 0")
    callers = sites.select(F.col("call").alias("function"), F.col("function").alias("payer"), "args", F.col("path").alias("from_path"), F.col("def_index").alias("from_def"), F.col("seq").alias("from_seq"))
    passed = open_.join(callers, "function").withColumn("passed", F.get("args", (F.col("at") - 1).cast("int"))).filter("passed is not null")
    common = ["path", "def_index", "seq", "line", "function", "payer"]
    whence = ["from_path", "from_def", "from_seq"]
    literal = passed.filter(F.col("passed").rlike(LITERAL)).select(
        *common, F.lit("arg").alias("source"), *whence, F.lit(0).alias("place"), _literal(F.col("args"), "^MODEL_").alias("spawned_model"), F.col("passed").alias("spawned_behavior")
    )
    tabled = passed.filter(~F.col("passed").rlike(LITERAL)).withColumn("table", F.regexp_extract("passed", r"^([A-Za-z_]\w*)", 1)).join(rows, "table")
    tabled = tabled.select(*common, F.col("passed").alias("source"), *whence, "place", "spawned_model", "spawned_behavior")
    found = here.unionByName(literal).unionByName(tabled).join(owners.withColumnRenamed("function", "payer"), "payer")
    found = first_row(found.drop("payer"), ["behavior_name", "spawned_behavior"], ["path", "def_index", "seq", *whence, "place"])
    return found.select("behavior_name", "spawned_behavior", "spawned_model", "source", "function", F.col("path").alias("file"), "line")
