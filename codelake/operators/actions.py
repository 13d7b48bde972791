"""The state machine that action handlers make: its nodes, the calls that change the action, and the edges only data shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import defines_of, int_token
from ..functions.text import hex_of, json_list
from .graph import cut, reachable
from .mining import call_sites, defined, edges_of, one_each
from .state import first_row

# What changes the action, what that runs itself, and where a value keeps its group.
SETTERS = ("set_mario_action", "drop_and_set_mario_action", "hurt_and_set_mario_action", "set_jumping_action")
SETTER_PARTS = ("set_mario_action_airborne", "set_mario_action_moving", "set_mario_action_submerged", "set_mario_action_cutscene")
GROUP_MASK = 0x1C0
DISPATCHERS = "mario\\_execute\\_%\\_action"
OWN_VALUE, FLAG = "m->action&", "ACT_FLAG_"


def _hexadecimal(headers: DataFrame) -> DataFrame:
    """(name, value) of the defines whose text is one hexadecimal number."""
    rows = headers.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").startswith("#define"))
    words = F.split(F.trim("line"), r"\s+")
    rows = rows.select(F.get(words, F.lit(1)).alias("name"), F.get(words, F.lit(2)).alias("number"))
    return rows.filter(F.lower("number").startswith("0x")).select("name", int_token(F.col("number")).alias("value")).dropna()


def _named(headers: DataFrame, prefix: str) -> DataFrame:
    """(name without the prefix, value) of the defines that start with it and come to a number."""
    rows = headers.select(F.explode(defines_of(F.col("text"))).alias("d")).filter(F.col("d.name").startswith(prefix))
    return rows.select(F.substring("d.name", F.lit(len(prefix) + 1), F.length("d.name")).alias("name"), "d.value")


def nodes(headers: DataFrame, functions: DataFrame, handlers: DataFrame) -> DataFrame:
    """Actions with group and flags out of their value's bits, and the handler that runs them."""
    other = F.col("name").startswith("ACT_FLAG_") | F.col("name").startswith("ACT_GROUP_") | F.col("name").endswith("_MASK")
    actions = _hexadecimal(headers).filter(F.col("name").startswith("ACT_") & ~other).select(F.col("name").alias("action_name"), "value")
    groups = _named(headers, "ACT_GROUP_").filter("name <> 'MASK'").select(F.col("name").alias("group_name"), F.col("value").alias("group"))
    bits = _named(headers, FLAG).filter("bit_count(value) = 1").select(F.col("name").alias("flag"), F.bit_count(F.col("value") - 1).alias("bit"))
    held = actions.select("action_name", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")).filter(F.expr("(shiftright(value, bit) & 1) = 1"))
    flags = held.join(bits, "bit").groupBy("action_name").agg(F.sort_array(F.collect_list(F.struct("bit", "flag")))["flag"].alias("flags"))
    placed = functions.select(F.col("function").alias("handler"), F.col("path").alias("file"), "line")
    rows = actions.withColumn("group", F.when(F.col("value") != 0, F.col("value").bitwiseAND(GROUP_MASK))).join(groups, "group", "left")
    rows = rows.join(flags, "action_name", "left").join(handlers, "action_name", "left").join(placed, "handler", "left")
    flags_of = F.coalesce("flags", F.array().cast("array<string>"))
    return rows.select("action_name", hex_of(F.col("value")).alias("id"), "group_name", json_list(flags_of).alias("flags_json"), "handler", "file", "line", flags_of.alias("flags"))


def dispatched(functions: DataFrame) -> DataFrame:
    """(dispatcher, action_name, handler): labels of dispatchers' switches. Labels without a body share the next body's handler; default ends that."""
    cases = functions.filter(F.col("function").like(DISPATCHERS)).select(F.col("function").alias("dispatcher"), "path", F.posexplode("switch").alias("place", "c"))
    settled = F.when(F.col("c.label").isNull() | ~F.col("c.empty"), F.struct(F.when(F.col("c.label").isNotNull(), F.col("c.handler")).alias("handler")))
    following = Window.partitionBy("dispatcher").orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    cases = cases.withColumn("settled", F.first(settled, ignorenulls=True).over(following))
    return cases.filter("c.label is not null").select("dispatcher", "path", "place", F.col("c.label").alias("action_name"), F.col("settled.handler").alias("handler"))


def _masked(condition: Column) -> Column:
    """The (left, right) of every single & in a condition."""
    words = F.regexp_extract_all(condition, F.lit(r"(&&|\w+|\S)"), 1)
    around = lambda w, i: F.when(w == "&", F.array(F.get(words, i - 1), F.get(words, i + 1)))
    return F.filter(F.transform(words, around), lambda pair: pair.isNotNull())


def return_gates(functions: DataFrame) -> DataFrame:
    """(constant, flag): constants that are only ever returned under a test of a parameter for one flag."""
    shouted = lambda word: (F.upper(word) == word) & word.rlike("^[A-Z]\\w+$")
    rows = functions.filter(F.exists("params", lambda p: p.isNotNull())).select("params", F.explode("returns").alias("r")).filter(shouted(F.col("r.value")))
    pairs = F.flatten(F.transform("r.conditions", _masked))
    # A parameter may stand on either side of the flag.
    turned = F.flatten(F.transform(pairs, lambda p: F.array(p, F.reverse(p))))
    tested = F.filter(turned, lambda p: F.array_contains("params", F.get(p, F.lit(0))) & (F.upper(F.get(p, F.lit(1))) == F.get(p, F.lit(1))) & F.get(p, F.lit(1)).rlike("[A-Z]"))
    rows = rows.select(F.col("r.value").alias("constant"), F.get(F.get(tested, F.lit(0)), F.lit(1)).alias("flag"))
    return rows.groupBy("constant").agg(F.count_distinct("flag").alias("n"), F.count_if(F.col("flag").isNull()).alias("open"), F.min("flag").alias("flag")).filter("n = 1 and open = 0").select("constant", "flag")


def refuted(sites: DataFrame, functions: DataFrame, gates: DataFrame, owners: DataFrame) -> DataFrame:
    """(action_name, function, target, by): transitions in a case that only a flag makes possible, for actions whose code never passes the flag."""
    cases = sites.filter(F.col("call").isin(*SETTERS) & F.col("is_action")).select("function", "target", F.explode("cases").alias("constant")).join(gates, "constant")
    cases = cases.join(functions.select("function", "words"), "function").filter(~F.array_contains("words", F.col("flag"))).select("function", "target", "flag").distinct()
    callers = sites.select(F.col("call").alias("function"), F.col("function").alias("caller"), "args").join(cases.select("function", "flag").distinct(), "function")
    passing = callers.filter(F.exists("args", lambda a: F.regexp_like(a, F.concat(F.lit("\\b"), F.col("flag"), F.lit("\\b")))))
    valid = passing.join(owners.select(F.col("function").alias("caller"), "action_name"), "caller").select("function", "flag", "action_name").distinct()
    rows = cases.join(owners, "function").join(valid, ["function", "flag", "action_name"], "left_anti")
    return rows.groupBy("action_name", "function", "target").agg(F.max("flag").alias("by"))


def flag_gate(condition: Column, flags: Column) -> Column:
    """Why the action's own flags rule out a condition on them, else null.

    Without an || the condition is a row of tests joined by &&, each of which must
    hold: one of the value against a mask asks for any of the mask's flags, or for
    none of them if it is negated.
    """
    tests = F.filter(F.split(F.regexp_replace(condition, r"\s", ""), "&&"), lambda t: t.contains(OWN_VALUE))
    mask = lambda t: F.substring_index(F.substring_index(t, OWN_VALUE, -1), ")", 1)
    words = lambda t: F.filter(F.split(mask(t), r"\W+"), lambda w: w.startswith(FLAG))
    read = F.transform(tests, lambda t: F.struct(F.substring_index(t, OWN_VALUE, 1).endswith("!(").alias("negated"), words(t).alias("names")))
    held = lambda t: F.arrays_overlap(t["names"], F.transform(flags, lambda f: F.concat(F.lit(FLAG), f)))
    failed = F.filter(read, lambda t: (F.size(t["names"]) > 0) & (t["negated"] == held(t)))
    first = F.get(F.concat(F.filter(failed, lambda t: t["negated"]), F.filter(failed, lambda t: ~t["negated"])), F.lit(0))
    names = F.array_join(first["names"], " | ")
    return F.when(~condition.contains("||"), F.when(first["negated"], F.concat(F.lit("!("), names, F.lit(")"))).otherwise(names))


def data_transitions(sites: DataFrame, owners: DataFrame, actions: DataFrame, literal_edges: DataFrame) -> DataFrame:
    """Edges whose target is an expression with literals in it, or a parameter that a caller fills with a literal; without those that literals show."""
    known = actions.select(F.col("action_name").alias("to_action"))
    open_ = sites.filter(F.col("call").isin(*SETTERS) & F.col("target").isNotNull() & ~F.col("is_action"))
    said = open_.select("*", F.posexplode(F.split("target", r"\W+")).alias("place", "to_action"))
    said = said.join(known, "to_action", "left_semi")
    expression = said.select(
        F.col("function").alias("at"), F.col("seq").alias("at_seq"), F.lit("").alias("from_path"), F.lit(0).alias("from_def"), "place", "function", "to_action", F.lit("expr").alias("source"), "condition", F.col("path").alias("file"), "line"
    )
    forwarded = open_.join(said.select("function", "seq").distinct(), ["function", "seq"], "left_anti").withColumn("slot", F.array_position("params", F.col("target"))).filter("slot > 0")
    forwarded = forwarded.select(F.col("function").alias("at"), F.col("seq").alias("at_seq"), "target", "slot")
    callers = sites.select(F.col("call").alias("at"), "function", F.col("seq").alias("place"), F.col("path").alias("from_path"), F.col("def_index").alias("from_def"), "args", "condition", "line")
    passed = forwarded.join(callers, "at").withColumn("to_action", F.get("args", (F.col("slot") - 1).cast("int"))).join(known, "to_action", "left_semi")
    passed = passed.select("at", "at_seq", "from_path", "from_def", "place", "function", "to_action", F.col("target").alias("source"), "condition", F.col("from_path").alias("file"), "line")
    rows = expression.unionByName(passed).join(owners, "function").join(literal_edges, ["action_name", "to_action"], "left_anti")
    rows = first_row(rows, ["action_name", "to_action"], ["at", "at_seq", "from_path", "from_def", "place"])
    return rows.select("action_name", "to_action", "source", "condition", "function", "file", "line")


def state_machine(headers: DataFrame, sources: DataFrame, steps: DataFrame) -> dict[str, DataFrame]:
    """The three action tables from (path, text) of headers, of the files with handlers, and of those that only return step results.

    A function belongs to every action whose handler reaches it without going
    through a setter, and code that a dispatcher runs around its switch belongs
    to all actions of the switch.
    """
    every = cut(defined(sources.unionByName(steps)))
    functions = cut(one_each(every.join(sources.select("path"), "path", "left_semi"), F.max))
    labels = cut(dispatched(functions))
    handlers = labels.filter("handler is not null").groupBy("action_name").agg(F.max_by("handler", F.struct("path", "place")).alias("handler"))
    actions = cut(nodes(headers, functions, handlers))
    names = actions.select("action_name")
    runs = handlers.join(names, "action_name", "left_semi").join(functions.select(F.col("function").alias("handler")), "handler", "left_semi")
    sites = call_sites(functions).withColumn("target", F.get("args", F.lit(1)))
    marked = names.select(F.col("action_name").alias("target"), F.lit(True).alias("is_action"))
    sites = cut(sites.join(marked, "target", "left").withColumn("is_action", F.coalesce("is_action", F.lit(False))))
    followed = functions.select("function").filter(~F.col("function").isin(*SETTERS, *SETTER_PARTS))
    ambient = followed.join(handlers.select(F.col("handler").alias("function")), "function", "left_anti")
    direct = lambda inside: edges_of(sites, sites.limit(0).select(F.lit("").alias("table"), "function"), inside)
    reach = reachable(direct(followed), runs.select(F.col("handler").alias("root"))).join(runs.withColumnRenamed("handler", "root"), "root")
    group = labels.join(names, "action_name", "left_semi").select(F.col("dispatcher").alias("root"), "action_name").distinct()
    shared = reachable(direct(ambient), group.select("root")).join(group, "root")
    owners = cut(reach.unionByName(shared).select(F.col("node").alias("function"), "action_name").distinct())
    ruled_out = refuted(sites, functions, return_gates(every), owners)
    calls = sites.filter(F.col("call").isin(*SETTERS)).join(owners, "function").join(ruled_out, ["action_name", "function", "target"], "left").join(actions.select("action_name", "flags"), "action_name")
    gated = F.coalesce("by", F.when(F.col("is_action"), flag_gate(F.col("condition"), F.col("flags"))))
    calls = cut(calls.withColumn("gated_by", gated))
    literal = calls.filter("is_action and gated_by is null").select("action_name", F.col("target").alias("to_action")).distinct()
    return {
        "mario_action": actions.drop("flags"),
        "mario_action_call": calls.select(
            "action_name", "function", "seq", "call", "target", "condition", F.array_join("args", ", ").alias("args"), json_list(F.col("args")).alias("args_json"), F.col("path").alias("file"), "line", "gated_by"
        ),
        "mario_action_data_transition": data_transitions(sites, owners, names, literal),
    }
