"""Counts, roll-ups, audits and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import carried, first_row
from .registry import Tables, query

@query("SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY ALL")
def q20_count_group(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(*) AS n FROM orders GROUP BY ALL")
def q21_count_distinct(t: Tables) -> DataFrame:
    # Two ordinary aggregates instead of an expanded distinct one.
    each = t.orders.groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("k"))
    return each.groupBy("o_orderstatus").agg(F.count("o_custkey").alias("customers"), F.sum("k").alias("n"))


@query("""SELECT o_orderkey, CAST(COALESCE(SUM(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS covered, CAST(100 - COALESCE(SUM(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS padding
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q22_sum_left_coverage(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("covered"))
    covered = F.coalesce("covered", F.lit(0)).cast("long")
    return t.orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", covered.alias("covered"), (100 - covered).alias("padding"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING n > 1")
def q23_listagg_having(t: Tables) -> DataFrame:
    names = F.array_join(F.sort_array(F.collect_list("n_name")), ", ")
    return t.nation.groupBy("n_regionkey").agg(names.alias("nations"), F.count("*").alias("n")).filter("n > 1")


@query("SELECT n_regionkey, MIN(n_name) AS any_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def q24_functional_bare_column(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.min("n_name").alias("any_name"), F.count("*").alias("n"))


@query("SELECT COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS cat, COUNT(*) AS n FROM customer GROUP BY cat")
def q25_group_alias_coalesce_nullif(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("cat")).agg(F.count("*").alias("n"))


@query("""SELECT nation, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT c_nationkey AS nation, COUNT(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT s_nationkey, COUNT(*) FROM supplier GROUP BY ALL) GROUP BY nation""")
def q26_two_stage_union_agg(t: Tables) -> DataFrame:
    each = lambda df, c: df.groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n"))
    return each(t.customer, "c_nationkey").union(each(t.supplier, "s_nationkey")).groupBy("nation").agg(F.sum("n").alias("n"))


@query("SELECT event_type, COUNT(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY event_type ORDER BY n DESC, event_type")
def q27_residue_audit(t: Tables) -> DataFrame:
    return t.events.filter(~F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("""SELECT COUNT(*) AS n, COUNT(*) FILTER (event_type IN ('view', 'click')) AS classified, COUNT(*) FILTER (event_type NOT IN ('view', 'click')) AS residue,
COUNT(*) FILTER (event_type IN ('view', 'click') AND event_type NOT IN ('view', 'click')) AS both_ways FROM events""")
def q28_partition_check(t: Tables) -> DataFrame:
    known = F.col("event_type").isin("view", "click")
    return t.events.agg(F.count("*").alias("n"), F.count_if(known).alias("classified"), F.count_if(~known).alias("residue"), F.count_if(known & ~known).alias("both_ways"))


PLACEMENTS_SQL = """SELECT n_name AS level, kind, thing, CAST(SUM(n) AS BIGINT) AS n FROM (
SELECT c_nationkey AS nation, 'customer' AS kind, c_mktsegment AS thing, COUNT(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT s_nationkey, 'part', p_brand, COUNT(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
UNION ALL SELECT c_nationkey, 'order', o_orderpriority, COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) JOIN nation ON nation = n_nationkey GROUP BY ALL"""


def placements(t: Tables) -> DataFrame:
    """(level, kind, thing, n): three sources of facts, each resolved by its own dimension and counted."""
    count = lambda df, nation, kind, thing: df.groupBy(F.col(nation).alias("nation"), F.lit(kind).alias("kind"), F.col(thing).alias("thing")).agg(F.count("*").alias("n"))
    # Lines are counted by their two keys before the names come in.
    lines = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("k"))
    lines = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    parts = lines.groupBy(F.col("s_nationkey").alias("nation"), F.lit("part").alias("kind"), F.col("p_brand").alias("thing")).agg(F.sum("k").alias("n"))
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    all_ = count(t.customer, "c_nationkey", "customer", "c_mktsegment").union(parts).union(count(orders, "c_nationkey", "order", "o_orderpriority"))
    return all_.join(t.nation, F.col("nation") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("level"), "kind", "thing").agg(F.sum("n").alias("n"))


@query(PLACEMENTS_SQL)
def q30_placement_counts(t: Tables) -> DataFrame:
    return placements(t)


_ROLLED_SQL = f"""SELECT level, kind, thing, CAST(SUM(n) AS BIGINT) AS n, CASE WHEN MIN(kind) = MAX(kind) THEN MIN(kind) ELSE '' END AS shared
FROM ({PLACEMENTS_SQL}) GROUP BY ROLLUP """


@query(_ROLLED_SQL + "(level, kind, thing)")
def q31_treemap_rollup_a(t: Tables) -> DataFrame:
    return _rolled(t, "level", "kind", "thing")


@query(_ROLLED_SQL + "(kind, thing, level)")
def q32_treemap_rollup_b(t: Tables) -> DataFrame:
    return _rolled(t, "kind", "thing", "level")


def _rolled(t: Tables, *order: str) -> DataFrame:
    rows = placements(t).withColumn("own", F.col("kind"))
    shared = F.when(F.min("own") == F.max("own"), F.min("own")).otherwise("")
    return rows.rollup(*order).agg(F.sum("n").alias("n"), shared.alias("shared")).select("level", "kind", "thing", "n", "shared")


@query("SELECT o_orderpriority AS cat, o_orderstatus AS k, COUNT(*) AS n FROM orders GROUP BY ALL")
def q33_crosstab(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("cat"), F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority AS cat, o_orderstatus AS k, CAST(GROUPING(o_orderpriority) * 2 + GROUPING(o_orderstatus) AS BIGINT) AS tier, COUNT(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), (o_orderstatus), ())""")
def q34_crosstab_totals(t: Tables) -> DataFrame:
    return t.orders.cube(F.col("o_orderpriority").alias("cat"), F.col("o_orderstatus").alias("k")).agg(F.grouping_id().cast("long").alias("tier"), F.count("*").alias("n"))


@query("""SELECT kind, MIN(x) AS low, MAX(x) AS high, COUNT(*) AS n FROM (SELECT 'customer' AS kind, c_acctbal AS x FROM customer
UNION ALL SELECT 'supplier', s_acctbal FROM supplier UNION ALL SELECT 'part', p_retailprice FROM part) GROUP BY kind""")
def q35_points_extent(t: Tables) -> DataFrame:
    points = lambda df, kind, x: df.select(F.lit(kind).alias("kind"), F.col(x).alias("x"))
    all_ = points(t.customer, "customer", "c_acctbal").union(points(t.supplier, "supplier", "s_acctbal")).union(points(t.part, "part", "p_retailprice"))
    return all_.groupBy("kind").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, MIN(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def q43_representative(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"), F.min("o_orderkey").alias("first_order"))


@query("""SELECT l_suppkey, CASE WHEN COUNT(DISTINCT f) = 1 AND COUNT(*) = COUNT(f) THEN MIN(f) END AS gate
FROM (SELECT l_suppkey, CASE WHEN l_quantity > 2 THEN l_linestatus END AS f FROM lineitem) GROUP BY l_suppkey""")
def q47_gate_map(t: Tables) -> DataFrame:
    f = t.lineitem.select("l_suppkey", F.when(F.col("l_quantity") > 2, F.col("l_linestatus")).alias("f"))
    one = (F.min("f") == F.max("f")) & (F.count("*") == F.count("f"))
    return f.groupBy("l_suppkey").agg(F.when(one, F.min("f")).alias("gate"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def q49_first_wins_dedup(t: Tables) -> DataFrame:
    return first_row(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def q50_last_wins(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup_id FROM events""")
def q51_ffill_state(t: Tables) -> DataFrame:
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return carried(t.events.select("event_id", "user_id", "ts", "event_type"), {"signup_id": signup}, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "signup_id")


@query("""WITH RECURSIVE m AS (SELECT l_orderkey, l_linenumber, CAST(CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS BIGINT) AS size,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq FROM lineitem),
f AS (SELECT l_orderkey, seq, size, CAST(0 AS BIGINT) AS pos FROM m WHERE seq = 1
UNION ALL SELECT m.l_orderkey, m.seq, m.size, ((f.pos + f.size + m.size - 1) // m.size) * m.size FROM f JOIN m ON m.l_orderkey = f.l_orderkey AND m.seq = f.seq + 1)
SELECT l_orderkey, CAST(seq - 1 AS INTEGER) AS seq, size, pos AS offset_bytes FROM f""")
def q54_layout_offsets(t: Tables) -> DataFrame:
    """Members laid out one after another, each at a multiple of its size."""
    size = F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), (F.col("l_quantity").cast("long") % 4 + 1).cast("int")).cast("long")
    member = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", size.alias("size"))
    # A struct's members: few for each key, so a group is one row's array.
    grouped = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(member)).alias("members"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<seq:int,size:bigint,offset_bytes:bigint>>").alias("out"))

    def place(acc, m):
        at = F.ceil(acc["end"] / m["size"]) * m["size"]
        row = F.struct(F.size(acc["out"]).alias("seq"), m["size"].alias("size"), at.alias("offset_bytes"))
        return F.struct((at + m["size"]).alias("end"), F.concat(acc["out"], F.array(row)).alias("out"))

    laid = F.aggregate("members", start, place, lambda acc: acc["out"])
    return grouped.select("l_orderkey", F.explode(laid).alias("m")).select("l_orderkey", "m.seq", "m.size", "m.offset_bytes")


@query("""SELECT n_nationkey, CAST(slot AS INTEGER) AS slot, CAST(part AS INTEGER) AS part, CAST(n_nationkey * 512 + slot * 112 + part * 56 AS BIGINT) AS at
FROM nation, range(0, 4) AS s(slot), range(0, 2) AS c(part)""")
def q61_tree_expand(t: Tables) -> DataFrame:
    """Instances of nested arrays with their absolute offsets."""
    rows = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return rows.withColumn("at", (F.col("n_nationkey") * 512 + F.col("slot") * 112 + F.col("part") * 56).cast("long"))
