"""Graphs that come out of facts: edges, degrees, reachability, dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import degrees, reachable
from .joins import TRADE_SQL, trade
from .registry import Tables, query

#: An edge of fewer lines counts as refuted. The share is of the mean, so it means the same at every size.
_GATED = f"(SELECT src, dst, n, CASE WHEN n < 0.9 * AVG(n) OVER () THEN 'rare' END AS gated_by FROM ({TRADE_SQL}))"


def _gated(t: Tables) -> DataFrame:
    edges = trade(t)
    mean = edges.agg(F.avg("n").alias("mean"))  # one row
    return edges.join(F.broadcast(mean)).withColumn("gated_by", F.when(F.col("n") < 0.9 * F.col("mean"), F.lit("rare"))).drop("mean")


@query(f"SELECT DISTINCT src, dst FROM {_GATED} WHERE gated_by IS NULL")
def q38_edges_distinct(t: Tables) -> DataFrame:
    return _gated(t).filter("gated_by is null").select("src", "dst").distinct()


@query(f"SELECT DISTINCT src, dst, gated_by FROM {_GATED} WHERE gated_by IS NOT NULL ORDER BY src, dst")
def q39_refuted(t: Tables) -> DataFrame:
    return _gated(t).filter("gated_by is not null").select("src", "dst", "gated_by").distinct().orderBy("src", "dst")


@query(f"SELECT src, dst FROM {_GATED} WHERE gated_by IS NULL UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation")
def q40_all_edges(t: Tables) -> DataFrame:
    data = t.nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"))
    return _gated(t).filter("gated_by is null").select("src", "dst").union(data).distinct()


@query(f"""SELECT node, COUNT(*) AS degree FROM (SELECT src AS node FROM ({TRADE_SQL}) UNION ALL SELECT dst FROM ({TRADE_SQL}) WHERE src <> dst) GROUP BY node""")
def q41_degree(t: Tables) -> DataFrame:
    return degrees(trade(t))


@query("""SELECT nation, CASE WHEN bool_or(o = 'c') AND bool_or(o = 's') THEN 'both' WHEN bool_or(o = 'c') THEN 'code' ELSE 'script' END AS origin
FROM (SELECT c_nationkey AS nation, 'c' AS o FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 's' FROM supplier WHERE s_acctbal > 5000) GROUP BY nation""")
def q42_origin_merge(t: Tables) -> DataFrame:
    rows = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("o"))
    rows = rows.union(t.supplier.filter("s_acctbal > 5000").select("s_nationkey", F.lit("s")))
    code, script = F.bool_or(F.col("o") == "c"), F.bool_or(F.col("o") == "s")
    return rows.groupBy("nation").agg(F.when(code & script, "both").when(code, "code").otherwise("script").alias("origin"))


#: A graph with cycles: to 3n + 1, and from even nations to n / 2.
_CALLS = """(SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey % 2 = 0)"""
_CLOSURE = f"""WITH RECURSIVE c AS (SELECT n_nationkey AS root, n_nationkey AS node FROM nation WHERE n_regionkey = 0
UNION SELECT root, dst FROM c JOIN {_CALLS} e ON e.src = c.node)"""


def _calls(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.nation.select(n.alias("src"), ((n * 3 + 1) % 25).alias("dst")).union(t.nation.filter("n_nationkey % 2 = 0").select(n, (n / 2).cast("int"))).distinct()


def _roots(t: Tables) -> DataFrame:
    return t.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("root"))


@query(f"{_CLOSURE} SELECT root, node FROM c")
def q44_reachability(t: Tables) -> DataFrame:
    return reachable(_calls(t), _roots(t))


@query(f"{_CLOSURE} SELECT root AS owner, src AS function, dst AS call FROM c JOIN {_CALLS} e ON e.src = c.node")
def q45_attribution(t: Tables) -> DataFrame:
    owned = reachable(_calls(t), _roots(t))
    return owned.join(_calls(t), F.col("node") == F.col("src")).select(F.col("root").alias("owner"), F.col("src").alias("function"), F.col("dst").alias("call"))


@query(_CLOSURE.replace("ON e.src = c.node", "ON e.src = c.node AND c.node % 5 <> 1") + " SELECT root, node FROM c")
def q46_leaf_restricted_reach(t: Tables) -> DataFrame:
    leaves = t.nation.filter("n_nationkey % 5 = 1").select(F.col("n_nationkey").alias("node"))
    return reachable(_calls(t), _roots(t), leaves)


@query("""SELECT child, tag FROM (SELECT child, tag, row_number() OVER (PARTITION BY child ORDER BY rank) AS r FROM (
SELECT c_mktsegment AS child, 'code' AS tag, 0 AS rank FROM customer WHERE c_nationkey = 3 UNION ALL SELECT p_type, 'data', 1 FROM part WHERE p_size = 3
UNION ALL SELECT o_orderpriority, 'script', 2 FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_mktsegment, 'script', 2 FROM customer)) WHERE r = 1""")
def q62_dossier(t: Tables) -> DataFrame:
    part = lambda df, child, tag, rank: df.select(F.col(child).alias("child"), F.lit(rank).alias("rank"), F.lit(tag).alias("tag"))
    rows = part(t.customer.filter("c_nationkey = 3"), "c_mktsegment", "code", 0).union(part(t.part.filter("p_size = 3"), "p_type", "data", 1))
    rows = rows.union(part(t.orders.filter("o_orderstatus = 'P'"), "o_orderpriority", "script", 2)).union(part(t.customer, "c_mktsegment", "script", 2))
    return rows.groupBy("child").agg(F.min_by("tag", "rank").alias("tag"))
