"""Joins of every kind that symbolic names call for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keys import dangling
from ..operators.state import not_in, zip_by_place
from .registry import Tables, query


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def q08_inner_join(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("""SELECT r_name, n_name, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def q09_four_way_join(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    # Lines are summed up by order before they meet the customers.
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    joined = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("k").alias("n"), F.sum("q").alias("quantity"))


@query("""SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
WHERE a.n_nationkey <> b.n_nationkey GROUP BY ALL""")
def q10_two_role_dim(t: Tables) -> DataFrame:
    pairs = trade(t).filter("src != dst")
    names = lambda role, to: t.nation.select(F.col("n_nationkey").alias(role), F.col("n_name").alias(to))
    return pairs.join(names("src", "customer_nation"), "src").join(names("dst", "supplier_nation"), "dst").select("customer_nation", "supplier_nation", "n")


def trade(t: Tables) -> DataFrame:
    """(src, dst, n): how many lines go from which customer's to which supplier's nation."""
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    sold = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("k"))
    return sold.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.sum("k").alias("n"))


TRADE_SQL = """SELECT c_nationkey AS src, s_nationkey AS dst, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def q11_self_join(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    same = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, same).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("other"))


@query("SELECT p_partkey, n_name FROM part JOIN nation ON TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) = n_nationkey")
def q12_computed_key_join(t: Tables) -> DataFrame:
    return t.part.withColumn("number", F.expr("try_cast(replace(p_brand, 'Brand#', '') as int)")).join(t.nation, F.col("number") == F.col("n_nationkey")).select("p_partkey", "n_name")


@query("SELECT d.doc_id, COALESCE(quality, -1) AS quality, COALESCE(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q13_left_join_coalesce(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")))


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def q14_anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q15_semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 1 AND l_discount = 0)""")
def q16_not_in_subquery_chain(t: Tables) -> DataFrame:
    out = not_in(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", t.nation.filter("n_regionkey = 0").select("n_nationkey"))
    out = not_in(out, "s_nationkey", t.customer.filter("c_acctbal > 9990").select("c_nationkey"))
    return not_in(out, "s_suppkey", t.lineitem.filter("l_quantity = 1 and l_discount = 0").select("l_suppkey"))


@query("""SELECT event_id, slot, symbol FROM (SELECT event_id, unnest([event_type, 'u' || user_id, props]) AS symbol, unnest([0, 1, 2]) AS slot FROM events)
WHERE symbol IN ('signup', 'u7')""")
def q17_lateral_json_each(t: Tables) -> DataFrame:
    args = F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")), "props")
    return t.events.select("event_id", F.posexplode(args).alias("slot", "symbol")).filter(F.col("symbol").isin("signup", "u7"))


@query("""SELECT a.place, a.n_name, b.r_name FROM (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS place, n_name FROM nation) a
JOIN (SELECT CAST(row_number() OVER (ORDER BY r_name DESC) - 1 AS INTEGER) AS place, r_name FROM region) b ON a.place = b.place""")
def q52_positional_zip(t: Tables) -> DataFrame:
    return zip_by_place(t.nation, t.region, ["n_nationkey"], [F.desc("r_name")], strict=False).select(F.col("place").cast("int").alias("place"), "n_name", "r_name")


#: Child table and column, parent table and column.
FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"),
)


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS key, COUNT(*) AS dangling FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)" for c, k, p, pk in FOREIGN_KEYS))
def q60_fk_audit(t: Tables) -> DataFrame:
    tables = {name: getattr(t, name) for name in sorted({n for key in FOREIGN_KEYS for n in (key[0], key[2])})}
    return dangling(tables, FOREIGN_KEYS, "long").select("key", "dangling")
