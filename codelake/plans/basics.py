"""Projections, predicates, set operations, sorting and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables, query


@query("SELECT n_name AS nation, n_regionkey AS region FROM nation")
def q01_scan_project(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"))


@query("""SELECT o_orderkey, ((o_orderkey % 64) & 2) <> 0 AS in_act_2 FROM orders
WHERE ((o_orderkey % 64) & 1) <> 0 AND NOT (((o_orderkey % 64) & 62) <> 0) OR (o_orderkey % 64) = 3""")
def q02_filter_bool_mask(t: Tables) -> DataFrame:
    bits = F.col("o_orderkey") % 64
    on = lambda mask: bits.bitwiseAND(mask) != 0
    return t.orders.filter((on(1) & ~on(62)) | (bits == 3)).select("o_orderkey", on(2).alias("in_act_2"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')")
def q03_in_list(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").isin("signup", "purchase")).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('signup', 'purchase', 'view')")
def q04_not_in_list(t: Tables) -> DataFrame:
    return t.events.filter(~F.col("event_type").isin("signup", "purchase", "view")).select("event_id", "event_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_name ILIKE 'B_ue%'")
def q05_ilike(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%RED%") | F.col("p_name").ilike("B_ue%")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name GLOB 'Customer#0000[0-9]*' AND NOT c_name GLOB '*7'")
def q06_glob_prefix(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_name").rlike("^Customer#0000[0-9]") & ~F.col("c_name").endswith("7")).select("c_custkey", "c_name")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS kind,
'order' AS origin, CAST(NULL AS VARCHAR) AS param FROM orders""")
def q07_case_tag(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "open").otherwise("other")
    return t.orders.select("o_orderkey", kind.alias("kind"), F.lit("order").alias("origin"), F.lit(None).cast("string").alias("param"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def q18_json_extract_pos(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("""SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0""")
def q29_union_distinct(t: Tables) -> DataFrame:
    return t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.filter("s_acctbal < 0").select("s_nationkey")).distinct()


@query("""SELECT 'customer' AS origin, c_custkey AS id, c_nationkey AS nation FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_nationkey FROM nation""")
def q29b_union_all_tagged(t: Tables) -> DataFrame:
    tagged = lambda df, origin, id_, nation: df.select(F.lit(origin).alias("origin"), F.col(id_).cast("long").alias("id"), F.col(nation).alias("nation"))
    return tagged(t.customer, "customer", "c_custkey", "c_nationkey").union(tagged(t.supplier, "supplier", "s_suppkey", "s_nationkey")).union(tagged(t.nation, "nation", "n_nationkey", "n_nationkey"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def q36_topk_tiebreak(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("SELECT event_type, MIN(event_id) AS first_id FROM events GROUP BY event_type ORDER BY first_id")
def q37_distinct_order_min(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.min("event_id").alias("first_id")).orderBy("first_id")


@query("SELECT o_orderkey, (o_orderkey & 12) <> 0 AS any_set, (o_orderkey & 12) = 12 AS all_set FROM orders WHERE NOT ((o_orderkey & 3) <> 0)")
def q48_flag_gate(t: Tables) -> DataFrame:
    masked = lambda m: F.col("o_orderkey").bitwiseAND(m)
    return t.orders.filter(masked(3) == 0).select("o_orderkey", (masked(12) != 0).alias("any_set"), (masked(12) == 12).alias("all_set"))


@query("""SELECT p_partkey, CAST(bit AS INTEGER) AS bit, ((p_partkey >> bit) & 1) = 1 AS is_set, printf('0x%08X', CAST(1 AS BIGINT) << bit) AS mask
FROM part, range(0, 12) AS r(bit)""")
def q53_bit_decode(t: Tables) -> DataFrame:
    from ..functions.text import hex_of

    rows = t.part.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("bit"))
    mask = F.expr("shiftleft(1L, bit)")
    return rows.select("p_partkey", "bit", (F.col("p_partkey").bitwiseAND(mask) != 0).alias("is_set"), hex_of(mask).alias("mask"))


@query("""SELECT o_orderkey, ((o_orderkey << 3) | 5) & 255 AS packed, xor(o_orderkey, 255) AS flipped, ~o_orderkey AS inverted,
CAST(floor((o_orderkey - 100) / 7) AS BIGINT) AS floored FROM orders""")
def q55_const_eval(t: Tables) -> DataFrame:
    packed = F.expr("(shiftleft(o_orderkey, 3) | 5) & 255")
    return t.orders.select("o_orderkey", packed.alias("packed"), F.expr("o_orderkey ^ 255L").alias("flipped"), F.expr("~o_orderkey").alias("inverted"), F.floor((F.col("o_orderkey") - 100) / 7).cast("long").alias("floored"))


@query("""SELECT p_partkey, [trim(x) for x in ['f(' || p_brand || ', ' || p_type || ')', 'g[' || p_size || ',0]', 'h']] AS args FROM part""")
def q56_bracket_split(t: Tables) -> DataFrame:
    from ..functions.text import split_top_level

    text = F.concat(F.lit("f("), "p_brand", F.lit(", "), "p_type", F.lit("), g["), F.col("p_size").cast("string"), F.lit(",0], h"))
    return t.part.select("p_partkey", F.transform(split_top_level(text), lambda x: F.trim(x)).alias("args"))


@query("""SELECT page_id, CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS BIGINT) AS tracked FROM pages WHERE regexp_matches(html, 'track\\(\\d+\\)')""")
def q57_call_extract(t: Tables) -> DataFrame:
    return t.pages.filter(F.col("html").rlike(r"track\(\d+\)")).select("page_id", F.regexp_extract("html", r"track\((\d+)\)", 1).cast("long").alias("tracked"))


@query("SELECT page_id, length(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS n_bare FROM pages")
def q58_comment_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(F.regexp_replace("html", "(?s)<!--.*?-->", "")).cast("long").alias("n_bare"))


@query("SELECT doc_id, substring(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), 1, 70) AS snippet FROM documents")
def q59_snippet(t: Tables) -> DataFrame:
    from ..functions.text import snippet

    return t.documents.select("doc_id", snippet(F.col("text")).alias("snippet"))


@query("""SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[A-Z][a-z]'))[1] AS first_name
FROM conversations WHERE len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[A-Z][a-z]'))) > 0""")
def q19_pattern_pick(t: Tables) -> DataFrame:
    words = t.conversations.withColumn("words", F.split("text", " "))
    capital = lambda x: x.rlike("^[A-Z][a-z]")
    return words.filter(F.exists("words", capital)).select("conv_id", "turn", F.get(F.filter("words", capital), F.lit(0)).alias("first_name"))
