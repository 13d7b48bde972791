"""Map, cross-tab, treemap and relation graph against SQL texts of their own, over rows made at random."""

import duckdb
import pandas as pd
import pytest

from codelake.plans import tabs
from test_gallery import kind, made

PLACED = """
    SELECT 'object' AS kind, level, area, behavior, behavior AS label, model_name AS model FROM object
    UNION ALL SELECT 'macro', level, area, behavior, coalesce(behavior, m.macro_name), p.model_name FROM macro_object m {how} JOIN macro_preset p ON p.macro_name = m.macro_name
    UNION ALL SELECT 'special', level, area, behavior, coalesce(behavior, s.preset_name), q.model_name FROM special_object s {how} JOIN special_preset q ON q.{key} = s.{key}"""
ALL, NAMED = PLACED.format(how="LEFT", key="preset_id"), PLACED.format(how="INNER", key="preset_name")
LISTED = """SELECT coalesce(nullif(b.obj_list, ''), '(none)') AS category, o.behavior, {key} AS key, o.level FROM object o LEFT JOIN behavior b ON b.behavior_name = o.behavior {join} WHERE {key} IS NOT NULL"""
BY_LEVEL, BY_COURSE = LISTED.format(key="o.level", join=""), LISTED.format(key="l.course_name", join="JOIN level l ON l.folder = o.level")
COUNTS = f"SELECT coalesce(level, '') AS level, coalesce(p.behavior, '') AS behavior, coalesce(obj_list, '') AS obj_list, count(*) AS n FROM ({NAMED}) p LEFT JOIN behavior b ON b.behavior_name = p.behavior GROUP BY ALL"
EDGES = """
    SELECT behavior_name AS source, spawned_behavior AS target, CASE WHEN count(*) FILTER (origin = 'script') > 0 AND count(*) FILTER (origin <> 'script') > 0 THEN 'both' WHEN count(*) FILTER (origin = 'script') > 0 THEN 'script' ELSE 'code' END AS origin, 'spawn' AS relation
    FROM behavior_all_spawns GROUP BY ALL UNION ALL SELECT DISTINCT behavior_name, becomes_behavior, NULL, 'morph' FROM behavior_calls_morph UNION ALL SELECT DISTINCT behavior_name, target_behavior, NULL, 'seek' FROM behavior_calls_seek"""


@pytest.fixture(scope="module", params=[1, 2])
def t(spark, request):
    plain = made(request.param)
    for i, row in enumerate(plain["level"]):
        row["course_name"] = None if i == 2 else f"C{i}"
    for i, row in enumerate(plain["behavior_all_spawns"]):
        row["origin"] = ["script", "c", "data"][i % 3]
    plain["behavior"] = plain["behavior"][:-1]
    plain["behavior"][0]["obj_list"] = ""
    con = duckdb.connect()
    for name, rows in plain.items():
        frame = pd.DataFrame(rows)
        con.register(f"_{name}", frame)
        types = {"int": "INT", "boolean": "BOOLEAN"}
        cast = ", ".join(f'CAST("{c}" AS {types.get(kind(rows, c), "VARCHAR")}) AS "{c}"' for c in frame.columns)
        con.execute(f"CREATE TABLE {name} AS SELECT {cast} FROM _{name}")
    frames = {k: spark.createDataFrame([tuple(r.values()) for r in v], ", ".join(f"{c} {kind(v, c)}" for c in v[0])) for k, v in plain.items()}
    return frames, con


def same(df, con, sql):
    got, want = [tuple(r) for r in df.collect()], con.execute(sql).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and want


def test_map(t):
    frames, con = t
    same(tabs.placements(frames).select("kind", "level", "area", "behavior", "label", "model"), con, ALL)
    same(tabs.placements(frames, "preset_name", outer=False).select("kind", "level", "area", "behavior", "label", "model"), con, NAMED)
    same(tabs.levels_with_placements(frames), con, "SELECT level FROM object UNION SELECT level FROM macro_object UNION SELECT level FROM special_object")
    same(tabs.areas(frames, "moor"), con, f"SELECT DISTINCT area FROM ({ALL}) WHERE level = 'moor'")
    same(tabs.points_by_kind(frames, "cove", 1).select("kind", "n"), con, f"SELECT kind, count(*) FROM ({ALL}) WHERE level = 'cove' AND area = 1 GROUP BY kind")


@pytest.mark.parametrize("dim, rows", [("level", BY_LEVEL), ("course", BY_COURSE)])
def test_crosstab(t, dim, rows):
    frames, con = t
    sets = "GROUPING SETS ((category, behavior, key), (category, behavior), (category, key), (category), (key))"
    same(tabs.crosstab(frames, dim), con, f"SELECT category, behavior, key, count(*) FROM ({rows}) GROUP BY {sets}")
    category = con.execute(f"SELECT min(category) FROM ({rows})").fetchone()[0]
    same(tabs.category_row(frames, category, dim), con, f"SELECT key, count(*) FROM ({rows}) WHERE category = '{category}' GROUP BY key")
    wide = tabs.crosstab_wide(frames, dim)
    keys = wide.columns[2:]
    same(wide, con, f"SELECT category, behavior, {', '.join(f"count(*) FILTER (key = '{k}')" for k in keys)} FROM ({rows}) GROUP BY ALL")


def test_treemap(t):
    frames, con = t
    same(tabs.placement_counts(frames), con, COUNTS)
    for order in (("obj_list", "level", "behavior"), ("level", "behavior", "obj_list")):
        shown = "CASE WHEN min(obj_list) = max(obj_list) THEN min(obj_list) ELSE '' END"
        depths = [f"SELECT {n} AS depth, {', '.join(c if i < n else 'NULL' for i, c in enumerate(order))}, CAST(sum(n) AS BIGINT), {shown} FROM ({COUNTS}) GROUP BY {', '.join(order[:n])}" for n in (1, 2, 3)]
        same(tabs.nested(frames, order), con, " UNION ALL ".join(depths))


def test_relation_graph(t):
    frames, con = t
    nodes, edges = tabs.relation_graph(frames)
    same(edges.select("source", "target", "origin", "relation"), con, EDGES)
    placed = f"SELECT behavior AS id, count(*) AS n FROM ({NAMED}) WHERE behavior IS NOT NULL GROUP BY behavior"
    ids = f"SELECT source AS id FROM ({EDGES}) UNION SELECT target FROM ({EDGES}) UNION SELECT id FROM ({placed})"
    same(nodes.select("id", "list", "placements"), con, f"SELECT i.id, coalesce(obj_list, ''), coalesce(n, 0) FROM ({ids}) i LEFT JOIN ({placed}) p ON p.id = i.id LEFT JOIN behavior b ON b.behavior_name = i.id")
    same(tabs.neighbours(edges), con, f"SELECT source, target FROM ({EDGES}) UNION SELECT target, source FROM ({EDGES})")
