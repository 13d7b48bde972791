"""Map, cross-tab, treemap, graphs, dossiers and save tree over the small source tree of test_tree."""

import pytest
from pyspark.sql import functions as F

from codelake import build
from codelake.plans import tabs

from test_tree import rows


@pytest.fixture(scope="module")
def t(tables):
    return tables | build.views(tables)


def every(df, *columns):
    return rows(df, *(columns or df.columns))


def test_map(t):
    assert every(tabs.levels_with_placements(t)) == [("cove",)]
    assert every(tabs.areas(t, "cove")) == [(0,), (2,)]
    found = every(tabs.points(t, "cove"), "kind", "area", "label", "model")
    # The gate's preset goes by the number of the door's; by name it has none.
    assert found.count(("special", 2, "NULL", "MODEL_DOOR")) == 2 and ("macro", 2, "bhvCoin", "MODEL_COIN") in found and ("object", 2, "bhvCrab", "MODEL_CRAB") in found
    assert every(tabs.placements(t, "preset_name", outer=False).filter("kind = 'special'"), "area", "x") == [(2, 1)]
    counts = {r["kind"]: r["n"] for r in tabs.points_by_kind(t, "cove").collect()}
    assert counts == {k: sum(r[0] == k for r in found) for k in ("object", "macro", "special")}
    assert tabs.points(t, "cove", 2).count() == sum(r[1] == 2 for r in found)


def test_camera_zones(spark, t):
    schema = "level string, area int, event string, center_x int, center_y int, center_z int, bounds_x int, bounds_y int, bounds_z int, bounds_yaw int, doc string, file string, line int"
    own = {"camera_trigger": spark.createDataFrame([("a", 1, "e", 1, 2, 3, 10, 20, 30, 16384, None, "f", 1), ("a", -1, "g", 0, 0, 0, 5, 0, 5, 0, None, "f", 2), ("a", 2, "h", 0, 0, 0, 0, 1, 1, 0, None, "f", 3)], schema)}
    assert every(tabs.camera_zones(own, "a", 1), "event", "center_h", "center_v", "half_h", "half_v", "turn") == [("e", 1, 3, 10, 30, 90.0), ("g", 0, 0, 5, 5, 0.0)]
    assert every(tabs.camera_zones(own, "a", None, "zy"), "event", "half_h", "half_v", "turn") == [("e", 30, 20, 0.0)]


def test_crosstab_adds_up(t):
    objects = t["object"].count()
    for dim, key in (("level", "cove"), ("course", "COURSE_COVE")):
        cells = every(tabs.crosstab(t, dim), "category", "behavior", "key", "n")
        assert sum(r[3] for r in cells if r[1] and r[2]) == sum(r[3] for r in cells if r[0] and not r[1] and r[2]) == objects
        crab = next(r for r in cells if r[1] == "bhvCrab" and r[2] == key)
        assert crab[0] == "OBJ_LIST_PUSHABLE" and every(tabs.category_cell(t, crab[0], key, dim), "behavior", "n") == [("bhvCrab", crab[3])]
        assert every(tabs.category_row(t, "OBJ_LIST_PUSHABLE", dim)) == [(key, crab[3])] and tabs.behavior_cell(t, "bhvCrab", key, dim).count() == crab[3]
    assert every(tabs.behavior_row(t, "bhvCrab")) == [("cove", 2)]
    assert "cove" in tabs.crosstab_wide(t).columns


def test_treemap(t):
    counts = every(tabs.placement_counts(t), "level", "behavior", "obj_list", "n")
    assert ("cove", "bhvCrab", "OBJ_LIST_PUSHABLE", 3) in counts and ("cove", "bhvCoin", "", 2) in counts
    nodes = tabs.nested(t, ("level", "obj_list", "behavior"))
    assert all(nodes.filter(F.col("depth") == d).agg(F.sum("n")).first()[0] == sum(r[3] for r in counts) for d in (1, 2, 3))
    assert nodes.filter("depth = 1").first()["colour"] == "" and tabs.placed_in(t, "cove", "bhvCrab").count() == 3


def test_relation_graph_and_dossier(t):
    nodes, edges = tabs.relation_graph(t)
    found = every(edges, "source", "target", "relation")
    assert ("bhvCrab", "bhvCoin", "spawn") in found
    ids = {r["id"]: r for r in nodes.collect()}
    assert set(ids) >= {r[0] for r in found} | {r[1] for r in found} and ids["bhvCrab"]["placements"] == 3 and ids["bhvCrab"]["list"] == "OBJ_LIST_PUSHABLE"
    assert tabs.neighbours(edges).filter("id = 'bhvCoin'").count() >= 1
    parts = every(tabs.dossier(t, "bhvCrab"), "part", "item", "n")
    assert ("level", "cove", 3) in parts and ("list", "OBJ_LIST_PUSHABLE", None) in parts and ("native", "bhv_crab_loop", None) in parts
    children = [r[1] for r in parts if r[0] == "spawn"]
    assert "bhvCoin" in children and len(children) == len(set(children))
    assert ("parent", "bhvCrab", None) in every(tabs.dossier(t, "bhvCoin"), "part", "item", "n")


def test_action_graph_and_dossier(t):
    nodes, edges = tabs.action_graph(t)
    assert nodes.count() == t["mario_action"].count() and edges.count() == t["mario_all_transitions"].count()
    loops = edges.filter("source = target").count()
    assert nodes.agg(F.sum("degree")).first()[0] == 2 * edges.count() - loops
    parts = every(tabs.action_dossier(t, "ACT_RUN"), "part", "item", "source")
    assert ("out", "ACT_SINK", None) in parts  # refuted, but the call is there
    assert ("out", "ACT_JUMP", "expr") in parts and any(p == "in" for p, _, _ in parts)
    assert ("open", "landAction", None) in parts


def test_save_tree(t):
    tree = {r["path"]: r for r in tabs.save_tree(t).collect()}
    assert tree["SaveBuffer.files"]["size"] == 80 and tree["SaveBuffer.files.[1][0]"]["offset"] == 40 and tree["SaveBuffer.files.[1][1].pos"]["offset"] == 62
    assert tree["SaveBuffer.files.[0][1].flags.bit 4"]["label"] == "SAVE_FLAG_KEY" and tree["SaveBuffer.files.[0][1].flags.bit 9"]["label"] == "unused"
    assert sum(p.count(".") == 1 for p in tree) == t["save_field"].filter("struct_name = 'SaveBuffer'").count()


def test_labels(spark):
    one = spark.range(1)
    label = lambda c: one.select(c).first()[0]
    assert [label(tabs.short_name(F.lit(n))) for n in ("bhvCrab", "COURSE_BOB", "OBJ_LIST_X", "ACT_RUN", "SAVE_FLAG_A", "Other")] == ["crab", "bob", "x", "run", "a", "other"]
    assert [label(tabs.flag_kind(F.lit(f"SAVE_FLAG_{n}"))) for n in ("HAVE_KEY", "UNLOCKED_A", "CAP_ON_B", "COLLECTED_C", "MOAT")] == [*tabs.FLAG_KINDS.values(), "world state"]
    assert label(tabs.degrees(F.lit(16384))) == 90 and label(tabs.heat(F.lit(4), F.lit(16))) == 0.5 and label(tabs.radius(F.lit(100), 4, 1.5, 3.5, 12)) == 12


def test_catalogue(t, tmp_path):
    own = {k: v for k, v in t.items() if k not in build.VIEWS}
    listed = build.listing(own)
    assert len(listed) == len(own) + len(build.VIEWS) and ("level", "table", 2) in listed and any(kind == "view" for _, kind, _ in listed)
    assert ("level", "folder", "string") in build.columns(own)
    assert ("level", "level", "folder") in build.outgoing("object") and ("folder", "object", "level") in build.incoming("level")
    assert all(build.repeated(own, name).isEmpty() for name in ("level", "course", "dialog", "macro_preset"))
    twice = {"level": own["level"].union(own["level"])}
    assert build.repeated(twice, "level").count() == 2
    with pytest.raises(FileNotFoundError):
        build.main(["-r", str(tmp_path / "none")])
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        build.main(["-r", str(tmp_path / "file")])
    with pytest.raises(SystemExit) as left:
        build.main(["--version"])
    assert left.value.code == 0
