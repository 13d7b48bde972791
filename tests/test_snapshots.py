"""Saves that stop half-way, versions, damage, and a workspace that is reset."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from codelake import build, snapshots


@pytest.fixture
def two(spark):
    return {"a": spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, s string"), "b": spark.createDataFrame([(1.5,)], "d double")}


def held(tables):
    return {name: sorted(map(tuple, df.collect()), key=str) for name, df in tables.items()}


def test_a_save_that_stops_leaves_all_old_tables(spark, tables, tmp_path):
    folder = str(tmp_path / "db")
    names = sorted(tables)
    assert snapshots.save(tables, folder) == 1
    first = held(snapshots.load(spark, folder))
    assert sorted(first) == names and len(names) == 30
    stops = {name: df for name, df in tables.items()}
    half = names[15]
    stops |= {n: df.limit(0) for n, df in tables.items() if n != half}  # all other tables would change
    stops[half] = tables[half].withColumn("stop", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        snapshots.save(dict(sorted(stops.items())), folder, overwrite=True)
    assert len(glob.glob(f"{folder}/data/*/*")) > 30  # half of it was written
    assert held(snapshots.load(spark, folder)) == first and [m["version"] for m in snapshots.versions(spark, folder)] == [1]
    # A manifest that was begun and not committed doesn't count either.
    os.makedirs(f"{folder}/manifests/00000002-lost/_temporary/0")
    assert snapshots.manifest(spark, folder)["version"] == 1
    assert snapshots.save({"level": tables["level"].limit(1)}, folder, overwrite=True) == 2
    assert snapshots.load(spark, folder)["level"].count() == 1 and held(snapshots.load(spark, folder, version=1)) == first


def test_versions(spark, two, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, folder)
    snapshots.save(two, folder)
    with pytest.raises(FileExistsError):
        snapshots.save(two, folder)
    old = snapshots.load(spark, folder)
    # A table may be made of the version that it replaces, and readers of that keep their rows.
    assert snapshots.save({"a": old["a"].filter("i > 1"), "b": old["b"].repartition(2)}, folder, overwrite=True) == 2
    assert held(old) == held(two) and held(snapshots.load(spark, folder, ["a"])) == {"a": [(2, "y"), (3, None)]}
    assert snapshots.changed(spark, folder, 1, 2) == ["a"]
    assert snapshots.restore(spark, folder, 1) == 3 and snapshots.changed(spark, folder, 1, 3) == [] and held(snapshots.load(spark, folder)) == held(two)
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, folder, version=9)


def test_damage_is_found(spark, two, tmp_path):
    folder = str(tmp_path)
    snapshots.save(two | {"none": two["a"].limit(0)}, folder)
    assert snapshots.damaged(spark, folder) == []
    [path] = [t["path"] for t in snapshots.manifest(spark, folder)["tables"] if t["name"] == "a"]
    two["a"].filter("i = 1").write.mode("append").parquet(f"{folder}/{path}")
    assert snapshots.damaged(spark, folder) == ["a"]


def test_workspace_edits_reload_and_commit(spark, two, tmp_path):
    folder, told = str(tmp_path), []
    snapshots.save(two, folder)
    w = snapshots.Workspace(spark, folder, register=lambda tables: told.append(sorted(tables)))
    w.insert("a", spark.createDataFrame([(9,)], "i long"))
    w.update("a", {"s": F.concat("s", F.lit("!")), "i": F.col("i") + 10}, F.col("s") == "x")
    w.delete("a", F.col("s") == "y")
    assert held(w.tables)["a"] == sorted([(11, "x!"), (3, None), (9, None)], key=str)
    w.drop("b")
    w.reload()
    assert held(w.tables) == held(two) and told[-1] == ["a", "b"]
    w.delete("a", F.col("i") > 1)
    w.put("c", two["b"])
    assert w.commit() == 2 and held(w.tables) == {"a": [(1, "x")], "b": [(1.5,)], "c": [(1.5,)]}
    kept = [{t["name"]: t["path"] for t in m["tables"]} for m in snapshots.versions(spark, folder)]
    assert kept[0]["b"] == kept[1]["b"] and kept[0]["a"] != kept[1]["a"]
    assert held(snapshots.Workspace(spark, folder, version=1).tables) == held(two)


def test_reload_gives_the_first_rows_in_sql(spark, tables, tmp_path):
    build.save(tables, str(tmp_path))
    w = build.workspace(spark, str(tmp_path))
    count = lambda: spark.sql("SELECT count(*) FROM behavior_call_unclassified").first()[0]
    before = count()
    w.delete("behavior_call", F.lit(True))
    assert before > 0 and count() == 0
    w.reload()
    assert count() == before
