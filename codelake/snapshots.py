"""Sets of tables that change as a whole: snapshots with a manifest, and a workspace that can be reset.

A folder holds `data/<id>/<table>` and `manifests/<version>-<id>`. `save` writes all
tables to a new place under `data`, and their list last, as one small file; what has
no manifest doesn't exist for readers. So a save that stops anywhere leaves the last
version as it was, and readers of an older version keep their files. A manifest holds
each table's rows and fingerprint, which are observed while the table is written.

Everything is read and written by Spark, so any store that it knows will do. One
writer at a time; of two that save the same version the later one by id counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators.checks import fingerprint, observed

_TABLE = "struct<name:string,path:string,rows:bigint,sum_1:string,sum_2:string>"
_MANIFEST = f"version bigint, parent bigint, id string, tables array<{_TABLE}>"


def _at(folder: str, path: str) -> str:
    return f"{folder.rstrip('/')}/{path}"


def versions(spark: SparkSession, folder: str) -> list[Row]:
    """The manifests (version, parent, id, tables), oldest first."""
    try:
        found = spark.read.schema(_MANIFEST).json(_at(folder, "manifests/*")).collect()  # a row for each save
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(found, key=lambda m: (m["version"], m["id"]))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Row:
    """That of a version, or of the newest."""
    found = [m for m in versions(spark, folder) if version is None or m["version"] == version]
    if not found:
        raise FileNotFoundError(f"{folder} holds no tables" if version is None else f"{folder} holds no version {version}")
    return found[-1]


def _publish(spark: SparkSession, folder: str, tables: list[tuple]) -> int:
    before = versions(spark, folder)
    parent = before[-1]["version"] if before else None
    version, own = (parent or 0) + 1, uuid.uuid4().hex
    rows = spark.createDataFrame([(version, parent, own, tables)], _MANIFEST)
    rows.coalesce(1).write.json(_at(folder, f"manifests/{version:08d}-{own}"))
    return version


def save(tables: Mapping[str, DataFrame], folder: str, overwrite: bool = False, kept: Mapping[str, Row] | None = None) -> int:
    """Writes all tables as the next version, whose number it returns; without overwrite the folder must hold none.

    kept: entries of an earlier manifest of this folder that are taken over without
    writing their tables again.
    """
    spark = next((df.sparkSession for df in tables.values()), None) or SparkSession.active()
    if not overwrite and versions(spark, folder):
        raise FileExistsError(f"{folder} holds tables already")
    own, written = uuid.uuid4().hex, [tuple(entry) for entry in (kept or {}).values()]
    for name, df in tables.items():
        path = f"data/{own}/{name}"
        rows, seen = observed(df)
        rows.write.parquet(_at(folder, path))
        written.append((name, path, *(seen.get[k] for k in ("rows", "sum_1", "sum_2"))))
    return _publish(spark, folder, written)


def load(spark: SparkSession, folder: str, names: list[str] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, or of the newest, all of one save."""
    paths = {t["name"]: t["path"] for t in manifest(spark, folder, version)["tables"]}
    return {name: spark.read.parquet(_at(folder, paths[name])) for name in names or paths}


def restore(spark: SparkSession, folder: str, version: int) -> int:
    """Makes an older version the newest once more; no table is written."""
    return _publish(spark, folder, [tuple(t) for t in manifest(spark, folder, version)["tables"]])


def changed(spark: SparkSession, folder: str, old: int, new: int) -> list[str]:
    """Tables whose rows differ between two versions, or that only one has; from the manifests alone."""
    a, b = ({t["name"]: (t["rows"], t["sum_1"], t["sum_2"]) for t in manifest(spark, folder, v)["tables"]} for v in (old, new))
    return sorted(name for name in a | b if a.get(name) != b.get(name))


def damaged(spark: SparkSession, folder: str, version: int | None = None) -> list[str]:
    """Tables whose files no longer hold the rows that were saved; reads each once."""
    found = []
    for t in manifest(spark, folder, version)["tables"]:
        try:
            df = spark.read.parquet(_at(folder, t["path"]))
            if tuple(df.agg(*fingerprint(df.columns)).first()) != (t["rows"], t["sum_1"], t["sum_2"]):
                found.append(t["name"])
        except AnalysisException:
            found.append(t["name"])
    return found


class Workspace:
    """Tables of one version that may be edited; edits are plans over the saved rows until they are committed.

    `register` (as codelake.build has it) is told the tables after each change, so
    that spark.sql sees them and the views over them.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None, register: Callable[[dict[str, DataFrame]], None] | None = None):
        self.spark, self.folder, self._register = spark, folder, register or (lambda tables: None)
        self.version = manifest(spark, folder, version)["version"]
        self.reload()

    def reload(self) -> None:
        """The rows as they were saved, and no edits."""
        self.tables, self.edited = load(self.spark, self.folder, version=self.version), set()
        self._register(self.tables)

    def put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        self.edited.add(name)
        self._register(self.tables)

    def insert(self, name: str, rows: DataFrame) -> None:
        """Adds rows; columns that they lack are null."""
        own = self.tables[name]
        missing = [c for c in own.columns if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None) for c in missing}).select(*(F.col(f.name).cast(f.dataType) for f in own.schema))
        self.put(name, own.union(rows))

    def delete(self, name: str, where: Column) -> None:
        """Rows for which the condition holds go; where it is null they stay."""
        self.put(name, self.tables[name].filter(~F.coalesce(where, F.lit(False))))

    def update(self, name: str, values: Mapping[str, Column], where: Column) -> None:
        own = self.tables[name]
        new = {c: F.when(where, v.cast(own.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
        self.put(name, own.select(*(new.get(c, F.col(c)).alias(c) for c in own.columns)))

    def drop(self, name: str) -> None:
        del self.tables[name]
        self.edited.add(name)

    def commit(self) -> int:
        """Saves the edits as the next version; tables without edits are not written again."""
        kept = {t["name"]: t for t in manifest(self.spark, self.folder, self.version)["tables"] if t["name"] not in self.edited}
        self.version = save({n: self.tables[n] for n in sorted(self.edited & self.tables.keys())}, self.folder, overwrite=True, kept=kept)
        self.reload()
        return self.version
