"""All tables and views of a source tree: build(), save(), open_saved(), workspace(), and the command line."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from .operators.actions import state_machine
from .operators.keys import dangling
from .operators.mining import behavior_code
from .plans.views import VIEWS
from .snapshots import Workspace, load, save
from .sources.entities import BUILDERS, Tree

VERSION = "0.2"
# What tells a table's rows apart, and which columns point where.
UNIQUE_KEYS = {
    "level": ["level_name"], "course": ["course_name"], "behavior": ["behavior_name"], "model": ["model_name"], "sequence": ["seq_name"], "dialog": ["dialog_name"],
    "mario_animation": ["anim_name"], "course_name": ["course_name"], "macro_preset": ["macro_name"], "special_preset": ["preset_name"], "mario_action": ["action_name"], "save_struct": ["struct_name"],
}
#: (table, column, table it points to, column there); audits report rows that point nowhere, nothing fails.
FOREIGN_KEYS = [
    ("object", "level", "level", "folder"), ("object", "behavior", "behavior", "behavior_name"), ("object", "model_name", "model", "model_name"),
    ("macro_object", "level", "level", "folder"), ("macro_object", "macro_name", "macro_preset", "macro_name"),
    ("macro_preset", "behavior", "behavior", "behavior_name"), ("macro_preset", "model_name", "model", "model_name"),
    ("level", "course_name", "course", "course_name"),
    ("special_preset", "behavior", "behavior", "behavior_name"), ("special_preset", "model_name", "model", "model_name"),
    ("special_object", "level", "level", "folder"), ("special_object", "preset_name", "special_preset", "preset_name"),
    ("area", "level", "level", "folder"), ("area", "dialog", "dialog", "dialog_name"), ("area", "background_music", "sequence", "seq_name"),
    ("warp", "level", "level", "folder"), ("warp", "dest_level", "level", "level_name"), ("instant_warp", "level", "level", "folder"),
    ("course_name", "course_name", "course", "course_name"), ("star", "course_name", "course", "course_name"),
    ("model_load", "level", "level", "folder"), ("model_load", "model_name", "model", "model_name"),
    ("behavior_command", "behavior_name", "behavior", "behavior_name"), ("behavior_call", "behavior_name", "behavior", "behavior_name"),
    ("behavior_data_spawn", "behavior_name", "behavior", "behavior_name"), ("behavior_data_spawn", "spawned_behavior", "behavior", "behavior_name"),
    ("behavior_data_spawn", "spawned_model", "model", "model_name"), ("camera_trigger", "level", "level", "folder"),
    ("save_field", "struct_name", "save_struct", "struct_name"),
    ("mario_action_call", "action_name", "mario_action", "action_name"), ("mario_action_data_transition", "action_name", "mario_action", "action_name"),
    ("mario_action_data_transition", "to_action", "mario_action", "action_name"),
]


def build(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table that the tree's files give; a table whose files are missing is empty."""
    tree = Tree(spark, root)
    tables = {name: make(tree) for name, make in BUILDERS.items()}
    inside = r"src/game/behaviors/[^/]+\.inc\.c"
    calls, spawns = behavior_code(tree.texts(inside), tree.texts(rf"(?!{inside}$)src/.*\.c"), tables["behavior_command"])
    group = "stationary|moving|airborne|submerged|cutscene|automatic|object"
    files = rf"src/game/mario(?:_actions_(?:{group}))?\.c"
    machine = state_machine(tree.texts(r"include/[^/]+\.h"), tree.texts(files), tree.texts(r"src/game/mario_step\.c"))
    return tables | {"behavior_call": calls, "behavior_data_spawn": spawns} | machine


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The views whose tables are there."""
    found = {}
    for name, plan in VIEWS.items():
        try:
            found[name] = plan(tables)
        except KeyError as missing:
            if missing.args[0] in tables:
                raise
    return found


def repeated(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Keys that more than one row of a table has, with the number of rows; nulls don't count."""
    key = UNIQUE_KEYS[name]
    return tables[name].dropna(subset=key).groupBy(*key).count().filter("count > 1")


def listing(tables: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
    """(name, table or view, rows), tables first."""
    own, derived = sorted(tables.items()), sorted(views(tables).items())
    return [(name, "table", df.count()) for name, df in own] + [(name, "view", df.count()) for name, df in derived]


def columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table or view, column, type)."""
    return [(name, field.name, field.dataType.simpleString()) for name, df in sorted((tables | views(tables)).items()) for field in df.schema]


def outgoing(name: str) -> list[tuple[str, str, str]]:
    """(column, table, column there) of the keys by which a table points to others."""
    return [(column, parent, key) for child, column, parent, key in FOREIGN_KEYS if child == name]


def incoming(name: str) -> list[tuple[str, str, str]]:
    """(column, table, column there) of the keys by which others point to a table."""
    return [(key, child, column) for child, column, parent, key in FOREIGN_KEYS if parent == name]


def orphans(tables: dict[str, DataFrame], child: str, column: str, parent: str, key: str) -> DataFrame:
    """Values of a foreign key that no row of the parent has, with the number of rows."""
    known = tables[parent].select(tables[parent][key].alias(column))
    return tables[child].filter(tables[child][column].isNotNull()).join(known, column, "left_anti").groupBy(column).count()


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, dangling, different): all foreign keys whose tables are there, by one aggregation."""
    return dangling(tables, [key for key in FOREIGN_KEYS if key[0] in tables and key[2] in tables])


def joined(tables: dict[str, DataFrame], child: str, column: str, limit: int = 20) -> DataFrame:
    """A look at a table beside the one that a key of it points to."""
    parent, key = next((p, k) for c, col, p, k in FOREIGN_KEYS if (c, col) == (child, column))
    left, right = tables[child].alias("l"), tables[parent].alias("r")
    return left.join(right, left[column] == right[key]).limit(limit)


def register(tables: dict[str, DataFrame]) -> None:
    """Tables and views under their names, for spark.sql."""
    for name, df in (tables | views(tables)).items():
        df.createOrReplaceTempView(name)


def open_saved(spark: SparkSession, folder: str, names: list[str] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    return load(spark, folder, names, version)


def workspace(spark: SparkSession, folder: str, version: int | None = None) -> Workspace:
    """Saved tables under their names in spark.sql, with their views; they may be edited, reset and saved again."""
    return Workspace(spark, folder, version, register)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m codelake.build", description="Turns a source tree into tables.")
    parser.add_argument("-r", "--repo", required=True, help="the tree's folder")
    parser.add_argument("-d", "--db", help="folder for the tables; without it they are only counted")
    parser.add_argument("-o", "--overwrite", action="store_true", help="replace tables that are there")
    parser.add_argument("--version", action="version", version=f"codelake {VERSION}")
    args = parser.parse_args(argv)
    if "://" not in args.repo:  # Spark reads other stores, and says itself what is missing there
        if not os.path.exists(args.repo):
            raise FileNotFoundError(f"there is no {args.repo}")
        if not os.path.isdir(args.repo):
            raise NotADirectoryError(f"{args.repo} is no folder")
    spark = SparkSession.builder.appName("codelake").getOrCreate()
    tables = build(spark, args.repo)
    if args.db:
        save(tables, args.db, args.overwrite)
        tables = open_saved(spark, args.db, list(tables))
    for name, df in sorted(tables.items()):
        print(f"{name}\t{df.count()}")


if __name__ == "__main__":
    main()
