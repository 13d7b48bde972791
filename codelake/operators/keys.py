"""Foreign keys of many tables, all checked by one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Child table and column, parent table and column.
Key = tuple[str, str, str, str]


def dangling(tables: Mapping[str, DataFrame], keys: Sequence[Key], kind: str = "string") -> DataFrame:
    """(key, dangling, different): rows of each key whose value no row of its parent has, and how many such values; nulls point nowhere and don't count.

    Every table is read once: it hands out its own values as a parent and those of
    its keys as a child, each with the space (parent and column) that it belongs to.
    One aggregation by space and value then knows which values have a parent. Equal
    values are added up in the tasks first, so that neither a frequent value nor a
    large parent is gathered or sent to all. kind: the type that values are compared in.
    """
    spaces = list(dict.fromkeys((parent, column) for *_, parent, column in keys))
    # A key's number within its space says which counter it has.
    slot: dict[Key, int] = {}
    for key in keys:
        slot[key] = sum(other[2:] == key[2:] for other in slot)

    def values(name: str) -> DataFrame:
        as_parent = [(spaces.index((name, c)), -1, c) for p, c in spaces if p == name]
        as_child = [(spaces.index(key[2:]), slot[key], key[1]) for key in keys if key[0] == name]
        cells = ", ".join(f"named_struct('space', {space}, 'role', {role}, 'value', CAST(`{c}` AS {kind}))" for space, role, c in as_parent + as_child)
        return tables[name].selectExpr(f"inline(array({cells}))").filter("value IS NOT NULL")

    rows = reduce(DataFrame.union, (values(n) for n in dict.fromkeys(n for key in keys for n in (key[0], key[2]))))
    counts = [F.expr(f"count_if(role = {i})").alias(f"n{i}") for i in range(max(slot.values()) + 1)]
    orphans = rows.groupBy("space", "value").agg(F.expr("max(role = -1)").alias("held"), *counts).filter("NOT held")
    # One row, made of one from each task.
    own = [(spaces.index(key[2:]), slot[key]) for key in keys]
    sums = [F.expr(f"{f}(CASE WHEN space = {space} AND n{i} > 0 THEN n{i} END)").alias(f"{f}_{space}_{i}") for space, i in own for f in ("sum", "count")]
    cells = ", ".join(f"named_struct('key', '{key[0]}.{key[1]}', 'dangling', coalesce(sum_{space}_{i}, 0L), 'different', count_{space}_{i})" for key, (space, i) in zip(keys, own))
    return orphans.agg(*sums).selectExpr(f"inline(array({cells}))")
