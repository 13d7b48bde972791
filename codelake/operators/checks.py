"""Checks of whole relations: fingerprints, coverage of one table by rules, and sets against sets.

None of them gathers rows: what is counted is added up in the tasks before a shuffle.
Rows are told apart by two 64-bit hashes with different seeds, so two different rows
count as one with a chance of one in 2^128 for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SEEDS = (1, 2)


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """A hash of a row that tells a null from what stands beside it."""
    known = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *known, *(c.isNull() for c in known))


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """Aggregates rows, sum_1 and sum_2: equal for tables that hold the same rows equally often, in any order and layout."""
    sums = [F.sum(row_hash(columns, s).cast("decimal(28,0)")) for s in SEEDS]
    return [F.count("*").alias("rows"), *(F.coalesce(x, F.lit(0)).cast("string").alias(f"sum_{s}") for x, s in zip(sums, SEEDS))]


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The table, and its fingerprint once an action has read it: no pass of its own."""
    seen = Observation()
    return df.observe(seen, *fingerprint(df.columns)), seen


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both tables hold the same rows equally often, whatever their columns are called; one pass over each."""
    return len(a.columns) == len(b.columns) and a.agg(*fingerprint(a.columns)).first() == b.agg(*fingerprint(b.columns)).first()


def coverage(df: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """(parts, n): how many rows belong to exactly these parts, each given by a condition; null counts as no.

    One pass, and as many rows as there are combinations: no part is the residue,
    more than one an overlap.
    """
    names = F.array(*(F.when(holds, F.lit(name)) for name, holds in parts.items()))
    return df.select(F.array_compact(names).alias("parts")).groupBy("parts").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Claim:
    """What should hold between relations; `broken` is a condition on how often a row stands in each of them."""

    name: str
    relations: tuple[str, ...]
    broken: Callable[[Mapping[str, Column]], Column]


def subset(part: str, whole: str) -> Claim:
    """Each row of part stands in whole."""
    return Claim(f"{part} within {whole}", (part, whole), lambda n: (n[part] > 0) & (n[whole] == 0))


def disjoint(*names: str) -> Claim:
    """No row stands in two of them."""
    return Claim(" apart from ".join(names), names, lambda n: reduce(add, ((n[x] > 0).cast("int") for x in names)) > 1)


def union_of(whole: str, *parts: str) -> Claim:
    """As sets of rows, whole is all parts together."""
    return Claim(f"{whole} = {' or '.join(parts)}", (whole, *parts), lambda n: (n[whole] > 0) != (reduce(add, (n[p] for p in parts)) > 0))


def partition(whole: str, *parts: str) -> Claim:
    """Each row stands as often in whole as in all parts together, and in one part alone."""
    apart = disjoint(*parts)
    return Claim(f"{whole} = {' + '.join(parts)}", (whole, *parts), lambda n: apart.broken(n) | (n[whole] != reduce(add, (n[p] for p in parts))))


def check(relations: Mapping[str, DataFrame], claims: Sequence[Claim], examples: bool = False) -> DataFrame:
    """(claim, broken): how many different rows break each claim; with examples also one such row, as text.

    Each relation is read once, and all claims are settled by one aggregation by row:
    its key is the row's hashes, or with examples the row itself. Relations that are
    compared have columns of the same number and kinds, in order; names don't matter.
    """
    used = list(dict.fromkeys(r for c in claims for r in c.relations))
    place = {r: i for i, r in enumerate(used)}

    def marked(r: str) -> DataFrame:
        df = relations[r]
        key = [row_hash(df.columns, s).alias(f"h{s}") for s in SEEDS]
        if examples:
            key = [F.to_json(F.array(*(F.col(f"`{c}`").cast("string") for c in df.columns))).alias("row")]
        return df.select(*key, F.lit(place[r]).alias("relation"))

    rows = reduce(DataFrame.unionByName, (marked(r) for r in used))
    each = rows.groupBy(*(c for c in rows.columns if c != "relation")).agg(*(F.count_if(F.col("relation") == i).alias(f"n{i}") for i in place.values()))
    broken = [c.broken({r: F.col(f"n{place[r]}") for r in c.relations}) for c in claims]
    found = [F.count_if(b).alias(f"k{i}") for i, b in enumerate(broken)]
    if examples:
        found += [F.min(F.when(b, F.col("row"))).alias(f"e{i}") for i, b in enumerate(broken)]
    out = [F.struct(F.lit(c.name).alias("claim"), F.col(f"k{i}").alias("broken"), *([F.col(f"e{i}").alias("example")] if examples else [])) for i, c in enumerate(claims)]
    return each.agg(*found).select(F.explode(F.array(*out)).alias("c")).select("c.*")
