"""Operator 10: packing token sequences by dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so an instance of any size is one
count for each length. The plan is made on those counts (at most `capacity`
numbers) and says, for every length, which ranks of its pieces go to which
sequences; each task then looks up its own pieces.

Dominance: a set of pieces holding x dominates if every other set holding x
could be exchanged for it without needing more sequences. With r the room beside
x, the reduction fixes for good
  x alone                     if nothing else fits,
  x and y                     if y fills r exactly,
  x and the largest y <= r    if no two others fit together,
  x and the largest y <= r    if no three fit and y is no smaller than any pair,
  x, the largest y <= r and the largest z <= r - y
                              if no three fit and z is no smaller than the
                              smaller piece of any pair that fits.
Each fixed set is taken as often as its pieces last, the instance shrinks, and
the rest is packed best fit, longest first.

Null texts count as empty (one piece holding the end id), repeated rows are all
packed, ties are broken by doc_id and piece, an empty table gives no row, other
columns are left behind.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_and_text, ranges_for, read_table, small_batches
from .subwords import subwords

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Counts:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.of = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.of)

    def take(self, length: int, n: int) -> None:
        self.of[length] -= n
        if not self.of[length]:
            del self.of[length]
            self.lengths.remove(length)

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length <= most of which a piece is left beside those named."""
        for i in range(bisect.bisect_right(self.lengths, most) - 1, -1, -1):
            length = self.lengths[i]
            if self.of[length] > without.count(length):
                return length
        return None

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest pieces beside one of length `without`; fewer if there are no more."""
        found: list[int] = []
        for length in self.lengths:
            found += [length] * min(n - len(found), self.of[length] - (length == without))
            if len(found) == n:
                break
        return found


def _partners(left: Counts, x: int, room: int) -> tuple[int, ...] | None:
    """What provably goes with x, or None if no rule decides."""
    low = left.smallest(3, x)
    if not low or low[0] > room:
        return ()
    y = left.largest(room, (x,))
    assert y is not None
    if y == room or len(low) < 2 or low[0] + low[1] > room:
        return (y,)
    if len(low) == 3 and sum(low) <= room:
        return None
    best_sum = most_second = 0
    for a in left.lengths:
        if a > room:
            break
        b = left.largest(min(a, room - a), (x, a))
        if b is not None:
            best_sum, most_second = max(best_sum, a + b), max(most_second, b)
    if y >= best_sum:
        return (y,)
    z = left.largest(room - y, (x, y))
    return (y, z) if z is not None and z >= most_second else None


@dataclass
class Plan:
    """For each length: from which rank on its pieces go to which sequence at which offset."""

    sequences: int = 0
    fixed: int = 0
    ranges: dict[int, list[tuple[int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    _next: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def add(self, lengths: list[int], times: int) -> None:
        """`times` sequences that all hold pieces of these lengths."""
        offset = 0
        for length in lengths:
            self.ranges[length].append((self._next[length], self.sequences, offset))
            self._next[length] += times
            offset += length
        self.sequences += times

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(rows, np.int64).T for length, rows in self.ranges.items()}


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan, left = Plan(), Counts(counts)
    again = True
    while again and left.lengths:
        again = False
        for x in reversed(list(left.lengths)):
            while left.of.get(x) and (with_x := _partners(left, x, capacity - x)) is not None:
                group = [x, *with_x]
                need = {length: group.count(length) for length in group}
                times = min(left.of[length] // n for length, n in need.items())
                for length, n in need.items():
                    left.take(length, n * times)
                plan.add(group, times)
                again = True
    plan.fixed = plan.sequences
    _best_fit(plan, left, capacity)
    return plan


def _best_fit(plan: Plan, left: Counts, capacity: int) -> None:
    """Longest first; a piece goes where it leaves least room. Alike sequences are kept as one entry."""
    alike: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # room -> (how many, their lengths)
    rooms: list[int] = []

    def put(room: int, times: int, lengths: list[int]) -> None:
        if room not in alike:
            bisect.insort(rooms, room)
        alike[room].append((times, lengths))

    for x in reversed(left.lengths):
        n = left.of[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                times, lengths = alike[room].pop()
                if not alike[room]:
                    del alike[room]
                    rooms.pop(at)
            else:
                room, times, lengths = capacity, -(-n // (capacity // x)), []
            each = room // x
            full, over = min(times, n // each), 0
            if full:
                put(room - each * x, full, lengths + [x] * each)
            if full < times and (over := n - full * each):
                put(room - over * x, 1, lengths + [x] * over)
            if lengths and (rest := times - full - bool(over)):
                put(room, rest, lengths)
            n -= full * each + over
    for entries in alike.values():
        for times, lengths in entries:
            plan.add(lengths, times)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; only documents of more than `capacity` ids are cut, the first piece being the shorter one."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = subwords(tokenizer)
        end = np.array([end_id], words.dtype)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                borders = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (lo, hi) in enumerate(zip(borders, borders[1:])):
                    rows.append((doc_id, piece, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of 1 to `capacity`, doc_id and piece."""
    spark = pieces.sparkSession
    # Ranges are chosen from a sample, which would make the pieces a second time.
    pieces = cut(pieces)
    ordered = cut(pieces.repartitionByRange(ranges_for(pieces), "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece"))
    # A row for each range and each length in it: at most as many as there are ranges and lengths together.
    held = ordered.groupBy(F.spark_partition_id().alias("part"), "length").count().orderBy("part", "length").collect()
    totals: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for part, length, count in held:
        before[part, length] = totals[length]
        totals[length] += count
    plan = make_plan(dict(totals), capacity).arrays()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            starts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]]) if len(lengths) else []
            for lo, hi in zip(starts, [*starts[1:], len(lengths)]):
                length = int(lengths[lo])
                ranks = before[part, length] + seen[length] + np.arange(hi - lo)
                seen[length] += int(hi - lo)
                since, first, at = plan[length]
                k = np.searchsorted(since, ranks, side="right") - 1
                sequence[lo:hi], offset[lo:hi] = first[k] + ranks - since[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
