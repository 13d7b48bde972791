"""Operator 7: token ids as length-delimited binary records with an offset index.

A record file is the 8 bytes of MAGIC, one byte with the size of an id (2 or 4),
then one record after another:

    payload length      unsigned 64 bit
    masked checksum     unsigned 32 bit, of the length's 8 bytes
    payload             id of the document (signed 64 bit), a byte that is 1 if
                        that id is null, then the token ids
    masked checksum     unsigned 32 bit, of the payload

All numbers are little-endian. A checksum is crc32, rotated right by 15 bits
plus a constant, so that checksums of data holding checksums stay sound. Beside
every record file lies an index with one entry per record (document id, byte
offset of the record, number of ids), for reads in any order.

Null texts count as empty; null ids come first; rows that share an id are all
kept; an empty table gives no file and no row; other columns are left behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, id_and_text, ranges_for, read_table, small_batches
from .subwords import subwords

MAGIC = b"CLREC\x00\x01\n"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8")])
END_ID = 0
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = struct.pack("<qB", doc_id or 0, doc_id is None) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def _exactly(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError("a record file ends within a record")
    return data


def read_record(source, id_type: np.dtype) -> tuple[int | None, np.ndarray] | None:
    """The record at the source's place, None at its end. A wrong checksum is an error."""
    if not (length := source.read(8)):
        return None
    if len(length) != 8 or struct.unpack("<I", _exactly(source, 4))[0] != masked(length):
        raise ValueError("a record's length doesn't match its checksum")
    payload = _exactly(source, struct.unpack("<Q", length)[0])
    if struct.unpack("<I", _exactly(source, 4))[0] != masked(payload):
        raise ValueError("a record doesn't match its checksum")
    doc_id, null = struct.unpack_from("<qB", payload)
    return None if null else doc_id, np.frombuffer(payload, id_type, offset=9)


def open_records(source) -> np.dtype:
    """Reads the head of a file; the type of its ids."""
    if _exactly(source, len(MAGIC)) != MAGIC:
        raise ValueError("not a record file")
    return np.dtype(f"<u{_exactly(source, 1)[0]}")


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write every document's ids, `end_id` last, in ascending doc_id order; one row per file.

    Rows are dealt by ranges of doc_id, so file order is id order and no task
    sees more than its range. A repeated task writes the same bytes under a name
    of its own and then renames, so lost executors leave no half file behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or ranges_for(docs)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        words = subwords(tokenizer)
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        name = f"{top}/part-{part:06d}"
        end = np.array([end_id], words.dtype)
        entries, offset, total = [], len(MAGIC) + 1, 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = store.open_output_stream(f"{name}.{attempt}.tmp")
                out.write(MAGIC + bytes([words.dtype.itemsize]))
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1))):
                record = frame(doc_id, np.concatenate([ids, end]))
                out.write(record)
                entries.append((doc_id or 0, offset, len(ids) + 1))
                offset += len(record)
                total += len(ids) + 1
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{name}.{attempt}.idx.tmp") as index:
            index.write(np.array(entries, INDEX).tobytes())
        store.move(f"{name}.{attempt}.idx.tmp", f"{name}.idx")
        store.move(f"{name}.{attempt}.tmp", f"{name}.rec")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"part-{part:06d}.rec"], "docs": [len(entries)], "tokens": [total]})

    # The text's hash parts rows that share a doc_id, or have none.
    keys = ["doc_id", F.xxhash64("text")]
    ordered = id_and_text(docs).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(write, "part long, file string, docs long, tokens long")


def read_records(spark: SparkSession, folder: str, files: list) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record; files: the rows of write_records()."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed, before = [], 0
    for row in sorted(files, key=lambda r: r["part"]):
        listed.append((row["file"], before))
        before += row["tokens"]
    if not listed:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                with store.open_input_stream(f"{top}/{file}", buffer_size=1 << 20) as source:
                    kind = open_records(source)
                    while (record := read_record(source, kind)) is not None:
                        doc_id, ids = record
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)

    return spark.createDataFrame(listed, "file string, start long").repartition(len(listed)).mapInArrow(read, schema)


def read_index(spark: SparkSession, folder: str, files: list) -> DataFrame:
    """(file, offset, n_tokens) of every record, from the offset indexes alone; files: the rows of write_records()."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{file.removesuffix('.rec')}.idx") as source:
                    entries = np.frombuffer(source.read(), INDEX)
                columns = [pa.array([file] * len(entries)), *(pa.array(entries[entries.dtype.names[i]].astype(np.int64)) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "offset", "n_tokens"])

    names = spark.createDataFrame([(row["file"],) for row in files], "file string")
    return names.repartition(max(len(files), 1)).mapInArrow(read, "file string, offset long, n_tokens long")


def read_at(entries: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the records at (file, offset), in the order of the rows, whatever that is: a shuffled read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for batch in batches:
            found = []
            for file, offset in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{top}/{file}") as source:
                    kind = open_records(source)
                    source.seek(offset)
                    found.append(read_record(source, kind))
            doc_ids, ids = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([i.tolist() for i in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return entries.select("file", "offset").mapInArrow(read, "doc_id long, ids array<long>")


def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_dir(spark, "records")
    files = write_records(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(spark, folder, files.collect())  # a row for each file
