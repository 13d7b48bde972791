"""Record files and packed sequences against the tokenizers library and plain loops."""

import glob
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import common, packing, records

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    return lambda text, end: np.array([*made.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.fixture(scope="module")
def odd():
    words = " ".join(f"w{i}" for i in range(3000))
    return [(5, "a <|endoftext|> b"), (3, None), (4, ""), (None, "no id"), (None, None), (3, "a b"), (3, "a b"), (-2, "<|endoftext|>"), (9, words), (7, "q" * 20000), (8, "\u00a0\u2003x  y\n\n")]


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def test_records_equal_the_library(spark, encode):
    found = {r["doc_id"]: r for r in records.op7_binary_records(spark, SF).collect()}
    start = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = encode(r["text"], 0)
        assert (found[r["doc_id"]]["start"], found[r["doc_id"]]["n_tokens"], found[r["doc_id"]]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_odd_rows_come_back_in_order(spark, encode, odd):
    docs = spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, ids string")
    folder = common.fresh_dir(spark, "records")
    files = records.write_records(docs, folder, PATH, partitions=3).collect()
    rows = records.read_records(spark, folder, files).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in odd), key=lambda i: (i is not None, i))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((str(i), len(encode(t, 0)), crc(encode(t, 0))) for i, t in odd)
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    # A shuffled read through the index gives the same records.
    entries = records.read_index(spark, folder, files).orderBy(F.xxhash64("file", "offset"))
    assert sum(r["n_tokens"] for r in entries.collect()) == sum(r["n_tokens"] for r in rows)
    read = [(str(r["doc_id"]), crc(np.array(r["ids"]))) for r in records.read_at(entries, folder).collect()]
    assert sorted(read) == sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows)


def test_a_damaged_record_is_an_error(spark, odd):
    folder = common.fresh_dir(spark, "records")
    files = records.write_records(spark.createDataFrame(odd, "doc_id long, text string"), folder, PATH, partitions=1).collect()
    [name] = glob.glob(f"{folder.removeprefix('file:')}/*.rec")
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(spark, folder, files).collect()


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    folder = common.fresh_dir(spark, "records")
    assert records.read_records(spark, folder, records.write_records(none, folder, PATH).collect()).collect() == []
    assert packing.pack(packing.cut_pieces(none, PATH)).collect() == []


def check_packing(rows, docs, encode):
    want = []
    for doc_id, text in docs:
        ids = encode(text, 2)
        first = (len(ids) - 1) % 1024 + 1
        for piece, (lo, hi) in enumerate(zip([0, *range(first, len(ids), 1024)], range(first, len(ids) + 1, 1024))):
            want.append((str(doc_id), piece, lo, hi - lo, crc(ids[lo:hi])))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packed_pieces_equal_plain_cuts(spark, encode):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.op10_best_fit_packing(spark, SF).collect()
    assert check_packing(rows, docs, encode) <= 1.02 * -(-sum(r["length"] for r in rows) // 1024)


def test_odd_rows_are_packed(spark, encode, odd):
    check_packing(packing.pack(packing.cut_pieces(spark.createDataFrame(odd, "doc_id long, text string"), PATH)).collect(), odd, encode)


def fewest(lengths, capacity):
    """Sequences that an exhaustive search needs."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {room: k for k, room in enumerate(rooms) if room >= lengths[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_dominance_loses_no_optimum():
    rng = np.random.default_rng(5)
    for _ in range(150):
        lengths = rng.integers(1, 31, rng.integers(1, 10)).tolist()
        plan = packing.make_plan({x: lengths.count(x) for x in lengths}, 30)
        assert plan.sequences >= fewest(lengths, 30)
        if plan.fixed == plan.sequences:  # all of it decided by dominance
            assert plan.sequences == fewest(lengths, 30)


def test_odd_texts_have_the_ids_of_the_library(encode):
    """Blanks, line ends, marks and letters in any order, with a memory that soon overflows."""
    import pyarrow as pa

    from codelake.llm import subwords

    parts = ["a", "foo", "it's", "'s", "''", "don't", "é", "ª", "²", "漢", "٣", "!", ",.", "\n", "\n", "\n\n", " ", " ", " ", "\t", "\x1c", "\x85", "\xa0", "<|endoftext|>", "12", "x" * 60, "\0", "Ġ", "Ċ", "…", "\U0001f600", "." * 9]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(5000)]
    words = subwords.Subwords(PATH, remember=300)
    for lo in range(0, len(texts), 500):
        for text, ids in zip(texts[lo : lo + 500], words.encode(pa.array(texts[lo : lo + 500]))):
            assert ids.tolist() == encode(text, 0)[:-1].tolist(), repr(text)


def test_a_word_is_learned_once_for_all_marks(encode):
    import pyarrow as pa

    from codelake.llm import subwords

    made = subwords.Subwords(PATH)
    learned, led = [], made._led
    made._led = lambda words: learned.extend(words) or led(words)
    text = " ".join(f"wordle{mark}" for mark in ("", ",", ".", "!", "?", ":", ";", ").", "'"))
    assert made.encode(pa.array([f"so {text}"]))[0].tolist() == encode(f"so {text}", 0)[:-1].tolist()
    assert learned == list(dict.fromkeys(learned)) and sum("wordle" in w for w in learned) == 1
