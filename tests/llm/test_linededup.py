"""Line dedup against a plain version of its rule."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from codelake.llm import linededup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
K, R = linededup.WORDS, linededup.RADIUS
FOOTER = "Share this page\nTerms of use\nPrivacy policy\nAll rights reserved"


def hash_of(word):
    h = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def words_of(line):
    """The words of a long line; for texts whose words are short."""
    return line.split(" ") if len(line.encode()) > linededup.LONGEST else [line]


def chunks_of(text):
    """(what it holds, its words' places (line, word)) of every chunk, in order."""
    lines, found = text.split("\n"), []
    full = [k for k, line in enumerate(lines) if line]
    for p, k in enumerate(full):
        words = words_of(lines[k])
        if p + 1 < len(full):
            end = full[p + 2] if p + 2 < len(full) else len(lines)
            found.append(((lines[k], lines[full[p + 1]]), [(x, w) for x in range(k, end) for w in range(len(words_of(lines[x])))]))
        h = [hash_of(w) for w in words]
        last = len(words) - K
        for i in range(last + 1) if len(words) > 1 else ():
            if i in (0, last) or i >= R and all(h[i] < h[i - j] and i + j < len(h) and h[i] <= h[i + j] for j in range(1, R + 1)):
                found.append((tuple(words[i : i + K]), [(k, w) for w in range(i, i + K)]))
    return found


def without_repeats(docs):
    """The texts that stay of (doc_id, text) rows with unique ids."""
    first, out = {}, {}
    for doc_id, text in sorted(docs):
        for held, places in chunks_of(text):
            first.setdefault(held, (doc_id, places))
    for doc_id, text in docs:
        gone = {p for held, places in chunks_of(text) if first[held] != (doc_id, places) for p in places}
        lines = [[x for w, x in enumerate(words_of(line)) if (k, w) not in gone] for k, line in enumerate(text.split("\n"))]
        out[doc_id] = "\n".join(" ".join(words) for words in lines if words)
    return out


def removed(spark, rows, schema=DOCS):
    return [r["text"] for r in linededup.remove_repeats(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()]


def some_words(rng, letters, n):
    return ["".join(rng.choice(list(letters), 6)) for _ in range(n)]


def pairs_of(text):
    lines = [x for x in (text or "").split("\n") if x]
    return list(zip(lines, lines[1:]))


def test_every_repeated_chunk_goes_and_nothing_else(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] and max(map(len, re.split("[ \n]", r["text"]))) < 50]
    docs += [(10**6 + i, f"{t}\n\n{FOOTER}") for i, (_, t) in enumerate(docs[:40])]
    found = {r["doc_id"]: r["text"] for r in linededup.remove_repeats(spark.createDataFrame(docs, DOCS)).collect()}
    want = without_repeats(docs)
    assert found == want


def test_no_two_lines_stand_twice_on_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before, after = (Counter(p for r in d.collect() for p in pairs_of(r["text"])) for d in (docs, linededup.remove_repeats(docs)))
    twice = lambda pairs: sum(n - 1 for n in pairs.values())
    # What is left are pairs of lines that met only when the lines between them went.
    assert twice(before) > 500 and sum(n - 1 for p, n in after.items() if p in before) < 0.02 * twice(before)
    lines = {x for r in docs.collect() for x in (r["text"] or "").split("\n")}
    kept = {x for r in linededup.remove_repeats(docs).collect() for x in (r["text"] or "").split("\n")}
    assert all(x in kept for x in lines if len(x.encode()) <= linededup.LONGEST)  # whatever goes stands elsewhere


def test_a_footer_of_short_lines_stays_once(spark):
    rng = np.random.default_rng(8)
    own = [" ".join(some_words(rng, "abcdefgh", 8)) for _ in range(50)]
    found = removed(spark, [(i, f"{t}\n{FOOTER}" if i % 2 else f"{FOOTER}\n\n{t}") for i, t in enumerate(own)])
    assert found[0] == f"{FOOTER}\n\n{own[0]}" and found[1:] == own[1:]


def test_lines_in_other_company(spark):
    a, b, c, d, e = ("alpha one", "beta two", "gamma three", "delta four", "epsilon five")
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"{d}\n{b}\n{c}\n{e}"), (3, f"{b}\n{e}\n{a}"), (4, f"{a}\n\n{b}"), (5, f"{a}\n{c}\n{a}\n{c}\n{d}"), (6, f"{e}\n")]
    assert removed(spark, rows) == [rows[0][1], f"{d}\n{e}", rows[2][1], "", f"{a}\n{c}\n{d}", rows[5][1]]


def test_a_shared_passage_stays_once(spark):
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(some_words(rng, "abcdefghimnos", n))
    passage, own = words(200), [words(60) for _ in range(3)]
    found = removed(spark, [*((i, f"{o}\n{passage}\n{words(40)}") for i, o in enumerate(own)), (8, None), (9, "")])
    assert passage in found[0] and all(o.rpartition(" ")[0] in f for o, f in zip(own, found))
    assert all(sum(w in f for w in passage.split()) < 60 for f in found[1:3])
    assert found[3:] == [None, ""]


def test_most_of_a_passage_of_fifty_words_goes(spark):
    rng = np.random.default_rng(4)
    rows, passages = [], []
    for i in range(60):
        passages.append(some_words(rng, "abcdefghimnos", 55))
        rows += [(2 * i + k, " ".join([*some_words(rng, "hijkmpq", 40), *passages[-1], *some_words(rng, "hijkmpq", 40)])) for k in range(2)]
    found = removed(spark, rows)
    assert all(" ".join(p) in found[2 * i] for i, p in enumerate(passages))
    left = [sum(w in found[2 * i + 1].split(" ") for w in p) / len(p) for i, p in enumerate(passages)]
    assert np.mean(left) < 0.35 and np.mean(np.array(left) > 0.5) < 0.1


def test_passages_in_any_script_are_found(spark):
    rng = np.random.default_rng(6)
    words = lambda letters, n: some_words(rng, letters, n)
    passages = [words("бвгджзкл", 90), [str(x) for x in rng.integers(10**5, 10**6, 90)], words("bcdfgor", 90), words("αβγδικλμ", 90), ["".join(rng.choice([chr(c) for c in range(0x4E00, 0x5E00)], 300))]]
    for passage in passages:
        own = [" ".join(words("hijkmpq", 40)) for _ in range(4)]
        first, second = removed(spark, [(i, f"{own[2 * i]} {' '.join(passage)} {own[2 * i + 1]}") for i in range(2)])
        parts = passage if len(passage) > 1 else list(passage[0])
        assert all(w in first for w in parts) and sum(w in second for w in parts) <= 0.6 * len(parts)
        assert own[2] in second and own[3] in second


def test_unequal_texts_under_one_hash_stay(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(some_words(rng, "abcdefgh", 60))) for i in range(4)]
    plain = linededup.chunks
    monkeypatch.setattr(linededup, "chunks", lambda docs: plain(docs).selectExpr("uid", "at", "0L as h"))
    monkeypatch.setattr(linededup, "_hash_of", lambda chunk: linededup.F.lit(0).cast("long"))
    assert removed(spark, rows) == [t for _, t in rows]


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    text = " ".join(some_words(rng, "abcdefgh", 100))
    schema = "doc_id long, text string, n_chars int, uid long, row string, spans string, at int, pieces string, stays string, gone long, joined string"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (3, "one two"), (4, None), (5, ""), (6, "x" * 5000), (6, " ".join(some_words(rng, "xyz", 30)))]
    rows = [(*r, len(r[1] or ""), i, "r", "s", i, "a", "b", i, "c") for i, r in enumerate(rows)]
    found = [tuple(r) for r in linededup.remove_repeats(spark.createDataFrame(rows, schema)).collect()]
    assert len(found) == len(rows) and sorted(r[3:] for r in found) == sorted(r[3:] for r in rows)
    by_row = {r[3]: r[:3] for r in found}
    assert by_row[0] == by_row[1] == (1, text, len(text))  # repeated rows are one document
    assert by_row[2][0] == 2 and by_row[2][2] < 150 and by_row[3] == by_row[4] == (None, *by_row[2][1:])
    assert all(by_row[i] == rows[i][:3] for i in range(5, 10))


def test_no_documents(spark):
    assert removed(spark, []) == []


@pytest.mark.parametrize("n", [K - 1, K])
def test_long_lines_of_few_words(spark, n):
    text = " ".join(f"word{'x' * 12}{i}" for i in range(n))
    assert len(text) > linededup.LONGEST and removed(spark, [(1, text), (2, text), (3, "one short line"), (4, "one short line")]) == [text, "" if n == K else text, "one short line", "one short line"]


def test_a_very_long_text_of_short_lines(spark):
    lines = [f"line {i % 15_000} of many" for i in range(30_000)]
    first, second = removed(spark, [(1, "\n".join(lines)), (2, "own\n" + "\n".join(lines))])
    assert first == "\n".join(lines[:15_000]) and second == "own"


def test_emptied_documents_may_go(spark):
    rows = [(1, FOOTER), (2, FOOTER + "\n \n"), (3, ""), (4, None), (5, FOOTER + "\nown")]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in linededup.remove_repeats(df, emptied=False).collect()) == [(1, FOOTER), (3, ""), (4, None), (5, "own")]
    assert linededup.remove_repeats(df).count() == 5


def test_conditions_on_the_result_cost_nothing(spark):
    """A filter and a narrow selection, which the optimizer could weave into the work on each word."""
    rows = [(i, "\n".join(" ".join(f"word{k * 31 % 977} of line {j}" for k in range(60)) for j in range(60))) for i in range(2)]
    out = linededup.remove_repeats(spark.createDataFrame(rows, DOCS), report=True)
    assert out.filter("length(text) > 0 and text like '%word%'").count() == 1 and out.select("removed_chunks").agg({"removed_chunks": "sum"}).first()[0] > 0


def test_found_chunks_go_to_their_documents_once(spark):
    rng = np.random.default_rng(8)
    text = " ".join(some_words(rng, "abcdefgh", 100))
    out = linededup.remove_repeats(spark.createDataFrame([(1, text), (2, text), (3, "own")], DOCS), report=True)
    found = sorted(tuple(r)[:3] for r in out.collect())
    assert found[0] == (1, text, 0) and found[1][2] > 0 and found[2] == (3, "own", 0)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 1
