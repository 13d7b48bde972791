"""Spelling variants against all pairs of words, and the automata against plain sets."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codelake.llm import automata, spelling


def one_apart(a, b):
    """By the definition: some letter of the longer word (or of both) left out makes them equal."""
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return abs(len(a) - len(b)) == 1 and (a in less(b) or b in less(a))


def plain(docs):
    """(word, form, root, n, n_near, form_n) from every pair of words."""
    held = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            held[run] += 1
    n = {w: k for w, k in held.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w]) or 0) for w in n)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def some_texts(seed, letters="abäßÖ", words=150):
    """Texts of a few common words and of many that are an edit or two from them."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(6, 11))) for _ in range(8)]

    def edited(w):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice(["", rng.choice(letters)]) + w[i + rng.randint(0, 1) :]
        return w

    some = [edited(rng.choice(base)) for _ in range(words)]
    texts = [" ".join(rng.choices(some, k=60) + rng.choices(base[:3], k=120)) for _ in range(15)]
    return [(i, t.upper() if i % 5 == 0 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, size", [(1, spelling.CELL), (2, 120), (3, 40)])
def test_against_all_pairs(spark, seed, size):
    docs = some_texts(seed)
    want = plain(docs)
    assert any(form for _, form, *_ in want)
    assert rows_of(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size)) == want


def test_chains_of_forms(spark):
    docs = [(i, t) for i, t in enumerate(["abcdefgh " * 1500 + "abcdefgx " * 140 + "abcdefyx " * 13 + "abcdezyx " * 2])]
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {w: (f, r, k) for w, f, r, k in [(w, f, r, k) for w, (f, r, k) in {r[0]: (r[1] or None, r[2], r[4]) for r in plain(docs)}.items()]}
    assert sum(f is not None for f, _, _ in got.values()) >= 2


def test_odd_rows_and_long_words(spark):
    long = "x" * 30 + "abcdefghij" * 9
    texts = [long, long[:40] + "q" + long[40:], long[:64], long[:65], long[:63], long[:80] + "z" + long[81:], "y" + long[1:], "X" * 5000, "x" * 4999, "x" * 2500 + "y" + "x" * 2499]
    docs = [(1, " ".join(texts)), (1, " ".join(texts)), (2, None), (3, ""), (None, "nothing nothing Nothinx nothinx"), (4, " ".join(texts * 12)), (5, "一二 \U0001f600 ~~~ ×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert rows_of(spelling.variants(df)) == plain(docs)
    assert rows_of(spelling.variants(df, 500)) == plain(docs)
    assert spelling.variants(df.limit(0)).collect() == []


def test_automaton_numbers_and_neighbours():
    words = sorted({"".join(w) for k in (2, 3, 4) for w in itertools.islice(itertools.product("abc", repeat=k), 0, None, 2)})
    rows = automata.matrix([w.encode() for w in words], 6)
    made = automata.Automaton(rows)
    assert made.states < len({w[:k] for w in words for k in range(5)})  # fewer than the trie's nodes
    asked = ["ab", "abc", "cccc", "zbca", "bcabc", "a"]
    lengths = np.array([len(w) for w in asked])
    i, j = made.near(automata.matrix([w.encode() for w in asked], 6), lengths, lengths // 2)
    want = {(a, b) for a in asked for b in words if one_apart(a, b) and a[: len(a) // 2] == b[: len(a) // 2]}
    assert {(asked[p], words[q]) for p, q in zip(i, j)} == want and len(i) == len(want)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: r for r in rows_of(spelling.op13_spelling_variants(spark, folder))}
    held = Counter()
    for doc_id, text in docs:
        held.update(spelling.words_in(doc_id, text or ""))
    n = {w: k for w, k in held.items() if k >= 2}
    assert set(got) == set(n)
    less = {}
    for w in n:
        for v in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}:
            less.setdefault(v, []).append(w)
    near = {w: set() for w in n}
    for group in less.values():
        for a, b in itertools.permutations(group, 2):
            if one_apart(a, b):
                near[a].add(b)
    assert {w: r[4] for w, r in got.items()} == {w: len(v) for w, v in near.items()}
