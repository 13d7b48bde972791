"""Licence scans against a plain search of all matches and chains."""

import random
import re

import pytest

from codelake.llm import licences
from codelake.llm.licence_texts import TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_matches(template, text):
    """Runs of four or more words that stand in both and can be drawn out on neither side."""
    found = set()
    for p in range(len(template)):
        for q in range(len(text)):
            if p and q and template[p - 1] == text[q - 1]:
                continue
            k = 0
            while p + k < len(template) and q + k < len(text) and template[p + k] == text[q + k]:
                k += 1
            if k >= 4:
                found.add((p, q, k))
    return found


def plain_best(matches, gap):
    """The most template words that a chain covers, over all chains."""

    def best(i):
        p, q, k = m[i]
        ways = [best(j) + k - max(0, a + n - p, b + n - q) for j, (a, b, n) in enumerate(m) if a < p and b < q and q - b - n <= gap and k > max(0, a + n - p, b + n - q)]
        return max([k, *ways])

    m = sorted(matches)
    return max((best(i) for i in range(len(m))), default=0)


def plain_base(text):
    w = words(text)
    hits = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = sorted(i for i, _ in hits)
    return len(w), len(hits), at[0] if at else None, at[-1] if at else None, sorted({label for _, label in hits})


@pytest.mark.parametrize("seed", range(12))
def test_matches_and_scores_against_plain_search(seed):
    rng = random.Random(seed)
    templates = [(str(t), " ".join(rng.choices("abcdef"[: rng.randint(2, 6)], k=rng.randint(4, 25)))) for t in range(4)]
    text = " ".join(rng.choices("abcdefg", k=30) + templates[0][1].split()[:9] + rng.choices("abcdg", k=5) + templates[1][1].split() + ["z"] * 50 + templates[0][1].split()[4:])
    scanner = licences.Scanner(templates)
    w = words(text)
    ids = [scanner.numbers.get(x.encode(), 0) for x in w]
    got = set(scanner.automaton.matches(ids))
    assert got == {(t, *m) for t, (_, template) in enumerate(templates) for m in plain_matches(words(template), w)}
    want = max(plain_best(plain_matches(words(template), w), licences.GAP) / len(words(template)) for _, template in templates)
    assert scanner(text)["score"] == pytest.approx(want)


@pytest.mark.parametrize("t", range(len(TEMPLATES)))
def test_each_template_is_found_whole_and_edited(t):
    label, text = TEMPLATES[t]
    scanner, w = licences.Scanner(), text.split()
    found = scanner("foreign words stand here " * 30 + text.upper().replace(" ", "\n * ") + " and go on")
    assert label in found["labels"] and found["score"] == 1.0 and any(s["start"] == 120 and s["covered"] == 1.0 for s in found["spans"])
    if len(w) > 40:
        edited = " ".join("EDITED" if i % 17 == 8 else x for i, x in enumerate(w))
        own = lambda text: [s["covered"] for s in scanner(text)["spans"] if s["template"] == t]
        assert label in scanner(edited)["labels"] and len(own(edited)) == 1 and own(edited)[0] < 1
        assert own(" ".join(w[: len(w) // 4])) == []


def test_spans_of_several_copies():
    found = licences.Scanner()("x y z. " + "Released under the MIT License. one two three four. " * 3)
    assert [(s["label"], s["start"], s["end"]) for s in found["spans"] if s["template"] == 0] == [("mit", 3 + 9 * i, 8 + 9 * i) for i in range(3)]


def test_odd_rows(spark):
    long = "word " * 250_000 + "Licensed under the Apache License, Version 2.0" + " word" * 250_000
    rows = [(1, "Released under the MIT  licenſe, MIT-License"), (1, None), (2, ""), (None, "GNU general public license"), (3, long), (4, "mit license mit license's mitlicense"), (5, "İMIT LICENSE \U0001f600"), (5, "x" * 3_000_000)]
    df = spark.createDataFrame([(i, t, 0.5, "k") for i, t in rows], "doc_id long, text string, score double, labels string")
    got = licences.find_licences(df).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in got) == sorted((str(i), n, k, str(a), str(b), labels) for i, t in rows for n, k, a, b, labels in [plain_base(t)])
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 for r in got)
    assert [r["labels"] for r in got if r["doc_id"] == 3] == [["apache"]]
    assert licences.find_licences(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        licences.Scanner([("none", " ... ")])


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = licences.op11_licence_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, k, first, last, labels = plain_base(docs[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, k, first, last, ",".join(labels))
        best = max(plain_best(plain_matches(words(t), words(docs[r["doc_id"]])), licences.GAP) / len(words(t)) for _, t in TEMPLATES if len(words(t)) < 12) if "licen" in docs[r["doc_id"]].lower() else 0
        assert r["score"] >= best - 1e-12
    assert any(r["labels"] for r in rows)
