"""The language model: scores by plain loops, the same for any layout of the rows, and rows with nothing to learn from."""

import zlib

import numpy as np
import pytest

from codelake.llm import lm
from codelake.llm.common import id_and_text

FOLDER = "/root/testdata/sf0.001"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def plain_score(text, counts, voc, model):
    """Token after token, with the whole distribution over classes each time."""
    r, bias, c1, c2 = (x.astype(np.float64) for x in model.parts)
    place = {w: i for w, i in voc.words.items()}
    class_of = lambda w: place[w] if place.get(w, lm.SHORTLIST) < lm.SHORTLIST else lm.bin_of(w)
    tokens = [*text.encode().lower().split(), b""]
    total, a, b = 0.0, class_of(b""), class_of(b"")
    for w in tokens:
        c = class_of(w)
        s = r @ (c1 @ r[a] + c2 @ r[b]) + bias
        p = np.exp(s[c] - s.max()) / np.exp(s - s.max()).sum()
        if c >= lm.SHORTLIST:
            k = c - lm.SHORTLIST
            unknown = (voc.once[k] + 0.5) / (voc.bins[k] + 1)
            p *= (1 - unknown) * counts[w] / max(voc.bins[k], 1) if w in counts else unknown
        total += np.log10(p)
        a, b = c, a
    return total


def test_scores_by_plain_loops(spark):
    docs = id_and_text(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    learn = docs.filter(lm._trained())
    counted = lm.count_tokens(learn).cache()
    counts = {bytes(r["word"]): r["c"] for r in counted.collect()}
    voc = lm.vocabulary(counted)
    model = lm.train(learn, voc)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = lm.score(docs, counted, voc, model).collect()
    assert len(rows) == len(texts)
    for row in rows[::9]:
        assert row["score"] == pytest.approx(plain_score(texts[row["doc_id"]], counts, voc, model), rel=1e-5)
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in rows if r["held_out"]]
    assert np.mean(gain) > 0


def test_the_layout_of_the_rows_doesn_t_matter(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 4000)  # several shards
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    scores = [{r["doc_id"]: (r["score"], r["base_score"]) for r in lm.lm_scores(docs.repartition(n)).collect()} for n in (1, 2, 9)]
    for other in scores[1:]:
        assert other.keys() == scores[0].keys()
        assert max(abs(other[i][j] / scores[0][i][j] - 1) for i in other for j in (0, 1)) < 1e-10


def test_nothing_to_learn_from_and_ties(spark):
    out = [i for i in range(200) if held_out(i)][:6]
    docs = spark.createDataFrame([(i, t) for i, t in zip(out, ["a b a", "", None, "c", "a a a", "b"])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm.lm_scores(docs).collect()}
    assert len(rows) == 6 and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in rows.values())
    # Words of equal count, more than have classes of their own: chosen by their letters, the same each time.
    ids = [i for i in range(400) if not held_out(i)]
    tied = spark.createDataFrame([(i, " ".join(f"w{i:03}x{j}" for j in range(4))) for i in ids], "doc_id long, text string")
    one, two = ({r["doc_id"]: r["score"] for r in lm.lm_scores(tied.repartition(n)).collect()} for n in (1, 5))
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], rel=1e-10) for i in one)


def test_tokens_stand_one_after_another():
    words, ends = lm._all_tokens(["A b", "", " c"])
    assert words == [b"a", b"b", lm.END, lm.END, b"c", lm.END] and ends.tolist() == [3, 4, 6]
    assert lm._all_tokens([])[0] == []
