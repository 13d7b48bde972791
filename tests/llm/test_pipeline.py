"""Each stage of the pipeline on odd rows: nulls, repeats, emptied and long texts, extra columns, and a table without rows."""

import pytest

import corpus_pipeline
from codelake.llm.common import read_table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
FOOTER = "Share this page\nTerms of use\nPrivacy policy\nAll rights reserved"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table and odd rows, with columns whose names the operators use themselves."""
    own = read_table(spark, SF, "documents")
    text = own.orderBy("doc_id").first()["text"]
    odd = [(10**6 + i, t) for i, t in enumerate([None, "", text, text, FOOTER, FOOTER, f"one line of its own here\n{FOOTER}", "word " * 30_000, "x" * 20_000])] + [(None, "a row without an id"), (10**6, None)]
    rows = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], own.select("doc_id", "text", "lang", "source", "n_chars").schema)
    return own.unionByName(rows, allowMissingColumns=True).selectExpr("*", "1 as kept", "'s' as spans", "doc_id as uid", "0.5 as score").cache()


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_a_stage_keeps_columns_and_clean_rows(spark, docs, name):
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    before, after = rows_of(docs), rows_of(out)
    assert 0.5 * len(before) < len(after) <= len(before)
    if name != "line_dedup":  # what stays, stays as it was
        assert not set(after) - set(before)
    by_id = {r["doc_id"]: r["text"] for r in out.collect()}
    if name == "line_dedup":
        assert by_id[10**6 + 4] == FOOTER and 10**6 + 5 not in by_id and by_id[10**6 + 6] == "one line of its own here"
        assert by_id[10**6] is None and by_id[10**6 + 1] == ""  # empty before
    if name == "near_dedup":
        assert 10**6 + 3 not in by_id and None in by_id
    assert rows_of(STAGES[name](spark, docs.limit(0), SF)) == []


def test_packing_takes_every_row(spark, docs):
    out = STAGES["packing"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.collect()}
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
    assert STAGES["packing"](spark, docs.limit(0), SF).collect() == []
