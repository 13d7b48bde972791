"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import contamination, embeddings, licences, linededup, lm, neardup, packing, quality, records, secrets, spelling, toxicity, whitening

QUERIES = {
    f.__name__: f
    for f in (
        neardup.op1_minhash_near_dedup,
        linededup.op2_line_dedup,
        embeddings.op3_embedding_near_dedup,
        lm.op4_lm_scores,
        contamination.op5_decontamination,
        quality.op6_quality_classifier,
        records.op7_binary_records,
        toxicity.op8_toxicity,
        secrets.op9_secret_scan,
        packing.op10_best_fit_packing,
        licences.op11_licence_scan,
        whitening.op12_embedding_whitening,
        spelling.op13_spelling_variants,
    )
}

# Runs of five lower-case words of each text; of shorter texts all their words.
_RUNS = """
words AS (SELECT {id} AS id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM {table} WHERE {id} IS NOT NULL),
runs AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN {short} ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS run FROM words)
"""
# Every pair (a, b) of which a can reach b by pairs (a, b) of `links`.
_REACH = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"

#: Learned scores, hashed chunks, packed sequences and files aren't expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE {_RUNS.format(id="doc_id", table="documents", short="[array_to_string(ws, ' ')]")},
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE shared.n >= 0.8 * (s.n + t.n - shared.n)),
{_REACH},
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, doc_id <= coalesce(m, doc_id) AS kept FROM documents LEFT JOIN least ON a = doc_id
""",
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{_REACH},
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
""",
    "op5_decontamination": f"""
WITH {_RUNS.format(id="doc_id", table="documents", short="[]")},
{_RUNS.format(id="item_id", table="benchmark", short="[]").replace("words", "item_words").replace("runs AS", "item_runs AS")},
sizes AS (SELECT id, count(*) AS n FROM item_runs GROUP BY id),
held AS (SELECT runs.id AS doc_id, item_runs.id AS item_id, count(*) AS k FROM runs JOIN item_runs USING (run) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_runs, k::DOUBLE / n AS containment FROM held JOIN sizes ON sizes.id = item_id WHERE k::DOUBLE / n >= 0.8
""",
}
