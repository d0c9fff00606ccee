"""Pruned batch search against a plain one."""

import numpy as np

from citeframe.operators import retrieval as rt


def search_tables(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 8))
    vectors = [(centres[k % 12] + 0.05 * draw.normal(size=8)).tolist() for k in range(900)]
    vectors += [vectors[0]] * 40 + [[0.0] * 8, [1.0, 2.0], None, [None] * 8] + [[2.0 * x for x in vectors[5]]] * 3
    chunks = [(k // 3, k % 3, 0 if k % 7 else 1, f"d{k % 4}" if k % 5 else None, 1, f"text {k}", v) for k, v in enumerate(vectors)]
    documents = [(k, 0, f"n{k}", "other", k % 2 == 0, k % 11 == 10) for k in range(len(chunks) // 3 + 1)]
    documents += [(5000, 1, "x", "other", True, False)]
    asked = [(k, k % 2, "d1" if k % 4 == 0 else None, k % 3 == 0, k % 24, vectors[k * 5]) for k in range(60)]
    asked += [(100, 0, None, False, 20, [0.0] * 8), (101, 9, None, False, 5, vectors[0]), (102, 0, None, False, 3, vectors[0]), (103, 0, "none", False, 3, vectors[1])]
    return (
        spark.createDataFrame(chunks, "document_id int, chunk_index int, organization_id int, deal_id string, page_number int, content string, embedding array<float>"),
        spark.createDataFrame(documents, "document_id int, organization_id int, document_name string, source_type string, is_verified_knowledge boolean, is_archived boolean"),
        spark.createDataFrame(asked, "query_id int, organization_id int, deal_id string, verified_only boolean, k int, query_vector array<float>"),
    )


def plain(chunks, documents, asked):
    docs = {d.document_id: d for d in documents if not d.is_archived}
    out, pairs = {}, {}
    for q in asked:
        hits = []
        for c in chunks:
            d = docs.get(c.document_id)
            if d is None or not (q.organization_id == c.organization_id == d.organization_id):
                continue
            if (q.deal_id is not None and q.deal_id != c.deal_id) or (q.verified_only and not d.is_verified_knowledge):
                continue
            a, b = c.embedding, q.query_vector
            known = a and None not in a and len(a) == len(b) and any(a) and any(b)
            score = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if known else None
            hits.append((score is None, -round(score or 0, 9), c.document_id, c.chunk_index))
        pairs[q.query_id] = len(hits)
        out[q.query_id] = [(r, h[2], h[3]) for r, h in enumerate(sorted(hits)[: min(max(q.k, 1), 20)], 1)]
    return out, pairs


def test_pruned_search_is_exact(spark):
    tables = search_tables(spark)
    want, pairs = plain(*(t.collect() for t in tables))
    got = {}
    for r in rt.match_chunks_batch(*tables).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.document_id, r.chunk_index))
    assert {q: sorted(rows) for q, rows in got.items()} == {q: rows for q, rows in want.items() if rows}
    parts = rt.search_parts(*tables, part_rows=100, batch=7).cache()
    best = {}
    for r in parts.filter("document_id is not null").collect():
        best.setdefault(r.query_id, []).append((r.similarity is None, -round(r.similarity or 0, 9), r.document_id, r.chunk_index))
    for q, rows in want.items():
        assert [h[2:] for h in sorted(best.get(q, []))[: len(rows)]] == [h[1:] for h in rows]
    cost = {r.query_id: r for r in rt.search_cost(parts).collect()}
    assert {q: r.pairs for q, r in cost.items() if r.pairs} == {q: n for q, n in pairs.items() if n}
    # Twelve tight clusters: most of the pairs are never compared.
    assert sum(r.scored for r in cost.values()) < 0.5 * sum(r.pairs for r in cost.values())
