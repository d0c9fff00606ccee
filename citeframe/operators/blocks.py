"""Exact top-k search in blocks, pruned by pivots and the triangle inequality.

The vectors of a tenant are dealt into parts of bounded size, its queries into batches;
a part and a batch meet in one task. In a part, unit vectors gather around pivots, each the
vector farthest from those before. A cell keeps the least and greatest distance of its
vectors from the pivot, so from the distance of a query to the pivot follows the least
distance, and with it the greatest cosine, that any vector of the cell can have. A query
takes the cells by that bound and stops at the first that is below its k-th best so far;
what it skips cannot be among the k best of the part, hence not of the tenant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_PIVOTS = 64
_SLACK = 1e-9


def unit_rows(rows: np.ndarray) -> np.ndarray:
    sizes = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(sizes > 0, sizes, 1.0)[:, None]


class Cells:
    """Rows of a matrix by nearest pivot, with the range of distances of each cell."""

    def __init__(self, rows: np.ndarray):
        unit = unit_rows(rows)
        count = min(MOST_PIVOTS, int(np.ceil(np.sqrt(len(rows)))))
        nearest, best, chosen, at = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf), [], 0
        for k in range(count):
            chosen.append(at)
            away = np.sqrt(np.maximum(2 - 2 * (unit @ unit[at]), 0.0))
            closer = away < best
            nearest[closer], best[closer] = k, away[closer]
            at = int(best.argmax())
            if best[at] <= _SLACK:
                break
        self.pivots = unit[chosen]
        order = np.argsort(nearest, kind="stable")
        cuts = np.searchsorted(nearest[order], np.arange(len(chosen) + 1))
        self.rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.low = np.array([best[r].min() if len(r) else 0.0 for r in self.rows])
        self.high = np.array([best[r].max() if len(r) else 0.0 for r in self.rows])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest cosine each query (a row) can have with any vector of each cell."""
        away = np.sqrt(np.maximum(2 - 2 * unit_rows(queries) @ self.pivots.T, 0.0))
        least = np.maximum(np.maximum(away - self.high, self.low - away) - 1e-7, 0.0)
        return 1 - least**2 / 2


def best_rows(
    matrix: np.ndarray, sizes: np.ndarray, tie: np.ndarray, cells: Cells, bounds: np.ndarray, query: np.ndarray, k: int, open_: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best open rows for one query, their cosines, and how many rows were scored.
    Equal cosines go by `tie`. A cosine is a sum over one row, so equal vectors get equal
    ones wherever they lie."""
    length = float(np.sqrt((query * query).sum()))
    found, scores, scored = np.empty(0, np.int64), np.empty(0), 0
    for cell in np.argsort(-bounds, kind="stable"):
        if len(found) == k and bounds[cell] < scores[-1] - _SLACK:
            break
        rows = cells.rows[cell][open_[cells.rows[cell]]]
        if not len(rows):
            continue
        scored += len(rows)
        found = np.append(found, rows)
        scores = np.append(scores, (matrix[rows] * query).sum(axis=1) / (sizes[rows] * length))
        keep = np.lexsort((tie[found], -scores))[:k]
        found, scores = found[keep], scores[keep]
    return found, scores, scored


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length: row numbers and matrix of the vectors that are not zero and hold no null."""
    by_size: dict[int, list[int]] = {}
    values = column.to_pylist()
    for row, vector in enumerate(values):
        if vector and None not in vector and any(vector):
            by_size.setdefault(len(vector), []).append(row)
    return {size: (np.array(rows), np.array([values[r] for r in rows], float)) for size, rows in by_size.items()}


def search_block(asked: pa.Table, pool: pa.Table) -> Iterator[dict]:
    """Rows of the best of a part for each query of a batch; a row without document tells
    how many pairs were open to the query and how many were scored."""
    tie = np.empty(pool.num_rows, np.int64)
    tie[pc.sort_indices(pool, [("document_id", "ascending"), ("chunk_index", "ascending")]).to_numpy()] = np.arange(pool.num_rows)
    documents, places = pool.column("document_id").to_pylist(), pool.column("chunk_index").to_pylist()
    deals = np.array(pool.column("deal").to_pylist(), object)
    verified = np.array(pool.column("verified").to_pylist(), bool)
    lengths = _vectors(pool.column("embedding")).items()
    parts = {size: (rows, matrix, np.sqrt((matrix * matrix).sum(axis=1)), Cells(matrix)) for size, (rows, matrix) in lengths}
    masks: dict[tuple, np.ndarray] = {}
    for query in asked.to_pylist():
        rule = (query["deal"], query["verified_only"])
        if rule not in masks:
            open_ = np.ones(pool.num_rows, bool) if rule[0] is None else deals == rule[0]
            masks[rule] = open_ & verified if rule[1] else open_
        open_, k = masks[rule], query["k"]
        vector = query["query_vector"]
        usable = bool(vector) and None not in vector and any(vector) and len(vector) in parts
        chosen, scores, scored = np.empty(0, np.int64), np.empty(0), 0
        if usable:
            rows, matrix, sizes, cells = parts[len(vector)]
            told = np.array(vector, float)
            local, scores, scored = best_rows(matrix, sizes, tie[rows], cells, cells.bounds(told[None])[0], told, k, open_[rows])
            chosen = rows[local]
        yield {"query_id": query["query_id"], "document_id": None, "chunk_index": None, "similarity": None, "pairs": int(open_.sum()), "scored": scored}
        found = list(zip(chosen.tolist(), scores.tolist()))
        if len(found) < k:  # rows whose cosine is not defined come last
            known = np.zeros(pool.num_rows, bool)
            if usable:
                known[rows] = True
            rest = np.flatnonzero(open_ & ~known)
            found += [(int(row), None) for row in rest[np.argsort(tie[rest])][: k - len(found)]]
        for row, score in found:
            yield {"query_id": query["query_id"], "document_id": documents[row], "chunk_index": places[row], "similarity": score, "pairs": None, "scored": None}
