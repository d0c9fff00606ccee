"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes
log-count ratios.

Features are the byte n-grams of the lower-cased text, present or absent, hashed to a
fixed number of buckets. From labelled rows, each feature gets the log ratio of its
smoothed frequencies in the two classes; a logistic regression is then fitted on features
scaled by these ratios. The model is one weight per bucket, of a size fixed by `BUCKETS`,
and goes to the scoring tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .words import small_batches

SIZES = (3, 4, 5, 7)
BUCKETS = 1 << 18
THRESHOLD = 0.3
MAX_TRAIN_ROWS = 4000
LEAST_DOCS = 3
LEAST_RATIO = 1.0
_PENALTY = 1e-5
_STEPS = 300


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(text: str | None) -> np.ndarray:
    """Distinct n-gram buckets of a text, between two blanks; empty text has none."""
    if not text:
        return np.empty(0, np.int64)
    data = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "replace").lower().split()) + b" ", np.uint8).astype(np.uint64)
    out, gram = [], data
    for size in range(2, max(SIZES) + 1):
        if len(data) < size:
            break
        gram = (gram[:-1] << np.uint64(8)) | data[size - 1 :]
        if size in SIZES:
            key = (gram ^ np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((key >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a feature, per task; feature -1 counts all."""
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in small_batches(batches, "text"):
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
            counts[label, np.unique(features(text.as_py()))] += 1
            counts[label, BUCKETS] += 1
    found = np.flatnonzero(counts.any(axis=0))
    ids = np.where(found == BUCKETS, -1, found)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(counts[1, found]), pa.array(counts[0, found])], names=["feature", "pos", "neg"]
    )


def log_count_ratios(
    rows: DataFrame, least_docs: int = LEAST_DOCS, least_ratio: float = LEAST_RATIO
) -> tuple[np.ndarray, int, int]:
    """Naive Bayes log-count ratio per feature over (label, text) rows, 0 for features of
    fewer than `least_docs` documents or of a ratio nearer to 0 than `least_ratio`, and the number of documents of either class."""
    found = rows.mapInArrow(_class_counts, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos"), F.sum("neg")).toArrow()
    ids, pos_of, neg_of = (found.column(k).to_numpy() for k in range(3))
    pos, neg = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    pos[ids], neg[ids] = pos_of, neg_of
    n_pos, n_neg = int(pos[-1]), int(neg[-1])
    pos, neg = pos[:-1], neg[:-1]
    ratio = np.log(((pos + 1) / (n_pos + 2)) / ((neg + 1) / (n_neg + 2)))
    ratio[(pos + neg < least_docs) | (np.abs(ratio) < least_ratio)] = 0.0
    return ratio.astype(np.float32), n_pos, n_neg


def _with_ratio(ratio: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [np.unique(features(t.as_py())) for t in batch.column("text")]
            sets = [ids[ratio[ids] != 0].astype(np.int32) for ids in sets]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], names=["label", "features"])

    return work


def train(labels: np.ndarray, sets: list[np.ndarray], ratio: np.ndarray) -> Model:
    """Full-batch logistic regression with an L2 penalty on features scaled by `ratio`."""
    y = labels.astype(float)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ids = np.concatenate(sets).astype(np.int64)
    values = ratio[ids].astype(float)
    values /= max(1e-9, np.sqrt(np.bincount(rows, values**2, minlength=len(y)).mean()))
    scale = np.zeros(BUCKETS)
    scale[ids] = values
    weight, bias = np.zeros(BUCKETS), float(np.log(y.mean() / (1 - y.mean())))
    mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, _STEPS + 1):
        margin = np.bincount(rows, values * weight[ids], minlength=len(y)) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        slope = np.bincount(ids, values * error[rows], minlength=BUCKETS) / len(y) + _PENALTY * weight
        slope = np.append(slope, error.mean())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weight -= move[:-1]
        bias -= float(move[-1])
    return Model((weight * scale).astype(np.float32), bias)


def fit(
    rows: DataFrame, max_rows: int = MAX_TRAIN_ROWS, least_docs: int = LEAST_DOCS, least_ratio: float = LEAST_RATIO
) -> Model:
    """Fits on (id, text, label) rows with label 0 or 1: on all, or on the `max_rows` of
    them whose ids have the smallest hashes. Features are built in tasks; the driver gets
    one ratio per bucket and, of the sampled rows, the features that have one: with
    `least_docs=1, least_ratio=0.0` all of them, about ten times as many. Rows of a single
    class, or none, give a constant score."""
    ship_package(rows.sparkSession)
    known = rows.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    order = F.xxhash64("id", F.lit("train"))
    chosen = cut_lineage(known.select("id", order.alias("o")).distinct().orderBy("o", "id").limit(max_rows))
    used = cut_lineage(known.join(chosen.select("id"), "id", "left_semi").select("label", "text"))
    ratio, n_pos, n_neg = log_count_ratios(used, least_docs, least_ratio)
    if not n_pos or not n_neg:
        rate = (n_pos + 0.1) / (n_pos + n_neg + 1)  # without labels, not toxic
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    made = used.mapInArrow(_with_ratio(ratio), "label int, features array<int>").toArrow()
    column = made.column("features").combine_chunks()
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return train(made.column("label").to_numpy(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], ratio)


def _apply(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = np.zeros(BUCKETS, np.int64)
        for batch in small_batches(batches, "text"):
            scores = []
            for text in batch.column("text"):
                ids = features(text.as_py())
                place = np.arange(len(ids))
                stamp[ids] = place  # the last place of each distinct bucket stays
                margin = float(model.weights[ids[stamp[ids] == place]].sum(dtype=np.float64)) + model.bias
                scores.append(1 / (1 + np.exp(-np.clip(margin, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(scores, pa.float64())], names=["doc", "score"])

    return work


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The `keep` columns of docs (default: all), then `score` and `predicted`.

    Null and empty texts get the score of the bias alone. Every row is scored, repeated
    rows alike. Kept columns travel inside a struct, so that none clashes with others.
    """
    ship_package(docs.sparkSession)
    names = keep or docs.columns
    rows = docs.select(F.struct(*names).alias("doc"), F.col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    scored = rows.mapInArrow(_apply(model), f"doc {kind}, score double")
    return scored.select("doc.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def remainder(id_col: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, label) of documents with a toxicity label; one label per id counts."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return docs.select(F.col("doc_id").alias("id"), "text").join(known, F.col("id") == known.doc_id).select("id", "text", "label")
