"""Language-model scoring by prediction by partial matching (PPM, escape method C).

The model is a trie of byte contexts up to `ORDER` bytes. The training texts give the
count of every (context, byte) pair; counts of shorter contexts are sums of those. A
byte's probability is c / (n + t) in the longest context that was seen, where n is the
sum of the counts there and t the number of different bytes. A byte not seen there costs
the escape t / (n + t), and the next shorter context is asked with the bytes of the
longer one excluded from n and t. Below order 0 all bytes not excluded are equally
likely. Texts start after a fixed context and end with an end symbol, two byte values
that UTF-8 never uses.

Nothing of the corpus is held in one place. Counts are a distributed table. The code
lengths of a gram follow from the part of the trie below its last two context bytes
(at most 2**24 grams by construction) and from the counts of orders 1 and 0 (at most
2**16 numbers, which go to the tasks). Documents are dealt to blocks of about
`BLOCK_BYTES`; each block asks for the distinct grams and words it contains and is
scored with the answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .words import hash_words, small_batches, split_words

ORDER = 4
BLOCK_BYTES = 24_000_000
SMOOTHING = 0.1
_START, _END = b"\xfe" * ORDER, b"\xff"
_PIECE = 4_000_000
_WORD = np.uint64(1 << 63)


def _pieces(raws: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (document, bytes) of bounded size; a long document gives several parts
    that overlap by a context."""
    group, size = [], 0
    for number, raw in enumerate(raws):
        whole, last = b"".join((_START, raw, _END)), len(raw) + 1
        for low in range(0, last, _PIECE):
            part = whole[low : min(low + _PIECE, last) + ORDER]
            group.append((number, part))
            size += len(part)
            if size >= _PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def grams(parts: list[bytes]) -> np.ndarray:
    """Every (context, byte) of the parts as one number of ORDER + 1 bytes."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    out = data[: len(data) - ORDER].copy()
    for k in range(1, ORDER + 1):
        out <<= np.uint64(8)
        out |= data[k : len(data) - ORDER + k]
    ends = np.cumsum([len(p) for p in parts])[:-1]
    keep = np.ones(len(out), bool)
    keep[(ends[:, None] - ORDER + np.arange(ORDER)).ravel()] = False
    return out[keep]


def _counted(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with their counts added up."""
    if not values:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found, place = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), minlength=len(found))
    return found, total.astype(np.int64)


def _used_grams(raws: list[bytes], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts, with their number in texts that are not held out."""
    values, counts = [], []
    for flag in (False, True):
        for group in _pieces([r for r, h in zip(raws, held) if h == flag]):
            found, number = np.unique(grams([p for _, p in group]), return_counts=True)
            values.append(found)
            counts.append(np.zeros(len(found), np.int64) if flag else number)
    return _counted(values, counts)


def _bytes_of(column) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "replace") for t in column]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 16_000_000):
        found, number = _used_grams(_bytes_of(batch.column("text")), batch.column("held").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(number)], names=["key", "c"])


class _Level:
    """Entries and context nodes of one order inside a group of grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        self.keys, place = np.unique(keys & mask, return_inverse=True)
        self.counts = np.bincount(place, counts, minlength=len(self.keys))
        self.nodes, self.place = np.unique(self.keys >> np.uint64(8), return_inverse=True)
        self.n = np.bincount(self.place, self.counts, minlength=len(self.nodes))
        self.t = np.bincount(self.place, minlength=len(self.nodes)).astype(float)


def _look(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each asked key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    return at, sorted_keys[at] == asked


class ContextTrie:
    """log10 probabilities of the grams of one two-byte context."""

    def __init__(self, low_counts: np.ndarray):
        self.c1 = low_counts.reshape(256, 256).astype(float)  # [context byte, byte]
        self.c0 = self.c1.sum(axis=0)
        self.n1, self.t1 = self.c1.sum(axis=1), (self.c1 > 0).sum(axis=1).astype(float)
        self.n0, self.t0 = self.c0.sum(), float((self.c0 > 0).sum())

    def log_probabilities(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        seen = counts > 0
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        n, t = np.full(len(keys), np.nan), np.full(len(keys), np.nan)  # nan: nothing excluded yet
        symbol = (keys & np.uint64(255)).astype(np.int64)

        def settle(count, found, own_n, own_t, rest_n, rest_t):
            """One order: code the byte or escape; `found` says that the context was seen."""
            nonlocal n, t
            use_n, use_t = np.where(np.isnan(n), own_n, n), np.where(np.isnan(t), own_t, t)
            total = use_n + use_t
            coded = open_ & found & (count > 0)
            out[coded] += np.log10(count[coded] / total[coded])
            fled = open_ & found & (count <= 0) & (total > 0)
            out[fled] += np.log10(use_t[fled] / total[fled])
            open_[coded] = False
            n, t = np.where(found, rest_n, np.nan), np.where(found, rest_t, np.nan)

        levels = {k: _Level(keys[seen], counts[seen], k) for k in range(2, ORDER + 1)}
        for k in range(ORDER, 1, -1):
            level = levels[k]
            if k > 2:
                below = levels[k - 1]
                mask = np.uint64((1 << (8 * k)) - 1)
                lower = below.counts[_look(below.keys, level.keys & mask)[0]] if len(level.keys) else np.empty(0)
                at, _ = _look(below.nodes, level.nodes & np.uint64((1 << (8 * (k - 1))) - 1))
                base_n, base_t = (below.n[at], below.t[at]) if len(level.nodes) else (np.empty(0), np.empty(0))
            else:
                context = ((level.keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
                lower = self.c1[context, (level.keys & np.uint64(255)).astype(np.int64)]
                node = (level.nodes & np.uint64(255)).astype(np.int64)
                base_n, base_t = self.n1[node], self.t1[node]
            rest_n = base_n - np.bincount(level.place, lower, minlength=len(level.nodes))
            rest_t = base_t - level.t
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            at, there = _look(level.keys, keys & mask)
            count = np.where(there, level.counts[at] if len(level.keys) else 0.0, 0.0)
            at, found = _look(level.nodes, (keys & mask) >> np.uint64(8))
            pick = (lambda a: a[at]) if len(level.nodes) else (lambda a: np.zeros(len(keys)))
            settle(count, found, pick(level.n), pick(level.t), pick(rest_n), pick(rest_t))
        context = ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        excluded = ((self.c1 > 0) * self.c0).sum(axis=1)
        settle(self.c1[context, symbol], self.n1[context] > 0, self.n1[context], self.t1[context], self.n0 - excluded[context], self.t0 - self.t1[context])
        everywhere = np.full(len(keys), self.n0 > 0)
        settle(self.c0[symbol], everywhere, np.full(len(keys), self.n0), np.full(len(keys), self.t0), np.zeros(len(keys)), np.zeros(len(keys)))
        out[open_] -= math.log10(max(1.0, 256 - self.t0))
        return out


def gram_values(docs: DataFrame) -> DataFrame:
    """(gram, value): log10 probability of the last byte of each gram that occurs in any
    of the (text, held) rows, learned from those that are not held out."""
    counts = cut_lineage(docs.mapInArrow(_count_grams, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")))
    low = counts.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("c").alias("c")).collect()
    table = np.zeros(1 << 16, np.int64)
    for row in low:
        table[row["pair"]] = row["c"]
    trie = ContextTrie(table)

    def values(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        told = trie.log_probabilities(keys[order], group.column("c").to_numpy()[order])
        return pa.table({"gram": pa.array(keys[order].view(np.int64)), "value": pa.array(told)})

    context = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    return cut_lineage(counts.withColumn("context", context).groupBy("context").applyInArrow(values, "gram long, value double"))


def _word_keys(text: str | None) -> np.ndarray:
    return hash_words(split_words(text)) | _WORD


def _used(group: pa.Table) -> pa.Table:
    """Distinct grams and words of a block; for words, also their training count."""
    held = group.column("held").to_pylist()
    texts = group.column("text")
    values, counts = [], []
    for text, flag in zip(texts, held):
        words = _word_keys(text.as_py())
        values.append(words)
        counts.append(np.full(len(words), 0 if flag else 1, np.int64))
        if len(values) >= 2000:
            packed = _counted(values, counts)
            values, counts = [packed[0]], [packed[1]]
    words, number = _counted(values, counts)
    found, _ = _used_grams(_bytes_of(texts), held)
    keys = np.concatenate([words, found]).view(np.int64)
    block = group.column("block")[0]
    return pa.table(
        {"block": pa.repeat(block, len(keys)), "key": pa.array(keys), "n": pa.array(np.concatenate([number, np.zeros(len(found), np.int64)]))}
    )


def _scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
    keys, value = answers.column("key").to_numpy().view(np.uint64), answers.column("value").to_numpy()
    order = np.argsort(keys)
    keys, value = keys[order], value[order]
    split = int(np.searchsorted(keys, _WORD))
    log_words, is_word = np.log10(value[split:] + SMOOTHING), keys[split:]
    texts = docs.column("text")
    tokens, known, base = [], [], []
    for text in texts:
        at = np.searchsorted(is_word, _word_keys(text.as_py())) + split
        tokens.append(len(at) + 1)
        known.append(int((value[at] > 0).sum()))
        base.append(float(log_words[at - split].sum()))
    score = np.zeros(docs.num_rows)
    for group in _pieces(_bytes_of(texts)):
        parts = [p for _, p in group]
        told = value[np.searchsorted(keys[:split], grams(parts))]
        starts = np.cumsum([0, *(len(p) - ORDER for p in parts)])[:-1]
        np.add.at(score, [k for k, _ in group], np.add.reduceat(told, starts))
    first = (answers.column("first").to_numpy()[order][split:] & (value[split:] > 0)).sum()
    return pa.table(
        {
            "doc_id": pa.concat_arrays([docs.column("id").combine_chunks(), pa.nulls(1, pa.int64())]),
            "held_out": pa.array([*docs.column("held").to_pylist(), None], pa.bool_()),
            "n_tokens": pa.array([*tokens, 0], pa.int64()),
            "n_known": pa.array([*known, 0], pa.int64()),
            "base": pa.array([*base, 0.0], pa.float64()),
            "score": pa.array([*score, 0.0], pa.float64()),
            "vocabulary": pa.array([0] * docs.num_rows + [int(first)], pa.int64()),
        }
    )


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, vocabulary long"


def score_texts(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    `held_out` is a boolean column expression: such rows are scored but not learned from
    (null counts as false). `score` is the model's log10 probability of the whole text;
    `base_score` that of a smoothed word model with an end token per text. Null text is
    empty: one end token. Ids may be null or repeat; repeated rows are learned from as
    often as they occur. Only the two named columns are read besides `held_out`. An empty
    table gives no rows. Words are compared by 63-bit hashes.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(math.ceil(size / block_bytes), 2 * spark.sparkContext.defaultParallelism)
    values = gram_values(docs.select("text", "held"))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    used = dealt.groupBy("block").applyInArrow(_used, "block int, key long, n long")
    same = Window.partitionBy("key")
    counted = used.withColumn("c", F.sum("n").over(same)).withColumn("first", F.min("block").over(same) == F.col("block"))
    priced = counted.join(values, counted.key == values.gram, "left").select(
        "block", "key", F.coalesce("value", F.col("c").cast("double")).alias("value"), "first"
    )
    scored = cut_lineage(dealt.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(_scores, _SCORED))
    learned = ~F.col("held_out")
    train, total, vocabulary = scored.agg(
        F.count_if(learned), F.coalesce(F.sum(F.when(learned, F.col("n_tokens"))), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))
    ).first()
    vocabulary += 1 if train else 0  # the end token
    scale = math.log10(total + SMOOTHING * (vocabulary + 1))
    return scored.filter("held_out is not null").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if train else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(train + SMOOTHING) - F.col("n_tokens") * scale).alias("base_score"),
        "score",
    )
