"""Near-duplicate linking: MinHash bands, odd sketches, exact confirmation.

1. Texts with the same word sequence form a class; its smallest id stands for it.
2. Each class gets MinHash samples over its word shingles. Bands of samples make bucket
   keys; the number of bands is set so that a pair at the threshold shares no bucket
   with a probability below `MISS`.
3. All samples are folded into an odd sketch, a bitmap that keeps the parity of how many
   samples fell on each bit. Two sketches differ in at most two bits per differing sample,
   so a pair whose XOR has more bits than that bound allows cannot be a link.
4. Candidates that pass are confirmed on their full shingle sets.

A bucket is never paired with itself wholesale. Each turn compares its members with two
chosen members, and turns go on with other choices while very large buckets still hold
several components. Pairs that are left between different components are then all
compared, by a second, more precise odd sketch that only documents with a shared bucket
get, each pair in one of its buckets; only pairs close to the threshold come out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .components import connected_components
from .words import hash_words, lists_of, mix, shingle_stream, small_batches, split_words

BAND_ROWS = 5
MISS = 1e-6
SKETCH_BITS = 512
PRECISE_SAMPLES = 2048
PRECISE_BITS = 8192
_PIECE = 2048
_FUNCTIONS = 128
_MOST_TURNS = 6
# Pairs a bucket row may be compared with before further turns are worth their joins.
_PAIRS_A_ROW = 1000


def band_count(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def most_differing(samples: int, threshold: float, tail: float = 1e-9) -> int:
    """Smallest d such that a pair at the threshold differs in more than d samples with
    a probability below `tail`."""
    left = 1.0
    for d in range(samples + 1):
        ways = math.lgamma(samples + 1) - math.lgamma(d + 1) - math.lgamma(samples - d + 1)
        left -= math.exp(ways + d * math.log(1 - threshold) + (samples - d) * math.log(threshold))
        if left < tail:
            return d
    return samples


def most_bits(differing: int, bits: int) -> int:
    """Bits in which two sketches may differ: 2 for every differing sample, or, where many
    of them fall together, what is expected plus six standard deviations."""
    share = (1 - (1 - 2 / bits) ** (2 * differing)) / 2
    return min(2 * differing, math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share))))


def _factors(samples: int) -> np.ndarray:
    """One odd factor per MinHash function; the shingle hashes are mixed already."""
    return mix(np.arange(1, samples + 1, dtype=np.uint64)) | np.uint64(1)


def argmin_shingles(shingles: np.ndarray, samples: int) -> np.ndarray:
    """For each MinHash function, the shingle with its smallest value."""
    return np.array([shingles[np.argmin(shingles * factor)] for factor in _factors(samples)], np.uint64)


def minhash(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """One row of `samples` minima per (non-empty) set. Works on pieces of bounded size
    that may span several sets, or be a part of a long one."""
    factors = _factors(samples)[:, None]
    values, ends = np.concatenate(sets), np.cumsum([len(s) for s in sets])
    starts = ends - [len(s) for s in sets]
    out = np.full((len(sets), samples), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(values), _PIECE):
        high = min(low + _PIECE, len(values))
        first = int(np.searchsorted(starts, low, "right")) - 1
        inside = starts[first + 1 : np.searchsorted(starts, high, "left")]
        cuts = np.concatenate([[0], inside - low])
        rows = slice(first, first + len(cuts))
        for k in range(0, samples, _FUNCTIONS):
            some = slice(k, k + _FUNCTIONS)
            minima = np.minimum.reduceat(factors[some] * values[None, low:high], cuts, axis=1)
            out[rows, some] = np.minimum(out[rows, some], minima.T)
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(samples), bands)).copy()
    for k in range(rows):
        keys = mix(keys ^ samples[:, k : bands * rows : rows])
    return keys


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of all samples, as bits / 64 words per row."""
    count, width = samples.shape
    place = mix(samples ^ mix(np.arange(7, 7 + width, dtype=np.uint64))) % np.uint64(bits)
    flat = place.astype(np.int64) + np.arange(count)[:, None] * bits
    parity = (np.bincount(flat.ravel(), minlength=count * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(count, bits), axis=1).view(np.uint64)


def _signatures(size: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            digests, sets = [], []
            for text in batch.column("text"):
                words = split_words(text.as_py())
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                sets.append(np.unique(shingle_stream(hash_words(words), size)))
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, sketches = [np.empty(0, np.uint64)] * len(sets), [np.empty(0, np.uint64)] * len(sets)
            if full:
                samples = minhash([sets[k] for k in full], bands * rows)
                for k, key, sketch in zip(full, band_keys(samples, bands, rows), odd_sketch(samples)):
                    keys[k], sketches[k] = key, sketch
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists_of(keys), lists_of(sketches)],
                names=["id", "digest", "n", "keys", "sketch"],
            )

    return work


def _shingles(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [np.unique(shingle_stream(hash_words(split_words(t.as_py())), size)) for t in batch.column("text")]
            sketches = [odd_sketch(minhash(sets[k : k + 256], PRECISE_SAMPLES), PRECISE_BITS) for k in range(0, len(sets), 256)]
            precise = lists_of(list(np.concatenate(sketches)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists_of(sets), precise], names=["node", "shingles", "precise"])

    return work


def _likely(a: str, b: str, percent: int, most: int) -> Column:
    """The set sizes allow a link, and the sketches differ in few enough bits."""
    size_a, size_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    words = [F.bit_count(F.get(F.col(f"{a}.sketch"), F.lit(k)).bitwiseXOR(F.get(F.col(f"{b}.sketch"), F.lit(k)))) for k in range(SKETCH_BITS // 64)]
    sizes = F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent
    return sizes & (reduce(lambda x, y: x + y, words) <= most)


def _first_shared(a: str, b: str, bands: int) -> Column:
    """The key of the first band in which two documents agree."""
    keys = [(F.get(F.col(f"{a}.keys"), F.lit(k)), F.get(F.col(f"{b}.keys"), F.lit(k))) for k in range(bands)]
    return F.coalesce(*[F.when(x == y, x) for x, y in keys])


def _precisely(a: str, b: str, most: int) -> Column:
    bits = F.zip_with(f"{a}.precise", f"{b}.precise", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x) <= most


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(left, "a").join(right, "b")
    sized = joined.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return sized.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b").distinct()


def _in_order(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b")]


def _with_components(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("node"))
    named = labels.select(F.col("node").alias("other"), F.col("component").alias("found"))
    joined = members.join(named, members.node == named.other, "left")
    return joined.withColumn("component", F.coalesce("found", "node")).drop("other", "found")


def _links(members: DataFrame, sets: DataFrame, keys_of: DataFrame, percent: int, bands: int, band_rows: int) -> DataFrame | None:
    """(node, component) of all nodes with a link; None when there is no pair at all."""
    most = most_bits(most_differing(bands * band_rows, percent / 100), SKETCH_BITS)
    most_precise = most_bits(most_differing(PRECISE_SAMPLES, percent / 100), PRECISE_BITS)
    edges: DataFrame | None = None
    tested: DataFrame | None = None
    labels: DataFrame | None = None

    def take(pairs: DataFrame) -> bool:
        nonlocal edges, tested, labels
        pairs = pairs.distinct()
        pairs = cut_lineage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return False
        tested = pairs if tested is None else tested.union(pairs)
        found = cut_lineage(_confirm(pairs, sets, percent))
        edges = found if edges is None else edges.union(found)
        labels = connected_components(edges)
        return True

    for turn in range(_MOST_TURNS + 1):
        pool = cut_lineage(_with_components(members, labels))
        parts = pool.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        keys = parts.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s")).filter("m * m > s")
        left, width = keys.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2), F.sum("m")).first()
        if not left:
            break
        if turn and (left <= _PAIRS_A_ROW * width or turn == _MOST_TURNS):
            # Turns have done, or have stopped paying: all pairs that are left.
            mixed = keys.select(F.col("key").alias("bucket"))
            detail = sets.select(F.col("node").alias("of"), "precise").join(keys_of.select(F.col("node").alias("of"), "keys"), "of")
            open_ = pool.join(mixed, pool.key == F.col("bucket"), "left_semi")
            open_ = cut_lineage(open_.join(detail, open_.node == F.col("of")).drop("of"))
            me, you = open_.alias("me"), open_.alias("you")
            rest = me.join(
                you,
                (F.col("me.key") == F.col("you.key"))
                & (F.col("me.component") < F.col("you.component"))
                & _likely("me", "you", percent, most)
                & (_first_shared("me", "you", bands) == F.col("me.key"))
                & _precisely("me", "you", most_precise),
            )
            take(rest.select(*_in_order("me", "you")))
            break
        me = F.struct("node", "n", "sketch", "component")
        chosen = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), me.alias("v")))
        first = F.min(F.struct(F.col("node").alias("o"), me.alias("v")))
        centers = cut_lineage(
            pool.groupBy("key")
            .agg(first.alias("x"), chosen.alias("y"), F.min("component").alias("low"), F.max("component").alias("high"))
            .filter("low != high")
            .select(F.col("key").alias("bucket"), F.col("x.v").alias("x"), F.col("y.v").alias("y"))
        )
        near = pool.alias("me").join(centers, F.col("me.key") == F.col("bucket"))
        pairs = [
            near.filter((F.col("me.component") != F.col(f"{c}.component")) & _likely("me", c, percent, most)).select(*_in_order("me", c))
            for c in ("x", "y")
        ]
        take(pairs[0].union(pairs[1]))
    return labels


def link_near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * |intersection| >= percent * |union| of their shingle
    sets; `component_id` is the smallest id reachable over links, `kept` says that it is
    the row's own. Null and empty texts have no shingles, are linked with nothing and are
    their own component. A row with a null id gets component_id null and kept true, and
    links nothing. Rows that repeat an id count as one document and are all reported.
    Only the two named columns are read. An empty table gives no rows.
    """
    ship_package(df.sparkSession)
    threshold = percent / 100
    bands = band_count(threshold, band_rows)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut_lineage(
        docs.mapInArrow(_signatures(shingle_words, bands, band_rows), "id long, digest binary, n long, keys array<long>, sketch array<long>")
    )
    linked = rows.filter("n > 0 and id is not null")
    classes = cut_lineage(
        linked.groupBy("digest").agg(
            F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")
        )
    )
    keyed = classes.select(F.explode("keys").alias("key"), "node")
    shared = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("key").alias("bucket")))
    held = keyed.join(shared, keyed.key == shared.bucket).select("key", F.col("node").alias("member")).distinct()
    sketches = classes.select("node", "n", "sketch")
    members = cut_lineage(held.join(sketches, held.member == sketches.node).select("key", "node", "n", "sketch"))
    wanted = cut_lineage(members.select(F.col("node").alias("id")).distinct())
    texts = docs.join(wanted, "id", "left_semi").dropDuplicates(["id", "text"])
    sets = cut_lineage(texts.mapInArrow(_shingles(shingle_words), "node long, shingles array<long>, precise array<long>"))
    labels = _links(members, sets, classes.select("node", "keys"), percent, bands, band_rows)
    named = classes.select("digest", "node")
    if labels is not None:
        named = _with_components(named, labels)
    else:
        named = named.withColumn("component", F.col("node"))
    named = cut_lineage(named.select(F.col("digest").alias("class"), "component"))
    out = rows.join(named, (rows.digest == named["class"]) & (rows.n > 0) & rows.id.isNotNull(), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
