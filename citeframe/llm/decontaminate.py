"""Benchmark decontamination: MinHash containment search, confirmed on shingles.

Test items are short and documents are long, so plain set similarity says nothing. The
search is one-sided instead: of every item, each MinHash function keeps the shingle
with its smallest value, and a document is a candidate when it holds enough of these
shingles. Items are partitioned by size (powers of two); a partition has its own number of
functions and its own table of probes. The kept shingles are a random subset of the item's,
so the number that a candidate needs follows from the hypergeometric distribution: an item
at the threshold shows fewer with a probability below `MISS`, and never where so few of its
shingles may be missing that some kept ones must be there. Candidates are confirmed on all
shingles of the item, as words, not as hashes.

Items are the query set. They are cut into blocks of a bounded number of words; each
block goes to the tasks with a scan of its own, whose result is written before the next
block is fetched, so the driver holds one block; the documents are never shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder, ship_package
from .near_dedup import argmin_shingles
from .words import hash_words, shingle_stream, small_batches, split_words

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-9
SAMPLES = 64
BLOCK_WORDS = 500_000
_BITS = 22


def functions_of(partition: int, samples: int = SAMPLES) -> int:
    """MinHash functions of the size partition 2 ** (partition - 1) < shingles <= 2 ** partition."""
    return min(samples, max(1, 4 * 2 ** (partition // 2)))


@lru_cache(maxsize=100_000)
def needed_hits(shingles: int, kept: int, containment: float, miss: float = MISS) -> int:
    """Largest h such that of `kept` random ones of an item's shingles, fewer than h are in
    a document at the threshold with a probability below `miss`; at least one."""
    there = min(shingles, math.ceil(round(containment * shingles, 9)))
    ways = math.comb(shingles, kept)
    below = 0
    for h in range(max(0, kept - (shingles - there)), kept + 1):
        below += math.comb(there, h) * math.comb(shingles - there, kept - h)
        if below >= miss * ways:
            return max(1, h)
    return kept


def _words_of(text: str, width: int) -> tuple[list[bytes], set[tuple[bytes, ...]]]:
    words = split_words(text)
    return words, {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


class Partition:
    """Items of one size class and shingle width: their probes, and what each item needs."""

    def __init__(self, functions: int):
        self.functions = functions
        self.items: list[tuple[int, str, int]] = []
        self.probes: dict[int, list[int]] = defaultdict(list)

    def add(self, item_id: int, text: str, shingles: np.ndarray, containment: float) -> None:
        kept = np.unique(argmin_shingles(shingles, self.functions))
        for value in kept.tolist():
            self.probes[value].append(len(self.items))
        self.items.append((item_id, text, needed_hits(len(shingles), len(kept), containment)))

    def candidates(self, hits: set[int]) -> Iterator[tuple[int, str]]:
        tally: dict[int, int] = defaultdict(int)
        for value in hits & self.probes.keys():
            for number in self.probes[value]:
                tally[number] += 1
        yield from (self.items[number][:2] for number, n in tally.items() if n >= self.items[number][2])


class ItemBlock:
    """Sketches of one block of items, as a task uses them: a partition for each shingle
    width (items shorter than a shingle have their own) and size class."""

    def __init__(self, items: list[tuple[int, str]], size: int, containment: float, samples: int = SAMPLES, short_items: bool = True):
        self.containment = containment
        self.partitions: dict[tuple[int, int], Partition] = {}
        for item_id, text in items:
            hashes = hash_words(split_words(text))
            if len(hashes) < (1 if short_items else size):
                continue
            shingles = np.unique(shingle_stream(hashes, size))
            key = min(size, len(hashes)), math.ceil(math.log2(len(shingles)))
            if key not in self.partitions:
                self.partitions[key] = Partition(functions_of(key[1], samples))
            self.partitions[key].add(item_id, text, shingles, containment)
        # One look per shingle of a document tells whether any partition may know it.
        self.filters: dict[int, np.ndarray] = {}
        for (width, _), partition in self.partitions.items():
            flags = self.filters.setdefault(width, np.zeros(1 << _BITS, bool))
            flags[np.fromiter(partition.probes, np.uint64, len(partition.probes)) >> np.uint64(64 - _BITS)] = True

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, str]]:
        for width, flags in self.filters.items():
            if len(hashes) < width:
                continue
            stream = shingle_stream(hashes, width)
            hits = set(stream[flags[stream >> np.uint64(64 - _BITS)]].tolist())
            for (own, _), partition in self.partitions.items():
                if hits and own == width:
                    yield from ((width, *item) for item in partition.candidates(hits))

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(item_id, item's shingles, shared shingles) of each item the text contains."""
        hashes = hash_words(split_words(text))
        own: dict[int, set] = {}
        for width, item_id, item_text in self.candidates(hashes):
            if width not in own:
                own[width] = _words_of(text, width)[1]
            wanted = _words_of(item_text, width)[1]
            shared = len(wanted & own[width])
            if shared >= self.containment * len(wanted) - 1e-9:
                yield item_id, len(wanted), shared


def _search(block, size: int, containment: float, samples: int, short_items: bool):
    items = block

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ItemBlock(items, size, containment, samples, short_items)
        for batch in small_batches(batches, "text"):
            found = [(doc.as_py(), *m) for doc, text in zip(batch.column("id"), batch.column("text")) for m in search.matches(text.as_py())]
            if found:
                columns = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "item_shingles", "shared"])

    return work


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_words` words; none is kept here."""
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(words / block_words))
    place = F.pmod(F.xxhash64("text", "id"), F.lit(blocks))
    for number in range(blocks):
        yield [(r["id"], r["text"]) for r in items.filter(place == number).toLocalIterator()]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    containment: float = CONTAINMENT,
    samples: int = SAMPLES,
    block_words: int = BLOCK_WORDS,
    short_items: bool = True,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for each document that holds
    at least `containment` of an item's distinct shingles.

    An item shorter than a shingle counts as one shingle of its own length, or matches
    nothing without `short_items`: op5 reports such items, the pipeline leaves them out, as
    a word or two in a document are no reason to drop it. Items and documents without words
    match nothing. Null ids are returned as null; repeated rows
    on either side give one row each. Only the named columns are read. Without items or
    documents there are no rows.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    queries = cut_lineage(
        items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).filter(F.trim("text") != "")
    )
    schema = "doc_id long, item_id long, item_shingles long, shared long"
    root = f"{shared_folder(docs.sparkSession)}/leaks-{uuid.uuid4().hex}"
    number = 0
    for block in item_blocks(queries, block_words):
        search = _search(block, shingle_words, containment, samples, short_items)
        texts.mapInArrow(search, schema).write.parquet(f"{root}/block={number}")
        number += 1
        del block, search  # not held while the next one is fetched
    found = docs.sparkSession.read.schema(schema).parquet(root).select("doc_id", "item_id", "item_shingles", "shared")
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))
