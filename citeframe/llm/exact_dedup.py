"""Exact deduplication by tree-merging sorted digest runs.

Each scan partition turns its rows into one sorted run of (digest, smallest id,
count). Runs live in `RADIX ** ROUNDS` lanes. In every round, `RADIX` lanes whose
numbers differ in one digit exchange digest ranges and multiway-merge what they get,
so after the last round lane i holds exactly the digests of range i. No lane ever
holds all digests, and every run carries a digest at most once: a group of copies,
however large, is one row per run before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

RADIX = 4
ROUNDS = 3
_RUN = "lane int, sha binary, verify long, keep_id long, n long"


def normalized(text: Column) -> Column:
    """Null is empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up neighbouring rows of one digest; the input is sorted, so the first of
    them has the smallest id. Only the last, still open group outlives a batch."""
    schema = pa.schema([("lane", pa.int32()), ("sha", pa.binary()), ("verify", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64())])
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch]).cast(schema)
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        size = rows.num_rows
        new = np.zeros(size, dtype=bool)
        new[0] = True
        for name in ("lane", "sha", "verify"):
            column = rows.column(name)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, size - 1)).to_numpy().astype(bool)
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(rows.column("n").to_numpy(), starts)
        groups = rows.take(pa.array(starts)).set_column(4, "n", pa.array(sums, pa.int64()))
        held = groups.slice(groups.num_rows - 1)
        yield from groups.slice(0, groups.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _merge(runs: DataFrame) -> DataFrame:
    order = [F.asc("lane"), F.asc("sha"), F.asc("verify"), F.asc_nulls_last("keep_id")]
    return runs.sortWithinPartitions(*order).mapInArrow(_merged, _RUN)


def merge_runs(digests: DataFrame, radix: int = RADIX, rounds: int = ROUNDS) -> DataFrame:
    """(sha, verify, id) rows to one (sha, verify, keep_id, n) row per distinct text."""
    ship_package(digests.sparkSession)
    lanes = radix**rounds
    runs = _merge(
        digests.select(
            F.pmod(F.spark_partition_id(), F.lit(lanes)).cast("int").alias("lane"),
            "sha",
            "verify",
            F.col("id").alias("keep_id"),
            F.lit(1).cast("long").alias("n"),
        )
    )
    home = F.pmod(F.conv(F.substring(F.hex("sha"), 1, 8), 16, 10).cast("long"), F.lit(lanes))
    for level in range(rounds):
        low = radix**level
        digit = lambda c: F.pmod(F.floor(c / low), F.lit(radix))
        lane = (F.col("lane") + (digit(home) - digit(F.col("lane"))) * low).cast("int")
        runs = _merge(runs.withColumn("lane", lane).repartition(lanes, "lane"))
    return runs.select("sha", "verify", "keep_id", "n")


def dedupe_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when SHA-256 and a second, independent hash of the normalised
    text both agree. Null text is empty text; all such rows form one group. Repeated
    rows (same id and text) are all reported, all with kept = true when theirs is the
    smallest id. Null ids sort last: a group with only null ids keeps them (keep_id
    null). Only the two named columns are read, so extra columns never clash. An empty
    table gives no rows.
    """
    text = normalized(F.col(text_col))
    digests = cut_lineage(
        df.select(
            F.col(id_col).cast("long").alias("id"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
            F.xxhash64(text).alias("verify"),
        )
    )
    groups = cut_lineage(merge_runs(digests))
    return digests.join(groups, ["sha", "verify"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
