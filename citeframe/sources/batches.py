"""Several tables written as one batch: all of it is visible, or none.

Every attempt to write a batch has folders of its own; nothing committed is overwritten.
A batch counts once the commit table, which is written last, names an attempt of it, and of
several attempts the one committed last. What a failed writer leaves, nobody reads: neither
of a new batch nor of a retry of a committed one.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["batch_id", "attempt"]


def _folder(root: str, name: str, batch_id: str, attempt: str) -> str:
    """Folder of one attempt at a batch of a table; the id is made safe for a file name."""
    return f"{root}/{name}/batch={quote(batch_id, safe='')}/attempt={attempt}"


def new_attempt() -> str:
    return uuid.uuid4().hex


def write_table(df: DataFrame, root: str, name: str, batch_id: str, attempt: str) -> None:
    """One table of an attempt; not visible before `commit`."""
    marked = df.withColumn("batch_id", F.lit(batch_id)).withColumn("attempt", F.lit(attempt))
    marked.write.mode("errorifexists").parquet(_folder(root, name, batch_id, attempt))


def commit(spark: SparkSession, root: str, batch_id: str, attempt: str) -> None:
    row = spark.range(1).select(
        F.lit(batch_id).alias("batch_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at")
    )
    row.write.mode("errorifexists").parquet(_folder(root, "commits", batch_id, attempt))


def write_batch(tables: dict[str, DataFrame], root: str, batch_id: str) -> None:
    """Writes every table with string columns `batch_id` and `attempt`, then the commit row."""
    attempt = new_attempt()
    for name, df in tables.items():
        write_table(df, root, name, batch_id, attempt)
    commit(next(iter(tables.values())).sparkSession, root, batch_id, attempt)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """batch_id, attempt, committed_at of the attempt that counts for each batch. Ids are
    read from the files, as text: folder names would be guessed as numbers or dates,
    differently for each table."""
    commits = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/commits")
    latest = commits.groupBy("batch_id").agg(F.max(F.struct("committed_at", "attempt")).alias("_last"))
    return latest.select("batch_id", "_last.attempt", "_last.committed_at")


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of committed batches, with `batch_id`."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{name}")
    return rows.join(committed(spark, root).select(*KEY), KEY, "left_semi").drop("attempt")


def merge_documents(
    documents: DataFrame, chunks: DataFrame, root: str, batch_id: str
) -> tuple[DataFrame, DataFrame]:
    """Stores documents and chunks as one batch and returns all stored ones: of a document
    written again the latest batch counts, and chunks of other batches of it are dropped,
    as are chunks without a document."""
    write_batch({"documents": documents, "chunks": without_orphans(chunks, documents)}, root, batch_id)
    spark = documents.sparkSession
    stored, parts = read_committed(spark, root, "documents"), read_committed(spark, root, "chunks")
    latest = stored.join(committed(spark, root), "batch_id").groupBy("document_id").agg(F.max_by("batch_id", "committed_at").alias("batch_id"))
    key = ["document_id", "batch_id"]
    return stored.join(latest, key, "left_semi"), parts.join(latest, key, "left_semi")


def without_orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document exists."""
    return chunks.join(documents.select("document_id"), "document_id", "left_semi")


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")
