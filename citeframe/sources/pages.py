"""Page-preserved document text: checks, document text and fingerprints.

Pages: doc_id, page_ord, file_name, page_number, text.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_page, is_blank, strip
from ..operators.checks import error_list, rejected
from ..session import cut_lineage

# Pages per document, characters per extraction input.
MAX_PAGES = 500
MAX_INPUT_CHARS = 600_000
# Partitions of the page sidecar: the most that a write has to broadcast and rewrite.
PAGE_BUCKETS = 64


def clean_pages(pages: DataFrame) -> DataFrame:
    """Cleaned text, blank pages dropped; the other pages keep their numbers."""
    return pages.withColumn("text", clean_page(F.col("text"))).filter(F.col("text") != "")


def check_documents(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per document with `errors`. Only keys and a blank flag are shuffled,
    pre-aggregated by (document, file, page)."""
    per_page = (
        pages.select(
            "doc_id", "file_name", "page_number",
            (F.col("page_number").isNull() | (F.col("page_number") < 1)).alias("bad_number"),
            F.col("text").isNull().alias("no_text"),
            (~is_blank(F.col("text"))).alias("readable"),
        )
        .groupBy("doc_id", "file_name", "page_number")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("bad_number").alias("bad_number"),
            F.max("no_text").alias("no_text"),
            F.max("readable").alias("readable"),
        )
    )
    per_document = per_page.groupBy("doc_id").agg(
        F.sum("n").alias("page_count"),
        F.max(F.col("n") > 1).alias("repeated"),
        F.max("bad_number").alias("bad_number"),
        F.max("no_text").alias("no_text"),
        F.max("readable").alias("readable"),
    )
    checks = {
        "page_number: not a positive integer": ~F.col("bad_number"),
        "text: missing": ~F.col("no_text"),
        "page: appears more than once": ~F.col("repeated"),
        f"document: more than {max_pages} pages": F.col("page_count") <= max_pages,
        "document: no readable text": F.col("readable"),
    }
    return per_document.withColumn("errors", error_list(checks)).select("doc_id", "page_count", "errors")


def read_pages(pages: DataFrame, max_pages: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """(usable pages of accepted documents, rejected documents with errors)."""
    checked = check_documents(pages, max_pages)
    refused = rejected(checked)
    usable = clean_pages(pages.join(refused.select("doc_id"), "doc_id", "left_anti"))
    return usable, refused


def _block(df: DataFrame) -> DataFrame:
    marker = F.format_string("--- %s | Page %d ---\n", F.coalesce("file_name", F.lit("document")), F.col("page_number"))
    return df.withColumn("block", F.concat(marker, strip(F.col("text"))))


def document_sizes(pages: DataFrame) -> DataFrame:
    """Characters of each document text (blocks joined by an empty line)."""
    return (
        _block(pages)
        .groupBy("doc_id")
        .agg((F.sum(F.length("block")) + (F.count(F.lit(1)) - 1) * 2).alias("n_chars"))
    )


def document_texts(pages: DataFrame, max_chars: int = MAX_INPUT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(document text and fingerprint, documents over the limit). Sizes are summed
    first, so no document longer than the limit is ever put together in one task."""
    sizes = document_sizes(pages)
    fits, too_long = sizes.filter(F.col("n_chars") <= max_chars), sizes.filter(F.col("n_chars") > max_chars)
    texts = (
        _block(pages.join(fits.select("doc_id"), "doc_id", "left_semi"))
        .groupBy("doc_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "block"))), lambda p: p["block"]), "\n\n"
            ).alias("document_text")
        )
    )
    return texts.withColumn("input_sha256", F.sha2("document_text", 256)), too_long


def with_pages(deals: DataFrame, pages: DataFrame) -> DataFrame:
    """Deals whose page text is kept."""
    return deals.join(pages.select("deal_id").distinct(), "deal_id", "left_semi")


def without_pages(deals: DataFrame, pages: DataFrame) -> DataFrame:
    return deals.join(pages.select("deal_id").distinct(), "deal_id", "left_anti")


def stored_pages(spark: SparkSession, path: str) -> DataFrame | None:
    """All pages of the sidecar, or null if none was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_pages(pages: DataFrame, path: str, buckets: int = PAGE_BUCKETS) -> None:
    """Keeps the pages of these deals, in place of those kept for them before; other deals
    stay as they are.

    The sidecar is partitioned by a bucket of the deal. Only buckets that a deal of this
    write falls into are read and written again (dynamic partition overwrite, which moves
    them in when all are complete). Range partitioning on (bucket, deal, page) spreads a
    long document over several files, and a reader of few deals skips most row groups."""
    spark = pages.sparkSession
    bucket = F.pmod(F.xxhash64("deal_id"), F.lit(buckets)).cast("int")
    rows = pages.withColumn("bucket", bucket)
    stored = stored_pages(spark, path)
    if stored is not None:
        touched = rows.select("bucket").distinct()
        kept = stored.join(F.broadcast(touched), "bucket", "left_semi").join(pages.select("deal_id").distinct(), "deal_id", "left_anti")
        rows = rows.unionByName(cut_lineage(kept.select(*rows.columns)))
    dealt = rows.repartitionByRange("bucket", "deal_id", "page_ord").sortWithinPartitions("bucket", "deal_id", "page_ord")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
