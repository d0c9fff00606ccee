"""Text-ingest requests read from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.checks import error_list
from ..operators.chunks import SOURCE_TYPES

# Limits of one request.
MAX_NAME_CHARS = 255
MAX_PAGES = 1_000
MAX_PAGE_CHARS = 25_000
MAX_TEXT_CHARS = 25_000_000

REQUEST_SCHEMA = (
    "request_id string, organization_id string, document_name string, source_type string, deal_id string, "
    "is_verified_knowledge boolean, pages array<struct<page_number:int,text:string>>"
)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that does not parse keeps its text in `_corrupt`."""
    return (
        spark.read.schema(REQUEST_SCHEMA + ", _corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def check_requests(requests: DataFrame) -> DataFrame:
    """Adds stripped name and pages, defaults, and `errors`."""
    pages = F.transform(
        "pages", lambda p: F.struct(p["page_number"].alias("page_number"), strip(p["text"]).alias("text"))
    )
    df = (
        requests.withColumn("document_name", strip(F.col("document_name")))
        .withColumn("source_type", F.coalesce("source_type", F.lit("other")))
        .withColumn("is_verified_knowledge", F.coalesce("is_verified_knowledge", F.lit(False)))
        .withColumn("pages", pages)
    )
    total = F.aggregate("pages", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.length(p["text"]), F.lit(0)))
    checks = {
        "document_name: not 1 to 255 characters": F.length("document_name").between(1, MAX_NAME_CHARS),
        "document_name: a path": ~F.col("document_name").rlike(r"[/\\]"),
        "pages: not 1 to 1,000": F.size("pages").between(1, MAX_PAGES),
        "pages: page number not positive": F.forall("pages", lambda p: F.coalesce(p["page_number"] > 0, F.lit(False))),
        "pages: text not 1 to 25,000 characters": F.forall(
            "pages", lambda p: F.coalesce(F.length(p["text"]).between(1, MAX_PAGE_CHARS), F.lit(False))
        ),
        "pages: over 25,000,000 characters": total <= MAX_TEXT_CHARS,
        "source_type: unknown": F.col("source_type").isin(SOURCE_TYPES),
    }
    return df.withColumn("errors", error_list(checks))


def request_pages(accepted: DataFrame) -> DataFrame:
    """Pages of accepted requests (page_ord keeps their order)."""
    return accepted.select("request_id", F.posexplode_outer("pages").alias("page_ord", "_p")).select(
        "request_id", "page_ord", "_p.page_number", "_p.text"
    )
