"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

RATIO = 0.1
MIN_PAGES = 3
_BLANKS = " \t\r"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without port, for tables that carry URLs."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """Identity of a line without outer blanks; null for a blank line."""
    body = F.btrim(line, F.lit(_BLANKS))
    return F.when(body != "", F.xxhash64(body))


def boilerplate(df: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): the lines that occur on more than `ratio` of a host's pages.

    Pages with identical text count once per host, in both counts, so a page that is
    mirrored a thousand times does not turn its own content into boilerplate. A host's
    list holds at most (its mean number of distinct lines per page) / ratio keys,
    because each listed line takes up a `ratio` of all pages.
    """
    pages = cut_lineage(
        df.select(
            host.alias("host"),
            F.struct(F.xxhash64(text), F.hash(text)).alias("page"),
            F.array_compact(F.array_distinct(F.transform(_lines(text), _key))).alias("keys"),
        )
        .groupBy("host", "page")
        .agg(F.first("keys").alias("keys"))
    )
    totals = cut_lineage(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    seen = (
        pages.select("host", F.explode("keys").alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    frequent = seen.join(totals.withColumnRenamed("host", "site"), F.col("host").eqNullSafe(F.col("site"))).filter(
        F.col("n") > F.lit(ratio) * F.col("pages")
    )
    return cut_lineage(frequent.groupBy("host").agg(F.collect_set("key").alias("keys")))


def drop_boilerplate(
    df: DataFrame,
    host: Column | str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """All rows as (doc, host, n_lines, n_dropped, text): `doc` is the input row as a
    struct, `text` its text without the host's boilerplate lines.

    Lines are separated by LF and compared without outer blanks; blank lines always
    stay. Null text is null again with n_lines 1; empty text has one, blank, line. Rows
    with a null host form a site of their own. Repeated rows are all returned. Extra
    columns only travel inside `doc`, so their names cannot clash. An empty table gives
    no rows.
    """
    host = F.col(host) if isinstance(host, str) else host
    text = F.col(text_col)
    sites = boilerplate(df, host, text, ratio, min_pages).withColumnRenamed("host", "site")
    rows = df.select(F.struct("*").alias("doc"), host.alias("host"), text.alias("text"))
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("site")), "left")
    hits = F.array_intersect(F.array_compact(F.transform(_lines(F.col("text")), _key)), F.col("keys"))
    marked = joined.select("doc", "host", "text", F.coalesce(hits, F.array().cast("array<long>")).alias("hits"))
    kept = F.filter(_lines(F.col("text")), lambda x: ~F.coalesce(F.array_contains(F.col("hits"), _key(x)), F.lit(False)))
    changed = F.size("hits") > 0
    cleaned = marked.select(
        "doc",
        "host",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.when(changed, kept).alias("kept"),
        "text",
    )
    return cleaned.select(
        "doc",
        "host",
        "n_lines",
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )
