"""Citation verification: does the cited page hold the quote, and the quote the value?

Tables (long form, order columns carried explicitly):

* values     deal_id, field_name, num_value, text_value
* citations  deal_id, field_name, cite_ord, value, source_document, page_number, snippet
* pages      deal_id, page_ord, file_name, page_number, text
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import spec
from ..functions import numbers, quotes
from ..functions.plans import let
from ..functions.text import display_value, holds_words, norm, quoted, spaced_words

FIELD_KEY = ["deal_id", "field_name"]
PAGE_KEY = ["deal_id", "page_number"]


def attach_pages(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Decides which page each citation means and adds it: `page_ord`, `page_file` and
    `page_text`, or why there is none as `page_problem`. One row per citation.

    One page with the cited number: that page. Several files share the number: the
    cited file name must pick exactly one. Pages and citations are shuffled once, on
    (deal, page number): what is known of the pages of a number comes from a window
    with the partitions and the order the join needs anyway.
    """
    number = Window.partitionBy("_deal", "_page").orderBy("_file_key")
    whole = number.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    text = pages.select(
        F.col("deal_id").alias("_deal"),
        F.col("page_number").alias("_page"),
        F.col("page_ord"),
        F.col("file_name").alias("page_file"),
        norm(F.col("file_name")).alias("_file_key"),
        F.col("text").alias("page_text"),
    ).select(
        "*", F.count(F.lit(1)).over(whole).alias("_pages"), F.row_number().over(number).alias("_rank"),
        F.collect_list("_file_key").over(whole).alias("_keys"),
    ).withColumn("_keys", F.when(F.col("_pages") > 1, F.col("_keys")))
    cited = citations.withColumn("cited_key", norm(F.col("source_document")))
    only = text["_pages"] == 1
    # Files of the cited name among several; where it is not one, the first page stands for all.
    one_named = let(cited["cited_key"], lambda key: F.size(F.filter(text["_keys"], lambda file: file == key))) == 1
    named = F.when(~only & one_named, text["_file_key"] == cited["cited_key"])
    stands_in = ~only & ~one_named & (text["_rank"] == 1)
    same_page = (cited["deal_id"] == text["_deal"]) & (cited["page_number"] == text["_page"])
    joined = cited.join(text, same_page & (only | F.coalesce(named, F.lit(False)) | stands_in), "left")
    unnamed = (F.col("_pages") > 1) & (
        let(F.col("cited_key"), lambda key: F.size(F.filter("_keys", lambda file: file == key))) != 1
    )
    absent = F.format_string(
        "The citation points to page %d, which has no text in the document.", F.col("page_number")
    )
    unclear = F.concat(
        F.format_string(
            "Page %d exists in more than one document and the citation's file name ", F.col("page_number")
        ),
        quoted(F.col("source_document")),
        F.lit(" doesn't pick one."),
    )
    return joined.withColumn("_unclear", unnamed).select(
        *citations.columns,
        *[F.when(~F.col("_unclear"), F.col(c)).alias(c) for c in ("page_ord", "page_file", "page_text")],
        F.when(F.col("_pages").isNull(), absent).when(F.col("_unclear"), unclear).alias("page_problem"),
    )


def with_support(df: DataFrame, snippet: str, page: str) -> DataFrame:
    """Finds the quote and reads the figures inside it. Adds `long_enough`,
    `q_found`, `q_texts` and `q_numbers` (figures overlapping the quote, read in
    the context of the whole page); drops the page. All in the row: figures are not
    shuffled, and the page text goes no further."""
    df = quotes.with_quote(df, snippet, page, spec.is_numeric(F.col("field_name")))
    df = df.withColumn("long_enough", quotes.quoted_chars(F.col("_parts")) >= quotes.MIN_SNIPPET_CHARS)
    # Only quotes for numeric fields have a start.
    read = ["_parts", page, "q_page", "q_joined", "q_start", "q_stop"]
    return numbers.with_mentions_in(df, "q_page", "q_start", "q_stop", "q_numbers", drop=read)


def number_in_quote(value: Column) -> Column:
    return F.coalesce(
        F.exists("q_numbers", lambda m: numbers.supports(F.col("field_name"), value, m)), F.lit(False)
    )


def text_in_quote(value_norm: Column) -> Column:
    """`value_norm` must already be in match form."""
    return F.coalesce(F.exists("q_texts", lambda t: holds_words(t, value_norm)), F.lit(False))


def _cited_reading(df: DataFrame, figure: str) -> DataFrame:
    """Adds what the cited value means as a number, as the percentage a fraction stands for
    (`_percent_reading`) and as it is (`_plain_reading`), from its only figure, STRUCT<value, kind>."""
    field, value = F.col("field_name"), F.col(f"{figure}.value")
    fraction = spec.is_percent(field) & (F.col(f"{figure}.kind") == "plain") & (value > 0) & (value <= 1)
    # The bounds of a field are looked up once.
    low, high = spec.bounds(field)
    df = df.withColumns({"_low": low, "_high": high, "_whole": spec.is_integer(field), "_as_percent": F.when(fraction, value * 100)})

    def held(x: Column) -> Column:
        inside = F.coalesce(x >= F.col("_low"), F.lit(True)) & F.coalesce(x <= F.col("_high"), F.lit(True))
        return F.when(inside & (~F.col("_whole") | (x == F.floor(x))), x)

    return df.withColumns({"_percent_reading": held(F.col("_as_percent")), "_plain_reading": held(value)}).drop(
        "_low", "_high", "_whole", "_as_percent"
    )


def _stated_readings(usable: Column, stated) -> Column:
    return F.coalesce(*[F.when(usable & stated(c), F.col(c)) for c in ("_percent_reading", "_plain_reading")])


def _on_one_line(df: DataFrame) -> DataFrame:
    """Citations whose quote and cited value are the plain case (`quotes.with_line_quote`), read
    on columns. Adds `plain`, and for these `long_enough`, `value_ok`, `cited_num` and `cited_text`."""
    field = F.col("field_name")
    numeric, quote_only = spec.is_numeric(field), spec.is_quote_only(field)
    df = quotes.with_line_quote(df, "snippet", "page_text", numeric)
    df = df.withColumns({"_cited_norm": norm(F.col("value")), "_value_words": spaced_words(norm(F.col("text_value")))})
    df = df.withColumns({"_words": spaced_words(F.col("l_text")), "_cited_words": F.when(~numeric, spaced_words(F.col("_cited_norm")))})
    alone = numbers.is_plain_figure(F.col("_cited_norm"))
    df = df.withColumn("plain", F.col("l_found") & F.coalesce(~numeric | alone, F.lit(False)))
    df = df.withColumn("_one", F.when(F.col("plain") & numeric, numbers.plain_figure(F.col("_cited_norm"))))
    df = _cited_reading(df, "_one")
    # As `numbers.supports`, with what does not depend on the claim worked out once.
    value, kind = F.col("l_figure.value"), F.col("l_figure.kind")
    fraction = spec.is_percent(field) & (kind == "plain") & (value > 0) & (value <= 1)
    df = df.withColumns({
        "_read": F.when(spec.accepts_kind(field, kind), value), "_as_percent": F.when(fraction, value * 100),
    })

    def stated(claim: str) -> Column:
        close = numbers.is_close(F.col("_read"), F.col(claim))
        fits = F.col("_read").isNotNull() & numbers.is_close(F.col("_as_percent"), F.col(claim))
        return F.coalesce(close, F.lit(False)) | F.coalesce(fits, F.lit(False))

    def told(claim: str) -> Column:
        return F.coalesce((F.col(claim) != "  ") & F.col("_words").contains(F.col(claim)), F.lit(False))

    df = df.withColumn("long_enough", F.col("l_chars") >= quotes.MIN_SNIPPET_CHARS)
    usable = F.col("long_enough")
    return df.withColumns({
        "value_ok": F.when(numeric, stated("num_value")).otherwise(told("_value_words")),
        "cited_num": _stated_readings(usable, stated),
        "cited_text": F.when(usable & ~numeric & ~quote_only & told("_cited_words"), F.col("value")),
    }).drop(
        "l_found", "l_chars", "l_text", "l_figure", "_value_words", "_cited_norm", "_cited_words", "_words", "_one",
        "_percent_reading", "_plain_reading", "_read", "_as_percent",
    )


def _on_page(df: DataFrame) -> DataFrame:
    """The other citations: the quote is looked for on the whole page. Adds `q_found`, and fills
    what `_on_one_line` adds. Rows that are `plain` only pass, with nothing to look for."""
    field = F.col("field_name")
    numeric, quote_only = spec.is_numeric(field), spec.is_quote_only(field)
    told = ["long_enough", "value_ok", "cited_num", "cited_text"]
    open_ = {f"open_{c}": F.when(~F.col("plain"), F.col(c)) for c in ("snippet", "page_text", "value", "text_value")}
    df = df.withColumnsRenamed({c: f"l_{c}" for c in told}).withColumns(open_).drop("page_text", "value")
    df = with_support(df, "open_snippet", "open_page_text")
    df = (
        df.withColumn("_value_norm", norm(F.col("open_text_value")))
        .withColumn("_cited_norm", norm(F.col("open_value")))
        .withColumn("_cited_figures", F.when(numeric, F.col("_cited_norm")))
    )
    df = numbers.with_few_mentions(df, "_cited_figures", "_cited").withColumn(
        "_one", F.when(F.size("_cited") == 1, F.get("_cited", F.lit(0)))
    )
    df = _cited_reading(df, "_one")
    stated = lambda claim: number_in_quote(F.col(claim))
    usable = F.col("page_problem").isNull() & F.col("long_enough") & F.col("q_found")
    found = {
        "value_ok": F.when(numeric, stated("num_value")).otherwise(text_in_quote(F.col("_value_norm"))),
        "cited_num": _stated_readings(usable, stated),
        "cited_text": F.when(usable & ~numeric & ~quote_only & text_in_quote(F.col("_cited_norm")), F.col("open_value")),
    }
    plain = F.col("plain")
    return df.withColumns({c: F.when(plain, F.col(f"l_{c}")).otherwise(x) for c, x in found.items()}).withColumns({
        "q_found": plain | F.col("q_found"),
        "long_enough": F.when(plain, F.col("l_long_enough")).otherwise(F.col("long_enough")),
    })


def check_citations(values: DataFrame, citations: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per citation of a proposed value, with why it fails (`reason`,
    `detail`; null when it holds), how it was verified, and the value the
    citation itself states (`cited_num` / `cited_text`) when its passage backs it.

    Most quotes are one line of their page as it stands, settled on columns; the others
    are looked up as patterns, and carry the page text that far.
    """
    cited = citations.join(values.select(*FIELD_KEY, "num_value", "text_value"), FIELD_KEY)
    df = _on_page(_on_one_line(attach_pages(cited, pages).drop("page_ord", "cited_key")))
    df = df.withColumn("source_document", F.coalesce("page_file", "source_document"))

    field = F.col("field_name")
    quote_only = spec.is_quote_only(field)
    shown = quoted(display_value(F.col("num_value"), F.col("text_value")))
    reason = (
        F.when(F.col("page_problem").isNotNull(), F.lit("page_not_in_document"))
        .when(~F.col("long_enough"), F.lit("snippet_too_short"))
        .when(~F.col("q_found"), F.lit("snippet_not_on_page"))
        .when(~quote_only & ~F.col("value_ok"), F.lit("value_not_in_snippet"))
    )
    # The sentences a reviewer reads are stored with a run.
    detail = (
        F.when(F.col("reason") == "page_not_in_document", F.col("page_problem"))
        .when(
            F.col("reason") == "snippet_too_short",
            F.lit(
                f"The quoted snippet is under {quotes.MIN_SNIPPET_CHARS} characters, too short to show where the "
                "value came from."
            ),
        )
        .when(F.col("reason") == "snippet_not_on_page", F.lit("The quoted snippet was not found on the cited page."))
        .when(
            F.col("reason") == "value_not_in_snippet",
            F.concat(F.lit("The quoted passage does not contain the value "), shown, F.lit(".")),
        )
    )
    return (
        df.withColumn("reason", reason)
        .withColumn("detail", detail)
        .withColumn(
            "verification",
            F.when(F.col("reason").isNull(), F.when(quote_only, F.lit("quote_only")).otherwise(F.lit("value_matched"))),
        )
        .select(
            *FIELD_KEY, "cite_ord", "num_value", "text_value", "source_document", "page_number", "snippet",
            "reason", "detail", "verification", "cited_num", "cited_text",
        )
    )


def field_checks(values: DataFrame, checked: DataFrame) -> DataFrame:
    """Per proposed value: the first citation that verifies it and the first
    that fails, in citation order. Both are partial aggregates, so a field with
    very many citations is reduced before the shuffle."""
    evidence = F.struct("source_document", "page_number", "snippet", "verification", "reason", "detail")
    holds = F.col("reason").isNull()
    first = checked.groupBy(*FIELD_KEY).agg(
        F.min_by(evidence, F.when(holds, F.col("cite_ord"))).alias("verified"),
        F.min_by(evidence, F.when(~holds, F.col("cite_ord"))).alias("failure"),
    )
    return values.join(first, FIELD_KEY, "left")


def canonical_citations(checks: DataFrame) -> DataFrame:
    """The citation kept per value: the verified one, else the first failure;
    its text is the stored value and its document the page's own file."""
    kept = F.coalesce("verified", "failure")
    return checks.select(
        *FIELD_KEY,
        display_value(F.col("num_value"), F.col("text_value")).alias("value"),
        kept["source_document"].alias("source_document"),
        kept["page_number"].alias("page_number"),
        kept["snippet"].alias("snippet"),
        F.when(F.col("verified").isNotNull(), F.col("verified.verification")).alias("verification"),
        F.when(F.col("verified").isNull(), F.coalesce(F.col("failure.reason"), F.lit("no_evidence"))).alias("reason"),
    )


def withheld_from_checks(checks: DataFrame, no_evidence_detail: str) -> DataFrame:
    """Values no citation verifies, with the first failure or `no_evidence`."""
    open_ = checks.filter(F.col("verified").isNull())
    return open_.select(
        *FIELD_KEY, "num_value", "text_value",
        F.coalesce(F.col("failure.reason"), F.lit("no_evidence")).alias("reason"),
        F.coalesce(F.col("failure.detail"), F.lit(no_evidence_detail)).alias("detail"),
        F.col("failure.source_document").alias("source_document"),
        F.col("failure.page_number").alias("page_number"),
        F.col("failure.snippet").alias("snippet"),
    )
