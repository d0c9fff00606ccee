"""Quotes looked up in a positional index of the pages' words and marks.

Tables:

* postings  deal_id, page_ord, joined, pos, token, start, stop, digits, before, after: one
  row per word or mark of a page in match form (and of the form with words joined over line
  ends, where a page breaks words). `digits` counts the digits of the page before it,
  `before` and `after` are the lengths of the word that touches a mark.
* asked     quote_id, deal_id, page_ord, snippet, numeric: a quote and the page it is
  looked for on.

A piece of a quote is where its tokens follow each other: postings and pieces meet on
(deal, page, token), and the places where all tokens of a piece agree on where it begins
are counted. Pieces of one quote are then joined from the last to the first, by the rule of
the gap. The index is built once per page however many quotes cite it, and no pattern is
built per quote. Given the quotes, it holds their tokens only (`postings`), so that what is
shuffled follows the quotes and not the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import explode_computed, running_sum
from ..functions.quotes import MAX_GAP_CHARS, quote_parts
from ..functions.text import ALNUM, LETTER, norm

FORM = ["deal_id", "page_ord", "joined"]
POSTING = ["token", "start", "stop", "digits", "digits_after", "before", "after"]
TOKEN = rf"[{ALNUM}]+|[^{ALNUM} \n]"
_BIN = MAX_GAP_CHARS + 1


def asked_tokens(snippet: Column) -> Column:
    """The distinct tokens of the pieces of a quote, for `postings`."""
    pieces = F.array_join(quote_parts(norm(snippet)), " ")
    return F.array_distinct(F.regexp_extract_all(pieces, F.lit(TOKEN), F.lit(0)))


def postings(pages: DataFrame, tokens: str | None = None) -> DataFrame:
    """The index of `pages`: of all words and marks, or of those in the array column `tokens`
    of the page only, which suffice for quotes of such tokens."""
    plain = F.struct(F.lit(False).alias("joined"), F.col("_plain").alias("form"))
    broken = F.struct(F.lit(True).alias("joined"), norm(F.col("text"), join_line_hyphens=True).alias("form"))
    forms = F.when(F.col("_plain").rlike(rf"[{LETTER}]-\n[{LETTER}]"), F.array(plain, broken)).otherwise(F.array(plain))
    keys = ["deal_id", "page_ord"]
    kept = [tokens] if tokens else []
    read = explode_computed(
        pages.withColumn("_plain", norm(F.col("text"))).withColumn("_forms", forms), "_forms", "_f", keep=[*keys, *kept]
    )
    read = (
        read.select(*keys, *kept, "_f.joined", F.regexp_extract_all("_f.form", F.lit(TOKEN), F.lit(0)).alias("_tokens"),
                    F.transform(F.split("_f.form", TOKEN, -1), F.length).alias("_gaps"))
        .withColumn("_widths", F.transform("_tokens", F.length))
        .withColumn("_stops", running_sum("zip_with(_widths, slice(_gaps, 1, size(_widths)), (w, g) -> w + g)"))
        .withColumn("_digits", running_sum(r"transform(_tokens, t -> length(regexp_replace(t, '\\P{Nd}', '')))"))
        .withColumn("_words", F.transform("_tokens", lambda t: F.when(t.rlike(f"^[{ALNUM}]"), F.length(t)).otherwise(F.lit(0))))
    )
    rows = F.transform(
        F.arrays_zip("_tokens", "_widths", "_stops", "_digits"),
        lambda x, i: F.struct(
            x["_tokens"].alias("token"), (x["_stops"] - x["_widths"]).alias("start"), x["_stops"].alias("stop"),
            (x["_digits"] - F.length(F.regexp_replace(x["_tokens"], r"\P{Nd}", ""))).alias("digits"), x["_digits"].alias("digits_after"),
            F.when((i > 0) & (F.get("_gaps", i) == 0), F.get("_words", i - F.lit(1))).otherwise(F.lit(0)).alias("before"),
            F.when(F.get("_gaps", i + F.lit(1)) == 0, F.coalesce(F.get("_words", i + F.lit(1)), F.lit(0))).otherwise(F.lit(0)).alias("after"),
        ),
    )
    read = read.withColumn("_rows", rows)
    if tokens:
        numbered = F.transform("_rows", lambda x, i: F.struct(i.alias("pos"), *[x[c].alias(c) for c in POSTING]))
        asked = F.filter(numbered, lambda x: F.array_contains(F.col(tokens), x["token"]))
        return explode_computed(read.withColumn("_rows", asked), "_rows", "_p", keep=FORM).select(*FORM, "_p.*")
    return explode_computed(read, "_rows", "_p", pos="pos", keep=FORM).select(*FORM, "pos", "_p.*")


def find_pieces(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Every place of every piece: quote_id, numeric, piece, pieces, joined, start, stop,
    digits (before it), digits_after, low, high. A text field's piece that begins or ends
    with a mark may take in the word that touches it: from `low` to `high`."""
    parts = asked.withColumn("_parts", quote_parts(norm(F.col("snippet")))).withColumn("pieces", F.size("_parts"))
    keys = ["quote_id", "deal_id", "page_ord", "numeric", "pieces"]
    pieces = explode_computed(parts, "_parts", "_piece", pos="piece", keep=keys)
    pieces = pieces.withColumn("_tokens", F.regexp_extract_all("_piece", F.lit(TOKEN), F.lit(0))).withColumn("_n", F.size("_tokens"))
    words = explode_computed(pieces, "_tokens", "token", pos="_i", keep=[*keys, "piece", "_n"])
    hits = words.join(index, ["deal_id", "page_ord", "token"]).withColumn("_at", F.col("pos") - F.col("_i"))
    text = ~F.col("numeric")
    found = hits.groupBy("quote_id", "numeric", "pieces", "piece", "joined", "_n", "_at").agg(
        F.count(F.lit(1)).alias("_hits"),
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.min("digits").alias("digits"),
        F.max("digits_after").alias("digits_after"),
        F.min(F.when((F.col("_i") == 0) & text & ~F.col("token").rlike(f"^[{ALNUM}]"), F.col("before"))).alias("_before"),
        F.max(F.when((F.col("_i") == F.col("_n") - 1) & text & ~F.col("token").rlike(f"^[{ALNUM}]"), F.col("after"))).alias("_after"),
    )
    return found.filter("_hits = _n").select(
        "quote_id", "numeric", "piece", "pieces", "joined", "start", "stop", "digits", "digits_after",
        (F.col("start") - F.coalesce("_before", F.lit(0))).alias("low"),
        (F.col("stop") + F.coalesce("_after", F.lit(0))).alias("high"),
    )


def find_quotes(asked: DataFrame, index: DataFrame) -> DataFrame:
    """quote_id, joined, start, stop of each quote that is on its page: the first place
    from which all pieces follow each other with at most 150 characters between two of
    them, none a digit for a numeric field; each piece as close to the one before it as the
    rest allows. The form with joined words only counts where the page as it is has no match.
    `start` and `stop` leave out the words that a text field's marks may take in."""
    found = find_pieces(asked, index)
    rounds = found.agg(F.max("pieces")).first()[0] or 0
    here = ["quote_id", "joined"]
    # `rest`: where the quote ends if this piece is here. Pieces are counted from the last.
    left = F.col("pieces") - 1 - F.col("piece")
    open_ = found.withColumn("left", left)
    whole = open_.filter("left = 0").withColumn("rest", F.col("stop"))
    chains = whole.filter("piece = 0")
    for k in range(1, rounds):
        later = whole.select(
            *here, F.col("start").alias("_start"), F.col("low").alias("_low"), F.col("digits").alias("_digits"), "rest",
            F.explode(F.array_distinct(F.array(F.floor(F.col("low") / _BIN), F.floor(F.col("start") / _BIN)))).alias("_bin"),
        )
        earlier = open_.filter(F.col("left") == k).withColumn(
            "_bin", F.explode(F.sequence(F.floor(F.col("stop") / _BIN), F.floor((F.col("high") + MAX_GAP_CHARS) / _BIN)))
        )
        follows = (
            (F.col("_start") >= F.col("stop"))
            & (F.greatest("_low", "stop") <= F.col("high") + MAX_GAP_CHARS)
            & (~F.col("numeric") | (F.col("_digits") == F.col("digits_after")))
        )
        joined = earlier.join(later, [*here, "_bin"]).filter(follows)
        whole = joined.groupBy(*open_.columns).agg(F.min_by("rest", "_start").alias("rest"))
        chains = chains.unionByName(whole.filter("piece = 0"))
    best = chains.groupBy("quote_id").agg(F.min(F.struct("joined", "start", "rest")).alias("_b"))
    return best.select("quote_id", "_b.joined", "_b.start", F.col("_b.rest").alias("stop"))
