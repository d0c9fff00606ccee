"""Quotes and figures as spans of a page, joined by position.

Tables:

* figures  deal_id, page_ord, joined, start, stop, value, kind: every figure of a page,
  read once per page, in the context of the whole page. A page that breaks words at line
  ends is read a second time with the words joined.
* quotes   deal_id, page_ord, joined, q_start, q_stop: where quotes were found.

Pages are cut into bins of a fixed number of characters. A span has one row per bin that it
touches, so spans that overlap share a bin, and the join is an equi-join on (deal, page,
form, bin) with the overlap as the rest of its condition: the figures of a long page spread
over its bins, and a page that very many quotes cite is split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.plans import explode_computed
from ..functions.text import LETTER, norm

PAGE = ["deal_id", "page_ord"]
FORM = [*PAGE, "joined"]
BIN_CHARS = 256


def page_figures(pages: DataFrame) -> DataFrame:
    """The figures of every page and form."""
    plain = F.struct(F.lit(False).alias("joined"), F.col("_plain").alias("form"))
    broken = F.struct(F.lit(True).alias("joined"), norm(F.col("text"), join_line_hyphens=True).alias("form"))
    forms = F.when(F.col("_plain").rlike(rf"[{LETTER}]-\n[{LETTER}]"), F.array(plain, broken)).otherwise(F.array(plain))
    read = pages.withColumn("_plain", norm(F.col("text"))).withColumn("_forms", forms).select(*PAGE, "_forms")
    read = explode_computed(read, "_forms", "_form", keep=PAGE)
    return numbers.number_mentions(read.select(*PAGE, "_form.joined", "_form.form"), "form", FORM).drop("mention_ord")


def by_bin(spans: DataFrame, start: str, stop: str, width: int = BIN_CHARS) -> DataFrame:
    """One row per bin that a span touches; an empty span touches none."""
    first = F.floor(F.col(start) / width).cast("int")
    last = F.floor((F.col(stop) - 1) / width).cast("int")
    touched = F.when(F.col(stop) > F.col(start), F.sequence(first, last))
    return explode_computed(spans.withColumn("_touched", touched), "_touched", "bin")


def values_in_quotes(claims: DataFrame, figures: DataFrame) -> DataFrame:
    """The claims whose value a figure in their quote states. `claims`: FORM, q_start,
    q_stop, field_name, claim (a value or null), and any other columns."""
    told = by_bin(claims.filter(F.col("claim").isNotNull()), "q_start", "q_stop").alias("c")
    read = by_bin(figures, "start", "stop").alias("f")
    same = [F.col(f"c.{k}") == F.col(f"f.{k}") for k in (*FORM, "bin")]
    overlap = (F.col("f.start") < F.col("c.q_stop")) & (F.col("c.q_start") < F.col("f.stop"))
    mention = F.struct(F.col("f.value").alias("value"), F.col("f.kind").alias("kind"))
    states = numbers.supports(F.col("c.field_name"), F.col("c.claim"), mention)
    condition = overlap & states
    for equal in same:
        condition = equal & condition
    return told.join(read, condition, "left_semi").drop("bin")

