"""Numbers written in text, read with sign, currency, scale and unit.

The text is cut at every figure, so each figure sees only the piece before it
and the piece after it. All steps are built-in expressions: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import spec
from .plans import explode_computed, filter_computed, let, running_sum
from .text import ALNUM, LETTER, WORD_CHAR, ascii_digits

# A figure: digits with inner commas and an optional fraction, not glued to a
# word, a digit or a point on its left.
FIGURE = rf"(?=[0-9.])(?<![{WORD_CHAR}.])(?:[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?|\.[0-9]+)"
DIGITS_FIRST = FIGURE.rsplit("|", 1)[0] + ")"
# "(", a minus that is no hyphen, a currency sign: what may stand right before.
_BEFORE = rf"(?s)(?<=.)(?:\(\s?)?(?:(?<![{ALNUM}])-\s?)?(?:(?:\$|usd)\s?(?:-\s?)?)?$"
# A percent sign or a scale: what may stand right after.
_AFTER = rf"^ ?(?:%|percent(?![{WORD_CHAR}])|(?:thousand|million|billion|mm|bn|[kmb])(?![{WORD_CHAR}]))"
_NEXT_WORD = rf"^ ?-? ?([{LETTER}]+)"

# Scale words.
SCALES = {
    "k": 1e3, "thousand": 1e3,
    "m": 1e6, "mm": 1e6, "million": 1e6,
    "b": 1e9, "bn": 1e9, "billion": 1e9,
}
# Words that say what a figure counts, by kind.
UNIT_WORDS = {
    "dollars": "currency", "usd": "currency",
    "unit": "units", "units": "units",
    "gsf": "area", "nrsf": "area", "rsf": "area", "sf": "area", "sq": "area", "square": "area",
    "year": "years", "years": "years", "yr": "years", "yrs": "years",
    "acre": "other", "acres": "other", "bed": "other", "beds": "other", "building": "other", "buildings": "other",
    "day": "other", "days": "other", "key": "other", "keys": "other", "mile": "other", "miles": "other",
    "month": "other", "months": "other", "room": "other", "rooms": "other", "space": "other", "spaces": "other",
    "stories": "other", "story": "other",
}

# A figure by itself, and one that ends a line after "label: ", with nothing but a dollar or
# percent sign beside it: both in ASCII match form.
_PLAIN_FIGURE = r"\$?[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?%?\z"
_PLAIN_LINE = rf"^[\x20-\x2f\x3a-\x7e]*: {_PLAIN_FIGURE}"


def is_plain_figure(text: Column) -> Column:
    return text.rlike("^" + _PLAIN_FIGURE)


def ends_plain(text: Column) -> Column:
    """Whether `text` is one line of ASCII that holds one figure, last and after ": "."""
    return text.rlike(_PLAIN_LINE)


def plain_figure(text: Column) -> Column:
    """STRUCT<value, kind> of a figure by itself, as `with_mentions` reads it at the end of a line."""
    kind = F.when(text.endswith("%"), F.lit("percent")).when(text.startswith("$"), F.lit("currency")).otherwise(F.lit("plain"))
    digits = F.replace(F.btrim(text, F.lit("$%")), F.lit(","), F.lit(""))
    return F.struct(digits.try_cast("double").alias("value"), kind.alias("kind"))


def is_close(a: Column, b: Column) -> Column:
    tolerance = F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))
    return F.abs(a - b) <= tolerance


# A figure is read in steps, each from the fields of the one before, so that nothing is
# computed twice. The same steps serve arrays (`with_mentions`) and rows (`number_mentions`).
Fields = Callable[[str], Column]


def _surroundings(figure: Column, left: Column, right: Column, first: Column) -> dict[str, Column]:
    return {
        "gap": F.length(left),
        "width": F.length(figure),
        "digits": F.replace(figure, F.lit(","), F.lit("")).try_cast("double"),
        "left": F.concat(F.when(first, F.lit("\n")).otherwise(F.lit("0")), F.right(left, F.lit(9))),
        # Enough for a mark and the longest unit word.
        "right": F.left(right, F.lit(32)),
    }


def _kept(m: Fields, *names: str) -> dict[str, Column]:
    return {name: m(name) for name in names}


def _marks(m: Fields) -> dict[str, Column]:
    left = m("left")
    marked = left.contains("$") | left.contains("usd") | left.contains("(") | left.contains("-")
    return _kept(m, "gap", "width", "digits", "right") | {
        "before": F.when(marked, F.regexp_extract(F.right(left, F.lit(9)), _BEFORE, 0)).otherwise(F.lit("")),
        "after": F.regexp_extract(m("right"), _AFTER, 0),
    }


def _units(m: Fields) -> dict[str, Column]:
    return _kept(m, "gap", "width", "digits", "right", "before", "after") | {
        "mark": F.ltrim(m("after")),
        "currency": m("before").contains("$") | m("before").contains("usd"),
    }


def _scales(m: Fields) -> dict[str, Column]:
    mark = m("mark")
    scaled = (mark != "") & ((F.length(mark) > 1) | ~m("after").startswith(" ") | m("currency"))
    return _kept(m, "gap", "width", "digits", "right", "before", "currency") | {
        "after": F.length(m("after")),
        "percent": mark.isin("%", "percent"),
        "scale": F.when(scaled, F.try_element_at(spec.literal_map(SCALES), mark)),
    }


def _rests(m: Fields) -> dict[str, Column]:
    taken = F.when(m("percent") | m("scale").isNotNull(), m("after")).otherwise(F.lit(0))
    return _kept(m, "gap", "width", "before", "currency", "percent") | {
        "value": m("digits") * F.coalesce(m("scale"), F.lit(1.0)),
        "rest": F.substr(m("right"), taken + F.lit(1)),
        # For a bare figure the next word is read after any mark, taken or not.
        "past_mark": F.when(taken < m("after"), F.substr(m("right"), m("after") + F.lit(1))),
    }


def _words(m: Fields) -> dict[str, Column]:
    return _kept(m, "gap", "width", "before", "currency", "percent", "value", "rest", "past_mark") | {
        "word": F.regexp_extract(m("rest"), _NEXT_WORD, 1)
    }


def _kinds(m: Fields) -> dict[str, Column]:
    negative = m("before").contains("-") | (m("before").startswith("(") & m("rest").startswith(")"))
    counts = F.when(m("word") != "", F.try_element_at(spec.literal_map(UNIT_WORDS), m("word")))
    return _kept(m, "gap", "width") | {
        "value": F.when(negative, -m("value")).otherwise(m("value")),
        "kind": F.when(m("percent"), F.lit("percent"))
        .when(m("currency"), F.lit("currency"))
        .otherwise(F.coalesce(counts, F.lit("plain"))),
        "counted": F.when(m("past_mark").isNull(), m("word") != "").otherwise(m("past_mark").rlike(_NEXT_WORD)),
    }


_STEPS = (_marks, _units, _scales, _rests, _words, _kinds)


@lru_cache(maxsize=1)
def _readings() -> tuple[Column, Column, Column]:
    """What each of `_figures` reads, where it stops, and the mentions. Built once: the
    expressions are large, and the same for every table."""
    pieces = F.col("_pieces")

    def struct(fields: dict[str, Column]) -> Column:
        return F.struct(*[column.alias(name) for name, column in fields.items()])

    read = F.transform(
        "_figures",
        lambda figure, i: struct(_surroundings(figure, F.get(pieces, i), F.get(pieces, i + F.lit(1)), i == 0)),
    )
    for step in _STEPS:
        read = F.transform(read, lambda m: struct(step(lambda name: m[name])))  # called at once

    # Offsets are running sums of piece and figure widths.
    def placed(m: Column, stop: Column) -> Column:
        return F.struct(
            (stop - m["width"]).alias("start"), stop.alias("stop"), m["value"].alias("value"), m["kind"].alias("kind"),
            m["counted"].alias("counted"),
        )

    return read, running_sum("transform(_read, m -> m.gap + m.width)"), F.zip_with("_read", "_stops", placed)


# Stands for a figure in a text: match form has no upper-case ASCII.
_FIGURE_MARK = "F"


def _marked(text: Column) -> Column:
    """`text` with a mark for every figure, to be cut with `substring_index`. A split compiles
    its pattern for every row, which takes longer than the search; a replacement does not."""
    return F.regexp_replace(text, FIGURE, _FIGURE_MARK)


def _marks_in(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit(_FIGURE_MARK), F.lit("")))


def _piece(marked: Column, i: int) -> Column:
    """The text before the first figure (1) or after the last (-1)."""
    return F.call_function("substring_index", marked, F.lit(_FIGURE_MARK), F.lit(i))


def _cut(text: str) -> dict[str, Column]:
    src = ascii_digits(F.col(text))
    return {"_pieces": F.split(src, FIGURE, -1), "_figures": F.regexp_extract_all(src, F.lit(FIGURE), F.lit(0))}


def with_mentions(df: DataFrame, text: str, out: str = "mentions") -> DataFrame:
    """Adds `out ARRAY<STRUCT<start, stop, value, kind, counted>>` for text in
    match form: offsets in characters, `counted` = a word follows the figure."""
    read, stops, mentions = _readings()
    return (
        df.withColumns(_cut(text))
        .withColumn("_read", read)
        .withColumn("_stops", stops)
        .withColumn(out, mentions)
        .drop("_pieces", "_figures", "_read", "_stops")
    )


# Figures are read from so many characters before and after a span: more than the longest
# mark before a figure, and more than `_surroundings` keeps after one.
_LEAD, _TRAIL = 16, 48
_MENTIONS = "array<struct<start:int,stop:int,value:double,kind:string,counted:boolean>>"


def with_mentions_in(df: DataFrame, text: str, start: str, stop: str, out: str, drop: list[str]) -> DataFrame:
    """Adds `out` as `with_mentions` does, with the figures that overlap the span from `start`
    to `stop` only, read in the context of the whole text; their offsets count from the part
    that was read. The part begins before any word or figure the span starts in, so figures
    are cut as in the whole text, whatever its length. `drop`: columns not needed any more,
    which are dropped before figures are read."""
    glued = F.regexp_extract(F.left(F.col(text), F.col(start)), rf"(?<![{WORD_CHAR}.,])[{WORD_CHAR}.,]++\z", 0)
    rest = F.regexp_extract(F.substr(F.col(text), F.col(stop) + F.lit(1)), r"^[\p{Nd}.,]*+", 0)
    df = df.withColumn("_from", F.greatest(F.col(start) - F.length(glued) - F.lit(_LEAD), F.lit(0))).withColumn(
        "_part",
        F.substr(F.col(text), F.col("_from") + F.lit(1), F.col(stop) - F.col("_from") + F.length(rest) + F.lit(_TRAIL)),
    )
    inside = let(
        F.struct(F.col(f"_{start}").alias("start"), F.col(f"_{stop}").alias("stop")),
        lambda span: F.filter("_mentions", lambda m: (m["start"] < span["stop"]) & (span["start"] < m["stop"])),
    )
    span = [(F.col(c) - F.col("_from")).alias(f"_{c}") for c in (start, stop)]
    # A span in which one figure begins and which starts in none: that one is read on columns,
    # only other spans as arrays.
    df = df.select(
        "*", *span, (F.length(glued) == 0).alias("_clean"),
        ascii_digits(F.substr(F.col(text), F.col(start) + F.lit(1), F.col(stop) - F.col(start))).alias("_span"),
    ).drop("_from", *drop)
    df = df.withColumn("_part", ascii_digits(F.col("_part"))).withColumn("_cuts", F.split("_span", FIGURE, -1))
    lone = F.col("_clean") & (F.size("_cuts") == 2) & ~F.col("_span").endswith(".")
    df = df.withColumn("_at", F.when(lone, F.col(f"_{start}") + F.length(F.get("_cuts", F.lit(0)))))
    # Without a figure in it, such a span has none to read.
    empty = F.col("_clean") & (F.size("_cuts") == 1) & ~F.col("_span").endswith(".")
    df = df.withColumn("_empty", empty).drop("_cuts", "_clean", "_span")
    df = with_figure_at(df, "_part", "_at", "_lone", later=False)
    df = df.withColumn("_whole", F.when(F.col("_at").isNull() & ~F.col("_empty"), F.col("_part"))).drop("_part")
    numbers = F.when(F.col("_at").isNotNull(), F.array("_lone")).when(F.col("_empty"), F.array().cast(_MENTIONS)).otherwise(inside)
    return with_mentions(df, "_whole", "_mentions").withColumn(out, numbers).drop(
        "_whole", "_mentions", "_lone", "_at", "_empty", f"_{start}", f"_{stop}"
    )


def with_few_mentions(df: DataFrame, text: str, out: str) -> DataFrame:
    """As `with_mentions`, for texts that mostly hold one figure: it is read on columns, as
    compiled code; only texts with more are read as arrays."""
    df = df.withColumn("_src", ascii_digits(F.col(text))).withColumn("_cuts", _marked(F.col("_src")))
    df = df.withColumn("_n", _marks_in(F.col("_cuts")))
    df = df.withColumn("_at", F.when(F.col("_n") == 1, F.length(_piece(F.col("_cuts"), 1)))).withColumn(
        "_several", F.when(F.col("_n") > 1, F.col("_src"))
    ).drop("_cuts", "_n")
    df = with_mentions(with_figure_at(df, "_src", "_at", "_lone", later=False).drop("_src"), "_several", "_many")
    found = (
        F.when(F.col("_at").isNotNull(), F.array("_lone"))
        .when(F.col("_several").isNotNull(), F.col("_many"))
        .when(F.col(text).isNotNull(), F.array().cast(_MENTIONS))
    )
    return df.withColumn(out, found).drop("_lone", "_at", "_several", "_many")


def with_figure_at(df: DataFrame, text: str, start: str, out: str, later: bool = True) -> DataFrame:
    """Adds `out STRUCT<start, stop, value, kind, counted, later_kinds>`: the figure that begins at
    `start`, and the kinds of the figures after it (null if there are none, left out without
    `later`). `text` is in match form with ASCII digits.

    The figure is read on columns, as compiled code; only figures after it are an array.
    """
    kept = df.columns
    tail = F.substr(F.col(text), F.col(start) + F.lit(1))
    # The text on both sides of the start is cut as the whole text is: no figure spans it.
    df = df.withColumns({
        "_before": _marked(F.left(F.col(text), F.col(start))),
        "_tail": _marked(tail),
        "_figure": F.regexp_extract(tail, FIGURE, 0),
    })
    after = []
    if later:
        several = _marks_in(F.col("_tail")) > 1
        df = df.withColumns({
            "_pieces": F.when(several, F.split(tail, FIGURE, -1)),
            "_figures": F.when(several, F.regexp_extract_all(tail, F.lit(FIGURE), F.lit(0))),
        })
        after = [F.transform(F.slice(_readings()[0], 2, F.size("_figures")), lambda m: m["kind"]).alias("_later")]
    # The tail begins with the figure itself, so with its mark.
    right = _piece(F.substr(F.col("_tail"), F.lit(2)), 1)
    fields = _surroundings(
        F.col("_figure"), _piece(F.col("_before"), -1), right, ~F.contains(F.col("_before"), F.lit(_FIGURE_MARK))
    )
    df = df.select(*kept, *after, *[c.alias(f"_{n}") for n, c in fields.items()])
    after = ["_later"] if later else []
    for step in _STEPS:
        fields = step(lambda name: F.col(f"_{name}"))
        df = df.select(*kept, *after, *[c.alias(f"_{n}") for n, c in fields.items()])
    figure = F.struct(
        F.col(start).alias("start"), (F.col(start) + F.col("_width")).alias("stop"), F.col("_value").alias("value"),
        F.col("_kind").alias("kind"), F.col("_counted").alias("counted"), *[F.col(x).alias("later_kinds") for x in after],
    )
    # A later filter on the figure would be moved to the front, with every step copied into it.
    return filter_computed(df.select(*kept, figure.alias(out)), F.lit(True))


def number_mentions(pages: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Table of mentions: one row per figure, keyed by `keys` and its position.

    Figures become rows before they are read: on rows the steps are compiled code, inside
    the lambdas of an array each is interpreted, which takes several times as long.
    """
    cut = pages.select(*keys, F.col(text).alias("_text")).withColumns(_cut("_text")).withColumn(
        "_stops", running_sum("transform(_figures, (f, i) -> length(f) + length(_pieces[i]))")
    )
    apart = F.arrays_zip("_figures", "_pieces", F.slice("_pieces", 2, F.size("_pieces")).alias("_rights"), "_stops")
    rows = explode_computed(
        # One piece more than figures: the last stands after all of them.
        cut.withColumn("_apart", F.slice(apart, 1, F.size("_figures"))), "_apart", "_m", pos="mention_ord", keep=keys
    )
    fields = _surroundings(F.col("_m._figures"), F.col("_m._pieces"), F.col("_m._rights"), F.col("mention_ord") == 0)
    rows = rows.select(*keys, "mention_ord", F.col("_m._stops").alias("stop"), *[c.alias(f"_{n}") for n, c in fields.items()])
    for step in _STEPS:
        fields = step(lambda name: F.col(f"_{name}"))
        rows = rows.select(*keys, "mention_ord", "stop", *[c.alias(f"_{n}") for n, c in fields.items()])
    # A later filter on value or kind would be moved to the front, with every step copied into it.
    read = rows.select(
        *keys, "mention_ord", (F.col("stop") - F.col("_width")).alias("start"), "stop",
        F.col("_value").alias("value"), F.col("_kind").alias("kind"),
    )
    return filter_computed(read, F.lit(True))


def supports(field: Column, value: Column, mention: Column) -> Column:
    """Whether a mention states `value` for `field` (fractions may be percentages)."""
    fraction = (
        spec.is_percent(field) & (mention["kind"] == "plain") & (mention["value"] > 0) & (mention["value"] <= 1)
    )
    close = is_close(mention["value"], value) | (fraction & is_close(mention["value"] * 100, value))
    return spec.accepts_kind(field, mention["kind"]) & close


def coerced(field: Column, value: Column) -> Column:
    """`value` as the field can hold it, or null (a fractional count, out of bounds)."""
    whole = ~spec.is_integer(field) | (value == F.floor(value))
    return F.when(whole & spec.in_bounds(field, value), value)


def candidate_value(field: Column, mention: Column) -> Column:
    """The field value a mention stands for, or null when it cannot be one."""
    fraction = (
        spec.is_percent(field) & (mention["kind"] == "plain") & (mention["value"] > 0) & (mention["value"] <= 1)
    )
    value = F.when(fraction, mention["value"] * 100).otherwise(mention["value"])
    return F.when(spec.accepts_kind(field, mention["kind"]), coerced(field, value))
