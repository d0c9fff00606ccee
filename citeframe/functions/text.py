"""Text column functions: page cleaning, match form, words, display text.

Unicode normalization and case folding call the ICU library that ships with
Spark through the built-in `java_method`, and only for rows that hold non-ASCII
text, so no row ever leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans import explode_computed

ALNUM = r"\p{L}\p{N}"
WORD_CHAR = ALNUM + "_"
LETTER = r"\p{L}\p{No}\p{Nl}"
# Every white-space character, as trimming understands it.
SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

# Characters invisible in print, dropped before matching.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Typographic quotes and dashes and what each is read as.
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u2032"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u2033"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
_FOLD_FROM = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES
_FOLD_TO = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES)

# Every decimal digit outside ASCII and the digit it stands for.
_DIGIT_FROM = "".join(chr(c) for c in range(0x80, 0x10000) if chr(c).isdecimal())
_DIGIT_TO = "".join(str(int(c)) for c in _DIGIT_FROM)


def _icu(cls: str, method: str, col: Column, flag: bool) -> Column:
    return F.java_method(F.lit(cls), F.lit(method), col, F.lit(flag))


def _has_non_ascii(col: Column) -> Column:
    return F.octet_length(col) != F.length(col)


def nfc(col: Column) -> Column:
    return F.when(_has_non_ascii(col), _icu("com.ibm.icu.text.Normalizer", "compose", col, False)).otherwise(col)


def nfkc(col: Column) -> Column:
    return F.when(_has_non_ascii(col), _icu("com.ibm.icu.text.Normalizer", "compose", col, True)).otherwise(col)


def casefold(col: Column) -> Column:
    folded = _icu("com.ibm.icu.lang.UCharacter", "foldCase", col, True)
    return F.when(_has_non_ascii(col), folded).otherwise(F.lower(col))


def strip(col: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(col, F.lit(SPACES))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def single_spaced(col: Column) -> Column:
    """Every white-space run as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " "))


def clean_page(col: Column) -> Column:
    """Page text as stored: NFC, LF line ends, no control or invisible characters."""
    x = nfc(col)
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\x7f" + INVISIBLE + "]", "")
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    return strip(x)


def clean_for_chunks(col: Column) -> Column:
    """Page text as indexed: single blanks, at most one empty line in a row."""
    x = F.regexp_replace(col, "\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(x)


def _untidy(col: Column) -> Column:
    """Whether ASCII text holds white space that the match form rewrites. Plain searches:
    most text is tidy, and a pattern takes ten times as long to find that out."""
    marks = ["  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\f", "\r", "\x1c", "\x1d", "\x1e", "\x1f"]
    return reduce(lambda a, b: a | b, [col.contains(mark) for mark in marks])


def norm(col: Column, join_line_hyphens: bool = False) -> Column:
    """The form quotes are matched in: NFKC, plain quotes and dashes, no invisible
    characters, case folded, each white-space run one LF or one space."""
    def spacing(x: Column, blank: str, hyphens: str) -> Column:
        # Only runs that are not yet a single space or LF are rewritten.
        if join_line_hyphens:
            x = F.regexp_replace(x, hyphens, "")
        x = F.regexp_replace(x, rf"[ {blank}]{{2,}}|[{blank}]", " ")
        return F.regexp_replace(x, r" \n[ \n]*|\n[ \n]+", "\n")

    plain = spacing(col, r"\t\x0b\f\r\x1c-\x1f", r"(?<=[A-Za-z])-[ \t]*\n\s*(?=[A-Za-z])")
    # Two separate branches, so plain ASCII rows never reach the ICU calls and
    # nothing is computed twice.
    composed = F.translate(_icu("com.ibm.icu.text.Normalizer", "compose", col, True), _FOLD_FROM, _FOLD_TO)
    visible = F.regexp_replace(composed, "[" + INVISIBLE + "]", "")
    wide = spacing(
        visible, r"\t\x0b\f\r\x1c-\x1f\x85\p{Z}", rf"(?U)(?<=[{LETTER}])-[ \t]*\n\s*(?=[{LETTER}])"
    )
    folded = _icu("com.ibm.icu.lang.UCharacter", "foldCase", wide, True)
    untidy = _untidy(col) | col.contains("-\n") if join_line_hyphens else _untidy(col)
    x = F.when(_has_non_ascii(col), folded).when(untidy, F.lower(plain)).otherwise(F.lower(col))
    return F.btrim(x, F.lit(" \n"))


def words(col: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(col, F.lit(f"[{ALNUM}]+"), F.lit(0))


def spaced_words(col: Column) -> Column:
    """The words of text, each between single blanks; two blanks if there is none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(col, f"[^{ALNUM}]+", " ")), F.lit(" "))


def holds_words(haystack: Column, needle: Column) -> Column:
    """Whether the words of `needle` occur next to each other in `haystack`."""
    spaced = spaced_words(needle)
    return (spaced != "  ") & spaced_words(haystack).contains(spaced)


def ascii_digits(col: Column) -> Column:
    return F.when(_has_non_ascii(col), F.translate(col, _DIGIT_FROM, _DIGIT_TO)).otherwise(col)


def display_number(value: Column) -> Column:
    """Whole numbers without a fraction, others as the shortest decimal."""
    whole = F.when(F.abs(value) < 9e18, value.cast("bigint").cast("string")).otherwise(
        value.cast("decimal(38,0)").cast("string")
    )
    decimal = F.regexp_replace(value.cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    plain = ((F.abs(value) >= 1e7) & (F.abs(value) < 1e15)) | ((F.abs(value) < 1e-3) & (F.abs(value) >= 1e-4))
    return F.when(value == F.floor(value), whole).when(plain, decimal).otherwise(value.cast("string"))


def display_value(num: Column, text: Column) -> Column:
    return F.coalesce(display_number(num), text)


def quoted(col: Column) -> Column:
    """Text in quotes as a reader-facing message shows it."""
    x = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = col.contains("'") & ~col.contains('"')
    escaped = F.replace(x, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def _named_at_start(folded: Column, field: Column) -> Column:
    """Whether text starts with a field's name (underscores or spaces) and the
    name ends there."""

    def starts(label: Column) -> Column:
        following = F.substr(folded, F.length(label) + F.lit(1), F.lit(1))
        return folded.startswith(label) & ~following.rlike(f"[{WORD_CHAR}]")

    return starts(field) | starts(F.replace(field, F.lit("_"), F.lit(" ")))


def note_names_field(note: Column, field: Column) -> Column:
    """Whether a note is about `field`."""
    return _named_at_start(casefold(strip(note)), field)


def with_named_fields(df: DataFrame, note: str, fields: list[str], out: str = "field_name") -> DataFrame:
    """One row per (note, field the note is about). The few field names are
    tried inside the row, so notes are never joined or shuffled for this."""
    named = F.filter(F.array(*[F.lit(f) for f in fields]), lambda f: _named_at_start(F.col("_folded"), f))
    df = df.withColumn("_folded", casefold(strip(F.col(note)))).withColumn("_named", named).drop("_folded")
    return explode_computed(df, "_named", out)


def note_text(note: Column, field: Column) -> Column:
    """A note without its leading field name; the whole note if nothing is left."""
    stripped = strip(note)
    folded = casefold(stripped)
    spaced = F.replace(field, F.lit("_"), F.lit(" "))
    rest = F.regexp_replace(F.substr(stripped, F.length(field) + F.lit(1)), "^[ \t:\\-\u2013\u2014]+", "")
    named = folded.startswith(field) | folded.startswith(spaced)
    return F.when(named & (rest != ""), rest).otherwise(stripped)


def placeholder_to_null(col: Column, placeholders: list[str]) -> Column:
    """Null for text that only says there is no value."""
    key = F.lower(strip(F.regexp_replace(strip(col), r"\.+$", "")))
    return F.when(key.isin(placeholders), F.lit(None)).otherwise(col)
