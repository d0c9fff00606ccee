"""Secret scans in DataFrame functions only: fixed patterns and sliding-window entropy.

Matches are located without a UDF: a replacement puts a mark character on both sides of
each match, and the lengths of the pieces between marks give its code point span. The
mark itself is replaced in the text by a character that no pattern holds either.

Candidate strings are runs of token characters. A fold slides a window over each
candidate and keeps the count of every character of the class in the window; each step
adds one character, drops one, and updates the sum of c * log2(c) by these two changes,
so the entropy of a window costs the same whatever its width. All work on a text stays in
its row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import let

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more characters
HEX = r"[0-9a-f]{16,}"  # maximal runs of 16 or more characters
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Class, alphabet, window and least entropy in bits a character.
HEX_CLASS = ("0123456789abcdef", 20, 2.9)
ANY_HEX_CLASS = (HEX_CLASS[0] + "ABCDEF", *HEX_CLASS[1:])
TOKEN_CLASS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.8)
HEX_RUN = r"[0-9A-Fa-f]{20,}"  # maximal runs, of either case, inside a candidate
# Suppressed candidates: placeholders, UUIDs, and strings of letters or of digits alone.
ALLOWED = (
    r"(?i)example|placeholder|changeme|dummy|x{8}",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
)
_MARK, _OTHER = "\x01", "\x02"


def _pieces(text: Column, pattern: str) -> Column:
    """Text between matches and matches, in turn."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    return F.split(marked, _MARK)


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, end, body>> of all matches, leftmost, not overlapping."""
    empty = F.array().cast("array<struct<start:long,kind:int,end:long,body:string>>")

    def fold(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        found = F.struct(
            acc["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), piece.alias("body")
        )
        return F.struct(
            end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out")
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), empty.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(_pieces(text, pattern), start, fold, lambda acc: acc["out"])).otherwise(empty)


def entropy_regions(body: Column, alphabet: str, width: int, least: float) -> Column:
    """array<struct<start, end>>: the parts of `body` that windows of at least `least`
    bits cover. Characters outside the alphabet end a window's run of counted ones only
    in that they add no count; `body` shorter than the window is one window."""
    size = F.length(body)
    width_of = F.least(size, F.lit(width))
    counts = F.array_repeat(F.lit(0), len(alphabet))
    regions = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(counts.alias("counts"), F.lit(0.0).alias("sum"), regions.alias("regions"))
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    place = lambda at: F.position(F.substring(body, at, F.lit(1)), F.lit(alphabet))

    def step(acc: Column, at: Column) -> Column:
        change = F.struct(
            place(at).alias("come"), F.when(at > width_of, place(at - width_of)).otherwise(F.lit(0)).alias("go"), acc.alias("acc")
        )

        def apply(x: Column) -> Column:
            old, come, go = x["acc"], x["come"], x["go"]
            count = lambda k: F.coalesce(F.get(old["counts"], k - 1), F.lit(0))
            moved = (come != go) | (come == 0)
            up = F.when(moved & (come > 0), weight(count(come) + 1) - weight(count(come))).otherwise(F.lit(0.0))
            down = F.when(moved & (go > 0), weight(count(go) - 1) - weight(count(go))).otherwise(F.lit(0.0))
            counts = F.when(
                moved,
                F.transform(old["counts"], lambda c, k: c + F.when(k + 1 == come, 1).otherwise(0) - F.when(k + 1 == go, 1).otherwise(0)),
            ).otherwise(old["counts"])
            total = old["sum"] + up + down
            bits = F.log2(width_of.cast("double")) - total / width_of
            begin = at - width_of
            last = F.element_at(old["regions"], -1)
            joined = (F.size(old["regions"]) > 0) & (F.coalesce(last["end"], F.lit(-1)) >= begin)
            here = F.struct(begin.cast("int").alias("start"), at.cast("int").alias("end"))
            longer = F.struct(last["start"].alias("start"), at.cast("int").alias("end"))
            grown = F.when(joined, F.concat(F.slice(old["regions"], 1, F.greatest(F.size(old["regions"]) - 1, F.lit(0))), F.array(longer))).otherwise(
                F.concat(old["regions"], F.array(here))
            )
            hit = (at >= width_of) & (bits >= least - 1e-9)
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hit, grown).otherwise(old["regions"]).alias("regions"))

        return let(change, apply)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), start, step, lambda acc: acc["regions"])


def _allowed(body: Column, patterns: tuple[str, ...] = ALLOWED) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | body.rlike(pattern)
    return found


def _moved(regions: Column, by: Column) -> Column:
    return F.transform(regions, lambda r: F.struct((by + r["start"]).cast("int").alias("start"), (by + r["end"]).cast("int").alias("end")))


def _merged(regions: Column) -> Column:
    """Regions that touch or overlap become one."""

    def fold(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        joined = F.coalesce(last["end"] >= r["start"], F.lit(False))
        return F.when(joined, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.sort_array(regions), F.array().cast("array<struct<start:int,end:int>>"), fold)


def _candidate_regions(body: Column) -> Column:
    """One class and one allow-list decision for the whole candidate."""
    regions = F.when(body.rlike("^[0-9A-Fa-f]+$"), entropy_regions(body, *ANY_HEX_CLASS)).otherwise(entropy_regions(body, *TOKEN_CLASS))
    return F.when(~_allowed(body), regions).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _run_regions(body: Column) -> Column:
    """Regions of each hex run by the hex class, and of the candidate by the token class.

    A run is only suppressed by what it holds itself. A token region is suppressed when it
    overlaps a placeholder word, or when the whole candidate is a UUID or of letters or of
    digits alone; a region that merely lacks digits is not."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    runs = F.filter(spans(body, HEX_RUN, "entropy"), lambda run: ~_allowed(run["body"]))
    inside = F.flatten(F.transform(runs, lambda run: _moved(entropy_regions(run["body"], *ANY_HEX_CLASS), run["start"])))
    apart = lambda words: lambda r: ~F.exists(words, lambda w: (w["start"] < r["end"]) & (r["start"] < w["end"]))
    tokens = let(spans(body, ALLOWED[0], "entropy"), lambda words: F.filter(entropy_regions(body, *TOKEN_CLASS), apart(words)))
    # Windows of a candidate that is one run reach the token class only where they reach the hex class.
    rest = F.when(body.rlike("^[0-9A-Fa-f]+$") | _allowed(body, ALLOWED[1:]), none).otherwise(tokens)
    return _merged(F.concat(inside, rest))


def _entropy_spans(text: Column, hex_runs: bool) -> Column:
    regions = _run_regions if hex_runs else _candidate_regions
    kind = F.lit(KINDS.index("entropy"))

    def of(candidate: Column) -> Column:
        return F.transform(
            regions(candidate["body"]),
            lambda r: F.struct((candidate["start"] + r["start"]).alias("start"), kind.alias("kind"), (candidate["start"] + r["end"]).alias("end")),
        )

    return F.flatten(F.transform(spans(text, CANDIDATE, "entropy"), of))


def told(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hex_runs: bool = False) -> DataFrame:
    """One row per input row: doc_id, base and spans, as arrays of (start, kind, end) in
    order of start, then kind; kinds index `KINDS`. `base` has the fixed patterns, `spans`
    also what the entropy windows add; a window region is not suppressed when it touches a
    base span, so one secret can be reported by both.

    With `hex_runs`, as op9 scans, hex runs of either case have their own class wherever
    they stand in a candidate, and the allow-list looks at what was found. Without it, a
    candidate has one class, and one allowed part suppresses all of it.

    Null and empty texts have no spans. Ids may be null or repeat. Only the two named
    columns are read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = lambda found: F.transform(found, lambda s: s.dropFields("body"))
    value = lambda s: F.regexp_extract(s["body"], ASSIGN, 2)
    assign = F.filter(spans(text, ASSIGN, "assign"), lambda s: F.length(value(s)) >= ASSIGN_LEAST)
    base = F.concat(plain(assign), plain(spans(text, ACCESS, "access")), plain(spans(text, HEX, "hex")))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", base.alias("base"), _entropy_spans(text, hex_runs).alias("extra"))
    return found.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", "extra")).alias("spans"))
