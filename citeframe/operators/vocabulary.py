"""Free text onto the fixed vocabulary: property types and markets.

The vocabulary is a constant of a few hundred entries. Rules that look an entry up by its
key hold it as a literal map; property types are found by joining the word sequences of a
text with the phrases, so their number is in no row's cost. `once_per_text` matches a text
that many rows share once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.plans import explode_computed
from ..functions.text import casefold, is_blank, single_spaced
from ..session import cut_lineage
from ..spec import constant, literal_map

PROFILE_MARKET_FIELDS = ["market", "submarket", "location", "address"]

_ZIP = r"\s*\b\d{5}(?:-\d{4})?$"
_TRAILING_STATE = r"^(.*\S)\s+([a-z]{2})(?:\s+\d{5}(?:-\d{4})?)?$"
_FILLER = r"\b(?:" + "|".join(vocab.FILLER) + r")\b"
_FOREIGN = r"\b(?:" + "|".join(vocab.FOREIGN) + r")\b"


def tidy(text: Column) -> Column:
    """Case folded, "&" spelled out, plain dashes, other punctuation dropped."""
    x = F.replace(casefold(text), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, "[‐-―]", "-")
    return single_spaced(F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\s,/-]", " "))


def _as_key(tidied: Column) -> Column:
    return F.trim(F.regexp_replace(tidied, "[-/, ]+", " "))


def vocabulary_key(text: Column) -> Column:
    return _as_key(tidy(text))


def type_vocabulary(spark: SparkSession) -> DataFrame:
    """tier, property_type, phrase"""
    return spark.createDataFrame(vocab.type_phrases(), "tier int, property_type string, phrase string")


def market_vocabulary(spark: SparkSession) -> DataFrame:
    """market, states, alias, alias_key: one row per name of a market"""
    rows = [(m, s, a, vocab.lookup_key(a)) for m, s, names in vocab.market_rows() for a in names]
    return spark.createDataFrame(rows, "market string, states array<string>, alias string, alias_key string")


def once_per_text(df: DataFrame, text: str, out: str, match: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """`df` with `out` as `match` adds it, computed for every distinct text once. The texts
    come back by an equi-join whose other side has one row per text; a text that very many
    rows share is split there at run time."""
    told = match(df.select(F.col(text).alias("_text")).filter("_text is not null").distinct(), "_text", out)
    return df.join(told.select(F.col("_text"), out), F.col(text) == F.col("_text"), "left").drop("_text")


def vocabulary_problems(markets: DataFrame) -> DataFrame:
    """Names listed for two markets, and states nobody knows."""
    codes = sorted(set(vocab.STATES.values()))
    shared = (
        markets.groupBy("alias_key")
        .agg(F.count_distinct("market").alias("n"))
        .filter("n > 1")
        .select(F.concat(F.lit("alias of two markets: "), "alias_key").alias("problem"))
    )
    unknown = (
        markets.select(F.explode("states").alias("state"))
        .distinct()
        .filter(~F.col("state").isin(codes))
        .select(F.concat(F.lit("unknown state: "), "state").alias("problem"))
    )
    return shared.unionByName(unknown)


# --- Property types ------------------------------------------------------------


def strict_type(text: Column) -> Column:
    """The type when the text is a canonical name or an exact alias, else null."""
    key = vocabulary_key(text)
    return F.when(
        ~is_blank(text) & ~key.isin(vocab.NOT_MANDATE_PHRASES), F.try_element_at(literal_map(vocab.exact_types()), key)
    )


def _type_dictionary(spark: SparkSession) -> tuple[DataFrame, int]:
    """(phrase, whole, tier, property_type) and the most words of a phrase. Aliases that
    must be the whole text come first, as tier 0."""
    rows = [(phrase, False, tier, name) for tier, name, phrase in vocab.type_phrases()]
    rows += [(key, True, 0, name) for key, name in vocab.exact_types().items()]
    table = spark.createDataFrame(rows, "phrase string, whole boolean, tier int, property_type string")
    return table, max(len(row[0].split(" ")) for row in rows)


def _loose_types(texts: DataFrame, text: str, out: str) -> DataFrame:
    phrases, longest = _type_dictionary(texts.sparkSession)
    words = texts.withColumn("_words", F.split(vocabulary_key(F.col(text)), " "))
    sequences = F.flatten(
        F.transform(
            "_words",
            lambda _, i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_words") - i)),
                lambda n: F.struct(
                    i.alias("at"), F.array_join(F.slice("_words", i + F.lit(1), n), " ").alias("phrase"), (n == F.size("_words")).alias("all")
                ),
            ),
        )
    )
    grams = explode_computed(words.withColumn("_grams", sequences), "_grams", "_g", keep=[text])
    # The dictionary has a fixed few hundred rows, whatever the size of the data.
    hits = grams.select(text, "_g.at", "_g.phrase", "_g.all").join(F.broadcast(phrases), "phrase").filter(F.col("all") | ~F.col("whole"))
    best = F.min(F.struct("tier", "at", (-F.length("phrase")).alias("l"), "property_type"))
    return hits.groupBy(text).agg(best.alias("_best")).select(text, F.col("_best.property_type").alias(out))


def with_loose_type(df: DataFrame, text: str, out: str = "property_type") -> DataFrame:
    """Adds the type a description is about: an exact alias, else the best phrase of
    the first tier that has one (earliest, then longest; whole words only)."""
    return once_per_text(df, text, out, _loose_types)


# --- Markets -------------------------------------------------------------------


def _market_map() -> Column:
    """Name key -> (market, states)."""
    names = {vocab.lookup_key(a): {"market": m, "states": s} for m, s, names in vocab.market_rows() for a in names}
    return constant(names, "map<string,struct<market:string,states:array<string>>>")


def _is_state_code(word: Column) -> Column:
    return F.array_contains(constant(sorted(set(vocab.STATES.values())), "array<string>"), word)


def _states_of(piece: Column) -> Column:
    """Sorted state codes when the piece is nothing but states, else empty."""
    bare = F.trim(F.regexp_replace(piece, _ZIP, ""))
    words = F.filter(F.split(bare, r"[\s/-]+"), lambda w: w != "")
    named = F.try_element_at(literal_map(vocab.STATES), bare)
    all_codes = (F.size(words) > 0) & F.forall(words, _is_state_code)
    return F.when(named.isNotNull(), F.array(named)).when(all_codes, F.array_sort(F.array_distinct(words))).otherwise(
        F.array().cast("array<string>")
    )


def _pieces(tidied: Column) -> Column:
    return F.filter(F.transform(F.split(tidied, ","), lambda p: F.trim(p)), lambda p: p != "")


def with_strict_market(df: DataFrame, text: str, out: str = "market") -> DataFrame:
    """Adds the market when the text is one of its names, with or without its state."""
    df = df.withColumn("_tidy", tidy(F.col(text))).withColumn("_parts", _pieces(F.col("_tidy")))
    place, second = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    df = df.withColumn("_states", F.when(F.size("_parts") == 2, _states_of(second)))
    candidates = F.concat(
        F.transform("_states", lambda s: _as_key(F.concat(place, F.lit(" "), s))), F.array(_as_key(place))
    )
    df = df.withColumn("_candidates", F.when(F.size("_states") > 0, candidates))
    hits = F.filter(
        F.transform("_candidates", lambda c: F.try_element_at(_market_map(), c)),
        lambda m: m.isNotNull() & F.arrays_overlap(m["states"], F.col("_states")),
    )
    whole = F.try_element_at(_market_map(), _as_key(F.col("_tidy")))["market"]
    return df.withColumn(
        out, F.when(~is_blank(F.col(text)), F.coalesce(whole, F.get(hits, F.lit(0))["market"]))
    ).drop("_tidy", "_parts", "_states", "_candidates")


def with_market_match(df: DataFrame, text: str, out: str = "match") -> DataFrame:
    """Adds struct(market, confidence, matched_text): "exact" when a whole place in
    the text is a known name, "partial" when only words inside a place are. A named
    state rules out markets elsewhere; a foreign country rules out all."""
    state_names = constant(sorted(vocab.STATES), "array<string>")
    df = df.withColumn("_tidy", tidy(F.col(text))).withColumn(
        "_parts", _pieces(F.regexp_replace("_tidy", _FILLER, " "))
    )

    def read(piece: Column, i: Column) -> Column:
        states = F.when(i > 0, _states_of(piece)).otherwise(F.array().cast("array<string>"))
        head, code = F.regexp_extract(piece, _TRAILING_STATE, 1), F.regexp_extract(piece, _TRAILING_STATE, 2)
        trailing = _is_state_code(code) & ~F.array_contains(state_names, head)
        place = F.trim(F.regexp_replace(F.when(trailing, head).otherwise(piece), _ZIP, ""))
        return F.when(F.size(states) > 0, F.struct(F.lit("").alias("place"), states.alias("states"))).otherwise(
            F.struct(
                place.alias("place"),
                F.when(trailing, F.array(code)).otherwise(F.array().cast("array<string>")).alias("states"),
            )
        )

    df = (
        df.withColumn("_read", F.transform("_parts", read))
        .withColumn("_places", F.filter(F.transform("_read", lambda r: r["place"]), lambda p: p != ""))
        .withColumn("_states", F.array_sort(F.array_distinct(F.flatten(F.transform("_read", lambda r: r["states"])))))
    )

    def whole_names(place: Column) -> Column:
        return F.concat(
            F.transform("_states", lambda s: _as_key(F.concat(place, F.lit(" "), s))),
            F.array(_as_key(place)),
            F.transform(F.split(place, "[-/]"), _as_key),
        )

    def inner_words(words: Column) -> Column:
        longest = F.least(F.size(words), F.lit(4)) - F.lit(1)
        sizes = F.when(longest >= 1, F.sequence(longest, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        grams = F.flatten(
            F.transform(
                sizes,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.size(words) - n + F.lit(1)),
                    lambda start: F.array_join(F.slice(words, start, n), " "),
                ),
            )
        )
        return F.filter(grams, lambda g: F.length(g) >= vocab.MIN_PARTIAL_CHARS)

    def first_hit(candidates: str, confidence: str) -> Column:
        hits = F.filter(
            F.transform(
                candidates, lambda c: F.struct(F.try_element_at(_market_map(), c).alias("m"), c.alias("c"))
            ),
            lambda h: h["m"].isNotNull()
            & ((F.size("_states") == 0) | F.arrays_overlap(h["m"]["states"], F.col("_states"))),
        )
        hit = F.get(hits, F.lit(0))
        return F.when(
            hit.isNotNull(),
            F.struct(
                hit["m"]["market"].alias("market"), F.lit(confidence).alias("confidence"), hit["c"].alias("matched_text")
            ),
        )

    words = F.transform("_places", lambda p: F.split(_as_key(p), " "))
    foreign = (F.size("_states") == 0) & F.element_at(_pieces(F.col("_tidy")), -1).rlike(_FOREIGN)
    df = (
        df.withColumn("_whole", F.flatten(F.transform("_places", whole_names)))
        .withColumn("_words", words)
        .withColumn("_inner", F.flatten(F.transform("_words", inner_words)))
        .withColumn("_ruled_out", is_blank(F.col(text)) | (F.size("_parts") == 0) | F.coalesce(foreign, F.lit(False)))
    )
    return df.withColumn(
        out, F.when(~F.col("_ruled_out"), F.coalesce(first_hit("_whole", "exact"), first_hit("_inner", "partial")))
    ).drop("_tidy", "_parts", "_read", "_places", "_states", "_whole", "_words", "_inner", "_ruled_out")


def with_profile_market(df: DataFrame, out: str = "profile_market") -> DataFrame:
    """Adds struct(market, confidence, matched_text, field) over a wide profile: the
    first field with an exact match, else the first partial one. A text is matched once,
    however many rows and fields hold it (as `once_per_text` does for one field)."""
    texts = df.select(F.explode(F.array(*PROFILE_MARKET_FIELDS)).alias("_text")).filter("_text is not null").distinct()
    # Written once: the four joins would each match the texts anew.
    told = cut_lineage(with_market_match(texts, "_text", "_match").select("_text", "_match"))
    matches = []
    for name in PROFILE_MARKET_FIELDS:
        named = told.select(F.col("_text").alias(f"_t_{name}"), F.col("_match").alias(f"_m_{name}"))
        df = df.join(named, F.col(name) == F.col(f"_t_{name}"), "left").drop(f"_t_{name}")
        match = F.col(f"_m_{name}")
        matches.append(
            F.when(
                match.isNotNull(),
                F.struct(match["market"], match["confidence"], match["matched_text"], F.lit(name).alias("field")),
            )
        )
    every = F.array_compact(F.array(*matches))
    df = df.withColumn("_matches", every)
    exact = F.filter("_matches", lambda m: m["confidence"] == "exact")
    return df.withColumn(out, F.coalesce(F.get(exact, F.lit(0)), F.get("_matches", F.lit(0)))).drop(
        "_matches", *[f"_m_{name}" for name in PROFILE_MARKET_FIELDS]
    )
