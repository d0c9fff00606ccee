"""Strict validation of proposal JSON, and its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import spec
from ..functions.plans import explode_computed, filter_computed
from ..functions.text import placeholder_to_null, strip

# Error messages kept per row, flags a model may set.
MAX_ERRORS = 25
FLAGS = ["conflicting", "uncertain"]

VALUE_FIELDS = [name for name, _ in spec.REPE_FIELDS]
TYPES = dict(spec.REPE_FIELDS)
LISTS = ["missing_information", "evidence", "field_flags"]
EVIDENCE_KEYS = ["field_name", "value", "source_document", "page_number", "snippet"]
FLAG_KEYS = ["field_name", "flag", "note"]


def _at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _type(item: Column) -> Column:
    """The JSON type of a variant: null when absent, VOID for a JSON null."""
    return F.schema_of_variant(item)


def _text(item: Column) -> Column:
    return F.when(_type(item) == "STRING", strip(F.try_variant_get(item, "$", "string")))


def _is_number(kind: Column) -> Column:
    return (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")


def _field_errors(doc: Column, name: str) -> Column:
    item = _at(doc, f"$.{name}")
    kind = _type(item)
    blank = (kind == "STRING") & placeholder_to_null(_text(item), spec.PLACEHOLDERS).isNull()
    number = F.try_variant_get(item, "$", "double")
    if TYPES[name] == "text":
        wrong = ~kind.isin("STRING", "VOID")
        message = "not text"
        out = F.lit(False)
    else:
        accepted = (kind == "BIGINT") if TYPES[name] == "int" else _is_number(kind)
        finite = F.abs(number) < F.lit(float("inf"))
        wrong = ~(accepted & F.coalesce(finite, F.lit(False))) & (kind != "VOID") & ~blank
        message = "not a whole number" if TYPES[name] == "int" else "not a number"
        lower, upper = spec.BOUNDS.get(name, (None, None))
        out = F.lit(False)
        if lower is not None:
            out = out | (number < float(lower))
        if upper is not None:
            out = out | (number > float(upper))
        out = accepted & out
    return F.when(kind.isNotNull() & wrong, F.lit(f"{name}: {message}")).when(
        kind.isNotNull() & out, F.lit(f"{name}: out of bounds")
    )


def _items(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "array<variant>")


def _keys_ok(item: Column, keys: list[str]) -> Column:
    found = F.json_object_keys(F.to_json(item))
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.coalesce((F.size(F.array_except(found, wanted)) == 0) & (F.size(F.array_except(wanted, found)) == 0), F.lit(False))


def _page(item: Column) -> Column:
    """A whole page number; numeric text and whole decimals are read as numbers."""
    number = F.try_variant_get(item, "$.page_number", "double")
    return F.when(number == F.floor(number), number)


def _evidence_ok(item: Column) -> Column:
    value = _at(item, "$.value")
    some_value = (F.length(_text(value)) > 0) | _is_number(_type(value))
    return (
        _keys_ok(item, EVIDENCE_KEYS)
        & F.coalesce(_text(_at(item, "$.field_name")).isin(VALUE_FIELDS), F.lit(False))
        & F.coalesce(some_value, F.lit(False))
        & F.coalesce(F.length(_text(_at(item, "$.source_document"))) > 0, F.lit(False))
        & F.coalesce(F.length(_text(_at(item, "$.snippet"))) > 0, F.lit(False))
        & F.coalesce(_page(item) >= 1, F.lit(False))
    )


def _flag_ok(item: Column) -> Column:
    return (
        _keys_ok(item, FLAG_KEYS)
        & F.coalesce(_text(_at(item, "$.field_name")).isin(VALUE_FIELDS), F.lit(False))
        & F.coalesce(_text(_at(item, "$.flag")).isin(FLAGS), F.lit(False))
        & F.coalesce(F.length(_text(_at(item, "$.note"))) > 0, F.lit(False))
    )


def _list_errors(doc: Column, name: str, ok) -> Column:
    items = _items(doc, name)
    bad = F.filter(
        F.transform(items, lambda item, i: F.when(~ok(item), F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(": malformed")))),
        lambda e: e.isNotNull(),
    )
    not_list = F.array(F.lit(f"{name}: not a list"))
    present = _type(_at(doc, f"$.{name}"))
    return F.when(present.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(bad, not_list))


def validate_proposals(df: DataFrame, json: str, complete: bool = True) -> DataFrame:
    """Adds `errors` (`path: message`, at most 25). With `complete`, every value
    field and list must be present (null is allowed for values) and nothing else;
    without it, any subset of value fields and nothing else (reviewer corrections).
    Types are tested on the parsed document before any cast."""
    allowed = F.array(*[F.lit(k) for k in VALUE_FIELDS + (LISTS if complete else [])])
    df = df.withColumn("_doc", F.try_parse_json(F.col(json))).withColumn("_keys", F.json_object_keys(F.col(json)))
    doc = F.col("_doc")
    extra = F.transform(F.array_except("_keys", allowed), lambda k: F.concat(k, F.lit(": not allowed")))
    absent = F.transform(F.array_except(allowed, "_keys"), lambda k: F.concat(k, F.lit(": missing")))
    parts = [extra, F.array_compact(F.array(*[_field_errors(doc, name) for name in VALUE_FIELDS]))]
    if complete:
        parts += [
            absent,
            _list_errors(doc, "missing_information", lambda item: F.coalesce(_type(item) == "STRING", F.lit(False))),
            _list_errors(doc, "evidence", _evidence_ok),
            _list_errors(doc, "field_flags", _flag_ok),
        ]
    readable = doc.isNotNull() & F.col("_keys").isNotNull()
    errors = F.when(readable, F.slice(F.concat(*parts), 1, MAX_ERRORS)).otherwise(
        F.array(F.lit("document: not a JSON object"))
    )
    return df.withColumn("errors", errors).drop("_doc", "_keys")


def proposal_values(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """Value rows of accepted proposals; placeholders such as "N/A" become null.
    `stated` tells a field given as null from one left out."""
    # One row per key before anything is read: an array of all fields becomes one method of
    # 20 KB, which the JVM never compiles.
    members = F.try_variant_get(F.try_parse_json(F.col(json)), "$", "map<string,variant>")
    entries = explode_computed(df.withColumn("_members", F.map_entries(members)), "_members", "_member", keep=keys)
    name, item = F.col("_member.key"), F.col("_member.value")
    read = filter_computed(entries.filter(name.isin(VALUE_FIELDS)), item.isNotNull()).select(
        *keys, name.alias("field_name"), item.alias("_item"), _type(item).alias("_kind")
    )
    is_text = F.col("field_name").isin([field for field in VALUE_FIELDS if TYPES[field] == "text"])
    number = F.try_variant_get(F.col("_item"), "$", "double")
    text = F.when(F.col("_kind") == "STRING", strip(F.try_variant_get(F.col("_item"), "$", "string")))
    return (
        read.withColumn("_text", F.when(is_text, text))
        .select(
            *keys, "field_name", F.when(~is_text & _is_number(F.col("_kind")), number).alias("num_value"),
            placeholder_to_null(F.col("_text"), spec.PLACEHOLDERS).alias("text_value"), F.lit(True).alias("stated"),
        )
    )


def proposal_citations(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    items = F.transform(
        _items(F.try_parse_json(F.col(json)), "evidence"),
        lambda item: F.struct(
            _text(_at(item, "$.field_name")).alias("field_name"),
            strip(F.try_variant_get(item, "$.value", "string")).alias("value"),
            _text(_at(item, "$.source_document")).alias("source_document"),
            _page(item).cast("int").alias("page_number"),
            _text(_at(item, "$.snippet")).alias("snippet"),
        ),
    )
    return explode_computed(df.withColumn("_items", items), "_items", "_item", pos="cite_ord", keep=keys).select(
        *keys, "cite_ord", "_item.*"
    )


def proposal_flags(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    items = F.transform(
        _items(F.try_parse_json(F.col(json)), "field_flags"),
        lambda item: F.struct(
            _text(_at(item, "$.field_name")).alias("field_name"),
            _text(_at(item, "$.flag")).alias("flag"),
            _text(_at(item, "$.note")).alias("note"),
        ),
    )
    return explode_computed(df.withColumn("_items", items), "_items", "_item", pos="flag_ord", keep=keys).select(
        *keys, "flag_ord", "_item.*"
    )


def proposal_notes(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    notes = F.try_variant_get(F.try_parse_json(F.col(json)), "$.missing_information", "array<string>")
    return explode_computed(df.withColumn("_items", notes), "_items", "note", pos="note_ord", keep=keys)
