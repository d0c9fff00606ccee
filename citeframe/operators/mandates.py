"""Screening mandates: validation, criteria rows, and versioned batch edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import spec, vocab
from ..functions.plans import explode_computed
from ..functions.text import single_spaced, strip
from ..spec import literal_map
from .checks import accepted, error_list, rejected
from .vocabulary import _market_map

# Limits of a mandate form.
MAX_NAME_CHARS = 120
MAX_DESCRIPTION_CHARS = 2000
MAX_LIST_ITEMS = 50
MAX_ITEM_CHARS = 120
MAX_LIMIT = 1e12

# Criteria keys, metrics and the profile field each one is read from.
CRITERIA_KEYS = [
    "schema_version", "asset_types", "target_markets", "excluded_markets", "deal_size", "key_metrics", "leverage",
    "preferences",
]
METRICS = [
    "cap_rate", "occupancy_rate", "noi", "annual_revenue", "operating_expenses", "units", "square_feet", "year_built",
]
PROFILE_FIELDS = {
    "asset_types": "property_type",
    "target_markets": "market",
    "excluded_markets": "market",
    "deal_size": "asking_price",
    "leverage.max_ltv": "ltv",
    "leverage.max_interest_rate": "interest_rate",
    **{f"key_metrics.{name}": name for name in METRICS},
}
LISTS = ["asset_types", "target_markets", "excluded_markets", "preferences"]

NO_OBJECT = "criteria: not an object"

# Fixed value: the name of the example mandate; its content is only an example.
DEMO_NAME = "Demo - Sun Belt Value-Add Multifamily"
DEMO_DESCRIPTION = "Shows what a mandate can hold. Not a policy of any fund."
DEMO_CRITERIA = (
    '{"schema_version": 1, "asset_types": ["Industrial", "Self-Storage"], "target_markets": ["Memphis", "Savannah"], '
    '"deal_size": {"min": 3000000, "max": 40000000}, "key_metrics": {"square_feet": {"min": 50000}}, '
    '"leverage": {"max_interest_rate": 8}, "preferences": ["Close to a port"]}'
)

_SHAPE = (
    "schema_version string, asset_types array<string>, target_markets array<string>, excluded_markets array<string>, "
    "deal_size map<string,string>, key_metrics map<string,map<string,string>>, leverage map<string,string>, "
    "preferences array<string>"
)
_EMPTY = "array<string>"


def tidy_list(items: Column) -> Column:
    """Single-spaced entries, blanks dropped, repeats (ignoring case) dropped keeping
    the first spelling and the order."""
    spaced = F.filter(F.transform(items, single_spaced), lambda x: x != "")
    return F.filter(
        spaced,
        lambda x, i: ~F.exists(F.slice(spaced, 1, i), lambda earlier: F.lower(earlier) == F.lower(x)),
    )


def parse_criteria(df: DataFrame, criteria: str = "criteria") -> DataFrame:
    """Adds `_c` (loosely typed criteria), `_keys` and tidied lists `_<list>`."""
    df = df.withColumn("_c", F.from_json(criteria, _SHAPE)).withColumn("_keys", F.json_object_keys(F.col(criteria)))
    for name in LISTS:
        df = df.withColumn(
            f"_{name}",
            tidy_list(F.coalesce(F.col(f"_c.{name}"), F.array().cast(_EMPTY))),
        )
    return df


def canonical_lists(df: DataFrame) -> DataFrame:
    """Adds canonical names per list (`_k_<list>`) and the entries nobody knows
    (`_u_<list>`). Canonical names stand in for entries in order, once each."""
    types = literal_map({k: v for k, v in vocab.exact_types().items() if k not in vocab.NOT_MANDATE_PHRASES})
    df = df.withColumn("_named_asset_types", F.transform("_asset_types", lambda x: F.struct(
        x.alias("entry"), F.try_element_at(types, _plain_key(x)).alias("name"))))
    for name in ("target_markets", "excluded_markets"):
        df = df.withColumn(f"_named_{name}", F.transform(f"_{name}", lambda x: F.struct(x.alias("entry"), _market_name(x).alias("name"))))
    for name in ("asset_types", "target_markets", "excluded_markets"):
        named = F.col(f"_named_{name}")
        df = df.withColumn(
            f"_k_{name}",
            F.array_distinct(F.transform(F.filter(named, lambda n: n["name"].isNotNull()), lambda n: n["name"])),
        ).withColumn(
            f"_u_{name}", F.transform(F.filter(named, lambda n: n["name"].isNull()), lambda n: n["entry"])
        ).drop(f"_named_{name}")
    return df


def _plain_tidy(text: Column) -> Column:
    """`vocabulary.tidy` for use inside lambdas (lower case is enough: every
    vocabulary name is ASCII)."""
    x = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[‐-―]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\s,/-]", " "), r"(?U)\s+", " "))


def _plain_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(_plain_tidy(text), "[-/, ]+", " "))


def _market_name(text: Column) -> Column:
    from .vocabulary import _as_key, _pieces, _states_of

    parts = _pieces(_plain_tidy(text))

    def with_state(p: Column) -> Column:
        place, states = F.get(p, F.lit(0)), _states_of(F.get(p, F.lit(1)))
        candidates = F.concat(
            F.transform(states, lambda s: _as_key(F.concat(place, F.lit(" "), s))), F.array(_as_key(place))
        )
        hits = F.filter(
            F.transform(candidates, lambda c: F.try_element_at(_market_map(), c)),
            lambda m: m.isNotNull() & F.arrays_overlap(m["states"], states),
        )
        return F.when(F.size(p) == 2, F.get(hits, F.lit(0))["market"])

    whole = F.try_element_at(_market_map(), _plain_key(text))["market"]
    return F.coalesce(whole, F.get(F.transform(F.array(parts), with_state), F.lit(0)))


def _number(value: Column) -> Column:
    return value.try_cast("double")


def _has_key(name: str) -> Column:
    return F.coalesce(F.array_contains("_keys", name), F.lit(False))


def _range_problem(limits: Column, label: Column) -> Column:
    """First problem of a min/max map, or null."""
    low, high = F.try_element_at(limits, F.lit("min")), F.try_element_at(limits, F.lit("max"))
    a, b = _number(low), _number(high)

    def odd(text: Column, number: Column) -> Column:
        return text.isNotNull() & (number.isNull() | F.isnan(number) | (F.abs(number) > MAX_LIMIT))

    unknown = F.size(F.array_except(F.map_keys(limits), F.array(F.lit("min"), F.lit("max")))) > 0
    return (
        F.when(unknown, F.concat(label, F.lit(": unknown key")))
        .when(odd(low, a) | odd(high, b), F.concat(label, F.lit(": not a usable number")))
        .when(low.isNull() & high.isNull(), F.concat(label, F.lit(": needs a min, a max, or both")))
        .when(a > b, F.concat(label, F.lit(": min is larger than max")))
    )


def _bounds(limits: Column) -> Column:
    return F.array_compact(
        F.array(
            _number(F.try_element_at(limits, F.lit("min"))), _number(F.try_element_at(limits, F.lit("max")))
        )
    )


def _metric_problem(name: Column, limits: Column) -> Column:
    path = F.concat(F.lit("key_metrics."), name)
    bounds = _bounds(limits)
    return F.coalesce(
        F.when(~name.isin(METRICS), F.concat(path, F.lit(": not a metric"))),
        _range_problem(limits, path),
        F.when(
            name.isin("units", "year_built") & F.exists(bounds, lambda b: b != F.floor(b)),
            F.concat(path, F.lit(": not a whole number")),
        )
        .when(
            name.isin("annual_revenue", "operating_expenses", "units", "square_feet") & F.exists(bounds, lambda b: b < 0),
            F.concat(path, F.lit(": negative")),
        )
        .when(
            (name == "year_built") & F.exists(bounds, lambda b: (b < 1700) | (b > 2100)),
            F.concat(path, F.lit(": not a year between 1700 and 2100")),
        )
        .when(
            name.isin("cap_rate", "occupancy_rate") & F.exists(bounds, lambda b: (b < 0) | (b > 100)),
            F.concat(path, F.lit(": not a percentage")),
        ),
    )


def validate_mandates(df: DataFrame) -> DataFrame:
    """Adds `errors`, and `asset_types`, `target_markets`, `excluded_markets` in
    canonical form. Reads name, description and the criteria JSON, whose text is checked
    once however many mandates share it (and comes back as with `once_per_text`)."""
    texts = df.select(F.col("criteria").alias("_text"))
    told = _check_criteria(texts.filter("_text is not null").distinct().select("_text", F.col("_text").alias("criteria")))
    name = single_spaced(F.coalesce("name", F.lit("")))
    row_checks = error_list(
        {
            "name: not 1 to 120 characters": F.length(name).between(1, MAX_NAME_CHARS),
            "description: over 2,000 characters": F.col("description").isNull()
            | (F.length(strip(F.col("description"))) <= MAX_DESCRIPTION_CHARS),
        }
    )
    none = F.array().cast(_EMPTY)
    found = F.coalesce("_problems", F.array(F.lit(NO_OBJECT)))  # null is no object either
    added = {"errors": F.concat(row_checks, found)} | {n: F.coalesce(f"_k_{n}", none) for n in LISTS[:3]}
    joined = df.join(told, F.col("criteria") == F.col("_text"), "left")
    return joined.select(*[c for c in df.columns if c not in added], *[c.alias(n) for n, c in added.items()])


def _check_criteria(texts: DataFrame) -> DataFrame:
    """`_text`, `_problems` and canonical names per list, for distinct criteria texts."""
    df = canonical_lists(parse_criteria(texts)).withColumn("_doc", F.try_parse_json(F.col("criteria")))
    doc = F.col("_doc")
    no_text = F.lit(None).cast("string")

    def list_problems(name: str) -> list[Column]:
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))
        # An explicit null list is refused, an absent one is an empty list.
        problems = [
            F.when(
                ~F.coalesce(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True)) | (kind == "ARRAY<VOID>") & (F.size(f"_c.{name}") > 0),
                F.lit(f"{name}: not a list of text"),
            ),
            F.when(F.size(f"_c.{name}") > MAX_LIST_ITEMS, F.lit(f"{name}: more than {MAX_LIST_ITEMS} entries")),
            F.when(
                F.exists(f"_{name}", lambda x: F.length(x) > MAX_ITEM_CHARS),
                F.lit(f"{name}: entry over {MAX_ITEM_CHARS} characters"),
            ),
        ]
        if name != "preferences":
            problems.append(
                F.when(
                    F.size(f"_u_{name}") > 0,
                    F.concat(F.lit(f"{name}: unknown "), F.array_join(f"_u_{name}", ", ")),
                )
            )
        return problems

    def kind_of(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))

    def malformed(name: str, may_be_null: bool) -> Column:
        """A section that is there but is no object; the loose reader would drop it."""
        kind = kind_of(f"$.{name}")
        fine = kind.startswith("OBJECT") | (F.lit(may_be_null) & (kind == "VOID"))
        return F.when(~F.coalesce(fine, F.lit(True)), F.lit(f"{name}: not an object"))

    entries = F.map_entries(F.from_json("criteria", "key_metrics map<string,string>")["key_metrics"])
    loose_metrics = F.transform(
        F.filter(entries, lambda e: ~F.coalesce(F.trim(e["value"]).startswith("{"), F.lit(False))),
        lambda e: F.concat(F.lit("key_metrics."), e["key"], F.lit(": not a range")),
    )
    leverage = F.col("_c.leverage")
    limits = ["max_ltv", "max_interest_rate"]
    lever_values = [F.try_element_at(leverage, F.lit(name)) for name in limits]
    lever_odd = F.lit(False)
    for value in lever_values:
        lever_odd = lever_odd | (value.isNotNull() & ~F.coalesce(_number(value).between(0, 100), F.lit(False)))
    leverage_problem = (
        F.when(
            F.size(F.array_except(F.map_keys(leverage), F.array(*[F.lit(x) for x in limits]))) > 0,
            F.lit("leverage: unknown key"),
        )
        .when(lever_odd, F.lit("leverage: not a percentage"))
        .when(lever_values[0].isNull() & lever_values[1].isNull(), F.lit("leverage: needs a limit"))
    )
    deal_size = F.col("_c.deal_size")
    size_problem = F.coalesce(
        _range_problem(deal_size, F.lit("deal_size")),
        F.when(F.exists(_bounds(deal_size), lambda b: b < 0), F.lit("deal_size: negative")),
    )
    metrics = F.filter(
        F.transform(
            F.filter(F.map_entries("_c.key_metrics"), lambda e: e["value"].isNotNull()), lambda e: _metric_problem(e["key"], e["value"])
        ),
        lambda e: e.isNotNull(),
    )
    both = F.array_sort(F.array_intersect("_k_target_markets", "_k_excluded_markets"))
    hard = (
        (F.size("_asset_types") > 0)
        | (F.size("_target_markets") > 0)
        | (F.size("_excluded_markets") > 0)
        | deal_size.isNotNull()
        | F.coalesce(F.size("_c.key_metrics") > 0, F.lit(False))
        | leverage.isNotNull()
    )
    row_checks = error_list({NO_OBJECT: F.col("_keys").isNotNull()})
    unknown = F.transform(
        F.array_except(F.coalesce("_keys", F.array().cast(_EMPTY)), F.array(*[F.lit(k) for k in CRITERIA_KEYS])),
        lambda k: F.concat(k, F.lit(": not allowed")),
    )
    singles = [
        F.when(
            ~F.coalesce((F.col("_c.schema_version") == "1") & (kind_of("$.schema_version") == "BIGINT"), ~_has_key("schema_version")),
            F.lit("schema_version: not 1"),
        ),
        malformed("deal_size", True),
        malformed("leverage", True),
        malformed("key_metrics", False),
        *[p for n in LISTS for p in list_problems(n)],
        F.when(deal_size.isNotNull(), size_problem),
        F.when(leverage.isNotNull(), leverage_problem),
        F.when(F.size(both) > 0, F.concat(F.lit("markets: both targeted and excluded: "), F.array_join(both, ", "))),
        F.when(F.col("_keys").isNotNull() & ~hard, F.lit("criteria: needs at least one hard criterion")),
        no_text,
    ]
    errors = F.concat(
        row_checks,
        unknown,
        F.array_compact(F.array(*singles)),
        F.coalesce(loose_metrics, F.array().cast(_EMPTY)),
        F.coalesce(metrics, F.array().cast(_EMPTY)),
    )
    return df.select("_text", errors.alias("_problems"), *[f"_k_{n}" for n in LISTS[:3]])


def problem_summary(errors: Column, limit: int = 3) -> Column:
    """The first problems and how many more there are."""
    more = F.size(errors) - F.lit(limit)
    shown = F.array_join(F.slice(errors, 1, limit), "; ")
    return F.when(more > 0, F.concat(shown, F.lit("; and "), more.cast("string"), F.lit(" more"))).otherwise(shown)


def _value_free(error: Column) -> Column:
    """A problem without the values it names."""
    return F.regexp_replace(error, r"(unknown|excluded:) .*$", "$1")


def criteria_rows(valid: DataFrame) -> DataFrame:
    """One row per hard criterion of a valid mandate: mandate_id, version, criterion,
    field_name, min, max, allowed. `valid` comes from `validate_mandates`."""
    df = parse_criteria(valid)
    text = F.lit(None).cast("array<string>")
    none = F.lit(None).cast("double")

    def row(criterion: Column, field: Column, low: Column, high: Column, allowed: Column) -> Column:
        return F.struct(
            criterion.alias("criterion"), field.alias("field_name"), low.alias("min"), high.alias("max"),
            allowed.alias("allowed"),
        )

    lists = [
        F.when(F.size(n) > 0, row(F.lit(n), F.lit(PROFILE_FIELDS[n]), none, none, F.col(n)))
        for n in ("asset_types", "target_markets", "excluded_markets")
    ]
    deal_size = F.col("_c.deal_size")
    leverage = F.col("_c.leverage")
    get = F.try_element_at
    singles = [
        *lists,
        F.when(
            deal_size.isNotNull(),
            row(
                F.lit("deal_size"), F.lit("asking_price"), _number(get(deal_size, F.lit("min"))),
                _number(get(deal_size, F.lit("max"))), text,
            ),
        ),
        *[
            F.when(
                get(leverage, F.lit(n)).isNotNull(),
                row(
                    F.lit(f"leverage.{n}"), F.lit(PROFILE_FIELDS[f"leverage.{n}"]), none, _number(get(leverage, F.lit(n))),
                    text,
                ),
            )
            for n in ("max_ltv", "max_interest_rate")
        ],
    ]
    metrics = F.transform(
        F.coalesce(F.map_entries("_c.key_metrics"), F.array().cast("array<struct<key:string,value:map<string,string>>>")),
        lambda e: row(
            F.concat(F.lit("key_metrics."), e["key"]), e["key"], _number(get(e["value"], F.lit("min"))),
            _number(get(e["value"], F.lit("max"))), text,
        ),
    )
    df = df.withColumn("_rows", F.concat(F.array_compact(F.array(*singles)), metrics))
    return explode_computed(df, "_rows", "_row", keep=["mandate_id", "version"]).select("mandate_id", "version", "_row.*")


def check_criteria_mapping(spark) -> DataFrame:
    """Criteria that point at a profile field that is missing or, for a limit, not
    numeric; example markets outside the vocabulary. Empty when all is well."""
    kinds = dict(spec.REPE_FIELDS)
    rows = [(c, f) for c, f in PROFILE_FIELDS.items() if f not in kinds]
    rows += [(c, f) for c, f in PROFILE_FIELDS.items() if c.startswith(("key_metrics", "leverage")) and kinds.get(f) == "text"]
    return spark.createDataFrame(rows, "criterion string, field_name string")


# --- Listing and selecting ---------------------------------------------------------


def list_mandates(mandates: DataFrame, organization_id=None, include_archived: bool = False) -> tuple[DataFrame, DataFrame]:
    """(readable mandates ordered by name, how many rows per organization were left
    out and why). One unreadable row never hides the others."""
    rows = mandates if organization_id is None else mandates.filter(F.col("organization_id") == organization_id)
    if not include_archived:
        rows = rows.filter(~F.col("is_archived"))
    checked = validate_mandates(rows)
    readable = accepted(checked)
    skipped = (
        rejected(checked)
        .groupBy("organization_id")
        .agg(
            F.count(F.lit(1)).alias("skipped"),
            F.min_by(problem_summary(F.transform("errors", _value_free)), "mandate_id").alias("first_problem"),
        )
    )
    return readable.orderBy("organization_id", "name"), skipped


def select_for_screening(requests: DataFrame, mandates: DataFrame) -> DataFrame:
    """Per request (organization_id, mandate_id): the outcome and, when it can be
    used, the version. Another tenant's mandate is not found."""
    checked = validate_mandates(mandates).select(
        "organization_id", "mandate_id", "version", "is_archived", F.size("errors").alias("_errors")
    )
    outcome = (
        F.when(F.col("_errors").isNull(), F.lit("not_found"))
        .when(F.col("_errors") > 0, F.lit("unreadable"))
        .when(F.col("is_archived"), F.lit("archived"))
        .otherwise(F.lit("selected"))
    )
    return requests.join(checked, ["organization_id", "mandate_id"], "left").select(
        *requests.columns, outcome.alias("outcome"), F.when(outcome == "selected", F.col("version")).alias("version")
    )


# --- Batch changes -------------------------------------------------------------------


# Keys of an edit, all required, and keys a client may send back.
EDIT_KEYS = ["name", "description", "criteria", "is_demo", "version"]
READ_ONLY_KEYS = ["id", "organization_id", "created_at", "updated_at", "is_archived"]


def read_edits(requests: DataFrame) -> DataFrame:
    """Edits from JSON (organization_id, mandate_id, edit_ord, payload), with
    `payload_errors`. An edit replaces the whole mandate: every key must be there,
    read-only keys are dropped, any other key is an error."""
    keys = F.json_object_keys("payload")
    allowed = F.array(*[F.lit(k) for k in EDIT_KEYS + READ_ONLY_KEYS])
    required = F.array(*[F.lit(k) for k in EDIT_KEYS])
    problems = F.concat(
        F.transform(F.array_except(keys, allowed), lambda k: F.concat(k, F.lit(": not allowed"))),
        F.transform(F.array_except(required, keys), lambda k: F.concat(k, F.lit(": missing"))),
    )
    values = F.from_json("payload", "name string, description string, is_demo boolean, version int")
    return requests.select(
        "organization_id", "mandate_id", "edit_ord", values["version"].alias("version"), values["name"].alias("name"),
        values["description"].alias("description"), F.get_json_object("payload", "$.criteria").alias("criteria"),
        values["is_demo"].alias("is_demo"),
        F.coalesce(problems, F.array(F.lit("edit: not an object"))).alias("payload_errors"),
    )


def _name_key(name: Column) -> Column:
    return F.lower(single_spaced(name))


def apply_edits(mandates: DataFrame, edits: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(mandates after the batch, every edit with its outcome and errors). An edit is
    validated first. It applies when its tenant and version match, the mandate is
    active and no other active mandate of the organization has its name; of several
    valid edits of one version, and of several edits that want one name, the first (by
    edit_ord) wins. A name that an edit gives up stays taken until the next batch.
    `edits`: organization_id, mandate_id, version, edit_ord, name, description,
    criteria, is_demo and, from `read_edits`, payload_errors.

    Winners are partial aggregates: a mandate with very many competing edits is
    reduced before the shuffle. Joins are null-safe, so an edit without a key gets an
    outcome too.
    """
    key = ["organization_id", "mandate_id"]
    same = lambda *names: [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    under = lambda df, *names: df.withColumnsRenamed({n: f"_{n}" for n in names})
    checked = validate_mandates(edits)
    if "payload_errors" in edits.columns:
        checked = checked.withColumn("errors", F.concat("payload_errors", "errors"))
    current = mandates.select(*key, F.col("version").alias("_now"), "is_archived")
    judged = checked.join(under(current, *key), same(*key), "left").drop(*[f"_{k}" for k in key])
    standing = (
        F.when(F.size("errors") > 0, F.lit("invalid"))
        .when(F.col("_now").isNull(), F.lit("not_found"))
        .when(F.col("is_archived"), F.lit("archived"))
        .when(~F.col("_now").eqNullSafe(F.col("version")), F.lit("conflict"))
    )
    judged = judged.withColumn("outcome", standing).withColumn("_name", _name_key(F.col("name"))).drop("_now", "is_archived")
    # Names of other active mandates.
    names = mandates.filter(~F.col("is_archived")).groupBy(
        F.col("organization_id").alias("_organization_id"), _name_key(F.col("name")).alias("_taken")
    ).agg(F.min("mandate_id").alias("_least"), F.max("mandate_id").alias("_most"))
    judged = judged.join(names, [F.col("organization_id").eqNullSafe(F.col("_organization_id")), F.col("_name") == F.col("_taken")], "left")
    other = (F.col("_least") != F.col("mandate_id")) | (F.col("_most") != F.col("mandate_id"))
    judged = judged.withColumn("outcome", F.coalesce("outcome", F.when(other, F.lit("duplicate_name"))))
    judged = judged.drop("_organization_id", "_taken", "_least", "_most")
    for group, refusal in ((key, "conflict"), (["organization_id", "_name"], "duplicate_name")):
        first = judged.filter(F.col("outcome").isNull()).groupBy(*group).agg(F.min("edit_ord").alias("_first"))
        joined = judged.join(under(first, *group), [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in group], "left")
        late = F.col("outcome").isNull() & (F.col("edit_ord") != F.col("_first"))
        judged = joined.withColumn("outcome", F.when(late, F.lit(refusal)).otherwise(F.col("outcome"))).drop(
            "_first", *[f"_{n}" for n in group]
        )
    judged = judged.withColumn("outcome", F.coalesce("outcome", F.lit("applied")))
    applied = _canonical(judged.filter(F.col("outcome") == "applied")).select(
        *[F.col(k).alias(f"_{k}") for k in key],
        F.struct(single_spaced(F.col("name")).alias("name"), "description", "criteria", "is_demo").alias("_new"),
    )
    merged = mandates.join(applied, same(*key), "left")
    changed = F.col("_new").isNotNull()
    replaced = {
        name: F.when(changed, F.col(f"_new.{name}")).otherwise(F.col(name))
        for name in ("name", "description", "criteria", "is_demo")
    }
    replaced["version"] = F.when(changed, F.col("version") + 1).otherwise(F.col("version"))
    replaced["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    columns = [c for c in judged.columns if c != "_name"]
    return merged.withColumns(replaced).select(*mandates.columns), judged.select(*columns)


def _canonical(valid: DataFrame) -> DataFrame:
    """Stored form of valid criteria: canonical lists, tidied preferences, bounds that
    are set, whole numbers without a fraction."""
    df = parse_criteria(valid)

    def number(text: Column) -> Column:
        value = _number(text)
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.parse_json(F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string")))

    def limits(values: Column, names: list[str]) -> Column:
        return F.struct(*[number(F.try_element_at(values, F.lit(n))).alias(n) for n in names])

    metrics = F.transform_values("_c.key_metrics", lambda _, v: limits(v, ["min", "max"]))
    deal_size, leverage = F.col("_c.deal_size"), F.col("_c.leverage")
    stored = F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"), "asset_types", "target_markets", "excluded_markets",
            F.when(deal_size.isNotNull(), limits(deal_size, ["min", "max"])).alias("deal_size"),
            metrics.alias("key_metrics"),
            F.when(leverage.isNotNull(), limits(leverage, ["max_ltv", "max_interest_rate"])).alias("leverage"),
            F.col("_preferences").alias("preferences"),
        )
    )
    return df.withColumn("criteria", stored).drop("_c", "_keys", *[f"_{n}" for n in LISTS])


def archive(mandates: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mandates after archiving, outcome per request). Archiving again changes
    nothing, versions stay, unreadable mandates can be archived too."""
    key = ["organization_id", "mandate_id"]
    wanted = requests.select(*key).distinct().withColumn("_archive", F.lit(True))
    after = (
        mandates.join(wanted, key, "left")
        .withColumn("is_archived", F.col("is_archived") | F.coalesce("_archive", F.lit(False)))
        .drop("_archive")
    )
    checked = validate_mandates(mandates).select(*key, "version", F.col("errors").alias("_errors"))
    outcome = requests.join(checked, key, "left").select(
        *requests.columns,
        F.when(F.col("_errors").isNull(), F.lit("not_found")).otherwise(F.lit("archived")).alias("outcome"),
        "version",
        F.when(F.size("_errors") > 0, problem_summary(F.col("_errors"))).alias("problem"),
    )
    return after, outcome


def duplicate_names(mandates: DataFrame) -> DataFrame:
    """Active mandates whose name (ignoring case) another active mandate of the
    organization took first (lowest created_ord)."""
    active = mandates.filter(~F.col("is_archived")).withColumn("_name", F.lower("name"))
    first = active.groupBy("organization_id", "_name").agg(F.min("created_ord").alias("_first"))
    return (
        active.join(first, ["organization_id", "_name"])
        .filter(F.col("created_ord") != F.col("_first"))
        .drop("_name", "_first")
    )


def insert_absent(mandates: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose name no active mandate of their organization has."""
    taken = mandates.filter(~F.col("is_archived")).select("organization_id", F.lower("name").alias("_name")).distinct()
    return candidates.withColumn("_name", F.lower("name")).join(taken, ["organization_id", "_name"], "left_anti").drop("_name")


def create_mandates(inputs: DataFrame, organizations: DataFrame, mandates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new rows at version 1 with canonical criteria, refused inputs with errors). A name
    that an active one of `mandates`, or an earlier valid input (by mandate_id), has in the
    organization is refused."""
    known = organizations.select(F.col("organization_id").alias("_organization"), F.lit(True).alias("_known")).distinct()
    checked = validate_mandates(inputs).join(known, F.col("organization_id") == F.col("_organization"), "left")
    none = F.array().cast(_EMPTY)
    unknown = F.when(F.col("_known").isNull(), F.array(F.lit("organization: does not exist"))).otherwise(none)
    checked = checked.withColumn("errors", F.concat("errors", unknown)).withColumn("_name", _name_key(F.col("name"))).drop("_known", "_organization")
    first = checked.filter(F.size("errors") == 0).groupBy(F.col("organization_id").alias("_organization"), F.col("_name").alias("_wanted")).agg(
        F.min("mandate_id").alias("_first")
    )
    same = (F.col("organization_id") == F.col("_organization")) & (F.col("_name") == F.col("_wanted"))
    checked = checked.join(first, same, "left").drop("_organization", "_wanted")
    late = (F.size("errors") == 0) & (F.col("mandate_id") != F.col("_first"))
    if mandates is not None:
        active = mandates.filter(~F.col("is_archived"))
        names = active.select(F.col("organization_id").alias("_organization"), _name_key(F.col("name")).alias("_wanted"), F.lit(True).alias("_used")).distinct()
        checked = checked.join(names, same, "left").drop("_organization", "_wanted")
        late = late | ((F.size("errors") == 0) & F.col("_used").isNotNull())
    taken = F.when(late, F.array(F.lit("name: already in use"))).otherwise(none)
    checked = checked.withColumn("errors", F.concat("errors", taken)).drop("_name", "_first", "_used")
    created = (
        _canonical(accepted(checked))
        .withColumn("name", single_spaced(F.col("name")))
        .withColumn("version", F.lit(1))
        .withColumn("is_archived", F.lit(False))
    )
    return created, rejected(checked)
