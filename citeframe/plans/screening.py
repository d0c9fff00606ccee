"""Vocabulary and mandate queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import vocab
from ..operators import mandates as md
from ..operators import vocabulary as voc
from ..operators.checks import accepted
from .registry import query, table

# Inputs are made from the vocabulary itself and from keys of the tables; what is
# expected follows from the rule that made an input, not from matching its text.
_PHRASES = vocab.type_phrases()
_USUAL = [row for row in _PHRASES if row[0] == 2]
_CODES = set(vocab.STATES.values())


def _plain_names():
    """(market, name, state) of names that do not end with a state themselves."""
    endings = _CODES | set(vocab.STATES)
    for market, states, names in vocab.market_rows():
        for name in names:
            key = vocab.lookup_key(name)
            if not any(key == e or key.endswith(f" {e}") for e in endings) and key not in vocab.FOREIGN:
                yield market, key.title(), states[len(key) % len(states)]


# (text, market, confidence, strict market); {n} is a number of the row.
MARKETS = [
    case
    for k, (market, name, state) in enumerate(_plain_names())
    for case in [
        [
            (name.upper(), market, "exact", market),
            (f"{name}, {state.upper()}", market, "exact", market),
            (f"{{n}} Harbor Rd, {name}, {state.upper()} 7{k:04d}", market, "exact", None),
            (f"Upper {name}", *((market, "partial") if len(name) >= vocab.MIN_PARTIAL_CHARS else (None, None)), None),
            (f"{name}, HI", None, None, None),
            (f"{name}, Alaska", None, None, None),
            (f"{name}, Kenya", None, None, None),
            (f"Greater {name} Metro Area", market, "exact", None),
        ][k % 8]
    ]
] + [(None, None, None, None), ("  ", None, None, None), ("Nowhere {n}", None, None, None)]


def _sql_values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    return ", ".join(f"({i}, " + ", ".join(lit(v) for v in row) + ")" for i, row in enumerate(rows))


def _spread(spark, sf_dir, texts, shift=0):
    """One text per customer, by key, with the key in the place of {n}."""
    array = F.array(*[F.lit(t) for t in texts])
    text = F.get(array, ((F.col("c_custkey") + shift) % len(texts)).cast("int"))
    return F.replace(text, F.lit("{n}"), F.col("c_custkey").cast("string"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name")


@query(
    "property_types",
    f"""WITH p AS (SELECT * FROM (VALUES {_sql_values(_PHRASES)}) p(id, tier, property_type, phrase)),
    u AS (SELECT * FROM (VALUES {_sql_values(_USUAL)}) u(id, tier, property_type, phrase))
    SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN p.tier = '1' THEN p.property_type ELSE u.property_type END AS property_type
    FROM customer JOIN u ON u.id = c_custkey % {len(_USUAL)} JOIN p ON p.id = (c_custkey * 7 + 3) % {len(_PHRASES)}""",
)
def property_types(spark, sf_dir):
    """Two phrases in one text: one of the first tier wins, else the one named first."""
    usual = _spread(spark, sf_dir, [p for _, _, p in _USUAL])
    phrases = F.array(*[F.lit(p) for _, _, p in _PHRASES])
    other = F.get(phrases, ((F.col("c_custkey") * 7 + 3) % len(_PHRASES)).cast("int"))
    text = F.concat(F.initcap(usual), F.lit(" by "), F.col("c_name"), F.lit(" beside "), other)
    df = _customers(spark, sf_dir).withColumn("text", F.when(F.col("c_custkey") % 11 != 0, text).otherwise(F.col("c_name")))
    return voc.with_loose_type(df, "text").select("c_custkey", "property_type")


@query(
    "strict_property_types",
    f"""WITH p AS (SELECT * FROM (VALUES {_sql_values(_PHRASES)}) p(id, tier, property_type, phrase))
    SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 AND phrase NOT IN ({", ".join(repr(x) for x in vocab.NOT_MANDATE_PHRASES)}) THEN property_type END AS property_type
    FROM customer JOIN p ON p.id = c_custkey % {len(_PHRASES)}""",
)
def strict_property_types(spark, sf_dir):
    phrase = _spread(spark, sf_dir, [p for _, _, p in _PHRASES])
    text = F.when(F.col("c_custkey") % 3 == 0, F.upper(phrase)).when(
        F.col("c_custkey") % 3 == 1, F.replace(phrase, F.lit(" "), F.lit("-"))
    ).otherwise(F.concat(phrase, F.lit(" of "), F.col("c_name")))
    return _customers(spark, sf_dir).select("c_custkey", voc.strict_type(text).alias("property_type"))


_N = len(MARKETS)


@query(
    "market_matches",
    f"""SELECT c_custkey, market, confidence FROM customer
        JOIN (VALUES {_sql_values(MARKETS)}) g(id, text, market, confidence, strict) ON c_custkey % {_N} = id""",
)
def market_matches(spark, sf_dir):
    df = _customers(spark, sf_dir).withColumn("text", _spread(spark, sf_dir, [m[0] for m in MARKETS]))
    return voc.once_per_text(df, "text", "match", voc.with_market_match).select("c_custkey", "match.market", "match.confidence")


@query(
    "strict_markets",
    f"""SELECT c_custkey, strict AS market FROM customer
        JOIN (VALUES {_sql_values(MARKETS)}) g(id, text, market, confidence, strict) ON c_custkey % {_N} = id""",
)
def strict_markets(spark, sf_dir):
    df = _customers(spark, sf_dir).withColumn("text", _spread(spark, sf_dir, [m[0] for m in MARKETS]))
    return voc.with_strict_market(df, "text").select("c_custkey", "market")


@query(
    "profile_markets",
    f"""WITH g AS (SELECT * FROM (VALUES {_sql_values(MARKETS)}) g(id, text, market, confidence, strict)),
    tried AS (
      SELECT c_custkey, f.ord, f.field, g.market, g.confidence FROM customer,
             (VALUES (0, 'market', 0), (1, 'submarket', 7), (2, 'location', 19), (3, 'address', 31)) f(ord, field, shift)
      JOIN g ON g.id = (c_custkey + f.shift) % {_N}
      WHERE NOT (f.field = 'submarket' AND c_custkey % 2 = 0) AND g.market IS NOT NULL),
    picked AS (
      SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY confidence = 'partial', ord) AS r FROM tried)
    SELECT c.c_custkey, p.market, p.confidence, p.field FROM customer c LEFT JOIN picked p ON p.c_custkey = c.c_custkey AND p.r = 1""",
)
def profile_markets(spark, sf_dir):
    def pick(shift):
        return _spread(spark, sf_dir, [m[0] for m in MARKETS], shift)

    profiles = table(spark, sf_dir, "customer").select(
        "c_custkey", pick(0).alias("market"), F.when(F.col("c_custkey") % 2 != 0, pick(7)).alias("submarket"),
        pick(19).alias("location"), pick(31).alias("address"),
    )
    df = voc.with_profile_market(profiles)
    return df.select(
        "c_custkey", F.col("profile_market.market").alias("market"),
        F.col("profile_market.confidence").alias("confidence"), F.col("profile_market.field").alias("field"),
    )


# --- Mandates: generated per customer, one case per key ------------------------------

# (criteria JSON, number of errors, first error)
CRITERIA = [
    ('{"preferences": ["Near rail"]}', 1, "criteria: needs at least one hard criterion"),
    ('{"deal_size": {"min": 9, "max": 4}}', 1, "deal_size: min is larger than max"),
    ('{"deal_size": {"min": null}}', 1, "deal_size: needs a min, a max, or both"),
    ('{"deal_size": {"max": -20}}', 1, "deal_size: negative"),
    ('{"key_metrics": {"noi": {"min": 125000.5}}, "excluded_markets": ["  "]}', 0, None),
    ('{"key_metrics": {"occupancy_rate": {"max": 101}}}', 1, "key_metrics.occupancy_rate: not a percentage"),
    ('{"key_metrics": {"ltv": {"min": 1}}}', 1, "key_metrics.ltv: not a metric"),
    ('{"leverage": {"max_interest_rate": -1}}', 1, "leverage: not a percentage"),
    ('{"leverage": {"max_ltv": null}}', 1, "leverage: needs a limit"),
    ('{"target_markets": ["Tucson", "Boise"], "excluded_markets": ["BOISE"]}', 1, "markets: both targeted and excluded: Boise"),
    ('{"asset_types": ["Retail"], "extra": 0}', 1, "extra: not allowed"),
    ('{"asset_types": ["Castle", "retail", " RETAIL "]}', 1, "asset_types: unknown Castle"),
    ('{"asset_types": ["hotel", "Motel", "Land"], "target_markets": ["Reno", "Tucson"]}', 1, "target_markets: unknown Reno"),
    ('{"asset_types": ["hotel", "Motel", "land"], "target_markets": ["Tucson", "boise"], "deal_size": {"max": 7}}', 0, None),
    ('{"key_metrics": {"year_built": {"max": 1999.5}}}', 1, "key_metrics.year_built: not a whole number"),
    ('{"deal_size": {"max": false}}', 1, "deal_size: not a usable number"),
    ('{"key_metrics": {"noi": {"min": -2e12}}}', 1, "key_metrics.noi: not a usable number"),
    ('{"schema_version": 3, "asset_types": ["Land"]}', 1, "schema_version: not 1"),
    ('{"leverage": {"max_ltv": 55}, "key_metrics": {"units": {"min": 12, "max": 400}}}', 0, None),
    ('"text"', 1, "criteria: not an object"),
    ('{"key_metrics": {"year_built": {"max": 2200}}}', 1, "key_metrics.year_built: not a year between 1700 and 2100"),
    # Sections of a wrong type beside a valid one.
    ('{"asset_types": ["Land"], "deal_size": "big"}', 1, "deal_size: not an object"),
    ('{"asset_types": ["Land"], "deal_size": [1]}', 1, "deal_size: not an object"),
    ('{"asset_types": ["Land"], "leverage": 65}', 1, "leverage: not an object"),
    ('{"asset_types": ["Land"], "key_metrics": "x"}', 1, "key_metrics: not an object"),
    ('{"asset_types": ["Land"], "key_metrics": null}', 1, "key_metrics: not an object"),
    ('{"asset_types": ["Land"], "key_metrics": {"noi": 5}}', 1, "key_metrics.noi: not a range"),
    ('{"asset_types": ["Land"], "schema_version": "1"}', 1, "schema_version: not 1"),
    ('{"asset_types": ["Land"], "schema_version": 1, "deal_size": null, "leverage": null}', 0, None),
    (json.dumps({"asset_types": ["Land"], "preferences": [f"wish {k}" for k in range(60)]}), 1, "preferences: more than 50 entries"),
]
_C = len(CRITERIA)

# (case, criterion, field, min, max, allowed) of the valid cases
CRITERIA_ROWS = [
    (4, "key_metrics.noi", "noi", 125000.5, None, None),
    (13, "asset_types", "property_type", None, None, "Hospitality|Land"),
    (13, "target_markets", "market", None, None, "Tucson|Boise"),
    (13, "deal_size", "asking_price", None, 7.0, None),
    (18, "leverage.max_ltv", "ltv", None, 55.0, None),
    (18, "key_metrics.units", "units", 12.0, 400.0, None),
    (28, "asset_types", "property_type", None, None, "Land"),
]


def _mandates(spark, sf_dir):
    """One mandate per customer: organization = nation, case by key, every seventh archived."""
    texts = F.array(*[F.lit(c[0]) for c in CRITERIA])
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("mandate_id"),
        F.col("c_nationkey").alias("organization_id"),
        F.concat(F.lit("Mandate  "), F.col("c_name")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.get(texts, (key % _C).cast("int")).alias("criteria"),
        F.lit(False).alias("is_demo"),
        (key % 7 == 0).alias("is_archived"),
        (key % 3 + 1).cast("int").alias("version"),
        key.alias("created_ord"),
        F.lit("2024-01-01").alias("updated_at"),
    )


SQL_CASES = f"cases AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n}, ' + ('NULL' if e is None else repr(e)) + ')' for i, (_, n, e) in enumerate(CRITERIA))}) c(id, n_errors, first_error))"
SQL_MANDATES = f"""{SQL_CASES},
m AS (SELECT c_custkey AS mandate_id, c_nationkey AS organization_id, 'Mandate  ' || c_name AS name, n_errors, first_error,
             c_custkey % 7 = 0 AS is_archived, CAST(c_custkey % 3 + 1 AS INTEGER) AS version
      FROM customer JOIN cases ON c_custkey % {_C} = id)"""


@query("mandates_checked", f"WITH {SQL_MANDATES} SELECT mandate_id, CAST(n_errors AS INTEGER) AS n_errors, first_error FROM m")
def mandates_checked(spark, sf_dir):
    return md.validate_mandates(_mandates(spark, sf_dir)).select(
        "mandate_id", F.size("errors").alias("n_errors"), F.get("errors", F.lit(0)).alias("first_error")
    )


@query(
    "mandate_criteria_rows",
    f"""WITH rows AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in r) + ')' for r in CRITERIA_ROWS)}) r(id, criterion, field_name, low, high, allowed))
    SELECT c_custkey AS mandate_id, CAST(c_custkey % 3 + 1 AS INTEGER) AS version, criterion, field_name,
           CAST(low AS DOUBLE) AS min, CAST(high AS DOUBLE) AS max, allowed
    FROM customer JOIN rows ON c_custkey % {_C} = id""",
)
def mandate_criteria_rows(spark, sf_dir):
    valid = accepted(md.validate_mandates(_mandates(spark, sf_dir)))
    return md.criteria_rows(valid).withColumn("allowed", F.array_join("allowed", "|"))


@query(
    "mandates_listed",
    f"""WITH {SQL_MANDATES}
    SELECT organization_id, count(*) FILTER (n_errors = 0) AS listed, count(*) FILTER (n_errors > 0) AS skipped,
           regexp_replace(arg_min(first_error, mandate_id) FILTER (n_errors > 0), '(unknown|excluded:) .*$', '\\1') AS first_problem
    FROM m WHERE NOT is_archived GROUP BY organization_id""",
)
def mandates_listed(spark, sf_dir):
    listed, skipped = md.list_mandates(_mandates(spark, sf_dir))
    counts = listed.groupBy("organization_id").agg(F.count(F.lit(1)).alias("listed"))
    return counts.join(skipped, "organization_id", "full_outer").select(
        "organization_id", F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("skipped", F.lit(0)).alias("skipped"), "first_problem"
    )


def _edits(spark, sf_dir):
    """Every event is an edit, as JSON, of the mandate with its user's key. By key, some
    lack a key, bring an unknown or a read-only one, hold bad criteria, have no version,
    name no organization, or want a name that others have or want too."""
    key = F.col("event_id")
    name = F.when(key % 13 == 0, F.lit("Mandate Customer#000000001")).when(key % 17 == 0, F.lit("Wanted by many")).otherwise(
        F.concat(F.lit("Edited  "), key.cast("string"))
    )
    extra = F.when(key % 5 == 1, F.lit(', "descripton": 1')).when(key % 5 == 2, F.lit(', "id": 9, "is_archived": true')).otherwise(F.lit(""))
    version = F.when(key % 19 == 0, F.lit("null")).otherwise((key % 3 + 1).cast("string"))
    criteria = F.when(key % 7 == 3, F.lit('{"leverage": 65, "asset_types": ["Land"]}')).otherwise(
        F.lit('{"asset_types": ["office"], "deal_size": {"min": 5.0, "max": null}}')
    )
    demo = F.when(key % 23 == 0, F.lit("")).otherwise(F.lit(', "is_demo": false'))
    payload = F.concat(
        F.lit('{"name": "'), name, F.lit('", "description": "by batch", "criteria": '), criteria,
        F.lit(', "version": '), version, demo, extra, F.lit("}"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("mandate_id"), key.alias("edit_ord"), payload.alias("payload")
    )


@query(
    "mandate_edits",
    f"""WITH {SQL_MANDATES},
    e AS (SELECT user_id AS mandate_id, event_id AS edit_ord, CASE WHEN event_id % 19 <> 0 THEN event_id % 3 + 1 END AS version,
                 CASE WHEN event_id % 13 = 0 THEN 'Mandate Customer#000000001' WHEN event_id % 17 = 0 THEN 'Wanted by many' ELSE 'Edited ' || event_id END AS name,
                 event_id % 5 = 1 OR event_id % 7 = 3 OR event_id % 23 = 0 AS invalid,
                 CASE WHEN event_id % 29 <> 0 THEN c_nationkey END AS organization_id
          FROM events LEFT JOIN customer ON c_custkey = user_id),
    o AS (SELECT organization_id, 'Mandate Customer#000000001' AS name FROM m WHERE mandate_id = 1 AND NOT is_archived),
    j AS (SELECT e.*, m.version AS now,
                 CASE WHEN invalid THEN 'invalid' WHEN m.mandate_id IS NULL THEN 'not_found' WHEN m.is_archived THEN 'archived'
                      WHEN e.version IS NULL OR m.version <> e.version THEN 'conflict'
                      WHEN o.name IS NOT NULL AND e.mandate_id <> 1 THEN 'duplicate_name' END AS outcome
          FROM e LEFT JOIN m ON m.mandate_id = e.mandate_id AND m.organization_id = e.organization_id
          LEFT JOIN o ON o.organization_id = e.organization_id AND o.name = e.name),
    k AS (SELECT * EXCLUDE (outcome), CASE WHEN outcome IS NULL AND row_number() OVER (PARTITION BY mandate_id, outcome IS NULL ORDER BY edit_ord) > 1
                                          THEN 'conflict' ELSE outcome END AS outcome FROM j),
    l AS (SELECT * EXCLUDE (outcome), CASE WHEN outcome IS NULL AND row_number() OVER (PARTITION BY organization_id, lower(name), outcome IS NULL ORDER BY edit_ord) > 1
                                          THEN 'duplicate_name' ELSE coalesce(outcome, 'applied') END AS outcome FROM k)
    SELECT edit_ord, mandate_id, outcome, CASE WHEN outcome = 'applied' THEN CAST(now + 1 AS INTEGER) END AS new_version,
           CASE WHEN outcome = 'applied' THEN name END AS new_name,
           CASE WHEN outcome = 'applied' THEN '{{"schema_version":1,"asset_types":["Office"],"target_markets":[],"excluded_markets":[],"deal_size":{{"min":5}},"preferences":[]}}' END AS new_criteria
    FROM l""",
)
def mandate_edits(spark, sf_dir):
    mandates = _mandates(spark, sf_dir)
    owners = mandates.select("mandate_id", "organization_id")
    requests = _edits(spark, sf_dir).join(owners, "mandate_id", "left").withColumn(
        "organization_id", F.when(F.col("edit_ord") % 29 != 0, F.col("organization_id"))
    )
    after, judged = md.apply_edits(mandates, md.read_edits(requests), F.lit("2024-02-01"))
    new = after.filter(F.col("updated_at") == "2024-02-01").select(
        "mandate_id", F.col("version").alias("new_version"), F.col("name").alias("new_name"),
        F.col("criteria").alias("new_criteria"), F.lit("applied").alias("outcome"),
    )
    return judged.select("edit_ord", "mandate_id", "outcome").join(new, ["mandate_id", "outcome"], "left")


@query(
    "mandate_archive",
    f"""WITH {SQL_MANDATES}
    SELECT o_orderkey AS request, o_custkey * 2 AS mandate_id,
           CASE WHEN m.mandate_id IS NULL THEN 'not_found' ELSE 'archived' END AS outcome, m.version,
           m.first_error AS problem
    FROM orders LEFT JOIN m ON m.mandate_id = o_custkey * 2""",
)
def mandate_archive(spark, sf_dir):
    mandates = _mandates(spark, sf_dir)
    owners = mandates.select("mandate_id", "organization_id")
    requests = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") * 2).alias("mandate_id"))
        .join(owners, "mandate_id", "left")
    )
    _, outcome = md.archive(mandates, requests)
    return outcome.select("request", "mandate_id", "outcome", "version", "problem")


@query(
    "mandate_names",
    """WITH n AS (SELECT c_custkey AS mandate_id, c_nationkey AS organization_id, lower(c_mktsegment) AS name FROM customer WHERE c_custkey % 7 <> 0)
    SELECT mandate_id, organization_id FROM (
      SELECT *, row_number() OVER (PARTITION BY organization_id, name ORDER BY mandate_id) AS r FROM n) WHERE r > 1""",
)
def mandate_names(spark, sf_dir):
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mandate_id"), "c_mktsegment")
    mixed = F.when(F.col("mandate_id") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    mandates = _mandates(spark, sf_dir).drop("name").join(segments, "mandate_id").withColumn("name", mixed)
    return md.duplicate_names(mandates).select("mandate_id", "organization_id")


@query(
    "mandate_seed",
    f"""SELECT n_nationkey AS organization_id, '{md.DEMO_NAME}' AS name FROM nation
        WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 1 AND c_custkey % 7 <> 0)""",
)
def mandate_seed(spark, sf_dir):
    mandates = _mandates(spark, sf_dir).withColumn(
        "name", F.when(F.col("mandate_id") % 40 == 1, F.upper(F.lit(md.DEMO_NAME))).otherwise(F.col("name"))
    )
    seeds = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("organization_id"), F.lit(md.DEMO_NAME).alias("name"),
        F.lit(md.DEMO_CRITERIA).alias("criteria"),
    )
    return md.insert_absent(mandates, seeds).select("organization_id", "name")


@query(
    "mandates_created",
    f"""WITH {SQL_CASES},
    i AS (SELECT c_custkey AS mandate_id, c_nationkey AS org, id, n_errors + CASE WHEN c_nationkey >= 20 THEN 1 ELSE 0 END AS n,
                 'Mandate ' || CASE WHEN c_custkey % 10 = 4 THEN c_mktsegment ELSE c_name END AS name
          FROM customer JOIN cases ON c_custkey % {_C} = id),
    r AS (SELECT *, n = 0 AND (row_number() OVER (PARTITION BY org, name, n = 0 ORDER BY mandate_id) > 1 OR name = 'Mandate BUILDING') AS taken FROM i)
    SELECT mandate_id, CAST(n + CASE WHEN taken THEN 1 ELSE 0 END AS INTEGER) AS n_errors,
           CASE WHEN n = 0 AND NOT taken THEN name END AS name, CASE WHEN n = 0 AND NOT taken THEN 1 END AS version,
           CASE WHEN n = 0 AND NOT taken THEN CASE id
             WHEN 4 THEN '{{"schema_version":1,"asset_types":[],"target_markets":[],"excluded_markets":[],"key_metrics":{{"noi":{{"min":125000.5}}}},"preferences":[]}}'
             WHEN 13 THEN '{{"schema_version":1,"asset_types":["Hospitality","Land"],"target_markets":["Tucson","Boise"],"excluded_markets":[],"deal_size":{{"max":7}},"preferences":[]}}'
             WHEN 18 THEN '{{"schema_version":1,"asset_types":[],"target_markets":[],"excluded_markets":[],"key_metrics":{{"units":{{"min":12,"max":400}}}},"leverage":{{"max_ltv":55}},"preferences":[]}}'
             WHEN 28 THEN '{{"schema_version":1,"asset_types":["Land"],"target_markets":[],"excluded_markets":[],"preferences":[]}}' END END AS criteria
    FROM r""",
)
def mandates_created(spark, sf_dir):
    """Some inputs are named after a segment: within an organization the first one gets
    the name, and "building" belongs to a mandate that is there already."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mandate_id"), "c_mktsegment")
    inputs = _mandates(spark, sf_dir).join(segments, "mandate_id").select(
        "mandate_id", "organization_id", "description", "criteria", "is_demo",
        F.when(F.col("mandate_id") % 10 == 4, F.concat(F.lit(" Mandate  "), "c_mktsegment")).otherwise(F.col("name")).alias("name"),
    )
    organizations = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(
        F.col("n_nationkey").alias("organization_id")
    )
    there = organizations.select("organization_id", F.lit("mandate building").alias("name"), F.lit(False).alias("is_archived"))
    created, refused = md.create_mandates(inputs, organizations, there)
    return created.select("mandate_id", F.lit(0).alias("n_errors"), "name", "version", "criteria").unionByName(
        refused.select(
            "mandate_id", F.size("errors").alias("n_errors"), F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("int").alias("version"), F.lit(None).cast("string").alias("criteria"),
        )
    )


@query(
    "mandate_selected",
    f"""WITH {SQL_MANDATES},
    r AS (SELECT o_orderkey AS request, o_custkey AS mandate_id, c_nationkey + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS organization_id
          FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT request, CASE WHEN m.mandate_id IS NULL THEN 'not_found' WHEN n_errors > 0 THEN 'unreadable'
                         WHEN is_archived THEN 'archived' ELSE 'selected' END AS outcome,
           CASE WHEN n_errors = 0 AND NOT is_archived THEN version END AS version
    FROM r LEFT JOIN m USING (mandate_id, organization_id)""",
)
def mandate_selected(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    requests = (
        table(spark, sf_dir, "orders")
        .join(customers, "o_custkey")
        .select(
            F.col("o_orderkey").alias("request"),
            F.col("o_custkey").alias("mandate_id"),
            (F.col("c_nationkey") + F.when(F.col("o_orderkey") % 9 == 0, F.lit(1)).otherwise(F.lit(0))).alias("organization_id"),
        )
    )
    return md.select_for_screening(requests, _mandates(spark, sf_dir)).select("request", "outcome", "version")


@query(
    "vocabulary_check",
    """SELECT n_name AS alias, count(DISTINCT r) AS markets FROM (
         SELECT n_name, c_custkey % 3 AS r FROM nation JOIN customer ON n_nationkey = c_nationkey)
       GROUP BY n_name HAVING count(DISTINCT r) > 1""",
)
def vocabulary_check(spark, sf_dir):
    """The uniqueness rule on a vocabulary as large as the tables: aliases are nation
    names claimed by three markets."""
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    claimed = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select(
        F.concat(F.lit("market "), (F.col("c_custkey") % 3).cast("string")).alias("market"),
        F.array(F.lit("tx")).alias("states"), F.col("n_name").alias("alias_key"),
    )
    problems = voc.vocabulary_problems(claimed)
    counts = claimed.groupBy("alias_key").agg(F.count_distinct("market").alias("markets"))
    named = problems.select(F.regexp_extract("problem", "^alias of two markets: (.*)$", 1).alias("alias_key"))
    return counts.join(named, "alias_key", "left_semi").select(F.col("alias_key").alias("alias"), "markets")
