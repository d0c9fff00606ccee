"""Proposal, status, run, review and evaluation queries, and the sink round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import spec
from ..operators import evaluation as ev
from ..operators import integrity as it
from ..operators import proposals as pr
from ..operators import review as rv
from ..operators import runs as rn
from ..operators import status as st
from ..operators.checks import accepted
from ..session import cut_lineage, shared_folder
from ..sources import batches, deals, layout
from . import packages as pkg
from .evidence import SQL_OUTCOMES, integrity
from .registry import query, spread, table

# --- Proposals -------------------------------------------------------------------


def _json(fields: dict[str, str], drop: str | None = None) -> str:
    """Proposal JSON with every value field null except `fields` (JSON text)."""
    parts = [f'"{n}":{fields.get(n, "null")}' for n, _ in spec.REPE_FIELDS if n != drop]
    parts += [f'"{n}":{fields[n]}' for n in fields if n not in dict(spec.REPE_FIELDS) and n not in pr.LISTS]
    parts += [f'"{n}":{fields.get(n, "[]")}' for n in pr.LISTS if n != drop]
    return "{" + ",".join(parts) + "}"


def _cited(*pages: str) -> str:
    """Evidence for the address, one entry per page (JSON text; empty: no page at all)."""
    entry = '{"field_name":"address","value":"9 Mill Lane","source_document":"om.pdf"%s,"snippet":"at 9 Mill Lane"}'
    return "[" + ",".join(entry % (f',"page_number":{page}' if page else "") for page in pages) + "]"


def _out_of_bounds() -> list[tuple[str, str]]:
    """Each bounded field one below and one above what it may hold."""
    sides = [(name, low, -1) for name, (low, _) in spec.BOUNDS.items()] + [(name, high, 1) for name, (_, high) in spec.BOUNDS.items()]
    return [(_json({name: str(bound + step)}), f"{name}: out of bounds") for name, bound, step in sides if bound is not None]


# (proposal with {price} standing for the order's price, first error)
PROPOSALS = [
    (_json({"asking_price": "{price}"}), None),
    (_json({"asking_price": '"not disclosed"', "submarket": '"Unknown."', "evidence": _cited("4", '"12"')}), None),
    # One missing and one of the wrong type for each type.
    *[(_json({"asking_price": "{price}"}, drop=name), f"{name}: missing") for name in ("submarket", "sponsor_equity", "loan_term_years", "field_flags")],
    (_json({"sponsor_name": "17"}), "sponsor_name: not text"),
    (_json({"square_feet": '"roomy"'}), "square_feet: not a number"),
    (_json({"square_feet": "{}"}), "square_feet: not a number"),
    (_json({"loan_term_years": "7.25"}), "loan_term_years: not a whole number"),
    (_json({"loan_term_years": '"ten"'}), "loan_term_years: not a whole number"),
    *_out_of_bounds(),
    (_json({"broker": '"x"', "asking_price": "{price}"}), "broker: not allowed"),
    (_json({"corrected_fields": "[]"}), "corrected_fields: not allowed"),
    (_json({"field_flags": '[{"field_name":"ltv","flag":"doubtful","note":"n"}]'}), "field_flags.0: malformed"),
    (_json({"missing_information": '["ltv: see loan terms", {}]'}), "missing_information.1: malformed"),
    (_json({"evidence": _cited("2", "")}), "evidence.1: malformed"),
    (_json({"evidence": _cited("-1", "2")}), "evidence.0: malformed"),
    ('"{price}"', "document: not a JSON object"),
    ('{"asking_price":', "document: not a JSON object"),
]
_GOOD = [i for i, (_, error) in enumerate(PROPOSALS) if error is None]
_P = len(PROPOSALS)


def _proposals(spark, sf_dir):
    texts = F.array(*[F.lit(t) for t, _ in PROPOSALS])
    orders = spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("deal_id"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price")
    )
    return orders.select(
        "deal_id", F.replace(F.get(texts, (F.col("deal_id") % _P).cast("int")), F.lit("{price}"), F.col("price")).alias("proposal")
    )


SQL_PROPOSALS = "p AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {'NULL' if e is None else repr(e)})" for i, (_, e) in enumerate(PROPOSALS)
) + ") p(id, error))"


@query(
    "validate_proposals",
    f"WITH {SQL_PROPOSALS} SELECT o_orderkey AS deal_id, error AS first_error, CAST(error IS NOT NULL AS INTEGER) AS n_errors FROM orders JOIN p ON o_orderkey % {_P} = id",
)
def validate_proposals(spark, sf_dir):
    checked = pr.validate_proposals(_proposals(spark, sf_dir), "proposal")
    return checked.select(
        "deal_id", F.get("errors", F.lit(0)).alias("first_error"), F.size("errors").alias("n_errors")
    )


@query(
    "proposal_rows",
    f"""SELECT o_orderkey AS deal_id, CASE WHEN o_orderkey % {_P} = 0 THEN round(o_totalprice, 2) END AS asking_price,
               CAST(25 AS BIGINT) AS stated, CAST(CASE WHEN o_orderkey % {_P} = {_GOOD[1]} THEN 2 ELSE 0 END AS BIGINT) AS citations
        FROM orders WHERE o_orderkey % {_P} IN ({', '.join(map(str, _GOOD))})""",
)
def proposal_rows(spark, sf_dir):
    # Checked once for both readers.
    valid = cut_lineage(accepted(pr.validate_proposals(_proposals(spark, sf_dir), "proposal")))
    values = pr.proposal_values(valid, "proposal", ["deal_id"])
    cites = pr.proposal_citations(valid, "proposal", ["deal_id"]).groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("citations")
    )
    per_deal = values.groupBy("deal_id").agg(
        F.max(F.when(F.col("field_name") == "asking_price", F.col("num_value"))).alias("asking_price"),
        F.count(F.lit(1)).alias("stated"),
    )
    return per_deal.join(cites, "deal_id", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))


# --- Corrections from feedback -----------------------------------------------------


def _corrections(spark, sf_dir):
    """One asking-price correction per order: cleared, right, wrong or uncited by key."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deal_id"), F.round("o_totalprice", 2).alias("price")
    )
    case = F.col("deal_id") % 4
    corrections = orders.select(
        "deal_id", F.lit("asking_price").alias("field_name"),
        F.when(case == 1, F.col("price")).when(case == 2, F.col("price") + 5).when(case == 3, F.col("price")).alias("num_value"),
        F.lit(None).cast("string").alias("text_value"),
    )
    cites = orders.filter(case != 3).select(
        "deal_id", F.lit("asking_price").alias("field_name"), F.lit(0).alias("cite_ord"),
        F.col("price").cast("string").alias("value"), pkg.file_name(F.col("deal_id")).alias("source_document"),
        F.lit(1).alias("page_number"), F.concat(F.lit("Asking Price: $"), pkg.money(F.col("price"))).alias("snippet"),
    )
    return corrections, cites, pkg.package_pages(spark, sf_dir)


@query(
    "verified_corrections",
    """SELECT o_orderkey AS deal_id, CASE o_orderkey % 4 WHEN 0 THEN 'cleared' WHEN 1 THEN 'applied' ELSE 'withheld' END AS outcome,
              CASE o_orderkey % 4 WHEN 2 THEN 'value_not_in_snippet' WHEN 3 THEN 'no_evidence' END AS reason FROM orders""",
)
def verified_corrections(spark, sf_dir):
    return it.verify_corrections(*_corrections(spark, sf_dir)).select("deal_id", "outcome", "reason")


@query(
    "feedback_updates",
    """SELECT o_orderkey AS deal_id,
              CASE o_orderkey % 4 WHEN 0 THEN 'noi' WHEN 1 THEN 'asking_price new, noi' ELSE 'asking_price, noi' END AS evidence,
              CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'cap_rate' ELSE 'asking_price, asking_price new, cap_rate' END AS withheld,
              'pending' AS review_status FROM orders""",
)
def feedback_updates(spark, sf_dir):
    verified = cut_lineage(it.verify_corrections(*_corrections(spark, sf_dir)))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"))

    def old(fields, **columns):
        rows = orders.select("deal_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_name"))
        return rows.withColumns(columns)

    evidence = old(
        ["asking_price", "noi"], source_document=F.lit("old.pdf"), page_number=F.lit(1), snippet=F.lit("old"),
        verification=F.lit("value_matched"),
    )
    withheld = old(
        ["asking_price", "cap_rate"], num_value=F.lit(1.0), text_value=F.lit(None).cast("string"),
        reason=F.lit("model_uncertain"), detail=F.lit("x"),
    )
    new_evidence, new_withheld, status = it.feedback_updates(verified, evidence, withheld)

    def listed(df, name):
        label = F.concat("field_name", F.when(F.col("is_new"), F.lit(" new")).otherwise(F.lit("")))
        return df.groupBy("deal_id").agg(F.array_join(F.array_sort(F.collect_list(label)), ", ").alias(name))

    return status.join(listed(new_evidence, "evidence"), "deal_id").join(listed(new_withheld, "withheld"), "deal_id")


# --- Statuses ------------------------------------------------------------------------

SQL_STATUSES = f"""
{SQL_OUTCOMES},
spec_fields AS (SELECT unnest([{', '.join(repr(n) for n, _ in spec.REPE_FIELDS)}]) AS field_name),
statuses AS (
  SELECT o_orderkey AS deal_id, f.field_name, o_custkey,
         CASE WHEN o.deal_id IS NULL THEN 'missing'
              WHEN reason IN ('model_conflicting', 'conflicting_evidence') THEN 'conflicting'
              WHEN reason IS NOT NULL OR possible THEN 'uncertain' ELSE 'supported' END AS status,
         CASE WHEN o.deal_id IS NULL THEN 'not_stated'
              WHEN reason = 'model_conflicting' THEN 'model_flagged_conflicting'
              WHEN reason = 'conflicting_evidence' THEN 'conflicting_values'
              WHEN reason = 'model_uncertain' THEN 'model_flagged_uncertain'
              WHEN reason = 'model_listed_as_missing' THEN 'listed_as_missing'
              WHEN reason IS NOT NULL THEN 'unverified_value'
              WHEN possible THEN 'same_label_different_value' ELSE 'verified_citation' END AS codes
  FROM orders CROSS JOIN spec_fields f LEFT JOIN outcomes o ON o.deal_id = o_orderkey AND o.field_name = f.field_name)
"""


def statuses(spark, sf_dir):
    result = integrity(spark, sf_dir)
    outcomes = cut_lineage(result.outcomes)
    notes = it.integrity_notes(outcomes, pkg.proposal_flags(spark, sf_dir), pkg.missing_notes(spark, sf_dir))
    values, evidence, withheld, possible = st.status_inputs(outcomes)
    deals_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"))
    corrected = values.select("deal_id", "field_name").filter(F.lit(False))
    return st.assess_fields(deals_, values, evidence, withheld, possible, notes, corrected), evidence, withheld


@query(
    "field_statuses",
    f"WITH {SQL_STATUSES} SELECT deal_id, field_name, status, CAST(status <> 'supported' AS INTEGER) AS needs_review, codes FROM statuses",
)
def field_statuses(spark, sf_dir):
    found, _, _ = statuses(spark, sf_dir)
    return found.select(
        "deal_id", "field_name", "status", F.col("needs_review").cast("int").alias("needs_review"),
        F.array_join("reason_codes", ",").alias("codes"),
    )


@query(
    "status_rollup",
    f"""WITH {SQL_STATUSES}
    SELECT c_nationkey AS organization_id, field_name, status, count(*) AS fields, count(*) FILTER (status <> 'supported') AS to_review
    FROM statuses JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def status_rollup(spark, sf_dir):
    found, _, _ = statuses(spark, sf_dir)
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"), "o_custkey").join(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("organization_id")
        ),
        "o_custkey",
    )
    return st.status_counts(
        found.select("deal_id", "field_name", "status", "needs_review").join(owners, "deal_id"),
        ["organization_id", "field_name"],
    )


@query(
    "field_evidence",
    f"""WITH {SQL_OUTCOMES},
    price AS (SELECT deal_id, price FROM lines WHERE rk = 1)
    SELECT deal_id, 'asking_price' AS field_name,
           CAST(CASE WHEN reason = 'no_evidence' THEN 0 WHEN reason = 'conflicting_evidence' THEN 2 ELSE 1 END AS BIGINT) AS passages
    FROM outcomes WHERE field_name = 'asking_price' AND reason IS DISTINCT FROM 'no_evidence'
    UNION ALL SELECT deal_id, 'property_type', 1 FROM ruled
    UNION ALL SELECT own.deal_id, own.field_name, coalesce(c.passages, 1) FROM own LEFT JOIN counted c USING (deal_id, field_name)""",
)
def field_evidence(spark, sf_dir):
    found, evidence, withheld = statuses(spark, sf_dir)
    held = st.field_evidence(evidence, withheld, found)
    return held.groupBy("deal_id", "field_name").agg(F.count(F.lit(1)).alias("passages"))


@query(
    "status_reviewer_cases",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS c FROM customer)
    SELECT k AS deal_id,
           CASE c WHEN 0 THEN 'supported' WHEN 1 THEN 'missing' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'uncertain' WHEN 4 THEN 'uncertain'
                  WHEN 5 THEN 'missing' WHEN 6 THEN 'conflicting' ELSE 'uncertain' END AS status,
           CASE c WHEN 0 THEN 'reviewer_corrected' WHEN 1 THEN 'reviewer_corrected' WHEN 2 THEN 'unverified_value,reviewer_corrected'
                  WHEN 3 THEN 'no_citation' WHEN 4 THEN 'quote_only_citation' WHEN 5 THEN 'listed_as_missing'
                  WHEN 6 THEN 'model_flagged_conflicting' ELSE 'model_flagged_uncertain' END AS codes,
           CAST(c NOT IN (0, 1) AS INTEGER) AS needs_review
    FROM c""",
)
def status_reviewer_cases(spark, sf_dir):
    """Reviewer precedence on one narrative field per customer, case by key: corrected,
    cleared, corrected with a newer proposal, uncited, quote only, listed missing,
    conflict note, uncertain note."""
    key = F.col("deal_id")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deal_id")).withColumn(
        "field_name", F.lit("business_plan")
    )
    case = key % 8
    values = base.filter(case.isin(0, 2, 3, 4, 6, 7)).select(
        "deal_id", "field_name", F.lit(None).cast("double").alias("num_value"), F.lit("Renovate").alias("text_value")
    )
    evidence = base.filter(case.isin(4, 6, 7)).select(
        "deal_id", "field_name", F.lit(0).alias("ev_ord"), F.lit("a.pdf").alias("source_document"),
        F.lit(1).alias("page_number"), F.lit("quote").alias("snippet"),
        F.when(case == 4, F.lit("quote_only")).otherwise(F.lit("value_matched")).alias("verification"),
    )
    passage = "struct<num:double,text:string,source_document:string,page_number:int,snippet:string>"
    withheld = base.filter(case == 2).select(
        "deal_id", "field_name", F.lit(0).alias("w_ord"), F.lit("no_evidence").alias("reason"), F.lit("d").alias("detail"),
        F.lit(None).cast("struct<source_document:string,page_number:int,snippet:string>").alias("evidence"),
        F.lit(None).cast(f"array<{passage}>").alias("conflicting_values"),
    )
    possible = base.filter(F.lit(False)).select(
        "deal_id", "field_name", F.lit(0).alias("p_ord"), F.lit("d").alias("detail"),
        F.lit(None).cast(f"array<{passage}>").alias("conflicting_values"),
    )
    kind = F.when(case == 6, F.lit("conflicting")).when(case == 7, F.lit("uncertain")).otherwise(F.lit("missing"))
    notes = base.filter(case.isin(0, 5, 6, 7)).select(
        "deal_id", kind.alias("kind"), F.lit(0).alias("note_src"), F.lit(0).alias("note_ord"),
        F.lit("Business plan: see page 3").alias("note"),
    )
    corrected = base.filter(case.isin(0, 1, 2)).select("deal_id", "field_name")
    found = st.assess_fields(
        base.select("deal_id"), values, evidence, withheld, possible, notes, corrected, fields=["business_plan"]
    )
    return found.select(
        "deal_id", "status", F.array_join("reason_codes", ",").alias("codes"),
        F.col("needs_review").cast("int").alias("needs_review"),
    )


@query(
    "dismissed_conflicts",
    f"""WITH {SQL_OUTCOMES},
    wanted AS (SELECT deal_id, field_name FROM own)
    SELECT deal_id, field_name, CASE WHEN (deal_id, field_name) IN (SELECT (deal_id, field_name) FROM counted) THEN 'dismissed' ELSE 'nothing open' END AS outcome
    FROM wanted""",
)
def dismissed_conflicts(spark, sf_dir):
    """Dismisses the possible conflict of every noi and cap_rate."""
    outcomes = cut_lineage(integrity(spark, sf_dir).outcomes)
    notes = it.integrity_notes(outcomes, pkg.proposal_flags(spark, sf_dir), pkg.missing_notes(spark, sf_dir))
    wanted = outcomes.filter(F.col("field_name").isin("noi", "cap_rate")).select("deal_id", "field_name")
    remaining, rejected = st.dismiss_possible_conflicts(notes, wanted)
    left_open = st.field_notes(remaining, ["noi", "cap_rate"]).filter("is_possible").select(
        "deal_id", "field_name", F.lit("still open").alias("outcome")
    )
    done = wanted.join(rejected, ["deal_id", "field_name"], "left_anti").join(
        left_open, ["deal_id", "field_name"], "left_anti"
    )
    return (
        rejected.withColumn("outcome", F.lit("nothing open"))
        .unionByName(done.withColumn("outcome", F.lit("dismissed")))
        .unionByName(left_open)
    )


# --- Runs ------------------------------------------------------------------------------


def _attempts(spark, sf_dir):
    """Every event is an extraction attempt; errors failed; the value is the latency."""
    events = table(spark, sf_dir, "events")
    key = F.col("event_id")
    failed = F.col("event_type") == "error"
    return events.select(
        key.alias("run_id"),
        (F.col("user_id") % 10).alias("organization_id"),
        F.when(key % 17 == 0, F.lit("")).otherwise(F.lit("model-1")).alias("model"),
        F.sha2("event_type", 256).alias("prompt_sha256"),
        F.when(key % 19 == 0, F.lit("short")).otherwise(F.sha2("props", 256)).alias("source_sha256"),
        F.sha2(F.concat(F.col("props"), F.col("event_type")), 256).alias("input_sha256"),
        F.when(key % 23 == 0, F.lit(0)).otherwise(F.lit(3)).alias("page_count"),
        F.col("props").alias("profile"),
        F.when(failed, F.lit("TimeoutError")).alias("error_type"),
        F.when(failed, F.repeat("props", 300)).alias("error_message"),
        F.col("ts").alias("started_at"),
        F.when(key % 29 == 0, F.col("ts") - F.expr("interval 1 second")).otherwise(F.col("ts")).alias("completed_at"),
        F.round("value").cast("int").alias("latency_ms"),
    )


SQL_RUN_ERRORS = """concat_ws('; ', CASE WHEN event_id % 17 = 0 THEN 'model: empty' END,
   CASE WHEN event_id % 19 = 0 THEN 'source_sha256: not 64 characters' END,
   CASE WHEN event_id % 23 = 0 THEN 'page_count: not positive' END,
   CASE WHEN round(value) < 0 THEN 'latency_ms: negative' END,
   CASE WHEN event_id % 29 = 0 THEN 'completed_at: before started_at' END,
   CASE WHEN event_id % 31 = 0 THEN 'outcome: profile and error do not match the status' END)"""


@query("runs_checked", f"SELECT event_id AS run_id, {SQL_RUN_ERRORS} AS errors FROM events")
def runs_checked(spark, sf_dir):
    runs = rn.run_records(_attempts(spark, sf_dir))
    swapped = F.when(F.col("status") == "failed", F.lit("succeeded")).otherwise(F.lit("failed"))
    runs = runs.withColumn("status", F.when(F.col("run_id") % 31 == 0, swapped).otherwise(F.col("status")))
    return rn.check_runs(runs).select("run_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "failed_runs",
    """SELECT event_id AS run_id, 'failed' AS status, 'TimeoutError' AS error_type, md5(left(repeat(props, 300), 2000)) AS message_md5
       FROM events WHERE event_type = 'error'""",
)
def failed_runs(spark, sf_dir):
    runs = rn.run_records(_attempts(spark, sf_dir)).filter(F.col("status") == "failed")
    return runs.filter(F.col("profile").isNull()).select(
        "run_id", "status", "error_type", F.md5("error_message").alias("message_md5")
    )


def _run_profiles(spark, sf_dir):
    """Succeeded runs with a profile document; every fifth has no statuses, every
    seventh no evidence."""
    key = F.col("event_id")
    evidence = F.concat(
        F.lit('[{"field_name":"noi","value":"'), key.cast("string"),
        F.lit('","source_document":"a.pdf","page_number":2,"snippet":"NOI"},{"field_name":"ltv","value":"65","page_number":3}]'),
    )
    statuses_ = F.lit(
        '{"noi":{"status":"uncertain","needs_review":true,"reasons":[{"code":"same_label_different_value","message":"m"},'
        '{"code":"no_citation","message":"n"}],"conflicting_values":[{"value":1},{"value":2}]},'
        '"ltv":{"status":"supported","needs_review":false,"reasons":[]}}'
    )
    profile = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(key % 7 != 0, F.concat(F.lit('"evidence":'), evidence)),
            F.when(key % 5 == 0, F.lit('"field_statuses":[1]')).otherwise(F.concat(F.lit('"field_statuses":'), statuses_)),
        ),
        F.lit(',"withheld_values":[{"field_name":"cap_rate","evidence":{"page_number":9}}]}'),
    )
    return table(spark, sf_dir, "events").filter(F.col("event_type") != "error").select(
        key.alias("run_id"), (F.col("user_id") % 10).alias("organization_id"), profile.alias("profile")
    )


@query(
    "shred_evidence",
    """SELECT event_id AS run_id, user_id % 10 AS organization_id, f.field_name, CASE f.field_name WHEN 'noi' THEN CAST(event_id AS VARCHAR) ELSE '65' END AS value,
              CASE f.field_name WHEN 'noi' THEN 'a.pdf' END AS source_document, f.page AS page_number
       FROM events, (VALUES ('noi', 2), ('ltv', 3)) f(field_name, page) WHERE event_type <> 'error' AND event_id % 7 <> 0""",
)
def shred_evidence(spark, sf_dir):
    return rn.shred_evidence(_run_profiles(spark, sf_dir)).select(
        "run_id", "organization_id", "field_name", "value", "source_document", "page_number"
    )


@query(
    "shred_statuses",
    """SELECT event_id AS run_id, f.field_name, f.status, f.codes, f.passages
       FROM events, (VALUES ('noi', 'uncertain', 'same_label_different_value,no_citation', 2), ('ltv', 'supported', '', 0)) f(field_name, status, codes, passages)
       WHERE event_type <> 'error' AND event_id % 5 <> 0""",
)
def shred_statuses(spark, sf_dir):
    rows = accepted(rn.check_statuses(rn.shred_statuses(_run_profiles(spark, sf_dir))))
    return rows.select(
        "run_id", "field_name", "status", F.array_join("reason_codes", ",").alias("codes"),
        F.col("conflicting_passage_count").alias("passages"),
    )


@query(
    "orphaned_children",
    """SELECT event_id AS run_id, count(*) AS rows FROM events, (VALUES (1), (2)) f(x)
       WHERE event_type <> 'error' AND event_id % 7 <> 0 AND event_id % 13 = 0 GROUP BY event_id""",
)
def orphaned_children(spark, sf_dir):
    runs = _run_profiles(spark, sf_dir)
    children = rn.shred_evidence(runs).withColumn(
        "organization_id", F.when(F.col("run_id") % 13 == 0, F.lit(99)).otherwise(F.col("organization_id")).cast("bigint")
    )
    return rn.orphaned_rows(children, runs).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


# --- Review ----------------------------------------------------------------------------

_FIELDS = ["asking_price", "units", "market", "not_a_field", "review_feedback"]


def _profiles(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    none_n, none_t = F.lit(None).cast("double"), F.lit(None).cast("string")
    return customers.select(
        F.col("c_custkey").alias("deal_id"),
        F.explode(
            F.array(
                F.struct(F.lit("asking_price").alias("f"), F.col("c_acctbal").alias("n"), none_t.alias("t")),
                F.struct(F.lit("market").alias("f"), none_n.alias("n"), F.col("c_mktsegment").alias("t")),
            )
        ).alias("v"),
    ).select("deal_id", F.col("v.f").alias("field_name"), F.col("v.n").alias("num_value"), F.col("v.t").alias("text_value"))


def _review_corrections(spark, sf_dir):
    """Every event corrects one field of its user's profile: the last by (ts, id) wins.
    Some numbers come as text; some of these are not whole where they have to be."""
    key = F.col("event_id")
    field = F.get(F.array(*[F.lit(f) for f in _FIELDS]), (key % 5).cast("int"))
    cleared = key % 10 == 9
    as_text = ~cleared & (key % 5 < 2) & (key % 3 == 1)
    text = F.when(key % 7 == 1, F.concat(key.cast("string"), F.lit(".5"))).otherwise(key.cast("string"))
    number = F.when(key % 5 == 0, F.col("value")).when(key % 5 == 1, F.floor("value") + F.when(key % 8 == 1, F.lit(0.5)).otherwise(F.lit(0.0)))
    worded = F.when(as_text, text).when(~cleared & (key % 5).isin(2, 4), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        key.alias("batch_id"), F.col("user_id").alias("deal_id"), "ts", key.alias("seq"), field.alias("field_name"),
        F.when(cleared, F.lit("null")).when(as_text | (key % 5).isin(2, 4), F.lit("text")).otherwise(F.lit("number")).alias("kind"),
        F.when(~cleared & ~as_text, number).alias("num_value"),
        worded.alias("text_value"),
    )


SQL_CORRECTIONS = """
e AS (SELECT event_id, user_id AS deal_id, ts, ['asking_price', 'units', 'market', 'not_a_field', 'review_feedback'][event_id % 5 + 1] AS field_name,
             event_id % 10 = 9 AS cleared, event_id % 10 <> 9 AND event_id % 5 < 2 AND event_id % 3 = 1 AS as_text, value, event_type,
             c_custkey IS NOT NULL AS known FROM events LEFT JOIN customer ON c_custkey = user_id),
n AS (SELECT *, CASE WHEN cleared THEN NULL WHEN as_text THEN event_id + CASE WHEN event_id % 7 = 1 THEN 0.5 ELSE 0 END::DOUBLE
                     WHEN field_name = 'asking_price' THEN value
                     WHEN field_name = 'units' THEN floor(value) + CASE WHEN event_id % 8 = 1 THEN 0.5 ELSE 0 END::DOUBLE END AS num FROM e),
j AS (SELECT *, CASE WHEN field_name = 'not_a_field' THEN 'field_name: not a profile field'
                     WHEN field_name = 'units' AND NOT cleared AND num <> floor(num) THEN 'value: wrong type'
                     WHEN NOT known THEN 'deal_id: no such deal' END AS error FROM n),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deal_id, field_name ORDER BY ts DESC, event_id DESC) AS r FROM j WHERE error IS NULL) WHERE r = 1),
prof AS (SELECT c_custkey AS deal_id, 'asking_price' AS field_name, c_acctbal AS n, NULL AS t FROM customer
         UNION ALL SELECT c_custkey, 'market', NULL, c_mktsegment FROM customer)
"""


@query(
    "apply_corrections",
    f"""WITH {SQL_CORRECTIONS}
    SELECT coalesce(prof.deal_id, last.deal_id) AS deal_id, coalesce(prof.field_name, last.field_name) AS field_name,
           CASE WHEN last.deal_id IS NULL THEN n ELSE num END AS num_value,
           CASE WHEN last.deal_id IS NULL THEN t WHEN cleared THEN NULL WHEN last.field_name IN ('market', 'review_feedback') THEN event_type END AS text_value,
           CAST(last.deal_id IS NOT NULL AND last.field_name <> 'review_feedback' AS INTEGER) AS corrected
    FROM prof FULL JOIN last USING (deal_id, field_name)""",
)
def apply_corrections(spark, sf_dir):
    profiles = _profiles(spark, sf_dir)
    clean, _ = rv.split_batches(rv.check_corrections(_review_corrections(spark, sf_dir), profiles))
    merged = rv.apply_corrections(profiles, clean, ["ts", "seq"])
    return merged.withColumn("corrected", F.col("corrected").cast("int"))


@query("refused_corrections", f"WITH {SQL_CORRECTIONS} SELECT event_id, error FROM j WHERE error IS NOT NULL")
def refused_corrections(spark, sf_dir):
    checked = rv.check_corrections(_review_corrections(spark, sf_dir), _profiles(spark, sf_dir))
    _, refused = rv.split_batches(checked)
    return refused.select(F.col("batch_id").alias("event_id"), F.get("errors", F.lit(0)).alias("error"))


def _verdicts(spark, sf_dir):
    names = {"click": "approved", "error": "rejected", "purchase": "approved", "view": "rejected"}
    verdict = F.coalesce(F.try_element_at(spec.literal_map(names), F.col("event_type")), F.lit("pending"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("deal_id"), "ts", F.col("event_id").alias("seq"), verdict.alias("verdict")
    )


SQL_VERDICTS = """
v AS (SELECT user_id AS deal_id, ts, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'approved'
             WHEN event_type IN ('error', 'view') THEN 'rejected' ELSE 'pending' END AS verdict FROM events)
"""


@query(
    "review_verdicts",
    f"""WITH {SQL_VERDICTS},
    last AS (SELECT deal_id, arg_max(verdict, (ts, event_id)) AS verdict FROM v WHERE verdict <> 'pending' GROUP BY deal_id)
    SELECT c_custkey AS deal_id, coalesce(verdict, 'pending') AS review_status FROM customer LEFT JOIN last ON deal_id = c_custkey""",
)
def review_verdicts(spark, sf_dir):
    deals_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deal_id"))
    return rv.review_verdicts(deals_, _verdicts(spark, sf_dir), ["ts", "seq"])[0]


@query(
    "refused_verdicts",
    f"""WITH {SQL_VERDICTS}
    SELECT event_id AS seq, CASE WHEN verdict = 'pending' THEN 'not a verdict' ELSE 'no such deal' END AS reason
    FROM v LEFT JOIN supplier ON deal_id = s_suppkey WHERE verdict = 'pending' OR s_suppkey IS NULL""",
)
def refused_verdicts(spark, sf_dir):
    deals_ = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("deal_id"))
    return rv.review_verdicts(deals_, _verdicts(spark, sf_dir), ["ts", "seq"])[1].select("seq", "reason")


@query(
    "review_workflow",
    """SELECT o_orderkey AS deal_id,
              CASE WHEN o_orderstatus = 'F' THEN 'approved'
                   WHEN o_orderkey % 3 <> 0 AND l_orderkey IS NOT NULL AND o_orderkey % 4 <> 2 THEN 'pending' ELSE 'rejected' END AS review_status,
              CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 <> 0 THEN o_orderpriority END AS review_feedback
       FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey""",
)
def review_workflow(spark, sf_dir):
    key = F.col("deal_id")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "deal_id")
    reviews = orders.select(
        "deal_id", F.when(F.col("o_orderstatus") == "F", F.lit("approved")).otherwise(F.lit("rejected")).alias("verdict"),
        F.when(key % 3 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("feedback"),
    )
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deal_id"))
    fixes = orders.filter(key % 4 != 2).select("deal_id")
    return rv.review_workflow(reviews, pages, fixes).select("deal_id", "review_status", "review_feedback")


@query(
    "resolve_withheld",
    f"""WITH {SQL_OUTCOMES},
    w AS (SELECT o.deal_id, o.reason, r.total FROM outcomes o JOIN ruled r USING (deal_id) WHERE o.reason IS NOT NULL AND o.field_name = 'asking_price')
    SELECT deal_id, CASE deal_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'dismissed' ELSE 'left' END AS state,
           CASE WHEN deal_id % 3 = 0 THEN round(total + CASE WHEN reason = 'value_not_in_snippet' THEN 1 ELSE 0 END, 2) END AS num_value FROM w""",
)
def resolve_withheld(spark, sf_dir):
    """Accepts every third withheld value, dismisses the next, leaves the rest."""
    outcomes = cut_lineage(integrity(spark, sf_dir).outcomes)
    withheld = outcomes.filter(F.col("outcome") == "withheld").select("deal_id", "field_name", "num_value", "text_value")
    stored = outcomes.filter(F.col("outcome") == "stored").select("deal_id", "field_name", "num_value", "text_value")
    case = F.col("deal_id") % 3
    decisions = withheld.filter(case < 2).select(
        "deal_id", "field_name", F.when(case == 0, F.lit("accept")).otherwise(F.lit("dismiss")).alias("decision")
    )
    values, left = rv.resolve_withheld(stored, withheld, decisions)
    set_values = values.filter("corrected").select("deal_id", "field_name", F.col("num_value").alias("new_value"))
    return (
        withheld.join(set_values, ["deal_id", "field_name"], "left")
        .join(left.select("deal_id", "field_name", F.lit(True).alias("kept")), ["deal_id", "field_name"], "left")
        .select(
            "deal_id",
            F.when(F.col("new_value").isNotNull(), F.lit("accepted")).when(F.col("kept"), F.lit("left")).otherwise(F.lit("dismissed")).alias("state"),
            F.round("new_value", 2).alias("num_value"),
        )
    )


# --- Evaluation ---------------------------------------------------------------------------


def _expected(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    none_n, none_t = F.lit(None).cast("double"), F.lit(None).cast("string")
    return orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.explode(
            F.array(
                F.struct(F.lit("asking_price").alias("f"), F.col("o_totalprice").alias("n"), none_t.alias("t")),
                F.struct(F.lit("property_type").alias("f"), none_n.alias("n"), F.col("o_orderpriority").alias("t")),
                F.struct(F.lit("market").alias("f"), none_n.alias("n"), none_t.alias("t")),
            )
        ).alias("v"),
    ).select("case_id", F.col("v.f").alias("field_name"), F.col("v.n").alias("exp_num"), F.col("v.t").alias("exp_text"))


def _actual(spark, sf_dir):
    """Perturbed answers: the price off by 0.5 % or 50 %, the text in other case, the
    market sometimes invented, the text of every eleventh case absent."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    none_n, none_t = F.lit(None).cast("double"), F.lit(None).cast("string")
    factor = F.when(key % 4 == 0, F.lit(1.5)).otherwise(F.lit(1.005))
    return orders.select(
        key.alias("case_id"),
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("asking_price").alias("f"), (F.col("o_totalprice") * factor).alias("n"), none_t.alias("t")),
                    F.when(
                        key % 11 != 0,
                        F.struct(
                            F.lit("property_type").alias("f"), none_n.alias("n"),
                            F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit("\n")).alias("t"),
                        ),
                    ),
                    F.struct(
                        F.lit("market").alias("f"), none_n.alias("n"), F.when(key % 5 == 0, F.lit("Austin")).alias("t")
                    ),
                )
            )
        ).alias("v"),
    ).select("case_id", F.col("v.f").alias("field_name"), F.col("v.n").alias("num_value"), F.col("v.t").alias("text_value"))


def _failed(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 13 == 0).select(
        F.col("o_orderkey").alias("case_id"), F.lit("TimeoutError: slow").alias("error")
    )


SQL_SCORES = """
s AS (SELECT o_orderkey AS case_id, f.field_name, o_orderstatus AS suite,
             CASE f.field_name WHEN 'asking_price' THEN o_orderkey % 4 <> 0 WHEN 'property_type' THEN o_orderkey % 11 <> 0
                  ELSE o_orderkey % 5 <> 0 END AS correct
      FROM orders, (VALUES ('asking_price'), ('property_type'), ('market')) f(field_name) WHERE o_orderkey % 13 <> 0),
a AS (SELECT o_orderkey AS case_id, o_orderstatus AS suite, o_orderkey % 13 = 0 AS failed,
             coalesce(n, 0) AS correct, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 3 END AS total
      FROM orders LEFT JOIN (SELECT case_id, count(*) FILTER (correct) AS n FROM s GROUP BY 1) ON case_id = o_orderkey)
"""


def _scored(spark, sf_dir):
    return ev.score_cases(_expected(spark, sf_dir), _actual(spark, sf_dir), _failed(spark, sf_dir))


@query("evaluation_fields", f"WITH {SQL_SCORES} SELECT case_id, field_name, CAST(correct AS INTEGER) AS correct FROM s")
def evaluation_fields(spark, sf_dir):
    return _scored(spark, sf_dir).select("case_id", "field_name", F.col("correct").cast("int").alias("correct"))


def _accuracy(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("suite"))
    return ev.case_accuracy(cases, _scored(spark, sf_dir), _failed(spark, sf_dir))


@query(
    "case_accuracy",
    f"""WITH {SQL_SCORES} SELECT case_id, suite, correct, CAST(total AS BIGINT) AS total,
        CASE WHEN failed THEN NULL ELSE correct / total END AS accuracy FROM a""",
)
def case_accuracy(spark, sf_dir):
    return _accuracy(spark, sf_dir).drop("error")


@query(
    "suite_report",
    f"""WITH {SQL_SCORES}
    SELECT suite, count(*) AS cases, count(*) FILTER (failed) AS failed_cases, CAST(coalesce(sum(correct) FILTER (NOT failed), 0) AS BIGINT) AS correct,
           CAST(coalesce(sum(total) FILTER (NOT failed), 0) AS BIGINT) AS total,
           sum(correct) FILTER (NOT failed) / sum(total) FILTER (NOT failed) AS accuracy
    FROM a GROUP BY ROLLUP (suite)""",
)
def suite_report(spark, sf_dir):
    return ev.suite_report(_accuracy(spark, sf_dir))


# --- Sinks ----------------------------------------------------------------------------------


@query(
    "run_sink",
    """SELECT event_id AS run_id, CAST(CASE WHEN event_id % 7 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS evidence_rows,
              CAST(CASE WHEN event_id % 5 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS status_rows FROM events WHERE event_type <> 'error'""",
)
def run_sink(spark, sf_dir):
    """Writes runs, evidence and statuses as three batches, with ids that would be read as
    equal numbers. The first is written once more as it was, and a third time by a writer
    that ends half-way; a fourth batch never gets its commit. What is committed is read back."""
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    runs = cut_lineage(_run_profiles(spark, sf_dir))
    for number, batch_id in enumerate(("001", "1", "x/1")):
        part = runs.filter(F.pmod(F.col("run_id"), F.lit(3)) == number)
        batches.write_batch({"runs": part, "evidence": rn.shred_evidence(part), "statuses": rn.shred_statuses(part)}, root, batch_id)
    first = runs.filter(F.pmod(F.col("run_id"), F.lit(3)) == 0)
    again = {"runs": first, "evidence": rn.shred_evidence(first), "statuses": rn.shred_statuses(first)}
    batches.write_batch(again, root, "001")
    broken = batches.new_attempt()
    batches.write_table(again["runs"].limit(0), root, "runs", "001", broken)
    batches.write_table(again["evidence"].unionAll(again["evidence"]), root, "evidence", "001", broken)
    for name, rows in (("evidence", rn.shred_evidence(runs)), ("statuses", rn.shred_statuses(runs))):
        batches.write_table(rows, root, name, "retry-x", batches.new_attempt())
    counts = [
        batches.read_committed(spark, root, name).groupBy("run_id").agg(F.count(F.lit(1)).alias(f"{label}_rows"))
        for name, label in (("evidence", "evidence"), ("statuses", "status"))
    ]
    kept = batches.read_committed(spark, root, "runs").select("run_id")
    return (
        kept.join(counts[0], "run_id", "left")
        .join(counts[1], "run_id", "left")
        .select("run_id", F.coalesce("evidence_rows", F.lit(0)).alias("evidence_rows"), F.coalesce("status_rows", F.lit(0)).alias("status_rows"))
    )


SQL_RUN_KEYS = "SELECT event_id AS run_id, user_id % 50 AS organization_id, event_id % 97 AS deal_id, ts AS started_at, event_type FROM events"


@query(
    "run_lookup",
    f"""WITH r AS ({SQL_RUN_KEYS}), n AS (
      SELECT *, row_number() OVER (PARTITION BY organization_id, deal_id ORDER BY started_at DESC, run_id DESC) AS place,
             count(*) OVER (PARTITION BY organization_id, deal_id) AS runs FROM r)
    SELECT organization_id, deal_id, run_id, event_type, runs FROM n WHERE place = 1""",
)
def run_lookup(spark, sf_dir):
    """The newest run of every deal, from the stored layout."""
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), (F.col("user_id") % 50).alias("organization_id"), (F.col("event_id") % 97).alias("deal_id"),
        F.col("ts").alias("started_at"), "event_type",
    )
    name = f"runs_{uuid.uuid4().hex}"
    layout.write_runs(runs, name, f"{shared_folder(spark)}/{name}", buckets=8)
    return layout.newest_runs(spark, name).select("organization_id", "deal_id", "run_id", "event_type", "runs")


@query(
    "document_sink",
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '001' END AS batch_id,
              CASE WHEN doc_id % 2 = 0 THEN 1 ELSE len(string_split(text, chr(10))) END::BIGINT AS chunks FROM documents""",
)
def document_sink(spark, sf_dir):
    """Indexes all documents by line, then every second one again as a single chunk; the
    second batch also brings chunks of documents that do not exist."""
    root = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    batches.merge_documents(docs, lines, root, "001")
    again = docs.filter("document_id % 2 = 0")
    whole = docs.select(
        F.when(F.col("document_id") % 2 == 0, F.col("document_id")).otherwise(-1 - F.col("document_id")).alias("document_id"),
        F.lit(0).alias("chunk_index"),
        F.col("text").alias("content"),
    )
    stored, parts = batches.merge_documents(again, whole, root, "1")
    counted = parts.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return stored.select("document_id", "batch_id").join(counted, "document_id", "left")


@query(
    "profile_snapshot",
    """WITH saves AS (SELECT user_id AS deal_id, props, event_id FROM events),
    latest AS (SELECT deal_id, arg_max(props, event_id) AS profile FROM saves GROUP BY deal_id)
    SELECT CAST(c_custkey AS VARCHAR) AS deal_id, coalesce(profile, c_name) AS profile FROM customer LEFT JOIN latest ON deal_id = c_custkey
    UNION ALL SELECT CAST(deal_id AS VARCHAR), profile FROM latest WHERE deal_id NOT IN (SELECT c_custkey FROM customer)""",
)
def profile_snapshot(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("deal_id"), F.col("c_name").alias("profile")
    )
    saved = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("deal_id"), F.col("props").alias("profile"), F.col("event_id").alias("save_ord")
    )
    path = f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}"
    deals.write_snapshot(deals.merge_profiles(current, saved), path)
    return spark.read.parquet(path)
