"""Number, citation, conflict and integrity queries over the order packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.plans import explode_computed, filter_computed
from ..functions.text import norm
from ..operators import citations as cite
from ..operators import conflicts as conf
from ..operators.integrity import enforce_integrity, listed_as_missing
from ..operators.passages import passages
from ..operators.phrases import asked_tokens, find_quotes, postings
from ..operators.spans import page_figures, values_in_quotes
from ..session import cut_lineage
from . import packages as pkg
from .registry import query, spread, table


def _mentions(spark, sf_dir):
    pages = pkg.package_pages(spark, sf_dir).withColumn("match_text", norm(F.col("text")))
    return numbers.number_mentions(pages, "match_text", ["deal_id", "page_ord"])


SQL_MENTIONS = f"""
{pkg.SQL_LINES},
parts AS (
  SELECT o_orderkey AS deal_id, 0 AS page_ord, 0 AS mention_ord, 'Order Number: ' AS before, CAST(o_orderkey AS VARCHAR) AS figure,
         CAST(o_orderkey AS DOUBLE) AS value, 'plain' AS kind FROM orders
  UNION ALL SELECT o_orderkey, 0, 1, chr(10) || 'Asking Price: $', format('{{:,.2f}}', o_totalprice), round(o_totalprice, 2), 'currency' FROM orders
  UNION ALL SELECT o_orderkey, 0, 2, chr(10) || 'Status: ' || o_orderstatus || chr(10) || 'Priority: ', substr(o_orderpriority, 1, 1),
                   CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), 'plain' FROM orders
  UNION ALL SELECT deal_id, rk, 0, 'Line ', CAST(line_no AS VARCHAR), CAST(line_no AS DOUBLE), 'plain' FROM lines
  UNION ALL SELECT deal_id, rk, 1, chr(10) || 'Quantity: ', format('{{:,.2f}}', quantity), quantity, 'plain' FROM lines
  UNION ALL SELECT deal_id, rk, 2, chr(10) || 'Extended Price: $', format('{{:,.2f}}', price), price, 'currency' FROM lines
  UNION ALL SELECT deal_id, rk, 3, chr(10) || 'Discount: ', format('{{:,.2f}}', discount), discount, 'percent' FROM lines
  UNION ALL SELECT deal_id, rk, 4, '%' || chr(10) || 'Tax: ', format('{{:,.2f}}', tax), tax, 'percent' FROM lines),
mentions AS (
  SELECT deal_id, page_ord, mention_ord, value, kind, stop - length(figure) AS start, stop
  FROM (SELECT *, CAST(sum(length(before) + length(figure)) OVER (PARTITION BY deal_id, page_ord ORDER BY mention_ord) AS INTEGER) AS stop FROM parts))
"""


@query(
    "number_mentions",
    f"WITH {SQL_MENTIONS} SELECT deal_id, page_ord, mention_ord, CAST(start AS INTEGER) AS start, stop, value, kind FROM mentions",
)
def number_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).select("deal_id", "page_ord", "mention_ord", "start", "stop", "value", "kind")


@query(
    "number_support",
    f"""WITH {SQL_MENTIONS},
    tried AS (
      SELECT *, 'asking_price' AS field_name, CASE WHEN kind IN ('currency', 'plain') AND value >= 0 THEN value END AS candidate FROM mentions
      UNION ALL
      SELECT *, 'cap_rate', CASE WHEN kind = 'plain' AND value > 0 AND value <= 1 THEN value * 100
                                 WHEN kind IN ('percent', 'plain') AND value BETWEEN 0 AND 100 THEN value END FROM mentions
      UNION ALL
      SELECT *, 'units', CASE WHEN kind = 'plain' AND value >= 0 AND value = floor(value) THEN value END FROM mentions)
    SELECT deal_id, page_ord, mention_ord, field_name, candidate FROM tried WHERE candidate IS NOT NULL""",
)
def number_support(spark, sf_dir):
    tried = _mentions(spark, sf_dir).withColumn(
        "field_name", F.explode(F.array(F.lit("asking_price"), F.lit("cap_rate"), F.lit("units")))
    )
    mention = F.struct("value", "kind")
    return tried.withColumn("candidate", numbers.candidate_value(F.col("field_name"), mention)).filter(
        F.col("candidate").isNotNull()
    ).select("deal_id", "page_ord", "mention_ord", "field_name", "candidate")


@query(
    "resolve_cited_pages",
    """WITH cited AS (
      SELECT o_orderkey AS k, o_orderkey % 4 AS c, o_orderkey % 3 = 0 AS two, o_orderkey % 5 = 0 AS three FROM orders)
    SELECT k AS deal_id,
           CASE WHEN c = 3 THEN NULL
                WHEN NOT two AND NOT three THEN 'order_' || k || '.pdf'
                WHEN c = 0 THEN 'order_' || k || '.pdf'
                WHEN c = 1 AND two AND NOT three THEN 'annex_' || k || '.pdf'
                WHEN c = 1 AND three AND NOT two THEN 'ANNEX_' || k || '.PDF' END AS file_name,
           CASE WHEN c = 3 THEN 'The citation points to page 7, which has no text in the document.'
                WHEN NOT two AND NOT three THEN NULL
                WHEN c = 0 OR (c = 1 AND two <> three) THEN NULL
                ELSE 'Page 1 exists in more than one document and the citation''s file name '''
                     || CASE c WHEN 1 THEN 'annex_' || k || '.pdf' ELSE 'other.pdf' END
                     || ''' doesn''t pick one.' END AS problem
    FROM cited""",
)
def resolve_cited_pages(spark, sf_dir):
    key = F.col("deal_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"))
    names = F.array_compact(
        F.array(
            pkg.file_name(key),
            F.when(key % 3 == 0, F.concat(F.lit("annex_"), key.cast("string"), F.lit(".pdf"))),
            F.when(key % 5 == 0, F.concat(F.lit("ANNEX_"), key.cast("string"), F.lit(".PDF"))),
        )
    )
    pages = orders.select("deal_id", F.posexplode(names).alias("page_ord", "file_name")).select(
        "*", F.lit(1).alias("page_number"), F.lit("text").alias("text")
    )
    choice = key % 4
    source = (
        F.when(choice == 0, F.concat(F.lit("Order_"), key.cast("string"), F.lit(".PDF")))
        .when(choice == 1, F.concat(F.lit("annex_"), key.cast("string"), F.lit(".pdf")))
        .otherwise(F.lit("other.pdf"))
    )
    cited = orders.select(
        "deal_id", source.alias("source_document"), F.when(choice == 3, F.lit(7)).otherwise(F.lit(1)).alias("page_number")
    )
    resolved = cite.attach_pages(cited, pages)
    return resolved.select("deal_id", F.col("page_file").alias("file_name"), F.col("page_problem").alias("problem"))


SQL_CITATIONS = f"""
{pkg.SQL_LINES},
ruled AS (SELECT o_orderkey AS deal_id, round(o_totalprice, 2) AS total, {pkg.SQL_RULE} AS rule, o_orderpriority FROM orders),
cited AS (
  SELECT deal_id, 'asking_price' AS field_name, 0 AS cite_ord,
         CASE WHEN rule IN ('page_not_in_document', 'snippet_too_short', 'snippet_not_on_page', 'value_not_in_snippet')
              THEN rule END AS reason FROM ruled WHERE rule IS DISTINCT FROM 'no_evidence'
  UNION ALL SELECT deal_id, 'property_type', 0, NULL FROM ruled
  UNION ALL SELECT deal_id, 'noi', 0, NULL FROM lines WHERE rk = 1
  UNION ALL SELECT deal_id, 'cap_rate', 0, NULL FROM lines WHERE rk = 1
  UNION ALL SELECT deal_id, 'asking_price', 1, CASE WHEN price = total THEN NULL ELSE 'value_not_in_snippet' END
            FROM ruled JOIN lines USING (deal_id) WHERE rk = 1 AND rule = 'conflicting_evidence')
"""


def _inputs(spark, sf_dir):
    """Values, citations and pages. They are not written as tables first: page keys are
    derived with few columns, and deriving the text a second time costs less than a copy."""
    return pkg.proposed_values(spark, sf_dir), pkg.proposed_citations(spark, sf_dir), pkg.package_pages(spark, sf_dir)


@query(
    "verify_citations",
    f"""WITH {SQL_CITATIONS}
    SELECT deal_id, field_name, cite_ord, reason, CASE WHEN reason IS NULL THEN 'value_matched' END AS verification FROM cited""",
)
def verify_citations(spark, sf_dir):
    checked = cite.check_citations(*_inputs(spark, sf_dir))
    return checked.select("deal_id", "field_name", "cite_ord", "reason", "verification")


@query(
    "number_in_quote",
    f"""WITH {pkg.SQL_LINES},
    claims AS (
      SELECT o_orderkey AS deal_id, 0 AS page_ord, unnest([round(o_totalprice, 2), CAST(o_orderkey AS DOUBLE)]) AS claim,
             round(o_totalprice, 2) AS stated FROM orders
      UNION ALL SELECT deal_id, rk, unnest([price, price + 1, quantity]), price FROM lines)
    SELECT DISTINCT deal_id, page_ord, claim FROM claims WHERE claim = stated""",
)
def number_in_quote(spark, sf_dir):
    """Prices claimed for the line of a page that states its price, which is quoted from the
    word before the colon to the end of the line."""
    pages = cut_lineage(pkg.package_pages(spark, sf_dir).select("deal_id", "page_ord", "text"))
    at = F.instr("text", "Price: $")
    stop = at + F.length(F.substring_index(F.substr("text", at), "\n", 1)) - 1
    money = lambda x: F.regexp_replace(x, "[,%]", "").cast("double")
    # The figures of a page are cut out once; only those claimed are read.
    read = pages.withColumns({
        "_figures": F.regexp_extract_all("text", F.lit("[0-9][0-9,.]*"), F.lit(0)),
        "_price": money(F.regexp_extract("text", r"Price: \$([0-9,.]+)", 1)),
    })
    first = F.col("page_ord") == 0
    other = money(F.when(first, F.get("_figures", F.lit(0))).otherwise(F.get("_figures", F.lit(1))))
    read = read.withColumn("_claims", F.array("_price", other, F.when(~first, F.col("_price") + 1)))
    claims = explode_computed(read, "_claims", "claim")
    claims = claims.select(
        "deal_id", "page_ord", F.lit(False).alias("joined"), (at - 1).alias("q_start"), stop.alias("q_stop"),
        F.lit("asking_price").alias("field_name"), "claim",
    )
    return values_in_quotes(claims, page_figures(pages)).select("deal_id", "page_ord", "claim").distinct()


SQL_QUOTED = r"""
n AS (
  SELECT doc_id, text, trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[ \t\r]+', ' ', 'g'), ' \n[ \n]*|\n[ \n]+', chr(10), 'g'), ' ' || chr(10)) AS form
  FROM documents),
p AS (SELECT *, regexp_extract_all(form, '[\p{Ll}]{3,} [\p{Ll}]{3,} [\p{Ll}]{3,}') AS phrases FROM n),
q AS (
  SELECT doc_id, doc_id % 4 AS kind, doc_id % 3 = 0 AS numeric, phrases[1] AS a, phrases[2] AS b,
         CASE WHEN doc_id % 4 = 3 THEN 'see ' || substr(a, 1, 2) || '-' || chr(10) || substr(a, 3) || ' end' ELSE form END AS page
  FROM p WHERE len(phrases) >= 2)
"""


@query(
    "quotes_by_position",
    rf"""WITH {SQL_QUOTED},
    t AS (
      SELECT *, '[^\p{{L}}\p{{N}}]' AS sep, CASE WHEN numeric THEN '\P{{Nd}}' ELSE '.' END AS gap, replace(a, ' ', '[ \n]') AS pa, replace(b, ' ', '[ \n]') AS pb FROM q),
    m AS (
      SELECT *, CASE kind WHEN 0 THEN pa WHEN 1 THEN pa || '(?:' || sep || '|' || sep || gap || '{{0,148}}?' || sep || ')' || pb
                          WHEN 2 THEN pb || '(?:' || sep || '|' || sep || gap || '{{0,148}}?' || sep || ')' || pa END AS core FROM t),
    f AS (SELECT *, '(?s)^(|.*?' || sep || ')(' || core || ')(?:' || sep || '|$)' AS pattern FROM m)
    SELECT doc_id, kind = 3 AS joined,
           CAST(CASE WHEN kind = 3 THEN 4 ELSE length(regexp_extract(page, pattern, 1)) END AS INTEGER) AS start,
           CAST(CASE WHEN kind = 3 THEN 4 + length(a) ELSE length(regexp_extract(page, pattern, 1)) + length(regexp_extract(page, pattern, 2)) END AS INTEGER) AS stop
    FROM f WHERE kind = 3 OR regexp_matches(page, pattern)""",
)
def quotes_by_position(spark, sf_dir):
    """Two three-word phrases of a document as a quote: one, both, both in the wrong order,
    and one that the page breaks at a line end."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    form = docs.select("doc_id", "text", norm(F.col("text")).alias("_form"))
    phrases_ = F.regexp_extract_all("_form", F.lit(r"[\p{Ll}]{3,} [\p{Ll}]{3,} [\p{Ll}]{3,}"), F.lit(0))
    chosen = filter_computed(form.withColumn("_p", phrases_), F.size("_p") >= 2).select(
        "doc_id", "text", (F.col("doc_id") % 4).alias("kind"), F.get("_p", F.lit(0)).alias("a"), F.get("_p", F.lit(1)).alias("b")
    )
    broken = F.concat(F.lit("see "), F.left("a", F.lit(2)), F.lit("-\n"), F.substr("a", F.lit(3)), F.lit(" end"))
    kind, gap = F.col("kind"), F.lit(" ... ")
    chosen = chosen.withColumn(
        "snippet", F.when(kind == 1, F.concat("a", gap, "b")).when(kind == 2, F.concat("b", gap, "a")).otherwise(F.col("a"))
    ).withColumn("text", F.when(kind == 3, broken).otherwise(F.col("text")))
    asked = cut_lineage(chosen.select(
        F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("deal_id"), F.lit(0).alias("page_ord"), "snippet",
        (F.col("doc_id") % 3 == 0).alias("numeric"), "text",
    ))
    # A page is asked for one quote, which stands beside it: its words are all the index needs.
    pages = asked.select("deal_id", "page_ord", "text", asked_tokens(F.col("snippet")).alias("tokens"))
    # The look-up reads the index once for each number of pieces; it is small, and made once.
    found = find_quotes(asked.drop("text"), cut_lineage(postings(pages, "tokens")))
    return found.withColumnRenamed("quote_id", "doc_id")


@query(
    "canonical_citations",
    f"""WITH {SQL_CITATIONS},
    firsts AS (
      SELECT deal_id, field_name, min(cite_ord) FILTER (reason IS NULL) AS good, arg_min(reason, cite_ord) FILTER (reason IS NOT NULL) AS bad
      FROM cited GROUP BY ALL),
    vals AS (SELECT deal_id, 'asking_price' AS field_name FROM ruled UNION ALL SELECT deal_id, 'property_type' FROM ruled
             UNION ALL SELECT deal_id, unnest(['noi', 'cap_rate']) FROM lines WHERE rk = 1)
    SELECT vals.deal_id, vals.field_name, CASE WHEN good IS NULL THEN coalesce(bad, 'no_evidence') END AS reason,
           CASE WHEN good IS NOT NULL THEN 'value_matched' END AS verification,
           CASE WHEN good IS NULL AND bad IS NULL THEN NULL ELSE 'order_' || vals.deal_id || '.pdf' END AS source_document
    FROM vals LEFT JOIN firsts USING (deal_id, field_name)""",
)
def canonical_citations(spark, sf_dir):
    values, citations, pages = _inputs(spark, sf_dir)
    checks = cite.field_checks(values, cite.check_citations(values, citations, pages))
    return cite.canonical_citations(checks).select("deal_id", "field_name", "reason", "verification", "source_document")


SQL_NOTE = """
CASE o_orderkey % 6 WHEN 0 THEN 'asking_price: not stated' WHEN 1 THEN 'Asking price - see addendum'
     WHEN 2 THEN 'asking_price_new: x' WHEN 3 THEN 'units' WHEN 4 THEN 'Cap Rate' ELSE 'nothing here' END
"""


@query(
    "listed_missing",
    """SELECT o_orderkey AS deal_id,
              CASE o_orderkey % 6 WHEN 3 THEN 'units' WHEN 4 THEN 'cap_rate' ELSE 'asking_price' END AS field_name,
              CASE o_orderkey % 6 WHEN 0 THEN 'not stated' WHEN 1 THEN 'see addendum' WHEN 3 THEN 'units' ELSE 'Cap Rate' END AS note_text
       FROM orders WHERE o_orderkey % 6 IN (0, 1, 3, 4)""",
)
def listed_missing(spark, sf_dir):
    from ..functions.text import note_text

    choice = F.col("deal_id") % 6
    note = (
        F.when(choice == 0, F.lit("asking_price: not stated"))
        .when(choice == 1, F.lit("Asking price - see addendum"))
        .when(choice == 2, F.lit("asking_price_new: x"))
        .when(choice == 3, F.lit("units"))
        .when(choice == 4, F.lit("Cap Rate"))
        .otherwise(F.lit("nothing here"))
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"))
    notes = orders.select("deal_id", F.lit(0).alias("note_ord"), note.alias("note"))
    named = listed_as_missing(notes)
    return named.select(
        "deal_id", "field_name", note_text(F.col("missing_note"), F.col("field_name")).alias("note_text")
    )


@query(
    "conflicting_citations",
    f"""WITH {SQL_CITATIONS}
    SELECT deal_id, 'asking_price' AS field_name, 2 AS passages,
           CAST(total AS DECIMAL(18,2)) || '|' || CAST(price AS DECIMAL(18,2)) AS shown
    FROM ruled JOIN lines USING (deal_id) WHERE rk = 1 AND rule = 'conflicting_evidence' AND price <> total""",
)
def conflicting_citations(spark, sf_dir):
    values, citations, pages = _inputs(spark, sf_dir)
    checked = cut_lineage(cite.check_citations(values, citations, pages))
    flags = pkg.proposal_flags(spark, sf_dir).filter(F.col("flag") == "conflicting")
    listed = conf.listed_passages(conf.conflicting_citations(checked, cite.field_checks(values, checked), flags))
    return listed.select(
        "deal_id", "field_name", F.size("passages").alias("passages"),
        F.array_join(
            F.transform("passages", lambda p: p["num"].cast("decimal(18,2)").cast("string")), "|"
        ).alias("shown"),
    )


@query(
    "passage_index",
    r"""WITH l AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (
      SELECT doc_id, trim(unnest(CASE WHEN length(trim(line, chr(32) || chr(9) || chr(13) || chr(160))) > 300
             THEN string_split(regexp_replace(line, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [line] END), chr(32) || chr(9) || chr(13) || chr(160)) AS passage FROM l)
    SELECT doc_id, md5(passage) AS passage_md5, count(*) AS n FROM s WHERE length(passage) BETWEEN 8 AND 300 GROUP BY ALL""",
)
def passage_index(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = passages(docs, keys=("doc_id",))
    return found.groupBy("doc_id", F.md5("passage").alias("passage_md5")).agg(F.count(F.lit(1)).alias("n"))


SQL_SAME_LABEL = f"""
{pkg.SQL_LINES},
fields AS (
  SELECT deal_id, rk, 'noi' AS field_name, price AS v FROM lines
  UNION ALL SELECT deal_id, rk, 'cap_rate', discount FROM lines),
own AS (SELECT deal_id, field_name, v AS own_v FROM fields WHERE rk = 1),
others AS (
  SELECT f.deal_id, f.field_name, rk, v, own_v, v <> own_v AS differs,
         row_number() OVER (PARTITION BY f.deal_id, f.field_name ORDER BY v <> own_v DESC, rk) AS r
  FROM fields f JOIN own USING (deal_id, field_name) WHERE rk > 1),
kept AS (SELECT * FROM others WHERE r <= 10 AND (deal_id, field_name) IN (SELECT (deal_id, field_name) FROM others WHERE differs)),
counted AS (
  SELECT deal_id, field_name, CAST(count(*) + 1 AS INTEGER) AS passages, CAST(sum(CAST(differs AS INTEGER)) AS INTEGER) AS differing,
         max(rk) + 1 AS last_page
  FROM kept GROUP BY ALL)
"""


def _same_label(spark, sf_dir):
    values, citations, pages = _inputs(spark, sf_dir)
    checks = cite.field_checks(values, cite.check_citations(values, citations, pages))
    stored = cut_lineage(checks.filter(F.col("verified").isNotNull()))
    return conf.same_label_passages(stored, pages)


@query("same_label_conflicts", f"WITH {SQL_SAME_LABEL} SELECT deal_id, field_name, passages, differing, last_page FROM counted")
def same_label_conflicts(spark, sf_dir):
    return (
        _same_label(spark, sf_dir)
        .groupBy("deal_id", "field_name")
        .agg(
            (F.count(F.lit(1)) + 1).cast("int").alias("passages"),
            F.sum(F.col("differs").cast("int")).cast("int").alias("differing"),
            F.max("page_number").alias("last_page"),
        )
    )


@query(
    "capped_passages",
    f"""WITH {SQL_SAME_LABEL},
    shown AS (
      SELECT deal_id, field_name, 0 AS rk, own_v AS v FROM own WHERE (deal_id, field_name) IN (SELECT (deal_id, field_name) FROM kept)
      UNION ALL SELECT deal_id, field_name, rk - 1, v FROM kept),
    grouped AS (
      SELECT deal_id, field_name, v, min(rk) AS first_rk, string_agg('order_' || deal_id || '.pdf p.' || (rk + 2), '; ' ORDER BY rk) AS places
      FROM shown GROUP BY ALL),
    pretty AS (
      SELECT *, regexp_replace(regexp_replace(CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS shown_v FROM grouped)
    SELECT deal_id, field_name, string_agg(shown_v || ' (' || places || ')', ', ' ORDER BY first_rk) AS listing
    FROM pretty GROUP BY ALL""",
)
def capped_passages(spark, sf_dir):
    return conf.listed_passages(_same_label(spark, sf_dir)).select("deal_id", "field_name", "listing")


SQL_OUTCOMES = f"""
{SQL_SAME_LABEL},
ruled AS (SELECT o_orderkey AS deal_id, round(o_totalprice, 2) AS total, {pkg.SQL_RULE} AS rule FROM orders),
outcomes AS (
  SELECT deal_id, 'asking_price' AS field_name,
         CASE WHEN rule = 'conflicting_evidence' AND (price IS NULL OR price = total) THEN NULL ELSE rule END AS reason, FALSE AS possible
  FROM ruled LEFT JOIN (SELECT deal_id, price FROM lines WHERE rk = 1) USING (deal_id)
  UNION ALL SELECT deal_id, 'property_type', NULL, FALSE FROM ruled
  UNION ALL SELECT deal_id, field_name, NULL, (deal_id, field_name) IN (SELECT (deal_id, field_name) FROM counted) FROM own)
"""


def integrity(spark, sf_dir):
    values, citations, pages = _inputs(spark, sf_dir)
    return enforce_integrity(
        values, citations, pkg.proposal_flags(spark, sf_dir), pkg.missing_notes(spark, sf_dir), pages
    )


@query(
    "integrity_outcomes",
    f"""WITH {SQL_OUTCOMES}
    SELECT deal_id, field_name, CASE WHEN reason IS NULL THEN 'stored' ELSE 'withheld' END AS outcome, reason,
           CAST(possible AS INTEGER) AS possible FROM outcomes""",
)
def integrity_outcomes(spark, sf_dir):
    return integrity(spark, sf_dir).outcomes.select(
        "deal_id", "field_name", "outcome", "reason",
        F.col("possible_detail").isNotNull().cast("int").alias("possible"),
    )
