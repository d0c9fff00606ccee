import pytest
from pyspark.sql import functions as F

from citeframe.functions import numbers, quotes, text

READINGS = [
    ("Loan: $7,300,000 senior", [7_300_000]),
    ("guided to $3.25M", [3_250_000]),
    ("$4 B portfolio", [4_000_000_000]),
    ("Revenue was $88K", [88_000]),
    ("Result: ($41,500)", [-41_500]),
    ("Result: -$41,500", [-41_500]),
    ("phases 1971-1984", [1971, 1984]),
    ("9 m to the creek", [9]),
    ("Leverage: 58.25%", [58.25]),
    ("c7 d 2.5.1 w.8", [2.5]),
    ("words alone", []),
    ("short by (USD 1.2 million) over １８ weeks", [-1_200_000, 18]),
    ("\U0001F680 at 4% with ٥ lifts", [4, 5]),
]


def test_numbers_are_read_with_sign_and_scale(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(READINGS)], "id int, raw string")
    df = numbers.with_mentions(df.withColumn("n", text.norm(F.col("raw"))), "n")
    got = {r.id: [m.value for m in r.mentions] for r in df.collect()}
    for i, (raw, want) in enumerate(READINGS):
        assert got[i] == want, raw


def test_offsets_and_kinds(spark):
    raw = "\U0001F680 318 units, 7-year note at 5.4%, $2M, 42,750 SF, 9 acres, 2.6 million dollars, 12"
    df = numbers.with_mentions(spark.createDataFrame([(raw,)], "raw string").withColumn("n", text.norm(F.col("raw"))), "n")
    row = df.first()
    assert [(row.n[m.start : m.stop], m.kind) for m in row.mentions] == [
        ("318", "units"), ("7", "years"), ("5.4", "percent"), ("2", "currency"), ("42,750", "area"), ("9", "other"),
        ("2.6", "currency"), ("12", "plain"),
    ]


ON_PAGE = [
    ("Loan Amount: $3,250,000", "LOAN   AMOUNT:\n$3,250,000"),
    ("an owner’s “offer” – open", "an owner's \"offer\" - open"),
    ("leasing has been slow", "leas-\ning has been slow"),
    ("leasing has been slow", "leas\u00ading has been slow"),
    ("Revenue rose ... past $88K", "Revenue rose every quarter until it went past $88K"),
    ("office and flat", "oﬃce and ﬂat"),
    ("Debt:$3,250,000", "Debt: $3,250,000"),
    ("x \\w+ {y} [z]?", "so X \\W+ {Y} [Z]? now"),
    ("Großhof 7", "GROSSHOF 7"),
]
NOT_ON_PAGE = [
    ("Loan Amount: $3,260,000", "Loan Amount: $3,250,000"),
    ("past $88K ... Revenue rose", "Revenue rose past $88K"),
    ("... ...", "some words"),
    ("Floors: 31200 sf", "Floors: 3\n1200 sf"),
    ("Known as ... Depot", "Known as " + "so " * 200 + "Depot"),
    ("LoanAmount", "Loan Amount"),
    ("homes 60", "homes 600"),
]


@pytest.mark.parametrize("numeric", [False])
def test_quotes(spark, numeric):
    rows = [(i, s, p) for i, (s, p) in enumerate(ON_PAGE + NOT_ON_PAGE)]
    df = quotes.with_quote(spark.createDataFrame(rows, "id int, s string, p string"), "s", "p", F.lit(numeric))
    got = {r.id: r.q_found for r in df.collect()}
    assert [got[i] for i in range(len(rows))] == [True] * len(ON_PAGE) + [False] * len(NOT_ON_PAGE)


def test_display(spark):
    values = [10000000.0, 6.5, -150000.0, 0.0005, 12345678.25, 1e15, 0.1, 99999999.5]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(text.display_number(F.col("v")).alias("d"))
    assert [r.d for r in df.collect()] == [
        "10000000", "6.5", "-150000", "0.0005", "12345678.25", "1000000000000000", "0.1", "99999999.5",
    ]


def test_text_forms(spark):
    row = spark.createDataFrame([("a\r\nb \t\r\rc\x00​  ",)], "t string").select(
        text.clean_page(F.col("t")).alias("page"), text.clean_for_chunks(F.lit("a \t b\r\n\n\n\nc ")).alias("chunk"),
        text.quoted(F.lit("it's")).alias("q"),
    ).first()
    assert row.page == "a\nb\n\nc"
    assert row.chunk == "a b\n\nc"
    assert row.q == '"it\'s"'


def test_notes(spark):
    cases = [
        ("cap_rate: not stated", "cap_rate", True), ("cap rate not stated", "cap_rate", True),
        ("Cap Rate - absent", "cap_rate", True), ("units_renovated: 5", "units", False), ("unitsx", "units", False),
        ("units", "units", True), ("the units", "units", False),
    ]
    df = spark.createDataFrame(cases, "note string, field string, want boolean")
    df = df.select("want", text.note_names_field(F.col("note"), F.col("field")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    df = spark.createDataFrame([("cap_rate: not stated",), ("cap rate – n/s",), ("cap_rate",)], "n string")
    assert [r[0] for r in df.select(text.note_text(F.col("n"), F.lit("cap_rate"))).collect()] == ["not stated", "n/s", "cap_rate"]


def test_figures_on_rows_read_as_in_arrays(spark):
    texts = ["units: 12, noi $(1,200.50) thousand", "5 mm usd - 3 k, 7% and .5 percent", "40 units", "none", "", None, "٣ beds 2.5m sq", "1 2 3 4 million"]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = numbers.number_mentions(pages, "t", ["id"])
    arrays = numbers.with_mentions(pages, "t").selectExpr("id", "posexplode(mentions) as (ord, m)").select("id", "ord", "m.start", "m.stop", "m.value", "m.kind")
    got = sorted(map(tuple, rows.collect()))
    assert got and got == sorted(map(tuple, arrays.collect()))
    # No figure is read inside a lambda, where expressions are interpreted.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambda" in line and "regexp_extract(" in line for line in plan.splitlines())


def test_match_form_of_tidy_and_untidy_text(spark):
    texts = ["Plain Text", "a\n b", "a \nb", "a\n\nb", "A\tB", "a  b", "x\x1cy", " a ", "\nA", "a-\nb", "a- \n b", "é \n É", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(text.norm(F.col("t")), text.norm(F.col("t"), join_line_hyphens=True)).collect()]
    assert got == [
        ("plain text", "plain text"), ("a\nb", "a\nb"), ("a\nb", "a\nb"), ("a\nb", "a\nb"), ("a b", "a b"), ("a b", "a b"), ("x y", "x y"),
        ("a", "a"), ("a", "a"), ("a-\nb", "ab"), ("a-\nb", "ab"), ("é\né", "é\né"), (None, None),
    ]


def test_filters_on_mentions_are_not_copied_into_the_steps(spark):
    pages = spark.createDataFrame([(1, "units: 12, noi $1,200")], "id int, t string")
    found = numbers.number_mentions(pages, "t", ["id"]).filter("kind = 'currency'")
    assert [r["value"] for r in found.collect()] == [1200.0]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "regexp_extract(" in line for line in plan.splitlines())


def test_figures_of_a_span_are_read_as_in_the_whole_text(spark):
    texts = [
        "total 1,234,567 - $ 8.5 million (2,000) usd 7", "a1.5 -3% x 1,2,3,4 units", "b" * 40 + "9,8.7 mm. 12 years",
        "12 " * 30, "1" * 60 + ",5 k", "no figures", "",
    ]
    rows = [(t, a, b) for t in texts for a in range(0, len(t) + 1, 3) for b in range(a, len(t) + 1, 5)]
    df = numbers.with_mentions(spark.createDataFrame(rows, "t string, a int, b int"), "t", "whole")
    read = numbers.with_mentions_in(df, "t", "a", "b", "found", drop=[]).collect()
    for row in read:
        want = [tuple(m)[2:] + (m.stop - m.start,) for m in row.whole if m.start < row.b and row.a < m.stop]
        assert [tuple(m)[2:] + (m.stop - m.start,) for m in row.found] == want, row


def test_checking_citations_shuffles_no_figures(spark):
    from citeframe.operators import citations as cite

    values = spark.createDataFrame([(1, "noi", 5.0, None)], "deal_id long, field_name string, num_value double, text_value string")
    cited = spark.createDataFrame(
        [(1, "noi", 0, "$5", "a.pdf", 1, "the NOI is $5")],
        "deal_id long, field_name string, cite_ord int, value string, source_document string, page_number int, snippet string",
    )
    pages = spark.createDataFrame(
        [(1, 0, "a.pdf", 1, "7 units. The NOI is $5 now")], "deal_id long, page_ord int, file_name string, page_number int, text string"
    )
    checked = cite.check_citations(values, cited, pages)
    assert [(r.reason, r.cited_num) for r in checked.collect()] == [(None, 5.0)]
    # Figures are read in the row of the quote, not from a table written on the way.
    assert "parquet" not in checked._jdf.queryExecution().optimizedPlan().toString()


FIGURE_ROWS = [
    *[raw for raw, _ in READINGS], "", ".5 of 12,345.67 (3) x.5 1.2.3 7,.9", "Price: $1,250.50 million, 3 units", "12 ($4.5M) 7%",
    "USD -3 k sf", "-5 percent and 6", "(2) 9",
]


def test_single_figures_are_read_as_in_arrays(spark):
    df = spark.createDataFrame([(t,) for t in FIGURE_ROWS] + [(None,)], "raw string").withColumn("n", text.norm(F.col("raw")))
    df = numbers.with_few_mentions(numbers.with_mentions(df, "n", "many"), "n", "few")
    for row in df.collect():
        assert row.few == row.many, row.raw
    # Each figure by its start, with the kinds of those after it.
    at = df.select("raw", "n", "many", F.posexplode("many").alias("i", "m")).withColumn("at", F.col("m.start"))
    read = numbers.with_figure_at(at.withColumn("n", text.ascii_digits(F.col("n"))), "n", "at", "figure").collect()
    assert len(read) > 25
    for row in read:
        assert tuple(row.figure)[:5] == tuple(row.m), row.raw
        assert (row.figure.later_kinds or []) == [m.kind for m in row.many[row.i + 1 :]], row.raw


def test_a_quote_is_held_where_the_look_up_finds_it(spark):
    rows = [(s, p) for s, p in ON_PAGE + NOT_ON_PAGE] + [("", "page"), ("same words", "same words"), ("word", None)]
    df = quotes.with_quote(spark.createDataFrame(rows, "s string, p string"), "s", "p", F.lit(False))
    held = F.exists(F.array(F.struct("s", "p")), lambda x: quotes.holds_quote(x["s"], x["p"]))
    for row in df.withColumn("held", held).collect():
        assert bool(row.held) == row.q_found, row
    placed = quotes.with_quote(spark.createDataFrame(rows, "s string, p string"), "s", "p", F.lit(True))
    form = quotes.place(text.norm(F.col("s")), text.norm(F.col("p")), F.lit(True))
    for row in placed.filter("not coalesce(q_joined, false)").withColumn("at", form).collect():
        assert (row["at"] and (row["at"].start, row["at"].stop)) == (row.q_start, row.q_stop) or row.p is None, row
