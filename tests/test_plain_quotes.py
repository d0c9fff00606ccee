"""Quotes that are one line of their page: settled on columns, with the answers of the long way."""

from pyspark.sql import functions as F

from citeframe import spec
from citeframe.functions import quotes
from citeframe.operators import citations as cite

# field, quote, page, whether the plain case settles it
ROWS = [
    ("noi", "NOI: $62,500", "Terms\nNOI: $62,500\nTax: 3%", True),
    ("noi", "NOI: $62,500", "NOI: $62,500.75", False),
    ("noi", "NOI: $62,500", "NOI: $62,500 per year", False),
    ("noi", "NOI: $62,500", "Pro NOI:$62,500\nNOI: $62,500", False),  # its first place is spelled otherwise
    ("noi", "NOI: $62,500", "xNOI: $62,500", False),
    ("noi", "NOI: ($62,500)", "NOI: ($62,500)", False),
    ("noi", "NOI 62,500", "NOI 62,500", False),
    ("cap_rate", "Rate: 5.25%", "Rate: 5.25%", True),
    ("cap_rate", "Rate: 0.05", "Rate: 0.05\n%", True),
    ("cap_rate", "Rate ... 5%", "Rate\n5%", False),
    ("property_type", "Priority: 5-LOW", "Status: F\nPriority: 5-LOW", True),
    ("property_type", "Mini-Storage", "a mini-storage campus", True),
    ("property_type", "Mini-Storage", "a mini-\nstorage campus", False),
    ("property_type", "(mini)", "a (mini) campus", False),
    ("property_type", "Café", "a café", False),
]


def test_plain_quotes_are_as_the_long_way_reads_them(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ROWS)], "i int, field_name string, s string, p string")
    line = quotes.with_line_quote(df, "s", "p", spec.is_numeric(F.col("field_name")))
    long = cite.with_support(df, "s", "p")
    got = {r.i: r for r in line.collect()}
    want = {r.i: r for r in long.collect()}
    for i, (*_, plain) in enumerate(ROWS):
        assert got[i].l_found == plain, ROWS[i]
        if plain:
            assert want[i].q_found and got[i].l_chars >= 8
            assert (got[i].l_text is None and want[i].q_texts is None) or [got[i].l_text] == want[i].q_texts
            if got[i].l_figure:
                assert [(m.value, m.kind) for m in want[i].q_numbers] == [tuple(got[i].l_figure)]


def test_pages_and_citations_meet_once(spark):
    pages = [(1, 0, "a.pdf", 1, "A"), (1, 1, "b.pdf", 1, "B"), (1, 2, "B.PDF", 1, "B2"), (1, 3, None, 1, "N"), (1, 4, "a.pdf", 2, "two")]
    cites = [(0, "A.pdf", 1), (1, "b.pdf", 1), (2, "x", 2), (3, "x", 9), (4, "x", 1), (5, None, 2), (6, "a.pdf", None)]
    cited = cite.attach_pages(
        spark.createDataFrame([(1, *c) for c in cites], "deal_id long, c int, source_document string, page_number int"),
        spark.createDataFrame(pages, "deal_id long, page_ord int, file_name string, page_number int, text string"),
    )
    got = {r.c: (r.page_text, r.page_problem and r.page_problem.split()[0]) for r in cited.collect()}
    assert got == {0: ("A", None), 1: (None, "Page"), 2: ("two", None), 3: (None, "The"), 4: (None, "Page"), 5: ("two", None), 6: (None, "The")}
    assert cited.count() == len(cites)
    # Page text and page keys come from one read of the pages, the citations move once.
    assert cited._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_a_label_and_its_figure_are_read_as_in_any_passage(spark):
    from citeframe.operators.passages import plain_rest, with_labelled_figure

    # form, label, the figure as text where the passage is no more than both
    rows = [
        ("loan amount: $5", "loan amount", "$5"), ("rate: 5.25%", "rate", "5.25%"), ("rate: 5.25% fixed", "rate", None),
        ("the rate: 5", "rate", None), ("loan usd: 5", "loan usd", None), ("unit 2: 5", "unit 2", None), ("rate: -5", "rate", None),
        ("rate: 5 6", "rate", None), ("taux d'intérêt: 5", "taux d'intérêt", None), ("rate 5", "rate", None),
    ]
    df = spark.createDataFrame([(i, f, x) for i, (f, x, _) in enumerate(rows)], "i int, form string, label string")
    read = with_labelled_figure(df.withColumn("rest", plain_rest(F.col("form"), F.col("label"))), F.col("label"))
    for r in read.collect():
        assert r.rest == rows[r.i][2], rows[r.i]
        if r.rest:
            assert r.form[r.figure_start:] == r.rest.lstrip("$"), rows[r.i]
