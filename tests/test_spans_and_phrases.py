"""Span joins and the positional index against the row-local rules."""

import random

from pyspark.sql import functions as F

from citeframe.functions import numbers, quotes
from citeframe.functions.plans import running_sum
from citeframe.functions.text import norm
from citeframe.operators import phrases, spans


def test_running_sums(spark):
    draw = random.Random(2)
    rows = [([draw.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 23, 24, 25, 64, 257, 3000)]
    out = spark.createDataFrame(rows, "a array<int>").select("a", running_sum("a").alias("s")).collect()
    for row in out:
        assert row.s == [sum(row.a[: k + 1]) for k in range(len(row.a))]


FIXED = [
    ("Loan Amount: $3,250,000", "LOAN   AMOUNT:\n$3,250,000 and Loan Amount: $3,250,000"),
    ("leasing has been slow", "leas-\ning has been slow"),
    ("revenue rose ... past $88K", "Revenue rose every quarter until it went past $88K"),
    ("revenue rose ... past $88K", "Revenue rose 12 times past $88K"),
    ("past $88K ... Revenue rose", "Revenue rose past $88K"),
    ("a b ... c ... d e", "a b x a b c y d e z c d e"),
    ("known as ... depot", "Known as " + "so " * 60 + "Depot"),
    ("known as ... depot", "Known as " + "so " * 48 + "Depot"),
    ("Großhof ... Straße 7", "GROSSHOF an der STRASSE 7"),
    ("(a) ... (b)", "x(a)y " + "w " * 73 + "z(b)q"),
    ("... ...", "some words"),
    ("", "some words"),
]


def test_quotes_by_position_match_patterns(spark):
    draw = random.Random(11)
    pieces = ["a", "b", "ab", "7", "42", "-", "-\n", "...", " ", " ", "\n", "(", ")", "é", "x", "$"]
    rows = list(FIXED)
    while len(rows) < 400:
        page = "".join(draw.choices([p for p in pieces if p != "..."] + ["word " * 9], k=draw.randint(5, 40)))
        rows.append(("".join(draw.choices(pieces, k=draw.randint(1, 5))), page))
    data = [(i, i % 7, i, s, p, n) for i, (s, p) in enumerate(rows) for n in (False, True)]
    data = [(2 * i + n, d, o, s, p, n) for i, d, o, s, p, n in data]
    table = spark.createDataFrame(data, "quote_id int, deal_id int, page_ord int, snippet string, text string, numeric boolean")
    told = quotes.with_quote(table, "snippet", "text", F.col("numeric")).collect()
    index = phrases.postings(table.filter("numeric").select("deal_id", "page_ord", "text"))
    got = {r.quote_id: r for r in phrases.find_quotes(table, index).collect()}
    assert {r.quote_id for r in told if r.q_found} == set(got)
    for r in told:
        if r.q_found and r.numeric:
            assert (r.q_joined, r.q_start, r.q_stop) == (got[r.quote_id].joined, got[r.quote_id].start, got[r.quote_id].stop), r
    assert sum(r.q_found for r in told) > 60 and any(r.q_joined for r in told)


def test_an_index_of_the_words_asked_for_finds_the_same(spark):
    page = "the yard and the road " * 40 + "Creek Road of Straße 7, see Creek\nRoad; old mill-\nrace (a)b"
    asks = ["Creek Road ... (a)", "old millrace", "STRASSE 7", "Road of", "...", "", "yard road", "Creek ... 7 ... mill"]
    rows = [(2 * i + n, i, 0, s, page, bool(n)) for i, s in enumerate(asks) for n in (0, 1)]
    table = spark.createDataFrame(rows, "quote_id int, deal_id int, page_ord int, snippet string, text string, numeric boolean")
    pages = table.filter("numeric").select("deal_id", "page_ord", "text", phrases.asked_tokens(F.col("snippet")).alias("tokens"))
    whole, few = phrases.postings(pages), phrases.postings(pages, "tokens")
    found = lambda index: sorted(map(tuple, phrases.find_quotes(table, index).collect()))
    assert found(few) == found(whole) and len(found(whole)) >= 6
    assert few.count() * 5 < whole.count()
    assert few.exceptAll(whole.select(few.columns)).count() == 0


def test_literal_lookup_matches_the_pattern(spark):
    """The token lookup and the pattern give the same place and text."""
    draw = random.Random(4)
    pieces = ["a", "b", "ab", "7", "-", " ", " ", "\n", "(", "é"]
    rows = [("".join(draw.choices(pieces, k=draw.randint(1, 4))), "".join(draw.choices(pieces, k=30))) for _ in range(300)]
    table = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(rows)], "id int, s string, p string")
    for numeric in (True, False):
        found = quotes.with_quote(table, "s", "p", F.lit(numeric))
        parts = quotes.quote_parts(norm(F.col("s")))
        pattern = quotes.quote_pattern(parts, F.lit(numeric))
        plain = found.withColumn("_w", F.call_function("regexp_extract", norm(F.col("p")), pattern, F.lit(1)))
        for r in plain.filter("not q_joined").collect():
            assert r.q_found == bool(r._w)
            if r.q_found:
                assert (norm_text(r)[r.q_start : r.q_stop] if numeric else r.q_texts[0]) == r._w, r


def norm_text(row):
    return row.q_page


def test_values_in_quotes_match_row_local_reading(spark):
    draw = random.Random(7)
    texts = []
    for k in range(60):
        words = [draw.choice(["rent", "$1,200", "5%", "(300)", "lot-\nting", "12 units", "and", "2.5m", "\n", "7"]) for _ in range(draw.randint(1, 200))]
        texts.append((k % 5, k, " ".join(words)))
    pages = spark.createDataFrame(texts, "deal_id int, page_ord int, text string")
    figures = spans.page_figures(pages).collect()
    read = numbers.with_mentions(pages.withColumn("n", norm(F.col("text"))), "n").collect()
    assert sorted((f.page_ord, f.start, f.value) for f in figures if not f.joined) == sorted((r.page_ord, m.start, m.value) for r in read for m in r.mentions)
    claims = []
    for d, o, text in texts:
        for _ in range(8):
            a = draw.randint(0, 900)
            claims.append((d, o, False, a, a + draw.choice([0, 1, 30, 400]), draw.choice(["asking_price", "cap_rate", "units"]), draw.choice([1200.0, 5.0, 12.0, 7.0, 2.5e6, 300.0, None])))
    table = spark.createDataFrame(claims, "deal_id int, page_ord int, joined boolean, q_start int, q_stop int, field_name string, claim double")
    got = spans.values_in_quotes(table.withColumn("id", F.monotonically_increasing_id()), spans.page_figures(pages))
    ids = [r.id for r in got.select("id").distinct().collect()]
    local = table.withColumn("id", F.monotonically_increasing_id()).join(
        numbers.with_mentions(pages.withColumn("n", norm(F.col("text"))), "n").select("page_ord", "mentions"), "page_ord"
    )
    near = F.filter("mentions", lambda m: (m["start"] < F.col("q_stop")) & (F.col("q_start") < m["stop"]) & (F.col("q_stop") > F.col("q_start")))
    want = local.filter(F.exists(near, lambda m: numbers.supports(F.col("field_name"), F.col("claim"), m)))
    assert sorted(ids) == sorted(r.id for r in want.select("id").collect()) and ids
