"""Registered corpus queries against their SQL, and the pipeline against brute force."""

import sys
from collections import Counter
from pathlib import Path

import brute
import corpus_pipeline
import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import TABLES, rows_of  # noqa: E402

from citeframe.llm import mixing, toxicity  # noqa: E402
from citeframe.llm.catalog import LLM_ORACLES, LLM_QUERIES, quality_weights, toxicity_model  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_query_matches_sql(spark, con, name):
    df = LLM_QUERIES[name](spark, SF_DIR)
    result = con.execute(LLM_ORACLES[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_near_dedup_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    want = brute.near_duplicates(docs, 3, 85)
    out = LLM_QUERIES["op2_near_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: r.component_id for r in out} == want and len(set(want.values())) < len(want)


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity_model(spark, docs, SF_DIR)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]

    def margin(text):
        ids = sorted(set(toxicity.features(text).tolist()))
        return float(model.weights[ids].sum(dtype="float64")) + model.bias

    rows = [r.asDict() for r in docs.collect()]
    least = -0.8472978603872034  # log(0.3 / 0.7)
    rows = [r for r in rows if margin(r["text"]) < least]
    texts = {i: t for i, _, _, t in brute.clean_lines([(r["doc_id"], r["source"], r["text"]) for r in rows], 0.1, 3)}
    component = brute.near_duplicates(texts, 5, 80)
    rows = [r | {"text": texts[r["doc_id"]]} for r in rows if component[r["doc_id"]] == r["doc_id"]]
    leaky = {d for d, *_ in brute.leaks([(r["doc_id"], r["text"]) for r in rows], items, 5, 0.8)}
    rows = [r for r in rows if r["doc_id"] not in leaky]
    weight = {1: 2.0, 0: 0.5}
    _, _, sizes, copies = brute.mix([(r["doc_id"], r["source"], r["text"], weight.get(quality.get(r["doc_id"]), 1.0)) for r in rows])
    want = {(r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"]), c, c * n) for r, n, c in zip(rows, sizes, copies) if c}
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and leaky


def test_stages_accept_an_empty_table_and_nulls(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some text", "en", "s", 9), (1, "", None, None, 0)], docs.schema)
    for table, least in ((docs.limit(0), 0), (odd, 1)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, SF_DIR)
            assert name == "mixing" or out.columns == docs.columns
            kept = spark.createDataFrame(out.collect(), out.schema)
        assert kept.count() >= least


def test_items_shorter_than_a_shingle_are_reported_and_drop_nothing(spark, tmp_path):
    docs = [(1, "the clean page says so", "en", "s", 22), (2, "x one two three four five six y", "en", "s", 31), (3, "so", "en", "s", 2)]
    items = [(1, "the"), (2, "clean page"), (3, "one two three four"), (4, "one two three four five"), (5, "So")]
    spark.createDataFrame(docs, spark.read.parquet(f"{SF_DIR}/documents.parquet").schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    result = connection.execute(LLM_ORACLES["op5_decontamination"])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    df = LLM_QUERIES["op5_decontamination"](spark, str(tmp_path))
    got = df.collect()
    assert rows_of(df.columns, [tuple(r) for r in got]) == want and sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 2), (1, 5), (2, 3), (2, 4), (3, 5)]
    kept = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_mixing_stage_takes_what_the_plan_takes(spark):
    """Rows that repeat id and text, across sources too, keep the copies planned for them."""
    rows = [(None, "x y z", "en", "a", 5)] * 40 + [(None, None, "en", "b", None)] * 3 + [(None, None, "de", None, None)] * 2
    rows += [(7, "one two", "en", "b", 7)] * 30 + [(7, "one two", "en", "c", 7)] * 60  # the budget of c ends after 45
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF_DIR}/documents.parquet").schema)
    plan = mixing.mix_sources(docs, quality_of=quality_weights(spark, SF_DIR))
    planned = plan.collect()
    want = Counter((r.doc_id, r.source, r.copies, r.taken) for r in planned if r.copies)
    out = corpus_pipeline.mix(spark, docs, SF_DIR)
    assert out.columns == [*docs.columns, "copies", "taken"]
    assert Counter((r.doc_id, r.source, r.copies, r.taken) for r in out.collect()) == want
    groups = {(r.doc_id, r.source, r.text_hash) for r in planned}
    assert len({(r.doc_id, r.source, r.text_hash, r.copies) for r in planned}) > len(groups)


def test_stages_accept_columns_of_the_same_names(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    clash = {"score": "0.5D", "predicted": "1", "copies": "'c'", "taken": "'t'", "_size": "7", "doc": "'d'", "host": "'h'", "kept": "true"}
    wide = docs.selectExpr("*", *(f"{value} AS {name}" for name, value in clash.items()))
    for name, stage in corpus_pipeline.STAGES:
        out, plain = stage(spark, wide, SF_DIR), stage(spark, docs, SF_DIR)
        own = [c for c in wide.columns if name != "mixing" or c not in ("copies", "taken")]
        assert out.columns == (own if name != "mixing" else [*own, "copies", "taken"])
        ids = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        assert ids(out) == ids(plain)
        assert out.filter("score <> 0.5 or predicted <> 1 or doc <> 'd'").count() == 0
