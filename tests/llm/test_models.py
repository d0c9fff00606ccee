"""Toxicity and language-model scoring."""

import math
import random
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from citeframe.llm import lm, toxicity
from citeframe.llm.catalog import LLM_QUERIES

SF_DIR = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "toxic")
    rows = LLM_QUERIES["op8_toxicity"](spark, SF_DIR).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    hit = sum(r.toxic and r.predicted for r in held)
    # Only a few hundred labelled documents are toxic here, in four languages.
    assert hit >= 0.65 * sum(r.toxic for r in held) and hit >= 0.95 * sum(r.predicted for r in held)


def test_toxicity_edge_cases(spark):
    rows = [(k, "you idiot " + "word " * (k % 7) if k % 4 == 0 else "plain words " * (k % 9 + 1)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    odd = [(1, None, 5), (2, "", 6), (None, "IDIOT", 7), (None, "IDIOT", 7), (3, "an idiot " + "other stuff " * 20_000, 8)]
    out = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string, score int"), model, ["doc_id"]).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].score == by[2].score and by[None].score > 2 * by[1].score and by[3].predicted == 1
    nothing = toxicity.fit(toxicity.labelled(docs.limit(0), labels))
    alone = toxicity.fit(toxicity.labelled(docs, labels.filter("toxic = 0")))
    for model in (nothing, alone):
        assert toxicity.score(docs, model, ["doc_id"]).count() == 200
    assert toxicity.score(docs.limit(0), model).count() == 0


def lm_rows():
    draw = random.Random(31)
    alphabet = ["a", "b", "ab", " ", "  \n", "é", "日", "The", "x"]
    rows = [(k, "".join(draw.choices(alphabet, k=draw.randint(0, 60)))) for k in range(60)]
    return rows + [(100, None), (101, ""), (102, "never seen before ß!"), (103, "ab " * 9000), rows[3], rows[3], (None, "a b")]


def check_lm(rows, got, held):
    train = [t for i, t in rows if not held(i)]
    model = brute.Ppm(train)
    counts = Counter(w for t in train for w in brute.words(t))
    total, size = sum(counts.values()) + len(train), len(counts) + (1 if train else 0)
    want = Counter()
    for i, t in rows:
        c = [counts[w] for w in brute.words(t)] + [len(train)]
        base = sum(math.log10((n + 0.1) / (total + 0.1 * (size + 1))) for n in c)
        want[i, held(i), len(c), sum(n > 0 for n in c), total, round(base, 5), round(model.score(t), 5)] += 1
    told = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got)
    assert told == want


@pytest.mark.parametrize("piece", [4_000_000, 50])
def test_lm_matches_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(lm, "_PIECE", piece)
    rows = lm_rows()
    held = lambda i: i is not None and i % 3 == 0
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    check_lm(rows, lm.score_texts(df, F.col("doc_id") % 3 == 0).collect(), held)


def test_lm_without_training_texts(spark):
    rows = [(1, "abc"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_lm(rows, lm.score_texts(df, F.lit(True)).collect(), lambda i: True)
    assert lm.score_texts(df.limit(0), F.lit(False)).count() == 0


def test_pieces_cover_every_gram():
    raws = [b"", b"abcdefghij" * 3, b"z"]
    whole = Counter()
    for raw in raws:
        data = lm._START + raw + lm._END
        whole.update(data[k : k + 5] for k in range(len(raw) + 1))
    old, lm._PIECE = lm._PIECE, 7
    try:
        got = Counter(int(g).to_bytes(5, "big") for group in lm._pieces(raws) for g in lm.grams([p for _, p in group]))
    finally:
        lm._PIECE = old
    assert got == whole
