"""Chunk cutting against the rule written out plainly."""

import random

import pytest
from pyspark.sql import functions as F

from citeframe.functions.text import clean_for_chunks
from citeframe.operators import chunks as ch


def plain_chunks(text, size, overlap):
    out, start, least = [], 0, size * 3 // 5
    while text:
        if start + size >= len(text):
            stop = len(text)
        else:
            window = text[start + least : start + size]
            cut = max(window.rfind(" "), window.rfind("\n\n"))
            stop = start + least + cut + 1 if cut >= 0 else start + size
        out.append(text[start:stop].strip())
        if stop >= len(text):
            break
        start = max(start + 1, stop - overlap)
    return [c for c in out if c]


@pytest.mark.parametrize("size,overlap", [(1200, 200), (10, 3), (7, 6), (5000, 100), (1, 0)])
def test_chunks_follow_the_rule(spark, size, overlap):
    draw = random.Random(size)
    texts = ["", " ", "a", "x" * 4500, "ä" * 2048 + " b" * 1500, "one two " * 900, None]
    for _ in range(60):
        parts = draw.choices(["a", "bcd", "é", " ", " ", "\n", "\n\n", ".", "word " * 40, "y" * 60], k=draw.randint(1, 120))
        texts.append("".join(parts))
    if size == 1:
        texts = [t[:300] if t else t for t in texts]
    rows = spark.createDataFrame([(i, 0, 1, t) for i, t in enumerate(texts)], "doc_id int, page_ord int, page_number int, text string")
    got = {}
    for r in sorted(ch.chunk_pages(rows, size, overlap).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append(r.content)
    cleaned = {r.doc_id: r.c for r in rows.select("doc_id", clean_for_chunks(F.col("text")).alias("c")).collect()}
    assert got == {i: w for i, t in cleaned.items() if (w := plain_chunks(t, size, overlap))}


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, 10), (10, -1), (-5, 0)])
def test_parameters_are_checked(spark, size, overlap):
    with pytest.raises(ValueError):
        ch.chunk_pages(spark.createDataFrame([(1, 0, 1, "a")], "doc_id int, page_ord int, page_number int, text string"), size, overlap)
