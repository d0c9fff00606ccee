"""Exact, line and near dedup, decontamination: brute force on small tables."""

import random
from collections import Counter
from pathlib import Path

import brute
import pytest

from citeframe.llm import decontaminate, exact_dedup, lines, near_dedup
from citeframe.llm.components import connected_components

DOC = "doc_id long, text string, source string"


def vocabulary(seed, size=300):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefgéß") for _ in range(draw.randint(2, 8))) for _ in range(size)]


def test_exact_dedup_matches_brute_force(spark):
    draw = random.Random(1)
    bodies = [" ".join(draw.choices(vocabulary(2), k=6)) for _ in range(30)]
    rows = [(k, draw.choice(bodies).replace(" ", draw.choice([" ", "\t\n", "  "]))) for k in range(400)]
    rows += [(7, bodies[0]), (7, bodies[0]), (None, "only null"), (None, bodies[1]), (900, None), (901, ""), (902, None), (903, "x" * 200_000)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, sha string, keep_id int").repartition(5)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.dedupe_exact(df).collect())
    assert got == Counter(brute.exact(rows))


def test_exact_dedup_of_nothing(spark):
    out = exact_dedup.dedupe_exact(spark.createDataFrame([], DOC))
    assert out.count() == 0 and out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_lines_match_brute_force(spark):
    draw = random.Random(3)
    common, words = ["Read more", "  Subscribe\t", "©"], vocabulary(4)
    rows = []
    for k in range(200):
        body = [" ".join(draw.choices(words, k=4)) for _ in range(draw.randint(0, 6))]
        body += [c for c in common if draw.random() < 0.12] + [""] * draw.randint(0, 2)
        draw.shuffle(body)
        rows.append((k, draw.choice(["a", "b", None]), "\n".join(body)))
    rows += [(500, "a", None), (501, "a", ""), (502, None, "Read more"), rows[3], rows[3]] + [(600 + k, "b", "same page\nfor all") for k in range(150)]
    df = spark.createDataFrame([(i, t, h, 5, "k") for i, h, t in rows], "doc_id long, text string, source string, n_lines int, keys string")
    out = lines.drop_boilerplate(df, "source", ratio=0.1, min_pages=3).select("doc.doc_id", "n_lines", "n_dropped", "text")
    assert Counter(map(tuple, out.collect())) == Counter(brute.clean_lines(rows, 0.1, 3))
    assert lines.drop_boilerplate(spark.createDataFrame([], DOC)).count() == 0


def test_host_of(spark):
    urls = [("https://A.Example.com:8080/x?y",), ("http://u@b.org#f",), ("nothing",), (None,)]
    got = [r[0] for r in spark.createDataFrame(urls, "url string").select(lines.host_of("url")).collect()]
    assert got == ["a.example.com", "b.org", "", None]


def near_rows(seed):
    draw, words = random.Random(seed), vocabulary(seed + 1)
    docs = {}
    base = draw.choices(words, k=120)
    for k in range(60):  # one large group of near copies with different edits
        copy = list(base)
        for _ in range(draw.randint(0, 5)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        docs[k] = " ".join(copy)
    for k in range(60, 120):
        docs[k] = " ".join(draw.choices(words, k=draw.randint(1, 40)))
    for k in range(120, 160):  # chains: each differs a little from its predecessor
        prior = docs[k - 1].split()
        prior[draw.randrange(len(prior))] = draw.choice(words)
        docs[k] = " ".join(prior)
    docs |= {200: None, 201: "", 202: " \n", 203: "one", 204: "ONE", 205: "two words", 206: docs[3].upper(), 207: docs[3]}
    return docs


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_matches_brute_force(spark, size, percent):
    docs = near_rows(size)
    rows = [(k, t, "x", True) for k, t in docs.items()] + [(203, "one", "x", True), (None, docs[3], "x", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept boolean")
    out = near_dedup.link_near_duplicates(df, shingle_words=size, percent=percent).collect()
    want = brute.near_duplicates(docs, size, percent)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
            assert r.n_shingles == len(brute.shingles(docs[r.doc_id], size))


def test_near_dedup_of_nothing(spark):
    assert near_dedup.link_near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    one = near_dedup.link_near_duplicates(spark.createDataFrame([(4, None, "s")], DOC)).collect()
    assert [tuple(r) for r in one] == [(4, 0, 4, True)]


def test_remaining_pairs_are_all_compared(spark, monkeypatch):
    """With a single turn, what the chosen members miss is left to the full comparison."""
    monkeypatch.setattr(near_dedup, "_MOST_TURNS", 1)
    docs = near_rows(11)
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], DOC)
    got = {r.doc_id: r.component_id for r in near_dedup.link_near_duplicates(df, shingle_words=3, percent=85).collect()}
    assert got == brute.near_duplicates(docs, 3, 85)


def test_odd_sketch_estimates_the_distance():
    import numpy as np

    draw = np.random.default_rng(5)
    samples = draw.integers(0, 2**63, (1, 120), dtype=np.uint64)
    other = samples.copy()
    other[0, :12] = draw.integers(0, 2**63, 12, dtype=np.uint64)
    bits = lambda x: int(np.bitwise_count(near_dedup.odd_sketch(samples) ^ near_dedup.odd_sketch(x)).sum())
    assert bits(samples) == 0
    assert 10 <= bits(other) <= 24 and bits(other) % 2 == 0


def test_components_match_union_find(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(150), draw.randrange(150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(300, 300), (None, 4)]
    edges += [(400, 400 + k) for k in range(1, 50)] + [(500 + k, 550) for k in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    plain = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute.components({n for e in plain for n in e}, plain)


def test_leaks_match_brute_force(spark):
    draw, words = random.Random(21), vocabulary(22)
    items = [(k, " ".join(draw.choices(words, k=n))) for k, n in enumerate([5, 6, 9, 30, 64, 69, 120, 400])]
    items += [(20, "two words"), (21, "Single"), (22, ""), (23, None), (24, "   "), (3, items[3][1])]
    docs = []
    for k in range(80):
        body = draw.choices(words, k=draw.randint(0, 300))
        if k % 3 == 0:
            item = draw.choice(items[:8])[1].split()
            for _ in range(draw.randint(0, len(item) // 20 + 1)):
                item[draw.randrange(len(item))] = "changed"
            body[draw.randint(0, len(body)) : 0] = item
        docs.append((k, " ".join(body)))
    docs += [(100, "TWO  Words"), (101, "two"), (102, "a single case"), (103, None), (104, ""), (None, items[4][1]), docs[0], docs[0]]
    want = Counter(brute.leaks(docs, items, 5, 0.8))
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (10**6, 100):
        out = decontaminate.find_leaks(left, right, block_words=block_words)
        assert Counter((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in out.collect()) == want
    assert decontaminate.find_leaks(left, right.limit(0)).count() == 0
    assert decontaminate.find_leaks(left.limit(0), right).count() == 0


def test_leaks_of_a_block_are_written_before_the_next_is_fetched(spark, monkeypatch):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before, written = set(folder.glob("leaks-*/block=*/_SUCCESS")), []

    def blocks(items, block_words):
        for row in items.orderBy("id").collect():
            written.append(len(set(folder.glob("leaks-*/block=*/_SUCCESS")) - before))
            yield [(row["id"], row["text"])]

    monkeypatch.setattr(decontaminate, "item_blocks", blocks)
    docs = spark.createDataFrame([(k, f"a b c d e f g h i{k}") for k in range(3)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"d e f g h i{k}") for k in range(3)], "item_id long, text string")
    out = decontaminate.find_leaks(docs, items, containment=1.0)
    assert written == [0, 1, 2] and "MapInArrow" not in out._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_size_partitions_have_their_own_samples_and_cuts():
    draw = random.Random(17)
    words = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(draw.choices(words, k=n))) for k, n in enumerate([1, 3, 4, 5, 6, 8, 12, 20, 36, 60, 100, 300, 1500])]
    block = decontaminate.ItemBlock(items, 5, 0.8)
    held = {key: [i[0] for i in p.items] for key, p in block.partitions.items()}
    assert sorted(sum(held.values(), [])) == list(range(len(items)))
    full = {size for width, size in held if width == 5}
    assert len(full) >= 8 and len({p.functions for p in block.partitions.values()}) >= 5
    for (width, size), p in block.partitions.items():
        assert p.functions == decontaminate.functions_of(size)
        for number, (item_id, text, need) in enumerate(p.items):
            count = max(1, len(text.split()) - 4)
            kept = sum(number in found for found in p.probes.values())
            assert 1 <= need <= kept <= min(p.functions, count)
    # Of every size, the item is found with a fifth of its shingles gone, and not with half.
    for item_id, text in items[3:]:
        tokens = text.split()
        count = len(tokens) - 4
        near = " ".join(tokens[: len(tokens) - int(count * 0.2)])
        half = " ".join(tokens[: 4 + int(count * 0.5)])
        assert item_id in [m[0] for m in block.matches("x y " + near + " z")]
        assert item_id not in [m[0] for m in block.matches("x y " + half + " z")]
