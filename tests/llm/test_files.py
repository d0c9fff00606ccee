"""Token files, whitening and the Merkle manifest against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeframe.llm import merkle, sha256, token_files, whitening
from citeframe.llm.catalog import LLM_QUERIES

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "",
    "  \t ",
    "äb  ć ̈x",
    "ΣΑΣ σας ΟΔΟΣ.",
    "İstanbul DIŞ ẞ",
    "x<|endoftext|>y <|startoftext|> <|endoftext|",
    "it's we'll don'T o'clock ''s",
    "l'été 12,345.67 ÀÉîß, ÿÆ. µm ªº ÷×",
    "a b c\u0085d\x1ce​",
    "foo_bar{x}|~ `q A.B.C...",
    "ﬁ Å ½ 日本語 \U0001f600\U0001f600 ok.\tt\x0bv\x0cf",
]


# Token files.


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    draw = np.random.default_rng(bits)
    for count in (0, 1, 7, 8, 1000):
        ids = draw.integers(0, 1 << bits, count, dtype=np.uint64).astype(np.uint32)
        raw = token_files.pack(ids, bits)
        assert len(raw) == -(-count * bits // 8) and np.array_equal(token_files.unpack(raw, bits, count), ids)
    if bits < 32:
        with pytest.raises(ValueError):
            token_files.pack(np.array([1 << bits], np.uint32), bits)
    assert token_files.bits_for(1 << bits) == bits and token_files.bits_for((1 << bits) + 1) == bits + 1


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_is_that_of_the_library(file):
    """Word by word or whole, as the vocabulary allows, with caches emptied between."""
    path = public_tokenizers.path(file)
    library, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path)
    assert encoder.by_words == encoder.plain == (file == "word_bpe_49k.json")
    draw = random.Random(5)
    marks = ["a", "B", "é", "e", "́", " ", "\n", "'", "s", ".", "7", "<|endoftext|>", "ß", "ſ", "ı", "-", "あ"]
    texts = ODD + ["".join(draw.choices(marks, k=draw.randint(0, 40))) for _ in range(400)] + ["word " * 5000, "x" * 20_000]
    for k in range(0, len(texts), 50):
        part = texts[k : k + 50]
        ids, starts = token_files.encode_texts(pa.array([*part, None]), encoder)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)] + [[]]
        encoder.known.clear()


def token_rows():
    rows = [(k * 7 % 50, text) for k, text in enumerate(ODD)] + [(None, "null id"), (None, "null id"), (3, None), (3, "again"), (2**40, "big " * 3000)]
    return rows + [(5, f"many rows of one id {k}") for k in range(200)]


def test_token_files_hold_all_documents_in_order(spark, tmp_path):
    rows = token_rows()
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(5)
    manifest = token_files.write_token_files(docs, VOCABULARY, end_id=1, folder=f"{tmp_path}/ids", block_ids=64)
    files = sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["shard"])
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted(((i is None, i or 0), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    told = sorted(((r.doc_id is None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert told == want
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got if r.doc_id is not None)) + [None, None]
    ends = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == ends[:-1].tolist() and all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert sum(f["n_ids"] for f in files) == ends[-1] and sum(f["n_docs"] for f in files) == len(rows)
    # Any range is read by itself, over the edges of blocks.
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    draw = random.Random(8)
    for file in files:
        read = token_files.IdFile(file["file"])
        assert read.bits == 16 and len(read.offsets) == -(-file["n_ids"] // 64) + 1
        for _ in range(20):
            a, b = sorted(draw.randint(0, file["n_ids"]) for _ in range(2))
            assert np.array_equal(read.ids(a, b), stream[file["first_id"] + a : file["first_id"] + b])
        read.close()


def test_token_files_of_an_empty_table_and_without_end(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    out = token_files.read_token_files(token_files.write_token_files(docs, VOCABULARY)).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in out) == [(1, 0, 0, b""), (2, 0, 0, b"")]
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), VOCABULARY, 1)).count() == 0


def test_token_files_query(spark):
    library = Tokenizer.from_file(VOCABULARY)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    df = LLM_QUERIES["op11_token_files"](spark, SF_DIR)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in df.collect()) == want


# Whitening.


@pytest.mark.parametrize("kind", ["plain", "few", "axes", "line", "equal", "one", "wide"])
def test_rank_one_updates_give_the_spectrum(kind):
    draw = np.random.default_rng(3)
    rows = {
        "plain": draw.normal(size=(200, 12)) * 30,
        "few": draw.normal(size=(4, 9)),
        "axes": np.eye(6)[draw.integers(0, 6, 60)] * 300,
        "line": np.outer(draw.normal(size=80), np.ones(5)),
        "equal": np.full((20, 4), 7.0),
        "one": draw.normal(size=(30, 1)),
        "wide": draw.normal(size=(100, 8)) * 10.0 ** np.arange(-4, 4),
    }[kind]
    scatter = np.cov(rows.T, bias=True).reshape(rows.shape[1], -1) * len(rows)
    whole, first, second = (whitening.Spectrum.empty(rows.shape[1]) for _ in range(3))
    for k, row in enumerate(rows):
        whole.add(row)
        (first if k % 3 else second).add(row)
    first.merge(second)
    size = max(np.abs(scatter).max(), 1.0)
    for found in (whole, first):
        made = found.vectors @ np.diag(found.values) @ found.vectors.T
        assert found.n == len(rows) and np.allclose(found.mean, rows.mean(axis=0), atol=1e-9)
        assert np.abs(made - scatter).max() < 1e-11 * size and np.abs(found.vectors.T @ found.vectors - np.eye(rows.shape[1])).max() < 1e-11


def whitened_by_hand(rows, components=4):
    """rows: (id, vector). One (id, component, n, deviation, whitened, explained) each."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique([x for _, x in kept], axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, sums))
        for c in range(min(components, len(values))):
            out[i, c + 1] = (n, deviation, ((x - sums / n) @ vectors[:, c]) / np.sqrt(values[c]), values[c] / values.sum())
    return out


def test_whitening_matches_numpy(spark):
    draw = np.random.default_rng(9)
    spread = 3.0 ** -np.arange(6)
    rows = [(k, (draw.normal(size=6) * spread + 2).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)]  # a group of copies
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 4), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [1.0] * 5), (2005, [])]
    table = spark.createDataFrame([(i, v, i) for i, v in rows + bad], "vec_id long, embedding array<float>, n long").repartition(7)
    want = whitened_by_hand(rows)
    out = whitening.whiten(table, 4).collect()
    assert len(out) == len(rows) and len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-10
    signs = {}
    for r in out:
        for c in range(4):
            n, deviation, whitened, explained = want[r.id, c + 1]
            assert (r.n, r.deviation) == (n, deviation) and r.explained[c] == pytest.approx(explained, rel=1e-9)
            signs.setdefault(c, np.sign(r.whitened[c] * whitened))
            assert r.whitened[c] * signs[c] == pytest.approx(whitened, abs=1e-8)


def test_whitening_without_variance_and_empty(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(one, 4).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(1, 0, [None, None], [None, None], None)] * 3
    two = one.unionByName(spark.createDataFrame([(3, [5.0, 2.0])], one.schema))
    out = {r.id: r for r in whitening.whiten(two, 4).collect()}
    assert [abs(out[3].whitened[0]), out[3].whitened[1]] == [pytest.approx(1.0), None] and out[1].explained == [1.0, 0.0]
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 0.0])], one.schema)
    assert [r.deviation for r in whitening.whiten(huge).orderBy("id").collect()] == [None, None, 1]
    assert whitening.whiten(one.limit(0)).count() == 0 and whitening.whiten(one.filter("vec_id = 1")).count() == 1


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    want = whitened_by_hand(rows)
    out = LLM_QUERIES["op12_whitening"](spark, SF_DIR).collect()
    assert {(r.vec_id, r.component) for r in out} == set(want)
    for r in out:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened) == pytest.approx(abs(whitened), abs=1e-7)
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9


# Merkle manifest.


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(digests, fanout):
    out = [list(digests)]
    while len(out[-1]) > 1:
        out.append([hashed(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def climb(levels, at, digest, fanout):
    """The top with one leaf replaced, and the siblings on the way."""
    proof = []
    for below in levels[:-1]:
        first = at // fanout * fanout
        run = below[first : first + fanout]
        proof += run[: at - first] + run[at - first + 1 :]
        digest = hashed(*run[: at - first], digest, *run[at - first + 1 :])
        at //= fanout
    return digest, proof


def manifest_by_hand(leaves, fanout):
    """leaves: (id, source, digest, replaced). One row per leaf, in no order."""
    sources = {}
    for row in leaves:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3])) for s, rows in sources.items()}
    low = {s: levels_of([r[2] for r in trees[s]], fanout) for s in names}
    high = levels_of([low[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for at, (i, _, digest, replaced) in enumerate(trees[s]):
            subroot, proof = climb(low[s], at, replaced, fanout)
            top, rest = climb(high, k, subroot, fanout)
            out.append((i, s, digest, low[s][-1][0], high[-1][0], hashed(*proof, *rest), top, top == high[-1][0]))
    return out


def test_hash_states_are_those_of_sha256():
    digests = [hashed(str(k)) for k in range(300)]
    words = sha256.from_hex(digests)
    assert sha256.to_hex(words) == digests
    state = sha256.start(300)
    for children in range(1, 5):
        state = sha256.absorb(state, words, rows=128)
        assert sha256.to_hex(sha256.finish(state, children)) == [hashed(*[d] * children) for d in digests]


@pytest.mark.parametrize("fanout", [2, 3, 5])
@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 9, 10, 27, 28, 82, 243])
def test_subtrees_resume_the_state_of_a_slot(fanout, size):
    digests = [hashed(str(k)) for k in range(size)]
    changed = [hashed("other", d) for d in digests]
    levels = levels_of(digests, fanout)
    tree = merkle.Subtree(sha256.from_hex(digests), merkle.depth_of(size, fanout), fanout)
    assert [sha256.to_hex(n) for n in tree.nodes] == levels
    folded, siblings = sha256.to_hex(tree.fold(sha256.from_hex(changed))), tree.siblings()
    for k in range(0, size, 7):
        want, proof = climb(levels, k, changed[k], fanout)
        assert folded[k] == want and siblings[k] == "".join(proof).encode() == merkle.proof_text(tree.path(k))
        assert sha256.to_hex(merkle.fold_path(sha256.from_hex([changed[k]]), tree.path(k))) == [want]


def manifest_rows(counts):
    rows = []
    for source, count in counts.items():
        rows += [(k * 3, source, hashed(str(source), str(k)), hashed("x", str(k)) if k % 4 == 0 else hashed(str(source), str(k))) for k in range(count)]
    return rows


@pytest.mark.parametrize("fanout,levels", [(3, 2), (3, 7), (2, 1)])
def test_manifest_matches_plain_hashing(spark, fanout, levels):
    """One hot source over several tiers, null and odd names, single and repeated leaves."""
    rows = manifest_rows({None: 5, "": 1, "a": 260, "-": 2, "s": 3, "é": 9, "z\U0001f600": 1, "z￿": 4})
    rows += [rows[10]] * 3 + [(None, "a", hashed("n"), hashed("m"))] * 2
    leaves = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, source string, digest string, replaced string, tree string, at int").repartition(6)
    out = merkle.dataset_manifest(leaves, fanout, levels)
    assert out.columns == ["id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(manifest_by_hand(rows, fanout), key=key)


def test_manifest_of_one_leaf_and_of_none(spark):
    schema = "id long, source string, digest string, replaced string"
    lone = spark.createDataFrame([(1, None, hashed("a"), hashed("b"))], schema)
    assert tuple(merkle.dataset_manifest(lone).first()) == (1, None, *[hashed("a")] * 3, hashed(""), hashed("b"), False)
    assert merkle.dataset_manifest(lone.limit(0)).count() == 0


def test_leaf_digest_frames_values(spark):
    rows = [(1, "s:1", None, 0, "hé\n"), (None, None, "", None, None)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [r[0] for r in table.select(merkle.leaf_digest(*(F.col(c) for c in table.columns))).collect()]
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted(got) == sorted(hashed(*map(framed, r)) for r in rows)
