"""Token ids in files of fixed-width packed integers.

Every id takes the least number of bits that holds the largest id of the vocabulary. A
file holds the documents of one range of ids, in order:

    header    magic, bits an id, ids a block (8 bytes, two uint32)
    blocks    a fixed number of ids each, lowest bit first; the last block may be shorter
    index     uint64 byte offset of every block and of the end of the last one,
              uint64 first id of every document and of the end of the last one,
              int64 document ids, uint8 flags of the documents whose id is not null
    trailer   uint64 number of blocks, of documents, of ids, place of the index; magic

All numbers are little-endian. A block starts at a whole byte, so any range of ids is read
by one seek over the offsets and unpacked with numpy.

Rows are dealt to files by Spark's range partitioning on (document id, row), so a document
id that very many rows share spreads over several files. A task encodes its rows, packs
them block by block and writes one file under a name of its own; the row that Spark commits
for the task names that file. The file of a task that was lost or ran twice has no such
row, and nobody reads it.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut_lineage, shared_folder, ship_package
from .words import small_batches

MAGIC = b"PACKIDS1"
BLOCK_IDS = 1 << 16
_CACHE_WORDS = 300_000
_CACHE_LETTERS = 1_000_000
_CHUNK_WORDS = 20_000
_BATCH_BYTES = 6_000_000
_MANIFEST = "shard int, file string, n_docs long, n_ids long"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


# Packing.


def bits_for(vocabulary_size: int) -> int:
    """The least number of bits that holds every id below `vocabulary_size`."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return spread @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


# Encoding.

_ENCODERS: dict[str, WordEncoder] = {}
# Letters that have one code point and one lower case, then punctuation other than '.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_PROBES = ("One two", "it's we'LL, ok.", "\u00c4rger e\u0301t\u00e9 12,345.67!", "a_b{c}|~ \u03a3\u0391\u03a3 (x) -- \u65e5\u672c\u8a9e")


class WordEncoder:
    """Ids of words, each encoded by the tokenizers library when it is first seen. Forgets
    all words when it has grown to its bound.

    A vocabulary that drops white space lets the pieces between it be encoded apart:
    neither a token, a special token nor a step of the normaliser reaches across. Where it
    lowers case too, a run of Latin letters goes to its merges, and the punctuation after it
    is a piece of its own. Other vocabularies encode whole texts."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # four bytes an id
        whole = [self._encode([text])[0] for text in _PROBES]
        self.by_words = whole == [b"".join(self._encode(text.split())) for text in _PROBES]
        self.letters: dict[str, bytes] = {}
        self.alphabet, self.plain = {}, self.by_words
        if self.plain:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            latin = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
            self.alphabet = str.maketrans({c: "".join(piece for piece, _ in cut(c)) for c in latin})
            words = ["The", "an", *latin, *(f"A{c.upper()}z{c}" for c in latin if len(c.upper()) == 1 and ord(c.upper()) < 256)]
            self.plain = self._encode(words) == [self._merge(word.lower()) for word in words]

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", one.ids).tobytes() for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, letters: str) -> bytes:
        made = self.tokenizer.model.tokenize(letters.translate(self.alphabet) if not letters.isascii() else letters)
        ids = self.letters[letters] = array("I", [token.id for token in made]).tobytes()
        return ids

    def _punctuation(self, end: str) -> bytes:
        ids = self.letters[end] = self._encode([end])[0]
        return ids

    def ids_of(self, words: list[str]) -> list[bytes]:
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        if len(self.letters) > _CACHE_LETTERS:
            self.letters.clear()
        found, others = list(map(self.known.get, words)), []
        match, known, merged = _PLAIN.fullmatch, self.known, self.letters
        for k, ids in enumerate(found):
            if ids is not None:
                continue
            word = words[k]
            parts = match(word) if self.plain else None
            if parts is None:
                others.append(k)
                continue
            letters, end = parts.groups()
            letters = letters.lower()
            ids = merged.get(letters) or self._merge(letters)
            if end:
                ids += merged.get(end) or self._punctuation(end)
            found[k] = known[word] = ids
        for at in range(0, len(others), _CHUNK_WORDS):
            chunk = others[at : at + _CHUNK_WORDS]
            for k, ids in zip(chunk, self._encode([words[k] for k in chunk])):
                found[k] = known[words[k]] = ids
        return found


def encode_texts(texts: pa.Array, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text starts (and the last ends)."""
    texts = pc.fill_null(texts, "")
    if not encoder.by_words:
        made = encoder._encode(texts.to_pylist())
        return np.frombuffer(b"".join(made), np.uint32), np.cumsum([0, *map(len, made)]) // 4
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy()
    words = lists.flatten().dictionary_encode()
    ids_of = encoder.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
    flat = np.frombuffer(b"".join(ids_of), np.uint32)
    first = np.cumsum(sizes) - sizes
    word = words.indices.to_numpy()
    size = sizes[word]
    through = np.cumsum(size)
    total = int(through[-1]) if len(through) else 0
    shift = np.repeat(first[word] - (through - size), size)
    starts = np.append(0, through)[ends - ends[0]]
    return flat[shift + np.arange(total)], starts


# Files.


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark writes it; a plain path is local."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


class IdFileWriter:
    """Writes ids block by block; only the open block and the index are held."""

    def __init__(self, path: str, bits: int, block_ids: int = BLOCK_IDS):
        store, place = open_store(path)
        self.out = store.open_output_stream(place)
        self.bits, self.block_ids = bits, block_ids
        self.open: list[np.ndarray] = []
        self.held = self.count = self.at = 0
        self.offsets, self.docs, self.starts = [], [], []
        self._write(MAGIC + np.array([bits, block_ids], "<u4").tobytes())

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, docs: list[int | None], ids: np.ndarray, starts: np.ndarray) -> None:
        """Documents and their ids, which start at `starts` of `ids`."""
        self.docs += docs
        self.starts.append(self.count + starts.astype(np.uint64))
        self.count += len(ids)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            ids = np.concatenate(self.open)
            whole = len(ids) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._block(ids[at : at + self.block_ids])
            self.open = [ids[whole:].copy()]
            self.held = len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self._write(pack(ids, self.bits))

    def close(self) -> tuple[int, int]:
        if self.held:
            self._block(np.concatenate(self.open))
        place, blocks = self.at, len(self.offsets)
        self._write(np.array([*self.offsets, self.at], "<u8").tobytes())
        self._write(np.append(np.concatenate([np.empty(0, np.uint64), *self.starts]), np.uint64(self.count)).astype("<u8").tobytes())
        self._write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self._write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self._write(np.array([blocks, len(self.docs), self.count, place], "<u8").tobytes() + MAGIC)
        self.out.close()
        return len(self.docs), self.count


class IdFile:
    """Reads the index of a file once, then any range of ids by one seek."""

    def __init__(self, path: str):
        store, place = open_store(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        head = self.file.read_at(16, 0)
        if tail[32:] != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{path} is not a file of packed ids")
        self.bits, self.block_ids = (int(x) for x in np.frombuffer(head[8:], "<u4"))
        blocks, docs, self.count, at = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        raw = self.file.read_at(size - 40 - at, at)
        cut = [0, 8 * (blocks + 1), 8 * (blocks + docs + 2), 8 * (blocks + 2 * docs + 2)]
        self.offsets = np.frombuffer(raw[: cut[1]], "<u8").astype(np.int64)
        self.starts = np.frombuffer(raw[cut[1] : cut[2]], "<u8").astype(np.int64)
        self.docs = np.frombuffer(raw[cut[2] : cut[3]], "<i8")
        self.known = np.frombuffer(raw[cut[3] :], np.uint8).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from `start` up to `stop`, counted from the start of the file."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        raw = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        base = int(self.offsets[first])
        blocks = []
        for k in range(first, last + 1):
            count = min(self.block_ids, self.count - k * self.block_ids)
            blocks.append(unpack(raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], self.bits, count))
        ids = blocks[0] if len(blocks) == 1 else np.concatenate(blocks)
        return ids[start - first * self.block_ids : stop - first * self.block_ids]

    def runs(self, most_ids: int) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about `most_ids` ids, or of one document."""
        at = 0
        while at < len(self.docs):
            end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + most_ids, "right")) - 1)
            yield at, min(end, len(self.docs))
            at = end

    def close(self) -> None:
        self.file.close()


# Spark.


def _write_shard(folder: str, vocabulary: str, end_id: int | None, bits: int, block_ids: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId(), None
        encoder = WordEncoder.of(vocabulary)
        file = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        for batch in small_batches(batches, "text", _BATCH_BYTES):
            ids, starts = encode_texts(batch.column("text"), encoder)
            if end_id is not None:  # one more id after every text
                ids = np.insert(ids, starts[1:], end_id)
                starts = starts + np.arange(len(starts))
            writer = writer or IdFileWriter(f"{folder}/{file}", bits, block_ids)
            writer.add(batch.column("id").to_pylist(), ids, starts[:-1])
        if writer is not None:
            docs, count = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "file": [file], "n_docs": [docs], "n_ids": [count]}
            )

    return work


def write_token_files(
    df: DataFrame,
    vocabulary: str,
    end_id: int | None = None,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encodes every text, writes the ids and returns the manifest: one row per file with
    shard, file (its path), first_id (ids of all files before it), n_docs and n_ids.

    Files and the documents in them ascend by document id, null ids last; rows that share
    an id stay in the order of the scan. Null text is empty text, which has only the end id
    (`end_id`, none if null). Special tokens in a text are encoded as the vocabulary says;
    none is added. Only the two named columns are read. An empty table gives an empty
    manifest. The number of files is that of the shuffle partitions, fewer where run-time
    planning merges small ones. `vocabulary` is a file that every executor has; `folder`
    must be shared and is made if it does not exist.
    """
    spark = df.sparkSession
    ship_package(spark)
    folder = (folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}").rstrip("/")
    store, place = open_store(folder)
    store.create_dir(place, recursive=True)
    bits = bits_for(max(Tokenizer.from_file(vocabulary).get_vocab_size(), (end_id or 0) + 1))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_last("id"), F.asc("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    written = cut_lineage(dealt.mapInArrow(_write_shard(folder, vocabulary, end_id, bits, block_ids), _MANIFEST))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    first = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")
    return written.select("shard", F.concat(F.lit(f"{folder}/"), "file").alias("file"), first.alias("first_id"), "n_docs", "n_ids")


def _rows(read: IdFile, spans: Iterable[tuple[int, int]], first_id: int) -> Iterator[pa.RecordBatch]:
    for low, high in spans:
        start = int(read.starts[low])
        raw = read.ids(start, int(read.starts[high])).astype("<u4").tobytes()
        cuts = (read.starts[low : high + 1] - start) * 4
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(read.docs[low:high], mask=~read.known[low:high]),
                pa.array(read.starts[low:high] + first_id),
                pa.array(np.diff(read.starts[low : high + 1])),
                pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            ],
            names=["doc_id", "start", "n_tokens", "ids"],
        )


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, first_id in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist()):
            read = IdFile(file)
            yield from _rows(read, read.runs(500_000), first_id)
            read.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files, one task a file:
    `start` counts the ids of all documents before it, `ids` are little-endian unsigned
    32-bit integers."""
    ship_package(manifest.sparkSession)
    files = manifest.select("file", "first_id")
    return files.repartition(max(1, files.count())).mapInArrow(_read_shards, _DOCUMENTS)
