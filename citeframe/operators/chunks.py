"""Cutting pages into overlapping chunks, and the document index built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plans import explode_computed, let
from ..functions.text import clean_for_chunks, is_blank, strip
from .checks import error_list

# Chunk size, overlap, vector length and allowed source types.
CHUNK_CHARS = 1200
OVERLAP_CHARS = 200
VECTOR_LENGTH = 1536
SOURCE_TYPES = ["analyst_note", "deal_package", "decision", "investment_criteria", "other", "outcome"]


_BLOCK = 32
_PIECE = 2048
_SPANS = "array<struct<start:int,stop:int>>"


def with_pieces(df: DataFrame, text: str) -> DataFrame:
    """Adds `_pieces`, the text cut every 2,048 characters, and `_length`. Finding a place
    in one long text would count its characters from the beginning each time."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    pieces = F.when(F.length(text) > _PIECE, cut).otherwise(F.array(text))
    return df.withColumn("_pieces", pieces).withColumn("_length", F.length(text))


def _cut_out(start: Column, stop: Column) -> Column:
    """Characters of the text from `start` up to `stop`, read from the pieces they lie in."""
    first, last = F.shiftright(start, _PIECE.bit_length() - 1), F.shiftright(stop - F.lit(1), _PIECE.bit_length() - 1)
    near = F.when(first == last, F.get("_pieces", first)).otherwise(F.array_join(F.slice("_pieces", first + F.lit(1), last - first + F.lit(1)), ""))
    return F.substr(near, start - F.shiftleft(first, _PIECE.bit_length() - 1) + F.lit(1), stop - start)


def _last(window: Column, mark: str, width: int) -> Column:
    """0-based start of the last `mark` in `window`, -1 when absent."""
    at = F.instr(F.reverse(window), mark[::-1])
    return F.when(at > 0, F.length(window) - at - F.lit(width - 1)).otherwise(F.lit(-1))


def chunk_spans(size: int, overlap: int) -> Column:
    """Chunk (start, stop) offsets of a text that `with_pieces` has cut.

    A chunk ends after the last empty line or blank found in the last two fifths of
    the window (a sentence end is always followed by a blank, so the blank decides),
    else at the full size. A step reads only its window. Spans are gathered in blocks, so
    that appending one does not copy all before it.
    """
    least = size * 3 // 5
    step = max(1, least + 1 - overlap)
    none = F.from_json(F.lit("[]"), _SPANS)
    state = lambda start, spans: F.struct(start.cast("int").alias("start"), spans.alias("spans"))

    def stop_of(start: Column) -> Column:
        window = _cut_out(start + F.lit(least), start + F.lit(size))
        cut = let(window, lambda w: F.greatest(_last(w, " ", 1), _last(w, "\n\n", 2)))
        found = let(cut, lambda c: F.when(c >= 0, start + F.lit(least + 1) + c).otherwise(start + F.lit(size)))
        return F.when(start + F.lit(size) >= F.col("_length"), F.col("_length")).otherwise(found)

    def one(acc: Column, _: Column) -> Column:
        start = acc["start"]
        after = lambda stop: F.when(stop >= F.col("_length"), F.lit(-1)).otherwise(F.greatest(start + F.lit(1), stop - F.lit(overlap)))
        bound = let(stop_of(start), lambda stop: state(after(stop), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))))
        return F.when(start < 0, acc).otherwise(bound)

    def block(acc: Column, _: Column) -> Column:
        made = F.aggregate(F.sequence(F.lit(1), F.lit(_BLOCK)), state(acc["start"], none), one)
        return F.when(acc["start"] < 0, acc).otherwise(let(made, lambda m: state(m["start"], F.concat(acc["spans"], m["spans"]))))

    blocks = F.sequence(F.lit(0), F.ceil(F.col("_length") / F.lit(step * _BLOCK)).cast("int"))
    start = F.when(F.col("_length") > 0, F.lit(0)).otherwise(F.lit(-1))
    return F.aggregate(blocks, state(start, none), block, lambda acc: acc["spans"])


def chunk_pages(
    pages: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, keys: tuple[str, ...] = ("doc_id",),
    numbered: bool = True,
) -> DataFrame:
    """Chunks of every page: `keys`, page_ord, page_number, chunk_ord, content and,
    when `numbered`, chunk_index over the document. Chunks never cross a page, so
    all cutting is local to a row, in time linear in the page; only numbering shuffles."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("Chunk size must be positive and overlap smaller than it.")
    cleaned = pages.select(*keys, "page_ord", "page_number", clean_for_chunks(F.col("text")).alias("_text"))
    spans = with_pieces(cleaned, "_text").withColumn("_spans", chunk_spans(size, overlap)).drop("_text", "_length")
    contents = F.transform("_spans", lambda s: strip(_cut_out(s["start"], s["stop"])))
    kept = spans.withColumn("_contents", F.filter(contents, lambda c: c != ""))
    if numbered:
        kept = number_pages(kept, keys)
        chunks = explode_computed(
            kept, "_contents", "content", pos="chunk_ord", keep=[*keys, "page_ord", "page_number", "_before"]
        )
        return chunks.withColumn("chunk_index", (F.col("_before") + F.col("chunk_ord")).cast("int")).drop("_before")
    return explode_computed(kept, "_contents", "content", pos="chunk_ord", keep=[*keys, "page_ord", "page_number"])


def number_pages(kept: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds `_before`, the chunks of a document before each page. The pages of a document
    (at most 1,000) meet once, already cut, so nothing is cleaned or cut twice."""
    before = Window.partitionBy(*keys).orderBy("page_ord").rowsBetween(Window.unboundedPreceding, -1)
    slim = kept.select(*keys, "page_ord", "page_number", "_contents")
    return slim.withColumn("_before", F.coalesce(F.sum(F.size("_contents")).over(before), F.lit(0)))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, dimensions: int = VECTOR_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(chunks with their vectors, rejected documents). A document is kept only if
    every chunk has exactly one vector of the right length, all from one model.
    `vectors`: document_id, chunk_index, embedding, embedding_model."""
    key = ["document_id", "chunk_index"]
    per_chunk = vectors.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("embedding") != dimensions).alias("wrong"),
        F.min("embedding_model").alias("low"),
        F.max("embedding_model").alias("high"),
    )
    wanted = chunks.select(*key, is_blank(F.col("content")).alias("blank"), F.lit(True).alias("chunk"))
    both = wanted.join(per_chunk, key, "full_outer")
    per_document = both.groupBy("document_id").agg(
        F.count_if(F.col("n").isNull()).alias("without"),
        F.count_if(F.col("chunk").isNull() | (F.col("n") > 1)).alias("extra"),
        F.sum(F.coalesce("wrong", F.lit(0))).alias("wrong"),
        F.count_if(F.coalesce("blank", F.lit(False))).alias("blank"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    checks = {
        "vectors: not one per chunk": (F.col("without") == 0) & (F.col("extra") == 0),
        f"vectors: not {dimensions} long": F.col("wrong") == 0,
        "chunks: blank text": F.col("blank") == 0,
        "vectors: more than one model": F.col("low").isNull() | (F.col("low") == F.col("high")),
    }
    judged = per_document.withColumn("errors", error_list(checks)).select("document_id", "errors")
    refused = judged.filter(F.size("errors") > 0)
    indexed = chunks.join(refused, "document_id", "left_anti").join(vectors, key)
    return indexed, refused


def index_documents(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Index rows: counts, text fingerprint and storage path per document; `errors`
    for documents without any chunk. The fingerprint input is bounded: an ingest
    request holds at most 25,000,000 characters."""
    texts = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).cast("int").alias("page_count"),
        F.sha2(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "text"))), lambda p: p["text"]), "\n"
            ),
            256,
        ).alias("content_sha256"),
    )
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return (
        documents.join(texts, "document_id", "left")
        .join(counts, "document_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        .withColumn("page_count", F.coalesce("page_count", F.lit(0)))
        .withColumn(
            "storage_path",
            F.concat_ws("/", F.col("organization_id").cast("string"), F.col("document_id").cast("string"), "document_name"),
        )
        .withColumn("errors", error_list({"document: no text to index": F.col("chunk_count") > 0}))
    )


def check_index(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks with `errors` for rows the index tables would refuse.
    Uniqueness is counted by key (partial aggregate) and joined back."""
    paths = documents.groupBy("storage_path").agg(F.count(F.lit(1)).alias("_same"))
    checked = documents.join(paths, "storage_path", "left").withColumn(
        "errors",
        error_list(
            {
                "source_type: unknown": F.col("source_type").isin(SOURCE_TYPES),
                "content_sha256: not 64 characters": F.length("content_sha256") == 64,
                "page_count: not positive": F.col("page_count") > 0,
                "storage_path: not unique": F.coalesce("_same", F.lit(1)) == 1,
            }
        ),
    )
    repeats = chunks.groupBy("document_id", "chunk_index").agg(F.count(F.lit(1)).alias("_same"))
    rows = chunks.join(repeats, ["document_id", "chunk_index"], "left").withColumn(
        "errors",
        error_list(
            {
                "page_number: not positive": F.col("page_number") > 0,
                "chunk_index: negative": F.col("chunk_index") >= 0,
                "content: empty": F.length("content") > 0,
                "chunk_index: not unique in its document": F.col("_same") == 1,
            }
        ),
    )
    return checked.drop("_same"), rows.drop("_same")
