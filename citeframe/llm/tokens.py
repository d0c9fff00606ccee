"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. Token byte lengths give each token's span;
sections are spans of characters. Both are sorted, so the interval join of a document is
a binary search per token. A token that crosses a boundary goes to one section or is
shared, by an explicit rule:

    start    the section that holds its first byte
    end      the section that holds its last byte
    largest  the section that holds most of its bytes; the earlier of equals
    share    every section it touches, in proportion to bytes
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .words import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the characters that the pattern takes for white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_BLANKS = re.compile(f"[{BLANKS}]{{1000,}}")
RULES = ("start", "end", "largest", "share")
_SCHEMA = "doc_id long, section int, start long, end long, n_tokens double"


@lru_cache(maxsize=1)
def _encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ids(text: str, encoder: tiktoken.Encoding) -> list[int]:
    """The tokens of a text. The pattern takes a run of white space whole, all but its last
    character if a word follows, and the matcher ends on runs of about a million; so long
    runs go to the merges by themselves, and the text between them to the pattern."""
    ids, at = [], 0
    for run in _LONG_BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoder.encode_ordinary(text[at : run.start()]) if run.start() > at else []
        ids += encoder._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoder.encode_ordinary(text[at:])


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every token."""
    encoder, lengths = _encoder(path)
    sizes = lengths[np.fromiter(token_ids(text, encoder), np.int64)]
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def char_starts(raw: bytes) -> np.ndarray:
    """Byte position of every character, and the length in bytes at the end."""
    data = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, each with its LF."""
    raw = text.encode("utf-32-le", "replace")
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint32) == 10) + 1
    size = len(raw) // 4
    ends = np.unique(np.append(breaks, size)) if size else np.array([0])
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section, and last those outside all sections. Sections are sorted and
    do not overlap; all positions are bytes."""
    count = len(low)
    out = np.zeros(count + 1)
    if not len(starts):
        return out
    if not count:
        out[-1] = len(starts)
        return out

    def holder(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(low, at, "right") - 1
        return np.where((k >= 0) & (at < high[np.maximum(k, 0)]), k, count)

    if rule in ("start", "end"):
        return np.bincount(holder(starts if rule == "start" else ends - 1), minlength=count + 1).astype(float)
    first = np.searchsorted(high, starts, "right")
    last = np.searchsorted(low, ends, "left")
    touched = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(starts)), touched)
    place = np.arange(len(token)) - np.repeat(np.cumsum(touched) - touched, touched)
    section = first[token] + place
    held = np.minimum(ends[token], high[section]) - np.maximum(starts[token], low[section])
    size = (ends - starts).astype(float)
    if rule == "share":
        inside = np.bincount(section, held / size[token], minlength=count + 1)
        inside[-1] = len(starts) - inside[:-1].sum()
        return inside
    rest = size - np.bincount(token, held, minlength=len(starts))
    best = np.zeros(len(starts))
    np.maximum.at(best, token, held)
    owner = np.full(len(starts), count)
    winners = np.flatnonzero(held == best[token])[::-1]
    owner[token[winners]] = section[winners]
    owner[(rest > best) | (best == 0)] = count
    return np.bincount(owner, minlength=count + 1).astype(float)


def _count(path: str, rule: str, given: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2_000_000):
            ids, sections, lows, highs, counts = [], [], [], [], []
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py() or ""
                if given:
                    spans = batch.column("sections")[row].as_py() or []
                    spans = sorted((s["start"], s["end"], k) for k, s in enumerate(spans) if s and s["start"] is not None and s["end"] is not None)
                    low, high, names = (np.array([s[k] for s in spans], np.int64) for k in range(3))
                    low, high = np.clip(low, 0, len(text)), np.clip(high, 0, len(text))
                else:
                    low, high = line_spans(text)
                    names = np.arange(len(low))
                at = char_starts(text.encode("utf-8", "replace"))
                told = attribute(*token_spans(text, path), at[low], at[high], rule)
                outside = told[-1] > 1e-9
                size = len(low) + outside
                ids.append(pa.repeat(batch.column("id")[row], int(size)))
                sections.append(np.append(names, -1)[:size] if len(names) else np.array([-1])[:size])
                lows.append(np.append(low, -1)[:size])
                highs.append(np.append(high, -1)[:size])
                counts.append(told[:size])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(ids),
                    pa.array(np.concatenate(sections), pa.int32()),
                    pa.array(np.concatenate(lows), pa.int64()),
                    pa.array(np.concatenate(highs), pa.int64()),
                    pa.array(np.concatenate(counts), pa.float64()),
                ],
                names=["doc_id", "section", "start", "end", "n_tokens"],
            )

    return work


def count_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "start",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens): tokens per section of each document.

    `sections_col` is an array of structs (start, end) of code points, end exclusive, which
    must not overlap; null entries are skipped, positions are cut to the text. Without it,
    the lines of the text are its sections, each with its LF. Sections are numbered from 0
    in the order given; a last row with section, start and end -1 has the tokens outside
    all sections, if any. Null text is empty text: one empty line, no tokens. Repeated rows
    and null ids are counted like others. Only the named columns are read. An empty table
    gives no rows. The vocabulary file must be on every executor.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship_package(df.sparkSession)
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")]
    if sections_col:
        columns.append(F.col(sections_col).alias("sections"))
    return df.select(*columns).mapInArrow(_count(vocabulary, rule, bool(sections_col)), _SCHEMA)
