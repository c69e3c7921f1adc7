"""Quality rules on word repetition and on bands of zstandard compression ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Windows, Words, slices, whole_windows, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio of plain to compressed bytes.

    ``whole`` and ``chunk`` list (bytes below which the limits hold, lowest ratio, highest ratio), shortest
    texts first: short texts compress little, so each length has limits of its own. A text above its highest ratio repeats
    itself, one below its lowest ratio is noise. It is cut into chunks of ``chunk_bytes`` (a last part below a
    quarter of that joins the chunk before it) and also fails if more than ``bad_share`` of its bytes lie in chunks out of their band.
    """

    level: int = 3
    chunk_bytes: int = 4096
    bad_share: float = 0.5
    whole: tuple[tuple[float, float, float], ...] = (
        (300, 0.90, 2.4), (600, 1.05, 2.6), (1_200, 1.15, 3.0), (5_000, 1.25, 3.5),
        (30_000, 1.35, 4.0), (float("inf"), 1.40, 5.0),
    )
    chunk: tuple[tuple[float, float, float], ...] = ((1_200, 1.05, 3.2), (float("inf"), 1.20, 4.0))


def _band(bands: tuple[tuple[float, float, float], ...], size: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in bands if size < below)


def in_band(text: bytes, bands: Bands, zipper: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(ratio of the whole text, share of its bytes in bad chunks, verdict)."""
    if not text:
        return 0.0, 0.0, False
    ratio = len(text) / len(zipper.compress(text))
    low, high = _band(bands.whole, len(text))
    bad, begin = 0, 0
    while begin < len(text):
        end = begin + bands.chunk_bytes
        if len(text) - end < bands.chunk_bytes // 4:
            end = len(text)
        part = text[begin:end]
        below, above = _band(bands.chunk, len(part))
        bad += len(part) * (not below <= len(part) / len(zipper.compress(part)) <= above)
        begin = end
    share = bad / len(text)
    return ratio, share, low <= ratio <= high and share <= bands.bad_share


def repeated_words(words: Words, length: int = 3) -> np.ndarray:
    """Per text: words that stand in a window of ``length`` words found twice or more in it."""
    total = len(words.hash)
    start = whole_windows(words, length)
    window, doc = Windows(words.hash)(start, length), words.doc[start]
    order = np.lexsort((window, doc))
    same = (window[order][1:] == window[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(start), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(total, bool)
    for k in range(length):
        covered[start[twice] + k] = True
    return np.add.reduceat(np.append(covered, False), words.first[:-1]) * (words.counts > 0) if total else words.counts


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunk_share double"
)
_FIELDS = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunk_share", pa.float64())]
)


def quality_rules(docs: DataFrame, bands: Bands = Bands(), min_words: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), with its counts, ratios and verdict.

    One narrow pass without a shuffle. A null or empty text has zero counts, ratio 0 and fails; a null doc_id stays
    null; repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipper = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part in slices(batch):
                yield _judge(part, bands, min_words, zipper)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, SCHEMA)


def passing(docs: DataFrame, bands: Bands = Bands(), min_words: int = 50) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""

    def filter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipper = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part in slices(batch):
                own = pa.record_batch([part.column("doc_id"), part.column("text")], names=["doc_id", "text"])
                yield part.filter(_judge(own, bands, min_words, zipper).column("kept"))

    return docs.mapInArrow(filter_rows, docs.schema)


def _judge(part: pa.RecordBatch, bands: Bands, min_words: int, zipper: zstandard.ZstdCompressor) -> pa.RecordBatch:
    words = words_of(part.column("text"))
    n_words, repeats = words.counts, repeated_words(words)
    # A code point of a word is a byte of it that continues no other.
    heads = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    of_word = np.concatenate([[0], np.cumsum(heads[words.end] - heads[words.begin])])
    chars = of_word[words.first[1:]] - of_word[words.first[:-1]]
    texts = ["" if x is None else x for x in part.column("text").to_pylist()]
    failed = (n_words < min_words) | (100 * repeats > 50 * n_words)
    banded = [in_band(x.encode(), bands, zipper) for x in texts]
    return pa.record_batch(
        [
            part.column("doc_id"), n_words, chars, [sum(map(x.count, SYMBOLS)) for x in texts],
            [repeated_lines(x) for x in texts], repeats, failed,
            np.array([x[2] for x in banded], bool) & ~failed, [x[0] for x in banded], [x[1] for x in banded],
        ],
        schema=_FIELDS,
    ) if len(texts) else pa.record_batch([[] for _ in _FIELDS], schema=_FIELDS)
