"""Packing of tokenised documents into sequences: non-negative least squares over length combinations."""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

END_ID = 1  #: the id that ends each document
#: Middle lengths tried for each shortest length of a combination of three.
FAN = 8
#: Pieces of one length are numbered in parts of about so many, so that no task numbers a length of which most pieces are.
NUMBERED = 200_000


@lru_cache(maxsize=2)
def encoder(name: str) -> tiktoken.Encoding:
    """The vocabulary of ``<name>.json`` from its rank file, which gives the same ids several times faster, and the added tokens
    that only the JSON file lists."""
    path = public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_FIELDS = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def cut_documents(docs: DataFrame, window: int = 2048, vocabulary: str = "byte_bpe_50k", added: bool = True) -> DataFrame:
    """Pieces of at most ``window`` ids: whole windows from the start of a document, then a half one if more than that is left, then
    what is left. Rests of more than half a window would seldom find a partner. With ``added``, added tokens inside texts get
    their own ids, as the JSON file gives them when it is loaded as it stands."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        names = sorted(coder.special_tokens_set) if added else []
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                words = coder.encode(text, allowed_special="all") if any(x in text for x in names) else coder.encode_ordinary(text)
                ids = np.array([*words, END_ID], "<u4")
                whole, rest = divmod(len(ids), window)
                cuts = [*range(0, whole * window + 1, window), *([whole * window + window // 2] if rest > window // 2 else []), len(ids)]
                rows += [(doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)) for a, b in zip(cuts, cuts[1:]) if a < b]
            yield pa.record_batch([list(x) for x in zip(*rows)] if rows else [[] for _ in _FIELDS], schema=_FIELDS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def combinations(lengths: Sequence[int], window: int, fan: int = FAN) -> list[tuple[int, ...]]:
    """Combinations of one to three of the lengths that fill the window exactly. Of three, each shortest length
    meets ``fan`` middle ones spread over those that leave a third."""
    there = set(lengths)
    out: list[tuple[int, ...]] = [(window,)] if window in there else []
    out += [(a, window - a) for a in lengths if 2 * a <= window and window - a in there]
    for a in lengths:
        fits = [b for b in lengths if a <= b and 2 * b <= window - a and window - a - b in there]
        step = max(1, len(fits) // fan)
        out += [(a, b, window - a - b) for b in fits[::step]]
    return out


def solve(columns: Sequence[tuple[int, ...]], counts: dict[int, int], sweeps: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used closest to the histogram in squares, by coordinate descent: each
    step sets one count to its best value while the others stand."""
    left = {k: float(v) for k, v in counts.items()}
    uses = [{k: c.count(k) for k in set(c)} for c in columns]
    x = np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for j, use in enumerate(uses):
            step = sum(n * left[k] for k, n in use.items()) / sum(n * n for n in use.values())
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, n in use.items():
                    left[k] -= n * step
        if moved < 1e-3:
            break
    return x


def plan_packing(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) that use every piece of the histogram once."""
    left = {k: v for k, v in counts.items() if v}
    columns = combinations(sorted(left), window)
    plan: list[tuple[tuple[int, ...], int]] = []
    for column, x in zip(columns, solve(columns, left) if columns else []):
        need = {k: column.count(k) for k in set(column)}
        times = min(int(x + 0.5), *(left.get(k, 0) // n for k, n in need.items()))
        if times > 0:
            plan.append((column, times))
            for k, n in need.items():
                left[k] -= n * times
    # What rounding leaves: longest first, each gap filled with the longest that fit, repeated while all lengths last.
    rest = sorted((k for k, v in left.items() if v), reverse=True)
    while rest:
        held: list[int] = []
        gap = window
        for k in rest:
            n = min(left[k], gap // k)
            held += [k] * n
            gap -= n * k
        need = {k: held.count(k) for k in set(held)}
        times = min(left[k] // n for k, n in need.items())
        plan.append((tuple(held), times))
        for k, n in need.items():
            left[k] -= n * times
        rest = [k for k in rest if left[k]]
    return plan


def _intervals(plan: Sequence[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of its numbering and where in the sequences they go, in order of (length, from)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in plan:
        at = 0
        for k in sorted(set(lengths), reverse=True):
            n = lengths.count(k)
            rows.append((k, used.get(k, 0), sequence, n, at))
            used[k] = used.get(k, 0) + n * times
            at += n * k
        sequence += times
    rows.sort()
    return {name: np.array(x, np.int64) for name, x in zip(("length", "from", "sequence", "each", "offset"), zip(*rows))}


def pack_documents(docs: DataFrame, window: int = 2048, vocabulary: str = "byte_bpe_50k", added: bool = True) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    Documents are cut where a window is full; the histogram of piece lengths, at most ``window`` numbers, is all that
    reaches the driver. It is split into combinations of up to three lengths that fill the window, their repeats solved by
    non-negative least squares, rounded, and the residue packed greedily by length. Pieces of one length
    are then numbered in salted parts and each number has its place in the plan, which has at most a few tens of thousands of
    rows whatever the input and is sent to the tasks.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each; an empty table gives no
    rows; other columns are not read. ``added`` is as in ``cut_documents``.
    """
    pieces = settle(cut_documents(docs, window, vocabulary, added), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = 8 + max(counts.values(), default=0) // NUMBERED
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    spark = docs.sparkSession
    plan = spark.sparkContext.broadcast(_intervals(plan_packing(counts, window)) if counts else {})
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("number", F.col("before") + F.col("own") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            if not len(length):
                continue
            # One sorted key of (length, number): numbers of a length stay below 2 ** 50.
            at = np.searchsorted(runs["length"] * (1 << 50) + runs["from"], length * (1 << 50) + number, "right") - 1
            turn = number - runs["from"][at]
            sequence = runs["sequence"][at] + turn // runs["each"][at]
            offset = runs["offset"][at] + turn % runs["each"][at] * length
            yield pa.record_batch([*(batch.column(n) for n in _FIELDS.names), sequence, offset], names=[*_FIELDS.names, "sequence_id", "offset"])

    return ranked.select(*_FIELDS.names, "number").mapInArrow(place, PIECES + ", sequence_id long, offset long")
