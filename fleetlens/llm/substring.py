"""Substring dedup by level-wise doubling: windows repeated at one length alone go on to twice that length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .words import Windows, Words, mix, signed, slices, words_of

RUNS = "array<struct<begin: int, n: int>>"


def leading_seeds(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their leading seed: (seed hash, hash of all that the run covers, text, first start, starts).

    A seed is a window of half the length; the leading one of a window is the seed in it with the smallest hash. Equal windows have
    equal leading seeds at the same place, so a window repeats only if its leading seed does: seeds
    stand for all windows of their length, about one word in six instead of every word.
    """
    half = window // 2
    counts = words.counts
    start = np.arange(len(words.hash))
    start = start[start + window <= np.repeat(words.first[1:], counts)]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = Windows(words.hash)
    seeds = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
    ok = np.arange(len(words.hash))
    ok = ok[ok + half <= np.repeat(words.first[1:], counts)]
    seeds[ok] = hashes(ok, half)
    # Order by another hash than the one that names the seed: small hashes would else crowd together.
    order = mix(seeds + np.uint64(1))
    best, lead = order[start], start.copy()
    for k in range(1, window - half + 1):
        value = order[start + k]
        lower = value < best
        best[lower] = value[lower]
        lead[lower] = start[lower] + k
    doc = words.doc[start]
    new = np.ones(len(start), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    begin = start[at]
    cover = mix(hashes(begin, n + window - 1) + (lead[at] - begin).astype(np.uint64))
    return seeds[lead[at]], cover, doc[at], begin - words.first[doc[at]], n


def _earliest(keys: tuple[np.ndarray, ...], doc_id: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rows of each key, rows that a smaller place of the same key precedes)."""
    order = np.lexsort((begin, doc_id, *keys))
    same = np.ones(len(order), bool)
    for key in keys:
        same[1:] &= key[order][1:] == key[order][:-1]
    same[:1] = False
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = same & ((doc_id[order] != doc_id[order][head]) | (begin[order] != begin[order][head]))
    return np.sort(order[~same]), np.sort(order[later])


SEEDS = "seed long, cover long, doc_id long, begin int, n int"


def _seed_rows(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """A row for each run whose content is new in the slice, with its seed; a row without seed for each run that follows an equal one
    of an earlier place: what is repeated within a slice is settled there, and a hot window leaves it once."""
    ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    seed, cover, doc, begin, n = leading_seeds(words_of(part.column("text")), window)
    first, later = _earliest((cover, seed), ids[doc], begin)
    at = np.concatenate([first, later])
    return pa.record_batch(
        [
            pa.array(signed(seed[at]), mask=np.arange(len(at)) >= len(first)), signed(cover[at]), ids[doc][at],
            begin[at].astype(np.int32), n[at].astype(np.int32),
        ],
        names=["seed", "cover", "doc_id", "begin", "n"],
    )


def _starts(runs: list[dict] | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(r["begin"], r["begin"] + r["n"]) for r in runs or [])])


def _removed(count: int, runs: list[dict] | None, window: int) -> np.ndarray:
    """Mask of the words that windows starting in the runs cover."""
    edge = np.zeros(count + 1, np.int64)
    for r in runs or []:
        edge[min(r["begin"], count)] += 1
        edge[min(r["begin"] + r["n"] + window - 1, count)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _result(text: str | None, runs: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by one space)."""
    words = (text or "").encode().split()  # bytes split at exactly the given characters
    if not runs:
        return len(words), 0, b" ".join(words)
    gone = _removed(len(words), runs, window)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone) if not g])


def _read(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def repeated_substrings(docs: DataFrame, window: int = 20, keep_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), with ``keep_text`` also kept_text, for all rows of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts earlier, at a smaller doc_id or before in the same
    document. Level one: seeds of half the window, see ``leading_seeds``, are counted; those found once drop out. Level two:
    seeds found again are extended to whole windows, all windows of a seed at once. Where every occurrence of a seed has the same
    surroundings one comparison settles them; where they differ, windows are compared one by one. No candidate survives
    beyond: longer windows hold repeated ones of this length and remove the same words.

    Joins are on hashes of content and on doc_id. Equal runs of one slice are merged before the shuffle, minima again map-side.
    A null or empty text has no words; rows with a null doc_id are left as they are and remove nothing; rows that share a
    doc_id are versions of one document: a place that goes in one goes in all, and none is earlier than the
    other; an empty table gives no rows; other columns are not read.
    """
    if window < 2 or window % 2:
        raise ValueError("the window must be even")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _seed_rows(part, window)

    base = _read(docs)
    rows = base.where("doc_id is not null").mapInArrow(seeds, SEEDS)
    place = F.struct("doc_id", "begin")
    sent = rows.where("seed is not null")
    twice = sent.groupBy("seed").agg(F.count("*").alias("times")).where("times > 1").select("seed")
    found = settle(sent.join(twice, "seed"), "seeds")
    again = found.groupBy("seed").agg(F.min("cover").alias("low"), F.max("cover").alias("high"), F.min(place).alias("at"))
    met = found.join(again, "seed")
    open_ = F.col("low") != F.col("high")
    runs = (
        met.where(open_ | (place != F.col("at"))).select("doc_id", "begin", "n", open_.alias("open"))
        .unionByName(rows.where("seed is null").select("doc_id", "begin", "n", F.lit(False).alias("open")))
    )
    run = F.struct("begin", "n")
    # A document's runs are fewer than its words.
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.when(F.col("open"), run)).alias("open"), F.collect_list(F.when(~F.col("open"), run)).alias("gone"))

    def settle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, more, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "open", "gone"))):
                if more:  # goes on with its text
                    out.append((doc_id, None, None, None, text, None, more, gone))
                else:
                    n, removed, kept = _result(text, gone, window)
                    out.append((doc_id, n, removed, hashlib.sha256(kept).hexdigest(), None, kept.decode() if keep_text else None, None, None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, _STATE.types)], schema=_STATE)

    state = settle(base.join(by_doc, "doc_id", "left").mapInArrow(settle_rows, STATE), "substring-state")
    pending = state.where("n_words is null").select("doc_id", "text", "open", "gone")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                starts = [_starts(x) for x in part.column("open").to_pylist()]
                doc = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
                begin = np.concatenate([np.zeros(0, np.int64), *starts])
                fits = begin + window <= words.counts[doc]
                doc, begin = doc[fits], begin[fits]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                key = Windows(words.hash)(words.first[doc] + begin, window)
                check = Windows(words.hash, seed=1)(words.first[doc] + begin, window)
                first, later = _earliest((check, key), ids, begin)
                at = np.concatenate([first, later])
                yield pa.record_batch(
                    [
                        pa.array(signed(key[at]), mask=np.arange(len(at)) >= len(first)),
                        (check[at] >> np.uint64(32)).astype(np.int64).astype(np.uint32).view(np.int32), ids[at], begin[at].astype(np.int32),
                    ],
                    names=["key", "check", "doc_id", "begin"],
                )

    single = pending.mapInArrow(windows, "key long, check int, doc_id long, begin int")
    first = single.where("key is not null").groupBy("key", "check").agg(F.count("*").alias("times"), F.min(place).alias("at")).where("times > 1")
    later = single.where("key is not null").join(first, ["key", "check"]).where(place != F.col("at")).select("doc_id", "begin")
    later = later.unionByName(single.where("key is null").select("doc_id", "begin"))
    more = later.groupBy("doc_id").agg(F.collect_list(F.struct("begin", F.lit(1).alias("n"))).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, gone, single_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "gone", "more"))):
                n, removed, kept = _result(text, (gone or []) + (single_ or []), window)
                out.append((doc_id, n, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, _DONE.types)], schema=_DONE)

    done = state.where("n_words is not null").select(*_DONE.names)
    rest = pending.join(more, "doc_id", "left").mapInArrow(finish, DONE)
    out = done.unionByName(rest)
    return out if keep_text else out.drop("kept_text")


DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
STATE = f"doc_id long, n_words long, n_removed long, kept_sha256 string, text string, kept_text string, open {RUNS}, gone {RUNS}"
_RUN_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("n", pa.int32())]))
_STATE = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()),
     ("kept_text", pa.string()), ("open", _RUN_TYPE), ("gone", _RUN_TYPE)]
)
