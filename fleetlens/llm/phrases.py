"""Phrase collocations: Misra-Gries summaries per hash partition choose n-grams, a second pass counts them exactly.

A word is a run of ``[^\\x20\\x09]`` in a piece, a piece is what ``[.,;:!?\\x0A-\\x0D]`` leaves; A-Z count as a-z. Everything is per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .words import mix

#: Texts of about so many bytes are counted together.
SLICE_BYTES = 2_000_000
#: A task holds at most so many counted n-grams before it hands them on.
HELD = 1_000_000
#: Text of about so many bytes, or more beyond the most partitions, falls to a hash partition.
PART_BYTES, MOST_PARTS = 2_000_000, 1 << 24
#: The table of surviving n-grams that every task gets has at most so many bits.
MOST_BITS = 1 << 28
#: The phrases of a language are ranked in so many parts before all of them are.
RANK_PARTS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_STEP = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64((1 << 40) - 1)


def _together(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in groups of about ``limit`` bytes of text; a longer text is a group of its own."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for i, own in enumerate(sizes):
            if size and size + own > limit:
                yield _joined([*held, batch.slice(begin, i - begin)])
                held, size, begin = [], 0, i
            size += own
        held.append(batch.slice(begin))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(map(len, parts)) else parts[0]


@dataclass
class Grams:
    """Distinct n-grams of some texts, told apart by their words themselves. ``codes[n]`` is (an n-gram of one word less) *
    (number of words) + word; of single words it is word * (number of languages) + language."""

    words: pa.Array
    langs: list[str]
    codes: list[np.ndarray]
    counts: list[np.ndarray]

    def hashes(self) -> list[np.ndarray]:
        """64 bits for the n-grams of each length, equal wherever the n-gram is counted."""
        said = lambda x: xxhash.xxh3_64_intdigest(x)
        word = np.array([said(w) for w in self.words.to_pylist()], np.uint64)
        lang = np.array([said(x.encode()) for x in self.langs], np.uint64)
        one = mix(word[self.codes[0] // len(lang)] + mix(lang)[self.codes[0] % len(lang)]) if len(word) else word
        out = [one]
        for codes in self.codes[1:]:
            out.append(mix(out[-1][codes // len(one)] * _STEP + one[codes % len(one)]) if len(codes) else np.zeros(0, np.uint64))
        return out

    def told(self, n: int, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """(language, words joined by a space) of the n-grams ``at`` of length n + 1."""
        later, codes = [], self.codes[n][at]
        for k in range(n, 0, -1):
            later.append(self.codes[0][codes % len(self.codes[0])])
            codes = self.codes[k - 1][codes // len(self.codes[0])]
        words = [self.words.take(pa.array(x // len(self.langs))) for x in (codes, *reversed(later))]
        said = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if n else words[0]
        return pa.array(self.langs, pa.string()).take(pa.array(codes % len(self.langs))), said


def grams_of(texts: pa.Array, langs: pa.Array, longest: int) -> Grams:
    """All n-grams of up to ``longest`` words. A null text has none."""
    raw = texts.cast(pa.binary()).fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = _LOWER[np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_GAP[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    opens[offsets[:-1][full]] = inside[offsets[:-1][full]]
    closes[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(offsets[1:], begin, side="right")
    piece = np.cumsum(_BREAK[data], dtype=np.int32 if len(data) < 2**31 else np.int64)[begin]
    linked = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])]
    ).dictionary_encode()
    spoken = langs.dictionary_encode()
    lang = spoken.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = Grams(words.dictionary, spoken.dictionary.to_pylist(), [], [])
    # ``own`` has the n-gram that starts at each of the places ``at``.
    at = np.arange(len(begin))
    own = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(found.langs)) + lang[doc]
    for n in range(1, longest + 1):
        codes, own, counts = np.unique(own, return_inverse=True, return_counts=True)
        found.codes.append(codes)
        found.counts.append(counts)
        if n == 1:
            word = own
        if n < longest:
            goes_on = at + n - 1 < len(linked)
            goes_on[goes_on] = linked[at[goes_on] + n - 1]
            at, own = at[goes_on], own[goes_on]
            own = own * max(1, len(found.codes[0])) + word[at + n]
    return found


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters. A key's count is its counter and ``lost`` more at most,
    and ``lost`` * (capacity + 1) never exceeds the counts that came in."""

    capacity: int
    keys: np.ndarray
    counts: np.ndarray
    lost: int = 0

    @classmethod
    def empty(cls, capacity: int) -> Summary:
        return cls(capacity, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Take in the counters of another summary. The largest one that finds no room is taken off all of them."""
        self.keys, self.counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.lost += lost
        if len(self.keys) > self.capacity:
            least = len(self.keys) - self.capacity - 1
            off = int(np.partition(self.counts, least)[least])
            held = self.counts > off
            self.keys, self.counts = self.keys[held], self.counts[held] - off
            self.lost += off

    def may_reach(self, threshold: int) -> np.ndarray:
        """All keys that can have been counted ``threshold`` times, as long as the capacity exceeds what came in by that."""
        return self.keys[self.counts + self.lost >= threshold]


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _packed(hashes: np.ndarray) -> bytes:
    """The low 40 bits of each hash: n-grams of a partition that share them are one key, which can only keep more."""
    return np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<i8").ravel()


def _counted(batches: Iterator[pa.RecordBatch], longest: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, keys, counts): what a task counted for each hash partition."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def given() -> pa.RecordBatch:
        hashes, counts = summed(*(np.concatenate(x) for x in zip(*held)))
        part = _part_of(hashes, parts)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        rows = [(int(part[i]), _packed(hashes[i:j]), counts[i:j].astype("<i8").tobytes()) for i, j in zip(first, [*first[1:], len(part)])]
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["part", "keys", "counts"])

    for some in _together(batches):
        grams = grams_of(some.column("text"), some.column("lang"), longest)
        held.append(summed(np.concatenate(grams.hashes()), np.concatenate(grams.counts)))
        if sum(len(k) for k, _ in held) > HELD:
            held = [summed(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) > HELD:
                yield given()
                held = []
    if held:
        yield given()


def _merged(rows: pa.Table, threshold: int) -> pa.Table:
    """(part, keys, n) of a hash partition: the keys that may reach the threshold. Its summaries are merged as they come, some at a
    time; the capacity exceeds the partition's counts divided by the threshold."""
    read = lambda i: np.frombuffer(rows.column("counts")[i].as_py(), "<i8")
    mass = sum(int(read(i).sum()) for i in range(rows.num_rows))
    summary = Summary.empty(mass // threshold + 1)
    keys, counts, size = [], [], 0
    for i in range(rows.num_rows):
        keys.append(_unpacked(rows.column("keys")[i].as_py()))
        counts.append(read(i))
        size += len(keys[-1])
        if size > summary.capacity or i + 1 == rows.num_rows:
            summary.merge(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [], [], 0
    found = summary.may_reach(threshold)
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int64()), "keys": pa.array([_packed(found)], pa.binary()), "n": pa.array([len(found)], pa.int64())})


def _slots(low: np.ndarray, width: int) -> np.ndarray:
    return (mix(low.astype(np.uint64)) % np.uint64(width)).astype(np.int64)


def _flagged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, bits): the survivors of a partition as bits in its part of the table."""
    for batch in batches:
        bits = []
        for raw in batch.column("keys"):
            flags = np.zeros(width, bool)
            flags[_slots(_unpacked(raw.as_py()), width)] = True
            bits.append(np.packbits(flags).tobytes())
        yield pa.record_batch([batch.column("part"), pa.array(bits, pa.binary())], names=["part", "bits"])


def _recounted(batches: Iterator[pa.RecordBatch], longest: int, parts: int, width: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, size, f) of the n-grams that the table lets pass; with size 0 the number of words."""
    for some in _together(batches):
        grams = grams_of(some.column("text"), some.column("lang"), longest)
        lang = pa.array(grams.langs, pa.string())
        words = np.bincount(grams.codes[0] % max(1, len(lang)), grams.counts[0], len(lang)).astype(np.int64)
        yield _rows(lang, pa.array([b""] * len(lang), pa.binary()), 0, words)
        for n, (hashes, counts) in enumerate(zip(grams.hashes(), grams.counts)):
            slot = _part_of(hashes, parts).astype(np.int64) * width + _slots(hashes & _LOW, width)
            at = np.flatnonzero(table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            if len(at):
                spoken, phrase = grams.told(n, at)
                yield _rows(spoken, phrase.cast(pa.binary()), n + 1, counts[at].astype(np.int64))


def _rows(lang: pa.Array, phrase: pa.Array, size: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([lang, phrase, pa.array(np.full(len(counts), size, np.int32)), pa.array(counts)], names=["lang", "phrase", "size", "f"])


def frequent_grams(docs: DataFrame, longest: int = 3, threshold: int = 10) -> DataFrame:
    """Rows (lang, phrase, size, f): all n-grams of 1 to ``longest`` words that occur ``threshold`` times or more in a language, with
    their exact counts, and with size 0 the number of words of the language. Written to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(size // PART_BYTES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_PARTS)
    counted = texts.mapInArrow(lambda batches: _counted(batches, longest, parts), "part long, keys binary, counts binary")
    survivors = settle(
        counted.groupBy("part").applyInArrow(lambda rows: _merged(rows, threshold), "part long, keys binary, n long"), "frequent-keys"
    )
    n = survivors.agg(F.sum("n")).first()[0] or 0
    # Eight bits for each survivor as long as that fits the bound; a fuller table lets more n-grams through to the exact count.
    width = max(8, min(8 * n, MOST_BITS) // parts // 8 * 8 + 8)
    table = np.zeros(parts * width // 8, np.uint8)
    flags = survivors.mapInArrow(lambda batches: _flagged(batches, width), "part long, bits binary").toArrow()
    for part, bits in zip(flags.column("part").to_pylist(), flags.column("bits").to_pylist()):
        table[part * width // 8 : (part + 1) * width // 8] = np.frombuffer(bits, np.uint8)
    sent = spark.sparkContext.broadcast(table)
    again = texts.mapInArrow(lambda batches: _recounted(batches, longest, parts, width, sent.value), "lang string, phrase binary, size int, f long")
    exact = again.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size").agg(F.sum("f").alias("f"))
    return settle(exact.where((F.col("size") == 0) | (F.col("f") >= threshold)), "frequent-grams")


def _words(phrase: str | Column) -> Column:
    return F.split(phrase, " ")


def best_cuts(grams: DataFrame) -> DataFrame:
    """Rows (lang, phrase, size, a, l, r, score) of all phrases of two words and more: of the cuts into a first part and a rest the one with
    the lowest floor(1000000 * a * a / (l * r)), then the smallest first part. Both parts are as frequent as the phrase, so both are there."""
    phrases = grams.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(_words("phrase"), F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(_words("phrase"), F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    parts = grams.where("size >= 1")
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # Counts below 10^15 leave all products within 38 digits.
    score = F.expr("(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    least = met.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def standing_alone(cut: DataFrame, share: int = 50) -> DataFrame:
    """The phrases of ``cut`` without those that a longer one of them contains and that has ``share`` percent of their count or more."""
    longest = cut.agg(F.max("size")).first()[0] or 0
    inner = [F.struct(F.slice(_words("phrase"), i, n).alias("w"), F.col("size").alias("of")) for n in range(2, longest) for i in range(1, longest - n + 2)]
    if not inner:
        return cut
    held = cut.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(*inner)).alias("p"))
    held = held.where("size(p.w) < p.of").select("lang", F.array_join("p.w", " ").alias("phrase"), F.size("p.w").alias("size"), "longer")
    # A slice that reaches beyond the end of a shorter phrase repeats a shorter slice, which is contained as well.
    most = held.where("size >= 2").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return cut.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, count and bytes.

    Counts are of all rows of ``docs`` (doc_id, text, lang): repeated rows count as often as they are there. A null text is empty, a null lang
    is ``und``; an empty table, and a language without a phrase that occurs ``threshold`` times, give no rows; a very long text is counted whole, in
    arrays some times its size; other columns are not read.
    """
    grams = frequent_grams(docs, longest, threshold)
    kept = standing_alone(settle(best_cuts(grams), "phrase-cuts"), share)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The first of each part of a language come first, so that the task of a language gets a number of rows that does not grow.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = kept.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = grams.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
