"""Language identification by interpolated Kneser-Ney models of characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .words import slices

ORDER = 4
_BITS = np.uint64(16)
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point of the basic plane: its lower case if it is a letter, else 0."""
    points = np.arange(1 << 16, dtype=np.uint32)
    return np.array([ord(chr(p).lower()[0]) if not 0xD800 <= p < 0xE000 and chr(p).isalpha() else 0 for p in points], np.uint64)


_LETTER = _letters()


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text of each code, letters per text). Runs of letters, in lower case with one blank on each side, give a code of
    ``ORDER`` characters for each letter and each blank after a word; a code is the characters in 16 bits each.

    Letters beyond the basic plane share one symbol per 65,536 code points.
    """
    raw = [(x or "").encode("utf-32-le", "surrogatepass") for x in texts.to_pylist()]
    size = np.array([len(x) // 4 for x in raw], np.int64)
    points = np.frombuffer(b"".join(raw), "<u4")
    doc = np.repeat(np.arange(len(raw)), size)
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        letter[high] = np.array([0xE000 + (p >> 16) if chr(p).isalpha() else 0 for p in points[high]], np.uint64)
    is_letter = letter > 0
    # One blank stands for each run of other characters, and one at the end of each text.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (doc[1:] == doc[:-1])
    ends = np.cumsum(size)
    last = ends[size > 0] - 1
    add = np.zeros(len(points) + 1, np.int64)
    add[last[is_letter[last]] + 1] = 1  # a text that ends with a letter gets a blank
    at = np.flatnonzero(keep)
    seq, own = letter[at], doc[at]
    tail = last[is_letter[last]]
    if len(tail):
        where = np.searchsorted(at, tail, "right")
        seq, own = np.insert(seq, where, 0), np.insert(own, where, doc[tail])
    letters = np.bincount(own[seq > 0], minlength=len(raw))
    # Blanks are symbol 1; what stands before a text's start, too.
    seq = np.where(seq == 0, np.uint64(1), seq)
    code = np.zeros(len(seq), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        code <<= _BITS
        moved = np.full(len(seq), 1, np.uint64)
        if back < len(seq):
            same = own[back:] == own[: len(own) - back]
            moved[back:][same] = seq[: len(seq) - back][same]
        code |= moved
    return code, own, letters


COUNTS = "lang string, gram long, n long"


def count_grams(learn: DataFrame) -> DataFrame:
    """Counts of codes per language over all rows of (lang, text), added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch):
                code, own, _ = grams_of(part.column("text"))
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    keys, n = np.unique(code[(langs == lang)[own]], return_counts=True)
                    if lang in held:
                        keys, inverse = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                        n = np.bincount(inverse, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = keys, n
        for lang, (keys, n) in held.items():
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), keys.view(np.int64), n.astype(np.int64)], names=["lang", "gram", "n"])

    counted = learn.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, COUNTS)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=n, minlength=len(unique))


@dataclass
class Model:
    """Sorted arrays of codes, one pair per order: of grams with the log probability of their last character in each language, and of
    contexts with the log weight left to the next lower order. A column per language; NaN: not seen in it."""

    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Of each code's last character after the others, a column per language."""
        return self._order(codes, ORDER)

    def _order(self, codes: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.tile(self.floor, (len(codes), 1))
        mask = np.uint64((1 << (16 * order)) - 1)
        own = codes & mask
        out = _look_up(self.grams[order], self.logs[order], own)
        lost = np.isnan(out).any(axis=1)
        if lost.any():
            lower = self._order(own[lost], order - 1)
            weight = np.nan_to_num(_look_up(self.contexts[order], self.weights[order], own[lost] >> _BITS), nan=0.0)
            out[lost] = np.where(np.isnan(out[lost]), weight + lower, out[lost])
        return out


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    out = np.full((len(wanted), values.shape[1]), np.nan, np.float32)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        out[hit] = values[at[hit]]
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Per-language sorted (keys, values) as one sorted table with a column each."""
    keys = np.unique(np.concatenate([k for k, _ in parts])) if parts else np.zeros(0, np.uint64)
    table = np.full((len(keys), len(parts)), np.nan, np.float32)
    for j, (own, values) in enumerate(parts):
        table[np.searchsorted(keys, own), j] = values
    return keys, table


def train(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from (language, codes, counts) of the highest order. A lower order counts the
    different characters that its gram follows. Discounts are n1 / (n1 + 2 n2) of each order."""
    model = Model([lang for lang, _, _ in counts])
    by_order: list[list[tuple]] = [[] for _ in range(ORDER + 1)]
    floors = []
    for _, codes, n in counts:
        levels = {ORDER: _sums(codes, n.astype(float))}
        for order in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << (16 * order)) - 1)
            levels[order] = _sums(levels[order + 1][0] & mask, np.ones(len(levels[order + 1][0])))
        floor = 1.0 / (len(levels[1][0]) + 1)
        floors.append(np.log(floor))
        lower_keys, lower_p = np.zeros(1, np.uint64), np.array([floor])
        for order in range(1, ORDER + 1):
            keys, c = levels[order]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            context, inverse = np.unique(keys >> _BITS, return_inverse=True)
            total = np.bincount(inverse, weights=c)
            types = np.bincount(inverse)
            weight = d * types / total
            mask = np.uint64((1 << (16 * (order - 1))) - 1)
            below = lower_p[np.searchsorted(lower_keys, keys & mask)]
            p = (c - d) / total[inverse] + weight[inverse] * below
            by_order[order].append(((keys, np.log(p)), (context, np.log(weight))))
            lower_keys, lower_p = keys, p
    model.floor = np.array(floors, np.float32)
    for parts in by_order:
        for names, which in ((("grams", "logs"), 0), (("contexts", "weights"), 1)):
            keys, table = _merge([x[which] for x in parts]) if parts else (np.zeros(0, np.uint64), np.zeros((0, len(floors)), np.float32))
            getattr(model, names[0]).append(keys)
            getattr(model, names[1]).append(table)
    return model


SCORES = "doc_id long, held_out boolean, lang string, lang_pred string, score double, entropy double, letters long"
_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang", pa.string()), ("lang_pred", pa.string()),
     ("score", pa.float64()), ("entropy", pa.float64()), ("letters", pa.int64())]
)
#: Characters whose evidence counts in a score; beyond that a score would only say that a text is long.
EVIDENCE = 25


def classify(part: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    code, own, letters = grams_of(part.column("text"))
    n = len(letters)
    unique, inverse = np.unique(code, return_inverse=True)
    logs = model.log_probability(unique)
    length = np.maximum(np.bincount(own, minlength=n), 1)
    entropy = np.stack([-np.bincount(own, weights=logs[inverse, j], minlength=n) / length for j in range(len(model.langs))], axis=1)
    best = entropy.argmin(axis=1)
    gap = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(length, EVIDENCE)[:, None])
    told = letters > 0
    return pa.record_batch(
        [
            part.column("doc_id"), part.column("held_out"), part.column("lang"),
            pa.array([model.langs[b] if t else UNKNOWN for b, t in zip(best, told)], pa.string()),
            np.where(told, 1 / gap.sum(axis=1), 0.0), np.where(told, entropy.min(axis=1), 0.0), letters,
        ],
        schema=_FIELDS,
    )


def _deviations(quantile: float, n: Column) -> Column:
    """How many standard deviations above the mean of n values one more of them lies with the given chance: few documents do not
    reach a high quantile. Student's distribution by its expansion around the normal one."""
    z, free = NormalDist().inv_cdf(quantile), n - 1
    t = F.lit(z) + (z**3 + z) / (4 * F.greatest(free, F.lit(1))) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * F.greatest(free * free, F.lit(1)))
    return t * F.sqrt(1 + 1 / n)


def identify_languages(docs: DataFrame, quantile: float = 0.999) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, entropy, rejected) for all rows of ``docs`` (doc_id, text, lang).

    Models learn from documents with a language whose crc32 of doc_id, modulo 4, is not 2; the others are held out. Of those that
    may be learned from, one in five, by hash, is not counted but sets the limits of rejection. Counts of
    character grams are added up in Spark; the model that reaches driver and tasks has one row per gram seen in a language, which
    follows its alphabet and spelling and not the number of documents. A document gets the language with
    the lowest cross-entropy per character. ``rejected`` is true where that is above the given quantile of the entropies of
    the documents set apart that the language's model knows as its own, so limits come from texts that it did not learn; a
    language with fewer than two such documents rejects none. A very long text is read whole.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text if nothing can be learned. A null
    doc_id is neither learned from nor held out; repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    # crc32 of a null is null; "not 2" then does not hold, and neither does "2".
    turn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(turn == 2, F.lit(False)).alias("held_out"),
        F.when(turn != 2, F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text"),
    )
    apart = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(5)) == 0
    usable = base.where("lang is not null")
    # A language all of whose documents would be set apart is learned from them all the same.
    whole = usable.groupBy("lang").agg(F.min(apart).alias("whole")).where("whole").select(F.col("lang").alias("name"))
    counted = usable.join(whole, F.col("lang") == F.col("name"), "left").where(~apart | F.col("name").isNotNull())
    learned = count_grams(counted.select("lang", "text")).toArrow()
    langs = np.array(learned.column("lang").to_pylist(), object)
    gram, n = (learned.column(c).to_numpy() for c in ("gram", "n"))
    counts = [(lang, gram[langs == lang].view(np.uint64), n[langs == lang]) for lang in sorted(set(langs))]
    if not counts:
        none = base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"))
        return none.withColumn("rejected", F.lit(True))
    model = spark.sparkContext.broadcast(train(counts))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield classify(part, model.value)

    scored = settle(base.mapInArrow(predict, SCORES), "languages")
    known = scored.where(apart & (F.col("lang") == F.col("lang_pred")) & (F.col("letters") > 0)).groupBy("lang_pred")
    away = F.avg("entropy") + _deviations(quantile, F.count("*")) * F.stddev_samp("entropy")
    limits = known.agg(F.when(F.count("*") > 1, F.greatest(F.percentile_approx("entropy", quantile, 10_000), away)).alias("most"))
    # One row per language that was learned.
    return scored.join(F.broadcast(limits), "lang_pred", "left").select(
        "doc_id", "held_out", "lang_pred", "score", "entropy",
        F.coalesce((F.col("lang_pred") == UNKNOWN) | (F.col("entropy") > F.col("most")), F.lit(False)).alias("rejected"),
    )
