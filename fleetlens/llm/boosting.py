"""Gradient boosting of shallow trees for a yes or no question, on rows at hand or on a table of any size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


@dataclass
class Trees:
    """``depth`` levels of splits per tree in heap order: go right where a feature is above its cut."""

    depth: int
    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0) -> Trees:
    """Logistic loss, Newton steps; splits are looked for among quantiles of each feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1)  # bin b: above cuts[b - 1], not above cuts[b]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    inner = 2**depth - 1
    out = Trees(depth, start, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best, g, h = 1e-6, slope[own].sum(), bend[own].sum()
            for f, edges in enumerate(cuts if len(own) > 1 else []):
                left_g = np.cumsum(np.bincount(binned[own, f], slope[own], len(edges) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[own, f], bend[own], len(edges) + 1))[:-1]
                gain = left_g**2 / (left_h + smooth) + (g - left_g) ** 2 / (h - left_h + smooth) - g**2 / (h + smooth)
                if len(gain) and gain.max() > best:
                    best = gain.max()
                    out.feature[t, node], out.cut[t, node] = f, edges[int(gain.argmax())]
            at[own] = 2 * node + 1 + (x[own, out.feature[t, node]] > out.cut[t, node])
        for k in range(inner + 1):
            own = at == inner + k
            out.leaf[t, k] = rate * slope[own].sum() / (bend[own].sum() + smooth)
        score += out.leaf[t, at - inner]
    return out


def threshold(score: np.ndarray, y: np.ndarray, precision: float, support: int) -> float:
    """The lowest score from which at least ``precision`` of the rows are true; infinite if fewer than ``support`` rows reach it."""
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(y[order]) >= precision * np.arange(1, len(y) + 1)
    # Rows of one score stand or fall together.
    last = np.append(score[order][1:] != score[order][:-1], True) if len(y) else np.zeros(0, bool)
    fits = np.flatnonzero(good & last)
    return float(score[order][fits[-1]]) if len(fits) and fits[-1] + 1 >= support else float("inf")


# The same over rows of any number ------------------------------------------------------------------------
#: Parts of one in which slopes and bends are summed: sums of whole numbers don't depend on the order of the rows.
_UNIT = 2**30
#: Rows of a task.
TASK_ROWS = 20_000


def _scores(trees: Trees, x: np.ndarray, upto: int) -> np.ndarray:
    """Scores of rows by the first trees; cuts and rows both as numbers of bins."""
    score, rows = np.full(len(x), trees.start), np.arange(len(x))
    for t in range(upto):
        score += trees.leaf[t, _leaf(trees, t, x, rows, trees.depth) - len(trees.feature[t])]
    return score


def _leaf(trees: Trees, t: int, x: np.ndarray, rows: np.ndarray, levels: int) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range(levels):
        at = 2 * at + 1 + (x[rows, trees.feature[t][at]] > trees.cut[t][at])
    return at


def _read(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and folds of a task's rows."""
    parts = list(batches)
    column = lambda name: [v for b in parts for v in b.column(name).to_pylist()]
    return np.frombuffer(b"".join(column("bins")), np.uint8).reshape(-1, width), np.array(column("label"), float), np.array(column("fold"), np.int64)


def _level_sums(models: dict[int, Trees], t: int, level: int, width: int, bins: int):
    """Per task one row: slopes and bends by model, node of a level of tree ``t``, feature and bin."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, fold = _read(batches, width)
        out = np.zeros((len(models), 2, 2**level, width, bins), np.int64)
        for m, (held, trees) in enumerate(models.items()):
            own, label = x[fold != held], y[fold != held]
            p = 1 / (1 + np.exp(-_scores(trees, own, t)))
            node = _leaf(trees, t, own, np.arange(len(own)), level) - (2**level - 1)
            for k, value in enumerate((label - p, p * (1 - p))):
                whole = np.rint(value * _UNIT)
                for f in range(width):  # below 2**53, so exact
                    out[m, k, :, f] += np.bincount(node * bins + own[:, f], whole, 2**level * bins).astype(np.int64).reshape(-1, bins)
        yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    return sums


def fit_rows(rows: DataFrame, folds: int, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0) -> tuple[DataFrame, dict[int, Trees]]:
    """``fit`` over all rows (fold, kind, label, features), in tasks: for each fold the trees of the rows outside, and at ``folds`` those
    of all rows; a model whose rows have one label only is left out. Also returned: (kind, label, score), each row scored by the trees
    that did not see its fold.

    Cuts are quantiles of all rows, their values rounded so that few are told apart. A pass over the rows gives each level of a tree its sums, of one size for each task whatever its rows
    are, so the driver gets sums alone.
    """
    width = rows.select(F.size("features").alias("n")).first()["n"]
    quantiles = [float(q) for q in np.linspace(0, 1, bins + 1)[1:-1]]
    cuts = [np.unique(c) for c in rows.agg(*[F.percentile(F.round(F.col("features")[f], 4), quantiles).alias(f"c{f}") for f in range(width)]).first()]
    counted = {r["fold"]: (r["n"], r["true"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("label").alias("true")).collect()}
    inner, models = 2**depth - 1, {}
    for held in range(folds + 1):
        n, true = (sum(c[i] for fold, c in counted.items() if fold != held) for i in (0, 1))
        if 0 < true < n:
            share = min(max(true / n, 1e-3), 1 - 1e-3)
            models[held] = Trees(depth, float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("features").to_pylist(), float).reshape(-1, width)
            found = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1).astype(np.uint8)
            yield pa.record_batch([b.column("fold"), b.column("kind"), b.column("label"), pa.array([r.tobytes() for r in found], pa.binary())], names=["fold", "kind", "label", "bins"])

    tasks = -(-sum(n for n, _ in counted.values()) // TASK_ROWS)
    kept = rows.select(F.col("fold").cast("int").alias("fold"), "kind", "label", "features").mapInArrow(binned, "fold int, kind string, label boolean, bins binary")
    kept = settle(kept.repartition(tasks), "binned-rows")
    for t in range(trees):
        for level in range(depth):
            found = kept.mapInArrow(_level_sums(models, t, level, width, bins), "sums binary").collect()
            total = sum(np.frombuffer(r["sums"], np.int64) for r in found).reshape(len(models), 2, 2**level, width, bins) / _UNIT
            for (slope, bend), model in zip(total, models.values()):
                _split(model, t, level, slope, bend, cuts, rate, smooth)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, fold = _read(iter([b]), width)
            score = np.full(len(x), np.nan)
            for held, model in models.items():
                score[fold == held] = 1 / (1 + np.exp(-_scores(model, x[fold == held], trees)))
            there = pa.array(~np.isnan(score))
            yield pa.record_batch([b.column("kind"), b.column("label"), pa.array(score)], names=["kind", "label", "score"]).filter(there)

    scores = kept.mapInArrow(scored, "kind string, label boolean, score double")
    real = lambda model: np.array([[cuts[f][int(c)] if c < np.inf else np.inf for f, c in zip(*row)] for row in zip(model.feature, model.cut)])
    return scores, {held: Trees(depth, m.start, m.feature, real(m), m.leaf) for held, m in models.items()}


def _split(model: Trees, t: int, level: int, slope: np.ndarray, bend: np.ndarray, cuts: list[np.ndarray], rate: float, smooth: float) -> None:
    """The best split of each node of a level, by the sums of its rows; at the last level also the leaves below."""
    inner = model.feature.shape[1]
    for i in range(2**level):
        node, best, g, h = 2**level - 1 + i, 1e-6, slope[i, 0].sum(), bend[i, 0].sum()
        left = (g, h)
        for f, edges in enumerate(cuts):
            left_g, left_h = np.cumsum(slope[i, f])[: len(edges)], np.cumsum(bend[i, f])[: len(edges)]
            gain = left_g**2 / (left_h + smooth) + (g - left_g) ** 2 / (h - left_h + smooth) - g**2 / (h + smooth)
            if len(gain) and gain.max() > best:
                best, cut = gain.max(), int(gain.argmax())
                model.feature[t, node], model.cut[t, node] = f, cut
                left = (left_g[cut], left_h[cut])
        if level == model.depth - 1:
            for k, (own_g, own_h) in enumerate((left, (g - left[0], h - left[1]))):
                model.leaf[t, 2 * node + 1 + k - inner] = rate * own_g / (own_h + smooth)


def threshold_of(counts: list[tuple[float, int, int]], precision: float) -> float:
    """``threshold`` from (score, rows, true rows)."""
    rows = true = 0
    lowest = float("inf")
    for score, n, good in sorted(counts, reverse=True):
        rows, true = rows + n, true + good
        if true >= precision * rows:
            lowest = score
    return lowest
