"""Mixing of overlapping sources to target weights by a min-cost flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .components import connected_components

#: Copies of a document that the mix may hold, and the cost of a word in its first, second, third copy.
COPY_COSTS = (0, 1, 3)
#: Bins of the seeded order per step, as a power of two, and the steps that follow each other.
BIN_BITS = 12
STEPS = 3


def share_targets(sizes: Sequence[int], weights: Sequence[float], limit: float = len(COPY_COSTS)) -> list[float]:
    """Shares of the sum of ``sizes`` by weight. A share stops at ``limit`` times its source's size; what it leaves is
    shared again by weight among the others until none is above."""
    total, capped = float(sum(sizes)), set()
    while True:
        rest = total - sum(limit * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        shares = [limit * float(s) if i in capped else rest * w / weight for i, (s, w) in enumerate(zip(sizes, weights))]
        above = {i for i, (x, s) in enumerate(zip(shares, sizes)) if i not in capped and x > limit * s}
        if not above:
            return shares
        capped |= above


@dataclass
class _Arc:
    to: int
    room: int
    back: int


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[int] = COPY_COSTS) -> list[list[int]]:
    """Words that each membership pattern gives in its first, second, ... copy, so that the sources get their quotas
    at the least cost of repetition.

    ``capacity`` has a pattern's words, ``members`` its sources. The graph has a node per pattern and per source, never one
    per document. Only copies cost, and each further one more, so a path is cheapest whose first arc is: the largest flow of first copies,
    enlarged by second ones and then by third ones, is the optimum. Each is found by shortest paths in levels.
    """
    n, m = len(capacity), len(quotas)
    graph: list[list[_Arc]] = [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, room: int) -> _Arc:
        graph[a].append(_Arc(b, room, len(graph[b])))
        graph[b].append(_Arc(a, 0, len(graph[a]) - 1))
        return graph[a][-1]

    begin, end = n + m, n + m + 1
    for p, sources in enumerate(members):
        for s in sources:
            link(p, n + s, sum(quotas))
    for s, quota in enumerate(quotas):
        link(n + s, end, quota)
    copies: list[list[_Arc]] = [[] for _ in range(n)]
    for k in sorted(range(len(costs)), key=lambda k: costs[k]):
        for p in range(n):
            copies[p].append(link(begin, p, capacity[p]))
        while (level := _levels(graph, begin, end))[end] >= 0:
            _block(graph, level, begin, end)
    return [[cap - arc.room for arc in arcs] for cap, arcs in zip(capacity, copies)]


def _levels(graph: list[list[_Arc]], begin: int, end: int) -> list[int]:
    """Steps from the start along arcs with room, -1 where none lead."""
    level = [-1] * len(graph)
    level[begin], queue = 0, deque([begin])
    while queue:
        a = queue.popleft()
        for arc in graph[a]:
            if arc.room > 0 and level[arc.to] < 0:
                level[arc.to] = level[a] + 1
                queue.append(arc.to)
    return level


def _block(graph: list[list[_Arc]], level: list[int], begin: int, end: int) -> None:
    """Send what fits along paths that go one level up with each arc. An arc found useless is not tried again."""
    turn = [0] * len(graph)
    path: list[_Arc] = []
    at = begin
    while True:
        if at == end:
            flow = min(arc.room for arc in path)
            for arc in path:
                arc.room -= flow
                graph[arc.to][arc.back].room += flow
            path, at = [], begin
        elif turn[at] < len(graph[at]):
            arc = graph[at][turn[at]]
            if arc.room > 0 and level[arc.to] == level[at] + 1:
                path.append(arc)
                at = arc.to
            else:
                turn[at] += 1
        elif at == begin:
            return
        else:
            arc = path.pop()
            at = graph[arc.to][arc.back].to
            turn[at] += 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _cuts(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per pattern and wanted amount, which documents make it up: those taken in one of several rounds, and the one at ``fill``.

    A round puts the documents no larger than what is missing in a seeded order of its own and takes those before its ``cut``. Sums over bins
    of the place, then over finer bins of the one bin where the amount is passed: they are merged before the shuffle and small, whatever
    share of the rows a pattern holds, and count every row that shares a place. Rounds follow until what is missing is below the shortest
    document left. Rows of one doc_id and text go together; where they alone come next and are too many, the next round leaves out documents
    of their size. What is then missing is filled by the place whose rows come closest to it, if that is better than none.
    """
    order = W.partitionBy("pattern", "copy").orderBy("bin")
    full = sized.where("size > 0")
    now = settle(wanted.select("pattern", "copy", "need", F.col("need").alias("most"), F.array().cast(_ROUNDS).alias("rounds")), "mix-open")
    done: list[DataFrame] = []
    turn = 0
    while True:
        place = _turned(F.lit(turn))
        fits = full.join(now, "pattern").where((F.col("size") <= F.col("most")) & ~_held(F.col("rounds"))).withColumn("place", place).select("pattern", "copy", "need", "size", "place")

        def passed(rows: DataFrame, step: int) -> DataFrame:
            sums = rows.groupBy("pattern", "copy", "need", _bin(step).alias("bin")).agg(F.sum("size").alias("size"), F.min("size").alias("least"))
            return sums.withColumn("upto", F.sum("size").over(order)).withColumn("before", F.col("upto") - F.col("size"))

        first = settle(passed(fits, 1), "mix-bins")
        # Where all that fits is no more than what is missing, all is taken.
        every = first.groupBy("pattern", "copy").agg(F.max("upto").alias("upto"))
        at = first
        for step in range(2, STEPS + 1):
            inner = at.where("before <= need and need < upto").select("pattern", "copy", (F.col("need") - F.col("before")).alias("need"), F.col("bin").alias("_bin"))
            at = passed(fits.drop("need").join(inner, ["pattern", "copy"]).where(_bin(step - 1) == F.col("_bin")), step)
        found = at.where("before <= need and need < upto").select("pattern", "copy", "bin", "least", (F.col("need") - F.col("before")).alias("left"))
        cut = F.coalesce("bin", F.lit(1 << 62))
        left = F.coalesce("left", F.col("need") - F.col("upto"))
        # Nothing taken: rows that share a place are too many.
        most = F.when(left == F.col("need"), F.col("least") - 1).otherwise(left)
        entry = F.struct(F.lit(turn).alias("turn"), F.col("most").alias("most"), cut.alias("cut"))
        after = now.join(every, ["pattern", "copy"], "left").join(found, ["pattern", "copy"], "left").select(
            "pattern", "copy", F.when(F.col("upto").isNull(), F.col("need")).otherwise(left).alias("need"), F.when(F.col("upto").isNull(), 0).otherwise(most).alias("most"),
            F.when(F.col("upto").isNull(), F.col("rounds")).otherwise(F.concat("rounds", F.array(entry)).cast(_ROUNDS)).alias("rounds"),
        )
        after = settle(after, "mix-open")
        done.append(after.where("most <= 0"))
        now = after.where("most > 0")
        turn += 1
        if now.isEmpty():
            break
    ended = reduce(DataFrame.unionByName, done)
    off = F.abs(F.col("size") - F.col("need"))
    rest = full.join(ended, "pattern").where((F.col("size") < 2 * F.col("need")) & ~_held(F.col("rounds")))
    groups = rest.groupBy("pattern", "copy", "need", "place").agg(F.sum("size").alias("size"))
    fill = groups.where(off < F.col("need")).groupBy("pattern", "copy").agg(F.min_by("place", F.struct(off, "place")).alias("fill"))
    return ended.join(fill, ["pattern", "copy"], "left").select("pattern", F.struct("rounds", "fill").alias("cut"))


_ROUNDS = "array<struct<turn: int, most: bigint, cut: bigint>>"


def _turned(turn: Column) -> Column:
    """The place of a document in the order of a round."""
    return F.xxhash64("place", turn)


def _held(rounds: Column) -> Column:
    """Whether a row was taken in one of the rounds."""
    return F.exists(rounds, lambda r: (F.col("size") <= r["most"]) & (F.shiftright(_turned(r["turn"]), 64 - STEPS * BIN_BITS) < r["cut"]))


def _bin(step: int) -> Column:
    """Bin of the seeded place after so many steps."""
    return F.shiftright("place", 64 - step * BIN_BITS)


def _pattern(source: str | Column, many: bool) -> Column:
    names = F.col(source) if isinstance(source, str) else source
    alone = F.array(F.lit(None).cast("string"))
    return F.to_json(F.coalesce(F.array_sort(F.array_distinct(names)), alone) if many else F.array(names.cast("string")))


def _place(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def draw_plan(docs: DataFrame, source: str | Column = "source", weights: Sequence[float] = (1, 2, 3), seed: int = 0, many: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a row (doc_id, pattern, size, place) per row of ``docs``, a row per pattern with its facts and cuts)."""
    sized = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), _pattern(source, many).alias("pattern"),
            word_count(F.col("text")).alias("size"), _place(seed).alias("place"),
        ),
        "mix-sizes",
    )
    patterns = settle(sized.groupBy("pattern").agg(F.sum("size").alias("size")).withColumn("names", F.from_json("pattern", "array<string>")), "mix-patterns")
    sources = _targets(patterns, weights)
    facts = settle(
        patterns.withColumn("own", _key(F.col("names")[0])).join(sources.select("own", "source_size", "target"), "own").join(_flows(patterns, sources), "pattern"), "mix-flows",
    )
    wanted = facts.select("pattern", "size", F.posexplode("flow").alias("copy", "need")).where("0 < need and need < size").drop("size")
    whole = F.when(F.col("size") > 0, F.size(F.filter("flow", lambda f: f == F.col("size")))).otherwise(0)
    cuts = _cuts(sized, wanted).groupBy("pattern").agg(F.collect_list("cut").alias("cuts"))
    plan = facts.select("pattern", "source_size", "target", whole.alias("whole")).join(cuts, "pattern", "left")
    return sized, settle(plan, "mix-plan")


def _key(name: Column) -> Column:
    """The pattern of one source alone: a name that is never null."""
    return F.to_json(F.array(name))


def _targets(patterns: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(own, name, source_size, target) for each source, as ``share_targets`` gives it, by one aggregate for each time that shares are shared again."""
    spark = patterns.sparkSession
    each = patterns.select(F.explode("names").alias("name"), "size").groupBy("name").agg(F.sum("size").alias("source_size"))
    ordered = settle(each.orderBy(F.col("name").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "mix-sources")
    before, offsets = 0, []
    for r in ordered.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    turn = F.col("before") + F.col("id") - F.shiftleft("part", 33)
    numbered = ordered.join(spark.createDataFrame(offsets, "part long, before long"), "part").withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    )
    words = patterns.agg(F.sum("size")).first()[0] or 0
    total, weight = numbered.agg(F.sum("source_size"), F.sum("weight")).first()
    total, limit = total or 0, len(COPY_COSTS)
    rest, weight, n = float(total), weight or 0.0, 0
    while True:
        share = F.lit(rest) * F.col("weight") / F.lit(weight) if weight else F.lit(0.0)
        above = share > limit * F.col("source_size")
        found = numbered.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("source_size"))).alias("size"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if found["n"] <= n:
            break
        n, rest, weight = found["n"], float(total - limit * found["size"]), found["weight"] or 0.0
    # Overlapping sources count a document more than once; what is shared out is the words there are.
    scale = words / max(1, total) if words < total else 1.0
    target = F.when(above, limit * F.col("source_size").cast("double")).otherwise(share) * scale
    return settle(numbered.select(_key(F.col("name")).alias("own"), "name", "source_size", target.alias("target")), "mix-targets")


def _flows(patterns: DataFrame, sources: DataFrame) -> DataFrame:
    """(pattern, flow) of every pattern. Words never flow between sources that no chain of patterns links, so each group of linked
    sources is a problem of its own; the groups are routed in tasks, and nothing of them reaches the driver. A group's row holds its patterns and
    sources, never documents."""
    given = patterns.select("pattern", "size", F.transform("names", _key).alias("owns")).withColumn("own", F.col("owns")[0])
    asked = sources.select("own", "name", F.rint("target").cast("long").alias("quota"))
    links = given.where(F.size("owns") > 1).select(F.col("own").alias("u"), F.explode("owns").alias("v")).where("u <> v")
    group = F.col("own")
    if not links.isEmpty():
        linked = settle(connected_components(links, "mix-groups").select(F.col("node").alias("own"), "component"), "mix-linked")
        given, asked = (rows.join(linked, "own", "left") for rows in (given, asked))
        group = F.coalesce("component", "own")
    given = given.groupBy(group.alias("group")).agg(F.collect_list(F.struct("pattern", "size", "owns")).alias("given"))
    asked = asked.groupBy(group.alias("group")).agg(F.collect_list(F.struct("own", "name", "quota")).alias("asked"))
    return given.join(asked, "group").select("given", "asked").mapInArrow(_routed, "pattern string, flow array<bigint>")


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flows of groups of linked sources. Sources go by name, null last, patterns by their sources, so reruns agree."""
    for batch in batches:
        names, flows = [], []
        for row in batch.to_pylist():
            asked = sorted(row["asked"], key=lambda s: (s["name"] is None, s["name"] or ""))
            number = {s["own"]: i for i, s in enumerate(asked)}
            given = sorted(([number[own] for own in p["owns"]], p["size"], p["pattern"]) for p in row["given"])
            flows += route([size for _, size, _ in given], [members for members, _, _ in given], [s["quota"] for s in asked])
            names += [pattern for _, _, pattern in given]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(flows, pa.list_(pa.int64()))], names=["pattern", "flow"])


def _copies() -> Column:
    """Of a row with its pattern's plan."""
    held = F.filter("cuts", lambda c: _held(c["rounds"]) | F.coalesce(F.col("place") == c["fill"], F.lit(False)))
    part = F.when(F.col("cuts").isNotNull(), F.size(held)).otherwise(0)
    return F.when(F.col("size") > 0, F.col("whole") + part).otherwise(0).cast("int")


def mix_sources(docs: DataFrame, source: str | Column = "source", weights: Sequence[float] = (1, 2, 3), seed: int = 0, many: bool = False) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies) for all rows of ``docs`` (doc_id, text, source).

    ``source`` is a name, or with ``many`` an array of names for documents that belong to several sources; documents
    with the same sources form a pattern. Sources in order of code points, null last, have the weights in turn. The flow is solved in tasks, one
    problem for each group of sources that patterns link; nothing per source reaches the driver. Each document is taken 0 to 3 times; which
    ones make up a part of a copy depends on a hash of seed, doc_id and text alone, so reruns agree. A very long text is counted whole.

    ``source_size`` and ``target`` are those of the document's first source. Null and empty texts have size 0 and are never
    taken; rows with one doc_id, text and source go together; an empty table gives no rows; other columns are not read.
    """
    sized, plan = draw_plan(docs, source, weights, seed, many)
    return sized.join(plan, "pattern").withColumn("copies", _copies()).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, source: str | Column = "source", weights: Sequence[float] = (1, 2, 3), seed: int = 0, many: bool = False) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken. Texts are not shuffled."""
    _, plan = draw_plan(docs, source, weights, seed, many)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _pattern(source, many).alias("pattern"), word_count(F.col("text")).alias("size"), _place(seed).alias("place"))
    taken = row.join(plan, "pattern").withColumn("copies", _copies()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
