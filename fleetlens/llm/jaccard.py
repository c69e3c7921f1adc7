"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence with size-derived bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .components import connected_components
from .words import Windows, mix, signed, slices, words_of

#: N-grams that come last in the order of the incidence's columns, if they are among the most frequent ones. The order may
#: be any: this number bounds the table that is broadcast (8 bytes each) and the result does not depend on it.
LATE = 1 << 17
#: Columns with more documents than this are first joined through single documents of theirs, their hubs.
STAR = 8
#: Hubs that a crowded column names in a round, and of a document's hubs those whose sketches are compared and those verified.
HUBS, COMPARED, VERIFIED = 4, 4, 1
#: Rounds go on while the pairs of a column outnumber its rows by more than this, and shrink by half.
ROOM = 4
#: Words of 64 bits in a document's sketch of its leading columns, and in the smaller one that goes along with rows.
SKETCH, SMALL_SKETCH = 16, 4
#: Bits per n-gram, and up to twice as many, in a document's sketch of its whole set: a thirtieth to a fifteenth of the set's bytes.
SET_BITS = 2
#: Bits of the table of wanted documents that is broadcast: 4 MB.
WANTED_BITS = 25


def shingle_sets(texts: pa.Array, length: int) -> list[np.ndarray]:
    """Per text its distinct shingles as sorted hashes; a text of fewer words has its whole sequence as one."""
    words = words_of(texts, lower=True)
    window = Windows(words.hash)
    counts = words.counts
    start = np.arange(len(words.hash))
    last = np.maximum(words.first[1:] - length, words.first[:-1])
    start = start[start <= np.repeat(last, counts)]
    size = np.repeat(np.minimum(counts, length), np.where(counts > 0, np.maximum(counts - length, 0) + 1, 0))
    keys = window(start, size)
    ends = np.cumsum(np.where(counts > 0, np.maximum(counts - length, 0) + 1, 0))
    return [np.unique(x) for x in np.split(keys, ends[:-1])] if len(ends) else []


def set_id(keys: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = mix(keys).sum(dtype=np.uint64) if len(keys) else np.uint64(0)
    return int(mix(np.array([total + np.uint64(len(keys))]))[0].view(np.int64))


def _first_of_each(part: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, set id, set) of the first document of each non-empty set in a slice."""
    seen = set()
    for doc_id, keys in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), length)):
        if len(keys) and doc_id is not None and (name := set_id(keys)) not in seen:
            seen.add(name)
            yield doc_id, name, keys


def _narrow(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _bits(keys: np.ndarray) -> np.ndarray:
    """A bit for the hash of each n-gram of a set; the number of bits is a power of two and grows with the set."""
    size = 64
    while size < SET_BITS * len(keys):
        size *= 2
    bits = np.zeros(size if len(keys) else 0, bool)
    bits[(keys & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _facts(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """A row per document with a sketch of its set, and a row per n-gram that at least three different sets of the slice hold."""
    sets = shingle_sets(part.column("text"), length)
    own = {set_id(k): k for k in sets if len(k)}
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *own.values()]), return_counts=True)
    keys, counts = keys[counts >= 3], counts[counts >= 3]
    n, m = len(sets), len(keys)
    bits = [_bits(k) for k in sets]
    ends = np.cumsum([0, *map(len, bits), *[0] * m])
    return pa.record_batch(
        [
            pa.array(part.column("doc_id").to_pylist() + [None] * m, pa.int64()),
            pa.array([len(k) for k in sets] + [None] * m, pa.int64()),
            pa.array([set_id(k) if len(k) else None for k in sets] + [None] * m, pa.int64()),
            pa.array([None] * n + signed(keys).tolist(), pa.int64()),
            pa.array([None] * n + counts.tolist(), pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(np.concatenate([np.zeros(0, np.uint64), *bits]))),
        ],
        names=["doc_id", "n_shingles", "name", "gram", "df", "bits"],
    )


def _prefixes(part: pa.RecordBatch, length: int, percent: int, late: np.ndarray) -> pa.RecordBatch:
    """The leading n-grams of each set: two sets that link share one of them, whatever the order of n-grams is."""
    grams, names, sizes = [], [], []
    for _, name, keys in _first_of_each(part, length):
        at = np.minimum(np.searchsorted(late, keys), max(len(late) - 1, 0))
        is_late = late[at] == keys if len(late) else np.zeros(len(keys), bool)
        lead = len(keys) - -(-percent * len(keys) // 100) + 1
        chosen = np.concatenate([keys[~is_late], keys[is_late]])[:lead]
        grams.append(chosen)
        names.append(np.full(len(chosen), name, np.int64))
        sizes.append(np.full(len(chosen), len(keys), np.int32))
    if not grams:
        return pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32())], names=["gram", "name", "n"])
    return pa.record_batch([signed(np.concatenate(grams)), np.concatenate(names), np.concatenate(sizes)], names=["gram", "name", "n"])


def _wanted_table(nodes: DataFrame) -> np.ndarray:
    """One bit per hash of a wanted document, 4 MB whatever their number. False hits cost a little, none is missed."""
    slot = F.pmod(F.xxhash64("node"), F.lit(1 << WANTED_BITS))
    rows = (
        nodes.select(F.shiftright(slot, 15).alias("bucket"), F.pmod(slot, F.lit(1 << 15)).alias("bit"), slot.alias("slot"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    table = np.zeros((1 << (WANTED_BITS - 15), 4096), np.uint8)
    for row in rows:
        table[row["bucket"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return table.ravel()


def _sets_of(docs: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """(node, grams) of the wanted documents, and of few others, read from the texts again instead of kept for all."""
    table: Broadcast = docs.sparkSession.sparkContext.broadcast(_wanted_table(nodes))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << WANTED_BITS)).alias("slot"),
    )

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            for part in slices(batch.filter(pa.array(hit))):
                sets = shingle_sets(part.column("text"), length)
                ends = np.cumsum([0, *map(len, sets)])
                grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(np.concatenate([np.zeros(0, np.uint64), *sets])))
                yield pa.record_batch([part.column("doc_id"), grams], names=["node", "grams"])

    return base.where("doc_id is not null").mapInArrow(pick, "node long, grams array<long>")


def _near_by_sketch(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that sketches (node, size, bits) of their whole sets do not rule out: each bit that only one of them has is an n-gram of
    its own. A sketch is a small part of a set, so that few pairs that do not link have their sets sent."""
    pairs = pairs.select("u", "v").distinct()
    both = pairs.join(sets.toDF("v", "nb", "b"), "v").join(sets.toDF("u", "na", "a"), "u").withColumn("k", F.least(F.size("a"), F.size("b")))

    def folded(bits: str) -> Column:
        """With as few bits as the shorter sketch has: each stands for several."""
        none = F.array_repeat(F.lit(0).cast("long"), F.col("k"))
        turns = F.sequence(F.lit(0), (F.size(bits) / F.col("k")).cast("int") - 1)
        return F.aggregate(turns, none, lambda held, i: F.zip_with(held, F.slice(bits, i * F.col("k") + 1, F.col("k")), lambda p, q: p.bitwiseOR(q)))

    def lone(x: str, y: str) -> Column:
        words = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(words, F.lit(0), lambda total, k: total + k)

    both = both.select("u", "v", "na", "nb", folded("a").alias("a"), folded("b").alias("b"))
    most = F.least(F.col("na") - lone("a", "b"), F.col("nb") - lone("b", "a"))
    return both.where(most >= F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))).select("u", "v")


def _links(docs: DataFrame, pairs: DataFrame, percent: int, length: int) -> DataFrame:
    """Of the pairs (u, v) those whose whole sets meet the bound."""
    pairs = settle(pairs.select("u", "v").distinct(), "pairs")
    sets = _sets_of(docs, pairs.select(F.explode(F.array("u", "v")).alias("node")), length)
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("b")), "v").join(
        sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), "u"
    )
    same = F.size(F.array_intersect("a", "b"))
    return settle(both.where(100 * same >= percent * (F.size("a") + F.size("b") - same)).select("u", "v").distinct(), "links")


def _least_shared(a: Column, b: Column, percent: int) -> Column:
    """Leading columns that sets of sizes ``a`` and ``b`` share at least if they link: all but the leading ones of the set that
    ends first, ceil(percent * size / 100) - 1 of them, can be shared besides."""
    whole = F.ceil(percent * (a + b) / (100 + percent))
    return whole - F.ceil(percent * F.greatest(a, b) / 100) + 1


def _may_link(shared: str, a: str, b: str, percent: int) -> Column:
    a, b = F.col(a), F.col(b)
    return _sizes_fit(a, b, percent) & (F.col(shared) >= _least_shared(a, b, percent))


def _crowds(docs: DataFrame, block: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, length: int) -> DataFrame:
    """Links that join up the documents of crowded columns as far as hubs reach.

    In each round a crowded column names a few hubs, new ones each time: documents with the most shared columns, which are the ones
    least edited. A document's sketch is held against those of the hubs it meets in most columns, and the nearest one that
    the bound allows is verified, unless sketches of their whole sets rule it out. Most of a group of near copies is one component after
    a round or two, and pairs within a component are not looked at again. What hubs do not reach is left to the product.
    """
    crowd = block.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") > STAR).select("gram")
    dense = settle(block.join(crowd, "gram").join(sketches.select("node", F.col("m").alias("weight")), "node"), "crowds")
    links = docs.sparkSession.createDataFrame([], "u long, v long")
    used, found, left = None, None, float("inf")
    while True:
        placed = dense.withColumn("c", F.col("node")) if found is None else _placed(dense, found)
        shares = placed.groupBy("gram", "c").agg(F.count("*").alias("k")).groupBy("gram").agg(
            F.sum("k").alias("rows"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs")
        )
        busy = settle(shares.where(F.col("pairs") > ROOM * F.col("rows")), "busy")
        now = busy.agg(F.sum("pairs").alias("n")).first()["n"] or 0
        if now == 0 or now > 0.5 * left:
            return links
        left = now
        open_ = settle(placed.join(busy.select("gram"), "gram"), "open-columns")
        free = open_ if used is None else open_.join(used, ["gram", "node"], "left_anti")
        best = F.max_by(F.struct("node", "n", "c"), F.struct("weight", -F.col("node"))).alias("hub")
        hubs = settle(
            free.groupBy("gram", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("turn")).agg(best)
            .select("gram", F.col("hub.node").alias("h"), F.col("hub.n").alias("hn"), F.col("hub.c").alias("hc")), "hubs"
        )
        named = hubs.select("gram", F.col("h").alias("node"))
        used = named if used is None else used.unionByName(named)
        votes = (
            open_.join(hubs, "gram").where((F.col("c") != F.col("hc")) & _sizes_fit(F.col("n"), F.col("hn"), percent))
            .groupBy("node", "n", "h", "hn").agg(F.count("*").alias("votes"))
        )
        chosen = settle(_most(votes, "votes", COMPARED), "chosen")
        both = chosen.join(sketches.toDF("h", "hm", "hs"), "h").join(sketches, "node")
        most = F.least(_most_shared(F.col("m"), F.col("s"), F.col("hs")), _most_shared(F.col("hm"), F.col("hs"), F.col("s")))
        shared = both.select("node", "n", "h", "hn", most.alias("shared"))
        near = _most(shared.where(_may_link("shared", "n", "hn", percent)), "shared", VERIFIED)
        near = _near_by_sketch(near.select(F.col("h").alias("u"), F.col("node").alias("v")), sets, percent)
        links = links.unionByName(_links(docs, near, percent, length))
        found = connected_components(links)


def _most(pairs: DataFrame, count: str, k: int) -> DataFrame:
    """Of each node's hubs, at most one per column and so few, the ``k`` with the highest count."""
    order = W.partitionBy("node").orderBy(F.desc(count), "h")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("node", "n", "h", "hn")


def _sketches(block: DataFrame) -> DataFrame:
    """(node, m, s): number of a node's columns and a bit for the hash of each. Rows meet before they are merged: a node's columns
    lie apart, and a partial sketch is larger than a row."""
    slot = F.pmod(F.xxhash64("gram"), F.lit(64 * SKETCH))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = [F.bit_or(F.when(F.floor(slot / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(SKETCH)]
    return block.select("gram", "node").repartition("node").groupBy("node").agg(F.count("*").alias("m"), *words).select("node", "m", F.struct(*[f"s{i}" for i in range(SKETCH)]).alias("s"))


def _folded(sketches: DataFrame) -> DataFrame:
    """The same with fewer bits: each stands for several of the whole sketch."""
    words = []
    for i in range(SMALL_SKETCH):
        word = F.col(f"s.s{i}")
        for j in range(i + SMALL_SKETCH, SKETCH, SMALL_SKETCH):
            word = word.bitwiseOR(F.col(f"s.s{j}"))
        words.append(word.alias(f"s{i}"))
    return sketches.select("node", "m", F.struct(*words).alias("s"))


def _most_shared(m: Column, s: Column, other: Column, words: int = SKETCH) -> Column:
    """At most so many columns are shared with a node of the other sketch: each bit that only one has is a column of its own."""
    lone = [F.bit_count(s[f"s{i}"].bitwiseAND(F.bitwise_not(other[f"s{i}"]))) for i in range(words)]
    return m - sum(lone[1:], lone[0])


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of nodes with their component as ``c``."""
    return rows.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _product(block: DataFrame, sketches: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(u, v, most, least, shared): shared columns of pairs from different components, with the sizes of both sets.

    Of such a pair one is outside the largest component of each column they share, so only those outside are paired off.
    """
    placed = _placed(block, found)
    parts = placed.groupBy("gram", "c").agg(F.count("*").alias("k")).groupBy("gram").agg(
        F.count("*").alias("parts"), F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("inner")
    )
    busy = F.col("rows") * F.col("rows") - F.col("inner") > 2 * ROOM * F.col("rows")
    columns = settle(placed.join(parts.where("parts > 1").select("gram", "main", busy.alias("busy")), "gram"), "columns")
    some, many = _met(columns.where("not busy"), percent), _met(columns.where("busy").join(_folded(sketches), "node"), percent, ("m", "s"))
    # A pair may stand either way round in different columns.
    sizes = F.greatest("n", "n_").alias("most"), F.least("n", "n_").alias("least")
    ends = F.least("node", "node_").alias("u"), F.greatest("node", "node_").alias("v")
    return some.unionByName(many).groupBy(*ends, *sizes).agg(F.count("*").alias("shared"))


def _met(columns: DataFrame, percent: int, sketch: tuple[str, ...] = ()) -> DataFrame:
    """A row (node, n, node_, n_) for each column that a pair shares, unless sizes or sketches rule the pair out."""
    outside = columns.where("c <> main").select("gram", *[F.col(x).alias(f"{x}_") for x in ("node", "n", "c", *sketch)])
    # Both may be outside; such a pair counts once.
    fits = (F.col("c") != F.col("c_")) & ((F.col("c_") < F.col("c")) | (F.col("c") == F.col("main"))) & _sizes_fit(F.col("n"), F.col("n_"), percent)
    if sketch:
        need = _least_shared(F.col("n"), F.col("n_"), percent)
        here, there = _most_shared(F.col("m"), F.col("s"), F.col("s_"), SMALL_SKETCH), _most_shared(F.col("m_"), F.col("s_"), F.col("s"), SMALL_SKETCH)
        fits &= (here >= need) & (there >= need)
    return outside.join(columns, "gram").where(fits).select("node", "n", "node_", "n_")


def jaccard_join(docs: DataFrame, percent: int = 75, length: int = 5) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for all rows of ``docs`` (doc_id, text): documents link when
    100 times the intersection of their shingle sets is at least ``percent`` times the union.

    1. Documents with equal sets are one node, named by their smallest doc_id.
    2. The incidence keeps the leading columns of each row, in an order that puts the most frequent n-grams last; two sets
       that link share a leading n-gram. Columns that only one set holds are dropped.
    3. Columns of many documents are joined through a few hubs first; the links found make components. Pairs within a
       component need no further look, so a group of thousands of near copies is not paired off.
    4. The product of the rest, over pairs from different components, adds up the shared columns of each pair. A pair is
       discarded at once if sizes or sketches of its columns rule it out, else if the sum stays below the bound that its sizes give.
    5. Pairs that are left are held against sketches of their whole sets, whose bits grow with the set, then verified on the sets,
       read from the texts again.

    Every text is read whole and every candidate is verified; nothing is sampled or capped. A text without words, or null, has an
    empty set and is its own component; a null doc_id links with nothing and has a null component; repeated rows
    are copies; a doc_id should name one text. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    facts = settle(_narrow(docs, lambda part: _facts(part, length), "doc_id long, n_shingles long, name long, gram long, df long, bits array<long>"), "shingle-facts")
    late_rows = (
        facts.where("gram is not null").groupBy("gram").agg(F.sum("df").alias("df")).where("df >= 16")
        .orderBy(F.desc("df"), "gram").limit(LATE).select("gram").toArrow()
    )
    late = spark.sparkContext.broadcast(np.sort(late_rows.column("gram").to_numpy().view(np.uint64)))
    listed = facts.where("gram is null").select("doc_id", "n_shingles", "name")
    nodes = settle(
        facts.where("gram is null and doc_id is not null and name is not null").groupBy("name")
        .agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("size"), F.any_value("bits").alias("bits")), "nodes"
    )
    names, sets = nodes.select("name", "node"), nodes.select("node", "size", "bits")

    leading = _narrow(docs, lambda part: _prefixes(part, length, percent, late.value), "gram long, name long, n int")
    shared = leading.groupBy("gram").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("gram")
    block = settle(leading.join(shared, "gram").join(names, "name").select("gram", "node", "n").distinct(), "incidence")

    sketches = settle(_sketches(block), "sketches")
    links = _crowds(docs, block, sketches, sets, percent, length)
    product = _product(block, sketches, connected_components(links), percent)
    rest = product.where(_may_link("shared", "most", "least", percent)).select("u", "v")
    rest = _near_by_sketch(rest, sets, percent)
    found = connected_components(links.unionByName(_links(docs, rest, percent, length)))

    own = listed.join(names, "name", "left").join(found, "node", "left")
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
