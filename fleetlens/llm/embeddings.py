"""Near-duplicate embeddings: random-hyperplane hashing, exact cosines, distributed components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .components import connected_components


def tables_for(largest: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits per table, tables) for labels of up to ``largest`` vectors: as many bits as leave about one vector that is
    not alike in a bucket, and as many tables as bring the chance to miss a pair right at the cosine below ``miss``."""
    bits = min(30, max(8, math.ceil(math.log2(max(2, largest)))))
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - alike))


def _codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _by_size(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each vector length in a column of lists."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(size))


def _signed(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.zeros((batch.num_rows, tables), np.int64)
        for at, rows in _by_size(batch.column("vector")):
            codes[at] = _codes(rows, bits, tables, seed)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(codes.ravel()))
        sizes = pc.list_value_length(batch.column("vector")).cast(pa.int64())
        yield pa.record_batch([batch.column("node"), batch.column("label"), sizes, lists], names=["node", "label", "size", "codes"])


def _cosines(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose cosine in double precision reaches ``least``. Both vectors of a pair have one length."""
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        for (at, x), (_, y) in zip(_by_size(batch.column("x")), _by_size(batch.column("y"))):
            x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))  # squares of large floats stay finite
            dot, xx, yy = (np.einsum("ij,ij->i", a, b) for a, b in ((x, y), (x, x), (y, y)))
            near[at] = dot / np.sqrt(xx * yy) >= least
        yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(near))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-6, seed: int = 0) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for all rows of ``vectors`` (vec_id, embedding, label).

    Vectors are compared if their labels are equal and not null and their lengths agree. Equal vectors of a label form a class
    at once, so copies are never paired; classes meet in buckets of sign hashes, as many and as wide as the largest label asks for; each
    pair found is verified once; links of classes are joined into components. ``n_links`` counts rows.

    A vector that is null, zero or holds null or non-finite components, or whose label is null, links with nothing and
    is its own component. So is a row with a null vec_id, with a null component and kept false. A vec_id should name one
    vector: repeated rows count as copies of each other and link; an empty table gives no rows; other columns are not read.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    fit = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    base = base.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = settle(
        base.where("fit").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vector-classes"
    )
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    bits, tables = tables_for(largest, cosine, miss)
    signed = classes.select("node", F.col("label").cast("string").alias("label"), "vector").mapInArrow(
        lambda batches: _signed(batches, bits, tables, seed), "node long, label string, size long, codes array<long>"
    )
    bucket = signed.select("node", F.posexplode("codes").alias("turn", "code"), "label", "size").select(
        "node", F.xxhash64("label", "size", "turn", "code").alias("bucket")
    )
    filled = bucket.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket")
    bucket = bucket.join(filled, "bucket")
    pairs = (
        bucket.withColumnRenamed("node", "u").join(bucket.withColumnRenamed("node", "v"), "bucket")
        .where("u < v").select("u", "v").distinct()
    )
    own = classes.select("node", "vector", F.col("label").alias("l"))
    met = (
        pairs.join(own.select(F.col("node").alias("u"), F.col("vector").alias("x"), F.col("l").alias("lx")), "u")
        .join(own.select(F.col("node").alias("v"), F.col("vector").alias("y"), F.col("l").alias("ly")), "v")
        # Buckets are hashes: labels and lengths are compared as they are.
        .where("lx = ly and size(x) = size(y)").select("u", "v", "x", "y")
    )
    links = settle(met.mapInArrow(lambda batches: _cosines(batches, cosine), "u long, v long"), "vector-links")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    weight = classes.select(F.col("node").alias("v"), "copies")
    linked = both.join(weight, "v").groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("others"))
    facts = classes.join(linked, "node", "left").join(connected_components(links), "node", "left").select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    alone = base.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = base.where("fit").join(facts, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
