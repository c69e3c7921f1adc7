"""Whitening of embeddings: MLlib's BlockMatrix for scatter and projection, one local eigendecomposition between them."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Entries from here on count as not finite: beyond it a double holds no fractions and sums leave 38 digits.
LARGEST = 2.0**53
#: A block holds at most so many bytes and columns; a task multiplies so many pairs of blocks.
BLOCK_BYTES, BLOCK_COLUMNS, SLAB = 32 << 20, 256, 2
#: Rows of one written partition have places below this.
_PART = 33

SCHEMA = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


@dataclass(frozen=True)
class Fit:
    """What is learnt from all vectors of one length: their number, exact sums, unit eigenvectors (columns) of their covariance and
    its eigenvalues, both by falling eigenvalue, and the share of the trace that each explains."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _entries(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """Rows (vec_id, x, size, place) of the vectors that count: entries as long numbers and a place of its own for each row."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    x = F.transform("v", lambda c: F.floor(c * float(scale)).cast("long") + F.lit(shift).cast("long"))
    return base.where(whole).select("vec_id", x.alias("x"), F.size("v").alias("size"), F.monotonically_increasing_id().alias("place"))


def _sums(rows: DataFrame) -> list[int]:
    """Exact sums of all entries, a number for each dimension."""
    each = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    return [int(r["s"]) for r in sorted(each.collect())]


def _centred(n: int, sums: list[int]):
    """x - S / n: the whole part of the mean is taken off in whole numbers, so nothing is lost to its size."""
    whole = F.array(*[F.lit(s // n).cast("long") for s in sums])
    rest = F.array(*[F.lit(float(Fraction(s, n) - s // n)) for s in sums])
    return F.transform("x", lambda c, i: (c - F.get(whole, i)).cast("double") - F.get(rest, i))


def _deviation(n: int, sums: list[int]):
    """The exact sum of (n * x - S)^2, null where a long can't hold it."""
    held = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
    squares = F.transform("x", lambda c, i: _square((c.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - F.get(held, i)).cast("decimal(38,0)")))
    return F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda a, b: F.try_add(a, b).cast("decimal(38,0)")).try_cast("long")


def _square(x):
    return F.try_multiply(x, x).cast("decimal(38,0)")


def _blocks(rows: DataFrame, n: int, sums: list[int]) -> tuple[BlockMatrix, DataFrame]:
    """Centred rows as a block matrix, and rows (vec_id, index, deviation) that say whose they are.

    An index is the written partition's first one plus the row's place there, so no pass numbers the rows; indexes without
    a row are rows of zeros, which add nothing to a product.
    """
    within = (1 << _PART) - 1
    most = rows.agg(F.max(F.shiftright("place", _PART)).alias("part"), F.max(F.col("place").bitwiseAND(F.lit(within))).alias("row")).first()
    stride = most["row"] + 1
    index = F.shiftright("place", _PART) * F.lit(stride) + F.col("place").bitwiseAND(F.lit(within))
    columns = min(len(sums), BLOCK_COLUMNS)
    height = max(1024, min(n // 64, BLOCK_BYTES // (8 * columns)))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(index.alias("index"), array_to_vector(_centred(n, sums)).alias("vector")), "vector")
    matrix = IndexedRowMatrix(vectors, (most["part"] + 1) * stride, len(sums)).toBlockMatrix(height, columns)
    return matrix, rows.select("vec_id", index.alias("index"), _deviation(n, sums).alias("deviation"))


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. Its rows are many and its product is small, so the product is cut along the rows:
    each task multiplies a few blocks and the small products are added up."""
    slabs = max(1, -(-matrix.numRows() // (matrix.rowsPerBlock * SLAB)))
    # MLlib has this way of multiplying in the JVM; Python's multiply can't name the number of cuts.
    model = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, slabs)
    return BlockMatrix(model, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def fit(matrix: BlockMatrix, n: int, sums: list[int], components: int) -> Fit:
    """Components of the centred rows of ``matrix``. Those with an eigenvalue of no more than rounding errors are left out: nothing
    can be brought to unit variance along them."""
    covariance = _scatter(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    real = values > max(values[0], 0) * len(sums) * np.finfo(float).eps
    values, vectors = values[real], vectors[:, real]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Fit(n, sums, vectors * sign, values, values / np.trace(covariance))


def _projected(matrix: BlockMatrix, whitening: np.ndarray) -> BlockMatrix:
    step, k = matrix.colsPerBlock, whitening.shape[1]
    parts = [whitening[i : i + step] for i in range(0, len(whitening), step)]
    blocks = [((i, 0), Matrices.dense(len(p), k, p.ravel(order="F"))) for i, p in enumerate(parts)]
    context = matrix.blocks.context
    return matrix.multiply(BlockMatrix(context.parallelize(blocks, len(blocks)), step, k, len(whitening), k))


def _rows_of(matrix: BlockMatrix) -> DataFrame:
    """Rows (index, whitened) without leaving the JVM, where ``IndexedRowMatrix.rows`` would give Python objects."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("whitened"))


def _identity_error(projected: BlockMatrix, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    seen = projected.toIndexedRowMatrix().toRowMatrix().computeColumnSummaryStatistics()
    mean = seen.mean() * seen.count() / n
    return float(np.abs(_scatter(projected) / n - np.outer(mean, mean) - np.eye(len(mean))).max())


def _whitened(rows: DataFrame, size: int, components: int) -> DataFrame | None:
    rows = rows.where(F.col("size") == size)
    n, sums = rows.count(), _sums(rows)
    matrix, owners = _blocks(rows, n, sums)
    found = fit(matrix, n, sums, components)
    if not len(found.values):
        return None
    projected = _projected(matrix, found.matrix)
    return owners.join(_rows_of(projected), "index").select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(float(e)) for e in found.explained]).alias("explained"), F.lit(_identity_error(projected, n)).alias("identity_error"),
    )


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Rows (vec_id, n, deviation, whitened, explained, identity_error) for the rows of ``vectors`` (vec_id, embedding) that count, each
    entry c taken as floor(scale * c) + shift. ``whitened`` and ``explained`` have an entry for each component.

    Rows whose vector is null, or holds an entry that is null, not finite or 2^53 and more, are left out. Vectors of
    different lengths are whitened apart. An empty vector, and a set of vectors that do not differ, have no components and give no rows;
    components along which vectors do not differ are left out. A null vec_id stays null; repeated rows count and come back as often as
    they are there; an empty table gives no rows; other columns are not read. A deviation that a long can't hold is null.

    The driver holds sums, covariance and components, whose size depends on the length of vectors, and the places of
    blocks, one for each 32 MB of entries.
    """
    rows = settle(_entries(vectors, scale, shift), "vector-entries")
    sizes = sorted(r["size"] for r in rows.where("size > 0").select("size").distinct().collect())
    out = vectors.sparkSession.createDataFrame([], SCHEMA)
    for size in sizes:
        if (own := _whitened(rows, size, components)) is not None:
            out = out.unionByName(own)
    return out


def digest(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component."""
    return whitened.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("i")).alias("explained"), "identity_error"
    )
