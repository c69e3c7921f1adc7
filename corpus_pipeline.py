"""From raw documents to packed sequences: quality, near duplicates, personal data, mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import jaccard, mixing, packing, pii, quality
from fleetlens.session import settle, tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own_names(docs: DataFrame) -> list[str]:
    """Names under which a stage works: any other column gets a plain one, whatever characters its own has."""
    return [c if c in ("doc_id", "text", "source", "n_chars") else f"column_{i}" for i, c in enumerate(docs.columns)]


def _under_own_names(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` makes of the rows, its columns named as in ``docs``."""
    return stage(docs.toDF(*_own_names(docs))).toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null, empty or short text fails; repeated rows are judged each; a null doc_id
    makes no difference; very long texts are judged whole; an empty table gives no rows; other columns of any name and type stay."""
    tune(spark)
    return _under_own_names(docs, quality.passing)


def _row_order(docs: DataFrame) -> Column:
    """Which of the rows with one doc_id comes first, by hashes of all columns. Types that have no hash are hashed as JSON."""
    plain = lambda f: not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
    return F.struct(F.xxhash64("text"), F.xxhash64(*[F.col(f.name) if plain(f) else F.to_json(F.struct(f.name)) for f in docs.schema]))


def _one_of_near_copies(docs: DataFrame) -> DataFrame:
    joined = jaccard.jaccard_join(docs)
    firsts = joined.where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("first"), F.struct(*docs.columns).alias("row"), _row_order(docs).alias("turn"))
    one = rows.join(firsts, "first", "left_semi").groupBy("first").agg(F.min_by("row", "turn").alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; of rows that share a doc_id the one with the smallest hashes
    of its columns. Documents without an id are in no group and stay; those without text are alone in theirs; very long texts are compared
    whole; an empty table gives no rows; other columns of any name and type stay."""
    tune(spark)
    return _under_own_names(docs, _one_of_near_copies)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, ``n_chars`` counted anew. A null text stays null, an empty one empty; repeated
    rows stay repeated; null ids stay; very long texts are scanned whole; an empty table gives no rows; other columns of any name and type stay."""
    tune(spark)
    clean = _under_own_names(docs, pii.redact)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null and empty texts are never taken; a null source is a source; rows with one
    doc_id, text and source go together; an empty table gives no rows; other columns of any name and type stay."""
    tune(spark)
    return _under_own_names(docs, mixing.mixed_documents)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and their places in sequences. A null or empty text is its end id alone; null ids stay; repeated rows are
    packed each; very long texts are cut; an empty table gives no rows; other columns are not read."""
    tune(spark)
    return packing.pack_documents(docs, added=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_to_targets),
    ("packing", pack),
]

#: Compression ratios, boosted trees and token ids have no SQL; tests run the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
