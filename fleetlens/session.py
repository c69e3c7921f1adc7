"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the plans rely on. AQE splits skewed join partitions and coalesces small ones; the
#: Arrow batch is small because rows carry whole files.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # A task holds what it deals out until its split is read, and short rows grow into facts of whole texts: with larger splits
    # tasks spill.
    "spark.sql.files.maxPartitionBytes": "16m",
    # Of keys that occur twice in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Beyond this size the JVM runs a generated method uncompiled; separate operators are faster then.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the defaults to a session made elsewhere, leaving alone what it sets itself."""
    given = dict(spark.sparkContext.getConf().getAll())
    for key, value in DEFAULTS.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


#: Bytes of written rows from which the files that were shuffled for them are given up at once.
RELEASE_BYTES = 16_000_000


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write rows that several later steps read and return the written table: the steps share one
    computation, and a lost executor costs a reread only. What was shuffled for many rows is not needed any more."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    if path_bytes(df.sparkSession, path) >= RELEASE_BYTES:
        release_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps. It does so once the driver's JVM has collected the objects that stand for
    them, which by itself it may not do before the disk is full of them."""
    spark.sparkContext._jvm.System.gc()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``. Without that setting a session on one
    machine gets a local temporary folder; on a cluster, whose machines share none, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "fleetlens")
    return f"{root.rstrip('/')}/fleetlens-{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the scratch root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch root. Frames that read it end here, so call it
    when their results are written."""
    drop_path(spark, scratch_root(spark))
