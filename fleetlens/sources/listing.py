"""Listings of file trees as tables: folders are read in tasks, one level after the other, so no machine holds the names of all
files. Texts are read last, for the rows that are wanted."""

from __future__ import annotations

import datetime as dt
import fnmatch
import itertools
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLACE = "repo string, path string, uri string"
LISTED = f"{PLACE}, length bigint, modified timestamp"
_ENTRY = f"{LISTED}, is_dir boolean"
#: Folders that hold a repository's history instead of its files.
SKIPPED = (".git",)
#: Rows of files are handed over once they hold so many bytes.
BATCH_BYTES = 32_000_000
#: Rows of listings are handed over so many at once, of several small folders together or of a part of a large one.
LISTED_ROWS = 10_000
#: Spark's own names of schemes that pyarrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a full name, and the name in it. Names are taken as they are, without escapes."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest if scheme == "file" else uri)
    authority, _, inner = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{authority}/")
    return system, f"{base.rstrip('/')}/{inner}"


def _patterns(glob: str) -> list[str]:
    """A glob with ``{a,b}`` as globs without."""
    parts = re.split(r"\{([^{}]*)\}", glob)
    return ["".join(p) for p in itertools.product(*[x.split(",") if i % 2 else [x] for i, x in enumerate(parts)])]


def _list_level(globs: list[str], rows_at_once: int = LISTED_ROWS):
    names = ["repo", "path", "uri", "length", "modified", "is_dir"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
    never = dt.datetime.fromtimestamp(0, dt.timezone.utc)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for folder in batch.to_pylist():
                system, base = file_system(folder["uri"])
                for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                    name = info.base_name
                    is_dir = info.type == fs.FileType.Directory
                    if (is_dir and name not in SKIPPED) or (info.type == fs.FileType.File and any(fnmatch.fnmatchcase(name, g) for g in globs)):
                        path = f"{folder['path']}/{name}" if folder["path"] else name
                        yield folder["repo"], path, f"{folder['uri']}/{name}", info.size, info.mtime or never, is_dir

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = entries(batches)
        while rows := list(itertools.islice(found, rows_at_once)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return children


def repositories(spark: SparkSession, bases: list[str]) -> DataFrame:
    """(repo, path, uri) of the folders right below the bases: each is a repository, with an empty path in it."""
    roots = spark.createDataFrame([(None, "", b) for b in bases], PLACE)
    found = roots.mapInArrow(_list_level([]), _ENTRY)
    return settle(found.select(F.col("path").alias("repo"), F.lit("").alias("path"), "uri"), "repositories")


def walk(starts: DataFrame, name_glob: str = "*", levels: int | None = None) -> DataFrame:
    """Every file below the folders (repo, path, uri) whose name matches the glob, as (repo, path, uri, length, modified).

    One job for each level of folders, at most ``levels``; each reads the folders that the one before found, spread by hash, so that a
    repository with most of the files is dealt over all tasks. Names that begin with ``_`` or ``.`` are files like any other; folders
    named in ``SKIPPED`` are not entered, and a start that does not exist holds nothing.
    """
    spark = starts.sparkSession
    target = scratch_dir(spark, "listing")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    globs, folders, level = _patterns(name_glob), starts.select("repo", "path", "uri"), 0
    read = spark.read.schema(_ENTRY)
    while levels is None or level < levels:
        one = f"{target}/level={level}"
        seen = Observation()
        found = folders.repartition(tasks, "uri").mapInArrow(_list_level(globs), _ENTRY)
        found.observe(seen, F.count_if("is_dir").alias("deeper")).write.parquet(one)
        folders = read.parquet(one).where("is_dir").select("repo", "path", "uri")
        level += 1
        if not seen.get["deeper"]:
            break
    return read.parquet(target).where("not is_dir").select("repo", "path", "uri", "length", "modified")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def joined(batch: pa.RecordBatch, rows: list[int], contents: list[bytes]) -> pa.RecordBatch:
        part = batch.take(pa.array(rows, pa.int64()))
        return pa.record_batch([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])

    for batch in batches:
        rows, contents, held = [], [], 0
        for i, uri in enumerate(batch.column("uri").to_pylist()):
            system, name = file_system(uri)
            try:
                with system.open_input_stream(name) as stream:
                    data = stream.read()
            except FileNotFoundError:  # gone since it was listed
                continue
            rows.append(i)
            contents.append(data)
            held += len(data)
            if held >= BATCH_BYTES:
                yield joined(batch, rows, contents)
                rows, contents, held = [], [], 0
        if rows:
            yield joined(batch, rows, contents)


def with_content(listed: DataFrame) -> DataFrame:
    """Add the bytes of each listed file as ``content``. The rows are dealt over as many tasks as their sizes call for; a file that
    has vanished since it was listed gives no row."""
    spark = listed.sparkSession
    total = listed.agg(F.sum("length")).first()[0] or 0
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // size))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    return listed.repartition(tasks, "uri").mapInArrow(_read_files, f"{fields}, content binary")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, change) between two listings of one tree: ``added``, ``removed``, or ``changed`` where size or time of change
    differ. One aggregation over both sides; its rows are what a refresh of the catalog takes as changes."""
    facts = F.struct("length", "modified")
    both = old.select("repo", "path", facts.alias("was"), F.lit(None).cast("struct<length:bigint,modified:timestamp>").alias("now")).unionByName(
        new.select("repo", "path", F.lit(None).cast("struct<length:bigint,modified:timestamp>").alias("was"), facts.alias("now"))
    )
    sides = both.groupBy("repo", "path").agg(F.max("was").alias("was"), F.max("now").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return sides.select("repo", "path", change.alias("change")).where("change is not null")
