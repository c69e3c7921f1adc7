"""The published estate: catalog rows and the totals of every object, kept up to date job by job.

``<path>/catalog`` holds catalog rows in folders by (repo, hash of the ticket), ``<path>/totals`` a row per object in folders by
(repo, hash of the object). The index and the graph are read from these two tables: their rows are exploded from the catalog's, their
labels and counts are the totals'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import catalog as cat
from ..session import drop_path, path_exists, settle
from .sinks import bucketed, fresh_schema, publish, read_published, replace_rows

TICKET, OBJECT = ["repo", "ticket"], ["repo", "object_key"]
PLACE = "struct<num:struct<size:int,digits:string>,ticket:string,dir:string,pos:int>"
TOTALS = f"repo string, object_key string, object string, first {PLACE}, n_jobs bigint, n_tickets bigint"


@dataclass(frozen=True)
class Published:
    """A published estate at ``path``; ``schema`` is that of its catalog rows."""

    spark: SparkSession
    path: str
    schema: str

    @classmethod
    def first(cls, rows: DataFrame, path: str) -> Published:
        """Publish a first snapshot."""
        own = cls(rows.sparkSession, path, fresh_schema(rows))
        publish(rows, f"{path}/catalog", "ticket")
        publish(cat.object_totals(own.catalog()), f"{path}/totals", "object_key")
        return own

    def catalog(self) -> DataFrame:
        return read_published(self.spark, f"{self.path}/catalog", self.schema).drop("bucket")

    def totals(self) -> DataFrame:
        return read_published(self.spark, f"{self.path}/totals", TOTALS).drop("bucket")

    # Refresh -------------------------------------------------------------------------------------
    def refresh(self, jobs: DataFrame, build: Callable[[DataFrame], DataFrame], batch: str) -> None:
        """Bring the rows of some jobs (repo, job_dir, ticket) up to date, and the totals of their objects.

        ``build`` gets the jobs and returns their fresh catalog rows; a job without one has vanished. What the batch changes is
        written to a folder of its own before anything published is touched, and holds final values only: a batch that was broken
        off and comes again finds it, or starts anew, and either way the result is the same.
        """
        staged = f"{self.path}/staged/{batch}"
        if not path_exists(self.spark, f"{staged}/totals/_SUCCESS"):
            drop_path(self.spark, staged)
            if not self._stage(jobs, build, staged):
                return
        self._apply(staged)
        drop_path(self.spark, staged)

    def _stage(self, jobs: DataFrame, build: Callable[[DataFrame], DataFrame], staged: str) -> bool:
        jobs = settle(jobs.select("repo", "job_dir", "ticket").distinct(), "touched-jobs")
        if jobs.isEmpty():
            return False
        fresh = build(jobs).join(jobs.select("repo", F.col("job_dir").alias("dir")), ["repo", "dir"], "left_semi").select(*StructType.fromDDL(self.schema).names)
        tickets = jobs.select(*TICKET).distinct()
        before = settle(self._rows_of(tickets), "rows-before").drop("bucket")
        others = before.join(jobs.select("repo", F.col("job_dir").alias("dir")), ["repo", "dir"], "left_anti")
        bucketed(tickets, "ticket").write.parquet(f"{staged}/tickets")
        bucketed(fresh.unionByName(others), "ticket").write.parquet(f"{staged}/catalog")
        after = self._staged(staged, "catalog", self.schema).drop("bucket")
        bucketed(self._new_totals(before, after, tickets), "object_key").write.parquet(f"{staged}/totals")
        return True

    def _staged(self, staged: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema + ", bucket int").parquet(f"{staged}/{name}")

    def _rows_of(self, tickets: DataFrame) -> DataFrame:
        placed = bucketed(tickets, "ticket")
        return read_published(self.spark, f"{self.path}/catalog", self.schema, placed).join(tickets, TICKET, "left_semi")

    def _new_totals(self, before: DataFrame, after: DataFrame, tickets: DataFrame) -> DataFrame:
        """Totals of every object that the tickets have or had: published numbers plus what is added, less what is retracted. Only
        where the first entry of an object is retracted is the next one looked for among all jobs of the repository."""
        was = cat.object_totals(before).select(*OBJECT, F.lit(-1).alias("sign"), "n_jobs", "n_tickets", F.lit(None).cast(f"struct<place:{PLACE},object:string>").alias("own"))
        now = cat.object_totals(after).select(*OBJECT, F.lit(1).alias("sign"), "n_jobs", "n_tickets", F.struct(F.col("first").cast(PLACE).alias("place"), "object").alias("own"))
        delta = was.unionByName(now).groupBy(*OBJECT).agg(
            F.sum(F.col("sign") * F.col("n_jobs")).alias("more_jobs"), F.sum(F.col("sign") * F.col("n_tickets")).alias("more_tickets"),
            F.min("own").alias("own"), F.sum(F.when(F.col("sign") == 1, F.col("n_jobs")).otherwise(0)).alias("own_jobs"),
        )
        delta = settle(delta, "object-deltas")
        held = read_published(self.spark, f"{self.path}/totals", TOTALS, bucketed(delta, "object_key")).drop("bucket")
        ours = tickets.select("repo", F.col("ticket").alias("holder"), F.lit(True).alias("ours"))
        joined = (
            delta.join(held, OBJECT, "left").withColumn("holder", F.col("first.ticket")).join(ours, ["repo", "holder"], "left")
            .select(
                *OBJECT, "own",
                F.when(F.col("ours").isNull() & F.col("first").isNotNull(), F.struct(F.col("first").alias("place"), "object")).alias("other"),
                (F.coalesce("n_jobs", F.lit(0)) + F.col("more_jobs")).alias("n_jobs"),
                (F.coalesce("n_tickets", F.lit(0)) + F.col("more_tickets")).alias("n_tickets"), "own_jobs",
            )
        )
        joined = settle(joined, "object-changes")
        lost = joined.where("other is null and n_jobs > own_jobs").select(*OBJECT)
        if not lost.isEmpty():
            joined = joined.join(self._first_of_others(lost, tickets), OBJECT, "left").withColumn("other", F.coalesce("other", "next"))
        first = F.least("own", "other")  # a null is no value
        return joined.select(*OBJECT, first["object"].alias("object"), first["place"].alias("first"), "n_jobs", "n_tickets")

    def _first_of_others(self, lost: DataFrame, tickets: DataFrame) -> DataFrame:
        """The first entry of some objects among the jobs of other tickets."""
        rest = read_published(self.spark, f"{self.path}/catalog", self.schema).join(lost.select("repo").distinct(), "repo", "left_semi")
        entries = cat.object_entries(rest.join(tickets, TICKET, "left_anti")).join(lost, OBJECT, "left_semi")
        return entries.groupBy(*OBJECT).agg(F.min(F.struct(F.col("place").cast(PLACE).alias("place"), "object")).alias("next"))

    def _apply(self, staged: str) -> None:
        """Replace the rows of the staged keys in the folders where they lie. Doing so twice changes nothing."""
        tickets = self._staged(staged, "tickets", "repo string, ticket string")
        replace_rows(f"{self.path}/catalog", self.schema, self._staged(staged, "catalog", self.schema), tickets, TICKET)
        totals = self._staged(staged, "totals", TOTALS)
        replace_rows(f"{self.path}/totals", TOTALS, totals.where("n_jobs > 0"), totals, OBJECT)
