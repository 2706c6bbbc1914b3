"""Idempotent ingest of versioned rows: batches append versions, say what they supersede, and may be replayed at any point.

A store is a folder with ``rows/batch=N`` (the versions that batch N added) and ``commits/batch=N`` (written when they are
complete). Nothing is updated in place. A batch decides by the batches before it alone and writes to its own place, so a
replay, whole or after half of it, leaves the same rows; what was never committed isn't read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _versions_of(schema: str) -> str:
    return f"{schema}, content_hash string, version_id string, supersedes string, version long, batch long"


class VersionStore:
    """Versions of rows that ``key`` tells apart; ``content`` are the columns in which versions differ, ``order`` puts them in order."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], content: list[str], order: list[str]) -> None:
        self.spark, self.root, self.schema, self.key, self.content, self.order = spark, root.rstrip("/"), schema, key, content, order

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{what}").parquet(f"{self.root}/{what}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """A row for each batch whose rows are complete: batch, n_rows."""
        return self._read("commits", "n_rows long, batch long")

    def versions(self, before: int | None = None) -> DataFrame:
        """All committed versions, or those of the batches before one; batches are folders, so others aren't even listed in the scan."""
        done = self.commits()
        done = done if before is None else done.where(F.col("batch") < before)
        rows = self._read("rows", _versions_of(self.schema))
        rows = rows if before is None else rows.where(F.col("batch") < before)
        # One row of 16 bytes for each batch there ever was.
        return rows.join(F.broadcast(done.select("batch")), "batch", "left_semi")

    def current(self) -> DataFrame:
        """The versions that none supersedes: one for each key."""
        own = self.versions()
        return own.join(own.where("supersedes is not null").select(F.col("supersedes").alias("version_id")), "version_id", "left_anti")

    def history(self) -> DataFrame:
        """All versions with is_current and superseded_by."""
        own = self.versions()
        later = own.where("supersedes is not null").select(F.col("supersedes").alias("version_id"), F.col("version_id").alias("superseded_by"))
        return own.join(later, "version_id", "left").withColumn("is_current", F.col("superseded_by").isNull())

    def content_hash(self) -> Column:
        return F.sha2(F.to_json(F.struct(*self.content), {"ignoreNullFields": "false"}), 256)

    def new_versions(self, rows: DataFrame, batch: int) -> DataFrame:
        """The versions that a batch adds: contents that their key has never had, each after the one it supersedes.

        Rows with a null key are no reports and are left out. Of rows of one key and content the first by ``order`` counts.
        """
        old = self.versions(before=batch)
        keyed = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.key)).withColumn("content_hash", self.content_hash())
        once = Window.partitionBy(*self.key, "content_hash").orderBy(*self.order, *self.content)
        fresh = keyed.withColumn("__nth", F.row_number().over(once)).where("__nth = 1").drop("__nth").join(old.select(*self.key, "content_hash"), [*self.key, "content_hash"], "left_anti")
        last = old.groupBy(*self.key).agg(F.max(F.struct("version", "version_id")).alias("__last"))
        along = Window.partitionBy(*self.key).orderBy(*self.order, "content_hash")
        named = fresh.join(last, self.key, "left").withColumn("version_id", F.sha2(F.concat_ws("\x1f", *self.key, "content_hash"), 256))
        return named.select(
            *rows.columns, "content_hash", "version_id", F.coalesce(F.lag("version_id").over(along), F.col("__last.version_id")).alias("supersedes"), (F.coalesce(F.col("__last.version"), F.lit(0)) + F.row_number().over(along)).cast("long").alias("version"),
        )

    def write_batch(self, rows: DataFrame, batch: int) -> None:
        """What ``foreachBatch`` calls: rows, then the commit. Each write replaces what an earlier try has left."""
        self.new_versions(rows, batch).write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch}")
        self.commit(batch)

    def commit(self, batch: int) -> None:
        written = self.spark.read.schema(_versions_of(self.schema)).parquet(f"{self.root}/rows/batch={batch}").agg(F.count(F.lit(1)).alias("n_rows"))
        written.write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch}")

    def ingest(self, stream: DataFrame) -> None:
        """Take in what a stream has now and stop; the stream's checkpoint lies in the store."""
        stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
