"""Stages over files that run again only for what has changed: a manifest of contents decides which files are parsed.

A stage keeps its rows in ``rows/sha=<hash>``, a folder for each content, and a manifest (hash, path, n_rows) of what is
complete. A file is known by the SHA-256 of its bytes: a renamed or touched file is not parsed again, a changed one alone
is, and byte-identical copies count once, under the best name. A run that was broken off leaves no manifest row for what
it had begun, and the next run does that again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "sha string, path string, n_rows long, run string"
#: Path, length and time of a file; the hash of one whose three are unchanged is taken from the last listing.
LISTING = "path string, length long, modificationTime timestamp, sha string, run string"


class FileStage:
    """One stage: ``parse`` turns (path, content) rows into rows of ``schema``, one file at a time or all at once."""

    def __init__(self, spark: SparkSession, root: str, schema: str, parse: Callable[[DataFrame], DataFrame], version: str = "1") -> None:
        self.spark, self.root, self.schema, self.parse, self.version = spark, f"{root.rstrip('/')}/v{version}", schema, parse, version

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self._table("manifest", MANIFEST)

    def listed(self, path: str, glob: str = "*") -> DataFrame:
        """The files there are, each with its content's hash; only files that are new or touched since are read for it."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
        known = self._table("listing", LISTING).groupBy("path", "length", "modificationTime").agg(F.max("sha").alias("sha"))
        there = files.select("path", "length", "modificationTime").join(known, ["path", "length", "modificationTime"], "left")
        unread = there.where("sha is null").select("path")
        # Reading content by a join on path opens every file; the paths are few after the first run, so they are read by name.
        names = [r.path for r in unread.toLocalIterator()]
        read = there.where("sha is not null")
        for first in range(0, len(names), 1_000):
            part = self.spark.read.format("binaryFile").load(names[first : first + 1_000]).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha"))
            read = read.unionByName(part)
        return read

    def run(self, path: str, rank: Column | None = None, glob: str = "*") -> dict[str, int | str]:
        """Parse what has no rows yet; returns how many files there are, distinct ones, those parsed now, and the run's name.

        ``parse`` gets rows (path, content, sha) and keeps sha in what it returns.
        ``rank`` orders the names of identical files, the path decides among equals.
        """
        run = uuid.uuid4().hex
        order = F.struct((F.lit(0) if rank is None else rank).alias("rank"), "path")
        self.listed(path, glob).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.root}/listing")
        files = self._table("listing", LISTING).where(F.col("run") == run)
        best = files.groupBy("sha").agg(F.min(order)["path"].alias("path"))
        todo = best.join(self.manifest().select("sha"), "sha", "left_anti")
        paths = sorted(r.path for r in todo.toLocalIterator())
        for first in range(0, len(paths), 1_000):
            part = paths[first : first + 1_000]
            files_now = self.spark.read.format("binaryFile").load(part).select("path", "content", F.sha2("content", 256).alias("sha"))
            rows = self.parse(files_now)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha").parquet(f"{self.root}/rows")
            done = files_now.select("sha", "path").join(self._rows().groupBy("sha").agg(F.count(F.lit(1)).alias("n_rows")), "sha", "left")
            done.select("sha", "path", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.lit(run).alias("run")).write.mode("append").parquet(f"{self.root}/manifest")
        return {"files": files.count(), "distinct": best.count(), "parsed": len(paths), "run": run}

    def _rows(self) -> DataFrame:
        return self._table("rows", f"{self.schema}, sha string")

    def rows(self, run: str | None = None) -> DataFrame:
        """The rows of all complete contents, or of those that a run has found; each content once."""
        complete = self._rows().join(self.manifest().select("sha").distinct(), "sha", "left_semi")
        if run is None:
            return complete
        return complete.join(self._table("listing", LISTING).where(F.col("run") == run).select("sha").distinct(), "sha", "left_semi")


def stages_to_run(spark: SparkSession, stages: dict[str, str], only: set[str] | None = None, skip: set[str] = frozenset(), force: bool = False) -> dict[str, bool]:
    """Which stages to run: those asked for, less those skipped and those whose output is complete already.

    ``stages`` maps a stage to the folder of its output; an output counts if its write was finished (``_SUCCESS``).
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    done = {name: (p := hadoop(f"{folder}/_SUCCESS")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for name, folder in stages.items()}
    return {name: (only is None or name in only) and name not in skip and (force or not done[name]) for name in stages}


def stage_rows(spark: SparkSession, stages: dict[str, str], ran: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of every stage: those that have just run, and for the others what an earlier run has left, if anything."""
    found = dict(ran)
    for name, folder in stages.items():
        if name not in found:
            try:
                found[name] = spark.read.parquet(folder)
            except AnalysisException as missing:
                if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                    raise
    return found
