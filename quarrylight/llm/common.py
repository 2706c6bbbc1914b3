"""What the operators share: table reading, tables in the shared folder, and gapless numbering without one large task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one numbering block holds on average; a block is one group of one sort.
ROWS_PER_BLOCK = 20_000
#: Texts that pass between Spark and a Python worker at a time.
TEXTS_PER_BATCH = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, a local master (tests) gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives the loss of an executor."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` over rows that hold texts, few at a time: a batch lives in the JVM, in Arrow and in Python at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))
    return df.mapInArrow(function, schema)


def blocks_for(rows: int) -> int:
    """How many numbering blocks ``rows`` rows need; grows with the input."""
    return max(8, -(-rows // ROWS_PER_BLOCK))


def number_within(df: DataFrame, groups: list[str], spread: Column, order: list[Column], rows: int, name: str) -> DataFrame:
    """Give the rows of each group gapless longs from 0 in column ``name``, however large one group is.

    ``spread`` is a hash of the row that deals a group over blocks; rows are numbered inside (group, block) and
    the sizes of the earlier blocks are added. Only the sizes, one row for each (group, block), meet by group.
    """
    n = blocks_for(rows)
    block, before, size = f"__{name}_block", f"__{name}_before", f"__{name}_size"
    dealt = df.withColumn(block, F.pmod(spread, F.lit(n)).cast("int"))
    sizes = dealt.groupBy(*groups, block).agg(F.count(F.lit(1)).alias(size))
    ahead = Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, block, F.coalesce(F.sum(size).over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(*groups, block).orderBy(*order)
    numbered = dealt.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    return numbered.join(offsets, [*groups, block]).withColumn(name, F.col(name) + F.col(before)).drop(block, before)
