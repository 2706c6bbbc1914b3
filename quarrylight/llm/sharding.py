"""Sharding by longest processing time: groups that must stay together, largest first, go to the least-loaded shard.

A heap over every group would be one task over the whole corpus, so the heap runs over size classes. Groups of one
class weigh the same, hence the heap's choice for ``c`` of them in a row depends on the loads alone: it takes the ``c``
smallest of ``load + i * weight``. The classes number at most ``CLASS_BOUND`` whatever the corpus is (sizes below
``EXACT`` each have their own class, larger ones share one with sizes within 1/512), and the driver sees one row a class.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import materialise, number_within

#: Sizes below this have a class of their own; above, a class spans one 1/512 of its power of two.
EXACT = 1024
#: 1023 exact sizes and 512 classes for each of the 53 powers of two above.
CLASS_BOUND = EXACT + 512 * 54


def size_class(size: Column) -> Column:
    """The lower end of the size's class: ``size`` with all but its ten leading binary digits cleared."""
    shift = F.greatest(F.length(F.bin(size)) - 10, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return (size - size % step).cast("long")


def heap_plan(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """For each (class, groups, bytes), taken in descending order: how many of its groups each shard gets.

    Runs the heap for classes of few groups; for many equal weights it first deals out in bulk what the heap would
    surely give, then lets the heap place the rest.
    """
    loads = [0.0] * shards
    plan = {}
    for cls, count, total in sorted(classes, reverse=True):
        weight = total / count
        given = [0] * shards
        left = count
        if count > 4 * shards:
            # The level that all loads would share after the bulk; whole weights under it are certain.
            level = _level(loads, (count - 2 * shards) * weight)
            for s in range(shards):
                given[s] = max(0, int((level - loads[s]) // weight))
            left = count - sum(given)
        heap = [(loads[s] + given[s] * weight, s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (load + weight, s))
        loads = [loads[s] + given[s] * weight for s in range(shards)]
        plan[cls] = given
    return plan


def _level(loads: list[float], amount: float) -> float:
    """How high ``amount`` fills the loads when it is poured over the lowest ones."""
    ordered = sorted(loads)
    for i in range(1, len(ordered) + 1):
        level = (sum(ordered[:i]) + amount) / i
        if i == len(ordered) or level <= ordered[i]:
            return level
    return ordered[0]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deal documents into ``shards`` shards of nearly equal bytes; equal texts stay together.

    Size is the UTF-8 bytes of the text plus 1; a null text counts as empty, so nulls and empty texts form one group.
    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null:
    this law has no stable growth). Repeated rows are rows of their own with slots of their own; an empty table gives
    an empty result; extra columns are ignored. Equal weights go to the lower shard.

    No text is shuffled, only (doc_id, size, crc32, md5). A text that many rows share is summed before the shuffle and
    its rows meet their shard in a join whose large partitions Spark splits; ranks and slots are numbered in blocks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialise(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group_key")),
        "shard-base",
    )
    groups = base.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    groups = materialise(groups.select("group_key", "group_size", size_class(F.col("group_size")).alias("class")), "shard-groups")
    classes = [(r["class"], r["n"], r["total"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("total")).collect()]
    plan = [(cls, [sum(given[: s + 1]) for s in range(shards)]) for cls, given in heap_plan(classes, shards).items()]
    ends = F.broadcast(spark.createDataFrame(plan, "class long, ends array<long>"))  # CLASS_BOUND rows at most
    n_groups, n_rows = sum(c[1] for c in classes), base.count()
    ranked = number_within(groups, ["class"], F.xxhash64("group_key"), [F.col("group_key")], n_groups, "rank")
    placed = ranked.join(ends, "class").select("group_key", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    rows = base.join(placed, "group_key").drop("group_key")
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    rows = number_within(rows, ["shard"], F.xxhash64("doc_id", "text_crc32"), order, n_rows // shards, "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
