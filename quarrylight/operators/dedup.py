"""Duplicates of report texts: exact ones by a normalised key, near ones by shared word shingles, canonical rows by priority."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import dedup_key, hashed_shingles


#: Shingles that a task sorts.
SHARE = 2_000_000


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, so that loops start from data and not from lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def text_key(text: str, normalised: bool) -> Column:
    """The deduplication key of a text column, or the column itself if it holds keys already."""
    return F.col(text) if normalised else dedup_key(F.coalesce(F.col(text), F.lit("")))


def exact_duplicates(df: DataFrame, key: str, text: str, rank: Column, normalised: bool = False) -> DataFrame:
    """(key, canonical): the best of the rows whose normalised text is equal, by rank and then key.

    A text whose key is empty is never a duplicate. Texts meet as 128-bit digests of their keys, never whole; the best
    row is an aggregate, so copies are summed before the shuffle.
    """
    keyed = df.select(key, text_key(text, normalised).alias("__text"), rank.alias("__rank"))
    keyed = keyed.select(key, "__rank", F.when(F.col("__text") != "", F.unhex(F.md5("__text"))).alias("__key"))
    # Digests are asked for twice; texts are normalised once.
    keyed = keyed if normalised else _written(keyed)
    best = keyed.where("__key is not null").groupBy("__key").agg(F.min(F.struct(-F.col("__rank"), F.col(key).alias("canonical")))["canonical"].alias("canonical"))
    return keyed.join(best, "__key", "left").select(key, F.coalesce("canonical", F.col(key)).alias("canonical"))


def shingle_sets(df: DataFrame, key: str, text: str, n: int, normalised: bool = False) -> DataFrame:
    """(id, own): each row's distinct word shingles as 64-bit hashes; rows without words are left out.

    A row is judged by its text: asked for the size of its set, Spark would make the set twice.
    """
    worded = F.col(text) != "" if normalised else F.col(text).rlike(r"[\p{L}\p{N}\p{M}]")
    return df.where(worded).select(F.col(key).alias("id"), hashed_shingles(text_key(text, normalised), n).alias("own"))


def parts(sets: DataFrame) -> int:
    """Partitions over which written sets are dealt, so that a task sorts SHARE shingles or so in memory, however many there are."""
    total = sets.agg(F.sum(F.size("own"))).first()[0] or 0
    return max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARE))


def prefix_posts(sets: DataFrame, percent: int) -> DataFrame:
    """(id, size, s, left): the rarest shingles of each set, of which two similar sets share one at least.

    ``left`` counts the shared-with-anyone shingles from this one on, in the order from rare to frequent.
    """
    # One shuffle: shingles are counted where they meet, and those of no one else go no further.
    each = sets.select("id", F.size("own").alias("size"), F.explode("own").alias("s")).repartition(parts(sets), "s")
    shared = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("n > 1")
    known = shared.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("ordered"))
    # Shingles of no one else come first in the order and take up their part of the prefix.
    longest = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("ordered"))
    posts = known.where(longest > 0).select("id", "size", F.posexplode(F.slice("ordered", F.lit(1), longest.cast("int"))).alias("at", "post"), F.size("ordered").alias("known"))
    return _written(posts.select("id", "size", F.col("post.s").alias("s"), (F.col("known") - F.col("at")).alias("left")))


def _possible(left: Column, left_b: Column, size: Column, size_b: Column, percent: int) -> Column:
    return (F.least(left, left_b) * (100 + percent) >= (size + size_b) * percent) & (100 * F.least(size, size_b) >= percent * F.greatest(size, size_b))


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, total) of the pairs whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
    common = F.size(F.array_intersect("own_a", "own_b"))
    sized = both.select("a", "b", common.alias("shared"), (F.size("own_a") + F.size("own_b") - common).alias("total"))
    return sized.where(100 * F.col("shared") >= percent * F.col("total"))


def _met(posts: DataFrame, others: DataFrame, percent: int, condition: str) -> DataFrame:
    """Distinct pairs (a, b) of posts that meet at a shingle and may be similar enough."""
    right = others.select("s", *(F.col(c).alias(f"{c}_b") for c in others.columns if c != "s"))
    enough = _possible(F.col("left"), F.col("left_b"), F.col("size"), F.col("size_b"), percent)
    return posts.join(right, "s").where(enough & F.expr(condition)).select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def near_pairs(df: DataFrame, key: str, text: str, percent: int, n: int = 3) -> DataFrame:
    """(a, b, shared, total): all pairs of rows whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

    Prefix join: with shingles ordered from rare to frequent, similar sets share one of the first few of each. Callers
    collapse equal texts first; those that need groups and not pairs call ``near_groups``.
    """
    sets = _written(shingle_sets(df, key, text, n))
    posts = prefix_posts(sets, percent)
    return similar(_met(posts, posts, percent, "id < id_b"), sets, percent)


def near_groups(df: DataFrame, key: str, text: str, percent: int, n: int = 3, normalised: bool = False) -> DataFrame:
    """(id, root) of the rows that such pairs link to another one; root is the smallest id that links reach.

    Rows that meet at a shingle are held against one row of its list first, so a cluster of m copies makes m pairs; what
    is left in other components of a list is paired with those alone, until no new link is found.
    """
    sets = _written(shingle_sets(df, key, text, n, normalised))
    posts = prefix_posts(sets, percent)
    pivots = posts.groupBy("s").agg(F.max(F.struct("left", F.col("id").alias("pivot")))["pivot"].alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = posts.join(pivots, "s").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = _written(similar(stars, sets, percent).select("a", "b"))
    roots = groups(links)
    placed = _written(posts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    sizes = placed.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("s", "major")
    members = _written(placed.join(sizes, "s"))
    more = _written(similar(_met(members.where("root <> major"), members, percent, "root <> root_b and (root_b = major_b or id < id_b)"), sets, percent).select("a", "b"))
    return roots if more.isEmpty() else groups(links.unionByName(more))


def groups(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id that links reach.

    Each round every row takes the smallest label around it and then that label's own label, so the rounds number about
    the logarithm of the longest path.
    """
    both = _written(pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"))))
    labels = _written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("root").alias("r")), "other").groupBy("id").agg(F.min("r").alias("r"))
        taken = labels.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = _written(taken.join(jump, "root", "left").select("id", "was", F.least("root", F.coalesce("further", "root")).alias("root")))
        labels = new.select("id", "root")
        if new.where("root <> was").isEmpty():
            return labels


def mark_duplicates(df: DataFrame, key: str, text: str, percent: int = 85, rank: Column | None = None) -> DataFrame:
    """``df`` with is_duplicate, duplicate_of and dup_kind; no row is deleted.

    Near duplicates are sought among exact survivors only. The canonical row of a group is the one of the highest rank,
    then the smallest key. An exact duplicate points at its own canonical even where that is a near duplicate itself.
    """
    rank = F.lit(0) if rank is None else rank
    # Texts are normalised once; both steps start from the written keys.
    keyed = _written(df.select(key, rank.alias("__rank"), text_key(text, False).alias("__text")))
    exact = _written(exact_duplicates(keyed, key, "__text", F.col("__rank"), normalised=True))
    survivors = keyed.join(exact.where(F.col(key) == F.col("canonical")).select(key), key, "left_semi")
    roots = near_groups(survivors, key, "__text", percent, normalised=True)
    ranked = roots.join(survivors.select(F.col(key).alias("id"), "__rank"), "id")
    best = ranked.groupBy("root").agg(F.min(F.struct(-F.col("__rank"), F.col("id").alias("best")))["best"].alias("best"))
    near = roots.join(best, "root").select(F.col("id").alias(key), "best")
    joined = df.join(exact, key, "left").join(near, key, "left")
    is_exact, is_near = F.col("canonical") != F.col(key), F.col("best") != F.col(key)
    kind = F.when(is_exact, "exact").when(is_near, "near")
    return joined.select(*df.columns, F.coalesce(is_exact | is_near, F.lit(False)).alias("is_duplicate"), F.when(is_exact, F.col("canonical")).when(is_near, F.col("best")).alias("duplicate_of"), kind.alias("dup_kind"))


def merge_entries(df: DataFrame, term: str, variants: str, first_of: list[str], order: str) -> DataFrame:
    """Glossary entries of one lower-case term as one: variants united without regard to case, first non-null values."""
    rows = df.withColumn("__key", F.lower(term))
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first_of]
    conflicts = [(F.countDistinct(c) > 1).alias(f"{c}_conflict") for c in first_of]
    merged = rows.groupBy("__key").agg(F.min_by(term, order).alias(term), F.flatten(F.collect_list(variants)).alias("__all"), *firsts, *conflicts)
    united = F.array_sort(F.array_distinct(F.transform("__all", F.lower)))
    return merged.withColumn(variants, united).drop("__all", "__key")


def variant_lookup(entries: DataFrame, term: str, variants: str) -> DataFrame:
    """(variant, term, collides): each variant's first term, and whether others claim it."""
    own = entries.select(F.col(term).alias("term"), F.explode(variants).alias("variant"))
    return own.groupBy("variant").agg(F.min("term").alias("term"), (F.countDistinct("term") > 1).alias("collides"))


def best_by_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
