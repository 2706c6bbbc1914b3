"""Benchmark decontamination: MinHash containment search, confirmed by exact shingle containment.

DataFrame functions only. Items are partitioned by the size of their shingle sets, and a partition's parameters follow
from its bounds: its upper size u sets the length of its bottom-k MinHash sketches, ``k = u - ceil(0.8 u) + 1``, and its
lower size the least shingles that a document must have. A document that holds 80 % of an item's n shingles misses at
most ``n - ceil(0.8 n)`` of them, fewer than k, so it holds one of the sketch at least: the search loses nothing. A
document's shingle hashes stream past the partitions where it is read; a partition is probed with a hash only if the
document is large enough for it and the hash is within its sketches' range. Only documents that hit a sketch are read
again and held against the items on the shingles' own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import materialise

WORDS, PERCENT = 5, 80
#: Rows of sketches and of items, and ids of candidate documents, that may be broadcast; more are joined by a shuffle.
BROADCAST_SKETCHES, BROADCAST_ITEMS, BROADCAST_IDS = 500_000, 20_000, 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows(words: Column, make) -> Column:
    """``make`` of each WORDS words in a row; with fewer words, of all of them; nothing without words.

    The words are bound to a lambda's variable: an expression in a lambda is worked out anew for every element.
    """
    kind = "bigint" if make is hash_of else "string"

    def of(own: Column) -> Column:
        size = F.size(own)
        rows = F.transform(F.sequence(F.lit(1), F.greatest(size - WORDS + 1, F.lit(1))), lambda i: make(F.slice(own, i, WORDS)))
        return F.when(size == 0, F.array().cast(f"array<{kind}>")).when(size < WORDS, F.array(make(own))).otherwise(rows)

    return F.flatten(F.transform(F.array(words), of))


def hash_of(words: Column) -> Column:
    return F.xxhash64(words)


def text_of(words: Column) -> Column:
    return F.array_join(words, " ")


def item_sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, size_class, n, sketch): one row a sketched hash.

    The size class is the bit length of the set's size; the largest set of a class sets the length of all its sketches.
    """
    hashes = F.array_sort(F.array_distinct(windows(words_of(F.col("text")), hash_of)))
    sized = items.select("item_id", hashes.alias("hashes")).withColumn("n", F.size("hashes")).where("n > 0")
    sized = sized.withColumn("size_class", F.length(F.bin(F.col("n").cast("long"))))
    upper = sized.groupBy("size_class").agg(F.max("n").alias("upper"))
    length = F.col("upper") - F.ceil(F.col("upper") * percent / 100).cast("int") + 1
    # A size has 32 bits at most, so there are 32 classes at most.
    return sized.join(F.broadcast(upper), "size_class").select("item_id", "size_class", "n", F.explode(F.slice("hashes", F.lit(1), length)).alias("sketch"))


def size_partitions(sketches: DataFrame, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(size class, least shingles of a document, greatest sketched hash) of each partition; 32 rows at most."""
    bounds = sketches.groupBy("size_class").agg(F.min("n").alias("least"), F.max("sketch").alias("greatest")).orderBy("size_class")
    return [(r["size_class"], -(-r["least"] * percent // 100), r["greatest"]) for r in bounds.collect()]


def probes(docs: DataFrame, partitions: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, size_class, sketch): the hashes of each document (doc_id, words) and the partitions it probes with them."""
    hashes = docs.select("doc_id", windows(F.col("words"), hash_of).alias("hashes")).withColumn("m", F.size("hashes"))
    each = hashes.select("doc_id", "m", F.explode("hashes").alias("sketch"))
    fits = [F.when((F.col("m") >= least) & (F.col("sketch") <= greatest), F.lit(size_class)) for size_class, least, greatest in partitions]
    return each.select("doc_id", "sketch", F.explode(F.array_compact(F.array(*fits, F.lit(None).cast("int")))).alias("size_class"))


def hit_documents(docs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id) pairs where the document holds a sketched hash of the item, found partition by partition."""
    few = sketches.count() <= BROADCAST_SKETCHES
    asked = probes(docs, size_partitions(sketches, percent))
    own = sketches.select("size_class", "sketch", "item_id")
    return asked.join(F.broadcast(own) if few else own, ["size_class", "sketch"]).select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each document and item of which it holds ``percent`` of the distinct five-word shingles or more.

    Returns doc_id, item_id, n_item (the item's shingles), n_shared, containment. Words are lower-case runs of letters
    and digits; a text of fewer than five words is one shingle of all its words, one without words has none and matches
    nothing. Rows that repeat a doc_id are held against an item each, the best counts; so do items that repeat an
    item_id, whose shingles are taken one text at a time. Rows without doc_id or item_id take no part. Empty tables
    give an empty result; other columns are ignored. Ties cannot arise: every pair over the share is returned.
    """
    items = items.select("item_id", "text").where("item_id is not null")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    sketches = materialise(item_sketches(items, percent).distinct(), "sketches")
    hits = materialise(hit_documents(docs.select("doc_id", words_of(F.col("text")).alias("words")), sketches, percent), "hits")
    ids = hits.select("doc_id").distinct()
    again = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    own = again.select("doc_id", F.array_distinct(windows(words_of(F.col("text")), text_of)).alias("doc_shingles"))
    wanted = materialise(items.select("item_id", F.array_distinct(windows(words_of(F.col("text")), text_of)).alias("item_shingles")).where(F.size("item_shingles") > 0).distinct(), "items")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ITEMS else wanted
    both = own.join(hits, "doc_id").join(wanted, "item_id")
    both = both.withColumn("n_item", F.size("item_shingles").cast("long")).withColumn("n_shared", F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("long"))
    found = both.where(100 * F.col("n_shared") >= percent * F.col("n_item")).groupBy("doc_id", "item_id")
    best = found.agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_item").alias("n_item"), F.col("best.n_shared").alias("n_shared"), F.col("best.col1").alias("containment"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without doc_id stay, all columns stay."""
    return docs.join(contaminated(docs, items, percent).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
