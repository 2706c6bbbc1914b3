"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's signature is a set of ``coordinates`` pairs (coordinate, value), and each pair is a posting list. Two
documents over the similarity collide on at least ``match_threshold`` pairs but for a chance of ``MISS``. With pairs
ordered from rare to frequent over the whole corpus, two such documents share a pair among their first
``coordinates - match_threshold + 1``: only this prefix is posted, and of it only what occurs twice. What a passage
makes common stands at the end of the order and is not posted.

Lists are merged by skipping. Each member is held against its list's pivot first; members that a component joins by
then need no further comparison among themselves. What is left across components is paired within small lists; members
of large ones meet again on the rarest shingles of their full sets, by size, where a heavily edited copy of a text that
thousands share shows itself by what it shares with few. The largest component of a list is never paired with itself.
Pairs above the match threshold are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import map_texts, materialise
from quarrylight.llm.components import components
from quarrylight.llm.shingles import mix, shingle_sets

COORDINATES = 64
MISS = 1e-6
#: Lists of at most so many members are paired across components as they are.
SMALL_LIST = 16
#: Ids that may be broadcast to fetch documents (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Column that tells rows apart, whatever their doc_id.
ROW = "__row"
#: Ratio between neighbouring size classes.
SIZE_STEP = 1.04


@cache
def match_threshold(percent: int, coordinates: int = COORDINATES) -> int:
    """The most collisions to ask for such that a pair of ``percent`` similarity falls short with a chance of MISS at most."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > MISS:
            return t
    return coordinates


def multipliers(coordinates: int) -> np.ndarray:
    own = np.random.default_rng(7).integers(0, 1 << 62, coordinates, np.int64).astype(np.uint64)
    return own * np.uint64(2) + np.uint64(1)


def _signer(words: int, coordinates: int, with_sets: bool):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(coordinates)
        for batch in batches:
            sizes, prints, signatures, sets = [], [], [], []
            for own in shingle_sets(batch.column("text"), words):
                sizes.append(len(own))
                prints.append(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes() + mix(own ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).tobytes())
                # Long texts are signed in slices, so that the table of products stays small.
                least = np.full(coordinates, np.uint64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(own), 4096):
                    np.minimum(least, (own[at : at + 4096, None] * factors).min(0), out=least)
                signatures.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
                if with_sets:
                    sets.append(own.view(np.int64))
            flat = np.concatenate(signatures) if signatures else np.zeros(0, np.int32)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, coordinates), pa.int32()), pa.array(flat))]
            names = ["doc_id", "n_shingles", "print", "signature"]
            if with_sets:
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))))
                names.append("shingles")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return sign


def signatures(docs: DataFrame, words: int, coordinates: int = COORDINATES, with_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, print (of the set), signature and, if asked for, the shingle set of each document."""
    schema = "doc_id long, n_shingles long, print binary, signature array<int>" + ", shingles array<long>" * with_sets
    return map_texts(docs.select("doc_id", "text"), _signer(words, coordinates, with_sets), schema)


def posting_lists(nodes: DataFrame, threshold: int, coordinates: int = COORDINATES) -> DataFrame:
    """(token, node, n_shingles, weight): the prefix postings of (node, n_shingles, signature) that some other node shares a token with."""
    tokens = nodes.select("node", "n_shingles", F.posexplode("signature").alias("at", "value")).select(
        "node", "n_shingles", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("token")
    )
    shared = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    own = tokens.join(shared, "token").groupBy("node", "n_shingles").agg(F.collect_list(F.struct("n", "token")).alias("own"))
    # Tokens of no one else come first in the order and take up their part of the prefix.
    places = F.size("own") - F.lit(threshold) + 1
    prefix = own.where(places > 0).select("node", "n_shingles", F.aggregate("own", F.lit(0.0), lambda s, x: s + F.log1p(x["n"])).alias("weight"), F.explode(F.slice(F.array_sort("own"), F.lit(1), places)).alias("post"))
    return materialise(prefix.select(F.col("post.token").alias("token"), "node", "n_shingles", "weight"), "posts")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, threshold: int) -> DataFrame:
    """Of the pairs (a, b), those with enough collisions whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    hits = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    common = F.size(F.array_intersect("set_a", "set_b"))
    similar = 100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)
    return both.where((hits >= threshold) & similar).select("a", "b").distinct()


def size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")


def without_major(posts: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The posts outside the largest component of their list, and all posts, of lists that meet several components; column major."""
    by_comp = posts.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("n"))
    lists = by_comp.groupBy(*key).agg(F.max(F.struct("n", "comp"))["comp"].alias("major"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("members"))
    lists = materialise(lists.where("comps > 1").select(*key, "major", "members"), "lists")
    members = materialise(posts.join(lists, key), "members")
    return members.where("comp <> major"), members


def paired(left: DataFrame, right: DataFrame, key: list[str], extra: list[str], condition: str) -> DataFrame:
    """Distinct (a, b) of posts that meet under ``key`` in different components; the left ones' columns end in _1."""
    left = left.select(*key, *(F.col(c).alias(f"{c}_1") for c in ["node", "comp", *extra]))
    met = left.join(right, key).where(f"comp <> comp_1 and (comp = major or node_1 < node) and {condition}")
    return met.select(F.least("node", "node_1").alias("a"), F.greatest("node", "node_1").alias("b")).distinct()


def set_prefixes(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Posts of the listed documents' own sets: (shingle, low, high, class, node, comp, size, at).

    Shingles are ordered from rare to frequent among these documents. Against partners of one size class a document
    must share one of its first ``size - overlap + 1``, where overlap is what the similarity asks of the class's
    smallest partner; it posts them under the pair of classes.
    """
    chosen = sets.join(members, sets["doc_id"] == members["node"]).select("node", "comp", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    chosen = materialise(chosen.distinct(), "listed-shingles")
    counts = materialise(chosen.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "listed-counts")
    known = chosen.join(counts, "shingle")
    own = known.groupBy("node", "comp", "size").agg(F.collect_list(F.struct("n", "shingle")).alias("own"))
    # Shingles of no one else come first in the order and take up their part of the prefix.
    size, alone = F.col("size"), F.col("size") - F.size("own")
    longest = size - F.ceil(size * percent / 100) + 1 - alone
    posts = own.where(longest > 0).select("node", "comp", "size", alone.alias("alone"), F.posexplode(F.slice(F.array_sort("own"), F.lit(1), longest.cast("int"))).alias("at", "post"))
    least = F.ceil(size * percent / 100)
    classes = F.sequence(size_class(least), size_class(F.floor(size * 100 / percent)))
    posts = posts.select("node", "comp", "size", F.col("post.shingle").alias("shingle"), (F.col("at") + F.col("alone")).alias("at"), size_class(size).alias("class"), F.explode(classes).alias("other"))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), F.col("other"))))
    overlap = F.ceil((size + smallest) * percent / (100 + percent) - 1e-9)
    posts = posts.where(F.col("at") <= size - overlap)
    return posts.select("shingle", F.least("class", "other").alias("low"), F.greatest("class", "other").alias("high"), "class", "node", "comp", "size", "at")


def leftover_pairs(posts: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of listed nodes in different components that may still be similar enough."""
    placed = posts.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    minor, members = without_major(materialise(placed, "placed"), ["token"])
    small = paired(minor.where(F.col("members") <= SMALL_LIST), members.where(F.col("members") <= SMALL_LIST), ["token"], [], "true")
    large = materialise(members.where(F.col("members") > SMALL_LIST).select("node", "comp").distinct(), "large")
    if large.isEmpty():
        return small
    key = ["shingle", "low", "high"]
    minor, members = without_major(set_prefixes(sets, large, percent), key)
    # Both stand at the ends of the class pair, and what follows the meeting place suffices for the overlap.
    enough = f"least(size - at, size_1 - at_1) * {100 + percent} >= (size + size_1) * {percent}"
    return small.unionByName(paired(minor, members, key, ["class", "size", "at"], f"class + class_1 = low + high and {enough}")).distinct()


def fetch_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Signatures and sets of the documents in ``ids`` (node), written to the shared folder."""
    wanted = ids.select(F.col("node").alias("doc_id"))
    few = wanted.count() <= BROADCAST_IDS
    own = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return materialise(signatures(own, words, with_sets=True).where("n_shingles > 0").select("doc_id", "signature", "shingles"), "sets")


def one_document(found: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes (node) that rows of one doc_id have."""
    ends = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    several = ends.where("a < z").select("doc_id", "a")
    return found.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents link if their sets of distinct ``words``-word shingles have a Jaccard similarity of ``percent`` or more;
    a text of fewer words is one shingle, a null or empty one has none and links with nothing. component_id is the
    smallest doc_id that links reach, kept says whether it is the document's own. Rows that repeat a doc_id are one
    document, linked if any of its texts is. A row without doc_id links with nothing, has no component and is kept. An
    empty table gives an empty result; other columns are ignored.

    Documents of equal sets are one node from the start, so copies make no pairs however many they are.
    """
    threshold = match_threshold(percent)
    base = materialise(signatures(docs, words), "signatures")
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"))
    classes = materialise(classes, "classes")
    found = base.join(classes, "print", "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")))
    found = materialise(found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "placed-rows")
    first = base.where("n_shingles > 0 and doc_id is not null").join(classes.select("print", F.col("node").alias("doc_id")), ["print", "doc_id"], "left_semi")
    nodes = first.dropDuplicates(["doc_id", "print"]).select(F.col("doc_id").alias("node"), "n_shingles", "signature")
    posts = posting_lists(nodes, threshold)
    # The pivot of a list is the member with the most frequent tokens, which a text that was copied and edited is.
    pivots = posts.groupBy("token").agg(F.max(F.struct("weight", -F.col("node")))[F.lit("col2")].alias("pivot"), F.count(F.lit(1)).alias("n"))
    pivots = materialise(pivots.where("n > 1").select("token", (-F.col("pivot")).alias("pivot")), "pivots")
    posts = materialise(posts.join(pivots, "token"), "listed")
    sets = fetch_sets(docs, posts.select("node").distinct(), words)
    stars = posts.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = materialise(confirmed(stars, sets, percent, threshold).unionByName(one_document(found)).distinct(), "star-links")
    labels = components(links)
    more = materialise(confirmed(leftover_pairs(posts.drop("pivot", "weight"), labels, sets, percent), sets, percent, threshold), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    found = found.join(labels, "node", "left").withColumn("component_id", F.coalesce("comp", "node"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts, that of the smallest doc_id; all columns stay.

    Each row counts for itself here: rows that repeat a doc_id with the same text are cut to one, and of a doc_id with
    different texts only those are dropped that another row stands for. Rows without doc_id come last in their group, so
    that they stay only if no other row has their text. A text without words is in no group: one of each doc_id stays,
    and all without doc_id.
    """
    keyed = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text"), words, percent)
    found = found.select(F.col("doc_id").alias(ROW), "n_shingles", "component_id").join(keyed.select(ROW, "doc_id"), ROW)
    blank = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    rows = materialise(found.select(ROW, "doc_id", F.when(~blank, F.col("component_id")).alias("group"), F.when(blank, F.col("doc_id")).alias("blank")), "grouped")
    first = rows.groupBy("group", "blank").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW))[ROW].alias(ROW))
    dropped = materialise(rows.select(ROW).join(first.select(ROW), ROW, "left_anti"), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(dropped) if few else dropped, ROW, "left_anti").select(*docs.columns)
