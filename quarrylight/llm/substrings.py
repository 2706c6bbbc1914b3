"""Removal of byte strings that start earlier in the corpus, by suffix order of what they share.

A string of LENGTH bytes always holds an anchor: the ANCHOR bytes of the least hash in it. Equal strings hold the same
anchor at the same place, so only occurrences of one anchor have to meet, and of those only anchors that occur twice.
What surrounds an anchor (its context) holds every string that the anchor stands for. Equal contexts are one from the
start: all but the earliest occurrence are removed whole. The different contexts of an anchor are cut into blocks, each
named once; the contexts in corpus order are one integer string of names, and its suffix order (linear grouping, see
``suffixes``) gives the longest match that starts earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import map_texts, materialise
from quarrylight.llm.shingles import RAW_BYTE, mix, tables, text_slices
from quarrylight.llm.suffixes import longest_earlier

LENGTH, ANCHOR = 100, 32
#: How far a string can reach before its anchor.
SPAN = LENGTH - ANCHOR
#: Contexts of one anchor that one group may hold; larger groups are split by what they share.
GROUP_LIMIT = 4096
#: Anchor hashes, places and documents that may be broadcast; more are joined by a shuffle.
BROADCAST_HASHES, BROADCAST_PLACES, BROADCAST_DOCS = 4_000_000, 3_000_000, 1_000_000
PLACES = "doc long, key long, hash long, ctx long, pos int, l int, r int"
CONTEXTS = "grp long, doc long, key long, pos int, l int, bytes binary"


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, prefix sums) of the anchors of texts that lie end to end."""
    n = len(data)
    ahead, behind = tables(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(RAW_BYTE[data] * ahead[:n], dtype=np.uint64)])
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * behind[: n - ANCHOR + 1]) | np.uint64(1)
    least = slide(hashes, SPAN + 1, np.minimum)
    ends = np.repeat(starts[1:], np.diff(starts))[: len(least)]
    # Only strings inside one text choose an anchor; elsewhere 0 chooses none.
    least = np.where(np.arange(len(least)) + LENGTH <= ends, least, np.uint64(0))
    edge = np.zeros(SPAN, np.uint64)
    chosen = slide(np.concatenate([edge, least, edge]), SPAN + 1, np.maximum)
    places = np.flatnonzero((hashes == chosen[: len(hashes)]) & (chosen[: len(hashes)] > 0))
    return places, hashes[places], sums


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
        for first, data, starts in text_slices(batch.column("text")):
            places, hashes, sums = anchors(data, starts)
            if not len(places):
                continue
            text = np.searchsorted(starts, places, side="right") - 1
            left = np.minimum(places - starts[text], SPAN)
            right = np.minimum(starts[text + 1] - places, LENGTH)
            behind = tables(len(data) + 1)[1]
            context = mix((sums[places + right] - sums[places - left]) * behind[places - left])
            context = mix(context + (left * 256 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            columns = [docs[first + text], keys[first + text], hashes.view(np.int64), context.view(np.int64)]
            ints = [(places - starts[text]).astype(np.int32), left.astype(np.int32), right.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *ints)], names=["doc", "key", "hash", "ctx", "pos", "l", "r"])


def common_prefix(a: bytes, b: bytes) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    return n - (((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8)


def named_blocks(strings: list[bytes], name: int) -> tuple[list[tuple[list[int], list[int]]], int]:
    """For each string its (ends, names) of blocks from the first byte on, and the next free name.

    A string is cut where it parts from another one, and what follows the last such place is left out. Blocks have one
    name if they are the same bytes at the same place after equal blocks; every name is given once.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    paths: list[tuple[list[int], list[int]]] = [([], [])] * len(strings)
    # Neighbours' shared lengths open and close blocks as a stack does: those at or below the length to the next string
    # go on in it. What the string shares with a later one alone is added when that is met, so walk from both sides.
    shared = [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
    above: list[list[int]] = []
    stack: list[int] = []
    for length in [*shared[::-1], 0]:
        above.append(stack[:])
        while stack and stack[-1] > length:
            stack.pop()
        if length and (not stack or stack[-1] < length):
            stack.append(length)
    ends: list[int] = []
    names: list[int] = []
    for at, k in enumerate(order):
        length = shared[at - 1] if at else 0
        # Blocks up to the shared length are those of the string before; behind it new ones begin.
        while ends and ends[-1] > length:
            ends.pop()
            names.pop()
        for end in sorted({length, *above[len(order) - 1 - at]} - {0}):
            if not ends or end > ends[-1]:
                ends.append(end)
                names.append(name)
                name += 1
        paths[k] = (ends[:], names[:])
    return paths, name


def match_contexts(contexts: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(number, start, end) of the runs of a context that LENGTH bytes or more shared with an earlier one of the group cover.

    ``contexts`` are (position, bytes before the anchor, bytes) in corpus order; starts and ends count in the text. The
    named blocks of all contexts, parted by symbols that nothing equals, are one integer string; its suffix order finds
    the longest match that starts earlier.
    """
    left, name = named_blocks([c[2][: c[1]][::-1] for c in contexts], 0)
    right, name = named_blocks([c[2][c[1] :] for c in contexts], name)
    symbols: list[int] = []
    places: list[int] = []
    owners: list[tuple[int, int]] = []
    for k, ((left_ends, left_names), (right_ends, right_names)) in enumerate(zip(left, right, strict=True)):
        before, after = left_ends[-1] if left_ends else 0, right_ends[-1] if right_ends else 0
        if before + after < LENGTH:
            continue
        anchor = contexts[k][0]
        symbols += left_names[::-1]
        symbols += right_names
        symbols.append(name)
        name += 1
        places += [anchor - end for end in reversed(left_ends)]
        places.append(anchor)
        places += [anchor + end for end in right_ends]
        owners.append((k, len(symbols)))
    if len(owners) < 2:
        return []
    sizes = longest_earlier(symbols)
    found, at = [], 0
    for k, stop in owners:
        run = None
        for at in range(at, stop):
            start, end = places[at], places[at + sizes[at]]
            if end - start >= LENGTH:
                if run and start <= run[1]:
                    run = (run[0], max(run[1], end))
                else:
                    if run:
                        found.append((k, *run))
                    run = (start, end)
        if run:
            found.append((k, *run))
        at = stop
    return found


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive sorted by (grp, doc, key, pos); one may go on in the next batch."""
    held: list[tuple[int, int, int, int, bytes]] = []
    out: list[tuple[int, int, int, int]] = []

    def flush() -> None:
        if len(held) > 1:
            out.extend((held[k][0], held[k][1], s, e) for k, s, e in match_contexts([row[2:] for row in held]))
        held.clear()

    group = None
    for batch in batches:
        grp = batch.column("grp").to_numpy()
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "pos", "l", "bytes")), strict=True))
        edges = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(rows)]
        for first, end in zip(edges, edges[1:], strict=False):
            if end > first and grp[first] != group:
                flush()
                group = grp[first]
            held += rows[first:end]
        if out:
            yield _intervals_batch(out)
            out.clear()
    flush()
    if out:
        yield _intervals_batch(out)


def _intervals_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, key, s, e = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc", "key", "s", "e"])


INTERVALS = "doc long, key long, s int, e int"


def split_large(contexts: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Contexts in groups of at most ``limit``, and the intervals of copies found on the way.

    A group's strings start 0 to SPAN bytes before the anchor. A large group is halved by that distance; all strings of
    a half share a core, so its contexts part by their cores. At the last each string is a group of its own, in which
    equal contexts are one.
    """
    rows = contexts.withColumn("a", F.lit(0)).withColumn("b", F.lit(SPAN))
    settled, copies = [], []
    while True:
        sizes = materialise(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(f"n > {limit}").select("grp"), "large-groups")
        if sizes.isEmpty():
            return _all([*settled, rows.select("grp", "doc", "key", "pos", "l", "bytes")]), copies
        settled.append(rows.join(sizes, "grp", "left_anti").select("grp", "doc", "key", "pos", "l", "bytes"))
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b")))
        half = rows.join(sizes, "grp").select("grp", "doc", "key", "pos", "l", "bytes", F.explode(halves).alias("half")).select("*", "half.a", "half.b").drop("half")
        right = F.length("bytes") - F.col("l")
        half = half.where((F.col("a") <= F.col("b")) & (F.greatest(F.col("a"), LENGTH - right) <= F.least("b", "l")))
        core = F.substring("bytes", F.col("l") - F.col("a") + 1, F.col("a") - F.col("b") + LENGTH)
        kept = F.least("l", "b")
        cut = F.substring("bytes", F.col("l") - kept + 1, kept + F.least(right, LENGTH - F.col("a")))
        half = half.select(F.xxhash64("grp", "a", "b", core).alias("grp"), "doc", "key", "pos", kept.alias("l"), cut.alias("bytes"), "a", "b")
        half = materialise(half, "halves")
        first = materialise(half.groupBy("grp", "l", "bytes", "a", "b").agg(F.min(F.struct("doc", "key", "pos")).alias("first")), "first-halves")
        later = half.join(first, ["grp", "l", "bytes", "a", "b"]).where(F.struct("doc", "key", "pos") > F.col("first"))
        copies.append(materialise(later.select("doc", "key", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") - F.col("l") + F.length("bytes")).alias("e")), "half-copies"))
        rows = first.select("grp", "first.doc", "first.key", "first.pos", "l", "bytes", "a", "b")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def if_few(df: DataFrame, limit: int) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def removed_intervals(docs: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc, key, s, e): byte intervals to remove, overlapping and unordered, of documents (doc, key, text)."""
    places = materialise(map_texts(docs, _finder, PLACES), "places")
    repeated = materialise(places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "anchors")
    places = places.join(if_few(repeated, BROADCAST_HASHES), "hash", "left_semi")
    place = F.struct("doc", "key", "pos")
    variants = materialise(places.groupBy("hash", "ctx").agg(F.min(F.struct("doc", "key", "pos", "l", "r")).alias("first"), F.count(F.lit(1)).alias("n")), "variants")
    copied = variants.where("n > 1").select("hash", "ctx", F.struct("first.doc", "first.key", "first.pos").alias("first"))
    copies = places.join(copied, ["hash", "ctx"]).where(place > F.col("first")).select("doc", "key", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e"))
    mixed = variants.groupBy("hash").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("hash")
    wanted = materialise(variants.join(mixed, "hash").select("hash", "first.doc", "first.key", "first.pos", "first.l", "first.r"), "wanted")
    by_doc = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("hash", "pos", "l", "r")).alias("at"))
    by_doc = F.broadcast(by_doc) if wanted.count() <= BROADCAST_PLACES else by_doc
    cut = docs.join(by_doc, ["doc", "key"]).select("doc", "key", F.col("text").cast("binary").alias("text"), F.explode("at").alias("at"))
    contexts = cut.select(F.col("at.hash").alias("grp"), "doc", "key", F.col("at.pos").alias("pos"), F.col("at.l").alias("l"), F.substring("text", F.col("at.pos") - F.col("at.l") + 1, F.col("at.l") + F.col("at.r")).alias("bytes"))
    large = variants.groupBy("hash").agg(F.count(F.lit(1)).alias("v")).where(f"v > {limit}").isEmpty()
    more: list[DataFrame] = []
    if not large:
        contexts, more = split_large(materialise(contexts.distinct(), "contexts"), limit)
    sorted_groups = contexts.repartition("grp").sortWithinPartitions("grp", "doc", "key", "pos")
    return _all([copies, sorted_groups.mapInArrow(_matcher, INTERVALS), *more])


def merged(intervals: DataFrame) -> DataFrame:
    """One row a document: its maximal runs, in order, as ``runs``."""
    ordered = Window.partitionBy("doc", "key").orderBy("s", "e")
    before = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("opens", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)).withColumn("run", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    runs = opened.groupBy("doc", "key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


def keep(text: bytes, runs: list[dict] | None) -> bytes:
    """``text`` without the runs."""
    at, out = 0, []
    for run in runs or ():
        out.append(text[at : run["s"]])
        at = run["e"]
    return b"".join([*out, text[at:]]) if at else text


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw = (text or "").encode()
            left = keep(raw, runs)
            rows.append((len(raw), len(raw) - len(left), len(runs or ()), hashlib.sha256(left).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, key, text): key tells rows of one doc_id apart and is 0 where no id is repeated."""
    doc: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    plain = docs.select("doc_id", doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    unique = plain.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return plain.withColumn("key", F.lit(0).cast("long") if unique else F.xxhash64("text"))


def remove_repeats(docs: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller doc_id
    or earlier in the same one. Strings never cross documents, overlaps count, and strings are judged on the input. A
    null text counts as empty. A row without doc_id comes before all others. Rows that repeat a doc_id come in the order
    of a hash of their texts; those of equal text are one document with one result each. An empty table gives an empty
    result; other columns are ignored.

    Anchor counts and context groups are summed before they are shuffled, so an anchor that a third of all rows hold is
    one row a task; the different contexts of an anchor are split until a group is small.
    """
    own = keyed(docs)
    texts = own.select("doc", "key", "text")
    runs = materialise(merged(removed_intervals(texts, limit)), "runs")
    return map_texts(own.join(if_few(runs, BROADCAST_DOCS), ["doc", "key"], "left").select("doc_id", "text", "runs"), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
