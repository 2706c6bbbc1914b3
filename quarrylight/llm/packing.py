"""Best-two-fit packing of token sequences.

A bin is opened with the longest unpacked piece and filled greedily with the longest that fits the gap; then its
smallest piece is replaced by two unpacked pieces if they fill the expanded gap more tightly. Pieces of one length are
alike, so the packing is worked out over the histogram of lengths (at most ``capacity`` rows, whatever the corpus is)
and a bin pattern is repeated as long as its lengths last. Pieces then find their bin by their rank among those of
their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import map_texts, materialise, number_within
from quarrylight.llm.tokens import END_ID, TOKENIZER, encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Lengths:
    """The unpacked pieces as counts by length."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n

    def longest(self, gap: int) -> int:
        """The longest unpacked length of at most ``gap``; 0 if there is none."""
        found = np.flatnonzero(self.count[1 : gap + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def best_two(self, gap: int) -> tuple[int, int] | None:
        """Two unpacked pieces of the largest sum up to ``gap``."""
        own = np.flatnonzero(self.count[1 : gap + 1]) + 1
        if not len(own):
            return None
        at = np.searchsorted(own, gap - own, side="right") - 1
        # A length can be its own partner only where two such pieces are left.
        same = (at >= 0) & (own[at] == own) & (self.count[own] < 2)
        at = np.where(same, at - 1, at)
        sums = np.where(at >= 0, own + own[np.maximum(at, 0)], 0)
        k = int(np.argmax(sums))
        return (int(own[k]), int(own[at[k]])) if sums[k] else None


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (lengths) and how many bins follow each; together they use every piece once."""
    left = Lengths(counts, capacity)
    bins = []
    while first := left.longest(capacity):
        used: list[int] = []
        gap, length = capacity, first
        while length:
            used.append(length)
            left.count[length] -= 1
            gap -= length
            length = left.longest(gap) if gap else 0
        while gap and len(used) > 1:
            smallest = min(used)
            pair = left.best_two(gap + smallest)
            if not pair or sum(pair) <= smallest:
                break
            used.remove(smallest)
            left.count[smallest] += 1
            for length in pair:
                used.append(length)
                left.count[length] -= 1
            gap += smallest - sum(pair)
        times = 1
        need = defaultdict(int)
        for length in used:
            need[length] += 1
        # The next bins come out alike while each step would find the same lengths: what is used must last.
        times += min(int(left.count[length]) // n for length, n in need.items())
        for length, n in need.items():
            left.count[length] -= n * (times - 1)
        bins.append((tuple(used), times))
    return bins


def bin_slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, its slots in rank order: (first rank, first bin, offset in the bin)."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            slots[length].append((ranks[length], first, offset))
            ranks[length] += times
            offset += length
        first += times
    return slots


def _cutter(tokenizer: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            for first, ids, starts in words.encode_column(batch.column("text"), END_ID):
                sizes = np.diff(starts)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(sizes[doc] - piece * capacity, capacity)
                begin = starts[doc] + piece * capacity
                wide = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(first + doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a piece: documents of more than ``capacity`` ids (with the end id) are cut, the last piece may be shorter."""
    return map_texts(docs.select("doc_id", "text"), _cutter(tokenizer, capacity), PIECES)


def _placer(slots: dict[int, list[tuple[int, int, int]]]):
    # All lengths' slots end to end, by (length, first rank): one search finds the slot of every piece of a batch.
    rows = np.array([(length, *slot) for length in sorted(slots) for slot in slots[length]], np.int64).reshape(-1, 4)
    longest = int(rows[:, 1].max(initial=0)) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(rows[:, 0] * longest + rows[:, 1], length * longest + np.minimum(rank, longest - 1), side="right") - 1
            found = [pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *found], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids, one row a piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset (gapless in each sequence). A null or empty
    text is one piece that holds the end id alone; repeated rows are pieces of their own; an empty table gives an empty
    result; extra columns are ignored. The texts are encoded once where they are read; only the piece table is shuffled.
    Lengths that many pieces share are ranked in blocks.
    """
    pieces = materialise(cut_pieces(docs, capacity, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    slots = bin_slots(best_two_fit(counts, capacity))
    order = [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    ranked = number_within(pieces, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), order, sum(counts.values()), "rank")
    return ranked.mapInArrow(_placer(slots), f"{PIECES}, sequence_id long, offset long")
