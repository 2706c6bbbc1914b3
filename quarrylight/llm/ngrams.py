"""Hashed character n-grams of many texts at once, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import materialise

#: Characters that one numpy pass takes at most, unless a single text is longer.
CHUNK_CHARS = 1_500_000
#: Labels whose rates may be broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Characters of the longest text that a sample takes, so that no single text uses up its budget.
LONGEST_SAMPLED = 1_000_000
#: Odd multipliers of the characters of an n-gram, and of the final mix.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xB5297A4D], np.uint32)
MIX = np.uint32(0x2C1B3C6D)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, lower-case texts) in runs of bounded size; null counts as empty."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        low = (text or "").lower()
        if held and size + len(low) > CHUNK_CHARS:
            yield first, held
            first, held, size = k, [], 0
        held.append(low)
        size += len(low)
    if held:
        yield first, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and where each text begins (one more entry: the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def hashed(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each place where an n-gram fits, its bucket among ``2 ** bits``."""
    size = max(0, len(codes) - n + 1)
    h = np.full(size, n * 0x3C6EF372 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h += codes[k : k + size] * FACTORS[k]
        if k % 2:
            h ^= h >> np.uint32(15)
    h ^= h >> np.uint32(13)
    h *= MIX
    return h >> np.uint32(32 - bits)


def text_of(places: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number of each place, whether its n-gram ends inside that text)."""
    text = np.searchsorted(starts, places, side="right") - 1
    return text, places + n <= starts[text + 1]


def held_out() -> Column:
    """Whether the document's labels are kept from every model."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def stratified_ids(df: DataFrame, label: str, per_class: int, total: int) -> DataFrame:
    """About ``per_class`` rows (doc_id, label) of each label, ``total`` at most in all.

    A row is taken if the hash of its id falls below its label's rate; no label's rows have to meet in one task. No
    label is left out beforehand; with more than ``total`` of them, those whose rows come first by hash are taken.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    rates = materialise(counts.select(label, F.least(F.lit(1.0), F.lit(1.2 * per_class) / F.col("__n")).alias("__rate")), "label-rates")
    few = rates.count() <= BROADCAST_LABELS
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = df.select("doc_id", label).join(F.broadcast(rates) if few else rates, label).where(draw < F.col("__rate"))
    return taken.orderBy(F.xxhash64("doc_id"), "doc_id").limit(total).select("doc_id", label)


def labelled_texts(docs: DataFrame, sample: DataFrame, label: str, total: int, chars: int) -> list[tuple[str, object]]:
    """(text, label) of the sampled documents, bounded by ``total`` rows and ``chars`` characters, in a fixed order.

    A document whose row is repeated counts once. Texts over LONGEST_SAMPLED or over the whole budget are left out and do not count, so that the rows behind them do.
    The sample holds ``total`` ids at most, so it may be broadcast and no text is shuffled for the join.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("__t")).where(F.length("text") <= min(LONGEST_SAMPLED, chars))
    # Lengths decide before any text is gathered: one narrow row for each sampled document, ``total`` at most.
    order = [F.xxhash64("doc_id"), "doc_id", "__n", "__t"]
    sized = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "__t", label, F.length("text").alias("__n")).distinct().orderBy(*order).limit(total)
    chosen = sized.withColumn("__sum", F.sum("__n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__sum") <= chars).select("doc_id", "__t", label, "__sum")
    found = texts.join(F.broadcast(chosen), ["doc_id", "__t"]).dropDuplicates(["doc_id", "__t", label])
    return [(r["text"], r[label]) for r in sorted(found.select("__sum", "doc_id", "__t", "text", label).collect(), key=lambda r: (r["__sum"], str(r["doc_id"]), r["__t"]))]
