"""Toxicity: a linear classifier on the presence of character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import map_texts
from quarrylight.llm.ngrams import chunks, code_points, hashed, held_out, labelled_texts, stratified_ids, text_of

ORDERS, BITS = (4, 5), 19
#: The bound of the sample that the classifier is fitted on: rows of each label, rows in all, characters.
SAMPLE_PER_LABEL, SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 6_000, 20_000_000
#: Features kept: those whose document counts differ most between the labels.
FEATURES = 1 << 12
THRESHOLD = 0.3


class Model(NamedTuple):
    slot: np.ndarray  # feature of each bucket, -1 for none
    weight: np.ndarray
    bias: float


def present(texts: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs."""
    codes, starts = code_points(texts)
    keys = []
    width = len(slot)
    for k, n in enumerate(ORDERS):
        found = slot[hashed(codes, n, BITS).astype(np.int64) + (k << BITS)]
        places = np.flatnonzero(found >= 0)
        text, inside = text_of(places, starts, n)
        keys.append(text[inside] * width + found[places[inside]])
    key = np.unique(np.concatenate(keys))
    return key // width, key % width


def buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """Each text's distinct buckets."""
    codes, starts = code_points(texts)
    found = [hashed(codes, n, BITS) for n in ORDERS]
    for begin, end in zip(starts, starts[1:], strict=False):
        yield np.concatenate([np.unique(h[begin : max(begin, end - n + 1)]).astype(np.int64) + (k << BITS) for k, (n, h) in enumerate(zip(ORDERS, found, strict=True))])


def fit(rows: list[tuple[str, int]], prior: float | None = None) -> Model:
    """Fit on (text, label) rows; ``prior`` is the share of label 1 among all labelled rows, if the sample's differs.

    Without rows of both labels, every score is the prior (0 if unknown).
    """
    labels = np.array([int(y) for _, y in rows], np.float64)
    n1, n0 = labels.sum(), (1 - labels).sum()
    slot = np.full(len(ORDERS) << BITS, -1, np.int32)
    if not n1 or not n0:
        rate = min(max(prior if prior is not None else (1.0 if n1 else 0.0), 1e-4), 1 - 1e-4)
        return Model(slot, np.zeros(1), float(np.log(rate / (1 - rate))))
    df = np.zeros((2, len(slot)))
    for first, texts in chunks([t for t, _ in rows]):
        for k, own in enumerate(buckets(texts), first):
            df[int(labels[k] > 0), own] += 1
    rate = (df.sum(0) + 1) / (n0 + n1 + 2)
    z = (df[1] / n1 - df[0] / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
    kept = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    kept = np.sort(kept[np.abs(z[kept]) > 3.5])
    if not len(kept):
        kept = np.array([0])
    slot[kept] = np.arange(len(kept))
    # Naive Bayes log-count ratio of the presence counts.
    ratio = np.log((df[1, kept] + 1) / (n1 + 2)) - np.log((df[0, kept] + 1) / (n0 + 2))
    texts_at, features_at = [], []
    for first, texts in chunks([t for t, _ in rows]):
        text, feature = present(texts, slot)
        texts_at.append(text + first)
        features_at.append(feature)
    text, feature = np.concatenate(texts_at), np.concatenate(features_at)
    w, bias = logistic(text, feature, ratio, labels)
    if prior is not None:
        prior = min(max(prior, 1e-4), 1 - 1e-4)
        bias += np.log(prior / (1 - prior)) - np.log(n1 / n0)
    return Model(slot, w * ratio, float(bias))


def logistic(text: np.ndarray, feature: np.ndarray, scale: np.ndarray, labels: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of ridge logistic regression on 0/1 features times ``scale``, by adaptive gradient steps."""
    n = len(labels)
    value = scale[feature]
    w, bias = np.zeros(len(scale)), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    gw, gb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        score = np.bincount(text, w[feature] * value, n) + bias
        wrong = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels
        slope = np.bincount(feature, wrong[text] * value, len(w)) / n + ridge * w
        # Adaptive steps: each weight by the size of its slopes so far.
        gw += slope**2
        gb += wrong.mean() ** 2
        w -= 0.05 * slope / (np.sqrt(gw) + 1e-9)
        bias -= 0.05 * wrong.mean() / (np.sqrt(gb) + 1e-9)
    return w, bias


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    out = np.empty(len(texts))
    for first, held in chunks(texts):
        text, feature = present(held, model.slot)
        raw = np.bincount(text, model.weight[feature], len(held)) + model.bias
        out[first : first + len(held)] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    return out


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample (SAMPLE_*) of the labelled rows that are not held out.

    A document with several labels takes the highest; null labels and null texts don't count.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = stratified_ids(known, "toxic", SAMPLE_PER_LABEL, SAMPLE_ROWS)
    rows = labelled_texts(docs, sample, "toxic", SAMPLE_ROWS, SAMPLE_CHARS)
    seen = sum(counts.values())
    return fit(rows, counts.get(1, 0) / seen if seen else None)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    A null or empty text has no n-gram and gets the score of the bias. Repeated rows get the same score each, an empty
    table gives an empty result, other columns are ignored. Texts are scored whole where they are read.
    """
    return map_texts(docs.select("doc_id", held_out().alias("held_out"), "text"), _scorer(model), "doc_id long, held_out boolean, score double, predicted int")


def _keeper(model: Model, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model, batch.column("text").to_pylist()) < threshold))

    return keep


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, by default those that are predicted toxic; all columns stay."""
    return map_texts(docs, _keeper(model, threshold), docs.schema)
