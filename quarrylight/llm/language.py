"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (of blended lengths) that both hold, over the geometric mean
of their own numbers. Nyström landmarks make it a finite feature map, and one ridge regression for each language against
the rest is solved in it. Texts are scored in batches: presence matrix times landmark matrix times coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import map_texts
from quarrylight.llm.ngrams import chunks, code_points, hashed, held_out, labelled_texts, stratified_ids

ORDERS, BITS = (1, 2, 3), 14
LANDMARKS, RIDGE, SHARPNESS = 64, 1e-2, 6.0
#: The bound of the sample that the models are fitted on: rows of each language, rows in all, characters.
SAMPLE_PER_LANG, SAMPLE_ROWS, SAMPLE_CHARS = 400, 2_400, 12_000_000
#: Rows of a presence matrix at a time.
ROWS = 128
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    landmarks: np.ndarray  # buckets by landmark, scaled to unit kernel
    coefficients: np.ndarray  # landmark by language


def presence(texts: list[str]) -> np.ndarray:
    """0/1 matrix of texts (lower case) by bucket."""
    codes, starts = code_points(texts)
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for n in ORDERS:
        found = hashed(codes, n, BITS)
        for row, begin, end in zip(out, starts, starts[1:] - n + 1, strict=False):
            if end > begin:
                row[found[begin:end]] = 1
    return out


def scale(matrix: np.ndarray) -> np.ndarray:
    """Square root of each row's number of n-grams."""
    return np.sqrt(np.maximum(matrix.sum(1, keepdims=True), 1))


def kernels(texts: list[str | None], landmarks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, kernel values by landmark) in batches of bounded size."""
    for first, held in chunks(texts):
        for at in range(0, len(held), ROWS):
            seen = presence(held[at : at + ROWS])
            yield first + at, (seen @ landmarks) / scale(seen)


def fit(rows: list[tuple[str, str]]) -> Model:
    """Fit on (text, language) rows; every language with a row can be predicted."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((1 << BITS, 1), np.float32), np.zeros((1, 0), np.float32))
    by = {lang: [t for t, x in rows if x == lang] for lang in langs}
    share = max(1, LANDMARKS // len(langs))
    chosen = [t for lang in langs for t in by[lang][:share]]
    seen = presence([t.lower() for t in chosen])
    landmarks = np.ascontiguousarray((seen / scale(seen)).T)
    within = landmarks.T.astype(np.float64) @ landmarks
    values, vectors = np.linalg.eigh(within)
    sound = values > 1e-8 * values[-1]
    mapped = vectors[:, sound] / np.sqrt(values[sound])
    seen = np.vstack([k for _, k in kernels([t for t, _ in rows], landmarks)]).astype(np.float64) @ mapped
    target = np.where(np.array([lang for _, lang in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    # Each class weighs the same, however many rows it has in the sample.
    weight = np.array([1 / len(by[lang]) for _, lang in rows])[:, None]
    solved = np.linalg.solve(seen.T @ (weight * seen) + RIDGE / len(rows) * np.eye(seen.shape[1]), seen.T @ (weight * target))
    return Model(langs, landmarks, (mapped @ solved).astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text (``und`` for null and for texts without a letter) and its score, 0 to 1."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return langs, scores
    for first, kernel in kernels(texts, model.landmarks):
        raw = SHARPNESS * (kernel @ model.coefficients)
        odds = np.exp(raw - raw.max(1, keepdims=True))
        best = raw.argmax(1)
        for k, (lang, p) in enumerate(zip(best, odds.max(1) / odds.sum(1), strict=True)):
            if any(map(str.isalpha, texts[first + k] or "")):
                langs[first + k], scores[first + k] = model.langs[lang], min(1.0, float(p))
    return langs, scores


def _predictor(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return score


def train(docs: DataFrame) -> Model:
    """Fit on a bounded sample (SAMPLE_*) of the documents with a language that are not held out.

    Null texts and languages don't count; a document with several languages takes the least.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = stratified_ids(known, "lang", SAMPLE_PER_LANG, SAMPLE_ROWS).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    return fit(labelled_texts(docs.select("doc_id", "text"), sample, "lang", SAMPLE_ROWS, SAMPLE_CHARS))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 for a null text, one without a letter, or a model that has seen no language. Repeated rows get
    the same answer each, an empty table gives an empty result, other columns are ignored. Texts are scored whole where
    they are read; one very long text is a batch of its own.
    """
    return map_texts(docs.select("doc_id", held_out().alias("held_out"), "text"), _predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
