"""Corpus audits, term mining and text statistics over documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import dedup_key, word_count, words

#: Prototypes that every vector may be held against.
MAX_PROTOTYPES = 20_000

# Stop words of the language test.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "on", "as", "are", "this", "be", "by"),
    "fr": ("le", "la", "les", "de", "des", "du", "un", "une", "et", "que", "qui", "dans", "pour", "est", "au", "par"),
    "de": ("der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "ein", "eine", "des", "auf", "dem", "nicht", "im"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "es", "del", "al"),
}


def stop_word_language(text: Column, least: int = 2) -> Column:
    """The language most of whose stop words stand in the text, by name among equals; 'unknown' below ``least``."""
    own = F.transform(F.array(text), lambda t: F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != ""))
    scores = F.transform(own, lambda w: F.array_max(F.array(*(F.struct(F.size(F.filter(w, _in(stop))).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, stop) in enumerate(sorted(STOP_WORDS.items()))))))
    best = F.get(scores, F.lit(0))
    return F.when(best["n"] >= least, best["lang"]).otherwise("unknown")


def _in(stop: tuple[str, ...]):
    return lambda w: w.isin(*stop)


def term_counts(df: DataFrame, text: str, by: list[str], least: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """Documents by lower-case word of ``least`` characters or more."""
    own = F.array_distinct(F.filter(F.split(dedup_key(F.col(text)), " "), lambda w: (F.length(w) >= least) & ~w.isin(*(stop or ("",)))))
    return df.select(*by, F.explode(own).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))


def mine_terms(df: DataFrame, text: str, role: str, least_n: int, share: float, cap: int) -> DataFrame:
    """Terms that belong to one role: counted often enough, most of their rows in that role, the top of each."""
    counts = term_counts(df, text, [role], 3)
    total = counts.groupBy("term").agg(F.sum("n").alias("total"))
    own = counts.where(F.col("n") >= least_n).join(total, "term").where(F.col("n") >= share * F.col("total"))
    rank = F.row_number().over(Window.partitionBy(role).orderBy(F.desc("n"), "term"))
    return own.withColumn("rank", rank).where(F.col("rank") <= cap).select(role, "term", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def reused_ngrams(df: DataFrame, text: str, by: list[str], n: int, least: int) -> DataFrame:
    """How many word n-grams of each group stand in ``least`` places or more, and the most frequent one's count.

    N-grams are hashed to 64 bits where they are read; (group, hash, count) is all that is shuffled.
    """
    grams = F.flatten(F.transform(F.array(words(dedup_key(F.col(text)))), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))))
    counts = df.select(*by, F.explode(grams).alias("g")).groupBy(*by, "g").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("ngrams"), F.count_if(F.col("n") >= least).alias("reused"), F.max("n").alias("most"))


def _diversity(frame: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(1).to_pylist():
                own = (key or "").split()
                width, last, opened = min(frame, len(own)), {}, 0
                for at, w in enumerate(own):
                    # A word opens a type in the windows that start after its previous occurrence and hold it.
                    opened += max(0, min(at, len(own) - width) - max(0, at - width + 1, last.get(w, -1) + 1) + 1)
                    last[w] = at
                rows.append((len(own), len(last), opened, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4))], names=[batch.schema.names[0], "words", "types", "opened", "width"])

    return measure


def lexical_diversity(df: DataFrame, key: str, text: str, frame: int = 50) -> DataFrame:
    """Words, type-token ratio and its moving average over ``frame`` words, by document.

    The moving average follows from each word's distance to its previous occurrence, in one pass over a text where it
    is read: nothing is shuffled. Texts without words are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    found = df.select(key, dedup_key(F.col(text)).alias("__key")).mapInArrow(_diversity(frame), f"`{key}` {kind}, words long, types long, opened long, width long").where("words > 0")
    return found.select(key, "words", (F.col("types") / F.col("words")).alias("ttr"), (F.col("opened") / F.col("width") / (F.col("words") - F.col("width") + 1)).alias("mattr"))


def source_audit(df: DataFrame, by: str, text: str, label: str) -> DataFrame:
    """Rows, empty and short texts, exact duplicates, label coverage and a status by source."""
    n = F.count(F.lit(1))
    body = F.coalesce(F.col(text), F.lit(""))
    measured = df.select(by, F.sha1(dedup_key(body)).alias("k"), word_count(body).alias("w"), F.col(label).isNotNull().alias("has"))
    base = measured.groupBy(by).agg(n.alias("rows"), F.count_if(F.col("w") == 0).alias("empty"), F.count_if(F.col("w") < 8).alias("short"), (n - F.countDistinct("k")).alias("duplicates"), F.count_if("has").alias("labelled"))
    coverage = F.round(F.col("labelled") / F.col("rows"), 6)
    status = F.when(F.col("rows") < 20, "thin").when(F.col("duplicates") > F.col("rows") * 0.1, "repetitive").otherwise("ok")
    return base.select(by, "rows", "empty", "short", "duplicates", "labelled", coverage.alias("coverage"), status.alias("status"))


def quota_report(df: DataFrame, cls: str, targets: dict[str, int]) -> DataFrame:
    """Count, share and shortfall of each target class, in no order (A18, M11 without its row plan)."""
    table = df.sparkSession.createDataFrame(list(targets.items()), f"`{cls}` string, target long")
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    joined = table.join(counts, cls, "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return joined.select(cls, n.alias("n"), "target", F.round(n / F.col("total"), 6).alias("share"), F.greatest(F.lit(0), F.col("target") - n).alias("shortfall"))


def lexicon_hits(text: Column, lexicons: dict[str, str]) -> Column:
    """Names of the lexicons with a hit."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), name) for name, p in lexicons.items())))


def first_rule(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The first rule of an ordered table that fits."""
    return reduce(lambda e, r: e.when(text.rlike(f"(?i){r[0]}"), r[1]), table, F.when(F.lit(False), "")).otherwise(default)


def nearest_prototypes(vectors: DataFrame, prototypes: DataFrame, floor: float, margin: float) -> DataFrame:
    """Best and second class of each vector by the cosine of its best prototype, accepted above a floor and margin.

    ``prototypes`` (label, proto) is a small fixed set for each label; more than MAX_PROTOTYPES are refused, as every
    vector is held against each.
    """
    if prototypes.count() > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    proto = prototypes.select("proto_label", unit(F.col("proto").cast("array<double>")).alias("p"))
    dot = F.aggregate(F.zip_with("v", "p", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))
    scored = own.crossJoin(F.broadcast(proto)).withColumn("cos", dot / norm)
    best = scored.groupBy("vec_id", "proto_label").agg(F.max("cos").alias("cos"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cos"), "proto_label"))).where("rank <= 2")
    wide = ranked.groupBy("vec_id").agg(F.max(F.when(F.col("rank") == 1, F.col("proto_label"))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col("cos"))).alias("score"), F.max(F.when(F.col("rank") == 2, F.col("cos"))).alias("second"))
    return wide.select("vec_id", "best", F.round("score", 6).alias("score"), ((F.col("score") >= floor) & (F.col("score") - F.coalesce("second", F.lit(-1.0)) >= margin)).alias("accepted"))


def semantic_types(vectors: DataFrame, prototypes: DataFrame, floor: float = 0.45, margin: float = 0.05) -> DataFrame:
    """vec_id, best, score, margin and runner_up of the vectors that a class of prototypes fits.

    ``prototypes`` (proto_label, proto) is a small fixed set, at most MAX_PROTOTYPES; those without a label are negatives.
    The best class is that of the nearest prototype by cosine, the smaller label among equals; it has to reach the floor
    and to lie the margin above the nearest negative. Vectors that are null, of another
    length than the prototypes, all zero or not finite fit nothing; prototypes of two lengths are an error.
    """
    rows = prototypes.limit(MAX_PROTOTYPES + 1).select("proto_label", F.col("proto").cast("array<double>").alias("p")).collect()
    if len(rows) > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    positive = [r for r in rows if r["proto_label"] is not None]
    negative = [r for r in rows if r["proto_label"] is None]
    labels = sorted({r["proto_label"] for r in positive})
    if not labels:
        raise ValueError("no labelled prototypes")
    if len({len(r["p"]) for r in rows}) > 1:
        raise ValueError("prototypes of different lengths")

    def unit(vectors_: list) -> np.ndarray:
        m = np.array(vectors_, dtype=np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    classes = [unit([r["p"] for r in positive if r["proto_label"] == name]) for name in labels]
    against = unit([r["p"] for r in negative]) if negative else None
    label_type = prototypes.schema["proto_label"].dataType.simpleString()

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.array(batch["v"].tolist(), dtype=np.float64)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            cos = np.stack([(v @ own.T).max(1) for own in classes], axis=1)
            order = np.argsort(-cos, axis=1, kind="stable")
            first = np.take_along_axis(cos, order[:, :1], 1)[:, 0]
            gap = first - (v @ against.T).max(1) if against is not None else first + 1
            second = [labels[k] for k in order[:, 1]] if len(labels) > 1 else [None] * len(v)
            out = pd.DataFrame({"vec_id": batch["vec_id"], "best": [labels[k] for k in order[:, 0]], "score": first.round(5), "margin": gap.round(5), "runner_up": second})
            yield out[(first >= floor) & (gap >= margin)]

    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(f"size(v) = {len(positive[0]['p'])} AND aggregate(v, 0D, (s, x) -> s + x * x) BETWEEN 1e-300 AND 1e300")
    return own.mapInPandas(typed, f"vec_id long, best {label_type}, score double, margin double, runner_up {label_type}")
