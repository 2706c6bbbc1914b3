"""Rows to train span models on: token spans with what misaligns, the balance of weak rows, glossaries, and grounded reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.spans import matches
from quarrylight.functions.text import collapse_ws
from quarrylight.operators.analytics import numbered
from quarrylight.operators.annotations import MAX_SPAN_TOKENS, MAX_TEXT_TOKENS
from quarrylight.operators.dedup import merge_entries, variant_lookup

# Names of the roles that models are told, and those that raw reports hardly ever state.
ROLE_LABELS = {
    "energy_cue": "energy source", "release_cue": "energy released", "no_release_cue": "not released yet", "exposure_cue": "person exposed", "control_present": "control present", "control_absent": "control absent",
    "control_ineffective": "control ineffective", "pseudo_control": "pseudo control", "negation_cue": "negation word", "outcome_cue": "outcome", "statement_cue": "statement marker",
}
SCARCE = ["control absent", "control ineffective", "control present", "pseudo control", "person exposed", "not released yet"]
# What a glossary entry may have.
ENTRY_FIELDS = ["term", "variants", "meaning", "category", "safety_signal", "example_line", "lsr", "confidence", "source_hint"]
CATEGORIES = ["equipment", "abbreviation", "barrier", "activity", "location", "hazard", "phrase", "other"]
CONFIDENCES = ["high", "medium", "low"]

WORD = r"(?:[\wऀ-ॿঀ-৿]+(?:[-_][\wऀ-ॿঀ-৿]+)*|\S)"


def token_rows(df: DataFrame, text: str, spans: str, drop_empty: bool = False) -> DataFrame:
    """``df`` with tokens, ner, misaligned, wide and fate of texts with spans (role, start, end).

    ner has (first, last, label) of the tokens that a span covers, sorted, without repeats. A span that cuts a token is
    counted as misaligned, one of more than MAX_SPAN_TOKENS as wide. fate is 'kept', 'length' (no token, or more than
    MAX_TEXT_TOKENS) or, with ``drop_empty``, 'empty'; no row is dropped. Null spans count as none, unknown roles keep
    their name.
    """
    labels = F.create_map(*(F.lit(x) for pair in ROLE_LABELS.items() for x in pair))
    out = df.withColumn("__tokens", matches(F.coalesce(F.col(text), F.lit("")), WORD))
    tokens = F.col("__tokens")
    # Where tokens begin and end, so that a span is looked up and not held against every token.
    out = out.withColumn("__first", F.transform(tokens, lambda t: t["start"])).withColumn("__last", F.transform(tokens, lambda t: t["end"]))
    own = F.filter(F.col(spans), lambda s: s.isNotNull())
    placed = F.transform(own, lambda s: F.struct((F.array_position("__first", s["start"].cast("int")) - 1).cast("int").alias("first"), (F.array_position("__last", s["end"].cast("int")) - 1).cast("int").alias("last"), F.coalesce(F.try_element_at(labels, s["role"]), s["role"]).alias("label")))
    out = out.withColumn("__placed", F.coalesce(placed, F.array().cast("array<struct<first:int,last:int,label:string>>")))
    whole = lambda p: F.coalesce((p["first"] >= 0) & (p["last"] >= p["first"]), F.lit(False))
    wide = lambda p: p["last"] - p["first"] + 1 > MAX_SPAN_TOKENS
    long = (F.size(tokens) == 0) | (F.size(tokens) > MAX_TEXT_TOKENS)
    none = F.array().cast("array<struct<first:int,last:int,label:string>>")
    ner = F.array_sort(F.array_distinct(F.filter("__placed", lambda p: whole(p) & ~wide(p))))
    out = out.withColumn("tokens", F.transform(tokens, lambda t: t["text"])).withColumn("ner", F.when(long, none).otherwise(ner))
    out = out.withColumn("misaligned", F.when(long, 0).otherwise(F.size(F.filter("__placed", lambda p: ~whole(p))))).withColumn("wide", F.when(long, 0).otherwise(F.size(F.filter("__placed", lambda p: whole(p) & wide(p)))))
    fate = F.when(long, "length").when(F.lit(drop_empty) & (F.size("ner") == 0), "empty").otherwise("kept")
    return out.withColumn("fate", fate).drop("__tokens", "__first", "__last", "__placed")


def token_row_counts(rows: DataFrame) -> DataFrame:
    """(counter, n): rows kept, those with spans, those dropped by reason, spans misaligned and too wide, and spans of each label."""
    kept = F.col("fate") == "kept"
    one = rows.agg(F.count_if(kept).alias("rows"), F.count_if(kept & (F.size("ner") > 0)).alias("rows_with_spans"), F.count_if(F.col("fate") == "length").alias("dropped_length"), F.count_if(F.col("fate") == "empty").alias("dropped_empty"), F.coalesce(F.sum("misaligned"), F.lit(0)).alias("span_misaligned"), F.coalesce(F.sum("wide"), F.lit(0)).alias("span_too_wide"))
    flat = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*one.columns))).alias("counter", "n"))
    labels = rows.where(kept).select(F.explode("ner").alias("s")).groupBy(F.concat(F.lit("label:"), F.col("s.label")).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return flat.unionByName(labels)


def balanced_weak(weak: DataFrame, real_rows: int, key: str, ratio: float = 0.5) -> DataFrame:
    """The weak rows (with ner) to train with: only those with a scarce label, those with most of them first, ``ratio`` times the real rows at most.

    Among rows of equally many the hash of the key decides. The cut is found from the counts of rows by number of scarce
    spans, which are few; only the rows at the cut are numbered, in blocks, so no task gathers them.
    """
    cap = int(real_rows * ratio)
    scarce = weak.withColumn("__scarce", F.size(F.filter("ner", lambda s: s["label"].isin(*SCARCE)))).where("__scarce > 0")
    counts = scarce.groupBy("__scarce").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("__scarce")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = counts.withColumn("__ahead", ahead).select("__scarce", F.greatest(F.lit(0), F.least("n", F.lit(cap) - F.col("__ahead"))).alias("__room"), "n")
    # A row for each number of scarce spans that occurs: at most as many as a text has tokens.
    dealt = scarce.join(F.broadcast(levels), "__scarce")
    whole = dealt.where(F.col("__room") == F.col("n"))
    cut = numbered(dealt.where((F.col("__room") > 0) & (F.col("__room") < F.col("n"))).withColumn("__digest", F.sha1(F.col(key).cast("string"))), ["__scarce"], "__digest", [F.col(key)], "__place")
    return whole.select(*weak.columns).unionByName(cut.where(F.col("__place") <= F.col("__room")).select(*weak.columns))


def checked_entries(entries: DataFrame, json: str, signals: dict[str, str | None]) -> DataFrame:
    """Glossary entries (JSON objects) with clean fields and problems: what their fields lack or have too much, by name.

    ``signals`` maps safety signals to roles (None: known, no role). Columns: those of ``entries``, term, variants, meaning,
    category, role, confidence, problems.
    """
    fields = "term string, variants array<string>, meaning string, category string, safety_signal string, example_line string, lsr string, confidence string, source_hint string"
    names = F.coalesce(F.json_object_keys(F.col(json)), F.array().cast("array<string>"))
    e = F.from_json(json, fields)
    out = entries.withColumn("__e", e).withColumn("__names", names)
    clean = lambda name: F.nullif(collapse_ws(F.col(f"__e.{name}")), F.lit(""))
    category, confidence, signal = F.lower(clean("category")), F.lower(clean("confidence")), F.lower(F.coalesce(clean("safety_signal"), F.lit("")))
    known = F.create_map(*(x for s, r in signals.items() for x in (F.lit(s), F.struct(F.lit(r).cast("string").alias("role")))))
    expected = F.array(*map(F.lit, ENTRY_FIELDS))
    listed = lambda label, extra: F.when(F.size(extra) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.array_sort(extra), ",")))
    problems = F.array_compact(
        F.array(
            listed("missing", F.array_except(expected, "__names")), listed("unexpected", F.array_except("__names", expected)), F.when(clean("term").isNull(), "no term"),
            F.when(~F.coalesce(category.isin(*CATEGORIES), F.lit(False)), F.concat(F.lit("category: "), F.coalesce(category, F.lit("")))), F.when(~F.coalesce(confidence.isin(*CONFIDENCES), F.lit(False)), F.concat(F.lit("confidence: "), F.coalesce(confidence, F.lit("")))),
            F.when(F.try_element_at(known, signal).isNull(), F.concat(F.lit("signal: "), signal)),
        )
    )
    variants = F.array_distinct(F.filter(F.transform(F.coalesce(F.col("__e.variants"), F.array().cast("array<string>")), lambda v: collapse_ws(v)), lambda v: v != ""))
    columns = {"term": clean("term"), "variants": variants, "meaning": clean("meaning"), "category": F.when(category.isin(*CATEGORIES), category).otherwise("other"), "role": F.try_element_at(known, signal)["role"], "confidence": F.when(confidence.isin(*CONFIDENCES), confidence).otherwise("low"), "problems": problems}
    return out.withColumns(columns).drop("__e", "__names")


def glossary(entries: DataFrame, json: str, signals: dict[str, str | None], order: str) -> tuple[DataFrame, DataFrame]:
    """(entries, lookup) of a glossary: checked, one entry a term, and the term of each variant."""
    sound = checked_entries(entries, json, signals).where("term IS NOT NULL")
    merged = merge_entries(sound, "term", "variants", ["meaning", "category", "role"], order)
    return merged, variant_lookup(merged, "term", "variants")


def grounded(reason: Column, text: Column) -> Column:
    """The sentences of a reason that quote the text word for word; null if fewer than two do."""
    sentences = F.filter(F.transform(F.split(reason, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    kept = F.filter(sentences, lambda s: F.exists(F.regexp_extract_all(s, F.lit('"([^"]{3,})"'), 1), lambda q: F.contains(text, q)))
    return F.when(F.size(kept) >= 2, F.array_join(kept, " "))


def accepted_rows(parts: dict[str, DataFrame], order: str) -> DataFrame:
    """Accepted rows of several jobs as one table with running ids d000000 on, by job and place, and a trap for each.

    ``order`` is a row's place in its job, 0 or more; there are ten jobs at most.
    """
    if len(parts) > 10:
        raise ValueError("more than ten jobs")
    rows = None
    for k, (job, df) in enumerate(parts.items()):
        own = df.withColumn("__job", F.lit(k)).withColumn("source", F.coalesce("source", F.lit(job)))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    # A block of the numbering is a hundredth of a job's places: blocks follow each other in order, none gathers a job.
    last = rows.groupBy("__job").agg(F.max(order).alias("__last"))
    part = F.floor(F.col(order) * 100 / (F.col("__last") + 1)).cast("int")
    digest = F.concat(F.lpad((F.col("__job") * 100 + part).cast("string"), 3, "0"), F.lpad(F.col(order).cast("string"), 20, "0"))
    dealt = rows.join(F.broadcast(last), "__job").withColumn("__all", F.lit(0)).withColumn("__digest", digest).drop("__last")
    placed = numbered(dealt, ["__all"], "__digest", [F.col(order)], "__place")
    trap = F.coalesce("trap", F.when(F.startswith("source", F.lit("rewind")), "rewind").otherwise("none"))
    return placed.withColumn("trap", trap).withColumn("id", F.concat(F.lit("d"), F.lpad((F.col("__place") - 1).cast("string"), 6, "0"))).drop("__job", "__all", "__digest", "__place")


def seeds(df: DataFrame, text: str, hint: str, limit: int, least: int = 6, most: int = 40) -> DataFrame:
    """Rows to start from: not set aside for evaluation, texts of so many words, ``limit`` of them by the hash of the text."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return df.where((F.coalesce(hint, F.lit("")) != "eval_pool") & words.between(least, most)).orderBy(F.xxhash64(text), text).limit(limit)


