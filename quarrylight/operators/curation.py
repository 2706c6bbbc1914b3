"""Joins, plans and metrics around labelled reports: lookups, leakage guards, batches, splits, agreement and span scores."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions.spans import matches
from quarrylight.functions.text import dedup_key
from quarrylight.operators.analytics import numbered, rounded
from quarrylight.operators.dedup import _written as written
from quarrylight.operators.dedup import exact_duplicates, near_groups, shared_folder, text_key
from quarrylight.operators.scoring import primary_flag

#: Word characters of the scripts that reports are written in.
TOKEN = r"[\wऀ-ॿঀ-৿]+|[^\w\sऀ-ॿঀ-৿]"


def length_counts(df: DataFrame, by: list[str], text: str, least: int = 15) -> DataFrame:
    """Rows whose trimmed text has ``least`` characters or more, and those that a filter would drop."""
    long = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least
    return df.groupBy(*by).agg(F.count_if(long).alias("kept"), F.count_if(~long).alias("dropped"))


def term_score(text: Column, strong: str, weak: str) -> Column:
    """Two for each distinct strong term, one for each distinct weak one."""
    distinct = lambda p: F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), 0), F.lower)))
    return 2 * distinct(strong) + distinct(weak)


def contains_any(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows one of whose columns holds the term, whatever its case."""
    return df.where(reduce(Column.__or__, (F.lower(F.col(c).cast("string")).contains(term.lower()) for c in columns)))


def two_key_lookup(rows: DataFrame, pool: DataFrame, key: str, text: str, value: str) -> DataFrame:
    """``rows`` with the pool's value by key, else by normalised text, and which of them found it.

    The pool is reduced to one row a key and one a text (the smallest key's) before the joins; texts meet as digests.
    """
    digest = lambda c: F.unhex(F.md5(F.nullif(dedup_key(F.col(c)), F.lit(""))))
    by_key = pool.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__a"))
    by_text = pool.select(digest(text).alias("__text"), key, value).where("__text is not null").groupBy("__text").agg(F.min_by(value, key).alias("__b"))
    joined = rows.withColumn("__own", digest(text)).join(by_key, F.col(key) == F.col("__key"), "left").join(by_text, F.col("__own") == F.col("__text"), "left")
    found = F.when(F.col("__a").isNotNull(), "key").when(F.col("__b").isNotNull(), "text")
    return joined.select(*rows.columns, F.coalesce("__a", "__b").alias(value), found.alias("found_by"))


def leakage_guard(corpus: DataFrame, held_out: DataFrame, key: str, text: str, percent: int = 85) -> DataFrame:
    """``corpus`` without the rows that are the same as a held-out one or stand in a near-duplicate group with one.

    Both sides become one table in which held-out rows rank first; a group that one of them is in is left out whole.
    """
    both = corpus.select(F.struct(F.lit(1).alias("side"), F.col(key).alias("id")).alias("node"), text).unionByName(held_out.select(F.struct(F.lit(0).alias("side"), F.col(key).alias("id")).alias("node"), text))
    # Texts are normalised once; both steps start from the written keys.
    both = written(both.select("node", text_key(text, False).alias("__text")))
    exact = exact_duplicates(both, "node", "__text", F.lit(0), normalised=True)
    survivors = both.join(exact.where("node = canonical").select("node"), "node", "left_semi")
    roots = near_groups(survivors, "node", "__text", percent, normalised=True)
    # The least node of a group is a held-out one if the group has any, for those come first.
    led = exact.join(roots.select(F.col("id").alias("canonical"), "root"), "canonical", "left").select("node", F.coalesce("root", "canonical").alias("root"))
    leaked = led.where("node.side = 1 and root.side = 0").select(F.col("node.id").alias(key))
    return corpus.join(leaked, key, "left_anti")


def overlapping_spans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of spans (key, role, start, end) of one row and role whose ranges intersect."""
    r = right.select(key, "role", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    return left.select(key, "role", "start", "end").join(r, [key, "role"]).where("start < end_b and start_b < end")


def pending(rows: DataFrame, done: DataFrame, keys: list[str], done_key: str) -> DataFrame:
    """Rows none of whose keys has been done."""
    known = done.select(F.col(done_key).alias("__done")).distinct()
    return reduce(lambda df, k: df.join(known, df[k] == F.col("__done"), "left_anti"), keys, rows)


def belonging(rows: DataFrame, batch: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that the batch names by key or, failing that, by text: two semi joins, each row once."""
    by_key = rows.join(batch.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    rest = rows.join(batch.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    texts = batch.select(F.sha2(F.col(text), 256).alias("__sha")).where("__sha is not null").distinct()
    by_text = rest.withColumn("__sha", F.sha2(F.col(text), 256)).join(texts, "__sha", "left_semi").select(*rows.columns)
    return by_key.select(*rows.columns).unionByName(by_text)


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a totally ordered result, each row with the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def agreement(df: DataFrame, by: list[str], a: Column, b: Column, set_a: Column, set_b: Column) -> DataFrame:
    """Rows, share of equal labels and mean Jaccard similarity of two annotators' sets; rows without either set don't count for it."""
    rows = df.select(*by, a.eqNullSafe(b).alias("same"), F.size(F.array_intersect(set_a, set_b)).alias("both"), F.size(F.array_union(set_a, set_b)).alias("any"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("same").cast("double"))).alias("label_agreement"), rounded(F.avg(F.when(F.col("any") > 0, F.col("both") / F.col("any")))).alias("mean_jaccard"))


def span_scores(truth: DataFrame, predicted: DataFrame, by: str = "label") -> DataFrame:
    """Precision, recall and F1 of exact spans (row, start, end, label), by label and, as '(all)', over all."""
    key = ["row", "start", "end", "label"]
    met = truth.select(*key).distinct().withColumn("t", F.lit(1)).join(predicted.select(*key).distinct().withColumn("p", F.lit(1)), key, "full")
    counts = met.groupBy(by).agg(F.count_if(F.expr("t = 1 and p = 1")).alias("tp"), F.count_if(F.expr("t is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))
    whole = counts.agg(F.lit("(all)").alias(by), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    both = counts.unionByName(whole)
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return both.select(by, "tp", "fp", "fn", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(F.try_divide(2 * p * r, p + r)).alias("f1"))


def flag_scores(df: DataFrame, truth: Column, act: Column, condition: Column, acts: Column, conditions: Column) -> DataFrame:
    """Strict and lenient accuracy, recall of either class, rows with both flags and with none."""
    rows = df.select(truth.alias("t"), primary_flag(act, condition, acts, conditions).alias("p"), act.alias("a"), condition.alias("c")).where("t in ('UA', 'UC')")
    share = lambda hit, of=None: rounded(F.try_divide(F.count_if(F.expr(hit)), F.count_if(F.expr(of)) if of else F.count(F.lit(1))))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), share("t = p").alias("strict"), share("(t = 'UA' and a) or (t = 'UC' and c)").alias("lenient"), share("t = 'UA' and p = 'UA'", "t = 'UA'").alias("ua_recall"),
        share("t = 'UC' and p = 'UC'", "t = 'UC'").alias("uc_recall"), F.count_if(F.expr("a and c")).alias("both_flags"), F.count_if(F.expr("not a and not c")).alias("no_flag"),
    )


def stated_truth(*keys: Column) -> Column:
    """in, out or border from the first key that is given; other values are null."""
    value = F.lower(F.trim(F.coalesce(*keys)))
    return F.when(value.startswith("bord"), "border").when(value.isin("in", "out"), value)


def shuffle_split(df: DataFrame, key: str, seed: int, dev: float = 0.15, test: float = 0.15) -> DataFrame:
    """``df`` with its side of a shuffled split: the last shares of a hash order are dev and test."""
    placed = numbered(df.withColumn("__digest", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))), [], "__digest", [F.col(key)], "__place")
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    train, upto = F.floor(F.col("__n") * (1 - dev - test) + 1e-9), F.floor(F.col("__n") * (1 - test) + 1e-9)
    side = F.when(F.col("__place") <= train, "train").when(F.col("__place") <= upto, "dev").otherwise("test")
    return placed.crossJoin(F.broadcast(total)).select(*df.columns, side.alias("split"))


def work_batches(df: DataFrame, key: str, first: Column, size: int) -> DataFrame:
    """``df`` with a batch number: rows for which ``first`` holds come first, then by a hash of the key."""
    order = F.concat(F.when(first, "0").otherwise("1"), F.md5(F.col(key).cast("string")))
    return numbered(df.withColumn("__digest", order), [], "__digest", [F.col(key)], "__place").select(*df.columns, F.floor((F.col("__place") - 1) / size).alias("batch"))


def deficit_plan(report: DataFrame, cls: str, rows: int, most: int = 3) -> DataFrame:
    """How many of the next ``rows`` each of the worst shortfalls gets, in proportion; the last of them takes the rest.

    ``report`` has one row a class with its shortfall, so its order is a sort of a few rows.
    """
    short = report.where("shortfall > 0").select(cls, "shortfall").orderBy(F.desc("shortfall"), F.desc(cls)).limit(most)
    by = Window.orderBy(F.desc("shortfall"), F.desc(cls))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = short.withColumn("place", F.row_number().over(by)).withColumn("last", F.count(F.lit(1)).over(whole)).withColumn("own", F.greatest(F.lit(1), F.bround(rows * F.col("shortfall") / F.sum("shortfall").over(whole)).cast("int")))
    before = F.coalesce(F.sum("own").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return share.select(cls, "shortfall", F.when(F.col("place") == F.col("last"), rows - before).otherwise(F.col("own")).cast("long").alias("planned"))


def multi_hot(values: Column, names: list[str]) -> Column:
    """0/1 for each name."""
    return F.array(*(F.coalesce(F.array_contains(values, name), F.lit(False)).cast("int") for name in names))


def token_spans(text: Column) -> Column:
    """Tokens with offsets: words of Latin, Devanagari and Bengali script, and single other characters."""
    return matches(text, f"(?:{TOKEN})")


def aligned(tokens: Column, start: Column, end: Column) -> Column:
    """struct<first,last> of the tokens that a character span covers exactly; null where it cuts one."""
    own = F.filter(F.transform(tokens, lambda t, k: F.struct(k.alias("k"), t["start"].alias("start"), t["end"].alias("end"))), lambda t: (t["start"] < end) & (t["end"] > start))
    first, last = F.get(own, F.lit(0)), F.get(own, F.size(own) - 1)
    return F.when((first["start"] == start) & (last["end"] == end), F.struct(first["k"].alias("first"), last["k"].alias("last")))


def without_overlaps(spans: Column) -> Column:
    """Of spans (size: minus the length, rank, start, end, role), those that no better one overlaps, in order of place."""
    free = lambda out, s: ~F.exists(out, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    own = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["role"].alias("role")))
    start = F.array().cast("array<struct<start:int,end:int,role:string>>")
    return F.array_sort(F.aggregate(F.array_sort(spans), start, lambda out, s: F.when(free(out, s), F.concat(out, own(s))).otherwise(out)))


def weak_spans(text: Column, lexicon: dict[str, str]) -> Column:
    """Lexicon hits without overlaps: longer ones first, then by the order of the roles, then by place."""

    def ranked(k: int, role: str, pattern: str) -> Column:
        return F.transform(matches(text, rf"\b(?:{pattern})\b"), lambda m: F.struct((m["start"] - m["end"]).alias("size"), F.lit(k).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(role).alias("role")))

    return without_overlaps(F.concat(*(ranked(k, role, pattern) for k, (role, pattern) in enumerate(lexicon.items()))))


def highlighted(text: Column, spans: Column) -> Column:
    """The text in pieces, each with the role of the span that it is, null between spans; spans that overlap an earlier one are left out (X11)."""
    kind = "struct<at:int,out:array<struct<text:string,role:string>>>"
    piece = lambda a, b, role: F.struct(text.substr(a + 1, b - a).alias("text"), role.alias("role"))
    none = F.lit(None).cast("string")

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] > state["at"], F.array(piece(state["at"], s["start"], none))).otherwise(F.array().cast("array<struct<text:string,role:string>>"))
        return F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.array(piece(s["start"], s["end"], s["role"]))).alias("out"))).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,role:string>>").alias("out")).cast(kind)
    return F.aggregate(F.array_sort(spans), start, step, lambda s: F.when(F.length(text) > s["at"], F.concat(s["out"], F.array(piece(s["at"], F.length(text), none)))).otherwise(s["out"]))


def review_actions(verdicts: DataFrame, reviewer: str, action: str, at: Column, corrected: Column | None = None, note: str | None = None) -> DataFrame:
    """Action rows to append for verdicts: approve, correct (with the corrected verdict) or escalate."""
    if action not in ("approve", "correct", "escalate") or (action == "correct") != (corrected is not None):
        raise ValueError("an action is approve, escalate, or correct with a corrected verdict")
    value = F.lit(None).cast("string") if corrected is None else corrected
    return verdicts.select("verdict_id", F.lit(action).alias("action"), F.lit(reviewer).alias("reviewer"), value.alias("corrected"), F.lit(note).cast("string").alias("note"), at.alias("at"))


def ingest_report(rows: DataFrame, text: str, checks: dict[str, Column]) -> DataFrame:
    """Rows by the first check that they fail ('ok' for none), with distinct texts: what a batch ingest would say."""
    reason = reduce(lambda e, c: e.when(~F.coalesce(c[1], F.lit(False)), c[0]), checks.items(), F.when(F.lit(False), "")).otherwise("ok")
    return rows.groupBy(reason.alias("result")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.sha2(F.col(text), 256)).alias("distinct_texts"))


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], folder: str | None = None) -> dict[str, DataFrame]:
    """Each table written as Parquet in a folder of its own and read back: the analytic copy of live tables.

    Filters and pruned columns belong in the frames that are given; they reach the live tables' scans.
    """
    root = folder or f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        out[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")
    return out


def marked_records(lines: DataFrame, by: list[str], order: str, text: str, marker: Column, heading: Column) -> DataFrame:
    """Records that a marker line opens, with the last heading above it; what stands before the first marker is left out."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("record", F.sum(marker.cast("int")).over(upto)).withColumn("__heading", F.last(heading, ignorenulls=True).over(upto)).where("record > 0")
    return placed.groupBy(*by, "record").agg(F.min_by("__heading", order).alias("heading"), F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("body"))


def projected(df: DataFrame, columns: dict[str, Column], required: list[str]) -> DataFrame:
    """The typed columns of a register; a required input column that is missing stops the job."""
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(c.alias(name) for name, c in columns.items()))
