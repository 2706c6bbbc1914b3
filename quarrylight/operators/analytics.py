"""Analytics over verdict-like facts: disproportionality, drift, blind spots, barrier health, association rules, roll-ups.

Every function takes DataFrames and column names and returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def rounded(value: Column) -> Column:
    return F.round(value, DIGITS)


def prr_all(facts: DataFrame, precursor: str, site: str) -> DataFrame:
    """Proportional reporting ratio of every precursor at every site, from one grouped pass.

    ``a`` counts the pair, ``b`` the site's other precursors, ``c`` the precursor elsewhere, ``d`` the rest. The ratio is
    a/(a+b) over c/(c+d) with a 95 % interval on its logarithm; it is null where a or c is 0. A pair is flagged if the
    interval lies above 1 and a >= 3. Rows without precursor or site don't count.
    """
    cells = facts.where(F.col(precursor).isNotNull() & F.col(site).isNotNull()).groupBy(precursor, site).agg(F.count(F.lit(1)).alias("a"))
    by_site = cells.groupBy(site).agg(F.sum("a").alias("site_n"))
    by_precursor = cells.groupBy(precursor).agg(F.sum("a").alias("precursor_n"))
    total = cells.agg(F.sum("a").alias("n"))
    full = by_precursor.crossJoin(F.broadcast(total)).join(cells, precursor).join(by_site, site)
    a = F.col("a")
    b, c = F.col("site_n") - a, F.col("precursor_n") - a
    d = F.col("n") - F.col("site_n") - c
    ratio = F.when((c > 0) & (a > 0), (a / (a + b)) / (c / (c + d)))
    error = F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    low, high = F.exp(F.log(ratio) - 1.96 * error), F.exp(F.log(ratio) + 1.96 * error)
    return full.select(
        F.col(precursor).alias("precursor"), F.col(site).alias("site"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"),
        rounded(ratio).alias("prr"), rounded(low).alias("ci_lower"), rounded(high).alias("ci_upper"),
        F.coalesce((low > 1) & (a >= 3), F.lit(False)).alias("flagged"),
    )


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_of(ts: Column) -> Column:
    """Year and Monday-based week number, week 0 before the year's first Monday."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat_ws("-", F.year(ts), F.lpad(week.cast("string"), 2, "0"))


def cusum(facts: DataFrame, series: list[str], period: Column, slack: float = 0.5, limit: float = 4.0, floor: float = 5.0) -> DataFrame:
    """One-sided CUSUM of the counts per period of each series.

    s grows by x - mean - slack * sd and never falls below 0; it is flagged above max(limit * sd, floor). In closed form
    s = C - min(0, least C so far) with C the running sum. Periods without rows aren't filled in; a series of fewer than
    two periods is left out.
    """
    counts = facts.groupBy(*series, period.alias("period")).agg(F.count(F.lit(1)).alias("x"))
    whole, so_far = Window.partitionBy(*series), Window.partitionBy(*series).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    mean, sd = F.avg("x").over(whole), F.coalesce(F.stddev_pop("x").over(whole), F.lit(0.0))
    steps = counts.withColumn("periods", F.count(F.lit(1)).over(whole)).withColumn("mean", mean).withColumn("sd", sd).where("periods >= 2")
    running = steps.withColumn("c", F.sum(F.col("x") - F.col("mean") - slack * F.col("sd")).over(so_far))
    s = F.col("c") - F.least(F.lit(0.0), F.min("c").over(so_far))
    return running.withColumn("s", s).select(*series, "period", "x", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"), rounded(F.col("s")).alias("s"), (F.col("s") > F.greatest(limit * F.col("sd"), F.lit(floor))).alias("flagged"))


def blind_spots(facts: DataFrame, sites: DataFrame, site: str, name: str, include_zero: bool = False) -> DataFrame:
    """Sites that report far less than their peers: z-score of the site's count, flagged below -2."""
    counts = facts.groupBy(site).agg(F.count(F.lit(1)).alias("n"))
    joined = sites.select(site, name).join(counts, site, "left" if include_zero else "inner").withColumn("n", F.coalesce("n", F.lit(0)))
    peers = joined.agg(F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    risk = F.when(F.col("z") < -2, "HIGH").when(F.col("z") < -1, "MEDIUM").otherwise("LOW")
    return joined.crossJoin(F.broadcast(peers)).withColumn("z", z).select(F.col(site).alias("site"), F.col(name).alias("site_name"), "n", rounded(F.col("z")).alias("z"), (F.col("z") < -2).alias("flagged"), risk.alias("risk"))


def barrier_health(facts: DataFrame, hazard: str, barrier: str, status: str, values: list[str], failed: list[str]) -> DataFrame:
    """Status counts, total and failure rate of each hazard's barriers."""
    wide = facts.groupBy(hazard, barrier).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values))
    total = reduce(Column.__add__, [F.col(f"n_{v}") for v in values])
    bad = reduce(Column.__add__, [F.col(f"n_{v}") for v in failed])
    return wide.withColumn("total", total).select(F.col(hazard).alias("hazard"), F.col(barrier).alias("barrier"), *(f"n_{v}" for v in values), "total", rounded(F.when(total > 0, bad / total)).alias("failure_rate"))


def association_rules(facts: DataFrame, attributes: list[str], min_support: float, min_confidence: float, min_rows: int = 10) -> DataFrame:
    """Rules between values of distinct attributes with support, confidence and lift.

    A transaction has one value of each attribute, so its item sets are those of a cube: the rows are first summed over
    all attributes, and the cube of those sums gives each set's support. Nothing below ``min_rows`` transactions.
    """
    base = facts.groupBy(*attributes).agg(F.count(F.lit(1)).alias("n"))
    cube = base.cube(*attributes).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    total = base.agg(F.sum("n").alias("total"))
    # A set's items are the attributes that its cube level keeps.
    items = F.array_compact(F.array(*(F.when(F.col("gid").bitwiseAND(1 << (len(attributes) - 1 - k)) == 0, F.concat(F.lit(f"{a}="), F.col(a).cast("string"))) for k, a in enumerate(attributes))))
    frequent = cube.crossJoin(F.broadcast(total)).where((F.col("total") >= min_rows) & (F.col("n") / F.col("total") >= min_support))
    frequent = frequent.select(items.alias("items"), "n", "total").where(F.size("items") > 0)
    # Every non-empty proper part of a set can be the antecedent; what is left is the consequent.
    parts = frequent.where(F.size("items") > 1).select("items", F.col("n").alias("n_ab"), "total", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(items)) - 2"))).alias("mask"))

    def side(value: int) -> Column:
        return F.array_join(F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {value})"), " & ")

    supports = frequent.select(F.array_join("items", " & ").alias("key"), "n")
    rules = parts.select(side(1).alias("antecedent"), side(0).alias("consequent"), "n_ab", "total")
    rules = rules.join(supports.select(F.col("key").alias("antecedent"), F.col("n").alias("n_a")), "antecedent").join(supports.select(F.col("key").alias("consequent"), F.col("n").alias("n_b")), "consequent")
    confidence = F.col("n_ab") / F.col("n_a")
    return rules.where(confidence >= min_confidence).select("antecedent", "consequent", rounded(F.col("n_ab") / F.col("total")).alias("support"), rounded(confidence).alias("confidence"), rounded(confidence / (F.col("n_b") / F.col("total"))).alias("lift"))


def current_rows(facts: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """The latest row of each key (W05, K12): append-only versions read as of now."""
    return facts.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("__n = 1").drop("__n")


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """Rows by value, null shown as 'None' (A01, A02)."""
    return df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("None")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def multi_counts(df: DataFrame, field: str) -> DataFrame:
    """Rows by element of an array column, the part before ':' only; '(none)' for null and empty arrays."""
    value = F.split_part(F.coalesce(F.col("element"), F.lit("(none)")), F.lit(":"), F.lit(1))
    return df.select(F.explode_outer(field).alias("element")).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def rank_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, upper median, 90th of the sorted values by index, and greatest, by group.

    The values at ranks n div 2 and floor(0.9 n) come from cumulative counts of distinct values, so no group's values
    meet in one array.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    so_far = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("k").over(so_far)).withColumn("n", F.sum("k").over(Window.partitionBy(*by)))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col(value)))

    return upto.groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("least"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 9 / 10)).alias("p90"), F.max(value).alias("greatest"))


def agreement(actions: DataFrame, action: str) -> DataFrame:
    """Reviewer agreement: total, approvals, corrections and the share of approvals in percent."""
    total = F.count(F.lit(1))
    approved = F.count_if(F.col(action) == "approve")
    return actions.agg(total.alias("total"), approved.alias("approved"), F.count_if(F.col(action) == "correct").alias("corrected"), F.bround(F.when(total > 0, 100 * approved / total).otherwise(0.0), 1).alias("rate"))


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 200) -> DataFrame:
    """One page of a totally ordered result; sizes above ``most`` are cut to it."""
    size = min(size, most)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def review_queue(verdicts: DataFrame, actions: DataFrame, key: str, filters: dict[str, str] | None = None) -> DataFrame:
    """Current verdicts that need review and have no action yet; filters apply where given."""
    open_ones = verdicts.where(F.col("review_required") & F.col("is_current")).join(actions.select(key).distinct(), key, "left_anti")
    for name, value in (filters or {}).items():
        open_ones = open_ones.where(F.col(name) == value)
    return open_ones


def grouped_split(df: DataFrame, group: str, strata: list[str], seed: int, dev: float = 0.1, test: float = 0.1) -> DataFrame:
    """Each group's side of a stratified split: whole groups go to test, dev or train.

    A stratum's groups are ordered by a hash; half-even rounding of its shares gives the sizes of dev and test.
    """
    first = df.groupBy(group).agg(*(F.min(s).alias(s) for s in strata))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.col(group).cast("string"), F.lit(str(seed)))), group))
    sized = first.withColumn("rank", rank).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*strata)))
    n_test, n_dev = F.bround(F.col("n") * test), F.bround(F.col("n") * dev)
    side = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_dev, "dev").otherwise("train")
    return sized.select(group, *strata, side.alias("split"))


def numbered(df: DataFrame, by: list[str], digest: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place from 1 in its group, ordered by a hex digest and then ``order``.

    Blocks of equal first digits are numbered apart and follow each other, so that a group of a third of all rows is
    many small sorts and not one; only the block sizes meet by group.
    """
    block, ahead = f"__{name}_block", f"__{name}_ahead"
    dealt = df.withColumn(block, F.substring(digest, 1, 3))
    sizes = dealt.groupBy(*by, block).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(c).alias(f"__{c}") for c in by), F.col(block).alias(f"__{block}"), before.alias(ahead))
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*by, block).orderBy(digest, *order)))
    same = [inside[c].eqNullSafe(starts[f"__{c}"]) for c in by] + [inside[block].eqNullSafe(starts[f"__{block}"])]
    return inside.join(starts, reduce(Column.__and__, same)).withColumn(name, F.col(name) + F.col(ahead)).select(*df.columns, name)


def folds(df: DataFrame, key: str, cls: str, text: str, n: int = 5) -> DataFrame:
    """Fold of each row: its place in the class's order by SHA-1 of the text, modulo ``n``."""
    placed = numbered(df.select(key, cls, F.sha1(F.col(text)).alias("__digest")), [cls], "__digest", [F.col(key)], "__place")
    return placed.select(key, cls, F.pmod(F.col("__place") - 1, F.lit(n)).alias("fold"))


def capped(df: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each group in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def enforce_quotas(df: DataFrame, cls: str, key: str, shares: dict[str, float], tolerance: float, rounds: int = 60) -> DataFrame:
    """Rows kept when no class may exceed share * tolerance * the total kept, a fixed point.

    The driver iterates over one count for each class of ``shares``; classes without a share stay whole.
    """
    counts = {r[cls]: r["n"] for r in df.where(F.col(cls).isin(*shares)).groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()}
    others = df.where(~F.col(cls).isin(*shares) | F.col(cls).isNull()).count()
    kept = dict(counts)
    for _ in range(rounds):
        total = sum(kept.values()) + others
        now = {c: min(kept[c], int(shares[c] * tolerance * total)) for c in kept}
        if now == kept:
            break
        kept = now
    limits = reduce(lambda e, c: e.when(F.col(cls) == c, kept[c]), kept, F.when(F.lit(False), 0)).otherwise(F.lit(1 << 62))
    placed = numbered(df.withColumn("__digest", F.md5(F.col(key).cast("string"))), [cls], "__digest", [F.col(key)], "__n")
    return placed.where(F.col("__n") <= limits).select(*df.columns)


def binary_metrics(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None, beta: float = 2.0) -> DataFrame:
    """Confusion counts, precision, recall, F-beta and accuracy, whole or by group."""
    rows = df.select(*(by or []), truth.alias("t"), predicted.alias("p"))
    counts = rows.groupBy(*(by or [])).agg(F.count_if(F.expr("t and p")).alias("tp"), F.count_if(F.expr("not t and p")).alias("fp"), F.count_if(F.expr("t and not p")).alias("fn"), F.count_if(F.expr("not t and not p")).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.select(*(by or []), "tp", "fp", "fn", "tn", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r)).alias("f_beta"), rounded((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"))


def threshold_sweep(df: DataFrame, score: Column, protected: Column, cuts: list[float]) -> DataFrame:
    """At each cut: protected rows lost and other rows caught below it.

    A row is counted once, under the first cut above its score; the cuts' counts are running sums of those.
    """
    ordered = sorted(cuts)
    first = reduce(lambda e, c: e.when(F.col("s") < c, c), ordered, F.when(F.lit(False), 0.0))
    counts = df.select(score.alias("s"), protected.alias("keep")).groupBy(first.alias("cut")).agg(F.count_if(F.expr("keep")).alias("lost"), F.count_if(F.expr("not keep")).alias("caught"))
    table = df.sparkSession.createDataFrame([(c,) for c in ordered], "cut double").join(counts, "cut", "left")
    upto = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    return table.select("cut", F.sum(F.coalesce("lost", F.lit(0))).over(upto).alias("lost"), F.sum(F.coalesce("caught", F.lit(0))).over(upto).alias("caught"))


def safe_cut(sweep: DataFrame, floor: float) -> DataFrame:
    """The highest cut from ``floor`` on that loses no protected row, and what it catches; no row if every cut loses one."""
    return sweep.where((F.col("cut") >= floor) & (F.col("lost") == 0)).orderBy(F.desc("cut")).limit(1)


def sessions(df: DataFrame, by: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Gaps and islands: a new session where the gap exceeds the limit; session number, span and size."""
    order = Window.partitionBy(*by).orderBy(ts)
    # A difference of timestamps keeps fractions of a second; whole seconds would let a gap just above the limit pass.
    gap = F.col(ts) - F.lag(ts).over(order)
    marked = df.withColumn("opens", F.when(gap.isNull() | (gap > F.lit(timedelta(seconds=gap_seconds))), 1).otherwise(0)).withColumn("session", F.sum("opens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
