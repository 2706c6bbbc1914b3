"""Registered analytics queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import analytics as A
from quarrylight.plans.tables import order_facts, order_verdicts, read

FACTS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""
WITH cells AS (SELECT o_orderpriority AS precursor, n_name AS site, count(*) AS a FROM {FACTS} GROUP BY 1, 2),
f AS (SELECT *, sum(a) OVER (PARTITION BY site)::BIGINT - a AS b, sum(a) OVER (PARTITION BY precursor)::BIGINT - a AS c,
  (sum(a) OVER () - sum(a) OVER (PARTITION BY site) - sum(a) OVER (PARTITION BY precursor) + a)::BIGINT AS d FROM cells),
r AS (SELECT *, CASE WHEN a > 0 AND c > 0 THEN (a / (a + b)) / (c / (c + d)) END AS p, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) AS e FROM f)
SELECT precursor, site, a, b, c, d, round(p, 6) AS prr, round(exp(ln(p) - 1.96 * e), 6) AS ci_lower, round(exp(ln(p) + 1.96 * e), 6) AS ci_upper,
  coalesce(exp(ln(p) - 1.96 * e) > 1 AND a >= 3, false) AS flagged FROM r""")
def prr_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prr_all(order_facts(spark, sf_dir), "o_orderpriority", "n_name")


def cusum_sql(source: str, series: str, period: str) -> str:
    return f"""
WITH n AS (SELECT {series}, {period} AS period, count(*) AS x FROM {source} GROUP BY ALL),
m AS (SELECT *, count(*) OVER w AS periods, avg(x) OVER w AS mean, coalesce(stddev_pop(x) OVER w, 0) AS sd FROM n WINDOW w AS (PARTITION BY {series})),
c AS (SELECT *, sum(x - mean - 0.5 * sd) OVER (PARTITION BY {series} ORDER BY period) AS c FROM m WHERE periods >= 2),
s AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY {series} ORDER BY period)) AS v FROM c)
SELECT {series}, period, x, round(mean, 6) AS mean, round(sd, 6) AS sd, round(v, 6) AS s, v > greatest(4 * sd, 5) AS flagged FROM s"""


@query(cusum_sql("orders", "o_orderpriority", "strftime(o_orderdate, '%Y-%m')"))
def cusum_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cusum(read(spark, sf_dir, "orders"), ["o_orderpriority"], A.month_of(F.col("o_orderdate")))


@query(cusum_sql("orders", "o_orderpriority", "strftime(o_orderdate, '%Y-%W')"))
def cusum_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cusum(read(spark, sf_dir, "orders"), ["o_orderpriority"], A.week_of(F.col("o_orderdate")))


@query(cusum_sql("events", "event_type", "strftime(ts, '%Y-%m-%d')"))
def cusum_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cusum(read(spark, sf_dir, "events"), ["event_type"], F.date_format("ts", "yyyy-MM-dd"))


def blind_sql(join: str) -> str:
    return f"""
WITH n AS (SELECT n_nationkey AS site, n_name AS site_name, count(o_orderkey) AS n FROM nation {join} (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) ON c_nationkey = n_nationkey GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN coalesce(stddev_samp(n) OVER (), 0) > 0 THEN (n - avg(n) OVER ()) / (stddev_samp(n) OVER ()) ELSE 0 END AS z FROM n)
SELECT site, site_name, n, round(z, 6) AS z, z < -2 AS flagged, CASE WHEN z < -2 THEN 'HIGH' WHEN z < -1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM z"""


@query(blind_sql("JOIN"))
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.blind_spots(order_facts(spark, sf_dir).drop("n_name"), read(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query(blind_sql("LEFT JOIN"))
def blind_spots_with_silent_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.blind_spots(order_facts(spark, sf_dir).drop("n_name"), read(spark, sf_dir, "nation"), "n_nationkey", "n_name", include_zero=True)


@query("""
SELECT c_mktsegment AS hazard, o_orderpriority AS barrier, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O",
  count(*) FILTER (o_orderstatus = 'P') AS "n_P", count(*) AS total, round(count(*) FILTER (o_orderstatus <> 'F') / count(*), 6) AS failure_rate
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def barrier_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.barrier_health(order_facts(spark, sf_dir), "c_mktsegment", "o_orderpriority", "o_orderstatus", ["F", "O", "P"], ["O", "P"])


def rules_sql(attributes: list[str], source: str, support: float, confidence: float) -> str:
    from itertools import combinations

    parts = []
    for size in range(2, len(attributes) + 1):
        for whole in combinations(attributes, size):
            for k in range(1, size):
                for left in combinations(whole, k):
                    right = [a for a in whole if a not in left]
                    text = lambda own: " || ' & ' || ".join(f"'{a}=' || {a}" for a in own)
                    parts.append(f"""SELECT {text(left)} AS antecedent, {text(right)} AS consequent, n AS n_ab,
  sum(n) OVER (PARTITION BY {', '.join(left)}) AS n_a, sum(n) OVER (PARTITION BY {', '.join(right)}) AS n_b, (SELECT count(*) FROM t) AS total
FROM (SELECT {', '.join(whole)}, count(*) AS n FROM t GROUP BY ALL)""")
    return f"""WITH t AS (SELECT {', '.join(attributes)} FROM {source}), r AS ({' UNION ALL '.join(parts)})
SELECT antecedent, consequent, round(n_ab / total, 6) AS support, round(n_ab / n_a, 6) AS confidence, round((n_ab / n_a) / (n_b / total), 6) AS lift
FROM r WHERE total >= 10 AND n_ab / total >= {support} AND n_ab / n_a >= {confidence}"""


ITEMS = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment"]


@query(rules_sql(ITEMS, "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", 0.02, 0.2))
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    facts = lines.join(order_facts(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.association_rules(facts, ITEMS, 0.02, 0.2)


@query("""
SELECT p_brand AS precursor, count(l_orderkey) AS n_reports, count(DISTINCT s_nationkey) AS n_sites, count(*) FILTER (l_returnflag = 'R') AS n_sif,
  round(count(*) FILTER (l_returnflag = 'R') / nullif(count(l_orderkey), 0), 6) AS density
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linestatus = 'O' LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def pattern_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, sites and serious share of each precursor; the residual predicate stays in the join."""
    lines = read(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    sites = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = read(spark, sf_dir, "part").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left").join(sites, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    serious = F.count_if(F.col("l_returnflag") == "R")
    return joined.groupBy(F.col("p_brand").alias("precursor")).agg(F.count("l_orderkey").alias("n_reports"), F.countDistinct("s_nationkey").alias("n_sites"), serious.alias("n_sif"), A.rounded(F.try_divide(serious, F.count("l_orderkey"))).alias("density"))


@query("""
SELECT l_orderkey, l_linenumber, p_brand, o_orderpriority, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R' AND p_brand = (SELECT min(p_brand) FROM part) ORDER BY o_orderdate DESC, l_orderkey, l_linenumber LIMIT 50""")
def pattern_reports_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest reports of one precursor."""
    part = read(spark, sf_dir, "part")
    brand = part.agg(F.min("p_brand").alias("p_brand"))
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    joined = lines.join(part.join(F.broadcast(brand), "p_brand", "left_semi"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.page(joined.select("l_orderkey", "l_linenumber", "p_brand", "o_orderpriority", "o_orderdate"), [F.desc("o_orderdate"), F.col("l_orderkey"), F.col("l_linenumber")], 1, 50)


QUEUE = "orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


@query(f"SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate FROM {QUEUE}")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    acted = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.review_queue(order_verdicts(spark, sf_dir), acted, "o_orderkey").drop("review_required", "is_current")


@query(f"SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate FROM {QUEUE} ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25")
def review_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page by verdict name, then newest first."""
    return A.page(review_queue(spark, sf_dir), [F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")], 2, 25)


@query(f"""SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'insufficient' END AS bucket,
  count(*) AS n FROM {QUEUE} GROUP BY 1""")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open verdicts by bucket."""
    p = F.col("o_orderpriority")
    bucket = F.when(p.isin("1-URGENT", "2-HIGH"), "high").when(p == "3-MEDIUM", "medium").when(p == "5-LOW", "low").otherwise("insufficient")
    return review_queue(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, o_orderdate, o_orderpriority, l_linenumber, l_returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1
ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their current verdict, newest first."""
    current = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_returnflag")
    joined = read(spark, sf_dir, "orders").join(current, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return A.page(joined.select("o_orderkey", "o_orderdate", "o_orderpriority", "l_linenumber", "l_returnflag"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 1, 100)


@query("""
SELECT o_orderkey, o_orderstatus, count(l_linenumber) AS n_spans, coalesce(string_agg(l_linenumber::VARCHAR || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS spans
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def report_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report with its spans nested in order."""
    spans = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("own"))
    joined = read(spark, sf_dir, "orders").join(spans, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    shown = F.array_join(F.transform("own", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_returnflag"])), ",")
    return joined.select("o_orderkey", "o_orderstatus", F.coalesce(F.size("own"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce(shown, F.lit("")).alias("spans")).withColumn("n_spans", F.greatest("n_spans", F.lit(0).cast("long")))


@query("""
SELECT n_nationkey AS site, n_name AS site_name, r_name AS region, count(o_orderkey) AS n_reports, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_sif,
  round(coalesce(count(*) FILTER (o_orderpriority = '1-URGENT') / nullif(count(o_orderkey), 0), 0), 6) AS sif_density
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sites with their report counts and real densities."""
    counts = order_facts(spark, sf_dir).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_reports"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_sif"))
    sites = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).join(counts, "n_nationkey", "left").na.fill(0, ["n_reports", "n_sif"])
    return sites.select(F.col("n_nationkey").alias("site"), F.col("n_name").alias("site_name"), F.col("r_name").alias("region"), "n_reports", "n_sif", A.rounded(F.coalesce(F.try_divide("n_sif", "n_reports"), F.lit(0.0))).alias("sif_density"))


@query("""
SELECT count(*) AS total, count(*) FILTER (a = 'approve') AS approved, count(*) FILTER (a = 'correct') AS corrected,
  round(100 * count(*) FILTER (a = 'approve') / count(*), 1) AS rate
FROM (SELECT CASE l_returnflag WHEN 'N' THEN 'approve' WHEN 'R' THEN 'correct' ELSE 'escalate' END AS a FROM lineitem)""")
def agreement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return A.agreement(read(spark, sf_dir, "lineitem").select(F.when(flag == "N", "approve").when(flag == "R", "correct").otherwise("escalate").alias("a")), "a")


@query("""SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.current_rows(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("SELECT coalesce(source, 'None') AS value, count(*) AS n FROM documents GROUP BY 1")
def value_counts_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_counts(read(spark, sf_dir, "documents"), "source")


@query("""
SELECT coalesce(split_part(e, ':', 1), '(none)') AS value, count(*) AS n FROM (
  SELECT unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS e FROM (SELECT list_filter(string_split(p_name, ' '), lambda w: w > 'm') AS x FROM part)) GROUP BY 1""")
def multi_valued_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("p_name", " "), lambda w: w > "m")
    return A.multi_counts(read(spark, sf_dir, "part").select(words.alias("x")), "x")


@query("""
WITH v AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT source, max(n) AS n, min(n_chars) AS least, max(n_chars) FILTER (k = n // 2) AS median, max(n_chars) FILTER (k = n * 9 // 10) AS p90, max(n_chars) AS greatest FROM v GROUP BY 1""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rank_stats(read(spark, sf_dir, "documents"), ["source"], "n_chars")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS sif FROM orders GROUP BY 1""")
def month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports and serious reports by month."""
    return read(spark, sf_dir, "orders").groupBy(A.month_of(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("sif"))


@query("""SELECT p_type AS rule, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, rule LIMIT 6""")
def rule_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent rules and their shares."""
    counts = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("rule", "n", A.rounded(F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("n"), "rule").limit(6)


@query(f"""SELECT n_name AS site, {', '.join(f"count(*) FILTER (o_orderpriority = '{p}') AS p{p[0]}" for p in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))} FROM {FACTS} GROUP BY 1""")
def site_rule_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by site and rule as a wide table."""
    values = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return order_facts(spark, sf_dir).groupBy(F.col("n_name").alias("site")).agg(*(F.count_if(F.col("o_orderpriority") == v).alias(f"p{v[0]}") for v in values))


@query("""SELECT o_orderpriority AS rule, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS breaches, count(*) FILTER (o_orderstatus = 'O') AS near_misses,
  round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS compliance FROM orders GROUP BY 1""")
def rule_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compliance, breaches and near misses of each rule."""
    s = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "P").alias("breaches"), F.count_if(s == "O").alias("near_misses"), A.rounded(100 * F.count_if(s == "F") / F.count(F.lit(1))).alias("compliance"))


@query("""
WITH m AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 21600 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM m)
SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY 1, 2""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sessions(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", 6 * 3600)


@query("""
WITH g AS (SELECT doc_id % 97 AS seed, min(lang) AS lang, min(source) AS source FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(seed::VARCHAR || ':7'), seed) AS k, count(*) OVER (PARTITION BY lang) AS n FROM g)
SELECT seed, lang, CASE WHEN k <= round_even(n * 0.1, 0) THEN 'test' WHEN k <= round_even(n * 0.1, 0) * 2 THEN 'dev' ELSE 'train' END AS split FROM r""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("seed", F.col("doc_id") % 97)
    return A.grouped_split(docs, "seed", ["lang"], 7)


@query("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY sha1(text), doc_id) - 1) % 5 AS fold FROM documents")
def class_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.folds(read(spark, sf_dir, "documents"), "doc_id", "lang", "text").withColumn("fold", F.col("fold").cast("long"))


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) <= 10")
def shortest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's per-source cap that keeps the shortest texts."""
    return A.capped(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.asc("n_chars"), F.asc("doc_id")], 10)


@query("""
WITH RECURSIVE n AS (SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'fr', 'de', 'es')) AS o FROM documents),
f(i, en, fr, de, es, o) AS (SELECT 0, en, fr, de, es, o FROM n UNION ALL SELECT i + 1, least(en, floor(0.4::DOUBLE * 1.1::DOUBLE * (en + fr + de + es + o))::BIGINT), least(fr, floor(0.2::DOUBLE * 1.1::DOUBLE * (en + fr + de + es + o))::BIGINT),
  least(de, floor(0.2::DOUBLE * 1.1::DOUBLE * (en + fr + de + es + o))::BIGINT), least(es, floor(0.2::DOUBLE * 1.1::DOUBLE * (en + fr + de + es + o))::BIGINT), o FROM f WHERE i < 60),
k AS (SELECT * FROM f WHERE i = 60), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS place FROM documents)
SELECT doc_id, lang FROM r, k WHERE place <= CASE lang WHEN 'en' THEN en WHEN 'fr' THEN fr WHEN 'de' THEN de WHEN 'es' THEN es ELSE 1 << 61 END""")
def quota_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.enforce_quotas(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}, 1.1)


SCORED = "(SELECT lang, source, toxic = 1 AS t, regexp_matches(lower(text), 'idiot|moron|stupid|trash') AS p FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"


@query(f"""WITH c AS (SELECT lang, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM {SCORED} GROUP BY 1),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS rc FROM c)
SELECT lang, tp, fp, fn, tn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(5 * pr * rc / nullif(4 * pr + rc, 0), 6) AS f_beta, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM m""")
def metrics_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion, precision, recall, F2 and accuracy of a word-list rule against the labels."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), read(spark, sf_dir, "labels").where("toxic is not null")
    return A.binary_metrics(docs.join(labels, "doc_id"), F.col("toxic") == 1, F.lower("text").rlike("idiot|moron|stupid|trash"), ["lang"])


@query("""WITH c AS (SELECT unnest([250.0, 500.0, 1000.0, 2000.0, 4000.0])::DOUBLE AS cut), d AS (SELECT n_chars::DOUBLE AS s, quality = 1 AS k FROM documents JOIN labels USING (doc_id))
SELECT cut, count(*) FILTER (k AND s < cut) AS lost, count(*) FILTER (NOT k AND s < cut) AS caught FROM c CROSS JOIN d GROUP BY 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return A.threshold_sweep(scored, F.col("n_chars").cast("double"), F.col("quality") == 1, [250.0, 500.0, 1000.0, 2000.0, 4000.0])


@query("""WITH c AS (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, 500.0])::DOUBLE AS cut), d AS (SELECT n_chars::DOUBLE AS s, quality = 1 AS k FROM documents JOIN labels USING (doc_id)),
w AS (SELECT cut, count(*) FILTER (k AND s < cut) AS lost, count(*) FILTER (NOT k AND s < cut) AS caught FROM c CROSS JOIN d GROUP BY 1)
SELECT cut, lost, caught FROM w WHERE lost = 0 AND cut >= 10 ORDER BY cut DESC LIMIT 1""")
def chosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length cut that loses no good document and catches most others."""
    scored = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return A.safe_cut(A.threshold_sweep(scored, F.col("n_chars").cast("double"), F.col("quality") == 1, [10.0, 25.0, 50.0, 100.0, 250.0, 500.0]), 10.0)


@query("""SELECT lang, round(avg(n_chars) FILTER (quality = 1), 6) AS mean_good, round(avg(n_chars) FILTER (quality = 0), 6) AS mean_bad,
  round(count(*) FILTER (quality = 1 AND n_chars < 1000) / nullif(count(*) FILTER (n_chars < 1000), 0), 6) AS p_good_short, round(covar_pop(n_chars, quality) / nullif(stddev_pop(n_chars) * stddev_pop(quality), 0), 6) AS r
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def length_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether length gives the label away: conditional means, shares and correlation."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    good, short = F.col("quality") == 1, F.col("n_chars") < 1000
    return d.groupBy("lang").agg(A.rounded(F.avg(F.when(good, F.col("n_chars")))).alias("mean_good"), A.rounded(F.avg(F.when(F.col("quality") == 0, F.col("n_chars")))).alias("mean_bad"), A.rounded(F.try_divide(F.count_if(good & short), F.count_if(short))).alias("p_good_short"), A.rounded(F.try_divide(F.covar_pop("n_chars", "quality"), F.stddev_pop("n_chars") * F.stddev_pop("quality"))).alias("r"))
