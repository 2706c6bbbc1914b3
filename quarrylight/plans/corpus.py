"""Registered queries over texts, pages and vectors, and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions.spans import matches
from quarrylight.operators import corpus as C
from quarrylight.operators.dedup import exact_duplicates, mark_duplicates, near_pairs, shared_folder
from quarrylight.operators.scoring import ASSAMESE, HINGLISH, language, score
from quarrylight.plans.tables import read, read_texts
from quarrylight.sources import html as H
from quarrylight.sources.files import unify
from quarrylight.streaming.events import read_stream, run_complete, windowed_counts

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


KEY = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'))"


@query(rf"SELECT doc_id, sha1({KEY}) AS key_sha1, len(list_filter(string_split({KEY}, ' '), lambda w: w <> '')) AS n_words FROM documents")
def normalised_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplication key and word count of each text."""
    key = T.dedup_key(F.coalesce("text", F.lit("")))
    return read_texts(spark, sf_dir, "documents").select("doc_id", F.sha1(key).alias("key_sha1"), T.word_count(key).cast("long").alias("n_words"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM conversations WHERE text IS NOT NULL")
def clean_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed in every turn."""
    clean = T.collapse_ws(F.col("text"))
    return read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", clean.alias("clean"), F.length(clean).cast("long").alias("n"))


@query(rf"""
WITH k AS (SELECT doc_id, n_chars, {KEY} AS key FROM documents)
SELECT doc_id, CASE WHEN key = '' THEN doc_id ELSE first_value(doc_id) OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) END AS canonical FROM k""")
def exact_duplicate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_texts(spark, sf_dir, "documents"), "doc_id", "text", F.col("n_chars"))


PAIRS = rf"""
k AS (SELECT doc_id, {KEY} AS key FROM documents), s AS (SELECT min(doc_id) AS id, key FROM k WHERE key <> '' GROUP BY key),
w AS (SELECT id, string_split(key, ' ') AS w FROM s),
g AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT a, b, shared, x.n + y.n - shared AS total FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared))"""


@query(f"WITH {PAIRS} SELECT a, b, shared, total FROM p")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct report texts at the reference's own threshold."""
    docs = read_texts(spark, sf_dir, "documents")
    first = exact_duplicates(docs, "doc_id", "text", F.lit(0)).where("doc_id = canonical").select("doc_id")
    return near_pairs(docs.join(first, "doc_id", "left_semi"), "doc_id", "text", 85).withColumn("shared", F.col("shared").cast("long")).withColumn("total", F.col("total").cast("long"))


@query(f"""
WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, other) AS (SELECT id, id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other), root AS (SELECT id, min(other) AS root FROM r GROUP BY 1),
x AS (SELECT doc_id, key, CASE WHEN key = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY key) END AS canonical FROM k)
SELECT doc_id, source, coalesce(canonical <> doc_id OR root <> doc_id, false) AS is_duplicate,
  CASE WHEN canonical <> doc_id THEN canonical WHEN root <> doc_id THEN root END AS duplicate_of, CASE WHEN canonical <> doc_id THEN 'exact' WHEN root <> doc_id THEN 'near' END AS dup_kind
FROM x JOIN documents USING (doc_id) LEFT JOIN root ON root.id = x.doc_id""")
def marked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mark_duplicates(docs, "doc_id", "text").drop("text")


@query(rf"""
WITH t AS (SELECT DISTINCT doc_id, lang, unnest(list_filter(string_split({KEY}, ' '), lambda w: length(w) >= 3)) AS term FROM documents),
c AS (SELECT lang, term, count(*) AS n, sum(count(*)) OVER (PARTITION BY term) AS total FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS k FROM c WHERE n >= 5 AND n >= 0.55 * total)
SELECT lang, term, n, round(n / total, 6) AS share FROM r WHERE k <= 400""")
def mined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mine_terms(read_texts(spark, sf_dir, "documents"), "text", "lang", 5, 0.55, 400)


@query(rf"""
WITH w AS (SELECT source, list_filter(string_split({KEY}, ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT source, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i : i + 5], ' '))) AS g FROM w WHERE len(w) >= 6),
c AS (SELECT source, g, count(*) AS n FROM g GROUP BY 1, 2)
SELECT source, count(*) AS ngrams, count(*) FILTER (n >= 3) AS reused, max(n) AS most FROM c GROUP BY 1""")
def reused_sixgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reused_ngrams(read_texts(spark, sf_dir, "documents"), "text", ["source"], 6, 3)


@query(rf"""
WITH w AS (SELECT doc_id, list_filter(string_split({KEY}, ' '), lambda x: x <> '') AS w FROM documents),
m AS (SELECT doc_id, w, len(w) AS n, least(50, len(w)) AS k FROM w WHERE len(w) > 0)
SELECT doc_id, n AS words, len(list_distinct(w)) / n AS ttr,
  list_sum(list_transform(range(1, n - k + 2), lambda i: len(list_distinct(w[i : i + k - 1]))))::BIGINT / k / (n - k + 1) AS mattr FROM m""")
def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lexical_diversity(read_texts(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"""
WITH m AS (SELECT source, sha1({KEY}) AS k, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
c AS (SELECT source, count(*) AS rows, count(*) FILTER (w = 0) AS empty, count(*) FILTER (w < 8) AS short, count(*) - count(DISTINCT k) AS duplicates, count(quality) AS labelled FROM m GROUP BY 1)
SELECT *, round(labelled / rows, 6) AS coverage, CASE WHEN rows < 20 THEN 'thin' WHEN duplicates > rows * 0.1 THEN 'repetitive' ELSE 'ok' END AS status FROM c""")
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return C.source_audit(read_texts(spark, sf_dir, "documents").join(labels, "doc_id", "left"), "source", "text", "quality")


@query("""SELECT t.lang, coalesce(c.n, 0) AS n, t.target, round(coalesce(c.n, 0) / (SELECT count(*) FROM documents), 6) AS share, greatest(0, t.target - coalesce(c.n, 0)) AS shortfall
FROM (VALUES ('en', 500::BIGINT), ('fr', 300::BIGINT), ('hi', 100::BIGINT)) t(lang, target) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) c USING (lang)""")
def quota_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quota_report(read_texts(spark, sf_dir, "documents"), "lang", {"en": 500, "fr": 300, "hi": 100})


def _count(lang: str) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in C.STOP_WORDS[lang])})))"


@query(rf"""
WITH w AS (SELECT doc_id, lang, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}]+') AS w FROM documents),
s AS (SELECT doc_id, lang, {', '.join(f'{_count(x)} AS {x}' for x in sorted(C.STOP_WORDS))} FROM w)
SELECT lang, CASE WHEN greatest(de, en, es, fr) < 2 THEN 'unknown' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS found, count(*) AS n FROM s GROUP BY 1, 2""")
def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop-word language against the stated one."""
    docs = read_texts(spark, sf_dir, "documents")
    return docs.select("lang", C.stop_word_language(F.coalesce("text", F.lit(""))).alias("found")).groupBy("lang", "found").agg(F.count(F.lit(1)).alias("n"))


TERMS = "idiot|moron|password|license|the"


@query(rf"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?i)({TERMS})') AS m, string_split_regex(text, '(?i)({TERMS})') AS g FROM documents),
u AS (SELECT doc_id, unnest(m) AS hit, unnest(g[1 : len(m)]) AS gap, unnest(range(len(m))) AS k FROM m WHERE len(m) > 0),
e AS (SELECT doc_id, k, length(hit) AS n, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e FROM u)
SELECT doc_id, count(*) AS n, sum(n)::BIGINT AS chars, sha1(string_agg((e - n) || ':' || e, ',' ORDER BY k)) AS spans_sha1 FROM e GROUP BY 1""")
def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term spans by document, with a digest of all their offsets."""
    found = read_texts(spark, sf_dir, "documents").select("doc_id", matches(F.col("text"), f"({TERMS})").alias("m")).where(F.size("m") > 0)
    offsets = F.array_join(F.transform("m", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("chars"), F.sha1(offsets).alias("spans_sha1"))


def _in_words(words: str) -> str:
    return f"list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words.split('|'))}))"


@query(rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents), h AS (SELECT *, {_in_words(HINGLISH)} AS h, {_in_words(ASSAMESE)} AS a FROM w)
SELECT doc_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hindi' WHEN len(regexp_extract_all(text, '[ঀ-৿]')) + len(a) >= 2 THEN 'assamese_mix' WHEN len(h) >= 2 AND len(list_filter(h, lambda x: x <> 'the')) > 0 THEN 'hinglish' ELSE 'english' END AS language FROM h""")
def scored_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer's own language test on every document."""
    return read_texts(spark, sf_dir, "documents").select("doc_id", language(F.coalesce("text", F.lit(""))).alias("language"))


@query()
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, confidence, route and flags of every document, rules only."""
    scored = score(read_texts(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "language", "statement_type", F.col("hazard.name").alias("hazard_name"), "verdict", "confidence", "route", "review_required", "barrier_failure_mode", "negation_scope", "unsafe_act", "unsafe_condition", F.size("spans").alias("n_spans"))


@query()
def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of conversation turns by role."""
    scored = score(read_texts(spark, sf_dir, "conversations"))
    return scored.groupBy("role", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if("review_required").alias("to_review"))


SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


@query(rf"""
WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]+)', 1)) AS h FROM pages),
a AS (SELECT page_id, CASE WHEN regexp_matches(h, '{SCHEME}') THEN h WHEN h LIKE '//%' THEN regexp_extract(url, '{SCHEME}') || h WHEN h LIKE '/%' THEN regexp_extract(url, '{SCHEME}//[^/?#]+') || h
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END AS l FROM h),
l AS (SELECT page_id, string_agg(DISTINCT l, ' ' ORDER BY l) AS links FROM a WHERE NOT regexp_matches(l, '(?i)^(javascript|mailto|data):') GROUP BY 1)
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, coalesce(links, '') AS links FROM pages LEFT JOIN l USING (page_id)""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and absolute links of every page."""
    found = F.array_join(F.array_sort(H.links(F.col("html"), F.col("url"))), " ")
    return read_texts(spark, sf_dir, "pages").select("page_id", F.coalesce(H.title(F.col("html")), F.lit("")).alias("title"), found.alias("links"))


def _visible_sql() -> str:
    text = "html"
    for element in H.DROPPED.split("|"):
        text = rf"regexp_replace({text}, '<{element}\b[^>]*>.*?</{element}\s*>', ' ', 'gis')"
    text = rf"regexp_replace(regexp_replace({text}, '<!--.*?-->', ' ', 'gs'), '<br\s*/?>|</(p|div|li|h[1-6]|tr|article|section)\s*>', chr(10), 'gi')"
    text = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    for entity, plain in H.ENTITIES.items():
        quoted = plain.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    lines = rf"list_transform(string_split(regexp_replace({text}, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x0B\f]+', ' ', 'g')))"
    return rf"trim(regexp_replace(array_to_string({lines}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'))"


@query(rf"""
WITH t AS (SELECT page_id, {_visible_sql()} AS text, trim(regexp_replace(lower(regexp_replace(url, '^[a-z]+://', '')), '[^a-z0-9]+', '-', 'g'), '-')[1 : 80] AS slug,
  coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+(?:published_time|date)["''][^>]+content=["''](\d{{4}}-\d\d-\d\d)', 1), ''), nullif(regexp_extract(html, '(?i)<time[^>]+datetime=["''](\d{{4}}-\d\d-\d\d)', 1), ''), nullif(regexp_extract(html, '\b(\d{{4}}-\d\d-\d\d)\b', 1), '')) AS d FROM pages)
SELECT page_id, slug, TRY_CAST(d AS DATE) AS page_date, length(text) AS n_chars, sha1(text) AS text_sha1 FROM t""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text, date and file name of every page."""
    pages = read_texts(spark, sf_dir, "pages")
    text = H.visible_text(F.col("html"))
    return pages.select("page_id", H.slug(F.col("url")).alias("slug"), H.page_date(F.col("html")).alias("page_date"), F.length(text).cast("long").alias("n_chars"), F.sha1(text).alias("text_sha1"))


@query("""
SELECT 'customer' AS source, c_custkey AS id, c_name AS text, c_mktsegment AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier
UNION ALL SELECT 'part', p_partkey, p_name, p_type FROM part UNION ALL SELECT 'nation', n_nationkey, n_name, NULL FROM nation""")
def unified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources in one schema."""
    parts = [("customer", "c_custkey", "c_name", "c_mktsegment"), ("supplier", "s_suppkey", "s_name", None), ("part", "p_partkey", "p_name", "p_type"), ("nation", "n_nationkey", "n_name", None)]
    return unify([read(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).cast("long").alias("id"), F.col(n).alias("text"), *([F.col(x).alias("label")] if x else [])) for t, k, n, x in parts])


@query("""SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS parsed, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1""")
def parsed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties by a declared schema."""
    k = F.from_json("props", "k long")["k"]
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("parsed"), F.sum(k).alias("total"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS parsed FROM orders""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates read back from four written forms."""
    d, form = F.col("o_orderdate"), F.col("o_orderkey") % 4
    written = F.when(form == 0, F.date_format(d, "yyyy-MM-dd")).when(form == 1, F.date_format(d, "dd/MM/yyyy")).when(form == 2, F.date_format(d, "d MMMM yyyy")).otherwise(F.concat(F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy")))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(written).alias("parsed"))


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT label AS proto_label, v AS p FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
s AS (SELECT vec_id, proto_label, max(list_inner_product(v, p) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(p, p))) AS cos FROM v CROSS JOIN p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, proto_label) AS k FROM s)
SELECT vec_id, max(proto_label) FILTER (k = 1) AS best, round(max(cos) FILTER (k = 1), 6) AS score, max(cos) FILTER (k = 1) >= 0.45 AND max(cos) FILTER (k = 1) - coalesce(max(cos) FILTER (k = 2), -1) >= 0.05 AS accepted FROM r GROUP BY 1""")
def nearest_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.operators.analytics import capped

    vectors = read(spark, sf_dir, "embeddings")
    prototypes = capped(vectors, ["label"], [F.asc("vec_id")], 3).select(F.col("label").alias("proto_label"), F.col("embedding").alias("proto"))
    return C.nearest_prototypes(vectors, prototypes, 0.45, 0.05)


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by event type from a stream over the events; beyond what users run today."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "events").schema
    events = read_stream(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    run_complete(windowed_counts(events, "ts", ["event_type"], "1 day", "0 seconds"), f"{out}/rows", f"{out}/state")
    return spark.read.schema("window_start timestamp, event_type string, n long").parquet(f"{out}/rows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
