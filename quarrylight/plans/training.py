"""Registered queries over alert documents and training rows, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import alerts as A
from quarrylight.operators import audit as U
from quarrylight.operators import heads as H
from quarrylight.operators import training as T
from quarrylight.operators.scoring import language
from quarrylight.plans.replies import TIDY
from quarrylight.plans.reports import has_sql, language_sql, report_sql, report_text
from quarrylight.plans.tables import read, read_texts

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LONG = "The driller was hit by the tong while the crew was making up a joint and this was seen by all. "


@query(f"""
WITH p AS (SELECT page_id, page_id % 6 AS k, page_id::VARCHAR AS n FROM pages WHERE page_id % 6 <> 5)
SELECT page_id, CASE WHEN k = 1 THEN 'attachment' ELSE 'html' END AS text_source, CASE k WHEN 2 THEN 'Fire at pump ' || n WHEN 3 THEN '19-' || lpad((page_id % 90 + 10)::VARCHAR, 2, '0') || ' Finger caught, LTI' ELSE 'Page ' || n END AS title,
  CASE k WHEN 2 THEN 'OISD/SA/2019-20/PL/' || lpad((page_id % 100)::VARCHAR, 2, '0') WHEN 3 THEN '19-' || lpad((page_id % 90 + 10)::VARCHAR, 2, '0') WHEN 4 THEN 'R' || n END AS reference, CASE WHEN k IN (2, 3) THEN 2019 WHEN k = 4 THEN 2020 END AS year,
  CASE k WHEN 2 THEN '2019-' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') WHEN 3 THEN '2019' WHEN 4 THEN '2020-05-01' END AS date, CASE k WHEN 2 THEN 'injury' WHEN 3 THEN 'lost_time_injury' WHEN 4 THEN 'fatality' END AS actual_outcome,
  CASE k WHEN 3 THEN 'injury' WHEN 4 THEN 'fatal' ELSE 'incident' END AS record_type, CASE WHEN k = 0 THEN 'Safe Mechanical Lifting|Driving' ELSE '' END AS rules, CASE WHEN k = 0 THEN 'The sling of hook ' || n || ' was worn.' END AS what_went_wrong,
  CASE WHEN k = 1 THEN md5(trim(repeat('{LONG}', 3))) END AS attached_md5, k = 4 AS off_domain, k = 2 AS has_location FROM p""")
def alert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert documents of every page: sections, attachments of two languages, header blocks, numbered titles, ships' bulletins, and texts too short."""
    key = F.col("page_id")
    n, k = key.cast("string"), key % 6
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    padding = F.repeat(F.lit("It was dark on the deck that day. "), 12)
    page = (
        F.when(k == 0, F.concat(F.lit("What happened\nA load was lifted over the deck with hook "), n, F.lit(" while two men stood by and looked on.\nWhat went wrong\nThe sling of hook "), n, F.lit(" was worn.\nActions\nLife-saving rules: Lifting Operations and Driving\n"), padding))
        .when(k == 2, F.concat(F.lit("OISD/SA/2019-20/PL/"), key % 100, F.lit(" dated "), key % 28 + 1, F.lit("."), key % 12 + 1, F.lit(".2019\nTitle: Fire at pump "), n, F.lit("\nLocation: Plant\nOutcome: Two men burnt\nThe flange let go while the line was opened by two men who had no permit.")))
        .when(k == 3, F.lit("The hand of the man was caught by the door as it was closed by the wind on deck."))
        .when(k == 4, F.lit("The diver died at once when the bell was let down to the bed of the sea by the crew.")).when(k == 1, F.lit("See the file.")).otherwise(F.lit("Too short"))
    )
    files = F.when(k.isin(0, 1), F.array(F.struct(F.lit("a.pdf").alias("file"), F.repeat(F.lit(LONG), 3).alias("text")), F.struct(F.lit("b.pdf").alias("file"), F.lit("El trabajador fue golpeado por la tenaza y se cayó al suelo con los otros que estaban allí.").alias("text"))))
    title = F.when(k == 3, F.concat(F.lit("19-"), two(key % 90 + 10), F.lit(" Finger caught, LTI"))).otherwise(F.concat(F.lit("Page "), n))
    alerts = read(spark, sf_dir, "pages").select(
        "page_id", title.alias("title"), F.when(k == 4, "2020-05-01").alias("date"), F.when(k == 4, F.concat(F.lit("R"), n)).alias("reference"), F.lit(None).cast("array<string>").alias("tags"), page.alias("html_text"), files.alias("attachments"),
        (k == 0).alias("prefer_page"), (k == 4).alias("marine"), (k == 2).alias("board"),
    )
    found = A.alert_documents(alerts)
    attached = F.when(F.col("text_source") == "attachment", F.md5("body"))
    return found.select("page_id", "text_source", "title", "reference", "year", "date", "actual_outcome", "record_type", F.array_join("life_saving_rules", "|").alias("rules"), "what_went_wrong", attached.alias("attached_md5"), "off_domain", F.col("location").isNotNull().alias("has_location"))


@query(rf"""
WITH d AS (SELECT conv_id, turn, {TIDY} AS t FROM conversations), w AS (SELECT *, regexp_extract_all(t, '\w+(?:[-_]\w+)*|[^\w\s]') AS w FROM d),
x AS (SELECT *, len(w) AS n, len(w) > 0 AND substr(t, length(w[1]) + 1, 1) NOT IN (' ', '') AND length(w[2]) = 1 AS next FROM w),
s AS (SELECT *, n = 0 OR n > 380 AS long, list_sort(list_filter([{{'a': 0, 'b': 0, 'c': 'energy source'}}, CASE WHEN n <= 12 THEN {{'a': 0, 'b': n - 1, 'c': 'control absent'}} END, CASE WHEN next THEN {{'a': 0, 'b': 1, 'c': 'energy released'}} END], lambda y: y IS NOT NULL)) AS ner FROM x)
SELECT conv_id, turn, n AS n_tokens, CASE WHEN long THEN '' ELSE array_to_string(list_transform(ner, lambda y: y.a || '-' || y.b || ' ' || y.c), '|') END AS ner, CASE WHEN long OR next THEN 0 ELSE 1 END AS misaligned, CASE WHEN NOT long AND n > 12 THEN 1 ELSE 0 END AS wide, CASE WHEN long THEN 'length' ELSE 'kept' END AS fate FROM s""")
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token spans of every turn: of its first token, of the whole turn, and of a span that may cut a token."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]+", " "), r"\s+", " "))
    turns = read_texts(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"))
    first = F.length(F.regexp_extract("t", r"^(\w+(?:[-_]\w+)*|[^\w\s])", 1))
    span = lambda role, end: F.struct(F.lit(role).alias("role"), F.lit(0).alias("start"), end.alias("end"))
    rows = turns.withColumn("spans", F.array(span("energy_cue", first), span("control_absent", F.length("t")), span("release_cue", first + 1)))
    found = T.token_rows(rows, "t", "spans")
    shown = F.array_join(F.transform("ner", lambda s: F.concat(F.concat_ws("-", s["first"], s["last"]), F.lit(" "), s["label"])), "|")
    return found.select("conv_id", "turn", F.size("tokens").cast("long").alias("n_tokens"), shown.alias("ner"), "misaligned", "wide", "fate")


@query("""
WITH d AS (SELECT doc_id, doc_id % 5 AS k FROM documents), n AS (SELECT count(*) AS n FROM d),
r AS (SELECT doc_id, k, row_number() OVER (ORDER BY k DESC, sha1(doc_id::VARCHAR), doc_id) AS place FROM d WHERE k > 0)
SELECT doc_id, k::INTEGER AS scarce FROM r, n WHERE place <= floor(n.n * 0.5)::BIGINT""")
def weak_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak rows that may be trained with: those with most scarce roles first, half as many as there are real ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("scarce"))
    label = lambda name: F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(name).alias("label"))
    rows = docs.withColumn("ner", F.concat(F.array(label("energy source")), F.array_repeat(label("control absent"), F.col("scarce"))))
    return T.balanced_weak(rows, rows.count(), "doc_id").select("doc_id", "scarce")


SIGNALS = {"positive": "control_present", "negative": "control_absent", "none": None}


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, c_mktsegment AS s, c_name AS n FROM customer)
SELECT c_custkey, CASE WHEN k < 3 THEN s END AS term, CASE WHEN k < 2 THEN n ELSE '' END AS variants, CASE WHEN k = 0 THEN 'barrier' ELSE 'other' END AS category, CASE WHEN k = 0 THEN 'control_present' END AS role,
  CASE k WHEN 0 THEN '' WHEN 1 THEN 'unexpected: more|category: magic|confidence: sure|signal: odd' WHEN 2 THEN 'missing: category,confidence,example_line,lsr,meaning,safety_signal,source_hint,variants|category: |confidence: |signal: '
  ELSE 'missing: category,confidence,example_line,lsr,meaning,safety_signal,source_hint,term,variants|no term|category: |confidence: |signal: ' END AS problems FROM c""")
def glossary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary entries of four kinds checked: whole, odd, bare and broken."""
    k = F.col("c_custkey") % 4
    rest = ', "meaning": "m", "example_line": "e", "lsr": "l", "source_hint": "h"'
    whole = lambda more: F.concat(F.lit('{"term": "'), "c_mktsegment", F.lit('", "variants": ["'), "c_name", F.lit(' ", "'), "c_name", F.lit(f'"]{rest}, {more}}}'))
    json = F.when(k == 0, whole('"category": "Barrier", "safety_signal": "Positive", "confidence": "HIGH"')).when(k == 1, whole('"category": "magic", "safety_signal": "odd", "confidence": "sure", "more": 1')).when(k == 2, F.concat(F.lit('{"term": " '), "c_mktsegment", F.lit('"}'))).otherwise("{broken")
    found = T.checked_entries(read(spark, sf_dir, "customer").select("c_custkey", json.alias("j")), "j", SIGNALS)
    return found.select("c_custkey", "term", F.array_join("variants", "|").alias("variants"), "category", "role", F.array_join("problems", "|").alias("problems"))


@query()
def balanced_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out labels and predictions of a class-balanced head on the vectors, counted."""
    vectors = read(spark, sf_dir, "embeddings")
    head = H.fit_head(vectors.where("vec_id % 4 <> 2"), "embedding", "label")
    return head.scored(vectors.where("vec_id % 4 = 2"), "embedding").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _share_sql(n: str, total: str = "n") -> str:
    return f"CASE WHEN {total} > 0 THEN round_even(100 * {n} / {total}, 0)::BIGINT || '%' ELSE 'n/a' END"


def _top_sql(items: dict[str, str], most: int) -> str:
    """The first of 'name:n', the highest first, by name among equals."""
    rows = ", ".join(f"{{'n': -({expr}), 'name': '{name}'}}" for name, expr in items.items())
    return f"array_to_string(list_transform(list_slice(list_sort(list_filter([{rows}], lambda x: x.n < 0)), 1, {most}), lambda x: x.name || ':' || -x.n), ' ')"


LANGS = ["english", "hinglish", "hindi", "assamese_mix"]
AUDIT_SUMS = {
    "n": "count(*)", "words": "sum(w)", "long": "count(*) FILTER (w > 300)", "short": "count(*) FILTER (w < 15)", "relevant": "count(*) FILTER (relevant)", "energy": "count(*) FILTER (e > 0)", "multi": "count(*) FILTER (e > 1)",
    **{m: f"count(*) FILTER ({has_sql(p)})" for m, p in U.MEASURES.items()}, **{f"l_{x}": f"count(*) FILTER (lang = '{x}')" for x in LANGS}, **{f"d_{x}": f"count(*) FILTER ({has_sql(p)})" for x, p in U.DOMAINS.items()},
}
KIND_SQL = "(['near_miss', 'fatal', 'incident', 'injury', 'drill', 'audit', 'other', 'first_aid'])[doc_id % 8 + 1]"


@query(f"""
WITH d AS (SELECT doc_id, coalesce(source, '?') AS source, {KIND_SQL} AS kind, {report_sql('doc_id')} AS t FROM documents),
m AS (SELECT source, kind, t, len(regexp_extract_all(t, '\\S+')) AS w, {language_sql()} AS lang, regexp_matches(t, '(?i)\\b(rig|drill|crane)') AS relevant, {' + '.join(f"{has_sql(p)}::INT" for p in U.ENERGY.values())} AS e FROM d),
b AS (SELECT source, kind, {', '.join(f'{e} AS {n}' for n, e in AUDIT_SUMS.items())} FROM m GROUP BY 1, 2), a AS (SELECT * FROM b UNION ALL SELECT '(all)', kind, {', '.join(f'sum({n})' for n in AUDIT_SUMS)} FROM b GROUP BY kind),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, kind) AS place FROM a),
s AS (SELECT source, {', '.join(f'sum({n})::BIGINT AS {n}' for n in AUDIT_SUMS)}, count(*) AS n_kinds, string_agg(kind || ':' || n, ' ' ORDER BY n DESC, kind) FILTER (place <= 6) AS record_types FROM r GROUP BY 1)
SELECT source, n, {_share_sql('relevant')} AS relevant, {_share_sql('energy')} AS energy_cue, multi AS multi_energy_rows, {', '.join(f'{_share_sql(m)} AS {m}' for m in U.MEASURES)}, round_even(words / n, 0)::BIGINT AS avg_words, {_share_sql('long')} AS over_300_words, {_share_sql('short')} AS under_15_words,
  n_kinds, {_top_sql({x: f'l_{x}' for x in LANGS}, 4)} AS language, {_top_sql({x: f'd_{x}' for x in U.DOMAINS}, 4)} AS top_domains, record_types FROM s""")
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve measures and three nested counters of each source of reports, and of all."""
    kind = F.element_at(F.array(*map(F.lit, ["near_miss", "fatal", "incident", "injury", "drill", "audit", "other", "first_aid"])), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", "source", report_text("doc_id").alias("t"))
    found = U.source_audit(docs, "source", "t", kind, language(F.col("t")), LANGS, U.DOMAINS, F.col("t").rlike(r"(?i)\b(rig|drill|crane)"))
    return found.withColumns({c: F.array_join(c, " ") for c in ("language", "top_domains", "record_types")})


TARGETS = {"Hot Work": 5, "Driving": 100_000}


@query(f"""
WITH d AS (SELECT {report_sql('doc_id')} AS t FROM documents), c AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule, count(*) FILTER ({has_sql(p)}) AS n, {TARGETS.get(r, 0)}::BIGINT AS target FROM d" for r, p in U.RULES.items())})
SELECT rule, n, target, greatest(target - n, 0) AS gap, CASE WHEN n = 0 THEN 'missing' WHEN n < 150 OR n < target THEN 'thin' ELSE 'ok' END AS status FROM c""")
def rule_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that speak of each rule against targets."""
    return U.rule_gaps(read_texts(spark, sf_dir, "documents").select(report_text("doc_id").alias("t")), "t", TARGETS)


@query("""
WITH p AS (SELECT c_mktsegment AS source, CASE WHEN c_custkey % 3 = 0 THEN 'label' ELSE 'rewind' END AS job, count(*) AS n FROM customer GROUP BY 1, 2),
j AS (SELECT job, sum(CASE WHEN source = 'BUILDING' THEN least(n, 20) ELSE n END)::BIGINT AS seeds FROM p GROUP BY 1),
e AS (SELECT job, seeds, round_even(seeds * CASE WHEN job = 'rewind' THEN 4 * 0.7::DOUBLE ELSE 0.8::DOUBLE END, 0)::BIGINT AS expected FROM j UNION ALL SELECT 'generate', 0, 450 UNION ALL SELECT 'agree', 0, 0),
t AS (SELECT * FROM e UNION ALL SELECT '(total)', sum(seeds)::BIGINT, sum(expected)::BIGINT FROM e)
SELECT job, seeds, expected, CASE WHEN job = '(total)' THEN (expected - round_even(expected * 0.08::DOUBLE, 0))::BIGINT END AS usable, CASE WHEN job = '(total)' THEN 5000::BIGINT END AS target, CASE WHEN job = '(total)' THEN expected - round_even(expected * 0.08::DOUBLE, 0) >= 5000 END AS ok FROM t""")
def seed_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the seeds of each job will yield."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source"), F.when(F.col("c_custkey") % 3 == 0, "label").otherwise("rewind").alias("job"))
    return U.sufficiency(rows, "source", "job", {"BUILDING": 20}, {"generate": 0.9, "rewind": 0.7, "label": 0.8, "agree": 0.5}, {"rewind": 4}, 500, 5000)
