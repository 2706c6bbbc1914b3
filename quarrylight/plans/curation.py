"""Registered queries over joins, plans and metrics around labelled reports, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import reports as P
from quarrylight.functions.spans import matches
from quarrylight.operators import curation as C
from quarrylight.operators.corpus import quota_report
from quarrylight.plans.corpus import KEY, PAIRS
from quarrylight.plans.registers import dealt, dealt_sql
from quarrylight.plans.tables import read, read_texts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Raw values as registers hold them, dealt over the parts.
RAW_RULES = ["LOTO / hot work", "Line of Fire (dropped object)", "n/a", "Work at Height; Driving", "unknown rule + Confined Space", "safe driving and lifting", "Other issue – no applicable rule", "Permit to Work", "line of fire zone", "isolation, LOTO", "", "Hot Work & hot work"]
ALIASES = {rule.lower(): rule for rule in P.RULES} | P.RULE_NAMES


@query(rf"""
WITH raw AS (SELECT p_partkey, [{', '.join(map(quoted, RAW_RULES))}][p_partkey % 12 + 1] AS raw FROM part),
l AS (SELECT p_partkey, list_filter(string_split_regex(raw, '(?i)\s*(?:/|;|,|\band\b|&|\+)\s*'), lambda x: x <> '') AS parts FROM raw),
u AS (SELECT p_partkey, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM l),
k AS (SELECT *, regexp_replace(regexp_replace(lower(trim(part)), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS key FROM u),
a AS (SELECT * FROM (VALUES {', '.join(f'({quoted(a)}, {quoted(r)})' for a, r in ALIASES.items())}) t(alias, rule)),
r AS (SELECT k.*, key IN ({', '.join(map(quoted, P.NO_RULE))}) OR replace(key, '–', '-') IN ({', '.join(map(quoted, P.NO_RULE))}) AS none,
  coalesce(x.rule, y.rule, {' '.join(['CASE', *(f'WHEN contains(key, {quoted(rule.lower())}) THEN {quoted(rule)}' for rule in P.RULES), 'END'])}) AS rule
  FROM k LEFT JOIN a x ON x.alias = key LEFT JOIN a y ON y.alias = trim(regexp_replace(key, '\(.*?\)', '', 'g'))),
f AS (SELECT p_partkey, rule, min(k) AS k FROM r WHERE NOT none AND rule IS NOT NULL GROUP BY 1, 2),
g AS (SELECT p_partkey, string_agg(rule, '|' ORDER BY k) AS rules FROM f GROUP BY 1), h AS (SELECT p_partkey, string_agg(trim(part), '|' ORDER BY k) AS unmapped FROM r WHERE NOT none AND rule IS NULL GROUP BY 1)
SELECT p_partkey, coalesce(rules, '') AS rules, coalesce(unmapped, '') AS unmapped FROM part LEFT JOIN g USING (p_partkey) LEFT JOIN h USING (p_partkey)""")
def canonical_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life-saving rules of raw register values, and what names none."""
    raw = F.element_at(F.array(*map(F.lit, RAW_RULES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    part = read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return part.select("p_partkey", F.array_join(P.canonical_rules(F.col("raw")), "|").alias("rules"), F.array_join(P.unmapped_rules(F.col("raw")), "|").alias("unmapped"))


#: Openings that reports have, dealt over the documents.
OPENINGS = ["It could have been a fatality.", "Near miss on the rig floor.", "The man died at once.", "LTI: dropped object, first aid given.", "No injury, equipment damage only.", "Nothing more.", "Worst case a death. A worker was killed in the fall.", "Medical treatment case after a fracture."]
OPENED = f"([{', '.join(map(quoted, OPENINGS))}])[doc_id % 8 + 1] || ' ' || coalesce(text, '')"


def _first_at(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(t, {quoted('(?i)' + pattern)}) THEN length(string_split_regex(t, {quoted('(?i)' + pattern)})[1]) END"


def _hedged(at: str) -> str:
    return f"regexp_matches(substr(t, greatest({at} - 80, 0) + 1, {at} - greatest({at} - 80, 0)), {quoted(P.HEDGE)})"


#: RE2 has no look-ahead: "dropped object" counts unless "injur" follows, so the twin masks those places.
_PLAIN = {name: p.replace(r"\b(?! injur)", r"\b") for name, p in P.OUTCOMES.items()}


@query(rf"""
WITH d AS (SELECT doc_id, {OPENED} AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, {quoted('(?i)' + P.FATALITY)}) AS m, string_split_regex(t, {quoted('(?i)' + P.FATALITY)}) AS g FROM d),
u AS (SELECT doc_id, t, unnest(m) AS hit, unnest(g[1 : len(m)]) AS gap, unnest(range(len(m))) AS k FROM m WHERE len(m) > 0),
e AS (SELECT doc_id, t, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT - length(hit) AS pos FROM u),
f AS (SELECT DISTINCT doc_id FROM e WHERE NOT {_hedged('pos')}),
o AS (SELECT doc_id, t, {', '.join(f'{_first_at(p)} AS {n}' for n, p in _PLAIN.items())} FROM d),
p AS (SELECT doc_id, unnest([{', '.join(f"{{'at': CASE WHEN {n} IS NOT NULL AND {'true' if n == 'near_miss' else f'NOT {_hedged(n)}'} THEN {n} END, 'name': '{n}'}}" for n in _PLAIN)}]) AS x FROM o),
b AS (SELECT doc_id, arg_min(x.name, (x.at, x.name)) FILTER (x.at IS NOT NULL) AS outcome FROM p GROUP BY 1)
SELECT doc_id, f.doc_id IS NOT NULL AS fatal, outcome, CASE WHEN f.doc_id IS NOT NULL THEN 'fatal' WHEN coalesce(outcome = 'near_miss', false) OR regexp_matches(t, {quoted(P.NEAR_MISS)}) THEN 'near_miss'
  WHEN coalesce(outcome IN ('lost_time_injury', 'restricted_work', 'medical_treatment', 'first_aid'), false) OR regexp_matches(t, {quoted(P.INJURY)}) THEN 'injury' ELSE 'incident' END AS record_type
FROM d JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)""")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hedged facts, outcome and record type of whole texts that open as reports do."""
    opened = F.concat(F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % 8 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", opened.alias("t"))
    t, begun = F.col("t"), F.col("begun")
    facts = docs.withColumn("begun", P.report_cues(t)).withColumns({"fatal": P.actual_fatality(t, begun), "outcome": P.outcome(t, begun)})
    return facts.select("doc_id", "fatal", "outcome", P.record_type(t, F.col("fatal"), F.col("outcome")).alias("record_type"))


@query(r"""
WITH l AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, nullif(array_to_string(lines, ' '), '') AS narrative, source AS what_went_wrong, lang AS corrective_actions FROM l""")
def alert_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of texts laid out as alerts are: headings alone on a line and before a colon or a dash."""
    laid = F.concat(F.lit("What happened?\n"), F.coalesce("text", F.lit("")), F.lit("\nRoot cause: "), F.col("source"), F.lit("\n## Lessons learned - "), F.col("lang"))
    found = read_texts(spark, sf_dir, "documents").select("doc_id", P.sections(laid).alias("s"))
    return found.select("doc_id", *(F.col("s")[name].alias(name) for name in ("narrative", "what_went_wrong", "corrective_actions")))


@query("SELECT lang, count(*) FILTER (length(trim(coalesce(text, ''))) >= 15) AS kept, count(*) FILTER (length(trim(coalesce(text, ''))) < 15) AS dropped FROM documents GROUP BY 1")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a filter on 15 characters keeps and drops."""
    return C.length_counts(read(spark, sf_dir, "documents"), ["lang"], "text")


STRONG, WEAK = "pressure|license|password", "water|people|the|time"


@query(f"""SELECT doc_id, (2 * len(list_distinct(list_transform(regexp_extract_all(text, '(?i){STRONG}'), lambda x: lower(x)))) + len(list_distinct(list_transform(regexp_extract_all(text, '(?i){WEAK}'), lambda x: lower(x)))))::INTEGER AS score
FROM documents WHERE text IS NOT NULL""")
def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct strong and weak terms of each text."""
    return read_texts(spark, sf_dir, "documents").where("text is not null").select("doc_id", C.term_score(F.col("text"), STRONG, WEAK).alias("score"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), 'r#00000001') OR contains(lower(c_mktsegment), 'r#00000001')")
def customer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by substring over several columns."""
    return C.contains_any(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "R#00000001", ["c_name", "c_mktsegment"])


@query(f"""
WITH d AS (SELECT doc_id, source, {KEY} AS key FROM documents), t AS (SELECT key, arg_min(source, doc_id) AS source FROM d WHERE key <> '' GROUP BY 1), k AS (SELECT doc_id, min(source) AS source FROM d GROUP BY 1),
r AS (SELECT conv_id, turn, role, conv_id * 3 AS doc_id, {KEY} AS key FROM conversations)
SELECT conv_id, turn, coalesce(k.source, t.source) AS source, CASE WHEN k.source IS NOT NULL THEN 'key' WHEN t.source IS NOT NULL THEN 'text' END AS found_by
FROM r LEFT JOIN k USING (doc_id) LEFT JOIN t ON t.key = r.key""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's source by key, else by its text."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 3).alias("doc_id"), "text")
    return C.two_key_lookup(rows, read(spark, sf_dir, "documents"), "doc_id", "text", "source").select("conv_id", "turn", "source", "found_by")


@query(f"""
WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, other) AS (SELECT id, id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
x AS (SELECT doc_id, key, CASE WHEN key = '' THEN NULL ELSE min(doc_id) OVER (PARTITION BY key) END AS canonical FROM k),
h AS (SELECT DISTINCT canonical FROM x WHERE doc_id IN (SELECT doc_id FROM labels)),
bad AS (SELECT DISTINCT r.id FROM r JOIN h ON h.canonical = r.other)
SELECT doc_id FROM x WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND (canonical IS NULL OR canonical NOT IN (SELECT id FROM bad))""")
def leakage_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label that are no copy or near copy of a labelled one."""
    docs, labels = read_texts(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id").distinct()
    return C.leakage_guard(docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id", "left_semi"), "doc_id", "text").select("doc_id")


@query("SELECT source, count(*) AS n FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def pending_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows neither of whose keys has been labelled."""
    return C.pending(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id", "n_chars"], "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark) OR sha256(text) IN (SELECT sha256(text) FROM conversations WHERE text IS NOT NULL)")
def sliced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a batch names by key or by text."""
    batch = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(None).cast("string").alias("text")).unionByName(read(spark, sf_dir, "conversations").select(F.lit(None).cast("long").alias("doc_id"), "text"))
    return C.belonging(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), batch, "doc_id", "text").select("doc_id", "source")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a queue with the number of all its rows."""
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return C.page_with_total(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 20)


@query("""
WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '')) AS w FROM conversations),
p AS (SELECT a.role AS first_role, a.role = b.role AS same, len(list_intersect(a.w, b.w)) AS n_both, len(list_distinct(list_concat(a.w, b.w))) AS n_any FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT first_role, count(*) AS n, round(avg(same::INT), 6) AS label_agreement, round(avg(n_both / n_any) FILTER (n_any > 0), 6) AS mean_jaccard FROM p GROUP BY 1""")
def turn_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label agreement and word overlap of neighbouring turns."""
    own = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != ""))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", own.alias("w"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"), F.col("w").alias("next_w"))
    both = turns.join(after, ["conv_id", "turn"]).withColumnRenamed("role", "first_role")
    return C.agreement(both, ["first_role"], F.col("first_role"), F.col("next_role"), F.col("w"), F.col("next_w"))


GOLD, GUESS = "idiot|moron|license", "idiot|license|password"


def _spans_sql(name: str, pattern: str) -> str:
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(text, '(?i)({pattern})') AS m, string_split_regex(text, '(?i)({pattern})') AS g FROM documents),
{name}_u AS (SELECT doc_id, unnest(m) AS hit, unnest(g[1 : len(m)]) AS gap, unnest(range(len(m))) AS k FROM {name}_m WHERE len(m) > 0),
{name} AS (SELECT DISTINCT doc_id, lower(hit) AS label, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e FROM {name}_u)"""


@query(f"""
WITH {_spans_sql('t', GOLD)}, {_spans_sql('p', GUESS)},
j AS (SELECT coalesce(t.label, p.label) AS label, t.e IS NOT NULL AS t, p.e IS NOT NULL AS p FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.label = p.label AND t.e = p.e),
c AS (SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (NOT p) AS fn FROM j GROUP BY 1),
a AS (SELECT * FROM c UNION ALL SELECT '(all)', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c)
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1 FROM a""")
def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-span precision, recall and F1 by label and over all."""
    docs = read_texts(spark, sf_dir, "documents").where("text is not null")
    spans = lambda p: docs.select(F.col("doc_id").alias("row"), F.explode(matches(F.col("text"), f"({p})")).alias("m")).select("row", "m.start", "m.end", F.lower("m.text").alias("label"))
    return C.span_scores(spans(GOLD), spans(GUESS))


@query("""
WITH r AS (SELECT CASE quality WHEN 1 THEN 'UA' ELSE 'UC' END AS t, len(regexp_extract_all(lower(text), 'the')) AS na, len(regexp_extract_all(lower(text), 'and')) AS nc FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL),
f AS (SELECT t, na > 3 AS a, nc > 3 AS c, CASE WHEN na > 3 AND nc > 3 THEN CASE WHEN na > nc THEN 'UA' ELSE 'UC' END WHEN na > 3 THEN 'UA' WHEN nc > 3 THEN 'UC' END AS p FROM r)
SELECT count(*) AS n, round(count(*) FILTER (t = p) / count(*), 6) AS strict, round(count(*) FILTER ((t = 'UA' AND a) OR (t = 'UC' AND c)) / count(*), 6) AS lenient,
  round(count(*) FILTER (t = 'UA' AND p = 'UA') / nullif(count(*) FILTER (t = 'UA'), 0), 6) AS ua_recall, round(count(*) FILTER (t = 'UC' AND p = 'UC') / nullif(count(*) FILTER (t = 'UC'), 0), 6) AS uc_recall,
  count(*) FILTER (a AND c) AS both_flags, count(*) FILTER (NOT a AND NOT c) AS no_flag FROM f""")
def flag_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flags against one stated class, strict and lenient."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").where("text is not null and quality is not null")
    count = lambda w: F.size(F.regexp_extract_all(F.lower("text"), F.lit(w), 0))
    return C.flag_scores(rows, F.when(F.col("quality") == 1, "UA").otherwise("UC"), count("the") > 3, count("and") > 3, count("the"), count("and"))


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':11'), doc_id) AS place, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN place <= floor(n * (1 - 0.15::DOUBLE - 0.15::DOUBLE) + 1e-9) THEN 'train' WHEN place <= floor(n * (1 - 0.15::DOUBLE) + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM r""")
def shuffled_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70/15/15 in a hash order."""
    return C.shuffle_split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 11)


@query("SELECT doc_id, lang, ((row_number() OVER (ORDER BY (CASE WHEN lang = 'fr' THEN '0' ELSE '1' END) || md5(doc_id::VARCHAR), doc_id) - 1) // 25)::BIGINT AS batch FROM documents")
def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 25 rows, one language first."""
    return C.work_batches(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", F.coalesce(F.col("lang") == "fr", F.lit(False)), 25)


QUOTAS = {"en": 90_000, "fr": 70_000, "de": 80_000, "es": 10}


@query(f"""
WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::BIGINT)" for k, v in QUOTAS.items())}) t(lang, target)), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
s AS (SELECT lang, greatest(0, target - coalesce(n, 0)) AS shortfall FROM t LEFT JOIN n USING (lang)), w AS (SELECT * FROM s WHERE shortfall > 0 ORDER BY shortfall DESC, lang DESC LIMIT 3),
o AS (SELECT *, row_number() OVER (ORDER BY shortfall DESC, lang DESC) AS k, count(*) OVER () AS last, greatest(1, round_even(40 * shortfall / sum(shortfall) OVER (), 0))::BIGINT AS own FROM w)
SELECT lang, shortfall, CASE WHEN k = last THEN 40 - coalesce(sum(own) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE own END::BIGINT AS planned FROM o""")
def deficit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the next 40 rows are dealt over the three worst shortfalls."""
    return C.deficit_plan(quota_report(read(spark, sf_dir, "documents"), "lang", QUOTAS), "lang", 40)


@query(f"""SELECT p_partkey, array_to_string(list_transform([{', '.join(quoted(r.split()[0].lower()) for r in P.RULES)}], lambda x: CASE WHEN list_contains(string_split(lower(p_name), ' '), x) THEN '1' ELSE '0' END), '') AS hot FROM part""")
def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each row as 0/1 by name."""
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(C.multi_hot(F.split(F.lower("p_name"), " "), [r.split()[0].lower() for r in P.RULES]), "").alias("hot"))


#: A start in each script, so that every turn has words of all of them.
SCRIPTS = ["मिस्त्री गिर गया, ", "কাজ বন্ধ ছিল। ", "Hot work! ", "año_2 "]


@query(rf"""
WITH t AS (SELECT conv_id, turn, {dealt_sql(SCRIPTS, 'conv_id * 10 + turn')} || coalesce(text, '') AS text FROM conversations),
m AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_\x{{0900}}-\x{{097F}}\x{{0980}}-\x{{09FF}}]+|[^\s\x{{0085}}\x{{00A0}}\p{{L}}\p{{M}}\p{{N}}_]') AS m FROM t)
SELECT conv_id, turn, len(m) AS tokens, sha1(array_to_string(m, ' ')) AS tokens_sha1, 0 AS first_token, CASE WHEN length(m[2]) > 1 THEN NULL ELSE 0 END AS cut_token FROM m""")
def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every turn in Latin, Devanagari and Bengali script; the token that the first one's span aligns with, and one that may cut a token."""
    turns = read_texts(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") * 10 + F.col("turn")).select("conv_id", "turn", F.concat(dealt(SCRIPTS, "n"), F.coalesce("text", F.lit(""))).alias("text"))
    found = turns.select("conv_id", "turn", C.token_spans(F.col("text")).alias("m"))
    first, second = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    cut = C.aligned(F.col("m"), first["start"], second["start"] + 1)["first"]
    return found.select("conv_id", "turn", F.size("m").cast("long").alias("tokens"), F.sha1(F.array_join(F.transform("m", lambda x: x["text"]), " ")).alias("tokens_sha1"), C.aligned(F.col("m"), first["start"], first["end"])["first"].alias("first_token"), cut.alias("cut_token"))


@query(r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, sum((role = 'user')::INT) OVER w AS record, max(CASE WHEN turn % 4 = 0 THEN turn END) OVER w AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, record::BIGINT AS record, arg_min(h, turn)::VARCHAR AS heading, count(*) AS lines, sha1(string_agg(text, chr(10) ORDER BY turn)) AS body_sha1 FROM c WHERE record > 0 GROUP BY 1, 2""")
def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a user's turn opens, with the last heading above."""
    turns = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    found = C.marked_records(turns, ["conv_id"], "turn", "text", F.col("role") == "user", F.when(F.col("turn") % 4 == 0, F.col("turn").cast("string")))
    return found.select("conv_id", "record", "heading", "lines", F.sha1("body").alias("body_sha1"))


@query("""SELECT o_orderkey AS id, o_orderdate::DATE AS event_date, year(o_orderdate)::INTEGER AS event_year, substr(o_orderpriority, 1, 1)::INTEGER AS level, (o_orderstatus = 'F')::INTEGER AS closed,
  CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS severity_hint,
  CASE WHEN o_custkey % 4 = 0 THEN 'oil_gas_extraction' WHEN o_custkey % 4 = 1 THEN 'drilling_oil_gas_wells' WHEN o_custkey % 4 = 2 THEN 'petroleum_refineries' END AS sector FROM orders""")
def projected_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw register of strings as typed columns, with year, flags, severity ladder and sector."""
    orders = read(spark, sf_dir, "orders")
    code = F.element_at(F.array(*map(F.lit, ["211120", "213111", "324110", "999999"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    raw = orders.select(*(F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), code.alias("code"))
    price, day = F.col("o_totalprice").cast("double"), F.col("o_orderdate").try_cast("date")
    columns = {
        "id": F.col("o_orderkey").cast("long"), "event_date": day, "event_year": F.year(day), "level": F.substring("o_orderpriority", 1, 1).try_cast("int"), "closed": (F.col("o_orderstatus") == "F").cast("int"),
        "severity_hint": F.when(price > 300000, "high").when(price > 100000, "medium").otherwise("low"), "sector": P.sector(F.col("code")),
    }
    return C.projected(raw, columns, ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"])


@query("""
WITH v AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_mktsegment, count(*) AS customers, sum(n)::BIGINT AS current_orders, sum(open)::BIGINT AS open_orders FROM customer JOIN v ON c_custkey = o_custkey GROUP BY 1""")
def snapshot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over an analytic copy that holds current rows and pruned columns alone."""
    live = {"verdicts": read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderstatus"), "sites": read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")}
    copy = C.snapshot(spark, live)
    per = copy["verdicts"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return copy["sites"].join(per, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("current_orders"), F.sum("open").alias("open_orders"))


@query("""SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' WHEN length(text) < 200 THEN 'too short' WHEN lang IS NULL THEN 'no language' ELSE 'ok' END AS result, count(*) AS n, count(DISTINCT sha256(text)) AS distinct_texts FROM documents GROUP BY 1""")
def ingest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch ingest says of its rows."""
    checks = {"no text": F.trim("text") != "", "too short": F.length("text") >= 200, "no language": F.col("lang").isNotNull()}
    return C.ingest_report(read(spark, sf_dir, "documents"), "text", checks)


@query("""SELECT o_orderkey AS verdict_id, CASE WHEN o_orderstatus = 'F' THEN 'approve' WHEN o_orderstatus = 'O' THEN 'correct' ELSE 'escalate' END AS action, 'r1' AS reviewer, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS corrected, o_orderdate::DATE AS at FROM orders""")
def appended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals, corrections and escalations as rows to append."""
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "verdict_id")
    at = F.col("o_orderdate").cast("date")
    parts = [C.review_actions(orders.where("o_orderstatus = 'F'"), "r1", "approve", at), C.review_actions(orders.where("o_orderstatus = 'O'"), "r1", "correct", at, F.col("o_orderpriority")), C.review_actions(orders.where("o_orderstatus not in ('F', 'O')"), "r1", "escalate", at)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("note")


@query(rf"""
WITH s AS (SELECT doc_id, t, unnest(regexp_extract_all(t, '(?i)\b(?:mit license|license|licensed under)\b')) AS hit, unnest(string_split_regex(t, '(?i)\b(?:mit license|license|licensed under)\b')[1 : len(regexp_extract_all(t, '(?i)\b(?:mit license|license|licensed under)\b'))]) AS gap, unnest(range(len(regexp_extract_all(t, '(?i)\b(?:mit license|license|licensed under)\b')))) AS k
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]+', ' ', 'g') || ' the MIT License, a license' AS t FROM documents)),
e AS (SELECT doc_id, hit, k, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e FROM s)
SELECT doc_id, string_agg((e - length(hit)) || ':' || e || ':' || CASE WHEN lower(hit) = 'mit license' THEN 'long' WHEN lower(hit) = 'license' THEN 'short' ELSE 'other' END, ',' ORDER BY e) AS spans FROM e GROUP BY 1""")
def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon spans of three roles without overlaps, the longer first, so that a shorter role keeps only what is left."""
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]+", " "), F.lit(" the MIT License, a license"))
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    kept = C.weak_spans(F.col("t"), {"short": "license", "long": "mit license", "other": "licensed under"})
    return docs.select("doc_id", F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["start"], s["end"], s["role"])), ",").alias("spans"))
