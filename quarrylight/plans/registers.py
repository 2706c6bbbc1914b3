"""Registered queries over register projections and spelling, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.text import PLAIN, QUOTES
from quarrylight.operators import corpus as C
from quarrylight.operators import gates as G
from quarrylight.operators import pages as P
from quarrylight.operators import registers as R
from quarrylight.operators import spelling as S
from quarrylight.plans.tables import read, read_texts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def dealt(values: list[str | None], key: str, step: int = 1) -> Column:
    """One of the values for each row, by ``key // step``."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col(key) / step) % len(values) + 1).cast("int"))


def dealt_sql(values: list[str | None], key: str, step: int = 1) -> str:
    return f"([{', '.join(map(quoted, values))}])[({key} // {step}) % {len(values)} + 1]"


def cases(value: str, table, test: str = "=") -> str:
    fits = (lambda p: f"regexp_matches({value}, {quoted(p)})") if test == "~" else (lambda p: f"{value} = {quoted(p)}")
    return "CASE " + " ".join(f"WHEN {fits(k)} THEN {v if v.startswith('[') else quoted(v)}" for k, v in table)


#: Raw labels as labelled files hold them, dealt over the documents.
STATEMENTS = ["observed", "Training", "positive", "suggestion ", "unscorable", "historical", "rumour", "corrective_closed"]
ENERGIES = ["none", "Gravity_Height", "suspended_load", "vehicle", "lava", "pressure", ""]
BARRIERS = ["LOTO", "none", "H2S monitor", "Permit", "full body harness", "drop zone", "tag line", "machine cover", "trench box", "PSV", "Safety boots", "SOP", "prayer", None]
STATES = ["failed", "degraded", "intact", "unknown", "not_applicable", "odd"]
SIFS = ["YES", "no", "UNCERTAIN", "YES"]
TRAPS = ["negation_scope", "none", "multi_rule", "low_sif", "capacity", "india_heat", "typo", "near_miss", "strange", None]
#: With how many rules each names, and what names none.
RULES = {"Energy Isolation": (1, ""), "none": (0, ""), "Hot Work / Confined Space": (2, ""), "LOTO": (1, ""), "unknown rule": (0, "unknown rule")}
EXPOSURES = ["present", "Absent", None]
CONFIDENCES = ["0.9", "high", "1"]
OPENINGS = ["Slipped and fell.", "All well.", "Gas leak at the flange.", "A permit was there."]
TIDY = rf"trim(regexp_replace(regexp_replace(translate(t, {quoted(QUOTES)}, {quoted(PLAIN)}), '[\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
WITH d AS (SELECT doc_id, {dealt_sql(OPENINGS, 'doc_id')} || ' ' || coalesce(text, '') AS t, lower(trim({dealt_sql(STATEMENTS, 'doc_id')})) AS st, {dealt_sql(ENERGIES, 'doc_id', 2)} AS en, coalesce({dealt_sql(BARRIERS, 'doc_id', 3)}, '') AS b,
  {dealt_sql(STATES, 'doc_id', 5)} AS bs, upper({dealt_sql(SIFS, 'doc_id', 7)}) AS sif, coalesce({dealt_sql(TRAPS, 'doc_id', 11)}, '') AS tr, {dealt_sql(list(RULES), 'doc_id', 13)} AS lsr,
  lower(coalesce({dealt_sql(EXPOSURES, 'doc_id', 17)}, '')) AS ex, {dealt_sql(CONFIDENCES, 'doc_id', 19)} AS co FROM documents),
m AS (SELECT *, {cases('st', R.STATEMENTS.items())} END AS known, {cases('lower(en)', [(k, f'[{", ".join(map(quoted, v))}]::VARCHAR[]') for k, v in R.ENERGIES.items()])} END AS energy,
  CASE WHEN lower(b) IN ('none', '', 'n/a', 'null') THEN NULL ELSE {cases('lower(b)', R.BARRIERS, '~')} ELSE 'other' END END AS barrier_class,
  CASE WHEN tr IN ('', 'none') THEN 'none' ELSE {cases('tr', R.TRAPS, '~')} ELSE 'other' END END AS trap_family,
  CASE WHEN bs <> 'not_applicable' THEN coalesce({cases('bs', R.STATES.items())} END, 'unknown') END AS s0, {cases('lsr', [(k, str(v[0])) for k, v in RULES.items()])} END::INTEGER AS n_rules, {cases('lsr', [(k, v[1]) for k, v in RULES.items()])} END AS un FROM d),
s AS (SELECT *, coalesce(known, 'observed') AS statement, coalesce(energy, []) AS energies, CASE WHEN barrier_class = 'ppe' AND s0 IN ('present_effective', 'present_ineffective', 'absent') THEN 'pseudo' ELSE s0 END AS status,
  regexp_matches(t, {quoted('(?i)' + R.RELEASED)}) AS rel FROM m)
SELECT doc_id, statement, array_to_string(energies, '|') AS energies, barrier_class, status, trap_family, CASE WHEN statement IN ('hypothetical', 'historical', 'training_example') THEN 'NON_EVENT'
  WHEN sif = 'UNCERTAIN' THEN CASE WHEN len(energies) = 0 THEN 'INSUFFICIENT' ELSE 'INSUFFICIENT|EXPOSURE' END
  WHEN sif = 'NO' THEN CASE WHEN len(energies) = 0 THEN 'LOW_ENERGY|NON_EVENT' WHEN coalesce(status = 'present_effective', false) THEN 'SUCCESS|CAPACITY' ELSE 'LOW_ENERGY|SUCCESS|NON_EVENT' END
  WHEN coalesce(status = 'present_effective', false) THEN CASE WHEN rel THEN 'CAPACITY' ELSE 'SUCCESS|EXPOSURE' END WHEN rel THEN 'P_SIF|EXPOSURE' ELSE 'EXPOSURE|P_SIF' END AS verdicts,
  array_to_string(list_filter([CASE WHEN {TIDY} <> t THEN 'text_changed_by_normaliser' END, CASE WHEN known IS NULL THEN 'unknown_statement_type:' || st END, CASE WHEN un <> '' THEN 'lsr_unmapped:' || un END,
  CASE WHEN energy IS NULL THEN 'unknown_energy:' || en END, CASE WHEN sif = 'YES' AND len(energies) = 0 THEN 'sif_yes_but_energy_none' END, CASE WHEN contains(tr, 'multi') AND n_rules < 2 THEN 'multi_rule_but_single_lsr' END,
  CASE WHEN len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) <= 3 THEN 'very_short_text' END, CASE WHEN sif = 'YES' AND n_rules = 0 THEN 'sif_yes_no_lsr' END,
  CASE WHEN sif = 'YES' AND statement IN ('hypothetical', 'historical', 'training_example') THEN 'non_event_statement_but_sif_yes' END, CASE WHEN sif = 'YES' AND ex = 'absent' THEN 'exposure_absent_but_sif_yes' END,
  CASE WHEN try_cast(co AS DOUBLE) IS NULL THEN 'confidence_not_numeric' END], lambda x: x IS NOT NULL), ' ') AS flags FROM s""")
def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels on the common vocabulary, allowed verdicts and review flags of whole texts."""
    opened = F.concat(dealt(OPENINGS, "doc_id"), F.lit(" "), F.coalesce("text", F.lit("")))
    raw = {"statement_type": (STATEMENTS, 1), "energy_source": (ENERGIES, 2), "barrier": (BARRIERS, 3), "barrier_status": (STATES, 5), "sif_potential": (SIFS, 7), "trap_type": (TRAPS, 11), "lsr": (list(RULES), 13), "exposure": (EXPOSURES, 17), "confidence": (CONFIDENCES, 19)}
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", opened.alias("report_text"), *(dealt(v, "doc_id", n).alias(c) for c, (v, n) in raw.items()))
    found = R.gold_labels(docs, compose=False)
    return found.select("doc_id", "statement", F.array_join("energies", "|").alias("energies"), "barrier_class", "status", "trap_family", F.array_join("verdicts", "|").alias("verdicts"), F.array_join("flags", " ").alias("flags"))


ACTUAL, POTENTIAL = ["I", "ii", " III", "IV", None, "x"], ["I", "II", "III", "iv", "V ", "VI", None]


@query(f"""
WITH r AS (SELECT p_partkey, {cases(f"upper(trim({dealt_sql(ACTUAL, 'p_partkey')}))", [(k, str(v)) for k, v in R.LEVELS.items()])} END::INTEGER AS actual,
  {cases(f"upper(trim({dealt_sql(POTENTIAL, 'p_partkey', 2)}))", [(k, str(v)) for k, v in R.LEVELS.items()])} END::INTEGER AS potential FROM part)
SELECT p_partkey, actual, potential, potential - actual AS difference, CASE WHEN potential >= 4 THEN 'SIF_POTENTIAL' WHEN potential <= 2 THEN 'LOW_ENERGY' ELSE 'BORDERLINE' END AS verdict_group FROM r""")
def accident_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman accident levels and the verdict group that they ask for."""
    return read(spark, sf_dir, "part").select("p_partkey", R.accident_levels(dealt(ACTUAL, "p_partkey"), dealt(POTENTIAL, "p_partkey", 2)).alias("x")).select("p_partkey", "x.*")


#: Forms of dates, codes and flags as registers of severe injuries hold them, dealt over the orders.
FORMS = {"MM/dd/yyyy": "%m/%d/%Y", "yyyy-MM-dd": "%Y-%m-%d", "dd/MM/yyyy": "%d/%m/%Y", "MM/dd/yy": "%m/%d/%y", "dd.MM.yyyy": "%d.%m.%Y"}
CODES = ["211120", "213111.0", " 213112", "324110", "445110", "", None]
FLAGS = ["1.0", "0", None, "1", "n/a"]
CITIES = ["  NEW   delhi", "port-au-prince", "o'fallon", None]


@query(rf"""
WITH r AS (SELECT o_orderkey, ([{', '.join(f"strftime(o_orderdate, {quoted(f)})" for f in FORMS.values())}])[o_orderkey % 5 + 1] AS day, nullif(regexp_replace(trim({dealt_sql(CODES, 'o_orderkey')}), '\.0$', ''), '') AS naics,
  {dealt_sql(CITIES, 'o_orderkey')} AS city, {dealt_sql(FLAGS, 'o_orderkey', 2)} AS h, {dealt_sql(FLAGS, 'o_orderkey', 3)} AS a, {dealt_sql(FLAGS, 'o_orderkey', 5)} AS e, trim('order ' || o_orderpriority) AS narrative FROM orders),
f AS (SELECT *, try_cast(try_cast(h AS DOUBLE) AS INTEGER) AS hospitalized, try_cast(try_cast(a AS DOUBLE) AS INTEGER) AS amputation, try_cast(try_cast(e AS DOUBLE) AS INTEGER) AS loss_of_eye,
  (CASE WHEN regexp_matches(day, '/\d{{4}}$') THEN try_strptime(day, ['%m/%d/%Y', '%d/%m/%Y']) ELSE try_strptime(day, ['%Y-%m-%d', '%m/%d/%y']) END)::DATE AS event_date FROM r WHERE length(narrative) >= 15)
SELECT o_orderkey::VARCHAR AS osha_id, event_date, year(event_date)::INTEGER AS event_year, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(city, '\s+', ' ', 'g')), '\p{{L}}+|\P{{L}}+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS city, naics,
  CASE WHEN starts_with(naics, '211') THEN 'oil_gas_extraction' WHEN starts_with(naics, '213111') THEN 'drilling_oil_gas_wells' WHEN starts_with(naics, '213112') THEN 'support_activities_oil_gas' WHEN starts_with(naics, '324110') THEN 'petroleum_refineries' END AS naics_sector,
  CASE WHEN coalesce(amputation, 0) <> 0 THEN 'amputation' WHEN coalesce(loss_of_eye, 0) <> 0 THEN 'loss_of_eye' WHEN coalesce(hospitalized, 0) <> 0 THEN 'hospitalized' ELSE 'reported_severe' END AS severity_hint, narrative FROM f""")
def severe_injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A severe-injury register on the common columns."""
    day = F.element_at(F.array(*(F.date_format("o_orderdate", f) for f in FORMS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    raw = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID"), F.concat(day, F.lit(" 00:00")).alias("EventDate"), F.lit("ACME").alias("Employer"), dealt(CITIES, "o_orderkey").alias("City"), F.lit("TEXAS").alias("State"), dealt(CODES, "o_orderkey").alias("Primary NAICS"),
        dealt(FLAGS, "o_orderkey", 2).alias("Hospitalized"), dealt(FLAGS, "o_orderkey", 3).alias("Amputation"), dealt(FLAGS, "o_orderkey", 5).alias("Loss of Eye"), F.concat(F.lit("order   "), "o_orderpriority").alias("Final Narrative"),
    )
    named = {"osha_id": "ID", "event_date": "EventDate", "employer": "Employer", "city": "City", "state": "State", "naics": "Primary NAICS", "hospitalized": "Hospitalized", "amputation": "Amputation", "loss_of_eye": "Loss of Eye", "narrative": "Final Narrative"}
    return R.severe_injuries(raw, named).select("osha_id", "event_date", "event_year", "city", "naics", "naics_sector", "severity_hint", "narrative")


TITLES = ["Worker killed at oil well", "Employee is burned", "Fall from derrick", "Amputation at a swab line"]
KEYWORDS = ["drilling rig,  h2s ; burn", "nan", "fall  ladder", None]
SUMMARIES = ["In 2004 he died in hospital.", "On 3 May 1931 and 2011 a pump jack and a Pump Jack moved.", "Employees were hospitalised.", "His finger was amputated at the wellhead near the casing."]
ALL = "concat_ws(' ', title, s, array_to_string(words, ' '))"


def terms_sql(pattern: str) -> str:
    return f"len(list_distinct(list_transform(regexp_extract_all({ALL}, {quoted('(?i)' + pattern)}), lambda x: lower(x))))"


@query(rf"""
WITH d AS (SELECT doc_id, {dealt_sql(TITLES, 'doc_id')} AS title, {dealt_sql(SUMMARIES, 'doc_id', 2)} || ' ' || coalesce(text, '') AS s,
  list_filter(list_transform(string_split_regex(coalesce({dealt_sql(KEYWORDS, 'doc_id', 3)}, ''), '\s{{2,}}|,|;'), lambda x: lower(trim(x))), lambda x: x <> '' AND x <> 'nan') AS words FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(s, {quoted('(?i)' + R.DIED)}) THEN 'fatal' ELSE 'severe_injury' END AS record_type, regexp_matches(s, {quoted('(?i)' + R.HOSPITAL)}) AS hospitalized, regexp_matches(s, {quoted('(?i)' + R.AMPUTATED)}) AS amputation,
  CASE WHEN try_cast(regexp_extract(s, '\b((?:19|20)\d\d)\b', 1) AS INTEGER) BETWEEN 1990 AND 2026 THEN regexp_extract(s, '\b((?:19|20)\d\d)\b', 1)::INTEGER END AS event_year, array_to_string(words, '|') AS keywords,
  {terms_sql(R.STRONG)} > 0 AS is_oilgas, (2 * {terms_sql(R.STRONG)} + {terms_sql(R.WEAK)})::INTEGER AS oilgas_score FROM d""")
def abstract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of whole texts that open as accident abstracts do."""
    summary = F.concat(dealt(SUMMARIES, "doc_id", 2), F.lit(" "), F.coalesce("text", F.lit("")))
    found = read_texts(spark, sf_dir, "documents").select("doc_id", R.abstract_facts(summary, dealt(TITLES, "doc_id"), dealt(KEYWORDS, "doc_id", 3)).alias("x"))
    return found.select("doc_id", "x.*").withColumn("keywords", F.array_join("keywords", "|"))


DEGREES = ["0", "01", "2.0", "03", " 00", "1"]
CLASSES = ["POWERED HAULAGE", "FALL OF ROOF OR BACK", "HANDTOOLS", None, "INUNDATION"]
PLACES = ["Surface at underground mine", "Face", "NO VALUE FOUND", None]
DUPLICATE = 10


@query(rf"""
WITH r AS (SELECT doc_id, lpad(regexp_replace(trim({dealt_sql(DEGREES, 'doc_id')}), '\.0$', ''), 2, '0') AS degree, {dealt_sql(CLASSES, 'doc_id', 2)} AS c, {dealt_sql(PLACES, 'doc_id', 3)} AS p, 2000 + doc_id % 20 AS year, doc_id % {DUPLICATE} = 0 AS dup,
  'the pump jack and the casing of unit ' || doc_id % 3 || coalesce(' hit ' || source, '') || ' while the crew of three was at work there' AS t FROM documents),
k AS (SELECT *, CASE degree WHEN '00' THEN 'no_injury_event' WHEN '01' THEN 'fatal' ELSE 'permanent_impairment' END AS record_type, len(regexp_extract_all(t, '\S+')) AS w, 2 * len(list_distinct(regexp_extract_all(t, {quoted(R.STRONG)}))) + len(list_distinct(regexp_extract_all(t, {quoted(R.WEAK)}))) AS score
  FROM r WHERE degree IN ('00', '01', '02') AND NOT coalesce(regexp_matches(c, {quoted('(?i)' + R.MINE_ONLY)}), false) AND NOT (coalesce(regexp_matches(p, {quoted('(?i)' + R.UNDERGROUND)}), false) AND NOT coalesce(regexp_matches(p, {quoted('(?i)' + R.SURFACE)}), false))),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY record_type = 'no_injury_event' ORDER BY score DESC, year DESC, md5(doc_id::VARCHAR), doc_id) AS n, record_type = 'no_injury_event' AS calm FROM k WHERE NOT dup AND w >= 12)
SELECT k.doc_id, record_type, score::INTEGER AS oilgas_score, w::INTEGER AS narrative_words, CASE WHEN o.n <= CASE WHEN calm THEN 100 ELSE 30 END THEN 'train_candidate' ELSE 'eval_pool' END AS split_hint FROM k LEFT JOIN o USING (doc_id)""")
def mine_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mine accidents that have a like elsewhere, and which of them may train."""
    told = F.concat(F.lit("the pump jack and the casing of unit "), F.col("doc_id") % 3, F.coalesce(F.concat(F.lit(" hit "), "source"), F.lit("")), F.lit(" while the crew of three  was at work there"))
    raw = read(spark, sf_dir, "documents").select("doc_id", dealt(DEGREES, "doc_id").alias("degree"), dealt(CLASSES, "doc_id", 2).alias("classification"), dealt(PLACES, "doc_id", 3).alias("location"), told.alias("narrative"), (F.col("doc_id") % 20 + 2000).alias("year"), (F.col("doc_id") % DUPLICATE == 0).alias("is_duplicate"))
    return R.train_candidates(R.mine_accidents(raw), "doc_id", 100, 30).select("doc_id", "record_type", "oilgas_score", "narrative_words", "split_hint")


#: Openings as they are typed on phones, dealt over the documents.
TYPED = ["Non permited area me chala gya.", "Presure guage nhi tha, barrikading khula.", "Scafoldnig ki harnes kharab.", "ElectricIan ne panl khola, hydrualic hose leek.", "All barricadings fine, request sent.", "Compresser temprature high, sefty valve."]
TYPED_SQL = dealt_sql(TYPED, "doc_id") + " || ' ' || coalesce(text, '')"
CORE_SQL = ", ".join(f"({quoted(t)})" for t in S.CORE_TERMS)


@query(rf"""
WITH d AS (SELECT doc_id, {TYPED_SQL} AS t FROM documents),
p AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM (SELECT doc_id, regexp_extract_all(t, '[A-Za-z\x{{0900}}-\x{{097F}}]+|[^A-Za-z\x{{0900}}-\x{{097F}}]+') AS ps FROM d)),
v AS (SELECT * FROM (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in S.VARIANTS.items())}) v(low, fix)), c AS (SELECT * FROM (VALUES {CORE_SQL}) c(term)),
w AS (SELECT DISTINCT lower(piece) AS low FROM p WHERE regexp_full_match(lower(piece), '[a-z]{{7,}}')),
l AS (SELECT low FROM w WHERE low NOT IN ({', '.join(map(quoted, S.KEPT))}) AND low NOT IN (SELECT low FROM v) AND NOT EXISTS (SELECT 1 FROM c WHERE term = low OR (length(term) >= 6 AND starts_with(low, term)))),
e AS (SELECT low, arg_min(term, (damerau_levenshtein(low, term), term)) AS fix FROM l JOIN c ON term[1] = low[1] AND damerau_levenshtein(low, term) <= CASE WHEN length(low) < 10 THEN 1 ELSE 2 END GROUP BY low),
f AS (SELECT p.*, coalesce(v.fix, e.fix) AS fix FROM p LEFT JOIN v ON v.low = lower(piece) LEFT JOIN e ON e.low = lower(piece)),
g AS (SELECT doc_id, k, piece, CASE WHEN fix IS NOT NULL THEN CASE WHEN regexp_matches(piece, '^[A-Z]') THEN upper(fix[1]) || fix[2:] ELSE fix END END AS fix FROM f),
h AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM g)
SELECT doc_id, md5(string_agg(coalesce(fix, piece), '' ORDER BY k)) AS normalised_md5, coalesce(string_agg(s || ':' || (s + length(piece)) || ':' || fix, '|' ORDER BY k) FILTER (fix IS NOT NULL), '') AS changes,
  coalesce(string_agg(s || ':' || (s + length(piece)), '|' ORDER BY k) FILTER (fix IS NOT NULL), '') AS restored, '0:' || sum(length(piece)) AS whole FROM h GROUP BY 1""")
def corrected_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected whole texts, what was changed, and the changed places led back to the original."""
    typed = F.concat(dealt(TYPED, "doc_id"), F.lit(" "), F.coalesce("text", F.lit("")))
    docs = read_texts(spark, sf_dir, "documents").select("doc_id", typed.alias("text"))
    found = S.normalised(docs)
    changes = found["changes"]
    shift = lambda c: F.length(c["new"]) - (c["end"] - c["start"])
    # Where the changed words stand in the corrected text: each is moved by the changes before it.
    before = F.transform(changes, lambda c, i: c["start"] + F.aggregate(F.slice(changes, F.lit(1), i), F.lit(0), lambda s, x: s + shift(x)))
    back = F.zip_with(changes, before, lambda c, at: S.restored(changes, at, at + F.length(c["new"])))
    shown = lambda s: F.concat_ws(":", s["start"], s["end"])
    return found.select(
        "doc_id", F.md5("normalised").alias("normalised_md5"), F.array_join(F.transform(changes, lambda c: F.concat_ws(":", c["start"], c["end"], c["new"])), "|").alias("changes"),
        F.array_join(F.transform(back, shown), "|").alias("restored"), shown(S.restored(changes, F.lit(0), F.length("normalised"))).alias("whole"),
    )


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT label, e FROM v WHERE vec_id < 40), n AS (SELECT e FROM v WHERE vec_id BETWEEN 40 AND 49),
c AS (SELECT v.vec_id, p.label, max(list_cosine_similarity(v.e, p.e)) AS s FROM v, p GROUP BY ALL), m AS (SELECT v.vec_id, max(list_cosine_similarity(v.e, n.e)) AS s FROM v, n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM c)
SELECT a.vec_id, a.label AS best, round(a.s, 5) AS score, round(a.s - m.s, 5) AS margin, b.label AS runner_up FROM r a JOIN m USING (vec_id) LEFT JOIN r b ON b.vec_id = a.vec_id AND b.k = 2 WHERE a.k = 1 AND a.s >= 0.15 AND a.s - m.s >= 0.05""")
def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each vector by its nearest prototype, if that beats every negative one by a margin."""
    vectors = read(spark, sf_dir, "embeddings")
    fixed = vectors.where("vec_id < 50").select(F.when(F.col("vec_id") < 40, F.col("label")).alias("proto_label"), F.col("embedding").alias("proto"))
    return C.semantic_types(vectors, fixed, 0.15, 0.05)


LONG = "The battery of the truck burned while two men stood near it and called for help."


@query(f"""
WITH c AS (SELECT *, c_custkey % 4 AS k, 'The charger of ' || c_name || ' was left on over night and nobody looked at it' AS wrong FROM customer)
SELECT c_custkey // 5 AS file, c_custkey % 5 + 1 AS record, CASE WHEN c_custkey // 5 % 2 = 0 THEN 'EUROPE ONSHORE' ELSE 'AFRICA OFFSHORE' END AS heading, make_date(2000 + c_custkey % 20, 3, c_custkey % 28 + 1) AS date, 'France' AS country,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS function, CASE WHEN k % 2 = 0 THEN 2 END AS number_of_deaths, 'Contractor' AS employer, c_name AS occupation, 12 AS lwdc_days, CASE WHEN k <> 1 THEN 'Energy Isolation|Hot Work' ELSE '' END AS rules,
  CASE k WHEN 1 THEN NULL WHEN 2 THEN '{LONG}' ELSE 'Battery fire. ' || wrong END AS text, CASE WHEN k IN (0, 3) THEN 'narrative+what_went_wrong' ELSE 'narrative' END AS text_composition, '• Check it.|• Check it again.' AS corrective_actions,
  'people_acts:Inattention:Improper deci- sion|process_conditions:Tools' AS factors, CASE k WHEN 0 THEN 'very_short_narrative' WHEN 1 THEN 'missing_narrative no_lsr fatal_without_death_count' WHEN 2 THEN 'unparsed_header_lines' ELSE 'very_short_narrative fatal_without_death_count' END AS warnings FROM c""")
def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of reports that come as pages, a customer a page: lines, records, sections, victims, factors, warnings."""
    key = F.col("c_custkey")
    k = key % 4
    lines = [
        F.lit("2023 safety data - fatal incident reports"), F.when(key % 5 == 0, F.concat(F.lit("Front matter\n"), F.when(F.floor(key / 5) % 2 == 0, "Europe  Onshore").otherwise("AFRICA OFFSHORE"))),
        F.concat(F.lit("DATE: "), key % 28 + 1, F.lit("th March, "), key % 20 + 2000), F.lit("COUNTRY: FRANCE"), F.when(k == 2, "Odd line"), F.concat(F.lit("FUNCTION: "), "c_mktsegment"), F.when(k % 2 == 0, "NUMBER OF DEATHS: 2 in all"),
        F.lit("FATALITY\nFunction: Drilling, Employer: Contractor,"), F.concat(F.lit("Occupation: "), "c_name", F.lit(", LWDC Days: 12 days")), F.when(k != 1, "RULE: LOTO / Hot Work"),
        F.when(k == 2, "NARRATIVE: " + LONG.replace(" while ", " while\n")).when(k != 1, "NARRATIVE: Battery fire."), F.concat(F.lit("WHAT WENT WRONG: The charger of "), "c_name", F.lit(" was left\non over night and nobody looked at it")),
        F.lit("CORRECTIVE ACTIONS AND RECOMMENDATIONS:\n• Check it.\n• Check it\nagain.\nCAUSAL FACTORS: PEOPLE (ACTS): Inattention: Improper deci-\nsion\nPROCESS (CONDITIONS): Tools\nPROCESS (CONDITIONS): Tools"), (key % 100).cast("string"),
    ]
    pages = read(spark, sf_dir, "customer").select(F.floor(key / 5).alias("file"), key.alias("page"), F.concat_ws("\n", *lines).alias("text"))
    found = P.parsed_records(P.page_records(P.page_lines(pages, ["file"], "page", "text"), ["file"]), F.lit("fatal"))
    factors = F.transform("causal_factors", lambda c: F.concat_ws(":", c["group"], c["category"], c["factor"]))
    return found.select(
        "file", "record", "heading", "date", "country", "function", "number_of_deaths", F.col("victim.victim_employer").alias("employer"), F.col("victim.victim_occupation").alias("occupation"), "victim.lwdc_days",
        F.array_join("life_saving_rules", "|").alias("rules"), "text", "text_composition", F.translate("corrective_actions", "\n", "|").alias("corrective_actions"), F.array_join(factors, "|").alias("factors"), F.array_join("warnings", " ").alias("warnings"),
    )


ROLES = ["control_absent", "energy_cue", "release_cue", "control_ineffective"]
SPANS = ["harness nahi", "crane", "Loose", "nahi tha", "not isolated"]
SOURCES = ["rules", "rules:mined"]
HAZARDS = [None, "vehicle_or_mobile_plant", None, "electrical", None, None, None]
GATES = ["NONE", None, "EXCEEDS", "UNKNOWN", "NONE"]
PREFILTERS = ["0", "0", "1", None, "0"]
HEADS = ["NON_EVENT", None, "P_SIF", "SUCCESS"]
SHORTS = ["Nil", "", "As per attached list of things to do"]
SPAN_TYPE = "array<struct<role:string,text:string,source:string,score:double>>"


@query(rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN {dealt_sql(SHORTS, 'doc_id')} ELSE coalesce(text, '') END AS t, (doc_id * 37 % 101) / 100.0 AS p, {dealt_sql(ROLES, 'doc_id', 2)} AS role, {dealt_sql(SPANS, 'doc_id', 3)} AS span, {dealt_sql(SOURCES, 'doc_id', 5)} AS source,
  {dealt_sql(HAZARDS, 'doc_id', 7)} AS hazard, {dealt_sql(GATES, 'doc_id', 11)} AS g, {dealt_sql(PREFILTERS, 'doc_id', 13)} AS pre, {dealt_sql(HEADS, 'doc_id', 17)} AS head, (doc_id % 10) / 10.0 AS conf, (doc_id % 6) / 5.0 AS score FROM documents),
h AS (SELECT *, CASE WHEN role <> 'energy_cue' AND source = 'rules' AND span NOT IN ('Loose', 'nahi tha') THEN 'rule span ' || role || '=' || span END AS hard FROM d),
e AS (SELECT *, list_filter([hard, CASE WHEN hazard <> 'vehicle_or_mobile_plant' OR (hazard IS NOT NULL AND role IN ('release_cue', 'control_absent')) THEN 'hazard ' || hazard END, CASE WHEN g = 'EXCEEDS' THEN 'energy EXCEEDS' END,
  CASE WHEN score >= 0.8 THEN 'model energy_cue=pump' END, CASE WHEN pre = '1' THEN 'prefilter' END, CASE WHEN head = 'P_SIF' AND conf >= 0.4 THEN 'head P_SIF' END], lambda x: x IS NOT NULL) AS ev,
  regexp_matches(t, '(?i)^\W*(nil|as per attached)\b') OR len(regexp_extract_all(t, '\S+')) <= 3 AS bare FROM h),
s AS (SELECT *, CASE WHEN p > 0.9 AND hard IS NULL THEN 'scope' WHEN p >= 0.35 AND (pre IS NOT NULL OR head IS NOT NULL) AND NOT bare AND len(ev) = 0 THEN 'evidence' END AS stage FROM e)
SELECT doc_id, stage IS NOT NULL AS reject, stage, array_to_string(ev, '|') AS evidence FROM s""")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts the scope and evidence gates turn away, and what speaks for the others."""
    text = F.when(F.col("doc_id") % 9 == 0, dealt(SHORTS, "doc_id")).otherwise(F.coalesce("text", F.lit("")))
    span = F.array(F.struct(dealt(ROLES, "doc_id", 2).alias("role"), dealt(SPANS, "doc_id", 3).alias("text"), dealt(SOURCES, "doc_id", 5).alias("source"), F.lit(1.0).alias("score")))
    model = F.array(F.struct(F.lit("energy_cue").alias("role"), F.lit("pump").alias("text"), F.lit("model").alias("source"), (F.col("doc_id") % 6 / 5.0).alias("score")))
    docs = read_texts(spark, sf_dir, "documents").select(
        "doc_id", text.alias("text"), (F.col("doc_id") * 37 % 101 / 100.0).alias("p"), span.cast(SPAN_TYPE).alias("spans"), model.cast(SPAN_TYPE).alias("model_spans"), dealt(HAZARDS, "doc_id", 7).alias("hazard"), F.lit(None).cast("string").alias("semantic"),
        dealt(GATES, "doc_id", 11).alias("energy_gate"), dealt(PREFILTERS, "doc_id", 13).alias("prefilter"), dealt(HEADS, "doc_id", 17).alias("head"), (F.col("doc_id") % 10 / 10.0).alias("head_confidence"),
    )
    names = ["p", "text", "spans", "model_spans", "hazard", "semantic", "energy_gate", "prefilter", "head", "head_confidence"]
    return G.gated(docs, {n: n for n in names}).select("doc_id", "gate.reject", "gate.stage", F.array_join("gate.evidence", "|").alias("evidence"))
