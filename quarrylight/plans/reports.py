"""Registered queries over the whole rule stack: reports as they are typed, scored in one pass, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import rules as R
from quarrylight.operators import gates as G
from quarrylight.operators import spelling as S
from quarrylight.operators.scoring import ASSAMESE, HINGLISH, cues, score
from quarrylight.plans.registers import dealt, dealt_sql, quoted
from quarrylight.plans.tables import read_texts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


#: Reports as they come from phones, with slips, placeholders and routine notes; dealt over documents and turns.
REPORTS = [
    "Non permited area me chala gya.", "Spanner monkey board se neeche gira, 3 log the, barricading nahi tha.", "Worker did not wear harness, floor was slippery and rope damaged.", "Presure guage broken tha, line ka presure 12 bar.",
    "Toolbox talk conducted at the gate.", "Vehicle arrived at the gate and parked.", "Live panl 440 V khula tha, electrician ne bypass kiya.", "Canteen me khana thanda tha aaj bhi.", "Hot work welding without permit, spark near drum.",
    "Forklift reversing, operator almost hit by trolley.", "Nil", "During training the drill was demonstrated.", "Scafolding 4 m height, loose plank, no injury.", "Leek at the flange, oil spill on wet floor.", "Pichle hafte crane lift me sling toot gayi.",
    "If the hook had failed the load would have fallen.", "Routine patrol done, all fine.", "Manhole open, poor light, H2S 20 ppm.", "Driver started the pump while cleaning inside the guard.", "Bina permit ke kaam, helmet nahi pehna.",
]


def report_text(key: str, text: str = "text") -> Column:
    """A report and the ASCII of the row's own whole text behind it."""
    return F.concat(dealt(REPORTS, key), F.lit(" "), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ -~]+", " "))


def report_sql(key: str) -> str:
    return f"{dealt_sql(REPORTS, key)} || ' ' || regexp_replace(coalesce(text, ''), '[^ -~]+', ' ', 'g')"


def spelled_sql(source: str, key: str) -> str:
    """CTEs up to ``spelled`` (key, t): the texts of ``source`` (key, t) with known variants and near core terms put right."""
    core = ", ".join(f"({quoted(t)})" for t in S.CORE_TERMS)
    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in S.VARIANTS.items())
    return rf"""
pieces AS (SELECT {key}, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM (SELECT {key}, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]+') AS ps FROM {source})),
known AS (SELECT * FROM (VALUES {known}) v(low, fix)), core AS (SELECT * FROM (VALUES {core}) c(term)),
long AS (SELECT DISTINCT lower(piece) AS low FROM pieces WHERE regexp_full_match(lower(piece), '[a-z]{{7,}}')),
doubtful AS (SELECT low FROM long WHERE low NOT IN ({', '.join(map(quoted, S.KEPT))}) AND low NOT IN (SELECT low FROM known) AND NOT EXISTS (SELECT 1 FROM core WHERE term = low OR (length(term) >= 6 AND starts_with(low, term)))),
near AS (SELECT low, arg_min(term, (damerau_levenshtein(low, term), term)) AS fix FROM doubtful JOIN core ON term[1] = low[1] AND damerau_levenshtein(low, term) <= CASE WHEN length(low) < 10 THEN 1 ELSE 2 END GROUP BY low),
fixed AS (SELECT p.*, coalesce(v.fix, e.fix) AS fix FROM pieces p LEFT JOIN known v ON v.low = lower(piece) LEFT JOIN near e ON e.low = lower(piece)),
spelled AS (SELECT {key}, string_agg(CASE WHEN fix IS NULL THEN piece WHEN regexp_matches(piece, '^[A-Z]') THEN upper(fix[1]) || fix[2:] ELSE fix END, '' ORDER BY k) AS t FROM fixed GROUP BY {key})"""


def has_sql(pattern: str, text: str = "t") -> str:
    return f"regexp_matches({text}, {quoted('(?is)' + pattern)})"


def hits_sql(pattern: str, text: str = "t") -> str:
    return f"regexp_extract_all({text}, {quoted('(?i)' + pattern)})"


def stated_sql(units: str) -> tuple[str, str]:
    pattern = quoted(rf"(?i)(\d+(?:[.,]\d+)?)\s?({units})")
    return f"TRY_CAST(replace(regexp_extract(t, {pattern}, 1), ',', '.') AS DOUBLE)", f"lower(regexp_extract(t, {pattern}, 2))"


def table_sql(table: list[tuple[str, float]]) -> str:
    return "CASE " + " ".join(f"WHEN {has_sql(p)} THEN {v}::DOUBLE" for p, v in table) + " END"


def language_sql() -> str:
    words = "list_filter(string_split_regex(lower(t), '[^a-z0-9_]+'), lambda x: x IN ({}))"
    own = lambda table: words.format(", ".join(quoted(x) for x in table.split("|")))
    return f"CASE WHEN len({own(ASSAMESE)}) >= 2 THEN 'assamese_mix' WHEN len({own(HINGLISH)}) >= 2 AND len(list_filter({own(HINGLISH)}, lambda x: x <> 'the')) > 0 THEN 'hinglish' ELSE 'english' END"


def hazard_sql() -> str:
    """Struct of the hazard with the most cues, the earliest of equals; null without a cue."""
    options = []
    for k, (name, (cues, energy, *_)) in enumerate(R.HAZARDS.items()):
        first = f"length(regexp_extract(t, {quoted(f'(?is)^(.*?){cues}')}, 1))"
        options.append(f"CASE WHEN {has_sql(cues)} THEN {{'n': len({hits_sql(cues)}), 'at': -{first}, 'k': -{k}, 'name': '{name}', 'energy': '{energy}'}} END")
    return f"list_max(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def tags_sql(table: list[tuple[str, str]]) -> str:
    """Tags with a hit, each at the place of its first pattern that hits."""
    found = f"list_filter([{', '.join(f'CASE WHEN {has_sql(p)} THEN {quoted(tag)} END' for p, tag in table)}], lambda x: x IS NOT NULL)"
    return f"(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({found}, lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END))"


def gate_sql() -> str:
    """The energy gate of a text by its hazard's kind of energy."""
    (volts, v_unit), (bar, p_unit), (mass, m_unit), (height, h_unit) = map(stated_sql, (r"kv|volt|v\b", r"bar|psi|kg/cm2|kpa|mpa", r"kg|kilo|kgs|ton|tonne|t\b", r"m\b|meter|metre|mtr|ft\b|feet|foot"))
    celsius = r"TRY_CAST(replace(regexp_extract(t, '(?i)(\d+(?:[.,]\d+)?)\s?(deg|°)?\s?c\b', 1), ',', '.') AS DOUBLE)"
    kg = f"coalesce(CASE WHEN {m_unit} LIKE 't%' THEN {mass} * 1000 ELSE {mass} END, {table_sql(R.DEFAULT_MASS)})"
    metres = f"coalesce(CASE WHEN {h_unit} LIKE 'f%' THEN {height} * 0.3048 ELSE {height} END, {table_sql(R.DEFAULT_HEIGHT)})"
    fatal = "CASE " + " ".join(f"WHEN kg >= {m} THEN m >= {h}" for m, h in R.FATAL_BANDS) + f" ELSE m >= {R.LIGHT_FATAL_HEIGHT} END"
    over = f"""CASE h.energy WHEN 'electrical' THEN CASE WHEN {v_unit} = 'kv' THEN {volts} * 1000 ELSE {volts} END >= {R.VOLTS}
      WHEN 'pressure' THEN CASE {p_unit} WHEN 'psi' THEN {bar} / 14.5038 WHEN 'kpa' THEN {bar} / 100 WHEN 'mpa' THEN {bar} * 10 ELSE {bar} END >= {R.BAR} WHEN 'thermal' THEN {celsius} >= {R.CELSIUS}
      WHEN 'gravity' THEN kg * {R.GRAVITY} * m >= {R.JOULES} OR ({fatal}) END"""
    return f"weights AS (SELECT *, {kg} AS kg, {metres} AS m FROM judged), energies AS (SELECT *, CASE {over} WHEN true THEN 'EXCEEDS' WHEN false THEN 'BELOW' ELSE 'UNKNOWN' END AS energy_gate FROM weights)"


VETO_HITS = " || ".join(hits_sql(R.SPAN_PATTERNS[role]) for role in G.VETO_ROLES)
ANY_RULE = " OR ".join(has_sql(p) for p in R.SPAN_PATTERNS.values())
BESIDE = " OR ".join(has_sql(R.SPAN_PATTERNS[role]) for role in G.BESIDE)


def composed_sql(table: str, key: str, number: str) -> str:
    return rf"""
WITH typed AS (SELECT {key}, {report_sql(number)} AS t, ({number} * 37 % 101) / 100.0 AS p FROM {table}), {spelled_sql('typed', key)},
judged AS (SELECT s.{key}, trim(s.t) AS t, p, {language_sql()} AS language, CASE {' '.join(f"WHEN {has_sql(p)} THEN '{name}'" for name, p in R.STATEMENT_TYPES.items())} ELSE 'condition_only' END AS statement_type,
  {hazard_sql()} AS h, {tags_sql(R.ACTS)} AS acts, {tags_sql(R.CONDITIONS)} AS conditions, trim(regexp_extract(t, {quoted('(?i)' + R.ACTOR)})) AS actor, {has_sql(R.PASSIVE)} AS passive_victim,
  len(list_filter({VETO_HITS}, lambda x: NOT regexp_full_match(trim(x), {quoted('(?i)' + G.GENERIC[5:])}))) > 0 AS hard, {BESIDE} AS beside,
  {' OR '.join(has_sql(p) for p in R.ROUTINE)} AS routine, regexp_matches(trim(t), {quoted('(?i)' + G.UNSCORABLE[5:])}) OR len(regexp_extract_all(t, '\S+')) <= 3 AS bare
  FROM (SELECT s.{key}, trim(s.t) AS t, y.p FROM spelled s JOIN typed y USING ({key})) s),
{gate_sql()},
gated AS (SELECT *, CASE WHEN routine THEN 'routine' WHEN p > {G.OUT} AND NOT hard THEN 'scope' WHEN p >= {G.SOFT} AND NOT bare AND NOT hard AND NOT (h IS NOT NULL AND (h.name <> '{G.NAMED_ONLY}' OR beside)) AND energy_gate NOT IN ('EXCEEDS', 'BELOW') THEN 'evidence' END AS stage FROM energies)
SELECT {key}, language, statement_type, stage, CASE WHEN stage IS NULL THEN h.name END AS hazard, CASE WHEN stage IS NULL THEN energy_gate ELSE 'NOT_ASSESSED' END AS energy_gate,
  CASE WHEN stage IS NULL THEN array_to_string(acts, '|') ELSE '' END AS acts, CASE WHEN stage IS NULL THEN array_to_string(conditions, '|') ELSE '' END AS conditions,
  CASE WHEN stage IS NULL AND actor <> '' THEN actor END AS actor, stage IS NULL AND passive_victim AS passive_victim, md5(t) AS corrected_md5 FROM gated"""


def composed(rows: DataFrame, key: str, number: Column, dealt_by: str) -> DataFrame:
    typed = rows.select(key, report_text(dealt_by).alias("text"), (number * 37 % 101 / 100.0).alias("p"), F.lit("0").alias("prefilter"))
    found = score(typed, spelling=True, gates={"p": "p", "prefilter": "prefilter"})
    tags = lambda c: F.array_join(F.array_except(F.transform(c, lambda x: x["cue"]), F.array(F.lit("control_absent_span"), F.lit("control_degraded_span"))), "|")
    shift = F.aggregate("changes", F.lit(0), lambda n, c: n + F.length(c["new"]) - (c["end"] - c["start"]))
    # The corrected text again, from the text as typed and the list of what was changed.
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = F.aggregate("changes", begin, lambda s, c: F.struct(c["end"].alias("at"), F.concat(s["out"], F.col("scored_text").substr(s["at"] + 1, c["start"] - s["at"]), c["new"]).alias("out")), lambda s: F.concat(s["out"], F.col("scored_text").substr(s["at"] + 1, F.length("scored_text"))))
    corrected = F.when(F.length(put) == F.length("scored_text") + shift, F.trim(put))
    return found.select(key, "language", "statement_type", "gate.stage", F.col("hazard.name").alias("hazard"), "energy.gate", tags("act_cues").alias("acts"), tags("condition_cues").alias("conditions"), "actor", "passive_victim", F.md5(corrected).alias("corrected_md5")).withColumnRenamed("gate", "energy_gate")


@query(composed_sql("documents", "doc_id", "doc_id"))
def composed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with slips scored by the whole rule stack: language, type, gates, hazard, energy, flags with their cues."""
    return composed(read_texts(spark, sf_dir, "documents"), "doc_id", F.col("doc_id"), "doc_id")


@query(f"""SELECT conv_id, turn, x.* FROM (SELECT *, conv_id * 1000 + turn AS number FROM conversations) c
JOIN ({composed_sql("(SELECT *, conv_id * 1000 + turn AS number FROM conversations)", "number", "number")}) x USING (number)""".replace("x.*", "language, statement_type, stage, hazard, energy_gate, acts, conditions, actor, passive_victim, corrected_md5"))
def composed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the turns of conversations."""
    turns = read_texts(spark, sf_dir, "conversations").withColumn("number", F.col("conv_id") * 1000 + F.col("turn"))
    keys = turns.select("number", "text")
    return composed(keys, "number", F.col("number"), "number").withColumn("conv_id", F.floor(F.col("number") / 1000)).withColumn("turn", F.col("number") % 1000).drop("number")


@query(f"""
WITH typed AS (SELECT doc_id, {report_sql("doc_id")} AS t FROM documents)
SELECT doc_id, 'procedure_not_followed' AS cue, regexp_extract(t, {quoted('(?i)' + R.ACTS[2][0])}) AS text, length(regexp_extract(t, {quoted('(?is)^(.*?)' + R.ACTS[2][0])}, 1)) AS start,
  length(regexp_extract(t, {quoted('(?is)^(.*?)' + R.ACTS[2][0])}, 1)) + length(regexp_extract(t, {quoted('(?i)' + R.ACTS[2][0])})) AS "end" FROM typed WHERE {has_sql(R.ACTS[2][0])}""")
def act_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first cue of a procedure not followed stands, of the texts in which it is the first pattern's."""
    typed = read_texts(spark, sf_dir, "documents").select("doc_id", report_text("doc_id").alias("t"))
    return typed.select("doc_id", F.explode(cues(F.col("t"), [R.ACTS[2]])).alias("c")).select("doc_id", "c.cue", "c.text", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"))
