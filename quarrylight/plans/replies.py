"""Registered queries over what models have written: damaged arrays and annotations, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import annotations as A
from quarrylight.operators import replies as L
from quarrylight.plans.registers import dealt, dealt_sql, quoted
from quarrylight.plans.tables import read_texts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


#: What befalls a reply of some turns, by conv_id: a fence, commas at ends, stray tokens, talk around it, a cut in the last element, quotes inside a string.
FAULTS = ["fence", "commas", "stray", "talk", "cut", "quotes"]


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM t WHERE NOT (conv_id % 6 = 4 AND back = 1))
SELECT conv_id, place::INTEGER AS place, turn, md5(CASE WHEN conv_id % 6 = 5 THEN 'He said "stop" in turn ' || turn || chr(10) || 'and left' ELSE text END) AS text_md5, 0 AS dropped FROM k""")
def reply_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of replies that hold a conversation's turns and are damaged in six ways."""
    quotes = F.concat(F.lit('{"turn": '), "turn", F.lit(', "text": "He said "stop" in turn '), "turn", F.lit('\nand left"}'))
    kind = F.col("conv_id") % 6
    whole = F.to_json(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    element = F.when(kind == 5, quotes).when(kind == 1, F.concat(whole.substr(F.lit(1), F.length(whole) - 1), F.lit(",}"))).otherwise(whole)
    turns = read_texts(spark, sf_dir, "conversations").select("conv_id", "turn", element.alias("element"))
    joined = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "element"))), lambda x: x["element"]), ", \n").alias("inner"))
    inner = F.col("inner")
    reply = (
        F.when(kind == 0, F.concat(F.lit("Here [as asked]:\n```json\n["), inner, F.lit("]\n```\nDone {all}.")))
        .when(kind == 1, F.concat(F.lit("["), inner, F.lit(",]")))
        .when(kind == 2, F.concat(F.lit("<|channel_end|>["), F.replace(inner, F.lit(", \n"), F.lit(",<eos>\n")), F.lit("]</s>")))
        .when(kind == 3, F.concat(F.lit("Sure: ["), inner, F.lit("] and [that] is {all}")))
        .when(kind == 4, F.concat(F.lit("["), inner.substr(F.lit(1), F.length(inner) - 2)))
        .otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    )
    damaged = joined.select("conv_id", reply.alias("reply"))
    rows = L.element_rows(L.reply_elements(damaged, "reply"), "turn long, text string")
    return rows.select("conv_id", "place", F.col("fields.turn").alias("turn"), F.md5("fields.text").alias("text_md5"), "dropped")


ANSWERS = ["true", "False", "unknown", "Yes", "no", "maybe", None]
TYPES = ["observed", "historical", "corrective_completed", "Hypothetical", "condition_only", "rumour", "observed"]
SAID = ["EXPOSURE", "NON_EVENT", "p_sif", "SUCCESS", "INSUFFICIENT", "LOW_ENERGY", "WORSE"]
MARKED = ["energy_cue", "release_cue", "control_absent", "culprit"]
TIDY = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^ -~]+', ' ', 'g'), '\\s+', ' ', 'g'))"
#: The span that an annotation quotes: a word of the text, two words further apart, two in capitals, the ends with dots between, or what isn't there.
SPAN_SQL = "CASE n % 5 WHEN 0 THEN w[len(w) // 2 + 1] WHEN 1 THEN w[1] || '   ' || w[2] WHEN 2 THEN upper(w[1] || ' ' || w[2]) WHEN 3 THEN w[1] || ' ... ' || w[len(w)] ELSE 'nowhere to be seen' END"


@query(rf"""
WITH d AS (SELECT conv_id, turn, {TIDY} AS t, conv_id * 10 + turn AS n FROM conversations), w AS (SELECT *, string_split(t, ' ') AS w FROM d), s AS (SELECT *, {SPAN_SQL} AS s FROM w),
l AS (SELECT *, CASE WHEN trim(s) = '' OR s IS NULL THEN NULL WHEN strpos(t, s) > 0 THEN [strpos(t, s) - 1, strpos(t, s) - 1 + length(s)] WHEN strpos(t, regexp_replace(trim(s), '\s+', ' ', 'g')) > 0 THEN [strpos(t, regexp_replace(trim(s), '\s+', ' ', 'g')) - 1, strpos(t, regexp_replace(trim(s), '\s+', ' ', 'g')) - 1 + length(regexp_replace(trim(s), '\s+', ' ', 'g'))]
  WHEN strpos(lower(t), lower(s)) > 0 THEN [strpos(lower(t), lower(s)) - 1, strpos(lower(t), lower(s)) - 1 + length(s)]
  WHEN n % 5 = 3 AND strpos(substr(t, length(w[1]) + 1), w[len(w)]) > 0 THEN [0, length(w[1]) + strpos(substr(t, length(w[1]) + 1), w[len(w)]) - 1 + length(w[len(w)])] END AS pl,
  len(regexp_extract_all(t, '\w+(?:[-_]\w+)*|[^\w\s]')) AS tokens FROM s),
a AS (SELECT *, {dealt_sql(MARKED, 'n')} AS role, lower({dealt_sql(TYPES, 'n', 3)}) AS st, upper({dealt_sql(SAID, 'n', 2)}) AS v, [{', '.join(dealt_sql(ANSWERS, 'n', k) for k in (2, 3, 5, 7))}] AS raw FROM l),
b AS (SELECT *, len(regexp_extract_all(substr(t, (pl[1] + 1)::BIGINT, (pl[2] - pl[1])::BIGINT), '\w+(?:[-_]\w+)*|[^\w\s]')) > 12 AS wide, list_transform(raw, lambda x: CASE WHEN lower(x) IN ('true', 'yes') THEN true WHEN lower(x) IN ('false', 'no') THEN false END) AS q, CASE WHEN st IN ({', '.join(map(quoted, A.STATEMENT_TYPES))}) THEN st ELSE 'observed' END AS kt,
  regexp_extract(t, {quoted(A.SERIOUS.replace('(?iU)', '(?i)'))}) AS hurt FROM a),
c AS (SELECT *, role <> 'culprit' AND pl IS NOT NULL AND NOT wide AS marked, CASE WHEN kt IN ('hypothetical', 'historical', 'training_example') THEN 'NON_EVENT' WHEN q[1] IS NULL THEN 'INSUFFICIENT' WHEN NOT q[1] THEN CASE WHEN q[3] THEN 'L_SIF' ELSE 'LOW_ENERGY' END WHEN q[2] IS NULL THEN 'INSUFFICIENT'
  WHEN q[2] THEN CASE WHEN q[3] THEN 'H_SIF' WHEN q[3] IS NULL THEN 'INSUFFICIENT' WHEN q[4] THEN 'CAPACITY' WHEN NOT q[4] THEN 'P_SIF' ELSE 'INSUFFICIENT' END WHEN kt = 'corrective_completed' THEN NULL WHEN q[4] THEN 'SUCCESS' WHEN NOT q[4] THEN 'EXPOSURE' ELSE 'INSUFFICIENT' END AS rv FROM b),
p AS (SELECT *, list_filter(list_concat([CASE WHEN role <> 'culprit' AND pl IS NULL THEN 'role ' || role || ' not in text: ' || substr(coalesce(s, 'None'), 1, 40) END, CASE WHEN role <> 'culprit' AND wide THEN 'role ' || role || ' too long' END],
  list_transform(range(1, 5), lambda k: CASE WHEN raw[k] = 'maybe' THEN 'question ' || (['high_energy_present', 'energy_released', 'serious_injury', 'direct_control_present'])[k] || ' has no truth value: maybe' END),
  [CASE WHEN q[3] = false AND hurt <> '' AND NOT regexp_matches(t, {quoted(A.NO_INJURY.replace('(?iU)', '(?i)'))}) THEN 'no serious injury, but the text says ' || hurt END, CASE WHEN st <> kt THEN 'unknown statement type ' || st END, CASE WHEN v = 'WORSE' THEN 'unknown verdict WORSE' END,
  CASE WHEN v <> 'WORSE' AND rv IS NULL AND v NOT IN ('EXPOSURE', 'SUCCESS', 'INSUFFICIENT') THEN 'verdict not allowed after a corrective action: ' || v END, CASE WHEN v <> 'WORSE' AND rv <> v AND NOT (v = 'NON_EVENT' AND rv = 'LOW_ENERGY') THEN 'verdict ' || v || ' against answers ' || rv END,
  CASE WHEN NOT marked AND v NOT IN ('NON_EVENT', 'INSUFFICIENT', 'LOW_ENERGY') THEN 'no role' END]), lambda x: x IS NOT NULL) AS problems FROM c)
SELECT conv_id, turn, tokens >= 3 AND tokens <= 380 AND len(problems) = 0 AS accepted, CASE WHEN tokens < 3 THEN 'text missing or too short' ELSE array_to_string(list_concat(CASE WHEN tokens > 380 THEN ['text too long'] ELSE CAST([] AS VARCHAR[]) END, problems), '|') END AS problems,
  CASE WHEN tokens >= 3 AND role = 'culprit' THEN 'unknown role culprit' ELSE '' END AS issues, CASE WHEN tokens >= 3 AND marked THEN pl[1] || ':' || pl[2] ELSE '' END AS span FROM p""")
def judged_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of every turn judged: spans quoted in five ways, answers, types and verdicts that do or don't agree."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]+", " "), r"\s+", " "))
    turns = read_texts(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"), (F.col("conv_id") * 10 + F.col("turn")).alias("n")).withColumn("w", F.split("t", " "))
    w: Column = F.col("w")
    word = lambda k: F.get(w, k - 1 if isinstance(k, Column) else F.lit(k - 1))
    kind = F.col("n") % 5
    span = F.when(kind == 0, word(F.floor(F.size(w) / 2).cast("int") + 1)).when(kind == 1, F.concat(word(1), F.lit("   "), word(2))).when(kind == 2, F.upper(F.concat(word(1), F.lit(" "), word(2)))).when(kind == 3, F.concat(word(1), F.lit(" ... "), word(F.size(w)))).otherwise("nowhere to be seen")
    asked = F.struct(*(F.struct(dealt(ANSWERS, "n", k).alias("value"), F.lit(None).cast("string").alias("span")).alias(q) for q, k in zip(A.QUESTIONS, (2, 3, 5, 7), strict=True)))
    event = F.struct(F.array(F.struct(dealt(MARKED, "n").alias("role"), span.alias("span"))).alias("roles"), asked.alias("questions"), F.array().cast("array<struct<barrier:string,status:string,span:string>>").alias("barriers"), F.array().cast("array<string>").alias("energy_types"), F.array().cast("array<string>").alias("life_saving_rules"), dealt(TYPES, "n", 3).alias("statement_type"), dealt(SAID, "n", 2).alias("verdict"), F.lit(None).cast("string").alias("rationale_one_line"))
    # Through JSON, as annotations come from a model.
    written = turns.select("conv_id", "turn", F.from_json(F.to_json(F.struct(F.col("t").alias("text"), F.array(event).alias("events"))), A.ELEMENT).alias("element"))
    found = A.judged(written, "element")
    spans = F.array_join(F.transform(F.flatten(F.transform("events", lambda e: e["roles"])), lambda r: F.concat_ws(":", r["start"], r["end"])), "|")
    return found.select("conv_id", "turn", "accepted", F.array_join("problems", "|").alias("problems"), F.array_join("issues", "|").alias("issues"), F.coalesce(spans, F.lit("")).alias("span"))
