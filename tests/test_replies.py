"""Damaged replies element by element, spans that annotations quote, and each problem and issue of an annotation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import annotations as A
from quarrylight.operators import replies as L

ONE, TWO = {"a": 1, "t": "x [y] {z}"}, {"a": 2, "t": 'he said "no", twice'}


@pytest.mark.parametrize(
    ("text", "good", "bad"),
    [
        (json.dumps([ONE, TWO]), [ONE, TWO], 0), ("Look: ```json\n[%s]\n``` and [] more" % json.dumps(ONE), [ONE], 0), ('[{"a": 1,}, {"a": 2},]', [{"a": 1}, {"a": 2}], 0), ('[{"a": "he "is" here"}]', [{"a": 'he "is" here'}], 0),
        ('[{"a": "line\nend"}]', [{"a": "line\nend"}], 0), ('[{"a": 1}, {"b": {"c": [1, 2]}}, {"d": "cut of', [{"a": 1}, {"b": {"c": [1, 2]}}], 0), ('[{"a": 1}, {"a": nope}, {"a": 3}]', [{"a": 1}, {"a": 3}], 1), ("<|end|>[{“a”: 1}]</s>", [{"a": 1}], 0),
        ("no array", [], 0), ("", [], 0), (None, [], 0), ("[1, 2]", [], 0), ('{"rows": [{"a": 1}]}', [{"a": 1}], 0), ("```[{\"a\": 1}]``` ```[{\"a\": 1}, {\"a\": 2}]```", [{"a": 1}, {"a": 2}], 0), ('[{"a": "\\"}]"}]', [{"a": '"}]'}], 0), ("[" * 5000, [], 0),
    ],
)
def test_elements(text, good, bad):
    assert L.elements(text) == (good, bad)


def test_cut_anywhere():
    """However an array is cut, all elements that are whole come back."""
    rng = random.Random(1)
    for _ in range(60):
        rows = [{"k": k, "t": "".join(rng.choice('ab ,:{}[]\\"\n') for _ in range(rng.randint(0, 12)))} for k in range(rng.randint(1, 5))]
        strict = [r for r in rows if not any(q in json.dumps(r["t"]) for q in ('\\"',))]
        text = json.dumps(strict)
        ends = [len(json.dumps(strict[: k + 1])) - 1 for k in range(len(strict))]
        for cut in range(1, len(text)):
            got, _ = L.elements(text[:cut])
            assert got == strict[: sum(e <= cut for e in ends)], text[:cut]


def test_first_value():
    assert L.first_value('Well: {"rows": [1, 2], "x": 0} end', "array") == [1, 2] and L.first_value('{"a": 1} tail', "array") == [{"a": 1}]
    assert L.first_value('[{"a": 1}]', "object") == {"a": 1} and L.first_value("```json\n[1,]\n```") == [1] and L.first_value("none") is None and L.first_value("[1, 2") is None and L.first_value(None) is None


def test_replies_of_a_table(spark):
    df = spark.createDataFrame([(1, '[{"a": 1, "b": "x"}, {"a": "no"}]', 5), (2, None, 6), (1, "junk", 7)], "k int, reply string, dropped int").repartition(3)
    rows = L.element_rows(L.reply_elements(df, "reply"), "a int, b string")
    assert sorted((r.k, r.place, r.fields.a, r.fields.b) for r in rows.select("k", "place", "fields").collect()) == [(1, 0, 1, "x"), (1, 1, None, None)]
    assert L.reply_elements(df.where("false"), "reply").collect() == [] and {r.dropped for r in L.reply_elements(df, "reply").collect()} == {0}


PLACES = [
    ("ek do teen", "do", (3, 5, "exact")), ("ek do\n teen", "do teen", (3, 11, "spaces")), ("Ek DO teen", "ek  do", (0, 5, "case")), ("operator line of fire me tha", "operator ... tha", (0, 28, "parts")), ("a (b) c", "(B)  c", (2, 7, "case")), ("🙂 do", "do", (2, 4, "exact")),
    ("ek do", "nahi", None), ("ek do", "", None), ("ek do", None, None), ("", "do", None), ("ek do teen", "teen … ek", None), ("ek do ek", "do...ek", (3, 8, "parts")), (r"a \E b", r"\E  b", (2, 6, "spaces")), ("मजदूर गिर गया", "गिर", (6, 9, "exact")),
]


def test_located(spark):
    df = spark.createDataFrame([(k, t, s) for k, (t, s, _) in enumerate(PLACES)], "k int, t string, s string").select("k", A.located(F.col("t"), F.col("s")).alias("at"))
    assert {r.k: r.at and tuple(r.at) for r in df.collect()} == {k: w for k, (*_, w) in enumerate(PLACES)}


TEXT = "Worker fell 4 m from the scaffold, harness nahi pehna tha, nahi tha guard."


def event(**more):
    base = {"roles": [{"role": "release_cue", "span": "fell 4 m"}], "questions": {"high_energy_present": {"value": True, "span": "4 m"}, "energy_released": {"value": "yes", "span": None}, "serious_injury": {"value": "unknown"}, "direct_control_present": {"value": False, "span": "harness nahi pehna"}}, "barriers": [], "energy_types": ["Gravity", "magic"], "life_saving_rules": ["Working at Height"], "statement_type": "observed", "verdict": "insufficient", "rationale_one_line": 'It says "fell 4 m".'}
    return base | more


CASES = [
    ({}, [], []),
    ({"roles": [{"role": "release_cue", "span": "flew away"}]}, ["role release_cue not in text: flew away"], ["rationale without a span"][:0]),
    ({"roles": [{"role": "villain", "span": "fell"}, {"role": "release_cue", "span": "fell 4 m"}]}, [], ["unknown role villain"]),
    ({"roles": [{"role": "statement_cue", "span": "scaffold"}, {"role": "release_cue", "span": "fell 4 m"}]}, [], ["no marker in statement_cue: scaffold"]),
    ({"roles": [{"role": "energy_cue", "span": "harness nahi"}, {"role": "control_absent", "span": "harness nahi"}]}, [], ["energy_cue on a control"]),
    ({"questions": {"high_energy_present": {"value": "perhaps"}, "energy_released": {"value": True}, "serious_injury": {"value": False, "span": "gone"}}}, ["question direct_control_present missing", "question high_energy_present has no truth value: perhaps"], ["question serious_injury span not in text"]),
    ({"barriers": [{"barrier": "Harness", "status": "absent", "span": "harness"}, {"barrier": "luck", "status": "absent"}, {"barrier": "ppe", "status": "absent"}, {"barrier": "LOTO", "status": "lost"}]}, [], ["unknown barrier luck", "barrier energy_isolation without a status", "ppe is pseudo"]),
    ({"statement_type": "gossip"}, ["unknown statement type gossip"], []),
    ({"verdict": "bad"}, ["unknown verdict BAD"], []),
    ({"verdict": "P_SIF"}, ["verdict P_SIF against answers INSUFFICIENT"], []),
    ({"statement_type": "historical", "verdict": "non_event"}, [], []),
    ({"life_saving_rules": ["Work permit of the moon", "Driving"]}, [], None),
    ({"rationale_one_line": "Because."}, [], ["rationale without a span"]),
    ({"rationale_one_line": None}, [], []),
    ({"roles": [], "verdict": "insufficient"}, [], []),
]


def test_each_problem_and_issue(spark):
    rows = [(k, json.dumps({"text": TEXT, "events": [event(**more)]})) for k, (more, *_) in enumerate(CASES)]
    got = {r.k: r for r in A.judged(spark.createDataFrame(rows, "k int, j string").select("k", F.from_json("j", A.ELEMENT).alias("e")), "e").collect()}
    for k, (_, problems, issues) in enumerate(CASES):
        assert got[k].problems == problems and got[k].accepted == (not problems), (k, got[k].problems)
        assert issues is None or got[k].issues == issues, (k, got[k].issues)
    first = got[0].events[0]
    assert [(r.role, r.span, r.start, r.end) for r in first.roles] == [("release_cue", "fell 4 m", 7, 15)] and first.energy_types == ["gravity"] and first.life_saving_rules == ["Working at Height"] and first.rules_verdict == "INSUFFICIENT"
    assert [(q.question, q.value, q.start) for q in first.questions] == [("high_energy_present", "true", 12), ("energy_released", "true", None), ("serious_injury", "unknown", None), ("direct_control_present", "false", 35)]
    assert [(b.barrier, b.status) for b in got[6].events[0].barriers] == [("fall_arrest", "absent"), ("ppe", "pseudo")]
    assert got[11].issues and got[11].events[0].life_saving_rules[-1] == "Driving"


def test_short_spans_move_into_longer_ones(spark):
    roles = [{"role": "negation_cue", "span": "nahi"}, {"role": "control_absent", "span": "nahi tha guard"}]
    more = [{"text": TEXT, "events": [event(roles=roles)]}, {"text": "ab", "events": [event()]}, {"text": TEXT, "events": []}, {"text": TEXT + " fractured leg", "events": [event(questions={q: {"value": False} for q in A.QUESTIONS}, verdict="LOW_ENERGY")]}, {"text": TEXT + " word" * 400, "events": [event()]}]
    rows = [(k, json.dumps(m)) for k, m in enumerate(more)] + [(9, "null"), (10, None)]
    df = spark.createDataFrame(rows, "k int, j string").select("k", F.from_json("j", A.ELEMENT).alias("e"))
    got = {r.k: r for r in A.judged(df, "e").collect()}
    assert [(r.role, r.start) for r in got[0].events[0].roles] == [("negation_cue", TEXT.index("nahi tha guard")), ("control_absent", TEXT.index("nahi tha guard"))]
    assert got[1].problems == ["text missing or too short"] and got[2].problems == ["no events"] and got[9].problems == got[10].problems == ["text missing or too short"] and got[4].problems == ["text too long"]
    assert got[3].problems == ["no serious injury, but the text says fractured"]
    flat = A.training_rows(df, "e").collect()
    assert [(r.k, r.verdict, r.n_events, len(r.spans), r.energy_types) for r in flat] == [(0, "INSUFFICIENT", 1, 2, ["gravity"])]
