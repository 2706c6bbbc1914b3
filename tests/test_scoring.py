"""The scorer on sentences of both scripts, on barriers that a model names, and on its own path."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import rules as R
from quarrylight.operators.scoring import SPAN, fused_spans, harms, person_fall_exceeds, score

#: One sentence for each class of harm and script: text, class, severity level.
HARMS = [
    ("The rigger died on site.", "fatal", 3), ("मजदूर की मौत हो गई", "fatal", 3), ("His hand was amputated.", "amputation", 3), ("उंगली कट कर अलग हो गई", "amputation", 3), ("Leg fracture reported", "fracture", 3), ("पैर की हड्डी टूट गई", "fracture", 3),
    ("pair toot gaya", "break", 3), ("पैर टूट गया", "break", 3), ("he was unconscious", "unconscious", 3), ("वह बेहोश था", "unconscious", 3), ("dum ghutne laga", "asphyxia", 3), ("उसका दम घुटने लगा", "asphyxia", 3),
    ("usko current laga", "electric_shock", 3), ("उसे करंट लगा", "electric_shock", 3), ("haath jal gaya", "burn", 3), ("हाथ जल गया", "burn", 3), ("skin irritation", "chemical_irritation", 1), ("त्वचा में जलन", "chemical_irritation", 1),
    ("chakkar aane laga", "poisoning", 1), ("उल्टी हुई", "poisoning", 1), ("foot crushed", "crush", 3), ("पैर दब गया", "crush", 3), ("knee cut", "cut", 2), ("हाथ में घाव", "cut", 2), ("knee bruise", "bruise", 1), ("घुटने में सूजन", "bruise", 1),
    ("he was injured", "generic", 1), ("उसे चोट आई", "generic", 1), ("halka burn on the arm", "burn", 2), ("finger fracture", "fracture", 2), ("eyes cut", "cut", 3), ("आंख में घाव", "cut", 3),
]


def test_harm_of_each_class_and_script(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(HARMS)], "k int, t string").select("k", harms(F.col("t"), F.lit(None).cast("string")).alias("h"))
    for r in df.collect():
        text, harm, level = HARMS[r.k]
        assert [(h.harm, h.level) for h in r.h] == [(harm, level)], (text, r.h)
        assert all(text[h.start : h.end] == h.text for h in r.h)
    assert {h for _, h, _ in HARMS} == set(R.HARMS) == set(R.HARM_LEVELS)


def test_harms_that_are_none(spark):
    for text in ("no injury", "koi chot nahi lagi", "lanyard toot gaya", "कोई चोट नहीं लगी", "burner"):
        assert spark.range(1).select(harms(F.lit(text), F.lit(None).cast("string")).alias("h")).first().h == [], text
    jalan = spark.range(1).select(harms(F.lit("aankh me jalan"), F.lit("chemical")).alias("h")).first().h
    assert [(h.harm, h.part, h.level) for h in jalan] == [("chemical_irritation", "eyes", 3)]


# A noun that a model takes for a control, in sentences where nothing held; in the last one a real barrier did. That a
# pipeline is an energy and no barrier is known from a mined lexicon alone.
BARRIERS = [
    ("Derrick pe 12 meter height pe kaam kar raha tha, helmet ka chin strap khula tha.", "chin strap", False), ("Portable DG set ka exhaust room ke andar tha aur darwaza band tha.", "darwaza", False),
    ("Trench ke bilkul kinare pe excavated soil rakhi hui thi, depth 3 m.", "excavated soil", False), ("Pipeline se illegal tapping ki koshish dekhi gayi, aas paas log maujud the.", "Pipeline", False), ("Mud pump ka relief valve line blocked mili.", "relief valve", False),
    ("Escape ladder ka niche ka portion tuta hua tha, platform pe do log kaam kar rahe the.", "Escape ladder", False), ("Line ka pressure high tha aur worker ne flange kholna shuru kiya.", "flange", False),
    ("Height 10 meter pe kaam, worker ne full body harness pehna tha aur anchor point verified tha.", "full body harness", True),
]


def test_barriers_that_a_model_names(spark):
    rows = [(k, t, [("control_present", noun, t.index(noun), t.index(noun) + len(noun), "gliner", 0.71)]) for k, (t, noun, _) in enumerate(BARRIERS)]
    df = spark.createDataFrame(rows, f"k int, text string, found {SPAN}")
    got = {r.k: r.verdict for r in score(df, lexicon={"energy_cue": ["pipeline"]}, model_spans="found", fuse=False).select("k", "verdict").collect()}
    assert {k: v == "SUCCESS" for k, v in got.items()} == {k: held for k, (*_, held) in enumerate(BARRIERS)}, got


def test_fused_spans(spark):
    own = [("energy_cue", "12 m", 3, 7, "rules", 1.0), ("outcome_cue", "burn", 10, 14, "rules:mined", 0.9)]
    model = [("energy_cue", "at 12 m", 0, 7, "gliner", 0.8), ("outcome_cue", "burn", 10, 14, "gliner", 0.95), ("release_cue", "fell", 20, 24, "gliner", 0.7), ("release_cue", "hit", 30, 33, "gliner", 0.4), ("energy_cue", "x", 40, 41, "gliner", 0.6)]
    out = spark.createDataFrame([(own, model)], f"a {SPAN}, b {SPAN}").select(fused_spans(F.col("a"), F.col("b")).alias("s")).first().s
    assert [(s.role, s.start, s.source, s.score) for s in out] == [("energy_cue", 3, "rules+gliner", 1.0), ("outcome_cue", 10, "rules+gliner", 0.95), ("release_cue", 20, "gliner", 0.7), ("energy_cue", 40, "gliner", 0.6)]


@pytest.mark.parametrize(("text", "want"), [("fell 2 m", True), ("fell 3 ft", False), ("4 feet high", True), ("fell down", None)])
def test_person_fall(spark, text, want):
    assert spark.range(1).select(person_fall_exceeds(F.lit(text)).alias("x")).first().x is want


def test_paths_and_flags(spark):
    texts = ["During training the drill was demonstrated.", "A spanner fell from the monkey board 20 m near two workers, no barricading.", "Harness worn and lanyard anchored at height, worker slipped but no fall.", "", "Worker did not wear harness, floor was slippery and rope damaged."]
    rows = {r.k: r for r in score(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()}
    assert rows[0].decision_path == "statement_type=training_example -> NON_EVENT"
    assert rows[1].decision_path == "high_energy=True AND energy_released=True AND serious_injury=False AND control_present=False -> P_SIF"
    assert rows[2].decision_path.endswith("control_present=True -> SUCCESS") and rows[3].decision_path == "high_energy=unknown -> INSUFFICIENT"
    assert all(r.decision_path.endswith(f"-> {r.verdict}") for r in rows.values())
    assert rows[4].primary_flag == "UC" and rows[4].unsafe_act and rows[3].primary_flag is None


def composed(spark, rows, **more):
    """Rows (text, p) through the whole stack."""
    df = spark.createDataFrame([(k, t, p, "0") for k, (t, p) in enumerate(rows)], "k int, text string, p double, prefilter string")
    return {r.k: r for r in score(df, spelling=True, gates={"p": "p", "prefilter": "prefilter"}, **more).collect()}


def test_misspelt_reports(spark):
    """Patterns read the corrected text; what comes back is what was typed, where it was typed."""
    texts = ["  Worker ne harnes nhi pehna, 12 m hight pe kaam.", "Presure line leek, haath jl gya.", "manager ko permision nhi thi, non permited area me chala gya", "Bina permision ke panl khola.", None, "nhi " * 200 + "gir gya"]
    rows = composed(spark, [(t, 0.0) for t in texts])
    for k, text in enumerate(texts):
        r, typed = rows[k], (text or "").strip()
        assert r.scored_text == typed
        for s in [*r.spans, *r.harms, *r.act_cues, *r.condition_cues]:
            assert typed[s.start : s.end].strip() == s.text.strip(), (k, s)
        for name in ("high_energy_present", "energy_released", "serious_injury", "direct_control_present"):
            if (f := r[name]).span_start is not None:
                assert typed[f.span_start : f.span_end] == f.span
    assert [(c.old, c.new) for c in rows[0].changes] == [("harnes", "harness"), ("nhi", "nahi"), ("hight", "height")]
    assert [(c.cue, c.text, c.start) for c in rows[0].act_cues] == [("ppe_not_worn", "nhi pehna", 17)] and rows[0].hazard.name == "fall_from_height"
    assert [(h.harm, h.part, h.text) for h in rows[1].harms] == [("burn", "hand", "jl gya")] and rows[1].serious_injury.value and rows[1].verdict == "H_SIF"
    plain = score(spark.createDataFrame([(texts[1],)], "text string")).first()
    assert plain.harms == [] and plain.verdict != "H_SIF"
    assert rows[4].verdict == "INSUFFICIENT" and rows[4].changes == [] and len(rows[5].changes) == 201


def test_gated_reports(spark):
    rows = composed(spark, [("Canteen me khana thanda tha aaj bhi.", 0.95), ("Worker fell from the scaffold.", 0.95), ("Canteen me khana thanda tha aaj bhi.", 0.5), ("Canteen me khana thanda tha aaj bhi.", 0.2), ("Vehicle arrived at the gate, worker fell.", 0.0), ("Nil", 0.5), ("Truck khada tha canteen ke paas.", 0.5), ("Canteen me khana thanda tha aaj bhi.", None)])
    assert {k: (r.gate.stage, r.verdict) for k, r in rows.items() if r.gate.reject} == {0: ("scope", "OUT_OF_SCOPE"), 2: ("evidence", "OUT_OF_SCOPE"), 4: ("routine", "NON_EVENT"), 6: ("evidence", "OUT_OF_SCOPE")}
    for k in (0, 2, 4, 6):
        r = rows[k]
        assert r.route == "gated" and not r.review_required and r.hazard is None and r.harms == [] and r.act_cues == [] and r.energy.gate == "NOT_ASSESSED" and r.flag_confidence == 0 and r.primary_flag is None
        assert all(r[f].value is None and r[f].source == f"not_asked({r.gate.stage})" for f in ("high_energy_present", "energy_released", "serious_injury", "direct_control_present"))
    assert rows[0].confidence == 0.95 and rows[4].confidence == 1.0 and rows[4].decision_path == "routine -> NON_EVENT"
    assert [s.role for s in rows[4].spans if s.role == "release_cue"] == ["release_cue"]
    assert rows[1].gate.evidence[0] == "rule span release_cue=fell"
    df = spark.createDataFrame([(1, "All quiet on the site today.", "routine_operations", 0.9, 0.1), (2, "All quiet on the site today.", "routine_operations", 0.9, 0.5), (3, "All quiet on the site today.", "incident", 0.9, 0.1)], "k int, text string, e string, c double, s double")
    assert [r.gate.stage for r in score(df, gates={"event_type": "e", "event_p": "c", "p_safety": "s"}).orderBy("k").collect()] == ["routine", None, None]


def test_hazards_by_meaning(spark):
    text = "Sulphur ki wajah se sab bahar aaye."
    span = lambda p: [("energy_cue", "Sulphur", 0, 7, "gliner", p)]
    rows = [(1, text, ("confined_space", 0.61), span(0.55)), (2, text, ("confined_space", 0.61), span(0.4)), (3, text, None, span(0.55)), (4, "A harness hung there.", ("confined_space", 0.61), []), (5, text, ("confined_space", 0.61), span(0.7)), (6, text, ("unheard", 0.9), span(0.55))]
    df = spark.createDataFrame(rows, f"k int, text string, meant struct<hazard:string,score:double>, found {SPAN}")
    got = {r.k: r for r in score(df, model_spans="found", semantic="meant").collect()}
    assert {k: r.hazard and r.hazard.name for k, r in got.items()} == {1: "confined_space", 2: None, 3: None, 4: "fall_from_height", 5: "confined_space", 6: None}
    assert [(s.source, s.text) for s in got[1].spans if s.role == "energy_cue"] == [("gliner+semantic", "Sulphur")] and got[1].high_energy_present.source == "gliner+semantic"
    assert got[2].high_energy_present.value is None and got[5].high_energy_present.source == "gliner"


def test_cues_in_the_order_of_the_patterns(spark):
    """The tag's first pattern that hits gives the text, not the leftmost match."""
    texts = ["failed to wear it, helmet pehne bina", "not wearing gloves, harness nahi pehna", "almost hit by a trolley", "The valve was damaged.", "LOTO nahi tha", "🙂 Mistri ne loto hata diya"]
    rows = {r.k: r for r in score(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect()}
    assert [(c.cue, c.text, c.start, c.end) for c in rows[0].act_cues] == [("procedure_not_followed", "failed to wear", 0, 14), ("ppe_not_worn", "pehne bina", 26, 36)]
    assert [(c.cue, c.text) for c in rows[1].act_cues] == [("ppe_not_worn", "nahi pehna")]
    assert rows[2].passive_victim and rows[2].unsafe_act and rows[2].act_cues == [] and rows[2].flag_confidence == 0.35
    assert [(c.cue, c.text) for c in rows[3].condition_cues] == [("damaged_equipment", "damaged")] and rows[3].flag_confidence == 0.53
    assert [(c.cue, c.start) for c in rows[4].condition_cues] == [("control_absent_span", 0)]
    assert rows[5].actor == "Mistri" and [(c.cue, texts[5][c.start : c.end]) for c in rows[5].act_cues] == [("control_bypassed", "hata diya")] and rows[5].flag_confidence == 0.61


def test_beginnings_miss_no_match(spark):
    """Every pattern that whole texts are searched for, held against the pattern alone, in texts cut from the rules' own words and odd letters."""
    from quarrylight.functions.spans import FLAGS, beginnings, begins, matches, may_match
    from quarrylight.operators.scoring import SOUGHT

    assert all(begins(p) for p in SOUGHT)
    random.seed(3)
    pieces = sorted({w for p in SOUGHT for w in re.findall(r"[\wऀ-ॿ]+", re.sub(r"\\.", " ", p))}) + ["Kick", "ſlipped", "GİRA", "12 kv", "3 log", "किसी", "電", "मौत", "\x01", "n't", "कट कर अलग"]
    texts = ["".join(random.choice(pieces) + random.choice([" ", "  ", "\n", "-", "", ". ", "́ "]) for _ in range(random.randrange(1, 40))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in [*texts, *(t.upper() for t in texts), "", "Zzz qq."]], "t string").withColumn("b", beginnings(F.col("t"), SOUGHT)).localCheckpoint()
    for pattern in SOUGHT:
        wrong = F.transform(matches(F.col("t"), pattern, F.col("b")), lambda m: m["text"]) != F.regexp_extract_all("t", F.lit(FLAGS + pattern), 0)
        assert df.where(wrong | (~may_match(F.col("b"), pattern) & F.col("t").rlike(FLAGS + pattern))).count() == 0, pattern
    assert df.where("t = 'Zzz qq.'").first().b == "\x01"
