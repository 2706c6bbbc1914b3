"""Steps whose time or volume grew too fast: work that was done several times over, or by few tasks."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarrylight.functions import reports as R
from quarrylight.functions import rules as RULES
from quarrylight.functions import spans as N
from quarrylight.operators import audit as U
from quarrylight.operators import curation as C
from quarrylight.operators import dedup as D
from quarrylight.operators import pages as P
from quarrylight.operators import spelling as S
from quarrylight.operators.scoring import energy_gate

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_dealt_before_they_are_taken_apart_and_tidied_once(spark):
    pages = spark.createDataFrame([(k, 1, "a  b\n\n c\n7") for k in range(8)] + [(9, 1, None)], "f int, p int, t string").coalesce(1)
    lines = P.page_lines(pages, ["f"], "p", "t")
    assert lines.rdd.getNumPartitions() == 4 and lines.count() == 16
    assert plan(lines).count("translate") == 1


def test_record_types_seek_each_cue_once(spark):
    rows = [(1, "It could have been fatal."), (2, "Could be.\nHe died"), (3, "An LTI and a hipo."), (4, "no lti; first aid"), (5, "étatal fatality"), (6, ""), (7, None), (8, "dropped object injury, dropped object"), (9, "hospital")]
    docs = spark.createDataFrame(rows, "id int, t string")
    t = F.col("t")
    facts = docs.withColumn("b", R.report_cues(t)).select("id", R.actual_fatality(t, F.col("b")).alias("f"), R.outcome(t, F.col("b")).alias("o"), R.record_type(t).alias("r"), R.actual_fatality(t).alias("f2"), R.outcome(t).alias("o2"))
    got = {r.id: r for r in facts.collect()}
    assert all((r.f, r.o) == (r.f2, r.o2) for r in got.values())
    assert [(got[k].o, got[k].r) for k in range(1, 10)] == [(None, "incident"), (None, "fatal"), ("lost_time_injury", "near_miss"), (None, "injury"), ("fatality", "fatal"), (None, "incident"), (None, "incident"), ("equipment_damage", "injury"), (None, "injury")]
    assert plan(E.queries()["record_types"](spark, SF)).count("were killed") <= 3


def test_entries_are_walked_once(spark):
    assert plan(E.queries()["nested_terms"](spark, SF)).count("array_sort") == 1


def test_audits_read_a_text_once_for_all_cues(spark):
    docs = spark.createDataFrame([("a", "The crane fell on a truck. Fire!"), ("a", None), ("b", "no injury on the rig floor")], "s string, t string")
    found = U.source_audit(docs, "s", "t", F.lit("k"), F.lit("english"), ["english"], U.DOMAINS, F.lit(True))
    got = {r.source: r for r in found.collect()}
    assert got["a"].energy_cue == "50%" and got["a"].multi_energy_rows == 1 and got["b"].near_miss_like == "100%" and got["b"].top_domains == ["drilling_well:1"]
    assert "__begun" in plan(found)


def test_sets_are_made_once_and_shingles_counted_in_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "A b, c d!"), (3, "x"), (4, " ,. "), (5, None), (6, "")], "id int, t string")
    sets = D.shingle_sets(docs, "id", "t", 3)
    assert plan(sets).count("xxhash64") == 2
    assert {r.id: len(r.own) for r in sets.collect()} == {1: 2, 2: 2, 3: 1}
    own = D._written(sets)
    assert D.parts(own) == 4 and {tuple(r) for r in D.prefix_posts(own, 85).select("id", "size", "left").collect()} == {(1, 2, 2), (2, 2, 2)}


def test_a_guard_normalises_texts_once(spark):
    corpus = spark.createDataFrame([(1, "One two three four"), (2, "other words here now"), (3, None)], "id int, t string")
    held = spark.createDataFrame([(9, "one, two three FOUR")], "id int, t string")
    left = C.leakage_guard(corpus, held, "id", "t")
    assert sorted(r.id for r in left.collect()) == [2, 3] and "lower(" not in plan(left)


def test_short_words_are_held_within_two_letters_of_a_term(spark):
    words = spark.createDataFrame([("hanress",), ("lanyerd",), ("lanyxyd",), ("hydrualic",), ("electircain",)], "w string")
    found = words.select("w", S.correction(F.col("w")).alias("fix"))
    assert {r.w: r.fix for r in found.collect()} == {"hanress": "harness", "lanyerd": "lanyard", "lanyxyd": None, "hydrualic": "hydraulic", "electircain": "electrician"}
    assert "Some(2)" in plan(found)


def test_words_are_corrected_once_a_worker(spark):
    """A word's fix is kept by the worker, as the column expression gives it, and no more words than are allowed."""
    words = ["hanress", "lanyerd", "lanyxyd", "hydrualic", "electircain", "harnessed", "morning", "sacffoldnig", "barricadng"]
    fixes = {r.w: r.fix for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", S.correction(F.col("w")).alias("fix")).collect()}
    assert [S.near_term(w) for w in words] == [None if w in ("harnessed", "morning") else fixes[w] for w in words]
    S.FIXES.clear()
    got = S.corrected(pa.array(["Hanress nhi, hanress", "all well", "", None])).to_pylist()
    assert got[0]["text"] == "Harness nahi, harness" and [(c["start"], c["new"]) for c in got[0]["changes"]] == [(0, "Harness"), (8, "nahi"), (13, "harness")]
    assert all(r == {"text": None, "changes": []} for r in got[1:]) and set(S.FIXES) == {"Hanress", "nhi", "hanress", "all", "well"}


def test_matches_compile_no_pattern_for_each_text(spark):
    """``split`` by a pattern compiles it for every text: what stands between matches is found without."""
    docs = spark.createDataFrame([("no fall, \x01 no drop",), ("x",), ("",), ("no spill",), (None,), ("\x01no fall\x02",)], "t string")
    pattern = RULES.SPAN_PATTERNS["no_release_cue"]
    found = docs.select("t", N.matches(F.col("t"), pattern).alias("m"), N.first_match(F.col("t"), pattern).alias("f"))
    assert plan(found).count("split(") == plan(found).count(f", {N.PART}, -1)") > 0
    for r in found.collect():
        assert [(m.start, m.end) for m in r.m or []] == [m.span() for m in re.finditer(pattern, r.t or "")]
        assert (r.f and r.f.start) == (r.m[0].start if r.m else None)


def test_mass_and_height_are_sought_once(spark):
    gate = spark.createDataFrame([("a spanner of 2 kg fell 12 m", "gravity"), ("a spanner", "gravity"), ("440 volt", "electrical"), ("x", None)], "t string, k string").select(energy_gate(F.col("t"), F.col("k")).alias("e"))
    assert plan(gate).count("cargo net") == 1
    assert [tuple(r.e) for r in gate.collect()] == [("EXCEEDS", 235.0, "stated"), ("UNKNOWN", None, "insufficient"), ("EXCEEDS", None, "stated"), ("UNKNOWN", None, None)]
