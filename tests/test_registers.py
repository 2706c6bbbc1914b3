"""Register projections, spelling and semantic types on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import registers as R
from quarrylight.operators import spelling as S
from quarrylight.operators.corpus import semantic_types

GOLD = "report_text string, statement_type string, energy_source string, barrier string, barrier_status string, sif_potential string, trap_type string, lsr string, exposure string, confidence string"


def test_gold_labels(spark):
    rows = [
        ("He fell from the ladder and was not hurt", "observed", "gravity_height", "harness", "intact", "YES", "", "Working at Height", "present", "0.8"),
        ("Nil", "unscorable", "none", "Safety boots", "failed", "YES", "multi_rule", "NONE", "absent", "x"),
        (None,) * 10,
    ]
    first, second, empty = R.gold_labels(spark.createDataFrame(rows, GOLD)).collect()
    assert (first["barrier_class"], first["status"], first["verdicts"], first["flags"]) == ("fall_arrest", "present_effective", ["CAPACITY"], [])
    assert (second["statement"], second["status"], second["verdicts"]) == ("condition_only", "pseudo", ["EXPOSURE", "P_SIF"])
    assert second["flags"] == ["sif_yes_but_energy_none", "multi_rule_but_single_lsr", "very_short_text", "sif_yes_no_lsr", "exposure_absent_but_sif_yes", "confidence_not_numeric"]
    assert (empty["statement"], empty["energies"], empty["barrier_class"], empty["trap_family"]) == ("observed", [], None, "none")
    assert empty["flags"] == ["unknown_statement_type:", "unknown_energy:", "very_short_text", "confidence_not_numeric"]


def test_severe_injuries_need_their_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        R.severe_injuries(spark.createDataFrame([(1,)], "ID int"), {"osha_id": "ID"})


def test_register_day(spark):
    given = ["03/04/2019 10:00", "25/03/2019", "2019-3-4", "3/4/19", "3/4/70", "4 March", None]
    got = [str(r[0]) for r in spark.createDataFrame([(x,) for x in given], "d string").select(R.register_day(F.col("d"))).collect()]
    assert got == ["2019-03-04", "2019-03-25", "2019-03-04", "2019-03-04", "1970-03-04", "None", "None"]


def test_mine_accidents(spark):
    told = "A PUMP JACK ON THE SURFACE HIT THE HAND OF A MAN WHO STOOD BY."
    rows = [(1, "0", "HAULAGE", "Surface", told), (2, "1", "FALL OF ROOF", None, told), (3, "2.0", None, "Face", told), (4, "1", None, None, told), (5, "3", None, None, told), (6, "0", None, None, "short"), (7, None, None, None, None)]
    found = R.mine_accidents(spark.createDataFrame(rows, "id int, degree string, classification string, location string, narrative string"))
    got = {r["id"]: r for r in found.collect()}
    assert sorted(got) == [1, 4] and got[4]["record_type"] == "fatal" and got[1]["narrative"].startswith("A pump jack") and got[1]["oilgas_score"] == 2
    chosen = R.train_candidates(found.withColumn("year", F.lit(None).cast("int")).withColumn("is_duplicate", F.col("id") == 4), "id")
    assert {r["id"]: r["split_hint"] for r in chosen.collect()} == {1: "train_candidate", 4: "eval_pool"}


def plain_edits(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_edits(spark):
    """The count by built-in functions against the table of all prefixes, on terms with up to three edits."""
    rng = random.Random(5)
    terms = [t for t in S.CORE_TERMS if len(t) > 5]
    rows = [("abcdef", "abcdef"), ("abcdefghij", "badcefghij"), ("abcdefghij", "abcdefghxi"), ("abcdefghij", "bxacdefghij"), ("aabbccddee", "ababccddee"), ("ab", "ba")]
    for _ in range(1500):
        word = term = rng.choice(terms)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("aeinrst") + word[k:], word[:k] + rng.choice("aeinrst") + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]])
        rows.append((word, term))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", *(S.edits(F.col("a"), F.col("b"), F.lit(cap)).alias(f"d{cap}") for cap in (1, 2)))
    for r in df.collect():
        want = plain_edits(r.a, r.b)
        assert (r.d1, r.d2) == (want if want <= 1 else None, want if want <= 2 else None), r


def test_spelling(spark):
    texts = ["Barrikading nhi, PRESURE high", "machines request morning chala", "वाल्व leek हुआ", "", None, "no  change", "scafoldnig " * 300]
    df = S.normalised(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    got = {r["id"]: r for r in df.collect()}
    assert got[0]["normalised"] == "Barricading nahi, Pressure high"
    assert [(c["old"], c["start"], c["end"]) for c in got[0]["changes"]] == [("Barrikading", 0, 11), ("nhi", 12, 15), ("PRESURE", 17, 24)]
    assert got[1]["changes"] == [] and got[2]["normalised"] == "वाल्व leak हुआ" and got[3]["normalised"] == "" and got[4]["normalised"] is None and got[5]["normalised"] == "no  change"
    twice = S.normalised(spark.createDataFrame([(None, "presure gauge")] * 2 + [(1, "presure leek"), (1, "presure high"), (1, None)], "id int, text string")).collect()
    assert sorted(r["normalised"] or "" for r in twice) == ["", "pressure gauge", "pressure gauge", "pressure high", "pressure leak"]
    assert got[6]["normalised"] == "scaffolding " * 300 and got[6]["changes"][-1]["start"] == 299 * 11


def test_offsets_lead_back(spark):
    df = S.normalised(spark.createDataFrame([(1, "gass nhi presure")], "id int, text string"))
    assert df.first()["normalised"] == "gas nahi pressure"
    spans = [(0, 3), (4, 8), (9, 17), (0, 17), (5, 6), (3, 4), (2, 2)]
    back = [S.restored(F.col("changes"), F.lit(a), F.lit(b)).alias(f"s{k}") for k, (a, b) in enumerate(spans)]
    row = df.select(*back).first()
    assert [tuple(x) for x in row] == [(0, 4), (5, 8), (9, 16), (0, 16), (5, 8), (4, 5), (2, 2)]


def test_semantic_types(spark):
    protos = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), (None, [0.7, 0.7])], "proto_label string, proto array<double>")
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [0.0, 3.0]), (7, [1.0, 0.0, 0.0]), (8, [1.0]), (9, [float("nan"), 1.0]), (10, [None, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["best"], r["runner_up"]) for r in semantic_types(rows, protos).orderBy("vec_id").collect()] == [(1, "a", "b"), (6, "b", "a")]
    with pytest.raises(ValueError, match="no labelled"):
        semantic_types(rows, protos.where("proto_label is null"))
    with pytest.raises(ValueError, match="different lengths"):
        semantic_types(rows, protos.union(spark.createDataFrame([("c", [1.0])], protos.schema)))


def test_page_records(spark):
    from quarrylight.operators import pages as P

    text = "2021 safety data - high potential event reports\nEUROPE ONSHORE\nDATE: 4 May 2021\nCAUSE: other\n7\nNARRATIVE: A man\nfell.\nCAUSAL FACTORS:\nNo causal factors allocated"
    pages = spark.createDataFrame([("a", 1, "front"), ("a", 2, text), ("a", 3, "DATE: soon\nEUROPE ONSHORE"), ("b", 1, None), ("c", 1, "")], "f string, p int, t string")
    found = P.parsed_records(P.page_records(P.page_lines(pages, ["f"], "p", "t"), ["f"]), F.lit("hipo")).orderBy("record").collect()
    assert [(r["f"], r["heading"], r["lines"]) for r in found] == [("a", "EUROPE ONSHORE", 6), ("a", "EUROPE ONSHORE", 1)]
    assert (found[0]["text"], found[0]["causal_factors"], found[0]["warnings"]) == ("A man fell.", [], ["very_short_narrative", "no_lsr"])
    assert (found[1]["text"], found[1]["date_raw"], found[1]["warnings"]) == (None, "soon", ["missing_narrative", "no_lsr", "date_unparsed"])


def test_victims_and_files(spark):
    from quarrylight.operators import pages as P

    row = spark.createDataFrame([("Function: Drilling, Employer: Contractor; LWDC Days: unknown, RWDC Days: 5 or more", "/in/2022sh (1).pdf", "notes.pdf")], "v string, a string, b string")
    v, a, b = row.select(P.victim(F.col("v")), P.file_kind(F.col("a")), P.file_kind(F.col("b"))).first()
    assert (v["victim_function"], v["victim_employer"], v["lwdc_days"], v["rwdc_days"], v["pi_category"]) == ("Drilling", "Contractor", None, 5, None)
    assert tuple(a) == (2022, "hipo") and b is None


def test_gates(spark):
    from quarrylight.operators import gates as G

    span = "array<struct<role:string,text:string,source:string,score:double>>"
    names = ["p", "text", "spans", "model_spans", "hazard", "semantic", "energy_gate", "prefilter", "head", "head_confidence"]
    long = "the paratha was cold again in the mess"
    rows = [
        (1, 0.95, long, [("control_absent", "nahi tha", "rules", 1.0)], [], None, None, None, "0", None, None),
        (2, 0.95, long, [("control_absent", "harness nahi", "rules", 1.0)], [], None, None, None, "0", None, None),
        (3, 0.5, long, [], None, None, None, None, "0", None, None),
        (4, 0.5, "Nil", None, None, None, None, None, "0", None, None),
        (5, 0.5, long, [], [("energy_cue", "AC", "model", 0.9)], None, None, None, "0", None, None),
        (6, 0.5, long, [], [("negation_cue", "remote", "model", 0.9)], "vehicle_or_mobile_plant", None, "NONE", None, "P_SIF", 0.3),
        (7, None, None, None, None, None, None, None, None, None, None),
        (8, 0.5, long, [], [], None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, p double, text string, spans {span}, model_spans {span}, hazard string, semantic string, energy_gate string, prefilter string, head string, head_confidence double")
    got = {r["id"]: (r["gate"]["stage"], r["gate"]["evidence"]) for r in G.gated(df, {n: n for n in names}).collect()}
    assert got == {1: ("scope", []), 2: (None, ["rule span control_absent=harness nahi"]), 3: ("evidence", []), 4: (None, []), 5: (None, ["model energy_cue=AC"]), 6: ("evidence", []), 7: (None, []), 8: (None, [])}
