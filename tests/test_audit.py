"""Audit, gaps and readiness on small rows; headers of uploaded statements in any order and without any."""

from pyspark.sql import functions as F

from quarrylight.operators import audit as U
from quarrylight.sources import files as S


def test_audit(spark):
    rows = [("a", "The worker fell from the ladder near the rig floor.", "x"), ("a", "word " * 301, "x"), ("a", None, None), ("b", "Truck hit by crane, LPG tanker burst, near miss in Assam.", "y"), (None, "short", "z")] + [("c", "t", f"k{k}") for k in range(9)]
    df = spark.createDataFrame(rows, "source string, text string, kind string").repartition(3)
    got = {r.source: r for r in U.source_audit(df, "source", "text", F.col("kind"), F.when(F.col("text").isNull(), "none").otherwise("english"), ["english", "none", "other"], U.DOMAINS, F.lower("text").contains("rig")).collect()}
    a = got["a"]
    assert (a.n, a.relevant, a.energy_cue, a.avg_words, a.over_300_words, a.under_15_words, a.language, a.top_domains, a.record_types, a.n_kinds) == (3, "33%", "33%", 104, "33%", "67%", ["english:2", "none:1"], ["drilling_well:1"], ["x:2", "?:1"], 2)
    b = got["b"]
    assert (b.india_context, b.near_miss_like, b.severe_outcome, b.multi_energy_rows) == ("100%", "100%", "0%", 1) and b.top_domains == ["construction_projects:1", "marketing_lpg_pol:1", "transport_driving:1"]
    assert got["c"].record_types == [f"k{k}:1" for k in range(6)] and got["c"].n_kinds == 9 and got["?"].n == 1 and got["(all)"].n == 14 and got["(all)"].record_types[0] == "x:2"
    assert U.source_audit(df.where("false"), "source", "text", F.col("kind"), F.lit("english"), ["english"], U.DOMAINS, F.lit(True)).collect() == []


def test_gaps_and_readiness(spark):
    df = spark.createDataFrame([("Hot work near the crane.",)] * 200 + [("Scaffold",)] * 3, "text string")
    gaps = {r.rule: (r.n, r.gap, r.status) for r in U.rule_gaps(df, "text", {"Hot Work": 250, "Driving": 7}).collect()}
    assert gaps["Hot Work"] == (200, 50, "thin") and gaps["Safe Mechanical Lifting"] == (200, 0, "ok") and gaps["Driving"] == (0, 7, "missing") and gaps["Working at Height"] == (3, 0, "thin") and len(gaps) == 9
    seeds = spark.createDataFrame([("s1", "rewind")] * 30 + [("s2", "rewind")] * 10 + [("s3", "other")], "source string, job string")
    enough = U.sufficiency(seeds, "source", "job", {"s1": 20}, {"generate": 0.9, "rewind": 0.5}, {"rewind": 4}, 100, 130)
    assert {r.job: (r.seeds, r.expected, r.usable, r.ok) for r in enough.collect()} == {"rewind": (30, 60, None, None), "generate": (0, 90, None, None), "(total)": (30, 150, 138, True)}
    audit = spark.createDataFrame([("(all)", "50%", "1%", "30%", "0%"), ("a", "0%", "0%", "0%", "90%")], "source string, relevant string, india_context string, near_miss_like string, over_300_words string")
    row = U.readiness(audit, U.rule_gaps(df, "text", {}), enough).first()
    assert row.status == "ENOUGH_AND_RELEVANT" and row.notes[0] == "little of the region" and row.notes[1].startswith("thin rules: Bypassing") and len(row.notes) == 2
    assert U.readiness(audit, U.rule_gaps(df, "text", {}), enough.withColumn("ok", F.lit(False))).first().status == "NOT_ENOUGH"


def test_statement_headers(spark, tmp_path):
    assert S.statement_columns(["Activity", "Yard name", "Observation text"]) == {"text": "Observation text", "site": "Yard name", "activity": "Activity"}
    assert S.statement_columns(["a", "b", "c", "d"]) == {"text": "a", "site": "b", "activity": "c"} and S.statement_columns(["x"]) == {"text": "x", "site": None, "activity": None}
    assert S.statement_columns(["site", "x", "y"]) == {"text": None, "site": "site", "activity": "y"} and S.statement_columns(["Work report", "place"])["text"] == "Work report" and S.statement_columns([]) == {"text": None, "site": None, "activity": None}
    (tmp_path / "u.csv").write_text('Site , Activity, Description\nA1, lifting, "Hook fell, no one hurt"\n, , \nB2,,"said ""stop"""\n')
    assert [tuple(r) for r in S.read_statements(spark, f"file://{tmp_path}/u.csv").collect()] == [("Hook fell, no one hurt", "A1", "lifting"), ('said "stop"', "B2", "")]
    (tmp_path / "u.json").write_text('[{"statement": "Gas leak", "location": "C3"}, {"location": "D4"}]')
    assert [tuple(r) for r in S.read_statements(spark, f"file://{tmp_path}/u.json").collect()] == [("Gas leak", "C3", "")]
