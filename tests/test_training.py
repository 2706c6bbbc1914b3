"""Heads against a plain solver, token rows and their balance against plain counts, glossaries, running ids."""

import json
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import heads as H
from quarrylight.operators import training as T


def plain_head(x, y, strength):
    """Weighted logistic regression by Newton's steps; the intercept is free."""
    n, w = len(y), np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    a, beta = np.hstack([x, np.ones((n, 1))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve(strength * (a.T * (w * p * (1 - p))) @ a + penalty, strength * a.T @ (w * (p - y)) + penalty @ beta)
    return beta


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.2).astype(int)
    x = rng.normal(size=(400, 5)) + y[:, None] * np.array([1.0, -0.5, 0.2, 0, 0])
    rows = [(i, [float(v) for v in x[i]], int(y[i]), ["even"] * (i % 2 == 0) + ["one"] * int(y[i])) for i in range(400)]
    odd = [(900, None, 1, []), (901, [float("nan")] * 5, 1, []), (902, [1.0] * 5, None, None), (903, [None] * 5, 0, [])]
    return x, y, spark.createDataFrame(rows + odd, "id int, v array<double>, y int, tags array<string>").repartition(4)


def test_head_equals_plain_solver(spark, vectors):
    x, y, df = vectors
    head = H.fit_head(df, "v", "y")
    want = plain_head(x, y, 2.0)
    got = np.array([*head.model.coefficients, head.model.intercept])
    assert head.classes == [0, 1] and np.abs(got - want).max() < 1e-3
    scored = {r.id: (r.predicted, r.p) for r in head.scored(df, "v").withColumn("p", H.probability_of(head, 1)).collect()}
    p = 1 / (1 + np.exp(-(np.hstack([x, np.ones((400, 1))]) @ want)))
    assert set(scored) == {*range(400), 902} and all(abs(scored[i][1] - p[i]) < 1e-3 and (abs(p[i] - 0.5) < 1e-3 or scored[i][0] == int(p[i] > 0.5)) for i in range(400))
    with pytest.raises(ValueError, match="two classes"):
        H.fit_head(df.where("y = 1"), "v", "y")


def test_several_labels_and_classes(vectors):
    x, y, df = vectors
    heads = H.fit_heads(df, "v", "tags", ["one", "even", "never"])
    assert list(heads) == ["one", "even"]
    alone = H.fit_head(df, "v", "y")
    said = {r.id: r.predicted_labels for r in H.scored_labels(df, "v", heads).collect()}
    one = {r.id: r.p >= 0.5 for r in alone.scored(df, "v").withColumn("p", H.probability_of(alone, 1)).collect()}
    assert sum(("one" in said[i]) == one[i] for i in one) >= len(one) - 8
    three = df.withColumn("c", F.when(F.col("v")[0] > 1, "c").when(F.col("v")[0] < 0, "a").otherwise("b"))
    head = H.fit_head(three.where("y is not null"), "v", "c", strength=50.0)
    right = head.scored(three.where("id < 400"), "v").agg(F.avg((F.col("predicted") == F.col("c")).cast("double")).alias("a")).first().a
    assert head.classes == ["a", "b", "c"] and right > 0.9


def test_learning_curve(vectors):
    x, y, df = vectors
    curve = H.learning_curve(df, df, "v", "y", 0, "id", (0.5, 1.0)).collect()
    head = H.fit_head(df, "v", "y")
    whole = {r.id: r.predicted for r in head.scored(df.where("y is not null"), "v").collect()}
    assert curve[1].negatives == int((y == 0).sum()) + 1 and 0 < curve[0].negatives < curve[1].negatives
    assert abs(curve[1].accuracy - np.mean([whole[i] == y[i] for i in range(400)])) < 1e-9


def test_protected_rows(spark):
    df = spark.createDataFrame([(" a ", "yes"), ("b", None), ("", "YES"), (None, "no"), ("c", " ")], "t string, p string")
    assert sorted(tuple(r) for r in H.protected_rows(df, "t", "p").collect()) == [("a", "YES"), ("b", "UNCERTAIN"), ("c", "UNCERTAIN")]


SPANS = "array<struct<role:string,start:int,end:int>>"


def test_token_rows(spark):
    text = "Hot-work ke paas, मिस्त्री नहीं 🙂 guard_rail."
    at = lambda w: (text.index(w), text.index(w) + len(w))
    rows = [(1, text, [("control_absent", *at("मिस्त्री नहीं")), ("energy_cue", *at("Hot-work")), ("energy_cue", *at("Hot-work")), ("energy_cue", *at("work")), ("odd", *at("🙂 guard_rail")), ("release_cue", 500, 510), None])]
    rows += [(2, "w " * 381, [("energy_cue", 0, 1)]), (3, "w " * 380, [("energy_cue", 0, 25), ("energy_cue", 0, 23)]), (4, "", []), (5, None, None), (6, "no spans here", None)]
    df = T.token_rows(spark.createDataFrame(rows, f"id int, text string, spans {SPANS}"), "text", "spans", drop_empty=True)
    got = {r.id: r for r in df.collect()}
    assert got[1].tokens == ["Hot-work", "ke", "paas", ",", "मिस्त्री", "नहीं", "🙂", "guard_rail", "."]
    assert [tuple(s) for s in got[1].ner] == [(0, 0, "energy source"), (4, 5, "control absent"), (6, 7, "odd")] and (got[1].misaligned, got[1].wide, got[1].fate) == (2, 0, "kept")
    assert (got[2].fate, got[2].ner, got[3].wide, [tuple(s) for s in got[3].ner]) == ("length", [], 1, [(0, 11, "energy source")]) and [got[k].fate for k in (4, 5, 6)] == ["length", "length", "empty"]
    counts = {r.counter: r.n for r in T.token_row_counts(df).collect()}
    assert counts == {"rows": 2, "rows_with_spans": 2, "dropped_length": 3, "dropped_empty": 1, "span_misaligned": 2, "span_too_wide": 1, "label:energy source": 2, "label:control absent": 1, "label:odd": 1}


def test_balanced_weak(spark):
    label = lambda n, common=1: [(k, k, "control absent") for k in range(n)] + [(50 + k, 50 + k, "energy source") for k in range(common)]
    rows = [(i, label(i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, ner array<struct<first:int,last:int,label:string>>").repartition(5)
    for real, want in ((1000, {1: 50, 2: 50, 3: 50}), (140, {3: 50, 2: 20}), (0, {}), (100, {3: 50})):
        kept = [r.id % 4 for r in T.balanced_weak(df, real, "id").collect()]
        assert {k: kept.count(k) for k in set(kept)} == want
    assert {r.id for r in T.balanced_weak(df, 140, "id").collect()} == {r.id for r in T.balanced_weak(df.repartition(2), 140, "id").collect()}


def test_weak_balance_of_an_odd_count_rounds_down(spark, tmp_path):
    from quarrylight.plans.training import ORACLE, weak_balance

    spark.range(5).withColumnRenamed("id", "doc_id").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in weak_balance(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLE["weak_balance"]).fetchall()) == [(3, 3), (4, 4)]


def test_glossary(spark):
    whole = {"term": " Lock out ", "variants": ["LOTO", " loto ", ""], "meaning": "m", "category": "Barrier", "safety_signal": "positive", "example_line": "e", "lsr": "l", "confidence": "high", "source_hint": "s"}
    rows = [(1, json.dumps(whole)), (2, json.dumps(whole | {"term": "lock OUT", "variants": ["LOCKOUT"], "category": "magic", "safety_signal": "odd", "more": 1})), (3, json.dumps({"term": "PTW", "variants": ["loto"]})), (4, json.dumps({"term": " "})), (5, "{broken"), (6, None)]
    df = spark.createDataFrame(rows, "n int, j string")
    got = {r.n: r for r in T.checked_entries(df, "j", {"positive": "control_present", "none": None, "": None}).collect()}
    assert got[1].problems == [] and (got[1].term, got[1].variants, got[1].role) == ("Lock out", ["LOTO", "loto"], "control_present")
    assert got[2].problems == ["unexpected: more", "category: magic", "signal: odd"] and got[2].category == "other" and got[2].role is None
    assert got[3].problems[0].startswith("missing: category,confidence,") and got[3].confidence == "low" and "no term" in got[4].problems and "no term" in got[6].problems
    entries, lookup = T.glossary(df, "j", {"positive": "control_present"}, "n")
    assert {r.term: r.variants for r in entries.collect()} == {"Lock out": ["lockout", "loto"], "PTW": ["loto"]}
    assert {r.variant: (r.term, r.collides) for r in lookup.collect()} == {"lockout": ("Lock out", False), "loto": ("Lock out", True)}


def test_grounded_reasons_ids_and_seeds(spark):
    text = "Worker fell from the ladder, no harness."
    reasons = ['It says "fell from". It also says "no harness". Nothing else.', 'Only "fell from".', 'Wrong "flew away". And "no harness".', None]
    df = spark.createDataFrame(list(enumerate(reasons)), "k int, r string").select("k", T.grounded(F.col("r"), F.lit(text)).alias("g"))
    assert {r.k: r.g for r in df.collect()} == {0: 'It says "fell from". It also says "no harness".', 1: None, 2: None, 3: None}
    part = lambda n, source: spark.createDataFrame([(k, source, None, f"{source}{k}") for k in range(n)], "n int, source string, trap string, text string").repartition(3)
    rows = T.accepted_rows({"generate": part(120, None), "rewind": part(7, "rewind:x")}, "n").orderBy("id").collect()
    assert [r.id for r in rows] == [f"d{k:06d}" for k in range(127)] and [r.n for r in rows] == [*range(120), *range(7)] and {r.trap for r in rows[120:]} == {"rewind"} and {r.trap for r in rows[:120]} == {"none"} and rows[0].source == "generate"
    pool = spark.createDataFrame([(f"word {k} " * n, h) for k, (n, h) in enumerate([(2, None), (3, None), (20, "train"), (21, None), (4, "eval_pool"), (5, "x")])], "t string, h string")
    found = [len(re.findall(r"\S+", r.t)) for r in T.seeds(pool, "t", "h", 9).collect()]
    assert sorted(found) == [6, 10, 40] and len(T.seeds(pool, "t", "h", 2).collect()) == 2
