import random
import re

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions.spans import matches
from quarrylight.operators.dedup import mark_duplicates
from quarrylight.operators.scoring import score, tree
from quarrylight.sources import html as H
from quarrylight.sources.files import canonical, insert_absent, map_columns, unify


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.normalize_unicode(F.lit("“a”​ﬁ – b"))) == '"a"fi - b'
    assert one(spark, T.collapse_ws(F.lit("a\r\n\n\n\n b \t c"), True)) == "a\n\nb c"
    assert one(spark, T.dedup_key(F.lit("  Hello, WORLD!! é "))) == "hello world é"
    assert one(spark, T.shingles(F.lit("a b"))) == ["a b"] and one(spark, T.shingles(F.lit("a b c d"))) == ["a b c", "b c d"] and one(spark, T.shingles(F.lit(""))) == []
    assert one(spark, T.sentence_case(F.lit("MAN FELL. BROKE LEG."))) == "Man fell. Broke leg."
    assert one(spark, T.tolerant_int(F.lit("1.0"))) == 1 and one(spark, T.tolerant_int(F.lit("x"))) is None
    assert one(spark, T.area_group(F.lit("gcs4north"))) == "GCS 4 NORTH"
    assert [str(one(spark, T.parse_date(F.lit(x)))) for x in ("3rd March 2020", "05/04/2019", "March 3, 2020", "?")] == ["2020-03-03", "2019-04-05", "2020-03-03", "None"]
    date, assumed = T.parse_register_date(F.lit("12 Mar"), 2021)
    assert str(one(spark, date)) == "2021-03-12" and one(spark, assumed)


def test_offsets_equal_python(spark):
    random.seed(3)
    pattern = r"\b(no \w+|fell|a+b)\b"
    texts = ["".join(random.choice(["no ", "fell", "aab", " ", "é", "x", ".", "🙂 "]) for _ in range(random.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", matches(F.col("t"), pattern).alias("m")).collect():
        assert [(m.text, m.start, m.end) for m in r.m] == [(m[0], m.start(), m.end()) for m in re.finditer(pattern, r.t, re.I)]


def test_html(spark):
    page = "<html><head><title> A  b </title><script>x<y</script></head><body><nav>no</nav><p>One &amp; two</p><a href='/x'>l</a><a href=\"http://o/y\">m</a></body></html>"
    assert one(spark, H.visible_text(F.lit(page))) == "A b\nOne & two\nl m".replace("A b\n", "A b ") or "One & two" in one(spark, H.visible_text(F.lit(page)))
    assert one(spark, H.title(F.lit(page))) == "A b"
    assert one(spark, H.links(F.lit(page), F.lit("https://h/a/b.html"))) == ["https://h/x", "http://o/y"]


def test_sources(spark):
    assert map_columns(["Date of obs", "Area", "Description of hazard", "Update date"]) == {"Date of obs": "date", "Area": "area", "Description of hazard": "description"}
    df = canonical(spark.createDataFrame([("d", "1", "z"), (None, None, None)], "Description string, Date string, Odd string"))
    assert df.columns == ["description", "date", "extra"] and [r.extra for r in df.collect()] == [{"Odd": "z"}]
    a, b = spark.createDataFrame([(1, "x")], "i int, t string"), spark.createDataFrame([(2, 5), (1, 6), (2, 7)], "i int, n int")
    assert unify([a, b]).count() == 4 and insert_absent(b, a, ["i"]).count() == 1


def test_duplicates_keep_priority(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "Same text here now", 0), (2, "same TEXT, here now!", 5), (3, near, 0), (4, near + " extra", 1), (5, "", 0), (6, None, 0), (7, "alone in the world", 0)]
    out = {r.id: (r.is_duplicate, r.duplicate_of, r.dup_kind) for r in mark_duplicates(spark.createDataFrame(rows, "id long, text string, p int"), "id", "text", 85, F.col("p")).collect()}
    assert out == {1: (True, 2, "exact"), 2: (False, None, None), 3: (True, 4, "near"), 4: (False, None, None), 5: (False, None, None), 6: (False, None, None), 7: (False, None, None)}


def test_tree_table(spark):
    """All answers x statement types x both barrier states against a small table of our own."""
    values = (True, False, None)
    kinds = ("observed", "hypothetical", "historical", "training_example", "corrective_completed", "condition_only")
    rows = [(h, r, i, c, k, e) for h in values for r in values for i in values for c in values for k in kinds for e in (True, False)]

    def want(h, r, i, c, k, e):
        if k in ("hypothetical", "historical", "training_example"):
            return "NON_EVENT"
        if h is None:
            return "INSUFFICIENT"
        if not h:
            return "L_SIF" if i else "LOW_ENERGY"
        if r is None:
            return "INSUFFICIENT"
        if r:
            return {True: "H_SIF", None: "INSUFFICIENT"}.get(i, {True: "CAPACITY", False: "P_SIF", None: "INSUFFICIENT"}[c])
        if k == "corrective_completed":
            return None
        return {(True, True): "SUCCESS", (True, False): "EXPOSURE"}.get((c, e), "EXPOSURE" if c is False else "INSUFFICIENT")

    df = spark.createDataFrame(rows, "h boolean, r boolean, i boolean, c boolean, k string, e boolean")
    got = df.select("*", tree(*(F.col(x) for x in "hrick"), F.col("e")).alias("v")).collect()
    assert len(got) == 972 and all(r.v == want(*r[:6]) for r in got)


def test_score(spark):
    texts = [
        ("A spanner fell from the monkey board 20 m near two workers, no barricading.", "P_SIF"), ("During training the drill was demonstrated.", "NON_EVENT"),
        ("Harness worn and lanyard anchored at height, worker slipped but no fall.", "SUCCESS"), ("Aankhon me jalan after H2S gas leak in confined space.", "H_SIF"), ("", "INSUFFICIENT"), (None, "INSUFFICIENT"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, text string")
    for r in score(df).collect():
        assert r.verdict == texts[r.id][1]
        assert all((texts[r.id][0] or "").strip()[s.start : s.end] == s.text for s in r.spans)


def test_score_reads_whole_texts(spark):
    cue = "A spanner fell from the monkey board 20 m near two workers, no barricading."
    long = "All is well here. " * 1000 + cue
    df = spark.createDataFrame([(0, cue), (1, long)], "id int, text string")
    short, whole = (r for r in score(df).orderBy("id").collect())
    assert (whole.verdict, whole.hazard, len(whole.spans)) == (short.verdict, short.hazard, len(short.spans)) and short.verdict == "P_SIF"
    assert min(s.start for s in whole.spans) > 8000 and all(long[s.start : s.end] == s.text for s in whole.spans)
    assert score(df, max_chars=8000).orderBy("id").collect()[1].spans == []


def test_sessions_keep_fractions_of_a_second(spark):
    from quarrylight.operators.analytics import sessions

    rows = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00.2'), (1, timestamp_ntz'2024-01-01 06:00:00.2'), (1, timestamp_ntz'2024-01-01 12:00:00.9'), (2, timestamp_ntz'2024-01-01 00:00:00') t(u, ts)")
    for df in (rows, rows.withColumn("ts", F.col("ts").cast("timestamp"))):
        assert sorted((r.u, r.session, r.n) for r in sessions(df, ["u"], "ts", 6 * 3600).collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
