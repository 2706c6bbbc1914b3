"""Report functions and curation operators on small inline cases."""

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import reports as P
from quarrylight.operators import curation as C
from quarrylight.operators.dedup import groups, near_groups, near_pairs
from quarrylight.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rules(spark):
    cases = {"Line of fire (dropped object)": "Line of Fire", "LOTO": "Energy Isolation", " Work at  height. ": "Working at Height", "N/A": None, "No applicable rule": None, "hot work near tank": "Hot Work", "magic": None}
    for raw, want in cases.items():
        assert one(spark, P.canonical_rule(F.lit(raw))) == want, raw
    assert one(spark, P.canonical_rules(F.lit("Driving; driving + LOTO, magic"))) == ["Driving", "Energy Isolation"]
    assert one(spark, P.unmapped_rules(F.lit("Driving; none, magic"))) == ["magic"]


def test_facts(spark):
    assert not one(spark, P.actual_fatality(F.lit("This could have resulted in a fatality.")))
    assert one(spark, P.actual_fatality(F.lit("It could have been avoided. One worker was killed.")))
    assert one(spark, P.outcome(F.lit("Dropped object results in LTI"))) == "equipment_damage"
    assert one(spark, P.outcome(F.lit("Could have been a fatality. First aid given"))) == "first_aid"
    assert one(spark, P.outcome(F.lit("nothing"))) is None
    assert [one(spark, P.record_type(F.lit(t))) for t in ("He died.", "A near miss with no harm", "LTI after a slip", "Pump stopped")] == ["fatal", "near_miss", "injury", "incident"]
    assert one(spark, P.potential_consequence(F.lit("Ok. This could have\nkilled a worker below. More."))) == "This could have killed a worker below."


def test_layout(spark):
    assert one(spark, P.reflowed(F.array(*map(F.lit, ["tools/equipment/", "materials and", "more", "", "- first", "second", "1. third-", "degree"])))) == ["tools/equipment/materials and more", "- first second", "1. third-degree"]
    found = one(spark, P.sections(F.lit("Intro line\n# What happened?\nA man fell.\nHe rose.\nRoot cause: no rail\nbad light\nLessons learned - fix it\n\nReferences\nX")))
    assert found == {"other": "Intro line", "narrative": "A man fell. He rose.", "what_went_wrong": "no rail bad light", "corrective_actions": "fix it", "references": "X"}
    assert one(spark, P.first_paragraph(F.lit("Short.\n\nThis one has more than eight words in it, truly.\n\nLast"))) == "This one has more than eight words in it, truly."
    assert one(spark, P.strip_boilerplate(F.lit("A fall. Members are reminded to be careful. Page 2 of 3\npage 2 of 3\nEnd"))).replace("\n", "|").strip() == "A fall. Page 2 of 3| |End"
    assert [one(spark, P.register_category(F.lit(v))) for v in ("Unsafe  Act", "uc", "Near-miss", "foo ", " ")] == ["UA", "UC", "NM", "FOO", None]
    assert [one(spark, P.sector(F.lit(v))) for v in ("211120", "213112", "99")] == ["oil_gas_extraction", "support_activities_oil_gas", None]


@pytest.mark.parametrize(("text", "title", "date", "want"), [("", "19-04 Finger", None, ("19-04", 2019)), ("Alert 4-19 x", None, "2019-05-01", ("19-04", 2019)), ("ALERT 00-01", None, None, ("00-01", 2000)), ("Alert 4 - 19", "t", None, ("19-04", 2019)), ("none", "none", None, None)])
def test_alert_numbers(spark, text, title, date, want):
    got = one(spark, P.alert_number(F.lit(text), F.lit(title).cast("string"), F.lit(date).cast("string")))
    assert (tuple(got) if got else None) == want


def test_spans(spark):
    text = "A fall from the derrick, no harness."
    df = spark.createDataFrame([(text,)], "t string")
    tokens = df.select(C.token_spans(F.col("t")).alias("k")).first().k
    assert [t.text for t in tokens] == ["A", "fall", "from", "the", "derrick", ",", "no", "harness", "."] and all(text[t.start : t.end] == t.text for t in tokens)
    at = lambda s, e: df.select(C.aligned(C.token_spans(F.col("t")), F.lit(s), F.lit(e)).alias("x")).first().x
    assert tuple(at(2, 11)) == (1, 2) and at(3, 11) is None
    weak = df.select(C.weak_spans(F.col("t"), {"site": "derrick|fall", "word": "the derrick|fall"}).alias("w")).first().w
    assert [(text[s.start : s.end], s.role) for s in weak] == [("fall", "site"), ("the derrick", "word")]
    parts = df.select(C.highlighted(F.col("t"), C.weak_spans(F.col("t"), {"a": "fall", "b": "harness"})).alias("p")).first().p
    assert [(p.text, p.role) for p in parts] == [("A ", None), ("fall", "a"), (" from the derrick, no ", None), ("harness", "b"), (".", None)]
    left = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 3, 9)], "row int, role string, start int, end int")
    right = spark.createDataFrame([(1, "a", 4, 6), (1, "b", 9, 12)], "row int, role string, start int, end int")
    assert [(r.role, r.start_b) for r in C.overlapping_spans(left, right, "row").collect()] == [("a", 4)]


def test_truth_and_actions(spark):
    assert [one(spark, C.stated_truth(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in ((None, "Borderline"), ("in", "out"), ("x", None))] == ["border", "in", None]
    with pytest.raises(ValueError, match="corrected"):
        C.review_actions(spark.createDataFrame([(1,)], "verdict_id int"), "r", "correct", F.lit(1))
    with pytest.raises(ValueError, match="missing"):
        C.projected(spark.range(1), {}, ["nope"])


def test_guard_keeps_what_is_not_held_out(spark):
    base = " ".join(f"w{i}" for i in range(60))
    corpus = spark.createDataFrame([(1, base + " x"), (2, "other words here"), (3, "OTHER words, here"), (4, None), (5, "alone")], "id long, text string")
    held = spark.createDataFrame([(9, base), (1, "alone!")], "id long, text string")
    assert sorted(r.id for r in C.leakage_guard(corpus, held, "id", "text").collect()) == [2, 3, 4]


def test_groups_of_a_long_chain_and_of_many_copies(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in groups(chain).collect()} == {0}
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(40)] + [(100, "quite another text")]
    df = spark.createDataFrame(rows, "id long, text string")
    grouped = {r.id: r.root for r in near_groups(df, "id", "text", 85).collect()}
    assert grouped == {k: 0 for k in range(40)} and near_pairs(df, "id", "text", 85).count() == 780


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, with ""quotes"""\n2,plain\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r.text for r in rows] == ['two\nlines, with "quotes"', "plain"]
    (tmp_path / "b.tsv").write_text("id\t text \n1\tx\n")
    assert files.read_any(spark, str(tmp_path / "b.tsv")).columns == ["id", "text"]
    (tmp_path / "c.jsonl").write_text('{"id": 1, "text": "x"}\nbroken\n')
    assert [r.id for r in files.read_jsonl(spark, str(tmp_path / "c.jsonl"), "id long, text string", tolerant=True).where("id is not null").collect()] == [1]
    (tmp_path / "d.txt").write_text("one\n\n two \n")
    assert [r.text for r in files.read_lines(spark, str(tmp_path / "d.txt")).collect()] == ["one", "two"]
    out = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    files.write_csv(out, str(tmp_path / "out"))
    assert [r.tags for r in files.read_csv(spark, str(tmp_path / "out")).collect()] == ['["a","b"]']


def test_attachments(spark, tmp_path):
    import zipfile

    folder = tmp_path / "att"
    folder.mkdir()
    (folder / "a.txt").write_text("plain")
    (folder / "b.html").write_text("<p>One &amp; two</p><script>x</script>")
    (folder / "c.pdf").write_bytes(b"%PDF-1.4 \xff\x00")
    with zipfile.ZipFile(folder / "d.zip", "w") as z:
        z.writestr("in.txt", "inside")
        z.writestr("skip.bin", b"\x00\x01")
    (folder / "e.zip").write_bytes(b"not a zip")
    found = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_attachments(spark, str(folder)).collect()}
    assert {k: v and v.strip() for k, v in found.items()} == {"a.txt": "plain", "b.html": "One & two", "c.pdf": None, "d.zip": "inside", "e.zip": None}


def test_parts_are_trimmed_of_spaces_only(spark):
    from pyspark.sql import functions as F

    from quarrylight.functions.reports import first_paragraph, unmapped_rules

    df = spark.createDataFrame([("  0 rule of 10 / other 21 ", "  0 men were at work in the year 2010 \n\nshort")], "raw string, t string")
    row = df.select(unmapped_rules(F.col("raw")).alias("u"), first_paragraph(F.col("t")).alias("p")).first()
    assert row["u"] == ["0 rule of 10", "other 21"] and row["p"] == "0 men were at work in the year 2010"
