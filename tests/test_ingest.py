"""Nested JSON, versioned ingest killed at any point, and stages that run again only for what has changed."""

import itertools
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylight.sources import files as S
from quarrylight.sources import nested as N
from quarrylight.sources.stages import FileStage, stage_rows, stages_to_run
from quarrylight.streaming.versions import VersionStore


def test_nested_entries(spark):
    rows = ['{"term": "a", "k": "x", "sub": [{"term": "below"}]}', '[[{"term": "b"}], {"z": {"term": "d"}, "c": [{"term": "c"}]}, 5, null, "term"]', "{broken", "", None, "[]", "3", "[" * 12 + '{"term": "too deep"}' + "]" * 12]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, j string")
    got = [(r.id, r.place, r.entry.term, r.entry.k) for r in N.nested_entries(df, "j", "term", "term string, k int").orderBy("id", "place").collect()]
    assert got == [(0, 0, "a", None), (1, 0, "b", None), (1, 1, "c", None), (1, 2, "d", None)]
    assert [r.entry.term for r in N.nested_entries(df, "j", "term", "term string", depth=12).where("id = 7").collect()] == ["too deep"]


def test_embedded_texts(spark):
    long = "many words " * 12
    pages = [
        f'<script id=__NUXT_DATA__>["{long}", "short", "http{long}"]</script>', '<script type="text/javascript">{"body": "no"}</script><meta name=description content="Told">', '<script type="application/ld+json">{"body": {"text": "in  <i>it</i>"}, "title": "T"}</script>',
        '<script type="application/json">{"a": 1}</script>', "plain", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: r.t for r in N.embedded_texts(df, "html", "t").collect()}
    assert got == {0: long.strip(), 1: "Told", 2: "in it", 3: "", 4: "", 5: None, 6: ""}


class Killed(Exception):
    pass


BATCHES = [[("a", "x", 1), ("b", "x", 2), ("a", "x", 3), (None, "x", 4)], [("a", "y", 5), ("c", "z", 6), ("a", "w", 7)], [("a", "x", 8), ("b", "v", 9), ("b", None, 10)]]
CURRENT = {"a": ("w", 3), "b": (None, 3), "c": ("z", 1)}


@pytest.mark.parametrize(("at", "before_commit"), [*itertools.product((0, 1, 2), (True, False))])
def test_replayed_batches(spark, tmp_path, at, before_commit):
    """Each batch is tried, killed before its rows' commit or after it, and tried again."""
    store = VersionStore(spark, f"file://{tmp_path}", "key string, text string, n long", ["key"], ["text"], ["n"])
    for number, rows in enumerate(BATCHES):
        df = spark.createDataFrame(rows, "key string, text string, n long")
        if number == at:
            store.new_versions(df, number).write.mode("overwrite").parquet(f"{store.root}/rows/batch={number}")
            assert store.versions().where(F.col("batch") == number).count() == 0
            if not before_commit:
                store.commit(number)
        store.write_batch(df, number)
    assert {r.key: (r.text, r.version) for r in store.current().collect()} == CURRENT and store.current().count() == 3
    history = store.history().collect()
    assert sorted((r.key, r.version, r.text or "") for r in history) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "w"), ("b", 1, "x"), ("b", 2, "v"), ("b", 3, ""), ("c", 1, "z")]
    by = {r.version_id: r for r in history}
    assert all((r.supersedes is None) == (r.version == 1) and (r.supersedes is None or by[r.supersedes].version == r.version - 1) for r in history) and sum(r.is_current for r in history) == 3


def test_stage_parses_only_what_changed(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    for name, text in (("a.txt", "one\ntwo"), ("b.txt", "three"), ("b (1).txt", "three"), ("empty.txt", "")):  # files without a byte are no files to Spark
        (place / name).write_text(text)
    seen = []

    def parse(files):
        seen.append(sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()))
        return files.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"), "sha").where("line <> ''")

    stage = FileStage(spark, f"file://{tmp_path}/out", "line string", parse)
    first = stage.run(f"file://{place}", rank=F.col("path").contains("(1)").cast("int"))
    assert (first["files"], first["distinct"], first["parsed"]) == (3, 2, 2) and seen[0] == ["a.txt", "b.txt"]
    assert stage.run(f"file://{place}")["parsed"] == 0 and len(seen) == 1
    (place / "a.txt").write_text("one\nfour")
    (place / "b.txt").rename(place / "c.txt")
    (place / "b (1).txt").unlink()
    third = stage.run(f"file://{place}")
    assert third["parsed"] == 1 and seen[1] == ["a.txt"] and sorted(r.line for r in stage.rows(third["run"]).collect()) == ["four", "one", "three"]
    assert sorted(r.line for r in stage.rows().collect()) == ["four", "one", "one", "three", "two"]
    assert FileStage(spark, f"file://{tmp_path}/out", "line string", parse, version="2").run(f"file://{place}")["parsed"] == 2


def test_stages_to_run(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/done")
    folders = {"done": f"file://{tmp_path}/done", "new": f"file://{tmp_path}/new", "other": f"file://{tmp_path}/other"}
    assert stages_to_run(spark, folders) == {"done": False, "new": True, "other": True} and stages_to_run(spark, folders, only={"done", "new"}, skip={"new"}, force=True) == {"done": True, "new": False, "other": False}
    found = stage_rows(spark, folders, {"new": spark.range(2)})
    assert sorted(found) == ["done", "new"] and found["done"].count() == 3


def test_small_file_functions(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b (1)", bytearray(b"x")), ("c", bytearray(b"y"))], "path string, content binary")
    assert sorted(r.path for r in S.distinct_files(files, F.col("path").contains("(").cast("int")).collect()) == ["a", "c"]
    index = spark.createDataFrame([("a", 1)], "path string, n int")
    assert sorted((r.path, r.n) for r in S.with_loose_files(index, files.select("path"), "path").collect()) == [("a", 1), ("b (1)", None), ("c", None)]
    there = spark.sql("SELECT * FROM VALUES ('a', 1L, timestamp'2024-01-01'), ('b', 2L, timestamp'2024-01-01') t(path, length, modificationTime)")
    assert [r.path for r in S.uncached(there, there.where("path = 'a'")).collect()] == ["b"] and S.uncached(there, there.withColumn("length", F.col("length") + 1)).count() == 2
    S.write_jsonl(index.withColumn("n", F.lit(None).cast("int")), f"file://{tmp_path}/j")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/j").collect()] == ['{"path":"a","n":null}']
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("t.txt", "inside")
    assert [r.text.strip() for r in S.read_attachments(spark, f"file://{tmp_path}/z.zip").collect()] == ["inside"]


def test_first_seen_in_a_stream(spark, tmp_path):
    from quarrylight.streaming.events import first_seen, read_stream, run_available

    rows = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00', 'a'), (timestamp'2024-01-01 00:00:01', 'a'), (timestamp'2024-01-01 00:00:02', 'b') t(ts, text)")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    run_available(first_seen(read_stream(spark, f"file://{tmp_path}/in", "ts timestamp, text string"), "ts", "text", "1 hour"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert sorted(r.text for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]


def test_glossary_entries(spark):
    from quarrylight.functions.text import full_year, pseudonym, tidy_category
    from quarrylight.operators.dedup import merge_entries, variant_lookup

    rows = [("LOTO", ["lock out", "Loto"], None, "barrier", 1), ("loto", ["LOTO", "tag out"], "isolate", "barrier", 2), ("PTW", ["permit", "lock out"], "permit", None, 3), ("ptw", None, None, "phrase", 4), (None, ["x"], "m", "c", 5)]
    df = spark.createDataFrame(rows, "term string, variants array<string>, meaning string, category string, n int")
    got = {r.term: r for r in merge_entries(df, "term", "variants", ["meaning", "category"], "n").collect()}
    assert got["LOTO"].variants == ["lock out", "loto", "tag out"] and got["LOTO"].meaning == "isolate" and not got["LOTO"].category_conflict and got["PTW"].category == "phrase"
    found = {r.variant: (r.term, r.collides) for r in variant_lookup(df.where("term in ('LOTO', 'PTW')"), "term", "variants").collect()}
    assert found == {"lock out": ("LOTO", True), "Loto": ("LOTO", False), "permit": ("PTW", False)}
    row = spark.range(1).select(full_year(F.lit(89)).alias("a"), full_year(F.lit(90)).alias("b"), pseudonym(F.lit("Ab")).alias("c"), pseudonym(F.lit("aB")).alias("d"), *(tidy_category(F.lit(x)).alias(n) for n, x in (("e", " [] "), ("f", "NaN"), ("g", "HOT WORK"), ("h", " Mixed Case ")))).first()
    assert (row.a, row.b) == (2089, 1990) and row.c == row.d and len(row.c) == 8 and (row.e, row.f, row.g, row.h) == (None, None, "Hot work", "Mixed Case")


def test_versions_of_many_files_follow_the_days(spark, tmp_path):
    from quarrylight.plans.ingest import ORACLE, ingested_versions

    # Every day in each of nine files: a batch a file would take a user's later events before earlier ones.
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.col("user_id") % 7)
    events.repartition(9, "event_type", "value").write.parquet(f"file://{tmp_path}/events.parquet")
    got = sorted(map(str, (tuple(r) for r in ingested_versions(spark, str(tmp_path)).select("user_id", "current_type", "version", "n_versions", "superseded_type").collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(map(str, con.execute(ORACLE["ingested_versions"]).fetchall()))
