"""Registered queries over nested JSON, versioned ingest and resumed stages, and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.operators.dedup import shared_folder
from quarrylight.plans.tables import read, read_dealt, read_texts
from quarrylight.sources import nested as N
from quarrylight.sources.stages import FileStage
from quarrylight.streaming.versions import VersionStore

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("""
WITH e AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k')::BIGINT AS k, event_id % 6 AS kind FROM events)
SELECT event_id, 0 AS place, t AS term, k, NULL::VARCHAR AS meaning FROM e WHERE kind = 0
UNION ALL SELECT event_id, p::INTEGER, t || p, k + p, CASE WHEN p = 1 THEN 'low' END FROM e, range(3) r(p) WHERE kind = 1
UNION ALL SELECT event_id, 0, t, k, 'deep' FROM e WHERE kind = 2 UNION ALL SELECT event_id, 0, t, NULL, 'outer' FROM e WHERE kind = 5""")
def nested_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of lists and objects nested to any depth; broken JSON and JSON without entries have none."""
    t, k, kind = F.col("event_type"), F.get_json_object("props", "$.k"), F.col("event_id") % 6
    entry = lambda term, value, more="": F.concat(F.lit('{"term": "'), term, F.lit('", "k": '), value, F.lit(f"{more}}}"))
    plus = lambda n: (k.cast("long") + n).cast("string")
    json = (
        F.when(kind == 0, entry(t, k)).when(kind == 1, F.concat(F.lit("["), entry(F.concat(t, F.lit("0")), plus(0)), F.lit(', {"more": {"a": '), entry(F.concat(t, F.lit("1")), plus(1), ', "meaning": "low"'), F.lit(', "b": ['), entry(F.concat(t, F.lit("2")), plus(2)), F.lit("]}}]")))
        .when(kind == 2, F.concat(F.lit('{"x": [[[[1, {"y": '), entry(t, k, ', "meaning": "deep"'), F.lit("}]]]]}"))).when(kind == 3, F.concat(F.lit("["), entry(t, k), F.lit(", {")))
        .otherwise(entry(t, F.lit('"none"'), ', "meaning": "outer", "sub": {"term": "inner"}'))
    )
    json = F.when(kind == 4, F.col("props")).otherwise(json)
    found = N.nested_entries(read_dealt(spark, sf_dir, "events", ["event_id", "event_type", "props"]).select("event_id", json.alias("json")), "json", "term", "term string, k long, meaning string")
    return found.select("event_id", "place", "entry.term", "entry.k", "entry.meaning")


@query("""
SELECT page_id, md5(CASE page_id % 5 WHEN 0 THEN 'All of ' || page_id || chr(10) || repeat('word ' || page_id || ' ', 20)[1:-2] || chr(10) || 'Body' WHEN 1 THEN 'Told <at length>' || chr(10) || 'Two' WHEN 2 THEN 'Described ' || page_id || chr(10) || 'Again' WHEN 3 THEN 'Only sound' ELSE '' END) AS text_md5 FROM pages""".replace("Told <at length>", "Told"))
def embedded_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that pages carry in the JSON of their scripts, or in descriptions."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 5
    head = (
        F.when(kind == 0, F.concat(F.lit('<script id="__NEXT_DATA__">{"a": {"summary": "All <b>of</b>  '), n, F.lit('", "u": "http://x y"}, "b": ["short one", "'), F.repeat(F.concat(F.lit("word "), n, F.lit(" ")), 20), F.lit('"], "c": {"body": "Body", "title": "T"}}</script>')))
        .when(kind == 1, F.lit('<script type="application/ld+json">[{"articleBody": "Told <at length>"}, {"@graph": [{"description": "Two"}, {"description": "Told"}]}]</script>'))
        .when(kind == 2, F.concat(F.lit('<script type="application/json">{"body": "broken"</script><meta name="description" content="Described '), n, F.lit("\"><meta content='Again' property=\"og:description\"><meta name=\"author\" content=\"No\">")))
        .when(kind == 3, F.lit('<script type="application/json">{"text": "broken",}</script><script type=application/json>{"text": "Only sound", "body": {"x": 1}}</script><meta name="description" content="Unused">'))
        .otherwise(F.lit(""))
    )
    pages = read_texts(spark, sf_dir, "pages").select("page_id", F.concat(head, F.coalesce("html", F.lit(""))).alias("html"))
    return N.embedded_texts(pages, "html", "text").select("page_id", F.md5("text").alias("text_md5"))


class Killed(Exception):
    """What breaks off the first run of ``ingested_versions``."""


@query("""
WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS version, lag(event_type) OVER (PARTITION BY user_id ORDER BY first) AS before, count(*) OVER (PARTITION BY user_id) AS n FROM f)
SELECT user_id, event_type AS current_type, version, n AS n_versions, before AS superseded_type FROM v WHERE version = n""")
def ingested_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of every key after a stream in three batches that is killed between its second batch's rows and their commit, and replayed.

    A batch is a third of the days, in however many files that is written: a batch a file would order versions by files.
    """
    root = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events")
    third = F.ntile(3).over(Window.orderBy("day"))
    days = events.select(F.to_date("ts").alias("day")).distinct().select("day", third.alias("third"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    store = VersionStore(spark, f"{root}/store", schema, ["user_id"], ["event_type"], ["ts", "event_id"])

    def arrive(k: int) -> None:
        events.join(F.broadcast(days.where(F.col("third") == k)), F.to_date("ts") == F.col("day"), "left_semi").write.mode("append").parquet(f"{root}/in")

    def ingest() -> None:
        store.ingest(spark.readStream.schema(events.schema).parquet(f"{root}/in"))

    def killed(batch: int, commit=store.commit) -> None:
        if batch == 1:
            raise Killed
        commit(batch)

    arrive(1)
    ingest()
    arrive(2)
    store.commit = killed
    try:
        ingest()
    except Exception as broken:
        if "Killed" not in str(broken):
            raise
    del store.commit
    arrive(3)
    ingest()
    rows = store.history()
    before = rows.select(F.col("version_id").alias("supersedes"), F.col("event_type").alias("superseded_type"))
    counted = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_versions"))
    return rows.where("is_current").join(counted, "user_id").join(before, "supersedes", "left").select("user_id", F.col("event_type").alias("current_type"), "version", "n_versions", "superseded_type")


@query("""
WITH c AS (SELECT c_nationkey AS nation, c_custkey, c_name FROM customer UNION ALL SELECT 3, -1, 'Added later')
SELECT nation, count(*) AS n_rows, sum(c_custkey)::BIGINT AS keys, (SELECT count(DISTINCT c_nationkey) FROM customer) AS first_parsed, 1 AS then_parsed FROM c GROUP BY 1""")
def resumed_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage over a file a nation, run again after one file was changed and copied: only that one is parsed anew."""
    root = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    lines = read(spark, sf_dir, "customer").select(F.concat_ws("|", "c_nationkey", "c_custkey", "c_name").alias("value"), F.col("c_nationkey").alias("nation"))
    put = lambda rows, mode: rows.repartition("nation").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("nation").text(f"{root}/in")
    put(lines, "overwrite")

    def parse(files: DataFrame) -> DataFrame:
        rows = files.select("sha", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''").withColumn("f", F.split("line", "\\|"))
        return rows.select(F.col("f")[0].cast("int").alias("nation"), F.col("f")[1].cast("long").alias("key"), F.col("f")[2].alias("name"), "sha")

    stage = FileStage(spark, f"{root}/out", "nation int, key long, name string", parse)
    first = stage.run(f"{root}/in", glob="*.txt")
    put(lines.where("nation = 3").union(spark.createDataFrame([("3|-1|Added later", 3)], "value string, nation int")).coalesce(1), "overwrite")
    for copy in ("a", "b"):
        spark.read.text(f"{root}/in/nation=3").coalesce(1).write.mode("overwrite").text(f"{root}/in/copy={copy}")
    then = stage.run(f"{root}/in", glob="*.txt")
    return stage.rows(then["run"]).groupBy("nation").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("key").alias("keys")).withColumn("first_parsed", F.lit(first["parsed"]).cast("long")).withColumn("then_parsed", F.lit(then["parsed"]))
