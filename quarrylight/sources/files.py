"""Readers and writers of report files: every column a string until it is mapped, bad lines dropped or kept as asked."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.html import visible_text

# Header fragments of registers and the columns they map to, in the order in which they are tried.
REGISTER_FRAGMENTS = [("description", "description"), ("observation", "description"), ("category", "category"), ("date", "date"), ("area", "area"), ("location", "location"), ("department", "department"), ("name", "reported_by"), ("status", "status"), ("action", "action"), ("risk", "risk"), ("remark", "remarks"), ("shift", "shift"), ("contractor", "contractor"), ("severity", "severity")]


def read_csv(spark: SparkSession, path: str, sep: str = ",", keep: list[str] | None = None, drop_malformed: bool = False, multiline: bool = True) -> DataFrame:
    """A delimited file, all strings, header names trimmed; ``keep`` prunes at the scan.

    Quoted values may hold line ends and doubled quotes. Such a file is read by one task; ``multiline=False`` splits
    large files whose values stay on their line.
    """
    options = {"header": True, "sep": sep, "inferSchema": False, "multiLine": multiline, "escape": '"', "mode": "DROPMALFORMED" if drop_malformed else "PERMISSIVE"}
    df = spark.read.options(**options).csv(path)
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.select(*keep) if keep else df


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; bad lines are dropped if ``tolerant``, else an error."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One report a line, blank lines left out."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("text"))


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reader by suffix: csv, tsv, json lines, parquet, text."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if suffix == "tsv" else ",")
    if suffix in ("json", "jsonl"):
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    return spark.read.parquet(path) if suffix == "parquet" else read_lines(spark, path)


#: Suffixes whose bytes are text, and the most bytes that are unpacked from one archive.
TEXT_SUFFIXES, ARCHIVE_BYTES = (".txt", ".csv", ".tsv", ".md", ".json", ".html", ".htm"), 64 << 20


def _attachment_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def members(data: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            own = [i for i in sorted(z.infolist(), key=lambda i: i.filename) if i.filename.lower().endswith(TEXT_SUFFIXES)]
            if sum(i.file_size for i in own) > ARCHIVE_BYTES:
                raise ValueError("the archive unpacks to too much")
            return "\n".join(z.read(i).decode("utf-8", "replace") for i in own)

    def text(path: str, data: bytes) -> str | None:
        try:
            if path.lower().endswith(".zip"):
                return members(data)
            return data.decode("utf-8") if path.lower().endswith(TEXT_SUFFIXES) else None
        except (zipfile.BadZipFile, OSError, ValueError):
            return None

    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "text": [text(p, d) for p, d in zip(pdf["path"], pdf["content"], strict=True)]})


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text, HTML (its visible text) and zip files; what is no text or can't be read is null, not an error."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_attachment_text, "path string, text string")
    return raw.select("path", F.when(F.lower("path").rlike(r"\.html?$"), visible_text(F.col("text"))).otherwise(F.col("text")).alias("text"))


def distinct_files(files: DataFrame, name_rank: Column) -> DataFrame:
    """Byte-identical files once, the best name first."""
    keyed = files.withColumn("sha", F.sha2("content", 256))
    best = keyed.groupBy("sha").agg(F.min(F.struct(name_rank.alias("rank"), "path"))["path"].alias("path"))
    return keyed.join(best, ["sha", "path"], "left_semi")


def with_loose_files(index: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The index and, as rows of their own, files that it doesn't list."""
    return index.unionByName(files.join(index, key, "left_anti"), allowMissingColumns=True)


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files without a row of the same path, length and time in the text cache."""
    return files.join(cache, ["path", "length", "modificationTime"], "left_anti")


def map_columns(headers: list[str], fragments: list[tuple[str, str]] = REGISTER_FRAGMENTS) -> dict[str, str]:
    """Header to canonical column, first fragment that fits, each target once."""
    found: dict[str, str] = {}
    for header in headers:
        low = " ".join(header.lower().replace("_", " ").split())
        target = next((t for f, t in fragments if f in low and t not in found.values()), None)
        if target:
            found[header] = target
    return found


def canonical(df: DataFrame, fragments: list[tuple[str, str]] = REGISTER_FRAGMENTS) -> DataFrame:
    """A register in canonical columns, the rest in a map ``extra``; rows of nulls only are dropped."""
    mapped = map_columns(df.columns, fragments)
    if "description" not in mapped.values():
        raise ValueError("no column holds a description")
    rest = [c for c in df.columns if c not in mapped]
    extra = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest))) if rest else F.lit(None).cast("map<string,string>")
    return df.dropna("all").select(*(F.col(c).alias(t) for c, t in mapped.items()), extra.alias("extra"))


def unify(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL of mapped sources into one schema; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """Nested values as JSON, with a header; ``mark`` puts a UTF-8 byte order mark before it."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    flat = df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
    if mark and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def insert_absent(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: one for each key that the table lacks."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


# What headers of uploaded statements may hold, by column.
STATEMENT_HEADERS = {"text": ["statement", "report", "observation", "description", "text"], "site": ["site", "location", "yard"], "activity": ["activity", "operation", "work"]}


def statement_columns(headers: list[str]) -> dict[str, str | None]:
    """The header of each column of uploaded statements: the first that holds one of its words, else the one in its place.

    A header is given away once: where two columns would take it, the earlier of text, site, activity has it. Without a
    header in its place a column has none.
    """
    found: dict[str, str | None] = {}
    for name, words in STATEMENT_HEADERS.items():
        found[name] = next((h for h in headers if h not in found.values() and any(w in h.strip().lower() for w in words)), None)
    for place, name in enumerate(STATEMENT_HEADERS):
        if found[name] is None and place < len(headers) and headers[place] not in found.values():
            found[name] = headers[place]
    return found


def statements(df: DataFrame) -> DataFrame:
    """(text, site, activity) of uploaded rows whatever their headers; rows without a text are dropped, missing columns are empty."""
    columns = statement_columns(df.columns)
    clean = lambda name: F.coalesce(F.trim(F.col(f"`{columns[name]}`").cast("string")), F.lit("")) if columns[name] else F.lit("")
    return df.select(*(clean(name).alias(name) for name in STATEMENT_HEADERS)).where("text <> ''")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded statements: CSV with headers, or a JSON array of objects, by the suffix."""
    if path.lower().endswith(".json"):
        return statements(spark.read.option("multiLine", True).json(path))
    return statements(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
