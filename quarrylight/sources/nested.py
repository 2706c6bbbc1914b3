"""JSON of unknown shape, walked with Spark's variant type: entries of nested lists, and texts that pages carry in scripts.

A walk goes down level by level to a stated depth, as a chain of projections: nothing is shuffled, and a value that is no
JSON has nothing in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that a walk goes down; what lies deeper is left out.
DEPTH = 10
NODES = "array<struct<path:array<int>,key:string,v:variant>>"
# Fields that hold a page's text, scripts that hold its data, and the length from which another string counts.
TEXT_FIELDS = ("articleBody", "description", "body", "content", "summary", "text", "html", "excerpt")
DATA_IDS = r"""(?i)\bid\s*=\s*["']?(__NEXT_DATA__|__NUXT_DATA__)\b"""
DATA_TYPES = r"""(?i)\btype\s*=\s*(["'][^"']*json[^"']*["']|[^\s>"']*json)"""
LONG_STRING = 120
SCRIPT, SCRIPT_OPEN, SCRIPT_ENDS = r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)^<script\b([^>]*)>", r"(?is)^<script\b[^>]*>|</script\s*>$"
META = r"(?is)<meta\b[^>]*>"
META_NAMES = r"""(?i)\b(?:name\s*=\s*["']?(?:description|twitter:description)\b|property\s*=\s*["']?og:description\b)"""
META_CONTENT = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def root(json: Column) -> Column:
    """A JSON text as the one node that a walk starts from; null and what is no JSON give none."""
    parsed = F.try_parse_json(json)
    return F.when(parsed.isNotNull(), F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit("").alias("key"), parsed.alias("v")))).otherwise(F.array().cast(NODES))


def children(node: Column) -> Column:
    """The nodes right below: elements of a list in order, fields of an object in order of name."""
    of = lambda key, value, i: F.struct(F.concat(node["path"], F.array(i)).alias("path"), key.alias("key"), value.alias("v"))
    elements = F.transform(F.try_variant_get(node["v"], "$", "array<variant>"), lambda x, i: of(F.lit(""), x, i))
    fields = F.transform(F.map_entries(F.try_variant_get(node["v"], "$", "map<string,variant>")), lambda e, i: of(e["key"], e["value"], i))
    return F.coalesce(elements, fields, F.array().cast(NODES))


def string_of(node: Column) -> Column:
    """The value of a node that is a string, else null."""
    return F.when(F.schema_of_variant(node["v"]) == "STRING", F.try_variant_get(node["v"], "$", "string"))


def walked(df: DataFrame, json: Column, into: str, found, enter, depth: int = DEPTH) -> DataFrame:
    """``df`` with ``into``: what ``found`` gives for the nodes for which it isn't null, in the order of a walk from the top.

    ``enter`` says below which nodes the walk goes on.
    """
    taken = lambda level: F.transform(F.filter(level, lambda n: found(n).isNotNull()), lambda n: F.struct(n["path"].alias("path"), found(n).alias("value")))
    out = df.withColumn("__level", root(json)).withColumn("__taken", taken(F.col("__level")))
    for _ in range(depth):
        out = out.withColumn("__level", F.flatten(F.transform(F.filter("__level", enter), children)))
        out = out.withColumn("__taken", F.concat("__taken", taken(F.col("__level"))))
    return out.withColumn(into, F.transform(F.array_sort("__taken"), lambda x: x["value"])).drop("__level", "__taken")


def nested_entries(df: DataFrame, json: str, field: str, schema: str, depth: int = DEPTH) -> DataFrame:
    """A row for each object with ``field``, at whatever depth of lists and objects it stands, with its fields by ``schema``.

    Columns: those of ``df``, place (from 0) and entry. What lies below an entry is its own; fields that the entry lacks
    or that don't fit are null. Rows whose JSON is null or broken, or that have no entry, give no row.
    """
    holds = lambda n: F.coalesce(F.map_contains_key(F.try_variant_get(n["v"], "$", "map<string,variant>"), field), F.lit(False))
    out = walked(df, F.col(json), "__entries", lambda n: F.when(holds(n), F.to_json(n["v"])), lambda n: ~holds(n), depth)
    # An inner explode would have Spark ask before it, in one expression without the levels in between, whether there are any
    # entries: each level would be walked again from the top.
    return out.select("*", F.posexplode_outer("__entries").alias("place", "__entry")).where("place is not null").withColumn("entry", F.from_json("__entry", schema)).drop("__entries", "__entry")


def data_scripts(html: Column) -> Column:
    """The bodies of scripts that hold data: those of known ids and of JSON types."""
    opening = lambda s: F.regexp_extract(s, SCRIPT_OPEN, 1)
    own = F.filter(F.regexp_extract_all(html, F.lit(SCRIPT), 0), lambda s: opening(s).rlike(DATA_IDS) | opening(s).rlike(DATA_TYPES))
    return F.transform(own, lambda s: F.regexp_replace(s, SCRIPT_ENDS, ""))


def _plain(texts: Column) -> Column:
    bare = F.transform(texts, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " ")))
    return F.array_join(F.array_distinct(F.filter(bare, lambda t: t != "")), "\n")


def embedded_texts(df: DataFrame, html: str, into: str, depth: int = DEPTH) -> DataFrame:
    """``df`` with ``into``: the texts that a page rendered by scripts carries in their JSON, a line each, without tags and repeats.

    A string counts if its field is one of TEXT_FIELDS, or if it is long, has a space and is neither an address nor JSON.
    Without any, the page's descriptions stand in. Null pages have null.
    """

    def text(node: Column) -> Column:
        value = string_of(node)
        long = (F.length(value) > LONG_STRING) & F.contains(value, F.lit(" ")) & ~value.rlike(r"^(http|\{|\[)")
        return F.when(node["key"].isin(*TEXT_FIELDS) | long, value)

    page = F.col(html)
    # The scripts as one list: a walk goes through them in turn; broken ones are left out first.
    sound = F.filter(data_scripts(page), lambda s: F.try_parse_json(s).isNotNull())
    together = F.concat(F.lit("["), F.array_join(sound, ","), F.lit("]"))
    out = walked(df, together, "__texts", text, lambda n: F.lit(True), depth + 1)
    tags = F.filter(F.regexp_extract_all(page, F.lit(META), 0), lambda m: m.rlike(META_NAMES))
    described = F.transform(tags, lambda m: F.concat(F.regexp_extract(m, META_CONTENT, 1), F.regexp_extract(m, META_CONTENT, 2)))
    return out.withColumn(into, F.when(page.isNotNull(), F.when(F.size("__texts") > 0, _plain(F.col("__texts"))).otherwise(_plain(described)))).drop("__texts")
