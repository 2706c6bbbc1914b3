"""Incident reports that come as pages of text: lines, records, sections, victims, causal factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.reports import canonical_rules, reflowed, unmapped_rules
from quarrylight.functions.text import collapse_ws, normalize_unicode, parse_date, short_sha1, word_count
from quarrylight.operators.curation import marked_records

# Page furniture, regions, labels of one line and of sections, headers and fields of a victim's block.
PAGE_HEADERS = r"(?i)^(?:\d{4} safety data\s*[-–]\s*.*reports?|safety performance indicators\s*[-–].*|iogp permanent impairment incidents\s+\d{4}|contents|\d{1,3})$"
REGIONS = [
    "AFRICA ONSHORE", "AFRICA OFFSHORE", "ASIA/AUSTRALASIA ONSHORE", "ASIA/AUSTRALASIA OFFSHORE", "EUROPE ONSHORE", "EUROPE OFFSHORE", "MIDDLE EAST ONSHORE",
    "MIDDLE EAST OFFSHORE", "NORTH AMERICA ONSHORE", "NORTH AMERICA OFFSHORE", "RUSSIA & CENTRAL ASIA ONSHORE", "RUSSIA & CENTRAL ASIA OFFSHORE",
    "SOUTH & CENTRAL AMERICA ONSHORE", "SOUTH & CENTRAL AMERICA OFFSHORE",
]
LABELS = {
    "DATE": "date_raw", "COUNTRY": "country", "NUMBER OF DEATHS": "number_of_deaths", "WORKFORCE DEATHS": "number_of_deaths",
    "NUMBER OF PERMANENT IMPAIRMENT INJURIES": "number_of_pi_injuries", "WORKFORCE PI INJURIES": "number_of_pi_injuries", "FUNCTION": "function",
    "CAUSE": "cause", "ACTIVITY": "activity", "RULE": "lsr_primary_raw", "PRIMARY LIFE-SAVING RULE": "lsr_primary_raw",
    "SECONARY LIFE-SAVING RULE": "lsr_secondary_raw", "SECONDARY LIFE-SAVING RULE": "lsr_secondary_raw", "SECONDARY LIFE-SAVING RULES": "lsr_secondary_raw",
}
SECTIONS = {"NARRATIVE": "narrative", "WHAT WENT WRONG": "what_went_wrong", "CORRECTIVE ACTIONS AND RECOMMENDATIONS": "corrective_actions", "CAUSAL FACTORS": "causal_factors"}
VICTIM_HEADERS = ["FATALITY", "WORKFORCE FATALITY", "PERMANENT IMPAIRMENT", "WORKFORCE PERMANENT IMPAIRMENT"]
VICTIM_FIELDS = {
    "Function": "victim_function", "Employer": "victim_employer", "Occupation": "victim_occupation", "Body part": "victim_body_part",
    "Nature of injury": "victim_nature_of_injury", "Time in service": "victim_time_in_service", "PI Category": "pi_category", "PI Subcategory": "pi_subcategory",
    "LWDC Days": "lwdc_days", "RWDC Days": "rwdc_days",
}
FILE_KINDS = {"sf": "fatal", "sh": "hipo", "fpi": "permanent_impairment"}
DAYS = ("lwdc_days", "rwdc_days")
LABEL_LINE = r"^([A-Z][A-Z /\-&()]+?)\s*[:;]\s*(.*)$"
CAUSAL = r"^(PEOPLE \(ACTS\)|PROCESS \(CONDITIONS\))\s*:\s*(.*)$"
VICTIM_LABEL = "(" + "|".join(VICTIM_FIELDS) + r"):\s*"
#: Words that a narrative needs to stand alone, and below which it is called very short.
ALONE, SHORT = 12, 8
#: More lines than a section has.
MOST = 1 << 30


def file_kind(path: Column) -> Column:
    """struct<year,record_type> of a report's file name; null where the name has another form."""
    form = r"(?i)(?:^|/)(20\d{2})([a-z]+)(?:(?:\s|%20)*\(\d+\))?\.pdf$"
    table = F.create_map(*(F.lit(x) for pair in FILE_KINDS.items() for x in pair))
    kind = F.try_element_at(table, F.lower(F.regexp_extract(path, form, 2)))
    return F.when(path.rlike(form), F.struct(F.regexp_extract(path, form, 1).try_cast("int").alias("year"), kind.alias("record_type")))


def page_lines(pages: DataFrame, by: list[str], page: str, text: str) -> DataFrame:
    """(by, page, at, line): the lines of each page without blank ones, headers and page numbers; ``at`` counts on over the pages.

    Pages are dealt by ``by`` before they are taken apart: a file of few row groups is read by few tasks, and what numbers
    the records of ``by`` finds its lines where they are.
    """
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    tidy = F.transform(F.split(F.col(text), r"\r\n|\r|\n"), lambda x: collapse_ws(normalize_unicode(x, compose=False)))
    # An inner explode would have Spark tidy a page twice, to see first whether it has lines; those of none are dropped below.
    lines = pages.select(*by, page, F.posexplode_outer(tidy).alias("k", "line")).where((F.col("line") != "") & ~F.col("line").rlike(PAGE_HEADERS))
    return lines.select(*by, page, F.struct(page, "k").alias("at"), "line")


def page_records(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, record, heading, lines, body): the records that a DATE: line opens, under the last region above them."""
    region = F.when(F.upper("line").isin(*REGIONS), F.upper("line"))
    found = marked_records(lines.withColumn("__region", region), by, "at", "line", F.col("line").startswith("DATE:"), F.col("__region"))
    inside = F.filter(F.split("body", "\n"), lambda x: ~F.upper(x).isin(*REGIONS))
    return found.withColumn("body", F.array_join(inside, "\n")).withColumn("lines", F.size(inside))


def victim(text: Column) -> Column:
    """struct of the victim's fields in 'Label: value, Label: value'; the last of equal labels counts, days are ints."""
    value = lambda label: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(text, rf"(?s).*{label}:\s*(.*?)(?={VICTIM_LABEL}|$)", 1)), r"^[,;\s]+|[,;\s]+$", ""), F.lit(""))
    days = lambda v: F.nullif(F.regexp_extract(v, r"^\d+", 0), F.lit("")).try_cast("int")
    return F.struct(*((days(value(label)) if name in DAYS else value(label)).alias(name) for label, name in VICTIM_FIELDS.items()))


def causal_factors(lines: Column) -> Column:
    """array<struct<group,category,factor>>, distinct: a line that names no group goes on from the one before."""
    kind = "array<struct<group:string,category:string,factor:string>>"

    def step(out: Column, line: Column) -> Column:
        rest = F.regexp_extract(line, CAUSAL, 2)
        group = F.when(F.startswith(line, F.lit("PEOPLE")), "people_acts").otherwise("process_conditions")
        new = F.struct(group.alias("group"), F.trim(F.substring_index(rest, ":", 1)).alias("category"), F.nullif(F.trim(F.regexp_extract(rest, r"^[^:]*:(.*)$", 1)), F.lit("")).alias("factor"))
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["group"].alias("group"), last["category"].alias("category"), F.concat_ws(" ", last["factor"], line).alias("factor"))
        n = F.size(out)
        return F.when(line.rlike(CAUSAL), F.concat(out, F.array(new))).when(n > 0, F.concat(F.slice(out, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(longer))).otherwise(out)

    own = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    none = F.exists(own, lambda x: x.rlike("(?i)no causal factors? allocated"))
    empty = F.array().cast(kind)
    return F.when(none, empty).otherwise(F.array_distinct(F.aggregate(own, empty, step)))


def _split(body: Column) -> Column:
    """struct<head,parts>: the lines before any section, and struct<section,lines> of each section's lines in order."""
    names = "|".join(SECTIONS)
    apart = F.regexp_replace(body, rf"(?m)(?:(?<=\s)|^)({names}):\s*", "\n$1:\n")
    split = F.split(apart, rf"(?m)^(?=(?:{names}):$)")
    rows = lambda x: F.filter(F.transform(F.split(x, "\n"), lambda x: F.trim(x)), lambda y: y != "")
    headed = lambda c: c.rlike(rf"^(?:{names}):")

    def placed(chunks: Column) -> Column:
        head = F.flatten(F.transform(F.filter(chunks, lambda c: ~headed(c)), rows))
        parts = F.transform(F.filter(chunks, headed), lambda c: F.struct(F.regexp_extract(c, rf"^({names}):", 1).alias("section"), F.slice(rows(c), F.lit(2), F.lit(MOST)).alias("lines")))
        return F.struct(head.alias("head"), parts.alias("parts"))

    # Bound to a lambda's variable, a body is split once; a bare struct would be worked out again for each field that is asked for.
    return F.get(F.transform(F.array(split), placed), F.lit(0))


def _placed(head: Column) -> Column:
    """array<struct<kind,label,value>> of head lines: a label with its value, a victim's line, a block header, or what is unknown."""
    def step(state: Column, line: Column) -> Column:
        label = F.regexp_extract(line, LABEL_LINE, 1)
        header = F.rtrim(F.regexp_replace(line, ":+$", "")).isin(*VICTIM_HEADERS)
        known = label.isin(*LABELS)
        own = state["victim"] | line.rlike(VICTIM_LABEL)
        kind = F.when(header, "header").when(known, "label").when(own, "victim").otherwise("unknown")
        return F.struct(
            F.when(header, True).when(known, False).otherwise(own).alias("victim"),
            F.concat(state["out"], F.array(F.struct(kind.alias("kind"), label.alias("label"), F.when(known & ~header, F.trim(F.regexp_extract(line, LABEL_LINE, 2))).otherwise(line).alias("value")))).alias("out"),
        )

    start = F.struct(F.lit(False).alias("victim"), F.array().cast("array<struct<kind:string,label:string,value:string>>").alias("out"))
    return F.aggregate(head, start, step, lambda s: s["out"])


def _category(value: Column) -> Column:
    shouted = (value == F.upper(value)) & value.rlike("[A-Z]") & (F.length(value) > 3)
    return F.nullif(F.when(shouted, F.concat(F.upper(F.substring(value, 1, 1)), F.lower(value.substr(F.lit(2), F.length(value))))).otherwise(value), F.lit(""))


def parsed_records(records: DataFrame, kind: Column, body: str = "body") -> DataFrame:
    """``records`` with what their bodies say: labels, victim, sections, rules, the text to read and warnings.

    ``kind`` is the record type (fatal, hipo or permanent_impairment). A narrative under twelve words with a longer
    account of what went wrong is joined with it. A record without a part has a null there; an empty body has warnings only.
    """
    out = records.withColumn("record_type", kind).withColumn("__s", _split(F.coalesce(F.col(body), F.lit("")))).withColumn("__p", _placed(F.col("__s.head")))

    def label(name: str) -> Column:
        own = F.filter("__p", lambda p: (p["kind"] == "label") & p["label"].isin(*(k for k, v in LABELS.items() if v == name)))
        return F.try_element_at(F.transform(own, lambda p: p["value"]), F.lit(-1))

    def lines(title: str) -> Column:
        return F.flatten(F.transform(F.filter("__s.parts", lambda p: p["section"] == title), lambda p: p["lines"]))

    def section(title: str) -> Column:
        return F.nullif(F.array_join(F.transform(reflowed(lines(title)), lambda x: collapse_ws(x)), "\n"), F.lit(""))

    of = lambda which: F.transform(F.filter("__p", lambda p: p["kind"] == which), lambda p: p["value"])
    number = lambda v: F.nullif(F.regexp_extract(v, r"^\d+", 0), F.lit("")).try_cast("int")
    out = out.select(
        "*", label("date_raw").alias("date_raw"), parse_date(label("date_raw")).alias("date"), *(_category(label(n)).alias(n) for n in ("country", "function", "cause", "activity")),
        *(number(label(n)).alias(n) for n in ("number_of_deaths", "number_of_pi_injuries")), label("lsr_primary_raw").alias("lsr_primary_raw"), label("lsr_secondary_raw").alias("lsr_secondary_raw"),
        victim(F.array_join(of("victim"), " ")).alias("victim"), *(section(title).alias(name) for title, name in SECTIONS.items() if name != "causal_factors"),
        causal_factors(lines("CAUSAL FACTORS")).alias("causal_factors"), F.nullif(F.array_join(of("unknown"), "\n"), F.lit("")).alias("unparsed"),
    )
    none = F.array().cast("array<string>")
    both = lambda f: F.concat(*(F.coalesce(f(F.col(c)), none) for c in ("lsr_primary_raw", "lsr_secondary_raw")))
    out = out.withColumn("life_saving_rules", F.array_distinct(both(canonical_rules))).withColumn("lsr_unmapped", both(unmapped_rules)).withColumn("narrative_words", F.coalesce(word_count(F.col("narrative")), F.lit(0)))
    short = F.coalesce(F.col("narrative").isNotNull() & (F.col("narrative_words") < ALONE) & (word_count(F.col("what_went_wrong")) > F.col("narrative_words")), F.lit(False))
    joined = F.concat(F.regexp_replace("narrative", r"\.+$", ""), F.lit(". "), F.col("what_went_wrong"))
    warnings = F.array(
        F.when(F.col("narrative").isNull(), "missing_narrative").when(F.col("narrative_words") < SHORT, "very_short_narrative"),
        F.when(F.size("life_saving_rules") == 0, "no_lsr"),
        F.when(F.size("lsr_unmapped") > 0, F.concat(F.lit("lsr_unmapped:"), F.array_join("lsr_unmapped", "|"))),
        F.when(F.col("date").isNull(), "date_unparsed"),
        F.when((F.col("record_type") == "fatal") & (F.coalesce("number_of_deaths", F.lit(0)) == 0), "fatal_without_death_count"),
        F.when(F.col("unparsed").isNotNull(), "unparsed_header_lines"),
    )
    out = out.withColumn("text", F.when(short, joined).otherwise(F.col("narrative"))).withColumn("text_composition", F.when(short, "narrative+what_went_wrong").otherwise("narrative"))
    return out.withColumn("warnings", F.array_compact(warnings)).withColumn("content_key", short_sha1(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("narrative", "date_raw", "country"))))).drop("__s", "__p")
