"""Alert documents: one row an alert from its page and its attachments, with the part that counts, its header, rules and outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import reports as R
from quarrylight.functions.text import collapse_ws

# Stop words of the languages that attachments come in, and names of languages in file names.
STOP_WORDS = {
    "en": ["the", "and", "was", "were", "with", "that", "this", "for", "from", "which", "had", "been", "not", "while", "during", "into"],
    "es": ["el", "la", "los", "las", "del", "que", "una", "por", "para", "con", "fue", "estaba", "se", "al", "como"],
    "pt": ["o", "os", "da", "do", "das", "dos", "que", "uma", "por", "para", "com", "foi", "estava", "não", "ao"],
    "fr": ["le", "la", "les", "des", "une", "que", "pour", "avec", "dans", "sur", "était", "été", "est", "pas", "qui"],
    "id": ["yang", "dan", "di", "untuk", "dengan", "tidak", "pada", "dari", "ini", "itu", "adalah", "telah", "ke", "oleh"],
}
HINDI_NAMED = r"(?i)(?:[_\-. (]|^)hindi(?:[_\-. )]|$)"
# The header block of one board's alerts, and its segments.
REFERENCE = r"(?i)OISD\s*/\s*SA\s*/\s*(\d{4}-\d{2})\s*/\s*([A-Z&]+)\s*/\s*(\d{1,3})"
DATED = r"(?i)\b(?:dated?|dt)\s*[.:]*\s*(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
FIELD = r"(?im)^\s*{}\s*:\s*(.+)$"
SEGMENTS = {"E&P": "exploration_production", "P&E": "projects_engineering", "PL": "pipelines", "MOLPG": "marketing_lpg", "MOPOL": "marketing_pol", "REF": "refinery", "GP": "gas_processing", "LPG": "lpg"}
LOSSES = {"fatality": r"(?i)fatal|death|died|killed", "injury": r"(?i)injur|burn|fractur|hospital", "equipment_damage": r"(?i)fire|loss|damage|burnt|spill|leak|explos", "near_miss": r"(?i)no (?:injury|loss)|near miss"}
# How rules are announced in a text, topics of ships alone, and the lengths that decide.
RULE_LINE = r"(?i)life[- ]saving rules?\s*(?:referenced|:)?\s*[:\-]?\s*(.+)"
MARINE_TOPICS = r"(?i)\b(diving bell|saturation div|diver|rov\b|remotely operated vehicle|dynamic positioning|\bdp\b|mooring line|anchor handling|gangway|man overboard|lifeboat|fast rescue|gps jamming|spoofing|navigation|collision at sea|bridge watch|helicopter)\b"
LEAST_BODY, ATTACHED, PAGE_ENOUGH, SHORT_NARRATIVE, LEAST_SURE = 15, 200, 300, 12, 0.02
LEAST_TEXT, DEVANAGARI_SHARE = 40, 0.15
ATTACHMENTS = "array<struct<file:string,text:string>>"


def let(value: Column, function) -> Column:
    return F.get(F.transform(F.array(value), function), F.lit(0))


def text_language(text: Column) -> Column:
    """en, hi, es, pt, fr, id or other: by script, then by the share of each language's stop words, the first of equals."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúàâãçêôõñü]+"), 0)

    def best(own: Column) -> Column:
        share = lambda name: F.size(F.filter(own, lambda w: w.isin(*STOP_WORDS[name]))) / F.size(own)
        shares = F.array(*(F.struct(share(name).alias("share"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, name in enumerate(STOP_WORDS)))
        return let(F.array_max(shares), lambda b: F.when(b["share"] >= LEAST_SURE, b["name"]))

    devanagari = F.length(F.regexp_replace(text, "[^ऀ-ॿ]", "")) > DEVANAGARI_SHARE * F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < LEAST_TEXT, "other").when(devanagari, "hi").otherwise(F.coalesce(let(words, lambda own: F.when(F.size(own) > 0, best(own))), F.lit("other")))


def attachment_parts(attachments: Column) -> Column:
    """struct<en,hi,languages> of an alert's attachments: English and Hindi texts joined, others only listed.

    A file named for Hindi whose text tells nothing counts as Hindi; empty texts are passed over.
    """
    named = lambda a: let(text_language(a["text"]), lambda lang: F.struct(a["file"].alias("file"), F.when((lang == "other") & a["file"].rlike(HINDI_NAMED), "hi").otherwise(lang).alias("lang"), F.length(a["text"]).alias("chars"), a["text"].alias("text")))
    there = F.transform(F.filter(attachments, lambda a: F.trim(a["text"]) != ""), named)

    def parts(own: Column) -> Column:
        of = lambda lang: F.array_join(F.transform(F.filter(own, lambda a: a["lang"] == lang), lambda a: a["text"]), "\n")
        return F.struct(of("en").alias("en"), F.nullif(of("hi"), F.lit("")).alias("hi"), F.transform(own, lambda a: F.struct(a["file"].alias("file"), a["lang"].alias("lang"), a["chars"].alias("chars"))).alias("languages"))

    return let(F.coalesce(there, F.array().cast("array<struct<file:string,lang:string,chars:int,text:string>>")), parts)


def header(text: Column) -> Column:
    """struct<reference,segment,year,date,title,location,activity,loss_outcome,outcome> of the block that a board's alerts start with (P10)."""
    found = lambda pattern, k=1: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    # Of a field that is stated twice the last counts, as later lines correct earlier ones.
    stated = lambda name: F.nullif(collapse_ws(F.element_at(F.regexp_extract_all(text, F.lit(FIELD.format(name)), 1), -1)), F.lit(""))
    field = lambda name: F.when(F.size(F.regexp_extract_all(text, F.lit(FIELD.format(name)), 1)) > 0, stated(name))
    years, code, number = found(REFERENCE), F.upper(found(REFERENCE, 2)), found(REFERENCE, 3)
    segments = F.create_map(*(F.lit(x) for pair in SEGMENTS.items() for x in pair))
    day, month, year = (found(DATED, k) for k in (1, 2, 3))
    loss = field(r"(?:loss\s*/?\s*outcome|outcome)")
    outcome = reduce(lambda e, x: e.when(loss.rlike(x[1]), x[0]), LOSSES.items(), F.when(F.lit(False), ""))
    return F.struct(
        F.concat(F.lit("OISD/SA/"), years, F.lit("/"), code, F.lit("/"), F.lpad(number, 2, "0")).alias("reference"), F.coalesce(F.try_element_at(segments, code), F.lower(code)).alias("segment"),
        F.coalesce(F.substring(years, 1, 4), year).cast("int").alias("year"), F.when(year.isNotNull(), F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))).alias("date"),
        field("title").alias("title"), field("location").alias("location"), field("activity").alias("activity"), loss.alias("loss_outcome"), outcome.alias("outcome"),
    )


def stated_rules(text: Column, tags: Column) -> Column:
    """struct<rules,unmapped> of an alert's tags and of what its text announces as life-saving rules."""
    lines = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RULE_LINE), 1), lambda x: F.split(x, r"[,;/\n]|\band\b")))
    raw = F.transform(F.concat(F.coalesce(tags, F.array().cast("array<string>")), lines), lambda x: F.regexp_replace(x, r"^[ .\-]+|[ .\-]+$", ""))
    return let(raw, lambda own: F.struct(F.array_distinct(F.flatten(F.transform(own, R.canonical_rules))).alias("rules"), F.flatten(F.transform(own, R.unmapped_rules)).alias("unmapped")))


def alert_documents(alerts: DataFrame) -> DataFrame:
    """One row an alert with what its parts say (P22); alerts whose text is too short are left out.

    ``alerts`` has title, date, reference, tags, html_text, attachments (of type ATTACHMENTS), prefer_page (boolean: the
    page is the alert, its attachments are something else), marine and board (booleans: ships' bulletins; alerts with a
    header block). Precedence: the body is the page if that is preferred and long enough, else the English attachments if
    they are, else the page; date and reference are those given, then the header's, then those that the text numbers;
    the title is the header's, then the one given; the outcome is a fatality without a hedge, the header's, the title's,
    then that of the narrative and the body. Other columns stay; nulls count as empty. Texts are read whole.
    """
    text_of = lambda name: F.coalesce(F.trim(name), F.lit(""))
    page = text_of("html_text")
    preferred = F.coalesce(F.col("prefer_page"), F.lit(False)) & (F.length(page) > PAGE_ENOUGH)
    none = F.array().cast(ATTACHMENTS)
    out = alerts.withColumn("__parts", attachment_parts(F.when(preferred, none).otherwise(F.coalesce(F.col("attachments").cast(ATTACHMENTS), none))))
    attached = F.trim("__parts.en")
    from_files = F.length(attached) > ATTACHED
    body = F.regexp_replace(R.strip_boilerplate(F.when(from_files, attached).otherwise(page)), r"\n{3,}", "\n\n")
    out = out.withColumn("body", body).withColumn("text_source", F.when(from_files, "attachment").otherwise("html")).where(F.length("body") >= LEAST_BODY)
    b = F.col("body")
    out = out.withColumn("__sections", R.sections(b))
    section = lambda name: F.try_element_at(F.col("__sections"), F.lit(name))
    out = out.withColumn("narrative", F.coalesce(section("narrative"), R.first_paragraph(F.coalesce(section("other"), b)))).withColumn("what_went_wrong", section("what_went_wrong"))
    told = F.coalesce(F.col("narrative"), F.lit(""))
    words = F.size(F.filter(F.split(told, r"\s+"), lambda w: w != ""))
    out = out.withColumn("narrative_words", words).withColumn("text", F.when((told != "") & (words < SHORT_NARRATIVE) & F.col("what_went_wrong").isNotNull(), F.concat(F.regexp_replace(told, r"\.+$", ""), F.lit(". "), "what_went_wrong")).otherwise(F.col("narrative")))
    is_board = F.coalesce(F.col("board"), F.lit(False)) | F.contains(F.regexp_replace(F.upper(b), " ", ""), F.lit("OISD/SA"))
    out = out.withColumn("__header", F.when(is_board, header(b)))
    given = F.nullif(collapse_ws(F.col("title")), F.lit(""))
    out = out.withColumn("__numbered", R.alert_number(b, given, F.col("date"))).withColumn("title", F.coalesce("__header.title", given))
    out = out.withColumn("actual_fatality", R.actual_fatality(b))
    near = F.concat(told, F.lit(" "), b)
    found = F.coalesce(F.col("__header.outcome"), R.outcome(F.coalesce("title", F.lit(""))), R.outcome(near))
    out = out.withColumn("actual_outcome", F.when(F.col("actual_fatality"), "fatality").otherwise(found))
    kind = F.when(F.col("actual_fatality"), "fatal").when((F.col("actual_outcome") == "near_miss") | near.rlike(R.NEAR_MISS), "near_miss").when(F.col("actual_outcome").isin(*R.INJURED) | F.coalesce("narrative", b).rlike(R.INJURY), "injury").otherwise("incident")
    year = F.coalesce(F.col("__header.year"), F.col("__numbered.year"))
    day = F.coalesce(F.nullif(F.col("date"), F.lit("")), F.col("__header.date"), F.col("__numbered.year").cast("string"))
    rules = stated_rules(b, F.col("tags"))
    marine = F.coalesce(F.col("marine"), F.lit(False)) & F.concat(F.coalesce("title", F.lit("")), F.lit(" "), b).rlike(MARINE_TOPICS)
    injured = F.when(told.rlike(R.NEAR_MISS), False).when(told.rlike(R.INJURY), True)
    columns = {
        "record_type": kind, "reference": F.coalesce(F.nullif(F.col("reference"), F.lit("")), F.col("__header.reference"), F.col("__numbered.number")), "year": F.coalesce(year, F.nullif(F.regexp_extract(day, r"^(\d{4})", 1), F.lit("")).cast("int")), "date": day,
        "potential_consequence": R.potential_consequence(F.concat_ws(" ", told, F.coalesce("what_went_wrong", F.lit("")), b)), "text_hi": F.col("__parts.hi"), "attachment_languages": F.col("__parts.languages"), "__rules": rules, "off_domain": marine, "actual_injury": injured,
        "location": F.col("__header.location"), "activity": F.col("__header.activity"), "loss_outcome": F.col("__header.loss_outcome"), "segment": F.col("__header.segment"), "corrective_actions": section("corrective_actions"), "references": section("references"), "sections_found": F.map_keys("__sections"),
    }
    out = out.withColumns(columns).withColumns({"life_saving_rules": F.col("__rules.rules"), "rules_unmapped": F.col("__rules.unmapped")})
    return out.select(*(c for c in out.columns if not c.startswith("__") and c not in ("html_text", "attachments", "prefer_page", "marine", "board")))
