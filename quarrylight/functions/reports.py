"""Column functions for safety alerts and registers: rules, outcomes, hedged facts, sections, reference numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions.spans import beginnings, first_start, matches, quick
from quarrylight.functions.text import collapse_ws

# Life-saving rules, what says that none applies, and other names of the rules.
RULES = ["Bypassing Safety Controls", "Confined Space", "Driving", "Energy Isolation", "Hot Work", "Line of Fire", "Safe Mechanical Lifting", "Work Authorisation", "Working at Height"]
NO_RULE = [
    "null", "none", "n/a", "na", "-", "nil", "", "unspecified", "other", "not applicable", "other issue - no applicable rule", "other issue no applicable rule", "no applicable rule", "no rule",
    "no life-saving rule", "unspecified - other",
]
RULE_NAMES = {
    "bypass safety controls": "Bypassing Safety Controls", "confined spaces": "Confined Space", "confined space entry": "Confined Space", "safe driving": "Driving", "isolation": "Energy Isolation", "loto": "Energy Isolation",
    "mechanical lifting": "Safe Mechanical Lifting", "lifting operations": "Safe Mechanical Lifting", "lifting": "Safe Mechanical Lifting", "work authorization": "Work Authorisation", "permit to work": "Work Authorisation",
    "work at height": "Working at Height", "working at heights": "Working at Height",
}

# Words that make a fact a possibility, fatality words, outcomes in order, and cues of record types.
HEDGE = r"(?i)\b(could|might|may|would|can|potential(?:ly)?|possibl[ey]|worst[- ]case|risk of|likely|narrowly|avoided|prevented|averted|no|without|zero|near)\b[^.]{0,60}$"
FATALITY = r"\b(fatal(?:ity|ities|ly)?|died|death|was killed|were killed|deceased)\b"
OUTCOMES = {
    "fatality": r"\bfatal(?:ity|ities)?\b",
    "lost_time_injury": r"\b(?:lti|ltis|dafwc|lost[- ]time(?: injur(?:y|ies)| incident)?|lost workday)\b",
    "restricted_work": r"\b(?:rwc|rwdc|rwi|restricted work(?: case| injury| duty)?)\b",
    "medical_treatment": r"\b(?:mto|mtc|mti|medical treatment(?: only| case| injury)?)\b",
    "first_aid": r"\bfirst[- ]aid(?: case| injury| only)?\b",
    "near_miss": r"\b(?:near[- ]miss|near[- ]hit|high potential|hipo)\b",
    "equipment_damage": r"\b(?:equipment|property|asset) damage\b|\bdropped object\b(?! injur)",
}
INJURY = r"(?i)\b(injur(?:y|ies|ed)|fractur|amputat|burn(?:s|ed)?|laceration|hospital|lti\b|medical treatment|first aid)\b"
NEAR_MISS = r"(?i)\b(near[- ]miss|near[- ]hit|no injur|no one was (?:hurt|injured)|nobody was (?:hurt|injured)|high potential|hipo)\b"
POTENTIAL = r"[^.!?\n]*\b(could have|might have|may have|would have|potential(?:ly)?|worst[- ]case|had the potential|could easily)\b[^.!?\n]*[.!?]?"
CONSEQUENCE = r"(?i)\b(fatal|death|die|kill|injur|serious|severe|major|life|harm|hospital|amputat|fractur|burn|crush|struck|dropped|fall|fell|explos|fire|electrocut|drown|collapse|loss of|catastroph|disab)\w*"
INJURED = ("lost_time_injury", "restricted_work", "medical_treatment", "first_aid")
#: How far before a word a hedge counts.
HEDGE_REACH = 80

# Sentences that alerts repeat.
BOILERPLATE = [
    r"to address this incident,?\s+this company issued the following(?: to (?:rig|its) personnel)?\s*:?",
    r"the corrective actions? stated in this alert are one company'?s attempts? to address the incident,? and do not necessarily reflect the position of iadc or the iadc hse committee\.?",
    r"iadc safety alert\s*",
    r"the following is a\s+(?:safety\s+)?alert issued by [^.\n]*\.",
    r"(?:please|kindly) (?:forward|circulate|distribute|share) (?:this|the) (?:alert|information)[^.\n]*\.",
    r"this (?:safety )?(?:alert|flash) is (?:issued|provided|intended) (?:for|as) (?:information|awareness)[^.\n]*\.",
    r"members are (?:reminded|encouraged)[^.\n]*\.",
    r"provided for information purposes? only\.?\s*this information should be evaluated to determine if it is applicable in your\s*operations,?\s*to avoid recurrence of such incidents\.?",
    r"^\s*page\s+\d+(?:\s+of\s+\d+)?\s*$",
]

# Headings of alert sections.
HEADINGS = {
    "narrative": ["what happened", "what happened?", "incident", "description", "description of incident", "brief description", "brief of incident", "brief of accident", "sequence of events", "brief of the incident", "incident description", "summary"],
    "what_went_wrong": ["what caused it", "what caused it?", "what went wrong", "what went wrong?", "cause", "causes", "probable cause", "probable causes", "root cause", "root causes", "findings", "investigation findings", "contributing factors", "observations", "observation", "analysis", "why it happened", "unsafe acts and conditions", "immediate causes"],
    "corrective_actions": ["corrective actions", "corrective action", "corrective actions and recommendations", "actions taken", "actions", "recommendations", "recommendation", "lessons learned", "lessons learnt", "learnings", "key learnings", "learning points"],
    "references": ["members may wish to refer to", "members may wish to review", "references"],
}

# Industry-code prefixes of the oil and gas sectors, and register categories.
SECTORS = {"211": "oil_gas_extraction", "213111": "drilling_oil_gas_wells", "213112": "support_activities_oil_gas", "324110": "petroleum_refineries"}


def _ladder(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda e, c: e.when(*c), cases[1:], F.when(*cases[0])).otherwise(default)


def _rule_key(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " "), r"^[ .]+|[ .]+$", "")


def is_no_rule(raw: Column) -> Column:
    key = _rule_key(raw)
    return key.isin(*NO_RULE) | F.translate(key, "–", "-").isin(*NO_RULE)


def canonical_rule(raw: Column) -> Column:
    """The life-saving rule that a raw value names: by its names, then without what stands in brackets, then by a rule's name in it."""
    names = {rule.lower(): rule for rule in RULES} | RULE_NAMES
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    key = _rule_key(raw)
    bare = F.trim(F.regexp_replace(key, r"\(.*?\)", ""))
    inside = _ladder([(key.contains(rule.lower()), F.lit(rule)) for rule in RULES], F.lit(None).cast("string"))
    return F.when(~is_no_rule(raw), F.coalesce(F.try_element_at(table, key), F.try_element_at(table, bare), inside))


def rule_parts(raw: Column) -> Column:
    return F.filter(F.split(raw, r"(?i)\s*(?:/|;|,|\band\b|&|\+)\s*"), lambda p: p != "")


def canonical_rules(raw: Column) -> Column:
    """Distinct rules of a value that may hold several, in order."""
    return F.array_distinct(F.array_compact(F.transform(rule_parts(raw), canonical_rule)))


def unmapped_rules(raw: Column) -> Column:
    """Parts of the value that name no rule and do not say that none applies."""
    return F.transform(F.filter(rule_parts(raw), lambda p: canonical_rule(p).isNull() & ~is_no_rule(p) & (F.trim(p) != "")), lambda x: F.trim(x))


def hedged(text: Column, start: Column) -> Column:
    """Whether a hedge stands before the place, in the same sentence."""
    first = F.greatest(start - HEDGE_REACH, F.lit(0))
    return text.substr(first + 1, start - first).rlike(HEDGE)


def report_cues(text: Column) -> Column:
    """Where the words of fatalities and outcomes could begin: a text is read once for all of them."""
    return beginnings(text, [FATALITY, *OUTCOMES.values()])


def actual_fatality(text: Column, begun: Column | None = None) -> Column:
    """Whether a fatality word stands without a hedge: "could have been fatal" is none.

    ``begun`` are the text's ``report_cues``, where they have been found already.
    """
    return F.exists(matches(text, FATALITY, begun), lambda m: ~hedged(text, m["start"]))


def outcome(text: Column, begun: Column | None = None) -> Column:
    """The outcome that stands first; each outcome counts by its first mention, unless that is hedged."""
    def first(name: str, pattern: str) -> Column:
        # Bound to a lambda's variable, the place is sought once.
        sound = lambda at: at.isNotNull() & (F.lit(name == "near_miss") | ~hedged(text, at))
        return F.get(F.transform(F.array(first_start(text, pattern, begun)), lambda at: F.when(sound(at), F.struct(at.alias("at"), F.lit(name).alias("name")))), F.lit(0))

    return F.array_min(F.array_compact(F.array(*(first(n, p) for n, p in OUTCOMES.items()))))["name"]


def record_type(text: Column, fatal: Column | None = None, first: Column | None = None) -> Column:
    """fatal, near_miss, injury or incident, the first that holds.

    ``fatal`` and ``first`` are the text's ``actual_fatality`` and ``outcome``, where they have been found already.
    """
    fatal, first = actual_fatality(text) if fatal is None else fatal, outcome(text) if first is None else first
    said = lambda pattern: text.rlike(quick(pattern.removeprefix("(?i)"), "(?i)"))
    return F.when(fatal, "fatal").when((first == "near_miss") | said(NEAR_MISS), "near_miss").when(first.isin(*INJURED) | said(INJURY), "injury").otherwise("incident")


def potential_consequence(text: Column) -> Column:
    """The first hedged sentence of 20 to 400 characters that names a harm."""
    flat = F.regexp_replace(text, r"\s*\n\s*", " ")
    sentences = F.transform(F.regexp_extract_all(flat, F.lit("(?i)" + POTENTIAL), 0), lambda x: collapse_ws(x))
    return F.get(F.filter(sentences, lambda s: s.rlike(CONSEQUENCE) & F.length(s).between(20, 400)), F.lit(0))


def strip_boilerplate(text: Column) -> Column:
    """The text without sentences that every alert repeats."""
    return F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, f"(?im){p}", " "), BOILERPLATE, text), r"[ \t]{2,}", " ")


def reflowed(lines: Column) -> Column:
    """Lines of a page as paragraphs: a bullet opens one, a line that ends in '/' or '-' is joined without a space."""
    def step(out: Column, line: Column) -> Column:
        last, n = F.element_at(out, -1), F.size(out)
        opens = (n == 0) | line.rlike(r"^\s*(?:[•●▪‣*–-]|\d{1,2}[.)])\s+")
        glue = F.when(last.rlike(r"[/-]$"), "").otherwise(" ")
        return F.when(opens, F.concat(out, F.array(F.trim(line)))).otherwise(F.concat(F.slice(out, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, glue, F.trim(line)))))

    return F.aggregate(F.filter(lines, lambda x: F.trim(x) != ""), F.array().cast("array<string>"), step)


def sections(text: Column) -> Column:
    """map of section to its text: a heading alone on a line, or before a colon or dash, opens a section; 'other' comes before any."""
    names = {h: name for name, own in HEADINGS.items() for h in own}
    quoted = "|".join(h.replace("?", r"\?") for h in sorted(names, key=len, reverse=True))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    alone, inline = rf"(?i)^(?:#+\s*)?({quoted})\s*[:?]?\s*$", rf"(?i)^(?:#+\s*)?({quoted})\s*[:-]\s+(.+)$"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: collapse_ws(x)), lambda x: x != "")

    def classed(line: Column) -> Column:
        return F.when(line.rlike(alone), F.struct(F.try_element_at(table, F.lower(F.regexp_extract(line, alone, 1))).alias("opens"), F.lit("").alias("body"))).when(
            line.rlike(inline), F.struct(F.try_element_at(table, F.lower(F.regexp_extract(line, inline, 1))).alias("opens"), F.regexp_extract(line, inline, 2).alias("body"))
        ).otherwise(F.struct(F.lit(None).cast("string").alias("opens"), line.alias("body")))

    def step(state: Column, line: Column) -> Column:
        now = F.coalesce(line["opens"], state["now"])
        return F.struct(now.alias("now"), F.when(line["body"] != "", F.concat(state["out"], F.array(F.struct(now.alias("section"), line["body"].alias("body"))))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit("other").alias("now"), F.array().cast("array<struct<section:string,body:string>>").alias("out"))
    placed = F.aggregate(F.transform(lines, classed), start, step, lambda s: s["out"])

    def body_of(name: str) -> Column:
        own = F.filter(placed, lambda p: p["section"] == name)
        return F.struct(F.lit(name).alias("key"), F.array_join(F.transform(own, lambda p: p["body"]), " ").alias("value"))

    return F.map_from_entries(F.filter(F.array(*map(body_of, ["other", *HEADINGS])), lambda e: e["value"] != ""))


def first_paragraph(text: Column, words: int = 8, most: int = 1500) -> Column:
    """The first paragraph of at least ``words`` words, else the beginning of the text."""
    long = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= words)
    return F.coalesce(collapse_ws(F.get(long, F.lit(0))), F.nullif(F.substring(collapse_ws(text), 1, most), F.lit("")))


def sector(code: Column) -> Column:
    """Oil and gas sector of an industry code."""
    return _ladder([(code.startswith(prefix), F.lit(name)) for prefix, name in SECTORS.items()], F.lit(None).cast("string"))


def register_category(value: Column) -> Column:
    """UA, UC, NM or INC; other values in capitals, empty ones null."""
    key = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(value), "[^a-z ]", "")), r"\s+", " "))
    known = F.when(key.isin("ua", "uc", "nm", "inc"), F.upper(key)).when(key.contains("unsafe act"), "UA").when(key.contains("unsafe cond"), "UC").when(key.contains("near") & key.contains("miss"), "NM").when(key == "incident", "INC")
    return F.coalesce(known, F.nullif(F.upper(F.trim(value)), F.lit("")))


def alert_number(text: Column, title: Column, date: Column) -> Column:
    """struct<number,year> of an alert number in either order, told apart by the date where there is one."""
    full = lambda yy: F.when(yy >= 90, 1900 + yy).otherwise(2000 + yy)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    pattern = r"(?i)\b(?:safety\s+)?alert\s*(?:no\.?|#)?\s*(\d{1,2})\s*[-–—]\s*(\d{2,3})\b"
    source = F.when(text.rlike(pattern), text).otherwise(title)
    a, b = (F.nullif(F.regexp_extract(source, pattern, k), F.lit("")) for k in (1, 2))
    head = r"^\s*(\d{2})\s*[-–—]\s*(\d{2,3})\b"
    x, y = (F.nullif(F.regexp_extract(title, head, k), F.lit("")) for k in (1, 2))
    year = F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")).cast("int")
    pad = lambda v: F.when(F.length(v) < 2, F.lpad(v, 2, "0")).otherwise(v)
    made = lambda first, second, when: F.struct(F.concat(pad(first), F.lit("-"), pad(second)).alias("number"), when.cast("int").alias("year"))
    return (
        F.when(x.isNotNull(), made(x, y, full(x.cast("int"))))
        .when(a.isNotNull() & (a.cast("int") == year % 100), made(two(a.cast("int")), b, year))
        .when(a.isNotNull() & (b.cast("int") == year % 100), made(two(b.cast("int")), a, year))
        .when(F.length(a) == 2, made(a, b, full(a.cast("int"))))
        .when(a.isNotNull(), made(b, a, full(b.cast("int"))))
    )
