"""Projections of labelled and public registers onto common columns: gold labels, severe injuries, abstracts, mine accidents, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.reports import canonical_rules, sector, unmapped_rules
from quarrylight.functions.text import collapse_ws, normalize_unicode, sentence_case, tolerant_int, word_count, year_in
from quarrylight.operators.corpus import first_rule

# Statement types, energies and barrier states of the gold labels.
STATEMENTS = {
    "observed": "observed", "hypothetical": "hypothetical", "historical": "historical", "training": "training_example", "training_example": "training_example",
    "corrective_closed": "corrective_completed", "corrective_completed": "corrective_completed", "condition_only": "condition_only", "positive": "observed",
    "suggestion": "hypothetical", "unscorable": "condition_only",
}
ENERGIES = {
    "none": [], "gravity_height": ["gravity"], "suspended_load": ["gravity", "mechanical"], "excavation_collapse": ["gravity"], "vehicle": ["motion"],
    "mechanical_motion": ["mechanical", "motion"], "electrical": ["electrical"], "pressure": ["pressure"], "thermal_fire": ["thermal"],
    "toxic_atmosphere": ["chemical"], "oxygen_deficiency": ["chemical"], "chemical": ["chemical"], "radiation": ["radiation"], "biological": ["biological"], "drowning": ["water"],
}
STATES = {"failed": "absent", "degraded": "present_ineffective", "intact": "present_effective", "unknown": "unknown"}

# Barrier and trap rules, the first that fits.
BARRIERS = [
    (r"loto|isolation|lock ?out|de-?energi", "energy_isolation"),
    (r"gas test|gas detect|lel|atmospher|o2|h2s|ventilat", "gas_test"),
    (r"entry permit|confined space permit|entry authori", "entry_permit"),
    (r"hot work permit|hot work", "hot_work_permit"),
    (r"permit to work|ptw|work permit|permit\b", "ptw"),
    (r"fall protection|fall arrest|harness|lanyard|lifeline|anchorage|edge protection|guard ?rail|handrail", "fall_arrest"),
    (r"tool lanyard|tool tether|drop(ped)? object|secondary retention", "tool_lanyard"),
    (r"barricad|drop zone|exclusion zone|cordon|restricted area|line of fire|standing clear", "exclusion_zone"),
    (r"lifting plan|lift plan|tag ?line|rigging|swl|load chart|crane", "lifting_plan"),
    (r"guard|guarding|interlock|machine", "machine_guard"),
    (r"shoring|benching|trench|excavation support|sloping", "exclusion_zone"),
    (r"containment|pressure relief|psv|relief valve|isolation valve|integrity|nrv|bop|well control", "energy_isolation"),
    (r"ppe|helmet|goggles|gloves|respirat|scba|life jacket|boots|hand protection|eye protection|head protection", "ppe"),
    (r"housekeeping|escape route|signage|training|competen|supervis|communication|reporting|inspection|maintenance|procedure|sop|jsa|tbt", "management_control"),
]
TRAPS = [
    (r"negation", "negation"),
    (r"historical", "historical"),
    (r"hypothetical|suggestion", "hypothetical"),
    (r"corrective|historical_closed", "corrective_completed"),
    (r"contradict|ppe_x|trivial_ppe|borderline_ppe|ppe_ground", "contradiction_ppe"),
    (r"injury_but_low|low_sif|numbers_matter|missing_unit|missing_number|borderline_height", "low_energy_or_numbers"),
    (r"capacity|barrier_worked|mitigation_barrier|detection_barrier|instrument_barrier|partial_barrier|negation_barrier_intact", "capacity_or_barrier_status"),
    (r"vague|unscorable|boilerplate|pattern_statement|quota_gaming", "vague_or_unscorable"),
    (r"sarcasm|minimising", "sarcasm_minimising"),
    (r"duplicate", "duplicate_cluster"),
    (r"^india_|monsoon|wildlife|lightning|remote|pilferage|public_access|rig_move|soft_soil|heat|disruption|power|road|improvised", "india_context"),
    (r"language|typo|spelling|hinglish", "language_noise"),
    (r"positive", "positive_observation"),
    (r"multi_rule|multiple", "multi_rule_or_event"),
    (r"process_safety|no_exposure|lone_working|simops|well_control|dropped_object|drowning|deliberate_bypass|blind_spot|communication|competency|life_altering|recurrence|near_miss|no_injury_but_sif", "domain_scenario"),
]
AWAY = ("hypothetical", "historical", "training_example")
RELEASED = r"\b(gir|gira|fell|fall|slipped|released|leak|spill|hit|struck|toota|phat|burst|nikla|contact)\b"
LEVELS = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6}

# Terms of the oil and gas domain, cues of abstracts, and degrees and places of mine accidents.
STRONG_TERMS = [
    r"oil ?wells?", r"gas wells?", r"drilling rigs?", r"drill rigs?", r"derricks?", r"oil ?fields?", r"well ?heads?", r"workover", r"well servic\w*",
    r"frac(?:k|turing|king|ing)?\b", r"rig floor", r"drill pipe", r"drillers?\b", r"roughnecks?", r"floor ?hands?", r"pump ?jacks?", r"pumping units?",
    r"refiner(?:y|ies)", r"crude oil", r"oil (?:and|&) gas", r"tank batter(?:y|ies)", r"blowouts?", r"mud pumps?", r"well ?sites?", r"salt ?water disposal",
    r"tool ?pushers?", r"flowback", r"natural gas (?:wells?|plants?|compressors?|pipelines?)", r"gas (?:gathering|compressor) stations?", r"petroleum",
    r"drilling crews?", r"cementing (?:unit|crew|truck)", r"coil(?:ed)? tubing", r"wireline", r"christmas tree", r"x-?mas tree", r"separator vessel",
    r"oil (?:tank|pipeline|lease)", r"gas (?:pipeline|lease)",
]
WEAK_TERMS = [r"pipelines?", r"casing", r"tubing", r"catwalk", r"kelly", r"swab", r"pipe rack", r"h2s", r"hydrogen sulfide"]
STRONG, WEAK = (r"\b(?:" + "|".join(t) + r")\b" for t in (STRONG_TERMS, WEAK_TERMS))
DIED = r"\b(was killed|were killed|died|death|fatal(?:ly|ity)?|pronounced dead|succumbed|deceased)\b"
HOSPITAL, AMPUTATED = r"\b(hospitali[sz]ed|hospital)\b", r"\bamputat"
DEGREES = {"00": "no_injury_event", "01": "fatal", "02": "permanent_impairment"}
MINE_ONLY = r"fall of (?:roof|rib|face|back|highwall)|ignition or explosion of gas or dust|inundation|entrapment|disorders? \(physical agents\)"
UNDERGROUND, SURFACE = r"underground|face|entry|crosscut|longwall|shaft|slope", r"no value|surface|n/a|nan"
MIN_CHARS, TRAIN_WORDS = 15, 12


def _key(raw: Column) -> Column:
    return F.lower(F.trim(F.coalesce(raw, F.lit(""))))


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def barrier(raw: Column) -> Column:
    """Barrier class of a free text; null for none, 'other' where no rule fits."""
    return F.when(~_key(raw).isin("none", "", "n/a", "null"), first_rule(_key(raw), BARRIERS, "other"))


def trap_family(raw: Column) -> Column:
    """Family of a trap type; 'none' for none, 'other' where no rule fits."""
    return F.when(_key(raw).isin("", "none", "nan"), "none").otherwise(first_rule(_key(raw), TRAPS, "other"))


def verdict_candidates(sif: Column, statement: Column, energies: Column, status: Column, text: Column) -> Column:
    """Verdicts that the coarse labels allow, the likeliest first."""
    of = lambda *names: F.array(*map(F.lit, names))
    none, held = F.size(energies) == 0, F.coalesce(status == "present_effective", F.lit(False))
    released = F.coalesce(text, F.lit("")).rlike("(?iU)" + RELEASED)
    return (
        F.when(statement.isin(*AWAY), of("NON_EVENT"))
        .when((sif == "UNCERTAIN") & none, of("INSUFFICIENT"))
        .when(sif == "UNCERTAIN", of("INSUFFICIENT", "EXPOSURE"))
        .when((sif == "NO") & none, of("LOW_ENERGY", "NON_EVENT"))
        .when((sif == "NO") & held, of("SUCCESS", "CAPACITY"))
        .when(sif == "NO", of("LOW_ENERGY", "SUCCESS", "NON_EVENT"))
        .when(held & released, of("CAPACITY"))
        .when(held, of("SUCCESS", "EXPOSURE"))
        .when(released, of("P_SIF", "EXPOSURE"))
        .otherwise(of("EXPOSURE", "P_SIF"))
    )


def gold_labels(df: DataFrame, compose: bool = True) -> DataFrame:
    """Labelled reports on the common vocabulary, with what needs a review.

    Reads report_text, statement_type, energy_source, barrier, barrier_status, sif_potential, trap_type, lsr, exposure and
    confidence, all strings, null as empty; other columns stay. ``compose`` is that of ``normalize_unicode``.
    """
    raw = lambda name: F.coalesce(F.col(name), F.lit(""))
    text, sif, rules = raw("report_text"), F.upper(F.trim(raw("sif_potential"))), F.when(F.upper(F.trim(raw("lsr"))) != "NONE", raw("lsr"))
    known = _mapped(STATEMENTS, _key(F.col("statement_type")))
    table = F.create_map(*(x for name, own in ENERGIES.items() for x in (F.lit(name), F.array(*map(F.lit, own)).cast("array<string>"))))
    energy = F.try_element_at(table, _key(F.col("energy_source")))
    state = _key(F.col("barrier_status"))
    status = F.when(state != "not_applicable", F.coalesce(_mapped(STATES, state), F.lit("unknown")))
    out = df.select(
        "*",
        F.coalesce(known, F.lit("observed")).alias("statement"),
        F.coalesce(energy, F.array().cast("array<string>")).alias("energies"),
        F.coalesce(canonical_rules(rules), F.array().cast("array<string>")).alias("rules"),
        F.coalesce(unmapped_rules(rules), F.array().cast("array<string>")).alias("unmapped"),
        barrier(F.col("barrier")).alias("barrier_class"),
        trap_family(F.col("trap_type")).alias("trap_family"),
        F.when(text.rlike("[ऀ-ॿ]"), "devanagari").when(text.rlike("[ঀ-৿]"), "bengali_assamese").otherwise("latin").alias("script"),
    )
    pseudo = F.coalesce((F.col("barrier_class") == "ppe") & status.isin("present_effective", "present_ineffective", "absent"), F.lit(False))
    out = out.withColumn("status", F.when(pseudo, "pseudo").otherwise(status))
    yes = sif == "YES"
    flags = F.array(
        F.when(collapse_ws(normalize_unicode(text, compose)) != text, "text_changed_by_normaliser"),
        F.when(known.isNull(), F.concat(F.lit("unknown_statement_type:"), _key(F.col("statement_type")))),
        F.when(F.size("unmapped") > 0, F.concat(F.lit("lsr_unmapped:"), F.array_join("unmapped", "|"))),
        F.when(energy.isNull(), F.concat(F.lit("unknown_energy:"), raw("energy_source"))),
        F.when(yes & (F.size("energies") == 0), "sif_yes_but_energy_none"),
        F.when(F.lower(raw("trap_type")).contains("multi") & (F.size("rules") < 2), "multi_rule_but_single_lsr"),
        F.when(word_count(text) <= 3, "very_short_text"),
        F.when(yes & (F.size("rules") == 0), "sif_yes_no_lsr"),
        F.when(yes & F.col("statement").isin(*AWAY), "non_event_statement_but_sif_yes"),
        F.when(yes & (_key(F.col("exposure")) == "absent"), "exposure_absent_but_sif_yes"),
        F.when(raw("confidence").try_cast("double").isNull(), "confidence_not_numeric"),
    )
    candidates = verdict_candidates(sif, F.col("statement"), F.col("energies"), F.col("status"), text)
    return out.withColumn("verdicts", candidates).withColumn("flags", F.array_compact(flags)).drop("unmapped")


def level(roman: Column) -> Column:
    """1 to 6 of a Roman numeral, else null."""
    return _mapped({k: str(v) for k, v in LEVELS.items()}, F.upper(F.trim(roman))).cast("int")


def accident_levels(actual: Column, potential: Column) -> Column:
    """struct<actual,potential,difference,verdict_group> of two Roman levels."""
    a, p = level(actual), level(potential)
    group = F.when(p >= 4, "SIF_POTENTIAL").when(p <= 2, "LOW_ENERGY").otherwise("BORDERLINE")
    return F.struct(a.alias("actual"), p.alias("potential"), (p - a).alias("difference"), group.alias("verdict_group"))


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first, others small."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), 0), lambda x: F.initcap(x)), "")


def register_day(raw: Column) -> Column:
    """The day of a register's date, by the first form that fits; a time behind it is dropped."""
    day = F.get(F.split(F.trim(raw), " "), F.lit(0))
    tried = lambda form: F.try_to_timestamp(day, F.lit(form)).cast("date")
    four = day.rlike(r"/\d{4}$")
    short = tried("M/d/yy")
    return F.coalesce(F.when(four, tried("M/d/yyyy")), tried("yyyy-M-d"), F.when(four, tried("d/M/yyyy")), F.when(day.rlike(r"/\d\d$"), F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)))


def severe_injuries(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A severe-injury register on the common columns; ``columns`` names its own.

    Expects osha_id, event_date, employer, city, state, naics, hospitalized, amputation, loss_of_eye and narrative; one
    that is missing is an error. Narratives under 15 characters are dropped, as are null ones.
    """
    needed = ["osha_id", "event_date", "employer", "city", "state", "naics", "hospitalized", "amputation", "loss_of_eye", "narrative"]
    missing = [n for n in needed if columns.get(n) not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    own = lambda name: F.col(f"`{columns[name]}`").cast("string")
    tidy = lambda name: F.nullif(collapse_ws(normalize_unicode(own(name))), F.lit(""))
    code = F.nullif(F.regexp_replace(F.trim(own("naics")), r"\.0$", ""), F.lit(""))
    flag = {name: tolerant_int(own(name)) for name in ("hospitalized", "amputation", "loss_of_eye")}
    set_ = lambda name: F.coalesce(flag[name] != 0, F.lit(False))
    hint = F.when(set_("amputation"), "amputation").when(set_("loss_of_eye"), "loss_of_eye").when(set_("hospitalized"), "hospitalized").otherwise("reported_severe")
    rows = df.select(
        own("osha_id").alias("osha_id"),
        register_day(own("event_date")).alias("event_date"),
        tidy("employer").alias("employer"),
        title_case(tidy("city")).alias("city"),
        title_case(tidy("state")).alias("state"),
        code.alias("naics"),
        sector(code).alias("naics_sector"),
        F.coalesce(sector(code).isNotNull(), F.lit(False)).alias("is_oilgas"),
        *(c.alias(name) for name, c in flag.items()),
        hint.alias("severity_hint"),
        tidy("narrative").alias("narrative"),
    ).where(F.length("narrative") >= MIN_CHARS)
    return rows.withColumn("event_year", F.year("event_date")).withColumn("narrative_words", word_count(F.col("narrative")))


def domain_terms(text: Column) -> Column:
    """struct<strong,weak> of the distinct domain terms in a text, in lower case and sorted."""
    own = lambda p: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + p), 0), F.lower)))
    return F.struct(own(STRONG).alias("strong"), own(WEAK).alias("weak"))


def domain_score(terms: Column) -> Column:
    return 2 * F.size(terms["strong"]) + F.size(terms["weak"])


def abstract_facts(summary: Column, title: Column, keywords: Column) -> Column:
    """struct<record_type,hospitalized,amputation,event_year,keywords,is_oilgas,oilgas_score> of an accident abstract."""
    words = F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), r"\s{2,}|,|;"), lambda k: F.lower(F.trim(k))), lambda k: (k != "") & (k != "nan"))
    terms = domain_terms(F.concat_ws(" ", title, summary, F.array_join(words, " ")))
    has = lambda p: summary.rlike("(?iU)" + p)
    first = F.nullif(F.regexp_extract(summary, r"\b((?:19|20)\d\d)\b", 1), F.lit(""))
    return F.struct(
        F.when(has(DIED), "fatal").otherwise("severe_injury").alias("record_type"), has(HOSPITAL).alias("hospitalized"), has(AMPUTATED).alias("amputation"), year_in(first).alias("event_year"),
        words.alias("keywords"), (F.size(terms["strong"]) > 0).alias("is_oilgas"), domain_score(terms).alias("oilgas_score"),
    )


def mine_accidents(df: DataFrame) -> DataFrame:
    """Mine accidents that have a like outside of mines: degrees 0 to 2, no mine-only class, not underground.

    Reads degree, classification, location and narrative; other columns stay. The narrative loses its capitals; those
    under 15 characters are dropped.
    """
    code = F.lpad(F.regexp_replace(F.trim("degree"), r"\.0$", ""), 2, "0")
    has = lambda name, p: F.coalesce(F.col(name).rlike("(?i)" + p), F.lit(False))
    kept = df.where(code.isin(*DEGREES) & ~has("classification", MINE_ONLY) & ~(has("location", UNDERGROUND) & ~has("location", SURFACE)))
    narrative = collapse_ws(normalize_unicode(sentence_case(F.col("narrative"))))
    terms = domain_terms(F.col("narrative"))
    rows = kept.withColumn("degree", code).withColumn("narrative", narrative).where(F.length("narrative") >= MIN_CHARS)
    return rows.withColumn("record_type", _mapped(DEGREES, F.col("degree"))).withColumn("oilgas_score", domain_score(terms)).withColumn("narrative_words", word_count(F.col("narrative")))


def train_candidates(rows: DataFrame, key: str, no_injury: int = 1000, injury: int = 300) -> DataFrame:
    """``rows`` of ``mine_accidents``, with year and is_duplicate, and a column split_hint.

    Of the rows without injury and of the others the given numbers are candidates: no duplicates, twelve words or more, by
    domain score, then year, then a hash of ``key``. Each choice is a top-k, so no task sorts a whole class.
    """
    fit = rows.where(~F.coalesce("is_duplicate", F.lit(False)) & (F.col("narrative_words") >= TRAIN_WORDS))
    order = [F.desc("oilgas_score"), F.desc(F.coalesce("year", F.lit(0))), F.md5(F.col(key).cast("string")), key]
    calm = F.col("record_type") == "no_injury_event"
    chosen = fit.where(calm).orderBy(*order).limit(no_injury).select(key).unionByName(fit.where(~calm).orderBy(*order).limit(injury).select(key))
    marked = rows.join(chosen.select(key, F.lit("train_candidate").alias("split_hint")), key, "left")
    return marked.withColumn("split_hint", F.coalesce("split_hint", F.lit("eval_pool")))
