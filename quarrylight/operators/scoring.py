"""Report text to verdict, rules only: spans with offsets, energy, harm, four questions, decision tree, review routing.

``score`` adds the columns of the response to a DataFrame; it is one projection chain of built-in functions, so it runs
where the text is read; only spelling, where it is asked for, passes texts through a Python worker. Optional model layers would add spans before the questions; without them nothing is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import rules as R
from quarrylight.functions.spans import around, beginnings, first_match, first_of, hit, matches, may_match, overlaps, quick
from quarrylight.operators.gates import OUT, decision, hard_evidence, routine
from quarrylight.operators.spelling import led_back, normalised

FAST_LANE, REVIEW_BELOW = 0.75, 0.55
# Words of the language test.
HINGLISH = "nahi|nahin|tha|thi|the|hai|hain|kiya|raha|rahi|rahe|gaya|gayi|mein|aur|bina|koi|kaam|hua|hui|liye|lekin|phir|upar|neeche|niche|andar|bahar|pehle|baad|sirf|bhi|gira|toota|chal|band|khula|dekha|mila|karke|wajah|dauran|jagah|paas|log|admi|se|par|pe"
ASSAMESE = "nasil|nohol|hoise|ase|asil|cholise|bhitorot|gol|dhukise|korile|nohoi"
STOP_WORDS, ASSAMESE_WORDS = rf"\b({HINGLISH})\b", rf"\b({ASSAMESE})\b"
#: Harms and body parts stand between what are no letters or vowel signs, Latin or Devanagari.
HARM_WORDS, PART_WORDS = (r"(?<![\w\u0900-\u097F])(?:" + "|".join(table.values()) + r")(?![\w\u0900-\u097F])" for table in (R.HARMS, R.BODY_PARTS))
SPAN = "array<struct<role:string,text:string,start:int,end:int,source:string,score:double>>"
PRESENT = ("control_present", "control_ineffective")


def as_spans(found: Column, role: str, source: str, score: float = 1.0) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(role).alias("role"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(source).alias("source"), F.lit(score).alias("score")))


#: Patterns that every whole text is searched for; its ``beginnings`` tell which of them it may hold.
SOUGHT = [*R.SPAN_PATTERNS.values(), *R.STATEMENT_TYPES.values(), *(cues for cues, *_ in R.HAZARDS.values()), *(p for p, _ in R.ACTS + R.CONDITIONS), R.ACTOR, R.PASSIVE, R.SERIOUS, R.NO_INJURY, R.LOW_ENERGY, R.MINIMISER, STOP_WORDS, ASSAMESE_WORDS, HARM_WORDS, PART_WORDS]


def rule_spans(text: Column, begun: Column | None = None) -> Column:
    """Every hit of the hand-written patterns."""
    return F.concat(*(as_spans(matches(text, p, begun), role, "rules") for role, p in R.SPAN_PATTERNS.items()))


def unclaimed(found: Column, spans: Column, ignore: tuple[str, ...] = ()) -> Column:
    """Of ``found``, the matches whose start no span (but those of ignored roles) covers, nor any span equals."""

    def free(m: Column) -> Column:
        covered = F.exists(spans, lambda s: (s["start"] <= m["start"]) & (m["start"] < s["end"]) & ~s["role"].isin(*(ignore or ("",))))
        return ~covered & ~F.exists(spans, lambda s: (s["start"] == m["start"]) & (s["end"] == m["end"]))

    return F.filter(found, free)


def with_lexicon(text: Column, spans: Column, lexicon: dict[str, list[str]]) -> Column:
    """``spans`` with the hits of a mined lexicon, longest terms first, where no earlier span claims the text."""
    for role, terms in lexicon.items():
        pattern = r"\b(?:" + "|".join(sorted(terms, key=len, reverse=True)) + r")\b"
        spans = F.concat(spans, as_spans(unclaimed(matches(text, pattern), spans), role, "rules:mined", 0.9))
    return spans


def language(text: Column, begun: Column | None = None) -> Column:
    """Script and stop-word tests."""
    assamese = rf"[ঀ-৿]|\b({ASSAMESE})\b"
    # Bound to a lambda's variable, the words are sought once for both tests.
    hits = F.array(F.regexp_extract_all(text, F.lit(quick(STOP_WORDS)), 0))
    mixed = may_match(begun, STOP_WORDS) & F.exists(hits, lambda own: (F.size(own) >= 2) & F.exists(own, lambda h: F.lower(h) != "the"))
    some = text.rlike("[ঀ-৿]") | may_match(begun, ASSAMESE_WORDS)
    return F.when(text.rlike("[ऀ-ॿ]"), "hindi").when(some & (F.size(F.regexp_extract_all(text, F.lit("(?iU)" + assamese), 0)) >= 2), "assamese_mix").when(mixed, "hinglish").otherwise("english")


def statement_type(text: Column, begun: Column | None = None) -> Column:
    return reduce(lambda e, x: e.when(hit(text, x[1], begun), x[0]), R.STATEMENT_TYPES.items(), F.when(F.lit(False), "")).otherwise("condition_only")


def hazard(text: Column, cues: list[Column] | None = None) -> Column:
    """Struct of the hazard with the most cues, the earliest of equals; null without a cue.

    ``cues`` are the matches of each hazard's pattern, where they have been sought already.
    """
    options = []
    for k, (name, (pattern, energy, barrier, consequence, cluster, lsr)) in enumerate(R.HAZARDS.items()):
        found = cues[k] if cues else matches(text, pattern)
        options.append(F.when(F.size(found) > 0, F.struct(F.size(found).alias("n"), (-F.get(found, F.lit(0))["start"]).alias("at"), F.lit(-k).alias("order"), F.struct(F.lit(name).alias("name"), F.lit(energy).alias("energy"), F.lit(barrier).alias("barrier"), F.lit(consequence).alias("consequence"), F.lit(cluster).alias("cluster"), F.array(*map(F.lit, lsr)).alias("lsr")).alias("hazard"))))
    return F.array_max(F.array_compact(F.array(*options)))["hazard"]


def negation_scope(text: Column, spans: Column) -> Column:
    """What the negations stand near: sorted scopes joined by '+', null without a negation."""
    windows = F.transform(F.filter(spans, lambda s: s["role"] == "negation_cue"), lambda s: around(text, s["start"], s["end"], 40))

    def near(pattern: str) -> Column:
        return F.exists(windows, lambda w: w.rlike("(?iU)" + pattern))

    scopes = F.array_compact(F.array(F.when(near(R.CONTROL_WORDS), "control"), F.when(near(R.OUTCOME_WORDS), "outcome_only"), F.when(near(R.RELEASE_WORDS), "release")))
    return F.when(F.size(windows) > 0, F.when(F.size(scopes) > 0, F.array_join(scopes, "+")).otherwise("unclear"))


def stated(text: Column, units: str) -> tuple[Column, Column]:
    """(number, unit) of the first quantity in ``units``; null without one."""
    pattern = rf"(?iU)(\d+(?:[.,]\d+)?)\s?({units})"
    number = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    return number, F.lower(F.regexp_extract(text, pattern, 2))


def fallback(text: Column, table: list[tuple[str, float]]) -> Column:
    return reduce(lambda e, x: e.when(hit(text, x[0]), x[1]), table, F.when(F.lit(False), 0.0))


def kills(mass: Column, height: Column) -> Column:
    """Whether a dropped object of this mass kills from this height."""
    return reduce(lambda e, b: e.when(mass >= b[0], height >= b[1]), R.FATAL_BANDS, F.when(F.lit(False), False)).otherwise(height >= R.LIGHT_FATAL_HEIGHT)


def energy_gate(text: Column, kind: Column) -> Column:
    """Struct of gate, joules and basis: stated numbers first, then defaults for falling masses."""
    volts, v_unit = stated(text, r"kv|volt|v\b")
    bar, p_unit = stated(text, r"bar|psi|kg/cm2|kpa|mpa")
    celsius = F.replace(F.regexp_extract(text, r"(?iU)(\d+(?:[.,]\d+)?)\s?(deg|°)?\s?c\b", 1), F.lit(","), F.lit(".")).try_cast("double")
    mass, m_unit = stated(text, r"kg|kilo|kgs|ton|tonne|t\b")
    height, h_unit = stated(text, r"m\b|meter|metre|mtr|ft\b|feet|foot")
    kg = F.coalesce(F.when(m_unit.startswith("t"), mass * 1000).otherwise(mass), fallback(text, R.DEFAULT_MASS))
    metres = F.coalesce(F.when(h_unit.startswith("f"), height * 0.3048).otherwise(height), fallback(text, R.DEFAULT_HEIGHT))
    bars = F.when(p_unit == "psi", bar / 14.5038).when(p_unit == "kpa", bar / 100).when(p_unit == "mpa", bar * 10).otherwise(bar)

    def judged(w: Column) -> Column:
        joules = w["kg"] * R.GRAVITY * w["m"]
        over = (
            F.when(kind == "electrical", F.when(v_unit == "kv", volts * 1000).otherwise(volts) >= R.VOLTS)
            .when(kind == "pressure", bars >= R.BAR)
            .when(kind == "thermal", celsius >= R.CELSIUS)
            .when(kind == "gravity", (joules >= R.JOULES) | kills(w["kg"], w["m"]))
        )
        basis = F.when(kind == "gravity", F.when(joules.isNull(), "insufficient").when(w["stated"], "stated").otherwise("inferred"))
        own = F.array(over)
        return F.get(F.transform(own, lambda o: F.struct(F.when(o, "EXCEEDS").when(~o, "BELOW").otherwise("UNKNOWN").alias("gate"), F.when(kind == "gravity", F.bround(joules)).alias("estimate_j"), F.coalesce(basis, F.when(o.isNotNull(), "stated")).alias("basis"))), F.lit(0))

    # Bound to a lambda's variable, mass and height are sought once for all bands, and not at all for other kinds of energy.
    weighed = F.array(F.when(kind == "gravity", F.struct(kg.alias("kg"), metres.alias("m"), (mass.isNotNull() & height.isNotNull()).alias("stated"))))
    return F.get(F.transform(weighed, judged), F.lit(0))


def person_fall_exceeds(text: Column) -> Column:
    """Whether a stated height is one from which a person's fall is high energy; null without a height."""
    height, unit = stated(text, r"m\b|meter|metre|mtr|ft\b|feet|foot")
    return F.when(unit.startswith("f"), height * 0.3048).otherwise(height) >= R.PERSON_FALL


def _named(found: Column, table: dict[str, str]) -> Column:
    """The first entry of the table that is the whole of what was found."""
    return reduce(lambda e, x: e.when(found.rlike(f"(?iU)^(?:{x[1]})$"), x[0]), table.items(), F.when(F.lit(False), ""))


def harms(text: Column, kind: Column, begun: Column | None = None) -> Column:
    """Harms with the nearest body part within 60 characters, severity and offsets; negated ones are left out.

    All classes are one alternation, so each place holds one harm, of the first class that fits. Boundaries are those of
    Latin and Devanagari letters and vowel signs alike.
    """
    parts = F.transform(matches(text, PART_WORDS, begun), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _named(m["text"], R.BODY_PARTS).alias("part")))

    def real(m: Column) -> Column:
        first = F.greatest(m["start"] - 24, F.lit(0))
        return ~text.substr(first + 1, m["start"] - first).rlike("(?iU)" + R.HARM_NEGATED_BEFORE) & ~text.substr(m["end"] + 1, F.lit(16)).rlike("(?iU)" + R.HARM_NEGATED_AFTER)

    def placed(m: Column, parts: Column) -> Column:
        near = F.filter(parts, lambda p: (p["start"] >= m["start"] - 60) & (p["end"] <= m["end"] + 60))
        part = F.array_min(F.transform(near, lambda p: F.struct(F.abs(p["start"] - m["start"]).alias("d"), p["part"].alias("part"))))["part"]
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), _named(m["text"], R.HARMS).alias("harm"), part.alias("part"))

    def rated(m: Column) -> Column:
        harm, part = m["harm"], m["part"]
        base = reduce(lambda e, x: e.when(harm == x[0], x[1]), R.HARM_LEVELS.items(), F.when(F.lit(False), 0)).otherwise(1)
        level = F.when(harm == "break", F.when(part.isNotNull(), 3).otherwise(0)).when((harm == "fracture") & (part == "finger"), 2).when(harm.isin("chemical_irritation", "poisoning") & ~F.coalesce(kind == "chemical", F.lit(False)), 1).otherwise(base)
        level = F.when(harm.isin("cut", "crush") & (part == "finger"), 2).when((level == 2) & part.isin(*R.CRITICAL_PARTS), 3).otherwise(level)
        level = level - (~harm.isin("fatal", "amputation") & around(text, m["start"], m["end"], 60).rlike("(?iU)" + R.HARM_MINIMISED)).cast("int")
        return F.struct(F.greatest(level, F.lit(0)).alias("level"), base.alias("base"), (-m["start"]).alias("order"), harm.alias("harm"), part.alias("part"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"))

    # Bound to a lambda's variable, the parts are sought once for all harms, and not at all without one.
    own = F.array(F.filter(matches(text, HARM_WORDS, begun), real))
    near_parts = lambda hs: F.transform(F.array(parts), lambda ps: F.transform(hs, lambda m: placed(m, ps)))
    with_parts = F.get(F.transform(own, lambda hs: F.when(F.size(hs) > 0, F.get(near_parts(hs), F.lit(0)))), F.lit(0))
    found = F.when(text.isNotNull(), F.coalesce(F.transform(with_parts, rated), F.array().cast("array<struct<level:int,base:int,order:int,harm:string,part:string,text:string,start:int,end:int>>")))
    return F.filter(found, lambda h: (h["harm"] != "break") | (h["level"] > 1))


def fused_spans(spans: Column, model: Column, floor: float = 0.6) -> Column:
    """Rule spans and a model's: those of one role that overlap are one, model spans of ``floor`` or more that meet none are added."""
    sure = F.filter(model, lambda g: g["score"] >= floor)
    meets = lambda a, b: (a["role"] == b["role"]) & overlaps(a, b)
    first = lambda s: F.get(F.filter(sure, lambda g: meets(g, s)), F.lit(0))

    def own(s: Column) -> Column:
        base = F.when(s["source"] == "rules:mined", 0.9).otherwise(1.0)
        met = first(s)
        return F.struct(s["role"].alias("role"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.when(met.isNotNull(), "rules+gliner").otherwise(s["source"]).alias("source"), F.greatest(base, met["score"]).alias("score"))

    kept = F.transform(spans, own)
    added = F.filter(sure, lambda g: ~F.exists(spans, lambda s: meets(g, s)))
    return F.concat(kept, F.transform(added, lambda g: F.struct(*(g[c].alias(c) for c in ("role", "text", "start", "end", "source", "score"))))).cast(SPAN)


def fact(value: Column, span: Column, source: Column | str) -> Column:
    """One answered question: value (null: unknown), the span that answers it, and where the answer comes from."""
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(value.cast("boolean").alias("value"), span["text"].alias("span"), span["start"].alias("span_start"), span["end"].alias("span_end"), source.alias("source"))


def effective(text: Column, spans: Column) -> Column:
    """Whether no word of degradation or removal stands within 60 characters of the control or of a degraded one."""
    def sound(s: Column) -> Column:
        window = around(text, s["start"], s["end"], 60)
        return ~window.rlike("(?iU)" + R.DEGRADED) & ~window.rlike("(?iU)" + R.BEING_REMOVED)

    control = first_of(spans, PRESENT)
    checked = F.filter(spans, lambda s: (s["role"] == "control_ineffective") | F.coalesce((s["start"] == control["start"]) & (s["end"] == control["end"]) & (s["role"] == control["role"]), F.lit(False)))
    return F.forall(checked, sound)


def tree(high: Column, released: Column, injured: Column, control: Column, statement: Column, sound: Column) -> Column:
    """Verdict of the decision tree; null where it abstains (N15). Null answers mean unknown."""
    held = F.when(control & sound, "SUCCESS").when(control, "EXPOSURE").when(~control, "EXPOSURE").otherwise("INSUFFICIENT")
    after = F.when(injured, "H_SIF").when(injured.isNull(), "INSUFFICIENT").when(control, "CAPACITY").when(~control, "P_SIF").otherwise("INSUFFICIENT")
    return (
        F.when(statement.isin("hypothetical", "historical", "training_example"), "NON_EVENT")
        .when(high.isNull(), "INSUFFICIENT")
        .when(~high, F.when(injured, "L_SIF").otherwise("LOW_ENERGY"))
        .when(released.isNull(), "INSUFFICIENT")
        .when(released, after)
        .when(statement == "corrective_completed", F.lit(None).cast("string"))
        .otherwise(held)
    )


def decision_path(high: Column, released: Column, injured: Column, control: Column, statement: Column, sound: Column, verdict: Column) -> Column:
    """The answers that the tree took to its verdict, in words."""
    said = lambda c: F.when(c.isNull(), "unknown").when(c, "True").otherwise("False")
    step = lambda name, c: F.concat(F.lit(f"{name}="), said(c))
    away = statement.isin("hypothetical", "historical", "training_example")
    free = F.coalesce(released, F.lit(False))
    steps = F.array_compact(
        F.array(
            step("high_energy", high),
            F.when(high, step("energy_released", released)),
            F.when((high & free) | (~high & F.coalesce(injured, F.lit(False))), step("serious_injury", injured)),
            F.when(high & ~released & (statement == "corrective_completed"), F.lit("statement_type=corrective_completed")),
            F.when(high & ((released & ~injured) | (~released & (statement != "corrective_completed"))), step("control_present", control)),
            F.when(high & ~released & (statement != "corrective_completed") & control & ~sound, F.lit("barrier_degraded=True")),
        )
    )
    path = F.when(away, F.concat(F.lit("statement_type="), statement)).otherwise(F.array_join(steps, " AND "))
    return F.concat(path, F.lit(" -> "), F.coalesce(verdict, F.lit("undecided")))


def cues(text: Column, table: list[tuple[str, str]], begun: Column | None = None) -> Column:
    """array<struct<cue,text,start,end>>: the first match of each pattern, one a tag, in the order of the table."""
    def tagged(pattern: str, tag: str) -> Column:
        return F.get(F.transform(F.array(first_match(text, pattern, begun)), lambda m: F.when(m.isNotNull(), cue(tag, m))), F.lit(0))

    found = F.array_compact(F.array(*(tagged(p, tag) for p, tag in table)))
    earlier = lambda c, k: F.exists(F.slice(found, F.lit(1), k), lambda o: o["cue"] == c["cue"])
    return F.filter(found, lambda c, k: ~earlier(c, k))


def cue(tag: str, found: Column) -> Column:
    return F.struct(F.lit(tag).alias("cue"), found["text"].alias("text"), found["start"].alias("start"), found["end"].alias("end"))


def primary_flag(act: Column, condition: Column, acts: Column, conditions: Column) -> Column:
    """UA or UC of two flags: the one with more cues, UC among equals."""
    return F.when(act & condition, F.when(acts > conditions, "UA").otherwise("UC")).when(act, "UA").when(condition, "UC")


#: Columns that ``score`` may be told of for its gates; those that are not named are null.
GATE_COLUMNS = {"p": "double", "prefilter": "string", "head": "string", "head_confidence": "double", "event_type": "string", "event_p": "double", "p_routine": "double", "p_safety": "double"}
#: Score from which a model's energy span bears out what a text is about (N22), and from which it counts by itself.
WEAK_SPAN, SURE_SPAN = 0.50, 0.60
FACTS = ("high_energy_present", "energy_released", "serious_injury", "direct_control_present")


def hazard_of(name: Column) -> Column:
    """The entry of a hazard by its name, shaped as ``hazard`` gives it; null for an unknown name."""
    options = {n: F.struct(F.lit(n).alias("name"), F.lit(energy).alias("energy"), F.lit(barrier).alias("barrier"), F.lit(consequence).alias("consequence"), F.lit(cluster).alias("cluster"), F.array(*map(F.lit, lsr)).alias("lsr")) for n, (_, energy, barrier, consequence, cluster, lsr) in R.HAZARDS.items()}
    return reduce(lambda e, x: e.when(name == x[0], x[1]), options.items(), F.when(F.lit(False), next(iter(options.values()))))


def score(
    df: DataFrame, text: str = "text", lexicon: dict[str, list[str]] | None = None, max_chars: int | None = None, model_spans: str | None = None, fuse: bool = True,
    spelling: bool = False, semantic: str | None = None, gates: dict[str, str] | None = None,
) -> DataFrame:
    """``df`` with language, statement_type, hazard, spans, energy, facts, verdict, confidence, review and act/condition columns.

    A null or blank text gets the verdict INSUFFICIENT with no spans. Texts are read whole, unless ``max_chars`` cuts
    them (the scorer of the reference takes 8000). Offsets are those of ``scored_text``, the text without the spaces
    around it. ``model_spans`` names a column of spans from a model: they are fused with the rules' own or, without
    ``fuse``, added as they are. Input columns of the same names as the added ones are replaced.

    The whole rule stack is a matter of three options (X01). ``spelling``: every layer reads the corrected text, and the
    spans, facts, harms and cues that come back have the words and offsets of the text as it was typed; ``changes`` lists
    what was corrected (N05, N06). ``semantic`` names a column struct<hazard,score> of the hazard that the text is about;
    it counts only where a model's energy span bears it out (N22). ``gates`` maps names of GATE_COLUMNS to columns (it may
    be empty): routine texts become NON_EVENT, those out of scope OUT_OF_SCOPE, all with the full row, nothing asked
    and nothing to review; ``gate`` tells the stage and what spoke for the others (N19 to N21, N25). Routine and scope
    leave before anything else is sought in the text.
    """
    out = df.withColumn("__whole", F.trim(F.coalesce(F.col(text), F.lit(""))))
    if max_chars is not None:
        out = out.withColumn("__whole", F.substring("__whole", 1, max_chars))
    out = out.withColumn("scored_text", F.col("__whole"))
    out = normalised(out, "__whole", ("__text", "changes")) if spelling else out.withColumn("__text", F.col("__whole"))
    model = F.coalesce(F.col(model_spans).cast(SPAN), F.array().cast(SPAN)) if model_spans else F.array().cast(SPAN)
    out = out.withColumn("__model", model)
    t, begun = F.col("__text"), F.col("__begun")
    out = out.withColumn("__begun", beginnings(t, SOUGHT)).withColumn("language", language(t, begun)).withColumn("statement_type", statement_type(t, begun)).withColumn("__rules", rule_spans(t, begun))
    spans = with_lexicon(t, F.col("__rules"), lexicon or {})
    # The cues of hazards are sought once, for the spans that they add and for the hazard that they name.
    cued = [f"__cues{k}" for k in range(len(R.HAZARDS))]
    out = out.withColumns({c: matches(t, words, begun) for c, (words, *_) in zip(cued, R.HAZARDS.values(), strict=True)})
    for c in cued:
        out = out.withColumn("__rules", spans)
        spans = F.concat(F.col("__rules"), as_spans(unclaimed(F.col(c), F.col("__rules"), ("negation_cue", "energy_cue")), "energy_cue", "rules:hazard_lexicon"))
    out = out.withColumn("__found", spans).withColumn("hazard", hazard(t, [F.col(c) for c in cued]))
    g = {name: (F.col(gates[name]) if gates and name in gates else F.lit(None)).cast(kind) for name, kind in GATE_COLUMNS.items()}
    if gates is not None:
        early = F.when(routine(t, g["event_type"], g["event_p"], g["p_routine"], g["p_safety"]), "routine").when((g["p"] > OUT) & hard_evidence(F.col("__found")).isNull(), "scope")
        # What leaves here has no more text to look at, and no model has run on it.
        out = out.withColumn("__early", early).withColumn("__read", t).withColumn("__text", F.when(F.col("__early").isNull(), t).otherwise("")).withColumn("__model", F.when(F.col("__early").isNull(), F.col("__model")).otherwise(F.array().cast(SPAN)))
        out = out.withColumn("hazard", F.when(F.col("__early").isNull(), F.col("hazard")))
    out = out.withColumn("__spans", F.col("__found"))
    if semantic:
        borne = F.exists("__model", lambda s: (s["role"] == "energy_cue") & (s["score"] >= WEAK_SPAN))
        out = out.withColumn("__meant", F.when(borne & (F.col("__text") != ""), F.struct(F.col(semantic)["hazard"].alias("hazard"), F.col(semantic)["score"].cast("double").alias("score"))))
        out = out.withColumn("__meant", F.when(F.col("__meant.hazard").isNotNull(), F.col("__meant"))).withColumn("hazard", F.coalesce("hazard", hazard_of(F.col("__meant.hazard"))))
        # Two weak signals that agree make an energy span, where neither the rules nor the model are sure of one.
        weak = F.filter("__model", lambda s: (s["role"] == "energy_cue") & (s["score"] >= WEAK_SPAN))
        top = F.array_max(F.transform(weak, lambda s: s["score"]))
        named = F.exists("__spans", lambda s: s["role"] == "energy_cue") | F.exists("__model", lambda s: (s["role"] == "energy_cue") & (s["score"] >= SURE_SPAN))
        raised = F.transform(F.slice(F.filter(weak, lambda s: s["score"] == top), 1, 1), lambda s: s.withField("source", F.lit("gliner+semantic")))
        sure = F.filter("__model", lambda s: s["score"] >= SURE_SPAN) if fuse else F.col("__model")
        out = out.withColumn("__model", F.when(F.col("__meant").isNotNull() & ~named, F.concat(sure, raised)).otherwise(sure))
    out = out.withColumn("energy", energy_gate(t, F.col("hazard.energy"))).withColumn("harms", harms(t, F.col("hazard.energy"), begun))
    # A harm that no outcome span covers is an outcome; an energy source or a person is no control.
    fresh = F.filter("harms", lambda h: ~F.exists("__spans", lambda s: (s["role"] == "outcome_cue") & overlaps(s, h)))
    out = out.withColumn("__spans", F.concat("__spans", as_spans(fresh, "outcome_cue", "rules:harm")))
    if model_spans:
        out = out.withColumn("__spans", fused_spans(F.col("__spans"), F.col("__model"), 0.0 if semantic else SURE_SPAN) if fuse else F.concat(F.col("__spans"), F.col("__model")))
    order = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["end"] < b["end"])), -1).when((a["start"] == b["start"]) & (a["end"] == b["end"]), 0).otherwise(1)
    out = out.withColumn("spans", F.array_sort("__spans", order))
    wrong = lambda s: s["role"].isin(*PRESENT) & (F.exists("spans", lambda e: (e["role"] == "energy_cue") & overlaps(s, e)) | s["text"].rlike("(?iU)" + R.PERSON_ONLY))
    out = out.withColumn("__own", F.filter("spans", lambda s: ~wrong(s)))
    own = F.col("__own")
    for name, roles in (("energy", ("energy_cue",)), ("outcome", ("outcome_cue",)), ("release", ("release_cue",)), ("no_release", ("no_release_cue",)), ("present", PRESENT), ("absent", ("control_absent",)), ("pseudo", ("pseudo_control",)), ("no_exposure", ("no_exposure_cue",))):
        out = out.withColumn(f"__{name}", first_of(own, roles))
    c = lambda name: F.col(f"__{name}")
    nothing = F.lit(None).cast("struct<text:string,start:int,end:int>")
    plain = lambda s: F.when(s.isNotNull(), F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))

    # Was anyone seriously injured?
    worst = F.array_max("harms")
    out = out.withColumn("__worst", worst)
    serious = F.get(matches(t, R.SERIOUS, begun), F.lit(0))
    out = out.withColumn("__serious", serious)
    finger = around(t, c("serious")["start"], c("serious")["end"], 30).rlike("(?iU)" + R.FINGER) & F.lower(c("serious")["text"]).contains("fractur")
    injury = (
        F.when(c("serious").isNotNull() & ~finger, fact(F.lit(True), plain(c("outcome")), "rules"))
        .when(c("worst")["level"] >= 3, fact(F.lit(True), plain(c("worst")), "rules:harm"))
        .when(hit(t, R.NO_INJURY, begun), fact(F.lit(False), plain(c("outcome")), "rules"))
        .when(c("worst").isNotNull(), fact(F.lit(False), plain(c("worst")), "rules:harm"))
        .when(c("outcome").isNotNull(), fact(F.lit(False), plain(c("outcome")), c("outcome")["source"]))
        .otherwise(fact(F.lit(False), nothing, "default_no_injury_stated"))
    )
    out = out.withColumn("serious_injury", injury)

    # Was there high energy?
    low = F.get(matches(t, R.LOW_ENERGY, begun), F.lit(0))
    implied = F.coalesce(plain(c("absent")), plain(c("present")))
    out = out.withColumn("__low", F.when(~(hit(t, R.MINIMISER, begun) & c("absent").isNotNull()), low)).withColumn("__implied", implied)
    meant = F.col("__meant").isNotNull() if semantic else F.lit(False)
    about = F.format_string("semantic(%s@%.2f)", "__meant.hazard", "__meant.score") if semantic else F.lit("none")
    high = (
        F.when(F.col("energy.gate") == "EXCEEDS", fact(F.lit(True), plain(c("energy")), "energy_model"))
        .when(F.col("energy.gate") == "BELOW", fact(F.lit(False), plain(c("energy")), "energy_model"))
        .when(c("low").isNotNull(), fact(F.lit(False), c("low"), "rules:low_energy_marker"))
        .when(c("energy").isNotNull(), fact(F.lit(True), plain(c("energy")), c("energy")["source"]))
        .when(c("implied").isNotNull(), fact(F.lit(True), c("implied"), "derived(barrier implies its energy)"))
        .when(meant, fact(F.lit(True), nothing, about))
        .when(F.col("serious_injury.value"), fact(F.lit(True), F.struct(F.col("serious_injury.span").alias("text"), F.col("serious_injury.span_start").alias("start"), F.col("serious_injury.span_end").alias("end")), "derived(serious injury implies high energy)"))
        .otherwise(fact(F.lit(None), nothing, "none"))
    )
    out = out.withColumn("high_energy_present", high)
    if semantic:
        # A minor harm alone speaks against an energy that only the meaning names.
        slight = F.col("high_energy_present.value") & (c("worst")["level"] == 1) & (F.col("high_energy_present.source").startswith("semantic") | (F.col("high_energy_present.source") == "gliner+semantic"))
        out = out.withColumn("high_energy_present", F.when(slight, fact(F.lit(False), plain(c("worst")), "derived(minor harm, no named energy)")).otherwise(F.col("high_energy_present")))

    # Was it released? Was a direct control in place?
    released = (
        F.when(c("no_release").isNotNull() & c("release").isNull(), fact(F.lit(False), plain(c("no_release")), c("no_release")["source"]))
        .when(c("release").isNotNull() & c("no_release").isNull(), fact(F.lit(True), plain(c("release")), c("release")["source"]))
        .when(c("release").isNotNull(), fact(F.lit(False), plain(c("no_release")), "rules(no_release overrides release)"))
        .when(F.col("serious_injury.value"), fact(F.lit(True), plain(c("outcome")), "derived(serious injury implies release)"))
        .otherwise(fact(F.lit(False), nothing, "default_no_release_stated"))
    )
    control = (
        F.when(c("absent").isNotNull() & c("present").isNull(), fact(F.lit(False), plain(c("absent")), c("absent")["source"]))
        .when(c("present").isNotNull() & c("absent").isNull(), fact(F.lit(True), plain(c("present")), c("present")["source"]))
        .when(c("present").isNotNull(), fact(F.lit(False), plain(c("absent")), "rules(absent overrides present)"))
        .when(c("pseudo").isNotNull(), fact(F.lit(False), plain(c("pseudo")), "pseudo_control_not_a_barrier"))
        .when(F.col("high_energy_present.value"), fact(F.lit(False), nothing, "default_no_control_stated"))
        .otherwise(fact(F.lit(None), nothing, "none"))
    )
    out = out.withColumn("energy_released", released).withColumn("direct_control_present", control).withColumn("control_effective", effective(t, own))

    # Verdict, confidence by kind of evidence, review.
    derived = tree(*(F.col(f"{f}.value") for f in FACTS), F.col("statement_type"), F.col("control_effective"))
    verdict = F.when(c("no_exposure").isNotNull() & ~F.coalesce(F.col("serious_injury.value"), F.lit(False)), "NON_EVENT").otherwise(derived)
    out = out.withColumn("__verdict", verdict)
    path = decision_path(*(F.col(f"{f}.value") for f in FACTS), F.col("statement_type"), F.col("control_effective"), derived)
    out = out.withColumn("decision_path", F.when(c("no_exposure").isNotNull() & ~F.coalesce(F.col("serious_injury.value"), F.lit(False)), "no_exposure -> NON_EVENT").otherwise(path))

    def worth(name: str) -> Column:
        source = F.col(f"{name}.source")
        model_only = ~source.startswith("rules") & (source.contains("gliner") | source.startswith("semantic"))
        return F.when(F.col(f"{name}.value").isNull(), 0.0).when(source.startswith("default") | source.startswith("derived"), 0.06).when(model_only, 0.08).otherwise(0.13)

    confidence = F.lit(0.34) + reduce(Column.__add__, map(worth, FACTS))
    confidence = F.when(c("verdict").isNull(), 0.4).when(~F.col("control_effective"), F.least(confidence, F.lit(0.62))).otherwise(confidence)
    out = out.withColumn("verdict", F.coalesce(c("verdict"), F.lit("INSUFFICIENT"))).withColumn("confidence", F.bround(confidence, 3))
    sif_like = F.col("verdict").isin("H_SIF", "L_SIF", "P_SIF", "EXPOSURE", "CAPACITY")
    out = out.withColumn("route", F.when(F.col("confidence") >= FAST_LANE, "fast_lane").otherwise("slow_lane"))
    out = out.withColumn("review_required", (F.col("verdict") == "INSUFFICIENT") | ((F.col("confidence") < REVIEW_BELOW) & sif_like))
    mode = F.when(F.exists("spans", lambda s: s["role"] == "control_ineffective"), "present_but_degraded").when(F.exists("spans", lambda s: s["role"] == "pseudo_control") & ~F.col("direct_control_present.value"), "pseudo_control_only").when(~F.col("direct_control_present.value"), "not_established").when(F.col("direct_control_present.value"), "effective")
    out = out.withColumn("barrier_failure_mode", mode).withColumn("negation_scope", negation_scope(t, F.col("spans")))

    # Unsafe act, unsafe condition: two flags, and what speaks for them.
    out = out.withColumn("act_cues", cues(t, R.ACTS, begun)).withColumn("__conditions", cues(t, R.CONDITIONS, begun))
    of_role = lambda role: F.get(F.filter("spans", lambda s: s["role"] == role), F.lit(0))
    absent, degraded = of_role("control_absent"), of_role("control_ineffective")
    none = F.size("__conditions") == 0
    named = F.when(none & (F.size("act_cues") == 0) & absent.isNotNull(), F.array(cue("control_absent_span", absent))).when(none & degraded.isNotNull(), F.array(cue("control_degraded_span", degraded))).otherwise(F.col("__conditions"))
    actor = first_match(t, R.ACTOR, begun)["text"]
    out = out.withColumn("condition_cues", named).withColumn("actor", actor).withColumn("passive_victim", hit(t, R.PASSIVE, begun))
    act, condition = F.size("act_cues") > 0, F.size("condition_cues") > 0
    behind = ~act & ~condition & (F.col("actor").isNotNull() | F.col("passive_victim"))
    out = out.withColumn("unsafe_act", act | behind).withColumn("unsafe_condition", condition | (~act & ~condition & ~behind & (F.size("spans") > 0)))
    sure = F.lit(0.35) + F.least(F.lit(0.5), F.lit(0.18) * (F.size("act_cues") + F.size("condition_cues"))) + F.when(F.col("actor").isNotNull(), 0.08).otherwise(0.0)
    out = out.withColumn("flag_confidence", F.bround(F.least(F.lit(0.95), sure), 3))
    out = out.withColumn("primary_flag", primary_flag(F.col("unsafe_act"), F.col("unsafe_condition"), F.size("act_cues"), F.size("condition_cues")))
    if gates is not None:
        out = turned_away(out, g, F.col("__meant.hazard") if semantic else F.lit(None).cast("string"))
    if spelling:
        out = as_typed(out)
    return out.select(*(x for x in out.columns if not x.startswith("__")))


def turned_away(out: DataFrame, g: dict[str, Column], meant: Column) -> DataFrame:
    """Rows that a gate turns away with the full width: verdict and stage, spans found so far, and everything else not asked."""
    found = decision({**g, "text": F.col("__read"), "spans": F.col("__found"), "model_spans": F.col("__model"), "hazard": F.col("hazard.name"), "semantic": meant, "energy_gate": F.col("energy.gate")})
    early = F.col("__early")
    out = out.withColumn("gate", F.when(early.isNull(), found).otherwise(F.struct(F.lit(True).alias("reject"), early.alias("stage"), F.array().cast("array<string>").alias("evidence"))))
    stage, away = F.col("gate.stage"), F.col("gate.reject")
    label = F.when(stage == "routine", "NON_EVENT").otherwise("OUT_OF_SCOPE")
    chance = F.coalesce(F.when(stage == "routine", F.coalesce(g["p_routine"], F.lit(1.0))).otherwise(g["p"]), F.lit(0.0))
    instead = {
        "verdict": label, "confidence": F.bround(chance, 3), "route": F.lit("gated"), "review_required": F.lit(False), "decision_path": F.concat(stage, F.lit(" -> "), label),
        "energy": F.struct(F.lit("NOT_ASSESSED").alias("gate"), F.lit(None).cast("double").alias("estimate_j"), F.lit(None).cast("string").alias("basis")),
        "act_cues": F.filter("act_cues", lambda x: F.lit(False)), "condition_cues": F.filter("condition_cues", lambda x: F.lit(False)), "harms": F.filter("harms", lambda x: F.lit(False)), "flag_confidence": F.lit(0.0), "unsafe_act": F.lit(False), "unsafe_condition": F.lit(False), "passive_victim": F.lit(False),
    }
    instead |= {name: F.lit(None) for name in ("hazard", "barrier_failure_mode", "negation_scope", "actor", "primary_flag", "control_effective")}
    asked = F.concat(F.lit("not_asked("), stage, F.lit(")"))
    nothing = F.lit(None).cast("struct<text:string,start:int,end:int>")
    instead |= {name: fact(F.lit(None), nothing, asked) for name in FACTS}
    for name, value in instead.items():
        out = out.withColumn(name, F.when(away, value).otherwise(F.col(name)))
    return out


def as_typed(out: DataFrame) -> DataFrame:
    """Spans, harms, cues and facts of the corrected text with the words and offsets of the text as it was typed."""
    whole, changes = F.col("__whole"), F.col("changes")
    for name in ("spans", "harms", "act_cues", "condition_cues"):
        out = out.withColumn(name, led_back(whole, changes, F.col(name)))
    for name in FACTS:
        out = out.withColumn(name, F.get(led_back(whole, changes, F.array(name), ("span", "span_start", "span_end")), F.lit(0)))
    return out
