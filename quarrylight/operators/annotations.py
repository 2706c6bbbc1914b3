"""Annotations that a model has written: where their spans stand in the text, and whether they hold together.

A row is rejected for problems and keeps a list of issues for what was dropped or put right. Everything is built-in
functions over one struct column, so annotations are judged where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import reports
from quarrylight.operators.scoring import tree

# The vocabularies of annotations, and the greatest lengths of spans and texts in tokens.
ROLES = ["energy_cue", "release_cue", "no_release_cue", "exposure_cue", "control_present", "control_absent", "control_ineffective", "pseudo_control", "negation_cue", "outcome_cue", "statement_cue"]
QUESTIONS = ["high_energy_present", "energy_released", "serious_injury", "direct_control_present"]
BARRIERS = ["energy_isolation", "gas_test", "entry_permit", "fall_arrest", "tool_lanyard", "drop_zone_barricade", "exclusion_zone", "lifting_plan", "hot_work_permit", "machine_guard", "ptw", "ppe"]
BARRIER_STATUS = ["absent", "present_effective", "present_ineffective", "pseudo"]
VERDICTS = ["H_SIF", "L_SIF", "P_SIF", "EXPOSURE", "CAPACITY", "SUCCESS", "LOW_ENERGY", "NON_EVENT", "INSUFFICIENT"]
STATEMENT_TYPES = ["observed", "hypothetical", "historical", "training_example", "corrective_completed", "condition_only"]
ENERGY_TYPES = ["gravity", "motion", "electrical", "pressure", "thermal", "chemical", "mechanical", "radiation", "biological", "water"]
CONTROL_ROLES = ["control_present", "control_absent", "control_ineffective", "pseudo_control"]
MAX_SPAN_TOKENS, MAX_TEXT_TOKENS, LEAST_TOKENS = 12, 380, 3
# Names that stand for a barrier.
BARRIER_NAMES = {
    "work_authorisation": "ptw", "work_authorization": "ptw", "permit": "ptw", "permit_to_work": "ptw", "work_permit": "ptw", "sop": "ptw", "procedure": "ptw", "jsa": "ptw", "risk_assessment": "ptw", "toolbox_talk": "ppe", "training": "ppe",
    "supervision": "ppe", "competent_person": "ppe", "banksman": "exclusion_zone", "spotter": "exclusion_zone", "harness": "fall_arrest", "fall_protection": "fall_arrest", "lifeline": "fall_arrest", "guardrail": "fall_arrest",
    "edge_protection": "fall_arrest", "scaffold_tagging": "fall_arrest", "barricade": "drop_zone_barricade", "barrication": "drop_zone_barricade", "hard_barricade": "drop_zone_barricade", "drop_zone": "drop_zone_barricade", "cordon": "exclusion_zone",
    "exclusion": "exclusion_zone", "loto": "energy_isolation", "lockout": "energy_isolation", "isolation": "energy_isolation", "lock_out_tag_out": "energy_isolation", "guard": "machine_guard", "guarding": "machine_guard", "interlock": "machine_guard",
    "gas_testing": "gas_test", "gas_detector": "gas_test", "gas_monitoring": "gas_test", "confined_space_permit": "entry_permit", "confined_space_entry_permit": "entry_permit", "lift_plan": "lifting_plan", "lifting_plan_and_rigging": "lifting_plan",
    "rigging": "lifting_plan", "sling_inspection": "lifting_plan", "hot_work": "hot_work_permit", "fire_watch": "hot_work_permit", "tool_tether": "tool_lanyard", "lanyard": "tool_lanyard",
}
# Words that mark a statement as no observation, serious injuries, the digits they may be of, and what takes them back.
STATEMENT_MARKER = r"(?iU)\b(agar|if|could|would|might|may|had|ho sakta|ho sakti|hota|hoti|kya hoga|suppose|hypothetic\w*|last (?:year|month|week)|pichle|pichhle|purana|earlier|previous\w*|in 20\d\d|20\d\d me|training|mock|drill|tbt|toolbox|example|udaharan|scenario|closed|completed|rectified|repaired|replaced|fixed|done|ho gaya|kar diya gaya|action taken|corrective|yaad|remember|recalled|dekha tha|hua tha|thi jab)\b"
SERIOUS = r"(?iU)\b(fatal(?:ity|ities|ly)?|died|death|killed|amputat\w*|fractur\w*|broke(?:n)?\s+(?:\w+\s+){0,3}?(?:leg|arm|tibia|fibula|femur|skull|pelvis|hip|spine|back|neck|ribs?|wrist|ankle|jaw|collar ?bone|bones?)\b|unconscious|concussion|hospitali[sz]ed|admitted to (?:the )?hospital|surgery|third[- ]degree|second[- ]degree|crushed (?:his |her |their |the )?(?:head|chest|pelvis|torso|abdomen)|electrocut\w*|asphyxiat\w*|maut|mar gaya|mrityu|haddi toot)"
DIGIT = r"(?iU)\b(finger|fingertip|thumb|toe|pinky|digit)s?\b"
NO_INJURY = r"(?iU)\b(no (?:one was )?(?:injur\w*|hurt)|uninjured|koi chot nahi|first aid only|could have|would have|might have|potential(?:ly)?|agar|ho sakta|last year|pichle saal|in 20\d\d|training|drill|mock)\b"

TOKEN = r"(?U)[\wऀ-ॿঀ-৿]+(?:[-_][\wऀ-ॿঀ-৿]+)*|\S"
ELLIPSIS = r"\s*(?:\.\.\.|…)\s*"
ASKED = ", ".join(f"{q}:struct<value:string,span:string>" for q in QUESTIONS)
#: What ``judged`` reads of an annotation.
ELEMENT = (
    "text string, events array<struct<roles:array<struct<role:string,span:string>>,questions:struct<" + ASKED + ">,barriers:array<struct<barrier:string,status:string,span:string>>,"
    "energy_types:array<string>,life_saving_rules:array<string>,statement_type:string,verdict:string,rationale_one_line:string>>"
)
PLACE = "struct<start:int,end:int,tier:string>"
TEXTS = "array<string>"


def let(value: Column, function) -> Column:
    """``function`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), 0))


def _at(start: Column, end: Column, tier: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(tier).alias("tier"))


def _by_pattern(text: Column, pattern: Column, tier: str) -> Column:
    """The place of a pattern's first match; what stands before and behind it tells where."""
    return let(F.split(text, pattern, 2), lambda parts: F.when(F.size(parts) == 2, _at(F.length(parts[0]), F.length(text) - F.length(parts[1]), tier)))


def quoted(word: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _plain_place(text: Column, span: Column) -> Column:
    words = F.filter(F.split(span, r"\s+"), lambda w: w != "")
    loose = F.array_join(F.transform(words, quoted), r"\s+")
    at = F.position(span, text)
    return F.when(F.size(words) > 0, F.coalesce(F.when(at > 0, _at(at - 1, at - 1 + F.length(span), "exact")), _by_pattern(text, loose, "spaces"), _by_pattern(text, F.concat(F.lit("(?iu)"), loose), "case")))


def located(text: Column, span: Column) -> Column:
    """struct<start,end,tier> of a span that a model quotes from a text; null if it isn't there.

    Offsets are code points of the text, ends exclusive. It is sought as it is, then with any white space between its
    words, then in any case; with dots of omission, from its first part to its last one behind it.
    """

    def parted(parts: Column) -> Column:
        def behind(first: Column) -> Column:
            last = _plain_place(text.substr(first["end"] + 1, F.length(text)), F.get(parts, F.size(parts) - 1))
            return let(last, lambda b: F.when(b.isNotNull(), _at(first["start"], first["end"] + b["end"], "parts")))

        return F.when(F.size(parts) >= 2, let(_plain_place(text, parts[0]), lambda a: F.when(a.isNotNull(), behind(a))))

    whole = F.coalesce(_plain_place(text, span), let(F.filter(F.transform(F.split(span, ELLIPSIS), F.trim), lambda p: p != ""), parted))
    return F.when(F.trim(span) != "", whole).cast(PLACE)


def truth(value: Column) -> Column:
    """'true', 'false' or 'unknown' of an answer; null for anything else."""
    key = F.lower(F.trim(value))
    return F.when(key.isin("true", "yes"), "true").when(key.isin("false", "no"), "false").when(value.isNull() | key.isin("unknown", "unclear", "null", "none", ""), "unknown")


def said(*parts: tuple[Column, Column | str]) -> Column:
    """The messages whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in parts))).cast(TEXTS)


def told(rows: Column, test, message) -> Column:
    """A message for each of the rows that a test holds for."""
    return F.transform(F.filter(rows, lambda r: F.coalesce(test(r), F.lit(False))), message).cast(TEXTS)


def _placed_roles(text: Column, roles: Column) -> Column:
    def placed(r: Column) -> Column:
        return let(located(text, r["span"]), lambda at: F.struct(r["role"].alias("role"), text.substr(at["start"] + 1, at["end"] - at["start"]).alias("span"), at["start"].alias("start"), at["end"].alias("end"), F.coalesce(r["span"], F.lit("None")).alias("asked")))

    return F.transform(F.filter(F.coalesce(roles, F.array().cast("array<struct<role:string,span:string>>")), lambda r: r.isNotNull()), placed)


def _anchored(text: Column, roles: Column) -> Column:
    """Roles in turn: a span that recurs in the text moves into the first longer span of the event that holds one of its places."""

    def places(span: Column) -> Column:
        pieces = F.split(text, quoted(span), -1)
        upto = lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda n, p: n + F.length(p)) + (k - 1) * F.length(span)
        return F.when(F.size(pieces) > 2, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), upto))

    def moved(r: Column, others: Column) -> Column:
        size = F.length(r["span"])
        inside = F.filter(places(r["span"]), lambda o: F.exists(others, lambda h: (h["end"] - h["start"] > size) & (h["start"] <= o) & (o + size <= h["end"])))
        return let(F.get(inside, F.lit(0)), lambda o: F.when(o.isNotNull(), r.withField("start", o).withField("end", o + size)).otherwise(r))

    turns = F.when(F.size(roles) > 0, F.sequence(F.lit(0), F.size(roles) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, roles, lambda own, k: F.transform(own, lambda r, i: F.when(i == k, moved(r, own)).otherwise(r)))


def _event(text: Column, e: Column) -> Column:
    """One event judged: problems, issues, and what is kept of it."""
    statement = F.lower(F.trim(F.coalesce(e["statement_type"], F.lit(""))))
    verdict = F.upper(F.trim(F.coalesce(e["verdict"], F.lit(""))))
    known_type = F.when(statement.isin(*STATEMENT_TYPES), statement).otherwise("observed")

    def with_roles(found: Column) -> Column:
        known = F.filter(found, lambda r: r["role"].isin(*ROLES))
        long = lambda r: n_tokens(r["span"]) > MAX_SPAN_TOKENS
        bare = lambda r: (r["role"] == "statement_cue") & ~r["span"].rlike(STATEMENT_MARKER)
        there = F.filter(known, lambda r: r["start"].isNotNull())
        short = F.filter(there, lambda r: ~long(r))
        fit = F.filter(short, lambda r: ~bare(r))
        control = lambda r: F.exists(fit, lambda o: o["role"].isin(*CONTROL_ROLES) & (o["start"] == r["start"]) & (o["end"] == r["end"]))
        kept = F.filter(fit, lambda r: ~((r["role"] == "energy_cue") & control(r)))
        problems = F.concat(told(known, lambda r: r["start"].isNull(), lambda r: F.concat(F.lit("role "), r["role"], F.lit(" not in text: "), F.substring(r["asked"], 1, 40))), told(there, long, lambda r: F.concat(F.lit("role "), r["role"], F.lit(" too long"))))
        issues = F.concat(
            told(found, lambda r: ~F.coalesce(r["role"].isin(*ROLES), F.lit(False)), lambda r: F.concat(F.lit("unknown role "), F.coalesce(r["role"], F.lit("None")))),
            told(short, bare, lambda r: F.concat(F.lit("no marker in statement_cue: "), F.substring(r["span"], 1, 40))), said((F.size(kept) < F.size(fit), "energy_cue on a control")),
        )
        return F.struct(_anchored(text, kept).alias("roles"), problems.alias("problems"), issues.alias("issues"))

    def answer(name: str) -> Column:
        q = e["questions"][name]
        return let(located(text, q["span"]), lambda at: F.struct(F.lit(name).alias("question"), F.coalesce(F.when(q.isNotNull(), truth(q["value"])), F.lit("unknown")).alias("value"), text.substr(at["start"] + 1, at["end"] - at["start"]).alias("span"), at["start"].alias("start"), at["end"].alias("end")))

    def with_answers(r: Column) -> Column:
        return let(F.array(*map(answer, QUESTIONS)), lambda answers: _finished(text, e, r, answers, statement, known_type, verdict))

    return let(_placed_roles(text, e["roles"]), lambda found: let(with_roles(found), with_answers))


def _finished(text: Column, e: Column, r: Column, answers: Column, statement: Column, known_type: Column, verdict: Column) -> Column:
    q = e["questions"]
    asked = [q[name] for name in QUESTIONS]
    high, released, injured, control = (F.when(answers[k]["value"] != "unknown", answers[k]["value"] == "true") for k in range(4))
    derived = tree(high, released, injured, control, known_type, F.lit(True))
    hurt = F.regexp_extract(text, SERIOUS, 0)
    behind = F.get(F.split(text, SERIOUS, 2), F.lit(1))
    of_digit = F.lower(hurt).rlike("^(fractur|broke)") & F.substring(behind, 1, 40).rlike(DIGIT)

    def barrier(b: Column) -> Column:
        key = F.regexp_replace(F.lower(F.trim(F.coalesce(b["barrier"], F.lit("None")))), "[ -]", "_")
        names = F.create_map(*(F.lit(x) for pair in BARRIER_NAMES.items() for x in pair))
        name = F.when(key.isin(*BARRIERS), key).otherwise(F.try_element_at(names, key))
        return let(located(text, b["span"]), lambda at: F.struct(name.alias("barrier"), b["status"].alias("status"), text.substr(at["start"] + 1, at["end"] - at["start"]).alias("span"), at["start"].alias("start"), at["end"].alias("end"), key.alias("key")))

    barriers = F.transform(F.filter(F.coalesce(e["barriers"], F.array().cast("array<struct<barrier:string,status:string,span:string>>")), lambda b: b.isNotNull()), barrier)
    good = lambda b: F.coalesce(b["status"].isin(*BARRIER_STATUS), F.lit(False))
    kept = F.transform(F.filter(barriers, lambda b: b["barrier"].isNotNull() & good(b)), lambda b: F.struct(b["barrier"].alias("barrier"), F.when(b["barrier"] == "ppe", "pseudo").otherwise(b["status"]).alias("status"), b["span"].alias("span"), b["start"].alias("start"), b["end"].alias("end")))
    empty = F.array().cast(TEXTS)
    rules = F.coalesce(e["life_saving_rules"], empty)
    named = F.array_distinct(F.flatten(F.transform(rules, reports.canonical_rules)))
    unnamed = F.flatten(F.transform(rules, reports.unmapped_rules))
    why = F.when(F.trim(e["rationale_one_line"]) != "", e["rationale_one_line"])
    quotes = F.regexp_extract_all(why, F.lit('"([^"]{3,})"'), 1)
    backed = F.exists(quotes, lambda s: F.contains(text, s)) | F.exists(r["roles"], lambda x: F.contains(why, x["span"]))
    problems = F.concat(
        r["problems"], said(*((c.isNull(), f"question {name} missing") for name, c in zip(QUESTIONS, asked, strict=True))), said(*((c.isNotNull() & truth(c["value"]).isNull(), F.concat(F.lit(f"question {name} has no truth value: "), c["value"])) for name, c in zip(QUESTIONS, asked, strict=True))),
        said(
            ((answers[2]["value"] == "false") & ~text.rlike(NO_INJURY) & (hurt != "") & ~of_digit, F.concat(F.lit("no serious injury, but the text says "), hurt)),
            (~statement.isin(*STATEMENT_TYPES), F.concat(F.lit("unknown statement type "), statement)), (~verdict.isin(*VERDICTS), F.concat(F.lit("unknown verdict "), verdict)),
            (verdict.isin(*VERDICTS) & derived.isNull() & ~verdict.isin("EXPOSURE", "SUCCESS", "INSUFFICIENT"), F.concat(F.lit("verdict not allowed after a corrective action: "), verdict)),
            (verdict.isin(*VERDICTS) & (derived != verdict) & ~((verdict == "NON_EVENT") & (derived == "LOW_ENERGY")), F.concat(F.lit("verdict "), verdict, F.lit(" against answers "), derived)),
            ((F.size(r["roles"]) == 0) & ~verdict.isin("NON_EVENT", "INSUFFICIENT", "LOW_ENERGY"), "no role"),
        ),
    )
    lost = [(c["span"] != "") & answers[k]["start"].isNull() for k, c in enumerate(asked)]
    issues = F.concat(
        r["issues"], said(*((c, f"question {name} span not in text") for name, c in zip(QUESTIONS, lost, strict=True))), told(barriers, lambda b: b["barrier"].isNull(), lambda b: F.concat(F.lit("unknown barrier "), b["key"])),
        told(barriers, lambda b: b["barrier"].isNotNull() & ~good(b), lambda b: F.concat(F.lit("barrier "), b["barrier"], F.lit(" without a status"))), told(barriers, lambda b: (b["barrier"] == "ppe") & good(b) & (b["status"] != "pseudo"), lambda b: F.lit("ppe is pseudo")),
        said((F.size(unnamed) > 0, F.concat(F.lit("unknown rules: "), F.array_join(unnamed, "|"))), (why.isNotNull() & ~F.coalesce(backed, F.lit(False)), "rationale without a span")),
    )
    energy = F.filter(F.transform(F.coalesce(e["energy_types"], empty), F.lower), lambda x: x.isin(*ENERGY_TYPES))
    roles = F.transform(r["roles"], lambda x: F.struct(x["role"].alias("role"), x["span"].alias("span"), x["start"].alias("start"), x["end"].alias("end")))
    return F.struct(problems.alias("problems"), issues.alias("issues"), roles.alias("roles"), answers.alias("questions"), kept.alias("barriers"), energy.alias("energy_types"), named.alias("life_saving_rules"), known_type.alias("statement_type"), verdict.alias("verdict"), derived.alias("rules_verdict"), why.alias("rationale"))


def judged(df: DataFrame, element: str) -> DataFrame:
    """``df`` with accepted, problems, issues and events of the annotations in a struct column (of type ELEMENT).

    A row is accepted if it has no problem. A text of fewer than LEAST_TOKENS tokens and a row without events have that
    one problem and no events; a null struct is one of these. Problems and issues name what they are about, event by
    event, in order. Spans are those of the trimmed text.
    """
    text = F.trim(F.coalesce(F.col(element)["text"], F.lit("")))
    events = F.filter(F.col(element)["events"], lambda e: e.isNotNull())
    out = df.withColumn("__text", text)
    t = F.col("__text")
    short, none = n_tokens(t) < LEAST_TOKENS, F.coalesce(F.size(events) <= 0, F.lit(True))
    out = out.withColumn("events", F.when(~short & ~none, F.transform(events, lambda e: _event(t, e))))
    early = said((short, "text missing or too short"), (~short & none, "no events"), (~short & ~none & (n_tokens(t) > MAX_TEXT_TOKENS), "text too long"))
    gathered = lambda name: F.coalesce(F.flatten(F.transform("events", lambda e: e[name])), F.array().cast(TEXTS))
    out = out.withColumn("problems", F.concat(early, gathered("problems"))).withColumn("issues", gathered("issues"))
    return out.withColumn("accepted", F.size("problems") == 0).drop("__text")


def training_rows(df: DataFrame, element: str) -> DataFrame:
    """The accepted annotations as flat rows: text, spans of all events, first verdict and type, distinct rules and energies."""
    good = judged(df, element).where("accepted")
    flat = lambda name: F.flatten(F.transform("events", lambda e: e[name]))
    first = F.col("events")[0]
    return good.select(
        *df.columns, F.trim(F.col(element)["text"]).alias("text"), flat("roles").alias("spans"), first["verdict"].alias("verdict"), first["statement_type"].alias("statement_type"),
        F.array_sort(F.array_distinct(flat("life_saving_rules"))).alias("life_saving_rules"), F.array_sort(F.array_distinct(flat("energy_types"))).alias("energy_types"), F.size("events").alias("n_events"), "issues",
    )
