"""Gates before the verdict: is the text a safety report at all, and does anything speak for it?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.rules import ROUTINE
from quarrylight.functions.spans import hit

# Thresholds, roles and sources that count as evidence, spans that say nothing, texts without content.
OUT, SOFT, SURE, HEAD = 0.90, 0.35, 0.80, 0.40
VETO_ROLES = ("control_absent", "control_ineffective", "release_cue", "outcome_cue", "pseudo_control")
VETO_SOURCES = ("rules", "rules:hazard_lexicon")
MODEL_ROLES = ("energy_cue", "release_cue", "exposure_cue", "control_present", "control_absent", "control_ineffective", "outcome_cue")
SIF_LIKE = ("H_SIF", "L_SIF", "P_SIF", "EXPOSURE", "CAPACITY")
GENERIC = r"(?iU)^(?:(?:nahi|nai|nahin)\s+(?:tha|thi|the|kiya|liya|hua|hui)|bina(?:\s+\w+){0,3}|almost|nearly|about to|abhi tak|loose|empty|expired|overdue|partially|damaged|defective|missing|removed|disabled|discharged|blocked|jam(?:med)?|broken|dheela)$"
UNSCORABLE = r"(?iU)^\W*(nil|na|n\.?a\.?|none|kuch nahi|same as above|as per (?:annexure|attached|above)|refer (?:to )?(?:attach|annex)\w*|photo|screenshot|image|attach\w*|dekh\w* attach\w*)\b"
# Event types of routine, and the chance from which a model's word for routine counts.
ROUTINE_TYPES, ROUTINE_SURE = ("routine_operations", "administrative", "maintenance_log"), 0.70
#: A vehicle that is merely named speaks for a report only beside a release or a missing control.
NAMED_ONLY, BESIDE = "vehicle_or_mobile_plant", ("release_cue", "control_absent")


def hard_evidence(spans: Column) -> Column:
    """The first hand-written span of a release, an outcome or a control that says more than a bare negation; null without one."""
    own = lambda s: s["role"].isin(*VETO_ROLES) & s["source"].isin(*VETO_SOURCES) & ~F.trim(s["text"]).rlike(GENERIC)
    first = F.get(F.filter(spans, own), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.lit("rule span "), first["role"], F.lit("="), first["text"]))


def unscorable(text: Column) -> Column:
    """Whether a text has nothing to score: a placeholder, a pointer to an attachment, or three words at most."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.trim(text).rlike(UNSCORABLE) | (F.size(words) <= 3)


def routine(text: Column, event_type: Column, event_p: Column, p_routine: Column, p_safety: Column) -> Column:
    """Whether a text tells of routine operations: by a fixed description, or by a model that is sure, unless it also sees an event."""
    described = reduce(Column.__or__, (hit(text, p) for p in ROUTINE))
    sure = (event_type.isin(*ROUTINE_TYPES) & (event_p >= ROUTINE_SURE)) | (p_routine >= ROUTINE_SURE)
    return described | F.coalesce(F.coalesce(sure, F.lit(False)) & ~F.coalesce(p_safety >= 1 - ROUTINE_SURE, F.lit(False)), F.lit(False))


def decision(c: dict[str, Column]) -> Column:
    """struct<reject,stage,evidence> of the two gates.

    ``c`` has p (the chance of being out of scope), text, spans and model_spans (arrays of spans, not null), hazard,
    semantic, energy_gate, prefilter (label), head (label) and head_confidence. Above OUT a row is rejected unless a hard
    span vetoes it (stage scope). From SOFT on it is rejected if no kind of evidence speaks for it (stage evidence), but
    not if it is unscorable or no head has judged it. A null p rejects nothing.
    """
    spans, hard = c["spans"], hard_evidence(c["spans"])
    beside = F.exists(spans, lambda s: s["role"].isin(*BESIDE))
    sure = F.filter(c["model_spans"], lambda s: (s["score"] >= SURE) & s["role"].isin(*MODEL_ROLES))
    best = F.array_max(F.transform(sure, lambda s: s["score"]))
    model = F.get(F.filter(sure, lambda s: s["score"] == best), F.lit(0))
    evidence = F.array_compact(
        F.array(
            hard,
            F.when(c["hazard"].isNotNull() & ((c["hazard"] != NAMED_ONLY) | beside), F.concat(F.lit("hazard "), c["hazard"])),
            F.when(c["semantic"].isNotNull(), F.concat(F.lit("semantic "), c["semantic"])),
            F.when(c["energy_gate"].isin("EXCEEDS", "BELOW"), F.concat(F.lit("energy "), c["energy_gate"])),
            F.when(model.isNotNull(), F.concat(F.lit("model "), model["role"], F.lit("="), model["text"])),
            F.when(c["prefilter"] == "1", "prefilter"),
            F.when(c["head"].isin(*SIF_LIKE) & (c["head_confidence"] >= HEAD), F.concat(F.lit("head "), c["head"])),
        )
    )
    out = F.coalesce((c["p"] > OUT) & hard.isNull(), F.lit(False))
    judged = c["prefilter"].isNotNull() | c["head"].isNotNull()
    alone = F.coalesce((c["p"] >= SOFT) & judged & ~unscorable(c["text"]) & (F.size(evidence) == 0), F.lit(False))
    stage = F.when(out, "scope").when(alone, "evidence")
    return F.struct((out | alone).alias("reject"), stage.alias("stage"), evidence.alias("evidence"))


def gated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the column gate: struct<reject,stage,evidence>; no row is dropped.

    ``columns`` names the columns that ``decision`` takes; null texts and spans count as empty.
    """
    c = {name: F.col(own) for name, own in columns.items()}
    for name in ("spans", "model_spans"):
        c[name] = F.coalesce(c[name], F.array().cast(df.schema[columns[name]].dataType))
    return df.withColumn("gate", decision(c | {"text": F.coalesce(c["text"], F.lit(""))}))
