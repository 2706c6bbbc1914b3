"""Audit of a corpus by source: shares of what rows speak of, nested counters of the most frequent, and whether there is enough."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.spans import beginnings, hit

# Cues of energies, of life-saving rules, and of what a row may speak of.
ENERGY = {
    "gravity": r"\b(fall|fell|height|dropped|drop(?:ped)? object|elevat|ladder|scaffold|roof|collapse|overhead|suspended load|from above)",
    "motion": r"\b(struck by|hit by|vehicle|truck|moving|swing|run over|ran over|collision|rotating|conveyor|forklift|crane)",
    "mechanical": r"\b(caught (?:in|between)|crush|pinch|amputat|entangle|rotating|tong|winch|gear|nip point|guard)",
    "electrical": r"\b(electr|shock|voltage|kv\b|live (?:panel|wire|line)|arc flash|energi[sz]ed)",
    "pressure": r"\b(pressure|hydraulic|pneumatic|blowout|kick\b|release|rupture|burst|hose whip|compressed)",
    "chemical": r"\b(h2s|hydrogen sul|toxic|chemical|acid|caustic|fumes|vapou?r|gas leak|inhal|asphyx|oxygen deficien|confined space)",
    "temperature_fire": r"\b(fire|flash|explo|burn|hot work|weld|ignit|steam|hot oil|flammable|thermal)",
    "sound_radiation_bio": r"\b(noise|radiation|radioactive|snake|insect|bite|heat stroke|heat stress)",
}
RULES = {
    "Working at Height": r"\b(height|scaffold|ladder|harness|fall arrest|edge protection|roof|elevated|lifeline|fall from)",
    "Line of Fire": r"\b(line of fire|struck by|caught between|crush|pinch|dropped object|suspended load|swing|run over|under the load)",
    "Energy Isolation": r"\b(loto|lock ?out|tag ?out|isolat|energi[sz]ed|de-?energi|zero energy|stored energy|live (?:panel|wire|line))",
    "Confined Space": r"\b(confined space|tank entry|vessel entry|manhole|entry permit|oxygen deficien|gas test)",
    "Hot Work": r"\b(hot work|weld|cutting torch|grind|flammable|ignition source|fire watch|gas free)",
    "Driving": r"\b(driver|driving|vehicle|seat ?belt|speed|reversing|journey|road|overturn|tank truck|forklift)",
    "Safe Mechanical Lifting": r"\b(crane|lift(?:ing)?|sling|rigging|hoist|load|banksman|winch|shackle|eot)",
    "Work Authorisation": r"\b(permit|ptw\b|jsa\b|risk assessment|toolbox|authori[sz]|work order|isolation certificate)",
    "Bypassing Safety Controls": r"\b(bypass|override|defeat|disabled|interlock|removed guard|guard (?:was )?removed|inhibit|tamper)",
}
MEASURES = {
    "india_context": r"\b(india|oisd|assam|duliajan|digboi|arunachal|ongc|oil india|dgms|pngrb|pesos?|tank truck|ttpa|bottling plant|gail|iocl|hpcl|bpcl|crore|lakh|rupee)",
    "near_miss_like": r"\b(near[- ]miss|no injur|no one was (?:hurt|injured)|nobody was (?:hurt|injured)|narrowly|could have|potential(?:ly)? (?:fatal|serious)|uninjured|without injury|escaped)",
    "severe_outcome": r"\b(fatal|died|death|killed|amputat|fractur|hospitali|lost time|lti\b|permanent|disab|burn(?:s|ed)|unconscious)",
}
# Domains of work.
DOMAINS = {
    "drilling_well": r"\b(drill(?:ing)? rig|rig floor|derrick|drill pipe|driller|roughneck|floor ?hand|tool ?pusher|workover|well ?head|well site|casing|tubing|mud pump|blowout|bop\b|kick\b|tripping|top drive|kelly|catwalk|wireline|coil(?:ed)? tubing|frac)",
    "production_process": r"\b(separator|gas plant|gathering station|ggs\b|ocs\b|compressor|processing plant|tank farm|storage tank|dehydration|flare|manifold|heater treater|pump ?jack|pumping unit|production facility|process unit|h2s|hydrogen sul[fp]hide)",
    "pipeline": r"\b(pipeline|right of way|row\b|sectionali[sz]ing valve|pig launcher|pigging|hot tap|scraper)",
    "refinery_petrochem": r"\b(refiner(?:y|ies)|petrochemical|crude unit|distillation|hydrocracker|catalyst|reformer|coker)",
    "marketing_lpg_pol": r"\b(lpg|bottling plant|tank truck|tanker|pol\b|petrol pump|retail outlet|depot|terminal|loading gantry|cylinder)",
    "construction_projects": r"\b(scaffold|excavat|trench|construction site|project site|rebar|concrete|formwork|crane|eot crane|hoist|welding|fabrication)",
    "transport_driving": r"\b(driver|driving|vehicle|truck|reversing|road accident|overturn|collision|forklift|haul(?:age|ing)? truck)",
    "mining": r"\b(mine\b|mining|underground|shaft|roof bolt|face\b|longwall|continuous miner|scoop|haulage|quarry|dragline|stope)",
    "marine_offshore": r"\b(vessel|offshore|platform|deck crew|gangway|mooring|anchor|diver|diving|rov\b|subsea|jack-?up|semi-?sub)",
    "electrical": r"\b(electrical|electric shock|electrocut|switchgear|kv\b|volts?|live (?:panel|wire|conductor)|arc flash|transformer|substation|cable laying)",
}
#: Words from which a text is long, and below which it is short; how many of a counter's values are shown; rows that make a rule thin.
LONG, SHORT, TOP, TYPES, THIN = 300, 15, 4, 6, 150


def percent(n: Column, total: Column) -> Column:
    """'37%' of two counts, halves to the even number; 'n/a' of nothing."""
    return F.when(total > 0, F.concat(F.bround(100 * n / total).cast("long"), F.lit("%"))).otherwise("n/a")


def hits(text: Column, table: dict[str, str], begun: Column | None = None) -> Column:
    return F.array_compact(F.array(*(F.when(hit(text, p, begun), name) for name, p in table.items()))).cast("array<string>")


def top(counts: Column, most: int) -> Column:
    """The first ``most`` of an array<struct<n,name>> as 'name:n', the highest first, by name among equals; zeros are left out."""
    order = lambda a, b: F.when(a["n"] != b["n"], F.sign(b["n"] - a["n"]).cast("int")).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    return F.transform(F.slice(F.array_sort(F.filter(counts, lambda c: c["n"] > 0), order), 1, most), lambda c: F.concat_ws(":", c["name"], c["n"]))


def source_audit(df: DataFrame, by: str, text: str, kind: Column, language: Column, languages: list[str], domains: dict[str, str], relevant: Column) -> DataFrame:
    """One row a source, and '(all)': n, twelve measures, and the most frequent languages, domains and record types.

    Rows are measured once where they are read; sums by source and record type are all that is shuffled. The counters of
    languages and domains have fixed names and are sums like the others; of the record types of a source, however many
    there are, the TYPES most frequent are kept by their place. A null text counts as empty, a null source or kind as '?'.
    """
    body, begun = F.coalesce(F.col(text), F.lit("")), F.col("__begun")
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    # A text is read once for the beginnings of all cues; those that it can't hold are not sought.
    cues = [p for table in (domains, ENERGY, MEASURES) for p in table.values()]
    measured = df.withColumn("__begun", beginnings(body, cues)).select(
        F.coalesce(F.col(by).cast("string"), F.lit("?")).alias("source"), F.coalesce(kind.cast("string"), F.lit("?")).alias("kind"), words.alias("w"), language.alias("lang"), hits(body, domains, begun).alias("domains"), hits(body, ENERGY, begun).alias("energy"),
        relevant.alias("relevant"), *(hit(body, p, begun).alias(name) for name, p in MEASURES.items()),
    )
    sums = {
        "n": F.count(F.lit(1)), "words": F.sum("w"), "long": F.count_if(F.col("w") > LONG), "short": F.count_if(F.col("w") < SHORT), "relevant": F.count_if("relevant"), "energy_cue": F.count_if(F.size("energy") > 0), "multi_energy": F.count_if(F.size("energy") > 1),
        **{name: F.count_if(name) for name in MEASURES}, **{f"lang:{x}": F.count_if(F.col("lang") == x) for x in languages}, **{f"domain:{x}": F.count_if(F.array_contains("domains", x)) for x in domains},
    }
    pairs = measured.groupBy("source", "kind").agg(*(c.alias(name) for name, c in sums.items()))
    every = pairs.groupBy("kind").agg(*(F.sum(F.col(f"`{name}`")).alias(name) for name in sums)).withColumn("source", F.lit("(all)"))
    both = pairs.unionByName(every)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "kind"))
    kinds = F.collect_list(F.when(F.col("place") <= TYPES, F.struct(F.col("n").alias("n"), F.col("kind").alias("name"))))
    one = both.withColumn("place", place).groupBy("source").agg(kinds.alias("kinds"), F.count(F.lit(1)).alias("n_kinds"), *(F.sum(F.col(f"`{name}`")).alias(f"s:{name}") for name in sums))
    s = lambda name: F.col(f"`s:{name}`")
    n = s("n")
    counter = lambda prefix, names: top(F.array(*(F.struct(s(f"{prefix}:{x}").alias("n"), F.lit(x).alias("name")) for x in names)), TOP)
    return one.select(
        "source", n.alias("n"), percent(s("relevant"), n).alias("relevant"), percent(s("energy_cue"), n).alias("energy_cue"), s("multi_energy").alias("multi_energy_rows"), *(percent(s(m), n).alias(m) for m in MEASURES),
        F.bround(s("words") / n).cast("long").alias("avg_words"), percent(s("long"), n).alias("over_300_words"), percent(s("short"), n).alias("under_15_words"), "n_kinds", counter("lang", languages).alias("language"), counter("domain", list(domains)).alias("top_domains"), top(F.col("kinds"), TYPES).alias("record_types"),
    )


def rule_gaps(df: DataFrame, text: str, targets: dict[str, int]) -> DataFrame:
    """(rule, n, target, gap, status) of the rows that speak of each rule, against a table of targets.

    status is 'missing' without a row, 'thin' below THIN or the target, else 'ok'. Rules without a target have 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counts = df.select(F.explode(hits(body, RULES)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    table = df.sparkSession.createDataFrame([(r, targets.get(r, 0)) for r in RULES], "rule string, target long")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "missing").when((n < THIN) | (n < F.col("target")), "thin").otherwise("ok")
    return table.join(counts, "rule", "left").select("rule", n.alias("n"), "target", F.greatest(F.col("target") - n, F.lit(0)).alias("gap"), status.alias("status"))


def sufficiency(df: DataFrame, source: str, job: str, caps: dict[str, int], accept: dict[str, float], variants: dict[str, int], generated: int, target: int, loss: float = 0.08) -> DataFrame:
    """(job, seeds, expected, usable, target, ok): what the seeds of each job will yield after caps by source, acceptance and duplicates.

    Sources without a cap count whole. The row '(total)' also has the rows that are generated without seeds.
    """
    spark = df.sparkSession
    per = df.groupBy(job, source).agg(F.count(F.lit(1)).alias("n"))
    limits = spark.createDataFrame([*caps.items()] or [(None, None)], "source string, cap long")
    capped = per.join(F.broadcast(limits), per[source] == limits["source"], "left").groupBy(F.col(job).alias("job")).agg(F.sum(F.least("n", F.coalesce("cap", "n"))).alias("seeds"))
    rates = spark.createDataFrame([(j, float(r), int(variants.get(j, 1))) for j, r in accept.items() if j != "generate"], "job string, rate double, variants long")
    jobs = F.broadcast(rates).join(capped, "job", "left").select("job", F.coalesce("seeds", F.lit(0)).alias("seeds"), F.bround(F.coalesce("seeds", F.lit(0)) * F.col("variants") * F.col("rate")).cast("long").alias("expected"))
    made = spark.createDataFrame([("generate", 0, round(generated * accept["generate"]))], "job string, seeds long, expected long")
    parts = jobs.unionByName(made)
    total = parts.agg(F.sum("seeds").alias("seeds"), F.sum("expected").alias("expected")).select(F.lit("(total)").alias("job"), "seeds", "expected")
    usable = (F.col("expected") - F.bround(F.col("expected") * loss)).cast("long")
    return parts.unionByName(total).withColumn("usable", F.when(F.col("job") == "(total)", usable)).withColumn("target", F.when(F.col("job") == "(total)", F.lit(target).cast("long"))).withColumn("ok", F.col("usable") >= F.col("target"))


def readiness(audit: DataFrame, gaps: DataFrame, enough: DataFrame) -> DataFrame:
    """One row: status and notes of an audit, by what falls short."""
    share = lambda name: F.coalesce(F.regexp_extract(name, r"(\d+)%", 1).try_cast("int"), F.lit(0))
    said = audit.where("source = '(all)'").select(F.filter(F.array(*(F.when(c, F.lit(note)) for note, c in {"little of the domain": share("relevant") < 40, "little of the region": share("india_context") < 5, "few near misses": share("near_miss_like") < 25, "many long rows": share("over_300_words") > 20}.items())), lambda x: x.isNotNull()).alias("notes"))
    thin = gaps.agg(F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.col("rule")))).alias("thin"))
    ok = enough.where("job = '(total)'").select("ok")
    notes = F.concat("notes", F.when(F.size("thin") > 0, F.array(F.concat(F.lit("thin rules: "), F.array_join("thin", ", ")))).otherwise(F.array().cast("array<string>")))
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), (said, thin, ok))
    return one.select(notes.alias("notes"), F.when(F.col("ok") & (F.size(notes) <= 3), "ENOUGH_AND_RELEVANT").when(F.col("ok"), "ENOUGH_WITH_GAPS").otherwise("NOT_ENOUGH").alias("status"))
