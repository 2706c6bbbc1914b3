"""Spelling of field reports: known variants, corrections to core terms, and the way back to the offsets of the original."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known variants of words, and what they stand for.
VARIANTS = {
    "gya": "gaya", "gyi": "gayi", "gye": "gaye", "gayaa": "gaya", "nhi": "nahi", "nai": "nahi", "nahin": "nahi", "nhin": "nahi",
    "rha": "raha", "rhi": "rahi", "rhe": "rahe", "hia": "hai", "hogya": "ho gaya", "hogyi": "ho gayi", "kam": "kaam",
    "kr": "kar", "krke": "karke", "krna": "karna", "chor": "chhod", "chod": "chhod", "jl": "jal", "jla": "jala",
    "kahrab": "kharab", "khrab": "kharab", "bhut": "bahut", "bht": "bahut", "wrkr": "worker", "wrker": "worker", "wroker": "worker",
    "hath": "haath", "haat": "haath", "ankh": "aankh", "ankhe": "aankhen", "ankhen": "aankhen", "ankho": "aankhon", "aankho": "aankhon",
    "pipline": "pipeline", "pipeine": "pipeline", "piplines": "pipeline", "gase": "gas", "gass": "gas", "leek": "leak", "lik": "leak",
    "leaking": "leak", "leakge": "leakage", "presure": "pressure", "pressur": "pressure", "electic": "electric", "eletric": "electric",
    "elec": "electric", "voltag": "voltage", "vlt": "volt", "scafolding": "scaffolding", "scafold": "scaffold", "harnes": "harness",
    "harnss": "harness", "barricad": "barricade", "baricade": "barricade", "barikade": "barricade", "barrikade": "barricade",
    "permited": "permitted", "permision": "permission", "permisson": "permission", "isoltn": "isolation", "isolatn": "isolation",
    "isoln": "isolation", "panl": "panel", "pannel": "panel", "crain": "crane", "cran": "crane", "vehical": "vehicle", "vechile": "vehicle",
    "vehcle": "vehicle", "weldng": "welding", "fractur": "fracture", "fractue": "fracture", "hight": "height", "hieght": "height",
    "heigth": "height", "injurd": "injured", "injry": "injury", "injuri": "injury", "bandge": "bandage", "safty": "safety",
    "saftey": "safety", "sefty": "safety", "exposd": "exposed", "expsure": "exposure", "temprature": "temperature", "temp": "temperature",
}
# The terms that long words are corrected to.
CORE_TERMS = (
    "barricade barricading barricaded exclusion harness lanyard lifeline scaffold scaffolding ladder platform permitted permission isolation "
    "isolated energised energized switchgear voltage electric electrical electrician confined manhole oxygen nitrogen welding grinding cutting "
    "pressure pressurised pressurized hydraulic compressor separator wellhead manifold pipeline flowline chemical corrosive hydrocarbon benzene "
    "ammonia chlorine methane sulphur radiography radiation explosion flammable ignition extinguisher hydrogen generator excavation trenching "
    "shoring vehicle forklift trailer reversing banksman collision overspeed overspeeding lifting rigging shackle suspended conveyor rotating "
    "entanglement machine guarding fracture fractured amputation unconscious hospital hospitalised injured injury bleeding electrocuted "
    "temperature detector respirator goggles helmet gloves"
).split()
# Words of seven letters and more that are never corrected (shorter ones never are).
KEPT = ["dopahar", "hamesha", "because", "between", "yesterday", "tomorrow", "morning", "evening", "reported", "request"]

WORD = r"[A-Za-zऀ-ॿ]+"
CHANGES = "array<struct<old:string,new:string,start:int,end:int>>"
#: Letters a word must have to be corrected, those from which two edits count, and those of a term that a word may go on from.
LEAST, LONG, STEM = 7, 10, 6
SOUND, STEMS = {*KEPT, *CORE_TERMS}, tuple(t for t in CORE_TERMS if len(t) >= STEM)
BY_LETTER = {letter: [(t, set(t)) for t in CORE_TERMS if t[0] == letter] for letter in {t[0] for t in CORE_TERMS}}
#: Words that a worker remembers.
MOST_WORDS = 200_000


def _swapped(word: Column, i: Column) -> Column:
    """``word`` with its letters at ``i`` and behind it (from 1) in turn."""
    return F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.lit(1)), word.substr(i, F.lit(1)), word.substr(i + 2, F.length(word)))


def _swaps(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.struct(i.alias("i"), _swapped(word, i).alias("word")))


def _put_between(swap: Column, term: Column) -> Column:
    """Whether ``term`` is a swapped word with a new letter between the two: that edits one place twice."""
    i, word = swap["i"], swap["word"]
    new, pair = term.substr(i + 1, F.lit(1)), word.substr(i, F.lit(2))
    same = (term.substr(F.lit(1), i) == word.substr(F.lit(1), i)) & (term.substr(i + 2, F.length(term)) == word.substr(i + 1, F.length(word)))
    return (F.length(term) == F.length(word) + 1) & same & ~F.contains(pair, new)


def edits(word: Column, term: Column, cap: Column) -> Column:
    """Insertions, deletions, replacements and swaps of neighbours that turn ``word`` into ``term``; above ``cap`` (1 or 2), null.

    No place is edited twice. A swap costs two of ``levenshtein``; so within twice the cap swaps are tried, and within two
    of them one more plain edit or one more swap.
    """
    plain = F.levenshtein(word, term)
    one = F.exists(_swaps(word), lambda s: s["word"] == term)
    two = F.exists(_swaps(word), lambda s: ((F.levenshtein(s["word"], term) == 1) & ~_put_between(s, term)) | F.exists(_swaps(s["word"]), lambda r: (r["word"] == term) & (F.abs(r["i"] - s["i"]) > 1)))
    return F.when(plain <= 1, plain).when((plain == 2) & one, 1).when(cap < 2, F.lit(None).cast("int")).when(plain == 2, 2).when((plain <= 4) & two, 2)


def correction(word: Column) -> Column:
    """The core term that a long word in lower case lies near, one edit off or from ten letters on two; null without one.

    The term has the word's first letter; the nearest counts, the alphabetically first of equals.
    """
    by_letter = {}
    for term in sorted(CORE_TERMS):
        by_letter.setdefault(term[0], []).append(term)
    table = F.create_map(*(x for letter, terms in by_letter.items() for x in (F.lit(letter), F.array(*map(F.lit, terms)))))
    cap = F.when(F.length(word) < LONG, 1).otherwise(2)
    near = F.filter(F.try_element_at(table, F.substring(word, 1, 1)), lambda t: (F.abs(F.length(word) - F.length(t)) <= cap) & F.when(F.length(word) < LONG, F.levenshtein(word, t, 2) >= 0).otherwise(F.levenshtein(word, t, 4) >= 0))
    return F.array_min(F.filter(F.transform(near, lambda t: F.struct(edits(word, t, cap).alias("d"), t.alias("term"))), lambda x: x["d"].isNotNull()))["term"]


def _distance(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn one word into the other, no place edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def near_term(word: str) -> str | None:
    """What ``correction`` gives for a word in lower case that is doubtful; null for others."""
    if len(word) < LEAST or not word.isascii() or word in SOUND or word.startswith(STEMS):
        return None
    cap, letters = 1 if len(word) < LONG else 2, set(word)
    # An edit takes one letter away or adds one: words that differ in more letters are further off.
    alike = (t for t, own in BY_LETTER.get(word[0], ()) if abs(len(t) - len(word)) <= cap and len(own - letters) <= cap and len(letters - own) <= cap)
    near = [(d, t) for t in alike if (d := _distance(word, t)) <= cap]
    return min(near)[1] if near else None


class _Fixes(dict):
    """What a word as it is typed is replaced by, found once a worker for as long as MOST_WORDS are held; null for sound ones."""

    def __missing__(self, word: str) -> str | None:
        low = word.lower()
        fix = VARIANTS.get(low) or near_term(low)
        if fix and word[0].isupper():
            fix = fix[0].upper() + fix[1:]
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = fix
        return fix


FIXES, WORDS = _Fixes(), re.compile(WORD)


def corrected(texts: pa.Array) -> pa.Array:
    """struct<text,changes> of each text: the corrected one, null where nothing was, and its changes in order."""
    whole, changes = [], []
    for text in texts.to_pylist():
        wrong = {w for w in set(WORDS.findall(text)) if FIXES[w]} if text else ()
        found = [{"old": m[0], "new": FIXES[m[0]], "start": m.start(), "end": m.end()} for m in WORDS.finditer(text) if m[0] in wrong] if wrong else []
        changes.append(found)
        whole.append(WORDS.sub(lambda m: FIXES[m[0]] if m[0] in wrong else m[0], text) if wrong else None)  # noqa: B023
    kind = pa.list_(pa.struct([("old", pa.string()), ("new", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.StructArray.from_arrays([pa.array(whole, pa.string()), pa.array(changes, kind)], ["text", "changes"])


def normalised(df: DataFrame, text: str = "text", into: tuple[str, str] = ("normalised", "changes")) -> DataFrame:
    """``df`` with the columns normalised (the corrected text) and changes: array<struct<old,new,start,end>> in order.

    ``into`` names them otherwise; columns of these names are replaced.
    Offsets are code points of the original, ends exclusive. A null text has null columns, an empty or sound one no
    changes. Each row is corrected where it is read: rows may repeat and need no key, nothing is shuffled, and a text
    without anything to correct is not taken apart. A worker looks a word up once, however many texts hold it.
    """
    column = F.col(text)
    found = df.withColumn("__fixed", F.arrow_udf(corrected, f"struct<text:string,changes:{CHANGES}>")(column))
    fixed = F.col("__fixed")
    return found.select(*(c for c in df.columns if c not in into), F.coalesce(fixed["text"], column).alias(into[0]), F.when(column.isNotNull(), fixed["changes"]).alias(into[1]))


def _original(changes: Column, at: Column) -> Column:
    """struct<start,end> in the original of one character of the normalised text: all of a word that was changed."""
    def step(state: Column, c: Column) -> Column:
        start = c["start"] + state["shift"]
        end = start + F.length(c["new"])
        inside = (at >= start) & (at < end)
        shift = F.when(at >= end, state["shift"] + F.length(c["new"]) - (c["end"] - c["start"])).otherwise(state["shift"])
        return F.struct(shift.alias("shift"), F.when(inside, c["start"]).otherwise(state["start"]).alias("start"), F.when(inside, c["end"]).otherwise(state["end"]).alias("end"))

    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("shift"), none.alias("start"), none.alias("end"))
    return F.aggregate(changes, begin, step, lambda s: F.struct(F.coalesce(s["start"], at - s["shift"]).alias("start"), F.coalesce(s["end"], at - s["shift"] + 1).alias("end")))


def restored(changes: Column, start: Column, end: Column) -> Column:
    """struct<start,end> in the original of a span of the normalised text; an empty span stays as it is."""
    span = F.struct(_original(changes, start)["start"].alias("start"), _original(changes, end - 1)["end"].alias("end"))
    return F.when(start < end, span).otherwise(F.struct(start.alias("start"), end.alias("end")))


def led_back(original: Column, changes: Column, found: Column, names: tuple[str, str, str] = ("text", "start", "end")) -> Column:
    """An array of structs with a text and offsets, as the original has them; without changes it stays as it is."""
    text, start, end = names
    placed = F.transform(found, lambda s: F.struct(s.alias("own"), restored(changes, s[start], s[end]).alias("at")))
    words = lambda x: original.substr(x["at"]["start"] + 1, x["at"]["end"] - x["at"]["start"])
    moved = F.transform(placed, lambda x: x["own"].withField(text, words(x)).withField(start, x["at"]["start"]).withField(end, x["at"]["end"]))
    return F.when(F.size(changes) > 0, moved).otherwise(found)
