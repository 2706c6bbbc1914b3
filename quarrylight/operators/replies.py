"""Elements of JSON that a model has written: damaged arrays are read element by element, cut ones keep what is whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens of chat formats that stray into replies, fences, quotes that stand for plain ones.
STRAY = re.compile(r"<\|[a-z_]+\|>|<\/?s>|<eos>|<\|im_end\|>", re.IGNORECASE)
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
PLAIN_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})
#: What the scan stops at, and what a quote that ends a string stands before.
STOPS, ENDS = re.compile(r'\\.|["\n\[\]{}]', re.DOTALL), re.compile(r"[ \t\r\n]*(?:[,:}\]]|\Z)")
BREAK = re.compile(r",\s*([}\]])")


def marks(text: str, start: int = 0) -> Iterator[tuple[int, str, bool]]:
    """(place, mark, inside) of quotes, brackets and line ends; ``inside`` tells whether a string holds the mark.

    A quote ends a string only before a comma, a colon, a closing bracket or the end of the text; others belong to it.
    """
    inside = False
    for m in STOPS.finditer(text, start):
        at, mark = m.start(), m[0]
        if len(mark) == 2:
            if inside:
                continue
            # Outside of strings a backslash is a character like any other.
            at, mark = at + 1, mark[1]
            if mark not in '"\n[]{}':
                continue
        if mark == '"':
            ends = inside and ENDS.match(text, at + 1) is not None
            yield at, mark, inside and not ends
            inside = not inside or not ends
        else:
            yield at, mark, inside


def objects(text: str) -> list[str]:
    """The objects that stand whole in the first array of a text; what follows the array is left alone."""
    found, depth, begin, start = [], 0, None, text.find("[")
    if start < 0:
        return found
    for at, mark, inside in marks(text, start):
        if inside or mark in '"\n':
            continue
        if mark in "[{":
            depth += 1
            if depth == 2 and mark == "{":
                begin = at
            continue
        depth -= 1
        if depth == 1 and mark == "}" and begin is not None:
            found.append(text[begin : at + 1])
            begin = None
        if depth == 0:
            break
    return found


def requoted(text: str) -> str:
    """``text`` with the quotes and line ends inside its strings escaped."""
    out, last = [], 0
    for at, mark, inside in marks(text):
        if inside and mark in '"\n':
            out += [text[last:at], '\\"' if mark == '"' else "\\n"]
            last = at + 1
    return "".join([*out, text[last:]])


def tidied(text: str) -> str:
    """``text`` with plain quotes and without commas before closing brackets."""
    return BREAK.sub(r"\1", text).translate(PLAIN_QUOTES)


def loaded(text: str) -> object | None:
    """The JSON value of a text, mended as little as will do; None if nothing helps."""
    for attempt in (text, tidied(text), requoted(text), tidied(requoted(text))):
        try:
            return json.loads(attempt)
        except (json.JSONDecodeError, RecursionError):
            continue
    return None


def elements(text: str | None) -> tuple[list[dict], int]:
    """(objects of an array that could be read, objects that could not), from the fence or the whole text that gives most."""
    text = STRAY.sub("", text or "")
    best: tuple[list[dict], int] = ([], 0)
    for part in [*(m[1] for m in FENCE.finditer(text)), text]:
        read = [loaded(x) for x in objects(part)]
        good = [x for x in read if isinstance(x, dict)]
        if len(good) > len(best[0]):
            best = (good, len(read) - len(good))
    return best


def first_value(text: str | None, expect: str = "any") -> object | None:
    """The first array or object of a text (``expect``: array, object or any), from a fence before the whole text.

    An object where an array is expected gives its first array, or stands for an array of itself; an array of one object
    where an object is expected gives that object. What stands behind the last closing bracket is left out.
    """
    for part in [*(m[1] for m in FENCE.finditer(text or "")), text or ""]:
        for opening in {"any": ("[{",), "array": ("[", "{"), "object": ("{", "[")}[expect]:
            value = _value_from(part, opening)
            if value is None:
                continue
            if expect == "array" and isinstance(value, dict):
                return next((v for v in value.values() if isinstance(v, list)), [value])
            if expect == "object" and isinstance(value, list):
                if len(value) == 1 and isinstance(value[0], dict):
                    return value[0]
                continue
            return value
    return None


def _value_from(text: str, first: str) -> object | None:
    """The JSON value that the first of these brackets opens, whatever stands behind its last closing bracket."""
    starts = [k for k in map(text.find, first) if k >= 0]
    whole = text[min(starts) :].strip() if starts else ""
    for attempt in (whole, tidied(whole)):
        for end in (len(attempt), max(attempt.rfind("]"), attempt.rfind("}")) + 1):
            try:
                return json.loads(attempt[:end])
            except (json.JSONDecodeError, RecursionError):
                continue
    return None


def written(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [elements(t) for t in batch.column("__reply").to_pylist()]
        kept = pa.array([[written(x) for x in good] for good, _ in found], pa.list_(pa.string()))
        rest = [n for n in batch.schema.names if n != "__reply"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), kept, pa.array([bad for _, bad in found], pa.int32())], names=[*rest, "elements", "dropped"])


def reply_elements(df: DataFrame, reply: str) -> DataFrame:
    """``df`` with elements: the objects of each reply's array as JSON texts, and dropped: how many could not be read.

    Fences, stray tokens, trailing commas, quotes and line ends inside strings do no harm; of an array that was cut, the
    whole elements stay. A null reply has no elements. Rows are read where they are, by a scan that passes over a text
    once for each fence; columns named elements and dropped are replaced.
    """
    own = df.drop("elements", "dropped").withColumn("__reply", F.col(reply).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "__reply")
    return own.mapInArrow(_read, f"{schema}, elements array<string>, dropped int")


def element_rows(df: DataFrame, schema: str) -> DataFrame:
    """A row for each element of ``reply_elements``, with its place and its fields by ``schema``; unfit fields are null."""
    return df.select("*", F.posexplode("elements").alias("place", "element")).withColumn("fields", F.from_json("element", schema)).drop("elements", "element")

