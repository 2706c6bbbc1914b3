"""Regex matches with code-point offsets, from built-in functions: matches and the gaps between them."""

from __future__ import annotations

import functools
import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iU)"
#: Characters of a match's beginning that are held against a text's words, and what parts these in ``beginnings``.
LOOK, PART = 6, "\x01"
CLASSES = {"CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w", "CATEGORY_SPACE": r"\s"}
#: ASCII letters of each kind and, of some letters, what equals them but for case. Java tells a listed ASCII letter by one
#: look in a table, a range or one of Unicode's kinds by a chain of calls: so the looks before a pattern list their letters.
KINDS = {r"\d": string.digits, r"\w": string.ascii_letters + string.digits + "_", r"\s": " \t\n\v\f\r"}
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
BEYOND = r"\x{80}-\x{10FFFF}"
LETTERS = f"[{KINDS[r'\w']}]"

Heads = set[tuple[tuple[str, ...], bool]]


def _heads(items, depth: int, inside: bool = False) -> Heads:
    """What matches of a parsed pattern begin with: a piece for each character or edge, and whether what follows may go on from there."""
    found = {((), True)}
    for op, arg in items:
        longer = set()
        for head, goes_on in found:
            if goes_on and len(head) < depth:
                longer |= {(head + more, on) for more, on in _head(str(op), arg, depth - len(head), inside or bool(head))}
            else:
                longer.add((head, False))
        found = longer
    return found


def _head(op: str, arg, depth: int, inside: bool) -> Heads:
    if op == "LITERAL":
        return {((re.escape(chr(arg)),), True)}
    if op == "AT" and str(arg) == "AT_BOUNDARY" and inside:
        return {((r"\b",), True)}
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {((), True)}
    if op == "SUBPATTERN" and not arg[1] and not arg[2]:
        return _heads(arg[3], depth, inside)
    if op == "BRANCH":
        return set().union(*(_heads(branch, depth, inside) for branch in arg[1]))
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, body = arg
        own = {(head, on and most == 1) for head, on in _heads(body, depth, inside)}
        return own if least else own | {((), True)}
    if op == "IN":
        kinds = [(str(kind), str(value)) if str(kind) == "CATEGORY" else (str(kind), value) for kind, value in arg]
        if all(k in ("LITERAL", "RANGE") or (k == "CATEGORY" and v in CLASSES) for k, v in kinds):
            piece = lambda k, v: re.escape(chr(v)) if k == "LITERAL" else CLASSES[v] if k == "CATEGORY" else f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}"
            return {((piece(k, v),), True) for k, v in kinds}
    return {((), False)}


def _edged(items) -> bool:
    """Whether matches of a parsed pattern stand at a word's edge."""
    for op, arg in items:
        if str(op) == "AT":
            return str(arg) == "AT_BOUNDARY"
        if str(op) == "SUBPATTERN":
            return _edged(arg[3])
        if str(op) == "ASSERT_NOT":
            # No letter before, of those that make words: an edge, if the match begins with such a letter.
            return arg[0] < 0 and str(arg[1][0][0]) == "IN" and any(str(v) == "CATEGORY_WORD" for _, v in arg[1][0][1]) and all(head and (head[0] in (r"\d", r"\w") or head[0].isalnum()) for head, _ in _heads(items, 1))
        return str(op) == "BRANCH" and all(map(_edged, arg[1]))
    return False


def _explicit(piece: str) -> tuple[str, str]:
    """What a piece of a beginning may be, as classes without flags: of ASCII letters in both cases, and of others; either may hold too much."""
    if piece in KINDS:
        return KINDS[piece], BEYOND
    letter = piece.removeprefix("\\")
    if len(letter) > 1:
        return KINDS[r"\w"], BEYOND
    return ("".join(sorted({letter.lower(), letter.upper()})) if letter.isascii() else ""), FOLDED.get(letter.lower(), "") if letter.isascii() else letter


def _class(letters: str) -> str:
    return "[" + "".join(rf"\{x}" if not x.isalnum() and x.isascii() and x.isprintable() else x for x in sorted(set(letters))) + "]"


def _chosen(options: list[tuple[str, str]]) -> str:
    """An alternation of (ASCII letters, what follows); many are halved behind a look at the letter."""
    if len(options) <= 3:
        return "|".join(_class(own) + rest for own, rest in options)
    halves = options[: len(options) // 2], options[len(options) // 2 :]
    return "|".join(f"(?={_class(''.join(own for own, _ in half))})(?:{_chosen(half)})" for half in halves)


def _any_of(heads: set[tuple[str, ...]], behind: str = "") -> str:
    """A pattern without flags for what may be any of the beginnings, read piece by piece; pieces with the same continuation share a class.

    ``behind`` is the piece before: at an edge behind a letter none follows.
    """
    if () in heads:
        return ""
    after, plain, others = {}, {}, {}
    for head in heads:
        after.setdefault(head[0].lower() if len(head[0]) == 1 else head[0], set()).add(head[1:])
    edge = after.pop(r"\b", None)
    for piece, rest in after.items():
        own, other = _explicit(piece)
        follows = _any_of(rest, piece)
        plain[follows] = plain.get(follows, "") + own
        others[follows] = others.get(follows, "") + other
    found = [_chosen(sorted((own, rest) for rest, own in plain.items() if own))] if any(plain.values()) else []
    if edge is not None:
        found.append((f"(?!{LETTERS})" if _lettered(behind) else "") + _any_of(edge))
    if any(others.values()):
        found.append(f"(?=[{BEYOND}])(?:" + "|".join(f"[{own}]{rest}" for rest, own in sorted(others.items()) if own) + ")")
    return f"(?:{'|'.join(found)})"


def _lettered(piece: str) -> bool:
    return piece in (r"\d", r"\w") or piece.isalnum()


@functools.cache
def begins(pattern: str) -> frozenset[tuple[str, ...]]:
    """What a pattern's matches begin with at a word's edge; empty if they may stand elsewhere or begin with anything."""
    try:
        parsed = re._parser.parse(pattern)
    except re.error:
        return frozenset()
    heads = frozenset(head for head, _ in _heads(parsed, LOOK)) if _edged(parsed) else frozenset()
    return heads if all(head and _lettered(head[0]) for head in heads) else frozenset()


def _may_begin(heads: set[tuple[str, ...]]) -> str:
    """A look, without flags, at whether any of the beginnings may stand here at a word's edge."""
    return rf"\b(?={_any_of(heads)})"


@functools.cache
def quick(pattern: str, flags: str = FLAGS) -> str:
    """A pattern with its flags and the same matches: one at a word's edge first looks at the letters that may follow there."""
    heads = begins(pattern)
    if not heads:
        return flags + pattern
    return _may_begin(set(heads)) + flags + pattern


def beginnings(text: Column, patterns: list[str]) -> Column:
    """One string of all places of a text where a match of one of many patterns could begin, for ``may_match``.

    A text is read once for all patterns instead of once for each, most of which it doesn't hold.
    """
    heads = set().union(*map(begins, patterns))
    found = F.regexp_extract_all(text, F.lit(rf"{_may_begin(heads)}(?=([\s\S]{{1,{LOOK}}}))"), 1)
    return F.concat(F.lit(PART), F.array_join(F.array_distinct(found), PART))


def parted(text: Column, regex: str) -> Column:
    """What stands between the matches of a pattern, as ``split`` gives it without a limit.

    ``split`` compiles its pattern for every text, which costs more than the search; ``regexp_replace`` keeps it, and to
    split at one plain character no pattern is compiled. That character in a text stands for another that no rule names.
    """
    own = F.when(F.contains(text, F.lit(PART)), F.translate(text, PART, "\x02")).otherwise(text)
    return F.split(F.regexp_replace(own, regex, PART), PART, -1)


def may_match(begun: Column | None, pattern: str) -> Column:
    """Whether a text with these ``beginnings`` may hold a match of one of their patterns; never false where it does."""
    heads = begins(pattern)
    return F.lit(True) if begun is None or not heads else begun.rlike(PART + _any_of(set(heads)))


#: Matches that one inner fold takes; a fold copies its array at every step, so long lists are folded in two levels.
CHUNK = 64


def matches(text: Column, pattern: str, begun: Column | None = None) -> Column:
    """array<struct<text,start,end>> of a pattern's matches, leftmost and non-overlapping; ends are exclusive.

    ``begun`` are the text's ``beginnings``, where they have been found already.
    """
    regex = quick(pattern)
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(pair["hit"].alias("text"), start.alias("start"), end.alias("end")))).alias("out"))

    def chunk(state: Column, pairs: Column) -> Column:
        inner = F.array(F.aggregate(pairs, F.struct(state["at"].alias("at"), empty.alias("out")), step))
        return F.get(F.transform(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], x["out"]).alias("out"))), F.lit(0))

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(parted(text, regex), F.lit(1), F.size(found)), F.length)
        pairs = F.array(F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))))
        cut = F.flatten(F.transform(pairs, lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int")), lambda k: F.slice(own, k * CHUNK + 1, F.lit(CHUNK)))))
        return F.aggregate(cut, F.struct(F.lit(0).alias("at"), empty.alias("out")), chunk, lambda s: s["out"])

    # Bound to a lambda's variable, the hits are sought once; a text without any is not split.
    hits = F.array(F.regexp_extract_all(text, F.lit(regex), 0))
    sought = F.get(F.transform(hits, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(empty)), F.lit(0))
    return sought if begun is None else F.when(may_match(begun, pattern), sought).otherwise(empty)


def hit(text: Column, pattern: str, begun: Column | None = None) -> Column:
    return text.rlike(quick(pattern)) if begun is None else may_match(begun, pattern) & text.rlike(quick(pattern))


def first_start(text: Column, pattern: str, begun: Column | None = None) -> Column:
    """Where a pattern's first match starts; null without one."""
    return F.when(hit(text, pattern, begun), F.length(F.get(parted(text, quick(pattern)), F.lit(0))))


def first_match(text: Column, pattern: str, begun: Column | None = None) -> Column:
    """struct<text,start,end> of a pattern's first match, the text trimmed and the offsets not; null without one."""
    regex = quick(pattern)
    found = F.regexp_extract(text, regex, 0)
    start = F.length(F.get(parted(text, regex), F.lit(0)))
    return F.when(hit(text, pattern, begun), F.struct(F.trim(found).alias("text"), start.alias("start"), (start + F.length(found)).alias("end")))


def around(text: Column, start: Column, end: Column, reach: int) -> Column:
    """What stands within ``reach`` characters of a span, the span included."""
    first = F.greatest(start - reach, F.lit(0))
    return text.substr(first + 1, end + reach - first)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def first_of(spans: Column, roles: tuple[str, ...]) -> Column:
    """The span of the highest score among ``roles``, the first of equals; null without one."""
    own = F.filter(spans, lambda s: s["role"].isin(*roles))
    best = F.array_max(F.transform(own, lambda s: s["score"]))
    return F.get(F.filter(own, lambda s: s["score"] == best), F.lit(0))
