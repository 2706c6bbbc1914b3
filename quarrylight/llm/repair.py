"""Repair of conversation structure by a bidirectional Dijkstra search over the lattice of edits.

A lattice node is (rows read, state); a state is what the kept roles end in. Keep, Rerole and Delete read a row, Insert
does not. The audit of a repair is the initials of its edits in order. Among cheapest repairs the least audit is taken;
codes and audit together determine every role, so it stands for one repair.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import map_texts

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: State after reading a role's initial: 0 nothing kept, 1 system, 2 user, 3 assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ACCEPTED = (0, 3)
LEGAL_PAIRS = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
#: Code of a row that only Delete may read. Other rows have their initial (x: none of s, u, a), in upper case if truncated.
MUST_GO = "-"
SPACES = " \t\n\x0b\x0c\r"
KNOWN_CODES = 50_000


class Path:
    """A list of edits that shares its far end with other lists; ``letter`` is the edit next to the node."""

    __slots__ = ("length", "letter", "rest")

    def __init__(self, letter: str, rest: Path | None) -> None:
        self.letter, self.rest, self.length = letter, rest, 1 + (rest.length if rest else 0)

    def letters(self) -> list[str]:
        at, out = self, []
        while at:
            out.append(at.letter)
            at = at.rest
        return out


def _earlier_before(p: Path, q: Path) -> bool:
    """Whether ``p`` is the lesser of two lists that run back from one node: the first letters after they part decide.

    Lists of one cost at one node are never prefixes of each other, as what one has more would be inserts, which cost.
    """
    a, b = [], []
    while p is not q:
        ahead = (p.length if p else 0) - (q.length if q else 0)
        if ahead >= 0:
            a.append(p.letter)
            p = p.rest
        if ahead <= 0:
            b.append(q.letter)
            q = q.rest
    return a[::-1] < b[::-1]


def _earlier_after(p: Path, q: Path) -> bool:
    """Whether ``p`` is the lesser of two lists that run on from one node."""
    while p is not q:
        if p.letter != q.letter:
            return p.letter < q.letter
        p, q = p.rest, q.rest
    return False


def edits_from(codes: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """(edit, cost, node reached) from ``node``."""
    at, state = node
    for role in "ua":
        if (state, role) in NEXT:
            yield "I", INSERT, (at, NEXT[state, role])
    if at < len(codes):
        yield from _readings(codes[at], at + 1, state, False)


def edits_to(codes: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """(edit, cost, node left) of the edits that reach ``node``."""
    at, state = node
    for (before, role), after in NEXT.items():
        if after == state and role in ROLES:
            yield "I", INSERT, (at, before)
    if at:
        yield from _readings(codes[at - 1], at - 1, state, True)


def _readings(code: str, at: int, state: int, back: bool) -> Iterator[tuple[str, int, tuple[int, int]]]:
    yield "D", DELETE, (at, state)
    if code == MUST_GO:
        return
    own, more = code.lower(), TRUNCATED if code.isupper() else 0
    for (before, role), after in NEXT.items():
        if state == (after if back else before):
            far = before if back else after
            if role == own:
                yield "K", more, (at, far)
            elif role in ROLES:
                yield "R", REROLE + more, (at, far)


class Side:
    """One of the two searches: labels by node, those that are final, and the heap."""

    def __init__(self, starts: list[tuple[int, int]], edits, earlier, order: int) -> None:
        self.edits, self.earlier, self.order = edits, earlier, order
        self.labels: dict[tuple[int, int], tuple[int, Path | None]] = {node: (0, None) for node in starts}
        self.final: set[tuple[int, int]] = set()
        # Edits that cost nothing read a row: among nodes of one cost, those that come first on their side are final first.
        self.heap = [(0, order * node[0], node) for node in starts]
        heapq.heapify(self.heap)

    def top(self) -> float:
        while self.heap and self.heap[0][2] in self.final:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, codes: str, other: Side) -> float:
        """Make the cheapest node final; returns the cheapest whole repair that its edits complete."""
        cost, _, node = heapq.heappop(self.heap)
        self.final.add(node)
        path, least = self.labels[node][1], float("inf")
        for letter, more, far in self.edits(codes, node):
            if far not in self.final:
                total, known = cost + more, self.labels.get(far)
                if known is None or total < known[0]:
                    self.labels[far] = (total, Path(letter, path))
                    heapq.heappush(self.heap, (total, self.order * far[0], far))
                elif total == known[0] and self.earlier(found := Path(letter, path), known[1]):
                    self.labels[far] = (total, found)
                if far in other.labels:
                    least = min(least, self.labels[far][0] + other.labels[far][0])
        return least


@functools.lru_cache(maxsize=KNOWN_CODES)
def cheapest_repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation with these row codes, ties to the least audit.

    Both searches go on until no repair of the least cost can have an edit that neither has seen. All nodes below the
    forward heap's top are then final on that side, and every cheapest repair crosses that line by exactly one edit,
    whose far end is final on the other side; or it lies wholly below the line.
    """
    end = len(codes)
    ahead = Side([(0, 0)], edits_from, _earlier_before, 1)
    behind = Side([(end, state) for state in ACCEPTED], edits_to, _earlier_after, -1)
    least: float = 0 if end == 0 else float("inf")
    while ahead.top() + behind.top() <= least:
        side, other = (ahead, behind) if ahead.top() <= behind.top() else (behind, ahead)
        least = min(least, side.settle(codes, other))
    line, cost = ahead.top(), int(least)
    text = lambda path: "".join(path.letters()) if path else ""
    if line > cost:
        return cost, min(text(ahead.labels[end, s][1])[::-1] for s in ACCEPTED if ahead.labels.get((end, s), (None,))[0] == cost)
    audits = []
    for node in ahead.final:
        before, path = ahead.labels[node]
        if before < line:
            for letter, more, far in edits_from(codes, node):
                if before + more >= line and far in behind.final and before + more + behind.labels[far][0] == cost:
                    audits.append(text(path)[::-1] + letter + text(behind.labels[far][1]))
    return cost, min(audits)


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the damage that the CRC-32 of ``conv_id:turn`` deals, and ``gone``.

    Nulls count as one space. Dropped rows stay, marked ``gone`` and without role and text, so that no conversation is lost.
    """
    deal = (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20).alias("deal")
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    dealt = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), deal)
    gone = F.col("deal") == 0
    return dealt.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("deal") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def ordered(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of a conversation next to each other, by turn, then role and the text's hash; columns may go before and after."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col(first).asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "print", last)


def row_codes(rows: DataFrame) -> DataFrame:
    """Each row's fault and code: (conv_id, turn, role, print, fault, code); texts are told apart by their SHA-256.

    A row is a duplicate if it isn't the first with its role and text. The groups of that count are (conversation, role,
    text), so a large conversation is dealt out.
    """
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    facts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("print"), "gone", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "print").orderBy(F.col("turn").asc_nulls_first()))
    numbered = facts.withColumn("nth", nth)
    initial = F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("x")
    fault = F.when(F.col("gone"), "gone").when(F.col("blank"), "blank").when(F.col("nth") > 1, "duplicate").when(F.col("open"), "truncated").otherwise("none")
    code = F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(initial)).otherwise(initial)
    return numbered.select("conv_id", "turn", "role", "print", "nth", fault.alias("fault"), code.alias("code"), F.substring("role", 1, 1).alias("initial"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) in the order in which they come; a conversation is never held whole."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    yield from itertools.groupby(rows, key=lambda row: row[0])


def _packed(batches: Iterator[pa.RecordBatch], function, texts: list[str], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """What ``function`` finds in ``batches``: the conversation, COUNTS and ``texts``."""
    if (first := next(batches, None)) is None:
        return
    schema = pa.schema([first.schema.field(0), *((c, pa.int64()) for c in COUNTS), *((c, pa.string()) for c in texts)])
    rows = function(itertools.chain([first], batches))
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in _conversations(batches):
            codes, faults, turns, illegal, low, high, before = [], dict.fromkeys(COUNTS[1:4], 0), 0, 0, None, None, None
            for _, turn, initial, fault, code in rows:
                if fault == "gone":
                    continue
                if fault in faults:
                    faults[fault] += 1
                if turn is not None:
                    low = turn if low is None else low
                    turns += turn != high
                    high = turn
                illegal += before is not None and before + initial not in LEGAL_PAIRS
                before = initial
                codes.append(code)
            gaps = high - low + 1 - turns if turns else 0
            yield conv, gaps, *faults.values(), illegal, *cheapest_repair("".join(codes))

    yield from _packed(batches, found, ["audit"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in _conversations(batches):
            facts = next(rows)[1:8]
            sha, lines = hashlib.sha256(), repaired_lines(facts[-1], ((r[8], r[9]) for r in rows))
            for k, (role, text) in enumerate(lines):
                sha.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            yield conv, *facts, sha.hexdigest()

    yield from _packed(batches, found, ["audit", "repaired_sha256"])


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation: the edits of ``audit`` applied to its rows in order."""
    state = 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
        state = NEXT[state, initial]
        yield (role if edit == "K" else ROLES[initial]), text


def audits(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (as ``damaged`` gives them): conv_id, COUNTS and the least cheapest audit."""
    codes = ordered(row_codes(rows), "turn", "nth").select("conv_id", "turn", "initial", "fault", "code")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return codes.mapInArrow(_audit, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: faults after damage, the cheapest repair and the repaired rows' hash.

    Rows whose conv_id is null are one conversation. Nulls in role and text count as one space, in turn they sort first;
    rows of one turn go by role and text. A role that begins with none of s, u, a (the empty one too) can't be kept.
    Repeated rows are duplicates, extra columns are ignored, an empty table gives an empty result. A conversation
    passes its task row by row: its codes (a letter a row) and its audit are held, its texts are not.
    """
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    facts = audits(rows)
    nothing = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    texts = rows.where(~F.col("gone")).select("conv_id", *nothing, F.lit(None).cast("string").alias("audit"), "role", "text", "turn", F.unhex(F.sha2("text", 256)).alias("print"), F.lit(1).alias("part"))
    heads = facts.select("conv_id", *COUNTS, "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("turn", rows.schema["turn"].dataType), ("print", "binary"))), F.lit(0).alias("part"))
    stream = ordered(heads.unionByName(texts), "part", "print").select("conv_id", *COUNTS, "audit", "role", "text")
    return map_texts(stream, _digest, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
