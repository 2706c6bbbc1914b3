"""Conversation repair: the search against every repair there is, the whole operator against a plain version."""

import functools
import hashlib
import random
import re
import zlib

from quarrylight.llm import repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
SPACE = " \t\n\x0b\x0c\r"


def every_repair(codes):
    """Least (cost, audit), row by row; more than three inserts in a row never pay."""

    @functools.cache
    def best(i, state, inserts):
        found = [(0, "")] if i == len(codes) and state in ("", "a") else []
        steps = [("I", 5, i, NEXT[state, r], inserts + 1) for r in "ua" if (state, r) in NEXT and inserts < 3]
        if i < len(codes):
            own, more = codes[i].lower(), 5 if codes[i].isupper() else 0
            steps.append(("D", 2, i + 1, state, 0))
            if own != "-":
                steps += [("K", more, i + 1, NEXT[state, own], 0)] if (state, own) in NEXT else []
                steps += [("R", 1 + more, i + 1, NEXT[state, r], 0) for r in "ua" if (state, r) in NEXT]
        for letter, cost, *node in steps:
            if rest := best(*node):
                found.append((cost + rest[0], letter + rest[1]))
        return min(found, default=None)

    return best(0, "", 0)


def test_cheapest_repair():
    random.seed(7)
    for _ in range(4000):
        codes = "".join(random.choice("suaxSUAX-uauaua") for _ in range(random.randint(0, 13)))
        assert repair.cheapest_repair(codes) == every_repair(codes)
    assert repair.cheapest_repair("") == (0, "") and repair.cheapest_repair("su") == (2, "RR") and repair.cheapest_repair("sa") == (1, "RK")


def test_long_conversation():
    cost, audit = repair.cheapest_repair("s" + "ua" * 20_000)
    assert cost == 0 and audit == "K" * 40_001
    cost, audit = repair.cheapest_repair("-" * 5_000 + "ua")
    assert cost == 10_000 and audit == "D" * 5_000 + "KK"


def plainly(rows):
    out, by = {}, {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = by.setdefault(conv, [])
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        role = "user" if deal == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(deal, 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, codes, faults = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = every_repair(codes)
        lines, rest, state = [], iter(own), ""
        for edit in audit:
            _, role, text = next(rest) if edit != "I" else (None, "", "")
            if edit != "D":
                state = role[:1] if edit == "K" else next(r for r in "ua" if (state, r) in NEXT)
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_whole_operator(spark):
    random.seed(3)
    texts = ["Yes.", "No", "why?", "", " \n", None, "Über ☃!", "a. b", "x" * 200_000 + "."]
    rows = [(c, t, random.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), random.choice(texts)) for c in range(120) for t in range(random.randint(1, 7))]
    rows += rows[:60] + [(None, None, "user", "hi."), (None, 3, "assistant", "ok."), (None, None, "user", "hi."), (500, None, None, None), (501, -4, "user", "a."), (501, 9, "assistant", "b.")]
    rows += [(600, k % 3, "user", "same text.") for k in range(60)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, print string").repartition(5)
    got = repair.repair_conversations(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plainly(rows) and len(got) == len({r[0] for r in rows})
    assert repair.repair_conversations(df.where("false")).collect() == []
