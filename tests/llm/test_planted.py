"""Secrets planted in a table of plain documents: each is found where it was put, and nothing else is."""

import base64
import json
import random

from quarrylight.llm import secrets


def der(n):
    body = bytes([2, 1, 0]) + b"".join(bytes([2, 8]) + bytes(range(k, k + 8)) for k in range(n))
    return bytes([0x30, 0x81, len(body)]) + body


def test_planted_keys(spark):
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    part = lambda v: base64.urlsafe_b64encode(json.dumps(v).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1', 'iat': 2})}.{'Ab3_' * 11}"
    planted = {7: base64.b64encode(der(18)).decode(), 11: token, 13: der(18).hex()}
    rows = [(i, prose(80), "en", "s", 0) for i in range(20)]
    rows = [(i, f"{t[:200]} {planted[i]} {t[200:]}" if i in planted else t, *rest) for i, t, *rest in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    for i, text, *_ in rows:
        spans = [s.split(":") for s in found[i].spans.split(",") if s]
        assert bool(spans) == (i in planted), i
        if i in planted:
            start = text.index(planted[i])
            assert any(int(a) <= start + 8 and int(b) >= start + len(planted[i]) - 4 for _, a, b in spans), (i, spans)
    kept = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert all((planted[i][10:40] not in kept[i]) and "[SECRET]" in kept[i] for i in planted) and all(kept[i] == t for i, t, *_ in rows if i not in planted)
