"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import decontaminate, language, minhash, ngrams, packing, secrets, sharding, substrings, suffixes, tokenfile, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, rank int"


def docs(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    vocab = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    base, passage = prose(150), prose(40)
    rows = [(i, prose(random.randint(20, 120))) for i in range(60)]
    rows += [(100 + i, base) for i in range(8)]
    for i in range(25):
        w = base.split()
        for _ in range(i // 2):
            w[random.randrange(len(w))] = random.choice(vocab)
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{prose(10)} {passage} {prose(10)}") for i in range(10)]
    rows += [(400, None), (401, ""), (402, "one"), (403, "one"), (404, "two words"), (405, "Ünïcode ☃ " * 30), (406, prose(3000)), (407, "aaaa" * 100)]
    return rows


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, m in zip(b, gone, strict=True) if not m)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limit", [4096, 3])
def test_repeated_strings(spark, texts, limit):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs(spark, texts), limit).collect()}
    assert got == removed(texts)


def test_suffix_order():
    random.seed(1)
    for _ in range(800):
        s = [random.randint(0, random.randint(1, 4)) for _ in range(random.randint(0, 30))]
        assert suffixes.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_encoder_equals_library():
    random.seed(2)
    own = tokens.encoder()
    parts = [*"aB1 '́é\x85İΣς٣–.,\x1f\x0b ﻿ﬁ漢🙂K", "<|endoftext|>", "'s", "'LL"]
    for _ in range(1500):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert list(own.encode(t)) == own.tokenizer.encode(t, add_special_tokens=False).ids


def ids_of(text):
    return [*tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, texts):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.path) for r in tokenfile.token_file_digest(docs(spark, texts)).collect()}
    at = 0
    for i, t in sorted(texts):
        ids = ids_of(t)
        assert got[i][:3] == (at, len(ids), crc(ids))
        at += len(ids)
    path = got[100][3]
    own = sorted(i for i in got if got[i][3] == path)
    assert list(tokenfile.documents_in(path, [own.index(100)])[0]) == ids_of(dict(texts)[100])


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(230)] + [(i, [0.5] * 8) for i in range(300, 340)]
    rows += [(500, None), (501, [1.0, float("nan")] * 4), (502, [None] * 8), (503, [1.0, 2.0]), (600, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    own = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if i < 500}
    for q in (0, 100, 200, 300):
        want = sorted(((sum(a * b for a, b in zip(own[q], v, strict=True)), -i) for i, v in own.items() if i != q), reverse=True)[:10]
        assert got[q] == [(-i, s) for s, i in want]
    assert set(got) == {0, 100, 200, 300}


def test_top_k_broadcasts_no_queries_and_meets_all_cells(spark, monkeypatch):
    """However small they look before they are dealt, queries go to the candidate blocks by a shuffle, few to a task."""
    rng = np.random.default_rng(9)
    vectors = {i: [float(x) for x in rng.integers(-3, 4, 4)] for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "QUERIES_PER_CELL", 3, raising=False)
    found = topk.top_k(df, df.where("vec_id % 3 = 0"), k=4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 300, 3):
        want = sorted((-sum(1024 * 1024 * int(a) * int(b) for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)[:4]
        assert got[q] == [(i, -s) for s, i in want]
    assert len(got) == 100


def test_toxicity_held_out():
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    rows = [(" ".join([word() for _ in range(40)] + (["idiotic"] if k % 5 == 0 else [])), int(k % 5 == 0)) for k in range(1200)]
    model = toxicity.fit(rows[:900], 0.2)
    score = toxicity.score_texts(model, [t for t, _ in rows[900:]] + [None, ""])
    truth = np.array([y for _, y in rows[900:]])
    assert ((score[:-2] >= 0.3) == truth).mean() > 0.98 and (score[-2:] < 0.3).all() and ((score >= 0) & (score <= 1)).all()


def test_sample_passes_over_a_long_text(spark):
    rows = docs(spark, [(i, "x" * 10) for i in range(6)])
    first = rows.selectExpr("doc_id").orderBy(F.xxhash64("doc_id")).first().doc_id
    rows = docs(spark, [(i, "x" * (101 if i == first else 10)) for i in range(6)])
    assert [t for t, _ in ngrams.labelled_texts(rows, rows.select("doc_id", "lang"), "lang", 10, 100)] == ["x" * 10] * 5


def test_clean_is_what_is_not_predicted_toxic(spark):
    slot = np.full(len(toxicity.ORDERS) << toxicity.BITS, -1, np.int32)
    for share in (0.2, 0.4, 0.6):
        model = toxicity.Model(slot, np.zeros(1), float(np.log(share / (1 - share))))
        rows = docs(spark, [(1, "some text"), (2, None)])
        clean = toxicity.score_documents(rows, model).where("predicted = 0").count()
        assert toxicity.keep_clean(rows, model).count() == clean == (2 if share < 0.3 else 0)


def test_language_held_out(spark):
    random.seed(6)
    make = {"x": "abcde", "y": "fghij", "z": "aeiou"}
    rows = [(" ".join("".join(random.choice(make[k]) for _ in range(5)) for _ in range(30)), k) for k in make for _ in range(60)]
    random.shuffle(rows)
    model = language.fit(rows[:120])
    langs, scores = language.predict(model, [*(t for t, _ in rows[120:]), None, "", "123 !!"])
    assert [*langs[:-3]] == [k for _, k in rows[120:]] and langs[-3:] == ["und"] * 3 and all(0 <= s <= 1 for s in scores)
    out = language.identify(docs(spark, [(1, "abc"), (2, None)]), model).collect()
    assert {r.doc_id: r.lang_pred for r in out}[2] == "und"


def test_shards(spark, texts):
    rows = [*texts, (100, dict(texts)[100])]
    got = sharding.shard_documents(docs(spark, rows), 4).collect()
    assert len(got) == len(rows)
    slots, by_text, loads = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        by_text[(r.text_crc32, r.size)].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in by_text.values())
    assert max(loads.values()) < 1.6 * sum(loads.values()) / 4


def test_bulk_heap_equals_heap():
    import heapq

    random.seed(7)
    for _ in range(60):
        classes = {random.randint(1, 60): random.choice([1, 2, 50, 400]) for _ in range(6)}
        plan = sharding.heap_plan([(w, n, w * n) for w, n in classes.items()], 4)
        heap = [(0.0, s) for s in range(4)]
        want = {w: [0] * 4 for w in classes}
        for w in sorted(classes, reverse=True):
            for _ in range(classes[w]):
                load, s = heap[0]
                want[w][s] += 1
                heapq.heapreplace(heap, (load + w, s))
        assert {w: sorted(v) for w, v in plan.items()} == {w: sorted(v) for w, v in want.items()}


def test_secrets(spark):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.abcDEF"
    torn = bytes([0x30, 0x1F, 2, 1, 0]) + bytes([2, 1, 5]) * 9
    key = base64.b64encode(bytes([0x30, 30]) + bytes([2, 1, 0]) + bytes([2, 1, 5]) * 9).decode()
    assert not secrets.is_private_der(torn) and secrets.is_private_der(base64.b64decode(key))
    text = f"é password = 'abcdef12' AKIA{'A1' * 8} {'0123456789abcdef' * 2} {token} -----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
    spans = secrets.base_spans(text) + secrets.structural_spans(text)
    assert collections.Counter(k for _, _, k in spans) == {"assign": 1, "access": 1, "hex": 1, "jwt": 1, "pem": 1}
    assert [text[s:e] for s, e, k in spans if k == "jwt"] == [token]
    assert secrets.base_spans("secret=token: abcdefgh") == []
    assert secrets.structural_spans("abcdefgh.ijklmnop.qrst " + "Q" * 64) == []
    out = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, [(1, text), (2, None), (3, ""), (1, text)])).collect()}
    assert out[2].spans == out[3].spans == "" and out[1].n_confirmed == 2
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs(spark, [(1, text), (2, None), (3, "plain")])).collect()}
    assert token not in clean[1] and clean[2] is None and clean[3] == "plain"


def test_secret_forms(spark):
    """Forms around a key or token that hide it from a plain pattern: each is found, and nothing of it is left."""
    part = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    der = bytes([0x30, 0x81, 165]) + bytes([2, 1, 0]) + bytes([2, 18]) + bytes(range(1, 19)) + b"".join(bytes([2, 16]) + bytes(range(k, k + 16)) for k in range(1, 8))
    der = der + bytes([2, 165 + 3 - len(der) - 2]) + bytes(range(1, 165 + 3 - len(der) - 1))
    key = base64.b64encode(der).decode()
    assert secrets.is_private_der(der) and key.startswith("M") and len(key) > 64
    lines = [key[k : k + 64] for k in range(0, len(key), 64)]
    armour = lambda kind, end, head=(): end.join([f"-----BEGIN {kind}PRIVATE KEY-----", *head, *lines, f"-----END {kind}PRIVATE KEY-----"])
    sealed = ("Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", "")
    claims = part('{"sub": 1}')
    token = f"{part('{"alg": "HS256"}')}.{claims}.abcDEF"
    forms = {
        "after an equals sign": (f"PRIVATE_KEY={key} x", key, "der"), "after padding": (f"{'A' * 50}=={key}", key, "der"), "after a colon": (f"PRIVATE_KEY: {key}", key, "der"),
        "encrypted": (f"a {armour('RSA ', chr(10), sealed)} b", armour("RSA ", "\n", sealed), "pem"), "encrypted, line ends lost": (armour("EC ", " ", sealed), armour("EC ", " ", sealed), "pem"),
        "escaped": (json.dumps({"private_key": armour("", "\n") + "\n"}), armour("", "\\n"), "pem"), "escaped twice": (json.dumps(json.dumps({"k": armour("", "\n")})), armour("", "\\\\n"), "pem"),
        "escaped return": (f"k='{armour('', chr(92) + 'r' + chr(92) + 'n')}'", armour("", "\\r\\n"), "pem"), "encrypted, escaped": (json.dumps(armour("RSA ", "\n", sealed)), armour("RSA ", "\\n", sealed), "pem"),
        "after a dotted word": (f"session_jwt.{token}", token, "jwt"), "after two": (f"some.long_enough.{token} end", token, "jwt"),
    }
    for k, head in enumerate(('{\r\n"alg":"HS256"}', '{\t"alg":"HS256"}', ' {"alg":"HS256"}', '\n{"alg":"HS256"}', '{ "alg":"HS256"}')):
        own = f"{part(head)}.{claims}.sig"
        forms[f"header {k}"] = (f"x {own} y", own, "jwt")
    for name, (text, secret, kind) in forms.items():
        assert [(text[s:e], k) for s, e, k in secrets.structural_spans(text) if k == kind] == [(secret, kind)], name
    for text in (f"{'A' * 60}={'B' * 60}", "Proc-Type: 4,ENCRYPTED", "-----BEGIN PRIVATE KEY-----\\nnot-a-key\\n-----END PRIVATE KEY-----", f"some_word.{claims}.{claims}.sig"):
        assert secrets.structural_spans(text) == [], text
    rows = list(enumerate(forms.values()))
    found = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, [(i, t) for i, (t, *_) in rows])).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs(spark, [(i, t) for i, (t, *_) in rows])).collect()}
    for i, (text, secret, kind) in rows:
        assert found[i].n_confirmed >= 1 and f"{kind}:{text.index(secret)}:{text.index(secret) + len(secret)}" in found[i].spans.split(",")
        assert secret not in clean[i] and "[SECRET]" in clean[i]


def shingles(text, n):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("words", "percent", "small"), [(3, 85, 16), (5, 80, 2)])
def test_near_duplicates(spark, texts, words, percent, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_LIST", small)
    found = minhash.near_duplicates(docs(spark, [*texts, (100, dict(texts)[100])]), words, percent).collect()
    assert len(found) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_components(texts, words, percent)


def test_repeated_ids(spark, texts):
    """Rows that share a doc_id are one document; the stage keeps one row of each text, whatever its doc_id."""
    a, b, c, d, e = (dict(texts)[i] for i in range(5))
    near = f"{d} one_more"
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (7, c), (None, e), (None, e), (None, a), (2, d), (8, near), (8, d), (9, None), (9, ""), (9, "far away from all of them"), (4, c), (None, None)]
    found = collections.defaultdict(set)
    for r in minhash.near_duplicates(docs(spark, rows), 5, 80).collect():
        found[r.doc_id].add((r.component_id, r.kept))
    assert dict(found) == {1: {(1, True)}, 5: {(1, False)}, 6: {(1, False)}, 7: {(4, False)}, 4: {(4, True)}, 2: {(2, True)}, 8: {(2, False)}, 9: {(9, True)}, None: {(None, True)}}
    out = minhash.keep_representatives(docs(spark, rows), 5, 80)
    assert out.columns == docs(spark, rows).columns
    kept = collections.Counter((r.doc_id, r.text or "") for r in out.collect())
    assert kept == collections.Counter([(1, a), (5, b), (4, c), (None, e), (2, d), (9, ""), (9, "far away from all of them"), (None, "")])


def test_decontamination(spark, texts):
    import re

    passage = dict(texts)[300].split()[10:50]
    items = [(1, " ".join(passage[:20])), (2, "one"), (3, None), (4, "not in any of the documents at all here"), (5, " ".join([*passage[:20], "changed"])), (5, " ".join(passage[20:]))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_item int")

    def grams(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    want = collections.defaultdict(float)
    for i, t in texts:
        for j, u in items:
            g = grams(u)
            if g and 100 * len(g & grams(t)) >= 80 * len(g):
                want[i, j] = max(want[i, j], len(g & grams(t)) / len(g))
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == dict(want) and (300, 1) in got and (402, 2) in got
    kept = decontaminate.keep_uncontaminated(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns and kept.count() == len({i for i, _ in texts} - {i for i, _ in want})


def test_packing(spark, texts):
    rows = packing.pack_documents(docs(spark, texts), capacity=256).collect()
    bins = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    for i, t in texts:
        ids = ids_of(t)
        assert sorted(pieces[i]) == [(k, s, len(ids[s : s + 256]), crc(ids[s : s + 256])) for k, s in enumerate(range(0, len(ids), 256))]
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.05 * total / 256 + 1


def test_best_two_fit_replaces():
    # 6 + 3 leaves 1; 3 is exchanged for 2 + 2, which fill the bin.
    bins = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(bins[0][0], reverse=True) == [6, 2, 2] and sum(n * len(b) for b, n in bins) == 4


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    outs = [
        substrings.remove_repeats(none), tokenfile.token_file_digest(none), topk.top_k(vectors, vectors), toxicity.score_documents(none, toxicity.train(none, labels)), sharding.shard_documents(none),
        decontaminate.contaminated(none, bench), language.identify(none, language.train(none)), secrets.scan_secrets(none), minhash.near_duplicates(none), packing.pack_documents(none),
    ]
    assert [x.count() for x in outs] == [0] * 10


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    assert sorted((r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect()) == [(0, True), (0, True), (1, True), (2, True)]
    assert substrings.remove_repeats(docs(spark, rows)).count() == 4
    assert sharding.shard_documents(docs(spark, rows)).count() == 4
    assert tokenfile.token_file_digest(docs(spark, rows)).count() == 4
    assert ngrams.stratified_ids(docs(spark, rows).where("doc_id is not null"), "lang", 5, 5).count() == 2
