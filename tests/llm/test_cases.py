"""Operators and pipeline stages against brute force on awkward rows: nulls, long texts, repeats, clashing names."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import decontaminate, language, ngrams, packing, secrets, substrings, tokenfile, tokens, topk, toxicity

#: Extra columns named as the operators name their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, grp int, block int, runs int, words string, print int, sketch long, class int, size_class int, ids string, group int"


def docs(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 2, 3, 4, "w", 5, 6, 7, 8, "i", 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def long_text():
    random.seed(9)
    vocab = ["".join(random.choice("abcdefghijklm") for _ in range(random.randint(2, 8))) for _ in range(2000)]
    return " ".join(random.choice(vocab) for _ in range(150_000))


def test_columns_of_texts_equal_library():
    random.seed(3)
    own = tokens.WordEncoder(tokens.public_tokenizers.path(tokens.TOKENIZER))
    parts = [*"aB1 '́é\x85İΣς٣–.,\x1f\x0b ﻿ﬁ漢🙂K\n\t", "<|endoftext|>", "'s", "'LL", "word", " a, "]
    texts = [None if random.random() < 0.05 else "".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(1500)]
    for column in (pa.array(texts), pa.array(texts).slice(7, 900), pa.array([None, ""]), pa.array([], pa.string())):
        seen = 0
        for first, ids, starts in own.encode_column(column, 1):
            for k in range(len(starts) - 1):
                assert ids[starts[k] : starts[k + 1]].tolist() == [*own.tokenizer.encode(column[first + k].as_py() or "", add_special_tokens=False).ids, 1]
            seen += len(starts) - 1
        assert seen == len(column)


def test_few_known_words(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 20)
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 5)
    own = tokens.WordEncoder(tokens.public_tokenizers.path(tokens.TOKENIZER))
    random.seed(5)
    for _ in range(30):
        text = " ".join(random.choice(["one", "two.", "Three", "f5", "x-y"]) + str(random.randint(0, 9)) for _ in range(random.randint(0, 40)))
        assert list(own.encode(text)) == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_text(spark, long_text):
    """A text of a megabyte goes whole through every operator that reads texts."""
    rows = [(1, long_text), (2, None), (3, ""), (None, long_text), (4, "password = hunter22 " + long_text[:500])]
    table = docs(spark, rows)
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(table).collect()}
    assert removed[None] == 0 and removed[1] == len(long_text) and removed[4] == 500 and removed[2] == removed[3] == 0
    passage = " ".join(long_text.split()[140_000:140_012])
    bench = spark.createDataFrame([(7, passage), (8, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated(table, bench).collect()] == [(1, 7, 8)]
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(table.withColumn("text", F.concat("text", F.lit(" secret: abcdefgh")))).collect()}
    assert spans[1].startswith("assign:") and spans[4].startswith("assign:0:19") and spans[2] == ""
    slot = np.full(len(toxicity.ORDERS) << toxicity.BITS, -1, np.int32)
    assert toxicity.score_documents(table, toxicity.Model(slot, np.zeros(1), 0.0)).count() == 5
    model = language.fit([("aaa bbb", "x"), ("ccc ddd", "y")])
    assert collections.Counter(r.lang_pred == "und" for r in language.identify(table, model).collect()) == {True: 2, False: 3}
    digest = tokenfile.token_file_digest(table).collect()
    assert [r.n_tokens for r in sorted(digest, key=lambda r: r.start)][1:] == [len(tokens.encoder().encode(t or "")) + 1 for _, t in sorted(rows[:3] + rows[4:])]


def test_removal_with_repeated_ids(spark):
    a = "".join(chr(97 + (k * k) % 26) for k in range(150))
    out = substrings.remove_repeats(docs(spark, [(1, a), (1, a), (1, a + "tail"), (2, a)])).collect()
    assert len(out) == 4 and sum(r.n_removed for r in out if r.doc_id == 2) == 150


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, block int")


def test_top_k_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, [1e38, 1.0]), (2, [0.5, 0.5]), (3, []), (4, None), (5, [1.0]), (6, [2.0, 2.0]), (6, [2.0, 2.0]), (None, [1.0, 1.0])]
    df = vectors(spark, rows)
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 2 = 0"), k=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    top = (1 << 63) - 1
    assert sorted(got[2]) == [(1, 1, top), (2, 6, 2048 * 512 * 2), (3, 6, 2048 * 512 * 2)]
    assert sorted(got[6])[0] == (1, 1, top) and 3 not in got and 4 not in got and len(got[0]) == 3
    assert topk.top_k(df, df.where("vec_id = 5")).collect() == []


def test_lists_stop_early_and_read_no_entry_twice():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * np.exp(rng.normal(size=(3000, 3)) * 2))
    ids = np.arange(3000)
    for query, found, scores, depth in topk.best_in_block(ids, x, ids[:20], x[:20], 5):
        exact = x @ x[query]
        exact[query] = -np.inf
        order = np.lexsort((ids, -exact))[:5]
        assert (ids[order] == found).all() and (exact[order] == scores).all() and depth < 3000
    lists = topk.Lists(x)
    parts = [lists.read_on(depth) for depth in (10, 100, 3000)]
    for end in (0, 1):
        met = [p[end] != 0 for p in parts]
        assert not (met[0] & met[1]).any() and not (met[1] & met[2]).any()


def test_partitions_by_size_are_probed_apart(spark):
    """A document too small for a partition, or a hash beyond its sketches, does not probe it."""
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    items = spark.createDataFrame([(1, words(6, 1)), (2, words(7, 2)), (3, words(60, 3)), (4, words(90, 4))], "item_id long, text string")
    sketches = decontaminate.item_sketches(items).collect()
    by = collections.defaultdict(list)
    for r in sketches:
        by[r.size_class].append(r)
    assert {c: sorted({r.n for r in rows}) for c, rows in by.items()} == {2: [2, 3], 6: [56], 7: [86]}
    for c, rows in by.items():
        upper = max(r.n for r in rows)
        assert all(n == min(upper - -(-upper * 80 // 100) + 1, size) for (_, size), n in collections.Counter((r.item_id, r.n) for r in rows).items())
    partitions = decontaminate.size_partitions(spark.createDataFrame(sketches))
    assert [(c, least) for c, least, _ in partitions] == [(2, 2), (6, 45), (7, 69)]
    texts = docs(spark, [(1, words(6, 9)), (2, words(60, 3)), (3, words(300, 8)), (4, "one")]).select("doc_id", decontaminate.words_of(F.col("text")).alias("words"))
    asked = collections.defaultdict(set)
    greatest = {c: g for c, _, g in partitions}
    for r in decontaminate.probes(texts, partitions).collect():
        asked[r.doc_id].add(r.size_class)
        assert r.sketch <= greatest[r.size_class]
    assert asked[1] <= {2} and asked[2] <= {2, 6} and 6 in asked[2] and asked[3] == {2, 6, 7} and 4 not in asked


def der(n):
    body = bytes([2, 1, 0]) + b"".join(bytes([2, 8]) + bytes(range(k, k + 8)) for k in range(n))
    return bytes([0x30, 0x81, len(body)]) + body


def openssh():
    part = lambda b: len(b).to_bytes(4, "big") + b
    return secrets.OPENSSH_MAGIC + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(b"k" * 51) + part(b"s" * 136)


def test_wrapped_and_hex_keys():
    import base64

    for data, kind in ((der(18), "der"), (openssh(), "openssh")):
        key = base64.b64encode(data).decode()
        for width in (64, 76):
            for end in ("\n", "\r\n", "\n  "):
                wrapped = end.join(key[k : k + width] for k in range(0, len(key), width))
                for text in (f"k: {wrapped}", f"{wrapped}\nend of it", f"x={wrapped} more", f"a\n{wrapped}\n\nb"):
                    assert [(text[s:e], k) for s, e, k in secrets.structural_spans(text)] == [(wrapped, kind)], (kind, width, text)
        for digits in (data.hex(), data.hex().upper()):
            assert [(s, e, k) for s, e, k in secrets.structural_spans(f"<{digits}>")] == [(1, 1 + len(digits), kind)]
        # Near misses: a cut key, a changed length, plain words in lines.
        assert secrets.structural_spans(key[:-8]) == [] and secrets.structural_spans(data[:-3].hex()) == []
    assert secrets.structural_spans("M" + "word" * 15 + "\n" + "more" * 16) == []


def test_encrypted_armour_is_checked():
    import base64

    body = base64.b64encode(bytes(range(96))).decode()
    block = lambda head, b: f"-----BEGIN RSA PRIVATE KEY-----\n{head}\n{b}\n-----END RSA PRIVATE KEY-----"
    sealed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n"
    assert [k for _, _, k in secrets.structural_spans(block(sealed, body))] == ["pem"]
    bad = [block("Proc-Type: 4,ENCRYPTED\n", body), block(sealed, base64.b64encode(b"x" * 95).decode()), block(sealed, "anything at all"), block(sealed.replace("0123456789ABCDEF0123456789ABCDEF", "01"), body), block(sealed, base64.b64encode(b"x" * 8).decode())]
    assert [secrets.structural_spans(t) for t in bad] == [[]] * 5


def plain_base(text):
    """The base patterns by hand, character by character."""
    found = []
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for kind, own, least in (("assign", pattern, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24)):
        at = 0
        while m := own.search(text, at):
            at = m.end()
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_base_spans_equal_plain_scan():
    random.seed(8)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", " ", "=", ":", "'", '"', "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ſecret", "é", "\n", "."]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert sorted(secrets.base_spans(text), key=lambda x: (x[0], ("assign", "access", "hex").index(x[2]))) == plain_base(text), text


def one_bin_at_a_time(lengths, capacity):
    left, bins = collections.Counter(lengths), 0
    take = lambda gap: max((n for n in left if left[n] and n <= gap), default=0)
    while sum(left.values()):
        used, gap = [], capacity
        while gap and (n := take(gap)):
            used.append(n)
            left[n] -= 1
            gap -= n
        while gap and len(used) > 1:
            least = min(used)
            pairs = [(a + b) for a in left if left[a] for b in left if left[b] - (a == b) > 0 and a + b <= gap + least]
            if max(pairs, default=0) <= least:
                break
            total = max(pairs)
            a = max(a for a in left if left[a] and total - a > 0 and left[total - a] - (2 * a == total) > 0)
            used.remove(least)
            left[least] += 1
            for n in (a, total - a):
                used.append(n)
                left[n] -= 1
            gap += least - total
        bins += 1
    return bins


def test_packing_equals_one_bin_at_a_time():
    random.seed(11)
    for _ in range(150):
        lengths = [random.randint(1, 40) for _ in range(random.randint(0, 80))]
        patterns = packing.best_two_fit(dict(collections.Counter(lengths)), 40)
        assert collections.Counter(n for own, times in patterns for n in own for _ in range(times)) == collections.Counter(lengths)
        assert all(sum(own) <= 40 for own, _ in patterns)
        assert abs(sum(times for _, times in patterns) - one_bin_at_a_time(lengths, 40)) <= 1


def test_training_with_awkward_rows(spark):
    """Null ids, null and empty texts, repeated and null labels; no label is left out."""
    rows = [(i, f"{'vile idiot' if i % 3 == 0 else 'good day'} number {i}") for i in range(60)] + [(None, "x"), (60, None), (61, ""), (1, "good day again")]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), 0) for i in range(62)] + [(1, 1, 0, 0), (None, 1, 1, 0), (2, 1, None, 0)], "doc_id long, quality int, toxic int, text int")
    model = toxicity.train(table, labels)
    scores = toxicity.score_texts(model, ["a vile idiot", "a good day", None])
    assert scores[0] > scores[1] and 0 <= scores.min() and scores.max() <= 1
    many = docs(spark, [(i, f"text {i}") for i in range(400)]).withColumn("lang", F.format_string("l%d", F.col("doc_id")))
    model = language.train(many.unionByName(docs(spark, [(None, "x"), (500, None)], None)))
    assert len(model.langs) == many.where(~ngrams.held_out()).count()
    assert language.predict(language.train(docs(spark, [])), ["abc"])[0] == ["und"]


def test_stages_on_awkward_rows(spark, tmp_path, long_text):
    """Every stage takes nulls, empty and long texts, repeats, no rows and further columns, and drops only what it should."""
    prose = [" ".join(long_text.split()[k * 50 : k * 50 + 40]) for k in range(30)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(100, prose[3]), (101, prose[4] + " again"), (102, None), (103, ""), (None, prose[5]), (None, None), (7, prose[7]), (104, "token = abcdef123456 " + prose[20][:90] + " tail of the text"), (105, long_text)]
    table = docs(spark, rows)
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose[9].split()[5:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == table.columns
        kept.write.parquet(path := f"{tmp_path}/stage-{stage.__name__}")
        kept = spark.read.parquet(path)
        assert stage(spark, docs(spark, []), str(tmp_path)).count() == 0
    got = {r.doc_id: r.text for r in kept.collect()}
    # 9 holds the benchmark passage, and so does the long text; 100, 101, the copy without id and one row of 7 go as copies.
    assert set(got) == {*range(30), 102, 103, 104, None} - {9} and len(got[104]) and "abcdef123456" not in got[104] and got[3] == prose[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum(len(tokens.encoder().encode(r.text or "")) + 1 for r in kept.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs(spark, []), str(tmp_path)).count() == 0


def test_components_near_the_end_of_doubles(spark):
    """Whole numbers beyond doubles are compared exactly, also where two of them cancel."""
    rows = [(0, [1.0, 1.0]), (1, [1e308, -1e308]), (2, [1e308, 0.0]), (3, [1.5e308, -1.0e308]), (4, [-1e308, 0.0]), (5, [0.0004, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    top = (1 << 63) - 1
    assert got == [(2, top), (3, top), (5, 2048 * 1024), (1, 0), (4, -top)]


def test_sample_is_measured_before_texts_are_gathered(spark):
    """The texts within the budget are found from lengths; a repeated row counts once, an id with two texts twice."""
    rows = [(i, chr(97 + i) * 40) for i in range(8)] + [(3, "d" * 40), (3, "x" * 40)]
    table = docs(spark, rows)
    sample = table.select("doc_id").distinct().withColumn("lang", F.lit("en"))
    found = ngrams.labelled_texts(table, sample, "lang", 100, 5 * 40)
    assert len(found) == 5 and len({t for t, _ in found}) == 5 and all(len(t) == 40 for t, _ in found)
    assert len(ngrams.labelled_texts(table, sample, "lang", 100, 10_000)) == 9 and len(ngrams.labelled_texts(table, sample, "lang", 3, 10_000)) == 3


def test_language_of_a_document_with_two(spark):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "x" if i % 2 else "y") for i in range(40)]
    both = spark.createDataFrame(rows + [(i, t, "z") for i, t, _ in rows], "doc_id long, text string, lang string")
    models = [language.train(both.repartition(n)) for n in (1, 5)]
    assert [language.predict(m, ["aaa bbb", "ccc ddd"])[0] for m in models] == [["x", "y"]] * 2
