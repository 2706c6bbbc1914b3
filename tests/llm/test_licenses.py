"""License scan: base phrases against a plain scan, longer templates against what was done to them."""

import collections
import random
import re

from quarrylight.llm import licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plainly(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    found = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, template int, label string, place int").repartition(3)


def test_base_phrases(spark):
    random.seed(4)
    parts = ["mit", "MIT", "license", "License", "apache", "general", "public", "GENERAL", " ", " ", "-", "\n", "é", "Ünï", "\0", "_", "7", "漢字", "licenses", "k"]
    rows = [(i, "".join(random.choice(parts) + random.choice([" ", "", "/"]) for _ in range(random.randint(0, 40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "mit license"), (502, "mit license"), (502, "other"), (None, "General Public License"), (503, "word " * 60_000 + "apache  LICENSE mit license mit license"), (504, "general public general public license")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(frame(spark, rows)).collect())
    assert got == collections.Counter((i, *plainly(t)) for i, t in rows)
    assert licenses.scan_licenses(frame(spark, rows).where("false")).collect() == []


def test_longer_templates(spark):
    random.seed(5)
    mit = licenses.TEMPLATES[3].words
    words, junk = mit.split(), lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    without = [w for k, w in enumerate(words) if k not in (20, 21, 50)]
    between = words[:30] + junk(3) + words[30:]
    other = [junk(1)[0] if k % 3 == 0 else w for k, w in enumerate(words)]
    rows = {1: words, 2: without, 3: between, 4: other, 5: junk(50) + words[:40], 6: [*junk(9), *words, *junk(2), *words], 7: junk(30)}
    rows = [(i, " ".join(w)) for i, w in rows.items()] + [(8, "This work is Licensed under CC BY-NC 4.0."), (9, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "mit", 2: "mit", 3: "mit", 4: "", 5: "", 6: "mit", 7: "", 8: "cc-by-nc", 9: "apache,apache-2.0"}
    assert got[1].score == got[3].score == got[6].score == 1.0 and 0.9 < got[2].score < 1 and got[4].score == 0 and all(r.base_labels == "" for i, r in got.items() if i != 9)
    starts = [r.start for r in licenses.license_finds(frame(spark, rows)).where("doc_id = 6 AND label IS NOT NULL").orderBy("start").collect()]
    count = len(licenses.words_of([mit]).begins)
    assert starts == [9, 9 + count + 2]


def test_grams_are_those_of_the_words():
    texts = ["one two  three", "", "four", "a-b c", "x\0y z"]
    words = licenses.words_of(texts)
    for size in (1, 2, 3):
        text, place, hashes, spelled = licenses.grams(words, size)
        want = [(n, k, " ".join(w[k : k + size])) for n, t in enumerate(texts) for w in [re.findall("[a-z]+", t)] for k in range(len(w) - size + 1)]
        assert list(zip(text, place, spelled.to_pylist(), strict=True)) == want
        assert len(set(hashes.tolist())) == len({x for _, _, x in want})
