"""Token alignment against both libraries text by text, and the sparse products against dense ones."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarrylight.llm import alignment, incidence
from quarrylight.llm.tokens import byte_letters


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: b for b, c in byte_letters().items()}

    def tokens(text):
        if not text:
            return [], []
        a = [(e, bytes(back[c] for c in first.id_to_token(e))) for e in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, alignment.piece_bytes(second.id_to_piece(i))) for i in second.encode(text)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == want else ([], [])

    return tokens


def plainly(rows, tokens):
    """The contract, token by token."""
    groups, count, linked = {}, collections.Counter(), {}
    for n, (_, text) in enumerate(rows):
        sides = tokens(text)
        ends = [list(np.cumsum([len(x) for _, x in side])) for side in sides]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        found = [([], []) for _ in cuts]
        for k, side in enumerate(sides):
            for (i, _), end in zip(side, ends[k], strict=True):
                found[next(c for c, at in enumerate(cuts) if at >= end)][k].append(i)
        groups[n] = found
        linked[n] = [(a, b) for x, y in found for a in x for b in y]
        count.update(set(linked[n]))
    best = collections.Counter()
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    out = []
    for n, (i, _) in enumerate(rows):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups[n])
        own = linked[n]
        out.append((i, sum(len(x) for x, _ in groups[n]), sum(len(y) for _, y in groups[n]), len(groups[n]), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return collections.Counter(out)


def test_whole_operator(spark, libraries, monkeypatch):
    random.seed(11)
    parts = [*"aB1 '́é\x85İΣς٣–.,\x1f\x0b ﻿ﬁ漢🙂K \n\t  ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "the ", "of ", "▁", "日本語", "\0"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 25)))) for i in range(150)]
    rows += [(200 + i, " ".join(random.choice(["the", "of", "shiner", "onandth", "x.y", "año", "und"]) for _ in range(40))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " "), (303, "  two  spaces  "), (304, "ends "), (305, "ab▁cd"), (306, "the"), (306, "the"), (None, "of the"), (307, "é" * 300), (308, " ".join(["prose", "words"] * 4000)), (309, "▁")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk long, pair string").repartition(3)
    got = collections.Counter(tuple(r)[:8] for r in alignment.align_documents(df).collect())
    assert got == plainly(rows, libraries)
    assert alignment.align_documents(df.where("false")).collect() == []
    assert [tuple(r)[1:] for r in alignment.align_documents(df.where("doc_id in (300, 301)")).collect()] == [(0, 0, 0, 0, 0, 0, "", 0)] * 2


def test_many_small_chunks(spark, libraries, monkeypatch):
    rows = [(i, " ".join(random.choice(["the", "of", "shiner", "x.y"]) for _ in range(9))) for i in range(40)]
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 60)
    chunks = [t for _, t in alignment.chunks(iter(spark.createDataFrame(rows, "doc_id long, text string").toArrow().to_batches()))]
    assert len(chunks) > 20 and [t for c in chunks for t in c] == [t for _, t in rows]
    own = alignment.encoder()
    pairs = collections.Counter()
    for texts in chunks:
        got = alignment.chunk_of(own, texts)
        held = incidence.product(got.places, got.linked.links)
        pairs.update(dict(zip(got.linked.pairs.tolist(), np.bincount(held.cols, minlength=len(got.linked.pairs)).tolist(), strict=True)))
    want = collections.Counter()
    for _, text in rows:
        a, b = libraries(text)
        ends = [np.cumsum([len(x) for _, x in s]) for s in (a, b)]
        cuts = np.intersect1d(*ends)
        group = [np.searchsorted(cuts, e) for e in ends]
        want.update({x * own.widths[1] + y for (x, _), g in zip(a, group[0], strict=True) for (y, _), h in zip(b, group[1], strict=True) if g == h})
    assert pairs == want


@pytest.mark.parametrize("terms", [4_000_000, 5])
def test_product_equals_dense(monkeypatch, terms):
    monkeypatch.setattr(incidence, "TERMS_PER_PASS", terms)
    rng = np.random.default_rng(2)
    for _ in range(100):
        n, k, m = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (n, k)) * (rng.random((n, k)) < 0.4), rng.integers(0, 3, (k, m)) * (rng.random((k, m)) < 0.4)
        sparse = [incidence.from_entries(np.repeat(np.nonzero(d)[0], d[d > 0]), np.repeat(np.nonzero(d)[1], d[d > 0]), *d.shape) for d in (x, y)]
        got = incidence.product(*sparse)
        dense = np.zeros((n, m), int)
        dense[got.rows(), got.cols] = got.values
        assert (dense == x @ y).all() and (incidence.row_sums(got) == (x @ y).sum(1)).all()
        turned = incidence.transposed(sparse[0])
        assert sorted(zip(turned.cols, turned.rows(), strict=True)) == sorted(zip(sparse[0].rows(), sparse[0].cols, strict=True))
    assert (incidence.incidence(np.array([2, 0, 3])).starts == [0, 2, 2, 5]).all()
