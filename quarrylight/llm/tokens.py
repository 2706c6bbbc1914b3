"""Token ids from the tokenizers library for columns of texts, each distinct word of a column encoded once.

The tokenizer's normalizer works by character and its pre-tokenizer never joins what white space parts, so the ids of a
text are those of its words in order, and those of a word are those of its pieces. Arrow splits a column into words and
finds the distinct ones, numpy lays their ids out again. Texts on whose white space or lower case Python and the
tokenizer disagree are encoded whole, and so is everything under a tokenizer of another normalizer or pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words, and pieces of words, whose ids a worker keeps from one column to the next; they are met anew when there are more.
KNOWN_WORDS, KNOWN_PIECES = 300_000, 250_000
#: Bytes of text that one pass takes at most, unless a single text is longer.
PASS_BYTES = 4 << 20

#: U+001C to U+001F are white space to Python alone; sigma and dotted I have lower cases that depend on what is around them.
ODD = "[\x1c-\x1fΣİ]"
#: The normalizer and the pre-tokenizer pattern that the encoding by words stands for.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = regex.compile(PATTERN)
_BY_PATH: dict[str, WordEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Encodes texts to arrays of little-endian ids; ``dtype`` is the narrowest that holds the vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.letters = byte_letters()
        self.by_words = works_by_words(json.loads(Path(path).read_text()))
        self.pieces: dict[str, bytes] = {}
        self.known = pa.array([], pa.large_string())
        self.flat, self.ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _whole(self, text: str) -> array:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if (got := self.pieces.get(piece)) is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            got = array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()
            if len(self.pieces) >= KNOWN_PIECES:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def _word(self, word: str, low: str) -> bytes:
        if "<|" in word and any(s in word for s in self.special):
            return self._whole(word).tobytes()
        if low.isascii():
            if low.isalpha():
                return self._piece(low)
            if low[-1:] in {".", ","} and low[:-1].isalpha():
                return self._piece(low[:-1]) + self._piece(low[-1])
        else:
            low = unicodedata.normalize("NFC", word).lower()
        return b"".join(map(self._piece, PIECES.findall(low)))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` end to end, and where each ends (first entry 0)."""
        # Whole words among the known pieces are letters alone: nothing else is a piece by itself and a word.
        known, word_ids = self.pieces.get, self._word
        ids = [known(low) or word_ids(word, low) for word, low in zip(words, map(str.lower, words), strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        return np.frombuffer(b"".join(ids), self.dtype), np.concatenate([[0], np.cumsum(sizes)])

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) by distinct word: those known from earlier columns are looked up, others encoded."""
        at = pc.index_in(words, value_set=self.known)
        missed = at.is_null()
        new = words.filter(missed)
        ids, ends = self._encoded(new.to_pylist())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[missed.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        flat = np.concatenate([self.flat, ids])
        ends = np.concatenate([self.ends, len(self.flat) + ends[1:]])
        if len(self.known) + len(new) <= KNOWN_WORDS:
            self.known, self.flat, self.ends = pa.concat_arrays([self.known, new]), flat, ends
        elif len(words) <= KNOWN_WORDS:
            # Too many are known: this column's words stay, the others go.
            sizes = ends[place + 1] - ends[place]
            self.known, self.flat, self.ends = words, gathered(flat, ends[place], sizes), np.concatenate([[0], np.cumsum(sizes)])
        return flat, ends[place], ends[place + 1] - ends[place]

    def _pass(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        odd = np.ones(len(texts), bool) if not self.by_words else pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        coded = split.values.dictionary_encode()
        flat, start, size = self._distinct(coded.dictionary)
        # Each text's end, and the whole ids of an odd text, follow its words as one more word.
        tails = [*(self._whole(texts[int(k)].as_py()) for k in np.flatnonzero(odd))]
        tail = np.concatenate([*(np.frombuffer(t, self.dtype) for t in tails if t), np.array([] if end_id is None else [end_id], self.dtype)])
        tail_sizes = np.zeros(len(texts), np.int64)
        tail_sizes[odd] = [len(t) for t in tails]
        word, ends = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        starts, sizes = np.insert(start[word], ends[1:], len(flat) + np.cumsum(tail_sizes) - tail_sizes), np.insert(size[word], ends[1:], tail_sizes)
        ends = ends + np.arange(len(ends))
        if end_id is not None:
            starts, sizes = np.insert(starts, ends[1:], len(flat) + len(tail) - 1), np.insert(sizes, ends[1:], 1)
            ends = ends + np.arange(len(ends))
        ids = gathered(np.concatenate([flat, tail]), starts, sizes)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[ends]

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids end to end, where each text begins and the last ends) in passes of bounded size.

        A null text counts as empty; ``end_id``, if given, follows every text.
        """
        texts = column.cast(pa.large_string()).fill_null("")
        sums = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        first = 0
        while first < len(texts):
            end = min(max(int(np.searchsorted(sums, sums[first] + PASS_BYTES, side="right")) - 1, first + 1), len(texts))
            yield first, *self._pass(texts.slice(first, end - first), end_id)
            first = end

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_column(pa.array([text])))[1]


def works_by_words(file: dict) -> bool:
    """Whether the tokenizer file has the normalizer, pre-tokenizer and model that ``WordEncoder`` takes apart."""
    normalizers = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = bool(steps) and steps[0]["type"] == "Split" and steps[0]["pattern"].get("Regex") == PATTERN and steps[0]["behavior"] == "Removed"
    return normalizers == NORMALIZERS and split and [s["type"] for s in steps[1:]] == ["ByteLevel"] and file["model"]["type"] == "BPE"


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, end to end."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def encoder(name: str = TOKENIZER) -> WordEncoder:
    """The worker's encoder for a public tokenizer file; it lives as long as the Python worker."""
    if name not in _BY_PATH:
        _BY_PATH[name] = WordEncoder(public_tokenizers.path(name))
    return _BY_PATH[name]
