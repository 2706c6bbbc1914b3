"""Alignment of two tokenizers' tokens on the same bytes, and how often the corpus links their ids.

Texts are cut before single spaces between other characters: neither tokenizer has a token across such a place, so the
tokens of a text are those of its pieces in order. A chunk of texts has each distinct piece once. For those, products of
token-byte incidence matrices give the tokens that overlap, and products of group incidence matrices the ids that share
a group. Counts of linked ids are summed over chunks; each chunk then gets back the counts of the pairs that it holds.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import uuid
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylight.llm.common import map_texts, materialise
from quarrylight.llm.incidence import Csr, from_entries, incidence, offsets, product, row_sums, runs, transposed
from quarrylight.llm.tokens import byte_letters

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in one chunk, unless a single text is longer; a chunk is worked on by one task at a time.
CHUNK_BYTES = 3 << 20
#: Pieces whose tokens a worker keeps from one chunk to the next, and pieces that are encoded at a time.
KNOWN_PIECES, PIECES_PER_CALL = 150_000, 2_000
#: Occurrences of pieces whose group texts are laid out at a time.
PLACES_PER_PASS = 200_000
#: White space of either library next to a space, or a space at an end: such texts are cut one by one.
WHITE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = f"^ | $| [{WHITE}]|[{WHITE}] "
CUT = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])")
_ENCODERS: dict[tuple[str, str], PairEncoder] = {}


class Tokens(NamedTuple):
    """Ids of several pieces end to end, and how many each piece has."""

    ids: np.ndarray
    sizes: np.ndarray


class PairEncoder:
    """Tokens of both tokenizers for pieces; a piece stands for itself behind one space."""

    def __init__(self, first: str, second: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        back = {letter: byte for byte, letter in byte_letters().items()}
        spell = lambda i: bytes(back[c] for c in self.first.id_to_token(i)) if all(c in back for c in self.first.id_to_token(i)) else self.first.id_to_token(i).encode()
        self.widths = (self.first.get_vocab_size(), self.second.get_piece_size())
        self.spelled = (self._table([spell(i) for i in range(self.widths[0])]), self._table([piece_bytes(self.second.id_to_piece(i)) for i in range(self.widths[1])]))
        self.known: dict[str, tuple[bytes, bytes]] = {}
        if any("▁" in self.second.id_to_piece(i).lstrip("▁") for i in range(self.widths[1])):
            raise ValueError("a piece of the second tokenizer holds a space behind another character")

    @staticmethod
    def _table(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(spelled), np.uint8), offsets(np.array([len(s) for s in spelled]))

    def encode(self, pieces: list[str]) -> tuple[Tokens, Tokens]:
        new, fresh = [p for p in pieces if p not in self.known], {}
        for at in range(0, len(new), PIECES_PER_CALL):
            part = new[at : at + PIECES_PER_CALL]
            a = [array("H", e.ids).tobytes() for e in self.first.encode_batch_fast([f" {p}" for p in part], add_special_tokens=False)]
            b = [array("H", ids).tobytes() for ids in self.second.encode(part, num_threads=1)]
            fresh.update(zip(part, zip(a, b, strict=True), strict=True))
        both = [fresh[p] if p in fresh else self.known[p] for p in pieces]
        if len(self.known) + len(fresh) > KNOWN_PIECES:
            # Of the pieces known before, those that have come again stay.
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        self.known.update(itertools.islice(fresh.items(), max(0, KNOWN_PIECES - len(self.known))))
        return tuple(Tokens(np.frombuffer(b"".join(x[k] for x in both), np.uint16).astype(np.int64), np.array([len(x[k]) // 2 for x in both], np.int64)) for k in (0, 1))

    def lengths(self, which: int, ids: np.ndarray) -> np.ndarray:
        return np.diff(self.spelled[which][1])[ids]

    def bytes_of(self, which: int, ids: np.ndarray) -> np.ndarray:
        flat, at = self.spelled[which]
        return runs(flat, at[ids], at[ids + 1] - at[ids])


def piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if regex.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def encoder() -> PairEncoder:
    """The worker's encoder of the two public tokenizers; it lives as long as the Python worker."""
    names = (BYTE_TOKENIZER, PIECE_TOKENIZER)
    if names not in _ENCODERS:
        _ENCODERS[names] = PairEncoder(*map(public_tokenizers.path, names))
    return _ENCODERS[names]


class Pieces(NamedTuple):
    """Distinct pieces with their tokens; those whose tokens don't spell them have none."""

    first: Tokens
    second: Tokens
    sound: np.ndarray


class Linked(NamedTuple):
    """What the incidence products say of distinct pieces."""

    groups: np.ndarray  # groups of each piece
    sizes: tuple[np.ndarray, np.ndarray]  # tokens of each group, by tokenizer
    overlaps: np.ndarray  # overlapping tokens of each piece, in pairs
    pairs: np.ndarray  # distinct linked id pairs, ascending, as first * width + second
    links: Csr  # pieces by places in ``pairs``: how many linked occurrences


def encoded(own: PairEncoder, pieces: list[str]) -> Pieces:
    """Tokens of distinct pieces, checked byte for byte against what they should spell."""
    tokens = own.encode(pieces)
    raw = np.frombuffer((" " + " ".join(pieces)).encode() if pieces else b"", np.uint8)
    length = np.array([1 + len(p) if p.isascii() else 1 + len(p.encode()) for p in pieces], np.int64)
    begin, sound = offsets(length), np.ones(len(pieces), bool)
    for which, (ids, sizes) in enumerate(tokens):
        spelled, at = own.bytes_of(which, ids), offsets(own.lengths(which, ids))[offsets(sizes)]
        same = np.diff(at) == length
        wrong = runs(spelled, at[:-1][same], length[same]) != runs(raw, begin[:-1][same], length[same])
        same[np.repeat(np.flatnonzero(same), length[same])[wrong]] = False
        sound &= same
    return Pieces(*(Tokens(t.ids[np.repeat(sound, t.sizes)], np.where(sound, t.sizes, 0)) for t in tokens), sound)


def linked(own: PairEncoder, first: Tokens, second: Tokens) -> Linked:
    """Groups and links of distinct pieces, from two products of incidence matrices.

    Tokens by bytes, times its counterpart turned over: the tokens that overlap. Run through in order, both sides change
    at once exactly where both tokens end, which is where a group ends. Ids by groups, times groups by ids: the ids
    that share groups, with the number of their linked occurrences.
    """
    count = len(first.sizes)
    overlap = product(incidence(own.lengths(0, first.ids)), transposed(incidence(own.lengths(1, second.ids))))
    a, b = overlap.rows(), overlap.cols
    ends = np.flatnonzero((a[1:] != a[:-1]) & (b[1:] != b[:-1])) if len(a) else np.zeros(0, np.int64)
    group = np.zeros(len(a), np.int64)
    group[ends + 1] = 1
    group = np.cumsum(group)
    of_a, of_b = np.zeros(len(first.ids), np.int64), np.zeros(len(second.ids), np.int64)
    of_a[a], of_b[b] = group, group
    n = int(group[-1]) + 1 if len(group) else 0
    piece = np.repeat(np.arange(count), first.sizes)
    by_piece = np.zeros(n, np.int64)
    by_piece[of_a] = piece
    # The first side's ids are told apart by piece, so that a product's row belongs to one piece.
    names, row = np.unique(piece * own.widths[0] + first.ids, return_inverse=True)
    shared = product(from_entries(row, of_a, len(names), max(n, 1)), from_entries(of_b, second.ids, n, own.widths[1]))
    at = shared.rows()
    pairs, place = np.unique((names % own.widths[0])[at] * own.widths[1] + shared.cols, return_inverse=True)
    keys, values = names[at] // own.widths[0] * max(len(pairs), 1) + place, shared.values
    order = np.argsort(keys, kind="stable")
    links = Csr(np.searchsorted(keys[order], np.arange(count + 1) * max(len(pairs), 1)), place[order], values[order], len(pairs))
    return Linked(np.bincount(by_piece, minlength=count), (np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)), np.bincount(piece[a], minlength=count), pairs, links)


def cut(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all pieces, where each text's begin, where they end); texts marked ``whole`` are one piece each."""
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) | whole
    plain = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    flat, ends = plain.values, plain.offsets.to_numpy().astype(np.int64)
    begins, ends = ends[:-1].copy(), ends[1:].copy()
    apart = [[p[1:] for p in CUT.split(" " + texts[int(k)].as_py())] if not whole[k] else [texts[int(k)].as_py()] for k in np.flatnonzero(odd)]
    at = offsets(np.array([len(p) for p in apart])) + len(flat)
    begins[odd], ends[odd] = at[:-1], at[1:]
    return pa.concat_arrays([flat, pa.array([p for part in apart for p in part], pa.large_string())]), begins, ends


class Chunk(NamedTuple):
    pieces: Pieces
    linked: Linked
    places: Csr  # texts by pieces: how often
    order: np.ndarray  # pieces of all sound texts in order
    starts: np.ndarray  # where those of each text begin, and the last end


def chunk_of(own: PairEncoder, texts: list[str | None]) -> Chunk:
    """Pieces, links and places of the texts of one chunk; texts null, empty or not spelled by both tokenizers have none."""
    column = pa.array([t or "" for t in texts], pa.large_string())
    whole, none = np.zeros(len(texts), bool), np.array([not t for t in texts], bool)
    for again in (False, True):
        flat, begins, ends = cut(column, whole)
        coded = flat.dictionary_encode()
        pieces, index = encoded(own, coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64)
        wrong = offsets(~pieces.sound[index])
        bad = (wrong[ends] > wrong[begins]) & ~none
        if again or not bad.any():
            break
        whole = bad
    sizes = np.where(bad | none, 0, ends - begins)
    order = runs(index, begins, sizes)
    rows = np.repeat(np.arange(len(texts)), sizes)
    return Chunk(pieces, linked(own, pieces.first, pieces.second), from_entries(rows, order, len(texts), max(len(pieces.sound), 1)), order, offsets(sizes))


def listed(values: pa.Array, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def group_texts(own: Chunk) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of each distinct piece."""
    sides = []
    for tokens, sizes in zip(own.pieces[:2], own.linked.sizes, strict=True):
        names = pa.array(tokens.ids).cast(pa.string())
        sides.append(pc.binary_join(listed(names, offsets(sizes)), ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    return pc.binary_join(listed(groups, offsets(own.linked.groups)), ";")


def group_hashes(own: Chunk) -> list[str]:
    """SHA-256 of each text's groups, '' for texts without tokens."""
    texts, out, first, count = group_texts(own), [], 0, len(own.starts) - 1
    while first < count:
        end = min(max(int(np.searchsorted(own.starts, own.starts[first] + PLACES_PER_PASS, side="right")) - 1, first + 1), count)
        at = own.starts[first : end + 1]
        joined = pc.binary_join(listed(texts.take(pa.array(own.order[at[0] : at[-1]])), at - at[0]), ";")
        out += [hashlib.sha256(s.as_buffer()).hexdigest() if n else "" for s, n in zip(joined, np.diff(at), strict=True)]
        first = end
    return out


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def shrunk(array: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(array.astype(kind).tobytes(), 1)


def grown(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind).astype(np.int64)


STORED = {"pairs": "<u4", "n_docs": "<u4", "first_ids": "<u2", "first_sizes": "<u4", "second_ids": "<u2", "second_sizes": "<u4", "place_sizes": "<u4", "places": "<u4", "place_counts": "<u4"}


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(doc_ids, texts) of CHUNK_BYTES of text, or of one text that is longer."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for number, text in enumerate(batch.column("text").to_pylist()):
            size = len(text or "")
            if texts and held + size > CHUNK_BYTES:
                yield pa.concat_arrays(ids), texts
                ids, texts, held = [], [], 0
            ids.append(batch.column("doc_id").slice(number, 1))
            texts.append(text)
            held += size
    if texts:
        yield pa.concat_arrays(ids), texts


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder()
    for ids, texts in chunks(batches):
        got = chunk_of(own, texts)
        facts = (got.pieces.first.sizes, got.pieces.second.sizes, got.linked.groups, row_sums(got.linked.links), got.linked.overlaps)
        held = product(got.places, got.linked.links)
        stored = {
            "pairs": got.linked.pairs, "n_docs": np.bincount(held.cols, minlength=len(got.linked.pairs)), "first_ids": got.pieces.first.ids, "first_sizes": got.pieces.first.sizes, "second_ids": got.pieces.second.ids,
            "second_sizes": got.pieces.second.sizes, "place_sizes": np.diff(got.places.starts), "places": got.places.cols, "place_counts": got.places.values,
        }
        columns = {"chunk": pa.array([uuid.uuid4().int >> 65], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
        columns |= {c: pa.array([row_sums(got.places, fact)], pa.list_(pa.int64())) for c, fact in zip(COUNTS, facts, strict=True)}
        columns["hashes"] = pa.array([group_hashes(got)], pa.list_(pa.string()))
        columns |= {c: pa.array([shrunk(stored[c], kind)], pa.binary()) for c, kind in STORED.items()}
        yield pa.RecordBatch.from_pydict(columns)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, counts = grown(pairs, STORED["pairs"]), grown(counts, STORED["n_docs"])
            for at in range(0, len(pairs), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[part]), chunk)), pa.array(pairs[part]), pa.array(counts[part])], names=["chunk", "pair", "n_docs"])


def _finished(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """A chunk's documents with what its links count in the whole corpus."""
    own = encoder()
    row = {c: stored.column(c)[0] for c in stored.column_names}
    data = {c: grown(row[c].as_py(), kind) for c, kind in STORED.items()}
    links = linked(own, Tokens(data["first_ids"], data["first_sizes"]), Tokens(data["second_ids"], data["second_sizes"])).links
    order = np.argsort(asked.column("pair").to_numpy())
    if not np.array_equal(asked.column("pair").to_numpy()[order], data["pairs"]):
        raise ValueError("a chunk's pairs came back incomplete")
    total, best = asked.column("total").to_numpy()[order], asked.column("best").to_numpy()[order].astype(np.int64)
    places = Csr(offsets(data["place_sizes"]), data["places"], data["place_counts"], len(data["first_sizes"]))
    columns = {"doc_id": row["doc_ids"].values} | {c: row[c].values for c in COUNTS[:4]}
    columns |= {"n_best": row_sums(places, row_sums(links, best)), "count_sum": row_sums(places, row_sums(links, total)), "groups_sha256": row["hashes"].values, "n_overlaps": row["n_overlaps"].values}
    return pa.table(columns)


def stored_chunks(docs: DataFrame) -> DataFrame:
    """Tokens, links and places of the texts, a row a chunk, written in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, doc_ids array<{kind}>, {', '.join(f'{c} array<long>' for c in COUNTS)}, hashes array<string>, {', '.join(f'{c} binary' for c in STORED)}"
    return materialise(map_texts(docs.select("doc_id", "text"), _store, schema), "aligned-chunks")


def linked_pairs(stored: DataFrame) -> DataFrame:
    """(pair, total, best): in how many documents a pair of ids is linked, and whether no pair of its first id is in more."""
    rows = stored.select("chunk", "pairs", "n_docs").mapInArrow(_pairs, "chunk long, pair long, n_docs long")
    totals = materialise(rows.groupBy("pair").agg(F.sum("n_docs").alias("total")), "linked-pairs")
    first = F.expr(f"pair div {encoder().widths[1]}")
    # A row for each id of the first tokenizer at most, whatever the corpus: 50,257 rows of 16 bytes.
    most = totals.groupBy(first.alias("first")).agg(F.max("total").alias("most"))
    return totals.withColumn("first", first).join(F.broadcast(most), "first").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps.

    Texts that are null, empty or not spelled by both tokenizers have zeros and ''. Repeated rows count as documents of
    their own and get a row each; extra columns are ignored; an empty table gives an empty result. A text of any length
    is taken whole. n_overlaps counts the pairs of tokens that share a byte.
    """
    stored = stored_chunks(docs)
    asked = stored.select("chunk", "pairs", "n_docs").mapInArrow(_pairs, "chunk long, pair long, n_docs long").select("chunk", "pair")
    answers = asked.join(linked_pairs(stored), "pair").select("chunk", "pair", "total", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"
    return answers.groupBy("chunk").cogroup(stored.groupBy("chunk")).applyInArrow(_finished, schema)
