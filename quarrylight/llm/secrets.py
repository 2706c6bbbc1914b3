"""Secret scans with structural confirmation.

Plain patterns find assignments, cloud access keys and long hex runs. Candidates in base64, base64url or hex are decoded
and parsed before they are reported: DER nested lengths of private-key encodings, the length-prefixed OpenSSH key
format, PEM armour around either, and the JSON header of signed tokens.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.llm.common import map_texts

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "openssh", "der", "pem")

KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Tried at the start of every segment, as a dotted word may precede a token. The base64 of a JSON object begins with one
#: of these characters, whatever whitespace stands in or before its brace.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([eCDI][A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48,}={0,2}")
#: A further line of a wrapped run.
NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
#: Line ends and slashes as string literals and JSON write them, once or more often escaped.
ESCAPED_END, ESCAPED_SLASH = re.compile(r"\\+(?:[rnt]|u000[9aAdD])"), re.compile(r"\\+/")
#: Headers of encrypted traditional keys; they may stand in one line with the body if line ends were lost.
ENCRYPTED = re.compile(r"Proc-Type:\s*\d\s*,\s*ENCRYPTED\b")
DEK_INFO = re.compile(r"DEK-Info:\s*([A-Za-z0-9-]+)(?:\s*,\s*([0-9A-Fa-f]+))?")
#: What the ciphers of encrypted traditional keys start from, in hex digits, and the least block and key they give, in bytes.
VECTOR_DIGITS, CIPHER_BLOCK, LEAST_SEALED = (16, 32), 8, 48
OPENSSH_MAGIC = b"openssh-key-v1\0"
#: Object identifiers of key algorithms, in DER: RSA, EC, Ed25519, Ed448, X25519, DSA.
KEY_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b6571", "2b656e", "2a8648ce380401"))


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the DER item at ``at``; None if its length doesn't fit before ``end``."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    start = at + 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or start + n > end or data[start] == 0:
            return None
        size = int.from_bytes(data[start : start + n], "big")
        if size < 0x80:
            return None
        start += n
    return (tag, start, start + size) if start + size <= end else None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill ``at`` to ``end`` exactly, or None."""
    items = []
    while at < end:
        if (item := der_item(data, at, end)) is None:
            return None
        items.append(item)
        at = item[2]
    return items


def is_private_der(data: bytes) -> bool:
    """Whether ``data`` is a PKCS #1, PKCS #8 (plain or encrypted) or SEC 1 private key whose nested lengths all fit."""
    top = der_item(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data) or not (items := der_children(data, top[1], top[2])):
        return False
    tags = [t for t, _, _ in items]
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and data[items[0][1] : items[0][2]] in (b"\0", b"\1"):
        return True
    if tags[:3] == [0x02, 0x30, 0x04]:
        inner = der_children(data, items[1][1], items[1][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]] in KEY_OIDS
    if tags[:2] == [0x02, 0x04] and data[items[0][1] : items[0][2]] == b"\1":
        return 16 <= items[1][2] - items[1][1] <= 72
    if tags == [0x30, 0x04]:
        inner = der_children(data, items[0][1], items[0][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] :].startswith(bytes.fromhex("2a864886f70d0105"))
    return False


def is_openssh_key(data: bytes) -> bool:
    """Whether ``data`` is the OpenSSH private-key format: three strings, a key count, then that many keys and a secret part."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at, parts = len(OPENSSH_MAGIC), 3
    while parts:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at, parts = at + 4 + size, parts - 1
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16:
        return False
    for _ in range(count + 1):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return False
        at += 4 + size
    return not data[at:].strip(b"\0")


def decode64(text: str) -> bytes | None:
    """Base64 or base64url of any padding; None if it isn't that."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(text: str) -> dict | None:
    try:
        found = json.loads(decode64(text) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def armoured(body: str) -> tuple[bytes | None, bool]:
    """What the body of PEM armour decodes to (None if it is no base64), and whether it is an encrypted traditional key.

    Such a key has both headers, a vector of a cipher's size, and whole cipher blocks.
    """
    plain = ESCAPED_SLASH.sub("/", ESCAPED_END.sub("\n", body))
    bare, marked = ENCRYPTED.subn("\n", plain)
    cipher = DEK_INFO.search(bare)
    lines = (x for x in DEK_INFO.sub("\n", bare).splitlines() if ":" not in x)
    data = decode64("".join("".join(lines).split()))
    sealed = bool(marked and cipher and len(cipher[2] or "") in VECTOR_DIGITS)
    return data, sealed and data is not None and len(data) >= LEAST_SEALED and len(data) % CIPHER_BLOCK == 0


def key_kind(data: bytes | None) -> str | None:
    """The kind of key that the bytes are."""
    if not data:
        return None
    return "openssh" if is_openssh_key(data) else "der" if is_private_der(data) else None


def wrapped_key(text: str, first: re.Match) -> tuple[int, str] | None:
    """(end, kind) of the key that starts with the run ``first`` and may go on in lines of equal width, the last one shorter."""
    lines, ends = [first[0]], [first.end()]
    while not lines[-1].endswith("=") and (more := NEXT_LINE.match(text, ends[-1])):
        if len(lines) > 1 and len(more[1]) > len(lines[1]):
            break
        lines.append(more[1])
        ends.append(more.end())
        if len(lines) > 2 and len(more[1]) < len(lines[1]):
            break
    # What looks like a last line may be the text that follows.
    for n in {len(lines), len(lines) - 1, 1} - {0}:
        if kind := key_kind(decode64("".join(lines[:n]))):
            return ends[n - 1], kind
    return None


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates whose decoded structure is that of a key or of a signed token."""
    found = []
    end = 0
    for m in TOKEN.finditer(text):
        if m.start() < end:
            continue
        head = json_object(m[1])
        if head is not None and isinstance(head.get("alg"), str) and (json_object(m[2]) is not None or "enc" in head):
            if m[3] or head["alg"].lower() == "none":
                end = m.end(3)
                found.append((m.start(), end, "jwt"))
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            data, encrypted = armoured(m[2])
            if data and (encrypted or is_private_der(data) or is_openssh_key(data)):
                found.append((m.start(), m.end(), "pem"))
    end = 0
    for m in RUN.finditer(text):
        # A DER sequence or the OpenSSH magic shows in the first characters; nothing else is decoded.
        if m.start() >= end and (m[0][0] == "M" or m[0].startswith("b3BlbnNzaC")) and (key := wrapped_key(text, m)):
            end = key[0]
            found.append((m.start(), *key))
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2].lower() in {"30", "6f"} and (kind := key_kind(bytes.fromhex(m[0]))):
            found.append((m.start(), m.end(), kind))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns: leftmost, non-overlapping in each kind, too short ones dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, then end; comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with the union of the spans replaced by one ``[SECRET]`` a merged run."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e, _ in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]]) if merged else text


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base, more = base_spans(text), structural_spans(text)
            counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, counts of the base kinds, SHA-256 of the base spans, all spans, and how many were confirmed by structure.

    A null text counts as empty and has no spans. Repeated rows give repeated results, an empty table an empty one;
    extra columns are ignored. Offsets are code points, ends exclusive. There is no shuffle: each text is scanned
    whole where it is read.
    """
    return map_texts(docs.select("doc_id", "text"), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if t is None else redact(t, base_spans(t) + structural_spans(t)) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``; all rows and columns stay, null texts stay null."""
    return map_texts(docs, _redact, docs.schema)
