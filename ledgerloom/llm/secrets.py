"""Secret scan: three pattern kinds, and encoded candidates that count only if their structure can be parsed.

Pattern kinds (``assign``, ``access``, ``hex``) follow fixed expressions.  Structural kinds decode base64 or hex and read
what is inside: ``pem`` and ``der`` are keys whose ASN.1 lengths nest exactly, or keys in the openssh format whose length
fields add up, encrypted ones included (their algorithm and body nest, or their headers name a cipher of whole blocks);
``derhex`` is the same in hex, outside marks from 40 characters of base64 or 32 bytes of hex on one line; ``jwt`` is a signed token whose header is JSON with an algorithm and whose
claims are a JSON object.  Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import add_columns, long_field, text_field

# Fixed values of the contract.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "derhex")
MASK = "[SECRET]"

KEYWORDS = ("passw", "secret", "token", "api")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s:,.-]*?)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
SSH_MAGIC = b"openssh-key-v1\x00"


def decode64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padding optional; None if it is not base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the ASN.1 item at ``at``; None unless its length fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
    return (tag, at, at + size) if at + size <= end else None


def is_der_key(data: bytes) -> bool:
    """A sequence that spans all bytes and whose items nest exactly, with a version number and key material inside."""
    top = der_item(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    at, tags = top[1], []
    while at < top[2]:
        item = der_item(data, at, top[2])
        if not item:
            return False
        tags.append(item[0])
        if item[0] == 0x30:
            inner = item[1]
            while inner < item[2]:
                below = der_item(data, inner, item[2])
                if not below:
                    return False
                inner = below[2]
        at = item[2]
    return len(tags) >= 3 and tags[0] == 0x02 and any(t in (0x02, 0x04) for t in tags[1:])


def is_encrypted_key(data: bytes) -> bool:
    """An encrypted private key: a sequence of an algorithm (with an object identifier) and an octet string, to the last byte."""
    top = der_item(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    algorithm = der_item(data, top[1], top[2])
    if not algorithm or algorithm[0] != 0x30:
        return False
    name, body = der_item(data, algorithm[1], algorithm[2]), der_item(data, algorithm[2], top[2])
    return bool(name and name[0] == 0x06 and body and body[0] == 0x04 and body[2] == len(data) and body[2] - body[1] >= 16)


def is_ciphered(headers: str, data: bytes) -> bool:
    """A body that its headers call encrypted: a named cipher with its start value, and whole blocks."""
    named = re.search(r"^DEK-Info:\s*[A-Za-z0-9-]+\s*,\s*([0-9A-Fa-f]{16,32})\s*$", headers, re.MULTILINE)
    return bool(named) and "ENCRYPTED" in headers and len(data) >= 16 and len(data) % 8 == 0


def is_ssh_key(data: bytes) -> bool:
    """Three length-prefixed strings, a key count, then as many public keys and the private part, to the last byte."""
    if not data.startswith(SSH_MAGIC):
        return False
    at, n = len(SSH_MAGIC), 0
    for field in range(64):
        if at + 4 > len(data):
            return False
        size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if field == 3:
            n = size
            continue
        at += size
        if field >= 4 and field == 4 + n:
            return at == len(data)
    return False


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def is_jwt(token: str) -> bool:
    header, claims, signature = token.split(".")
    try:
        head, body = json.loads(decode64(header) or b"0"), json.loads(decode64(claims) or b"0")
    except ValueError:
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return (head["alg"].lower() == "none") == (signature == "")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three pattern kinds."""
    found: list[tuple[int, int, str]] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded bytes parse."""
    found = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            lines = m[2].split("\n")
            headers = "\n".join(x.strip() for x in lines if ":" in x)
            data = decode64("".join("".join(x for x in lines if ":" not in x).split()))
            if data and (is_ciphered(headers, data) if headers else is_encrypted_key(data) if m[1].startswith("ENCRYPTED") else is_key(data)):
                found.append((m.start(), m.end(), "pem"))
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_jwt(m[0])]
    inside = [(a, b) for a, b, _ in found]
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in inside)
    for m in BASE64.finditer(text):
        if free(m) and m[0][0] in "MYb" and is_key(decode64(m[0])):
            found.append((m.start(), m.end(), "der"))
    for m in HEX_KEY.finditer(text):
        if m[0][:2].lower() in ("30", "6f") and is_key(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), "derhex"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end`` by start, then by kind in the order of ``KINDS``, comma-joined."""
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal run of overlapping spans replaced by a mask."""
    out, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a < end:
            end = max(end, b)
            at = max(at, b)
            continue
        out += [text[at:a], MASK]
        at = end = b
    return "".join([*out, text[at:]])


def _report(batch: pa.RecordBatch) -> list[list]:
    rows: list[list] = [[] for _ in range(5)]
    for value in batch.column("text"):
        text = value.as_py() or ""
        base = base_spans(text)
        kinds = [k for _, _, k in base]
        figures = [kinds.count(k) for k in KINDS[:3]]
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        for column, x in zip(rows, (*figures, digest, joined(base + confirmed_spans(text))), strict=True):
            column.append(x)
    return rows


def _clean(batch: pa.RecordBatch) -> list[list]:
    texts, sizes = [], []
    own = batch.column("n_chars") if "n_chars" in batch.schema.names else None
    for i, value in enumerate(batch.column("text")):
        text = value.as_py()
        spans = base_spans(text) + confirmed_spans(text) if text else []
        texts.append(redacted(text, spans) if spans else text)
        sizes.append(len(texts[-1]) if spans else own[i].as_py() if own is not None else None)
    return [texts] if own is None else [texts, sizes]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row; a missing text counts as empty."""
    fields = [long_field("n_assign"), long_field("n_access"), long_field("n_hex"), text_field("base_sha256"), text_field("spans")]
    return add_columns(docs.select("doc_id", "text"), fields, _report, ["doc_id"])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` masked and ``n_chars`` (where there is one) counted anew."""
    fields = [text_field("text")] + ([long_field("n_chars")] if "n_chars" in docs.columns else [])
    return add_columns(docs, fields, _clean).select(*docs.columns)
