"""Secrets in texts: pattern matches, and structures that decode to keys or signed tokens.

Base kinds are matched as written: ``assign``, ``access``, ``hex``. Structural
confirmation adds spans only where a candidate decodes and its contents parse:

``jwt``  a signed token: a JSON header that names an algorithm, a JSON payload and a signature
``pem``  an armoured private key whose body parses as one; encrypted bodies and escaped line ends count too
``der``  base64 or hex of a private key in DER (PKCS#1, PKCS#8, SEC1, DSA, encrypted PKCS#8), also
         wrapped over lines: its own nested lengths say where it ends
``ssh``  base64 of a private key container in SSH's wire format, all of whose lengths add up

Public keys, certificates and signatures have other fields and are not reported.
A ``der`` or ``ssh`` body inside a ``pem`` span is part of that span.

Offsets are code points, ends exclusive. Null texts count as empty. Texts are
scanned whole and one by one, so repeated rows and ties are of no account; keys
may be of any size, and a key that says it is longer than the base64 around it is
refused unread, so very long texts cost about their length. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_or_empty

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
BASE = KINDS[:3]

# The base patterns and the candidates for decoding.
_ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_BREAK = r"(?:\r?\n|\\r|\\n)"
_PEM = re.compile(
    rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:{_BREAK}[ \t]*[A-Za-z-]+: [^\r\n\\]*)*)((?:[A-Za-z0-9+/=\s]|\\[rn])*)-----END \1-----"
)
# the first bytes of a DER sequence, and of SSH's container, in base64 and hex
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{22,}")
_REST = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+)")
_RUN = re.compile(r"[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
_SSH_MAGIC = b"openssh-key-v1\0"
# Tags of DER, and what the identifiers of password-based encryption begin with.
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))


def decoded64(text: str) -> bytes | None:
    """Base64 in either alphabet, padding optional; None where it isn't."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_header(raw: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, where the value begins, where it ends) of the DER value at ``at``; None where its length isn't well-formed."""
    if at + 2 > len(raw):
        return None
    tag, size, at = raw[at], raw[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(raw) or raw[at] == 0:
            return None
        size, at = int.from_bytes(raw[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return tag, at, at + size


def der_fields(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The headers of consecutive DER values that fill ``raw[at:end]`` exactly; None where lengths don't add up."""
    fields = []
    while at < end:
        header = der_header(raw, at)
        if header is None or header[2] > end:
            return None
        fields.append(header)
        at = header[2]
    return fields


def is_der_key(raw: bytes) -> bool:
    """One sequence, whole and exact, with the fields of a private key."""
    whole = der_fields(raw, 0, len(raw))
    if not whole or len(whole) != 1 or whole[0][0] != SEQUENCE:
        return False
    fields = der_fields(raw, *whole[0][1:])
    if not fields or len(fields) < 2:
        return False
    tags = [f[0] for f in fields]
    value = lambda f: raw[f[1] : f[2]]
    inner = lambda f: der_fields(raw, f[1], f[2]) or [(0, 0, 0)]
    if tags[0] == SEQUENCE:  # encrypted PKCS#8: algorithm, octets
        kind = inner(fields[0])[0]
        return tags == [SEQUENCE, OCTETS] and kind[0] == OID and value(kind).startswith(ENCRYPTIONS)
    if tags[0] != INTEGER or value(fields[0]) not in (b"\0", b"\1"):
        return False
    if tags[1] == SEQUENCE:  # PKCS#8: version, algorithm, octets, attributes
        return tags[2:3] == [OCTETS] and inner(fields[1])[0][0] == OID and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:])
    if tags[1] == OCTETS:  # SEC1: version 1, octets, curve, point
        return value(fields[0]) == b"\1" and fields[1][2] - fields[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    numbers = len(tags) - (tags[-1] == SEQUENCE)  # PKCS#1, and the six numbers of DSA
    return numbers in (6, 9) and all(t == INTEGER for t in tags[:numbers])


def ssh_size(raw: bytes) -> tuple[bool, int] | None:
    """(True, bytes of the private key container that ``raw`` begins with), as its lengths say, or (False, bytes that are needed to tell); None where it is none.

    Fields: cipher, key derivation and its options, a count, as many public keys, the private part.
    """
    at, n, keys = len(_SSH_MAGIC), 0, 1
    if not raw.startswith(_SSH_MAGIC):
        return None
    while n < 5 + keys:
        if at + 4 > len(raw):
            return False, at + 4
        size = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if n == 3:
            keys = size
        else:
            at += size
        if n == 4 + keys and not size:
            return None
        n += 1
    return True, at


def is_ssh_key(raw: bytes) -> bool:
    """The private key container, whole and exact."""
    return ssh_size(raw) == (True, len(raw))


def is_jwt(header: str, payload: str, signature: str) -> bool:
    """The header names an algorithm that signs, the payload is an object and the signature decodes."""
    raw, body = decoded64(header), decoded64(payload)
    try:
        head = json.loads(raw) if raw else None
        signed = isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none"
        return signed and isinstance(json.loads(body or b""), dict) and bool(decoded64(signature))
    except (ValueError, RecursionError):
        return False


def is_pem_key(label: str, headers: str, body: str) -> bool:
    """The body decodes to a private key, or to whole cipher blocks where the headers say that it is encrypted."""
    raw = decoded64(re.sub(r"\\[rn]|\s", "", body))
    if not raw:
        return False
    if "DEK-Info:" in headers:
        return len(raw) >= 32 and len(raw) % 8 == 0
    return is_ssh_key(raw) if label.startswith("OPENSSH") else is_der_key(raw)


def lines_at(text: str, start: int, end: int, wanted: int) -> tuple[str, int]:
    """At least ``wanted`` base64 characters from ``start`` on, to ``end`` and from the lines that follow, and where they end."""
    parts, size = [text[start:end]], end - start
    while size < wanted and (more := _REST.match(text, end)):
        parts.append(more[1])
        size, end = size + len(more[1]), more.end()
    return "".join(parts), end


def ssh_size_at(text: str, start: int, end: int, run_end: int) -> int | None:
    """Bytes of the container whose base64 begins at ``start``: as much is read as its lengths ask for, at least twice as much each time."""
    need = 1024
    while True:
        wanted = -(-need * 4 // 3)
        some, _ = lines_at(text, start, end, wanted)
        found = ssh_size(decoded64(some) or decoded64(some[: len(some) // 4 * 4]) or b"")
        if found is None or found[0]:
            return found and found[1]
        if len(some) < wanted or found[1] * 4 > (run_end - start) * 3:
            return None
        need = max(found[1], 2 * need)


def key_at(text: str, start: int, end: int, run_end: int) -> tuple[int, int] | None:
    """(kind's number, end) of the key whose base64 begins at ``start`` and runs on its line to ``end``, and over later ones to ``run_end`` at most.

    How many characters it has comes from its own lengths; the last line must end with it.
    """
    head = decoded64(text[start : start + 24])
    if head and head.startswith(_SSH_MAGIC):
        size = ssh_size_at(text, start, end, run_end)
    else:
        header = der_header(head, 0) if head else None
        first = der_header(head, header[1]) if header else None
        # the first field is a version or an algorithm inside the sequence
        size = header[2] if first and first[0] in (INTEGER, SEQUENCE) and first[2] <= header[2] else None
    wanted = -(-(size or 0) * 4 // 3)
    if not size or wanted > run_end - start:
        return None
    body, end = lines_at(text, start, end, wanted)
    raw = decoded64(body) if len(body) == wanted else None
    if not raw or not (is_der_key(raw) or is_ssh_key(raw)):
        return None
    pad = 0
    while pad < -len(body) % 4 and text[end : end + 1] == "=":
        end, pad = end + 1, pad + 1
    return (5 if is_der_key(raw) else 6), end


def keys_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the keys in base64."""
    starts = [(m.start(), m.end()) for m in _BASE64.finditer(text)]
    found, runs, run_end = [], _RUN.finditer(text, starts[0][0]) if starts else iter(()), 0
    for a, b in starts:
        while run_end <= a:
            run_end = next(runs).end()
        if key := key_at(text, a, b, run_end):
            found.append((a, *key))
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in that order."""
    found: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_jwt(m[1], m[2], m[3])]
    armoured = []
    if "PRIVATE KEY-----" in text:
        armoured = [(m.start(), 4, m.end()) for m in _PEM.finditer(text) if is_pem_key(m[1], m[2], m[3])]
    bare = keys_of(text)
    for m in _HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            bare.append((m.start(), 5, m.end()))
    found += armoured + [x for x in bare if not any(a <= x[0] < b for a, _, b in armoured)]
    return sorted(set(found))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span, or overlapping run of spans, replaced by its first kind's name in brackets."""
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, doc_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, redacted); redacted is null where nothing was found."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t) for t in texts]
            base = [[x for x in f if x[1] < len(BASE)] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(len(BASE))]
                + [
                    pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string()),
                    pa.array([joined(f) for f in found], pa.string()),
                    pa.array([redacted(t, f) if f else None for t, f in zip(texts, found, strict=True)], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"],
            )

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        lean(run),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string",
    )


def redact(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` with each secret in the text replaced by its kind in brackets; null texts stay null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t if t is None else redacted(t, spans(t)) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)
