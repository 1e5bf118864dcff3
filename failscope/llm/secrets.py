"""Secret scans with structural confirmation."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# The base kinds in order, with the pattern of each and the least characters (of group 2 for assign).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 24),
)
#: Kinds that structural confirmation adds, in order after the base kinds.
CONFIRMED = ("der_key", "ssh_key", "pem_key", "signed_token")

#: Most characters of a signed token's header.
HEADER = 1 << 14

# No pattern looks at a character of a long run from more than a few starts, so all are linear in the text.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+)", re.ASCII)
_BRACE = re.compile(r'\{(?=[\s"}])')
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}", re.ASCII)
_HEX = re.compile(r"[0-9A-Fa-f]{64,}", re.ASCII)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}+(?:\r?\n|\\n)[\x20\t]*+)++[A-Za-z0-9+/_-]*+={0,2}", re.ASCII)
_BREAK = re.compile(r"\\r|\\n|\s")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----", re.ASCII)
_PEM_HEADER = re.compile(r"[A-Za-z0-9-]+: [^\n]*")
# Object identifiers of public-key algorithms (RSA, DSA, elliptic curve, X25519, X448, Ed25519, Ed448) and of
# password-based encryption (the arcs of PKCS#5 and PKCS#12), as encoded bytes.
_ALGORITHMS = tuple(map(bytes.fromhex, ("2a864886f70d010101", "2a8648ce380401", "2a8648ce3d0201", "2b656e", "2b656f", "2b6570", "2b6571")))
_ENCRYPTIONS = tuple(map(bytes.fromhex, ("2a864886f70d0105", "2a864886f70d010c01")))


def _items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the nested values that fill data[start:end] exactly, or None."""
    out = []
    while start < end:
        if start + 2 > end:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n >= 128:
            size = n - 128
            if not 1 <= size <= 4 or at + size > end:
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def is_der_private_key(data: bytes) -> bool:
    """A sequence whose nested lengths fit and whose fields are those of a private key.

    Version 0 or 1 and at least eight further integers (RSA) or just five (DSA); version 1 and an octet string (elliptic
    curve); version 0 or 1, an algorithm sequence with a known identifier and an octet string (any algorithm); or, with no
    version, a password-based encryption's sequence and an octet string (encrypted key).
    """
    if len(data) < 30 or data[0] != 0x30:
        return False
    n, size = data[1], 0
    if n >= 128:
        size = n - 128
        if not 1 <= size <= 4:
            return False
        n = int.from_bytes(data[2 : 2 + size], "big")
    end = 2 + size + n
    if end > len(data) or len(data) - end > 2:
        return False
    items = _items(data, 2 + size, end)
    if not items or len(items) < 2:
        return False
    if items[0][0] == 0x30 and len(items) == 2 and items[1][0] == 0x04:
        inner = _items(data, items[0][1], items[0][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(_ENCRYPTIONS) and items[1][2] - items[1][1] >= 16
    if items[0][0] != 0x02 or items[0][2] - items[0][1] != 1:
        return False
    version, tags = data[items[0][1]], [t for t, _, _ in items]
    if version in (0, 1) and len(items) >= 9 and all(t == 0x02 for t in tags[:9]):
        return True
    if version == 0 and len(items) == 6 and all(t == 0x02 for t in tags) and min(e - s for _, s, e in items[1:]) >= 16:
        return True
    if version == 1 and tags[1] == 0x04 and 16 <= items[1][2] - items[1][1] <= 80:
        return True
    if version in (0, 1) and len(items) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        inner = _items(data, items[1][1], items[1][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]] in _ALGORITHMS
    return False


def is_ssh_private_key(data: bytes) -> bool:
    """The magic, then cipher, derivation and options as length-prefixed strings, a count and a length-prefixed key."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return False
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def token_start(head: str, body: str, signature: str) -> int | None:
    """Where in the first of three parts the header of a signed token begins, if the second is JSON and the first ends with a
    JSON object that names an algorithm; the earliest such place.

    A header is at most HEADER characters. Each of the four alignments of these is decoded once, and an object is read
    forward from every brace at which a character of base64 can begin, which ends at the first fault.
    """
    try:
        json.loads(_decoded(body))
    except (ValueError, RecursionError):
        return None
    read, best, least = json.JSONDecoder().raw_decode, None, max(0, len(head) - HEADER)
    for first in range(least, min(least + 4, len(head))):
        raw = _decoded(head[first:])
        text = raw.decode("latin-1")  # a character a byte
        stop = len(text.rstrip(" \t\r\n"))
        for m in _BRACE.finditer(text) if text[stop - 1 : stop] == "}" else ():
            at = first + m.start() // 3 * 4
            if m.start() % 3 or best is not None and at >= best:
                continue
            try:
                header, end = read(text, m.start())
                raw[m.start() :].decode() if end >= stop else None
            except (ValueError, RecursionError):
                continue
            if end >= stop and isinstance(header.get("alg"), str) and (header["alg"] == "none" or signature):
                best = at
                break
    return best


def _decoded(text: str) -> bytes:
    raw = text.rstrip("=").translate({45: 43, 95: 47})
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4))
    except (binascii.Error, ValueError):
        return b""


def _base64_key(run: str) -> str | None:
    """The kind of private key that a run of base64 holds. Only one that begins like a sequence or like the magic is
    decoded, so prose in long words costs little."""
    if not run.startswith(("MI", "MC", "MH", "MF", "MG", "MD", "ME", "b3BlbnNza")):
        return None
    data = _decoded(run)
    return "ssh_key" if is_ssh_private_key(data) else "der_key" if is_der_private_key(data) else None


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then kind; code points, end exclusive. Null: none.

    Base kinds are the patterns alone, so the confirmation takes none away. Confirmed kinds come from candidates that
    decode and parse: signed tokens, and base64 or hex runs that hold a private key's nested lengths.
    """
    text = text or ""
    found = []
    for rank, (kind, pattern, least) in enumerate(BASE):
        group = 2 if kind == "assign" else 0
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    add = lambda kind, start, end: found.append((start, len(BASE) + CONFIRMED.index(kind), kind, end))
    for m in _PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        # header lines go, and line breaks that were written out as \\n
        body = "\n".join(line for line in m[2].replace("\\r", "").replace("\\n", "\n").split("\n") if not _PEM_HEADER.match(line.strip()))
        data = _decoded("".join(body.split()))
        if is_der_private_key(data) or is_ssh_private_key(data) or ("ENCRYPTED" in m[2] and len(data) >= 64 and len(data) % 8 == 0):
            add("pem_key", m.start(), m.end())
    at = 0
    while m := _TOKEN.search(text, at) if "." in text else None:
        # what is no token may hold the head of one after its first point
        start = token_start(m[1], m[2], m[3])
        if start is not None:
            add("signed_token", m.start() + start, m.end())
        at = m.end() if start is not None else m.end(1)
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(text):
            run = _BREAK.sub("", m[0])
            if kind := _base64_key(run):
                add(kind, m.start(), m.end())
    for m in _HEX.finditer(text):
        if is_der_private_key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            add("der_key", m.start(), m.end())
    return [(kind, start, end) for start, _, kind, end in sorted(set(found))]


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs plus ``secrets`` (a column of that name is replaced): an array of (kind, start, end) for every whole text,
    however long. Null and empty texts have none; rows are independent, so repeated rows repeat; spans that begin at one
    place come in the order of kinds. Other columns pass through as they are. No rows: none. One pass, no shuffle."""
    docs = docs.drop("secrets")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, secrets array<struct<kind:string,start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, "secrets"])

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets rows: base kinds alone hashed, all spans joined."""
    base = F.expr("filter(secrets, s -> s.kind in ('assign', 'access', 'hex'))")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k, _, _ in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans")
    )
