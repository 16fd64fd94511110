"""Secrets in texts: patterns, then structural confirmation of encoded key material.

Patterns find assignments, access keys and long hex runs. Beyond them, runs of
base64 or hex are decoded and reported only if what they decode to has the
structure of a key: DER whose nested lengths add up, an OpenSSH private key or
wire-format public key whose length-prefixed fields fill it, or a signed token
whose header is JSON that names an algorithm. Base64 may go over lines, also
indented or quoted ones; where a key ends is told by its own lengths.

Defined results: null or empty text has no spans; spans are in code points, end
exclusive; every match of a kind is reported, however long the text; rows that
repeat a doc_id are judged each for itself. Only ``doc_id`` and ``text`` are read.
"""

import base64
import hashlib
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skygrade.llm.common import map_batches, texts

ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more; shorter runs would be dropped
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
BASE64 = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}(?:\r?\n[\x20\t>]*[A-Za-z0-9+/]+={0,2})*")
LINE = re.compile(r"([A-Za-z0-9+/]+)={0,2}")
#: How base64 of a DER sequence, of public SSH keys and of a private one begins.
BEGINS = re.compile(r"M[A-P]|AAAA(?:B3NzaC1|C3NzaC1|E2VjZHNh)|b3BlbnNzaC1rZXktdjE")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE_KINDS = KINDS[:3]

#: One pass of a linear-time matcher leaves the texts that can hold any kind. It accepts more than the patterns above.
MAYBE = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9A-Fa-f]{32}|[A-Za-z0-9+/]{32}"
    r"|[A-Za-z0-9_-]{10}\.[A-Za-z0-9_-]+\."
)

SSH_MAGIC = b"openssh-key-v1\0"
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
DER_SEQUENCE, DER_SET, DER_INTEGER = 0x30, 0x31, 0x02
DEEPEST = 12


def der_items(data: bytes, start: int, end: int):
    """(tag, start, end) of the values that fill data[start:end]; None if the lengths do not add up."""
    items = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, body = data[start], data[start + 1], start + 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or body + size > end:
                return None
            length, body = int.from_bytes(data[body : body + size], "big"), body + size
        if body + length > end:
            return None
        items.append((tag, body, body + length))
        start = body + length
    return items


def nested(data: bytes, start: int, end: int, depth=0) -> bool:
    """Whether all sequences and sets inside are filled exactly by their values."""
    items = der_items(data, start, end)
    if items is None or depth > DEEPEST:
        return False
    return all(nested(data, a, b, depth + 1) for tag, a, b in items if tag in (DER_SEQUENCE, DER_SET))


def is_der_key(data: bytes) -> bool:
    """One sequence fills the data, and begins as keys do: an integer, or an algorithm's sequence and a bit or octet string."""
    if len(data) < 24 or data[0] != DER_SEQUENCE:
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or not nested(data, 0, len(data)):
        return False
    inner = der_items(data, outer[0][1], outer[0][2])
    tags = [tag for tag, _, _ in inner]
    if tags == [DER_SEQUENCE, 0x04]:  # an encrypted key; its algorithm has parameters, as a mere digest's has not
        return [tag for tag, _, _ in der_items(data, *inner[0][1:])] == [0x06, DER_SEQUENCE]
    return len(tags) >= 2 and (tags[0] == DER_INTEGER or tags[:2] == [DER_SEQUENCE, 0x03])


def fields(data: bytes, at: int, most=64):
    """Values with 32-bit lengths from ``at`` on, up to ``most``, and where they end; None if a length runs over."""
    found = []
    while at + 4 <= len(data) and len(found) < most:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return found, at


def is_ssh_key(data: bytes) -> bool:
    """Fields that fill the data: a key type and its numbers, or an OpenSSH private key.

    The latter has cipher, key derivation and its options, the number of keys,
    as many public keys, and the private part.
    """
    if data.startswith(SSH_MAGIC):
        head = fields(data, len(SSH_MAGIC), 3)
        if not head or len(head[0]) < 3:
            return False
        keys = int.from_bytes(data[head[1] : head[1] + 4], "big")
        rest = fields(data, head[1] + 4)
        return bool(rest) and rest[1] == len(data) and len(rest[0]) == keys + 1
    found = fields(data, 0)
    return bool(found) and found[1] == len(data) and len(found[0]) >= 2 and found[0][0] in SSH_TYPES


def is_token_header(part: str) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def key_kind(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def unbase64(symbols: str) -> bytes:
    """Bytes of base64 without padding; a last symbol that makes no byte is left out."""
    symbols = symbols[: len(symbols) - (len(symbols) % 4 == 1)]
    return base64.b64decode(symbols + "=" * (-len(symbols) % 4))


def symbols_of(n: int) -> int:
    return (4 * n + 2) // 3


def possible_sizes(head: bytes, data) -> list[int]:
    """Bytes that a key may have which begins with ``head``; ``data`` gives all that follows, if it is needed."""
    if head[0] == DER_SEQUENCE:
        size = head[1] & 0x7F if head[1] >= 0x80 else 0
        return [2 + size + (int.from_bytes(head[2 : 2 + size], "big") if size else head[1])]
    found, sizes = data(), []
    at = len(SSH_MAGIC) if found.startswith(SSH_MAGIC) else 0
    while at + 4 <= len(found) and len(sizes) < 72:
        if at and found.startswith(SSH_MAGIC) and len(sizes) == 3:
            at += 4  # the number of keys
        at += 4 + int.from_bytes(found[at : at + 4], "big")
        sizes.append(at)
    return sizes


def base64_spans(text: str):
    """Keys in base64 lines: one begins with a line of 32 symbols or more and ends with the line where its lengths say."""
    for run in BASE64.finditer(text):
        lines = [(m.start(), m.end(1), m.end()) for m in LINE.finditer(text, run.start(), run.end())]
        symbols = "".join(text[a:b] for a, b, _ in lines)
        begins, ends, at, fence = [], {}, 0, []
        for i, (a, b, c) in enumerate(lines):
            begins.append(at)
            at += b - a
            ends[at] = c
            if b < c:
                fence.append(at)  # nothing goes on after padding
        fence.append(at)
        done, wall = 0, 0
        for (a, b, _), begin in zip(lines, begins):
            while fence[wall] <= begin and wall < len(fence) - 1:
                wall += 1
            if begin < done or b - a < 32 or not BEGINS.match(symbols, begin):
                continue
            most = fence[wall]
            for size in possible_sizes(unbase64(symbols[begin : begin + 32]), lambda: unbase64(symbols[begin:most])):
                end = begin + symbols_of(size)
                if end <= most and end in ends and (kind := key_kind(unbase64(symbols[begin:end])[:size])):
                    yield kind, a, ends[end]
                    done = end
                    break


def base_spans(text: str):
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def confirmed_spans(text: str):
    yield from base64_spans(text)
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            yield kind, m.start(), m.end()
    for m in SIGNED.finditer(text):
        if is_token_header(m[1]):
            yield "jwt", m.start(), m.end()


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed, then end; equal spans once."""
    found = {*base_spans(text), *confirmed_spans(text)}
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(column) -> list:
    maybe = pc.match_substring_regex(column, MAYBE).to_pylist()
    return [find_spans(text.as_py()) if hit else [] for text, hit in zip(column, maybe)]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end)."""

    def run(batch):
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in found] for found in _found(batch.column("text"))]
        return [batch.column("doc_id"), pa.array(spans, SPAN_TYPE)]

    return map_batches(texts(docs), run, f"doc_id long, spans {SPANS}")


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 of the spans of these kinds, spans as text."""

    def run(batch):
        rows = []
        for found in _found(batch.column("text")):
            base = [s for s in found if s[0] in BASE_KINDS]
            counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))]

    return map_batches(texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
