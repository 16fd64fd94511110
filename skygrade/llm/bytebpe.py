"""Byte-level BPE over Arrow batches, with offsets, and its reversal.

Merges run in the ``tokenizers`` library on a model built from a file of ranks.
Its alphabet is the byte table of byte-level models: each byte stands as one
printable character. A text is cut by the tokenizer's pattern; pieces that a
worker has seen are taken from a table of bounded size, others are encoded in
one call per batch.

Defined results: null text is empty and has no ids; special tokens are ordinary
text; ids and offsets cover the whole text; an empty table gives an empty table.
Only ``doc_id`` and ``text`` (``ids`` for decoding) are read, other columns cannot clash.
"""

import base64
import hashlib
import os
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skygrade.llm.common import map_batches, map_slices, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SLICE = 1_000_000  # bytes of texts a task holds as strings, ids and words at a time
BLOCK = 1_000_000  # characters cut into words at once
REMEMBERED = 100_000  # words and pieces a worker keeps the ids of; beyond that it starts anew

_codecs = {}


def byte_table() -> list[str]:
    """Character of each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path=RANKS) -> list[bytes]:
    """Token bytes by rank. Read on the driver; the file is a vocabulary of fixed size."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return [base64.b64decode(token) for token, rank in sorted(pairs, key=lambda p: int(p[1]))]


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The pair each token is merged from: what the lower ranks leave of it."""
    rank = {token: i for i, token in enumerate(tokens)}
    merges = []
    for limit, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], limit))
            if rank.get(parts[best] + parts[best + 1], limit) >= limit:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


class Codec:
    """Encoder and decoder of one vocabulary, made once per worker."""

    def remembered(self) -> int:
        return REMEMBERED

    def __init__(self, tokens: list[bytes], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        table = byte_table()
        as_text = lambda b: "".join(table[x] for x in b)
        vocab = {as_text(token): i for i, token in enumerate(tokens)}
        merges = [(as_text(a), as_text(b)) for a, b in merges_of(tokens)]
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of = [bytes(back[c] for c in text) for text in vocab]
        self.pattern = regex.compile(pattern)
        self.seen, self.pieces = {}, {}

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; pieces not met before are encoded in one call."""
        cut = list(map(self.pattern.findall, chunks))
        new = list({piece for found in cut for piece in found}.difference(self.pieces))
        for piece, coded in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False)):
            self.pieces[piece] = np.array(coded.ids, "<u4").tobytes()
        return [b"".join(map(self.pieces.__getitem__, found)) for found in cut]

    def cut(self, text: str, new: set[str]) -> list[str]:
        """``text`` at its spaces, adding parts not met before to ``new``.

        The pattern always cuts before a space that stands alone between two
        words, so what follows can be looked up by itself. A text with any other
        gap next to a space (two spaces, a space at a line's end) stays whole.
        """
        head, *parts = text.split(" ")
        unknown = set(parts).difference(self.seen)
        for part in (head, *unknown) if parts else ():
            if not part or part[0].isspace() or part[-1].isspace():
                return [text]
        new |= unknown
        return [head, *parts]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, block, size = [], [], 0
        for text in batch:
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                out += self.encode_block(block)
                block, size = [], 0
        return out + self.encode_block(block)

    def encode_block(self, block: list[str]) -> list[bytes]:
        if max(len(self.seen), len(self.pieces)) > self.remembered():
            self.seen, self.pieces = {}, {}
        new = set()
        parts = [self.cut(text, new) for text in block]
        new = list(new)
        self.seen.update(zip(new, self.learn([" " + part for part in new])))
        heads = self.learn([found[0] for found in parts])
        known = self.seen.__getitem__
        return [b"".join([head, *map(known, found[1:])]) for head, found in zip(heads, parts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[list[int], list[int]]:
        """First character and the one after the last of each token; a token inside a character spans the whole of it."""
        lengths = [len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # character of each byte
        ends = list(accumulate(lengths))
        starts = [e - n for e, n in zip(ends, lengths)]
        return char[starts].tolist(), (char[np.array(ends, int) - 1] + 1).tolist()


def codec(tokens, pattern) -> Codec:
    key = (len(tokens), hashlib.sha256(b"\0".join(tokens)).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


def _shared(docs, path):
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path=RANKS, pattern=public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids, and for each id the characters it covers: starts, ends (end exclusive)."""
    tokens = _shared(docs, path)

    def run(batch):
        own = codec(tokens.value, pattern)
        given = batch.column("text").to_pylist()
        coded = own.encode(given)
        spans = [own.offsets(t, i) if t else ([], []) for t, i in zip(given, coded)]
        ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in coded]
        ints = pa.list_(pa.int32())
        return [batch.column("doc_id"), pa.array(ids, ints), pa.array([s for s, _ in spans], ints), pa.array([e for _, e in spans], ints)]

    return map_slices(texts(docs), run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(coded: DataFrame, path=RANKS) -> DataFrame:
    """doc_id and text of a table with doc_id and ids.

    Bytes are joined before they are read as characters, so a character that is
    split over tokens comes back whole; bytes that are no character become U+FFFD.
    """
    tokens = _shared(coded, path)

    def run(batch):
        own = codec(tokens.value, public_tokenizers.PATTERN)
        back = [own.decode(np.array(ids or [], "<u4").tobytes()).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
        return [batch.column("doc_id"), pa.array(back, pa.string())]

    return map_batches(coded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path=RANKS, pattern=public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    tokens = _shared(docs, path)
    sha = lambda found: pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string())

    def run(batch):
        own = codec(tokens.value, pattern)
        coded = own.encode(batch.column("text").to_pylist())
        counts = pa.array([len(x) // 4 for x in coded], pa.int64())
        return [batch.column("doc_id"), counts, sha(coded), sha(map(own.decode, coded))]

    return map_slices(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", SLICE)
