"""Documents as token ids, packed into as few sequences of fixed capacity as a bounded number of open bins allows.

Only documents longer than a sequence are cut: into full sequences after a first
piece that takes what is over. Each task packs its pieces online by best fit: a
piece goes into the open bin with the least free space that holds it, found in a
bitset with one bit for each amount of free space. When more than ``open_bins``
are open, the fullest closes. Pieces arrive in buffers of bounded size, longest
first. Bins that a task leaves open are items of a further, much smaller packing,
until one task has packed what is left; the joins that follow them hold one row
for each bin left open.

Defined results: null text is empty, and an empty document is its end token alone;
repeated rows are packed as often as they occur, rows without an id like others;
an empty table gives an empty table. Strings of special tokens in a text are read
as those tokens, as the tokenizer's file says. Only ``doc_id`` and ``text`` are
read, other columns cannot clash.
"""

import os
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skygrade.llm.bytebpe import Codec, byte_table
from skygrade.llm.common import Scratch, as_batches
from skygrade.operators.spread import lookup_join

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END = 0  # id after each document
OPEN_BINS = 16_384
BUFFER = 16_384  # pieces that are put in order at once; one may need a bin of its own, so no more than OPEN_BINS
TASK_PIECES = 100_000  # pieces that one task packs: the more, the better they fit
TASK_BINS = 1_000_000  # open bins of earlier tasks that one task packs

#: Neither letter, digit, space nor apostrophe: a run of them is a piece of its own.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

SLICE = 8_000_000  # bytes of text cut into words at once
REMEMBERED = 300_000  # words and parts a worker keeps the ids of

_encoders = {}


def merger(content: str):
    """Function from a part to its tokens; a part that is a token itself is looked up where that gives the same."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    merge = tokenizer.model.tokenize
    special = tokenizer.get_added_tokens_decoder()
    if all(len(merge(token)) == 1 for token, i in tokenizer.get_vocab().items() if i not in special):
        tokenizer.model.ignore_merges = True
    return tokenizer.model.tokenize


class Encoder(Codec):
    """Ids of texts by a tokenizer's file; words that a worker has seen are looked up."""

    def remembered(self) -> int:
        return REMEMBERED

    def __init__(self, content: str, pattern=public_tokenizers.PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(content)
        self.special = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.merge = merger(content)
        self.alphabet = dict(enumerate(byte_table()))
        self.pattern = regex.compile(pattern)
        self.seen, self.pieces = {}, {}

    def parts(self, chunk: str) -> list[str]:
        """What the pattern finds; words that end in marks, and such words around one line break, need no search."""
        line, gap, after = chunk.partition("\n")
        if gap and after and line and not line[-1].isspace() and not after[0].isspace():
            return [*self.parts(line), gap, *self.parts(after)]
        base = chunk.rstrip(MARKS)
        if base and (base[1:] if base[0] == " " else base).isalpha():
            return [base, chunk[len(base) :]] if len(base) < len(chunk) else [chunk]
        return self.pattern.findall(chunk)

    def ids(self, part: str) -> bytes:
        shown = part.encode().decode("latin-1").translate(self.alphabet)
        coded = self.pieces[part] = array("I", [token.id for token in self.merge(shown)]).tobytes()
        return coded

    def learn(self, chunks: list[str]) -> list[bytes]:
        known = self.pieces.get
        return [b"".join([known(part) or self.ids(part) for part in self.parts(chunk)]) for chunk in chunks]

    def encode(self, batch: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(batch, pa.string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a column without nulls, in slices of about ``SLICE`` bytes."""
        rows = max(1, int(len(column) * SLICE / max(column.nbytes, 1)))
        return [coded for at in range(0, len(column), rows) for coded in self.encode_slice(column.slice(at, rows))]

    def encode_slice(self, column: pa.Array) -> list[bytes]:
        """Texts are cut at their spaces, and each different part of the slice is looked up once.

        As in ``cut``, a text where another gap stands next to a space is searched whole.
        """
        lists = pc.split_pattern(column, " ")
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        parts = lists.flatten().dictionary_encode()
        words, at = parts.dictionary.to_pylist(), parts.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        first = ends - counts
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words])
        whole = np.logical_or.reduceat(odd[at], first)
        if max(len(self.seen), len(self.pieces)) > self.remembered():
            self.seen, self.pieces = {}, {}
        new = [w for w, strange in zip(words, odd.tolist()) if not strange and w not in self.seen]
        self.seen.update(zip(new, self.learn([" " + w for w in new])))
        heads = [words[i] for i in at[first].tolist()]
        table = [*[self.seen.get(w, b"") for w in words], *self.learn(heads)]
        at[first] = len(words) + np.arange(len(column))  # a text's first part has no space before it
        sizes = np.array([len(coded) // 4 for coded in table])
        begin, length = (np.cumsum(sizes) - sizes)[at], sizes[at]
        upto = np.cumsum(length)
        ids = np.frombuffer(b"".join(table), "<u4")[np.repeat(begin - upto + length, length) + np.arange(upto[-1])]
        stop = upto[ends - 1]
        out = [ids[i:j].tobytes() for i, j in zip([0, *stop[:-1].tolist()], stop.tolist())]
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.learn([column[i].as_py()])[0]
        for token in self.special:
            for i in np.flatnonzero(pc.match_substring(column, token).to_numpy(zero_copy_only=False)).tolist():
                out[i] = array("I", self.whole.encode(column[i].as_py(), add_special_tokens=False).ids).tobytes()
        return out


def encoder(content: str) -> Encoder:
    if content not in _encoders:
        _encoders.clear()
        _encoders[content] = Encoder(content)
    return _encoders[content]


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = tokens if tokens <= capacity else tokens % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, tokens, capacity))]


def pieces(docs: DataFrame, path=TOKENIZER, capacity=CAPACITY, keep_ids=False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids where they are wanted."""
    with open(path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]

    def run(batches):
        own, end = encoder(content.value), array("I", [END]).tobytes()
        for batch in batches:
            rows, ids = [], []
            for doc, coded in zip(batch.column("doc_id").to_pylist(), own.encode_column(batch.column("text"))):
                coded += end
                for number, (start, length) in enumerate(cuts(len(coded) // 4, capacity)):
                    part = coded[4 * start : 4 * (start + length)]
                    rows.append((doc, number, start, length, zlib.crc32(part)))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            if rows:
                doc, number, start, length, crc = zip(*rows)
                columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield from as_batches(columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


class Bins:
    """Best fit into open bins, which are kept by free space."""

    def __init__(self, capacity: int, open_bins: int, first: int):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.free = [[] for _ in range(capacity + 1)]  # numbers of the bins with so much space
        self.bits = self.count = 0

    def put(self, size: int) -> tuple[int, int]:
        """The bin and the place in it of an item of ``size``."""
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self.take(space)
        else:
            space, number = self.capacity, self.next
            self.next += 1
        if space > size:
            self.free[space - size].append(number)
            self.bits |= 1 << (space - size)
            self.count += 1
            if self.count > self.open_bins:
                self.take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - space

    def take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.count -= 1
        return number

    def left(self) -> list[tuple[int, int]]:
        """(bin, length of its content) of the bins that are still open."""
        return [(number, self.capacity - space) for space, numbers in enumerate(self.free) for number in numbers]


def packed_by_task(items: DataFrame, level: int, capacity: int, open_bins: int, buffer: int) -> DataFrame:
    """Items (item, length) with their bin and place, and the bins each task leaves open as rows without a place.

    Bin numbers hold the level, the task and a count, so a repeated task gives the same.
    """

    def run(batches):
        bins = Bins(capacity, open_bins, (level << 56) | (TaskContext.get().partitionId() << 32))
        held, rows, kind = [], 0, None

        def placed():
            table = pa.Table.from_batches(held)
            table = table.take(pa.array(np.argsort(-table.column("length").to_numpy(), kind="stable")))
            spots = [bins.put(size) for size in table.column("length").to_pylist()]
            number, place = (pa.array(c, pa.int64()) for c in zip(*spots))
            return as_batches([table.column("item"), table.column("length"), number, place], names)

        for batch in batches:
            kind = batch.column("item").type
            for at in range(0, batch.num_rows, buffer):
                part = batch.slice(at, buffer)
                if rows + part.num_rows > buffer:
                    yield from placed()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from placed()
        if left := bins.left():
            number, length = (pa.array(c, pa.int64()) for c in zip(*left))
            yield from as_batches([pa.nulls(len(left), kind), length, number, pa.nulls(len(left), pa.int64())], names)

    names = ["item", "length", "bin", "place"]
    given = items.select("item", F.col("length").cast("long").alias("length"))
    schema = StructType([StructField("item", given.schema["item"].dataType), *(StructField(name, LongType()) for name in names[1:])])
    return given.mapInArrow(run, schema)


def pack(parts: DataFrame, capacity=CAPACITY, open_bins=OPEN_BINS, buffer=BUFFER, task_pieces=TASK_PIECES, task_bins=TASK_BINS) -> DataFrame:
    """``parts`` (any columns, one of them ``length``) with sequence_id and offset."""
    scratch = Scratch(parts.sparkSession)
    # Written first, so that no text is encoded again when a packing task is repeated.
    written = scratch.write(parts, "pieces")
    items = written.select(F.struct(*parts.columns).alias("item"), "length").coalesce(-(-max(1, written.count()) // task_pieces))
    done = scratch.write(packed_by_task(items, 0, capacity, open_bins, buffer), "packed")
    spots, left = done.where("place is not null"), done.where("place is null")
    level, moved, rows, tasks = 0, None, left.count(), 0
    while rows and tasks != 1:
        level, tasks = level + 1, -(-rows // task_bins)
        again = left.select(F.col("bin").alias("item"), "length").repartition(tasks)
        done = scratch.write(packed_by_task(again, level, capacity, open_bins, buffer), "packed")
        step = done.where("place is not null").select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("place").alias("by"))
        if moved is None:
            moved = step
        else:
            follow = moved.join(step.toDF("to", "then", "more"), "to", "left")
            moved = follow.select("bin", F.coalesce("then", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
        left = done.where("place is null")
        rows = left.count()
    if moved is None:
        return spots.select("item.*", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    followed = lookup_join(spots, moved, ["bin"], "left")
    place = F.col("place") + F.coalesce("by", F.lit(0))
    return followed.select("item.*", F.coalesce("to", "bin").alias("sequence_id"), place.alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of the whole sequence, from packed pieces with their ids; a sequence holds ``capacity`` ids at most."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))


def packed_documents(docs: DataFrame, path=TOKENIZER, capacity=CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, path, capacity), capacity)
