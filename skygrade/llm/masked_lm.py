"""Masked pseudo-likelihood of documents under a bidirectional window network.

Vocabulary: words (A-Z in lower case) are counted over all documents; the most
frequent have ids of their own, all others share hashed ids, so no word is
without one. The number of ids grows with the square root of the number of
distinct words. The network predicts the id at a place from the two ids on either
side: position-wise embeddings add up to a hidden layer, and the id is predicted
as two digits (the second given the first), which is an exact distribution over
all ids for the price of two short ones. Under a shared id each word has the share
that its count has of all counts there (words never counted have one count
together), so that every word has a probability of its own. The counts of all
words stay a distributed table, which the words of the documents are joined to;
only the most frequent ones travel with the tasks, which saves most of that join.

Training covers all documents: each task trains a copy in numpy on the tokens of
its partition, and copies are averaged by token count with a Spark aggregate of
one row per parameter. Only the averaged parameters reach the driver, some 64 for
each id. A document's score is the sum over its tokens of the log-probability of
each given both sides.

Defined results: null, empty or blank text has 0 tokens, score 0 and no mean;
rows that repeat a doc_id or lack one are scored each for itself; an empty table
trains nothing and gives an empty table. Beyond a document's ends stands a
boundary id that is never predicted. Only ``doc_id`` and ``text`` are read.
"""

import math
from collections import Counter
from dataclasses import dataclass
from itertools import chain, compress, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.llm.common import Scratch, as_batches, map_batches, raw, slices, texts

DIGIT = 32  # digits of an id, at least
IDS = DIGIT * DIGIT
SHARED = 64  # ids for all words beyond the frequent ones; one in 16 where there are more ids
IDS_PER_ROOT = 1.6  # ids for each unit of the square root of the number of distinct words
NEAR = 65_536  # words whose counts travel with the tasks; those of all others are joined
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
STEP = 4096  # tokens of one training step
SAFE = 80.0  # single precision holds sums of exponentials of scores up to this
RATE = 0.2
LEAST = np.float32(math.log(1e-30))  # logarithm of the least probability of a digit
COUNTED = 1_000_000  # words counted before a task passes its counts on


def tokens(texts_: list[bytes]) -> list[list[bytes]]:
    return [text.lower().split() for text in texts_]


def shared_ids(digit: int) -> int:
    return digit * digit * SHARED // IDS


def digits(distinct: int) -> int:
    """Digits of an id in a corpus of so many distinct words."""
    return max(DIGIT, math.ceil((IDS_PER_ROOT * distinct**0.5) ** 0.5))


@dataclass(frozen=True)
class Vocabulary:
    words: tuple[bytes, ...]  # by rank; id 0 is the boundary
    counts: tuple[int, ...]
    digit: int = DIGIT

    @property
    def shared(self) -> int:
        return shared_ids(self.digit)

    @property
    def first(self) -> int:
        """The first of the shared ids."""
        return self.digit**2 - self.shared

    def ids(self, texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens, two boundaries around each document, and the document of each (-1: boundary)."""
        return self.ids_of(tokens(texts_))

    def ids_of(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        return Known(self).ids(split)[:2]


class Known:
    """Ids of the frequent words and of ``near`` ones; any other word has a shared id, by its hash."""

    def __init__(self, words: Vocabulary, near=()):
        self.first, self.shared, n = words.first, words.shared, len(words.words) + 1
        self.codes = dict(zip(chain(words.words, near), range(1, n + len(near))))
        self.table = np.concatenate([np.arange(n), self.hashed(list(near))]).astype(np.int32)

    def hashed(self, words: list[bytes]) -> np.ndarray:
        return self.first + np.fromiter(map(crc32, words), np.int64, len(words)) % self.shared

    def ids(self, split: list[list[bytes]]):
        """As ``Vocabulary.ids``, with the code of each token (-1: neither frequent nor near) and the tokens without one."""
        place = np.repeat(np.arange(len(split)), np.array([len(words) for words in split], np.int64))
        codes = np.fromiter(map(self.codes.get, chain.from_iterable(split), repeat(-1)), np.int32, len(place))
        far = codes < 0
        others = list(compress(chain.from_iterable(split), far.tolist()))
        found = self.table[codes]
        found[far] = self.hashed(others)
        at = np.arange(len(place)) + 2 * place + 2
        ids, owners = (np.full(len(place) + 2 * len(split) + 2, v, t) for v, t in ((0, np.int32), (-1, np.int64)))
        ids[at], owners[at] = found, place
        return ids, owners, codes, others


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def run(batches):
        for batch in batches:
            counts, n = Counter(), 0
            for text in raw(batch.column("text")):
                words = text.lower().split()
                counts.update(words)
                n += len(words)
                if n > COUNTED:
                    yield from out(counts)
                    counts, n = Counter(), 0
            yield from out(counts)

    def out(counts):
        if counts:
            yield from as_batches([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    partial = texts(docs).select("text").mapInArrow(run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list:
    """The first ``size`` rows by count, ties by the word itself; little more than these leave their tasks."""
    sizes = sorted(counts.groupBy("n").count().collect(), key=lambda r: -r.n)
    enough, least = 0, 1
    for row in sizes:
        least, enough = row.n, enough + row["count"]
        if enough >= size:
            break
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()


def ranked(counts: DataFrame, further=0) -> tuple[Vocabulary, dict[bytes, int]]:
    """The words that have ids of their own, and the counts of ``further`` words after them."""
    digit = digits(counts.count())
    size = digit * digit - shared_ids(digit) - 1
    rows = most_frequent(counts, size + further)
    words = Vocabulary(tuple(bytes(r.word) for r in rows[:size]), tuple(r.n for r in rows[:size]), digit)
    return words, {bytes(r.word): r.n for r in rows[size:]}


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The frequent words of all documents; ties by the word itself."""
    return ranked(Scratch(docs.sparkSession).write(count_words(docs), "words"))[0]


def shared_totals(counts: DataFrame, words: Vocabulary) -> np.ndarray:
    """Tokens under each shared id."""
    totals = np.zeros(words.shared, np.int64)
    for row in counts.groupBy((F.crc32("word") % words.shared).alias("id")).agg(F.sum("n").alias("n")).collect():
        totals[row.id] = row.n
    for word, n in zip(words.words, words.counts):
        totals[crc32(word) % words.shared] -= n
    return totals


def exponentials(z: np.ndarray, safe: bool) -> np.ndarray:
    """Exponentials by column, up to a common factor of each; scores that are ``safe``, all within ``SAFE`` of zero, are not moved first. ``z`` is used up."""
    if not safe:
        z -= z.max(axis=0)
    return np.exp(z, out=z)


def softmax(z: np.ndarray, safe=False) -> np.ndarray:
    """Chances by column: sums over rows of long columns take far less time than sums of short rows. ``z`` is used up."""
    z = exponentials(z, safe)
    z *= 1 / z.sum(axis=0)
    return z


def log_chance(z: np.ndarray, place: np.ndarray, safe=False) -> np.ndarray:
    """Logarithm of the softmax at one place of each column, not below that of 1e-30. ``z`` is used up."""
    if not safe:
        z -= z.max(axis=0)
    own = z[place, np.arange(len(place))]
    return np.maximum(own - np.log(exponentials(z, True).sum(axis=0)), LEAST)


def shapes(digit: int) -> dict:
    return {
        "embed": (len(OFFSETS), digit * digit, HIDDEN),
        "hidden": (HIDDEN,),
        "first": (HIDDEN, digit),
        "first_bias": (digit,),
        "second": (HIDDEN, digit),
        "second_bias": (digit, digit),
    }


def size_of(digit: int) -> int:
    return sum(math.prod(shape) for shape in shapes(digit).values())


def digit_of(size: int) -> int:
    """Inverse of ``size_of``: the embeddings and the second bias make up nearly all parameters."""
    digit = math.isqrt(size // (len(OFFSETS) * HIDDEN + 1))
    while size_of(digit) > size:
        digit -= 1
    return digit


class Network:
    """Parameters are one flat vector with named views into it."""

    SHAPES = shapes(DIGIT)
    SIZE = size_of(DIGIT)

    def __init__(self, flat: np.ndarray):
        self.flat, self.past = flat.astype(np.float32), None
        self.p = self.views(self.flat)
        self.digit = len(self.p["first_bias"])

    @classmethod
    def views(cls, flat):
        views, at = {}, 0
        for name, shape in shapes(digit_of(len(flat))).items():
            n = math.prod(shape)
            views[name] = flat[at : at + n].reshape(shape)
            at += n
        return views

    @classmethod
    def fresh(cls, words: Vocabulary) -> "Network":
        """Small embeddings from a fixed seed; digit biases from the counts, all other words being as many as the frequent ones."""
        net = cls(np.zeros(size_of(words.digit), np.float32))
        noise = np.random.default_rng(7)
        for name in ("embed", "first", "second"):
            net.p[name][:] = noise.normal(0, 0.1, net.p[name].shape)
        counts = np.ones(words.digit**2)
        counts[1 : 1 + len(words.counts)] += words.counts
        counts[words.first :] += sum(words.counts) / words.shared
        table = counts.reshape(words.digit, words.digit)
        net.p["first_bias"][:] = np.log(table.sum(1) / table.sum())
        net.p["second_bias"][:] = np.log(table / table.sum(1, keepdims=True))
        return net

    def forward(self, sides: np.ndarray, target: np.ndarray):
        """Hidden layer, both digits, and the scores of either digit; a token is a column."""
        h, a, b, both = self.scored(sides, target)
        return h, a, b, both[: self.digit], both[self.digit :]

    def scored(self, sides, target):
        """As ``forward``, the scores of both digits in one array."""
        p = self.p
        pre = np.take(p["embed"][0], sides[0], axis=0)
        for k in range(1, len(OFFSETS)):
            pre += np.take(p["embed"][k], sides[k], axis=0)
        pre += p["hidden"]
        h = np.ascontiguousarray(np.tanh(pre, out=pre).T)
        a, b = np.divmod(target, self.digit)
        both = np.concatenate([p["first"], p["second"]], axis=1).T @ h
        both[: self.digit] += p["first_bias"][:, None]
        both[self.digit :] += np.take(np.ascontiguousarray(p["second_bias"].T), a, axis=1)
        return h, a, b, both

    def safe(self) -> bool:
        """Whether no score can be further than ``SAFE`` from zero; the hidden layer is within one."""
        return all(np.abs(self.p[k]).sum(axis=0).max() + np.abs(self.p[f"{k}_bias"]).max() < SAFE for k in ("first", "second"))

    def log_probabilities(self, sides, target) -> np.ndarray:
        _, a, b, one, two = self.forward(sides, target)
        safe = self.safe()
        return log_chance(one, a, safe) + log_chance(two, b, safe)

    def learn(self, sides, target, rate=RATE) -> None:
        """One step of AdaGrad on the mean negative log-probability."""
        p, n, d = self.p, len(target), self.digit
        if self.past is None:
            self.past = self.views(np.full(len(self.flat), 1e-4, np.float32))
        # In the order of their ids, tokens of one first digit are neighbours.
        short = d * d <= 65_536  # short numbers are sorted by their digits
        order = np.argsort(target.astype(np.uint16) if short else target, kind="stable")
        sides, target = [ids[order] for ids in sides], target[order]
        h, a, b, both = self.scored(sides, target)
        one, two, safe, at = both[:d], both[d:], self.safe(), np.arange(n)
        softmax(one, safe)[a, at] -= 1
        softmax(two, safe)[b, at] -= 1
        back = np.concatenate([p["first"], p["second"]], axis=1) @ both
        back *= 1 - h * h
        back /= n
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        by_digit = np.zeros((d, d), np.float32)
        by_digit[a[starts]] = np.add.reduceat(two, starts, axis=1).T
        sums = h @ both.T
        slopes = {"first": sums[:, :d], "first_bias": one.sum(1), "second": sums[:, d:], "second_bias": by_digit}
        slopes = {name: g / n for name, g in slopes.items()} | {"hidden": back.sum(1)}
        for name, g in slopes.items():
            past = self.past[name]
            past += g * g
            p[name][...] -= rate * g / np.sqrt(past)
        back = np.ascontiguousarray(back.T)
        for k, ids in enumerate(sides):
            order = np.argsort(ids.astype(np.uint16) if short else ids, kind="stable")
            own = ids[order]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows = own[starts]
            g = np.add.reduceat(np.take(back, order, axis=0), starts, axis=0)
            past = self.past["embed"][k][rows] + g * g
            self.past["embed"][k][rows] = past
            p["embed"][k][rows] -= rate * g / np.sqrt(past)


def windows(ids: np.ndarray, owners: np.ndarray, step=STEP):
    """Blocks of (ids at each offset, targets, owners) over all tokens."""
    places = np.flatnonzero(owners >= 0)
    for start in range(0, len(places), step):
        at = places[start : start + step]
        yield [ids[at + o] for o in OFFSETS], ids[at], owners[at]


def train(docs: DataFrame, words: Vocabulary, rounds=1) -> Network:
    """Average of the copies that the tasks train, weighted by tokens; ``rounds`` passes over all documents."""
    net = Network.fresh(words)
    names = ["place", "value", "tokens"]
    for _ in range(rounds):
        given = net.flat.copy()

        def run(batches):
            own, n, known = Network(given), 0, Known(words)
            for batch in batches:
                for block in slices(raw(batch.column("text"))):
                    for sides, target, _ in windows(*known.ids(tokens(block))[:2]):
                        own.learn(sides, target)
                        n += len(target)
            if n:
                weighted = own.flat.astype(np.float64) * n
                yield from as_batches([np.arange(len(weighted), dtype=np.int32), weighted, np.full(len(weighted), n)], names)

        copies = texts(docs).select("text").mapInArrow(run, "place int, value double, tokens long")
        mean = copies.groupBy("place").agg((F.sum("value") / F.sum("tokens")).alias("value")).toPandas()
        if len(mean):
            flat = np.zeros(len(given), np.float32)
            flat[mean["place"].to_numpy()] = mean["value"].to_numpy()
            net = Network(flat)
    return net


def score(docs: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, pll (summed log-probabilities of ids), mean_pll and pseudo_perplexity (null without tokens)."""
    flat = net.flat

    def run(batch):
        own, totals, counts = Network(flat), [], []
        for block in slices(raw(batch.column("text"))):
            total, count = sums(own, *words.ids(block), len(block))
            totals.append(total)
            counts.append(count)
        return [batch.column("doc_id"), pa.array(np.concatenate(counts)), pa.array(np.concatenate(totals))]

    return with_means(map_batches(texts(docs), run, "doc_id long, n_tokens long, pll double"))


def score_words(docs: DataFrame, words: Vocabulary, net: Network, counts: DataFrame, near: dict[bytes, int]) -> DataFrame:
    """As ``score``, with the probability of each word itself: that of its id times its share of the counts under the id.

    ``counts`` has (word, n) of all words, ``near`` some of them that need no join.
    """
    flat, scratch = net.flat, Scratch(docs.sparkSession)
    # Words that were never counted have one count under each shared id.
    logs = np.log(shared_totals(counts, words) + 1)

    def run(batch):
        own, totals, sizes, far = Network(flat), [], [], []
        known = Known(words, near)
        # Of each code: the logarithm of its count, 0 for words with ids of their own.
        counted = np.concatenate([np.zeros(len(words.words) + 1), np.log(np.fromiter(near.values(), float, len(near)))])
        for block in slices(raw(batch.column("text"))):
            ids, owners, codes, others = known.ids(tokens(block))
            total, count = sums(own, ids, owners, len(block))
            owned = owners >= 0
            ids, owners = ids[owned], owners[owned]
            late = ids >= words.first
            share = np.where(codes[late] < 0, 0.0, counted[codes[late]])
            total += np.bincount(owners[late], share - logs[ids[late] - words.first], len(block))
            rest = [{} for _ in block]
            for place, word in zip(owners[codes < 0].tolist(), others):
                times = rest[place]
                times[word] = times.get(word, 0) + 1
            far += rest
            totals.append(total)
            sizes.append(count)
        offsets = pa.array(np.cumsum([0, *map(len, far)]), pa.int32())
        lists = [[w for rest in far for w in rest], [n for rest in far for n in rest.values()]]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in zip(lists, (pa.binary(), pa.int32()))]
        return [batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(totals)), *lists]

    rows = map_batches(texts(docs), run, "doc_id long, n_tokens long, pll double, word array<binary>, times array<int>")
    # Rows may share a doc_id or have none, so they are told apart by a number of their own.
    rows = scratch.write(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    far = rows.select("_row", F.inline(F.arrays_zip("word", "times")))
    added = F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(1)))).alias("_far")
    # A word that was counted once adds nothing.
    shares = far.join(counts.where("n > 1"), "word", "left").groupBy("_row").agg(added)
    full = rows.drop("word", "times").join(shares, "_row", "left")
    return with_means(full.select("doc_id", "n_tokens", (F.col("pll") + F.coalesce("_far", F.lit(0.0))).alias("pll")))


def sums(net: Network, ids: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities of the ids and number of tokens of each of n documents."""
    total, count = np.zeros(n), np.zeros(n, np.int64)
    for sides, target, owner in windows(ids, owners):
        total += np.bincount(owner, net.log_probabilities(sides, target), n)
        count += np.bincount(owner, minlength=n)
    return total, count


def with_means(scored: DataFrame) -> DataFrame:
    mean = F.col("pll") / F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    return scored.withColumns({"mean_pll": mean, "pseudo_perplexity": F.exp(-mean)})


def pseudo_likelihood(docs: DataFrame, rounds=1) -> DataFrame:
    """Count, train and score over the same documents."""
    counts = Scratch(docs.sparkSession).write(count_words(docs), "words")
    words, near = ranked(counts, NEAR)
    return score_words(docs, words, train(docs, words, rounds), counts, near)
