"""Quality of documents: random-indexing word vectors, pooled, and a small network.

Random indexing: each word (its whole bytes, hashed) has a fixed sparse index
vector of four +1 or -1. The context vector of a word is the sum of the index vectors that
stand within two places of it anywhere in the corpus. Words are counted over all
documents by a shuffle; those that are at least one in 16,384 words, so at most
as many, are given context vectors: tasks sum them over their partitions and Spark adds the sums up.
Any rarer word has its own index vector for its vector, made from its hash where it is met.

A document is the mean of its words' vectors (weighted against frequent words)
together with their length, their spread, how alike neighbouring vectors are,
how many are equal, how many are rare, and the expected error of a mean over so few words. As extra features it has
the mean of index vectors of its words' first and last three bytes. A network of
two layers is trained in numpy on a bounded sample of labelled documents and
calibrated with one temperature on a part of the sample kept apart.

Defined results: null or empty text pools to zeros and is scored as such; labels
that are null are left out, several labels of one document are averaged; with
one class only, or no labels at all, every score is the smoothed share of good
labels; rows that repeat a doc_id are scored each for itself; an empty table
gives an empty table. Only ``doc_id`` and ``text`` are read; doc_id merely finds
a label.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.llm.common import Scratch, as_batches, blocks, map_batches, texts
from skygrade.llm.shingles import mixed, word_hashes

COMMON = 16_384  # a word that is at least one in so many has a context vector
WIDTH = 64  # a power of two
NONZERO = 4
REACH = (-2, -1, 1, 2)
BLOCK = 200_000  # words pooled at once
COUNTED = 500_000  # words counted before a task passes its counts on
SAMPLE = 20_000  # labelled documents that the network is fitted on, at most
HIDDEN = 32
REJECT_BELOW = 0.3
EDGE = 3  # bytes of a word's beginning and end
STATED = 6  # features beside the means
POOLED = 2 * WIDTH + STATED


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of the index vectors that belong to hashes."""
    noise = mixed(hashes)[:, None]
    at = np.arange(NONZERO, dtype=np.uint64)
    places = ((noise >> at * np.uint64(8)) & np.uint64(WIDTH - 1)).astype(np.int64)
    return places, np.where((noise >> at + np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def edges(words: list[bytes]) -> np.ndarray:
    """First and last bytes of words as numbers."""
    first = b"".join([w[:EDGE].ljust(EDGE + 1, b"\1") for w in words])
    last = b"".join([w[-EDGE:].rjust(EDGE + 1, b"\2") for w in words])
    return np.frombuffer(first + last, np.uint32).astype(np.uint64)


def gathered(texts_: list[bytes]):
    """Hashes of all words of consecutive texts and the text of each word."""
    split = [t.split() for t in texts_]
    found = word_hashes([w for words in split for w in words])
    return found, np.repeat(np.arange(len(split)), [len(words) for words in split])


@dataclass
class Words:
    """Frequent words: sorted hashes, unit vectors, and weights that fall with the share of a word."""

    hashes: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray


def look_up(hashes: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Places of hashes among sorted ones, -1 for others."""
    if not len(sorted_):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)
    return np.where(sorted_[at] == hashes, at, -1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hash and occurrences of each word over all documents; without a word, the number of all words."""

    def run(batches):
        held = []
        for batch in batches:
            for block in blocks(batch.column("text")):
                held.append(gathered(block)[0])
                if sum(map(len, held)) >= COUNTED:
                    yield from counted(held)
                    held = []
        if held:
            yield from counted(held)

    def counted(held):
        found, n = np.unique(np.concatenate(held), return_counts=True)
        words = pa.array(np.append(found.view(np.int64), 0), mask=np.arange(len(n) + 1) == len(n))
        return as_batches([words, np.append(n, n.sum()).astype(np.int64)], ["word", "n"])

    partial = texts(docs).select("text").mapInArrow(run, "word long, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def common_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that are at least one in ``COMMON``, and their shares: at most ``COMMON`` rows."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.write(word_counts(docs), "words")
    total = counted.where("word is null").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = counted.where(F.col("word").isNotNull() & (F.col("n") * COMMON >= total)).toPandas()
    scratch.drop(counted)
    hashes = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["n"].to_numpy(np.float64)[order] / max(total, 1)


def context_sums(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(place, v0, v1, ...): summed context vector of each word of ``common`` over all documents."""
    names = ["place", "v"]

    def run(batches):
        total = np.zeros(len(common) * WIDTH)
        for batch in batches:
            for block in blocks(batch.column("text")):
                found, owner = gathered(block)
                at, (places, signs) = look_up(found, common), index_vectors(found)
                for reach in REACH:
                    here, there = (slice(None, -reach), slice(reach, None)) if reach > 0 else (slice(-reach, None), slice(None, reach))
                    used = np.flatnonzero((owner[here] == owner[there]) & (at[here] >= 0))
                    row = at[here][used] * WIDTH
                    for k in range(NONZERO):
                        total += np.bincount(row + places[there][used, k], signs[there][used, k], len(total))
        vectors = total.reshape(-1, WIDTH)
        used = np.flatnonzero(vectors.any(axis=1))
        if len(used):
            yield from as_batches([used.astype(np.int32), pa.array(list(vectors[used].astype(np.float32)), pa.list_(pa.float32()))], names)

    partial = texts(docs).select("text").mapInArrow(run, "place int, v array<float>")
    return partial.groupBy("place").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(WIDTH)))


def word_vectors(docs: DataFrame) -> Words:
    """Unit vectors and weights of the frequent words; their number is bounded, so the driver may hold them."""
    common, share = common_words(docs)
    vectors = np.zeros((len(common), WIDTH), np.float32)
    if len(common):
        rows = context_sums(docs, common).toPandas()
        found = rows[[f"v{i}" for i in range(WIDTH)]].to_numpy(np.float64)
        vectors[rows["place"].to_numpy(np.int64)] = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return Words(common, vectors, (1e-3 / (1e-3 + share)).astype(np.float32))


def pool(texts_: list[bytes], known: Words) -> np.ndarray:
    """One row per text: weighted mean of word vectors, what is stated of them, and the mean of its words' beginnings and ends."""
    out = np.zeros((len(texts_), POOLED), np.float32)
    unit = NONZERO**-0.5
    for place, text in enumerate(texts_):
        words = text.split()
        total, ends, weight, square, alike, equal, rare = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, 0.0, 0, 0
        for start in range(0, len(words), BLOCK):
            block = words[start : start + BLOCK]
            hashes = word_hashes(block)
            at = look_up(hashes, known.hashes)
            own, w = np.zeros((len(at), WIDTH), np.float32), np.ones(len(at), np.float32)
            hit, others = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            own[hit], w[hit] = known.vectors[at[hit]], known.weights[at[hit]]
            places, signs = index_vectors(hashes[others])
            for k in range(NONZERO):
                own[others, places[:, k]] += unit * signs[:, k]
            total += w @ own
            weight += w.sum()
            square += (w * (own * own).sum(1)).sum()
            alike += np.einsum("ij,ij->", own[1:], own[:-1])
            equal += np.count_nonzero(hashes[1:] == hashes[:-1])
            rare += len(others)
            places, signs = index_vectors(edges(block))
            ends += np.bincount(places.ravel(), signs.ravel(), WIDTH)
        if words:
            mean = total / max(weight, 1e-9)
            length = float(mean @ mean)
            spread, pairs = max(square / max(weight, 1e-9) - length, 0) ** 0.5, max(len(words) - 1, 1)
            stated = length**0.5, spread, alike / pairs, equal / pairs, rare / len(words), len(words) ** -0.5
            out[place] = np.concatenate([mean, stated, ends / (2 * len(words))])
    return out


@dataclass
class Model:
    """A network of two layers and its temperature; without weights, a constant."""

    prior: float
    layers: tuple | None = None
    scale: tuple | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, spread = self.scale
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray, epochs=60, seed=7) -> Model:
    """Train on the rows not set ``apart``, then choose the temperature on those that are."""
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    tx, ty = x[~apart].astype(np.float64), y[~apart]
    if len(np.unique(ty)) < 2:
        return Model(float(prior))
    noise = np.random.default_rng(seed)
    scale = tx.mean(0), tx.std(0) + 1e-3
    tx = (tx - scale[0]) / scale[1]
    layers = [noise.normal(0, tx.shape[1] ** -0.5, (tx.shape[1], HIDDEN)), np.zeros(HIDDEN), noise.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(epochs):
        for at in np.array_split(noise.permutation(len(ty)), max(1, len(ty) // 128)):
            w1, b1, w2, b2 = layers
            h = np.tanh(tx[at] @ w1 + b1)
            error = (1 / (1 + np.exp(-(h @ w2 + b2))) - ty[at]) / len(at)
            back = np.outer(error, w2) * (1 - h * h)
            grads = [tx[at].T @ back + 1e-4 * w1, back.sum(0), h.T @ error + 1e-4 * w2, error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(float(prior), tuple(layers), scale)
    if apart.any():
        z, target = model.logits(x[apart].astype(np.float64)), y[apart]
        loss = lambda t: np.mean(np.logaddexp(0, z / t) - target * z / t)
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def remainder(column):
    """crc32 of the id's text modulo 5; 0 is held out from learning."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, known: Words, sample=SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, those with the smallest hashes of doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder("doc_id") != 0))
    one = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    apart = (remainder("doc_id") == 1).alias("apart")
    found = texts(docs).join(F.broadcast(chosen), "doc_id").select("text", F.col("good").cast("double").alias("good"), apart)

    def run(batch):
        rows = np.concatenate([pool(block, known) for block in blocks(batch.column("text"))])
        return [pa.array(list(rows), pa.list_(pa.float32())), batch.column("good"), batch.column("apart")]

    # Bounded by ``sample`` unless documents repeat an id, so the bound holds for the rows too.
    rows = map_batches(found, run, "x array<float>, good double, apart boolean").limit(sample).toPandas()
    if not len(rows):
        return Model(0.5)
    return fit(np.stack(rows["x"].to_numpy()), rows["good"].to_numpy(), rows["apart"].to_numpy(bool))


def scorer(docs: DataFrame, labels: DataFrame, sample=SAMPLE):
    """A column function from text to score, learned from ``docs`` and ``labels``."""
    known = word_vectors(docs)
    model = learn(docs, labels, known, sample)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [model.scores(pool(block, known)) for block in blocks(text)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score


def score_quality(docs: DataFrame, labels: DataFrame, sample=SAMPLE) -> DataFrame:
    """doc_id, held_out, score (probability of a good label), predicted (1 from 0.3 on)."""
    scored = texts(docs).select("doc_id", scorer(docs, labels, sample)("text").alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"),
    )
