import math
from zlib import crc32

import numpy as np
from fixtures_llm import AWKWARD, empty, frame, read

from skygrade.llm import masked_lm as L

TEXTS = [r[1].encode() for r in read("/root/testdata/sf0.01", "documents")]


def small_vocabulary(texts):
    from collections import Counter

    counts = Counter(w for t in texts for w in t.lower().split())
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: L.IDS - L.SHARED - 1]
    return L.Vocabulary(tuple(w for w, _ in best), tuple(n for _, n in best))


def noisy(words):
    net = L.Network.fresh(words)
    return L.Network(net.flat + np.random.default_rng(3).normal(0, 0.3, net.flat.shape))


def naive(net, ids):
    """Sum of log-probabilities, one token at a time."""
    p, total = net.p, 0.0
    padded = [0, 0, *ids, 0, 0]
    for place, target in enumerate(ids, 2):
        pre = p["hidden"].astype(float).copy()
        for k, offset in enumerate(L.OFFSETS):
            pre += p["embed"][k][padded[place + offset]]
        h = np.tanh(pre)
        a, b = divmod(int(target), L.DIGIT)
        for z, at in ((h @ p["first"] + p["first_bias"], a), (h @ p["second"] + p["second_bias"][a], b)):
            total += z[at] - math.log(np.exp(z).sum())
    return total


def test_scores_equal_a_plain_computation(spark):
    words = small_vocabulary(TEXTS[:50])
    net = noisy(words)
    got = {r.doc_id: r for r in L.score(frame(spark, AWKWARD), words, net).collect()}
    for i, text in AWKWARD:
        if i in (9, 7, 8, 11, 12, 16):
            ids = words.ids([(text or "").encode()])[0][2:-2]
            assert got[i].n_tokens == len(ids) and abs(got[i].pll - naive(net, ids)) < 1e-3 * max(1, len(ids))
    assert got[7].mean_pll is None and got[7].pll == 0 and got[14].n_tokens == 30_000
    assert L.score(empty(spark), words, net).collect() == []


def test_probabilities_add_up():
    words = small_vocabulary(TEXTS[:50])
    sides = [np.full(L.IDS, i) for i in (3, 0, 9, 1000)]
    assert abs(np.exp(noisy(words).log_probabilities(sides, np.arange(L.IDS))).sum() - 1) < 1e-4


def test_gradients():
    words = small_vocabulary(TEXTS[:20])
    net = noisy(words)
    sides, target = [np.array([5, 6, 5]), np.array([1, 2, 3]), np.array([4, 4, 4]), np.array([0, 7, 7])], np.array([8, 40, 8])
    before = net.flat.astype(np.float64).copy()
    loss = lambda flat: -L.Network(flat).log_probabilities(sides, target).astype(np.float64).mean()
    net.past = L.Network.views(np.full(L.Network.SIZE, 1e12, np.float32))  # makes a step proportional to the gradient
    net.learn(sides, target, rate=1e6)
    step = before - net.flat
    place = {name: L.Network.views(np.arange(L.Network.SIZE))[name] for name in L.Network.SHAPES}
    for at in (place["embed"][0, 5, 2], place["embed"][2, 4, 0], place["hidden"][3], place["first"][1, 1], place["second"][2, 8], place["second_bias"][0, 8], place["first_bias"][1]):
        up, down = before.copy(), before.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - step[at]) < 2e-3


def test_training_beats_word_frequencies_on_held_out_text(spark):
    docs = spark.createDataFrame(list(enumerate(t.decode() for t in TEXTS[:800])), "doc_id long, text string").repartition(3)
    words = L.vocabulary(docs)
    assert words == small_vocabulary(TEXTS[:800])
    trained, fresh = L.train(docs, words), L.Network.fresh(words)
    block = [words.ids(TEXTS[800:])]
    mean = lambda net: np.mean(np.concatenate([net.log_probabilities(s, t) for s, t, _ in L.windows(*block[0])]))
    assert mean(trained) > mean(fresh) + 0.05


def test_copies_are_averaged_by_tokens(spark):
    words = small_vocabulary(TEXTS[:40])
    parts = [TEXTS[:30], TEXTS[30:40]]
    flats, tokens = [], []
    for part in parts:
        net, n = L.Network.fresh(words), 0
        for sides, target, _ in L.windows(*words.ids(part)):
            net.learn(sides, target)
            n += len(target)
        flats.append(net.flat.astype(np.float64) * n)
        tokens.append(n)
    rows = [[(p, t.decode()) for t in part] for p, part in enumerate(parts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).flatMap(lambda x: x), "doc_id long, text string")
    got = L.train(docs, words).flat
    assert np.allclose(got, sum(flats) / sum(tokens), atol=1e-4)


def test_nothing_to_train_on(spark):
    assert L.pseudo_likelihood(empty(spark)).collect() == []
    only = L.pseudo_likelihood(frame(spark, [(1, None), (2, " ")])).collect()
    assert [(r.n_tokens, r.pll, r.pseudo_perplexity) for r in only] == [(0, 0.0, None)] * 2


def test_every_word_has_a_probability_of_its_own(spark, monkeypatch):
    """Words under one shared id differ by their counts, whether these travel with the tasks or are joined."""
    monkeypatch.setattr(L, "IDS_PER_ROOT", 0)
    docs = frame(spark, [*AWKWARD, *((100 + i, t.decode()) for i, t in enumerate(TEXTS[:60]))])
    counts = L.count_words(docs).cache()
    of = {bytes(r.word): r.n for r in counts.collect()}
    words, _ = L.ranked(counts)
    assert len(of) > len(words.words) == L.IDS - L.SHARED - 1
    net, under = noisy(words), {}
    single = {w: int(words.ids([w])[0][2]) for w in of}
    for w, n in of.items():
        under[single[w]] = under.get(single[w], 0) + n
    want = []
    for r in docs.collect():
        split = (r.text or "").encode().lower().split()
        own = sum(math.log(of[w] / (under[single[w]] + 1)) for w in split if single[w] >= words.first)
        sides = L.sums(net, *words.ids([(r.text or "").encode()]), 1)[0][0]
        want.append((r.doc_id, len(split), round(sides + own, 2)))
    for further in (0, 50):
        got = L.score_words(docs, words, net, counts, L.ranked(counts, further)[1]).collect()
        assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((d, n) for d, n, _ in want), key=repr)
        for (_, n, a), r in zip(sorted(want, key=repr), sorted(got, key=lambda r: repr((r.doc_id, r.n_tokens, round(r.pll, 2))))):
            assert abs(a - r.pll) < 1e-3 * max(20, n)


def test_rare_words_score_below_commoner_ones_under_the_same_ids(spark):
    """1,100 words have or crowd the ids; of those beyond, some occur eight times and some once."""
    pick = np.random.default_rng(5)
    own = [f"c{i}" for i in range(1100)] * 20
    some, once = [f"b{i}" for i in range(200)], [f"a{i}" for i in range(200)]
    texts = [" ".join(pick.permutation(x)) for x in (own, some * 7, some, once)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.mean_pll for r in L.pseudo_likelihood(docs).collect()}
    assert got[2] - got[3] > 1.5


def test_ids_grow_with_the_distinct_words():
    assert [L.digits(n) for n in (0, 1000, 400_000, 6_400_000, 400_000_000)] == [32, 32, 32, 64, 179]
    words = L.Vocabulary(tuple(b"w%d" % i for i in range(3839)), tuple(range(4000, 161, -1)), 64)
    net = L.Network.fresh(words)
    assert (words.shared, words.first, net.digit, L.digit_of(len(net.flat))) == (256, 3840, 64, 64)
    assert all(L.digit_of(L.size_of(d)) == d for d in range(32, 300))
    sides = [np.full(4096, i) for i in (3, 0, 9, 4000)]
    assert abs(np.exp(net.log_probabilities(sides, np.arange(4096))).sum() - 1) < 1e-4
    net.learn(sides, np.arange(4096))


def test_most_frequent_words_by_count_and_word(spark):
    counts = spark.createDataFrame([(w.encode(), n) for w, n in (("a", 3), ("b", 1), ("c", 3), ("d", 2), ("e", 1), ("f", 1))], "word binary, n long")
    names = lambda k: "".join(bytes(r.word).decode() for r in L.most_frequent(counts, k))
    assert [names(k) for k in (1, 2, 3, 5, 9)] == ["a", "ac", "acd", "acdbe", "acdbef"]


def test_ids_and_steps_equal_a_plain_computation():
    """Ids of all words at once, and scores with a token as a column, equal one word and one token at a time."""
    words = L.Vocabulary((b"a", b"b"), (5, 3))
    ids, owners = words.ids_of([[b"a", b"zz", b"b"], [], [b"q"]])
    shared = [words.first + crc32(w) % words.shared for w in (b"zz", b"q")]
    assert ids.tolist() == [0, 0, 1, shared[0], 2, 0, 0, 0, 0, shared[1], 0, 0]
    assert owners.tolist() == [-1, -1, 0, 0, 0, -1, -1, -1, -1, 2, -1, -1] and ids.dtype == np.int32
    net, rng = noisy(words), np.random.default_rng(1)
    target, sides = rng.integers(0, L.IDS, 9), [rng.integers(0, L.IDS, 9) for _ in L.OFFSETS]
    h, a, b, one, two = net.forward(sides, target)
    assert h.shape == (L.HIDDEN, 9) and one.shape == two.shape == (L.DIGIT, 9)
    for i, got in enumerate(net.log_probabilities(sides, target)):
        plain = np.tanh(net.p["hidden"] + sum(net.p["embed"][k][s[i]] for k, s in enumerate(sides)))
        first, second = plain @ net.p["first"] + net.p["first_bias"], plain @ net.p["second"] + net.p["second_bias"][a[i]]
        want = sum(z[d] - np.log(np.exp(z - z.max()).sum()) - z.max() for z, d in ((first, a[i]), (second, b[i])))
        assert abs(got - want) < 1e-3


def test_near_words_are_looked_up_like_others():
    """Codes of frequent and near words; the ids are those that hashes give."""
    words = L.Vocabulary((b"a", b"b"), (5, 3))
    split = [[b"n", b"a", b"far", b"n"], [b"m"]]
    ids, owners, codes, others = L.Known(words, {b"m": 2, b"n": 2}).ids(split)
    assert codes.tolist() == [4, 1, -1, 4, 3] and others == [b"far"]
    assert ids.tolist() == words.ids_of(split)[0].tolist() and owners.tolist() == words.ids_of(split)[1].tolist()


def test_scores_far_from_zero_are_moved_first():
    """Chances are the same whether scores are known to be small or not, and large scores do not overflow."""
    words, rng = L.Vocabulary((b"a", b"b"), (5, 3)), np.random.default_rng(2)
    net, z = noisy(words), rng.normal(0, 9, (7, 40)).astype(np.float32)
    assert net.safe()
    assert np.allclose(L.softmax(z.copy(), True), L.softmax(z.copy()), atol=1e-6)
    assert np.allclose(L.log_chance(z.copy(), np.arange(40) % 7, True), L.log_chance(z.copy(), np.arange(40) % 7), atol=1e-4)
    net.p["first_bias"][:] = np.linspace(-50, 150, L.DIGIT)
    sides, target = [rng.integers(0, L.IDS, 50) for _ in L.OFFSETS], rng.integers(0, L.IDS, 50)
    assert not net.safe() and np.isfinite(net.log_probabilities(sides, target)).all()
    net.learn(sides, target)
    assert np.isfinite(net.flat).all()
