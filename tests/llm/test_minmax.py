import random

import numpy as np
import pytest
from fixtures_llm import AWKWARD, bag, empty, frame, near_components, read, shingles, words

from skygrade.llm import minmax
from skygrade.llm.common import Scratch
from skygrade.llm.components import components
from skygrade.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"


def expected(rows):
    """Rows that repeat a doc_id or have none are documents of their own."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = {place: shingles(text) for place, (_, text) in enumerate(order)}
    root = near_components(sets)
    return sorted(((i, len(sets[p]), order[root[p]][0], root[p] == p) for p, (i, _) in enumerate(order)), key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_components_against_union_find(spark):
    pick = random.Random(5)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 600)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    scratch = Scratch(spark)
    found = components(spark.createDataFrame(links, "a long, b long"), scratch)
    assert {r.a: r.b for r in found.collect()} == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).collect() == []


def test_both_extremes_estimate_the_similarity():
    pick = np.random.default_rng(1)
    a = np.unique(pick.integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:700], pick.integers(0, 1 << 63, 200).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    one, two = minmax.signatures([a, b])
    low, high = (one == two)[: minmax.FUNCTIONS].mean(), (one == two)[minmax.FUNCTIONS :].mean()
    assert abs((low + high) / 2 - true) < 0.15
    whole = minmax.signatures([a])
    assert (whole[0] == one).all() and (minmax.bands(whole)[0] == minmax.bands(np.stack([one, two]))[0]).all()


def test_whole_small_table(spark):
    rows = read(SF, "documents")
    got = bag(minmax.near_groups(spark.read.parquet(f"{SF}/documents.parquet")), *COLUMNS)
    assert got == expected([(r[0], r[1]) for r in rows])
    assert any(not r[3] for r in got)


def test_awkward_rows_and_planted_groups(spark):
    pick = random.Random(2)
    rows = list(AWKWARD)
    base = words("base", 200).split()
    for i in range(100, 160):  # a group of near copies around one text, some too far from it
        own = list(base)
        for _ in range(pick.randrange(8)):
            own[pick.randrange(200)] = f"e{pick.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    assert bag(minmax.near_groups(frame(spark, rows)), *COLUMNS) == expected(rows)
    assert minmax.near_groups(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_pairs_across_components_are_all_found(spark, seed):
    pick = random.Random(seed)
    pool = [words(f"p{i}", 40).split() for i in range(4)]
    docs = {}
    for i in range(60):
        own = list(pick.choice(pool))[: pick.randrange(25, 41)]
        for _ in range(pick.randrange(3)):
            own[pick.randrange(len(own))] = f"e{pick.randrange(50)}"
        docs[i] = " ".join(own)
    sets = {i: shingle_set(minmax.words_of(t.encode())) for i, t in docs.items()}
    comp = {i: i if pick.random() < 0.5 else 0 for i in docs}
    want = set()
    for a in docs:
        for b in docs:
            c = len(np.intersect1d(sets[a], sets[b]))
            if a < b and comp[a] != comp[b] and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                want.add((a, b))
    table = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in sets.items()], "rep long, shingles array<long>")
    members = spark.createDataFrame(list(comp.items()), "rep long, comp long")
    pairs = minmax.cross_pairs(members, table, Scratch(spark))
    assert want <= {(r.a, r.b) for r in pairs.collect()}
    assert {(r.a, r.b) for r in minmax.confirmed(pairs, table).collect()} == want and want
