import numpy as np
import pytest
from fixtures_llm import read

from skygrade.llm import whitening
from skygrade.llm.queries import op11_whitening

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, key string, x string, n string, component string, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x", "x") for i, v in vectors], SCHEMA)


def rows_of(df):
    return {(r.key, r.component): r for r in df.collect()}


def brute(x):
    """Centred by hand, by a symmetric solver."""
    x = np.array(x, float)
    away = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(away.T @ away / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    return away @ axes / np.sqrt(values), values / values.sum()


def test_query_equals_a_symmetric_solver(spark):
    given = [(r[0], r[1]) for r in read(FOLDER, "embeddings")]
    whole = np.floor(1024 * np.array([v for _, v in given], float)).astype(int) + 100_000
    expected, share = brute(whole)
    n, sums = len(whole), whole.sum(axis=0)
    result = op11_whitening(spark, FOLDER)
    assert result.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = {(r.vec_id, r.component): r for r in result.collect()}
    assert len(rows) == 8 * n
    for c in range(8):
        found = np.array([rows[i, c + 1].whitened for i, _ in given])
        sign = np.sign(found @ expected[:, c])
        assert np.abs(found - sign * expected[:, c]).max() < 1e-8
    for (i, _), x in zip(given, whole):
        row = rows[i, 3]
        assert (row.n, row.deviation) == (n, sum(int(n * a - s) ** 2 for a, s in zip(x, sums)))
        assert row.explained == pytest.approx(share[2], rel=1e-9)
        assert 0 <= row.identity_error < 1e-9


def test_result_does_not_depend_on_partitioning(spark):
    given = whitening.fixed_point(spark.read.parquet(f"{FOLDER}/embeddings.parquet"))
    one, many = (rows_of(whitening.whiten(given.repartition(k))) for k in (1, 13))
    assert all(many[k].whitened == pytest.approx(r.whitened, abs=1e-12) and many[k].deviation == r.deviation for k, r in one.items())


def test_awkward_vectors_are_dropped_and_equal_ones_count(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [0.5, 0.25]), (4, None), (5, [1.0, None]), (6, [nan, 1.0])]
    given += [(7, [1.0, -inf]), (8, [1.0]), (9, []), (10, [1e300, 0.0])]
    rows = whitening.whiten(whitening.fixed_point(frame(spark, given))).collect()
    assert sorted((r.key is None, r.key or 0, r.component) for r in rows) == [
        (False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 2, 1), (False, 2, 2), (True, 0, 1), (True, 0, 2),
    ]
    assert {r.n for r in rows} == {4} and max(r.identity_error for r in rows) < 1e-9


def test_components_without_variance_are_null(spark):
    given = [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)]
    rows = rows_of(whitening.whiten(whitening.fixed_point(frame(spark, given))))
    assert rows[0, 1].explained == pytest.approx(1) and rows[3, 1].whitened == pytest.approx(-rows[0, 1].whitened)
    assert rows[0, 2].whitened is None and rows[0, 3].explained == 0 and rows[0, 2].identity_error < 1e-9
    same = rows_of(whitening.whiten(whitening.fixed_point(frame(spark, [(1, [3.0, 3.0]), (2, [3.0, 3.0])]))))
    assert same[2, 1].whitened is None and same[2, 1].explained is None and same[2, 1].deviation == 0 and same[2, 1].identity_error is None


def test_large_numbers_stay_exact(spark):
    big = float(1 << 39)
    given = [(1, [big, 0.0]), (2, [-big, 1.0]), (3, [big, 7.0])]
    rows = rows_of(whitening.whiten(whitening.fixed_point(frame(spark, given))))
    x = [[int(1024 * c) + 100_000 for c in v] for _, v in given]
    sums = [sum(c) for c in zip(*x)]
    assert [int(rows[i, 1].deviation) for i in (1, 2, 3)] == [sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]


def test_empty_table(spark):
    assert whitening.whiten(whitening.fixed_point(frame(spark, []))).collect() == []


@pytest.mark.parametrize("d", [1, 2, 5, 24])
def test_factor_and_rotation(d):
    pick = np.random.default_rng(d)
    a = pick.normal(size=(d, d)) * np.logspace(0, -5, d)
    a = a @ a.T
    factor, order = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-14) and np.allclose(np.triu(factor, 1), 0)
    values, axes = whitening.principal_axes(a)
    known = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(values, known[: len(values)], rtol=1e-9, atol=1e-15)
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
    assert sorted({tuple(sorted(map(int, p))) for r in whitening.rounds(d) for p in r.T}) == [(i, j) for i in range(d) for j in range(i + 1, d)]
