import numpy as np
import pytest

from barloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, x int"


def brute(rows, top=16):
    """The same by eigh over plain lists."""
    own = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in own}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    c = ((fit * n - sums) / n).astype(float)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(top, int((e > e[0] * 1e-10).sum()))
    out = {}
    for i, x in own:
        x = np.array(x, dtype=object)
        out.setdefault(i, []).append((int(((n * x - sums) ** 2).sum()), (((n * x - sums) / n).astype(float) @ u[:, :k]) / np.sqrt(e[:k])))
    return n, e[:k] / v.trace(), out


def check(got, rows, top=16):
    n, explained, wanted = brute(rows, top)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-8 and len({r.identity_error for r in got}) == 1
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(wanted)
    signs = None
    for i, own in by.items():
        k = len(explained)
        assert sorted(r.component for r in own) == sorted(list(range(1, k + 1)) * len(wanted[i]))
        assert {r.deviation for r in own} == {d for d, _ in wanted[i]}
        w = {r.component: r.whitened for r in own}
        assert np.allclose([next(r.explained for r in own if r.component == c) for c in range(1, k + 1)], explained, rtol=1e-9)
        if len(wanted[i]) == 1:
            a, b = np.array([w[c] for c in range(1, k + 1)]), wanted[i][0][1]
            signs = np.sign(a * b) if signs is None and np.all(np.abs(b) > 1e-6) else signs
            assert np.allclose(np.abs(a), np.abs(b), atol=1e-7)
            if signs is not None:
                assert np.allclose(a, b * signs, atol=1e-7)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(24, 24)) * np.geomspace(1, 0.02, 24)
    v = rng.normal(size=(700, 24)) @ mix + 3
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(700 + i, v[i].tolist()) for i in range(300)]  # equal vectors count once
    rows += [(2000, None), (2001, [None] + [0.0] * 23), (2002, [float("nan")] * 24), (2003, [float("inf")] + [1.0] * 23), (2004, [0.0] * 24), (2005, []), (5, v[5].tolist())]
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], SCHEMA).repartition(7)
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * (700 + 300 + 2)
    check(got, rows)
    check(whitening.whiten(df.repartition(2), top=3).collect(), rows, 3)


def test_dependent_dimensions_lengths_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(200, 3)) * 8) / 4
    v = np.concatenate([v, v[:, :1] + v[:, 1:2], np.full((200, 1), 7.0)], 1)  # rank 3 of 5
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    make = lambda rows: spark.createDataFrame([(i, x, None, 1) for i, x in rows], SCHEMA)
    got = whitening.whiten(make(rows)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check(got, rows)
    two = [(1000 + i, rng.normal(size=2).tolist()) for i in range(50)]
    both = whitening.whiten(make(rows + two)).collect()
    check([r for r in both if r.vec_id < 1000], rows)
    check([r for r in both if r.vec_id >= 1000], two)
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0
    assert whitening.whiten(make(rows[:9] + [(None, [1.0] * 5), (1, [1e300] * 5)])).where("vec_id IS NULL").count() > 0
    far = [(i, [2.0**44 + float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)) * 100)]
    check(whitening.whiten(make(far)).collect(), far)


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_components(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(3 * d, d)) * np.geomspace(1, 1e-4, d)
    v = a.T @ a
    e, u = whitening.components(v)
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][: len(e)], rtol=1e-8)
    assert np.allclose(u * e @ u.T, v, atol=1e-12 * e[0])
    ties, _ = whitening.components(np.eye(d) * 4)
    assert np.allclose(ties, 4)
