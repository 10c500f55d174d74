import math

import numpy as np

from barloom.llm import embedding_dedup, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, node string, list int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1) for i, v in rows], SCHEMA)


def vectors(seed=0, groups=12, alone=150, d=24):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(d) for _ in range(alone)]
    for g in range(groups):
        centre = rng.standard_normal(d)
        out += [centre + rng.standard_normal(d) * rng.choice([0.02, 0.2, 0.3]) for _ in range(2 + g)]
    out += [out[0]] * 5
    return [(i, np.float32(v)) for i, v in enumerate(out)]


ODD = [(9001, None), (9002, [0.0] * 24), (9003, [None] + [1.0] * 23), (9004, [math.nan] * 24), (9005, [math.inf] * 24), (9006, []), (9007, [1.0, 0.0])]


def brute(rows):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return ids, u @ u.T


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = vectors()
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, rows + ODD)).collect()}
    ids, sim = brute(rows)
    near = sim >= 0.9
    np.fill_diagonal(near, False)
    found, true = sum(got[i].n_links for i in ids), int(near.sum())
    assert 0.97 * true <= found <= true
    assert all(got[i].n_links <= near[k].sum() for k, i in enumerate(ids))
    # components: none joins what brute force keeps apart
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 10**9).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    assert all(label[got[i].component_id] == label[i] for i in ids)
    assert np.mean([got[i].component_id == label[i] for i in ids]) >= 0.97
    assert all(got[i].n_links >= 5 for i in (0, *range(len(ids) - 5, len(ids))))  # equal vectors
    for i, _ in ODD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_duplicates_repeated_null_and_empty(spark):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.001]), (5, [0.0, 1.0])]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 2, 3), (3, 2, 3), (3, 2, 3), (5, 0, 5)]
    assert embedding_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_double_vectors_beyond_the_range_of_floats(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1.0, -1.0]), (3, [1e300, 0.9e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (2, 0, 2), (3, 2, 0)]
    assert [r.vec_id for r in nearest.nearest(df).orderBy("rank").collect()] == [1, 3, 2]


def test_nearest_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    rows = vectors(1, groups=20, alone=500)
    got = nearest.nearest(frame(spark, rows + ODD), k=5, every=10).collect()
    ids, sim = brute(rows)
    np.fill_diagonal(sim, -9)
    hit = total = 0
    for q in range(0, len(ids), 10):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
        assert mine == sorted(mine, key=lambda x: (-x[2], x[1]))
        assert all(abs(s - sim[q, v]) < 1e-12 for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(np.lexsort((ids, -sim[q]))[:5]))
        total += 5
    assert hit / total >= 0.9
    # equal vectors tie: the smaller id first
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == ids[-5:]


def test_nearest_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.9, 0.1]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0])]
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(frame(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 7), (0, 2, 8), (0, 3, 8)]  # repeated rows each count
    assert nearest.nearest(frame(spark, [])).count() == 0


def test_nearest_of_each_length_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0]), (2, [0.8, 0.3, 0.1]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (50, [1.0, 0.0]), (51, [0.5, 0.5]), (100, [1.0, 2.0, 3.0, 4.0]), (150, [2.0, 1.0]), (150, [2.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest.nearest(frame(spark, rows), every=50).collect())
    assert [x for x in got if x[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 3)]
    assert [x for x in got if x[0] == 50] == [(50, 1, 150), (50, 2, 150), (50, 3, 51)]
    assert [x for x in got if x[0] == 100] == []  # alone of its length
    assert [x for x in got if x[0] == 150] == [(150, 1, 150), (150, 1, 150), (150, 2, 51), (150, 2, 51), (150, 3, 50), (150, 3, 50)]


def test_near_duplicates_planted_among_thousands(spark):
    """Pairs around the threshold, groups of near copies (dealt in blocks) and loose vectors, at the length of the table."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x)
    vecs = [unit(rng.standard_normal(64)) for _ in range(3000)]
    for i in range(300):  # cosines of 0.86 to 0.98 with an earlier one
        c = 0.86 + 0.12 * (i / 300)
        off = rng.standard_normal(64)
        off = unit(off - (off @ vecs[i]) * vecs[i])
        vecs.append(c * vecs[i] + math.sqrt(1 - c * c) * off)
    vecs += [unit(vecs[5] + 0.03 * rng.standard_normal(64)) for _ in range(300)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vecs)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, rows)).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(1)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.985 * want.sum()
    assert (found[:3300] >= want[:3300] - 1).all()
    component = [got[i].component_id for i in range(len(rows))]
    assert all(component[i] == 5 for i in range(3300, 3600))


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    skip = np.arange(2000)[None, :] == np.arange(50)[:, None]
    live = nearest.scan(x[:50], x, 5, 2.1, skip)
    away = ((x[:50, None, :] - x[None, :, :]) ** 2).sum(2) + 9 * skip
    best = np.argsort(away, axis=1)[:, :5]
    assert np.take_along_axis(live, best, 1).mean() >= 0.97 and not (live & skip).any()
    assert live.mean() < 0.05
    few = nearest.scan(x[:3], x[:10], 5, 2.1, skip[:3, :10])
    assert (few == ~skip[:3, :10]).all()
