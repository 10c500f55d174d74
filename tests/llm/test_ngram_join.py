import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ngram_join
from barloom.llm.shared import connected_components

SCHEMA = "doc_id long, text string, lang string, n int, head string"


def brute(rows, k, num, den):
    """component by doc_id, from plain Python sets of word tuples."""
    sets = {}
    for i, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df, **kw).collect()}


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80)])
def test_against_brute_force(spark, words, num):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    common = list(rng.choice(vocab, 60))
    rows = []
    for i in range(40):
        base = list(rng.choice(vocab, int(rng.integers(1, 120)))) + (common if i % 3 == 0 else [])
        rows.append((len(rows), " ".join(base)))
        for _ in range(int(rng.integers(0, 5))):
            near = list(base)
            for _ in range(int(rng.integers(0, 1 + len(near) // 20))):
                near[int(rng.integers(len(near)))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(near).upper() if i % 2 else " ".join(near)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n"), (len(rows) + 3, "one"), (len(rows) + 4, "ONE\n"), (len(rows) + 5, "É x y z"), (len(rows) + 6, "é x y z")]
    assert run(spark, rows, words=words, num=num) == brute(rows, words, num, 100)


def test_large_near_copy_group_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(120):
        near = list(base)
        near[int(rng.integers(90))] = f"u{i % 40}"
        near[int(rng.integers(90))] = f"v{i}"
        rows.append((i, " ".join(near)))
    rows.append((500, " ".join(f"q{i}" for i in range(50_000))))
    assert run(spark, rows, words=4, num=85) == brute(rows, 4, 85, 100)


def test_pairs_that_share_rare_and_frequent_shingles(spark, monkeypatch):
    """Pairs with too few shared shingles in short lists alone and too late positions in long ones alone."""
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    rng = np.random.default_rng(7)
    rows = []
    for f, (own, shared) in enumerate([(3, 6), (3, 9), (4, 8), (5, 9), (2, 12), (8, 8)]):
        pool = [f"c{f}_{i}" for i in range(100 - own - shared)]
        for x in "ab":
            words = pool + [f"s{f}_{i}" for i in range(shared)] + [f"{x}{f}_{i}" for i in range(own)]
            rows.append((len(rows), " ".join(rng.permutation(words))))
        for _ in range(40):  # make the pool frequent, and link with nothing
            rows.append((len(rows), " ".join(rng.choice(pool, 55, replace=False))))
    assert run(spark, rows, words=1, num=80) == (want := brute(rows, 1, 80, 100))
    assert all(want[i + 1][1] == i for i in range(0, len(rows), 42))


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df, words=4).select("doc_id", "n_shingles", F.coalesce("component_id", F.lit(-1)).alias("component_id")).collect())
    assert got == [(-1, 1, -1), (-1, 3, 7), (7, 3, 7), (7, 3, 7)]


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 7), (None, 1)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, **{i: 7 for i in (7, 8, 9)}, **{100 + i: 100 for i in range(50)}}


def test_shingle_sets_by_bytes(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "SLICE", 64)
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("ab AB\t\n\x0b\x1c É ") for _ in range(rnd.randint(0, 200))) for _ in range(500)] + [None, "", "x" * 500 + " " + "y" * 300]
    by_set = {}
    for text, s in zip(texts, ngram_join.shingle_sets(pa.array(texts), 3), strict=True):
        w = (text or "").encode().lower().split()
        want = frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset()
        assert len(s) == len(want)
        assert by_set.setdefault(want, s.tobytes()) == s.tobytes()
    assert len(set(by_set.values())) == len(by_set)


def test_long_words_that_are_hard_to_tell_apart(spark):
    """Words whose polynomial hashes modulo a power of two are equal; words around eight and 64 bytes."""
    one = "a"
    while len(one) < 2048:
        one += one.translate({97: 98, 98: 97})
    other = one.translate({97: 98, 98: 97})
    words = [one, other] + [one[:n] for n in (7, 8, 9, 63, 64, 65, 127, 1024)] + [other[:n] for n in (7, 8, 9, 63, 64, 65, 127, 1024)]
    rows = [(i, w) for i, w in enumerate(words)] + [(100 + i, f"p q r {w} t u") for i, w in enumerate(words)]
    assert run(spark, rows, words=4, num=85) == brute(rows, 4, 85, 100)


def test_answers_derived_from_heads(spark, monkeypatch):
    """Groups whose members all lie near a head, at every distance from each other around the threshold."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    rng = np.random.default_rng(11)
    rows = []
    pool = [f"c{i}" for i in range(100)]
    for g in range(12):
        head = pool[: 100 - g] + [f"g{g}_{i}" for i in range(3 * g)]
        for _ in range(8):
            words = list(head)
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = f"x{int(rng.integers(0, 60))}"
            rows.append((len(rows), " ".join(words)))
    for num in (80, 85):
        assert run(spark, rows, words=1, num=num) == brute(rows, 1, num, 100)


def test_no_words_or_shingles_share_a_hash_by_design(spark):
    import pyarrow as pa

    one, other = "i-eqh524@\\\\^`@@`", "t5/d-19t>[@_-->?"
    rows = [(1, one), (2, other), (3, f"alpha beta gamma delta epsilon {one}"), (4, f"alpha beta gamma delta epsilon {other}")]
    for seed in (0, 1, 99):
        a, b = (ngram_join.shingle_sets(pa.array([x]), 5, seed) for x in (one, other))
        assert next(a).tolist() != next(b).tolist()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar_documents(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
