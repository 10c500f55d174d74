import math
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import mixing


def frame(spark, sizes):
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + i, "w " * (5 + i % 7), s, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")


def shares(df):
    return {r.s: (r.tokens, r.n) for r in df.groupBy(mixing.source_key().alias("s")).agg(F.sum(mixing.token_count()).alias("tokens"), F.count("*").alias("n")).collect()}


def test_repetition_limit_and_budget(spark):
    df = frame(spark, {"hot": 3000, "a": 300, "b": 100, None: 50})
    out = mixing.mix(df, max_repetition=2.0)
    got = out.groupBy(mixing.source_key().alias("s")).agg(F.sum("_mix_tokens").alias("t"), F.countDistinct("doc_id").alias("n"), F.first("_mix_weight").alias("w"), F.max("_mix_epoch").alias("e")).collect()
    have = shares(df)
    total = sum(r.t for r in got)
    assert {r.s for r in got} == set(have)
    for r in got:
        assert r.n == have[r.s][1]  # every document at least once
        assert abs(r.t / total - r.w) < 0.03 * r.w + 0.002
    rep = {r.s: r.t / have[r.s][0] for r in got}
    assert 1.9 < max(rep.values()) / min(rep.values()) < 2.1
    keys = out.agg(F.min("_mix_key"), F.max("_mix_key")).first()
    assert 0 <= keys[0] and keys[1] < 1
    assert set(df.columns) < set(out.columns)


def test_entropy_target(spark):
    df = frame(spark, {"hot": 800, "a": 100, "b": 40})
    sources = df.groupBy("source").agg(F.sum(mixing.token_count()).alias("tokens"))
    tokens = [r.tokens for r in sources.collect()]
    for target in (0.7, 0.95, 1.09):
        a = mixing.exponent(sources, entropy=target)
        w = [t**a for t in tokens]
        w = [x / sum(w) for x in w]
        assert abs(-sum(x * math.log(x) for x in w) - target) < 1e-4
    with pytest.raises(ValueError):
        mixing.exponent(sources)


def test_whole_passes_repeat_every_row(spark):
    df = frame(spark, {"a": 50, "b": 50})
    out = mixing.mix(df, max_repetition=1.5, budget=3.0 * df.agg(F.sum(mixing.token_count())).first()[0])
    assert {r["count"] for r in out.groupBy("doc_id").count().collect()} == {3}


def test_empty_and_wordless(spark):
    df = frame(spark, {})
    assert mixing.mix(df, max_repetition=1.5).count() == 0
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "b"), (3, "x y", "b"), (None, "z", "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repetition=1.5).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 2, 3, 3]


def spark_hash(*values, seed=42):
    """xxhash64 as Spark's function gives it, signed."""
    for v, kind in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<" + kind, v), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def fraction(h):
    return ((h & (1 << 64) - 1) >> 11) / float(1 << 53)


@pytest.mark.parametrize("stretch", [4, 1024])
def test_whole_schedule_against_plain_python(spark, monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    df = frame(spark, {"hot": 900, "a": 120, "b": 35, None: 11})
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    name = lambda s: "null" if s is None else "=" + s
    tokens, number = {}, {}
    for _, t, s in rows:
        tokens[name(s)] = tokens.get(name(s), 0) + len(t.split())
        number[name(s)] = number.get(name(s), 0) + 1
    total = sum(tokens.values())
    entropy = lambda a: (lambda w: -sum(x / sum(w) * math.log(x / sum(w)) for x in w))([t**a for t in tokens.values()])
    target = entropy(1) + 0.5 * (math.log(len(tokens)) - entropy(1))
    lo, hi = 0.0, 1.0
    for _ in range(60):
        lo, hi = (lo, (lo + hi) / 2) if entropy((lo + hi) / 2) < target else ((lo + hi) / 2, hi)
    weight = {s: t**lo / sum(x**lo for x in tokens.values()) for s, t in tokens.items()}
    budget = max(tokens[s] / weight[s] for s in tokens)
    blocks = {s: min(n, max(64, -(-n // 1024))) for s, n in number.items()}
    own = [(i, name(s), len(t.split()), spark_hash((7, "i"), (i, "q"))) for i, t, s in rows]
    size = {}
    for _, s, n, h in own:
        size[s, h % blocks[s]] = size.get((s, h % blocks[s]), 0) + n
    want = []
    for s in tokens:
        quota = weight[s] * budget
        for epoch in range(1, max(1, math.ceil(quota / tokens[s] - 1e-9)) + 1):
            order = sorted((fraction(spark_hash((7, "i"), (epoch, "i"), (s, "s"), (b, "q"))), b) for x, b in size if x == s)
            start = 0
            for _, b in order:
                if start + size[s, b] / 2 <= min(tokens[s], quota - (epoch - 1) * tokens[s]) + 1e-6 * tokens[s]:
                    for i, x, n, h in own:
                        if x == s and h % blocks[s] == b:
                            key = ((epoch - 1) * tokens[s] + start + fraction(spark_hash((h, "q"), (epoch, "i"))) * size[s, b]) / quota
                            want.append((i, epoch, n, weight[s], key))
                start += size[s, b]
    got = sorted((r.doc_id, r._mix_epoch, r._mix_tokens, r._mix_weight, r._mix_key) for r in mixing.mix(df, evenness=0.5).collect())
    want.sort()
    assert total and len(got) == len(want) and [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x - y) < 1e-6 for a, b in zip(got, want, strict=True) for x, y in zip(a[3:], b[3:], strict=True))
    assert max(x[1] for x in got) > 1  # the target binds


def test_targets_that_do_not_bind_or_cannot_be_met(spark):
    sources = spark.createDataFrame([(100,), (110,), (0,)], "tokens long")
    assert mixing.exponent(sources, max_repetition=1.5) == 0.0
    assert mixing.exponent(sources, evenness=1.0) < 1e-3
    for bad in (5.0, 0.1):
        with pytest.raises(ValueError):
            mixing.exponent(sources, entropy=bad)
    assert mixing.exponent(sources.where("tokens = 100"), entropy=3.0) == 1.0


def test_clashing_columns_and_very_long_text(spark):
    rows = [(i, "w " * (200_000 if i == 3 else 4), "ab"[i % 2], 5, 6, "x", "y", 1.0) for i in range(40)]
    names = ["_mix_epoch", "_mix_tokens", "s", "row", "_MIX_key"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, ("int", "int", "string", "string", "double"), strict=True)))
    out = mixing.mix(df, evenness=0.5)
    assert out.columns == [*df.columns, "_mix_tokens_", "_mix_epoch_", "_mix_weight", "_mix_key_"]
    got = out.collect()
    assert {r.doc_id for r in got} == set(range(40)) and {(r._mix_epoch, r._mix_tokens, r.s, r.row) for r in got} == {(5, 6, "x", "y")}
    assert max(r["_mix_tokens_"] for r in got) == 200_000


def test_intermediate_tables_can_be_removed(spark):
    from pathlib import Path

    from barloom.llm import shared

    shared.cleanup(spark)
    table = shared.saved(spark.range(3).toDF("i"), "three")
    paths = [Path(f.split(":", 1)[1].replace("//", "/")) for f in table.inputFiles()]
    assert table.count() == 3 and all(p.exists() for p in paths)
    assert shared.cleanup(spark) == 1 and not any(p.exists() for p in paths)
