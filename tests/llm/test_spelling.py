import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from barloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=7):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= 2}
    out, form = {}, {}
    for w, k in n.items():
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * k else None
        out[w] = [k, len(others)]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w][1], n[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def documents():
    rng = np.random.default_rng(3)
    letters = list("abcdeéÿ×")
    base = ["".join(rng.choice(letters, rng.integers(6, 10))) for _ in range(40)]
    words = list(base)
    for w in base:
        for _ in range(12):
            i = rng.integers(len(w))
            c = rng.choice(letters)
            words.append((w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:])[rng.integers(3)])
    weights = np.concatenate([rng.pareto(1.0, len(base)) * 30 + 10, rng.pareto(1.0, len(words) - len(base)) + 0.2])
    rows = []
    for i in range(300):
        rows.append((i % 250, " ".join(rng.choice(words, 60, p=weights / weights.sum())).upper().replace("É", "é") + ".x9"))
    rows += [(None, "aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa aaaaaaa aaaaaaa"), (1, None), (2, ""), (3, "1 2 3 ...")]
    rows += [(9000 + k, "wording " * 700) for k in range(2)] + [(9100, "wordimg " * 40 + "wardimg " * 3 + "wardimgs wardimgs")]
    rows += [(9200, " ".join(f"{w} {w}" for w in ("ÿÿÿÿÿÿÿ", "ÿÿÿÿÿÿa", "aÿÿÿÿÿÿ", "abababab", "babababa", "aÿbÿaÿbÿ")))]
    return rows


def test_spelling_equals_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], SCHEMA).repartition(5)
    wanted = brute(rows)
    assert sum(1 for v in wanted.values() if v[0]) > 20 and any(v[0] and wanted[v[0]][0] for v in wanted.values())
    assert got(spelling.spelling_groups(df)) == wanted
    # many cells and small samples find the same
    assert got(spelling.spelling_groups(df, cell=25, sample=60)) == wanted


def test_anagrams_long_words_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    some = sorted({"".join(rng.permutation(list("aabcdefg"))) for _ in range(1500)})
    some += sorted({"".join(rng.permutation(list("aabcdefh"))) for _ in range(1500)}) + sorted({"".join(rng.permutation(list("abcdefg"))) for _ in range(500)})
    long = "".join(rng.choice(list("abcdeféö"), 20_000))
    rows = [(1, " ".join(some)), (3, " ".join(some)), (6, f"{long} {long} {long[:1000]}x{long[1001:]} {long[:1000]}x{long[1001:]} {long[:-1]} {long[:-1]}")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    found = got(spelling.spelling_groups(df, cell=100))
    small = {w: v for w, v in found.items() if len(w) < 100}
    assert small == {w: v for w, v in brute(rows[:2]).items()}
    garbled = brute(rows[2:], least=100)
    assert {w for w in found if len(w) > 100} == set(garbled) and len(garbled) >= 2
    assert {w: v[3] for w, v in found.items() if len(w) > 100} == {w: v[3] for w, v in garbled.items()}
    empty = spark.createDataFrame([], SCHEMA)
    assert got(spelling.spelling_groups(empty)) == {} and got(spelling.spelling_groups(spark.createDataFrame([(1, None, None, None)], SCHEMA))) == {}


def test_box_pruning_reaches_every_neighbour():
    rng = np.random.default_rng(7)
    keys = sorted({"".join(sorted(rng.choice(list("abcdefgh"), rng.integers(5, 9)))) for _ in range(3000)})
    points = spelling.counts(pa.array(keys))
    tree = spelling.grow(points, np.arange(len(points)), 12, lambda rows: rows)
    far = np.abs(points[:, None, :-1] - points[None, :, :-1]).sum(-1)
    same = points[:, None, -1] == points[None, :, -1]
    wanted = {(a, b) for a, b in zip(*np.nonzero(same & (far == 2)))}
    seen = set()
    spelling.reach(tree, points, np.arange(len(points)), 1, 1, lambda leaf, rows: seen.update((a, b) for a in rows for b in leaf))
    assert wanted <= seen and len(seen) < len(points) ** 2 / 3
