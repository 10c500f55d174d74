import zlib

import numpy as np

from barloom.llm import language_id, licences


def test_licences(spark):
    mit = licences.LICENCES["MIT"]
    british = "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").replace("charge,", "charge;").upper()
    rows = [(1, mit), (2, british), (3, mit + " More."), (4, None), (5, ""), (6, "Text.\n  licensed under the apache licence, version 2.0\nReleased under the MIT License.\nMore"), (None, licences.LICENCES["ISC"]), (1, mit)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license_id string")
    got = sorted((r.doc_id or -1, r.license_id, r.notice_ids) for r in licences.scan_licences(df).collect())
    assert got == sorted([(1, "MIT", None), (2, "MIT", None), (3, None, None), (4, None, None), (5, None, None), (6, None, "Apache-2.0,MIT"), (-1, "ISC", None), (1, "MIT", None)])
    digests = {r.text_digest for r in licences.known_licences(spark).collect()}
    assert len(digests) == len(licences.LICENCES)
    plan = licences.scan_licences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_titles_markers_and_catalogues(spark):
    known = licences.LICENCES
    files = {r.license_id: r.text for r in licences.default_catalogue(spark).collect()}
    star = known["BSD-3-Clause"].replace("\n1. ", "\n * ").replace("\n2. ", "\n * ").replace("\n3. ", "\n * ")
    bare = known["BSD-2-Clause"].replace("\n1. ", "\n").replace("\n2. ", "\n")
    rows = [
        ("MIT License\n\nCopyright (c) 2020 Someone\n\n" + known["MIT"], "MIT", None),
        ("The MIT License (MIT)\n" + known["MIT"], "MIT", None),
        ("ISC License\n\n(c) 2021 A. Body\n\n" + known["ISC"], "ISC", None),
        ("BSD 3-Clause License\n\nCopyright 2019, X\nAll rights reserved.\n\n" + star, "BSD-3-Clause", None),
        (bare, "BSD-2-Clause", None),
        (known["BSD-2-Clause"].replace("\n1. ", "\n(a) ").replace("\n2. ", "\n(b) "), "BSD-2-Clause", None),
        ("\n".join("# " + x for x in ("MIT License\n\nCopyright (c) X\n\n" + known["MIT"]).split("\n")), "MIT", None),
        ("MIT License\n\n" + known["MIT"] + " More.", None, None),
        ("MIT License\n", None, None), ("\n\n* \n", None, None), (None, None, None),
        ("Some text.\nReleased under the ISC License\n# SPDX-License-Identifier: MPL-2.0\nEnd", None, "ISC,MPL-2.0"),
    ]
    rows += [(files[i], i, None) for i in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in licences.scan_licences(df).collect()}
    assert {i: got[i][0] for i in got} == {i: r[1] for i, r in enumerate(rows)}
    assert all(got[i][1] == r[2] for i, r in enumerate(rows[:12]))
    own = spark.createDataFrame([("Own-2", "Own License\n\n1. Do as you like."), ("Own-1", "Do as you like."), ("None", "")], "license_id string, text string")
    few = spark.createDataFrame([(1, "- Do as you like"), (2, "Do as you like"), (3, ""), (4, known["MIT"]), (5, "Own License\n1. Do as you like")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licences.scan_licences(few, own).collect()} == {1: "Own-1", 2: "Own-1", 3: None, 4: None, 5: "Own-2"}


def test_wrapped_lines_ties_and_very_long_texts(spark):
    mit = licences.LICENCES["MIT"]
    words = mit.split()
    at = words.index("COPYRIGHT")
    wrapped = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + " ".join(words[:at]) + "\n" + " ".join(words[at:])  # a line begins with COPYRIGHT HOLDERS
    years = "Copyright 2019-2021, Some Body <a@b.c>\n(c) 2001 Other\n(C) Copyright Third\nAll rights reserved.\n" + mit
    lettered = "(c) You must do so\n" + mit  # no statement
    long = "word " * 300_000
    catalogue = spark.createDataFrame([("B", "Do as you like"), ("A", "do as YOU like."), ("Long", long)], "license_id string, text string")
    df = spark.createDataFrame([(1, wrapped), (2, years), (3, lettered), (4, long), (5, long + "x")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licences.scan_licences(df).collect()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}
    df = df.union(spark.createDataFrame([(6, "DO AS YOU LIKE!")], df.schema))
    assert {r.doc_id: r.license_id for r in licences.scan_licences(df, catalogue).collect()} == {1: None, 2: None, 3: None, 4: "Long", 5: None, 6: "A"}


SYLLABLES = {"aa": ["the", "an", "ing", "of"], "bb": ["ñor", "que", "la", "ción"], "cc": ["sch", "und", "ß", "ein"]}


def corpus(n=300, seed=0):
    rng = np.random.default_rng(seed)
    langs = list(SYLLABLES)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[langs[i % 3]], 3)) for _ in range(30)), langs[i % 3]) for i in range(n)]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 --- ", "aa"), (1003, "the an ing " * 20000, None), (None, "que la ción", "aa")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    out = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(out) > 30 and np.mean([a == b for a, b in out]) >= 0.97
    assert all(r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    # held-out labels teach nothing
    other = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    assert "zz" not in {r.lang_pred for r in language_id.identify(other).collect()}


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(df).collect()] == [("und", 0.0)]
    assert [(r.lang_pred, r.score) for r in language_id.identify(df.drop("lang")).collect()] == [("und", 0.0)]
    assert language_id.identify(df.limit(0)).count() == 0


def grams(text):
    t = text.lower()
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_against_sets():
    texts = ["abc", "abcabc", "", "Zß\U0001f600x", "xyz"]
    k = language_id.Landmarks(texts[:4]).kernel(texts)
    want = [[len(grams(a) & grams(b)) / np.sqrt(max(1, len(grams(a))) * max(1, len(grams(b)))) for b in texts[:4]] for a in texts]
    assert np.allclose(k, want, atol=1e-6)


def test_predictions_against_brute_force(spark):
    """Sets of strings, the same sample, one dense solve."""
    rng = np.random.default_rng(4)
    rows = [(i, t + " " + "".join(rng.choice(list("abcdeß ñó"), 12)), lang) for i, t, lang in corpus(150, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, landmarks=5, all_rows=60, rows=25).collect()}
    # the sample: the first of each language by Spark's hash
    order = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(11, string(doc_id), text) AS h").collect()}
    taught = {}
    for i, t, lang in sorted(rows, key=lambda r: (order[r[0]], str(r[0]))):
        if zlib.crc32(str(i).encode()) % 5:
            taught.setdefault(lang, []).append(t)
    langs = sorted(taught)
    assert all(len(v) > 20 for v in taught.values())
    sample = [(lang, t, n) for lang in langs for n, t in enumerate(taught[lang][:20])]
    marks = [t for _, t, n in sample if n < 5]
    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    val, vec = np.linalg.eigh(own)
    root = (vec / np.sqrt(val))[:, val > 1e-6 * val.max()]
    phi = np.array([[kernel(t, b) for b in marks] for _, t, _ in sample]) @ root
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _, _ in sample])
    bias = np.ones((len(sample), 1))
    a = np.hstack([phi, bias])
    fine = 1e-3 * len(sample) * np.diag([1.0] * phi.shape[1] + [0.0])
    beta = np.linalg.solve(a.T @ a + fine, a.T @ y)
    for i, t, _ in rows:
        s = np.append(np.array([kernel(t, b) for b in marks]) @ root, 1) @ beta
        p = np.exp(4 * (s - s.max()))
        assert got[i].lang_pred == langs[int(s.argmax())]
        assert abs(got[i].score - p.max() / p.sum()) < 1e-4


def test_many_languages(spark):
    """No language is left out, whatever their number."""
    rng = np.random.default_rng(8)
    rows = []
    for lang in range(80):
        letters = [chr(0x4E00 + 3 * lang + j) for j in range(3)]
        rows += [(len(rows) + j, " ".join("".join(rng.choice(letters, 4)) for _ in range(12)), f"l{lang:02d}") for j in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df).collect()}
    assert len(set(got.values())) == 80
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95
