import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import personal_data as pd_

SCHEMA = "doc_id long, text string, spans string, n int"
#: As the task words them.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for place, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def make(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(4)
    pieces = ["a@b.c", "@", ".", "a.b%", "_", "1.2.3.4", "256.1.1.1", "0001.1.1.001", "4111 1111 1111 1111", "4111-1111-1111-1111", "5", " ", "-", "+1 (555) 010-9999", "+", "(", ")", "12", "é", "😀", "\n", "x", "37828224631000", "00000000000000", "+4930123456", "0", "255", "@x-.y", "a@b@c.d"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", "a@b.c_d@e.f", "a@b.c.", "1.2.3.4.5.6.7.8.9", "+1-2-3-4-5-6-7-8-9-0-x", "12 34", "😀😀 a@b.cc 😀 10.0.0.1"]
    got = {r.doc_id: r for r in pd_.find_personal_data(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans, r = brute(t), got[i]
        own = [s for s in r.spans.split(",") if s and s.split(":")[0] in PLAIN]
        assert own == spans, t
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in PLAIN]


def test_very_long_texts_are_read_in_linear_time(spark):
    n = 400_000
    texts = ["a" * n, "1" * n, "1 " * n, "a@" * n, "a.b@c" * n, "+1" * n, "+1(((" + "(" * n, "1.2" * n, "A" * n, "Ab " * n, "1-a" * n, "x at y " * n, "a@b.cc " * 40_000, "0.0.0.0 " * 40_000]
    got = {r.doc_id: r for r in pd_.find_personal_data(make(spark, texts).repartition(4)).collect()}
    assert got[12].n_email == 40_000 and got[13].n_ip == 40_000
    assert got[12].spans == ",".join(f"email:{7 * i}:{7 * i + 6}" for i in range(40_000))


def corpus(seed, n=900):
    """Texts with what no base pattern finds, and look-alikes: (text, span or None)."""
    rnd = random.Random(seed)
    filler = ["thing", "was", "there", "and", "over", "the", "river", "with", "some", "more", "words"]
    digits = lambda k: "".join(rnd.choices("0123456789", k=k))
    first = lambda: rnd.choice(["Anna", "Thomas", "Marie", "Carlos", "Karen", "Jonas"])
    last = lambda: rnd.choice(["Miller", "Okafor", "Svenson", "Petit", "Gomez", "Brandt"])
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    yes = [
        lambda: (rnd.choice(["call ", "phone ", "tel. "]), f"({digits(3)}) {digits(3)}-{digits(4)}"), lambda: (rnd.choice(["call me on ", "mobile "]), f"0{digits(3)} {digits(7)}"), lambda: ("SSN ", f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (rnd.choice(["mail ", "write to ", "contact "]), f"{word()} [at] {word()} [dot] com"), lambda: ("reach ", f"{word()} (at) {word()}.org"), lambda: ("mail ", f"{word()} at {word()} dot net"),
        lambda: (rnd.choice(["dear ", "signed ", "name: "]), f"{first()} {last()}"), lambda: (rnd.choice(["patient ", "contact "]), f"Mr {last()} {last()}"),
    ]
    no = [
        lambda: ("isbn ", "978" + digits(10)), lambda: ("order ", digits(9)), lambda: ("on ", f"20{digits(2)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}"), lambda: ("version ", f"{digits(3)}.{digits(4)}.{digits(2)}"),
        lambda: ("total ", f"{digits(8)} eur"), lambda: ("invoice ", digits(11)), lambda: ("the ", "Thomas March Street"), lambda: ("located in ", "Charles River City"), lambda: ("serial ", digits(4) + "-" + digits(4) + "-" + digits(4)),
    ]
    out = []
    for _ in range(n):
        good = rnd.random() < 0.5
        cue, item = rnd.choice(yes if good else no)()
        before = " ".join(rnd.choices(filler, k=rnd.randint(3, 9))) + " " + cue
        out.append((f"{before}{item.replace(' eur', '') if not good else item}{' eur' if item.endswith(' eur') else ''} {' '.join(rnd.choices(filler, k=5))}.", (len(before), len(before) + len(item)) if good else None))
    return out


def test_added_spans_precision_and_recall(spark):
    rows = corpus(7)
    got = {r.doc_id: r.spans for r in pd_.find_personal_data(make(spark, [t for t, _ in rows])).collect()}
    hit = wrong = missed = 0
    for i, (t, span) in enumerate(rows):
        found = {tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s and s.split(":")[0] in pd_.FURTHER}
        hit += span in found
        missed += span is not None and span not in found
        wrong += len(found - {span})
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.9, (hit, missed, wrong)


def test_learning_equals_plain_python(spark):
    df = make(spark, [t for t, _ in corpus(8, 500)] + ["a@b.com 1.2.3.4", "tel +49 30 1234567", "card 4111 1111 1111 1111"] * 30)
    found = pd_.saved(pd_.candidates(df), "test")
    table = pd_.saved(pd_.patterns_of(found), "test")
    rows = table.collect()
    learned = pd_.reliabilities(table, rounds=6, least_change=0.0)
    # plain expectation-maximisation
    kinds = {r["kind"] for r in rows}
    total = {k: sum(r["n"] for r in rows if r["kind"] == k) for k in kinds}
    now = {k: {"share": pd_.PRIOR[k], "votes": [[[pd_._assumed(y, v) for v in (-1, 0, 1)] for y in (0, 1)] for _ in pd_.LABELERS]} for k in kinds}

    def post(r):
        own = now[r["kind"]]
        odds = math.log(own["share"] / (1 - own["share"]))
        for j, name in enumerate(pd_.LABELERS):
            odds += math.log(own["votes"][j][1][r[name] + 1] / own["votes"][j][0][r[name] + 1])
        return 1 / (1 + math.exp(-odds))

    for _ in range(6):
        p, new = [post(r) for r in rows], {}
        for k in kinds:
            w = pd_.PRIOR_SHARE * total[k] + pd_.PRIOR_ROWS
            yes = sum(r["n"] * q for r, q in zip(rows, p) if r["kind"] == k)
            mass = (total[k] - yes, yes)
            told = [[[(sum(r["n"] * (q if y else 1 - q) for r, q in zip(rows, p) if r["kind"] == k and r[name] == v) + w * pd_._assumed(y, v)) / (mass[y] + w) for v in (-1, 0, 1)] for y in (0, 1)] for name in pd_.LABELERS]
            new[k] = {"share": (yes + w * pd_.PRIOR[k]) / (total[k] + w), "votes": told}
        now = new
    for k in kinds:
        assert learned[k]["share"] == pytest.approx(now[k]["share"], abs=1e-9)
        assert np.allclose(learned[k]["votes"], now[k]["votes"])
    # plain gradient of the classifier vanishes at its weights
    weights = np.array(pd_.train(table, learned))
    slope = -weights.copy()
    m, k0 = len(pd_.LABELERS), len(pd_.KINDS)
    scores = {}
    for r in rows:
        x = np.zeros(pd_.FEATURES)
        x[pd_.KINDS.index(r["kind"])] = 1
        for j, name in enumerate(pd_.LABELERS):
            if r[name]:
                x[k0 + j + (m if r[name] < 0 else 0)] = 1
        x[k0 + 2 * m : k0 + 2 * m + r["shape"]] = 1
        z = float(x @ weights)
        scores[tuple(r[c] for c in ("kind", *pd_.LABELERS, "shape"))] = z
        slope += r["n"] * (post(r) - 1 / (1 + math.exp(-z))) * x
    assert np.abs(slope).max() < 1e-3
    # and what is kept follows from the plain scores
    got = {r.doc_id: r.spans for r in found.select("doc_id", F.transform(F.filter("spans", lambda s: s["base"] | pd_.is_personal(weights.tolist(), s)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"))).alias("spans")).collect()}
    for r in found.collect():
        assert got[r.doc_id] == [f"{s.kind}:{s.start}" for s in r.spans if s.base or scores[(s.kind, *s.votes, s.shape)] >= 0]


def test_further_spans_touch_no_base_span_and_edge_cases(spark):
    texts = ["call +1 (555) 010-9999 now", "10.0.0.1 and 555-0100-22", None, "", "mail a@b.com (at) c [dot] com"]
    for r in pd_.candidates(make(spark, texts)).collect():
        base = [(s.start, s.end) for s in r.spans if s.base]
        assert not [s for s in r.spans if not s.base and any(s.start < e and b < s.end for b, e in base)]
    assert pd_.find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = pd_.find_personal_data(spark.createDataFrame([(None, "a@b.cc", None, 1), (1, None, None, 1), (1, None, None, 1)], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.spans, r.n_email) for r in rows) == [(0, "email:0:6", 1), (1, "", 0), (1, "", 0)]
    plan = pd_.find_personal_data(make(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
