"""Hand-made frames for the operators, and properties that hold on any panel."""

from datetime import date, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import codes, exprs
from barloom.operators import backtests as bt
from barloom.operators import combine, fundamentals, indicators, medians, nextday, screens, sectors
from barloom.plans import sql
from barloom.sources import panel

DAY = date(2020, 1, 1)


def make_bars(spark, n_codes=3, n=150, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_codes):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        for i in range(n):
            o = close[i] * (1 + rng.normal(0, 0.01))
            hi, lo = max(o, close[i]) * 1.01, min(o, close[i]) * 0.99
            pre = close[i - 1] if i else None
            rows.append((f"60000{c}.SH", DAY + timedelta(days=i), float(o), float(hi), float(lo), float(close[i]), None if pre is None else float(pre), None if pre is None else float((close[i] / pre - 1) * 100), float(rng.integers(100, 900)), float(rng.integers(100_000, 900_000))))
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, pre_close double, pct_chg double, vol double, amount double")


def by_key(df, *cols):
    return {(r.ts_code, r.trade_date): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def bars(spark):
    return make_bars(spark).cache()


def test_kdj_skips_zero_ranges_and_matches_the_recursion(spark):
    flat = [(10.0, 10.0, 10.0)] * 12 + [(11.0, 9.0, 10.5), (12.0, 10.0, 11.0), (11.5, 9.5, 9.9)]
    df = spark.createDataFrame([("600000.SH", DAY + timedelta(days=i), h, lo, c, c) for i, (h, lo, c) in enumerate(flat)], "ts_code string, trade_date date, high double, low double, close double, open double")
    got = sorted(by_key(indicators.kdj(df), "k", "d", "j").items())
    assert [k[1] for k, _ in got] == [DAY + timedelta(days=i) for i in (12, 13, 14)]
    k = d = 50.0
    for (_, v), (hi, lo, c) in zip(got, [(11, 9, 10.5), (12, 9, 11.0), (12, 9, 9.9)], strict=True):
        k = (2 * k + (c - lo) / (hi - lo) * 100) / 3
        d = (2 * d + k) / 3
        assert np.allclose(v, (k, d, 3 * k - 2 * d))


def test_rolling_values_are_null_until_full(spark, bars):
    out = indicators.moving_averages(bars, (20,)).orderBy("ts_code", "trade_date").toPandas()
    want = out.groupby("ts_code")["close"].rolling(20).mean().to_numpy()
    assert np.allclose(out["ma20"].to_numpy(dtype=float), want, equal_nan=True)


def test_means_by_sums_of_sums(spark):
    """Equal to window frames, nulls and short series too, with no frame of n rows; the SQL's index multiplies date by date."""
    rng = np.random.default_rng(5)
    steps = rng.normal(1.02, 0.1, 400)
    rows = [("a", DAY + timedelta(days=i), None if i in (7, 200) else float(x)) for i, x in enumerate(steps)] + [("b", DAY, 1.0)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, x double")
    sizes = (1, 2, 3, 4, 5, 14, 16, 20, 28, 57, 60, 64, 114, 120)
    out = exprs.with_rolling_means(df, {f"m{n}": ("x", n) for n in sizes})
    assert "-113" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.orderBy("ts_code", "trade_date").toPandas()
    for n in sizes:
        want = got.groupby("ts_code")["x"].rolling(n).mean().to_numpy()
        assert np.allclose(got[f"m{n}"].to_numpy(float), want, rtol=1e-12, atol=0, equal_nan=True)
    con = duckdb.connect()
    con.register("rows_", pd.DataFrame({"ts_code": "a", "trade_date": [DAY + timedelta(days=i) for i in range(400)], "open": 1.0, "close": 1.0, "amount": 1.0, "pct_chg": (steps - 1) * 100}))
    index = con.execute(f"WITH bars AS (SELECT * FROM rows_) SELECT idx FROM ({sql.CTES['r1a'][1]}) ORDER BY trade_date").fetchnumpy()["idx"]
    one_by_one, now = [], 1.0
    for x in (steps - 1) * 100:
        now *= 1 + x / 100
        one_by_one.append(now)
    assert list(index) == one_by_one


@pytest.mark.parametrize("operator", [
    lambda b: indicators.wide(b).select("ts_code", "trade_date", "k", "d", "j", "trend_short", "bull_bear", "ma60", "vol_ratio"),
    lambda b: indicators.golden_pit(b),
    lambda b: indicators.breakout_and_trend(indicators.reversal_features(b)).select("ts_code", "trade_date", "idx", "formation", "median20", "breakout_signal", "trend_signal", "trend_score"),
    lambda b: nextday.dataset(b).select("ts_code", "trade_date", *nextday.FEATURES),
])
def test_no_look_ahead(spark, bars, operator):
    """What comes after a date changes nothing up to it."""
    cut = DAY + timedelta(days=130)
    later = F.col("trade_date") > F.lit(cut)
    changed = bars.withColumns({c: F.when(later, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "vol", "amount", "pct_chg", "pre_close")})
    before = lambda df: df.where(F.col("trade_date") <= F.lit(cut)).orderBy("ts_code", "trade_date").toPandas()
    pd.testing.assert_frame_equal(before(operator(bars)), before(operator(changed)))


def test_partition_count_changes_nothing(spark, bars):
    frames = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        frames.append(indicators.wide(bars).orderBy("ts_code", "trade_date").toPandas())
    pd.testing.assert_frame_equal(*frames)


def test_ex_right_drop_is_no_loss(spark):
    rows = [("600000.SH", DAY + timedelta(days=i), 20.0 if i < 30 else 10.0, 20.0 if i < 30 else 10.0, 1.0, 0.0) for i in range(70)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, close double, amount double, pct_chg double")
    assert indicators.reversal_features(df).agg(F.max(F.abs("formation"))).first()[0] == 0


def test_unknown_conditions_count_as_inverse_hits(spark):
    df = spark.createDataFrame([("a", DAY, None, 1.0), ("b", DAY, 5.0, 2.0), ("c", DAY, 0.5, 3.0)], "ts_code string, trade_date date, ma60 double, close double").withColumn("ret", F.lit(0.1))
    c3 = F.coalesce(F.col("close") > F.col("ma60"), F.lit(False))
    got = {r.condition: r.n for r in bt.attribution(df, {"c3": c3, "c3_inv": ~c3}, ["ret"]).collect()}
    assert got == {"c3": 1, "c3_inv": 2}


def test_stop_ladder_with_missing_bars(spark):
    rows = [(1, 10.0, 9.0, 9.5, 11.0, 9.0), (2, 10.0, 11.0, 9.0, 12.0, 9.5), (3, 10.0, 11.0, 12.0, 13.0, 9.0), (4, 10.0, 11.0, None, None, 9.0)]
    df = spark.createDataFrame(rows, "i int, open_t1 double, open_t2 double, open_t3 double, open_t4 double, low_t1 double")
    got = {r.i: (r.exit_kind, r.holding_days, None if r.ret is None else round(r.ret, 6)) for r in bt.with_stop_trades(df).collect()}
    assert got == {1: ("forced", 3, 0.1), 2: ("stop_t3", 2, -0.1), 3: ("forced", 3, 0.3), 4: (None, None, None)}


def test_curve_arithmetic(spark):
    legs = spark.createDataFrame([("s", DAY, 0.2), ("s", DAY, 0.0), ("s", DAY + timedelta(days=1), -0.1), ("t", DAY, -0.1), ("u", DAY, -5.0), ("u", None, 1.0), ("u", DAY, None)], "strategy string, trade_date date, leg double")
    got = {(r.strategy, (r.trade_date - DAY).days): (round(r.nav, 6), round(r.drawdown, 6)) for r in bt.curve(legs).collect()}
    assert got == {("s", 0): (1.1, 0.0), ("s", 1): (0.99, -0.1), ("t", 0): (0.9, -0.1), ("u", 0): (0.05, -0.95)}


def test_sparse_curve_drops_unfinished_trades(spark):
    prices = [(10.0, 10.0), (10.0, 11.0), (12.0, 12.0), (10.8, 11.0)]
    b = spark.createDataFrame([("a", DAY + timedelta(days=i), o, c) for i, (o, c) in enumerate(prices)], "ts_code string, trade_date date, open double, close double")
    s = spark.createDataFrame([("x", "a", DAY), ("x", "a", DAY + timedelta(days=2))], "strategy string, ts_code string, trade_date date")
    legs = bt.holding_legs(b, s, 2, open_exit=True, only_complete=True)
    got = [round(r.leg, 6) for r in legs.orderBy("trade_date").collect()]
    assert got == [0.098, round(12 / 11 - 1, 6), -0.1]
    assert bt.holding_legs(b, s, 2, open_exit=True).count() == 4


def wf_rows(spark, later=0.0):
    rows = []
    for c in range(2):
        for i in range(12):
            rows.append(("s", i, i + 1 if i < 11 else None, True, (0.01 + (later if i >= 5 else 0)) if i < 11 else None))
    return spark.createDataFrame(rows, "strategy string, trade_index long, exit_index long, is_signal boolean, ret double")


def test_embargo_and_future_invariance(spark):
    cal = spark.range(12).select(F.col("id").alias("trade_index"))
    windows = bt.walk_forward_windows(cal, 5, 3)
    assert [(r.train_start, r.test_start, r.test_end) for r in windows.orderBy("test_start").collect()] == [(0, 5, 7), (3, 8, 10), (6, 11, 11)]
    gates = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.5)], "strategy string, min_signals long, min_net_mean double, min_excess double, min_win_rate double")
    first = lambda df: bt.walk_forward(df, windows, gates).orderBy("test_start").first()
    r = first(wf_rows(spark))
    assert r.training_signals == 8 and r.approved and r.test_signals == 6  # exits at 5 are not known before window 5
    assert first(wf_rows(spark, later=-0.5)) == r


def test_average_rank_share(spark):
    from barloom.functions.exprs import rank_share

    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None), (1, 1.0)], "g int, x double")
    got = sorted((r.x or -1, r.s) for r in df.withColumn("s", rank_share("x", ["g"])).collect())
    want = pd.Series([5, 5, 7, np.nan, 1.0]).rank(pct=True)
    assert got == sorted(zip([5.0, 5.0, 7.0, -1, 1.0], [None if np.isnan(v) else v for v in want], strict=True), key=lambda x: (x[0], x[1] or 0))


def test_codes_and_limits(spark):
    raw = [("600000", "600000.SH"), (" 000001 ", "000001.SZ"), ("830001", "830001.BJ"), ("920001", "920001.BJ"), ("123456", "123456"), ("600000.sh", "600000.SH"), ("abc", "ABC")]
    df = spark.createDataFrame(raw, "raw string, want string").withColumn("got", codes.canonical_code(F.col("raw")))
    assert all(r.got == r.want for r in df.collect())
    short = spark.createDataFrame([("1", "000001.SZ"), ("300001.XY", "300001.SZ"), ("999999", None)], "raw string, want string").withColumn("got", codes.code_of(F.col("raw")))
    assert all(r.got == r.want for r in short.collect())
    rows = [("600000.SH", "A", "2026-01-05", 10.0, 11.0, True), ("300001.SZ", "A", "2026-01-05", 10.0, 12.0, True), ("830001.BJ", "A", "2026-01-05", 10.0, 13.0, True), ("600001.SH", "*ST B", "2026-07-03", 10.0, 10.5, True),
            ("600001.SH", "*ST B", "2026-07-06", 10.0, 10.5, False), ("600001.SH", "*ST B", "2026-07-06", 10.0, 11.0, True), ("600000.SH", "A", "2026-01-05", 0.0, 0.0, False), ("600000.SH", "A", "2026-01-05", None, 1.0, False), ("600000.SH", "A", "2026-01-05", 3.35, 3.69, True)]
    lim = spark.createDataFrame(rows, "ts_code string, name string, d string, pre double, close double, want boolean").withColumn("got", codes.is_limit_up(F.col("ts_code"), F.col("name"), F.col("d").cast("date"), F.col("pre"), F.col("close")))
    assert all(r.got == r.want for r in lim.collect())
    num = spark.createDataFrame([("1.5", 1.5), ("--", None), ("", None), ("x", None)], "t string, want double").withColumn("got", codes.lenient_number(F.col("t")))
    assert all(r.got == r.want for r in num.collect())
    days = spark.createDataFrame([("20240131",), ("2024-01-31",), ("2024-01-31 00:00",)], "t string").select(codes.lenient_date(F.col("t")).alias("d")).collect()
    assert {r.d for r in days} == {date(2024, 1, 31)}


def test_search(spark):
    df = spark.createDataFrame([("600000.SH", "Alpha Bank", 1), ("000001.SZ", "Beta", 2), (None, None, 3)], "ts_code string, name string, i int")
    ids = lambda t: sorted(r.i for r in combine.search(df, t).collect())
    assert ids("600000") == ids("600000.sh") == ids("alpha") == [1] and ids("a.k") == [] and ids("SZ") == [2]
    assert combine.search(df.select(F.col("i").alias("x"), F.lit("Q1").alias("y")), "q").count() == 3


def test_combine_keeps_unmatched_and_orders(spark):
    s = spark.createDataFrame([("d", "600000", "A"), ("d", "000002.SZ", "B")], "signal_date string, ts_code string, name string")
    p = spark.createDataFrame([("d", "600000.SH", 0.4, "r"), ("d", "300001.SZ", 0.9, "q")], "signal_date string, ts_code string, prob_up double, reasons string")
    got = [(r.canonical_code, r.prediction_rank, r.has_signal) for r in combine.combine(s, p).orderBy("position").collect()]
    assert got == [("300001.SZ", 1, False), ("600000.SH", 2, True), ("000002.SZ", None, True)]
    assert combine.prediction_rows(combine.combine(s, p)).count() == 2


def test_value_needs_three_announced_reports(spark):
    reports = [(f"{y}-12-31", f"{y + 1}-04-15", 1.0 * y) for y in (2018, 2019, 2020)]
    cols = {"eps": 1.0, "book_value_per_share": 5.0, "ocf_per_share": 1.0, "roe": 20.0, "gross_margin": 30.0, "revenue_yoy": 5.0, "net_profit_yoy": 5.0, "debt_to_assets": 30.0}
    r = spark.createDataFrame([("a", a, b, x) for a, b, x in reports], "ts_code string, r string, a string, x double").select("ts_code", F.col("r").cast("date").alias("report_date"), F.col("a").cast("date").alias("announcement_date"), *(F.lit(v).alias(c) for c, v in cols.items()))
    p = spark.createDataFrame([("a", "2021-04-14"), ("a", "2021-04-15")], "ts_code string, d string").select("ts_code", F.col("d").cast("date").alias("trade_date"), F.lit("A").alias("name"), F.lit(10.0).alias("close"), F.lit(200_000.0).alias("amount20"))
    snap = fundamentals.as_of_three(p, r)
    assert sorted((x.trade_date.day, x.report_count, x.report_date.year) for x in snap.collect()) == [(14, 2, 2019), (15, 3, 2020)]
    assert [x.trade_date.day for x in fundamentals.value_quality(snap).collect()] == [15]


def test_month_ends_are_of_completed_months(spark):
    df = spark.createDataFrame([(date(2020, 1, 30),), (date(2020, 1, 31),), (date(2020, 2, 3),)], "trade_date date")
    assert [r.trade_date for r in screens.month_ends(df).collect()] == [date(2020, 1, 31)]


def test_confirmation_counts_islands(spark):
    leaders = ["A", "A", "B", "A", "A", "A"]
    rows = [(DAY + timedelta(days=i), n, k + 1, 0.85 - 0.15 * k) for i, top in enumerate(leaders) for k, n in enumerate([top, "Z"])]
    ranked = spark.createDataFrame(rows, "trade_date date, industry string, rank int, score double")
    got = [(r.main_line, r.consecutive_days, r.level) for r in sectors.confirmation(ranked).orderBy("trade_date").collect()]
    assert got == [("A", 1, "emerging"), ("A", 2, "emerging"), ("B", 1, "emerging"), ("A", 1, "emerging"), ("A", 2, "emerging"), ("A", 3, "strong")]


def test_single_industry_scores_half(spark):
    row = {"trade_date": DAY, "industry": "A", "members": 9} | dict.fromkeys(sectors.WEIGHTS, 1.0)
    out = sectors.rank(spark.createDataFrame([row])).first()
    assert out["rank"] == 1 and abs(out["score"] - 0.45) < 1e-6


def test_industry_trends_grid(spark):
    hits = spark.createDataFrame([("a", DAY), ("b", DAY), ("a", DAY + timedelta(days=1)), ("c", DAY + timedelta(days=1))], "ts_code string, trade_date date")
    names = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", " ")], "ts_code string, industry string")
    got = {(r.industry, (r.trade_date - DAY).days): (r.n, r.change, r.is_new, r.is_removed) for r in sectors.industry_trends(hits, names).collect()}
    assert got == {("X", 0): (1, 1, True, False), ("X", 1): (1, 0, False, False), ("Y", 0): (1, 1, True, False), ("Y", 1): (0, -1, False, True), (codes.NO_INDUSTRY, 0): (0, 0, False, False), (codes.NO_INDUSTRY, 1): (1, 1, True, False)}


def test_fit_follows_the_gradient_path(spark, bars):
    rows = nextday.dataset(bars).select("trade_date", "next_trade_date", "target", *nextday.FEATURES)
    m = nextday.fit(rows, steps=25, least_rows=10)
    pdf = rows.dropna(subset=[*nextday.FEATURES, "target"]).toPandas()
    x = pdf[nextday.FEATURES].to_numpy()
    s = x.std(0)
    x = np.clip((x - np.median(x, 0)) / np.where(s < 1e-12, 1, s), -8, 8)
    x = np.c_[np.ones(len(x)), x]
    y = pdf["target"].to_numpy()
    age = 0.5 ** ((max(pdf["trade_date"]) - pdf["trade_date"]).map(lambda t: t.days) / 120).to_numpy(float)
    age /= age.mean()
    w = np.zeros(15)
    base = np.average(y, weights=age)
    w[0] = np.log((base + 1e-6) / (1 - base + 1e-6))
    for k in range(25):
        g = x.T @ (age * (1 / (1 + np.exp(-x @ w)) - y)) / len(y) + 2.0 * np.r_[0, np.ones(14)] * w / len(y)
        w -= 0.08 / np.sqrt(1 + k / 50) * g
    assert np.allclose(m.weights, w, atol=1e-8)
    with pytest.raises(ValueError):
        nextday.fit(rows, least_rows=10**6)


def test_medians_keep_no_group_in_one_task(spark):
    """Exact for even and odd counts, ties, nulls, groups without values and a null group; no aggregate holds a group's values."""
    rng = np.random.default_rng(3)
    rows = [(g, None if i % 7 == 3 else float(v), None if g == "c" else float(i % 3)) for g, n in (("a", 5001), ("b", 4000), (None, 3), ("c", 2)) for i, v in enumerate(rng.normal(0, 1, n).round(3))]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = medians.medians(df, ["x", "y"], ["g"])
    want = df.groupBy("g").agg(F.median("x"), F.median("y")).collect()
    assert sorted(got.collect(), key=str) == sorted(want, key=str) and len(want) == 4
    assert medians.medians(df, ["x"]).first()[0] == df.agg(F.median("x")).first()[0]
    assert medians.medians(df.where("false"), ["x"]).collect() == [(None,)]
    plans = [nextday.centre_and_scale(df.select(*(F.col("x").alias(c) for c in nextday.FEATURES))), bt.cohort_stats(df.select("g", "x", F.lit(DAY).alias("trade_date")), ["x"], ["g"])]
    assert all("percentile" not in p._jdf.queryExecution().optimizedPlan().toString() and "median(" not in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)


def test_fits_of_many_dates_equal_single_ones(spark, bars):
    rows, cal = nextday.dataset(bars), panel.calendar(bars)
    days = [DAY + timedelta(days=n) for n in (90, 110)]
    both = nextday.fit_dates(rows, cal, [*days, DAY], train_dates=40, steps=10, least_rows=10)
    assert sorted(both) == days
    for on in days:
        one = nextday.fit(nextday.training_rows(rows, cal, on, dates=40), steps=10, least_rows=10)
        assert both[on].rows == one.rows and both[on].centres == one.centres
        assert np.allclose(both[on].weights, one.weights, atol=1e-9)
    picks = nextday.walk_forward(rows, cal, days, top=2, train_dates=40, steps=10, least_rows=10)
    best = nextday.score(both[days[0]], rows.where(F.col("trade_date") == F.lit(days[0]))).where("next_ret IS NOT NULL").orderBy(F.desc("prob_up"), "ts_code").limit(2)
    got = [(r.ts_code, r.prob_up) for r in picks.where(F.col("trade_date") == F.lit(days[0])).orderBy("day_rank").collect()]
    assert [c for c, _ in got] == [r.ts_code for r in best.collect()] and np.allclose([p for _, p in got], [r.prob_up for r in best.collect()])


def test_decisions_name_the_first_missing_condition(spark):
    names = ["ma20_ma60", "b2", "r1", "value_quality", "breakout"]
    gates = spark.createDataFrame([(s, t, ok) for s in names for t, ok in ((1, True), (2, s != "breakout"))], "strategy string, test_start long, approved boolean")

    def reasons(cohorts, log_nav, drawdown, is_open, latest=True):
        periods = spark.createDataFrame([("r1", "holdout", cohorts, log_nav, drawdown), ("r1", "development", 9, 1.0, 0.0)], "strategy string, period string, cohort_count long, log_nav double, max_drawdown double")
        own = gates.withColumn("approved", F.col("approved") & (F.lit(latest) | (F.col("strategy") != "r1") | (F.col("test_start") < 2)))
        return {r.strategy: r for r in bt.decisions(own, periods, spark.createDataFrame([(is_open,)], "open_regime boolean")).collect()}

    t = reasons(3, 0.1, -0.15, True)
    assert {s: (t[s].status, t[s].reason) for s in names} == {"ma20_ma60": ("active", "gate passed"), "b2": ("watch", "observed only"), "r1": ("active", "gate passed"), "value_quality": ("watch", "needs review"), "breakout": ("watch", "gate failed")}
    assert (t["r1"].same_status, t["b2"].same_status, t["value_quality"].action, t["b2"].action) == (2, 3, "research", "observe")
    assert reasons(2, 0.1, -0.01, True)["r1"].reason == "hold-out too short"
    assert reasons(3, 0.1, -0.16, True)["r1"].reason == "hold-out failed"
    assert reasons(3, 0.0, -0.01, True)["r1"].reason == "hold-out failed"
    assert reasons(3, 0.1, -0.01, False, latest=False)["r1"].reason == "gate failed"
    assert reasons(3, 0.1, -0.01, False)["r1"].reason == "market closed"


def test_training_rows_know_no_later_outcome(spark, bars):
    rows, cal = nextday.dataset(bars), panel.calendar(bars)
    on = DAY + timedelta(days=100)
    t = nextday.training_rows(rows, cal, on, dates=30)
    low, high, known = t.agg(F.min("trade_date"), F.max("trade_date"), F.max("next_trade_date")).first()
    assert (low, high, known) == (DAY + timedelta(days=70), DAY + timedelta(days=99), on)


def test_score_is_monotone_and_explains(spark):
    m = nextday.Model([0.0, 1.0] + [0.0] * 13, [0.0] * 14, [1.0] * 14, 1)
    df = spark.createDataFrame([(float(i), *([0.0] * 13)) for i in (-1, 0, 1, 100)], ", ".join(f"{f} double" for f in nextday.FEATURES))
    got = nextday.score(m, df).orderBy("ret_1d").collect()
    p = [r.prob_up for r in got]
    assert p == sorted(p) and p[1] == 0.5 and abs(p[3] - 1 / (1 + np.exp(-8))) < 1e-12
    assert got[3].reasons.startswith("ret_1d+") and got[0].reasons.startswith("ret_1d-")


def test_search_layouts(spark):
    df = spark.createDataFrame([("600001.SH", "Alpha ST", "x600001"), ("000002.SZ", None, "y"), ("600001", "beta", "z"), (None, "GAMMA", "600001.sh")], "`Security-Code` string, `Short Name` string, note string")
    found = lambda *a, **k: sorted(r.note for r in combine.search(df, *a, **k).collect())
    assert found("600001") == ["x600001", "z"] and found("600001.SH") == ["x600001", "z"] and found("600001.sz") == ["x600001", "z"]
    assert found("60000") == ["x600001", "z"]  # not a code: a part of any code or name
    assert found("alpha") == ["x600001"] and found("gamma") == ["600001.sh"]
    assert found("y") == [] and found("y", all_columns=True) == ["y"]
    assert found("600001", all_columns=True) == ["600001.sh", "x600001", "z"]
    assert found("z", names=["note"]) == ["y", "z"]
    assert combine.columns_ending(df, combine.CODE_ENDS) == ["Security-Code"] and combine.columns_ending(df, combine.NAME_ENDS) == ["Short Name"]
    odd = spark.createDataFrame([("v", "1", "2")], "value string, date string, ts_code string")
    assert combine.ordered_columns(odd).columns == ["ts_code", "date", "value"]
    assert combine.dated_rows({"a": odd, "b": odd.drop("value")}, "date").columns == ["source", "signal_date", "value", "ts_code"]


RECOMMENDED = "ts_code string, trade_date string, close double, ma60 double, amount double, pct_chg double, golden boolean, vol_ratio double, j double, trend_short double, bull_bear double"


def test_recommendations_by_default_limits(spark):
    names = spark.createDataFrame([(c, n, i) for c, n, i in [("A", "a", "lead"), ("B", "b", "tail"), ("C", "*st c", "lead"), ("D", None, None), ("E", "e", "lead"), ("F", "f", "lead")]], "ts_code string, name string, industry string")
    sectors = spark.createDataFrame([("d", "lead", 0.8, 3), ("d", "tail", 0.1, 40)], "trade_date string, industry string, score double, rank int")
    base = {"trade_date": "d", "close": 103.0, "ma60": 100.0, "amount": 200_000.0, "pct_chg": 2.0, "golden": True, "vol_ratio": 0.5, "j": 5.0, "trend_short": 102.0, "bull_bear": 101.0}
    rows = lambda *changes: spark.createDataFrame([tuple(({**base, "ts_code": c} | x)[k.split()[0]] for k in RECOMMENDED.split(", ")) for c, x in changes], RECOMMENDED)
    got = lambda df: [(r.ts_code, round(r.score, 6), r.reasons) for r in df.orderBy("position").collect()]
    b1 = screens.recommend_b1(rows(("A", {}), ("B", {}), ("C", {}), ("D", {"vol_ratio": 0.9}), ("E", {"vol_ratio": 0.0}), ("F", {"amount": 99_999.0})), names, sectors)
    assert got(b1) == [("A", 10 + 5 + 1 + 5, "oversold; volume below its mean; close above the long lines; sector rank 3"), ("B", 16.0, "oversold; volume below its mean; close above the long lines"), ("D", 12.0, "oversold; volume below its mean; close above the long lines")]
    low = {"trend_short": 94.0, "bull_bear": 100.0}
    b2 = screens.recommend_b2(rows(("A", low), ("B", low | {"pct_chg": 5.1}), ("D", low | {"pct_chg": 5.0}), ("E", low | {"trend_short": 97.5}), ("F", low | {"trend_short": 87.9})), names, sectors)
    assert got(b2) == [("A", 18 + 2 + 5, "short line below the long one; rising today; sector rank 3"), ("D", 20.0, "short line below the long one; rising today")]
    cross = screens.recommend_cross(rows(("A", {}), ("B", {}), ("D", {"pct_chg": 8.1}), ("E", {"close": 112.5}), ("F", {"golden": False})), names, sectors)
    assert [(c, s) for c, s, _ in got(cross)] == [("A", 40 + 18 + 3.0), ("B", 5 + 3.0)]


def test_specially_treated_only(spark):
    scored = spark.createDataFrame([("A", "d", 0.9, 30_000.0), ("B", "d", 0.8, 30_000.0), ("C", "d", 0.7, 30_000.0), ("D", "d", 0.6, None)], "ts_code string, trade_date string, prob_up double, amount double")
    names = spark.createDataFrame([("A", "*st a", "i"), ("B", "b退", "i"), ("C", None, "i"), ("D", "d", "i")], "ts_code string, name string, industry string")
    assert [r.ts_code for r in nextday.prediction_table(scored, scored, names).orderBy("prediction_rank").collect()] == ["B", "C"]


def test_baseline_holds_signals_and_all_rows_of_their_dates(spark):
    df = spark.createDataFrame([("A", 1, True), ("B", 1, False), ("C", 1, None), ("A", 2, False)], "ts_code string, trade_date int, hit boolean")
    got = sorted((r.cohort, r.ts_code) for r in bt.with_baseline(df, F.col("hit")).collect())
    assert got == [("baseline", "A"), ("baseline", "B"), ("baseline", "C"), ("signal", "A")]


def test_recursion_goes_on_from_its_state(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    rows = []
    for code in ("a", "b", "c"):
        for i in range(60):
            low, high = sorted(rng.integers(1, 6, 2).tolist())
            rows.append((code, date(2024, 1, 1) + timedelta(days=i), float(high), float(low), float(rng.integers(low, high + 1)), i))
    bars = spark.createDataFrame(rows, "ts_code string, trade_date date, high double, low double, close double, note int").where("ts_code <> 'c' OR note > 40")
    whole = indicators.recursive(bars)
    for cuts in ([5], [30], [3, 9, 31, 50]):
        state, parts, last = None, [], -1
        for cut in [*cuts, 99]:
            own = bars.where((F.col("note") > last) & (F.col("note") <= cut))
            parts.append(indicators.recursive(own, state).collect())
            state, last = spark.createDataFrame(indicators.recursion_state(own, state).collect(), indicators.STATE), cut
        key = lambda r: (r.ts_code, r.trade_date)
        assert sorted((r for p in parts for r in p), key=key) == sorted(whole.collect(), key=key)
        assert {r.ts_code: r.last_date for r in state.collect()} == {r.ts_code: r.last_date for r in indicators.recursion_state(bars).collect()}
    assert "FlatMapGroups" not in whole._jdf.queryExecution().executedPlan().toString()


def test_limit_up_names_and_previous_closes(spark):
    rows = [("600000.SH", "*ST X", 5.0, 5.25, True), ("600000.SH", "BEST", 5.0, 5.25, False), ("600000.SH", "best", 5.0, 5.5, True), ("600000.SH", "st y", 5.0, 5.25, True), ("600000.SH", None, 5.005, 5.51, True), ("600000.SH", None, 5.0045, 5.5, True), ("600000.SH", "x", None, 5.0, False), ("600000.SH", "x", 0.0, 0.0, False)]
    df = spark.createDataFrame([(*r[:2], date(2024, 1, 2), *r[2:]) for r in rows], "ts_code string, name string, d date, pre double, close double, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", codes.is_limit_up(F.col("ts_code"), F.col("name"), F.col("d"), F.col("pre"), F.col("close"))).collect())


def test_as_of_by_months(spark):
    day = lambda *ds: spark.createDataFrame([(date.fromisoformat(d),) for d in ds], "day date")
    known = day("2024-01-31", "2024-02-10", "2024-05-01").withColumnRenamed("day", "trade_date")
    got = {str(r.day): r.known and str(r.known) for r in sectors.as_of(known, day("2024-01-01", "2024-01-31", "2024-02-01", "2024-02-10", "2024-02-11", "2024-04-30", "2024-07-01", "2024-07-01")).collect()}
    assert got == {"2024-01-01": None, "2024-01-31": "2024-01-31", "2024-02-01": "2024-01-31", "2024-02-10": "2024-02-10", "2024-02-11": "2024-02-10", "2024-04-30": "2024-02-10", "2024-07-01": "2024-05-01"}


def test_bridge_and_boards_without_members(spark):
    landed = spark.createDataFrame([("d", "b", "600001", "first", 1, 2), ("d", "b", "600001 ", "again", 1, 1), ("d", "b", "1", "none", 1, 3), ("d", "b", "000002", "other", 2, 1), ("d", "b", "000002", "late", 3, 1)], "trade_date string, concept_code string, symbol string, given_name string, page int, place int")
    names = spark.createDataFrame([("600001.SH", "600001", None, "I"), ("000002.SZ", "000002", "Two", None), ("000002.SH", "000002", "Index", None)], "ts_code string, symbol string, name string, industry string")
    m = sectors.member_bridge(landed, names)
    assert sorted(tuple(r) for r in m.collect()) == [("d", "b", "000002.SH", "other", 3), ("d", "b", "600001.SH", "again", 1)]
    boards = spark.createDataFrame([("d", "b", 1, 1.0, 2e8, 50.0), ("d", "empty", 2, None, None, None)], "trade_date string, concept_code string, rank int, pct_chg double, amount double, breadth_pct double")
    prices = spark.createDataFrame([("d", "000002.SH", 10.0, 11.0, 10.0, 1.0)], "trade_date string, ts_code string, pre_close double, close double, pct_chg double, amount double").withColumn("trade_date", F.lit("d"))
    got = {r.concept_code: (r.members, r.limit_ups, [(x.member_rank, x.name) for x in r.members_listed]) for r in sectors.board_payload(boards, m, prices, names).collect()}
    assert got == {"b": (2, 1, [(1, "again"), (3, "Index")]), "empty": (0, None, [])}


def test_pending_rankings_prune_and_equal_a_full_run(spark):
    import random

    rnd = random.Random(3)
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(140)]
    rows = [(f"s{k}", d, float(rnd.randint(5, 9)), float(rnd.randint(5, 9)), rnd.uniform(-3, 3), float(rnd.randint(1, 99))) for k in range(20) for d in days if rnd.random() < 0.9]
    bars = spark.createDataFrame(rows, "ts_code string, trade_date date, high double, close double, pct_chg double, amount double")
    names = spark.createDataFrame([(f"s{k}", "A" if k % 2 else "B") for k in range(20)], "ts_code string, industry string")
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "trade_date date, trade_index int")
    asked = []

    def load(start, end):
        asked.append((start, end))
        return bars.where(F.col("trade_date").between(F.lit(start), F.lit(end)))

    whole = sectors.rank(sectors.factors(bars, names, calendar))
    stored = whole.where(F.col("trade_date") < days[130])
    rest = sectors.rank_pending(load, names, calendar, stored)
    clean = lambda df: sorted((r.trade_date, r.industry, r.rank, round(r.score, 6), round(r.return_20d, 9)) for r in df.where(F.col("trade_date") >= days[130]).collect())
    assert clean(rest) == clean(whole) and asked == [(days[130 - sectors.LOOK_BACK], days[-1])]
    assert sectors.rank_pending(load, names, calendar, whole) is None
    assert sectors.last_dates(whole, 3).select("trade_date").distinct().count() == 3
    pairs = spark.createDataFrame([("s1", days[0]), ("s1", days[0]), ("zz", days[0])], "ts_code string, trade_date date")
    assert combine.rows_of_pairs(bars, pairs).count() <= 1
