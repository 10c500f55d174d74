"""Queries of the next-session model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import backtests as bt
from ..operators import nextday as nd
from ..operators import screens
from ..sources import panel
from . import frames
from .registry import query
from .sql import cte, d, full, lag, lead, r, with_

cte("nd0", ["bars"], f"""SELECT *, close / prev - 1 AS ret_1d, close / {lag('close', 3)} - 1 AS ret_3d, close / {lag('close', 5)} - 1 AS ret_5d, {full('avg', 'close', 5)} AS m5, {full('avg', 'close', 20)} AS m20, {full('avg', 'vol', 5)} AS v5, {full('avg', 'amount', 20)} AS a20,
  {lead('close')} / {lead('open')} - 1 AS next_ret, {lead('trade_date')} AS next_trade_date FROM (SELECT *, coalesce(CASE WHEN pre_close > 0 THEN pre_close END, {lag('close')}) AS prev FROM bars)""")
cte("nd", ["nd0"], f"""SELECT *, ret_1d - market_ret_1d AS relative_strength_1d, CASE WHEN next_ret > 0 THEN 1.0 WHEN next_ret IS NOT NULL THEN 0.0 END AS target FROM (SELECT *, close / m5 - 1 AS close_vs_ma5, close / m20 - 1 AS close_vs_ma20, m5 / m20 - 1 AS ma5_vs_ma20, vol / v5 - 1 AS volume_ratio_5d, amount / a20 - 1 AS amount_ratio_20d, close / open - 1 AS intraday_ret,
  (high - low) / prev AS range_pct, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_position, {full('stddev_samp', 'ret_1d', 10)} AS volatility_10d, median(ret_1d) OVER (PARTITION BY trade_date) AS market_ret_1d FROM nd0)""")
_KNOWN = " AND ".join(f"{f} IS NOT NULL" for f in nd.FEATURES)


def _dataset(spark, sf_dir):
    return nd.dataset(panel.bars(spark, sf_dir))


@query(with_(["nd"], f"SELECT ts_code, {d()}, {', '.join(r(f) for f in nd.FEATURES)}, {r('next_ret')}, {r('target')}, {d('next_trade_date')} FROM nd"))
def next_day_features(spark, sf_dir):
    return rounded(_dataset(spark, sf_dir).select("ts_code", "trade_date", *nd.FEATURES, "next_ret", "target", "next_trade_date"))


@query(with_(["nd"], f"SELECT {', '.join(r(f'median({f})', f'median_{f}') + ', ' + r(f'stddev_pop({f})', f'scale_{f}') for f in nd.FEATURES)} FROM nd WHERE {_KNOWN} AND target IS NOT NULL"))
def next_day_standardise(spark, sf_dir):
    return rounded(nd.centre_and_scale(_dataset(spark, sf_dir).dropna(subset=[*nd.FEATURES, "target"])))


#: A model with given weights, so that SQL can score it.
_FIXED = nd.Model([0.1 * (i % 5 - 2) for i in range(15)], [0.05] * 14, [0.5 + 0.1 * i for i in range(14)], 0)
_PARTS = [f"{w!r} * greatest(-8, least(8, ({f} - {c!r}) / {s!r}))" for f, w, c, s in zip(nd.FEATURES, _FIXED.weights[1:], _FIXED.centres, _FIXED.scales, strict=True)]
_PROB = f"1 / (1 + exp(-greatest(-35, least(35, {_FIXED.weights[0]!r} + {' + '.join(_PARTS)}))))"


@query(with_(["nd", "b1", "instruments"], f"""SELECT ts_code, {d()}, name, {r('prob_up')}, row_number() OVER (PARTITION BY t.trade_date ORDER BY floor(prob_up * 1e6 + 0.5) DESC, ts_code) AS prediction_rank FROM (
  SELECT nd.*, name, {_PROB} AS prob_up FROM nd SEMI JOIN (SELECT * FROM b1 WHERE b1) h USING (ts_code, trade_date) LEFT JOIN instruments USING (ts_code) WHERE {_KNOWN} AND amount >= 20000 AND NOT contains(upper(coalesce(name, '')), 'ST')) t"""))
def next_day_score(spark, sf_dir):
    """Given weights over the instruments that the B1 screen hits."""
    pool = frames.wide(spark, sf_dir).where(screens.is_b1()).select("trade_date", "ts_code")
    table = nd.prediction_table(nd.score(_FIXED, _dataset(spark, sf_dir)), pool, panel.instruments(spark, sf_dir))
    return rounded(table.select("ts_code", "trade_date", "name", "prob_up", "prediction_rank"))


@query()
def next_day_fit(spark, sf_dir):
    """The fitted path's weights, on all dates but the last; no SQL expresses the iteration."""
    rows = _dataset(spark, sf_dir).select("trade_date", "next_trade_date", "target", *nd.FEATURES)
    cal = panel.calendar(panel.bars(spark, sf_dir))
    last = cal.agg(F.max("trade_date")).first()[0]
    m = nd.fit(nd.training_rows(rows, cal, last), least_rows=1)
    names = ["intercept", *nd.FEATURES]
    values = zip(names, m.weights, [0.0, *m.centres], [1.0, *m.scales], strict=True)
    return spark.createDataFrame([(n, float(w), float(c), float(s), m.rows) for n, w, c, s in values], "feature string, weight double, centre double, scale double, training_rows long")


@query()
def next_day_walk_forward(spark, sf_dir):
    """A model fitted at the start of each test window, and its ten best rows of that date; no SQL expresses the fits."""
    cal = panel.calendar(panel.bars(spark, sf_dir))
    starts = bt.walk_forward_windows(cal).join(cal, F.col("test_start") == F.col("trade_index")).select("trade_date")
    rows = _dataset(spark, sf_dir).select("ts_code", "trade_date", "next_trade_date", "next_ret", "target", *nd.FEATURES)
    return rounded(nd.walk_forward(rows, cal, [r[0] for r in starts.collect()], least_rows=1))


@query(with_(["nd"], f"""SELECT {d('trade_date')}, count(*) AS picks, {r('avg(target)', 'win_rate')}, {r('avg(next_ret)', 'mean_ret')}, avg(next_ret) > 0 AS profitable FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY floor(prob_up * 1e6 + 0.5) DESC, ts_code) AS rn FROM (SELECT *, {_PROB} AS prob_up FROM nd WHERE {_KNOWN} AND next_ret IS NOT NULL)) t WHERE rn <= 10 GROUP BY t.trade_date"""))
def next_day_report(spark, sf_dir):
    scored = nd.score(_FIXED, _dataset(spark, sf_dir).where("next_ret IS NOT NULL")).withColumn("p", F.floor(F.col("prob_up") * 1e6 + 0.5))
    return rounded(nd.report(screens.top_by_date(scored, F.desc("p"), n=10)))
