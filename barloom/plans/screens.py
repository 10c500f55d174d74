"""Queries of the screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codes import is_risky
from ..functions.exprs import rounded
from ..operators import indicators as ind
from ..operators import screens
from ..sources import panel
from . import frames
from .registry import query
from .sql import d, r, with_

CODE = "ts_code, " + d()
_NEAR = "datediff('day', lag(trade_date) OVER (PARTITION BY ts_code ORDER BY trade_date), trade_date) <= 90"


@query(with_(["b1", "instruments", "calendar"], f"""SELECT {CODE}, name, industry, {r('close')}, {r('vol_ratio')}, {r('j')}, {r('ma60')}, strftime(last_signal, '%Y%m%d') AS last_signal, days_since, position FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY n DESC, mj, industry, j, ts_code) AS position FROM (
  SELECT *, count(*) OVER (PARTITION BY trade_date, industry) AS n, avg(j) OVER (PARTITION BY trade_date, industry) AS mj FROM (
  SELECT h.*, name, coalesce(industry, '(unknown)') AS industry FROM (
  SELECT *, CASE WHEN {_NEAR} THEN lag(trade_date) OVER (PARTITION BY ts_code ORDER BY trade_date) END AS last_signal,
    CASE WHEN {_NEAR} THEN trade_index - lag(trade_index) OVER (PARTITION BY ts_code ORDER BY trade_date) END AS days_since
  FROM b1 JOIN calendar USING (trade_date) WHERE b1) h LEFT JOIN instruments USING (ts_code))))"""))
def b1_screen(spark, sf_dir):
    bars = panel.bars(spark, sf_dir)
    hits = screens.b1_hits(ind.wide(bars), panel.instruments(spark, sf_dir), panel.calendar(bars))
    return rounded(hits.select("ts_code", "trade_date", "name", "industry", "close", "vol_ratio", "j", "ma60", "last_signal", "days_since", "position"))


@query(with_(["b1"], f"""SELECT {d()}, count(*) AS universe, count(*) FILTER (vol_ratio < 1) AS c1, count(*) FILTER (j < 15) AS c2, count(*) FILTER (close > ma60) AS c3,
  count(*) FILTER (trend_short > bull_bear) AS c4, count(*) FILTER (close > bull_bear) AS c5, count(*) FILTER (b1) AS b1
  FROM b1 WHERE vol_ratio IS NOT NULL AND j IS NOT NULL AND ma60 IS NOT NULL AND bull_bear IS NOT NULL GROUP BY b1.trade_date"""))
def b1_counts(spark, sf_dir):
    return rounded(screens.condition_counts(frames.wide(spark, sf_dir)))


@query(with_(["b1", "instruments"], """SELECT CASE WHEN rn <= 10 THEN industry ELSE '(others)' END AS industry, count(*) AS kinds, sum(n)::BIGINT AS n FROM (
  SELECT *, row_number() OVER (ORDER BY n DESC, industry) AS rn FROM (
  SELECT coalesce(industry, '(unknown)') AS industry, count(*) AS n FROM b1 LEFT JOIN instruments USING (ts_code) WHERE b1 GROUP BY 1)) GROUP BY 1"""))
def b1_industry_dist(spark, sf_dir):
    own = panel.instruments(spark, sf_dir).select("ts_code", F.coalesce("industry", F.lit("(unknown)")).alias("industry"))
    return rounded(screens.industry_distribution(frames.wide(spark, sf_dir).where(screens.is_b1()).join(own, "ts_code", "left")))


@query(with_(["b1", "instruments"], f"""SELECT {CODE}, name, industry, {r('(bull_bear - trend_short) / bull_bear', 'gap')}, row_number() OVER (PARTITION BY b1.trade_date ORDER BY floor((bull_bear - trend_short) / bull_bear * 1e6 + 0.5) DESC, ts_code) AS position
  FROM b1 LEFT JOIN instruments USING (ts_code) WHERE trend_short < bull_bear AND bull_bear > 0"""))
def b2_screen(spark, sf_dir):
    hits = frames.wide(spark, sf_dir).where(screens.is_b2()).withColumn("gap", screens.gap_pct() / 100)
    # ordered by the rounded gap, so that the last bits of a sum decide nothing
    hits = screens.top_by_date(hits.withColumn("_g", F.floor(F.col("gap") * 1e6 + 0.5)), F.desc("_g"), n=1 << 30)
    return rounded(hits.join(panel.instruments(spark, sf_dir).select("ts_code", "name", "industry"), "ts_code", "left").select("ts_code", "trade_date", "name", "industry", "gap", "position"))


@query(with_(["losers"], f"""SELECT {CODE}, {r('formation')}, {r('amount20')}, {r('share')}, coalesce(median20 > 0, false) AS open_regime,
  row_number() OVER (PARTITION BY losers.trade_date ORDER BY amount20 DESC, ts_code) AS position FROM losers QUALIFY position <= 20"""))
def r1_select(spark, sf_dir):
    losers = screens.reversal_candidates(ind.reversal_features(panel.bars(spark, sf_dir)))
    top = screens.top_by_date(losers, F.desc("amount20"))
    return rounded(top.select("ts_code", "trade_date", "formation", "amount20", "share", "open_regime", "position"))


@query(with_(["tech"], f"""SELECT {CODE}, {r('trend_score')}, row_number() OVER (PARTITION BY tech.trade_date ORDER BY trend_score DESC, amount20 DESC, ts_code) AS position FROM tech WHERE trend_signal QUALIFY position <= 20"""))
def cap_signals(spark, sf_dir):
    rows = ind.breakout_and_trend(ind.reversal_features(panel.bars(spark, sf_dir))).where("trend_signal")
    return rounded(screens.top_by_date(rows, F.desc("trend_score"), F.desc("amount20")).select("ts_code", "trade_date", "trend_score", "position"))


@query(with_(["b1", "pit", "calendar"], f"""SELECT {CODE}, gp_signal::BIGINT AS gp_signal, {r('gp_var2z')}, strftime(ld, '%Y%m%d') AS gp_last_signal, ti - li AS gp_days_since FROM b1 LEFT JOIN (
  SELECT ts_code, trade_date, signal AS gp_signal, var2z AS gp_var2z, trade_index AS ti,
    max(CASE WHEN signal = 1 THEN trade_date END) OVER w AS ld, max(CASE WHEN signal = 1 THEN trade_index END) OVER w AS li
  FROM pit JOIN calendar USING (trade_date) WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) p USING (ts_code, trade_date) WHERE b1"""))
def gp_annotate(spark, sf_dir):
    bars = panel.bars(spark, sf_dir)
    hits = ind.wide(bars).where(screens.is_b1()).select("ts_code", "trade_date")
    return rounded(screens.annotate_pit(hits, ind.golden_pit(bars), panel.calendar(bars)))


_OK = "NOT regexp_matches(upper(coalesce(name, '')), 'ST|退')"


def _top(score: str, extra: str, source: str) -> str:
    return f"SELECT {CODE}, name, {r('score')}, {extra}, position FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, amount DESC, ts_code) AS position FROM (SELECT *, floor(({score}) * 1e6 + 0.5) / 1e6 AS score FROM {source} LEFT JOIN instruments USING (ts_code) WHERE {_OK})) WHERE position <= 8"


def _ranked(source: str) -> str:
    """Rows with the score and rank of their industry on the date."""
    return f"(SELECT *, coalesce(s.score0, 0) AS ss, coalesce(s.rank0, 999) AS sr FROM (SELECT w.*, i.industry AS ind, (close / ma60 - 1) * 100 AS ext, amount / 100000 AS liq FROM {source} w LEFT JOIN instruments i USING (ts_code)) x LEFT JOIN (SELECT trade_date AS td, industry AS i2, score AS score0, rank AS rank0 FROM ranked) s ON s.td = x.trade_date AND s.i2 = x.ind)"


def _why(*reasons: str) -> str:
    return f"concat_ws('; ', {', '.join(repr(x) for x in reasons)}, CASE WHEN sr <= 10 THEN 'sector rank ' || sr::BIGINT END) AS reasons"


#: Wider limits than the defaults: this panel moves more than a market.
_CHANGE_CROSS, _EXTENSION, _CHANGE_B2 = (-50, 80), (0, 300), (0, 500)


@query(with_(["b1", "gold", "instruments", "ranked"], _top("50 * ss + 18 * (sr <= 10)::INT + 1.5 * least(liq, 12) - 1.2 * abs(ext - 3) - 2 * greatest(pct_chg - 5, 0)", "sr::BIGINT AS sector_rank, " + _why("moving averages crossed"), f"(SELECT * FROM {_ranked('(SELECT b1.* FROM b1 JOIN gold g USING (ts_code, trade_date) WHERE g.golden AND amount >= 50000 AND pct_chg BETWEEN -50 AND 80)')} WHERE ext BETWEEN 0 AND 300)")))
def recommend_cross(spark, sf_dir):
    from . import sectors

    bars = sectors.bars_once(spark, sf_dir)
    best = screens.recommend_cross(ind.crosses(bars, 20, 60), panel.instruments(spark, sf_dir), sectors.ranking(spark, sf_dir, bars), change=_CHANGE_CROSS, extension=_EXTENSION)
    return rounded(best.select("ts_code", "trade_date", "name", "score", F.col("sector_rank").cast("long").alias("sector_rank"), "reasons", "position"))


@query(with_(["b1", "instruments", "ranked"], _top("greatest(15 - j, 0) + 10 * greatest(1 - vol_ratio, 0) + 0.5 * least(liq, 10) + 5 * (sr <= 10)::INT", f"{r('j')}, sr::BIGINT AS sector_rank, {_why('oversold', 'volume below its mean', 'close above the long lines')}", _ranked("(SELECT * FROM b1 WHERE b1 AND vol_ratio > 0 AND vol_ratio < 1 AND amount >= 100000)"))))
def recommend_b1(spark, sf_dir):
    from . import sectors

    bars = sectors.bars_once(spark, sf_dir)
    best = screens.recommend_b1(ind.wide(bars), panel.instruments(spark, sf_dir), sectors.ranking(spark, sf_dir, bars))
    return rounded(best.select("ts_code", "trade_date", "name", "score", "j", F.col("sector_rank").cast("long").alias("sector_rank"), "reasons", "position"))


@query(with_(["b1", "instruments", "ranked"], _top("18 - abs(gp - 6) + least(liq, 10) + 5 * (sr <= 10)::INT", f"{r('gp', 'gap_pct')}, sr::BIGINT AS sector_rank, {_why('short line below the long one', 'rising today')}", _ranked("(SELECT * FROM (SELECT *, (bull_bear - trend_short) / bull_bear * 100 AS gp FROM b1 WHERE trend_short < bull_bear AND bull_bear > 0) WHERE gp BETWEEN 3 AND 12 AND amount >= 100000 AND pct_chg BETWEEN 0 AND 500)"))))
def recommend_b2(spark, sf_dir):
    from . import sectors

    bars = sectors.bars_once(spark, sf_dir)
    best = screens.recommend_b2(ind.wide(bars), panel.instruments(spark, sf_dir), sectors.ranking(spark, sf_dir, bars), change=_CHANGE_B2)
    return rounded(best.select("ts_code", "trade_date", "name", "score", "gap_pct", F.col("sector_rank").cast("long").alias("sector_rank"), "reasons", "position"))


def _list(strategy: str, score: str, digits: int, order: str, source: str, *why: str) -> str:
    reasons = " || '; ' || ".join(why)
    return f"""SELECT '{strategy}' AS strategy, ts_code, {d()}, coalesce(name, ts_code) AS name, coalesce(industry, '未分类') AS industry, {r('close')}, floor(amount20 / 100000 * 10 + 0.5) / 10 AS amount_unit,
  floor(({score}) * 1e{digits} + 0.5) / 1e{digits} AS score, position, {reasons} AS reasons FROM (SELECT t.*, i.name, i.industry, row_number() OVER (PARTITION BY trade_date ORDER BY {order}, ts_code) AS position FROM ({source}) t LEFT JOIN instruments i USING (ts_code) WHERE {_OK.replace('name', 'i.name')}) WHERE position <= 8"""


def _t(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)::DECIMAL(18,1)::VARCHAR"


_LIQUID = "'mean amount of 20 bars ' || " + _t("amount20 / 100000")


@query(with_(["tech", "losers", "instruments", "value_hits"], " UNION ALL ".join([
    _list("breakout", "breakout_strength * 10 + vol_ratio20", 2, "breakout_strength DESC, amount20 DESC", "SELECT * FROM tech WHERE breakout_signal", f"'above the high of 55 bars by ' || {_t('breakout_strength')} || '%'", f"'volume ' || {_t('vol_ratio20')} || ' times its mean'", _LIQUID),
    _list("trend", "trend_score", 2, "trend_score DESC, amount20 DESC", "SELECT * FROM tech WHERE trend_signal", "'means of 20, 60 and 120 in order'", "'the slowest rising for 20 bars'", f"'return of 120 bars ' || {_t('ret120 * 100')} || '%'", _LIQUID),
    _list("r1", "amount20 / 100000", 1, "amount20 DESC", "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount20 DESC, ts_code) AS place FROM losers) WHERE place <= 20", f"'formation return ' || {_t('formation * 100')} || '%'", "'the latest week left out'", _LIQUID, f"'market median of 20 bars ' || {_t('median20 * 100')} || '%'"),
    _list("value_quality", "score", 1, "score DESC, amount20 DESC", "SELECT * EXCLUDE (name, position) FROM value_hits", f"'return on equity, median and least of the reports ' || {_t('roe_median')} || ' and ' || {_t('roe_min')}", f"'margin ' || {_t('margin_median')}",
          f"'growth of revenue and profit ' || {_t('revenue_yoy_median')} || ' and ' || {_t('profit_yoy_median')}", f"'price to earnings and book ' || {_t('pe')} || ' and ' || {_t('pb')}", "'cash flow positive in the reports'"),
])))
def recommend_technical(spark, sf_dir):
    """The best eight of each date with their reasons: breakouts, trends, the reversal pool whatever the regime, and the value screen's rows."""
    from . import fundamentals

    rows = ind.breakout_and_trend(ind.reversal_features(panel.bars(spark, sf_dir)))
    names = panel.instruments(spark, sf_dir)
    lists = [screens.recommend_breakouts(rows, names), screens.recommend_trends(rows, names), screens.observe_reversals(rows, names), screens.recommend_values(fundamentals.value_hits(spark, sf_dir), names)]
    return rounded(lists[0].union(lists[1]).union(lists[2]).union(lists[3]))
