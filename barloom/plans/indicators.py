"""Queries over bars and indicators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import crosses_above, rounded
from ..operators import indicators as ind
from ..sources import panel, stored, tables
from .registry import query
from .sql import d, full, lead, r, up, with_

CODE = "ts_code, " + d()


@query(with_(["bars"], f"SELECT {CODE}, {', '.join(r(c) for c in ('open', 'high', 'low', 'close', 'pre_close', 'change', 'pct_chg', 'vol', 'amount'))} FROM bars"))
def bars_panel(spark, sf_dir):
    return rounded(panel.bars(spark, sf_dir))


_WINDOWS = (5, 10, 14, 20, 28, 57, 60, 114, 120)


@query(with_(["bars"], f"SELECT {CODE}, {', '.join(r(full('avg', 'close', n), f'ma{n}') for n in _WINDOWS)} FROM bars"))
def sma_multi(spark, sf_dir):
    return rounded(ind.moving_averages(panel.bars(spark, sf_dir), _WINDOWS).select("ts_code", "trade_date", *(f"ma{n}" for n in _WINDOWS)))


_CROSSES = f"SELECT *, {{0}} AS hit FROM (SELECT *, {full('avg', 'close', 20)} AS ma20, {full('avg', 'close', 60)} AS ma60 FROM bars)"


@query(with_(["bars"], f"SELECT {CODE}, {r('close')}, {r('ma20')}, {r('ma60')} FROM ({_CROSSES.format(up('ma20', 'ma60'))}) WHERE hit"))
def golden_cross_screen(spark, sf_dir):
    return rounded(ind.crosses(panel.bars(spark, sf_dir), 20, 60).where("golden").select("ts_code", "trade_date", "close", "ma20", "ma60"))


@query(with_(["bars"], f"SELECT {CODE}, {r('close')}, {r('ma20')}, {r('ma60')} FROM ({_CROSSES.format(up('ma60', 'ma20'))}) WHERE hit"))
def death_cross(spark, sf_dir):
    return rounded(ind.crosses(panel.bars(spark, sf_dir), 20, 60).where("death").select("ts_code", "trade_date", "close", "ma20", "ma60"))


@query(with_(["kdj"], f"SELECT {CODE}, {r('k')}, {r('d')}, {r('j')} FROM kdj"))
def kdj(spark, sf_dir):
    return rounded(ind.kdj(panel.bars(spark, sf_dir)))


@query(with_(["kdj"], f"SELECT {CODE}, {r('k')}, {r('d')}, {r('j')} FROM kdj"))
def kdj_resumed(spark, sf_dir):
    """The same in two parts: the later bars with the state after the earlier ones, none of which they read."""
    bars = panel.bars(spark, sf_dir)
    early, late = bars.where("trade_date < '1996-06-01'"), bars.where("trade_date >= '1996-06-01'")
    both = ind.recursive(early).union(ind.recursive(late, ind.recursion_state(early)))
    return rounded(both.where("k is not null").select("ts_code", "trade_date", "k", "d", "j"))


@query(with_(["kdj"], f"SELECT {CODE}, {r('k')}, {r('d')} FROM (SELECT *, {up('k', 'd')} AS hit FROM kdj) WHERE hit"))
def stored_kdj_crosses(spark, sf_dir):
    """Where k crosses above d, over the indicator as a table stored by instrument: its windows need no shuffle."""
    name = f"kdj_{uuid.uuid4().hex}"
    stored.store_indicator(ind.kdj(panel.bars(spark, sf_dir)), name, tables.scratch(spark, name), 8)
    rows = stored.load_indicator(spark, name)
    return rounded(rows.withColumn("hit", crosses_above("k", "d")).where("hit").select("ts_code", "trade_date", "k", "d"))


@query(with_(["lines"], f"SELECT {CODE}, {r('trend_short / close', 'trend_short_ratio')}, {r('bull_bear / close', 'bull_bear_ratio')} FROM lines JOIN bars USING (ts_code, trade_date)"))
def trend_lines(spark, sf_dir):
    return rounded(ind.recursive(ind.add_bull_bear(panel.bars(spark, sf_dir))).select("ts_code", "trade_date", (F.col("trend_short") / F.col("close")).alias("trend_short_ratio"), (F.col("bull_bear") / F.col("close")).alias("bull_bear_ratio")))


@query(with_(["pit3"], f"SELECT {CODE}, {r('rsi5')}, {r('pdi')}, {r('mdi')}, {r('adx')}, {r('wr60')} FROM pit3"))
def rsi_dmi_wr(spark, sf_dir):
    return rounded(ind.strength(panel.bars(spark, sf_dir)).select("ts_code", "trade_date", "rsi5", "pdi", "mdi", "adx", "wr60"))


@query(with_(["pit"], f"SELECT {CODE}, {r('var2z')}, {r('var3z')}, signal::BIGINT AS signal FROM pit"))
def golden_pit(spark, sf_dir):
    return rounded(ind.golden_pit(panel.bars(spark, sf_dir)))


@query(with_(["bars"], f"SELECT {CODE}, {r(lead('open'), 'entry')}, {', '.join(r(f'{lead("close", h)} / {lead("open")} - 1', f'ret_{h}') for h in (5, 10, 20))} FROM bars"))
def forward_returns(spark, sf_dir):
    return rounded(ind.forward_returns(panel.bars(spark, sf_dir), (5, 10, 20)).select("ts_code", "trade_date", "entry", "ret_5", "ret_10", "ret_20"))


@query(with_(["r1a"], f"SELECT {CODE}, {r('ln(idx)', 'log_idx')}, {r('idx_open / idx', 'open_ratio')} FROM r1a"))
def adjusted_index(spark, sf_dir):
    return rounded(ind.reversal_features(panel.bars(spark, sf_dir)).select("ts_code", "trade_date", F.ln("idx").alias("log_idx"), (F.col("idx_open") / F.col("idx")).alias("open_ratio")))


@query(with_(["r1"], f"SELECT {CODE}, {r('formation')}, {r('ret20')}, {r('amount20')}, {r('median20')} FROM r1"))
def r1_features(spark, sf_dir):
    return rounded(ind.reversal_features(panel.bars(spark, sf_dir)).select("ts_code", "trade_date", "formation", "ret20", "amount20", "median20"))


@query(with_(["tech"], f"SELECT {CODE}, {r('high55')}, {r('vol_ratio20')}, {r('breakout_strength')} FROM tech WHERE breakout_signal"))
def breakout(spark, sf_dir):
    out = ind.breakout_and_trend(ind.reversal_features(panel.bars(spark, sf_dir)))
    return rounded(out.where("breakout_signal").select("ts_code", "trade_date", "high55", "vol_ratio20", "breakout_strength"))


@query(with_(["tech"], f"SELECT {CODE}, {r('ret120')}, {r('vol20')}, {r('trend_score')} FROM tech WHERE trend_signal"))
def trend_alignment(spark, sf_dir):
    out = ind.breakout_and_trend(ind.reversal_features(panel.bars(spark, sf_dir)))
    return rounded(out.where("trend_signal").select("ts_code", "trade_date", "ret120", "vol20", "trend_score"))


@query(with_(["calendar"], f"SELECT {d()}, trade_index FROM calendar"))
def trade_index(spark, sf_dir):
    return rounded(panel.calendar(panel.bars(spark, sf_dir)))


@query(with_(["bars"], """SELECT ts_code, count(*) AS n_bars, min(strftime(trade_date, '%Y%m%d')) AS first_date, max(strftime(trade_date, '%Y%m%d')) AS last_date,
  floor(arg_min(close, trade_date) * 1e6 + 0.5) / 1e6 AS first_close, floor(arg_max(close, trade_date) * 1e6 + 0.5) / 1e6 AS last_close,
  string_agg(strftime(trade_date, '%Y%m%d') || ':' || floor(open * 1e4 + 0.5)::BIGINT || ':' || floor(high * 1e4 + 0.5)::BIGINT || ':' || floor(low * 1e4 + 0.5)::BIGINT || ':' || floor(close * 1e4 + 0.5)::BIGINT || ':' || vol::BIGINT, ',' ORDER BY trade_date) AS kline
  FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn <= 120 GROUP BY ts_code"""))
def last_n_bars(spark, sf_dir):
    k = ind.last_bars(panel.bars(spark, sf_dir), 120)
    first, last = F.col("kline")[0], F.element_at("kline", -1)
    one = lambda b: F.concat_ws(":", F.date_format(b["trade_date"], "yyyyMMdd"), *(F.floor(b[c] * 1e4 + 0.5).cast("string") for c in ("open", "high", "low", "close")), b["vol"].cast("long").cast("string"))
    return rounded(k.select("ts_code", F.size("kline").alias("n_bars"), first["trade_date"].alias("first_date"), last["trade_date"].alias("last_date"), first["close"].alias("first_close"), last["close"].alias("last_close"), F.array_join(F.transform("kline", one), ",").alias("kline")))


@query(with_(["pit", "bars"], f"""SELECT {CODE}, {r('next_open')}, {r('latest_close')}, {r('latest_close / next_open - 1', 'ret')} FROM (
  SELECT *, {lead('open')} AS next_open, first(close) OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS latest_close, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS rn FROM bars)
  SEMI JOIN (SELECT * FROM pit WHERE signal = 1) p USING (ts_code, trade_date) WHERE rn <= 20"""))
def marked_returns(spark, sf_dir):
    bars = panel.bars(spark, sf_dir)
    return rounded(ind.marked_returns(bars, ind.golden_pit(bars).where("signal = 1")))
