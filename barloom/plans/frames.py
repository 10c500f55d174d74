"""Frames that several queries share."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import backtests as bt
from ..operators import indicators as ind
from ..operators import screens
from ..sources import panel, tables
from . import fundamentals

HOLD, OPEN_HOLD, VALUE_HOLD = 20, 20, 63


def wide(spark, sf_dir: str) -> DataFrame:
    return ind.wide(panel.bars(spark, sf_dir))


def wide_forward(spark, sf_dir: str) -> DataFrame:
    """Wide rows with the next ten opens and the entry bar's low; forward bars are taken before any join."""
    return ind.wide(ind.forward_bars(panel.bars(spark, sf_dir)))


class Strategies(NamedTuple):
    """rows: strategy, ts_code, trade_date, trade_index, exit_index, is_signal, ret, each bar once for each of seven strategies; features: what the screens
    of months are made from; calendar; hits: the rows that are signals, taken before bars are unfolded."""

    rows: DataFrame
    features: DataFrame
    calendar: DataFrame
    hits: DataFrame


def strategies(spark, sf_dir: str) -> Strategies:
    """All features come from one shuffle on the instrument and are written down once; the screens by month read them again, and a second, narrow
    table has the seven strategies of a bar as an array, so later stages read neither bars nor windows."""
    own = tables.written(panel.bars(spark, sf_dir), "bars")
    ordered = Window.partitionBy("ts_code").orderBy("trade_date")
    feats = ind.breakout_and_trend(ind.reversal_features(ind.crosses(own, 20, 60)))
    ahead = {"_close20": ("close", HOLD), "_d20": ("trade_date", HOLD), "_open21": ("idx_open", OPEN_HOLD + 1), "_idx1": ("idx_open", 1), "_d21": ("trade_date", OPEN_HOLD + 1), "_open64": ("idx_open", VALUE_HOLD + 1), "_d64": ("trade_date", VALUE_HOLD + 1), **{f"_d{i}": ("trade_date", i) for i in (2, 3, 4)}}
    feats = ind.forward_bars(feats, 4).withColumns({k: F.lead(c, n).over(ordered) for k, (c, n) in ahead.items()})
    price, offset = bt.stop_exit(4)
    stop_ret = F.try_divide(price, F.col("open_t1")) - 1
    stop_day = F.element_at(F.array(F.lit(None).cast("date"), "_d2", "_d3", "_d4"), offset)
    open_ret = F.try_divide("_open21", "_idx1") - 1
    # what is kept, and what the last windows and the recursion need: they carry all columns that they are given
    narrow = feats.select(
        "ts_code", "trade_date", "high", "low", "close", "vol", "amount20", "formation", "median20", F.col("golden").alias("_ma20_ma60"), F.col("breakout_signal").alias("_breakout"), F.col("trend_signal").alias("_trend"),
        stop_ret.alias("_stop_ret"), stop_day.alias("_stop_day"), open_ret.alias("_open_ret"), "_d21", (F.try_divide("_close20", "open_t1") - 1).alias("_close_ret"), "_d20", (F.try_divide("_open64", "_idx1") - 1).alias("_value_ret"), "_d64",
    )
    kept = ind.wide(narrow).withColumns({"_b1": screens.is_b1(), "_b2": screens.is_b2()}).select(*(c for c in narrow.columns if c not in ("high", "low", "vol")), "_b1", "_b2")
    kept = tables.written(kept, "strategy-features")
    calendar = panel.calendar(kept)
    losers = screens.reversal_candidates(kept).where("open_regime")
    r1 = screens.top_by_date(losers, F.desc("amount20")).select("ts_code", "trade_date", F.lit(True).alias("_r1"))
    value = fundamentals.value_hits(spark, sf_dir, kept).select("ts_code", "trade_date", F.lit(True).alias("_value_quality"))
    marked = kept.join(r1, ["ts_code", "trade_date"], "left").join(value, ["ts_code", "trade_date"], "left")
    legs = {"ma20_ma60": ("_close_ret", "_d20"), "b2": ("_stop_ret", "_stop_day"), "b1": ("_stop_ret", "_stop_day"), "r1": ("_open_ret", "_d21"), "breakout": ("_open_ret", "_d21"), "trend": ("_open_ret", "_d21"), "value_quality": ("_value_ret", "_d64")}
    item = lambda k, ret, day: F.struct(F.lit(k).alias("strategy"), F.coalesce(f"_{k}", F.lit(False)).alias("is_signal"), F.col(ret).alias("ret"), F.when(F.col(ret).isNotNull(), F.col(day)).alias("exit_date"))
    each = tables.written(marked.select("ts_code", "trade_date", F.array(*(item(k, *x) for k, x in legs.items())).alias("items")), "strategy-rows")
    # dates become indices on the way in: a row a date
    days = F.broadcast(calendar)

    def unfolded(items):
        rows = each.select("ts_code", "trade_date", F.inline(items)).join(days, "trade_date")
        rows = rows.join(days.select(F.col("trade_date").alias("exit_date"), F.col("trade_index").alias("exit_index")), "exit_date", "left")
        return rows.select("strategy", "ts_code", "trade_date", "trade_index", "exit_index", "is_signal", "ret")

    return Strategies(unfolded(F.col("items")), kept, calendar, unfolded(F.filter("items", lambda x: x["is_signal"])))
