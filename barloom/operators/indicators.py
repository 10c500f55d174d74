"""Technical indicators over a bar panel. All of an instrument's windows share one shuffle and one sort on its key."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import after, before, crosses_above, crosses_below, holds, rolling_max, rolling_mean, rolling_min, rolling_std, rolling_sum, series, with_date_median, with_rolling_means

#: Periods and seeds.
KDJ_PERIOD, KDJ_SEED = 9, 50.0
TREND_SPAN, TREND_MEANS = 10, (14, 28, 57, 114)
PIT_LEAST_BARS = 60


def moving_averages(bars: DataFrame, windows: tuple[int, ...], column: str = "close") -> DataFrame:
    """Adds ma{n} for each window."""
    return with_rolling_means(bars, {f"ma{n}": (column, n) for n in windows})


def crosses(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Adds ma{short}, ma{long}, golden and death."""
    out = moving_averages(bars, (short, long))
    return out.withColumns({"golden": crosses_above(f"ma{short}", f"ma{long}"), "death": crosses_below(f"ma{short}", f"ma{long}")})


def _smooth(x: np.ndarray, alpha: float, seed: float | None = None) -> np.ndarray:
    """Exponential smoothing from the seed, or from the first value."""
    own = x if seed is None else np.concatenate([[seed], x])
    out = pd.Series(own).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out if seed is None else out[1:]


#: What a recursion needs of all bars before: one row an instrument.
STATE = "ts_code string, last_date date, k double, d double, ema double, trend double, highs array<double>, lows array<double>"


def _recursion():
    """Arrays of an instrument's highs, lows and closes in date order, and what was there before, to arrays of the recursive values."""

    def runs(highs: pa.Array, lows: pa.Array, closes: pa.Array, k0: pa.Array, d0: pa.Array, e0: pa.Array, t0: pa.Array, before_highs: pa.Array, before_lows: pa.Array) -> pa.Array:
        def ends(x):
            sizes = np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            return np.concatenate([[0], np.cumsum(sizes)])

        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
        at, before_at = ends(closes), ends(before_highs)
        highs, lows, closes, more_highs, more_lows = (flat(x) for x in (highs, lows, closes, before_highs, before_lows))
        k0, d0, e0, t0 = ([None if v is None or np.isnan(v) else v for v in x.to_pylist()] for x in (k0, d0, e0, t0))
        # values of all instruments of a batch in five flat columns: no object an instrument stays
        rsv, kk, dd, ema, trend = out = [np.full(at[-1], np.nan) for _ in range(5)]
        gap, alpha = KDJ_PERIOD - 1, 2 / (TREND_SPAN + 1)
        for i in range(len(at) - 1):
            own, more = slice(at[i], at[i + 1]), slice(before_at[i], before_at[i + 1])
            close, n = closes[own], at[i + 1] - at[i]
            if not n:
                continue
            padded = [np.concatenate([np.full(gap, np.nan), x[more], y[own]])[-(n + gap) :] for x, y in ((more_highs, highs), (more_lows, lows))]
            top, bottom = (f(np.lib.stride_tricks.sliding_window_view(x, KDJ_PERIOD), 1) for f, x in ((np.max, padded[0]), (np.min, padded[1])))
            with np.errstate(invalid="ignore", divide="ignore"):
                rsv[own] = np.where(top > bottom, (close - bottom) / (top - bottom) * 100, np.nan)
            known = ~np.isnan(rsv[own])
            kk[own][known] = k = _smooth(rsv[own][known], 1 / 3, KDJ_SEED if k0[i] is None else k0[i])
            dd[own][known] = _smooth(k, 1 / 3, KDJ_SEED if d0[i] is None else d0[i])
            ema[own] = _smooth(close, alpha, e0[i])
            trend[own] = _smooth(ema[own], alpha, t0[i])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in out], ["rsv", "k", "d", "ema", "trend"])

    return F.arrow_udf(runs, "rsv array<double>, k array<double>, d array<double>, ema array<double>, trend array<double>")


def _resumed(bars: DataFrame, state: DataFrame | None) -> DataFrame:
    """An instrument's bars as one array in date order, the recursive values beside it and its state before."""
    rows = bars.groupBy("ts_code").agg(F.array_sort(F.collect_list(F.struct("trade_date", *(c for c in bars.columns if c not in ("ts_code", "trade_date"))))).alias("_bars"))
    names = {c: f"_{c}0" for c in ("k", "d", "ema", "trend", "highs", "lows")}
    if state is None:
        types = {"highs": "array<double>", "lows": "array<double>"}
        rows = rows.withColumns({n: F.lit(None).cast(types.get(c, "double")) for c, n in names.items()})
    else:
        rows = rows.join(state.select("ts_code", *(F.col(c).alias(n) for c, n in names.items())), "ts_code", "left")
    line = lambda c: F.transform("_bars", lambda b: b[c].cast("double"))
    return rows.withColumn("_own", _recursion()(line("high"), line("low"), line("close"), *(F.col(n) for n in names.values())))


def recursive(bars: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Adds rsv, k, d, j and trend_short, the values that only a recursion over an instrument's bars gives.

    rsv is null where the nine-bar range is zero or not full; such bars are skipped, not reset, and have no k, d, j. Bars that follow others
    need none of them but their recursion_state(). Only highs, lows and closes go through the helper, an array an instrument; the other
    columns stay where they are, on the shuffle that the windows have already made.
    """
    known = _resumed(bars, state)
    values = F.arrays_zip("_own.rsv", "_own.k", "_own.d", "_own.trend")
    each = known.select("ts_code", F.explode(F.zip_with("_bars", values, lambda b, v: F.struct(b.alias("b"), v.alias("v")))).alias("_x"))
    kept = [F.col(f"_x.b.{c}").alias(c) if c != "ts_code" else F.col("ts_code") for c in bars.columns]
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    out = each.select(*kept, *(clean(f"_x.v.{c}").alias(n) for c, n in (("rsv", "rsv"), ("k", "k"), ("d", "d"), ("trend", "trend_short"))))
    return out.withColumn("j", 3 * F.col("k") - 2 * F.col("d")).select(*bars.columns, "rsv", "k", "d", "j", "trend_short")


def recursion_state(bars: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """STATE after these bars, for the next call of recursive(); of instruments without bars, the state as it was."""
    known = _resumed(bars, state)
    none = F.array().cast("array<double>")
    tail = lambda c, before_: F.slice(F.concat(F.coalesce(before_, none), F.transform("_bars", lambda b: b[c].cast("double"))), -F.least(F.lit(KDJ_PERIOD - 1), F.size("_bars") + F.size(F.coalesce(before_, none))), F.lit(KDJ_PERIOD - 1))
    last = lambda c: F.try_element_at(F.filter(F.concat(F.array(f"_{c}0"), F.transform(f"_own.{c}", lambda x: F.when(~F.isnan(x), x))), lambda x: x.isNotNull()), F.lit(-1))
    now = known.select("ts_code", F.element_at("_bars", -1)["trade_date"].alias("last_date"), *(last(c).alias(c) for c in ("k", "d", "ema", "trend")), tail("high", F.col("_highs0")).alias("highs"), tail("low", F.col("_lows0")).alias("lows"))
    return now if state is None else now.unionByName(state.join(now.select("ts_code"), "ts_code", "left_anti"))


def kdj(bars: DataFrame) -> DataFrame:
    return recursive(bars).where("k is not null").select("ts_code", "trade_date", "k", "d", "j")


def add_bull_bear(bars: DataFrame) -> DataFrame:
    """The mean of four moving averages; null until the slowest is there."""
    return _bull_bear(with_rolling_means(bars, {f"_m{n}": ("close", n) for n in TREND_MEANS}))


def _bull_bear(out: DataFrame) -> DataFrame:
    total = sum((F.col(f"_m{n}") for n in TREND_MEANS[1:]), F.col(f"_m{TREND_MEANS[0]}"))
    return out.withColumn("bull_bear", total / len(TREND_MEANS)).drop(*(f"_m{n}" for n in TREND_MEANS))


def wide(bars: DataFrame) -> DataFrame:
    """Bars with every value that the screens need: means, ratios, KDJ and trend lines."""
    out = with_rolling_means(bars, {"_v5": ("vol", 5), "ma20": ("close", 20), "ma60": ("close", 60), **{f"_m{n}": ("close", n) for n in TREND_MEANS}})
    out = out.withColumn("vol_ratio", F.try_divide("vol", "_v5")).drop("_v5")
    return recursive(_bull_bear(out))


def strength(bars: DataFrame) -> DataFrame:
    """Adds rsi5, pdi, mdi, adx and wr60."""
    out = bars.withColumn("_c1", before("close"))
    diff, hd, ld = F.col("close") - F.col("_c1"), F.col("high") - before("high"), before("low") - F.col("low")
    out = out.withColumns({
        "_diff": diff, "_hd": hd, "_ld": ld,
        # the first bar has no previous close: greatest() skips nulls
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_c1")), F.abs(F.col("low") - F.col("_c1"))),
    })
    up, down = F.col("_hd"), F.col("_ld")
    out = out.withColumns({
        "_gain": F.when(F.col("_diff").isNotNull(), F.greatest(F.col("_diff"), F.lit(0.0))), "_move": F.abs("_diff"),
        "_dmp": F.when(up.isNotNull(), F.when((up > 0) & (up > down), up).otherwise(0.0)), "_dmm": F.when(down.isNotNull(), F.when((down > 0) & (down > up), down).otherwise(0.0)),
    })
    out = out.withColumns({"_g5": rolling_sum("_gain", 5), "_m5": rolling_sum("_move", 5), "_t10": rolling_sum("_tr", 10), "_p10": rolling_sum("_dmp", 10), "_d10": rolling_sum("_dmm", 10), "_h60": rolling_max("high", 60), "_l60": rolling_min("low", 60)})
    ratio = lambda a, b: F.try_divide(F.col(a) * 100, F.col(b))
    out = out.withColumns({"rsi5": F.try_divide("_g5", "_m5") * 100, "pdi": ratio("_p10", "_t10"), "mdi": ratio("_d10", "_t10"), "wr60": F.try_divide(100 * (F.col("_h60") - F.col("close")), F.col("_h60") - F.col("_l60"))})
    out = out.withColumn("_dx", F.try_divide(F.abs(F.col("mdi") - F.col("pdi")), F.col("mdi") + F.col("pdi")) * 100)
    return out.withColumn("adx", rolling_mean("_dx", 5)).drop(*(c for c in out.columns if c.startswith("_")))


def golden_pit(bars: DataFrame) -> DataFrame:
    """ts_code, trade_date, var2z, var3z, signal. Instruments with fewer than 60 bars are left out; the up-cross of the
    oscillator is 0, not null, while it warms up, so var2z starts at bar 15."""
    out = strength(bars).withColumn("_osc", 2 * F.col("rsi5") + F.col("adx") - F.col("wr60"))
    fired = holds((F.col("_osc") > 0) & (before("_osc") <= 0))
    out = out.withColumns({"_fired": F.when(fired, 1.0).otherwise(0.0), "_bars": F.count("*").over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    out = out.withColumn("_v1", rolling_mean("_fired", 8))
    out = out.withColumn("var2z", rolling_mean("_v1", 8))
    out = out.withColumn("var3z", rolling_mean("var2z", 10))
    out = out.withColumn("signal", F.when(crosses_above("var2z", "var3z") & (F.col("var2z") < 40), 1).otherwise(0))
    return out.where((F.col("_bars") >= PIT_LEAST_BARS) & ~(F.col("var2z").isNull() & F.col("var3z").isNull())).select("ts_code", "trade_date", "var2z", "var3z", "signal")


def forward_returns(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Adds entry (the next open) and ret_{h}: from it to the close h bars on."""
    entry = after("open")
    return bars.withColumns({"entry": entry, **{f"ret_{h}": F.try_divide(after("close", h), entry) - 1 for h in horizons}})


def forward_bars(bars: DataFrame, opens: int = 10) -> DataFrame:
    """Adds open_t1.. and low_t1, in one pass over the window."""
    return bars.withColumns({**{f"open_t{i}": after("open", i) for i in range(1, opens + 1)}, "low_t1": after("low")})


def reversal_features(bars: DataFrame) -> DataFrame:
    """Adds the ex-right adjusted index (idx, idx_open), formation return, 20-bar return, mean amount and the market's
    median 20-bar return on the date, which is aggregated by date and joined back."""
    step = F.lit(1.0) + F.greatest(F.coalesce(F.col("pct_chg") / 100, F.lit(0.0)), F.lit(-0.95))
    out = bars.withColumn("_step", step).withColumn("idx", F.product("_step").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    out = out.withColumns({"idx_open": F.col("idx") * F.col("open") / F.col("close"), "amount20": rolling_mean("amount", 20), "formation": F.try_divide(before("idx", 5), before("idx", 65)) - 1, "ret20": F.try_divide(F.col("idx"), before("idx", 20)) - 1})
    return with_date_median(out, "ret20", "median20")


#: Thresholds of the breakout and trend screens.
BREAKOUT_BARS, BREAKOUT_VOLUME, LEAST_AMOUNT, VOLATILITY_FLOOR = 55, 1.5, 100_000, 0.005


def breakout_and_trend(features: DataFrame) -> DataFrame:
    """Adds breakout_signal, breakout_strength, trend_signal and trend_score to reversal_features()' rows.

    A signal fires on the first bar on which its condition holds."""
    out = features.withColumns({"_hi": F.col("idx") * F.col("high") / F.col("close"), "_pr": F.col("pct_chg") / 100, "ret120": F.try_divide(F.col("idx"), before("idx", 120)) - 1})
    out = with_rolling_means(out, {"_v20": ("vol", 20), **{f"tma{n}": ("idx", n) for n in (20, 60, 120)}})
    earlier = series().rowsBetween(-BREAKOUT_BARS, -1)
    out = out.withColumns({"high55": F.when(F.count("_hi").over(earlier) == BREAKOUT_BARS, F.max("_hi").over(earlier)), "vol_ratio20": F.try_divide("vol", "_v20"), "vol20": rolling_std("_pr", 20), "_prev": before("tma120", 20)})
    liquid = (F.col("amount20") >= LEAST_AMOUNT) & (F.col("median20") > 0)
    out = out.withColumns({
        "_brk": holds((F.col("idx") > F.col("high55")) & (F.col("vol_ratio20") >= BREAKOUT_VOLUME) & liquid),
        "_trd": holds((F.col("tma20") > F.col("tma60")) & (F.col("tma60") > F.col("tma120")) & (F.col("tma120") > F.col("_prev")) & (F.col("ret120") > 0) & liquid),
    })
    out = out.withColumns({
        "breakout_signal": F.col("_brk") & ~holds(before("_brk")), "breakout_strength": (F.try_divide("idx", "high55") - 1) * 100,
        "trend_signal": F.col("_trd") & ~holds(before("_trd")), "trend_score": F.try_divide(F.col("ret120"), F.when(F.col("vol20").isNotNull(), F.greatest(F.col("vol20"), F.lit(VOLATILITY_FLOOR)))),
    })
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def bar_change(bars: DataFrame) -> DataFrame:
    """Adds change_pct: the close against the previous close as it was given, or the bar before where that is missing or not positive."""
    base = F.coalesce(F.when(F.col("pre_close") > 0, F.col("pre_close")), before("close"))
    return bars.withColumn("change_pct", (F.try_divide(F.col("close"), base) - 1) * 100)


def last_bars(bars: DataFrame, n: int = 120) -> DataFrame:
    """One row an instrument with its last n bars, ascending, as an array of structs."""
    recent = bars.withColumn("_r", F.row_number().over(Window.partitionBy("ts_code").orderBy(F.desc("trade_date")))).where(F.col("_r") <= n)
    bar = F.struct("trade_date", "open", "high", "low", "close", "vol", "amount")
    return recent.groupBy("ts_code").agg(F.array_sort(F.collect_list(bar)).alias("kline"))


def marked_returns(bars: DataFrame, signals: DataFrame, window: int = 20) -> DataFrame:
    """For signals within an instrument's last bars: the latest close over the next open, less 1; null if there is none."""
    down = Window.partitionBy("ts_code").orderBy(F.desc("trade_date"))
    out = bars.withColumns({"next_open": after("open"), "latest_close": F.first("close").over(down), "_r": F.row_number().over(down)})
    marked = signals.select("ts_code", "trade_date").distinct()
    return out.where(F.col("_r") <= window).join(marked, ["ts_code", "trade_date"], "left_semi").select("ts_code", "trade_date", "next_open", "latest_close", (F.try_divide("latest_close", "next_open") - 1).alias("ret"))
