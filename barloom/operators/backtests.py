"""Back-tests, event studies, portfolio curves and walk-forward gates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import after, by_date
from .medians import medians, stored

COST = 0.002
TRAIN_DAYS, TEST_DAYS, CASES = 252, 21, 4


def stop_exit(hold: int = 4) -> tuple[Column, Column]:
    """Exit price and its offset in bars: the first open below the entry bar's low, else the open of the last bar.

    Needs forward_bars()' columns. A missing open triggers nothing."""
    price, offset = F.col(f"open_t{hold}"), F.lit(hold)
    for i in range(hold - 1, 1, -1):
        hit = F.coalesce(F.col(f"open_t{i}") < F.col("low_t1"), F.lit(False))
        price, offset = F.when(hit, F.col(f"open_t{i}")).otherwise(price), F.when(hit, F.lit(i)).otherwise(offset)
    return price, offset


def complete(hold: int = 4) -> Column:
    out = F.col("low_t1").isNotNull()
    for i in range(1, hold + 1):
        out = out & F.col(f"open_t{i}").isNotNull()
    return out


def with_stop_trades(rows: DataFrame, hold: int = 4) -> DataFrame:
    """Adds ret, holding_days and exit_kind of complete trades; null of others."""
    price, offset = stop_exit(hold)
    ok = complete(hold)
    kind = F.when(offset == hold, "forced").otherwise(F.concat(F.lit("stop_t"), offset.cast("string")))
    return rows.withColumns({"ret": F.when(ok, F.try_divide(price, F.col("open_t1")) - 1), "holding_days": F.when(ok, offset - 1), "exit_kind": F.when(ok, kind)})


def with_baseline(rows: DataFrame, signal: Column) -> DataFrame:
    """Signal rows (cohort signal) and every row on their dates (cohort baseline).

    Whether a date has a signal is a window over the rows of the date, so what the rows are made from is worked out once; give only the columns
    that are needed, as they are shuffled by date."""
    own = rows.withColumn("_signal", F.coalesce(signal, F.lit(False)))
    cohorts = F.when(F.col("_signal"), F.array(F.lit("signal"), F.lit("baseline"))).otherwise(F.array(F.lit("baseline")))
    return own.withColumn("_day", F.max("_signal").over(by_date())).where("_day").select(*rows.columns, F.explode(cohorts).alias("cohort"))


def cohort_stats(rows: DataFrame, returns: list[str], by: list[str], days: str | None = None) -> DataFrame:
    """Per cohort: rows, dates, and of each return mean, exact median and share of gains; the mean of days.

    The rows are written once, as medians read them again; all else is summed by date first, so that no task sees a whole cohort."""
    own = stored(rows.select(*by, "trade_date", *returns, *([days] if days else [])))
    numbers = [*returns, *([days] if days else [])]
    daily = own.groupBy(*by, "trade_date").agg(F.count("*").alias("n"), *(f for c in numbers for f in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))), *(F.count(F.when(F.col(c) > 0, 1)).alias(f"_w_{c}") for c in returns))
    mean = lambda c: F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"mean_{c}" if c != days else "mean_days")
    total = daily.groupBy(*by).agg(F.sum("n").alias("n"), F.count("trade_date").alias("n_dates"), *(mean(c) for c in numbers), *((F.sum(f"_w_{c}") / F.sum("n")).alias(f"win_{c}") for c in returns))
    middle = F.broadcast(medians(own, returns, by).toDF(*(f"_of_{c}" for c in by), *(f"median_{c}" for c in returns)))
    both = total.join(middle, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by)), "left")
    return both.select(*by, "n", "n_dates", *(f"{k}_{c}" for c in returns for k in ("mean", "median", "win")), *(["mean_days"] if days else []))


def exit_kinds(trades: DataFrame, by: list[str]) -> DataFrame:
    n = trades.groupBy(*by, "exit_kind").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def attribution(rows: DataFrame, masks: dict[str, Column], returns: list[str]) -> DataFrame:
    """Per condition: n, dates, mean returns and lifts over all rows on the condition's own dates.

    Rows are exploded by the conditions they meet and by one that all meet, and summed by condition and date in one pass; a date's baseline is
    then the sum of that one, so only conditions and dates meet."""
    every = "_every"
    met = rows.dropna(subset=returns).select("trade_date", *returns, F.explode(F.array_compact(F.array(F.lit(every), *(F.when(m, F.lit(k)) for k, m in masks.items())))).alias("condition"))
    own = met.groupBy("condition", "trade_date").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"_o_{c}") for c in returns))
    of_all = lambda c: F.max(F.when(F.col("condition") == every, F.col(c))).over(by_date())
    own = own.withColumns({"_n": of_all("n"), **{f"_s_{c}": of_all(f"_o_{c}") for c in returns}}).where(F.col("condition") != every).groupBy("condition")
    mean = {c: F.sum(f"_o_{c}") / F.sum("n") for c in returns}
    return own.agg(F.sum("n").alias("n"), F.count("*").alias("n_dates"), *(mean[c].alias(f"mean_{c}") for c in returns), *((mean[c] - F.sum(f"_s_{c}") / F.sum("_n")).alias(f"lift_{c}") for c in returns))


def sweep(rows: DataFrame, configs: dict[str, tuple[Column, int]]) -> DataFrame:
    """Per configuration (a mask and a holding limit): signals and baseline, complete trades only; mean_days is over all
    signals. One pass: each row carries the results of all configurations as an array."""
    items = []
    for name, (mask, hold) in configs.items():
        price, offset = stop_exit(hold)
        items.append(F.struct(F.lit(name).alias("config"), mask.alias("hit"), F.when(complete(hold), F.try_divide(price, F.col("open_t1")) - 1).alias("ret"), (offset - 1).alias("days")))
    each = rows.select("trade_date", F.explode(F.array(*items)).alias("x")).select("trade_date", "x.*")
    won = lambda c: F.sum(F.when(c & (F.col("ret") > 0), 1).otherwise(0))
    ok, hit = F.col("ret").isNotNull(), F.col("hit")
    by_date = each.groupBy("config", "trade_date").agg(
        F.sum(F.when(hit & ok, 1).otherwise(0)).alias("n_sig"), F.sum(F.when(hit & ok, F.col("ret"))).alias("s_sig"), won(hit & ok).alias("w_sig"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("n_base"), F.sum("ret").alias("s_base"), won(ok).alias("w_base"),
        F.sum(F.when(hit, F.col("days"))).alias("d_sig"), F.sum(F.when(hit, 1).otherwise(0)).alias("n_all"),
    )
    base = lambda c: F.sum(F.when(F.col("n_sig") > 0, F.col(c)))  # noqa: E731  dates with a complete signal
    total = by_date.groupBy("config").agg(
        F.sum("n_sig").alias("n_sig"), base("n_base").alias("n_base"), F.try_divide(F.sum("s_sig"), F.sum("n_sig")).alias("sig_mean"), F.try_divide(F.sum("w_sig"), F.sum("n_sig")).alias("sig_win"),
        F.try_divide(base("s_base"), base("n_base")).alias("base_mean"), F.try_divide(base("w_base"), base("n_base")).alias("base_win"), F.try_divide(F.sum("d_sig"), F.sum("n_all")).alias("mean_days"),
    )
    return total.withColumn("lift", F.col("sig_mean") - F.col("base_mean"))


def cohort_periods(rows: DataFrame, split: str) -> DataFrame:
    """Of each strategy, before a day (development) and from it on (holdout): signals, mean return after cost, win rate, and
    one cohort a signal date, their mean returns after cost chained: cohort_count, log_nav, max_drawdown."""
    period = F.when(F.col("trade_date") < F.lit(split).cast("date"), "development").otherwise("holdout")
    done = rows.where("is_signal AND ret IS NOT NULL").withColumn("period", period)
    cohort = done.groupBy("strategy", "period", "trade_date").agg((F.avg("ret") - COST).alias("leg"), F.count("*").alias("k"), F.sum("ret").alias("s"), F.sum(F.when(F.col("ret") > 0, 1).otherwise(0)).alias("w"))
    legs = cohort.withColumns({"strategy": F.struct("strategy", "period")})
    chained = curve(legs.select("strategy", "trade_date", "leg")).groupBy("strategy").agg(F.ln(F.max_by("nav", "trade_date")).alias("log_nav"), F.min("drawdown").alias("max_drawdown"))
    total = cohort.groupBy("strategy", "period").agg(F.sum("k").alias("signal_count"), (F.sum("s") / F.sum("k") - COST).alias("net_mean"), (F.sum("w") / F.sum("k")).alias("win_rate"), F.count("*").alias("cohort_count"))
    return total.join(chained.select("strategy.*", "log_nav", "max_drawdown"), ["strategy", "period"])


# --- curves -------------------------------------------------------------------------------------------------------------


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with their number within the instrument and the previous close."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    return bars.withColumns({"bar_no": F.row_number().over(w), "_prev": F.lag("close").over(w), "_bars": F.count("*").over(Window.partitionBy("ts_code"))})


def holding_legs(bars: DataFrame, signals: DataFrame, hold: int, open_exit: bool = False, only_complete: bool = False) -> DataFrame:
    """Daily legs (strategy, trade_date, leg) of trades that enter at the next open and leave at the hold-th close, or at
    the open after it. Only signals are exploded to offsets and joined to bars; the cost is on the first leg."""
    own = numbered(bars)
    s = signals.join(own.select("ts_code", "trade_date", "bar_no", "_bars"), ["ts_code", "trade_date"])
    last = hold + 1 if open_exit else hold
    if only_complete:
        s = s.where(F.col("bar_no") + last <= F.col("_bars"))
    s = s.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(last)))).select("strategy", "ts_code", "offset", (F.col("bar_no") + F.col("offset")).alias("bar_no"))
    j = s.join(own.select("ts_code", "bar_no", "trade_date", "open", "close", "_prev"), ["ts_code", "bar_no"])
    leg = F.when(F.col("offset") == 1, F.try_divide("close", "open") - 1 - COST).when(F.col("offset") <= hold, F.try_divide("close", "_prev") - 1).otherwise(F.try_divide("open", "_prev") - 1)
    return j.select("strategy", "trade_date", leg.alias("leg"))


def stopped_legs(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Daily legs of trades under the four-bar stop rule."""
    b = bars.withColumns({**{f"open_t{i}": after("open", i) for i in range(1, 5)}, **{f"close_t{i}": after("close", i) for i in range(1, 4)}, **{f"date_t{i}": after("trade_date", i) for i in range(1, 5)}, "low_t1": after("low")})
    b = b.join(signals, ["ts_code", "trade_date"])
    c, stop = F.col, lambda i: F.coalesce(F.col(f"open_t{i}") < F.col("low_t1"), F.lit(False))
    s2, s3 = stop(2), stop(3)
    leg = lambda i, value, active: F.when(active, F.struct(c(f"date_t{i}").alias("trade_date"), value.alias("leg")))
    legs = F.array(
        leg(1, F.try_divide(c("close_t1"), c("open_t1")) - 1 - COST, F.lit(True)),
        leg(2, F.try_divide(F.when(s2, c("open_t2")).otherwise(c("close_t2")), c("close_t1")) - 1, F.lit(True)),
        leg(3, F.try_divide(F.when(s3, c("open_t3")).otherwise(c("close_t3")), c("close_t2")) - 1, ~s2),
        leg(4, F.try_divide(c("open_t4"), c("close_t3")) - 1, ~s2 & ~s3),
    )
    return b.select("strategy", F.explode(F.array_compact(legs)).alias("x")).select("strategy", "x.trade_date", "x.leg")


def curve(legs: DataFrame) -> DataFrame:
    """strategy, trade_date, daily_return, nav, drawdown: equal weight, floored at -95 %; starting cash counts as a peak."""
    ok = F.col("leg").isNotNull() & ~F.isnan("leg") & (F.abs("leg") != float("inf")) & F.col("trade_date").isNotNull()
    daily = legs.where(ok).groupBy("strategy", "trade_date").agg((F.sum("leg") / F.count("*")).alias("r"))
    w = Window.partitionBy("strategy").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("daily_return", F.greatest("r", F.lit(-0.95))).withColumn("_g", 1 + F.col("daily_return")).withColumn("nav", F.product("_g").over(w))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1).select("strategy", "trade_date", "daily_return", "nav", "drawdown")


def cash_curve(calendar: DataFrame) -> DataFrame:
    return calendar.select("trade_date", F.lit(0.0).alias("daily_return"), F.lit(1.0).alias("nav"), F.lit(0.0).alias("drawdown"))


# --- walk-forward -------------------------------------------------------------------------------------------------------


def walk_forward_windows(calendar: DataFrame, train: int = TRAIN_DAYS, test: int = TEST_DAYS) -> DataFrame:
    """train_start, train_end, test_start, test_end as trade indices; the last test window may be short."""
    n = calendar.agg((F.max("trade_index") + 1).alias("n"))
    starts = n.where(F.col("n") > train).select("n", F.explode(F.sequence(F.lit(train).cast("long"), F.col("n") - 1, F.lit(test).cast("long"))).alias("test_start"))
    return starts.select((F.col("test_start") - train).alias("train_start"), (F.col("test_start") - 1).alias("train_end"), "test_start", F.least(F.col("test_start") + test, F.col("n")).alias("test_end_")).withColumn("test_end", F.col("test_end_") - 1).drop("test_end_")


def walk_forward(rows: DataFrame, windows: DataFrame, gates: DataFrame) -> DataFrame:
    """Each strategy's gate in each window. rows: strategy, trade_index, exit_index, is_signal, ret.

    A training trade counts only if it left strictly before the test window. All rows are pre-aggregated to pairs of entry
    and exit index before the range join with the few windows, so the join sees index pairs and no bars.
    """
    pairs = rows.groupBy("strategy", "trade_index", "exit_index").agg(
        F.count("ret").alias("n_all"), F.sum("ret").alias("s_all"), F.sum(F.when(F.col("is_signal"), 1).otherwise(0)).alias("n_hits"),
        F.sum(F.when(F.col("is_signal") & F.col("ret").isNotNull(), 1).otherwise(0)).alias("n"), F.sum(F.when(F.col("is_signal"), F.col("ret"))).alias("s"), F.sum(F.when(F.col("is_signal") & (F.col("ret") > 0), 1).otherwise(0)).alias("w"),
    )
    wins = F.broadcast(windows)
    training = pairs.join(wins, pairs["trade_index"].between(F.col("train_start"), F.col("train_end")) & (pairs["exit_index"] < F.col("test_start")))
    by_date = training.groupBy("strategy", "test_start", "trade_index").agg(*(F.sum(c).alias(c) for c in ("n_all", "s_all", "n", "s", "w")))
    hit = F.col("n") > 0
    gate = by_date.groupBy("strategy", "test_start").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("w").alias("w"), F.sum(F.when(hit, F.col("n_all"))).alias("bn"), F.sum(F.when(hit, F.col("s_all"))).alias("bs"))
    tests = pairs.join(wins, pairs["trade_index"].between(F.col("test_start"), F.col("test_end"))).groupBy("strategy", "test_start").agg(F.sum("n_hits").alias("test_signals"))
    frame = F.broadcast(gates).crossJoin(wins)  # both a few rows
    out = frame.join(gate, ["strategy", "test_start"], "left").join(tests, ["strategy", "test_start"], "left")
    n = F.coalesce("n", F.lit(0))
    out = out.withColumns({"training_signals": n, "net_mean": F.try_divide("s", "n") - COST, "excess": F.try_divide("s", "n") - F.try_divide("bs", "bn"), "win_rate": F.try_divide("w", "n"), "test_signals": F.coalesce("test_signals", F.lit(0))})
    ok = (F.col("training_signals") >= F.col("min_signals")) & (F.col("net_mean") >= F.col("min_net_mean")) & (F.col("excess") >= F.col("min_excess")) & (F.col("win_rate") >= F.col("min_win_rate"))
    return out.withColumn("approved", F.coalesce(ok, F.lit(False))).select("strategy", "train_start", "train_end", "test_start", "test_end", "training_signals", "net_mean", "excess", "win_rate", "approved", "test_signals")


def out_of_sample(rows: DataFrame, gates: DataFrame) -> DataFrame:
    """Signals within the test windows that their strategy's gate approved."""
    ok = F.broadcast(gates.where("approved").select("strategy", "test_start", "test_end"))
    return rows.where("is_signal").join(ok, (rows["strategy"] == ok["strategy"]) & rows["trade_index"].between(ok["test_start"], ok["test_end"]), "left_semi")


#: Least signals, net mean, excess and win rate of each strategy's gate.
GATES = [
    ("ma20_ma60", 1000, 0.0, 0.0, 0.50),
    ("b2", 50000, 0.0015, 0.001, 0.48),
    ("b1", 5000, 0.001, 0.001, 0.48),
    ("r1", 60, 0.0, 0.0, 0.45),
    ("breakout", 200, 0.0, 0.0, 0.48),
    ("trend", 200, 0.0, 0.0, 0.48),
    ("value_quality", 40, 0.0, 0.0, 0.50),
]


def gates(spark, scale: float = 1.0) -> DataFrame:
    """The gates, with the least number of signals scaled to the size of the universe."""
    return spark.createDataFrame([(s, max(1, int(n * scale)), m, e, w) for s, n, m, e, w in GATES], "strategy string, min_signals long, min_net_mean double, min_excess double, min_win_rate double")


#: What the reversal strategy's hold-out must show before it may trade.
HOLDOUT_COHORTS, HOLDOUT_NAV, HOLDOUT_DRAWDOWN = 3, 1.0, -0.15


def decisions(gates: DataFrame, periods: DataFrame, regime: DataFrame) -> DataFrame:
    """strategy, latest_approved, reason, status, action, same_status: may each strategy trade after its latest gate?

    b2 is observed only and value_quality needs a review by people, whatever their gates. r1 also needs a hold-out that is
    long and good enough, then its gate, then an open market (one row, open_regime); the first that is missing is the reason.
    same_status counts the strategies of equal status."""
    c, reversal, value = F.col, F.col("strategy") == "r1", F.col("strategy") == "value_quality"
    latest = gates.groupBy("strategy").agg(F.max_by("approved", "test_start").alias("latest_approved"))
    holdout = periods.where("period = 'holdout'").select("strategy", "cohort_count", "log_nav", "max_drawdown")
    s = latest.join(holdout, "strategy", "left").join(F.broadcast(regime))
    enough = F.coalesce(c("cohort_count"), F.lit(0)) >= HOLDOUT_COHORTS
    good = F.coalesce((c("log_nav") > math.log(HOLDOUT_NAV)) & (c("max_drawdown") >= HOLDOUT_DRAWDOWN), F.lit(False))
    reason = (
        F.when(c("strategy") == "b2", "observed only")
        .when(value, F.when(c("latest_approved"), "needs review").otherwise("being validated"))
        .when(reversal & ~enough, "hold-out too short")
        .when(reversal & ~good, "hold-out failed")
        .when(~c("latest_approved"), "gate failed")
        .when(reversal & ~c("open_regime"), "market closed")
        .otherwise("gate passed")
    )
    s = s.withColumn("reason", reason).withColumn("status", F.when(c("reason") == "gate passed", "active").otherwise("watch"))
    action = F.when(value, "research").when(c("status") == "active", "buy").otherwise("observe")
    return s.select("strategy", "latest_approved", "reason", "status", action.alias("action"), F.count("*").over(Window.partitionBy("status")).alias("same_status"))
