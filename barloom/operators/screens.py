"""Rule-based screens over wide bar frames, and the lists that rank their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import NO_INDUSTRY, is_risky
from ..functions.exprs import holds, rank_share

#: Thresholds of the screens.
J_BELOW, HISTORY_DAYS = 15, 90
R1_LEAST_CLOSE, R1_LEAST_AMOUNT, R1_LOSERS, TOP = 2.0, 100_000, 0.10, 20
RECOMMENDED = 8


def b1_conditions() -> dict[str, Column]:
    """Each condition by name; null where an input is missing."""
    c = F.col
    return {"c1": c("vol_ratio") < 1, "c2": c("j") < J_BELOW, "c3": c("close") > c("ma60"), "c4": c("trend_short") > c("bull_bear"), "c5": c("close") > c("bull_bear")}


def is_b1() -> Column:
    out = F.lit(True)
    for x in b1_conditions().values():
        out = out & holds(x)
    return out


def is_b2() -> Column:
    return holds((F.col("trend_short") < F.col("bull_bear")) & (F.col("bull_bear") > 0))


def gap_pct() -> Column:
    """How far the short line lies below the long one, in percent of the long one."""
    return (F.col("bull_bear") - F.col("trend_short")) / F.col("bull_bear") * 100


def b1_hits(rows: DataFrame, instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """All dates' hits with name, industry, the last earlier hit within 90 days and trading days since it, and the order
    within the date: industries with most hits first, then those with the lower mean J, then by J."""
    own = rows.where(is_b1()).join(F.broadcast(calendar), "trade_date")
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    near = F.datediff("trade_date", F.lag("trade_date").over(w)) <= HISTORY_DAYS
    own = own.withColumns({"last_signal": F.when(near, F.lag("trade_date").over(w)), "days_since": F.when(near, F.col("trade_index") - F.lag("trade_index").over(w))})
    own = own.join(instruments.select("ts_code", "name", "industry"), "ts_code", "left").withColumn("industry", F.coalesce("industry", F.lit("(unknown)")))
    group = Window.partitionBy("trade_date", "industry")
    own = own.withColumns({"_n": F.count("*").over(group), "_j": F.avg("j").over(group)})
    order = Window.partitionBy("trade_date").orderBy(F.desc("_n"), "_j", "industry", "j", "ts_code")
    return own.withColumn("position", F.row_number().over(order)).drop("_n", "_j")


def condition_counts(rows: DataFrame) -> DataFrame:
    """By date: rows with all inputs, and how many pass each condition and all."""
    known = rows.dropna(subset=["vol_ratio", "j", "ma60", "trend_short", "bull_bear"])
    passes = {k: F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in b1_conditions().items()}
    return known.groupBy("trade_date").agg(F.count("*").alias("universe"), *passes.values(), F.sum(F.when(is_b1(), 1).otherwise(0)).alias("b1"))


def industry_distribution(hits: DataFrame, top: int = 10) -> DataFrame:
    """Hits by industry, the top ones and the rest as one: (industry, kinds, n)."""
    n = hits.groupBy("industry").agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "industry")))
    group = F.when(F.col("_r") <= top, F.col("industry")).otherwise("(others)")
    return n.groupBy(group.alias("industry")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))


def month_ends(rows: DataFrame) -> DataFrame:
    """The last trading date of each completed month; the latest month isn't complete."""
    m = rows.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.max("trade_date").alias("trade_date"))
    latest = m.agg(F.max("month").alias("_latest"))
    return m.join(F.broadcast(latest)).where("month < _latest").select("trade_date")


def reversal_candidates(features: DataFrame) -> DataFrame:
    """Losers of the formation period at month ends, with the regime flag. Eligible rows are cut out before the ranking
    by date, so the few, large date partitions hold no more than they must."""
    eligible = features.where((F.col("close") >= R1_LEAST_CLOSE) & (F.col("amount20") >= R1_LEAST_AMOUNT) & F.col("formation").isNotNull())
    at_ends = eligible.join(F.broadcast(month_ends(features)), "trade_date", "left_semi").withColumn("share", rank_share("formation", ["trade_date"]))
    return at_ends.where(F.col("share") <= R1_LOSERS).withColumn("open_regime", holds(F.col("median20") > 0))


def regime(features: DataFrame) -> DataFrame:
    """One row, open_regime: whether the market's median was up at the last completed month's end; false without candidates."""
    last = month_ends(features).agg(F.max("trade_date").alias("trade_date"))
    own = last.join(reversal_candidates(features).select("trade_date", "open_regime"), "trade_date", "left")
    return own.agg(F.coalesce(F.max("open_regime"), F.lit(False)).alias("open_regime"))


def top_by_date(rows: DataFrame, *order: Column | str, n: int = TOP) -> DataFrame:
    """Adds position and keeps the first n of each date; ties by ts_code."""
    w = Window.partitionBy("trade_date").orderBy(*order, "ts_code")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def annotate_pit(hits: DataFrame, pit: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds the pit's value and flag on the date, and, of the 90 days before, the last date it fired and trading days since."""
    dated = pit.join(F.broadcast(calendar), "trade_date")
    w = Window.partitionBy("ts_code").orderBy(F.datediff("trade_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-HISTORY_DAYS, -1)
    last = F.max(F.when(F.col("signal") == 1, F.struct("trade_date", "trade_index"))).over(w)
    dated = dated.withColumn("_last", last).select("ts_code", "trade_date", F.col("signal").alias("gp_signal"), F.col("var2z").alias("gp_var2z"), F.col("_last.trade_date").alias("gp_last_signal"), (F.col("trade_index") - F.col("_last.trade_index")).alias("gp_days_since"))
    return hits.join(dated, ["ts_code", "trade_date"], "left")


def recommend(rows: DataFrame, score: Column, reasons: list[Column], instruments: DataFrame, sectors: DataFrame | None = None, n: int = RECOMMENDED) -> DataFrame:
    """The best n of each date by score, amount and code, without risky names, with their reasons as one text."""
    out = rows.join(instruments.select("ts_code", "name", "industry"), "ts_code", "left").where(~is_risky(F.col("name")))
    if sectors is not None:
        out = out.join(sectors.select("trade_date", "industry", F.col("score").alias("_s"), F.col("rank").alias("_k")), ["trade_date", "industry"], "left")
        out = out.withColumns({"sector_score": F.coalesce("_s", F.lit(0.0)), "sector_rank": F.coalesce("_k", F.lit(999))}).drop("_s", "_k")
    out = out.withColumns({"score": score, "reasons": F.array_join(F.array_compact(F.array(*reasons)), "; ")})
    return top_by_date(out, F.desc("score"), F.desc("amount"), n=n)


#: Limits of the recommendations, and the sector ranks that add to a score.
CROSS_AMOUNT, CROSS_CHANGE, CROSS_EXTENSION = 50_000, (-5, 8), (0, 12)
GAP_LIMITS, GAP_CHANGE, LEAST_LIQUIDITY, LEADING = (3, 12), (0, 5), 1.0, 10


def _score(x: Column) -> Column:
    """To six digits, so that the last bits of a sum decide no order."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def _leading() -> Column:
    return F.when(F.col("sector_rank") <= LEADING, 1.0).otherwise(0.0)


def _sector_reason() -> Column:
    return F.when(F.col("sector_rank") <= LEADING, F.concat(F.lit("sector rank "), F.col("sector_rank").cast("string")))


def recommend_cross(rows: DataFrame, instruments: DataFrame, sectors: DataFrame, least_amount: float = CROSS_AMOUNT, change: tuple = CROSS_CHANGE, extension: tuple = CROSS_EXTENSION) -> DataFrame:
    """Of rows with ``golden``, those liquid, not too far up and not too far over the long average."""
    ext, liquidity = (F.col("close") / F.col("ma60") - 1) * 100, F.col("amount") / 100_000
    own = rows.where(F.col("golden") & (F.col("amount") >= least_amount) & F.col("pct_chg").between(*change) & ext.between(*extension))
    score = 50 * F.col("sector_score") + 18 * _leading() + 1.5 * F.least(liquidity, F.lit(12.0)) - 1.2 * F.abs(ext - 3) - 2 * F.greatest(F.col("pct_chg") - 5, F.lit(0.0))
    return recommend(own, _score(score), [F.lit("moving averages crossed"), _sector_reason()], instruments, sectors)


def recommend_b1(rows: DataFrame, instruments: DataFrame, sectors: DataFrame, least_liquidity: float = LEAST_LIQUIDITY) -> DataFrame:
    """Of the B1 screen's hits, those liquid whose volume is below its mean but not nil."""
    liquidity, ratio = F.col("amount") / 100_000, F.col("vol_ratio")
    own = rows.where(is_b1() & (ratio > 0) & (ratio < 1) & (liquidity >= least_liquidity) & (F.col("j") < J_BELOW))
    score = F.greatest(J_BELOW - F.col("j"), F.lit(0.0)) + 10 * F.greatest(1 - ratio, F.lit(0.0)) + 0.5 * F.least(liquidity, F.lit(10.0)) + 5 * _leading()
    return recommend(own, _score(score), [F.lit("oversold"), F.lit("volume below its mean"), F.lit("close above the long lines"), _sector_reason()], instruments, sectors)


def recommend_b2(rows: DataFrame, instruments: DataFrame, sectors: DataFrame, gap: tuple = GAP_LIMITS, least_liquidity: float = LEAST_LIQUIDITY, change: tuple = GAP_CHANGE) -> DataFrame:
    """Of the B2 screen's hits, those with a moderate gap that are liquid and have begun to rise."""
    liquidity = F.col("amount") / 100_000
    own = rows.where(is_b2()).withColumn("gap_pct", gap_pct())
    own = own.where(F.col("gap_pct").between(*gap) & (liquidity >= least_liquidity) & F.col("pct_chg").between(*change))
    score = 18 - F.abs(F.col("gap_pct") - 6) + F.least(liquidity, F.lit(10.0)) + 5 * _leading()
    return recommend(own, _score(score), [F.lit("short line below the long one"), F.lit("rising today"), _sector_reason()], instruments, sectors)


def tenths(x: Column) -> Column:
    """A number with one decimal, as text."""
    return (F.floor(x * 10 + 0.5) / 10).cast("decimal(18,1)").cast("string")


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _listed(own: DataFrame, strategy: str, score: Column, digits: int, reasons: list[Column], instruments: DataFrame, *order: Column) -> DataFrame:
    """The best of each date without risky names: strategy, code, date, name, close, amount in units, score, position and reasons."""
    named = own.drop("name", "industry", "position").join(instruments.select("ts_code", "name", "industry"), "ts_code", "left").where(~is_risky(F.col("name")))
    best = top_by_date(named, *order, F.desc("amount20"), n=RECOMMENDED)
    unit = F.floor(F.col("amount20") / 100_000 * 10 + 0.5) / 10
    return best.select(
        F.lit(strategy).alias("strategy"), "ts_code", "trade_date", F.coalesce("name", "ts_code").alias("name"), F.coalesce("industry", F.lit(NO_INDUSTRY)).alias("industry"), "close",
        unit.alias("amount_unit"), (F.floor(score * 10.0**digits + 0.5) / 10.0**digits).alias("score"), "position", F.array_join(F.array(*reasons), "; ").alias("reasons"),
    )


def _turnover() -> Column:
    return _said("mean amount of 20 bars ", tenths(F.col("amount20") / 100_000))


def recommend_breakouts(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Of rows with breakout_signal, by how far they broke out."""
    strength, ratio = F.col("breakout_strength"), F.col("vol_ratio20")
    why = [_said("above the high of 55 bars by ", tenths(strength), "%"), _said("volume ", tenths(ratio), " times its mean"), _turnover()]
    return _listed(rows.where("breakout_signal"), "breakout", strength * 10 + ratio, 2, why, instruments, F.desc("breakout_strength"))


def recommend_trends(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Of rows with trend_signal, by score."""
    why = [F.lit("means of 20, 60 and 120 in order"), F.lit("the slowest rising for 20 bars"), _said("return of 120 bars ", tenths(F.col("ret120") * 100), "%"), _turnover()]
    return _listed(rows.where("trend_signal"), "trend", F.col("trend_score"), 2, why, instruments, F.desc("trend_score"))


def observe_reversals(features: DataFrame, instruments: DataFrame) -> DataFrame:
    """The month ends' reversal pool, whatever the regime. The pool is cut to its size first; risky names leave gaps in it."""
    pool = top_by_date(reversal_candidates(features), F.desc("amount20"))
    why = [_said("formation return ", tenths(F.col("formation") * 100), "%"), F.lit("the latest week left out"), _turnover(), _said("market median of 20 bars ", tenths(F.col("median20") * 100), "%")]
    return _listed(pool, "r1", F.col("amount20") / 100_000, 1, why, instruments)


def recommend_values(selected: DataFrame, instruments: DataFrame) -> DataFrame:
    """Of the value-quality screen's selected rows, by score; a list to look into."""
    c = F.col
    pair = lambda a, b: (tenths(c(a)), " and ", tenths(c(b)))
    why = [
        _said("return on equity, median and least of the reports ", *pair("roe_median", "roe_min")), _said("margin ", tenths(c("margin_median"))),
        _said("growth of revenue and profit ", *pair("revenue_yoy_median", "profit_yoy_median")), _said("price to earnings and book ", *pair("pe", "pb")), F.lit("cash flow positive in the reports"),
    ]
    return _listed(selected, "value_quality", c("score"), 1, why, instruments, F.desc("score"))
