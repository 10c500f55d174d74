"""Annual reports as known at a date, and the value-quality screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import is_risky
from ..functions.exprs import rank_share
from .screens import month_ends, top_by_date

#: Eligibility and weights.
LIMITS = {"roe": 15.0, "least_roe": 10.0, "margin": 20.0, "debt": 60.0, "pe": (5.0, 30.0), "pb": (0.0, 6.0), "amount": 100_000, "reports": 3, "growth": 0.0}
QUALITY_WEIGHT, VALUE_WEIGHT, QUARTER_MONTHS = 0.65, 0.35, (1, 4, 7, 10)


def merge_reports(performance: DataFrame, balance: DataFrame) -> DataFrame:
    """One row an instrument and year: performance with the balance sheet's columns; known from the later announcement.

    The first row by announcement of repeated ones stays; rows with neither announcement are dropped."""
    key = ["ts_code", "report_date"]
    first = Window.partitionBy(*key).orderBy(F.asc_nulls_last("announcement_date"))
    one = lambda df: df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    b = one(balance).withColumnRenamed("announcement_date", "_balance_date")
    out = one(performance).join(b, key, "left").withColumn("announcement_date", F.greatest("announcement_date", "_balance_date")).drop("_balance_date")
    return out.where("announcement_date IS NOT NULL")


def stale_years(fetched: DataFrame, now, days: int = 7) -> DataFrame:
    """Report years whose last fetch is older than ``days`` at ``now``."""
    return fetched.groupBy("report_date").agg(F.max("fetched_at").alias("fetched_at")).where(F.datediff(F.lit(now), "fetched_at") >= days).select("report_date")


def snapshot_dates(bars: DataFrame) -> DataFrame:
    """The last trading date of each completed January, April, July and October."""
    return month_ends(bars).where(F.month("trade_date").isin(*QUARTER_MONTHS))


def as_of_three(prices: DataFrame, reports: DataFrame) -> DataFrame:
    """Each price row with its instrument's latest known report and aggregates of the last three.

    Known: announced by the date, and of a period that ended before it. An equi-join on the instrument with a range
    condition; an instrument has few reports, so rows stay in proportion."""
    r = reports.withColumnRenamed("ts_code", "_code")
    j = prices.join(r, (F.col("ts_code") == F.col("_code")) & (F.col("announcement_date") <= F.col("trade_date")) & (F.col("report_date") < F.col("trade_date"))).drop("_code")
    w = Window.partitionBy("ts_code", "trade_date").orderBy(F.desc("report_date"), F.desc("announcement_date"))
    j = j.withColumn("_r", F.row_number().over(w)).where("_r <= 3")
    latest = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c))).alias(c)
    return j.groupBy("ts_code", "trade_date", *(c for c in prices.columns if c not in ("ts_code", "trade_date"))).agg(
        latest("report_date"), latest("eps"), latest("book_value_per_share"), latest("ocf_per_share"), F.count("*").alias("report_count"),
        F.median("roe").alias("roe_median"), F.min("roe").alias("roe_min"), F.median("gross_margin").alias("margin_median"), F.median("revenue_yoy").alias("revenue_yoy_median"),
        F.median("net_profit_yoy").alias("profit_yoy_median"), F.sum(F.when(F.col("ocf_per_share") > 0, 1).otherwise(0)).alias("cash_years"), F.max("debt_to_assets").alias("debt_max"),
    ).withColumns({"pe": F.try_divide("close", "eps"), "pb": F.try_divide("close", "book_value_per_share")})


def score(snapshots: DataFrame, limits: dict | None = None) -> DataFrame:
    """Eligible snapshots with quality, value and joint score; snapshots need a name."""
    m, c = LIMITS | (limits or {}), F.col
    ok = ~is_risky(c("name")) & (c("report_count") >= m["reports"]) & c("pe").between(*m["pe"]) & c("pb").between(*m["pb"]) & (c("amount20") >= m["amount"]) & (c("roe_median") >= m["roe"]) & (c("roe_min") >= m["least_roe"])
    ok = ok & (c("margin_median") >= m["margin"]) & (c("debt_max") <= m["debt"]) & (c("revenue_yoy_median") >= m["growth"]) & (c("profit_yoy_median") >= m["growth"]) & (c("cash_years") >= m.get("cash_years", 3))
    e = snapshots.where(ok).withColumn("earnings_yield", 1 / c("pe"))
    by = ["trade_date"]
    ranks = {"_q1": ("roe_median", True), "_q2": ("margin_median", True), "_q3": ("profit_yoy_median", True), "_q4": ("ocf_per_share", True), "_q5": ("debt_max", False), "_v1": ("earnings_yield", True), "_v2": ("pb", False)}
    e = e.withColumns({k: rank_share(col, by, up) for k, (col, up) in ranks.items()})

    def mean(names):
        known = sum((F.when(c(n).isNotNull(), 1).otherwise(0) for n in names[1:]), F.when(c(names[0]).isNotNull(), 1).otherwise(0))
        return F.try_divide(sum((F.coalesce(c(n), F.lit(0.0)) for n in names[1:]), F.coalesce(c(names[0]), F.lit(0.0))), known)

    e = e.withColumns({"quality": mean([f"_q{i}" for i in range(1, 6)]), "value": mean(["_v1", "_v2"])})
    joint = (c("quality") * QUALITY_WEIGHT + c("value") * VALUE_WEIGHT) * 100
    return e.withColumn("score", F.floor(joint * 1e6 + 0.5) / 1e6).drop(*ranks)


def value_quality(snapshots: DataFrame, limits: dict | None = None, n: int = 20) -> DataFrame:
    return top_by_date(score(snapshots, limits), F.desc("score"), F.desc("amount20"), n=n)
