"""Column expressions that the operators share.

Missing is NULL, never NaN. A rolling value is null until its window holds as many non-null values as rows. Windows run
over an instrument's own rows in date order, so all of them need one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    """An instrument's rows in date order. A function, as windows need a session and workers import this module."""
    return Window.partitionBy("ts_code").orderBy("trade_date")


def by_date() -> WindowSpec:
    return Window.partitionBy("trade_date")


def last_rows(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def rolling(fn: Callable[[Column], Column], column: str, n: int) -> Column:
    w = last_rows(n)
    return F.when(F.count(column).over(w) == n, fn(F.col(column)).over(w))


def rolling_mean(column: str, n: int) -> Column:
    return rolling(F.avg, column, n)


def rolling_sum(column: str, n: int) -> Column:
    return rolling(F.sum, column, n)


def rolling_max(column: str, n: int) -> Column:
    return rolling(F.max, column, n)


def rolling_min(column: str, n: int) -> Column:
    return rolling(F.min, column, n)


def with_rolling_means(rows: DataFrame, means: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds means over n rows by name: {name: (column, n)}; null until n non-null values are there, as rolling_mean().

    A window frame of n rows costs n steps a row. Sums of 4, 16, 64 ... rows are made from those before by three lags each, and a sum of n
    from a few of them side by side, so a row costs a few lags whatever n. Nothing is subtracted, so no digits are lost."""
    part = lambda c, k: F.col(c) if k == 1 else F.col(f"_sum{k}_{c}")
    back = lambda column, n: column if n == 0 else F.lag(column, n).over(series())
    out, k, made = rows, 1, []
    while wanted := sorted({c for c, n in means.values() if n >= 4 * k}):
        out = out.withColumns({f"_sum{4 * k}_{c}": sum((back(part(c, k), i * k) for i in (1, 2, 3)), part(c, k)) for c in wanted})
        made += [f"_sum{4 * k}_{c}" for c in wanted]
        k *= 4
    exprs = {}
    for name, (c, n) in means.items():
        at, total, size = 0, None, k
        while size:
            while n - at >= size:
                total, at = back(part(c, size), at) if total is None else total + back(part(c, size), at), at + size
            size //= 4
        exprs[name] = total / n
    return out.withColumns(exprs).drop(*made)


def rolling_std(column: str, n: int) -> Column:
    """Sample deviation."""
    return rolling(F.stddev_samp, column, n)


def before(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(series())


def after(column: str, n: int = 1) -> Column:
    return F.lead(column, n).over(series())


def holds(condition: Column) -> Column:
    """False where the condition is unknown; apply before negating."""
    return F.coalesce(condition, F.lit(False))


def crosses_above(a: str, b: str) -> Column:
    """Above today, not above on the row before; unknown counts as no."""
    return holds((F.col(a) > F.col(b)) & (before(a) <= before(b)))


def crosses_below(a: str, b: str) -> Column:
    return holds((F.col(a) < F.col(b)) & (before(a) >= before(b)))


def rank_share(column: str, within: list[str], ascending: bool = True) -> Column:
    """Average rank over the number of non-null values, null for null."""
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    rank = F.rank().over(Window.partitionBy(*within).orderBy(order))
    ties = F.count(column).over(Window.partitionBy(*within, column))
    return F.when(F.col(column).isNotNull(), (rank + (ties - 1) / 2) / F.count(column).over(Window.partitionBy(*within)))


def share_of(condition: Column) -> Column:
    """Mean of a condition over rows; unknown counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def day(column: str = "trade_date") -> Column:
    """A date at the library's edge: yyyyMMdd."""
    return F.date_format(column, "yyyyMMdd")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """For output: doubles rounded, dates as yyyyMMdd, whole numbers as long."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            # half up on the binary value; never -0.0
            c = F.floor(c * 10.0**digits + 0.5).cast("double") / 10.0**digits
        elif kind == "date":
            c = day(f"`{f.name}`")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_date_median(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the median of a column over all rows of the date.

    Only (date, value) pairs are shuffled by date; the medians come back by broadcast, as there is one a date, whatever the
    number of instruments, so rows stay where the windows on the instrument have put them."""
    medians = rows.groupBy("trade_date").agg(F.median(value).alias(name))
    return rows.join(F.broadcast(medians), "trade_date", "left").select(*rows.columns, name)
