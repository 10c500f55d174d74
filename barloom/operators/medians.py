"""Exact medians of large groups, in memory that doesn't follow the number of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables

#: How far the bracket around a median reaches, as a share of the rows, and the sketch's accuracy.
REACH, ACCURACY = 0.002, 2000


def medians(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """median_{c} of each group, as F.median gives it; nulls don't count, a group without values has null.

    F.median keeps all distinct values of a group in one task. Here a quantile sketch of bounded size gives a bracket around the middle
    of each group and column; the values below it are counted, those within it, a few thousandths, are counted by value and added up in
    order, which gives the exact middle. Where a bracket misses the middle, it is opened to all values. rows are read three
    times, so they should be a stored table; groups are few and their brackets pass through the driver."""
    by = by or []
    spark = rows.sparkSession
    values = range(len(columns))
    sketch = lambda c: F.percentile_approx(c, [0.5 - REACH, 0.5 + REACH], ACCURACY)
    found = rows.groupBy(*by).agg(*(f for i, c in enumerate(columns) for f in (sketch(c).alias(f"_b{i}"), F.count(c).alias(f"_n{i}")))).collect()
    keys = ", ".join(f"_k{j} {rows.schema[k].dataType.simpleString()}" for j, k in enumerate(by))
    fields = ", ".join([*([keys] if keys else []), *(f"_lo{i} double, _hi{i} double, _n{i} long" for i in values)])
    infinite = (float("-inf"), float("nan"))  # NaN is the largest number here
    table = [[*(r[k] for k in by), *(x for i in values for x in (*(r[f"_b{i}"] or infinite), r[f"_n{i}"]))] for r in found]
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_k{j}"]) for j, k in enumerate(by)), F.lit(True))

    def bracketed():
        known = F.broadcast(spark.createDataFrame([tuple(x) for x in table], fields))
        return rows.join(known, same(rows, known))

    under = lambda i: F.col(columns[i]) < F.col(f"_lo{i}")
    within = lambda i: (F.col(columns[i]) >= F.col(f"_lo{i}")) & (F.col(columns[i]) <= F.col(f"_hi{i}"))
    groups = [f"_k{j}" for j in range(len(by))]
    counts = bracketed().groupBy(*groups).agg(*(f for i in values for f in (F.count(F.when(under(i), 1)).alias(f"_u{i}"), F.count(F.when(within(i), 1)).alias(f"_w{i}")))).collect() if table else []
    below = {tuple(r[g] for g in groups): r for r in counts}
    for x in table:
        r = below.get(tuple(x[: len(by)]))
        for i in values:
            at = len(by) + 3 * i
            n, u, w = x[at + 2], r[f"_u{i}"] if r else 0, r[f"_w{i}"] if r else 0
            if n and not (u <= (n - 1) // 2 and n // 2 < u + w):
                x[at : at + 2], u = infinite, 0
            x[at + 2] = n
            x.append(u)
    fields += "".join(f", _u{i} long" for i in values)
    entry = lambda i: F.when(within(i), F.struct(F.lit(i).alias("i"), F.col(columns[i]).cast("double").alias("v"), F.col(f"_n{i}").alias("n"), F.col(f"_u{i}").alias("u")))
    few = bracketed().select(*groups, F.explode(F.array_compact(F.array(*(entry(i) for i in values)))).alias("x")).groupBy(*groups, "x.i", "x.v", "x.n", "x.u").agg(F.count("*").alias("c"))
    upto = F.col("u") + F.sum("c").over(Window.partitionBy(*groups, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("v")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    middle = few.withColumn("upto", upto).groupBy(*groups, "i").agg(low.alias("a"), high.alias("b")).withColumn("m", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b")))
    wide = middle.groupBy(*groups).agg(*(F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"median_{c}") for i, c in enumerate(columns)))
    every = spark.createDataFrame([tuple(x[: len(by)]) + (0,) for x in table], f"{keys}{', ' if keys else ''}_one int")
    wide = wide.toDF(*(f"_g{j}" for j in range(len(by))), *(f"median_{c}" for c in columns))
    own = reduce(lambda x, y: x & y, (F.col(f"_k{j}").eqNullSafe(F.col(f"_g{j}")) for j in range(len(by))), F.lit(True))
    return every.join(F.broadcast(wide), own, "left").select(*(F.col(f"_k{j}").alias(k) for j, k in enumerate(by)), *(f"median_{c}" for c in columns))


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a table that can be read several times."""
    return tables.written(rows, "median-rows")
