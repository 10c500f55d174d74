"""Indicator tables stored by instrument, so that what follows on an instrument's rows needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attach(spark: SparkSession, name: str, schema: str, path: str, buckets: int) -> None:
    """Makes an indicator table known to the session's catalogue: bucketed and sorted by instrument and date. Its files may be there already."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (ts_code) SORTED BY (ts_code, trade_date) INTO {int(buckets)} BUCKETS LOCATION '{path}'")


def store_indicator(rows: DataFrame, name: str, path: str, buckets: int) -> None:
    """Writes rows (ts_code, trade_date, ...) as a whole indicator table, one sorted file a bucket, and attaches it."""
    spark = rows.sparkSession
    attach(spark, name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), path, buckets)
    rows.repartition(buckets, "ts_code").write.mode("overwrite").insertInto(name)


def load_indicator(spark: SparkSession, name: str, ts_code: str | None = None, start=None, end=None, columns: list[str] | None = None) -> DataFrame:
    """Rows of an indicator table of one instrument or all, within dates; one instrument is looked for in its bucket only."""
    df = spark.table(name)
    if ts_code is not None:
        df = df.where(F.col("ts_code") == ts_code)
    if start is not None:
        df = df.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return df if columns is None else df.select(*columns)
