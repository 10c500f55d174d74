"""Incremental refresh: a file stream of bars, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import upsert

BAR_SCHEMA = "ts_code string, trade_date date, open double, high double, low double, close double, pre_close double, vol double, amount double, ingest_ts timestamp"


def bar_stream(spark: SparkSession, folder: str, schema: str = BAR_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder).withColumn("trade_month", F.trunc("trade_date", "MM"))


def refresh_bars(spark: SparkSession, folder: str, table: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Takes what has landed since the last run and upserts it into the bar table, by months; a batch that is run again
    changes nothing. ``then`` gets the instruments touched, to recompute what derives from their bars alone."""

    def apply(batch: DataFrame, _: int) -> None:
        batch.persist()  # the merge reads it twice, then() once more
        try:
            if not batch.isEmpty():
                upsert(batch, table, ["ts_code", "trade_date"], "trade_month")
                if then:
                    then(batch.select("ts_code").distinct())
        finally:
            batch.unpersist()

    return bar_stream(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recompute(bars: DataFrame, touched: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An indicator over the touched instruments' bars only."""
    return operator(bars.join(touched, "ts_code", "left_semi"))
