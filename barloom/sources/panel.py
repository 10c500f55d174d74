"""The bar panel and its dimensions, derived from the order tables: instrument = supplier, bar = ISO week.

On real data the same columns are read from a partitioned bar table (see ``tables``); every operator takes frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instrument_code(key: str):
    prefix = F.element_at(F.array(*(F.lit(x) for x in ("600", "300", "688", "920"))), (F.col(key) % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*(F.lit(x) for x in ("SH", "SZ", "SH", "BJ"))), (F.col(key) % 4 + 1).cast("int"))
    digits = F.col(key).cast("string")
    return F.concat(prefix, F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), F.lit("."), suffix)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_code, trade_date, open, high, low, close, pre_close, change, pct_chg, vol, amount."""
    line = table(spark, sf_dir, "lineitem").select(
        instrument_code("l_suppkey").alias("ts_code"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("at"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("money"),
    )
    # dealt by instrument at once: the windows that follow need no other shuffle or sort, and there are few lines a bar to combine before
    daily = line.repartition("ts_code").groupBy("ts_code", "trade_date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("vol"),
        F.sum("money").cast("double").alias("amount"),
    )
    pre = F.lag("close").over(series())
    return daily.withColumn("pre_close", pre).select(
        "ts_code", "trade_date", "open", "high", "low", "close", "pre_close", (F.col("close") - F.col("pre_close")).alias("change"),
        ((F.col("close") / F.col("pre_close") - 1) * 100).alias("pct_chg"), "vol", "amount",
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_code, symbol, name, area, industry, list_date, delist_date: small, one row an instrument."""
    nation, region = (F.broadcast(table(spark, sf_dir, t)) for t in ("nation", "region"))
    key = F.col("s_suppkey")
    named = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    code = instrument_code("s_suppkey")
    return named.select(
        code.alias("ts_code"),
        F.split_part(code, F.lit("."), F.lit(1)).alias("symbol"),
        F.when(key % 17 == 3, F.concat(F.lit("*ST "), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.col("r_name").alias("area"),
        F.when(key % 19 == 5, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("industry"),
        F.lit("1990-01-01").cast("date").alias("list_date"),
        F.lit(None).cast("date").alias("delist_date"),
    )


def calendar(panel: DataFrame) -> DataFrame:
    """trade_date, trade_index: a dense index over the distinct dates, of which there are few however many bars."""
    return panel.select("trade_date").distinct().withColumn("trade_index", F.row_number().over(Window.orderBy("trade_date")) - 1)


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual reports by supplier and ship year, known 120 days after the year's end; ratios by fixed formulas."""
    line = table(spark, sf_dir, "lineitem")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    year = (
        line.groupBy(instrument_code("l_suppkey").alias("ts_code"), F.year("l_shipdate").alias("y"))
        .agg(F.sum(money).cast("double").alias("revenue"), F.count("*").alias("n"), F.sum("l_quantity").alias("units"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("returned"))
    )
    w = Window.partitionBy("ts_code").orderBy("y")
    profit = F.col("revenue") * (F.col("units") % 17 + 8) / 100
    return (
        year.withColumn("net_profit", profit)
        .withColumn("revenue_yoy", (F.col("revenue") / F.lag("revenue").over(w) - 1) * 100)
        .withColumn("net_profit_yoy", (F.col("net_profit") / F.lag("net_profit").over(w) - 1) * 100)
        .select(
            "ts_code",
            F.make_date("y", F.lit(12), F.lit(31)).alias("report_date"),
            F.date_add(F.make_date("y", F.lit(12), F.lit(31)), 120).alias("announcement_date"),
            "revenue", "revenue_yoy", "net_profit", "net_profit_yoy",
            (F.col("units") % 97 / 10 + 20).alias("eps"),
            (F.col("units") % 89 * 10 + 400).alias("book_value_per_share"),
            (F.col("units") % 23 + 5).alias("roe"),
            (F.col("n") % 7 - 1).cast("double").alias("ocf_per_share"),
            (F.col("units") % 31 + 10).alias("gross_margin"),
            (F.col("returned") % 71 + 5).alias("debt_to_assets"),
        )
    )


def concept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date, concept_code, ts_code, member_rank: brands that an instrument shipped in a week."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", instrument_code("l_suppkey").alias("ts_code"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"), "l_extendedprice")
    own = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("trade_date", F.col("p_brand").alias("concept_code"), "ts_code").agg(F.max("l_extendedprice").alias("best"))
    rank = F.row_number().over(Window.partitionBy("trade_date", "concept_code").orderBy(F.desc("best"), "ts_code"))
    return own.select("trade_date", "concept_code", "ts_code", rank.alias("member_rank"))
