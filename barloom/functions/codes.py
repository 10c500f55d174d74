"""Instrument codes, lenient parsing, names and price limits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exchange by the first two digits of a six-digit code.
EXCHANGES = {"SH": ["60", "68", "90"], "SZ": ["00", "30", "20"], "BJ": ["43", "83", "87", "88", "92"]}
#: Daily price limits by board, and when the special-treatment limit rises to the main board's.
LIMITS = {"BJ": "0.30", "growth": "0.20", "special": "0.05", "main": "0.10"}
GROWTH_PREFIXES = ["300", "301", "688", "689"]
SPECIAL_LIMIT_ENDS = date(2026, 7, 6)
NO_INDUSTRY = "未分类"


def exchange_of(symbol: Column) -> Column:
    two = F.substring(symbol, 1, 2)
    out = F.when(two.isin(EXCHANGES["SH"]), "SH")
    return out.when(two.isin(EXCHANGES["SZ"]), "SZ").when(two.isin(EXCHANGES["BJ"]), "BJ")


def code_of(symbol: Column) -> Column:
    """Full code of a raw symbol: what follows a dot is dropped, and zeros lead up to six digits. Null: no exchange."""
    digits = F.split_part(F.trim(symbol), F.lit("."), F.lit(1))
    six = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.when(six.rlike(r"^\d{6}$"), F.concat(six, F.lit("."), exchange_of(six)))


def canonical_code(raw: Column) -> Column:
    """Trimmed and upper-cased; a full code stays, six digits get their exchange, all else stays as it is."""
    c = F.upper(F.trim(raw))
    return F.when(c.rlike(r"^\d{6}$"), F.coalesce(F.concat(c, F.lit("."), exchange_of(c)), c)).otherwise(c)


def resolve_codes(raw: DataFrame, column: str, instruments: DataFrame) -> DataFrame:
    """Adds ts_code: by the instruments' symbol, else by the prefix rule. Rows that neither knows are kept with null."""
    known = instruments.select(F.col("symbol").alias("_symbol"), F.col("ts_code").alias("_known")).dropDuplicates(["_symbol"])
    digits = F.split_part(F.trim(F.col(column)), F.lit("."), F.lit(1))
    own = raw.withColumn("_key", F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))
    return own.join(known, F.col("_key") == F.col("_symbol"), "left").withColumn("ts_code", F.coalesce("_known", code_of(F.col(column)))).drop("_key", "_symbol", "_known")


def lenient_number(text: Column) -> Column:
    return F.when(F.trim(text).isin("", "--"), None).otherwise(F.trim(text)).try_cast("double")


def lenient_date(text: Column) -> Column:
    """From yyyyMMdd or yyyy-MM-dd; null if neither."""
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyyMMdd")), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))).cast("date")


def is_risky(name: Column) -> Column:
    """Specially treated or leaving the market by its name; a missing name passes."""
    return F.upper(F.coalesce(name, F.lit(""))).rlike("ST|退")


def is_specially_treated(name: Column) -> Column:
    """By its name; a missing name passes."""
    return F.contains(F.upper(F.coalesce(name, F.lit(""))), F.lit("ST"))


def industry_or_none(industry: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(industry), F.lit("")), F.lit(NO_INDUSTRY))


def limit_rate(ts_code: Column, name: Column, trade_date: Column) -> Column:
    """By board; a main-board name that begins with ST, after any asterisks, has the special rate until that ends."""
    rate = lambda key: F.lit(LIMITS[key]).cast("decimal(4,2)")
    code = F.upper(ts_code)
    growth = F.substring(code, 1, 3).isin(GROWTH_PREFIXES)
    special = F.startswith(F.ltrim(F.upper(F.coalesce(name, F.lit(""))), F.lit("*")), F.lit("ST")) & (trade_date < F.lit(SPECIAL_LIMIT_ENDS))
    return F.when(code.endswith(".BJ"), rate("BJ")).when(growth, rate("growth")).when(special, rate("special")).otherwise(rate("main"))


def is_limit_up(ts_code: Column, name: Column, trade_date: Column, pre_close: Column, close: Column) -> Column:
    """The close, in ticks, is the board's limit over the previous close as it is, both rounded half up. False without prices."""
    before = pre_close.cast("decimal(24,8)")
    limit = F.round(before * (F.lit(1).cast("decimal(4,2)") + limit_rate(ts_code, name, trade_date)), 2)
    return F.coalesce((pre_close > 0) & (F.round(close.cast("decimal(24,8)"), 2) == limit), F.lit(False))
