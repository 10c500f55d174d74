"""Signals joined with predictions, search over landed rows, and distinct codes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import canonical_code, industry_or_none

#: What the names of columns of codes and of names of instruments end in, and columns that stand first in a listing.
CODE_ENDS, NAME_ENDS = ("code", "symbol", "ticker", "代码"), ("name", "简称", "名称")
LEADING = ("source_file", "ts_code", "code", "name", "trade_date", "date", "industry", "close")
_CODE = r"^\s*([0-9]{6})(?:\.[A-Za-z]{2})?\s*$"


def combine(signals: DataFrame, predictions: DataFrame, code: str = "ts_code") -> DataFrame:
    """Signals with the predictions of their date and canonical code; predictions without a signal are kept as rows.

    Ordered by prediction rank within the date, rows without one last."""
    p = predictions.select("signal_date", canonical_code(F.col("ts_code")).alias("_code"), "prob_up", "reasons", F.row_number().over(Window.partitionBy("signal_date").orderBy(F.desc("prob_up"), "ts_code")).alias("prediction_rank"))
    s = signals.withColumn("_code", canonical_code(F.col(code)))
    both = s.join(p, ["signal_date", "_code"], "left").withColumn("has_signal", F.lit(True))
    only = p.join(s.select("signal_date", "_code").distinct(), ["signal_date", "_code"], "left_anti").withColumns({"has_signal": F.lit(False), code: F.col("_code")})
    out = both.unionByName(only, allowMissingColumns=True)
    w = Window.partitionBy("signal_date").orderBy(F.asc_nulls_last("prediction_rank"), "_code")
    return out.withColumn("position", F.row_number().over(w)).withColumnRenamed("_code", "canonical_code")


def prediction_rows(combined: DataFrame, industry: str | None = None) -> DataFrame:
    out = combined.where("prediction_rank IS NOT NULL")
    return out if industry is None else out.where(industry_or_none(F.col("industry")) == industry)


def signal_dates(signals: DataFrame) -> DataFrame:
    return signals.groupBy("ts_code").agg(F.array_sort(F.collect_set("trade_date")).alias("dates"))


def distinct_codes(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (f.select("ts_code") for f in frames)).where("ts_code IS NOT NULL").distinct()


def columns_ending(rows: DataFrame, ends: tuple[str, ...]) -> list[str]:
    return [c for c in rows.columns if c.lower().rstrip(" ._-").endswith(ends)]


def six_digits(value: Column) -> Column:
    """The digits of a six-digit code, whatever exchange follows; null for anything else."""
    return F.nullif(F.regexp_extract(value, _CODE, 1), F.lit(""))


def search(rows: DataFrame, text: str, codes: list[str] | None = None, names: list[str] | None = None, all_columns: bool = False) -> DataFrame:
    """Rows in which the text is found in a column of codes or of names, or in any column if there is none or all are asked for.

    ``codes`` and ``names`` say which columns those are; by default, their names' ends do. A six-digit code, with or without an exchange,
    is found in a column of codes by its digits; everything else, and everywhere else, by being part of the value, in any case. Nulls
    never match."""
    codes = columns_ending(rows, CODE_ENDS) if codes is None else codes
    names = columns_ending(rows, NAME_ENDS) if names is None else names
    looked = rows.columns if all_columns or not codes and not names else [c for c in rows.columns if c in codes or c in names]
    wanted = re.match(_CODE, text)
    value = {c: F.col(f"`{c}`").cast("string") for c in looked}
    found = [six_digits(v) == wanted[1] if wanted and c in codes else F.contains(F.lower(v), F.lit(text.lower())) for c, v in value.items()]
    return rows.where(F.coalesce(F.greatest(*found, F.lit(False)), F.lit(False)))


def dated_rows(frames: dict[str, DataFrame], date: str = "trade_date") -> DataFrame:
    """All rows of several tables as one that can be searched: source, signal_date and the columns of all, null where absent."""
    own = [f.select(F.lit(name).alias("source"), F.col(date).alias("signal_date"), *(c for c in f.columns if c != date)) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def ordered_columns(rows: DataFrame, leading: tuple[str, ...] = LEADING) -> DataFrame:
    """The leading columns that there are, in that order, and then all others in theirs."""
    return rows.select(*(c for c in leading if c in rows.columns), *(c for c in rows.columns if c not in leading))


def rows_of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose instrument and date are among the pairs, each once however often its pair is there."""
    return rows.join(pairs.select("ts_code", "trade_date"), ["ts_code", "trade_date"], "left_semi")
