"""Landed files and stored tables: dated CSVs, upserts by key, snapshots by date, screens' results, nested JSON."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import lenient_number

_DAY = r"(?:^|[^0-9])(20[0-9]{6})(?:[^0-9]|$)"


def load_bars(spark: SparkSession, path: str, start=None, end=None, columns: list[str] | None = None) -> DataFrame:
    """Bars of a date range from a table partitioned by trade_month: whole months are pruned, days pushed down."""
    df = spark.read.parquet(path)
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is not None:
            day = F.lit(bound).cast("date")
            df = df.where((F.col("trade_date") >= day) & (F.col("trade_month") >= F.trunc(day, "MM")) if op == ">=" else (F.col("trade_date") <= day) & (F.col("trade_month") <= F.trunc(day, "MM")))
    return df.drop("trade_month") if columns is None else df.select(*columns)


def with_names(bars: DataFrame, instruments: DataFrame) -> DataFrame:
    return bars.join(instruments.select("ts_code", "name", "industry"), "ts_code", "left")


def file_day(path: Column) -> Column:
    """The date in a file's name: eight digits from 20 on that no other digit touches; null if there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, _DAY, 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


#: How files may be encoded, in the order in which that is tried.
ENCODINGS = ("utf-8-sig", "gb18030")


def _decoded(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {', '.join(ENCODINGS)} decodes a file")


def _csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, header, cells) of files (path, content): one row a line, shorter lines filled with empty text."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lines = csv.reader(io.StringIO(_decoded(content), newline=""))
            header = next(lines, [])
            while rows := [(r + [""] * len(header))[: len(header)] for r in islice(lines, 5000) if r]:
                yield pa.record_batch([pa.array([path] * len(rows)), pa.array([header] * len(rows), pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string()))], names=["path", "header", "cells"])


def parse_csvs(files: DataFrame) -> DataFrame:
    """CSV files (path, content) with their own columns as one table, all text, with source_file and signal_date; columns that a file
    lacks are null. Bytes are UTF-8, with or without a mark, or GB18030; anything else is an error.

    One job over the files brings back the distinct headers, of which there are few; a file is read in one task. Of columns with
    equal names in a header the first counts. No file or no line gives no row."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [next(csv.reader(io.StringIO(_decoded(c), newline="")), []) for c in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(found, pa.list_(pa.string()))], names=["header"])

    known = files.select("content").mapInArrow(heads, "header array<string>").distinct().collect()
    columns = list(dict.fromkeys(c for r in sorted(known) for c in r["header"] if c))
    rows = files.select("path", "content").mapInArrow(_csv_rows, "path string, header array<string>, cells array<string>")
    cell = lambda c: F.try_element_at("cells", F.nullif(F.array_position("header", c), F.lit(0)).cast("int")).alias(c)
    return rows.select(*(cell(c) for c in columns), F.element_at(F.split("path", "/"), -1).alias("source_file"), file_day(F.col("path")).alias("signal_date"))


def read_dated_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        raise ValueError("no file given")
    return parse_csvs(spark.read.format("binaryFile").load(paths).select("path", "content"))


def load_pool(spark: SparkSession, paths: list[str], start, end) -> DataFrame:
    return pool_of(read_dated_csvs(spark, paths), start, end)


def pool_of(rows: DataFrame, start, end) -> DataFrame:
    """Distinct (trade_date, ts_code) of screens' rows (signal_date, ts_code) dated within the range; an error if they lack ts_code."""
    if "ts_code" not in rows.columns:
        raise ValueError("the files have no column ts_code")
    code = F.upper(F.trim("ts_code"))
    pool = rows.where(F.col("signal_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(F.col("signal_date").alias("trade_date"), code.alias("ts_code"))
    return pool.where("ts_code != ''").dropDuplicates(["trade_date", "ts_code"])


def last_write(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row a key, the last by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc_nulls_last()))).where("_r = 1").drop("_r")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a cluster it must be set: a local one would be another on each machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "file:///tmp/checkpoints"


_WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which cleanup() removes."""
    path = f"{shared_folder(spark).rstrip('/')}/barloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what reads them several times works them out once, and lost executors cost no more than
    the files they had not written."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Deletes what this application has written by scratch() and returns its number. Call it when results are stored: DataFrames that queries have
    returned read those tables."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        fs, at = _files(spark, p)
        fs.delete(at(), True)
    return len(paths)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *parts)))


def finish_swaps(spark: SparkSession, path: str) -> int:
    """Carries out what an interrupted write had staged whole but not put in place; the number of such writes."""
    fs, at = _files(spark, path)
    if not fs.exists(at()):
        return 0
    staged = sorted(x.getPath().getName() for x in fs.listStatus(at()) if x.getPath().getName().startswith("_ready-"))
    for name in staged:
        for part in sorted(x.getPath().getName() for x in fs.listStatus(at(name))):
            if "=" not in part:
                continue
            if fs.exists(at(part)):
                fs.mkdirs(at(name, "_old"))
                fs.rename(at(part), at(name, "_old", part))
            if not fs.rename(at(name, part), at(part)):
                raise OSError(f"{part} of {name} could not be put in place")
        fs.delete(at(name), True)
    return len(staged)


def put_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that rows have; others stay. A partition is a folder, as Spark writes it.

    The rows are written whole beside the table first, and one rename marks them as ready; then each partition is put in place by a
    rename. A job that fails before the mark changes nothing, and what fails after it is finished by the next write or
    read_table(), so no row is lost. (On a store without atomic renames, let a table format do this.)"""
    spark = rows.sparkSession
    finish_swaps(spark, path)
    fs, at = _files(spark, path)
    name = uuid.uuid4().hex
    staged = str(at(f"_staged-{name}"))
    try:
        rows.write.partitionBy(partition).parquet(staged)
    except Exception:
        fs.delete(at(f"_staged-{name}"), True)
        raise
    fs.rename(at(f"_staged-{name}"), at(f"_ready-{name}"))
    finish_swaps(spark, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    finish_swaps(spark, path)
    return spark.read.parquet(path)


def upsert(rows: DataFrame, path: str, key: list[str], partition: str, version: str = "ingest_ts") -> None:
    """Inserts or replaces by key, last write first; only partitions that the rows touch are read and rewritten, by put_partitions().

    Run again with the same rows, it changes nothing."""
    spark = rows.sparkSession
    finish_swaps(spark, path)
    new = last_write(rows, key, F.col(version))
    if _exists(spark, path):
        stored = spark.read.parquet(path)
        touched = rows.select(F.col(partition).cast(stored.schema[partition].dataType)).distinct()
        old = stored.join(touched, partition, "left_semi")
        new = last_write(old.unionByName(new, allowMissingColumns=True), key, F.col(version))
    put_partitions(new, path, partition)


def replace_dates(rows: DataFrame, path: str, partition: str = "trade_date") -> None:
    """Replaces whole snapshots: what the rows' dates held before is gone, other dates stay."""
    put_partitions(rows, path, partition)


def signal_history(log: DataFrame, strategy: str, ts_code: str | None = None, start=None, end=None) -> DataFrame:
    out = log.where(F.col("strategy") == strategy)
    if ts_code is not None:
        out = out.where(F.col("ts_code") == ts_code)
    if start is not None:
        out = out.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return out.orderBy("trade_date", "ts_code")


def persist_signals(hits: DataFrame, path: str, strategy: str, ingested) -> None:
    """Logs a strategy's hits (ts_code, trade_date, close), one row for each; logged again, they are replaced."""
    rows = hits.select(F.lit(strategy).alias("strategy"), "ts_code", "trade_date", "close", F.lit(ingested).cast("timestamp").alias("ingest_ts"))
    upsert(rows.withColumn("trade_month", F.date_format("trade_date", "yyyy-MM")), path, ["strategy", "ts_code", "trade_date"], "trade_month")


def signal_count(log: DataFrame, strategy: str, ts_code: str | None = None, start=None, end=None) -> DataFrame:
    """How many signals signal_history() has for the same arguments, as one row."""
    return signal_history(log, strategy, ts_code, start, end).agg(F.count("*").alias("n"))


def write_screen(hits: DataFrame, path: str, digits: dict[str, int]) -> None:
    """A CSV folder for each date, with the columns in order and numbers rounded."""
    out = hits.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in hits.columns))
    out.repartition("trade_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").csv(path, header=True)


def write_nested(rows: DataFrame, path: str, by: list[str], items: str = "rows", order: list[str] | None = None) -> None:
    """One JSON object a group, with its rows as an array, in folders by the first key."""
    rest = [c for c in rows.columns if c not in by]
    rest = [*(order or []), *(c for c in rest if c not in (order or []))]
    rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(items)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by[0]).json(path)


def refresh_documents(stored: DataFrame, fresh: DataFrame, key: str, entries: str, entry: str, drop: DataFrame | None = None) -> DataFrame:
    """Stored documents (key, entries: an array of structs with a field ``entry``, other columns) after some of their entries were made anew.

    ``fresh`` has key, entries of the same type and any of the other columns. Entries are merged by ``entry``: a new one replaces the
    stored one, all others stay as they are; other columns are replaced where they are given and not null. A document of which there
    is nothing new stays; a new one is added. ``drop`` (key, entry) takes entries out. Entries are ordered by ``entry``."""
    rest = [c for c in stored.columns if c not in (key, entries)]
    known = stored.select(key, *(F.col(c).alias(f"_old_{c}") for c in rest))
    new = fresh.select(key, *(F.col(c).alias(f"_new_{c}") for c in fresh.columns if c not in (key, entries)))
    # entries meet as rows: looking for each in an array of the others is quadratic in a document
    each = lambda df: df.select(F.col(key).alias("_of"), F.explode(entries).alias("_e"))
    gone = each(fresh).select("_of", F.col("_e")[entry].alias("_gone"))
    if drop is not None:
        gone = gone.union(drop.select(key, entry))
    gone = gone.distinct().toDF("_of_gone", "_gone")
    kept = each(stored).join(gone, F.col("_of").eqNullSafe(F.col("_of_gone")) & (F.col("_e")[entry] == F.col("_gone")), "left_anti")
    order = lambda a, b: F.when(a[entry] < b[entry], -1).when(a[entry] > b[entry], 1).otherwise(0)
    merged = kept.union(each(fresh)).groupBy("_of").agg(F.array_sort(F.collect_list("_e"), order).alias("_merged"))
    both = known.join(new, key, "full").join(merged, F.col(key).eqNullSafe(F.col("_of")), "left")
    none = F.array().cast(stored.schema[entries].dataType)
    others = [F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) if f"_new_{c}" in new.columns else F.col(f"_old_{c}").alias(c) for c in rest]
    return both.select(key, F.coalesce("_merged", none).alias(entries), *others)


def manifest(rows: DataFrame) -> DataFrame:
    """Per date the files, their number, the rows, and whether it is the latest date."""
    out = rows.groupBy("signal_date").agg(F.array_sort(F.collect_set("source_file")).alias("files"), F.countDistinct("source_file").alias("file_count"), F.count("*").alias("row_count"))
    return out.withColumn("is_latest", F.col("signal_date") == F.max("signal_date").over(Window.partitionBy()))


_TAG = r"""(?is)<input\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
#: Named characters of HTML that JSON text in an attribute needs.
NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\u00a0"}


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag's text, in double, single or no quotes, wherever it stands; null if it isn't there."""
    pattern = rf"""(?is)(?:^|[\s"'])({name})\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    parts = [F.regexp_extract(tag, pattern, i) for i in (2, 3, 4)]
    return F.when(F.regexp_extract(tag, pattern, 1) != "", F.concat(*parts))


def unescaped(text: Column) -> Column:
    """HTML's character references as the characters: the common names, decimal and hexadecimal numbers."""
    pattern = "&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
    number = lambda r: F.when(F.lower(r).startswith("x"), F.conv(F.substring(r, 2, 8), 16, 10)).otherwise(r).cast("long")
    one = lambda r: F.coalesce(F.when(number(r).between(1, 0x10FFFF) & ~number(r).between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number(r)), 8, "0")), "UTF-32")), F.lit("\ufffd"))
    signs = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), one), F.array(F.lit("")))
    out = F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), signs, lambda a, b: F.array(a, b))), "")
    for name, sign in NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def parse_snapshot(pages: DataFrame, html: str, input_id: str, texts: dict[str, str], numbers: dict[str, str], required: tuple[str, ...] = (), name: str = "name", keep_prefixes_out: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the JSON object of objects in a page's input with that id (the last one, if there are several): one for each key, with
    columns from the objects' fields: ``texts`` and ``numbers`` say which column is which field.

    Blank texts become null, as do numbers that are blank, ``--`` or none. Rows that lack a ``required`` column are dropped, and those whose
    ``name`` begins with an excluded prefix. Pages without such an input, or whose value is no object of objects, give no row."""
    # a column a step: within one expression Spark works a part out again wherever it stands
    tags = F.filter(F.regexp_extract_all(html, F.lit(_TAG), 1), lambda t: F.coalesce(attribute(t, "id") == input_id, F.lit(False)))
    rows = pages.withColumn("_tag", F.try_element_at(tags, F.lit(-1))).withColumn("_value", attribute(F.col("_tag"), "value")).withColumn("_text", unescaped(F.col("_value")))
    rows = rows.withColumn("_m", F.from_json("_text", "map<string,map<string,string>>")).select(*pages.columns, F.explode("_m").alias("key", "_item"))
    field = lambda f: F.trim(F.try_element_at("_item", F.lit(f)))
    out = rows.withColumns({**{c: F.nullif(field(f), F.lit("")) for c, f in texts.items()}, **{c: lenient_number(field(f)) for c, f in numbers.items()}}).drop("_item")
    for c in required:
        out = out.where(F.col(c).isNotNull())
    for p in keep_prefixes_out:
        out = out.where(~F.coalesce(F.col(name).startswith(p), F.lit(False)))
    return out


def high_water(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max("trade_date").alias("last"))


def pending_days(bars: DataFrame, until) -> DataFrame:
    """Weekdays after the last loaded date, up to ``until``, that aren't loaded."""
    end = F.lit(until).cast("date")
    days = high_water(bars).where(F.date_add("last", 1) <= end).select(F.explode(F.sequence(F.date_add("last", 1), end)).alias("trade_date"))
    return days.where(F.weekday("trade_date") < 5).join(bars.select("trade_date").distinct(), "trade_date", "left_anti")


def open_dates(calendar: DataFrame, exchange: str, start, end) -> DataFrame:
    return calendar.where((F.col("exchange") == exchange) & (F.col("is_open") == 1) & F.col("cal_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("cal_date").orderBy("cal_date")
