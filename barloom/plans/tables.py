"""Queries of codes, search, deduplication, combination and pending dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.exprs import rounded
from ..operators import backtests as bt
from ..operators import combine as comb
from ..operators import indicators as ind
from ..operators import nextday as nd
from ..operators import screens
from ..operators import sectors as sec
from ..sources import panel, tables
from . import frames
from .model import _FIXED, _KNOWN, _PROB
from .registry import query
from .sql import d, r, with_

_SUFFIX = "CASE WHEN substr(s, 1, 2) IN ('60','68','90') THEN 'SH' WHEN substr(s, 1, 2) IN ('00','30','20') THEN 'SZ' WHEN substr(s, 1, 2) IN ('43','83','87','88','92') THEN 'BJ' END"


def _raw(spark, sf_dir):
    """Codes as they come: part keys of up to six digits, some with a suffix or blanks."""
    key = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.lpad((F.col("p_partkey") * 37 % 1000000).cast("string"), 6, "0"), F.lit(" "))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0"), F.lit(".sz"))).otherwise(key)
    return panel.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


_RAW = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' ' || lpad((p_partkey * 37 % 1000000)::VARCHAR, 6, '0') || ' ' WHEN 1 THEN lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') || '.sz' ELSE p_partkey::VARCHAR END AS raw FROM part"


@query(f"SELECT p_partkey, CASE WHEN regexp_full_match(s, '[0-9]{{6}}') THEN coalesce(s || '.' || {_SUFFIX}, s) ELSE s END AS canonical FROM (SELECT p_partkey, upper(trim(raw)) AS s FROM ({_RAW}))")
def code_canon(spark, sf_dir):
    return rounded(_raw(spark, sf_dir).select("p_partkey", codes.canonical_code(F.col("raw")).alias("canonical")))


@query(with_(["instruments"], f"SELECT p_partkey, coalesce(i.ts_code, CASE WHEN regexp_full_match(s, '[0-9]{{6}}') THEN s || '.' || {_SUFFIX} END) AS ts_code FROM (SELECT p_partkey, CASE WHEN length(x) < 6 THEN lpad(x, 6, '0') ELSE x END AS s FROM (SELECT p_partkey, split_part(trim(raw), '.', 1) AS x FROM ({_RAW}))) LEFT JOIN (SELECT symbol, ts_code FROM instruments) i ON i.symbol = s"))
def code_resolve(spark, sf_dir):
    return rounded(codes.resolve_codes(_raw(spark, sf_dir), "raw", panel.instruments(spark, sf_dir)).select("p_partkey", "ts_code"))


_NAMED = "SELECT ts_code, trade_date, name, industry FROM bars LEFT JOIN instruments USING (ts_code)"


@query(with_(["bars", "instruments"], f"""SELECT 'six digits' AS layout, ts_code, {d()}, name FROM ({_NAMED}) t WHERE split_part(ts_code, '.', 1) = '300001' OR contains(lower(name), '300001')
UNION ALL SELECT 'full code', ts_code, {d()}, name FROM ({_NAMED}) t WHERE split_part(ts_code, '.', 1) = '688002' OR contains(lower(name), '688002.sh')
UNION ALL SELECT 'name', ts_code, {d()}, name FROM ({_NAMED}) t WHERE contains(lower(name), lower('#000000007')) OR contains(lower(ts_code), lower('#000000007'))
UNION ALL SELECT 'any column', ts_code, {d()}, name FROM ({_NAMED}) t WHERE contains(lower(industry), 'fran') OR contains(lower(ts_code), 'fran') OR contains(lower(name), 'fran')"""))
def search_rows(spark, sf_dir):
    """A code without and with its exchange, a part of a name, and a text in any column, over tables of several layouts."""
    rows = tables.with_names(panel.bars(spark, sf_dir), panel.instruments(spark, sf_dir)).select("ts_code", "trade_date", "name", "industry")
    found = [
        ("six digits", comb.search(rows, "300001")),
        ("full code", comb.search(rows.toDF("Security-Code", "trade_date", "Short Name", "industry"), "688002.SH").toDF(*rows.columns)),
        ("name", comb.search(rows, "#000000007")),
        ("any column", comb.search(rows.select(F.col("ts_code").alias("a"), F.col("trade_date").alias("b"), F.col("name").alias("c"), F.col("industry").alias("d")), "FRAN").toDF(*rows.columns)),
    ]
    parts = [f.select(F.lit(n).alias("layout"), "ts_code", "trade_date", "name") for n, f in found]
    return rounded(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))


@query("SELECT o_custkey, o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y%m%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def dedupe_latest(spark, sf_dir):
    o = panel.table(spark, sf_dir, "orders")
    return rounded(tables.last_write(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyyMMdd").alias("day")))


@query(with_(["bars"], "SELECT strftime(day, '%Y%m%d') AS trade_date FROM (SELECT unnest(generate_series(m + 1, DATE '2001-12-31', INTERVAL 1 DAY)) AS day FROM (SELECT max(trade_date) AS m FROM bars)) WHERE isodow(day) <= 5"))
def pending_dates(spark, sf_dir):
    return rounded(tables.pending_days(panel.bars(spark, sf_dir), "2001-12-31"))


@query("SELECT event_id, key, TRY_CAST(props::JSON ->> key AS DOUBLE) AS value FROM (SELECT event_id, props, unnest(json_keys(props::JSON)) AS key FROM events)")
def json_snapshot(spark, sf_dir):
    """Events' JSON text parsed to a map and exploded to rows, numbers read leniently."""
    out = panel.table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "text"))
    return rounded(out.select("event_id", "key", codes.lenient_number(F.col("text")).alias("value")))


@query("""SELECT user_id, event_id::VARCHAR AS key, event_type || ' & <' || chr(233) || '>' AS name, floor(value * 1e6 + 0.5) / 1e6 AS pct_chg, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END::DOUBLE AS net_inflow
FROM events WHERE event_type <> '' AND event_id % 5 <> 0 AND NOT starts_with(event_type, 'view')""")
def page_snapshot(spark, sf_dir):
    """Pages with a hidden input of a JSON object of objects, as a source lands them (built here, one a user), parsed to rows.

    Attributes stand in several orders and quotes, other inputs before and after, signs are written as character references."""
    e = panel.table(spark, sf_dir, "events")
    label = F.concat(F.lit(" "), "event_type", F.lit(" & <"), F.char(F.lit(233)), F.lit("> "))
    item = F.struct(label.alias("platename"), F.when(F.col("event_id") % 5 == 0, "--").otherwise(F.col("value").cast("string")).alias("199112"), F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 3).cast("string")).alias("zjjlr"))
    held = e.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string").alias("k"), item.alias("v"))))).alias("m"))
    escaped = F.col("m")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&#x3E;"), ('"', "&quot;"), ("\u00e9", "&#233;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    tag = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("<input type='hidden' id='snap' value='"), escaped, F.lit("'>")))
    tag = tag.when(F.col("user_id") % 3 == 1, F.concat(F.lit('<INPUT value="'), escaped, F.lit('" data-x="a>b" ID="snap"/>'))).otherwise(F.concat(F.lit('<input\nvalue = "'), escaped, F.lit('" id=snap >')))
    pages = held.select("user_id", F.concat(F.lit("<html><input id='other' value='{}'>"), tag, F.lit("<input value='1'></html>")).alias("html"))
    out = tables.parse_snapshot(pages, "html", "snap", {"name": "platename"}, {"pct_chg": "199112", "net_inflow": "zjjlr"}, required=("name", "pct_chg"), keep_prefixes_out=("view",))
    return rounded(out.select("user_id", "key", "name", "pct_chg", "net_inflow"))


_CUT = "1998-01-01"
_ENTRIES = "SELECT '{0}' AS strategy, ts_code, count(*) AS n, strftime(max(trade_date), '%Y%m%d') AS last_date FROM {1} GROUP BY ts_code"


@query(with_(["b1", "pit"], f""", hits AS (SELECT * FROM b1 WHERE b1), old AS ({_ENTRIES.format('b1', f"hits WHERE trade_date < DATE '{_CUT}'")} UNION ALL {_ENTRIES.format('pit', f"pit WHERE signal = 1 AND trade_date < DATE '{_CUT}'")}),
new AS (SELECT * FROM ({_ENTRIES.format('b1', 'hits')}) WHERE ts_code IN (SELECT ts_code FROM hits WHERE trade_date >= DATE '{_CUT}'))
SELECT *, CASE strategy WHEN 'b1' THEN 2::BIGINT ELSE 1 END AS version FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE strategy <> 'b1' OR ts_code NOT IN (SELECT ts_code FROM new))"""))
def partial_refresh(spark, sf_dir):
    """A stored document a strategy, with an entry an instrument. One strategy's document gets entries of instruments with new signals; its other
    entries and the other document stay."""
    path = tables.scratch(spark, "documents")
    bars = panel.bars(spark, sf_dir)
    hits = {"b1": ind.wide(bars).where(screens.is_b1()), "pit": ind.golden_pit(bars).where("signal = 1")}
    hits = {k: tables.written(rows.select("ts_code", "trade_date"), f"hits-{k}") for k, rows in hits.items()}

    def document(strategy, rows, version):
        entries = rows.groupBy("ts_code").agg(F.count("*").alias("n"), F.max("trade_date").alias("last_date"))
        return entries.agg(F.array_sort(F.collect_list(F.struct("ts_code", "n", "last_date"))).alias("entries")).select(F.lit(strategy).alias("strategy"), "entries", F.lit(version).cast("long").alias("version"))

    early = [document(k, rows.where(F.col("trade_date") < F.lit(_CUT).cast("date")), 1) for k, rows in hits.items()]
    tables.put_partitions(early[0].union(early[1]), path, "strategy")
    late = hits["b1"].where(F.col("trade_date") >= F.lit(_CUT).cast("date")).select("ts_code").distinct()
    stored = tables.read_table(spark, path).where("strategy = 'b1'")
    merged = tables.refresh_documents(stored, document("b1", hits["b1"].join(late, "ts_code", "left_semi"), 2), "strategy", "entries", "ts_code")
    tables.put_partitions(merged, path, "strategy")
    return rounded(tables.read_table(spark, path).select("strategy", "version", F.inline("entries")))


#: A file's name has a date only from the year 2000 on.
_FILE_DAY = "CASE WHEN year(trade_date) >= 2000 THEN strftime(trade_date, '%Y%m%d') END"


@query(with_(["b1", "pit"], f"""SELECT 'b1_' || strftime(trade_date, '%Y%m%d') || '.csv' AS source_file, {_FILE_DAY} AS signal_date, ts_code, (floor(close * 100 + 0.5)::BIGINT)::VARCHAR AS close, NULL::VARCHAR AS note FROM b1 WHERE b1
UNION ALL SELECT 'pit-' || strftime(trade_date, '%Y%m%d') || 'x.csv', {_FILE_DAY}, ts_code, NULL, 'a "note", of ' || ts_code || chr(10) || 'and more' FROM pit WHERE signal = 1"""))
def dated_files(spark, sf_dir):
    """Dated CSV files with two headers, with and without a mark, quotes and line breaks, read back as one table."""
    return rounded(_landed_files(spark, sf_dir).select("source_file", "signal_date", "ts_code", "close", "note"))


def _landed_files(spark, sf_dir):
    bars = panel.bars(spark, sf_dir)
    lines = lambda rows, line: rows.groupBy("trade_date").agg(F.array_join(F.array_sort(F.collect_list(line)), "\r\n").alias("lines"))
    day = F.date_format("trade_date", "yyyyMMdd")
    b1 = lines(ind.wide(bars).where(screens.is_b1()), F.concat_ws(",", "ts_code", F.floor(F.col("close") * 100 + 0.5).cast("string")))
    pit = lines(ind.golden_pit(bars).where("signal = 1"), F.concat(F.lit('"a ""note"", of '), "ts_code", F.lit('\nand more",'), "ts_code"))
    files = b1.select(F.concat(F.lit("landed/b1_"), day, F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("\ufeffts_code,close\r\n"), "lines"), "UTF-8").alias("content"))
    files = files.union(pit.select(F.concat(F.lit("landed/pit-"), day, F.lit("x.csv")), F.encode(F.concat(F.lit("note,ts_code\r\n"), "lines"), "UTF-8")))
    return tables.parse_csvs(tables.written(files, "landed"))


@query(with_(["b1", "pit"], f"SELECT DISTINCT {d()}, ts_code FROM (SELECT trade_date, ts_code FROM b1 WHERE b1 UNION ALL SELECT trade_date, ts_code FROM pit WHERE signal = 1) t WHERE t.trade_date BETWEEN DATE '2000-02-01' AND DATE '2001-03-31'"))
def dated_pool(spark, sf_dir):
    """The pool that dated files name within a range."""
    return rounded(tables.pool_of(_landed_files(spark, sf_dir), "2000-02-01", "2001-03-31"))


@query(with_(["bars", "instruments"], f"""SELECT {d()}, ts_code, floor(CASE WHEN month(t.trade_date) = 6 THEN amount / 2 ELSE amount END * 100 + 0.5) / 100 AS amount, CASE WHEN month(t.trade_date) = 6 THEN 2::BIGINT ELSE 1 END AS version
FROM bars t WHERE month(t.trade_date) IN (5, 6) AND (month(t.trade_date) = 5 OR right(split_part(ts_code, '.', 1), 1) <> '3')"""))
def replaced_snapshots(spark, sf_dir):
    """A table of whole snapshots by date; some dates are landed again with fewer rows, and what they held before is gone."""
    path = tables.scratch(spark, "snapshots")
    bars = panel.bars(spark, sf_dir).where(F.month("trade_date").isin(5, 6)).select("trade_date", "ts_code", "amount")
    tables.replace_dates(bars.withColumn("version", F.lit(1)), path)
    again = bars.where((F.month("trade_date") == 6) & (F.right(F.split_part("ts_code", F.lit("."), F.lit(1)), F.lit(1)) != "3"))
    tables.replace_dates(again.withColumns({"amount": F.col("amount") / 2, "version": F.lit(2)}), path)
    out = tables.read_table(spark, path)
    return rounded(out.select("trade_date", "ts_code", "amount", "version"), 2)


@query(with_(["b1", "instruments"], f"SELECT {d()}, ts_code, name, round(close, 2) AS close, round(vol_ratio, 3) AS vol_ratio, round(j, 1) + 0.0 AS j FROM b1 LEFT JOIN instruments USING (ts_code) WHERE b1"))
def screen_files(spark, sf_dir):
    """The B1 screen's hits as a folder of CSVs for each date, numbers rounded, read back."""
    path = tables.scratch(spark, "screens")
    hits = tables.with_names(frames.wide(spark, sf_dir).where(screens.is_b1()), panel.instruments(spark, sf_dir)).select("trade_date", "ts_code", "name", "close", "vol_ratio", "j")
    tables.write_screen(hits, path, {"close": 2, "vol_ratio": 3, "j": 1})
    out = spark.read.csv(path, header=True, schema="ts_code string, name string, close double, vol_ratio double, j double, trade_date date")
    return rounded(out.select("trade_date", "ts_code", "name", "close", "vol_ratio", "j"), 3)


@query(with_(["b1", "instruments"], f"SELECT {d()}, row_number() OVER (PARTITION BY t.trade_date ORDER BY j, ts_code) AS place, ts_code, name, {r('j')} FROM b1 t LEFT JOIN instruments USING (ts_code) WHERE b1"))
def nested_files(spark, sf_dir):
    """The B1 screen's hits as one JSON object a date, its rows nested in the order of J, read back and unfolded."""
    path = tables.scratch(spark, "nested")
    hits = tables.with_names(frames.wide(spark, sf_dir).where(screens.is_b1()), panel.instruments(spark, sf_dir)).select("trade_date", "j", "ts_code", "name")
    tables.write_nested(hits, path, ["trade_date"], "hits", ["j", "ts_code"])
    out = spark.read.json(path, schema="hits array<struct<j:double,ts_code:string,name:string>>, trade_date date")
    return rounded(out.select("trade_date", F.posexplode("hits").alias("place", "hit")).select("trade_date", (F.col("place") + 1).alias("place"), "hit.ts_code", "hit.name", "hit.j"))


@query(with_(["calendar"], f"SELECT {d('trade_date').replace('AS trade_date', 'AS cal_date')} FROM calendar t WHERE trade_index % 7 <> 3 AND t.trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"))
def open_sessions(spark, sf_dir):
    """Open dates of one of two exchanges in a range."""
    c = panel.calendar(panel.bars(spark, sf_dir)).select(F.col("trade_date").alias("cal_date"), "trade_index")
    both = c.select(F.lit("SSE").alias("exchange"), "cal_date", F.when(F.col("trade_index") % 7 == 3, 0).otherwise(1).alias("is_open")).union(c.select(F.lit("SZSE"), F.date_add("cal_date", 1), F.lit(1)))
    return rounded(tables.open_dates(both, "SSE", "1996-01-01", "1999-12-31"))


@query(with_(["nd", "b1", "pit", "instruments"], f""", p AS (SELECT trade_date AS signal_date, ts_code, pr, row_number() OVER (PARTITION BY trade_date ORDER BY pr DESC, ts_code) AS prediction_rank FROM (SELECT nd.trade_date, ts_code, floor({_PROB} * 1e6 + 0.5) / 1e6 AS pr FROM nd SEMI JOIN (SELECT * FROM pit WHERE signal = 1) g USING (ts_code, trade_date) WHERE {_KNOWN}))
SELECT {d('signal_date')}, ts_code AS canonical_code, prediction_rank, b.ts_code IS NOT NULL AS has_signal FROM p LEFT JOIN instruments USING (ts_code) LEFT JOIN (SELECT ts_code, trade_date AS signal_date FROM b1 WHERE b1) b USING (ts_code, signal_date) WHERE industry IS NULL"""))
def unclassified_predictions(spark, sf_dir):
    """Of the combined list, predictions for instruments without an industry."""
    named = _combined(spark, sf_dir).join(panel.instruments(spark, sf_dir).select(F.col("ts_code").alias("canonical_code"), "industry"), "canonical_code", "left")
    return rounded(comb.prediction_rows(named, codes.NO_INDUSTRY).select("signal_date", "canonical_code", "prediction_rank", "has_signal"))


_DATED = "SELECT 'b1' AS source, trade_date AS signal_date, ts_code, close, NULL::DOUBLE AS var2z FROM b1 WHERE b1 UNION ALL SELECT 'pit', trade_date, ts_code, NULL, var2z FROM pit WHERE signal = 1 UNION ALL SELECT 'cross', trade_date, ts_code, close, NULL FROM b1 JOIN gold USING (ts_code, trade_date) WHERE golden"


def _dated(spark, sf_dir):
    bars = panel.bars(spark, sf_dir)
    hits = ind.wide(bars).where(screens.is_b1()).select("ts_code", "trade_date", "close")
    pit = ind.golden_pit(bars).where("signal = 1").select("ts_code", "trade_date", "var2z")
    cross = ind.crosses(bars, 20, 60).where("golden").select("ts_code", "trade_date", "close")
    return comb.dated_rows({"b1": hits, "pit": pit, "cross": cross})


@query(with_(["b1", "pit", "gold"], f"SELECT source, {d('signal_date')}, ts_code, {r('close')}, {r('var2z')} FROM ({_DATED}) t"))
def dated_index(spark, sf_dir):
    """All dated lists as one table that can be searched."""
    return rounded(_dated(spark, sf_dir).select("source", "signal_date", "ts_code", "close", "var2z"))


@query(with_(["b1", "pit", "gold"], f"SELECT {d('signal_date')}, string_agg(DISTINCT source || '.csv', ',' ORDER BY source || '.csv') AS files, count(DISTINCT source) AS file_count, count(*) AS row_count, t.signal_date = max(t.signal_date) OVER () AS is_latest FROM ({_DATED}) t GROUP BY t.signal_date"))
def dated_manifest(spark, sf_dir):
    """Per date the files that hold its rows, their number and the rows."""
    m = tables.manifest(_dated(spark, sf_dir).withColumn("source_file", F.concat("source", F.lit(".csv"))))
    return rounded(m.withColumn("files", F.array_join("files", ",")))


@query(with_(["b1"], f"SELECT 'b1' AS strategy, ts_code, {d()}, {r('close')}, count(*) OVER () AS n FROM b1 WHERE b1"))
def signal_log(spark, sf_dir):
    """The B1 screen's hits written to the signal log twice, then its history and count."""
    path = tables.scratch(spark, "signals")
    hits = tables.written(frames.wide(spark, sf_dir).where(screens.is_b1()).select("ts_code", "trade_date", "close"), "hits")
    for at in ("2001-01-01 00:00:00", "2001-01-02 00:00:00"):
        tables.persist_signals(hits, path, "b1", at)
    log = spark.read.parquet(path)
    history = tables.signal_history(log, "b1")
    return rounded(history.join(F.broadcast(tables.signal_count(log, "b1"))).select("strategy", "ts_code", "trade_date", "close", "n"))


@query(with_(["b1"], "SELECT ts_code, count(*) AS n, string_agg(strftime(trade_date, '%Y%m%d'), ',' ORDER BY trade_date) AS dates FROM b1 WHERE b1 GROUP BY ts_code"))
def signal_dates(spark, sf_dir):
    dates = comb.signal_dates(frames.wide(spark, sf_dir).where(screens.is_b1()))
    return rounded(dates.select("ts_code", F.size("dates").alias("n"), F.array_join(F.transform("dates", lambda x: F.date_format(x, "yyyyMMdd")), ",").alias("dates")))


@query(with_(["nd", "b1", "pit"], f""", s AS (SELECT trade_date AS signal_date, ts_code FROM b1 WHERE b1), p AS (SELECT trade_date AS signal_date, ts_code, pr, row_number() OVER (PARTITION BY trade_date ORDER BY pr DESC, ts_code) AS prediction_rank FROM (SELECT nd.trade_date, ts_code, floor({_PROB} * 1e6 + 0.5) / 1e6 AS pr FROM nd SEMI JOIN (SELECT * FROM pit WHERE signal = 1) g USING (ts_code, trade_date) WHERE {_KNOWN}))
SELECT {d('signal_date')}, ts_code AS canonical_code, pr AS prob_up, prediction_rank, has_signal, row_number() OVER (PARTITION BY t.signal_date ORDER BY prediction_rank NULLS LAST, ts_code) AS position FROM (
  SELECT signal_date, ts_code, pr, prediction_rank, s.ok IS NOT NULL AS has_signal FROM (SELECT *, true AS ok FROM s) s FULL JOIN p USING (signal_date, ts_code)) t"""))
def combine_predictions(spark, sf_dir):
    """B1 hits annotated with predictions for golden-pit instruments; predictions without a hit stay."""
    return rounded(_combined(spark, sf_dir).select("signal_date", "canonical_code", "prob_up", "prediction_rank", "has_signal", "position"))


def _combined(spark, sf_dir):
    bars = tables.written(panel.bars(spark, sf_dir), "bars")
    pit = ind.golden_pit(bars).where("signal = 1").select("ts_code", "trade_date")
    scored = comb.rows_of_pairs(nd.score(_FIXED, nd.dataset(bars)), pit)
    pred = scored.select(F.col("trade_date").alias("signal_date"), "ts_code", (F.floor(F.col("prob_up") * 1e6 + 0.5) / 1e6).alias("prob_up"), "reasons")
    hits = ind.wide(bars).where(screens.is_b1()).select(F.col("trade_date").alias("signal_date"), "ts_code")
    return comb.combine(hits, pred)


@query(with_(["bars"], f"SELECT strftime(date_trunc('month', trade_date), '%Y%m%d') AS trade_month, count(*) AS row_count, count(DISTINCT ts_code) AS instruments, {r('sum(amount) / 1e6', 'amount_m')}, date_trunc('month', trade_date) = max(date_trunc('month', trade_date)) OVER () AS is_latest FROM bars GROUP BY date_trunc('month', trade_date)"))
def month_manifest(spark, sf_dir):
    """What a manifest of the bar table's partitions holds."""
    m = panel.bars(spark, sf_dir).groupBy(F.trunc("trade_date", "MM").alias("trade_month")).agg(F.count("*").alias("row_count"), F.countDistinct("ts_code").alias("instruments"), (F.sum("amount") / 1e6).alias("amount_m"))
    return rounded(m.withColumn("is_latest", F.col("trade_month") == F.max("trade_month").over(Window.partitionBy())))


@query(with_(["calendar", "tech"], f"SELECT {d('trade_date')}, 0.0::DOUBLE AS daily_return, 1.0::DOUBLE AS nav, 0.0::DOUBLE AS drawdown FROM (SELECT trade_date FROM calendar WHERE trade_date NOT IN (SELECT trade_date FROM tech WHERE breakout_signal)) t"))
def cash_days(spark, sf_dir):
    """The cash curve over the dates on which no breakout fires."""
    bars = panel.bars(spark, sf_dir)
    busy = ind.breakout_and_trend(ind.reversal_features(bars)).where("breakout_signal").select("trade_date").distinct()
    return rounded(bt.cash_curve(panel.calendar(bars).join(F.broadcast(busy), "trade_date", "left_anti")))


@query(with_(["b1", "pit", "members", "boards"], "SELECT ts_code FROM b1 WHERE b1 UNION SELECT ts_code FROM pit WHERE signal = 1 UNION SELECT ts_code FROM members SEMI JOIN (SELECT * FROM boards WHERE rank <= 10) b USING (trade_date, concept_code)"))
def exported_codes(spark, sf_dir):
    """Distinct codes that any of three lists names; of boards, the leading ten of each date."""
    bars = panel.bars(spark, sf_dir)
    hits = ind.wide(bars).where(screens.is_b1())
    pit = ind.golden_pit(bars).where("signal = 1")
    members = panel.concept_members(spark, sf_dir)
    return comb.distinct_codes(hits, pit, sec.leading_members(sec.rank_boards(members, bars), members))


@query(with_(["bars"], f"SELECT ts_code, {d()}, {r('CASE WHEN base > 0 THEN (close / base - 1) * 100 END', 'change_pct')} FROM (SELECT *, coalesce(CASE WHEN pre_close > 0 THEN pre_close END, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date)) AS base FROM bars)"))
def bar_change(spark, sf_dir):
    """A bar's change from its previous close, or from the bar before where that is missing."""
    return rounded(ind.bar_change(panel.bars(spark, sf_dir)).select("ts_code", "trade_date", "change_pct"))
