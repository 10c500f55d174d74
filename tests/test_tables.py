"""Sources, sinks and the streaming refresh."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barloom.sources import tables
from barloom.streaming import ingest

BAR = "ts_code string, trade_date date, close double, ingest_ts timestamp"


def bars(spark, rows):
    return spark.createDataFrame([(c, date(2024, m, d), x, datetime(2024, 6, v)) for c, m, d, x, v in rows], BAR).withColumn("trade_month", F.trunc("trade_date", "MM"))


def read(spark, path):
    return sorted((r.ts_code, r.trade_date.month, r.trade_date.day, r.close) for r in spark.read.parquet(path).collect())


@pytest.fixture
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))


def test_upsert_last_write_wins_and_is_idempotent(spark, tmp_path, checkpoints):
    path = str(tmp_path / "bars")
    tables.upsert(bars(spark, [("a", 1, 2, 1.0, 1), ("a", 1, 2, 2.0, 2), ("b", 2, 1, 3.0, 1)]), path, ["ts_code", "trade_date"], "trade_month")
    assert read(spark, path) == [("a", 1, 2, 2.0), ("b", 2, 1, 3.0)]
    new = bars(spark, [("a", 1, 2, 9.0, 3), ("c", 1, 5, 4.0, 3)])
    for _ in range(2):
        tables.upsert(new, path, ["ts_code", "trade_date"], "trade_month")
        assert read(spark, path) == [("a", 1, 2, 9.0), ("b", 2, 1, 3.0), ("c", 1, 5, 4.0)]
    old = bars(spark, [("a", 1, 2, 7.0, 1)])
    tables.upsert(old, path, ["ts_code", "trade_date"], "trade_month")
    assert ("a", 1, 2, 9.0) in read(spark, path)
    loaded = tables.load_bars(spark, path, "2024-01-03", "2024-02-28", ["ts_code", "close"])
    assert sorted(r.ts_code for r in loaded.collect()) == ["b", "c"]
    assert "PartitionFilters: [isnotnull" in loaded._jdf.queryExecution().executedPlan().toString()


def test_replace_dates(spark, tmp_path):
    path = str(tmp_path / "boards")
    day = lambda d, x: spark.createDataFrame([(date(2024, 1, d), x)], "trade_date date, v int")
    for df in (day(1, 1), day(2, 2), day(1, 3)):
        tables.replace_dates(df, path)
    assert sorted((r.trade_date.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, 3), (2, 2)]


def test_stream_refresh(spark, tmp_path, checkpoints):
    landed, table, state = (str(tmp_path / x) for x in ("landed", "table", "state"))
    make = lambda code, close, v: spark.createDataFrame([(code, date(2024, 1, 2), close, close, close, close, None, 1.0, 1.0, datetime(2024, 6, v))], ingest.BAR_SCHEMA)
    make("a", 1.0, 1).write.mode("append").parquet(landed)
    touched = []
    run = lambda: ingest.refresh_bars(spark, landed, table, state, lambda t: touched.append({r.ts_code for r in t.collect()})).awaitTermination()
    run()
    make("a", 5.0, 2).union(make("b", 2.0, 2)).write.mode("append").parquet(landed)
    run()
    run()
    assert read(spark, table) == [("a", 1, 2, 5.0), ("b", 1, 2, 2.0)]
    assert touched == [{"a"}, {"a", "b"}]
    df = ingest.recompute(spark.read.parquet(table), spark.createDataFrame([("b",)], "ts_code string"), lambda b: b)
    assert [r.ts_code for r in df.collect()] == ["b"]


def test_dated_csvs_pool_and_manifest(spark, tmp_path):
    files = {"b1_20240103.csv": "﻿ts_code,name\n 600000.sh ,A\n,B\n600000.SH,A\n", "b1_20240105.csv": "ts_code,name,close\n000001.SZ,C,1.5\n", "b1_x.csv": "ts_code,name\n1,D\n", "b1_1202401055.csv": "ts_code,name\n2,E\n"}
    paths = []
    for n, text in files.items():
        (tmp_path / n).write_text(text, encoding="utf-8")
        paths.append(str(tmp_path / n))
    df = tables.read_dated_csvs(spark, paths)
    assert {r.source_file: r.signal_date for r in df.collect()} == {"b1_20240103.csv": date(2024, 1, 3), "b1_20240105.csv": date(2024, 1, 5), "b1_x.csv": None, "b1_1202401055.csv": None}
    pool = tables.load_pool(spark, paths, "2024-01-01", "2024-01-04")
    assert [(r.trade_date, r.ts_code) for r in pool.collect()] == [(date(2024, 1, 3), "600000.SH")]
    m = {r.signal_date: (r.file_count, r.row_count, r.is_latest) for r in tables.manifest(df.where("signal_date IS NOT NULL")).collect()}
    assert m == {date(2024, 1, 3): (1, 3, False), date(2024, 1, 5): (1, 1, True)}
    (tmp_path / "bad_20240103.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        tables.load_pool(spark, [str(tmp_path / "bad_20240103.csv")], "2024-01-01", "2024-01-04")


def test_screen_and_nested_sinks(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 1), "a", 1.23456), (date(2024, 1, 1), "b", 2.0)], "trade_date date, ts_code string, close double")
    for _ in range(2):
        tables.write_screen(df, str(tmp_path / "csv"), {"close": 2})
        tables.write_nested(df, str(tmp_path / "json"), ["trade_date"], "items")
    got = spark.read.csv(str(tmp_path / "csv"), header=True).collect()
    assert sorted((r.ts_code, r.close) for r in got) == [("a", "1.23"), ("b", "2.0")]
    nested = spark.read.json(str(tmp_path / "json")).collect()
    assert len(nested) == 1 and [s.ts_code for s in nested[0]["items"]] == ["a", "b"]


def test_snapshot_page(spark):
    html = """<html><input type="hidden" id="board" value='{"1":{"name":"AI","pct_chg":"1.5","net_inflow":"--"},"2":{"name":" ","pct_chg":"2"},"3":{"name":"Z","pct_chg":""},"4":{"name":"Test x","pct_chg":"1"}}'></html>"""
    df = spark.createDataFrame([(1, html), (2, "<html></html>")], "i int, html string")
    got = tables.parse_snapshot(df, "html", "board", {"name": "name"}, {"pct_chg": "pct_chg", "net_inflow": "net_inflow"}, ("name", "pct_chg"), keep_prefixes_out=("Test",)).collect()
    assert [(r.i, r.key, r.name, r.pct_chg, r.net_inflow) for r in got] == [(1, "1", "AI", 1.5, None)]


def test_pending_days_and_history(spark):
    b = spark.createDataFrame([(date(2024, 1, 4),)], "trade_date date")
    assert [r.trade_date.day for r in tables.pending_days(b, "2024-01-09").orderBy("trade_date").collect()] == [5, 8, 9]
    assert tables.pending_days(b, "2024-01-01").count() == 0
    log = spark.createDataFrame([("b1", "a", date(2024, 1, 1)), ("b1", "b", date(2024, 1, 2)), ("b2", "a", date(2024, 1, 3))], "strategy string, ts_code string, trade_date date")
    assert tables.signal_history(log, "b1").count() == 2 and tables.signal_history(log, "b1", "a", "2024-01-01", "2024-01-01").count() == 1
    cal = spark.createDataFrame([("SSE", date(2024, 1, 1), 0), ("SSE", date(2024, 1, 2), 1), ("X", date(2024, 1, 2), 1)], "exchange string, cal_date date, is_open int")
    assert [r.cal_date.day for r in tables.open_dates(cal, "SSE", "2024-01-01", "2024-01-31").collect()] == [2]


def test_signals_logged_twice_count_once(spark, tmp_path):
    hits = spark.createDataFrame([("A", "2024-01-05", 1.5), ("B", "2024-02-06", 2.5)], "ts_code string, trade_date string, close double").withColumn("trade_date", F.col("trade_date").cast("date"))
    path = f"{tmp_path}/log"
    tables.persist_signals(hits, path, "b1", "2024-03-01 00:00:00")
    tables.persist_signals(hits.withColumn("close", F.col("close") + 1), path, "b1", "2024-03-02 00:00:00")
    tables.persist_signals(hits.limit(1), path, "b2", "2024-03-02 00:00:00")
    log = spark.read.parquet(path)
    assert [(r.ts_code, r.close) for r in tables.signal_history(log, "b1").collect()] == [("A", 2.5), ("B", 3.5)]
    assert tables.signal_count(log, "b1").first().n == 2 and tables.signal_count(log, "b1", start="2024-02-01").first().n == 1 and tables.signal_count(log, "b2").first().n == 1


def test_no_local_folder_on_a_cluster(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        tables.shared_folder(Cluster)


def test_pages_in_any_form(spark):
    head = "<input id=x value='{}'>"
    pages = [
        (1, head + """<INPUT type=hidden VALUE = "{&quot;1&quot;:{&quot;n&quot;:&quot;A &amp;amp; B&#33;&quot;,&quot;v&quot;:1.5}}" ID = 'board' >"""),
        (2, """<input id="board" data-a='>' value='{"2":{"n":"C&#x4e2d;","v":"--"}}'/>""" + head),
        (3, """<input id=board value='{"3":{"n":"old"}}'><input value='{"4":{"n":"last","v":"2"}}' id=board>"""),
        (4, "<input id='boards' value='{}'>"), (5, "<input id='board' value='no json'>"), (6, None), (7, "<input id='board'>"), (8, "<input id='board' value='{&#0;}'>"),
    ]
    df = spark.createDataFrame(pages, "i int, html string")
    got = tables.parse_snapshot(df, "html", "board", {"name": "n"}, {"change": "v"}).collect()
    assert sorted((r.i, r.key, r.name, r.change) for r in got) == [(1, "1", "A &amp; B!", 1.5), (2, "2", "C中", None), (3, "4", "last", 2.0)]
    assert tables.parse_snapshot(df, "html", "board", {"name": "n"}, {"change": "v"}, required=("change",), keep_prefixes_out=("last",)).count() == 1
    long = "<input " + "a='b' " * 20_000 + "id='board' value='{\"1\":{\"n\":\"x\"}}'>" + "<p>&#33;" * 20_000
    assert tables.parse_snapshot(spark.createDataFrame([(1, long)], "i int, html string"), "html", "board", {"name": "n"}, {}).count() == 1


def test_encodings_and_headers_of_csvs(spark, tmp_path):
    rows = {"a_20240101.csv": "代码,名称\n600000,浦发银行\n".encode("gb18030"), "b_20240102.csv": "代码,note\n1,\"x,\ny\"\n2\n\n".encode("utf-8-sig"), "c.csv": b"", "d_20240103.csv": "代码,代码\n7,8\n".encode()}
    for name, content in rows.items():
        (tmp_path / name).write_bytes(content)
    df = tables.read_dated_csvs(spark, [str(tmp_path / n) for n in rows])
    assert set(df.columns) == {"代码", "名称", "note", "source_file", "signal_date"}
    by = {(r["代码"], r.note) for r in df.collect()}
    assert by == {("600000", None), ("1", "x,\ny"), ("2", ""), ("7", None)}
    (tmp_path / "bad.csv").write_bytes(b"a\n\xff\xff\xff\n")
    with pytest.raises(Exception, match="none of"):
        tables.read_dated_csvs(spark, [str(tmp_path / "bad.csv")]).collect()


def test_a_broken_write_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    key = ["ts_code", "trade_date"]
    tables.upsert(bars(spark, [("a", 1, 2, 1.0, 1), ("b", 2, 1, 3.0, 1)]), path, key, "trade_month")
    before = read(spark, path)
    broken = bars(spark, [("a", 1, 2, 9.0, 3), ("c", 3, 1, 9.0, 3)]).withColumn("close", F.when(F.col("ts_code") == "c", F.raise_error(F.lit("no"))).otherwise(F.col("close")).cast("double"))
    with pytest.raises(Exception, match="no"):
        tables.upsert(broken, path, key, "trade_month")
    assert read(spark, path) == before and not [p for p in (tmp_path / "bars").iterdir() if p.name.startswith("_staged")]
    # what is staged whole, but put in place in part only, is finished by the next reader
    new = bars(spark, [("a", 1, 2, 5.0, 4), ("d", 4, 1, 6.0, 4)])
    new.write.partitionBy("trade_month").parquet(f"{path}/_ready-x")
    (tmp_path / "bars" / "trade_month=2024-01-01").rename(tmp_path / "moved")
    assert read(spark, path) == [("b", 2, 1, 3.0)]
    got = sorted((r.ts_code, r.close) for r in tables.read_table(spark, path).collect())
    assert got == [("a", 5.0), ("b", 3.0), ("d", 6.0)] and tables.finish_swaps(spark, path) == 0


def test_refresh_of_some_entries(spark):
    schema = "id string, entries array<struct<code:string,n:int>>, version int, note string"
    stored = spark.createDataFrame([("x", [("a", 1), ("b", 2)], 1, "keep"), ("y", [("c", 3)], 1, None), ("z", None, 1, "n")], schema)
    fresh = spark.createDataFrame([("x", [("b", 9), ("d", 4)], 2), ("w", [("e", 5)], 2), ("z", [("f", 6)], None)], "id string, entries array<struct<code:string,n:int>>, version int")
    got = {r.id: ([tuple(e) for e in r.entries], r.version, r.note) for r in tables.refresh_documents(stored, fresh, "id", "entries", "code").collect()}
    assert got == {"x": ([("a", 1), ("b", 9), ("d", 4)], 2, "keep"), "y": ([("c", 3)], 1, None), "w": ([("e", 5)], 2, None), "z": ([("f", 6)], 1, "n")}
    gone = spark.createDataFrame([("x", "a"), ("y", "q")], "id string, code string")
    got = {r.id: [e.code for e in r.entries] for r in tables.refresh_documents(stored, fresh, "id", "entries", "code", gone).collect()}
    assert got["x"] == ["b", "d"] and got["y"] == ["c"]


def test_stored_indicators_need_no_shuffle(spark, tmp_path):
    from barloom.functions.exprs import before
    from barloom.sources import stored

    rows = spark.createDataFrame([(f"i{k % 7}", date(2024, 1, 1 + k // 7), float(k)) for k in range(70)], "ts_code string, trade_date date, k double")
    stored.store_indicator(rows, "k_table", str(tmp_path / "k"), 4)
    out = stored.load_indicator(spark, "k_table", start="2024-01-02").withColumn("b", before("k"))
    assert out.count() == 63 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert stored.load_indicator(spark, "k_table", "i3", "2024-01-02", "2024-01-04", ["k"]).count() == 3
    spark.sql("DROP TABLE k_table")
    stored.attach(spark, "k_again", "ts_code string, trade_date date, k double", str(tmp_path / "k"), 4)
    assert stored.load_indicator(spark, "k_again").count() == 70


def test_refresh_compares_no_entry_with_all_others(spark):
    """Entries meet by a join, nulls and dropped ones included; no array is searched for each entry of another."""
    kind = "key string, entries array<struct<e:string,v:long>>, version long"
    stored = spark.createDataFrame([("a", [("x", 1), (None, 2), ("y", 3), ("z", 4)], 1), ("b", [("x", 5)], 1)], kind)
    fresh = spark.createDataFrame([("a", [("y", 30), ("w", 31)], 2), ("c", [("q", 6)], 2)], kind)
    drop = spark.createDataFrame([("a", "z"), ("b", "x")], "key string, e string")
    out = tables.refresh_documents(stored, fresh, "key", "entries", "e", drop)
    got = {r.key: (sorted([tuple(x) for x in r.entries], key=str), r.version) for r in out.collect()}
    assert got == {"a": ([("w", 31), ("x", 1), ("y", 30), (None, 2)], 2), "b": ([], 1), "c": ([("q", 6)], 2)}
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
