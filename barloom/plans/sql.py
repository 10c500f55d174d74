"""Building blocks of the SQL that gives the queries' rows again: common table expressions by name."""

from __future__ import annotations

#: An instrument's rows in date order.
S = "PARTITION BY ts_code ORDER BY trade_date"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], text: str) -> None:
    CTES[name] = (needs, text)


def full(fn: str, c: str, n: int) -> str:
    """A rolling value, null until n values are there."""
    w = f"OVER ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} = {n} THEN {fn}({c}) {w} END"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({S})"


def lead(c: str, n: int = 1) -> str:
    return f"lead({c}, {n}) OVER ({S})"


def r(c: str, name: str | None = None, digits: int = 6) -> str:
    return f"floor(({c}) * 1e{digits} + 0.5) / 1e{digits} AS {name or c}"


def d(c: str = "trade_date") -> str:
    return f"strftime({c}, '%Y%m%d') AS {c}"


def up(a: str, b: str) -> str:
    return f"coalesce({a} > {b} AND {lag(a)} <= {lag(b)}, false)"


def with_(needs: list[str], text: str) -> str:
    """A query over named blocks, with all that they need before them."""
    order: list[str] = []

    def add(n):
        for x in CTES[n][0]:
            add(x)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + text


def _code(key: str) -> str:
    return f"['600','300','688','920'][{key} % 4 + 1] || CASE WHEN length({key}::VARCHAR) < 3 THEN lpad({key}::VARCHAR, 3, '0') ELSE {key}::VARCHAR END || '.' || ['SH','SZ','SH','BJ'][{key} % 4 + 1]"


cte("raw_bars", [], f"""SELECT {_code("l_suppkey")} AS ts_code, date_trunc('week', l_shipdate)::DATE AS trade_date,
  arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close,
  sum(l_quantity) AS vol, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount
  FROM lineitem GROUP BY ALL""")
cte("bars", ["raw_bars"], f"SELECT *, close - pre_close AS change, (close / pre_close - 1) * 100 AS pct_chg FROM (SELECT *, {lag('close')} AS pre_close FROM raw_bars)")
cte("instruments", [], f"""SELECT {_code("s_suppkey")} AS ts_code, split_part({_code("s_suppkey")}, '.', 1) AS symbol,
  CASE WHEN s_suppkey % 17 = 3 THEN '*ST ' || s_name ELSE s_name END AS name, r_name AS area,
  CASE WHEN s_suppkey % 19 = 5 THEN NULL ELSE n_name END AS industry
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("calendar", ["bars"], "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS trade_index FROM (SELECT DISTINCT trade_date FROM bars)")
cte("rsv", ["bars"], f"""SELECT *, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 END AS rsv
  FROM (SELECT *, {full('max', 'high', 9)} AS hi, {full('min', 'low', 9)} AS lo FROM bars)""")
cte("kdj", ["rsv"], f"""SELECT ts_code, trade_date, k, d, 3 * k - 2 * d AS j FROM (
  SELECT *, pow(2/3, n) * (50 + sum(k * pow(1.5, n) / 3) OVER ({S})) AS d FROM (
  SELECT *, pow(2/3, n) * (50 + sum(rsv * pow(1.5, n) / 3) OVER ({S})) AS k FROM (
  SELECT ts_code, trade_date, rsv, row_number() OVER ({S}) AS n FROM rsv WHERE rsv IS NOT NULL)))""")
_ema = lambda x: f"pow(9/11, n) * (first({x}) OVER ({S}) + coalesce(sum(CASE WHEN n > 0 THEN {x} * pow(11/9, n) * 2 / 11 END) OVER ({S}), 0))"
cte("lines", ["bars"], f"""SELECT ts_code, trade_date, {_ema('e1')} AS trend_short, bull_bear FROM (
  SELECT *, {_ema('close')} AS e1 FROM (
  SELECT *, row_number() OVER ({S}) - 1 AS n, ({" + ".join(f"({full('avg', 'close', n)})" for n in (14, 28, 57, 114))}) / 4 AS bull_bear FROM bars))""")
cte("pit0", ["bars"], f"SELECT *, close - lcf AS diff, greatest(high - low, abs(high - lcf), abs(low - lcf)) AS tr, high - {lag('high')} AS hd, {lag('low')} - low AS ld FROM (SELECT *, {lag('close')} AS lcf, count(*) OVER (PARTITION BY ts_code) AS bars_in_all FROM bars)")
cte("pit1", ["pit0"], f"""SELECT *, greatest(diff, 0) * (CASE WHEN diff IS NULL THEN NULL ELSE 1 END) AS gain, abs(diff) AS move,
  CASE WHEN hd IS NULL THEN NULL WHEN hd > 0 AND hd > ld THEN hd ELSE 0 END AS dmp, CASE WHEN ld IS NULL THEN NULL WHEN ld > 0 AND ld > hd THEN ld ELSE 0 END AS dmm FROM pit0""")
cte("pit2", ["pit1"], f"""SELECT *, rs_up / nullif(rs_all, 0) * 100 AS rsi5, dp * 100 / nullif(trs, 0) AS pdi, dm * 100 / nullif(trs, 0) AS mdi, 100 * (hi60 - close) / nullif(hi60 - lo60, 0) AS wr60 FROM (
  SELECT *, {full('sum', 'gain', 5)} AS rs_up, {full('sum', 'move', 5)} AS rs_all, {full('sum', 'tr', 10)} AS trs, {full('sum', 'dmp', 10)} AS dp, {full('sum', 'dmm', 10)} AS dm,
  {full('max', 'high', 60)} AS hi60, {full('min', 'low', 60)} AS lo60 FROM pit1)""")
cte("pit3", ["pit2"], f"SELECT *, {full('avg', 'dx', 5)} AS adx FROM (SELECT *, abs(mdi - pdi) / nullif(mdi + pdi, 0) * 100 AS dx FROM pit2)")
cte("pit4", ["pit3"], f"SELECT *, CASE WHEN coalesce(osc > 0 AND {lag('osc')} <= 0, false) THEN 1.0 ELSE 0.0 END AS fired FROM (SELECT *, 2 * rsi5 + adx - wr60 AS osc FROM pit3)")
cte("pit5", ["pit4"], f"SELECT *, {full('avg', 'v1', 8)} AS var2z FROM (SELECT *, {full('avg', 'fired', 8)} AS v1 FROM pit4)")
cte("pit6", ["pit5"], f"SELECT *, {full('avg', 'var2z', 10)} AS var3z FROM pit5")
cte("pit", ["pit6"], f"SELECT ts_code, trade_date, var2z, var3z, signal FROM (SELECT *, CASE WHEN {up('var2z', 'var3z')} AND var2z < 40 THEN 1 ELSE 0 END AS signal FROM pit6) WHERE bars_in_all >= 60 AND NOT (var2z IS NULL AND var3z IS NULL)")
# the index multiplies in the order of dates, as a window's product() may not
cte("r1a", ["bars"], f"SELECT *, idx * open / close AS idx_open, {full('avg', 'amount', 20)} AS amount20 FROM (SELECT *, list_aggregate(list(1 + greatest(coalesce(pct_chg / 100, 0), -0.95)) OVER ({S}), 'product') AS idx FROM bars)")
cte("r1b", ["r1a"], f"SELECT *, {lag('idx', 5)} / {lag('idx', 65)} - 1 AS formation, idx / {lag('idx', 20)} - 1 AS ret20 FROM r1a")
cte("r1", ["r1b"], "SELECT *, median(ret20) OVER (PARTITION BY trade_date) AS median20 FROM r1b")
cte("tech0", ["r1"], f"""SELECT *, idx * high / close AS idx_high, vol / nullif({full('avg', 'vol', 20)}, 0) AS vol_ratio20,
  {full('avg', 'idx', 20)} AS tma20, {full('avg', 'idx', 60)} AS tma60, {full('avg', 'idx', 120)} AS tma120, idx / {lag('idx', 120)} - 1 AS ret120, pct_chg / 100 AS pr FROM r1""")
cte("tech1", ["tech0"], f"""SELECT *, CASE WHEN count(idx_high) OVER ({S} ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) = 55 THEN max(idx_high) OVER ({S} ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) END AS high55,
  {full('stddev_samp', 'pr', 20)} AS vol20, {lag('tma120', 20)} AS tma120_prev FROM tech0""")
cte("tech2", ["tech1"], """SELECT *, coalesce(idx > high55 AND vol_ratio20 >= 1.5 AND amount20 >= 100000 AND median20 > 0, false) AS brk,
  coalesce(tma20 > tma60 AND tma60 > tma120 AND tma120 > tma120_prev AND ret120 > 0 AND amount20 >= 100000 AND median20 > 0, false) AS trd FROM tech1""")
cte("tech", ["tech2"], f"SELECT *, brk AND NOT coalesce({lag('brk')}, false) AS breakout_signal, (idx / high55 - 1) * 100 AS breakout_strength, trd AND NOT coalesce({lag('trd')}, false) AS trend_signal, ret120 / greatest(vol20, 0.005) AS trend_score FROM tech2")
cte("fwd", ["bars"], f"SELECT *, {', '.join(f'{lead("open", i)} AS open_t{i}' for i in range(1, 11))}, {lead('low')} AS low_t1 FROM bars")
_stop = lambda h: "coalesce(" + ", ".join(f"CASE WHEN open_t{i} < low_t1 THEN open_t{i} END" for i in range(2, h)) + (", " if h > 2 else "") + f"open_t{h})"
cte("wide", ["bars", "kdj", "lines"], f"""SELECT b.*, k, d, j, trend_short, bull_bear, vol / nullif(vol_ma5, 0) AS vol_ratio FROM (
  SELECT *, {full('avg', 'vol', 5)} AS vol_ma5, {full('avg', 'close', 60)} AS ma60, {full('avg', 'close', 20)} AS ma20 FROM bars) b
  LEFT JOIN kdj USING (ts_code, trade_date) LEFT JOIN lines USING (ts_code, trade_date)""")
cte("b1", ["wide"], "SELECT *, coalesce(vol_ratio < 1 AND j < 15 AND close > ma60 AND trend_short > bull_bear AND close > bull_bear, false) AS b1 FROM wide")
cte("b1fwd", ["b1", "fwd"], "SELECT b1.*, " + ", ".join(f"fwd.open_t{i}" for i in range(1, 11)) + ", fwd.low_t1 FROM b1 JOIN fwd USING (ts_code, trade_date)")
cte("ends", ["bars"], "SELECT max(trade_date) AS trade_date FROM bars GROUP BY date_trunc('month', trade_date) HAVING date_trunc('month', max(trade_date)) < (SELECT date_trunc('month', max(trade_date)) FROM bars)")
cte("losers", ["r1", "ends"], """SELECT * FROM (SELECT *, (rank() OVER (PARTITION BY trade_date ORDER BY formation) + (count(*) OVER (PARTITION BY trade_date, formation) - 1) / 2) / count(*) OVER (PARTITION BY trade_date) AS share
  FROM r1 SEMI JOIN ends USING (trade_date) WHERE close >= 2 AND amount20 >= 100000 AND formation IS NOT NULL) WHERE share <= 0.10""")
cte("r1sel", ["losers"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount20 DESC, ts_code) AS position FROM losers WHERE median20 > 0) WHERE position <= 20")
_all = f"""SELECT t.*, {lead('close', 20)} AS close20, {lead('trade_index', 20)} AS i20, {lead('idx_open', 21)} / {lead('idx_open')} - 1 AS oret, {lead('trade_index', 21)} AS i21, {lead('idx_open', 64)} / {lead('idx_open')} - 1 AS vret, {lead('trade_index', 64)} AS i64,
  {lead('trade_index', 2)} AS x2, {lead('trade_index', 3)} AS x3, {lead('trade_index', 4)} AS x4, {lead('open', 1)} AS open_t1, {lead('open', 2)} AS open_t2, {lead('open', 3)} AS open_t3, {lead('open', 4)} AS open_t4, {lead('low')} AS low_t1
  FROM tech t JOIN calendar USING (trade_date)"""
cte("feat0", ["tech", "calendar"], _all.replace("SELECT t.*", "SELECT t.*, trade_index"))
cte("feat", ["feat0", "b1", "r1sel", "value_hits"], f"""SELECT f.*, b1.b1, coalesce(b1.trend_short < b1.bull_bear AND b1.bull_bear > 0, false) AS b2, b1.trend_short, b1.bull_bear, b1.j, b1.vol_ratio, b1.ma60, b1.ma20, r.position IS NOT NULL AS r1, v.position IS NOT NULL AS value_quality,
  {_stop(4)} / open_t1 - 1 AS sret, CASE WHEN coalesce(open_t2 < low_t1, false) THEN x2 WHEN coalesce(open_t3 < low_t1, false) THEN x3 ELSE x4 END AS sx
  FROM feat0 f JOIN b1 USING (ts_code, trade_date) LEFT JOIN r1sel r USING (ts_code, trade_date) LEFT JOIN value_hits v USING (ts_code, trade_date)""")
cte("gold", ["b1"], f"SELECT ts_code, trade_date, {up('ma20', 'ma60')} AS golden FROM b1")
_one = lambda n, hit, ret, at: f"SELECT '{n}' AS strategy, ts_code, trade_date, trade_index, CASE WHEN {ret} IS NOT NULL THEN {at} END AS exit_index, {hit} AS is_signal, {ret} AS ret FROM feat JOIN gold USING (ts_code, trade_date)"
cte("strat", ["feat", "gold"], " UNION ALL ".join([_one("ma20_ma60", "golden", "(close20 / open_t1 - 1)", "i20"), _one("b2", "b2", "sret", "sx"), _one("b1", "b1", "sret", "sx"), _one("r1", "r1", "oret", "i21"), _one("breakout", "breakout_signal", "oret", "i21"), _one("trend", "trend_signal", "oret", "i21"), _one("value_quality", "value_quality", "vret", "i64")]))
