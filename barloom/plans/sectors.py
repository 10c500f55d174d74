"""Queries of industries and concept boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.codes import limit_rate
from ..functions.exprs import rounded
from ..operators import indicators as ind
from ..operators import screens
from ..operators import sectors as sec
from ..sources import panel, tables
from .registry import query
from .sql import cte, d, r, with_

cte("own", ["bars", "instruments", "calendar"], "SELECT bars.*, industry, trade_index FROM bars JOIN instruments USING (ts_code) JOIN calendar USING (trade_date) WHERE industry IS NOT NULL")
cte("served", ["own"], "SELECT ts_code, industry, trade_index, close, unnest(range(trade_index, least(trade_index + 19, (SELECT max(trade_index) FROM calendar)) + 1)) AS e FROM own")
cte("rets", ["served"], "SELECT e AS trade_index, industry, " + ", ".join(f"avg(CASE WHEN e >= {w - 1} THEN l{w} / f{w} - 1 END) AS return_{w}d" for w in (5, 10, 20)) + " FROM (SELECT e, industry, ts_code, " + ", ".join(f"arg_min(close, trade_index) FILTER (trade_index > e - {w}) AS f{w}, arg_max(close, trade_index) FILTER (trade_index > e - {w}) AS l{w}" for w in (5, 10, 20)) + " FROM served GROUP BY ALL) GROUP BY ALL")
cte("flat", ["own"], """SELECT trade_date, trade_index, industry, count(*) AS members, sum(amount) AS turnover, avg(CASE WHEN pct_chg > 0 THEN 1.0 ELSE 0.0 END) AS breadth, avg(CASE WHEN high >= top THEN 1.0 ELSE 0.0 END) AS new_high_ratio,
  1 / (least(CASE WHEN count(*) < 3 OR stddev_samp(pct_chg) = 0 THEN 1 WHEN avg(pct_chg) = 0 THEN 99 ELSE stddev_samp(pct_chg) / abs(avg(pct_chg)) END, 20) + 0.001) AS concentration, avg(pct_chg) - any_value(m) AS relative_strength
  FROM (SELECT *, max(high) OVER (PARTITION BY ts_code ORDER BY trade_index RANGE BETWEEN 62 PRECEDING AND CURRENT ROW) AS top, avg(pct_chg) OVER (PARTITION BY trade_date) AS m FROM own) GROUP BY ALL""")
cte("factors", ["flat", "rets"], "SELECT * FROM flat LEFT JOIN rets USING (trade_index, industry)")
_n = lambda c: f"CASE WHEN max(({c} IS NOT NULL)::INT) OVER (PARTITION BY trade_date) = 0 THEN 0 WHEN count(*) OVER (PARTITION BY trade_date) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY trade_date ORDER BY coalesce({c}, 0)) + (count(*) OVER (PARTITION BY trade_date, coalesce({c}, 0)) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY trade_date) - 1) END"
cte("ranked", ["factors"], "SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, industry) AS rank FROM (SELECT *, floor((" + " + ".join(f"{w} * ({_n(c)})" for c, w in sec.WEIGHTS.items()) + ") * 1e6 + 0.5) / 1e6 AS score FROM factors WHERE members >= 5)")


def bars_once(spark, sf_dir):
    """The panel written down, for what reads it several times."""
    return tables.written(panel.bars(spark, sf_dir), "bars")


def _factors(spark, sf_dir, bars=None):
    bars = bars_once(spark, sf_dir) if bars is None else bars
    return sec.factors(bars, panel.instruments(spark, sf_dir), panel.calendar(bars))


def ranking(spark, sf_dir, bars=None):
    return sec.rank(_factors(spark, sf_dir, bars))


_COLS = list(sec.WEIGHTS)


@query(with_(["factors"], f"SELECT {d()}, industry, members, {', '.join(r(c) for c in _COLS)} FROM factors"))
def sector_factors(spark, sf_dir):
    return rounded(_factors(spark, sf_dir).select("trade_date", "industry", "members", *_COLS))


@query(with_(["ranked"], f"SELECT {d()}, industry, score, rank, {r('return_5d * 100', 'return_5d')}, {r('return_10d * 100', 'return_10d')}, {r('return_20d * 100', 'return_20d')}, {r('turnover / 1e8', 'turnover')}, {r('breadth * 100', 'breadth')}, {r('new_high_ratio * 100', 'new_high_ratio')}, {r('concentration')}, {r('relative_strength')} FROM ranked"))
def sector_ranking_history(spark, sf_dir):
    """Every date at once, in the units of the stored table."""
    c = F.col
    out = ranking(spark, sf_dir).withColumns({**{x: c(x) * 100 for x in ("return_5d", "return_10d", "return_20d", "breadth", "new_high_ratio")}, "turnover": c("turnover") / 1e8})
    return rounded(out.select("trade_date", "industry", "score", "rank", *_COLS))


@query(with_(["own", "instruments"], f"""SELECT {d()}, industry, ts_code, name, {r('ret_5d')}, position FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY ret_5d DESC, ts_code) AS position FROM (
  SELECT a.trade_date, a.industry, a.ts_code, i.name, a.close / b.close - 1 AS ret_5d FROM own a JOIN own b ON a.ts_code = b.ts_code AND a.trade_index = b.trade_index + 5 JOIN instruments i ON i.ts_code = a.ts_code)) WHERE position <= 5"""))
def sector_leaders(spark, sf_dir):
    bars = panel.bars(spark, sf_dir)
    return rounded(sec.leaders(bars, panel.instruments(spark, sf_dir), panel.calendar(bars)))


cte("tops", ["ranked"], "SELECT trade_date, max(industry) FILTER (rank = 1) AS main_line, max(score) FILTER (rank = 1) AS main_score, max(industry) FILTER (rank = 2) AS second_line, coalesce(max(score) FILTER (rank = 2), 0) AS second FROM ranked GROUP BY trade_date")


cte("signal", ["tops"], """SELECT trade_date, main_line, main_score, second_line, gap, consecutive_days, strength, CASE WHEN strength = 2 AND consecutive_days >= 3 THEN 'strong' WHEN strength = 2 THEN 'emerging' WHEN strength = 1 THEN 'candidate' ELSE 'none' END AS level FROM (
  SELECT *, CASE WHEN main_score >= 0.7 AND gap >= 0.1 THEN 2::BIGINT WHEN main_score >= 0.7 THEN 1 ELSE 0 END AS strength, least(row_number() OVER (PARTITION BY main_line, island ORDER BY trade_date), 20) AS consecutive_days FROM (
  SELECT *, floor((main_score - second) * 1e6 + 0.5) / 1e6 AS gap, row_number() OVER (ORDER BY trade_date) - row_number() OVER (PARTITION BY main_line ORDER BY trade_date) AS island FROM tops))""")


@query(with_(["signal"], f"SELECT {d()}, main_line, main_score, second_line, gap, consecutive_days, strength, level FROM signal"))
def mainline_signal(spark, sf_dir):
    return rounded(sec.confirmation(ranking(spark, sf_dir)))


@query(with_(["ranked"], f""", l AS (SELECT DISTINCT trade_date FROM ranked ORDER BY trade_date DESC LIMIT 30), n AS (SELECT industry FROM ranked WHERE rank <= 12 AND trade_date = (SELECT max(trade_date) FROM ranked))
SELECT {d('trade_date')}, industry, coalesce(score, 0) AS score FROM (SELECT l.trade_date, n.industry, k.score FROM l CROSS JOIN n LEFT JOIN ranked k ON k.trade_date = l.trade_date AND k.industry = n.industry)"""))
def rotation_matrix(spark, sf_dir):
    return rounded(sec.rotation(tables.written(ranking(spark, sf_dir), "ranking")))


@query(with_(["ranked"], "SELECT industry, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, industry) AS position FROM ranked WHERE rank = 1 GROUP BY industry QUALIFY position <= 8"))
def rotation_counts(spark, sf_dir):
    n = ranking(spark, sf_dir).where("rank = 1").groupBy("industry").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "industry"))).where("position <= 8"))


@query(with_(["ranked", "own"], f"""SELECT {d()}, industry, rank, count(*) AS n_constituents, string_agg(ts_code, ',' ORDER BY amount DESC, ts_code) AS constituents FROM (SELECT k.trade_date, k.industry, k.rank, o.ts_code, o.amount FROM ranked k JOIN own o ON o.trade_date = k.trade_date AND o.industry = k.industry WHERE k.rank <= 10) t GROUP BY t.trade_date, industry, rank"""))
def sector_pool(spark, sf_dir):
    """Constituents of the ten leading industries on each date, by amount, as one array a sector."""
    bars = bars_once(spark, sf_dir)
    own = bars.join(panel.instruments(spark, sf_dir).where("delist_date IS NULL").select("ts_code", "industry"), "ts_code").select("trade_date", "industry", "ts_code", "amount")
    top = ranking(spark, sf_dir, bars).where("rank <= 10").select("trade_date", "industry", "rank")
    lists = own.join(top, ["trade_date", "industry"]).groupBy("trade_date", "industry", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("a"), "ts_code"))).alias("l"))
    return rounded(lists.select("trade_date", "industry", "rank", F.size("l").alias("n_constituents"), F.array_join(F.col("l.ts_code"), ",").alias("constituents")))


_INTS = {"return_5d": ("return_5d * 100", 2), "turnover_billion": ("turnover * 1e-8", 1), "breadth_pct": ("breadth * 100", 1), "new_high_pct": ("new_high_ratio * 100", 1), "relative_strength": ("relative_strength", 2)}
_FOUR = """, four AS (SELECT * EXCLUDE (score), floor(score * 1e4 + 0.5) / 1e4 AS score FROM ranked),
lead4 AS (SELECT trade_date, max(industry) FILTER (rank = 1) AS main_line, max(score) FILTER (rank = 1) AS main_score, coalesce(max(score) FILTER (rank = 2), 0) AS second FROM four GROUP BY trade_date),
run4 AS (SELECT *, floor((main_score - second) * 1e6 + 0.5) / 1e6 AS gap, row_number() OVER (ORDER BY trade_date) - row_number() OVER (PARTITION BY main_line ORDER BY trade_date) AS island FROM lead4),
sig4 AS (SELECT *, CASE WHEN main_score >= 0.7 AND gap >= 0.1 THEN CASE WHEN days >= 3 THEN 'strong' ELSE 'emerging' END WHEN main_score >= 0.7 THEN 'candidate' ELSE 'none' END AS level FROM (SELECT *, least(row_number() OVER (PARTITION BY main_line, island ORDER BY trade_date), 11) AS days FROM run4))"""


@query(with_(["ranked", "own", "instruments"], _FOUR + f""", k AS (SELECT k.trade_date, k.industry, k.rank, k.score, {', '.join(f'any_value(floor(k.{x} * 1e{n} + 0.5))::BIGINT AS {c}' for c, (x, n) in _INTS.items())}, coalesce(string_agg(o.ts_code || '/' || i.name || '/' || floor(o.close * 1e4 + 0.5)::BIGINT, ',' ORDER BY o.amount DESC, o.ts_code), '') AS listed
  FROM four k LEFT JOIN own o ON o.trade_date = k.trade_date AND o.industry = k.industry LEFT JOIN instruments i ON i.ts_code = o.ts_code WHERE k.rank <= 10 GROUP BY ALL)
SELECT {d('trade_date')}, main_line, main_score, gap, days AS consecutive_days, level, CASE level WHEN 'strong' THEN 2::BIGINT WHEN 'none' THEN 0 ELSE 1 END AS strength, CASE WHEN level IN ('strong', 'emerging') THEN 'clear' ELSE 'fuzzy' END AS clarity, sectors FROM sig4 s
JOIN (SELECT trade_date, string_agg(concat_ws(':', rank, industry, floor(score * 10000 + 0.5)::BIGINT, {', '.join(_INTS)}, listed), '|' ORDER BY rank) AS sectors FROM k GROUP BY trade_date) USING (trade_date)"""))
def mainline_payload(spark, sf_dir):
    """The nested sectors are written as text, which SQL engines agree on; factors in units of their last digit."""
    bars = bars_once(spark, sf_dir)
    found = sec.main_line_payload(tables.written(ranking(spark, sf_dir, bars), "ranking"), bars, panel.instruments(spark, sf_dir))
    whole = lambda x, n: F.coalesce(F.floor(x * 10**n + 0.5).cast("string"), F.lit(None))
    one = lambda m: F.concat_ws("/", m["ts_code"], m["name"], whole(m["close"], 4))
    text = F.transform("sectors", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["industry"], whole(x["score"], 4), *(whole(x[c], n) for c, (_, n) in _INTS.items()), F.array_join(F.transform(x["constituents"], one), ",")))
    return rounded(found.withColumn("sectors", F.array_join(text, "|")).select("trade_date", "main_line", "main_score", "gap", "consecutive_days", "level", "strength", "clarity", "sectors"))


@query(with_(["ranked"], f"SELECT {d()}, industry, score, rank, {r('return_5d')}, {r('turnover / 1e8', 'turnover')} FROM ranked"))
def backfilled_rankings(spark, sf_dir):
    """The stored ranking of every date, in two runs: the first stops half-way, the second takes the dates that it lacks."""
    at = tables.scratch(spark, "backfill")
    bars = panel.bars(spark, sf_dir)
    tables.put_partitions(bars.withColumn("trade_month", F.trunc("trade_date", "MM")), f"{at}/bars", "trade_month")
    load = lambda start, end: tables.load_bars(spark, f"{at}/bars", start, end)
    names, calendar = panel.instruments(spark, sf_dir), panel.calendar(load(None, None))
    for until in ("1996-06-30", None):
        stored = tables.read_table(spark, f"{at}/rankings") if until is None else None
        fresh = sec.rank_pending(load, names, calendar, stored, until)
        if fresh is not None:
            tables.put_partitions(fresh.withColumn("trade_month", F.trunc("trade_date", "MM")) if stored is None else _with_stored_months(fresh, stored), f"{at}/rankings", "trade_month")
    out = tables.read_table(spark, f"{at}/rankings")
    return rounded(out.select("trade_date", "industry", "score", "rank", "return_5d", (F.col("turnover") / 1e8).alias("turnover")))


def _with_stored_months(fresh, stored):
    """The new rows and what is stored of their months, as a month is put in place whole."""
    own = fresh.withColumn("trade_month", F.trunc("trade_date", "MM"))
    return own.unionByName(stored.join(own.select("trade_month").distinct(), "trade_month", "left_semi"))


@query(with_(["calendar"], "SELECT strftime(day, '%Y%m%d') AS day, strftime(max(trade_date), '%Y%m%d') AS known FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) LEFT JOIN calendar ON trade_date <= day GROUP BY day"))
def asof_date(spark, sf_dir):
    """For each order date, the latest trading date that isn't later."""
    asked = panel.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return rounded(sec.as_of(panel.calendar(panel.bars(spark, sf_dir)), asked))


_CODE = "['600','300','688','920'][l_suppkey % 4 + 1] || CASE WHEN length(l_suppkey::VARCHAR) < 3 THEN lpad(l_suppkey::VARCHAR, 3, '0') ELSE l_suppkey::VARCHAR END || '.' || ['SH','SZ','SH','BJ'][l_suppkey % 4 + 1]"
cte("members", [], f"SELECT DISTINCT date_trunc('week', l_shipdate)::DATE AS trade_date, p_brand AS concept_code, {_CODE} AS ts_code FROM lineitem JOIN part ON l_partkey = p_partkey")
cte("boards", ["members", "bars"], """SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY floor(coalesce(pct_chg, 0) * 1e6 + 0.5) DESC, floor(coalesce(amount, 0) * 1e6 + 0.5) DESC, concept_code) AS rank FROM (
  SELECT trade_date, concept_code, avg(pct_chg) AS pct_chg, sum(amount) AS amount, avg(CASE WHEN pct_chg > 0 THEN 100.0 ELSE 0.0 END) AS breadth_pct, count(*) AS members FROM members JOIN bars USING (trade_date, ts_code) GROUP BY ALL)""")


def _boards(spark, sf_dir):
    bars, members = panel.bars(spark, sf_dir), panel.concept_members(spark, sf_dir)
    return bars, members, sec.rank_boards(members, bars)


@query(with_(["boards"], f"SELECT {d()}, concept_code, rank, {r('pct_chg')}, {r('breadth_pct')}, members FROM boards"))
def concept_rank(spark, sf_dir):
    return rounded(_boards(spark, sf_dir)[2].select("trade_date", "concept_code", "rank", "pct_chg", "breadth_pct", "members"))


_RATE = "CASE WHEN ts_code LIKE '%.BJ' THEN 0.30 WHEN substr(ts_code, 1, 3) IN ('300','301','688','689') THEN 0.20 WHEN starts_with(ltrim(upper(coalesce(name, '')), '*'), 'ST') AND trade_date < DATE '2026-07-06' THEN 0.05 ELSE 0.10 END::DECIMAL(4,2)"


_LIMIT_UPS = f""", pb AS (SELECT *, CASE WHEN substr(ts_code, 4, 3)::INT % 5 = 0 THEN floor(close / (1 + {_RATE})::DOUBLE * 100 + 0.5) / 100 ELSE pre END AS pc FROM (SELECT bars.* EXCLUDE (close), floor(close * 100 + 0.5) / 100 AS close, floor(pre_close * 100 + 0.5) / 100 AS pre, name FROM bars LEFT JOIN instruments USING (ts_code))),
m AS (SELECT k.trade_date, k.concept_code, k.rank, m.ts_code, b.close, b.pc, b.pc > 0 AND b.close::DECIMAL(18,2) = round(b.pc::DECIMAL(24,8) * (1 + {_RATE.replace('trade_date', 'k.trade_date').replace('ts_code', 'm.ts_code')}), 2)::DECIMAL(18,2) AS up FROM boards k JOIN members m USING (trade_date, concept_code) LEFT JOIN pb b ON b.trade_date = k.trade_date AND b.ts_code = m.ts_code WHERE k.rank <= 10)"""
_COUNTED = "count(*) AS members, CASE WHEN count(*) FILTER (close IS NOT NULL AND pc IS NOT NULL) > 0 THEN count(*) FILTER (up) END AS limit_ups"


def _limit_bars(spark, sf_dir):
    """Limit-ups practically never occur here, so a fifth of the instruments get the previous close of one."""
    names = panel.instruments(spark, sf_dir)
    own = panel.bars(spark, sf_dir).join(names.select("ts_code", "name"), "ts_code", "left")
    rate = F.lit(1).cast("decimal(4,2)") + limit_rate(F.col("ts_code"), F.col("name"), F.col("trade_date"))
    tick = lambda c: F.floor(c * 100 + 0.5).cast("double") / 100
    own = own.withColumns({"close": tick(F.col("close")), "pre_close": tick(F.col("pre_close"))})
    made = tick(F.col("close") / rate.cast("double"))
    return own.withColumn("pre_close", F.when(F.substring("ts_code", 4, 3).cast("int") % 5 == 0, made).otherwise(F.col("pre_close"))).drop("name"), names


@query(with_(["boards", "instruments"], _LIMIT_UPS + f" SELECT {d('trade_date')}, concept_code, rank, {_COUNTED} FROM m GROUP BY m.trade_date, concept_code, rank"))
def concept_limit_up(spark, sf_dir):
    _, members, boards = _boards(spark, sf_dir)
    return rounded(sec.limit_up_counts(boards, members, *_limit_bars(spark, sf_dir)))


cte("landed", [], f"""SELECT date_trunc('week', l_shipdate)::DATE AS trade_date, p_brand AS concept_code, CASE WHEN l_suppkey % 11 = 4 THEN '999' || l_suppkey ELSE ' ' || split_part({_CODE}, '.', 1) END AS symbol, 'given ' || l_suppkey AS given_name, l_linenumber AS page, l_orderkey AS place
  FROM lineitem JOIN part ON l_partkey = p_partkey""")
cte("bridge", ["landed", "instruments"], """SELECT trade_date, concept_code, i.ts_code, given_name, member_rank FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, concept_code ORDER BY page, place, symbol) AS member_rank FROM (
  SELECT * EXCLUDE (symbol), trim(symbol) AS symbol, row_number() OVER (PARTITION BY trade_date, concept_code, trim(symbol) ORDER BY page, place, given_name) AS rn FROM landed) WHERE rn = 1) m JOIN (SELECT symbol, min(ts_code) AS ts_code FROM instruments GROUP BY symbol) i USING (symbol)""")


def _landed(spark, sf_dir):
    """Members as pages list them: every shipment of a brand is one, so instruments repeat; some symbols are unknown."""
    line = panel.table(spark, sf_dir, "lineitem").join(panel.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = F.concat(F.lit(" "), F.split_part(panel.instrument_code("l_suppkey"), F.lit("."), F.lit(1)))
    symbol = F.when(F.col("l_suppkey") % 11 == 4, F.concat(F.lit("999"), F.col("l_suppkey").cast("string"))).otherwise(own)
    return line.select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"), F.col("p_brand").alias("concept_code"), symbol.alias("symbol"), F.concat(F.lit("given "), F.col("l_suppkey").cast("string")).alias("given_name"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("place"))


@query(with_(["bridge"], f"SELECT {d()}, concept_code, ts_code, given_name, member_rank FROM bridge"))
def member_bridge(spark, sf_dir):
    """Boards' members by code, from pages with repeated and unknown symbols."""
    return rounded(sec.member_bridge(_landed(spark, sf_dir), panel.instruments(spark, sf_dir)))


@query(with_(["boards", "instruments", "bridge"], _LIMIT_UPS.split("\nm AS")[0].rstrip(",") + f""", names AS (SELECT * FROM instruments WHERE right(symbol, 1) <> '7'),
m AS (SELECT k.trade_date, k.concept_code, k.rank, k.pct_chg AS board_change, k.amount AS board_amount, k.breadth_pct, m.ts_code, m.member_rank, coalesce(i.name, m.given_name) AS name, i.industry, b.close, b.pc, b.pct_chg, b.amount,
  coalesce(b.pc > 0 AND b.close::DECIMAL(18,2) = round(b.pc::DECIMAL(24,8) * (1 + {_RATE.replace('trade_date', 'k.trade_date').replace('ts_code', 'm.ts_code').replace('name', 'coalesce(i.name, m.given_name)')}), 2)::DECIMAL(18,2), false) AS up
  FROM boards k LEFT JOIN (SELECT * FROM bridge WHERE concept_code <> 'Brand#13') m USING (trade_date, concept_code) LEFT JOIN names i ON i.ts_code = m.ts_code LEFT JOIN pb b ON b.trade_date = k.trade_date AND b.ts_code = m.ts_code WHERE k.rank <= 10)
SELECT {d('trade_date')}, concept_code, rank, floor(any_value(board_change) * 100 + 0.5) / 100 AS pct_chg, floor(any_value(board_amount) / 1e8 * 100 + 0.5) / 100 AS net_inflow, floor(any_value(breadth_pct) * 10 + 0.5) / 10 AS breadth_pct, count(ts_code) AS members, CASE WHEN count(*) FILTER (close IS NOT NULL AND pc IS NOT NULL) > 0 THEN count(*) FILTER (up) END AS limit_ups,
  coalesce(string_agg(concat_ws(':', member_rank, ts_code, coalesce(name, ''), coalesce(industry, ''), coalesce((floor(close * 100 + 0.5)::BIGINT)::VARCHAR, ''), coalesce((floor(amount * 100 + 0.5)::BIGINT)::VARCHAR, '')), '|' ORDER BY member_rank) FILTER (ts_code IS NOT NULL), '') AS listed FROM m GROUP BY m.trade_date, concept_code, rank"""))
def concept_payload(spark, sf_dir):
    """Boards with members in the order of their pages, written as text, which SQL engines agree on; some instruments are unnamed and one brand's pages missing."""
    boards = _boards(spark, sf_dir)[2]
    own, names = _limit_bars(spark, sf_dir)
    members = sec.member_bridge(_landed(spark, sf_dir), names).where("concept_code <> 'Brand#13'")
    found = sec.board_payload(boards, members, own, names.where("right(symbol, 1) <> '7'"))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cents = lambda c: blank(F.floor(c * 100 + 0.5))
    text = F.transform("members_listed", lambda x: F.concat_ws(":", x["member_rank"].cast("string"), x["ts_code"], blank(x["name"]), blank(x["industry"]), cents(x["close"]), cents(x["amount"])))
    return rounded(found.withColumn("listed", F.array_join(text, "|")).drop("members_listed"))


@query(with_(["boards"], f"""SELECT {d()}, ts_code, concepts, concept_count, row_number() OVER (PARTITION BY f.trade_date ORDER BY concept_count DESC, pct_chg DESC NULLS LAST, amount DESC NULLS LAST, ts_code) AS focus_rank FROM (
  SELECT trade_date, ts_code, string_agg(concept_code, ',' ORDER BY concept_code) AS concepts, count(*) AS concept_count FROM members SEMI JOIN (SELECT * FROM boards WHERE rank <= 10) b USING (trade_date, concept_code) GROUP BY ALL) f LEFT JOIN bars USING (trade_date, ts_code) WHERE concept_count >= 2"""))
def focus_instruments(spark, sf_dir):
    bars, members, boards = _boards(spark, sf_dir)
    f = sec.focus(boards, members, bars)
    return rounded(f.select("trade_date", "ts_code", F.array_join("concepts", ",").alias("concepts"), "concept_count", "focus_rank"))


@query(with_(["b1", "instruments"], f""", n AS (SELECT trade_date, coalesce(nullif(trim(industry), ''), '未分类') AS industry, count(*) AS n FROM b1 LEFT JOIN instruments USING (ts_code) WHERE b1 GROUP BY ALL),
g AS (SELECT trade_date, industry, coalesce(n, 0) AS n FROM (SELECT DISTINCT trade_date FROM n) CROSS JOIN (SELECT DISTINCT industry FROM n) LEFT JOIN n USING (trade_date, industry)),
p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY industry ORDER BY trade_date), 0) AS previous, min(CASE WHEN n > 0 THEN trade_date END) OVER (PARTITION BY industry) AS f FROM g)
SELECT {d()}, industry, n, previous, n - previous AS change, n > 0 AND previous = 0 AS is_new, n = 0 AND previous > 0 AS is_removed, strftime(f, '%Y%m%d') AS first_seen FROM p"""))
def industry_trends(spark, sf_dir):
    hits = ind.wide(panel.bars(spark, sf_dir)).where(screens.is_b1()).select("ts_code", "trade_date")
    return rounded(sec.industry_trends(hits, panel.instruments(spark, sf_dir)))
