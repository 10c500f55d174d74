"""Queries of annual reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import fundamentals as fun
from ..operators import indicators as ind
from ..sources import panel
from .registry import query
from .sql import cte, d, r, with_

_CODE = "['600','300','688','920'][l_suppkey % 4 + 1] || CASE WHEN length(l_suppkey::VARCHAR) < 3 THEN lpad(l_suppkey::VARCHAR, 3, '0') ELSE l_suppkey::VARCHAR END || '.' || ['SH','SZ','SH','BJ'][l_suppkey % 4 + 1]"
cte("reports", [], f"""SELECT ts_code, make_date(y, 12, 31) AS report_date, make_date(y, 12, 31) + 120 AS announcement_date, revenue, (revenue / lag(revenue) OVER w - 1) * 100 AS revenue_yoy, profit AS net_profit, (profit / lag(profit) OVER w - 1) * 100 AS net_profit_yoy,
  units % 97 / 10 + 20 AS eps, units % 89 * 10 + 400 AS book_value_per_share, units % 23 + 5 AS roe, (n % 7 - 1)::DOUBLE AS ocf_per_share, units % 31 + 10 AS gross_margin, returned % 71 + 5 AS debt_to_assets
  FROM (SELECT *, revenue * (units % 17 + 8) / 100 AS profit FROM (SELECT {_CODE} AS ts_code, year(l_shipdate)::INT AS y, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS n, sum(l_quantity) AS units, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned FROM lineitem GROUP BY ALL)) WINDOW w AS (PARTITION BY ts_code ORDER BY y)""")
_REPORT = ("revenue", "revenue_yoy", "net_profit", "net_profit_yoy", "eps", "book_value_per_share", "roe", "ocf_per_share", "gross_margin", "debt_to_assets")
#: Wider limits than the defaults: this panel's prices are per unit of goods.
_LIMITS = {"roe": 8.0, "least_roe": 5.0, "margin": 10.0, "debt": 80.0, "pe": (5.0, 300.0), "pb": (0.0, 60.0), "growth": -60.0, "cash_years": 2}


def _halves(reports):
    """Two landed tables with repeated rows, as the sources send them."""
    perf = reports.select("ts_code", "report_date", "announcement_date", *_REPORT[:8])
    balance = reports.select("ts_code", "report_date", F.date_add("announcement_date", 10).alias("announcement_date"), "gross_margin", "debt_to_assets").where(F.year("report_date") % 3 != 0)
    return perf.union(perf.withColumn("announcement_date", F.date_add("announcement_date", 3))), balance


@query(with_(["reports"], f"SELECT ts_code, {d('report_date')}, strftime(announcement_date + CASE WHEN year(report_date) % 3 != 0 THEN 10 ELSE 0 END, '%Y%m%d') AS announcement_date, {', '.join(r(c) for c in _REPORT[:8])}, {', '.join(r(f'CASE WHEN year(report_date) % 3 != 0 THEN {c} END', c) for c in _REPORT[8:])} FROM reports"))
def fund_merge(spark, sf_dir):
    perf, balance = _halves(panel.fundamentals(spark, sf_dir))
    return rounded(fun.merge_reports(perf, balance).select("ts_code", "report_date", "announcement_date", *_REPORT))


cte("snaps", ["r1", "reports", "instruments", "ends"], """SELECT p.ts_code, p.trade_date, any_value(name) AS name, any_value(close) AS close, any_value(amount20) AS amount20, max(report_date) AS report_date, arg_max(eps, report_date) AS eps, arg_max(book_value_per_share, report_date) AS bvps, arg_max(ocf_per_share, report_date) AS ocf_per_share,
  count(*) AS report_count, median(roe) AS roe_median, min(roe) AS roe_min, median(gross_margin) AS margin_median, median(revenue_yoy) AS revenue_yoy_median, median(net_profit_yoy) AS profit_yoy_median, count(*) FILTER (ocf_per_share > 0) AS cash_years, max(debt_to_assets) AS debt_max
  FROM (SELECT r1.ts_code, r1.trade_date, name, close, amount20, q.* EXCLUDE (ts_code), row_number() OVER (PARTITION BY r1.ts_code, r1.trade_date ORDER BY report_date DESC) AS rn FROM r1 SEMI JOIN (SELECT * FROM ends WHERE month(trade_date) IN (1, 4, 7, 10)) e USING (trade_date) LEFT JOIN instruments USING (ts_code)
    JOIN reports q ON q.ts_code = r1.ts_code AND announcement_date <= r1.trade_date AND report_date < r1.trade_date) p WHERE rn <= 3 GROUP BY p.ts_code, p.trade_date""")


def value_hits(spark, sf_dir, features=None):
    """The value-quality screen's rows at the ends of its months; from features that are there already, if they are."""
    return fun.value_quality(_snapshots(spark, sf_dir, features), _LIMITS)


def _snapshots(spark, sf_dir, features=None):
    own = ind.reversal_features(panel.bars(spark, sf_dir)) if features is None else features
    days = fun.snapshot_dates(panel.bars(spark, sf_dir) if features is None else features)
    prices = own.select("ts_code", "trade_date", "close", "amount20").join(F.broadcast(days), "trade_date", "left_semi").join(panel.instruments(spark, sf_dir).select("ts_code", "name"), "ts_code", "left")
    return fun.as_of_three(prices.select("ts_code", "trade_date", "name", "close", "amount20"), panel.fundamentals(spark, sf_dir))


_SNAP = ("report_count", "roe_median", "roe_min", "margin_median", "revenue_yoy_median", "profit_yoy_median", "cash_years", "debt_max")


@query(with_(["snaps"], f"SELECT ts_code, {d()}, {d('report_date')}, {', '.join(c if c in ('report_count', 'cash_years') else r(c) for c in _SNAP)}, {r('close / eps', 'pe')}, {r('close / bvps', 'pb')} FROM snaps"))
def fund_asof3(spark, sf_dir):
    return rounded(_snapshots(spark, sf_dir).select("ts_code", "trade_date", "report_date", *_SNAP, "pe", "pb"))


def _share(c: str, order: str = "") -> str:
    return f"(rank() OVER (PARTITION BY trade_date ORDER BY {c} {order}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2) / count(*) OVER (PARTITION BY trade_date)"


_L = _LIMITS


cte("value_hits", ["snaps"], f"""WITH e AS (SELECT *, close / eps AS pe, close / bvps AS pb, 1 / (close / eps) AS ey FROM snaps WHERE NOT regexp_matches(upper(coalesce(name, '')), 'ST|退') AND report_count >= 3 AND close / eps BETWEEN {_L['pe'][0]} AND {_L['pe'][1]} AND close / bvps BETWEEN 0 AND {_L['pb'][1]} AND amount20 >= 100000
  AND roe_median >= {_L['roe']} AND roe_min >= {_L['least_roe']} AND margin_median >= {_L['margin']} AND debt_max <= {_L['debt']} AND revenue_yoy_median >= {_L['growth']} AND profit_yoy_median >= {_L['growth']} AND cash_years >= 2),
s AS (SELECT *, ({_share('roe_median')} + {_share('margin_median')} + {_share('profit_yoy_median')} + {_share('ocf_per_share')} + {_share('debt_max', 'DESC')}) / 5 AS quality, ({_share('ey')} + {_share('pb', 'DESC')}) / 2 AS value FROM e),
t AS (SELECT *, floor((quality * 0.65 + value * 0.35) * 100 * 1e6 + 0.5) / 1e6 AS score FROM s)
SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, amount20 DESC, ts_code) AS position FROM t QUALIFY position <= 20""")


@query(with_(["value_hits"], f"SELECT ts_code, {d()}, {r('pe')}, {r('pb')}, {r('quality')}, {r('value')}, {r('score')}, position FROM value_hits"))
def value_quality(spark, sf_dir):
    return rounded(value_hits(spark, sf_dir).select("ts_code", "trade_date", "pe", "pb", "quality", "value", "score", "position"))


@query(with_(["reports"], f"SELECT {d('report_date')} FROM (SELECT report_date, max(announcement_date + (hash_day % 400)::INT) AS fetched_at FROM (SELECT *, length(ts_code) * year(report_date) AS hash_day FROM reports) GROUP BY report_date) t WHERE datediff('day', fetched_at, DATE '2000-01-01') >= 7"))
def stale_reports(spark, sf_dir):
    """Report years whose last fetch is a week or more ago on 2000-01-01."""
    reports = panel.fundamentals(spark, sf_dir)
    fetched = reports.select("report_date", F.date_add("announcement_date", (F.length("ts_code") * F.year("report_date") % 400).cast("int")).alias("fetched_at"))
    return rounded(fun.stale_years(fetched, "2000-01-01"))
