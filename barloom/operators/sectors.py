"""Industry rankings over every trading date at once, confirmation of the leader, and concept boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import NO_INDUSTRY, is_limit_up

#: Factor weights (none for momentum, which has a weight of 0.10 but no factor, so 0.90 is the most) and limits.
WEIGHTS = {"return_5d": 0.20, "return_10d": 0.10, "return_20d": 0.05, "turnover": 0.20, "breadth": 0.15, "new_high_ratio": 0.10, "concentration": 0.05, "relative_strength": 0.05}
WINDOWS, HIGH_DATES, LEAST_MEMBERS, TOP_SECTORS = (5, 10, 20), 63, 5, 8
SCORE_LIMIT, GAP_LIMIT, CONFIRM_DAYS = 0.70, 0.10, 3


def factors(bars: DataFrame, instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """All factors by (trade_date, industry). Bars of instruments without an industry are left out.

    A window's return takes in instruments that traded within it but not on its last date: a bar stands for its instrument until the next one, so
    it serves its own date and, where dates are missing, those too. The closes of a window are at its end, on the shuffle by instrument; what
    moves to industries is a row an instrument and date, combined before.
    """
    own = bars.join(instruments.select("ts_code", "industry"), "ts_code").where("industry IS NOT NULL AND industry NOT IN ('None', '')").join(F.broadcast(calendar), "trade_date")
    longest, last = max(WINDOWS), calendar.agg(F.max("trade_index").alias("_last"))
    own_series = Window.partitionBy("ts_code").orderBy("trade_index")
    held = own.where("close IS NOT NULL").select("ts_code", "industry", "trade_index", "close").withColumns({
        "_recent": F.collect_list(F.struct("trade_index", "close")).over(own_series.rangeBetween(-(longest - 1), 0)), "_next": F.lead("trade_index").over(own_series),
    })
    served = held.join(F.broadcast(last)).withColumn("end", F.explode(F.sequence("trade_index", F.least(F.col("_next") - 1, F.col("trade_index") + longest - 1, F.col("_last")))))
    # a window spans w - 1 intervals, so it needs a date w - 1 before
    first = lambda w: F.try_element_at(F.filter("_recent", lambda x: x["trade_index"] > F.col("end") - w), F.lit(1))["close"]
    returns = served.groupBy("end", "industry").agg(*(F.avg(F.when(F.col("end") >= w - 1, F.try_divide(F.col("close"), first(w)) - 1)).alias(f"return_{w}d") for w in WINDOWS))

    span = Window.partitionBy("ts_code").orderBy("trade_index").rangeBetween(-(HIGH_DATES - 1), 0)
    daily = own.withColumn("_top", F.col("high") >= F.max("high").over(span))
    sd, mean = F.stddev_samp("pct_chg"), F.avg("pct_chg")
    raw = F.when((F.count("*") < 3) | (sd == 0), 1.0).when(mean == 0, 99.0).otherwise(F.try_divide(sd, F.abs(mean)))
    flat = daily.groupBy("trade_date", "trade_index", "industry").agg(
        F.count("*").alias("members"), F.sum("amount").alias("turnover"), F.avg(F.when(F.col("pct_chg") > 0, 1.0).otherwise(0.0)).alias("breadth"),
        F.avg(F.when(F.col("_top"), 1.0).otherwise(0.0)).alias("new_high_ratio"), (1 / (F.least(raw, F.lit(20.0)) + 0.001)).alias("concentration"), mean.alias("_mean"), F.sum("pct_chg").alias("_s"), F.count("pct_chg").alias("_c"),
    )
    market = Window.partitionBy("trade_date")
    flat = flat.withColumn("relative_strength", F.col("_mean") - F.sum("_s").over(market) / F.sum("_c").over(market)).drop("_mean", "_s", "_c")
    return flat.join(returns.withColumnRenamed("end", "trade_index"), ["trade_index", "industry"], "left")


def rank(factor_rows: DataFrame, least_members: int = LEAST_MEMBERS) -> DataFrame:
    """Score and rank of each valid industry on each date: average ranks scaled to 0..1, weighted; ties by name. A factor that no industry of the date
    has counts nothing, otherwise a missing one counts as 0.

    A date's industries are an array of at most a few hundred, within which a value's place is counted, so one shuffle by date serves all
    factors."""
    valid = factor_rows.where(F.col("members") >= least_members)
    rest = [c for c in valid.columns if c != "trade_date"]
    dates = valid.groupBy("trade_date").agg(F.collect_list(F.struct(*rest)).alias("_all"))
    filled = lambda x, c: F.coalesce(x[c], F.lit(0.0))
    dates = dates.withColumns({f"_v_{c}": F.when(F.exists("_all", lambda x: x[c].isNotNull()), F.array_sort(F.transform("_all", lambda x: filled(x, c)))) for c in WEIGHTS})  # noqa: B023  called at once
    n = F.size("_all")

    def weighted(x: Column, c: str, weight: float) -> Column:
        sorted_, v = F.col(f"_v_{c}"), filled(x, c)
        below = F.array_position(sorted_, v) - 1
        ties = F.size(F.filter(sorted_, lambda y: y == v))
        share = F.when(n > 1, (below + (ties - 1) / 2) / (n - 1)).otherwise(0.5)
        return F.when(sorted_.isNotNull(), share * weight).otherwise(0.0)

    def score(x: Column) -> Column:
        total = F.lit(0.0)
        for c, weight in WEIGHTS.items():
            total = total + weighted(x, c, weight)
        # whole millionths, so that the last bits of a sum order nothing
        return F.floor(total * 1e6 + 0.5) / 1e6

    scored = dates.select("trade_date", F.explode(F.transform("_all", lambda x: F.struct(x.alias("x"), score(x).alias("score")))).alias("_x"))
    out = scored.select(*(F.col("trade_date") if c == "trade_date" else F.col(f"_x.x.{c}").alias(c) for c in valid.columns), F.col("_x.score").alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("score"), "industry")))


#: Fixed value: sessions that a ranking may look back, the longest window and the highs and some more.
LOOK_BACK = max(WINDOWS) + HIGH_DATES + 20


def pending(calendar: DataFrame, stored: DataFrame | None, until=None) -> DataFrame:
    """Dates of the calendar, up to one of them, that the stored rankings lack."""
    own = calendar if until is None else calendar.where(F.col("trade_date") <= F.lit(until).cast("date"))
    return own if stored is None else own.join(stored.select("trade_date").distinct(), "trade_date", "left_anti")


def rank_pending(load, instruments: DataFrame, calendar: DataFrame, stored: DataFrame | None = None, until=None, least_members: int = LEAST_MEMBERS) -> DataFrame | None:
    """Rankings of the pending dates, from the bars that they can depend on; None if none is pending.

    ``load(start, end)`` reads the bars of a range, so that its table prunes by date. The range goes from LOOK_BACK sessions before the first
    pending date to the last one, as two dates that come to the driver."""
    wanted = pending(calendar, stored, until)
    ends = wanted.agg(F.min("trade_index").alias("first"), F.max("trade_index").alias("last")).first()
    if ends["first"] is None:
        return None
    span = calendar.where(F.col("trade_index").between(ends["first"] - LOOK_BACK, ends["last"]))
    start, end = span.agg(F.min("trade_date"), F.max("trade_date")).first()
    return rank(factors(load(start, end), instruments, span), least_members).join(wanted.select("trade_date"), "trade_date", "left_semi")


def last_dates(ranked: DataFrame, n: int) -> DataFrame:
    """The rankings of the last n distinct dates."""
    days = ranked.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    return ranked.join(days, "trade_date", "left_semi")


def leaders(bars: DataFrame, instruments: DataFrame, calendar: DataFrame, n: int = 5) -> DataFrame:
    """Per date and industry, the best returns over five intervals of the calendar."""
    own = bars.join(instruments.select("ts_code", "name", "industry"), "ts_code").where("industry IS NOT NULL").join(F.broadcast(calendar), "trade_date").select("ts_code", "name", "industry", "trade_date", "trade_index", "close")
    past = own.select("ts_code", (F.col("trade_index") + 5).alias("trade_index"), F.col("close").alias("_first"))
    both = own.join(past, ["ts_code", "trade_index"]).withColumn("ret_5d", F.try_divide("close", "_first") - 1)
    w = Window.partitionBy("trade_date", "industry").orderBy(F.desc("ret_5d"), "ts_code")
    return both.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select("trade_date", "industry", "ts_code", "name", "ret_5d", "position")


def confirmation(ranked: DataFrame, look_back: int = 20, level_strength: bool = False) -> DataFrame:
    """Per date: leader, its score, the gap to the second, dates on top in a row (up to look_back) and the level.

    strength is 2, 1 or 0 by score and gap alone, or, with ``level_strength``, by the level: strong, emerging or candidate, none."""
    top = ranked.where("rank <= 2").groupBy("trade_date").agg(F.max(F.when(F.col("rank") == 1, F.col("industry"))).alias("main_line"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("main_score"), F.max(F.when(F.col("rank") == 2, F.col("industry"))).alias("second_line"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second"))
    # one row a date; islands of the same leader by the difference of two row numbers
    w, own = Window.orderBy("trade_date"), Window.partitionBy("main_line").orderBy("trade_date")
    top = top.withColumn("_island", F.row_number().over(w) - F.row_number().over(own))
    streak = F.row_number().over(Window.partitionBy("main_line", "_island").orderBy("trade_date"))
    top = top.withColumns({"consecutive_days": F.least(streak, F.lit(look_back)), "gap": F.floor((F.col("main_score") - F.coalesce("_second", F.lit(0.0))) * 1e6 + 0.5) / 1e6})
    strength = F.when((F.col("main_score") >= SCORE_LIMIT) & (F.col("gap") >= GAP_LIMIT), 2).when(F.col("main_score") >= SCORE_LIMIT, 1).otherwise(0)
    top = top.withColumn("strength", strength)
    level = F.when((F.col("strength") == 2) & (F.col("consecutive_days") >= CONFIRM_DAYS), "strong").when(F.col("strength") == 2, "emerging").when(F.col("strength") == 1, "candidate").otherwise("none")
    top = top.withColumn("level", level)
    if level_strength:
        top = top.withColumn("strength", F.when(F.col("level") == "strong", 2).when(F.col("level") == "none", 0).otherwise(1))
    return top.drop("_second", "_island")


#: Dates before the leader's own that its run is counted back, and the units and digits of a payload's factors.
RUN_BACK = 10
PAYLOAD = {"return_5d": ("return_5d", 100, 2), "turnover_billion": ("turnover", 1e-8, 1), "breadth_pct": ("breadth", 100, 1), "new_high_pct": ("new_high_ratio", 100, 1), "relative_strength": ("relative_strength", 1, 2)}


def _digits(c: Column, n: int) -> Column:
    return F.floor(c * 10.0**n + 0.5) / 10.0**n


def main_line_payload(ranked: DataFrame, bars: DataFrame, instruments: DataFrame, top: int = 10) -> DataFrame:
    """Per date: the main line, its score, gap, run, level and strength, how clear it is, and the leading sectors with their factors and
    constituents, largest amount first, nested. A sector's constituents on a date are a few hundred at most; a sector without
    any has an empty list. Scores and gaps have four digits and decide with them."""
    own = ranked.withColumn("score", _digits(F.col("score"), 4))
    signal = confirmation(own, RUN_BACK + 1, level_strength=True).select("trade_date", "main_line", "main_score", "gap", "consecutive_days", "level", "strength")
    clarity = F.when(F.col("level").isin("strong", "emerging"), "clear").when(F.col("level").isNotNull(), "fuzzy").otherwise("rotating")
    listed = own.where(F.col("rank") <= top).select("trade_date", "industry", "rank", "score", *(_digits(F.col(c) * unit, n).alias(name) for name, (c, unit, n) in PAYLOAD.items()))
    known = bars.join(instruments.where("delist_date IS NULL").select("ts_code", "name", "industry"), "ts_code").select("trade_date", "industry", "ts_code", "name", "close", "pct_chg", "amount")
    member = F.struct((-F.col("amount")).alias("_order"), "ts_code", "name", "close", "pct_chg", "amount")
    members = F.when(F.col("ts_code").isNotNull(), member)  # collect_list leaves nulls out
    keys = ["trade_date", "industry", "rank", "score", *PAYLOAD]
    sectors = listed.join(known, ["trade_date", "industry"], "left").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(members)), lambda x: x.dropFields("_order")).alias("constituents"))
    nested = sectors.groupBy("trade_date").agg(F.array_sort(F.collect_list(F.struct("rank", "industry", "score", *PAYLOAD, "constituents"))).alias("sectors"))
    return nested.join(signal, "trade_date", "left").withColumn("clarity", clarity)


def rotation(ranked: DataFrame, dates: int = 30, top: int = 12) -> DataFrame:
    """Long form of the rotation matrix: the last dates by the latest date's leading industries; score 0 where missing."""
    ranked = last_dates(ranked, dates)
    names = last_dates(ranked, 1).where(F.col("rank") <= top).select("industry")
    grid = F.broadcast(ranked.select("trade_date").distinct()).crossJoin(F.broadcast(names))  # dates x top cells, both parameters
    return grid.join(ranked.select("trade_date", "industry", "score"), ["trade_date", "industry"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def rotation_matrix(ranked: DataFrame, dates: int = 30, top: int = 12) -> DataFrame:
    """The same as one column an industry."""
    return rotation(ranked, dates, top).groupBy("trade_date").pivot("industry").agg(F.first("score"))


def as_of(dates: DataFrame, asked: DataFrame) -> DataFrame:
    """For each distinct asked day, the latest known trade_date that isn't later; null where there is none.

    Both are merged month by month; a month's first days carry on the last date of the months before, of which one row each is ordered
    in one task."""
    month = lambda c: F.trunc(c, "MM").alias("_m")
    known = dates.select("trade_date").distinct().select(month("trade_date"), F.col("trade_date").alias("day"), F.col("trade_date").alias("known"))
    both = known.unionByName(asked.select("day").distinct().select(month("day"), "day", F.lit(None).cast("date").alias("known")).withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    inside = F.last("known", ignorenulls=True).over(Window.partitionBy("_m").orderBy("day", F.col("_asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    months = both.groupBy("_m").agg(F.max("known").alias("_last"))
    carried = months.select("_m", F.last("_last", ignorenulls=True).over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    return both.withColumn("known", inside).where("_asked").join(carried, "_m").select("day", F.coalesce("known", "_carried").alias("known"))


# --- concept boards -----------------------------------------------------------------------------------------------------


def rank_boards(members: DataFrame, bars: DataFrame) -> DataFrame:
    """Boards by mean change, then money, both with null as 0; ties by code."""
    m = members.join(bars.select("trade_date", "ts_code", "pct_chg", "amount"), ["trade_date", "ts_code"])
    b = m.groupBy("trade_date", "concept_code").agg(F.avg("pct_chg").alias("pct_chg"), F.sum("amount").alias("amount"), F.avg(F.when(F.col("pct_chg") > 0, 100.0).otherwise(0.0)).alias("breadth_pct"), F.count("*").alias("members"))
    zero = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) * 1e6 + 0.5)
    w = Window.partitionBy("trade_date").orderBy(zero("pct_chg").desc(), zero("amount").desc(), "concept_code")
    return b.withColumn("rank", F.row_number().over(w))


def member_bridge(landed: DataFrame, instruments: DataFrame) -> DataFrame:
    """(trade_date, concept_code, ts_code, given_name, member_rank) from members as pages list them: trade_date, concept_code, symbol,
    given_name, page, place.

    Of a symbol that a board lists several times the first place counts; member_rank numbers those that stay. A symbol becomes a code by
    the instruments; of several instruments with one symbol the smallest code. Symbols that no instrument has are left out."""
    first = Window.partitionBy("trade_date", "concept_code", "symbol").orderBy("page", "place", "given_name")
    order = Window.partitionBy("trade_date", "concept_code").orderBy("page", "place", "symbol")
    once = landed.withColumn("symbol", F.trim("symbol")).withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("member_rank", F.row_number().over(order))
    codes = instruments.groupBy("symbol").agg(F.min("ts_code").alias("ts_code"))
    return once.join(codes, "symbol").select("trade_date", "concept_code", "ts_code", "given_name", "member_rank")


def limit_up_counts(boards: DataFrame, members: DataFrame, bars: DataFrame, instruments: DataFrame, top: int = 10) -> DataFrame:
    """Leading boards with their members' limit-ups; null if no member has prices that day."""
    return _board_members(boards, members, bars, instruments, top).groupBy("trade_date", "concept_code", "rank").agg(*_limit_ups())


def board_payload(boards: DataFrame, members: DataFrame, bars: DataFrame, instruments: DataFrame, top: int = 10) -> DataFrame:
    """The same with what the boards are and their members, in rank order, nested, with the dimension's names, or else those that the
    board's page gave, and the day's bar where there is one. A board without members has an empty list."""
    member = F.when(F.col("ts_code").isNotNull(), F.struct("member_rank", "ts_code", "name", "industry", *(_digits(F.col(c), 2).alias(c) for c in ("close", "pct_chg", "amount"))))
    keys = ["trade_date", "concept_code", "rank", "pct_chg", "net_inflow", "breadth_pct"]
    own = _board_members(boards, members, bars, instruments, top)
    board = boards.where(F.col("rank") <= top).select("trade_date", "concept_code", _digits(F.col("pct_chg"), 2).alias("pct_chg"), _digits(F.col("amount") / 1e8, 2).alias("net_inflow"), _digits(F.col("breadth_pct"), 1).alias("breadth_pct"))
    nested = own.groupBy("trade_date", "concept_code", "rank").agg(*_limit_ups(), F.array_sort(F.collect_list(member)).alias("members_listed"))
    return nested.join(board, ["trade_date", "concept_code"]).select(*keys, "members", "limit_ups", "members_listed")


def _board_members(boards: DataFrame, members: DataFrame, bars: DataFrame, instruments: DataFrame, top: int) -> DataFrame:
    """Leading boards' members, in a row of nulls for a board without any."""
    listed = boards.where(F.col("rank") <= top).select("trade_date", "concept_code", "rank")
    given = F.col("given_name") if "given_name" in members.columns else F.lit(None).cast("string")
    own = listed.join(members.select("trade_date", "concept_code", "ts_code", "member_rank", given.alias("_given")), ["trade_date", "concept_code"], "left")
    named = own.join(instruments.select("ts_code", "name", "industry"), "ts_code", "left").withColumn("name", F.coalesce("name", "_given")).drop("_given")
    return named.join(bars.select("trade_date", "ts_code", "pre_close", "close", "pct_chg", "amount"), ["trade_date", "ts_code"], "left")


def _limit_ups() -> list[Column]:
    up = is_limit_up(F.col("ts_code"), F.col("name"), F.col("trade_date"), F.col("pre_close"), F.col("close"))
    priced = F.count(F.when(F.col("close").isNotNull() & F.col("pre_close").isNotNull(), 1))
    return [F.count("ts_code").alias("members"), F.when(priced > 0, F.sum(F.when(up, 1).otherwise(0))).alias("limit_ups")]


def leading_members(boards: DataFrame, members: DataFrame, top: int = 10) -> DataFrame:
    """The members of each date's leading boards."""
    return members.join(boards.where(F.col("rank") <= top).select("trade_date", "concept_code"), ["trade_date", "concept_code"], "left_semi")


def focus(boards: DataFrame, members: DataFrame, bars: DataFrame, top: int = 10, least: int = 2) -> DataFrame:
    """Instruments in at least two of a date's leading boards, by number of boards, change, amount and code."""
    m = leading_members(boards, members, top).groupBy("trade_date", "ts_code").agg(F.array_sort(F.collect_set("concept_code")).alias("concepts"))
    m = m.withColumn("concept_count", F.size("concepts")).where(F.col("concept_count") >= least).join(bars.select("trade_date", "ts_code", "pct_chg", "amount"), ["trade_date", "ts_code"], "left")
    w = Window.partitionBy("trade_date").orderBy(F.desc("concept_count"), F.desc_nulls_last("pct_chg"), F.desc_nulls_last("amount"), "ts_code")
    return m.withColumn("focus_rank", F.row_number().over(w))


def industry_trends(hits: DataFrame, instruments: DataFrame) -> DataFrame:
    """Hits by date and industry on a dense grid, with the change against the date before, first sight, new and removed."""
    own = hits.join(instruments.select("ts_code", "industry"), "ts_code", "left").withColumn("industry", F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.lit(NO_INDUSTRY)))
    n = own.groupBy("trade_date", "industry").agg(F.count("*").alias("n"))
    grid = n.select("trade_date").distinct().crossJoin(F.broadcast(n.select("industry").distinct()))  # two small dimensions
    w = Window.partitionBy("industry").orderBy("trade_date")
    out = grid.join(n, ["trade_date", "industry"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("previous", F.coalesce(F.lag("n").over(w), F.lit(0)))
    first = F.min(F.when(F.col("n") > 0, F.col("trade_date"))).over(Window.partitionBy("industry"))
    return out.withColumns({"change": F.col("n") - F.col("previous"), "is_new": (F.col("n") > 0) & (F.col("previous") == 0), "is_removed": (F.col("n") == 0) & (F.col("previous") > 0), "first_seen": first})
