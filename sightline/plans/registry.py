"""All panel queries and their DuckDB twins, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, cross_section, evaluation, labels, models, panel, rolling, schedules, signals
from ..sources import columns, library, market
from ..streaming import windows as stream
from . import catalog, contracts, dag, experiment, signal_plan

QUERIES: dict = {}
ORACLE: dict = {}
KEYS = ["security_id", "session"]


def query(sql: str | None = None, days: str = "session"):
    """Registers a function of (spark, sf_dir) under its name, with SQL that computes the same.

    days names the result's date columns, which both sides give as text: engines differ in how they hand dates over.
    """
    names = days.split()

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c in names})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return put


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return market.supplier_panel(spark, sf)


_LINES = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
#: The supplier panel as common table expressions.
P = f"""WITH px AS (SELECT l_suppkey AS security_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS session, l_extendedprice / l_quantity AS p, * FROM lineitem),
bars AS (SELECT security_id, session, first(p ORDER BY {_LINES}) AS open, last(p ORDER BY {_LINES}) AS close, max(p) AS high, min(p) AS low, sum(l_extendedprice) AS amount FROM px GROUP BY 1, 2),
cal AS (SELECT session, row_number() OVER (ORDER BY session) AS pos FROM (SELECT DISTINCT session FROM bars)),
uni AS (SELECT DISTINCT security_id FROM bars),
panel AS (SELECT u.security_id, c.session, c.pos, open, close, high, low, amount, n_regionkey AS industry, (u.security_id + c.pos) % 7 <> 0 AS member
  FROM uni u CROSS JOIN cal c LEFT JOIN bars b ON b.security_id = u.security_id AND b.session = c.session LEFT JOIN supplier ON s_suppkey = u.security_id LEFT JOIN nation ON n_nationkey = s_nationkey)"""
W = "PARTITION BY security_id ORDER BY pos"


def _over(n: int, to: int = 0) -> str:
    return f"({W} ROWS BETWEEN {n - 1 + to} PRECEDING AND {f'{to} PRECEDING' if to else 'CURRENT ROW'})"


# the flagship


def momentum_signal(spark: SparkSession, sf: str) -> DataFrame:
    nodes, outputs = catalog.rotation_recipe(3)
    return dag.compile_plan(_panel(spark, sf), nodes, outputs)


_MOM = f"""{P}, m AS (SELECT *, CASE WHEN count(CASE WHEN close > 0 THEN close END) OVER {_over(4)} = 4 THEN close / lag(close, 3) OVER ({W}) - 1 END AS momentum FROM panel),
r AS (SELECT *, CASE WHEN member AND momentum IS NOT NULL THEN (rank() OVER (PARTITION BY session, member AND momentum IS NOT NULL ORDER BY momentum)
  + (count(*) OVER (PARTITION BY session, member AND momentum IS NOT NULL, momentum) - 1) / 2.0) / count(*) OVER (PARTITION BY session, member AND momentum IS NOT NULL) END AS momentum_rank FROM m)"""


@query(f"{_MOM}, t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY momentum DESC, security_id) AS rank FROM r WHERE momentum > 0) SELECT session, security_id, round(momentum, 6) AS momentum, round(momentum_rank, 6)::DOUBLE AS momentum_rank, rank FROM t WHERE rank <= 1")
def momentum_top1(spark, sf):
    best = signals.top_k(momentum_signal(spark, sf), 1, "momentum")
    return best.select("session", "security_id", *_r("momentum", "momentum_rank"), "rank")


# grid and scans


@query(f"{P} SELECT security_id, session, pos, round(close, 6) AS close, member FROM panel")
def panel_grid(spark, sf):
    return _panel(spark, sf).select("security_id", "session", "pos", *_r("close"), "member")


@query(f"{P} SELECT coalesce(CASE WHEN close IS NULL THEN 'grid_hole' END, 'present') AS reason, count(*) AS n FROM panel GROUP BY 1", days="")
def panel_grid_reasons(spark, sf):
    return panel.grid_reasons(_panel(spark, sf), ["close"]).groupBy(F.coalesce("close__missing_reason", F.lit("present")).alias("reason")).agg(F.count("*").alias("n"))


_DAYS = "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders)"


def _days(spark, sf):
    return market.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("session")).distinct()


@query(f"{_DAYS} SELECT isoyear(session)::INT AS iso_year, week(session)::INT AS iso_week, min(session) AS session FROM d GROUP BY 1, 2")
def calendar_first_of_iso_week(spark, sf):
    return panel.first_of_iso_week(_days(spark, sf))


@query(f"{_DAYS} SELECT session, lag(session) OVER (ORDER BY session) AS prediction_session FROM d", days="session prediction_session")
def prediction_sessions(spark, sf):
    return panel.previous_session(_days(spark, sf)).select("session", "prediction_session")


@query(f"{P} SELECT security_id, count(*) AS n FROM bars WHERE security_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1", days="")
def semi_universe(spark, sf):
    universe = market.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("security_id"))
    return panel.in_universe(market.monthly_bars(market.table(spark, sf, "lineitem")), universe).groupBy("security_id").agg(F.count("*").alias("n"))


@query(f"{P} SELECT security_id, session FROM panel p WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.security_id = p.security_id AND b.session = p.session)")
def anti_missing_keys(spark, sf):
    bars = market.monthly_bars(market.table(spark, sf, "lineitem"))
    return panel.missing_keys(_panel(spark, sf), bars)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", days="")
def grid_repeated_keys(spark, sf):
    return panel.repeated_keys(market.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("count", "n")


@query(f"{_DAYS}, s AS (SELECT session, CASE WHEN isodow(session) < 6 THEN 'open' ELSE 'closed' END AS state FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY))::DATE AS session) WHERE day(session) <> 13) SELECT k.session, CASE WHEN s.state IS NULL THEN 'unprobed' WHEN s.state = 'open' AND d.session IS NULL THEN 'open_without_session' ELSE 'session_while_closed' END AS problem FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY))::DATE AS session) k LEFT JOIN s USING (session) LEFT JOIN d USING (session) WHERE s.state IS NULL OR (s.state = 'open') <> (d.session IS NOT NULL)")
def calendar_probe(spark, sf):
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'1995-12-31')) AS session").filter(F.dayofmonth("session") != 13)
    states = days.withColumn("state", F.when(F.weekday("session") < 5, "open").otherwise("closed"))
    return panel.probe_calendar(states, _days(spark, sf), "1995-01-01", "1995-12-31")


@query("WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) + INTERVAL 20 DAY AS last_day FROM orders), m AS (SELECT *, CASE WHEN first_day <= max(last_day) OVER (PARTITION BY o_custkey ORDER BY first_day, last_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM r), i AS (SELECT *, sum(opens) OVER (PARTITION BY o_custkey ORDER BY first_day, last_day ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT o_custkey, min(first_day) AS first_day, max(last_day)::DATE AS last_day FROM i GROUP BY o_custkey, island", days="first_day last_day")
def range_coalescing(spark, sf):
    rows = market.table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("first_day"))
    return panel.coalesce_ranges(rows.withColumn("last_day", F.date_add("first_day", 20)), ["o_custkey"], "first_day", "last_day")


@query(f"{P} SELECT security_id, session, pos FROM panel WHERE (pos >= 3 AND pos < 9) OR (pos >= 20 AND pos < 21)")
def index_ranges(spark, sf):
    ranges = spark.createDataFrame([(3, 9), (20, 21)], "start long, stop long")
    return panel.in_ranges(_panel(spark, sf), ranges).select("security_id", "session", "pos")


# pointwise


@query(f"{P} SELECT security_id, session, round((high - low) / nullif(open - close, 0), 6) AS x FROM panel")
def pw_safe_divide(spark, sf):
    return _panel(spark, sf).select(*KEYS, S.divide(F.col("high") - F.col("low"), F.col("open") - F.col("close")).alias("x")).select(*KEYS, *_r("x"))


@query(f"{P} SELECT security_id, session, CASE WHEN close > open THEN round(close, 6) WHEN NOT close > open THEN round(-open, 6) END AS x FROM panel")
def pw_where_preserve(spark, sf):
    return _panel(spark, sf).select(*KEYS, S.where(F.col("close") > F.col("open"), F.round("close", 6), F.round(-F.col("open"), 6)).alias("x"))


@query(f"{P} SELECT security_id, session, close > open AND member AS both, close > open OR member AS either, NOT close > open AS falls, close IS NULL AS missing FROM panel")
def pw_logic_missing(spark, sf):
    up = F.col("close") > F.col("open")
    return _panel(spark, sf).select(*KEYS, (up & F.col("member")).alias("both"), (up | F.col("member")).alias("either"), (~up).alias("falls"), F.isnull("close").alias("missing"))


@query(f"{P} SELECT security_id, session, round(ln(1 + amount), 6) AS logged, round(abs(open - close), 6) AS apart, CASE WHEN close IS NOT NULL THEN round(greatest(1000.0::DOUBLE, least(close, 1500.0::DOUBLE)), 6) END AS clipped, coalesce(round(close, 6), 0.0::DOUBLE) AS filled FROM panel")
def pw_log1p_abs_clip(spark, sf):
    return _panel(spark, sf).select(*KEYS, F.round(F.log1p("amount"), 6).alias("logged"), F.round(F.abs(F.col("open") - F.col("close")), 6).alias("apart"), F.round(S.clip(F.col("close"), 1000, 1500), 6).alias("clipped"), S.fill(F.round("close", 6), 0.0).alias("filled"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::FLOAT::DOUBLE AS x FROM lineitem", days="")
def pw_float32_projection(spark, sf):
    return market.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.float32(F.col("l_extendedprice")).alias("x"))


@query(f"{P}, s AS (SELECT avg(close) AS c, stddev_pop(close) AS d FROM panel) SELECT security_id, session, round(CASE WHEN close IS NULL THEN 0.0 ELSE greatest(-3.0, least(3.0, (close - c) / CASE WHEN d = 0 THEN 1 ELSE d END)) END, 6)::DOUBLE AS x FROM panel, s")
def pw_frozen_preprocessing(spark, sf):
    p = _panel(spark, sf)
    stats = p.agg(F.avg("close").alias("c"), F.stddev_pop("close").alias("d"))
    return p.crossJoin(F.broadcast(stats)).select(*KEYS, F.round(S.frozen_transform(F.col("close"), F.col("c"), F.col("d")), 6).alias("x"))


@query("SELECT event_id, date_diff('day', CAST('2020-01-01' AS DATE), CAST(ts AS DATE))::INT AS age, epoch_us(date_trunc('second', ts)) AS floored, CAST(ceil(epoch_us(ts) / 1000000.0) AS BIGINT) * 1000000 AS ceiled FROM events", days="")
def pw_clocks_and_age(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return market.table(spark, sf, "events").select("event_id", S.calendar_age(ts.cast("date"), F.lit("2020-01-01").cast("date")).alias("age"), F.unix_micros(S.floor_second(ts)).alias("floored"), F.unix_micros(S.ceil_second(ts)).alias("ceiled"))


# time series


@query(f"{P} SELECT security_id, session, round(lag(close, 2) OVER ({W}), 6) AS x FROM panel")
def ts_shift(spark, sf):
    return _panel(spark, sf).select(*KEYS, F.round(rolling.shift(F.col("close"), 2), 6).alias("x"))


@query(f"{P} SELECT security_id, session, round(close / nullif(lag(close, 3) OVER ({W}), 0) - 1, 6) AS x FROM panel")
def ts_pct_change(spark, sf):
    return _panel(spark, sf).select(*KEYS, F.round(rolling.pct_change(F.col("close"), 3), 6).alias("x"))


def _rolling_query(name: str, reduction: str, sql: str, **kw):
    def run(spark, sf):
        return _panel(spark, sf).select(*KEYS, F.round(rolling.rolling(F.col("close"), 6, reduction, **kw), 6).alias("x"))

    run.__name__ = name
    query(f"{P} SELECT security_id, session, round(CASE WHEN count(close) OVER {_over(6)} = 6 THEN {sql} END, 6)::DOUBLE AS x FROM panel")(run)


for _name, _sql in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("median", "median")):
    _rolling_query(f"ts_rolling_{_name}", _name, f"{_sql}(close) OVER {_over(6)}")
_rolling_query("ts_rolling_std1", "std", f"stddev_samp(close) OVER {_over(6)}", ddof=1)
_rolling_query("ts_rolling_std0", "std", f"stddev_pop(close) OVER {_over(6)}", ddof=0)
_LIST = f"list(close) OVER {_over(6)}"
_rolling_query("ts_rolling_rank", "rank", f"(len(list_filter({_LIST}, lambda e: e < close)) + (len(list_filter({_LIST}, lambda e: e = close)) + 1) / 2.0) / len({_LIST})")


@query(f"{P} SELECT security_id, session, round(CASE WHEN count(close) OVER {_over(6, 1)} >= 3 THEN avg(close) OVER {_over(6, 1)} END, 6) AS x FROM panel")
def ts_rolling_exclusive_min_periods(spark, sf):
    return _panel(spark, sf).select(*KEYS, F.round(rolling.rolling(F.col("close"), 6, "mean", min_periods=3, inclusive=False), 6).alias("x"))


@query(f"{P} SELECT security_id, session, round(CASE WHEN count(CASE WHEN close > 0 THEN close END) OVER {_over(4)} = 4 THEN close / lag(close, 3) OVER ({W}) - 1 END, 6) AS x FROM panel")
def ts_full_window_momentum(spark, sf):
    c = F.col("close")
    return _panel(spark, sf).select(*KEYS, F.round(rolling.full_window(rolling.pct_change(c, 3), S.positive(c), 4), 6).alias("x"))


# catalogs


def _features(spark, sf, nodes, outputs):
    out = dag.compile_plan(_panel(spark, sf), nodes, outputs)
    return out.select(*KEYS, *(F.round(F.col(o), 6).alias(o.lower()) for o in outputs))


def _ret(k):
    return f"round(CASE WHEN count(CASE WHEN close > 0 THEN close END) OVER {_over(k + 1)} = {k + 1} THEN close / lag(close, {k}) OVER ({W}) - 1 END, 6) AS ret{k}"


@query(f"{P} SELECT security_id, session, {_ret(1)}, {_ret(5)}, {_ret(20)}, round((high - low) / nullif(close, 0), 6) AS intraday_range, round(close / nullif(open, 0) - 1, 6) AS close_to_open, round(amount / nullif(CASE WHEN count(amount) OVER {_over(5)} = 5 THEN avg(amount) OVER {_over(5)} END, 0), 6) AS amount_relative_5 FROM panel")
def feat_stock6(spark, sf):
    return _features(spark, sf, *catalog.stock_catalog())


@query(f"""{P} SELECT security_id, session, round((close-open)/open, 6) AS kmid, round((high-low)/open, 6) AS klen, round((close-open)/(high-low+1e-12), 6) AS kmid2,
 round((high-greatest(open,close))/open, 6) AS kup, round((high-greatest(open,close))/(high-low+1e-12), 6) AS kup2, round((least(open,close)-low)/open, 6) AS klow, round((least(open,close)-low)/(high-low+1e-12), 6) AS klow2,
 round((2*close-high-low)/open, 6) AS ksft, round((2*close-high-low)/(high-low+1e-12), 6) AS ksft2, round(open/close, 6) AS open0, round(high/close, 6) AS high0, round(low/close, 6) AS low0 FROM panel""")
def feat_kbar(spark, sf):
    b = catalog.Builder()
    outputs = catalog.bar_features(b)
    return _features(spark, sf, b.nodes, outputs)


def _whole(x: str, n: int, body: str) -> str:
    return f"CASE WHEN count({x}) OVER {_over(n)} = {n} THEN {body} END"


def _agg(f: str, x: str, n: int) -> str:
    return _whole(x, n, f"{f}({x}) OVER {_over(n)}")


def _rolling13(d: int) -> str:
    rank = _whole("close", d, f"(len(list_filter(list(close) OVER {_over(d)}, lambda e: e < close)) + (len(list_filter(list(close) OVER {_over(d)}, lambda e: e = close)) + 1) / 2.0) / {d}")
    top, low, total = _agg("max", "high", d), _agg("min", "low", d), _agg("sum", "move", d)
    parts = {
        f"roc{d}": f"lag(close, {d}) OVER ({W}) / close", f"ma{d}": f"{_agg('avg', 'close', d)} / close", f"std{d}": f"{_agg('stddev_samp', 'close', d)} / close", f"max{d}": f"{top} / close", f"min{d}": f"{low} / close", f"rank{d}": rank,
        f"rsv{d}": f"(close - {low}) / ({top} - {low} + 1e-12)", f"cntp{d}": _agg("avg", "rise", d), f"cntn{d}": _agg("avg", "fall", d), f"cntd{d}": f"{_agg('avg', 'rise', d)} - {_agg('avg', 'fall', d)}",
        f"sump{d}": f"{_agg('sum', 'gain', d)} / ({total} + 1e-12)", f"sumn{d}": f"{_agg('sum', 'loss', d)} / ({total} + 1e-12)", f"sumd{d}": f"{_agg('sum', 'gain', d)} / ({total} + 1e-12) - {_agg('sum', 'loss', d)} / ({total} + 1e-12)",
    }
    return ", ".join(f"round({v}, 6)::DOUBLE AS {k}" for k, v in parts.items())


_MOVES = f"""{P}, l AS (SELECT *, lag(close) OVER ({W}) AS last FROM panel), d AS (SELECT *, CASE WHEN last IS NOT NULL AND close IS NOT NULL THEN (close > last)::INT::DOUBLE END AS rise, CASE WHEN last IS NOT NULL AND close IS NOT NULL THEN (close < last)::INT::DOUBLE END AS fall,
 CASE WHEN last IS NOT NULL AND close IS NOT NULL THEN greatest(close - last, 0.0::DOUBLE) END AS gain, CASE WHEN last IS NOT NULL AND close IS NOT NULL THEN greatest(last - close, 0.0::DOUBLE) END AS loss, abs(close - last) AS move, close / nullif(last, 0) - 1 AS ret1, abs(close / nullif(last, 0) - 1) / nullif(amount, 0) AS ill FROM l)"""


@query(f"{_MOVES} SELECT security_id, session, {_rolling13(5)}, {_rolling13(10)} FROM d")
def feat_rolling13(spark, sf):
    b = catalog.Builder()
    outputs = catalog.rolling_features(b, (5, 10))
    return _features(spark, sf, b.nodes, outputs)


@query(f"{_MOVES} SELECT security_id, session, {', '.join(map(_rolling13, catalog.WINDOWS))} FROM d")
def feat_rolling_all(spark, sf):
    """The thirteen families at all their windows."""
    b = catalog.Builder()
    outputs = catalog.rolling_features(b)
    return _features(spark, sf, b.nodes, outputs)


_RET = f"(close / nullif(lag(close, 12) OVER ({W}), 0) - 1)"


@query(f"""{_MOVES} SELECT security_id, session, round({_RET}, 6) AS ret12, round({_agg('avg', 'rise', 12)}, 6) AS up12, round(abs(close - lag(close, 12) OVER ({W})) / ({_agg('sum', 'move', 12)} + 1e-12), 6) AS smooth12,
 round((close - {_agg('min', 'low', 18)}) / ({_agg('max', 'high', 18)} - {_agg('min', 'low', 18)} + 1e-12), 6) AS pricepos18, round({_RET} / ({_agg('stddev_samp', 'ret1', 12)} + 1e-12), 6) AS voladjret12, round(ln(1 + amount), 6) AS log_amount,
 round(amount / {_agg('avg', 'amount', 4)}, 6) AS amount_rel4, round(amount / {_agg('avg', 'amount', 12)}, 6) AS amount_rel12, round((amount - {_agg('avg', 'amount', 4)}) / ({_agg('stddev_pop', 'amount', 4)} + 1e-12), 6) AS amount_z4,
 round({_agg('stddev_samp', 'amount', 4)} / {_agg('avg', 'amount', 4)}, 6) AS amount_cv4, round(1e6 * {_agg('avg', 'ill', 4)}, 6) AS illiq4 FROM d""")
def feat_extensions(spark, sf):
    b = catalog.Builder()
    outputs = catalog.extension_features(b, 12, 18, 4)
    out = dag.compile_plan(_panel(spark, sf), b.nodes, outputs)
    return out.select(*KEYS, *(F.round(F.col(o) * (1e6 if o.startswith("ILLIQ") else 1.0), 6).alias(o.lower()) for o in outputs))


# the daily panel, with the catalogs' own windows


def _daily(spark, sf):
    return market.daily_panel(spark, sf)


_DORDER = f"{_LINES}, l_quantity, l_suppkey"
#: The daily panel of regions as common table expressions.
DP = f"""WITH reg AS (SELECT s_suppkey, n_regionkey AS security_id FROM supplier JOIN nation ON n_nationkey = s_nationkey),
px AS (SELECT security_id, CAST(l_shipdate AS DATE) AS session, l_extendedprice / l_quantity AS p, lineitem.* FROM lineitem JOIN reg ON l_suppkey = s_suppkey),
bars AS (SELECT security_id, session, first(p ORDER BY {_DORDER}) AS open, last(p ORDER BY {_DORDER}) AS close, max(p) AS high, min(p) AS low, sum(l_extendedprice) AS amount FROM px GROUP BY 1, 2),
cal AS (SELECT session, row_number() OVER (ORDER BY session) AS pos FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem)),
live AS (SELECT b.* FROM bars b JOIN cal USING (session) WHERE security_id <> 4 OR pos <= (SELECT max(pos) FROM cal) - 100),
panel AS (SELECT u.security_id, c.session, c.pos, open, close, high, low, amount, TRUE AS member FROM (SELECT DISTINCT security_id FROM reg) u CROSS JOIN cal c LEFT JOIN live b ON b.security_id = u.security_id AND b.session = c.session)"""
_DMOVES = DP + _MOVES[len(P):]


def _extensions_sql(long: int, year: int, month: int) -> str:
    back = f"(close / nullif(lag(close, {long}) OVER ({W}), 0) - 1)"
    parts = {
        f"ret{long}": back, f"up{long}": _agg("avg", "rise", long), f"smooth{long}": f"abs(close - lag(close, {long}) OVER ({W})) / ({_agg('sum', 'move', long)} + 1e-12)",
        f"pricepos{year}": f"(close - {_agg('min', 'low', year)}) / ({_agg('max', 'high', year)} - {_agg('min', 'low', year)} + 1e-12)", f"voladjret{long}": f"{back} / ({_agg('stddev_samp', 'ret1', long)} + 1e-12)", "log_amount": "ln(1 + amount)",
        f"amount_rel{month}": f"amount / {_agg('avg', 'amount', month)}", f"amount_rel{3 * month}": f"amount / {_agg('avg', 'amount', 3 * month)}", f"amount_z{month}": f"(amount - {_agg('avg', 'amount', month)}) / ({_agg('stddev_pop', 'amount', month)} + 1e-12)",
        f"amount_cv{month}": f"{_agg('stddev_samp', 'amount', month)} / {_agg('avg', 'amount', month)}", f"illiq{month}": f"1e6 * {_agg('avg', 'ill', month)}",
    }
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in parts.items())


@query(f"{_DMOVES} SELECT security_id, session, {_extensions_sql(120, 252, 20)} FROM d")
def feat_extensions_daily(spark, sf):
    """The extensions over 120, 252, 20 and 60 sessions."""
    b = catalog.Builder()
    outputs = catalog.extension_features(b)
    out = dag.compile_plan(_daily(spark, sf), b.nodes, outputs)
    return out.select(*KEYS, *(F.round(F.col(o) * (1e6 if o.startswith("ILLIQ") else 1.0), 6).alias(o.lower()) for o in outputs))


def daily_factors(p: DataFrame) -> DataFrame:
    """A factor that steps up every 250 sessions, missing for some cells, among them those of the last session of region 2."""
    there = ((F.col("security_id") * 3 + F.col("pos")) % 97 != 0) & ~((F.col("security_id") == 2) & (F.col("pos") == F.col("last")))
    last = p.agg(F.max("pos").alias("last"))
    return p.crossJoin(F.broadcast(last)).select(*KEYS, F.when(there, 1 + 0.25 * F.floor((F.col("pos") - 1) / 250)).cast("double").alias("factor"))


_DROT = f"""{DP}, f AS (SELECT *, CASE WHEN (security_id * 3 + pos) % 97 <> 0 AND NOT (security_id = 2 AND pos = (SELECT max(pos) FROM cal)) THEN close * (1 + 0.25 * floor((pos - 1) / 250)) END::DOUBLE AS a FROM panel),
m AS (SELECT *, CASE WHEN count(CASE WHEN a > 0 THEN a END) OVER {_over(21)} = 21 THEN a / lag(a, 20) OVER ({W}) - 1 END AS momentum FROM f)"""


@query(f"{_DROT} SELECT security_id, session, round(CASE WHEN a > 0 THEN close END, 8) AS adjusted_close, round(momentum, 6) AS momentum, round(CASE WHEN momentum IS NOT NULL THEN (rank() OVER (PARTITION BY session, momentum IS NOT NULL ORDER BY momentum) + (count(*) OVER (PARTITION BY session, momentum IS NOT NULL, momentum) - 1) / 2.0) / count(*) OVER (PARTITION BY session, momentum IS NOT NULL) END, 6)::DOUBLE AS momentum_rank FROM m")
def rotation_daily20(spark, sf):
    """Momentum over 20 sessions of prices adjusted to each row's own session; one security stops early, one has no factor on the last day."""
    p = _daily(spark, sf)
    return experiment.rotation_features(p, daily_factors(p)).select(*KEYS, *_r("adjusted_close", digits=8), *_r("momentum", "momentum_rank"))


@query(f"""{_DROT}, t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY momentum DESC, security_id) AS rank FROM m WHERE momentum > 0), b AS MATERIALIZED (SELECT c.pos, c.session, coalesce(list(security_id ORDER BY rank) FILTER (rank <= 3), []) AS names FROM cal c LEFT JOIN t USING (session) GROUP BY 1, 2),
h AS (WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(NULL AS DATE) AS session, CAST([] AS BIGINT[]) AS held UNION ALL
 SELECT b.pos, b.session, list_slice(list_concat(list_filter(r.held, lambda x: list_contains(b.names, x)), list_filter(b.names, lambda x: NOT list_contains(r.held, x))), 1, 2) FROM r JOIN b ON b.pos = r.pos + 1) SELECT * FROM r)
SELECT session, array_to_string(held, ',') AS held FROM h WHERE pos > 0""")
def rank_buffer(spark, sf):
    """At most two holdings, each kept while it ranks among the best three."""
    p = _daily(spark, sf)
    scores = experiment.rotation_features(p, daily_factors(p)).select(*KEYS, F.col("momentum").alias("score"))
    return signals.rank_buffer(scores, 2, 3).select("session", F.array_join(F.transform("held", lambda x: x.cast("string")), ",").alias("held"))


@query(f"{DP} SELECT security_id, session, close::FLOAT::DOUBLE AS close, (close IS NULL)::INT * CASE WHEN security_id = 4 THEN 4 ELSE 1 END AS code, CASE WHEN close IS NOT NULL THEN epoch_us(session + INTERVAL 12 HOUR) END AS at_us FROM panel")
def column_source(spark, sf):
    """Cells of a column source: single precision, reason codes, clocks."""
    p = _daily(spark, sf).withColumns({"close__missing_reason": F.when(F.col("close").isNull(), F.when(F.col("security_id") == 4, "suspended").otherwise("grid_hole")), "close__at": F.col("session").cast("timestamp") + F.expr("interval 12 hours")})
    out = columns.columns_of(p, ["close"])
    return out.select(*KEYS, F.col("close").cast("double").alias("close"), F.col("close__code").cast("int").alias("code"), F.col("close__at_us").alias("at_us"))


# cross-section


@query(f"{P} SELECT security_id, session, round(CASE WHEN member AND stddev_pop(CASE WHEN member THEN close END) OVER s > 1e-12 THEN (close - avg(CASE WHEN member THEN close END) OVER s) / stddev_pop(CASE WHEN member THEN close END) OVER s END, 6) AS x FROM panel WINDOW s AS (PARTITION BY session)")
def cs_zscore_members(spark, sf):
    return cross_section.zscore(_panel(spark, sf), "close", "member", "x").select(*KEYS, *_r("x"))


@query(f"{P} SELECT security_id, session, round(CASE WHEN member AND stddev_pop(CASE WHEN member THEN close END) OVER s > 1e-12 THEN (close - avg(CASE WHEN member THEN close END) OVER s) / stddev_pop(CASE WHEN member THEN close END) OVER s END, 6) AS x FROM panel WINDOW s AS (PARTITION BY session, industry)")
def cs_zscore_group(spark, sf):
    return cross_section.zscore(_panel(spark, sf), "close", "member", "x", group=("industry",)).select(*KEYS, *_r("x"))


@query(f"{P}, q AS (SELECT *, floor(close / 100) AS c, member AND close IS NOT NULL AS able FROM panel) SELECT security_id, session, round(CASE WHEN able THEN (rank() OVER (PARTITION BY session, able ORDER BY c) + (count(*) OVER (PARTITION BY session, able, c) - 1) / 2.0) / count(*) OVER (PARTITION BY session, able) END, 6)::DOUBLE AS x FROM q")
def cs_rank_average(spark, sf):
    p = _panel(spark, sf).withColumn("c", F.floor(F.col("close") / 100).cast("double"))
    return p.select(*KEYS, F.round(cross_section.rank_column(F.col("c"), F.col("member")), 6).alias("x"))


@query(f"{P}, q AS (SELECT session, quantile_cont(CASE WHEN member THEN close END, [0.01, 0.99]) AS q FROM panel GROUP BY 1) SELECT security_id, p.session, round(CASE WHEN member AND close IS NOT NULL THEN greatest(q[1], least(q[2], close)) END, 6) AS x FROM panel p JOIN q USING (session)")
def cs_winsorize(spark, sf):
    return cross_section.winsorize(_panel(spark, sf), "close", "member", "x").select(*KEYS, *_r("x"))


# joins and time

_F = ", fac AS (SELECT security_id, session, pos, CASE WHEN (security_id * 3 + pos) % 41 <> 0 THEN 1 + 0.25 * floor((pos - 1) / 12) END::DOUBLE AS factor FROM panel)"


@query(f"{P}{_F}, a AS (SELECT security_id, factor AS af FROM fac WHERE pos = (SELECT max(pos) FROM cal)) SELECT p.security_id, p.session, round(close * factor / nullif(af, 0), 6) AS x, CASE WHEN close IS NULL THEN 'price_missing' WHEN factor IS NULL THEN 'factor_missing' WHEN af IS NULL THEN 'anchor_factor_missing' WHEN af = 0 THEN 'anchor_factor_zero' END AS reason FROM panel p LEFT JOIN fac USING (security_id, session) LEFT JOIN a ON a.security_id = p.security_id")
def price_anchor_adjust(spark, sf):
    p = _panel(spark, sf)
    anchor = p.agg(F.max("session").alias("anchor_session"))
    out = asof.adjust_to_anchor(p, market.factors(p), ["close"], anchor)
    return out.select(*KEYS, F.round("close__adjusted", 6).alias("x"), F.col("close__reason").alias("reason"))


_E = """WITH e AS (SELECT user_id AS security_id, CAST(ts AS DATE) - CAST(event_id % 10 AS INT) AS report_period, ts AS usable_from, event_id AS revision_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events),
s AS (SELECT u.security_id, d.session, d.session + INTERVAL 20 HOUR AS cutoff FROM (SELECT DISTINCT security_id FROM e) u CROSS JOIN (SELECT DISTINCT CAST(usable_from AS DATE) AS session FROM e) d),"""


def _latest(op: str) -> str:
    return f"""{_E} j AS (SELECT s.security_id, s.session, e.*, row_number() OVER (PARTITION BY s.security_id, s.session ORDER BY report_period DESC, usable_from DESC, revision_id DESC) AS rn
 FROM s LEFT JOIN e ON e.security_id = s.security_id AND e.usable_from {op} s.cutoff AND e.report_period <= s.session)
 SELECT security_id, session, round(value, 6) AS value, report_period AS value_period, epoch_us(usable_from) AS value_at FROM j WHERE rn = 1"""


def _reports(spark, sf, strict):
    e = market.table(spark, sf, "events")
    out = asof.latest_report(market.report_sessions(e), market.report_events(e), "value", "value", strict=strict)
    return out.select("security_id", "session", *_r("value"), "value_period", F.unix_micros("value_at").alias("value_at"))


@query(_latest("<="), days="session value_period")
def asof_latest_visible(spark, sf):
    return _reports(spark, sf, False)


@query(_latest("<"), days="session value_period")
def asof_strict(spark, sf):
    return _reports(spark, sf, True)


@query(f"{_E} r AS (SELECT *, row_number() OVER (PARTITION BY security_id, report_period ORDER BY usable_from DESC, revision_id DESC) AS rn FROM e) SELECT security_id, report_period, revision_id, round(value, 6) AS value, value IS NULL AS retracted FROM r WHERE rn = 1", days="report_period")
def asof_revision_retraction(spark, sf):
    latest = asof.latest_revision(market.report_events(market.table(spark, sf, "events")), ["security_id", "report_period"])
    return latest.select("security_id", "report_period", "revision_id", *_r("value"), F.isnull("value").alias("retracted"))


@query(f"{P}, o AS (SELECT security_id, session, pos, session + INTERVAL 20 DAY AS cutoff FROM panel), f AS (SELECT security_id, pos, close, session + to_days(CAST(security_id % 45 AS INT)) AS usable_from FROM panel) SELECT c.session AS out_session, f.security_id, count(close) AS n, round(sum(close), 8) AS total FROM f JOIN (SELECT DISTINCT session, pos, cutoff FROM o) c ON f.pos <= c.pos AND f.pos > c.pos - 4 AND f.usable_from <= c.cutoff GROUP BY 1, 2", days="out_session")
def pit_window_rule(spark, sf):
    p = _panel(spark, sf)
    facts = p.select("security_id", "pos", "close", F.date_add("session", (F.col("security_id") % 45).cast("int")).alias("usable_from"))
    outputs = p.select(F.col("session").alias("out_session"), F.col("pos").alias("out_pos"), F.date_add("session", 20).alias("cutoff")).distinct()
    return asof.visible_window(facts, outputs, 4).groupBy("out_session", "security_id").agg(F.count("close").alias("n"), F.round(F.sum("close"), 8).alias("total"))


@query(f"{P} SELECT b.security_id, b.session, round(b.close, 6) AS close, round(a.amount, 4) AS amount FROM bars b JOIN (SELECT security_id, session, amount FROM bars) a USING (security_id, session)")
def join_one_to_one(spark, sf):
    bars = market.monthly_bars(market.table(spark, sf, "lineitem"))
    out = panel.join_one_to_one(bars.select(*KEYS, "close"), bars.select(*KEYS, "amount"))
    return out.select(*KEYS, *_r("close"), F.round("amount", 4).alias("amount"))


@query("WITH a AS (SELECT o_custkey AS security_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS session, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey AS security_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS session, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) SELECT security_id, session, round(total, 4) AS orders__total, n AS filled__n FROM a JOIN b USING (security_id, session)")
def joint_panel(spark, sf):
    o = market.table(spark, sf, "orders").select(F.col("o_custkey").alias("security_id"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("session"), "o_totalprice", "o_orderstatus")
    a = o.groupBy(*KEYS).agg(F.sum("o_totalprice").alias("total"))
    b = o.filter("o_orderstatus = 'F'").groupBy(*KEYS).agg(F.count("*").alias("n"))
    return panel.merge_domains({"orders": a, "filled": b}).withColumn("orders__total", F.round("orders__total", 4))


# labels

_LAB = f"""{P}, l0 AS (SELECT *, lead(session, 1) OVER ({W}) AS start_session, lead(session, 3) OVER ({W}) AS end_session, lead(open, 1) OVER ({W}) AS s, lead(close, 3) OVER ({W}) AS e,
  greatest(lead(session + INTERVAL 40 DAY, 1) OVER ({W}), lead(session + INTERVAL 40 DAY, 3) OVER ({W})) AS label_available_at FROM panel),
lab AS (SELECT *, CASE WHEN end_session IS NULL THEN 'calendar_endpoint_uncovered' WHEN s IS NULL THEN 'start_missing' WHEN s <= 0 THEN 'start_not_positive' WHEN e IS NULL THEN 'end_missing' WHEN e <= 0 THEN 'end_not_positive' END AS invalid_reason,
  CASE WHEN s > 0 AND e > 0 THEN e / s - 1 END AS ret, s > 0 AND e > 0 AND end_session IS NOT NULL AS valid FROM l0)"""


def _labels(spark, sf):
    p = _panel(spark, sf).withColumn("clock", F.col("session").cast("timestamp") + F.expr("interval 40 days"))
    return labels.forward_labels(p, 3, clock="clock")


@query(f"{_LAB} SELECT security_id, session, start_session, end_session, round(ret, 6) AS return, invalid_reason, coalesce(valid, false) AS valid FROM lab", days="session start_session end_session")
def label_forward(spark, sf):
    return _labels(spark, sf).select(*KEYS, "start_session", "end_session", *_r("return"), "invalid_reason", "valid")


@query(f"{_LAB} SELECT coalesce(invalid_reason, 'valid') AS reason, count(*) AS n FROM lab GROUP BY 1", days="")
def label_reasons(spark, sf):
    return _labels(spark, sf).groupBy(F.coalesce("invalid_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


_CUT = "1996-05-11 00:00:00"


def _mature(op):
    return f"{_LAB} SELECT security_id, session, round(ret, 6) AS return FROM lab WHERE valid AND end_session <= DATE '1996-05-11' AND label_available_at {op} TIMESTAMP '{_CUT}'"


@query(_mature("<="))
def label_mature_inclusive(spark, sf):
    return labels.mature(_labels(spark, sf), _CUT).select(*KEYS, *_r("return"))


@query(_mature("<"))
def label_mature_strict(spark, sf):
    return labels.mature(_labels(spark, sf), _CUT, strict=True).select(*KEYS, *_r("return"))


@query(f"{P}{_F}, q AS (SELECT p.security_id, p.session, p.pos, close * factor AS adjusted FROM panel p JOIN fac USING (security_id, session)) SELECT security_id, session, round(lead(adjusted, 7) OVER ({W}) / nullif(lead(adjusted, 1) OVER ({W}), 0) - 1, 6) AS return FROM q")
def label_total_return(spark, sf):
    p = _panel(spark, sf)
    q = p.join(market.factors(p), KEYS).withColumn("adjusted", F.col("close") * F.col("factor"))
    return labels.total_return_labels(q, 6).select(*KEYS, *_r("return"))


_ELIG = f"""{_LAB}, el AS (SELECT *, CASE WHEN NOT coalesce(valid, false) THEN 'RAW_LABEL_INVALID' WHEN label_available_at IS NULL THEN 'LABEL_CLOCK_OR_ENDPOINT_UNKNOWN' WHEN label_available_at >= TIMESTAMP '{_CUT}' THEN 'LABEL_NOT_MATURE'
  WHEN NOT member THEN 'NOT_MEMBER' WHEN close IS NULL THEN 'FEATURE_MISSING' WHEN open = close THEN 'FEATURE_INVALID' END AS reason FROM lab)"""


def _eligible(spark, sf):
    rows = _labels(spark, sf).withColumns({"feature_row": F.lit(True), "features_present": F.col("close").isNotNull(), "features_valid": F.coalesce(F.col("open") != F.col("close"), F.lit(False)), "features_at": F.col("session").cast("timestamp")})
    return rows.withColumn("reason", labels.eligibility(F.to_timestamp(F.lit(_CUT))))


@query(f"{_ELIG} SELECT coalesce(reason, 'ELIGIBLE') AS reason, count(*) AS n FROM el GROUP BY 1", days="")
def train_exclusion_counts(spark, sf):
    return labels.exclusion_counts(_eligible(spark, sf))


@query(f"{_ELIG} SELECT security_id, session, round(CASE WHEN reason IS NULL AND stddev_pop(CASE WHEN reason IS NULL THEN ret END) OVER s > 1e-12 THEN (ret - avg(CASE WHEN reason IS NULL THEN ret END) OVER s) / stddev_pop(CASE WHEN reason IS NULL THEN ret END) OVER s END, 6) AS normalized, epoch_us(max(CASE WHEN reason IS NULL THEN label_available_at END) OVER s) AS normalized_at FROM el WINDOW s AS (PARTITION BY session)")
def label_normalized(spark, sf):
    return labels.normalize(_eligible(spark, sf)).select(*KEYS, *_r("normalized"), F.unix_micros("normalized_available_at").alias("normalized_at"))


@query(f"{_ELIG} SELECT security_id, session, round(close / open - 1, 6) AS feature, round(ret, 6) AS label FROM el WHERE reason IS NULL AND pos BETWEEN 10 AND 40")
def training_set(spark, sf):
    rows = _eligible(spark, sf)
    feature = rows.select(*KEYS, (F.col("close") / F.col("open") - 1).alias("feature"))
    label = rows.filter("reason is null and pos between 10 and 40").select(*KEYS, F.col("return").alias("label"))
    return feature.join(label, KEYS).select(*KEYS, *_r("feature", "label"))


# signals

_SIG = f"{P}, g AS (SELECT *, close / nullif(lag(close, 3) OVER ({W}), 0) - 1 AS m3, close / nullif(lag(close, 6) OVER ({W}), 0) - 1 AS m6, lead(close, 2) OVER ({W}) / nullif(lead(open, 1) OVER ({W}), 0) - 1 AS outcome FROM panel)"


def _scores(spark, sf):
    c = F.col("close")
    return _panel(spark, sf).select("*", rolling.pct_change(c, 3).alias("m3"), rolling.pct_change(c, 6).alias("m6"), (S.divide(rolling.shift(c, -2), rolling.shift(F.col("open"), -1)) - 1).alias("outcome"))


@query(f"{_SIG} SELECT security_id, session, round(CASE WHEN stddev_pop(m3) OVER s > 1e-12 THEN (m3 - avg(m3) OVER s) / stddev_pop(m3) OVER s END, 6) AS z FROM g WHERE m3 IS NOT NULL WINDOW s AS (PARTITION BY session)")
def signal_zscore(spark, sf):
    return signals.daily_zscore(_scores(spark, sf).filter("m3 is not null"), "m3", reject=False).select(*KEYS, *_r("z"))


@query(f"{_SIG}, z AS (SELECT security_id, session, (m3 - avg(m3) OVER s) / nullif(stddev_pop(m3) OVER s, 0) AS z3, (m6 - avg(m6) OVER s) / nullif(stddev_pop(m6) OVER s, 0) AS z6 FROM g WINDOW s AS (PARTITION BY session)) SELECT security_id, session, round(0.25 * z3 + 0.75 * z6, 6) AS score FROM z")
def signal_weighted_blend(spark, sf):
    z = signals.daily_zscore(signals.daily_zscore(_scores(spark, sf), "m3", "z3", False), "m6", "z6", False)
    return z.select(*KEYS, F.round(signals.weighted({"z3": 0.25, "z6": 0.75}), 6).alias("score"))


def _joined(spark, sf, outer):
    g = _scores(spark, sf)
    parts = {"m3": g.filter("m3 is not null and pos % 2 = 0"), "m6": g.filter("m6 is not null and pos % 3 = 0")}
    return signals.join_signals({k: v.withColumn("score", F.col(k)) for k, v in parts.items()}, outer=outer).select(*KEYS, *_r("m3", "m6"))


_JOINED = _SIG + ", a AS (SELECT security_id, session, m3 FROM g WHERE m3 IS NOT NULL AND pos % 2 = 0), b AS (SELECT security_id, session, m6 FROM g WHERE m6 IS NOT NULL AND pos % 3 = 0) SELECT security_id, session, round(m3, 6) AS m3, round(m6, 6) AS m6 FROM a {} JOIN b USING (security_id, session)"


@query(_JOINED.format("INNER"))
def signal_join_inner(spark, sf):
    return _joined(spark, sf, False)


@query(_JOINED.format("FULL OUTER"))
def signal_join_outer(spark, sf):
    return _joined(spark, sf, True)


@query(_JOINED.format("INNER").replace("SELECT security_id, session, round(m3, 6) AS m3, round(m6, 6) AS m6 FROM a INNER JOIN b USING (security_id, session)", "") + ", j AS (SELECT security_id, session, m3, m6 FROM a JOIN b USING (security_id, session)), z AS (SELECT *, CASE WHEN stddev_pop(m3) OVER s > 1e-12 THEN (m3 - avg(m3) OVER s) / stddev_pop(m3) OVER s END AS z3 FROM j WINDOW s AS (PARTITION BY session)) SELECT security_id, session, round(0.5 * z3 + 0.5 * m6, 6) AS score, z3 IS NOT NULL AS valid, CASE WHEN z3 IS NULL THEN 'MISSING_INPUT' END AS invalid_reason FROM z")
def signal_plan_blend(spark, sf):
    g = _scores(spark, sf)
    raw = {"a": g.filter("m3 is not null and pos % 2 = 0").select(*KEYS, F.col("m3").alias("score")), "b": g.filter("m6 is not null and pos % 3 = 0").select(*KEYS, F.col("m6").alias("score"))}
    n = contracts.SignalNode
    plan = contracts.SignalPlanSpec((n("a", "raw"), n("b", "raw"), n("za", "daily_zscore", ("a",)), n("mix", "weighted_combine", ("za", "b"), (0.5, 0.5))), "mix")
    return signal_plan.run_plan(plan, raw, reject=False).select(*KEYS, *_r("score"), "valid", "invalid_reason")


@query(f"{_SIG}, t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY m3 DESC, security_id) AS rank FROM g WHERE m3 > 0) SELECT session, security_id, round(m3, 6) AS m3, rank FROM t WHERE rank <= 1")
def signal_top1(spark, sf):
    return signals.top_k(_scores(spark, sf), 1, "m3").select("session", "security_id", *_r("m3"), "rank")


@query(f"{_SIG}, h AS (SELECT *, round(m3, 1) AS score FROM g), t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, security_id) AS rank FROM h WHERE score > 0) SELECT session, security_id, score, rank FROM t WHERE rank <= 5")
def signal_topk_ties(spark, sf):
    return signals.top_k(_scores(spark, sf).withColumn("score", F.round("m3", 1)), 5).select("session", "security_id", "score", "rank")


@query(f"{_SIG} SELECT security_id, session, round(m3, 6) AS score, m3 IS NOT NULL AS valid, CASE WHEN m3 IS NULL THEN 'FEATURE_MISSING' END AS invalid_reason FROM g WHERE pos <= 20 UNION ALL SELECT security_id, session, round(m6, 6), m6 IS NOT NULL, CASE WHEN m6 IS NULL THEN 'FEATURE_MISSING' END FROM g WHERE pos > 20")
def signal_concatenated(spark, sf):
    g = _scores(spark, sf).withColumn("cutoff", F.col("session").cast("timestamp"))
    parts = [signals.etf_signal(g.filter("pos <= 20"), "m3", "cutoff"), signals.etf_signal(g.filter("pos > 20"), "m6", "cutoff")]
    return panel.concatenate(parts).select(*KEYS, *_r("score"), "valid", "invalid_reason")


@query(f"{P}, t AS (SELECT isoyear(session) AS y, week(session) AS w, min(session) AS trade_session FROM cal GROUP BY 1, 2), b AS (SELECT session AS trade_session, lag(session) OVER (ORDER BY session) AS session FROM cal), g AS (SELECT *, close / nullif(lag(close, 3) OVER ({W}), 0) - 1 AS score FROM panel), r AS (SELECT trade_session, security_id, score, row_number() OVER (PARTITION BY g.session ORDER BY score DESC, security_id) AS rank FROM g JOIN b USING (session) JOIN t USING (trade_session) WHERE score > 0) SELECT trade_session, security_id, round(score, 6) AS score FROM r WHERE rank <= 2", days="trade_session")
def rotation_decisions(spark, sf):
    g = _scores(spark, sf).select(*KEYS, F.col("m3").alias("score"))
    return signals.rotation_decisions(g, g.select("session").distinct(), 2).select("trade_session", "security_id", *_r("score"))


# evaluation

_PAIRS = f"{_SIG}, pairs AS (SELECT 'm3' AS signal, security_id, session, m3 AS score, outcome FROM g WHERE member AND m3 IS NOT NULL AND outcome IS NOT NULL UNION ALL SELECT 'm6', security_id, session, m6, outcome FROM g WHERE member AND m6 IS NOT NULL AND outcome IS NOT NULL), sess AS (SELECT s.signal, session FROM cal, (VALUES ('m3'), ('m6')) AS s(signal))"


def _both(spark, sf):
    g = _scores(spark, sf)
    return g.select("*", F.explode(F.array(F.struct(F.lit("m3").alias("signal"), F.col("m3").alias("score")), F.struct(F.lit("m6").alias("signal"), F.col("m6").alias("score")))).alias("s")).select(*KEYS, "pos", "member", "outcome", "s.signal", "s.score")


def _pairs(spark, sf):
    return _both(spark, sf).filter("member and score is not null and outcome is not null").select("signal", *KEYS, "score", "outcome")


def _sessions(spark, sf):
    return _both(spark, sf).select("signal", "session").distinct()


def _ic(pairs: str, keys: str = "signal, session", minimum: int = 20) -> str:
    return f"(SELECT {keys}, count(*) AS n, min(score) = max(score) OR min(outcome) = max(outcome) AS constant, CASE WHEN min(score) = max(score) OR min(outcome) = max(outcome) THEN NULL ELSE covar_pop(score, outcome) / (stddev_pop(score) * stddev_pop(outcome)) END AS c FROM {pairs} GROUP BY {keys})"


_DAILY = "ic AS (SELECT sess.signal, sess.session, coalesce(n, 0) AS n_pairs, CASE WHEN coalesce(n, 0) >= 20 THEN c END AS ic, CASE WHEN coalesce(n, 0) < 20 THEN 'INSUFFICIENT_PAIRS' WHEN constant THEN 'CONSTANT_CROSS_SECTION' WHEN c IS NULL THEN 'NON_FINITE_CORRELATION' END AS reason FROM sess LEFT JOIN x ON x.signal = sess.signal AND x.session = sess.session)"
_RANKED = "ranked AS (SELECT signal, session, rank() OVER (PARTITION BY signal, session ORDER BY score) + (count(*) OVER (PARTITION BY signal, session, score) - 1) / 2.0 AS score, rank() OVER (PARTITION BY signal, session ORDER BY outcome) + (count(*) OVER (PARTITION BY signal, session, outcome) - 1) / 2.0 AS outcome FROM pairs)"


@query(f"{_PAIRS}, x AS {_ic('pairs')}, {_DAILY} SELECT signal, session, n_pairs, round(ic, 6) AS ic, reason FROM ic")
def ic_daily(spark, sf):
    return evaluation.daily_ic(_pairs(spark, sf), _sessions(spark, sf)).withColumn("ic", F.round("ic", 6))


@query(f"{_PAIRS}, {_RANKED}, x AS {_ic('ranked')}, {_DAILY} SELECT signal, session, n_pairs, round(ic, 6) AS ic, reason FROM ic")
def rank_ic_daily(spark, sf):
    return evaluation.daily_ic(_pairs(spark, sf), _sessions(spark, sf), rank=True).withColumn("ic", F.round("ic", 6))


_SUMMARY = "count(ic) AS n_sessions, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir, CASE WHEN count(ic) = 0 THEN 'NO_VALID_SESSIONS' WHEN count(ic) = 1 THEN 'INSUFFICIENT_VALID_SESSIONS' WHEN stddev_samp(ic) = 0 THEN 'ZERO_VARIANCE' END AS reason"


@query(f"{_PAIRS}, x AS {_ic('pairs')}, {_DAILY} SELECT signal, {_SUMMARY} FROM ic GROUP BY signal", days="")
def ic_summary(spark, sf):
    out = evaluation.ic_summary(evaluation.daily_ic(_pairs(spark, sf), _sessions(spark, sf)))
    return out.select("signal", "n_sessions", *_r("mean_ic", "std_ic", "icir"), "reason")


@query(f"{_PAIRS}, x AS {_ic('pairs')}, {_DAILY}, y AS (SELECT *, unnest(['all', CAST(year(session) AS VARCHAR)]) AS period FROM ic) SELECT signal, period, {_SUMMARY} FROM y GROUP BY signal, period", days="")
def ic_by_year(spark, sf):
    daily = evaluation.by_period(evaluation.daily_ic(_pairs(spark, sf), _sessions(spark, sf)))
    return evaluation.ic_summary(daily, ("signal", "period")).select("signal", "period", "n_sessions", *_r("mean_ic", "std_ic", "icir"), "reason")


@query(f"{_PAIRS}, k AS (SELECT security_id, session FROM pairs GROUP BY 1, 2 HAVING count(DISTINCT signal) = 2), sm AS (SELECT 'native' AS sample, * FROM pairs UNION ALL SELECT 'common', p.* FROM pairs p JOIN k USING (security_id, session)), x AS {_ic('sm', 'sample, signal, session')} SELECT sample, signal, session, n AS n_pairs, round(CASE WHEN n >= 20 THEN c END, 6) AS ic FROM x")
def common_vs_native(spark, sf):
    out = evaluation.daily_ic(evaluation.samples(_pairs(spark, sf), 2), by=("sample", "signal"))
    return out.select("sample", "signal", "session", "n_pairs", *_r("ic"))


_EXCL = {"NOT_MEMBER": "NOT member", "RAW_LABEL_INVALID": "outcome IS NULL", "LABEL_NOT_MATURE": "pos > 60", "SIGNAL_INVALID": "score IS NULL"}
_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in _EXCL.items()) + " END"


@query(f"""{_SIG}, b AS (SELECT 'm3' AS signal, m3 AS score, * FROM g UNION ALL SELECT 'm6', m6, * FROM g), c AS (SELECT *, {_REASON} AS reason FROM b)
SELECT signal, session, count(*) AS n_scope, count(*) FILTER (member) AS n_reference, count(*) FILTER (outcome IS NOT NULL) AS n_label, count(*) FILTER (score IS NOT NULL) AS n_prediction, count(*) FILTER (reason IS NULL) AS n_pair,
 {', '.join(f"count(*) FILTER (reason = '{r}') AS {r.lower()}" for r in evaluation.EXCLUSIONS)} FROM c GROUP BY 1, 2""")
def coverage_by_session(spark, sf):
    rows = _both(spark, sf).withColumns({"label_valid": F.col("outcome").isNotNull(), "label_available_at": F.col("pos"), "scored": F.lit(True), "signal_valid": F.col("score").isNotNull()})
    rows = rows.withColumns({"reason": evaluation.exclusion_reason(F.lit(60)), "label_ok": F.col("label_valid"), "signal_ok": F.col("signal_valid")})
    return evaluation.coverage(rows)


@query(f"{_PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY signal, session ORDER BY score) + (count(*) OVER (PARTITION BY signal, session, score) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY signal, session) AS n FROM pairs), q AS (SELECT signal, session, CAST(least(5, ceil(rk / n * 5)) AS BIGINT) AS grp, avg(outcome) AS mean, count(*) AS size FROM r WHERE n >= 20 GROUP BY 1, 2, 3) SELECT signal, grp AS \"group\", count(*) AS n_sessions, round(avg(mean), 6) AS mean_outcome, CAST(sum(size) AS BIGINT) AS n_pairs FROM q GROUP BY 1, 2", days="")
def quantile_groups(spark, sf):
    out = evaluation.quantile_groups(_pairs(spark, sf), 5)
    return out.select("signal", "group", "n_sessions", *_r("mean_outcome"), "n_pairs")


@query(f"{_PAIRS} SELECT signal, min(session) AS first_session, max(session) AS last_session, count(DISTINCT session) AS n_sessions, count(*) AS n_rows FROM pairs GROUP BY 1", days="first_session last_session")
def stage_report(spark, sf):
    return evaluation.stage_report(_pairs(spark, sf))


@query(f"{_PAIRS}, d AS (SELECT DISTINCT security_id, session, 'm3' AS signal, pos % 2 = 0 AS member FROM g UNION ALL SELECT security_id, session, 'm6', CASE WHEN security_id = 3 THEN pos % 2 = 1 ELSE pos % 2 = 0 END FROM g) SELECT security_id, session FROM d GROUP BY 1, 2 HAVING count(DISTINCT member) > 1")
def membership_conflicts(spark, sf):
    odd = F.when((F.col("security_id") == 3) & (F.col("signal") == "m6"), F.col("pos") % 2 == 1).otherwise(F.col("pos") % 2 == 0)
    return panel.membership_conflicts(_both(spark, sf).withColumn("member", odd))


# schedules


_WEEKS = f"{_DAYS}, n AS (SELECT session, row_number() OVER (ORDER BY session) AS pos, lag(session) OVER (ORDER BY session) AS before FROM d)"


@query(f"{_WEEKS}, f AS (SELECT isoyear(session)::INT AS iso_year, week(session)::INT AS iso_week, min(session) AS first_trade, max(session) AS last_trade, count(*) AS n_trades, arg_min_null(before, session) AS prediction_session, min(pos) AS fit_pos FROM n GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY first_trade) AS fold FROM f", days="first_trade last_trade prediction_session")
def folds_weekly(spark, sf):
    return schedules.weekly_folds(_days(spark, sf))


@query(f"{_WEEKS}, f AS (SELECT CAST(floor((pos - 1 - 109) / 20) AS BIGINT) AS block, min(session) AS first_trade, max(session) AS last_trade, count(*) AS n_trades, min(pos) AS fit_pos FROM n GROUP BY 1) SELECT block + 1 AS fold, first_trade, last_trade, n_trades, fit_pos, CAST(109 AS BIGINT) AS train_length FROM f WHERE block >= 0", days="first_trade last_trade")
def folds_periodic(spark, sf):
    return schedules.periodic_folds(_days(spark, sf), 20, 100, 10).select("fold", "first_trade", "last_trade", "n_trades", "fit_pos", "train_length")


@query(f"{_WEEKS}, f AS (SELECT CAST(floor((pos - 1 - 109) / 20) AS BIGINT) AS block, min(session) AS first_trade, min(pos) AS fit_pos FROM n GROUP BY 1) SELECT block + 1 AS fold, count(*) AS n, min(session) AS first_session, max(session) AS last_session, count(*) FILTER (pos + 10 <= fit_pos) AS n_mature FROM n JOIN f ON n.pos < f.fit_pos AND n.session >= f.first_trade - INTERVAL 2 YEAR WHERE block >= 0 GROUP BY 1", days="first_session last_session")
def folds_calendar_years(spark, sf):
    days = _days(spark, sf)
    train = schedules.training_sessions(schedules.periodic_folds(days, 20, 100, 10), days, years=2)
    return train.groupBy("fold").agg(F.count("*").alias("n"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count_if(F.col("pos") + 10 <= F.col("fit_pos")).alias("n_mature"))


# models (rows only: no SQL twin)


def _model_rows(spark, sf):
    nodes, outputs = catalog.stock_catalog()
    p = _panel(spark, sf)
    feats = dag.compile_plan(p, nodes, outputs[:2] + outputs[3:])
    lab = labels.forward_labels(p, 3).select(*KEYS, "member", "pos", F.col("return").alias("label"))
    return feats.join(lab, KEYS), outputs[:2] + outputs[3:]


@query()
def fold_fit_predict(spark, sf):
    """Predictions of the default profile for every session from the first that 33 precede, refitted every 20; labels of 3 sessions are complete before the fold."""
    nodes, outputs = catalog.stock_catalog()
    p = _panel(spark, sf)
    rows = dag.compile_plan(p, nodes, outputs).join(labels.forward_labels(p, 3).select(*KEYS, "member", F.col("return").alias("label")), KEYS)
    days = [r.session for r in rows.select("session").distinct().orderBy("session").collect()]
    folds = []
    for f in schedules.periodic_folds(rows.select("session").distinct(), 20, 30, 4).orderBy("fold").collect():
        first = f["fit_pos"] - 1
        folds.append({"name": f"fold{f['fold']}", "train_from": days[first - f["train_length"]], "train_to": days[first - 4], "predict_from": f["first_trade"], "predict_to": f["last_trade"]})
    return models.run_folds(rows, folds, outputs, "label")


_PRED = f"""{P}, x AS (SELECT *, {_ret(1)}, {_ret(5)}, (high - low) / nullif(close, 0) AS intraday_range, close / nullif(open, 0) - 1 AS close_to_open, amount / nullif({_agg('avg', 'amount', 5)}, 0) AS rel5,
  (security_id + pos) % 11 <> 0 AS in_time FROM panel),
r AS (SELECT CASE WHEN NOT member THEN 'NOT_MEMBER' WHEN NOT in_time THEN 'FEATURE_AVAILABILITY_UNKNOWN' WHEN ret1 IS NULL OR ret5 IS NULL OR intraday_range IS NULL OR close_to_open IS NULL OR rel5 IS NULL THEN 'FEATURE_MISSING' END AS invalid_reason FROM x WHERE pos > 33)
SELECT invalid_reason IS NULL AS valid, invalid_reason, count(*) AS n FROM r GROUP BY ALL"""


@query(_PRED, days="")
def prediction_rows(spark, sf):
    """What the rows of all sessions after a training window say of themselves; scores are the model's, reasons aren't."""
    rows, features = _model_rows(spark, sf)
    late = (F.col("security_id") + F.col("pos")) % 11 == 0
    rows = rows.withColumns({"cutoff": F.col("session").cast("timestamp"), "features_at": F.when(late & (F.col("pos") % 2 == 0), F.lit(None)).when(late, F.col("session").cast("timestamp") + F.expr("interval 1 day")).otherwise(F.col("session").cast("timestamp"))})
    train = rows.filter(models.usable(features, rows) & F.col("label").isNotNull() & (F.col("pos") < 30))
    model = models.fit(train, features, "label", models.TrainingProfile(rounds=5, depth=3))
    return models.predict(model, rows.filter("pos > 33"), features).groupBy("valid", "invalid_reason").agg(F.count("*").alias("n"))


# library, sets, experiments


@query(f"{P} SELECT 'close' AS feature, security_id, session, 'v1' AS dependency_ref FROM panel p WHERE NOT (pos <= 50 AND security_id % 2 = 0)")
def library_missing_cells(spark, sf):
    p = _panel(spark, sf)
    cells = p.select(F.lit("close").alias("feature"), *KEYS, F.lit("v1").alias("dependency_ref"), "pos")
    return library.missing_cells(cells, cells.filter("pos <= 50 and security_id % 2 = 0").drop("pos"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(*) AS n FROM orders GROUP BY 1", days="")
def latest_record(spark, sf):
    return market.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("n"))


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0", days="")
def set_intersect(spark, sf):
    return market.table(spark, sf, "orders").select("o_custkey").intersect(market.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'", days="")
def set_except(spark, sf):
    return market.table(spark, sf, "customer").select("c_custkey").subtract(market.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("WITH p AS (SELECT event_type, event_id // 1000 AS part, count(*) AS n, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1, 2) SELECT event_type, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, ',' ORDER BY part)) AS digest FROM p GROUP BY 1", days="")
def content_digest(spark, sf):
    """A digest of each event type's ids in two levels: of every thousand ids, and of those digests."""
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))
    parts = market.table(spark, sf, "events").groupBy("event_type", F.expr("event_id div 1000").alias("part")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", ids), 256).alias("digest"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.sha2(F.concat_ws(",", each), 256).alias("digest"))


# windows over time, as the streaming job computes them


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", days="window_start")
def stream_tumbling(spark, sf):
    return stream.tumbling(market.table(spark, sf, "events"), "1 day").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS window_start FROM events) SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2", days="window_start")
def stream_sliding(spark, sf):
    return stream.tumbling(market.table(spark, sf, "events"), "1 day", "12 hours").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k", days="")
def stream_sessions(spark, sf):
    return stream.sessions(market.table(spark, sf, "events"), "6 hours").select("user_id", F.unix_micros("session_start").alias("session_start"), "n")
