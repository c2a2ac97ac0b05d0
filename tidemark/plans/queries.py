"""The engine's queries over the driver's tables, each with the DuckDB SQL that it must match."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import jsontext, stamps
from tidemark.operators import asof, indicators, manifest, records, rules
from tidemark.operators import calls as external
from tidemark.operators.calendar import CLOSED, NYSE
from tidemark.plans import cycle, views
from tidemark.sources import recorded
from tidemark.sources.store import Store, current
from tidemark.sources.tables import shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- the views in SQL ----
_BARS = """bars AS (
    SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, min_by(o_totalprice, o_orderkey) AS open,
           max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
           CAST(count(*) AS DOUBLE) AS volume, CAST(max(o_orderkey % 5) AS INTEGER) AS lag
    FROM orders GROUP BY 1, 2)"""
_CLOSED = ", ".join(f"DATE '{d}'" for d in CLOSED.split())
_SESSIONS = f"{_BARS}, sbars AS (SELECT * FROM bars WHERE isodow(date) < 6 AND date NOT IN ({_CLOSED}))"
_GRID = f"""grid AS (
        SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR AS DATE) AS day FROM orders UNION SELECT CAST(ts AS DATE) FROM events),
    wide AS (SELECT CAST(d AS DATE) AS day FROM generate_series((SELECT min(day) - 31 FROM grid), (SELECT max(day) + 31 FROM grid), INTERVAL 1 DAY) t(d)),
    sess AS (SELECT day AS s FROM wide WHERE isodow(day) < 6 AND day NOT IN ({_CLOSED}))"""
_PAYLOADS = """pay AS (
    SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS key, ts, (ts AT TIME ZONE 'America/New_York') AS as_of_ts, props AS payload,
           date_trunc('second', ts + to_hours(CAST(event_id * 37 % 97 AS BIGINT))) AS fetched, event_id
    FROM events), req AS (
    SELECT event_id AS request_id, event_type AS kind, CAST(user_id AS VARCHAR) AS key, (ts + INTERVAL 1 HOUR) AT TIME ZONE 'America/New_York' AS cut,
           date_trunc('second', ts + INTERVAL 48 HOUR) AS known
    FROM events)"""
_CALLS = """calls AS (
    SELECT event_id AS seq, event_type AS agent, CAST(user_id AS VARCHAR) AS ticker,
           CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day, props AS digest, value FROM events)"""


def _rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- bars: store and point-in-time reads ----
@query(f"WITH {_BARS} SELECT ticker, date, open, high, low, close, volume FROM bars")
def bars_build(spark, sf_dir):
    return views.bars(spark, sf_dir).drop("fetched_at")


@query(f"WITH {_SESSIONS} SELECT ticker, date, close FROM sbars")
def bars_trading_days(spark, sf_dir):
    return views.session_bars(spark, sf_dir).select("ticker", "date", "close")


@query(f"""WITH {_BARS} SELECT ticker, date, open, high, low, close, volume FROM bars
    WHERE date >= DATE '1996-03-01' AND date <= least(DATE '1999-12-31', DATE '1998-06-30')""")
def bars_asof_end(spark, sf_dir):
    return asof.read_bars(views.bars(spark, sf_dir), start="1996-03-01", end="1999-12-31", as_of="1998-07-01T01:30:00+00:00")


@query(f"WITH {_BARS} SELECT ticker, date, open, high, low, close, volume FROM bars WHERE date + lag <= DATE '1997-05-05' AND date <= DATE '1997-05-05'")
def bars_known_at(spark, sf_dir):
    return asof.read_bars(views.bars(spark, sf_dir), as_of="1997-05-05T16:30:00", known_at="1997-05-05T00:00:00")


def _totals(bars: DataFrame, asked: DataFrame) -> DataFrame:
    """Number and summed closes of the bars of each request_id."""
    found = asof.bar_totals(bars, asked, F.count("*").alias("n"), F.sum("close").alias("total"))
    return found.groupBy("request_id").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query(f"""WITH {_BARS}, r AS (
    SELECT c_custkey AS request_id, ticker, DATE '1995-06-01' + CAST(c_custkey % 700 AS INTEGER) AS s
    FROM customer, (SELECT DISTINCT o_orderpriority AS ticker FROM orders))
    SELECT request_id, count(*) AS n, round(sum(close), 2) AS total FROM r JOIN bars USING (ticker)
    WHERE date >= s AND date <= s + 60 AND date + lag <= s + 45 GROUP BY 1""")
def bars_for_requests(spark, sf_dir):
    tickers = [F.lit(r[0]) for r in views.table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect()]  # a priority each
    start = F.date_add(F.lit("1995-06-01").cast("date"), (F.col("c_custkey") % 700).cast("int"))
    asked = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), F.explode(F.array(*tickers)).alias("ticker"), start.alias("start"), F.date_add(start, 90).alias("end"),
        F.concat(F.date_add(start, 60).cast("string"), F.lit("T12:00:00")).alias("as_of"), F.date_add(start, 45).cast("string").alias("known_at"),
    )
    return _totals(views.bars(spark, sf_dir), asked)


@query(f"""WITH {_BARS}, r AS (
    SELECT c_custkey AS request_id, (SELECT min(o_orderpriority) FROM orders) AS ticker, DATE '1995-06-01' + CAST(c_custkey % 700 AS INTEGER) AS s FROM customer)
    SELECT request_id, count(*) AS n, round(sum(close), 2) AS total FROM r JOIN bars USING (ticker)
    WHERE (request_id % 3 = 0 OR date >= s) AND (request_id % 3 = 1 OR date <= s + 900) AND date + lag <= s + 1200 GROUP BY 1""")
def bars_for_open_ends(spark, sf_dir):
    """Requests of one ticker without a first day, without a last one, and with both."""
    ticker = views.table(spark, sf_dir, "orders").agg(F.min("o_orderpriority")).first()[0]
    start, n = F.date_add(F.lit("1995-06-01").cast("date"), (F.col("c_custkey") % 700).cast("int")), F.col("c_custkey") % 3
    asked = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), F.lit(ticker).alias("ticker"), F.when(n != 0, start).alias("start"), F.when(n != 1, F.date_add(start, 900)).alias("end"),
        F.lit("").alias("as_of"), F.date_add(start, 1200).cast("string").alias("known_at"),
    )
    return _totals(views.bars(spark, sf_dir), asked)


@query(f"WITH {_BARS} SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1")
def bars_coverage(spark, sf_dir):
    return asof.coverage(views.bars(spark, sf_dir))


@query("""WITH log AS (
    SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, o_totalprice AS close,
           CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 5 AS INTEGER) AS fetched_on, o_orderkey AS seq FROM orders),
    cur AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) AS rn FROM log)
    SELECT ticker, date, close, fetched_on FROM cur WHERE rn = 1 AND fetched_on <= date + 1""")
def bars_latest_ingest(spark, sf_dir):
    now = current(views.ingest(spark, sf_dir), ["ticker", "date"])
    return now.where(F.col("fetched_on") <= F.date_add("date", 1)).select("ticker", "date", "close", "fetched_on")


# ---- payloads ----
def _hits(df: DataFrame) -> DataFrame:
    return df.select("request_id", "kind", "key", "payload", F.substring(stamps.as_of_text(F.col("fetched_at")), 1, 19).alias("fetched_at"))


_ASOF = """SELECT request_id, r.kind, r.key, arg_max(payload, (as_of_ts, fetched)) AS payload,
    strftime(arg_max(fetched, (as_of_ts, fetched)), '%Y-%m-%dT%H:%M:%S') AS fetched_at
    FROM req r LEFT JOIN pay p ON r.kind = p.kind AND r.key = p.key AND p.as_of_ts <= r.cut {more} GROUP BY 1, 2, 3"""


@query(f"WITH {_PAYLOADS} {_ASOF.format(more='')}")
def payload_asof(spark, sf_dir):
    return _hits(asof.payloads_at(views.payloads(spark, sf_dir), views.requests(spark, sf_dir)))


@query(f"WITH {_PAYLOADS} {_ASOF.format(more='AND p.fetched <= r.known')}")
def payload_asof_known(spark, sf_dir):
    return _hits(asof.payloads_for(views.payloads(spark, sf_dir), views.requests(spark, sf_dir)))


#: Requests of which some have a stamp that cannot be read.
_FORMS = """forms AS (
    SELECT event_id AS request_id, event_type AS kind, CAST(user_id AS VARCHAR) AS key, event_id % 10 AS form,
           (ts + INTERVAL 1 HOUR) AT TIME ZONE 'America/New_York' AS cut, date_trunc('second', ts + INTERVAL 48 HOUR) AS known
    FROM events)"""
_FORMS_SQL = """SELECT request_id, f.kind, f.key, arg_max(payload, (as_of_ts, fetched)) AS payload,
    strftime(arg_max(fetched, (as_of_ts, fetched)), '%Y-%m-%dT%H:%M:%S') AS fetched_at
    FROM forms f LEFT JOIN pay p ON f.kind = p.kind AND f.key = p.key AND p.as_of_ts <= f.cut AND {more} GROUP BY 1, 2, 3"""


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which some have a stamp that cannot be read, and some one in the basic form."""
    n, cut = F.col("request_id") % 10, F.col("as_of")
    noon = F.concat(F.substring(cut, 1, 10), F.lit(" noon"))
    return views.requests(spark, sf_dir).withColumns(
        {
            "as_of": F.when(n == 1, noon).when(n == 2, "soon").when(n == 4, F.regexp_replace(cut, "[-:]", "")).otherwise(cut),
            "known_at": F.when(n == 3, F.concat(F.col("known_at"), F.lit("?"))).otherwise(F.col("known_at")),
        }
    )


@query(f"WITH {_PAYLOADS}, {_FORMS} {_FORMS_SQL.format(more='form NOT IN (1, 2, 3) AND p.fetched <= f.known')}")
def payload_damaged_stamps(spark, sf_dir):
    """Cut-offs that cannot be read bring nothing, however late the payloads are."""
    return _hits(asof.payloads_for(views.payloads(spark, sf_dir), _damaged(spark, sf_dir)))


@query(f"WITH {_PAYLOADS}, {_FORMS} {_FORMS_SQL.format(more='form NOT IN (1, 2)')}")
def payload_damaged_as_of(spark, sf_dir):
    """The same with one cut-off: what cannot be read brings nothing here either."""
    return _hits(asof.payloads_at(views.payloads(spark, sf_dir), _damaged(spark, sf_dir)))


@query(f"WITH {_PAYLOADS} SELECT kind, key, arg_max(payload, (as_of_ts, fetched)) AS payload FROM pay GROUP BY 1, 2")
def payload_latest(spark, sf_dir):
    asked = views.payloads(spark, sf_dir).select("kind", "key").distinct().select(
        F.concat_ws("|", "kind", "key").alias("request_id"), "kind", "key", F.lit(None).cast("string").alias("as_of"), F.lit("").alias("known_at")
    )
    return asof.payloads_for(views.payloads(spark, sf_dir), asked).select("kind", "key", "payload")


@query(f"""WITH {_PAYLOADS}, k AS (SELECT min(event_type) AS kind FROM events)
    SELECT key FROM pay, k WHERE pay.kind = k.kind AND starts_with(lower(key), '1')
    AND as_of_ts >= (TIMESTAMP '2024-01-10' AT TIME ZONE 'America/New_York') AND as_of_ts < (TIMESTAMP '2024-01-11' AT TIME ZONE 'America/New_York')""")
def payload_prefix_day(spark, sf_dir):
    rows = views.payloads(spark, sf_dir)
    kind = views.table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    return asof.keys_with_prefix(rows, kind, "1", "2024-01-10")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS as_of FROM events")
def payload_distinct_stamps(spark, sf_dir):
    return views.payloads(spark, sf_dir).select("as_of").distinct()


# ---- stamps ----
_OFFSET = "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '+05:30' ELSE 'Z' END"
_INSTANT = """CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) AT TIME ZONE 'America/New_York'
    WHEN 1 THEN (date_trunc('second', ts) - INTERVAL 330 MINUTE) AT TIME ZONE 'UTC' ELSE date_trunc('second', ts) AT TIME ZONE 'UTC' END"""


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    offset = F.when(n == 0, "").when(n == 1, "+05:30").otherwise("Z")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return views.table(spark, sf_dir, "events").select("event_id", text.alias("stamp"))


@query(f"SELECT event_id, strftime(({_INSTANT}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS instant FROM events")
def as_of_instant(spark, sf_dir):
    return _stamped(spark, sf_dir).select("event_id", stamps.as_of_text(stamps.as_of_instant(F.col("stamp"))).alias("instant"))


@query("""WITH forms AS (SELECT event_id, date_trunc('second', ts) AS t, event_id % 9 AS form FROM events)
    SELECT event_id, strftime(CASE form
        WHEN 0 THEN date_trunc('day', t) WHEN 1 THEN t WHEN 2 THEN (date_trunc('day', t) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'
        WHEN 3 THEN t - INTERVAL 19815 SECOND WHEN 4 THEN t + INTERVAL 19800 SECOND WHEN 5 THEN date_trunc('week', t)
        WHEN 6 THEN date_trunc('minute', t) WHEN 7 THEN t + INTERVAL 250000 MICROSECOND END, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS instant FROM forms""")
def iso_forms(spark, sf_dir):
    """Week dates, the basic form, offsets with seconds, one character for another, and a week that is none."""
    n, at = F.col("event_id") % 9, lambda pattern: F.date_format("ts", pattern)
    two = lambda number: F.lpad(number.cast("string"), 2, "0")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), two(F.weekofyear("ts")))
    day = (F.weekday("ts") + 1).cast("string")
    stamp = (
        F.when(n == 0, F.concat(week, F.lit("-"), day, F.lit("T00Z")))
        .when(n == 1, F.concat(at("yyyyMMdd'T'HHmmss"), F.lit("Z")))
        .when(n == 2, F.concat(F.replace(week, F.lit("-"), F.lit("")), day))
        .when(n == 3, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30:15")))
        .when(n == 4, F.concat(at("yyyyMMdd HHmmss"), F.lit("-0530")))
        .when(n == 5, F.concat(week, F.lit(" 00:00Z")))
        .when(n == 6, F.concat(at("yyyy-MM-dd'_'HH:mm"), F.lit("+00")))
        .when(n == 7, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit(",25Z")))
        .otherwise(F.concat(at("yyyy"), F.lit("-W54-1")))
    )
    events = views.table(spark, sf_dir, "events")
    return events.select("event_id", stamps.as_of_text(stamps.as_of_instant(stamp)).alias("instant"))


@query(f"SELECT event_id, CAST(({_INSTANT}) AT TIME ZONE 'America/New_York' AS DATE) AS session_day FROM events")
def session_day(spark, sf_dir):
    return _stamped(spark, sf_dir).select("event_id", stamps.session_day(stamps.as_of_instant(F.col("stamp"))).alias("session_day"))


@query(f"SELECT CAST(({_INSTANT}) AT TIME ZONE 'America/New_York' AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def ny_day_counts(spark, sf_dir):
    day = stamps.session_day(stamps.as_of_instant(F.col("stamp"))).alias("day")
    return _stamped(spark, sf_dir).groupBy(day).agg(F.count("*").alias("n"))


# ---- calendar ----
@query(f"WITH {_GRID} SELECT day, isodow(day) < 6 AND day NOT IN ({_CLOSED}) AS is_session, year(day) IN (2025, 2026, 2027) AS covered FROM grid")
def trading_days(spark, sf_dir):
    day = F.col("day")
    return views.grid(spark, sf_dir).select(day, NYSE.is_session(day).alias("is_session"), NYSE.covers(day).alias("covered"))


@query(f"WITH {_GRID} SELECT day, (SELECT count(*) FROM sess WHERE s BETWEEN day AND day + 6) AS n, (SELECT max(s) FROM sess WHERE s BETWEEN day AND day + 6) AS last FROM grid")
def trading_days_between(spark, sf_dir):
    found = NYSE.sessions_between(F.col("day"), F.date_add("day", 6))
    return views.grid(spark, sf_dir).select("day", F.size(found).cast("long").alias("n"), F.array_max(found).alias("last"))


@query(f"WITH {_GRID} SELECT day, (SELECT max(s) FROM sess WHERE s <= day) AS session FROM grid")
def last_session(spark, sf_dir):
    return views.grid(spark, sf_dir).select("day", NYSE.last_session(F.col("day")).alias("session"))


@query(f"WITH {_GRID} SELECT day, (SELECT min(s) FROM sess WHERE s > day) AS session FROM grid")
def next_session(spark, sf_dir):
    return views.grid(spark, sf_dir).select("day", NYSE.next_session(F.col("day")).alias("session"))


_HOURS = "SELECT day, h, (day + to_hours(h)) AT TIME ZONE 'America/New_York' AS now FROM grid, (VALUES (9), (16), (23)) t(h)"


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.explode(F.array(*map(F.lit, (9, 16, 23)))).alias("h")
    text = F.concat(F.date_format("day", "yyyy-MM-dd'T'"), F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00:00"))
    return views.grid(spark, sf_dir).select("day", hours).withColumn("now", stamps.as_of_instant(text))


@query(f"WITH {_GRID} SELECT day, h, (SELECT max(s) FROM sess WHERE s < day OR (s = day AND h >= 16)) AS session FROM ({_HOURS})")
def last_completed(spark, sf_dir):
    return _moments(spark, sf_dir).select("day", "h", NYSE.last_completed(F.col("now")).alias("session"))


@query(f"WITH {_GRID} SELECT day, h, day - 1 < (SELECT max(s) FROM sess WHERE s < day OR (s = day AND h >= 16)) AS lookahead FROM ({_HOURS})")
def lookahead_flags(spark, sf_dir):
    stamp = F.date_format(F.date_sub("day", 1), "yyyy-MM-dd'T'16:30:00")
    return _moments(spark, sf_dir).select("day", "h", NYSE.is_lookahead(stamp, F.col("now")).alias("lookahead"))


@query(f"""WITH {_GRID} SELECT strftime(day, '%Y-%m-%d') AS text, CASE WHEN year(day) NOT IN (2025, 2026, 2027) THEN 255
    WHEN isodow(day) < 6 AND day NOT IN ({_CLOSED}) THEN 0 ELSE 1 END AS status FROM grid UNION ALL SELECT 'not-a-date', 255""")
def guard_status(spark, sf_dir):
    texts = views.grid(spark, sf_dir).select(F.col("day").cast("string").alias("text")).union(spark.createDataFrame([("not-a-date",)], "text string"))
    return texts.select("text", NYSE.guard_status(F.col("text")).alias("status"))


# ---- indicators ----
def _sma_sql(n: int) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {frame} = {n} THEN avg(close) {frame} END"


_TR = """greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"""
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def _ewm_sql(values: str, alpha: str, least: int) -> str:
    return f"CASE WHEN len({values}) >= {least} THEN list_reduce({values}, lambda a, x: a * (1 - {alpha}) + x * {alpha}) END"


@query(f"WITH {_SESSIONS} SELECT ticker, date, round({_sma_sql(20)}, 4) AS sma_20 FROM sbars")
def sma_20(spark, sf_dir):
    found = views.session_bars(spark, sf_dir).select("ticker", "date", indicators.sma(F.col("close"), 20).alias("sma_20"))
    return _rounded(found, "sma_20")


@query(f"""WITH {_SESSIONS}, s AS (SELECT ticker, date, {_sma_sql(50)} AS v FROM sbars)
    SELECT ticker, round((arg_max(v, date) - arg_max(p, date)) / arg_max(p, date), 6) AS sma_50_slope
    FROM (SELECT ticker, date, v, lag(v, 10) OVER (PARTITION BY ticker ORDER BY date) AS p FROM s WHERE v IS NOT NULL) GROUP BY 1""")
def sma_50_slope(spark, sf_dir):
    found = indicators.snapshot(views.session_bars(spark, sf_dir)).where(F.col("sma_50").isNotNull())
    return _rounded(found.select("ticker", "sma_50_slope"), "sma_50_slope", places=6)


@query(f"""WITH {_SESSIONS}, l AS (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM sbars)
    SELECT ticker, date, round({_ewm_sql('v', '(2.0::DOUBLE / 22)', 21)}, 4) AS ema_21 FROM l""")
def ema_21(spark, sf_dir):
    return _rounded(indicators.ema_series(views.session_bars(spark, sf_dir), 21), "ema_21")


@query(f"WITH {_SESSIONS} SELECT ticker, date, round({_TR}, 4) AS tr FROM sbars {_W}")
def true_range(spark, sf_dir):
    return _rounded(views.session_bars(spark, sf_dir).select("ticker", "date", indicators.true_range().alias("tr")), "tr")


@query(f"""WITH {_SESSIONS}, t AS (SELECT ticker, date, {_TR} AS tr FROM sbars {_W}),
    l AS (SELECT ticker, date, list(tr) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM t)
    SELECT ticker, date, round({_ewm_sql('v', '(1.0::DOUBLE / 14)', 14)}, 4) AS atr_14 FROM l""")
def atr_14(spark, sf_dir):
    return _rounded(indicators.atr_series(views.session_bars(spark, sf_dir), 14), "atr_14")


_RETURNS = ", ".join(f"round(close / lag(close, {n}) OVER w - 1, 6) AS ret_{k}" for k, n in indicators.LOOKBACKS.items())


@query(f"WITH {_SESSIONS} SELECT ticker, date, {_RETURNS} FROM sbars {_W}")
def returns_all(spark, sf_dir):
    named = {f"ret_{k}": n for k, n in indicators.LOOKBACKS.items()}
    found = views.session_bars(spark, sf_dir).select(
        "ticker", "date", *[indicators.trailing_return(F.col("close"), n).alias(name) for name, n in named.items()]
    )
    return _rounded(found, *named, places=6)


_AVERAGES = ", ".join(f"{_sma_sql(n)} AS sma_{n}" for n in indicators.AVERAGES)
_LAST = ", ".join(f"round((list(ret_{k} ORDER BY date))[-1], 6) AS ret_{k}" for k in indicators.LOOKBACKS)
_SLOPES = ", ".join(
    f"""round((list_filter(list(sma_{n} ORDER BY date), lambda x: x IS NOT NULL)[-1] / nullif(list_filter(list(sma_{n} ORDER BY date), lambda x: x IS NOT NULL)[-11], 0)) - 1, 6) AS sma_{n}_slope,
    round((list(sma_{n} ORDER BY date))[-1], 6) AS sma_{n}"""
    for n in indicators.AVERAGES
)
_SNAPSHOT = f"""WITH {_SESSIONS}, t AS (
    SELECT ticker, date, close, {_TR} AS tr, {_AVERAGES},
           {", ".join(f"close / nullif(lag(close, {n}) OVER w, 0) - 1 AS ret_{k}" for k, n in indicators.LOOKBACKS.items())}
    FROM sbars {_W}), g AS (
    SELECT ticker, count(*) AS n_bars, strftime(max(date), '%Y-%m-%d') AS as_of_bar, arg_max(close, date) AS close,
           list(tr ORDER BY date) AS trs, list(close ORDER BY date) AS cs, {_SLOPES}, {_LAST} FROM t GROUP BY 1)
    SELECT ticker, as_of_bar, close, n_bars, round({_ewm_sql('trs', '(1.0::DOUBLE / 14)', 14)}, 4) AS atr_14,
           round({_ewm_sql('trs', '(1.0::DOUBLE / 14)', 14)} / close, 6) AS atr_pct, round({_ewm_sql('cs', '(2.0::DOUBLE / 22)', 21)}, 4) AS ema_21,
           {", ".join(f"sma_{n}, sma_{n}_slope" for n in indicators.AVERAGES)}, {", ".join(f"ret_{k}" for k in indicators.LOOKBACKS)}
    FROM g WHERE n_bars >= 30"""


@query(_SNAPSHOT)
def snapshot(spark, sf_dir):
    found = indicators.snapshot(views.session_bars(spark, sf_dir))
    fine = ["atr_pct", *[f"sma_{n}_slope" for n in indicators.AVERAGES], *[f"ret_{k}" for k in indicators.LOOKBACKS]]
    return _rounded(_rounded(found, "atr_14", "ema_21"), *fine, *[f"sma_{n}" for n in indicators.AVERAGES], places=6)


_EVENT_BARS = """SELECT event_type AS ticker, CAST(ts AS DATE) AS date FROM events WHERE isodow(ts) < 6 GROUP BY 1, 2"""


@query(f"SELECT ticker, count(*) AS n_bars FROM ({_EVENT_BARS}) GROUP BY 1 HAVING count(*) < 30")
def snapshot_refused(spark, sf_dir):
    """Tickers with too short a history for a snapshot."""
    day = F.col("ts").cast("date")
    days = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), day.alias("date")).where(NYSE.is_session(F.col("date"))).distinct()
    return indicators.too_short(days)


# ---- the research gate ----
@query("SELECT c_custkey, CAST(greatest(0, c_nationkey - 5) * 2 AS BIGINT) AS budget FROM customer")
def research_budget(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", cycle.research_budget(F.col("c_nationkey") - 5).cast("long").alias("budget"))


@query("""SELECT c_nationkey, c_custkey, place FROM (
    SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS place FROM customer)
    WHERE place <= greatest(0, c_nationkey % 4) * 2""")
def topk_candidates(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = views.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", place.alias("place"))
    return rows.where(F.col("place") <= cycle.research_budget(F.col("c_nationkey") % 4))


@query("""WITH t AS (SELECT CAST(l_orderkey AS VARCHAR) AS ticker, CAST(l_linenumber AS VARCHAR) AS field, l_extendedprice AS given FROM lineitem WHERE l_linenumber < 5),
    q AS (SELECT l_orderkey AS reply_id, CAST(l_orderkey AS VARCHAR) AS ticker, l_linenumber AS pos, CAST(l_linenumber AS VARCHAR) AS field,
          l_extendedprice + CASE WHEN l_quantity > 45 THEN 0.5 ELSE 0.00001 END AS value FROM lineitem),
    bad AS (SELECT reply_id, pos, q.field FROM q LEFT JOIN t USING (ticker, field)
            WHERE given IS NULL OR abs(value - given) > greatest(1e-9 * greatest(abs(value), abs(given)), 1e-4))
    SELECT reply_id, min(pos) AS pos, arg_min(field, pos) AS field FROM bad GROUP BY 1""")
def quoted_check(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    key, field = F.col("l_orderkey").cast("string").alias("ticker"), F.col("l_linenumber").cast("string").alias("field")
    tables = lines.where(F.col("l_linenumber") < 5).select(key, field, F.col("l_extendedprice").alias("given"))
    off = F.when(F.col("l_quantity") > 45, 0.5).otherwise(0.00001)
    quotes = lines.select(F.col("l_orderkey").alias("reply_id"), key, F.col("l_linenumber").alias("pos"), field, (F.col("l_extendedprice") + off).alias("value"))
    return cycle.wrong_quotes(quotes, tables)


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^ ]+') AS cited FROM conversations),
    h AS (SELECT conv_id, turn, cited, cited[1:4] AS given FROM w)
    SELECT conv_id, turn, array_to_string(list_filter(cited, lambda c: NOT list_contains(given, c)), '|') AS invented FROM h""")
def cited_check(spark, sf_dir):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    rows = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("cited"))
    return rows.select("conv_id", "turn", F.array_join(cycle.invented(F.col("cited"), F.slice("cited", 1, 4)), "|").alias("invented"))


# ---- the record of a run ----
def _parts(spark: SparkSession, sf_dir: str) -> manifest.Parts:
    customers, orders = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "orders")
    key = F.col("c_custkey").cast("string")
    meta = customers.select(F.col("c_custkey").alias("seq"), key.alias("ticker"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("sector"), F.col("c_acctbal").alias("last"))
    summaries = orders.where(F.col("o_totalprice") > 200000).select(F.col("o_custkey").cast("string").alias("ticker")).distinct().withColumn("summary", F.lit("{}"))
    gap = F.when(F.col("c_custkey") % 8 == 0, "sector").when(F.col("c_custkey") % 3 == 0, "summary")
    gaps = customers.select(F.col("c_custkey").alias("seq"), key.alias("ticker"), gap.alias("field"), F.lit("told").alias("detail")).where(F.col("field").isNotNull())
    failures = customers.where(F.col("c_custkey") < 5).select(F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("agent"), key.alias("ticker"), F.lit("schema").alias("stage"), F.lit("no").alias("error"))
    return manifest.replace(manifest.Parts.empty(spark), meta=meta, summaries=summaries, gaps=gaps, failures=failures)


_PARTS = """meta AS (SELECT c_custkey AS seq, CAST(c_custkey AS VARCHAR) AS ticker, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS sector FROM customer),
    summ AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS ticker FROM orders WHERE o_totalprice > 200000),
    gap AS (SELECT CAST(c_custkey AS VARCHAR) AS ticker, CASE WHEN c_custkey % 8 = 0 THEN 'sector' WHEN c_custkey % 3 = 0 THEN 'summary' END AS field FROM customer),
    blank AS (SELECT * FROM meta m WHERE (sector IS NULL OR sector = '') AND NOT EXISTS (SELECT 1 FROM gap g WHERE g.ticker = m.ticker AND field = 'sector')),
    silent AS (SELECT * FROM meta m WHERE ticker NOT IN (SELECT ticker FROM summ) AND NOT EXISTS (SELECT 1 FROM gap g WHERE g.ticker = m.ticker AND field = 'summary'))"""


@query(f"""WITH {_PARTS} SELECT seq * 2 AS seq, ticker, 'sector' AS field, '{manifest.NO_SECTOR}' AS detail FROM blank
    UNION ALL SELECT seq * 2 + 1, ticker, 'summary', '{manifest.NO_SUMMARY}' FROM silent""")
def manifest_gaps(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return manifest.derived_gaps(parts.meta, parts.summaries, parts.gaps)


@query(f"""WITH {_PARTS} SELECT 'ticker_meta[' || ticker || '].sector is empty but {manifest.BLANK}' AS problem FROM blank
    UNION ALL SELECT ticker || ' has no summary and no data gap saying why' FROM silent
    UNION ALL SELECT 'agent failure(s) ' || string_agg(n, ', ' ORDER BY n) || ' but no stage is marked failed'
    FROM (SELECT DISTINCT c_mktsegment || '[' || c_custkey || ']' AS n FROM customer WHERE c_custkey < 5)""")
def cross_check_violations(spark, sf_dir):
    return _parts(spark, sf_dir).problems("2026-09-14T16:30:00-04:00")


_RUNS = """e AS (SELECT *, CAST(ts AS DATE) AS day, event_type || ' ' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run, 'U' || user_id AS ticker FROM events),
    pair AS (SELECT run, ticker, user_id, any_value(day) AS day, any_value(event_type) AS agent, max(value) AS top FROM e GROUP BY ALL),
    gap AS (SELECT run, ticker FROM pair WHERE user_id % 8 = 0),
    miss AS (
        SELECT run, ticker, 'ticker_meta[' || ticker || '].sector is empty but @B' AS problem FROM pair WHERE user_id % 4 = 0 AND user_id % 8 <> 0
        UNION ALL SELECT run, ticker, ticker || ' has no summary and no data gap saying why' FROM pair WHERE top <= 50),
    stage AS (SELECT run, user_id % 3 AS r, bool_or(value > 98) AS failed FROM e GROUP BY ALL),
    told AS (
        SELECT run, problem FROM miss
        UNION ALL SELECT run, 'stage stage-2 has no note' FROM stage WHERE r = 2
        UNION ALL SELECT run, 'agent failure(s) ' || string_agg(n, ', ' ORDER BY n) || ' but no stage is marked failed'
            FROM (SELECT DISTINCT run, event_type || '[' || ticker || ']' AS n FROM e WHERE value > 95) WHERE run NOT IN (SELECT run FROM stage WHERE failed) GROUP BY run
        UNION ALL SELECT run, 'usage[' || agent || ']: more cached calls than calls' FROM (
            SELECT run, any_value(event_type) AS agent, count(*) AS n, 2 * count(*) FILTER (WHERE event_id % 2 = 0) AS cached FROM e GROUP BY run) WHERE cached > n
        UNION ALL SELECT run, agent || ' output filed under ' || ticker || ' names U0' FROM pair WHERE user_id % 10 = 5)""".replace("@B", manifest.BLANK)


@query(f"""WITH {_RUNS}, said AS (SELECT run, string_agg(problem, '|' ORDER BY problem) AS problems FROM told GROUP BY run),
    gaps AS (SELECT run, count(*) AS n FROM (SELECT run FROM gap UNION ALL SELECT run FROM miss) GROUP BY run)
    SELECT run, coalesce(problems, '') AS problems, coalesce(n, 0) AS n_gaps, (SELECT count(*) FROM pair p WHERE p.run = r.run) AS n_meta,
           (SELECT count(*) FROM pair p WHERE p.run = r.run AND top > 50) AS n_summaries, (SELECT count(*) FROM e WHERE e.run = r.run AND value > 95) AS n_failures,
           (SELECT count(*) FROM pair p WHERE p.run = r.run AND user_id % 5 = 0) AS n_research, replace(split_part(run, ' ', 2), ' ', '') || '-morning' AS run_id
    FROM (SELECT DISTINCT run FROM e) r LEFT JOIN said USING (run) LEFT JOIN gaps USING (run)""")
def run_records(spark, sf_dir):
    """A record for each event type and day: what its document holds, read back from it, and what is wrong with it."""
    day, who = F.col("ts").cast("date").cast("string"), F.concat(F.lit("U"), F.col("user_id").cast("string"))
    events = views.table(spark, sf_dir, "events").withColumns({"day": day, "run": F.concat("event_type", F.lit(" "), day), "ticker": who})
    keys = ["run", "ticker", "user_id", "event_type", "day"]  # the last two say what the run does, and need no sort as keys
    dealt = events.repartition(3 * spark.sparkContext.defaultParallelism, *keys)  # else few tasks make all the parts
    pair = dealt.groupBy(*keys).agg(F.max("value").alias("last"), F.count("*").alias("n"))
    pair = stored(pair.withColumnsRenamed({"user_id": "seq", "event_type": "agent"}), "record-pairs")
    runs = events.select("run", F.lit("morning").alias("run_type"), F.lit("live").alias("backend"), F.col("day").alias("date"), F.concat("day", F.lit("T16:30:00")).alias("as_of")).distinct()
    runs = stored(runs, "record-runs")
    named = F.when(F.col("seq") % 10 == 5, "U0").otherwise(F.col("ticker"))
    data = F.to_json(F.struct("agent", named.alias("ticker"), F.col("day").alias("as_of")))
    third = F.col("user_id") % 3
    cost = F.round(F.sum("value"), 2)
    found = records.documents(
        runs,
        meta=pair.select("run", "ticker", "seq", F.when(F.col("seq") % 4 != 0, F.col("agent")).alias("sector"), "last"),
        summaries=pair.where(F.col("last") > 50).select("run", "ticker", F.to_json(F.struct("n")).alias("summary")),
        gaps=pair.where(F.col("seq") % 8 == 0).select("run", "ticker", "seq", F.lit("sector").alias("field"), F.lit("told").alias("detail")),
        failures=events.where(F.col("value") > 95).select("run", F.col("event_id").alias("seq"), F.col("event_type").alias("agent"), "ticker", F.lit("schema").alias("stage"), F.lit("no").alias("error")),
        research=pair.where(F.col("seq") % 5 == 0).select("run", "ticker", "seq", data.alias("data")),
        usage=stored(events.groupBy("run", F.col("event_type").alias("agent")).agg(
            F.lit("m").alias("model"), F.lit("live").alias("backend"), F.count("*").alias("calls"), (2 * F.count_if(F.col("event_id") % 2 == 0)).alias("cached_calls"),
            F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), cost.alias("cost_usd"), cost.alias("spent_usd"),
        ), "record-usage"),
        stages=stored(events.groupBy("run", third.alias("seq")).agg(
            F.concat(F.lit("stage-"), F.first(third).cast("string")).alias("stage"), F.when(F.max("value") > 98, "failed").otherwise("ran").alias("status"),
            F.when(F.first(third) == 2, " ").otherwise("done").alias("note"),
        ), "record-stages"),
    )

    sizes = {"n_gaps": ("data_gaps", "array<string>"), "n_meta": ("ticker_meta", "map<string, string>"), "n_summaries": ("summaries", "map<string, string>"), "n_failures": ("agent_failures", "array<string>"), "n_research": ("research", "map<string, string>")}
    held = F.from_json("document", ", ".join(["run_id string", *[f"{part} {kind}" for part, kind in sizes.values()]]), {"mode": "FAILFAST"})
    read = found.select("run", F.array_join("problems", "|").alias("problems"), F.inline(F.array(held)))  # a document is read once
    return read.select("run", "problems", *[F.size(part).cast("bigint").alias(name) for name, (part, _) in sizes.items()], "run_id")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ticker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def missing_source_gaps(spark, sf_dir):
    asked = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ticker"))
    found = cycle.headlines_for(asked, _headlines(spark, sf_dir), "2026-09-14", "2026-09-14")
    return cycle.silent_gaps(found).select("ticker")


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large orders as headlines of their customers."""
    large = views.table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000)
    at = F.date_format("o_orderdate", "yyyy-MM-dd")
    return large.select(
        F.lit("headlines").alias("kind"), F.col("o_custkey").cast("string").alias("key"), at.alias("as_of"), stamps.as_of_instant(at).alias("as_of_ts"),
        F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit("]")).alias("payload"), stamps.known_instant(at).alias("fetched_at"), F.col("o_orderkey").alias("ingest_seq"),
    )


@query("""WITH large AS (SELECT o_custkey, arg_max(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS last FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS ticker, '[' || last || ']' AS payload FROM customer LEFT JOIN large ON o_custkey = c_custkey""")
def headlines_as_of(spark, sf_dir):
    """Every customer's latest headline; of those of one day that of the last order is current."""
    asked = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ticker"))
    return cycle.headlines_for(asked, current(_headlines(spark, sf_dir), ["kind", "key", "as_of"]), "2026-09-14", "2026-09-14")


@query(f"""WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS ticker, c_custkey % 7 AS r, c_custkey % 5 AS trend, c_custkey % 3 AS tone FROM customer)
    SELECT ticker, CASE WHEN r > 0 AND trend > 0 THEN '{{"trend":"up","strength":"s' || trend || '","tone":' || CASE WHEN tone > 0 THEN '"t' || tone || '"' ELSE 'null' END
           || ',"atr_pct":0.25,"ret_1m":null}}' END AS summary,
           CASE WHEN r = 0 THEN '{cycle.NOT_ASKED_GAP.format(why=cycle.OVER_BUDGET)}' WHEN trend = 0 THEN '{cycle.NO_TREND_GAP}' END AS gap FROM t""")
def summaries_rolled(spark, sf_dir):
    key, n = F.col("c_custkey").cast("string").alias("ticker"), F.col("c_custkey")
    customers = views.table(spark, sf_dir, "customer")
    trend = customers.where(n % 5 > 0).select(key, F.lit(cycle.TREND).alias("agent"), F.concat(F.lit('{"trend": "up", "strength": "s'), (n % 5).cast("string"), F.lit('"}')).alias("data"))
    tone = customers.where(n % 3 > 0).select(key, F.lit(cycle.TONE).alias("agent"), F.concat(F.lit('{"tone": "t'), (n % 3).cast("string"), F.lit('"}')).alias("data"))
    tables = customers.select(key, F.lit(0.25).alias("atr_pct"), F.lit(None).cast("double").alias("ret_1m"))
    return cycle.summaries(tables, customers.where(n % 7 > 0).select(key), trend.unionByName(tone), cycle.OVER_BUDGET)


@query("""SELECT event_type AS stage, count(*) AS asked, count(*) FILTER (WHERE value > 99) AS n_failed,
    CASE WHEN count(*) FILTER (WHERE value > 99) > 0 THEN 'failed' ELSE 'ran' END AS status FROM events GROUP BY 1""")
def stage_status(spark, sf_dir):
    return manifest.stage_status(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("value") > 99).alias("failed")))


@query("""SELECT 'usage[' || event_type || ']: ' || what AS problem FROM (
    SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE event_id % 2 = 0) * 2 + 3 AS cached, sum(value) AS cost, sum(value) + (event_type > 'm')::INT AS spent
    FROM events GROUP BY 1), (VALUES ('more cached calls than calls'), ('spent_usd exceeds cost_usd')) t(what)
    WHERE CASE what WHEN 'spent_usd exceeds cost_usd' THEN spent > cost + 1e-9 ELSE cached > calls END""")
def impossible_usage(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("agent")).agg(
        F.count("*").alias("calls"), (F.count_if(F.col("event_id") % 2 == 0) * 2 + 3).alias("cached_calls"), F.sum("value").alias("cost_usd")
    )
    return manifest.impossible_usage(rows.withColumn("spent_usd", F.col("cost_usd") + (F.col("agent") > "m").cast("int")))


# ---- calls ----
def _with_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = W.partitionBy("agent", "ticker", "day", "digest").orderBy("seq")
    return views.calls(spark, sf_dir).withColumn("cached", F.row_number().over(same) > 1)


_CACHED = f"{_CALLS}, c AS (SELECT *, row_number() OVER (PARTITION BY agent, ticker, day, digest ORDER BY seq) > 1 AS cached FROM calls)"


@query(f"""WITH {_CACHED} SELECT agent, arg_min(digest, seq) AS model, 'live' AS backend, count(*) AS calls, count(*) FILTER (WHERE cached) AS cached_calls,
    CAST(sum(seq % 7) AS BIGINT) AS input_tokens, CAST(sum(seq % 3) AS BIGINT) AS output_tokens, round(CAST(sum(CAST(CAST(seq % 11 AS DECIMAL(18, 6)) / 1000 AS DECIMAL(18, 6))) AS DOUBLE), 6) AS cost_usd,
    round(coalesce(CAST(sum(CAST(CAST(seq % 11 AS DECIMAL(18, 6)) / 1000 AS DECIMAL(18, 6))) FILTER (WHERE NOT cached) AS DOUBLE), 0), 6) AS spent_usd FROM c GROUP BY 1""")
def usage_rollup(spark, sf_dir):
    uses = _with_cached(spark, sf_dir).select(
        "seq", "agent", F.col("digest").alias("model"), F.lit("live").alias("backend"), (F.col("seq") % 7).alias("input_tokens"),
        (F.col("seq") % 3).alias("output_tokens"), ((F.col("seq") % 11) / 1000).alias("cost_usd"), "cached",
    )
    return _rounded(external.usage(uses), "cost_usd", "spent_usd", places=6)


@query(f"""WITH {_CACHED} SELECT agent, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(day AS VARCHAR))), ',') AS days FROM c
    WHERE NOT cached AND EXISTS (SELECT 1 FROM calls e WHERE e.agent = c.agent AND e.ticker = c.ticker AND e.day = c.day AND e.seq < c.seq AND e.digest <> c.digest) GROUP BY 1""")
def stale_misses(spark, sf_dir):
    """Per agent the calls that were not served although the session held an answer to a changed question."""
    first = F.first("digest").over(W.partitionBy("agent", "ticker", "day").orderBy("seq"))
    stale = _with_cached(spark, sf_dir).withColumn("first", first).where(~F.col("cached") & (F.col("digest") != F.col("first")))
    return external.stale_report(stale).withColumn("days", F.array_join(F.transform("days", lambda d: d.cast("string")), ","))


@query(f"""WITH {_PAYLOADS}, hit AS (SELECT request_id, cut, arg_max(as_of_ts, (as_of_ts, fetched)) AS held, arg_max(payload, (as_of_ts, fetched)) AS payload
    FROM req r JOIN pay p ON r.kind = p.kind AND r.key = p.key AND p.as_of_ts <= r.cut GROUP BY 1, 2)
    SELECT request_id, payload AS data FROM hit WHERE CAST(held AT TIME ZONE 'America/New_York' AS DATE) = CAST(cut AT TIME ZONE 'America/New_York' AS DATE)""")
def cache_lookup(spark, sf_dir):
    stored = views.payloads(spark, sf_dir).withColumn("key", F.concat_ws("|", "kind", "key")).withColumn("kind", F.lit(external.CACHE_KIND))
    body = F.concat(F.lit('{"data": '), "payload", F.lit(', "reply": {"model": "m"}}'))
    asked = views.requests(spark, sf_dir).withColumns({"cache_key": F.concat_ws("|", "kind", "key"), "payload": F.lit("what is asked")})
    return external.from_cache(asked, stored.withColumn("payload", body)).select("request_id", F.replace("data", F.lit(":"), F.lit(": ")).alias("data"))


@query(f"""WITH {_CALLS}, asked AS (SELECT *, '{{"k": ' || (seq % 50) || '}}' AS own FROM calls)
    SELECT agent, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(day AS VARCHAR))), ',') AS days FROM asked a
    WHERE EXISTS (SELECT 1 FROM calls e WHERE e.agent = a.agent AND e.ticker = a.ticker AND e.day = a.day AND e.digest <> a.own) GROUP BY 1""")
def stale_misses_stored(spark, sf_dir):
    """Per agent the missed calls whose agent and ticker have an answer to another question stored in the session."""
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    who = F.concat_ws("|", F.lit("live"), "event_type", F.col("user_id").cast("string"))
    events = views.table(spark, sf_dir, "events")
    held = events.select(F.lit(external.CACHE_KIND).alias("kind"), F.concat_ws("|", who, "props").alias("key"), stamps.as_of_instant(at).alias("as_of_ts"))
    own = F.concat(F.lit('{"k": '), (F.col("event_id") % 50).cast("string"), F.lit("}"))
    missed = events.select(F.col("event_type").alias("agent"), at.alias("as_of"), F.concat_ws("|", who, own).alias("cache_key"))
    return external.stale_report(external.stale_misses(missed, held)).withColumn("days", F.array_join(F.transform("days", lambda d: d.cast("string")), ","))


class _ByNumber:
    """A backend that answers by the number asked about: well, well at the second attempt, badly, or not at all."""

    name = "live"

    def complete(self, call: external.Call) -> external.Reply:
        second = "Your previous reply was rejected" in call.prompt
        k = int(re.search(r'"k": (\d+)', call.prompt).group(1))
        if k % 4 == 3:
            raise external.BackendError("down")
        text = f'{{"k": {k}}}' if k % 4 == 0 or (k % 4 == 1 and second) else '{"k": "none"}'
        return external.Reply(text, call.model, self.name, 100, 20, 0.002)


_K_REPLY = {"k": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}}


def _asked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of asking about every event again, after all were asked about once with a store."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    asked = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("agent"), F.col("user_id").cast("string").alias("ticker"), stamp.alias("as_of"),
        F.lit("sys").alias("system"), F.col("props").alias("payload"), F.lit("k").alias("schema"),
    )
    store, settings = Store(spark), external.Settings(default_model="m")
    external.run_calls(asked, _ByNumber(), _K_REPLY, settings, store, now="2024-03-01T00:00:00Z")
    return external.run_calls(asked, _ByNumber(), _K_REPLY, settings, store, now="2024-03-01T00:00:00Z")[0]


_TWICE = """o AS (SELECT event_id AS request_id, event_type AS agent, CAST(user_id AS VARCHAR) AS ticker, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


@query(f"""WITH {_TWICE} SELECT request_id, CASE WHEN k % 4 < 2 THEN k END AS k, CAST(CASE k % 4 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS attempts,
    CASE k % 4 WHEN 2 THEN 'schema' WHEN 3 THEN 'backend' END AS stage FROM o""")
def calls_again(spark, sf_dir):
    """Answers of the session are served from the store; what failed is asked again."""
    k = F.try_variant_get(F.try_parse_json("data"), "$.k", "bigint")
    return _asked_twice(spark, sf_dir).select("request_id", k.alias("k"), "attempts", "stage")


@query(f"""WITH {_TWICE} SELECT agent, ticker, stage, error, count(*) AS n FROM (SELECT agent, ticker, CASE k % 4 WHEN 2 THEN 'schema' ELSE 'backend' END AS stage,
    CASE k % 4 WHEN 2 THEN 'rejected twice: schema ''k'' rejected the output: k: ''none'' is not of type ''integer''' ELSE 'down' END AS error FROM o WHERE k % 4 > 1) GROUP BY ALL""")
def calls_failures(spark, sf_dir):
    return external.failures(_asked_twice(spark, sf_dir)).groupBy("agent", "ticker", "stage", "error").agg(F.count("*").alias("n"))


@query(f"""WITH {_TWICE}, u AS (SELECT agent, k % 4 < 2 AS cached, CASE WHEN k % 4 = 2 THEN 2 ELSE 1 END AS n FROM o WHERE k % 4 < 3)
    SELECT agent, 'm' AS model, 'live' AS backend, CAST(sum(n) AS BIGINT) AS calls, count(*) FILTER (WHERE cached) AS cached_calls, CAST(100 * sum(n) AS BIGINT) AS input_tokens,
    CAST(20 * sum(n) AS BIGINT) AS output_tokens, round(CAST(sum(n) AS DOUBLE) / 500, 6) AS cost_usd, round(CAST(coalesce(sum(n) FILTER (WHERE NOT cached), 0) AS DOUBLE) / 500, 6) AS spent_usd
    FROM u GROUP BY 1""")
def calls_usage(spark, sf_dir):
    """What the second time used: replies from the store bring the cost of their first time and spend nothing."""
    return _rounded(external.usage(external.uses_of(_asked_twice(spark, sf_dir))), "cost_usd", "spent_usd", places=6)


@query("""WITH c AS (SELECT event_id, event_type AS agent, CAST(user_id AS VARCHAR) AS ticker, user_id FROM events)
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN agent || '/' || ticker || '.json' WHEN agent < 'm' THEN agent || '/default.json' WHEN agent <> 'view' THEN agent || '.json' END AS recorded FROM c""")
def recorded_places(spark, sf_dir):
    """The most specific recorded reply of each call."""
    events = views.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("agent"), F.col("user_id").cast("string").alias("ticker"))
    own, default, flat = (place.alias("place") for place in recorded.places())
    agents = events.select("agent").distinct()
    held = events.where(F.col("ticker").cast("bigint") % 3 == 0).select(own).distinct().unionByName(agents.where(F.col("agent") < "m").select(default))
    held = held.unionByName(agents.where(F.col("agent") != "view").select(flat))
    return recorded.with_recorded(events, held.withColumn("recorded", F.col("place"))).select("event_id", "recorded")


# ---- the store on disk ----
def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/tidemark/store-{uuid.uuid4().hex}")


@query(f"""WITH {_BARS} SELECT ticker, date, close + CASE WHEN day(date) % 2 = 0 THEN 1 ELSE 0 END AS close, day(date) % 2 = 0 AS again FROM bars""")
def store_bars(spark, sf_dir):
    """Bars stored, those of even days stored again with another close under an earlier fetch: the last arrival is current."""
    store, rows = _store(spark), views.bars(spark, sf_dir).drop("fetched_at")
    store.upsert_bars(rows, "first", "2010-01-02")
    store.upsert_bars(rows.where(F.dayofmonth("date") % 2 == 0).withColumn("close", F.col("close") + 1), "again", "2010-01-01")
    return store.bars().select("ticker", "date", "close", (F.col("source") == "again").alias("again"))


@query(f"""WITH {_BARS} SELECT 'bars' AS kind, ticker AS key, 'first' AS source, count(*) AS n_rows FROM bars GROUP BY 2""")
def store_fetches(spark, sf_dir):
    store = _store(spark)
    store.upsert_bars(views.bars(spark, sf_dir).drop("fetched_at"), "first", "2010-01-02")
    return store.log("fetches").select("kind", "key", "source", "n_rows")


@query("""SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS as_of, count(*) AS versions, count(*) > 1 OR bool_and(event_id % 2 = 0) AS either,
    CASE WHEN count(*) = 1 THEN any_value(props) END AS only FROM events GROUP BY 1, 2, 3""")
def store_payloads(spark, sf_dir):
    """Payloads of a log on disk with the number of versions that each has had, and the payload where that is one."""
    store = _store(spark)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"), stamp.alias("as_of"), F.col("props").alias("payload"), F.lit("2024-03-01").alias("fetched_at"),
        (F.col("event_id") % 2 == 0).alias("even"),
    )
    for even in (True, False):
        store.append_payloads(rows.where(F.col("even") == even), "even" if even else "odd", under=f"events-{even}")
        store.append_payloads(rows, "repeated", under=f"events-{even}")  # was marked before: left out
    counted = store.payloads(history=True).groupBy("kind", "key", "as_of").agg(F.count("*").alias("versions"))
    either = (F.col("versions") > 1) | (F.col("source") == "even")
    return store.payloads().join(counted, ["kind", "key", "as_of"]).select("kind", "key", "as_of", "versions", either.alias("either"), F.when(F.col("versions") == 1, F.col("payload")).alias("only"))


# ---- JSON ----
@query("""SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2, 4, 5, 7) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
    CASE event_id % 10 WHEN 3 THEN 'the reply contains no JSON object: ' || chr(39) || props[:-2] || chr(39)
        WHEN 6 THEN 'the reply is not valid JSON: Extra data: line 1 column ' || (length(props) + 2) || ' (char ' || (length(props) + 1) || ')'
        WHEN 8 THEN 'the reply is a list, not a JSON object'
        WHEN 9 THEN 'the reply contains no JSON object: ' || chr(39) || 'it' || chr(92) || chr(39) || 's ' || props[:-2] || chr(39) END AS problem FROM events""")
def extract_json(spark, sf_dir):
    found = jsontext.with_objects(views.replies(spark, sf_dir), F.col("reply"), "found")
    k = F.try_variant_get(F.try_parse_json("found.object"), "$.k", "bigint")
    return found.select("event_id", k.alias("k"), F.col("found.problem").alias("problem"))


_K_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 50}}, "additionalProperties": False}


@query("""SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 50 THEN
    'schema ''k'' rejected the output: k: ' || CAST(json_extract(props, '$.k') AS VARCHAR) || ' is less than the minimum of 50' END AS problem FROM events""")
def schema_violations(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", rules.schema_problem("k", _K_SCHEMA, F.col("props")).alias("problem"))


@query("""SELECT event_id, '{"as_of": "' || CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE '2024-02-20T16:30:00' END || '"}' AS reply FROM events""")
def restamp(spark, sf_dir):
    own = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    other = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'00:30:00")).otherwise(F.lit("2024-02-20T16:30:00"))
    text = F.concat(F.lit('{"as_of": "'), own, F.lit('"}'))
    return views.table(spark, sf_dir, "events").select("event_id", jsontext.restamped(text, other).alias("reply"))


@query("SELECT count(DISTINCT props) AS questions, count(*) AS n FROM events")
def canonical_hash(spark, sf_dir):
    """As many digests as different questions: fetch stamps and far decimals make no difference."""
    noisy = F.concat(F.lit('{"fetched_at": "'), F.col("event_id").cast("string"), F.lit('", "x": 1.00000'), (F.col("event_id") % 9).cast("string"), F.lit(', "p": '), "props", F.lit("}"))
    digest = jsontext.digest_text(F.lit("s"), noisy, F.lit("m"), F.lit("c"), F.lit(""))
    return views.table(spark, sf_dir, "events").select(digest.alias("d")).agg(F.count_distinct("d").alias("questions"), F.count("*").alias("n"))


_QUESTION = """'{"p": ' || props || ', "x": ' || (event_id % 9) || '.5}'"""


@query(f"""SELECT event_id, {_QUESTION} AS canonical,
    sha256('{{"effort": "", "model": "m", "payload": ' || {_QUESTION} || ', "schema": "c", "system": "s"}}') AS digest FROM events""")
def canonical_digests(spark, sf_dir):
    """The canonical form of noisy questions and their digests, byte for byte."""
    noisy = F.concat(F.lit('{"x":'), (F.col("event_id") % 9).cast("string"), F.lit('.500001, "fetched_at": "'), F.col("event_id").cast("string"), F.lit('", "p":'), "props", F.lit("}"))
    digest = jsontext.digest_text(F.lit("s"), noisy, F.lit("m"), F.lit("c"), F.lit(""))
    return views.table(spark, sf_dir, "events").select("event_id", jsontext.canonical_text(noisy).alias("canonical"), digest.alias("digest"))


@query("""SELECT event_id, '{"meta": {"as_of": "2020-01-01"}, "as_of": "' || CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE '2024-02-20T16:30:00' END || '", "p": ' || props || '}' AS reply FROM events""")
def restamp_nested(spark, sf_dir):
    """Only an object's own stamp is replaced."""
    own = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    other = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'00:30:00")).otherwise(F.lit("2024-02-20T16:30:00"))
    text = F.concat(F.lit('{"meta": {"as_of": "2020-01-01"}, "as_of": "'), own, F.lit('", "p": '), "props", F.lit("}"))
    return views.table(spark, sf_dir, "events").select("event_id", jsontext.restamped(text, other).alias("reply"))


@query("""SELECT CAST(ts AS DATE) || '-morning' || CASE WHEN event_id % 2 = 0 THEN '-dryrun' ELSE '' END AS run_id, count(*) AS n FROM events GROUP BY 1""")
def run_ids(spark, sf_dir):
    backend: Column = F.when(F.col("event_id") % 2 == 0, "fake").otherwise("live")
    name = manifest.run_id(F.col("ts").cast("date").cast("string"), F.lit("morning"), backend)
    return views.table(spark, sf_dir, "events").groupBy(name.alias("run_id")).agg(F.count("*").alias("n"))
