"""The driver's tables in the roles of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stamps import as_of_instant, known_instant, session_day
from tidemark.operators.calendar import NYSE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each order priority and day; fetched up to four days later."""
    orders = table(spark, sf_dir, "orders")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    built = orders.groupBy(F.col("o_orderpriority").alias("ticker"), day.alias("date")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.max(key % 5).cast("int").alias("lag"),
    )
    fetched = known_instant(F.date_format(F.date_add("date", F.col("lag")), "yyyy-MM-dd"))
    return built.withColumn("fetched_at", fetched).drop("lag")


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where(NYSE.is_session(F.col("date")))


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with several arrivals per key: later ones may have been fetched earlier."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("ticker"),
        day.alias("date"),
        F.col("o_totalprice").alias("close"),
        F.date_add(day, ((key * 7) % 5).cast("int")).alias("fetched_on"),
        key.alias("ingest_seq"),
    )


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payloads: as_of is exchange time, fetched_at some hours later in UTC."""
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") * 37 % 97).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"),
        F.col("user_id").cast("string").alias("key"),
        _stamp(F.col("ts")).alias("as_of"),
        F.col("props").alias("payload"),
        _stamp(F.col("ts") + hours).alias("fetched"),
        F.col("event_id").alias("ingest_seq"),
    )
    return rows.withColumns({"as_of_ts": as_of_instant(F.col("as_of")), "fetched_at": known_instant(F.col("fetched"))}).drop("fetched")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request an hour after every event, with what was known two days after it."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("kind"),
        F.col("user_id").cast("string").alias("key"),
        _stamp(F.col("ts") + F.expr("interval 1 hour")).alias("as_of"),
        _stamp(F.col("ts") + F.expr("interval 48 hours")).alias("known_at"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as replies: plain, fenced, inside a sentence, cut short, and objects that something follows."""
    p, n = F.col("props"), F.col("event_id") % 10
    text = (
        F.when(n == 0, p)
        .when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("Here it is: "), p, F.lit(" as asked.")))
        .when(n == 3, p.substr(F.lit(1), F.length(p) - 1))
        .when(n == 4, F.concat(p, F.lit(" hope this helps")))
        .when(n == 5, F.concat(p, F.lit("\n```")))
        .when(n == 6, F.concat(F.lit("x "), p, F.lit(" y "), p))
        .when(n == 7, F.concat(F.lit("[1] "), p))
        .when(n == 8, F.concat(F.lit("["), p, F.lit("]")))
        .otherwise(F.concat(F.lit("it's "), p.substr(F.lit(1), F.length(p) - 1)))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("reply"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as external calls, in order of event_id."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("agent"),
        F.col("user_id").cast("string").alias("ticker"),
        session_day(F.to_timestamp_ltz(F.concat(_stamp(F.col("ts")), F.lit("Z")))).alias("day"),
        F.col("props").alias("digest"),
        F.col("value"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of all orders, thirty years later, and of all events: covered years and others."""
    days = table(spark, sf_dir, "orders").select(F.add_months(F.col("o_orderdate").cast("date"), 360).alias("day"))
    return days.unionByName(table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"))).distinct()
