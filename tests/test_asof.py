"""Point-in-time reads of many requests, against brute force; cut-offs that cannot be read."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stamps import as_of_instant, known_instant
from tidemark.operators import asof, ranges
from tidemark.sources.store import Store

ASKED = "request_id int, kind string, key string, as_of string, known_at string"


def payloads(spark, rows):
    """Rows (kind, key, as_of, fetched, payload) as a store gives them."""
    made = spark.createDataFrame(rows, "kind string, key string, as_of string, fetched string, payload string")
    return made.withColumns({"as_of_ts": as_of_instant(F.col("as_of")), "fetched_at": known_instant(F.col("fetched"))}).drop("fetched")


def stamp(second):
    return f"2026-09-{14 + second // 86400:02}T{second // 3600 % 24:02}:{second // 60 % 60:02}:{second % 60:02}Z"


def brute(held, kind, key, as_of, known):
    """Everything is in seconds; None is not given."""
    fits = [h for h in held if (h[0], h[1]) == (kind, key) and (as_of is None or h[2] <= as_of) and (known is None or (h[3] is not None and h[3] <= known))]
    return max(fits, key=lambda h: (h[2], -1 if h[3] is None else h[3]))[4] if fits else None


@pytest.mark.parametrize("parts", [1, 7])
def test_both_cut_offs_against_brute_force(spark, parts):
    dice = random.Random(parts)
    held, seen = [], set()
    for i in range(600):
        h = (dice.choice("kl"), dice.choice("abcdeh") if i % 2 else "h", dice.randrange(3000), None if i % 11 == 0 else dice.randrange(6000), str(i))
        if (h[0], h[1], h[2], h[3]) not in seen:  # else either is right
            seen.add((h[0], h[1], h[2], h[3]))
            held.append(h)
    asked = [(i, dice.choice("klm"), dice.choice("abcdehz"), None if i % 7 == 0 else dice.randrange(3200), None if i % 5 == 0 else dice.randrange(6500)) for i in range(500)]
    asked += [(7, "k", "h", 2000, 4000), (7, "k", "a", 2000, 4000)]  # a repeated id
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = payloads(spark, [(k, y, stamp(t), None if f is None else stamp(f), p) for k, y, t, f, p in held])
        rows = spark.createDataFrame([(i, k, y, None if a is None else stamp(a), None if n is None else stamp(n)) for i, k, y, a, n in asked], ASKED)
        got = sorted((r["request_id"], r["kind"], r["key"], str(r["payload"])) for r in asof.payloads_for(store, rows).collect())
        assert got == sorted((i, k, y, str(brute(held, k, y, a, n))) for i, k, y, a, n in asked)
        one = sorted((r["request_id"], r["kind"], r["key"], str(r["payload"])) for r in asof.payloads_at(store, rows).collect())
        assert one == sorted((i, k, y, str(brute(held, k, y, a, None))) for i, k, y, a, n in asked)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_key_is_searched_and_not_met_row_by_row(spark):
    """200,000 payloads and as many requests of one key: pairs would be 20 thousand million."""
    n = 200_000
    at = lambda second: F.date_format(F.timestamp_add("SECOND", second, F.lit("2020-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    held = spark.range(n).select(F.lit("k").alias("kind"), F.lit("a").alias("key"), at(F.col("id")).alias("as_of"), F.col("id").cast("string").alias("payload"), at(F.col("id") + F.col("id") * 7919 % 1000).alias("fetched"))
    held = held.withColumns({"as_of_ts": as_of_instant(F.col("as_of")), "fetched_at": known_instant(F.col("fetched"))}).drop("fetched")
    asked = spark.range(n).select(F.col("id").cast("int").alias("request_id"), F.lit("k").alias("kind"), F.lit("a").alias("key"), at(F.col("id")).alias("as_of"), at(F.col("id")).alias("known_at"))
    found = asof.payloads_for(held, asked)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r["request_id"]: r["payload"] for r in found.where("request_id % 997 = 0").collect()}
    for request in got:
        fits = [i for i in range(max(0, request - 3000), request + 1) if i + i * 7919 % 1000 <= request]
        assert got[request] == (str(max(fits)) if fits else None), request
    assert found.where("payload is not null").count() > 0.99 * n


BAD = ["2024-06-01 noon", "soon", "last tuesday", "2026-13-01"]


@pytest.mark.parametrize("bad", BAD)
def test_a_cut_off_that_cannot_be_read_is_not_none(spark, bad):
    store = Store(spark)
    store.put_payload("k", "a", 1, "x", as_of="2024-01-01", fetched_at="2024-01-02")
    store.put_payload("k", "a", 2, "x", as_of="2030-01-01", fetched_at="2030-01-02")
    asked = spark.createDataFrame([(1, "k", "a", bad, None), (2, "k", "a", None, bad), (3, "k", "a", "", ""), (4, None, "a", None, None), (5, "k", "a", "20240601", "2026-W37-1")], ASKED)
    for read in (asof.payloads_for, asof.payloads_at):
        got = {r["request_id"]: r["payload"] for r in read(store.payloads(), asked).collect()}
        assert (got[1], got[3], got[4], got[5]) == (None, "2", None, "1")
    assert {r["request_id"]: r["payload"] for r in asof.payloads_for(store.payloads(), asked).collect()}[2] is None
    for cut in ({"as_of": bad}, {"known_at": bad}):
        with pytest.raises(ValueError, match="not a stamp"):
            store.get_payload("k", "a", **cut)
        with pytest.raises(ValueError, match="not a stamp"):
            store.get_bars("A", **cut)
    with pytest.raises(ValueError, match="not a stamp"):
        store.payload_keys_like("k", "", bad)


BAR = "ticker string, date date, open double, high double, low double, close double, volume double, fetched_at timestamp"


def test_bars_of_intervals_and_open_ends(spark):
    import datetime as dt

    day = lambda i: dt.date(2025, 1, 1) + dt.timedelta(days=i)
    bars = [(t, day(i), 1.0, 1.0, 1.0, float(i), 1.0, dt.datetime(2025, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=i + i % 5)) for t in "AB" for i in range(0, 700, 3)]
    dice = random.Random(3)
    rows = []
    for i in range(200):
        a, z = dice.randrange(-50, 750), dice.randrange(-50, 750)
        rows.append((i, dice.choice("ABC"), None if i % 4 == 0 else day(a), None if i % 3 == 0 else day(z), None if i % 5 else f"{day(z - 9)}T12:00:00", None if i % 2 else str(day(z))))
    rows.append((900, "A", None, None, "soon", None))
    rows.append((901, "A", None, None, None, "soon"))
    asked = spark.createDataFrame(rows, "request_id int, ticker string, start date, end date, as_of string, known_at string")
    found = asof.bars_for(spark.createDataFrame(bars, BAR), asked)
    got = sorted((r["request_id"], r["ticker"], r["date"], r["close"]) for r in found.collect())
    want = []
    for i, t, start, end, as_of, known in rows[:200]:
        cut = min([d for d in (end, dt.date.fromisoformat(as_of[:10]) if as_of else None) if d], default=None)
        for b in bars:
            if b[0] == t and (start is None or b[1] >= start) and (cut is None or b[1] <= cut) and (known is None or b[7].date() <= dt.date.fromisoformat(known)):
                want.append((i, t, b[1], b[5]))
    assert got == sorted(want)
    assert asof.bars_for(spark.createDataFrame([], BAR), asked).count() == 0


def test_covers_are_exact_and_short(spark):
    dice = random.Random(4)
    spans = [tuple(sorted((dice.randrange(5000), dice.randrange(5000)))) for _ in range(200)] + [(0, 4096), (5, 5), (0, 1)]
    rows = spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(spans)], "i int, a bigint, z bigint")
    levels = ranges.levels_for(5000)
    for r in rows.select("a", "z", ranges.cover(F.col("a"), F.col("z"), levels).alias("c")).collect():
        numbers = [n for b in r["c"] for n in range(b["block"] * 4 ** b["level"], (b["block"] + 1) * 4 ** b["level"])]
        assert numbers == sorted(set(numbers)) or sorted(numbers) == sorted(set(numbers))
        assert sorted(numbers) == list(range(r["a"], r["z"])) and len(r["c"]) <= 6 * levels


def test_requests_that_ask_the_same_are_answered_once(spark):
    """40,000 requests with two questions, one of them with nothing given: bars met requests, 4,000,000 times."""
    bars = spark.range(1000).select(
        F.lit("T").alias("ticker"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low")],
        F.col("id").cast("double").alias("close"), F.lit(1.0).alias("volume"), F.lit("2000-01-01").cast("timestamp").alias("fetched_at"),
    )
    none = F.lit(None).cast("string")
    first = F.when(F.col("id") % 2 == 0, F.lit("2002-09-01"))
    asked = spark.range(40_000).select(F.col("id").alias("request_id"), F.lit("T").alias("ticker"), first.alias("start"), none.alias("end"), F.lit("").alias("as_of"), none.alias("known_at"))
    questions, found = asof._bars_of_questions(bars, asked)
    assert questions.count() == 2 and found.count() == 1000 + 26
    totals = asof.bar_totals(bars, asked, F.count("*").alias("n"), F.sum("close").alias("total"))
    assert {tuple(r) for r in totals.groupBy(F.col("request_id") % 2, "n", "total").count().collect()} == {(0, 26, sum(range(974, 1000)) * 1.0, 20_000), (1, 1000, 499_500.0, 20_000)}
    few = asked.where("request_id < 4")
    assert asof.bars_for(bars, few).groupBy("request_id").count().orderBy("request_id").collect() == [(0, 26), (1, 1000), (2, 26), (3, 1000)]


def test_stamps_of_payloads_are_read_once_for_the_sort(spark):
    """A sort by range looks at its rows twice, for bounds and for the sort; both times every stamp was read."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = spark.range(200).select(
        F.lit("k").alias("kind"), F.lit("a").alias("key"), F.lit("2026-09-14").alias("as_of"), counted(F.col("id").cast("string")).alias("payload"),
        as_of_instant(F.lit("2026-09-14")).alias("as_of_ts"), known_instant(F.lit("2026-09-14")).alias("fetched_at"),
    )
    asked = spark.createDataFrame([(1, "k", "a", None, None)], ASKED)
    assert asof.payloads_for(rows, asked).count() == 1 and seen.value == 200
