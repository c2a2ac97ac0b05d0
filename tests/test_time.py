"""Stamps and calendar."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stamps
from tidemark.operators.calendar import NYSE, Calendar
from tidemark.plans import guard

DAY = dt.date


def values(spark, expressions):
    return list(spark.range(1).select(*expressions).first())


def utc(spark, *texts):
    return values(spark, [stamps.as_of_text(stamps.as_of_instant(F.lit(t).cast("string"))) for t in texts])


def test_as_of_instants(spark):
    assert utc(spark, "2026-09-15", "2026-09-14T18:00", "2026-09-14T18:00:00-04:00", "2026-09-14 20:00:00.9Z", "2026-01-02") == [
        "2026-09-15T04:00:00.000000+00:00",
        "2026-09-14T22:00:00.000000+00:00",
        "2026-09-14T22:00:00.000000+00:00",
        "2026-09-14T20:00:00.900000+00:00",
        "2026-01-02T05:00:00.000000+00:00",
    ]


@pytest.mark.parametrize("text", ["last tuesday", "", "2026", "2026-9-4", "2026-13-01", " 2026-09-14", "2026-W54-1", "2025-W53", "2026-W37-8", "2026-W37-0", "20260230", "2026-09-14T24:30", "2026-09-14T10:60", "2026-09-14T1000:30", None])
def test_what_is_no_stamp_is_null(spark, text):
    assert utc(spark, text) == [None]


def test_every_iso_form_is_read_as_python_reads_it(spark):
    """Dates and times of all forms, whole and damaged, against the standard library's parser."""
    import random
    from zoneinfo import ZoneInfo

    dice = random.Random(5)
    dates = ["2026-09-14", "20260914", "2026-W37", "2026-W37-3", "2026W37", "2026W373", "2020-W53-7", "2021-W53-1", "2024-02-29", "20230229", "2026-03-08", "2026-11-01"]
    times = ["", "T10", " 10:30", "T1030", "x10:30:15", "T103015", "T10:30:15.5", "T10:30:15,123456789", "T103015.25", "T02:30", "T01:30", "T23:59:60", "T25", "T1", "T10:3"]
    offsets = ["", "Z", "+05", "-0530", "+05:30", "+05:30:15", "-053015", "+05:30:15.5", "+24:00", "-23:59:59", "+5", "+05:3"]
    texts = sorted({dice.choice(dates) + dice.choice(times) + dice.choice(offsets) for _ in range(1500)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r["t"]: r["u"] for r in rows.select("t", stamps.as_of_text(stamps.as_of_instant(F.col("t"))).alias("u")).collect()}
    for text in texts:
        try:
            read = dt.datetime.fromisoformat(text)
            read = read if read.tzinfo else read.replace(tzinfo=ZoneInfo("America/New_York"))
            want = read.astimezone(dt.UTC).isoformat(timespec="microseconds")
        except ValueError:
            want = None
        assert found[text] == want, text


def test_known_instants_are_utc_and_cut_to_seconds(spark):
    known = stamps.known_instant(F.lit("2026-09-14T18:00:00.999999"))
    assert values(spark, [stamps.as_of_text(known)]) == ["2026-09-14T18:00:00.000000+00:00"]


def test_session_day_is_the_exchange_date(spark):
    days = [stamps.session_day(stamps.as_of_instant(F.lit(t))) for t in ("2026-09-15T01:00:00+00:00", "2026-09-15T09:30:00-04:00", "2026-09-15")]
    assert values(spark, days) == [DAY(2026, 9, 14), DAY(2026, 9, 15), DAY(2026, 9, 15)]


def test_finite(spark):
    found = values(spark, [stamps.finite(F.lit(x)) for x in (1.5, float("nan"), float("inf"), float("-inf"), "x", "2")])
    assert found == [1.5, None, None, None, None, 2.0]


def test_sessions(spark):
    days = {"2026-01-01": False, "2026-07-03": False, "2026-11-26": False, "2026-12-25": False, "2026-09-12": False, "2026-09-15": True}
    assert values(spark, [NYSE.is_session(F.lit(d).cast("date")) for d in days]) == list(days.values())
    labor_week = NYSE.sessions_between(F.lit("2026-09-07").cast("date"), F.lit("2026-09-11").cast("date"))
    backwards = NYSE.sessions_between(F.lit("2026-09-11").cast("date"), F.lit("2026-09-07").cast("date"))
    following = NYSE.next_session(F.lit("2026-07-02").cast("date"))
    assert values(spark, [F.size(labor_week), F.size(backwards), following]) == [4, 0, DAY(2026, 7, 6)]


def test_no_session_in_reach_is_an_error(spark):
    shut = Calendar(tuple(DAY(2026, 9, 1) + dt.timedelta(days=i) for i in range(20)), (2026,))
    day = F.lit("2026-09-15").cast("date")
    assert values(spark, [shut.last_session(day, strict=False)]) == [None]
    with pytest.raises(Exception, match="no session within 10 days before"):
        values(spark, [shut.last_session(day)])


def test_last_completed_and_lookahead(spark):
    before, after = (stamps.as_of_instant(F.lit(f"2026-09-15T{h}:00")) for h in ("15:59", "16:00"))
    assert values(spark, [NYSE.last_completed(before), NYSE.last_completed(after)]) == [DAY(2026, 9, 14), DAY(2026, 9, 15)]
    stamp = F.lit("2026-09-14T16:30:00-04:00")
    assert values(spark, [NYSE.is_lookahead(stamp, before), NYSE.is_lookahead(stamp, after)]) == [False, True]
    said = values(spark, [NYSE.lookahead_gap(stamp, F.lit("bars"), after)])[0]
    assert "2026-09-14" in said and "2026-09-15" in said and "bars" in said


@pytest.mark.parametrize(
    ("date", "status"), [("2026-09-15", 0), ("2026-09-12", 1), ("2026-12-25", 1), ("not-a-date", 255), ("2031-01-01", 255)]
)
def test_guard(spark, capsys, date, status):
    assert guard.main(["--date", date]) == status
    assert values(spark, [NYSE.guard_status(F.lit(date))]) == [status]


def test_guard_with_a_wrong_flag_cannot_tell(capsys):
    assert guard.main(["--nope"]) == 255
    assert guard.main(["--help"]) == 0


def test_calendar_from_yaml(tmp_path):
    file = tmp_path / "days.yaml"
    file.write_text("years: [2026]\nholidays:\n  - 2026-01-01\n  - '2026-12-25'\n")
    found = Calendar.from_yaml(file)
    assert found.closed == (DAY(2026, 1, 1), DAY(2026, 12, 25)) and found.years == (2026,)
    file.write_text("")
    assert Calendar.from_yaml(file) == Calendar((), ())


def test_bare_dates_are_of_the_usual_forms(spark):
    """They were taken apart, many times as slowly, though every headline and every fetch day is one."""
    texts = ["2026-09-14", "2024-02-29", "2023-02-29", "2026-13-01", "1900-01-01", "2026-03-08", "2026-11-01", "9999-12-31"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", F.unix_micros(stamps.usual_as_of(F.col("t"))).alias("usual"), F.unix_micros(stamps.as_of_instant(F.col("t"))).alias("read"), F.unix_micros(stamps._taken_apart(F.col("t"), stamps.EXCHANGE_ZONE)).alias("apart")).collect()
    assert {r["t"] for r in found if r["usual"] is None} == {"2023-02-29", "2026-13-01"}
    assert all(r["usual"] == r["read"] == r["apart"] for r in found)
