"""Exchange sessions as column expressions: no join, so they fold into any scan or filter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stamps import as_of_instant, exchange_time, session_day

#: Full-day closures and the years they are complete for: fixed values.
CLOSED = """
2025-01-01 2025-01-09 2025-01-20 2025-02-17 2025-04-18 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-11-27 2025-12-25
2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25
2027-01-01 2027-01-18 2027-02-15 2027-03-26 2027-05-31 2027-06-18 2027-07-05 2027-09-06 2027-11-25 2027-12-24
"""
YEARS = (2025, 2026, 2027)
#: The hour of the close, and how many closed days in a row are believed.
CLOSE_HOUR, SEARCH_DAYS = 16, 10
OPEN, CLOSED_DAY, UNKNOWN = 0, 1, 255


@dataclass(frozen=True)
class Calendar:
    """Closures besides weekends, and the years for which they are complete."""

    closed: tuple[dt.date, ...] = tuple(dt.date.fromisoformat(d) for d in CLOSED.split())
    years: tuple[int, ...] = YEARS

    @classmethod
    def from_yaml(cls, path: str | Path) -> Calendar:
        """A file with ``years`` and ``holidays``; either may be missing, dates may be quoted."""
        import yaml

        raw = yaml.safe_load(Path(path).read_text()) or {}
        days = tuple(sorted(d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)) for d in raw.get("holidays", [])))
        return cls(days, tuple(int(y) for y in raw.get("years", [])))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d,) for d in self.closed], "closed date")

    # ---- columns ----
    def is_session(self, day: Column) -> Column:
        on_weekday = F.weekday(day) < 5
        return on_weekday & ~day.isin(*self.closed) if self.closed else on_weekday

    def covers(self, day: Column) -> Column:
        return F.year(day).isin(*self.years) if self.years else F.lit(False)

    def last_session(self, day: Column, strict: bool = True) -> Column:
        """The day itself if it is a session, else the nearest before it; none in ten days is an error."""
        return self._first([F.date_sub(day, i) for i in range(SEARCH_DAYS + 1)], day, "before", strict)

    def next_session(self, day: Column, strict: bool = True) -> Column:
        """The nearest session after the day; none in ten days is an error."""
        return self._first([F.date_add(day, i) for i in range(1, SEARCH_DAYS + 1)], day, "after", strict)

    def _first(self, days: list[Column], day: Column, side: str, strict: bool) -> Column:
        found = F.coalesce(*[F.when(self.is_session(d), d) for d in days])
        if not strict:
            return found
        said = F.concat(F.lit(f"no session within {SEARCH_DAYS} days {side} "), day.cast("string"))
        return F.when(day.isNotNull(), F.coalesce(found, F.raise_error(said).cast("date")))

    def sessions_between(self, start: Column, end: Column) -> Column:
        """All sessions from start to end, both included; none if end comes first."""
        days = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))
        return F.filter(days, self.is_session)

    def last_completed(self, now: Column) -> Column:
        """The latest session whose close has passed at the instant ``now``."""
        wall = exchange_time(now)
        today = wall.cast("date")
        return F.when(self.is_session(today) & (F.hour(wall) >= CLOSE_HOUR), today).otherwise(self.last_session(F.date_sub(today, 1)))

    def is_lookahead(self, as_of: Column, now: Column) -> Column:
        """Whether a newer session has closed at ``now`` than that of the stamp ``as_of``."""
        return session_day(as_of_instant(as_of)) < self.last_completed(now)

    def lookahead_gap(self, as_of: Column, what: Column, now: Column) -> Column:
        return F.format_string(
            "insufficient_data: as_of %s is an older session than the newest completed one (%s), so fetching %s now would label "
            "a later session's values with a past date. Nothing was fetched; only what the cache already holds for that date may be used.",
            session_day(as_of_instant(as_of)).cast("string"),
            self.last_completed(now).cast("string"),
            what,
        )

    def guard_status(self, text: Column) -> Column:
        """0 for a session, 1 for a closed day, 255 for text that is no date or a year not covered."""
        day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        known = day.isNotNull() & self.covers(day)
        return F.when(~F.coalesce(known, F.lit(False)), UNKNOWN).when(self.is_session(day), OPEN).otherwise(CLOSED_DAY)

    # ---- the same for one day on the driver ----
    def open_on(self, day: dt.date) -> bool:
        return day.weekday() < 5 and day not in self.closed

    def next_open(self, day: dt.date) -> dt.date:
        ahead = (day + dt.timedelta(days=i) for i in range(1, SEARCH_DAYS + 1))
        found = next(filter(self.open_on, ahead), None)
        if found is None:
            raise ValueError(f"no session within {SEARCH_DAYS} days after {day}")
        return found


NYSE = Calendar()
