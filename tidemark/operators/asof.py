"""Point-in-time reads: what held at one moment, as far as it was known at another.

Reads are set-based: a DataFrame of requests is joined to the store. The two stores hold the current
version of each key (see ``tidemark.sources.store``); cut-offs come after that, never before. A cut-off that is
given and cannot be read is never taken for none: a read of one thing raises ValueError, and of
many requests such a one has no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stamps import as_of_instant, day_start, given, known_instant, must_read, session_day, unreadable
from tidemark.operators.ranges import blocks_of, carried, cover, in_order, levels_for, with_carried
from tidemark.sources.tables import stored

#: What a bar read returns, in order.
BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume"]


def read_bars(
    bars: DataFrame,
    ticker: str | None = None,
    start: str | None = None,
    end: str | None = None,
    as_of: str | None = None,
    known_at: str | None = None,
) -> DataFrame:
    """Current bars of one ticker (or of all), within the dates and both cut-offs, in order of date.

    Empty text counts as not given; a stamp that cannot be read raises ValueError. The as-of cut is the stamp's
    session, and binds even if ``end`` is later.
    """
    must_read(as_of=as_of, known_at=known_at)
    found = bars if not ticker else bars.where(F.col("ticker") == ticker)
    if start:
        found = found.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        found = found.where(F.col("date") <= F.lit(end).cast("date"))
    if as_of:
        found = found.where(F.col("date") <= session_day(as_of_instant(F.lit(as_of))))
    if known_at:
        found = found.where(F.col("fetched_at") <= known_instant(F.lit(known_at)))
    named = BAR_COLUMNS if ticker else ["ticker", *BAR_COLUMNS]
    return found.select(*named).orderBy(*named[: len(named) - 5])


#: What makes a question of a request for bars.
_QUESTION = ["ticker", "start", "end", "as_of", "known_at"]
#: Up to so many questions, or results of questions, are broadcast, after a count; beyond, joins sort both sides.
_FEW = 10_000


def bars_for(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Bars for many requests (request_id, ticker, start, end, as_of, known_at) at once; nulls are not given.

    A request's days, with open ends up to the first and the last day of all bars, are covered by few blocks of
    days, a bar lies in one block of each length, and both meet by ticker and block. Requests that ask the same are
    answered once. Requests of a stamp that cannot be read have no bars.
    """
    questions, found = _bars_of_questions(bars, requests)
    numbered = _of_questions(requests, questions).select("request_id", "question")
    return numbered.join(found.hint("merge"), "question").select("request_id", "ticker", *BAR_COLUMNS)


def bar_totals(bars: DataFrame, requests: DataFrame, *totals: Column) -> DataFrame:
    """``totals``, aggregates with names, of the bars that ``bars_for`` gives each request row: (request_id, *totals).

    A question's bars come together before its requests are met, so that no request meets bars. Requests without
    bars have no row.
    """
    questions, found = _bars_of_questions(bars, requests)
    each = found.groupBy(F.col("question").alias("of")).agg(*totals)
    told = stored(questions.join(each, F.col("question") == F.col("of")).drop("question", "of"), "bar-totals")
    return _of_questions(requests, told).select("request_id", *told.columns[len(_QUESTION) :])


def _of_questions(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Request rows with the columns of their question, if it is among the stored ``questions``.

    The requests, which may be rows that a scan's size tells nothing of, are never the side that is broadcast.
    """
    renamed = questions.withColumnsRenamed({c: f"q_{c}" for c in _QUESTION})
    same = F.lit(True)
    for c in _QUESTION:
        same = same & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    return requests.select("request_id", *_QUESTION).join(_few_or_sorted(renamed), same)


def _few_or_sorted(rows: DataFrame) -> DataFrame:
    """Stored ``rows``, broadcast if they have been counted few; else the join sorts, and skewed parts are split."""
    return F.broadcast(rows) if rows.count() <= _FEW else rows.hint("merge")


def _bars_of_questions(bars: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different questions of the requests (*_QUESTION, question), and their bars (question, ticker, *BAR_COLUMNS)."""
    bars = stored(bars.where(F.col("date").isNotNull()).select("ticker", *BAR_COLUMNS, "fetched_at"), "bars")
    questions = stored(requests.select(*_QUESTION).distinct().withColumn("question", F.monotonically_increasing_id()), "bar-questions")
    cut, known = as_of_instant(given(F.col("as_of"))), known_instant(given(F.col("known_at")))
    span = bars.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    levels = 1 if span["first"] is None else levels_for((span["last"] - span["first"]).days + 1)
    first, last = (F.lit(span[d]).cast("date") for d in ("first", "last"))
    day = lambda date: F.datediff(date, first).cast("bigint")
    r = questions.where(~unreadable(F.col("as_of"), cut) & ~unreadable(F.col("known_at"), known)).select(
        "question",
        F.col("ticker").alias("r_ticker"),
        F.greatest(F.col("start").cast("date"), first).alias("r_start"),
        F.least(F.col("end").cast("date"), session_day(cut), last).alias("r_end"),
        known.alias("r_known"),
    )
    r = r.where(F.col("r_start") <= F.col("r_end"))
    asked = r.select("question", "r_ticker", "r_known", F.inline(cover(day(F.col("r_start")), day(F.col("r_end")) + 1, levels)))
    asked = asked.withColumnsRenamed({"level": "r_level", "block": "r_block"})
    held = bars.select("ticker", *BAR_COLUMNS, "fetched_at", F.inline(blocks_of(day(F.col("date")), levels)))
    met = (F.col("ticker") == F.col("r_ticker")) & (F.col("level") == F.col("r_level")) & (F.col("block") == F.col("r_block"))
    found = held.join(F.broadcast(asked) if questions.count() <= _FEW else asked.hint("merge"), met)
    return questions, found.where(F.col("r_known").isNull() | (F.col("fetched_at") <= F.col("r_known"))).select("question", "ticker", *BAR_COLUMNS)


def payloads_for(payloads: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request row (request_id, kind, key, as_of, known_at) the latest payload at or before both cut-offs.

    Of payloads at one instant that fetched last wins, then that of the greater as_of text. A payload whose as_of is
    no stamp is never served; one without fetched_at only if known_at is not given. Requests without a hit,
    among them those of a null kind or key and of a stamp that cannot be read, keep nulls; rows
    of one request_id are answered each on its own.

    Payloads and requests are sorted together, by ranges, so that a request knows the numbers of all earlier
    payloads of its key. Without known_at the last of them is the hit. With it, the numbers are covered by
    few blocks; in each block, sorted by fetched_at, the greatest number up to known_at is found, and the
    greatest of all is the hit. No request meets the payloads of its key one by one, and no key's are in one task.
    """
    asked = requests.withColumns({"cut": as_of_instant(given(F.col("as_of"))), "known": known_instant(given(F.col("known_at")))})
    fair = F.col("kind").isNotNull() & F.col("key").isNotNull() & ~unreadable(F.col("as_of"), F.col("cut")) & ~unreadable(F.col("known_at"), F.col("known"))
    asked = asked.select("request_id", "kind", "key", "cut", "known", F.coalesce(fair, F.lit(False)).alias("fair"))
    return _latest(payloads, asked)


def payloads_at(payloads: DataFrame, requests: DataFrame) -> DataFrame:
    """``payloads_for`` where only as_of varies: one sort of payloads and requests answers all."""
    return payloads_for(payloads, requests.withColumn("known_at", F.lit(None).cast("string")))


_KEY = ["kind", "key"]


def _latest(payloads: DataFrame, asked: DataFrame) -> DataFrame:
    """``payloads_for`` of requests (request_id, kind, key, cut, known, fair)."""
    held = payloads.where(F.col("as_of_ts").isNotNull() & F.col("kind").isNotNull() & F.col("key").isNotNull()).select(
        *_KEY, F.lit(0).alias("open"), F.col("as_of_ts").alias("moment"), F.lit(0).alias("asked"), "fetched_at", "as_of", "payload"
    )
    questions = asked.where("fair").select(
        *_KEY, F.when(F.col("cut").isNull(), 1).otherwise(0).alias("open"), F.col("cut").alias("moment"), F.lit(1).alias("asked"), "request_id", "known"
    )
    by = [*_KEY, "open", "moment", "asked", F.asc_nulls_first("fetched_at"), "as_of"]
    read = stored(held.unionByName(questions, allowMissingColumns=True), "as-of-read")  # a sort by range looks at its rows twice; stamps are read once
    rows = in_order(read, [F.col(c) if isinstance(c, str) else c for c in by], "as-of-order")
    is_held, of_key = F.col("asked") == 0, Window.partitionBy("part", *_KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(is_held, F.col("at"))
    thin = rows.select("part", "at", *_KEY, "asked", "known", "fetched_at")
    last = with_carried(thin.withColumn("own", F.max(number).over(of_key)), carried(thin, _KEY, number, F.max), _KEY)
    last = last.withColumn("newest", F.coalesce("own", "carry")).drop("own", "carry")
    plain = last.where((F.col("asked") == 1) & F.col("known").isNull()).select(F.col("at").alias("request"), F.col("newest").alias("hit"))
    if not thin.where((F.col("asked") == 1) & F.col("known").isNotNull()).isEmpty():
        plain = plain.unionByName(_known_by(thin))
    hits = plain.where(F.col("hit").isNotNull())
    answers = rows.where(is_held).select(F.col("at").alias("a_at"), "payload", "as_of", "fetched_at")
    answered = stored(hits.hint("merge").join(answers, F.col("hit") == F.col("a_at")).select("request", "payload", "as_of", "fetched_at"), "as-of-hits")
    found = rows.where(~is_held).select("at", "request_id", *_KEY).join(answered.hint("merge"), F.col("at") == F.col("request"), "left")  # small files may hold many rows: never broadcast
    wanted = ["request_id", *_KEY, "payload", "as_of", "fetched_at"]
    unfair = asked.where(~F.col("fair")).select("request_id", *_KEY)
    return found.select(*wanted).unionByName(unfair, allowMissingColumns=True).select(*wanted)


def _known_by(rows: DataFrame) -> DataFrame:
    """(request, hit) of the requests with a known cut-off among sorted rows (part, at, kind, key, asked, known, fetched_at)."""
    is_held = F.col("asked") == 0
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count_if(is_held).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    counts = counts.select(F.col("part").alias("n_part"), F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.withColumn("seen", F.coalesce(F.count_if(is_held).over(inside), F.lit(0))).join(counts, F.col("part") == F.col("n_part"))
    numbered = numbered.withColumn("number", F.col("before") + F.col("seen")).drop("n_part", "before", "seen")
    first = F.min("number").over(Window.partitionBy("part", *_KEY))
    numbered = with_carried(numbered.withColumn("first", first), carried(numbered, _KEY, F.col("number"), F.min), _KEY)
    numbered = numbered.select("at", "asked", "known", "fetched_at", "number", F.coalesce("carry", "first").alias("first"))
    numbered = stored(numbered, "as-of-numbers")
    asked = numbered.where((F.col("asked") == 1) & F.col("known").isNotNull())
    span = asked.agg(F.max(F.col("number") - F.col("first")).alias("span")).first()["span"]
    if not span:
        return asked.limit(0).select(F.col("at").alias("request"), F.lit(None).cast("bigint").alias("hit"))
    levels = levels_for(span)
    block = ["level", "block"]
    held = numbered.where((F.col("asked") == 0) & F.col("fetched_at").isNotNull()).select(
        F.col("fetched_at").alias("moment"), F.lit(0).alias("asked"), F.col("at").alias("of"), F.inline(blocks_of(F.col("number"), levels))
    )
    looked = asked.select(F.col("known").alias("moment"), F.lit(1).alias("asked"), F.col("at").alias("of"), F.inline(cover(F.col("first"), F.col("number"), levels)))
    stairs = in_order(held.unionByName(looked), [F.col(c) for c in (*block, "moment", "asked", "of")], "as-of-blocks")
    number = F.when(F.col("asked") == 0, F.col("of"))
    upto = Window.partitionBy("part", *block).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    found = with_carried(stairs.withColumn("own", F.max(number).over(upto)), carried(stairs, block, number, F.max), block)
    found = found.where(F.col("asked") == 1).select("of", F.greatest("own", "carry").alias("best"))
    return found.groupBy(F.col("of").alias("request")).agg(F.max("best").alias("hit"))


def latest_payload(payloads: DataFrame, kind: str, key: str, as_of: str | None = None, known_at: str | None = None) -> DataFrame:
    """No row, or the one payload that ``payloads_for`` gives: (payload, as_of, fetched_at). A stamp that cannot be
    read raises ValueError."""
    must_read(as_of=as_of, known_at=known_at)
    found = payloads.where((F.col("kind") == kind) & (F.col("key") == key) & F.col("as_of_ts").isNotNull())
    if as_of:
        found = found.where(F.col("as_of_ts") <= as_of_instant(F.lit(as_of)))
    if known_at:
        found = found.where(F.col("fetched_at") <= known_instant(F.lit(known_at)))
    return found.orderBy(F.desc("as_of_ts"), F.desc_nulls_last("fetched_at"), F.desc("as_of")).limit(1).select("payload", "as_of", "fetched_at")


def keys_with_prefix(payloads: DataFrame, kind: str, prefix: str, day: str) -> DataFrame:
    """Keys of a kind that start with ``prefix``, whatever its case, stamped in the session of ``day`` (a date or
    a stamp), in order of fetch and key. A key stored under two stamps comes twice.

    The session is a half-open range of instants, so the predicate reaches the scan. A day that cannot be read
    raises ValueError.
    """
    must_read(day=day)
    of = session_day(as_of_instant(F.lit(day)))
    at = F.col("as_of_ts")
    return (
        payloads.where((F.col("kind") == kind) & F.startswith(F.lower("key"), F.lit(prefix.lower())))
        .where((at >= day_start(of)) & (at < day_start(F.date_add(of, 1))))
        .orderBy(F.asc_nulls_first("fetched_at"), "key")
        .select("key")
    )


def coverage(bars: DataFrame) -> DataFrame:
    """(ticker, first_date, last_date) of all current bars, whatever was known when."""
    return bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
