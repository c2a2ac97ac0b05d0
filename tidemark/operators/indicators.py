"""Indicators over daily bars (ticker, date, open, high, low, close, volume).

Series are window columns over one specification, so that one exchange and one sort serve them all.
Exponential smoothing is recursive, which no window expresses: its last value is a fold over a
ticker's sorted bars (a ticker's history, a bar a day, is the most that it gathers), its whole series a
composition of blocks of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.stamps import finite
from tidemark.operators.ranges import carried, in_order, with_carried

#: Rows that each trailing return looks back, sessions of the averages, and the least history of a snapshot.
LOOKBACKS = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252}
AVERAGES = (20, 50, 200)
LEAST_BARS, SLOPE_BARS = 30, 10
#: Rows of a block of an exponential series, and blocks of a larger one.
EWM_BLOCK = 128
#: The fields of a snapshot after the ticker.
SNAPSHOT_FIELDS = [
    "as_of_bar", "close", "n_bars", "atr_14", "atr_pct", "ema_21", "sma_20", "sma_20_slope", "sma_50", "sma_50_slope",
    "sma_200", "sma_200_slope", *[f"ret_{k}" for k in LOOKBACKS],
]


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def sma(x: Column, n: int) -> Column:
    """Mean of the last n rows, null unless all n hold a value."""
    frame = by_ticker().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def true_range() -> Column:
    """Greatest of high-low and the distances of both from the close before; null parts are skipped."""
    before = F.lag("close", 1).over(by_ticker())
    parts = (F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.greatest(*[F.nanvl(p, F.lit(None).cast("double")) for p in parts])


def trailing_return(x: Column, n: int) -> Column:
    """Last over the value n rows before, less one; null where that is missing, zero or not finite."""
    return finite(F.try_divide(x, F.lag(x, n).over(by_ticker())) - 1)


def ewm_last(values: Column, alpha: float, least: int) -> Column:
    """The last exponential mean of an array in order: no adjustment, nulls decay the weight of what came before."""
    start = F.struct(
        F.lit(None).cast("double").alias("mean"), F.lit(1.0).alias("weight"), F.lit(0).alias("seen")
    )

    def step(s: Column, x: Column) -> Column:
        decayed = F.when(s["mean"].isNull(), s["weight"]).otherwise(s["weight"] * (1 - alpha))
        mean = F.when(x.isNull(), s["mean"]).when(s["mean"].isNull(), x).otherwise((decayed * s["mean"] + alpha * x) / (decayed + alpha))
        weight = F.when(x.isNull(), decayed).otherwise(1.0)
        return F.struct(mean.alias("mean"), weight.alias("weight"), (s["seen"] + x.isNotNull().cast("int")).alias("seen"))

    return F.aggregate(values, start, step, lambda s: F.when(s["seen"] >= least, s["mean"]))


def slope(values: Column, lookback: int = SLOPE_BARS) -> Column:
    """Change over ``lookback`` of the non-null values of an array in order, relative to the earlier one."""
    held = F.filter(values, lambda v: v.isNotNull())
    last, before = F.try_element_at(held, F.lit(-1)), F.try_element_at(held, F.lit(-1 - lookback))
    return finite(F.try_divide(last - before, before))


def ewm_series(values: DataFrame, out: str, alpha: float, least: int) -> DataFrame:
    """(ticker, date, ``out``): the whole exponential series of (ticker, date, x), null before ``least`` values.

    A step is an affine map of the mean before it, and maps compose: those of a block of rows make one, those of
    blocks make one of a larger block, and so on up to a ticker. Down again, each block learns the mean that it
    begins with, and its rows theirs. Rows are sorted by ranges, so a ticker lies in as many parts as its length
    asks for. Nulls keep the mean and let the weight of what came before decay.
    """
    rows = in_order(values.select("ticker", "date", "x"), [F.col("ticker"), F.col("date")], "ewm-order")
    one, some = F.lit(1).cast("bigint"), F.col("x").isNotNull()
    upto = Window.partitionBy("part", "ticker").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = with_carried(rows.withColumn("n", F.row_number().over(upto)), carried(rows, ["ticker"], one, F.sum), ["ticker"])
    rows = rows.withColumn("number", F.col("n") + F.coalesce("carry", F.lit(0))).drop("carry")
    held = with_carried(rows, carried(rows, ["ticker"], some.cast("bigint"), F.sum), ["ticker"]).withColumnRenamed("carry", "seen_before")
    held = with_carried(held, carried(rows, ["ticker"], F.when(some, F.col("number")), F.max), ["ticker"])
    last = F.coalesce(F.max(F.when(some, F.col("number"))).over(before), F.col("carry"))
    seen = F.coalesce(F.col("seen_before"), F.lit(0)) + F.count("x").over(upto)
    held = held.withColumns({"gap": F.col("number") - last, "seen": seen})
    kept = F.pow(F.lit(1 - alpha), F.col("gap"))
    scale = F.when(~some, 1.0).when(F.col("gap").isNull(), 0.0).otherwise(kept / (kept + alpha))
    shift = F.when(~some, 0.0).when(F.col("gap").isNull(), F.col("x")).otherwise(alpha * F.col("x") / (kept + alpha))
    blocks = {f"b{i}": F.floor((F.col("n") - 1) / EWM_BLOCK**i) for i in (2, 1)}
    held = held.withColumns(blocks).select("part", "ticker", "b2", "b1", "at", "date", "seen", scale.alias("scale"), shift.alias("shift"))
    keys = ["ticker", "part", "b2", "b1"]
    levels = [_folded(held, keys, "at", F.struct("at", "scale", "shift", "date", "seen"))]
    for depth in (3, 2, 1):
        levels.append(_folded(levels[-1], keys[:depth], keys[depth], F.struct(keys[depth], "scale", "shift")))
    found = levels[-1].select("ticker", "maps", F.lit(0.0).alias("mean"))
    for depth, below in ((1, levels[2]), (2, levels[1]), (3, levels[0])):
        begun = found.select(*keys[:depth], F.inline(_means(F.col("maps"), F.col("mean"), keys[depth]))).select(*keys[:depth], keys[depth], "mean")
        found = below.join(begun, keys[: depth + 1])
    series = found.select("ticker", F.inline(_means(F.col("maps"), F.col("mean"), "date", "seen", after=True)))
    return series.select("ticker", "date", F.when(F.col("seen") >= least, F.col("mean")).alias(out))


def _folded(rows: DataFrame, keys: list[str], order: str, one: Column) -> DataFrame:
    """A row a key: its maps in order, and the map that they make together."""
    maps = F.array_sort(F.collect_list(one))
    whole = F.aggregate(
        "maps",
        F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift")),
        lambda s, m: F.struct((s["scale"] * m["scale"]).alias("scale"), (s["shift"] * m["scale"] + m["shift"]).alias("shift")),
    )
    return rows.groupBy(*keys).agg(maps.alias("maps")).withColumn("whole", whole).select(*keys, "maps", "whole.scale", "whole.shift")


def _means(maps: Column, mean: Column, *kept: str, after: bool = False) -> Column:
    """An array of (``kept``, mean): the mean before each map, or after it, if the first one finds ``mean``."""

    def step(s: Column, m: Column) -> Column:
        now = s["mean"] * m["scale"] + m["shift"]
        one = F.struct(*[m[c].alias(c) for c in kept], (now if after else s["mean"]).alias("mean"))
        return F.struct(now.alias("mean"), F.concat(s["out"], F.array(one)).alias("out"))

    none = F.transform(F.slice(maps, 1, 0), lambda m: F.struct(*[m[c].alias(c) for c in kept], m["shift"].alias("mean")))
    return F.aggregate(maps, F.struct(mean.alias("mean"), none.alias("out")), step, lambda s: s["out"])


def ema_series(bars: DataFrame, n: int) -> DataFrame:
    close = F.nanvl(F.col("close"), F.lit(None).cast("double"))
    return ewm_series(bars.select("ticker", "date", close.alias("x")), f"ema_{n}", 2.0 / (n + 1), n)


def atr_series(bars: DataFrame, n: int = 14) -> DataFrame:
    return ewm_series(bars.select("ticker", "date", true_range().alias("x")), f"atr_{n}", 1.0 / n, n)


def too_short(bars: DataFrame) -> DataFrame:
    """(ticker, n_bars) of the tickers that ``snapshot`` refuses for their short history."""
    return bars.groupBy("ticker").agg(F.count("*").alias("n_bars")).where(F.col("n_bars") < LEAST_BARS)


def snapshot(bars: DataFrame, strict: bool = False) -> DataFrame:
    """One row a ticker: the indicators at its last bar. Tickers of under 30 bars are left out, or with
    ``strict`` fail the job. What cannot be computed is null."""
    c = F.col("close")
    wide = bars.select(
        "ticker",
        "date",
        "close",
        true_range().alias("tr"),
        *[sma(c, n).alias(f"sma_{n}") for n in AVERAGES],
        *[trailing_return(c, n).alias(f"ret_{k}") for k, n in LOOKBACKS.items()],
    )
    last = ["close", *[f"sma_{n}" for n in AVERAGES], *[f"ret_{k}" for k in LOOKBACKS]]
    series = F.array_sort(F.collect_list(F.struct("date", "close", "tr", *[f"sma_{n}" for n in AVERAGES])))
    one = wide.groupBy("ticker").agg(
        F.count("*").alias("n_bars"),
        F.max("date").alias("last_date"),
        F.max_by(F.struct(*last), "date").alias("last"),
        series.alias("series"),
    )
    if strict:
        said = F.concat(F.lit(f"snapshot needs >= {LEAST_BARS} bars, have "), F.col("n_bars").cast("string"))
        one = one.withColumn("n_bars", F.when(F.col("n_bars") >= LEAST_BARS, F.col("n_bars")).otherwise(F.raise_error(said).cast("long")))
    else:
        one = one.where(F.col("n_bars") >= LEAST_BARS)

    def of(name: str) -> Column:
        return F.transform("series", lambda s: s[name])

    atr = finite(ewm_last(of("tr"), 1.0 / 14, 14))
    made = {
        "as_of_bar": F.date_format("last_date", "yyyy-MM-dd"),
        "close": F.col("last.close"),
        "atr_14": atr,
        "atr_pct": finite(F.try_divide(atr, F.col("last.close"))),
        "ema_21": finite(ewm_last(of("close"), 2.0 / 22, 21)),
        **{f"sma_{n}": finite(F.col(f"last.sma_{n}")) for n in AVERAGES},
        **{f"sma_{n}_slope": slope(of(f"sma_{n}")) for n in AVERAGES},
        **{f"ret_{k}": F.col(f"last.ret_{k}") for k in LOOKBACKS},
    }
    return one.select("ticker", *[F.col("n_bars") if f == "n_bars" else made[f].alias(f) for f in SNAPSHOT_FIELDS])
