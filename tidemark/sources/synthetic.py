"""Made-up daily bars: a random walk on weekdays, the same for the same seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "date date, open double, high double, low double, close double, volume double"


def walk(
    n: int = 300,
    start: str = "2025-01-02",
    seed: int = 7,
    drift: float = 0.0005,
    vol: float = 0.015,
    price0: float = 100.0,
    volume: float = 2_000_000,
    end: str | None = None,
) -> pd.DataFrame:
    """``n`` weekday bars from ``start``, or up to ``end``. Draws come in the order returns, open, high, low, volume."""
    days = pd.bdate_range(start, periods=n) if end is None else pd.bdate_range(end=end, periods=n)
    draw = np.random.default_rng(seed).normal
    steps, gap, above, below, busy = draw(drift, vol, n), draw(0, 0.003, n), draw(0, 0.005, n), draw(0, 0.005, n), draw(0, 0.3, n)
    bars = pd.DataFrame({"date": days.date, "close": price0 * np.cumprod(1 + steps)})
    bars["open"] = bars["close"] * (1 + gap)
    bars["high"] = bars[["open", "close"]].max(axis=1) * (1 + np.abs(above))
    bars["low"] = bars[["open", "close"]].min(axis=1) * (1 - np.abs(below))
    bars["volume"] = volume * (1 + np.abs(busy))
    return bars[["date", "open", "high", "low", "close", "volume"]]


def bars(spark: SparkSession, universe: dict[str, dict], n: int = 300, **options) -> DataFrame:
    """Bars of many tickers, each made in a task of its own from its options (seed, drift, ...)."""
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(universe)], "ticker string, i int")

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        ticker = rows["ticker"].iloc[0]
        return walk(n, **(options | universe[ticker])).assign(ticker=ticker)

    return asked.groupBy("ticker").applyInPandas(make, f"ticker string, {BAR_SCHEMA}")


def compounded(days: DataFrame, price0: float = 100.0) -> DataFrame:
    """close from the returns of (ticker, date, step): the running product, as a sum of logarithms."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("close", price0 * F.exp(F.sum(F.log1p("step")).over(so_far)))
