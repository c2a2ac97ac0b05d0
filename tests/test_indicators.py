"""Indicators against pandas, with missing values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators
from tidemark.sources import synthetic


def to_spark(spark, bars, ticker="A"):
    rows = [(ticker, *(None if isinstance(v, float) and v != v else v for v in r)) for r in bars.itertuples(index=False)]
    return spark.createDataFrame(rows, f"ticker string, {synthetic.BAR_SCHEMA}")


@pytest.fixture(scope="module", params=[300, 40])
def bars(request):
    made = synthetic.walk(request.param)
    holes = np.random.default_rng(1).random(len(made)) < 0.03
    made.loc[holes & (np.arange(len(made)) < len(made) - 12), "close"] = np.nan
    return made


def test_snapshot_matches_pandas(spark, bars):
    got = indicators.snapshot(to_spark(spark, bars)).first().asDict()
    close = bars["close"]
    before = close.shift(1)
    tr = pd.concat([bars["high"] - bars["low"], (bars["high"] - before).abs(), (bars["low"] - before).abs()], axis=1).max(axis=1)
    want = {"n_bars": len(bars), "close": close.iloc[-1], "atr_14": tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean().iloc[-1]}
    want["ema_21"] = close.ewm(span=21, adjust=False, min_periods=21).mean().iloc[-1]
    want["atr_pct"] = want["atr_14"] / want["close"]
    for n in (20, 50, 200):
        series = close.rolling(n, min_periods=n).mean()
        want[f"sma_{n}"] = series.iloc[-1]
        held = series.dropna()
        want[f"sma_{n}_slope"] = held.iloc[-1] / held.iloc[-11] - 1 if len(held) > 10 else None
    for label, n in indicators.LOOKBACKS.items():
        want[f"ret_{label}"] = close.iloc[-1] / close.iloc[-1 - n] - 1 if len(close) > n else None
    for name, value in want.items():
        if value is None or value != value:
            assert got[name] is None, name
        else:
            assert got[name] == pytest.approx(value, rel=1e-9), name


def test_series_match_pandas(spark, bars):
    found = indicators.ema_series(to_spark(spark, bars), 21).orderBy("date").toPandas()["ema_21"]
    want = bars["close"].ewm(span=21, adjust=False, min_periods=21).mean()
    np.testing.assert_allclose(found.astype(float), want, rtol=1e-12)


@pytest.mark.parametrize("block", [2, 128])
def test_series_of_many_blocks_parts_and_tickers(spark, monkeypatch, block):
    """A ticker with nearly all rows lies in several parts; others, one without a value, follow each other in one."""
    monkeypatch.setattr(indicators, "EWM_BLOCK", block)
    dice = np.random.default_rng(block)
    rows, days = [], pd.date_range("2000-01-01", periods=2000)
    for ticker, n, holes in (("A", 3, 0.0), ("B", 2000, 0.3), ("C", 60, 0.9), ("D", 40, 1.0), ("E", 400, 0.0)):
        rows += [(ticker, d.date(), None if dice.random() < holes else float(x)) for d, x in zip(days[:n], dice.random(n) * 100, strict=True)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = indicators.ewm_series(spark.createDataFrame(rows, "ticker string, date date, x double"), "y", 2.0 / 22, 21)
        assert "Python" not in found._jdf.queryExecution().toString()
        found = found.toPandas().sort_values(["ticker", "date"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    given = pd.DataFrame(rows, columns=["ticker", "date", "x"])
    want = given.groupby("ticker")["x"].transform(lambda x: x.astype(float).ewm(alpha=2 / 22, adjust=False, min_periods=21).mean())
    assert len(found) == len(given)
    np.testing.assert_allclose(found["y"].astype(float), want, rtol=1e-11)


def test_constant_range(spark):
    flat = synthetic.walk(40).assign(close=100.0, high=101.0, low=99.0)
    found = indicators.atr_series(to_spark(spark, flat)).orderBy("date").toPandas()["atr_14"]
    assert found[:13].isna().all() and (abs(found[13:] - 2.0) < 1e-12).all()


def test_gap_in_true_range(spark):
    two = synthetic.walk(2)
    two["close"], two["high"], two["low"] = [10.0, 12.0], [10.5, 12.5], [9.5, 11.8]
    found = to_spark(spark, two).select("date", indicators.true_range().alias("tr")).orderBy("date").collect()
    assert [r["tr"] for r in found] == pytest.approx([1.0, 2.5])


def test_short_histories(spark):
    short = to_spark(spark, synthetic.walk(29))
    assert indicators.snapshot(short).count() == 0
    with pytest.raises(Exception, match="snapshot needs >= 30 bars, have 29"):
        indicators.snapshot(short, strict=True).collect()


def test_zero_base_gives_null(spark):
    zero = synthetic.walk(31)
    zero.loc[25, "close"] = 0.0
    assert indicators.snapshot(to_spark(spark, zero)).first()["ret_1w"] is None
    slope = spark.range(1).select(indicators.slope(F.array(*[F.lit(float(x)) for x in range(100, 111)]))).first()[0]
    assert slope == pytest.approx(0.1)


def test_bars_of_many_tickers(spark):
    found = synthetic.bars(spark, {"A": {"seed": 1}, "B": {"seed": 2}}, n=5)
    assert found.groupBy("ticker").count().count() == 2
    steps = spark.createDataFrame([("A", 1, 0.1), ("A", 2, 0.1)], "ticker string, date int, step double")
    assert [round(r["close"], 6) for r in synthetic.compounded(steps).orderBy("date").collect()] == [110.0, 121.0]
