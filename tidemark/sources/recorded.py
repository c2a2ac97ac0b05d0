"""Recorded replies: files ``<agent>/<TICKER>.json``, ``<agent>/default.json``, ``<agent>.json``, the first that exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import Folder


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(place, recorded): each file's path below the folder and its whole text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # it is a URI, in which only blanks and the like are coded
    return files.select(F.substring_index(path, f"{Folder(spark, folder).place()}/", -1).alias("place"), F.col("value").alias("recorded"))


def places(agent: str = "agent", ticker: str = "ticker") -> list:
    return [
        F.concat(F.col(agent), F.lit("/"), F.col(ticker), F.lit(".json")),
        F.concat(F.col(agent), F.lit("/default.json")),
        F.concat(F.col(agent), F.lit(".json")),
    ]


def with_recorded(calls: DataFrame, held: DataFrame) -> DataFrame:
    """``calls`` with the recorded text of the most specific place, null where there is none."""
    out = calls
    for i, place in enumerate(places()):
        out = out.join(held.select(F.col("place").alias(f"place{i}"), F.col("recorded").alias(f"recorded{i}")), place == F.col(f"place{i}"), "left")
    return out.withColumn("recorded", F.coalesce(*[f"recorded{i}" for i in range(3)])).drop(*[f"{c}{i}" for i in range(3) for c in ("place", "recorded")])
