"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import fresh
from tidemark.llm.storage import small, stored

#: Hex digits of the digest that the equi-join uses; the rest is confirmed afterwards.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    at = F.instr(url, "://")
    host = F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else ''."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) given in code as a DataFrame."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``urls`` with host, path, the winning rule and its verdict.

    A rule fits its host and all subdomains of it where the url's path starts with the rule's path;
    of the rules that fit, the longest (host and path together, then the longer host) wins.
    Rows that no rule fits, among them null urls and urls without ``://`` (host and path both
    empty), get a null rule and ``default``. Equal rows are judged each on its own; an empty table
    gives an empty one; equal rules count once, and of two equal rules with different verdicts
    ``block`` wins. The columns host, path, rule, verdict replace columns of the same name.

    Only expressions that some rule could equal are made: as many labels as the deepest rule host,
    path prefixes of lengths that rules have. The join is an equi-join on a hash prefix; the full
    digest is compared after it. Hosts and paths are judged once each, and apart from the rows that have them; rules,
    and hosts and paths that a rule fits, are broadcast only if counted small.
    """
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    known = stored(
        rules.where(F.col("host").isNotNull() & (F.col("host") != ""))
        .groupBy(F.col("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("r_rule", F.concat("r_host", "r_path"))
        .withColumn("r_digest", F.sha2("r_rule", 256))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS)),
        "url-rules",
    )
    shape = known.agg(
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()
    labels, lengths = shape["labels"] or 0, shape["lengths"] or []

    parts = F.split("u_host", r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    suffixes = F.when(F.col("u_host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("u_path")),
        lambda n: F.substring(F.col("u_path"), F.lit(1), n),
    )
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))

    judged = urls.select(url_host(F.col(url)).alias("u_host"), url_path(F.col(url)).alias("u_path")).distinct()
    rows = (
        judged.withColumn("u_text", F.explode(expressions))
        .withColumn("u_digest", F.sha2("u_text", 256))
        .withColumn("u_prefix", F.substring("u_digest", 1, PREFIX_DIGITS))
    )
    order = F.struct(F.length("r_rule"), F.length("r_host"))
    won = (
        rows.join(small(known), F.col("u_prefix") == F.col("r_prefix"))
        .where(F.col("u_digest") == F.col("r_digest"))
        .groupBy("u_host", "u_path")
        .agg(F.max_by(F.struct("r_rule", "r_verdict"), order).alias("won"))
    )
    of_host, of_path, rule, verdict = (fresh(kept, n) for n in ("won_host", "won_path", "won_rule", "won_verdict"))
    won = stored(won.select(F.col("u_host").alias(of_host), F.col("u_path").alias(of_path), F.col("won.r_rule").alias(rule), F.col("won.r_verdict").alias(verdict)), "url-verdicts")
    each = urls.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    met = each.join(small(won), (F.col("host") == F.col(of_host)) & (F.col("path") == F.col(of_path)), "left")
    return met.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col(rule).alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
