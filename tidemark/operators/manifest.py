"""The record of a run: what ran, what is missing, and checks that every absence is explained.

The parts are DataFrames: stages (seq, stage, status, note), gaps (seq, ticker, field, detail), failures (seq,
agent, ticker, stage, error), research (seq, ticker, data), summaries (ticker, summary), meta (seq, ticker,
sector, last), usage. Checks are anti joins and aggregates; they return rows of problems.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.jsontext import one_json
from tidemark.functions.stamps import as_of_instant, let, session_day
from tidemark.operators import rules

REPLAY_SUFFIX = "-dryrun"
NO_SECTOR = "insufficient_data: the data layer returned no sector"
NO_SUMMARY = "no summary: no stage produced one"
#: What is said of a field that is empty for no stated reason: fixed text.
BLANK = "no data gap explains it; the report must show the gap rather than write a blank"
_TICKER = r"^[A-Z0-9.\-]{1,10}$"
_TEXT, _WHOLE, _AMOUNT = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0}


def _record(**properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}


def _listed(item: dict, **more: object) -> dict:
    return {"type": "array", "items": item, **more}


#: What a manifest looks like: fixed values of the format.
SCHEMA = _record(
    run_id={"type": "string", "pattern": r"^[A-Za-z0-9][A-Za-z0-9._\-]{0,64}$"},
    run_type={"enum": ["morning", "midday", "postmortem"]},
    backend=_TEXT,
    date={"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"},
    as_of={"type": "string", "minLength": 10},
    research={"type": "object", "propertyNames": {"pattern": _TICKER}, "additionalProperties": _listed({"type": "object"})},
    summaries={"type": "object", "propertyNames": {"pattern": _TICKER}, "additionalProperties": {"type": "object"}},
    ticker_meta={
        "type": "object",
        "additionalProperties": _record(sector={"type": ["string", "null"]}, last={"type": "number"}) | {"required": ["sector"]},
    },
    agent_failures=_listed(_record(agent=_TEXT, ticker={"type": "string"}, stage=_TEXT, error=_TEXT)),
    data_gaps=_listed(_record(ticker={"type": "string"}, field=_TEXT, detail=_TEXT)),
    usage=_listed(
        _record(
            agent=_TEXT, model={"type": "string"}, backend=_TEXT, calls=_WHOLE, cached_calls=_WHOLE, input_tokens=_WHOLE,
            output_tokens=_WHOLE, cost_usd=_AMOUNT, spent_usd=_AMOUNT,
        )
    ),
    stages=_listed(_record(stage=_TEXT, status={"enum": ["ran", "not_run", "failed"]}, note=_TEXT), minItems=1),
)


class ManifestError(ValueError):
    """A record that would let a reader take an absence for a result."""


def run_id(session: Column, run_type: Column, backend: Column) -> Column:
    return F.concat(session, F.lit("-"), run_type, F.when(backend == "fake", REPLAY_SUFFIX).otherwise(""))


# ---- checks: each gives (problem) rows ----
def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def unexplained_blanks(meta: DataFrame, gaps: DataFrame) -> DataFrame:
    """Tickers with an empty sector that no gap names."""
    named = gaps.where(F.col("field") == "sector").select("ticker").distinct()
    return meta.where(_blank(F.col("sector"))).join(named, "ticker", "left_anti")


def unexplained_summaries(meta: DataFrame, summaries: DataFrame, gaps: DataFrame) -> DataFrame:
    """Tickers with neither a summary nor a gap that names it."""
    named = gaps.where(F.col("field") == "summary").select("ticker").distinct()
    return meta.join(summaries.select("ticker").distinct(), "ticker", "left_anti").join(named, "ticker", "left_anti")


def derived_gaps(meta: DataFrame, summaries: DataFrame, gaps: DataFrame) -> DataFrame:
    """(seq, ticker, field, detail): the gaps that the record adds by itself, in the order of ``meta``."""
    sector = unexplained_blanks(meta, gaps).select((F.col("seq") * 2).alias("seq"), "ticker", F.lit("sector").alias("field"), F.lit(NO_SECTOR).alias("detail"))
    summary = unexplained_summaries(meta, summaries, gaps).select((F.col("seq") * 2 + 1).alias("seq"), "ticker", F.lit("summary").alias("field"), F.lit(NO_SUMMARY).alias("detail"))
    return sector.unionByName(summary)


def hidden_failures(failures: DataFrame, stages: DataFrame) -> DataFrame:
    """One problem if something failed and no stage says so."""
    names = failures.agg(
        F.array_join(F.array_sort(F.collect_set(F.concat("agent", F.lit("["), "ticker", F.lit("]")))), ", ").alias("names")
    ).where(F.col("names") != "")
    told = stages.where(F.col("status") == "failed").select(F.lit(None).cast("string").alias("names"), F.lit(1).alias("told")).limit(1)
    both = names.withColumn("told", F.lit(0)).unionByName(told)
    found = both.agg(F.max("names").alias("names"), F.max("told").alias("told")).where((F.col("told") == 0) & F.col("names").isNotNull())
    return found.select(F.concat(F.lit("agent failure(s) "), "names", F.lit(" but no stage is marked failed")).alias("problem"))


def misfiled_research(research: DataFrame, as_of: Column, *kept: str) -> DataFrame:
    """Outputs that name another ticker than they are filed under, or another session than the run's, with ``kept`` columns."""
    return misfiled_on(research, session_day(as_of_instant(as_of)), *kept)


def misfiled_on(research: DataFrame, run: Column, *kept: str) -> DataFrame:
    """``misfiled_research`` of runs whose session day is ``run``. Each output is parsed, and its stamp read, once."""

    def said(v: Column) -> Column:
        stamp = F.coalesce(F.try_variant_get(v, "$.as_of", "string"), F.lit(""))
        agent = F.coalesce(F.try_variant_get(v, "$.agent", "string"), F.lit("?"))
        return F.struct(F.try_variant_get(v, "$.ticker", "string").alias("ticker"), stamp.alias("stamp"), agent.alias("agent"))

    def problems(p: Column) -> Column:
        same, day = session_day(as_of_instant(p["stamp"])) == run, F.coalesce(run.cast("string"), F.lit("None"))
        names = F.concat(p["agent"], F.lit(" output filed under "), "ticker", F.lit(" names "), F.coalesce(p["ticker"], F.lit("nothing")))
        wrong = F.when(~p["ticker"].eqNullSafe(F.col("ticker")), names)
        stamped = F.concat(p["agent"], F.lit("["), "ticker", F.lit("] is stamped '"), p["stamp"], F.lit("', not session "), day)
        return F.array_compact(F.array(wrong, F.when(~F.coalesce(same, F.lit(False)), stamped)))

    return research.select(*kept, F.explode(let(let(one_json(F.col("data")), said), problems)).alias("problem"))


def impossible_usage(usage: DataFrame) -> DataFrame:
    who = F.concat(F.lit("usage["), "agent", F.lit("]: "))
    more = F.when(F.col("cached_calls") > F.col("calls"), F.concat(who, F.lit("more cached calls than calls")))
    spent = F.when(F.col("spent_usd") > F.col("cost_usd") + 1e-9, F.concat(who, F.lit("spent_usd exceeds cost_usd")))
    return usage.select(F.explode(F.array_compact(F.array(more, spent))).alias("problem"))


def bad_stages(stages: DataFrame) -> DataFrame:
    """Stages reported twice, and stages without a note."""
    twice = stages.groupBy("stage").count().where("count > 1").select(F.concat(F.lit("stage "), "stage", F.lit(" reported twice")).alias("problem"))
    silent = stages.where(F.col("note").isNull() | F.col("note").rlike(r"^\s*$")).select(F.concat(F.lit("stage "), "stage", F.lit(" has no note")).alias("problem"))
    return twice.unionByName(silent)


def stage_status(jobs: DataFrame) -> DataFrame:
    """(stage, asked, n_failed, status) from one row a job (stage, failed)."""
    counted = jobs.groupBy("stage").agg(F.count("*").alias("asked"), F.count_if("failed").alias("n_failed"))
    return counted.withColumn("status", F.when(F.col("n_failed") > 0, "failed").otherwise("ran"))


@dataclass(frozen=True)
class Parts:
    """The parts of one run."""

    stages: DataFrame
    gaps: DataFrame
    failures: DataFrame
    research: DataFrame
    summaries: DataFrame
    meta: DataFrame
    usage: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Parts:
        def none(schema: str) -> DataFrame:
            return spark.createDataFrame([], schema)

        return cls(
            none("seq bigint, stage string, status string, note string"),
            none("seq bigint, ticker string, field string, detail string"),
            none("seq bigint, agent string, ticker string, stage string, error string"),
            none("seq bigint, ticker string, data string"),
            none("ticker string, summary string"),
            none("seq bigint, ticker string, sector string, last double"),
            none("agent string, model string, backend string, calls bigint, cached_calls bigint, input_tokens bigint, output_tokens bigint, cost_usd double, spent_usd double"),
        )

    def explained(self) -> Parts:
        """With the gaps that the record adds by itself."""
        added = derived_gaps(self.meta, self.summaries, self.gaps).withColumn("seq", F.col("seq") + (1 << 40))
        return replace(self, gaps=self.gaps.unionByName(added))

    def problems(self, as_of: str) -> DataFrame:
        """All cross-checks at once: one row a problem."""
        blank = unexplained_blanks(self.meta, self.gaps).select(
            F.concat(F.lit("ticker_meta["), "ticker", F.lit(f"].sector is empty but {BLANK}")).alias("problem")
        )
        silent = unexplained_summaries(self.meta, self.summaries, self.gaps).select(
            F.concat("ticker", F.lit(" has no summary and no data gap saying why")).alias("problem")
        )
        found = blank.unionByName(silent).unionByName(hidden_failures(self.failures, self.stages))
        found = found.unionByName(misfiled_research(self.research, F.lit(as_of))).unionByName(impossible_usage(self.usage))
        return found.unionByName(bad_stages(self.stages))


def _in_order(df: DataFrame, *columns: str) -> list[dict]:
    return [r.asDict() for r in df.orderBy("seq").select(*columns).collect()]


def build(parts: Parts, session: str, as_of: str, run_type: str, backend: str) -> dict:
    """The validated manifest of one run as a document; ManifestError lists every problem.

    A run's parts are a handful of rows per ticker that it reports on: they are one document.
    """
    parts = parts.explained()
    research: dict[str, list] = {}
    for r in parts.research.orderBy("ticker", "seq").collect():
        research.setdefault(r["ticker"], []).append(json.loads(r["data"]))
    meta = {}
    for r in parts.meta.orderBy("ticker").collect():
        meta[r["ticker"]] = {"sector": r["sector"]} | ({} if r["last"] is None else {"last": r["last"]})
    document = {
        "run_id": f"{session}-{run_type}" + (REPLAY_SUFFIX if backend == "fake" else ""),
        "run_type": run_type,
        "backend": backend,
        "date": session,
        "as_of": as_of,
        "research": research,
        "summaries": {r["ticker"]: json.loads(r["summary"]) for r in parts.summaries.orderBy("ticker").collect()},
        "ticker_meta": meta,
        "agent_failures": _in_order(parts.failures, "agent", "ticker", "stage", "error"),
        "data_gaps": _in_order(parts.gaps, "ticker", "field", "detail"),
        "usage": [r.asDict() for r in parts.usage.orderBy("agent").collect()],
        "stages": _in_order(parts.stages, "stage", "status", "note"),
    }
    said = rules.problem("run_manifest", SCHEMA, document)
    if said is not None:
        raise ManifestError(f"run manifest: {said}")
    found = [r["problem"] for r in parts.problems(as_of).collect()]
    if found:
        raise ManifestError("run manifest is inconsistent:\n  - " + "\n  - ".join(found))
    return document
