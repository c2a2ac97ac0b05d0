"""The records of many runs at once: parts with a ``run`` column in, a document and its problems a run out.

All that concerns a ticker of a run meets in one row, which tells what is missing without a join; the elements of each
part of a run then meet in one row, and the parts of a run in another, a document. Three shuffles serve any number of
runs, and nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stamps import as_of_instant, session_day
from tidemark.operators import manifest

#: The parts of a document that are lists, with what their elements hold.
LISTS = {
    "agent_failures": ["agent", "ticker", "stage", "error"],
    "data_gaps": ["ticker", "field", "detail"],
    "usage": ["agent", "model", "backend", "calls", "cached_calls", "input_tokens", "output_tokens", "cost_usd", "spent_usd"],
    "stages": ["stage", "status", "note"],
}


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _quoted(column: str) -> Column:
    """A text as JSON, which is an array of it without its brackets."""
    listed = F.to_json(F.array(column))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _listed(rows: DataFrame, part: str, order: Column) -> DataFrame:
    """Rows of a part as (run, part, key, seq, value): value is an element's JSON."""
    return rows.select("run", F.lit(part).alias("part"), F.lit("").alias("key"), order.alias("seq"), _json(*LISTS[part]).alias("value"))


def ticker_facts(meta: DataFrame, summaries: DataFrame, gaps: DataFrame) -> DataFrame:
    """A row a ticker of a run: (run, ticker, seq, reported, sector, summary), the last two true if it has them or a gap names them.

    All but the keys are of fixed width, so that groups are hashed and not sorted.
    """
    def told(rows: DataFrame, reported: bool, sector: Column, summary: Column) -> DataFrame:
        seq = F.col("seq") if reported else F.lit(None).cast("bigint")
        return rows.select("run", "ticker", seq.alias("seq"), F.lit(reported).alias("reported"), sector.alias("sector"), summary.alias("summary"))

    field, no = F.coalesce("field", F.lit("")), F.lit(False)
    every = told(meta, True, F.coalesce("sector", F.lit("")) != "", no).unionByName(told(summaries, False, no, F.col("summary").isNotNull()))
    every = every.unionByName(told(gaps, False, field == "sector", field == "summary"))
    return every.groupBy("run", "ticker").agg(*[F.max(c).alias(c) for c in ("seq", "reported", "sector", "summary")])


def missing(facts: DataFrame) -> DataFrame:
    """(run, ticker, seq, field, detail, problem): every reported ticker's fields that are empty for no stated reason."""

    def gap(wanted: Column, field: str, place: int, detail: str, problem: Column) -> Column:
        return F.when(wanted, F.struct((F.col("seq") * 2 + place).alias("seq"), F.lit(field).alias("field"), F.lit(detail).alias("detail"), problem.alias("problem")))

    blank = F.concat(F.lit("ticker_meta["), "ticker", F.lit(f"].sector is empty but {manifest.BLANK}"))
    silent = F.concat("ticker", F.lit(" has no summary and no data gap saying why"))
    found = F.array_compact(F.array(gap(~F.col("sector"), "sector", 0, manifest.NO_SECTOR, blank), gap(~F.col("summary"), "summary", 1, manifest.NO_SUMMARY, silent)))
    return facts.where("reported").select("run", "ticker", F.explode(found).alias("gap")).select("run", "ticker", "gap.*")


def documents(
    runs: DataFrame, meta: DataFrame, summaries: DataFrame, gaps: DataFrame, failures: DataFrame, research: DataFrame, usage: DataFrame, stages: DataFrame
) -> DataFrame:
    """(run, document, problems) of every run of ``runs`` (run, run_type, backend, date, as_of).

    The parts have the columns of ``manifest.Parts`` and ``run``. The document is the record as JSON text, with the gaps that
    it adds by itself after those given; problems are those of the parts as they came, sorted. A part of a run
    that is not in ``runs`` is ignored; a run without parts has an empty record.
    """
    lacking = missing(ticker_facts(meta, summaries, gaps))
    added = lacking.select("run", "ticker", "field", "detail", (F.col("seq") + (1 << 40)).alias("seq"))
    every_gap = gaps.select("run", "ticker", "field", "detail", "seq").unionByName(added)
    outputs = research.groupBy("run", "ticker").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("held"))
    outputs = outputs.withColumn("value", F.concat(F.lit("["), F.array_join(F.transform("held", lambda h: h["data"]), ", "), F.lit("]")))
    by_ticker = [("research", outputs), ("summaries", summaries.select("run", "ticker", F.col("summary").alias("value"))), ("ticker_meta", meta.withColumn("value", F.when(F.col("last").isNull(), _json("sector")).otherwise(_json("sector", "last"))))]
    parts = [_listed(failures, "agent_failures", F.col("seq")), _listed(every_gap, "data_gaps", F.col("seq")), _listed(stages, "stages", F.col("seq"))]
    parts.append(_listed(usage.withColumn("seq", F.lit(0).cast("bigint")), "usage", F.col("seq")).withColumn("key", F.get_json_object("value", "$.agent")))
    parts += [rows.select("run", F.lit(part).alias("part"), F.col("ticker").alias("key"), F.lit(0).cast("bigint").alias("seq"), F.concat(_quoted("ticker"), F.lit(": "), "value").alias("value")) for part, rows in by_ticker]
    told = F.lit("problem")
    problems = [
        lacking.select("run", told.alias("part"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("seq"), F.col("problem").alias("value")),
        *[found.select("run", told.alias("part"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("seq"), F.col("problem").alias("value")) for found in (_hidden(failures, stages), _bad_stages(stages), _usage(usage), _misfiled(research, runs))],
    ]
    whole = parts[0]
    for more in [*parts[1:], *problems]:
        whole = whole.unionByName(more)
    by_part = whole.groupBy("run", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "key", "value"))).alias("held"))
    by_part = by_part.select("run", F.struct("part", F.col("held")["value"].alias("values")).alias("of"))
    met = by_part.groupBy("run").agg(F.map_from_entries(F.collect_list("of")).alias("held"))
    own = runs.join(met, "run", "left")

    def values(part: str) -> Column:
        return F.coalesce(F.try_element_at("held", F.lit(part)), F.array().cast("array<string>"))

    def shown(part: str) -> Column:
        begin, end = "[]" if part in LISTS else "{}"
        return F.concat(F.lit(f'"{part}": {begin}'), F.array_join(values(part), ", "), F.lit(end))

    head = F.struct(manifest.run_id(F.col("date"), F.col("run_type"), F.col("backend")).alias("run_id"), "run_type", "backend", "date", "as_of")
    opened = F.regexp_replace(F.to_json(head), r"\}$", "")
    rest = [shown(p) for p in ("research", "summaries", "ticker_meta", *LISTS)]
    document = F.concat(opened, F.lit(", "), F.concat_ws(", ", *rest), F.lit("}"))
    return own.select("run", document.alias("document"), F.array_sort(values("problem")).alias("problems"))


# ---- checks of many runs: each gives (run, problem) ----
def _hidden(failures: DataFrame, stages: DataFrame) -> DataFrame:
    """Runs in which something failed and no stage says so."""
    names = failures.select("run", F.concat("agent", F.lit("["), "ticker", F.lit("]")).alias("name"), F.lit(0).alias("told"))
    told = stages.where(F.col("status") == "failed").select("run", F.lit(None).cast("string").alias("name"), F.lit(1).alias("told"))
    found = names.unionByName(told).groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"), F.max("told").alias("told"))
    return found.where((F.col("told") == 0) & (F.col("names") != "")).select("run", F.concat(F.lit("agent failure(s) "), "names", F.lit(" but no stage is marked failed")).alias("problem"))


def _bad_stages(stages: DataFrame) -> DataFrame:
    """Stages that a run reports twice, and stages without a note."""
    twice = stages.groupBy("run", "stage").count().where("count > 1").select("run", F.concat(F.lit("stage "), "stage", F.lit(" reported twice")).alias("problem"))
    silent = stages.where(F.coalesce("note", F.lit("")).rlike(r"^\s*$"))
    return twice.unionByName(silent.select("run", F.concat(F.lit("stage "), "stage", F.lit(" has no note")).alias("problem")))


def _usage(usage: DataFrame) -> DataFrame:
    who = F.concat(F.lit("usage["), "agent", F.lit("]: "))
    more = F.when(F.col("cached_calls") > F.col("calls"), F.concat(who, F.lit("more cached calls than calls")))
    spent = F.when(F.col("spent_usd") > F.col("cost_usd") + 1e-9, F.concat(who, F.lit("spent_usd exceeds cost_usd")))
    return usage.select("run", F.explode(F.array_compact(F.array(more, spent))).alias("problem"))


def _misfiled(research: DataFrame, runs: DataFrame) -> DataFrame:
    """Outputs filed under another ticker, or of another session than their run's."""
    days = runs.select("run", session_day(as_of_instant(F.col("as_of"))).alias("run_day"))
    return manifest.misfiled_on(research.join(days, "run"), F.col("run_day"), "run")
