"""Records of many runs against those of one."""

import json

from pyspark.sql import functions as F

from tidemark.operators import manifest, records, rules


def parts_of(spark, runs):
    empty = manifest.Parts.empty(spark)
    made = {}
    rows = {
        "meta": [(1, "AAA", "tech", 5.0), (2, "B\"B", None, None), (3, "CCC", None, 1.5)],
        "summaries": [("AAA", '{"trend": "up"}')],
        "gaps": [(1, "CCC", "sector", "told"), (2, "CCC", "summary", "why, \"so\"")],
        "failures": [(1, "a", "AAA", "schema", "no"), (2, "a", "CCC", "schema", "no")],
        "research": [(2, "AAA", '{"agent": "a", "ticker": "AAA", "as_of": "2026-09-14"}'), (1, "AAA", '{"agent": "b", "ticker": "AAA", "as_of": "2026-09-14"}')],
        "usage": [("b", "m", "live", 1, 0, 1, 1, 0.5, 0.5), ("a", "m", "live", 1, 0, 1, 1, 0.25, 0.25)],
        "stages": [(1, "data", "ran", "n"), (2, "research", "failed", "two")],
    }
    for name, held in rows.items():
        schema = getattr(empty, name).schema
        made[name] = spark.createDataFrame([(r, *row) for r in runs for row in held], "run string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    return made


def test_a_document_of_many_runs_is_that_of_one(spark):
    runs = [("r1", "morning", "live", "2026-09-14", "2026-09-14T16:30:00"), ("r2", "midday", "fake", "2026-09-14", "2026-09-14T16:30:00"), ("r3", "morning", "live", "2026-09-15", "2026-09-15T16:30:00")]
    made = parts_of(spark, ["r1", "r2", "elsewhere"])
    frame = spark.createDataFrame(runs, "run string, run_type string, backend string, date string, as_of string")
    found = {r["run"]: r for r in records.documents(frame, **made).collect()}
    assert set(found) == {"r1", "r2", "r3"}
    for run, run_type, backend, day, as_of in runs[:2]:
        one = manifest.Parts(**{name: rows.where(f"run = '{run}'").drop("run") for name, rows in made.items()})
        assert json.loads(found[run]["document"]) == manifest.build(one, day, as_of, run_type, backend)
        assert found[run]["problems"] == sorted(r["problem"] for r in one.problems(as_of).collect()) and len(found[run]["problems"]) == 2
    empty = json.loads(found["r3"]["document"])
    assert (empty["stages"], empty["research"], found["r3"]["problems"]) == ([], {}, [])
    assert rules.problem("run_manifest", manifest.SCHEMA, empty | {"stages": [{"stage": "s", "status": "ran", "note": "n"}]}) is None


def test_problems_are_told_of_the_run_that_has_them(spark):
    made = parts_of(spark, ["r1", "r2"])
    made["stages"] = made["stages"].unionByName(spark.createDataFrame([("r2", 3, "data", "ran", " ")], made["stages"].schema)).where("not (run = 'r2' and status = 'failed')")
    made["usage"] = made["usage"].unionByName(spark.createDataFrame([("r1", "z", "m", "live", 1, 2, 1, 1, 1.0, 2.0)], made["usage"].schema))
    runs = [("r1", "morning", "live", "2026-09-14", "2026-09-14T16:30:00"), ("r2", "morning", "live", "2026-09-14", "2026-09-15T16:30:00")]
    frame = spark.createDataFrame(runs, "run string, run_type string, backend string, date string, as_of string")
    found = {r["run"]: r["problems"] for r in records.documents(frame, **made).collect()}
    shared = ['B"B has no summary and no data gap saying why', f'ticker_meta[B"B].sector is empty but {manifest.BLANK}']
    assert found["r1"] == sorted([*shared, "usage[z]: more cached calls than calls", "usage[z]: spent_usd exceeds cost_usd"])
    assert found["r2"] == sorted([*shared, "stage data reported twice", "stage data has no note", "agent failure(s) a[AAA], a[CCC] but no stage is marked failed",
        "a[AAA] is stamped '2026-09-14', not session 2026-09-15", "b[AAA] is stamped '2026-09-14', not session 2026-09-15"])


def test_tickers_are_hashed_and_outputs_are_parsed_once(spark):
    made = parts_of(spark, ["r1"])
    facts = records.ticker_facts(made["meta"], made["summaries"], made["gaps"])
    assert "SortAggregate" not in facts._jdf.queryExecution().executedPlan().toString()
    assert {(r["ticker"], r["field"]) for r in records.missing(facts).collect()} == {('B"B', "sector"), ('B"B', "summary")}
    found = manifest.misfiled_research(made["research"], F.lit("2026-09-15T16:30:00"), "run")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.lower().replace("_", "").count("parsejson") <= 3  # those of one ``one_json``
    assert {r["problem"] for r in found.collect()} == {f"{a}[AAA] is stamped '2026-09-14', not session 2026-09-15" for a in "ab"}
