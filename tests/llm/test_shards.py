"""Sharding over virtual slots."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import shards


def some(spark, many, longest=2000, seed=1):
    dice = random.Random(seed)
    rows = [(i, "é" * dice.randrange(longest), "clash") for i in range(many)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, shard string"), rows


def loads(rows):
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    return [sums[s] for s in range(8)]


def test_rows_sizes_and_places(spark):
    docs, rows = some(spark, 500)
    extra = [(None, "no id", None), (None, "no id either", None), (3, rows[3][1], "again"), (700, "", None), (701, None, None), (3, "other text", None)]
    found = shards.shard_rows(docs.unionByName(spark.createDataFrame(extra, docs.schema))).collect()
    want = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows + extra)
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r["shard"]].append(r["slot"])
    assert set(places) == set(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}


@pytest.mark.parametrize("many", [200, 3000])
def test_sizes_are_nearly_equal(spark, many):
    docs, _ = some(spark, many)
    sums = loads(shards.shard_rows(docs).collect())
    assert max(sums) - min(sums) < 0.02 * sum(sums) / 8


def test_one_long_text_leaves_the_other_shards_equal(spark):
    docs, _ = some(spark, 400)
    long = spark.createDataFrame([(1000, "x" * 100_000, None)], docs.schema)
    sums = sorted(loads(shards.shard_rows(docs.unionByName(long)).collect()))
    assert sums[-1] < 1.1 * sum(sums) / 8 and sums[0] > 0.9 * sum(sums) / 8


def test_a_repeated_row_is_counted_and_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK", 7)
    docs = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    found = shards.shard_rows(docs).collect()
    assert len(found) == 1000 and len({r["shard"] for r in found if r["doc_id"] == 5}) == 1
    places = defaultdict(list)
    for r in found:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert shards.records(docs).count() == 601


def test_the_slot_is_known_from_the_id_alone(spark):
    docs, rows = some(spark, 50)
    for r in docs.select("doc_id", shards.slot_of(F.col("doc_id"), F.col("text")).alias("v"), shards.slot_of(F.col("doc_id"), F.lit("other")).alias("w")).collect():
        assert r["v"] == r["w"] == int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % 8192


def as_dict(held):
    return {r["vslot"]: r["shard"] for r in held.collect()}


def test_rebalancing_moves_only_from_full_to_empty_and_keeps_versions(spark, tmp_path):
    docs, _ = some(spark, 3000)
    sizes = shards.slot_sizes(shards._cells(shards.records(docs)))
    path = f"file://{tmp_path}/maps"
    last = shards.balanced_map(spark, sizes, 8, path=path)
    one, two = as_dict(shards.load_version(spark, path, 1)), as_dict(shards.load_version(spark, path, 2))
    assert as_dict(shards.load_version(spark, path)) == as_dict(last) and last.first()["version"] == 4
    held = {r["vslot"]: r["bytes"] for r in sizes.collect()}
    before = Counter()
    for slot, shard in one.items():
        before[shard] += held.get(slot, 0)
    share = sum(held.values()) / 8
    moved = {s for s in one if one[s] != two[s]}
    assert moved and all(before[one[s]] > share for s in moved)
    assert sum(held[s] for s in moved if before[two[s]] > share) < 8 * max(held.values())  # what a full shard gave too much of
    assert sum(held[s] for s in moved) < 1.5 * sum(max(0, b - share) for b in before.values())
    with pytest.raises(ValueError):
        shards.save_version(last, path)
    with pytest.raises(ValueError):
        shards.load_version(spark, path, 9)


def test_another_shard_takes_slots_only_into_itself(spark):
    docs, _ = some(spark, 3000)
    sizes = shards.slot_sizes(shards._cells(shards.records(docs)))
    old = shards.balanced_map(spark, sizes, 8)
    new = shards.grown(old, sizes, 8)
    a, b = as_dict(old), as_dict(new)
    held = {r["vslot"]: r["bytes"] for r in sizes.collect()}
    assert {b[s] for s in a if a[s] != b[s]} == {8}
    sums = Counter()
    for slot, shard in b.items():
        sums[shard] += held.get(slot, 0)
    assert max(sums.values()) < 1.05 * sum(sums.values()) / 9 and new.first()["version"] == 5


def test_shards_are_written_with_all_columns(spark, tmp_path):
    docs, rows = some(spark, 100)
    sizes = shards.slot_sizes(shards._cells(shards.records(docs)))
    held = shards.balanced_map(spark, sizes, 4)
    shards.write_shards(docs, held, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["doc_id", "text", "shard", "shard_1"] and back.count() == 100
    of = as_dict(held)
    assert all(r["shard_1"] == of[int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % 8192] for r in back.collect())


def test_empty_table(spark):
    docs, _ = some(spark, 1)
    assert shards.shard_rows(docs.limit(0)).count() == 0
