"""The tiered index against scores reckoned one by one."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, best=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m, score = 50 + (50 * sum(c.values()) * n_docs) // n_terms, 0
            for t in set(terms(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(found[:best], 1)]
    return out


def some(seed, many, longest, letters="abcdefghijklmnop"):
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choices(letters, k=dice.randrange(1, 5))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(dice.choices(vocabulary, weights, k=dice.randrange(longest))) for _ in range(many)]


def found(spark, docs, items, best=50):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").withColumnsRenamed({})
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return ranking.rank(docs, items, best).collect()


@pytest.mark.parametrize(("tiers", "segment"), [(((64, 32), (512, 4)), 16_384), (((2, 64), (5, 16)), 40), (((1, 1000), (1, 1000)), 7)])
def test_any_tiers_give_the_scores_of_brute_force(spark, monkeypatch, tiers, segment):
    monkeypatch.setattr(ranking, "TIERS", tiers)
    monkeypatch.setattr(ranking, "SEGMENT_DOCS", segment)
    docs = list(enumerate(some(1, 300, 60))) + [(None, "no id aa"), (5, "a repeated id"), (5, "a repeated id"), (400, ""), (401, None), (402, "Éa É x É. 5")]
    items = list(enumerate(some(2, 20, 25))) + [(100, ""), (101, None), (102, "É 5 éa"), (103, "nowhere"), (104, "A a A"), (105, "no id"), (106, "repeated")]
    got = found(spark, docs, items, 10)
    want = brute(docs, items, 10)
    assert sorted((r["item_id"], r["rank"], str(r["doc_id"]), r["score"]) for r in got) == sorted((a, b, str(c), d) for a, b, c, d in want)


def test_items_are_proven_as_early_as_their_residuals_allow(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TIERS", ((5, 1000), (50, 1000)))
    monkeypatch.setattr(ranking, "SEGMENT_DOCS", 1000)
    docs = [(i, "common " * (1 + i % 7) + ("rare " * 5 if i < 3 else "") + "x " * (i % 11)) for i in range(300)]
    got = found(spark, docs, [(1, "rare"), (2, "common rare"), (3, "x rare")], 3)
    assert {r["item_id"]: r["tier"] for r in got}[1] == 0
    assert [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: (r["item_id"], r["rank"]))] == brute(docs, [(1, "rare"), (2, "common rare"), (3, "x rare")], 3)


def test_blocks_of_items_give_what_all_at_once_give(spark, monkeypatch):
    docs, items = list(enumerate(some(3, 80, 30))), list(enumerate(some(4, 12, 12)))
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 20)
    got = found(spark, docs, items)
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == sorted(brute(docs, items))


def test_only_the_tiers_that_are_needed_are_read(spark):
    docs = spark.createDataFrame(list(enumerate(some(5, 50, 20))), "doc_id bigint, text string")
    index = ranking.build_index(docs)
    plan = index.rows.where("tier = 0").select("term", "docs")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tier" in plan and "impacts" not in plan
    assert index.rows.where("tier = -1").selectExpr("sum(size(ids))").first()[0] == 50


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id bigint, text string, rank string, score bigint")
    items = spark.createDataFrame([(9, "b c", "z", "y")], "item_id bigint, text string, doc_id string, tier string")
    assert [tuple(r) for r in ranking.rank(docs, items).collect()] == [(9, 1, 1, brute([(1, "a b")], [(9, "b c")])[0][3], 0)]
    assert ranking.rank(docs.limit(0), items).count() == 0 and ranking.rank(docs, items.limit(0)).count() == 0
