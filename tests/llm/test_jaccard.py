"""The chosen-path join, its parts, and the pipeline."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, jaccard, shingles

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_set(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_shingles_are_brute_force():
    texts = ["a b c d e f", "A b, C. d e  F!", "a b", "", None, "…", "é É x", "x y z " * 50, "0" * 5000 + " 1 2 3 4 5"]
    sets = [shingles.shingle_set(None if t is None else t.encode()) for t in texts]
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    for (a, s), (b, t) in itertools.combinations(zip(texts, sets, strict=True), 2):
        assert len(np.intersect1d(s, t)) == len(brute_set(a) & brute_set(b))


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "BROADCAST_EDGES", few)
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, None), (7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    root = {}

    def least(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            a, b = least(a), least(b)
            root[max(a, b)] = min(a, b)
    assert found == {x: least(x) for x in root}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_chosen_paths_meet():
    """Pairs at the threshold meet in some node of depth one nearly always, others hardly ever."""
    rng = np.random.default_rng(1)
    runs, met, apart = jaccard.runs_for(0.999), 0, 0
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, 90).astype(np.uint64))
        y = np.unique(np.concatenate((x[:80], rng.integers(0, 2**63, 10).astype(np.uint64))))
        z = np.unique(np.concatenate((x[:5], rng.integers(0, 2**63, 85).astype(np.uint64))))
        nodes = [set(jaccard.first_nodes(s, runs, 0.8)[0].tolist()) for s in (x, y, z)]
        met += bool(nodes[0] & nodes[1])
        apart += not nodes[0] & nodes[2]
    assert met >= 199 and apart >= 80


def test_chosen_paths_meet_below_large_nodes():
    """Pairs at the threshold that meet only in nodes of the greatest depth are found as often as promised."""
    rng = np.random.default_rng(2)
    runs, met, pairs = jaccard.runs_for(0.999), 0, 2000
    below, repeats = jaccard.MAX_DEPTH - 1, jaccard.repeats_for(0.999, runs)

    def ends(tokens, node):
        return {c[-1] for c in jaccard.repeated_nodes(tokens, node, 0.8, below, repeats) if len(c) == below}

    for _ in range(pairs):
        y = np.unique(rng.integers(0, 2**63, 90).astype(np.uint64))
        x = y[rng.permutation(90)[:72]]
        first = [set(jaccard.first_nodes(s, runs, 0.8)[0].tolist()) for s in (x, y)]
        met += any(set.intersection(*[ends(s, node) for s in (x, y)]) for node in first[0] & first[1])
    assert met >= 0.997 * pairs


def check(spark, texts, monkeypatch=None):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    table = spark.createDataFrame([*rows, rows[0], (None, texts[0], "x"), (None, "nobody else says these words", "x")], "doc_id bigint, text string, class_id string")
    found = {}
    judged = jaccard.jaccard_classes(table).collect()
    assert len(judged) == len(texts) + 3
    for r in judged:
        found[r["doc_id"]] = r
    sets = [frozenset(brute_set(t)) for t in texts]
    distinct = sorted(set(sets) - {frozenset()}, key=sets.index)
    links = {s: [t for t in distinct if t != s and len(s & t) >= 0.8 * len(s | t)] for s in distinct}
    group, todo = {}, []
    for s in distinct:
        if s not in group:
            todo.append(s)
            while todo:
                t = todo.pop()
                if t not in group:
                    group[t] = sets.index(s)
                    todo += links[t]
    for i, s in enumerate(sets):
        r = found[i]
        if s:
            assert (r["class_id"], r["copy_of"], r["n_links"]) == (group[s], sets.index(s), len(links[s])), i
            assert r["n_copies"] == sum(t == s for t in sets) - 1 + 2 * (s == sets[0])
        else:
            assert (r["class_id"], r["copy_of"], r["n_links"], r["n_copies"], r["class_key"]) == (i, i, 0, 0, None)
    kept = jaccard.keep_one(table)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == table.columns
    assert sorted(x for x in ids if x is not None) == sorted({r["class_id"] for r in judged if r["doc_id"] is not None}) and ids.count(None) == 1


def texts_of(seed, groups, near, size=60):
    rng = np.random.default_rng(seed)
    out = ["one two three four five six seven eight", "", None, "...", "a b", "A, b!", "a c"]
    shared = " ".join(f"s{i}" for i in range(12))
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(size)]
        for _ in range(near):
            w = list(base)
            for at in rng.integers(0, size, int(rng.integers(0, 4))):
                w[at] = f"n{rng.integers(0, 10**9)}"
            out.append(" ".join(w) + " " + shared)
    return out


def test_join_is_brute_force(spark):
    check(spark, texts_of(0, 12, 6) + ["x" * 3000 + " y" * 3000])


def test_large_nodes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE_SETS", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    check(spark, texts_of(1, 3, 40) + [" ".join(f"s{i}" for i in range(12)) + f" u{j} v{j} w{j}" for j in range(60)])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.jaccard_classes(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids, at = {r["doc_id"] for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(DATA))
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert {r["doc_id"] for r in rows} <= ids and len(rows) == len({r["doc_id"] for r in rows})
        at = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(DATA))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_pipeline_rules_keep_what_op7_keeps(spark):
    import corpus_pipeline
    from conftest import DATA

    from tidemark.llm import queries

    folder = str(DATA.parent / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r["doc_id"] for r in queries.op7_quality_rules(spark, folder).where("kept").collect()}
    for handed in (corpus_pipeline.quality_classifier(spark, docs, folder), docs.join(spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0").select("doc_id"), "doc_id", "left_anti")):
        ids = {r["doc_id"] for r in handed.select("doc_id").collect()}
        assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, handed, folder).collect()} == ids & good


def test_many_rows_of_one_id(spark):
    """Null ids and repeated rows are known by their texts: each set is read once, and no text for another's key."""
    near = texts_of(5, 2, 4)[7:]
    rows = [(None, t, "x") for t in near for _ in range(40)] + [(7, t, "x") for t in near] + [(7, near[0], "x")] * 30
    table = spark.createDataFrame(rows, "doc_id bigint, text string, class_id string").repartition(5)
    found = jaccard.jaccard_classes(table).collect()
    sets = {t: frozenset(brute_set(t)) for t in near}
    links = {t: len({s for s in sets.values() if s != sets[t] and len(s & sets[t]) >= 0.8 * len(s | sets[t])}) for t in near}
    assert len(found) == len(rows)
    assert sorted(r["n_links"] for r in found) == sorted(links[t] for _, t, _ in rows)
    assert {r["class_id"] for r in found} == {7}
    kept = jaccard.keep_one(table).collect()
    assert len(kept) == len({r["class_key"] for r in found}) and {r["doc_id"] for r in kept} == {7}


AWKWARD = ["", None, "…", "one word", "w " * 200, "x" * 50_000]


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, very long texts and clashing columns pass through every stage; empty tables too."""
    import corpus_pipeline
    from conftest import DATA

    given = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in given.collect()]
    extra = [dict(rows[0], doc_id=None), dict(rows[1], lang=None, source=None, n_chars=None), rows[2], rows[2]]
    extra += [dict(rows[3], doc_id=9_000 + i, text=t) for i, t in enumerate(AWKWARD)] + [dict(rows[4], doc_id=9_100, text=(rows[4]["text"] or "a b. ") * 200)]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in given.schema)}, score string, key string, mark string, term string, value string"
    whole = spark.createDataFrame([tuple(r.values()) + ("s", "k", "m", "t", "v") for r in rows + extra], schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    given.write.parquet(str(tmp_path / "documents.parquet"))
    for at in (whole, whole.limit(0)):
        for _name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, at, str(tmp_path))
            assert after.columns == whole.columns
            kept = after.collect()
            assert {r["text"] for r in kept} <= {r["text"] for r in at.collect()}
            at = spark.createDataFrame(kept, whole.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
        assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in at.collect())


def test_the_pipeline_leaves_only_its_result(spark):
    """The whole run gives what its stages give one after the other, and removes what they stored on the way."""
    from pathlib import Path

    import corpus_pipeline
    from conftest import DATA

    from tidemark.sources.tables import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:")) / "tidemark"
    before = set(folder.iterdir()) if folder.exists() else set()
    packed = corpus_pipeline.run(spark, str(DATA))
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {"pipeline-packing"}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}
