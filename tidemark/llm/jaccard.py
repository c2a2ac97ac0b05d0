"""N-gram Jaccard join by chosen paths.

Each run splits the shingle sets recursively: at a node of the recursion every set samples shared tokens
by one hash per node, about 1/threshold of its own, and goes on to one child per sampled token. Two
sets meet in a child if both sampled a token that they share. Nodes of few sets are compared by brute
force; larger ones are split again, several times over, but for sets so alike that splitting would not part them: those
that share a min-hash with half of a large node. Runs are independent, and so many are made that
their misses fall below one minus the recall.

Brute force in the nodes works on sketches (the least hashes of each set) and only decides which
sets belong together. What belongs together is then compared exactly, on whole sets, each pair
once, in blocks of bounded size; results are per set, so no list of all pairs is ever made.
Sets that are equal are one from the start.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import fresh, in_arrow, map_column
from tidemark.llm.components import components
from tidemark.llm.shingles import mix, shingle_set
from tidemark.llm.storage import small, stored

#: Sets up to which a node is compared by brute force, and the depth at which it is in any case.
NODE_SETS, MAX_DEPTH = 256, 3
#: Sets of a large node that share a min-hash with this share of it belong together as they are.
DENSE = 0.5
#: Least hashes of a set in its sketch; sketches that share under this share of what they can are apart.
SKETCH, SKETCH_SHARE = 64, 0.55
#: Sets and tokens of a block of the exact comparison.
BLOCK_SETS, BLOCK_TOKENS = 1024, 2_000_000

_U = np.uint64


def _survival(levels: int) -> float:
    """How likely a pair at the threshold is to meet again in some node so many levels down.

    Such a pair shares one sampled token at a node on average; if it survives the levels below a child with
    probability p, it survives one level more with 1 - exp(-p).
    """
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float) -> int:
    """Independent runs after which a pair at the threshold that must survive two levels is missed with at most 1 - ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - _survival(2)))


def repeats_for(recall: float, runs: int, threshold: float = 0.8) -> int:
    """How often a large node of depth one is split so that ``runs`` keep the recall if all ``MAX_DEPTH`` levels must be survived.

    ValueError if no number up to 64 does: more runs are needed then.

    In a large node a pair may also be parted by the dense part: one of them in it, the other not. Both
    share the part's min-hash with a probability of the threshold, so at worst, with half of the node in the
    part, they meet with threshold * (1 + s) / 2 where s is the chance to survive the splits.
    """
    needed = -math.log(1 - recall) / runs  # of each large node: 1 - exp(-needed) is what a run must not miss
    repeats, below = 0, _survival(MAX_DEPTH - 1)
    while repeats < 64:
        repeats += 1
        survived = 1 - (1 - below) ** repeats
        if min(survived, threshold * (1 + survived) / 2) >= needed:
            return repeats
    raise ValueError(f"{runs} runs cannot reach a recall of {recall} at a threshold of {threshold}")


def _chosen(tokens: np.ndarray, node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the node, child node) for each token that a set samples at each of the nodes."""
    limit = min(1.0, 1.0 / (threshold * max(len(tokens), 1)))
    with np.errstate(over="ignore"):
        drawn = mix(tokens[None, :] ^ node[:, None])
        at, which = np.nonzero(drawn <= _U(min(int(limit * 2.0**64), 2**64 - 1)))
        return at, mix(mix(tokens[which] + _U(0x632BE59BD9B4E019)) ^ node[at])


def first_nodes(tokens: np.ndarray, runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of depth one that a set reaches over all runs, and its min-hash in each one's run."""
    with np.errstate(over="ignore"):
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))
        labels = mix(tokens[None, :] ^ mix(roots + _U(1))[:, None]).min(1)
    run, node = _chosen(tokens, roots, threshold)
    return node.view(np.int64), labels[run].view(np.int64)


def deeper_nodes(tokens: np.ndarray, node: int, threshold: float, depth: int) -> list[list[int]]:
    """Chains of nodes of the next depths below ``node``, at most ``depth`` long; a set that samples nothing at a node stops there."""
    at = np.array([node], np.int64).view(np.uint64)
    chains: list[list[int]] = []
    for child in _chosen(tokens, at, threshold)[1].view(np.int64).tolist():
        below = deeper_nodes(tokens, child, threshold, depth - 1) if depth > 1 else []
        chains += [[child, *c] for c in below] or [[child]]
    return chains


def repeated_nodes(tokens: np.ndarray, node: int, threshold: float, depth: int, repeats: int) -> list[list[int]]:
    """``deeper_nodes`` of a large node for each of ``repeats`` independent splits of it."""
    with np.errstate(over="ignore"):
        roots = np.array([node], np.int64).view(np.uint64) ^ (np.arange(repeats, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
    return [chain for root in roots.view(np.int64).tolist() for chain in deeper_nodes(tokens, root, threshold, depth)]


def set_key(tokens: np.ndarray) -> str | None:
    """96 bits that name a set; null for the empty one."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=12).hexdigest() if len(tokens) else None


def sketch(tokens: np.ndarray) -> bytes:
    """The least hashes of the set, as 32-bit integers, lowest first."""
    with np.errstate(over="ignore"):
        least = np.sort(mix(tokens))[:SKETCH]
    return (least >> _U(32)).astype(np.uint32).tobytes()


def _described(docs: DataFrame, runs: int, threshold: float, words: int, doc_id: str, text: str) -> DataFrame:
    """Every row as (doc, mark, key, n, sketch, nodes, labels); all of them null for texts without words."""

    def make(texts: list[bytes | None]) -> dict:
        sets = [shingle_set(t, words) for t in texts]
        reached = [first_nodes(s, runs, threshold) if len(s) else (None, None) for s in sets]
        return {
            "key": pa.array([set_key(s) for s in sets], pa.string()),
            "n": pa.array([len(s) or None for s in sets], pa.int64()),
            "sketch": pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
            "nodes": pa.array([r[0] for r in reached], pa.list_(pa.int64())),
            "labels": pa.array([r[1] for r in reached], pa.list_(pa.int64())),
        }

    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("body"))
    schema = "key string, n bigint, sketch binary, nodes array<bigint>, labels array<bigint>"
    return map_column(rows, ["doc", "mark"], F.col("body").cast("binary"), make, schema)


def _counted(entries: DataFrame, node: str = "node") -> DataFrame:
    """Nodes of two sets or more: their number of sets, and sums that tell equal memberships."""
    mark = F.xxhash64("key")
    return (
        entries.groupBy(node)
        .agg(F.count("*").alias("sets"), F.sum(F.shiftright(mark, 20)).alias("sum1"), F.bit_xor(mark).alias("sum2"))
        .where(F.col("sets") > 1)
    )


def _leaves(
    found: DataFrame, docs: DataFrame, threshold: float, words: int, repeats: int, doc_id: str, text: str
) -> tuple[DataFrame, DataFrame | None]:
    """(node, key) of the nodes to compare, nodes of equal members once; and edges (a, b) of dense parts of large nodes."""
    reached = F.explode(F.arrays_zip("nodes", "labels")).alias("at")
    entries = found.where(F.col("key").isNotNull()).select("key", reached)
    entries = entries.select("key", F.col("at.nodes").alias("node"), F.col("at.labels").alias("label")).distinct()
    counted = stored(_counted(entries), "nodes")
    once = counted.where(F.col("sets") <= NODE_SETS).groupBy("sets", "sum1", "sum2").agg(F.min("node").alias("leaf"))
    large = stored(counted.where(F.col("sets") > NODE_SETS).select(F.col("node").alias("big"), "sets"), "large-nodes")
    leaves = entries.join(small(stored(once.select("leaf"), "leaves")), F.col("node") == F.col("leaf")).select("leaf", "key")
    if large.isEmpty():
        return leaves, None
    members = stored(entries.join(small(large), F.col("node") == F.col("big")).select("key", "big", "label", "sets"), "large-members")
    shared = members.groupBy("big", "label", "sets").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    dense = stored(shared.where(F.col("n") >= DENSE * F.col("sets")).select(F.col("big").alias("d_big"), F.col("label").alias("d_label"), "least"), "dense")
    same = (F.col("big") == F.col("d_big")) & (F.col("label") == F.col("d_label"))
    edges = members.join(small(dense), same).where(F.col("key") != F.col("least")).select(F.col("key").alias("a"), F.col("least").alias("b"))
    rest = members.join(small(dense), same, "left_anti").select("key", "big")
    return leaves.unionByName(_deep_leaves(found, docs, rest, threshold, words, repeats, doc_id, text)), edges


def _texts_of(found: DataFrame, keys: DataFrame, docs: DataFrame, kept: list[str], doc_id: str, text: str) -> DataFrame:
    """(key, *kept, body) of one row for each of ``keys`` (key, *kept).

    A row is known by its id and the hash of its text. Where several rows are alike in both, their texts are
    brought down to one, within each task first.
    """
    first = found.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("doc", "mark")).alias("at"))
    first = first.join(small(keys), "key")  # after the rows of a set have become one
    again = found.where(F.col("key").isNotNull()).groupBy(F.col("doc").alias("again"), F.col("mark").alias("again_mark")).agg(F.count("*").alias("rows")).where("rows > 1")
    wanted = first.select("key", F.col("at.doc").alias("doc"), F.col("at.mark").alias("mark"), *kept)
    same = F.col("doc").eqNullSafe(F.col("again")) & (F.col("mark") == F.col("again_mark"))
    wanted = stored(wanted.join(again, same, "left").select("key", "doc", "mark", *kept, F.col("rows").isNotNull().alias("several")), "wanted-texts")
    rows = docs.select(F.col(doc_id).alias("own_doc"), F.xxhash64(text).alias("own_mark"), F.col(text).cast("binary").alias("body"))

    def met(of: DataFrame) -> DataFrame:
        own = F.col("own_doc").eqNullSafe(F.col("doc")) & (F.col("own_mark") == F.col("mark"))
        return rows.join(small(of), own).select("key", *kept, "body")

    single = met(wanted.where(~F.col("several")))
    several = wanted.where("several")
    if several.isEmpty():
        return single
    one = met(several).groupBy("key").agg(*[F.first(c).alias(c) for c in kept], F.min("body").alias("body"))
    return single.unionByName(one.select("key", *kept, "body"))


def _deep_leaves(
    found: DataFrame, docs: DataFrame, members: DataFrame, threshold: float, words: int, repeats: int, doc_id: str, text: str
) -> DataFrame:
    """Leaves below the large nodes of depth one; their members' texts are read once more for that."""
    depth = MAX_DEPTH - 1
    wanted = stored(members.groupBy("key").agg(F.collect_set("big").alias("bigs")), "deep-members")  # at most the set's own nodes
    texts = _texts_of(found, wanted, docs, ["bigs"], doc_id, text)

    def make(rows: list[dict]) -> dict:
        chains = []
        for row in rows:
            tokens = shingle_set(row["body"], words)
            own = set_key(tokens) == row["key"]
            chains.append([chain for big in (row["bigs"] if own else []) for chain in repeated_nodes(tokens, big, threshold, depth, repeats)])
        return {"chains": pa.array(chains, pa.list_(pa.list_(pa.int64())))}

    deep = map_column(texts, ["key"], F.struct("key", "bigs", "body"), make, "chains array<array<bigint>>")
    chain, levels = F.col("chain"), [f"level{i}" for i in range(1, depth + 1)]
    rows = stored(
        deep.select("key", F.explode("chains").alias("chain")).select("key", *[F.get(chain, F.lit(i)).alias(c) for i, c in enumerate(levels)]),
        "deep-nodes",
    )
    leaves = None
    for i, own in enumerate(levels):
        sizes = stored(_counted(rows.select("key", own).distinct(), own).select(F.col(own).alias("leaf"), "sets"), "deep-sizes")
        met = rows.join(small(sizes), F.col(own) == F.col("leaf"))  # sets alone in a node go no further
        ends = (F.col("sets") <= NODE_SETS) | F.lit(i == depth - 1)
        done = met.where(ends).select("leaf", "key").distinct()
        leaves = done if leaves is None else leaves.unionByName(done)
        rows = met.where(~ends).select("key", *levels)
    return leaves


def _grouped(rows: DataFrame, by: list[str], work: Callable[[pa.Table], dict[str, list]], schema: str, out: pa.Schema) -> DataFrame:
    """``work`` on the rows of each group; the groups, bounded in size, share tasks and arrive one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        made: dict[str, list] = {name: [] for name in out.names}

        def close() -> None:
            if held:
                for name, values in work(pa.Table.from_batches(held)).items():
                    made[name].extend(values)
                held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
            for values in made.values():
                values.clear()
            return batch

        for batch in batches:
            keys = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by], strict=True))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if start == end:
                    continue
                if keys[start] != last:
                    close()
                    last = keys[start]
                held.append(batch.slice(start, end - start))
            if len(made[out.names[0]]) > 20_000:
                yield flush()
        close()
        if made[out.names[0]]:
            yield flush()

    return in_arrow(rows.repartition(*by).sortWithinPartitions(*by), run, schema)


def _shared(tokens: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many tokens each of the sets shares with each of ``right`` (or of themselves), as a matrix."""
    both = tokens + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(t) for t in both])
    joined = np.concatenate(both) if both else np.zeros(0, np.uint64)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    fresh = np.concatenate(([True], joined[1:] != joined[:-1])) if len(joined) else np.zeros(0, bool)
    number = np.cumsum(fresh) - 1
    often = np.bincount(number)[number] > 1 if len(number) else fresh
    owner, number = owner[often], number[often]
    _, number = np.unique(number, return_inverse=True)
    m, k = len(tokens), len(right) if right is not None else len(tokens)
    total = np.zeros((m, k), np.float32)
    step = max(1, 4_000_000 // max(len(both), 1))
    bounds = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + step, step))
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        if begin == end:
            continue
        base = number[begin]
        held = np.zeros((len(both), number[end - 1] - base + 1), np.float32)
        held[owner[begin:end], number[begin:end] - base] = 1
        total += held[:m] @ (held[m:] if right is not None else held).T
    return total


def _roots(links: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric boolean matrix is connected with."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _alike(table: pa.Table) -> dict[str, list]:
    """Star edges among the members of a node whose sketches are close."""
    keys = table.column("key").to_pylist()
    n = np.array(table.column("n").to_pylist())
    sketches = [np.frombuffer(s, np.uint32) for s in table.column("sketch").to_pylist()]
    sizes = np.minimum(n, SKETCH)
    shared = _shared(sketches)
    links = shared >= SKETCH_SHARE * np.maximum(sizes[:, None], sizes[None, :])
    np.fill_diagonal(links, False)
    root = _roots(links)
    moved = np.flatnonzero(root != np.arange(len(keys)))
    return {"a": [keys[i] for i in moved], "b": [keys[root[i]] for i in moved]}


def _near(leaves: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (a, b) between sets whose sketches are close in some node. Nodes over a block are cut in blocks."""
    sizes = stored(leaves.groupBy(F.col("leaf").alias("of")).agg(F.count("*").alias("sets")), "leaf-sizes")
    keys = stored(leaves.select(F.col("key").alias("wanted")).distinct(), "leaf-keys")
    known = found.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    known = known.join(small(keys), F.col("key") == F.col("wanted"), "left_semi")
    rows = leaves.join(small(sizes), F.col("leaf") == F.col("of")).select("leaf", F.col("key").alias("own"), "sets")
    rows = rows.join(known, F.col("own") == F.col("key")).select("leaf", "sets", "key", "n", "sketch")
    dealt = _dealt(rows, "leaf", F.ceil(F.col("sets") / BLOCK_SETS))
    out = pa.schema([("a", pa.string()), ("b", pa.string())])
    return _grouped(dealt, ["leaf", "i", "j"], _alike, "a string, b string", out).distinct()


def _dealt(rows: DataFrame, group: str, blocks: F.Column) -> DataFrame:
    """Each row in every pair of blocks (i, j) of its group that its own block is in; one pair if the group is one block."""
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return (
        rows.withColumn("blocks", blocks.cast("bigint"))
        .withColumn("block", own)
        .withColumn("other", other)
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("other", "blocks")
    )


def _exact(threshold: float) -> Callable[[pa.Table], dict[str, list]]:
    """Links of a pair of blocks: how many each set has, and star edges. A set that comes twice counts once."""

    def work(table: pa.Table) -> dict[str, list]:
        first = {}
        for at, key in enumerate(table.column("key").to_pylist()):
            first.setdefault(key, at)
        table = table.take(list(first.values()))
        keys, block = table.column("key").to_pylist(), np.array(table.column("block").to_pylist())
        sets = [np.frombuffer(s, np.uint64) for s in table.column("tokens").to_pylist()]
        size = np.array([len(s) for s in sets])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        if i == j:
            links = _linked(_shared(sets), size, size, threshold)
            np.fill_diagonal(links, False)
        else:
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            links = np.zeros((len(keys), len(keys)), bool)
            met = _linked(_shared([sets[x] for x in left], [sets[x] for x in right]), size[left], size[right], threshold)
            links[np.ix_(left, right)] = met
            links |= links.T
        root, count = _roots(links), links.sum(1)
        held = np.flatnonzero(count)
        return {"a": [keys[x] for x in held], "b": [keys[root[x]] for x in held], "links": count[held].tolist()}

    return work


def _linked(shared: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    return shared.astype(np.float64) >= threshold * (left[:, None] + right[None, :] - shared) - 1e-9


def jaccard_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    recall: float = 0.999,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document row: doc_id, mark (hash of the text), class_key, class_id, copy_of, n_copies, n_links.

    Two texts are linked if the Jaccard similarity of their sets of shingles of ``words`` words is at
    least ``threshold``; a text of fewer words has one shingle. n_links counts the other, different
    sets that a text is linked with; n_copies the other rows of an equal set. copy_of is the
    least id of the rows of an equal set, class_id the least of all that are connected by links.
    Null and empty texts, and texts without a word, are each a class of their own, without a class_key. Null ids come
    into class_id and copy_of only if no row of the class has an id; rows of equal ids are told apart
    by their texts, and equal rows give equal rows. Other columns are ignored.

    A linked pair is missed with a probability of at most 1 - ``recall``; links that are counted are exact.
    """
    runs = runs_for(recall)
    found = stored(_described(docs, runs, threshold, words, doc_id, text), "sets")
    leaves, dense = _leaves(found, docs, threshold, words, repeats_for(recall, runs, threshold), doc_id, text)
    near = _near(stored(leaves, "members"), found)
    together = components(near if dense is None else near.unionByName(dense))
    sizes = (
        found.where(F.col("key").isNotNull()).select("key", "n").distinct().join(together, F.col("key") == F.col("node"))
    )
    groups = stored(sizes.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")), "groups")
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS))
    members = stored(
        together.join(small(groups.withColumnRenamed("root", "of")), F.col("root") == F.col("of")).select(
            F.col("node").alias("key"), "root", blocks.alias("parts")
        ),
        "group-members",
    )
    texts = _texts_of(found, members, docs, ["root", "parts"], doc_id, text)

    def make(rows: list[dict]) -> dict:
        sets = [shingle_set(r["body"], words) for r in rows]
        own = [s.tobytes() if set_key(s) == r["key"] else None for s, r in zip(sets, rows, strict=True)]
        return {"tokens": pa.array(own, pa.binary())}

    sets = map_column(texts, ["key", "root", "parts"], F.struct("key", "body"), make, "tokens binary")
    dealt = _dealt(sets.where(F.col("tokens").isNotNull()), "root", F.col("parts"))
    out = pa.schema([("a", pa.string()), ("b", pa.string()), ("links", pa.int64())])
    exact = stored(_grouped(dealt, ["root", "i", "j"], _exact(threshold), "a string, b string, links bigint", out), "links")
    links = exact.groupBy(F.col("a").alias("l_key")).agg(F.sum("links").alias("n_links"))
    classes = components(exact.select("a", "b"))

    copies = found.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc").alias("copy_of"), F.count("*").alias("rows"))
    linked = copies.join(classes, F.col("key") == F.col("node")).join(links, F.col("key") == F.col("l_key"))
    linked = stored(linked.select("key", "copy_of", "root", "n_links"), "linked-classes")
    least = linked.groupBy(F.col("root").alias("c_root")).agg(F.min("copy_of").alias("class_id"))
    linked = linked.join(small(stored(least, "class-ids")), F.col("root") == F.col("c_root")).select(F.col("key").alias("c_key"), "root", "class_id", "n_links")
    linked = stored(linked, "linked-sets")
    facts = copies.join(small(linked), F.col("key") == F.col("c_key"), "left").select(
        F.col("key").alias("f_key"),
        F.coalesce("root", "key").alias("class_key"),
        F.coalesce("class_id", "copy_of").alias("class_id"),
        "copy_of",
        "rows",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    facts = stored(facts, "set-facts")  # a plain side of a join that a set of many copies makes skewed
    alone = F.col("key").isNull()
    return found.select("doc", "mark", "key").join(small(facts), F.col("key") == F.col("f_key"), "left").select(
        F.col("doc").alias("doc_id"),
        "mark",
        "class_key",
        F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce(F.col("rows") - 1, F.lit(0)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of ``jaccard_classes``, that of the least id, with all its columns, whatever their names.

    Rows without an id stay only where no row of their class has one; equal rows stay once. Texts
    without a word are classes of their own and all stay.
    """
    judged = jaccard_classes(docs, threshold, words, recall, doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    best = judged.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min(order).alias("best"))
    doc, mark, own = (fresh(docs.columns, n) for n in ("kept_doc", "kept_mark", "own_mark"))
    chosen = stored(best.select(F.col("best.doc_id").alias(doc), F.col("best.mark").alias(mark)).distinct(), "chosen")
    wordless = stored(judged.where(F.col("class_key").isNull()).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark)).distinct(), "wordless")
    marked = docs.withColumn(own, F.xxhash64(docs[text]))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(mark))
    kept = marked.join(small(chosen), same, "left_semi").dropDuplicates([doc_id, own])
    return kept.unionByName(marked.join(small(wordless), same, "left_semi")).drop(own)
