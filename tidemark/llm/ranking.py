"""Ranked lexical search over a tiered index: high-impact postings first, and a proof before lower tiers are left out.

The index is made of segments, each the documents of a part of a task. A segment has a row for each of its
terms and tiers: the term's postings of highest impact lie in the first tier, those that follow in the
second, the rest in the last, and every row states its highest impact. What a document can still gain from
tiers that were not read is bounded by those statements, the residual of each term. An item is
answered by a tier once no document outside its best ones can reach the last of them; items without that proof
fall through to the next tier, the last of which leaves no residual.

Scores are whole numbers. Segments have a bounded number of documents and postings, so a term that every
document has makes many rows and no hot task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import give_back, in_arrow
from tidemark.llm.storage import small, stored
from tidemark.llm.words import ascii_lower, cased_words

#: Documents and postings at which a segment is closed. Documents are numbered in 16 bits.
SEGMENT_DOCS, SEGMENT_POSTINGS = 16_384, 500_000
#: Of a segment's postings of a term so many at least, and such a share, lie in the first tier, or in the first two.
TIERS = ((64, 32), (512, 4))
#: Pairs of item and term that are answered at one time.
BLOCK_TERMS = 200_000
#: Rows that go to Spark at one time.
OUT_ROWS = 4_096

#: Every byte that separates terms as a blank, A-Z as a-z, all others as they are.
_PLAIN = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def term_array(text: Column) -> Column:
    """The terms of a text, in order, with repeats; null and empty texts have none."""
    return F.transform(cased_words(text), ascii_lower)


@dataclass(frozen=True)
class Corpus:
    """How many documents have a term, how many terms they have with repeats, and how lengths and repeats weigh."""

    n_docs: int
    n_terms: int
    b: int = 50
    k: int = 20

    def impacts(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a weight of one is multiplied by, for terms that occur ``tf`` times in texts of so many terms."""
        m = 100 - self.b + (self.b * length * self.n_docs) // max(1, self.n_terms)
        return (1_000_000_000 * tf) // (1000 * tf + self.k * m)

    def weight(self, df: Column) -> Column:
        return F.floor(1000 * F.log((2 * F.lit(self.n_docs) + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Index:
    """Rows (tier, segment, term, n, top, docs, impacts, ids): of tier -1 one a segment, with its documents' ids in order."""

    corpus: Corpus
    rows: DataFrame

    @property
    def tiers(self) -> int:
        return len(TIERS) + 1


class _Segment:
    """The postings of some documents, until they are written."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.known: dict[bytes, int] = {}
        self.size = 0

    def add(self, doc_id: object, body: bytes) -> None:
        words = body.translate(_PLAIN).split()
        held, known = Counter(words), self.known
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(np.fromiter((known.setdefault(w, len(known)) for w in held), np.int32, len(held)))
        self.counts.append(np.fromiter(held.values(), np.int32, len(held)))
        self.size += len(held)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.size >= SEGMENT_POSTINGS

    def batches(self, name: str, corpus: Corpus, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The segment's rows, tier by tier, in order of terms. Documents are numbered in order of their ids, nulls last."""
        in_order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        number = np.empty(len(in_order), np.int64)
        number[in_order] = np.arange(len(in_order))
        ids = [self.ids[i] for i in in_order]
        yield _batch(-1, name, [None], [len(ids)], [0], pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([ids], pa.list_(kind)))
        if not self.size:
            return
        sizes = np.array([len(t) for t in self.terms])
        doc, tf = np.repeat(number, sizes), np.concatenate(self.counts).astype(np.int64)
        impact = corpus.impacts(tf, np.repeat(np.array(self.lengths, np.int64), sizes))
        names = sorted(self.known)
        place = np.empty(len(names), np.int64)
        place[[self.known[w] for w in names]] = np.arange(len(names))
        term = place[np.concatenate(self.terms)]
        by = np.lexsort((doc, -impact, term))
        doc, impact, term = doc[by].astype(np.uint16), impact[by].astype(np.uint32), term[by]
        n = np.bincount(term, minlength=len(names))
        first = np.concatenate(([0], n.cumsum()[:-1]))
        rank = np.arange(len(term)) - np.repeat(first, n)
        ends = [np.minimum(n, np.maximum(least, n // share)) for least, share in TIERS] + [n]
        texts = np.array([w.decode() for w in names], object)
        begun = np.zeros_like(n)
        for tier, end in enumerate(ends):
            end = np.maximum(end, begun)
            here = (rank >= np.repeat(begun, n)) & (rank < np.repeat(end, n))
            rows = np.flatnonzero(end > begun)
            size, top = (end - begun)[rows], impact[(first + begun)[rows]]
            docs, impacts = doc[here], impact[here]
            upto = np.concatenate(([0], size.cumsum()))
            for at in range(0, len(rows), OUT_ROWS):
                part = slice(at, min(len(rows), at + OUT_ROWS))
                a, z = upto[part.start], upto[part.stop]
                offsets = upto[part.start : part.stop + 1] - a
                yield _batch(tier, name, texts[rows[part]], size[part], top[part], _cells(docs[a:z], offsets), _cells(impacts[a:z], offsets), pa.nulls(len(size[part]), pa.list_(kind)))
            begun = end


def _cells(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of an array as cells of bytes."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


_COLUMNS = ["tier", "segment", "term", "n", "top", "docs", "impacts", "ids"]


def _batch(tier: int, segment: str, terms, n, top, docs: pa.Array, impacts: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    many = len(docs)
    return pa.RecordBatch.from_arrays(
        [pa.array([tier] * many, pa.int32()), pa.array([segment] * many, pa.string()), pa.array(terms, pa.string()), pa.array(n, pa.int32()), pa.array(top, pa.int64()), docs, impacts, ids],
        names=_COLUMNS,
    )


def corpus_of(docs: DataFrame, text: str = "text", b: int = 50, k: int = 20) -> Corpus:
    n = F.size(cased_words(F.col(text))).cast("bigint")
    found = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    return Corpus(found["docs"], found["terms"] or 0, b, k)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", b: int = 50, k: int = 20) -> Index:
    """The stored index of every row and every term, whatever is searched for; one folder a tier."""
    corpus = corpus_of(docs, text, b, k)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, closed, kind = TaskContext.get().partitionId(), _Segment(), 0, None
        for batch in batches:
            kind = batch.column(0).type
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(doc, body.as_py())
                if held.full():
                    yield from held.batches(f"{task}-{closed}", corpus, kind)
                    held, closed = _Segment(), closed + 1
        if held.ids:
            yield from held.batches(f"{task}-{closed}", corpus, kind)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"tier int, segment string, term string, n int, top bigint, docs binary, impacts binary, ids array<{kind}>"
    return Index(corpus, stored(in_arrow(rows, work, schema), "tiered-index", by=["tier"]))


def _questions(index: Index, items: DataFrame, text: str) -> DataFrame:
    """Stored (row, term, weight, rest): the different terms of each numbered item that the corpus has.

    rest is an array: what a document may still gain from the term after each tier.
    """
    asked = stored(items.select("row", F.explode(F.array_distinct(term_array(F.col(text)))).alias("term")), "item-terms")
    held = index.rows.where(F.col("tier") >= 0).select("tier", "term", "n", "top").join(small(stored(asked.select("term").distinct(), "terms")), "term")
    below = [F.coalesce(F.max(F.when(F.col("tier") > t, F.col("top"))), F.lit(0)) for t in range(index.tiers)]
    facts = held.groupBy("term").agg(F.sum("n").alias("df"), F.array(*below).alias("below"))
    weight = index.corpus.weight(F.col("df"))
    facts = facts.select("term", weight.alias("weight"), F.transform("below", lambda top: top * weight).alias("rest"))
    return stored(asked.join(small(stored(facts, "term-facts")), "term").where(F.col("weight") > 0), "questions")


def _score(rows: DataFrame, asked: dict[int, list[tuple[str, int, int]]], least: dict[int, int], best: int) -> DataFrame:
    """(row, doc, score, open) by segment: an item's best documents there by what was read, and, without a
    document, the most that one of which not all was read may come to."""

    def work(table: pa.Table) -> pa.Table:
        own = table.column("tier").to_pylist().index(-1)
        ids = table.column("ids")[own].as_py()
        lists = defaultdict(list)
        for term, docs, impacts in zip(table.column("term").to_pylist(), table.column("docs"), table.column("impacts"), strict=True):
            if term is not None:
                lists[term].append((np.frombuffer(docs.as_py(), np.uint16), np.frombuffer(impacts.as_py(), np.uint32).astype(np.int64)))
        out_row, out_doc, out_score, out_open = [], [], [], []
        for row, terms in asked.items():
            total, missing = np.zeros(len(ids), np.int64), np.full(len(ids), sum(rest for _, _, rest in terms), np.int64)
            for term, weight, rest in terms:
                for docs, impacts in lists.get(term, ()):
                    total[docs] += weight * impacts
                    missing[docs] -= rest
            part = np.flatnonzero((total > 0) & (missing > 0))
            if len(part):
                out_row.append(row), out_doc.append(None), out_score.append(None), out_open.append(int((total + missing)[part].max()))
            chosen = np.flatnonzero((total > 0) & (total >= least.get(row, 0)))
            if len(chosen) > best:
                last = np.partition(total[chosen], len(chosen) - best)[len(chosen) - best]
                chosen = chosen[total[chosen] >= last]
                chosen = chosen[np.argsort(-total[chosen], kind="stable")[:best]]
            out_row += [row] * len(chosen)
            out_doc += [ids[i] for i in chosen.tolist()]
            out_score += total[chosen].tolist()
            out_open += [None] * len(chosen)
        kind = table.schema.field("ids").type.value_type
        give_back()
        return pa.table({"row": pa.array(out_row, pa.int64()), "doc": pa.array(out_doc, kind), "score": pa.array(out_score, pa.int64()), "open": pa.array(out_open, pa.int64())})

    kind = rows.schema["ids"].dataType.elementType.simpleString()
    return rows.groupBy("segment").applyInArrow(work, f"row bigint, doc {kind}, score bigint, open bigint")


def _answer(index: Index, questions: DataFrame, best: int) -> list[DataFrame]:
    """(row, rank, doc, score, tier) of a block of questions, tier by tier until each item is proven."""
    pairs = questions.select("row", "term", "weight", "rest").collect()  # a bounded block
    asked: dict[int, list] = defaultdict(list)
    for r in pairs:
        asked[r["row"]].append((r["term"], r["weight"], r["rest"]))
    spark, found, least = questions.sparkSession, [], {}
    in_order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    for tier in range(index.tiers):
        if not asked:
            break
        of_tier = {row: [(t, w, rest[tier]) for t, w, rest in terms] for row, terms in asked.items()}
        wanted = small(stored(spark.createDataFrame([(t,) for t in sorted({t for terms in of_tier.values() for t, _, _ in terms})], "term string"), "wanted-terms"))
        read = index.rows.where((F.col("tier") >= 0) & (F.col("tier") <= tier)).join(wanted, "term", "left_semi")
        ids = index.rows.where(F.col("tier") == -1)
        columns = ["segment", "tier", "term", "docs", "impacts", "ids"]
        scored = stored(_score(read.select(*columns).unionByName(ids.select(*columns)), of_tier, least, best), "scores")
        top = scored.where(F.col("open").isNull()).withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= best)
        top = stored(top.select("row", "rank", "doc", "score", F.lit(tier).alias("tier")), "best")
        bounds = scored.groupBy("row").agg(F.max("open").alias("open")).join(top.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("last")), "row", "left")
        facts = {r["row"]: r for r in bounds.collect()}  # a row an item of the block
        unproven = {}
        for row, terms in of_tier.items():
            fact = facts.get(row)
            last = fact["last"] if fact is not None and fact["n"] == best else 0
            rest = max(sum(rest for _, _, rest in terms), fact["open"] or 0 if fact is not None else 0)
            if rest and rest >= last:
                unproven[row], least[row] = asked[row], last
        proven = [row for row in of_tier if row not in unproven]
        if proven:
            names = small(stored(spark.createDataFrame([(r,) for r in proven], "row bigint"), "proven"))
            found.append(top.join(names, "row", "left_semi"))
        asked = unproven
    return found


def rank(
    docs: DataFrame, items: DataFrame, best: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", index: Index | None = None
) -> DataFrame:
    """The ``best`` documents of each item by score: (item_id, rank, doc_id, score, tier), all with a score if there are fewer.

    Equal scores stand in order of doc_id, null ids last; tier is the one whose postings proved the item's answer.
    Null and empty texts have no terms: such documents are not found, such items give no row. Rows of one
    id are documents, or items, of their own; empty tables give an empty one; other columns are ignored.
    """
    index = index or build_index(docs, doc_id, text)
    numbers = stored(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "items")
    questions = _questions(index, numbers, "text")
    blocks = max(1, -(-questions.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    kind = index.rows.schema["ids"].dataType.elementType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"row bigint, rank int, doc {kind}, score bigint, tier int")
    for number in range(blocks):
        for part in _answer(index, questions.where(block == number), best):
            found = found.unionByName(part)
    return found.join(small(numbers.select("row", "item_id")), "row").select(
        F.col("item_id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score", "tier"
    )
