"""Benchmark decontamination: a positional inverted index over the corpus and exact phrase search.

The index stores a posting (term, document, position) for every word of the corpus, and one without a
term per document row, whose position is the document's length. Terms are 64-bit hashes of words.
A phrase is looked up from its rarest terms: the posting lists of its rarest and second rarest term are
shifted by the terms' offsets and intersected, and the lists of all its other terms, as far as they
lie where something is left, are intersected with that. Nothing but this decides what matches.

Everything is DataFrame functions. Postings are spread by document, never gathered by term, so a
term or passage that a third of the corpus holds makes no hot task; what test items contribute is
broadcast only when it has been counted small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import fresh
from tidemark.llm.storage import small, stored
from tidemark.llm.words import ascii_lower, cased_words, once, word_array

#: Where a posting lies; rows of one id and one text are the same document.
_PLACE = ["doc", "mark", "pos", "term"]


def phrases(items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The windows of ``window`` consecutive words of each item: (item, words), each once.

    An item of fewer words, but not none, is one window; null and empty texts have none.
    """
    words = F.col("words")
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))
    return (
        items.select(F.col(item_id).alias("item"), word_array(F.col(text)).alias("words"))
        .where(n > 0)
        .withColumn("words", F.explode(F.transform(starts, lambda i: F.slice(words, i, window))))
        .distinct()
    )


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all words: (doc, mark, term, pos); mark is a hash of the text.

    Each document row also has the posting (null, its number of words), so empty and null texts are in
    the index too. The index is made in one pass and does not depend on what is searched for.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc"), once(F.xxhash64(text)).alias("mark"), F.concat(cased_words(F.col(text)), F.array(F.lit(""))).alias("words")
    )
    rows = rows.select("doc", "mark", F.posexplode("words").alias("pos", "word"))
    term = F.when(F.col("word") != "", F.xxhash64(ascii_lower(F.col("word"))))
    return stored(rows.select("doc", "mark", term.alias("term"), "pos"), "postings")


def ranked_phrases(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored phrases (phrase, item, n, ranked) of ``wanted`` (item, words): ranked is an array of (df, offset,
    term), the terms that are rarest in the corpus first."""
    numbered = stored(wanted.select("item", "words", F.monotonically_increasing_id().alias("phrase")), "windows")
    each = numbered.select("phrase", "item", F.posexplode("words").alias("offset", "word")).withColumn("term", F.xxhash64("word"))
    terms = stored(each.select("term").distinct(), "item-terms")
    held = index.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    counts = stored(terms.join(held, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")), "term-counts")
    ranked = each.join(small(counts), "term").groupBy("phrase", "item").agg(F.sort_array(F.collect_list(F.struct("df", "offset", "term"))).alias("ranked"))
    return stored(ranked.withColumn("n", F.size("ranked")), "ranked")


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, Column]:
    """``b`` with its columns renamed, and the condition that ``on`` are equal, nulls too."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in on})
    met = F.lit(True)
    for c in on:
        met = met & a[c].eqNullSafe(b[f"_{c}"])
    return b, met


def _met(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    b, met = _same(a, b.select(*on), on)
    return a.join(small(b) if how == "left_semi" else b, met, how)


def _candidates(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Where the two rarest terms of a phrase of two words or more stand as in it: (doc, mark, phrase, start), stored.

    Windows of one passage mostly share these two terms and their distance, so lists are met by such
    pairs, not by phrases. Both lists of a pair come from one scan and are combined before the shuffle.
    """
    first, second = F.col("ranked")[0], F.col("ranked")[1]
    asked = ranked.where(F.col("n") > 1).select(
        "phrase",
        first["offset"].alias("offset"),
        F.struct(first["term"].alias("one"), second["term"].alias("two"), (second["offset"] - first["offset"]).alias("apart")).alias("pair"),
    )
    numbers = stored(asked.select("pair").distinct().withColumn("number", F.monotonically_increasing_id()), "pairs")
    one = F.struct(F.col("pair.one").alias("term"), F.lit(0).alias("shift"), F.lit(1).alias("side"))
    two = F.struct(F.col("pair.two").alias("term"), F.col("pair.apart").alias("shift"), F.lit(2).alias("side"))
    lists = stored(numbers.select("number", F.inline(F.array(one, two))), "lists")
    anchors = (
        index.join(small(lists), "term")
        .groupBy("doc", "mark", "number", (F.col("pos") - F.col("shift")).alias("at"))
        .agg(F.bit_or("side").alias("sides"))
        .where(F.col("sides") == 3)
    )
    places = stored(asked.join(numbers, "pair").select("number", "phrase", "offset"), "pair-phrases")
    start = F.col("at") - F.col("offset")
    return stored(anchors.join(small(places), "number").where(start >= 0).select("doc", "mark", "phrase", start.alias("start")), "candidates")


def find_phrases(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every exact occurrence of a phrase of ``ranked_phrases``: (doc, mark, item, start, n), each once."""
    alone = stored(ranked.where(F.col("n") == 1).select("phrase", F.col("ranked")[0]["term"].alias("term")), "single-words")
    single = index.join(small(alone), "term").select("doc", "mark", "phrase", F.col("pos").alias("start"))
    left = _candidates(index, ranked)
    others = stored(ranked.where(F.col("n") > 2).select("phrase", F.inline(F.slice("ranked", 3, F.col("n")))).drop("df"), "other-terms")
    wanted = left.join(small(others), "phrase").select("doc", "mark", "phrase", "start", (F.col("start") + F.col("offset")).alias("pos"), "term")
    places = stored(wanted.select(*_PLACE).distinct(), "wanted-places")
    marks = stored(left.select("mark").distinct(), "candidate-marks")
    held = stored(_met(index.join(small(marks), "mark", "left_semi"), places, _PLACE, "left_semi").select(*_PLACE).distinct(), "held-places")
    absent = stored(_met(places, held, _PLACE, "left_anti"), "absent-places")
    broken = _met(wanted, absent, _PLACE, "left_semi").select("doc", "mark", "phrase", "start").distinct()
    whole = _met(left, broken, ["doc", "mark", "phrase", "start"], "left_anti")
    names = small(stored(ranked.select("phrase", "item", "n"), "phrase-names"))
    return whole.unionByName(single).join(names, "phrase").select("doc", "mark", "item", "start", "n").distinct()


def find_near(index: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """Proximity matches: (doc, mark, phrase, item, pos), an occurrence ``pos`` of the phrase's rarest term in some
    span of at most its length plus ``slop`` words that holds all words of the phrase, in any order; a
    word that the phrase has twice must be there twice.

    The lists of the rarest and of the next rarest different term are met in blocks of a span's length;
    the other lists are read only around what is left, at most two spans about each occurrence, which takes up to
    three blocks of the longest span. An occurrence carries no words of its phrase, and no side of a join whose rows
    have become more than its files tell is broadcast.
    """
    terms = F.array_distinct(F.transform("ranked", lambda r: r["term"]))
    needs = F.transform(terms, lambda t: F.struct(t.alias("term"), F.size(F.filter("ranked", lambda r: r["term"] == t)).alias("times")))
    asked = stored(ranked.select("phrase", "item", (F.col("n") + slop).alias("span"), needs.alias("needs")), "near-phrases")
    width = asked.agg(F.max("span")).first()[0] or 1
    rare = asked.select("phrase", "item", "span", (F.size("needs") > 1).alias("more"), F.col("needs")[0]["term"].alias("term"))
    anchors = index.join(small(stored(rare, "near-rarest")), "term").select("doc", "mark", "phrase", "item", "span", "more", "pos")
    second = stored(asked.where(F.size("needs") > 1).select("phrase", "span", F.col("needs")[1]["term"].alias("term")), "near-second")
    block = F.floor(F.col("pos") / F.col("span"))
    beside = index.join(small(second), "term").select("doc", "mark", "phrase", F.explode(F.sequence(block - 1, block + 1)).alias("block")).distinct()
    pairs = anchors.where("more").withColumn("block", block)
    pairs = _met_far(pairs, beside, ["doc", "mark", "phrase", "block"]).drop("block")
    anchors = stored(pairs.unionByName(anchors.where(~F.col("more"))).drop("more").distinct(), "near-anchors")
    first, last = F.greatest(F.lit(0), F.col("pos") - F.col("span") + 1), F.col("pos") + F.col("span") - 1
    blocks = F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))
    wanted = anchors.select("doc", "mark", "phrase", "item", "span", F.col("pos").alias("anchor"), blocks.alias("block"))
    marks = stored(anchors.select("mark").distinct(), "near-marks")
    words = stored(asked.select("phrase", F.explode("needs.term").alias("term")), "near-words")
    kinds = stored(words.select("term").distinct(), "near-terms")
    around = index.join(small(marks), "mark", "left_semi").join(small(kinds), "term", "left_semi").select(*_PLACE).distinct()
    around, met = _same(wanted, around.withColumn("block", F.floor(F.col("pos") / width)), ["doc", "mark", "block"])
    inside = F.abs(F.col("pos") - F.col("anchor")) < F.col("span")
    seen = wanted.hint("merge").join(around, met).where(inside).join(small(words), ["phrase", "term"])
    seen = seen.groupBy("doc", "mark", "phrase", "item", "span", F.col("anchor")).agg(F.collect_set(F.struct("pos", "term")).alias("seen"))
    full = seen.withColumnRenamed("anchor", "pos").join(small(stored(asked.select("phrase", "needs"), "near-needs")), "phrase")

    def holds(first: Column) -> Column:
        def enough(need: Column) -> Column:
            here = F.filter("seen", lambda s: (s["term"] == need["term"]) & (s["pos"] >= first) & (s["pos"] < first + F.col("span")))
            return F.size(here) >= need["times"]

        return F.forall("needs", enough)

    firsts = F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("span") + 1), F.col("pos"))
    return full.where(F.exists(firsts, holds)).select("doc", "mark", "phrase", "item", "pos").distinct()


def _met_far(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` that ``b``, of any size, has the ``on`` of."""
    b, met = _same(a, b.select(*on), on)
    return a.join(b, met, "left_semi")


def _covered(spans: Column) -> Column:
    """How many positions the sorted spans (start, n) cover together."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["n"]
        fresh = F.greatest(F.lit(0), end - F.greatest(span["start"], state["upto"]))
        return F.struct(F.greatest(state["upto"], end).alias("upto"), (state["total"] + fresh).alias("total"))

    return F.aggregate(spans, start, add, lambda state: state["total"])


def _search(docs: DataFrame, items: DataFrame, window: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(index, occurrences) of all windows of the items in the whole corpus."""
    index = build_index(docs, doc_id, text)
    return index, find_phrases(index, ranked_phrases(index, phrases(items, window)))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items (sorted ids as text), contaminated.

    A document word inside any occurrence of a window of ``window`` consecutive item words is hit; an
    item of fewer words is one window. Null and empty texts have no words and no hits, on either
    side; rows with a null or a repeated id are judged each by its own text; equal rows give equal
    rows; an empty table of items leaves every document clean; other columns are ignored.
    """
    index, found = _search(docs, items, window, doc_id, text)
    hits = found.select(
        "doc",
        "mark",
        F.struct("start", "n").alias("span"),
        F.col("item").cast("string").alias("item"),
        F.lit(None).cast("long").alias("n_words"),
    )
    lengths = index.where(F.col("term").isNull()).select(
        "doc",
        "mark",
        F.lit(None).cast("struct<start:int,n:int>").alias("span"),
        F.lit(None).cast("string").alias("item"),
        F.col("pos").cast("long").alias("n_words"),
    )
    judged = lengths.unionByName(hits).groupBy("doc", "mark").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").cast("int").alias("copies"),
        _covered(F.sort_array(F.collect_set("span"))).alias("n_hit"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    return judged.select(
        F.explode(F.array_repeat(F.col("doc"), F.col("copies"))).alias(doc_id),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def near_items(
    docs: DataFrame, items: DataFrame, slop: int = 2, window: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n): in how many places a document has all words of some window of an item near together.

    A place is an occurrence of the window's rarest word that ``find_near`` finds; documents without any give
    no row. Rows of one id are counted by their different texts together; other columns are ignored.
    """
    index = build_index(docs, doc_id, text)
    found = find_near(index, ranked_phrases(index, phrases(items, window)), slop)
    return found.select("doc", "mark", "item", "pos").distinct().groupBy(F.col("doc").alias(doc_id), F.col("item").alias("item_id")).agg(F.count("*").alias("n"))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows in whose text no window of an item occurs, with all their columns, whatever their names; null texts stay."""
    _, found = _search(docs, items, window, doc_id, text)
    doc, mark = fresh(docs.columns, "hit_doc"), fresh(docs.columns, "hit_mark")
    hit = stored(found.select(F.col("doc").alias(doc), F.col("mark").alias(mark)).distinct(), "contaminated")
    same = docs[doc_id].eqNullSafe(hit[doc]) & (F.xxhash64(docs[text]) == hit[mark])
    return docs.join(small(hit), same, "left_anti")
