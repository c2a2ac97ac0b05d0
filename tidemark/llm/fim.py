"""Fill-in-the-middle: texts are cut at two units and written with the middle last.

Where the cuts lie is found by a parallel automaton scan. A text of one chunk is scanned where it stands. Of a
longer one chunks go to any task, and each emits its function of states (see ``automata``); the functions of a block of
chunks are composed, then those of a text's blocks, which gives the number of units and the block, then the chunk,
in which each cut lies; only that chunk is looked into again. Of a giant text nothing but its
chunks' functions meets in one place, and of these at most ``BLOCK`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automata import LINES, Automaton, composed, entered, holding, side_by_side
from tidemark.llm.batches import in_arrow
from tidemark.llm.storage import small, stored

#: Characters of a chunk, and chunks whose functions are composed in one group.
CHUNK, BLOCK = 1 << 15, 1 << 10
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits that the id and the seed decide. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _targets(n: int, one: int, two: int) -> list[int]:
    return sorted((one % (n + 1), two % (n + 1)))


def _cut_whole(rows: DataFrame, units: Automaton, marks: Sequence[str]) -> DataFrame:
    """Texts of one chunk (doc_id, body, one, two) with n, marked and the two cuts."""
    both = side_by_side(units, holding(marks))
    inner = len(both.step) // len(units.step)

    def cut(text: str, one: int, two: int) -> tuple[int, bool, int, int]:
        to, counts = both.function(text)
        n = int(counts[0]) + both.last[to[0]]
        first, second = units.where(text, 0, _targets(n, one, two))
        return n, int(to[0]) % inner == inner - 1, first, second

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cut(t, a, b) for t, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            n, marked, first, second = zip(*made, strict=True) if made else ((),) * 4
            added = [pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *added], names=["doc_id", "body", "n", "marked", "first", "second"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, work, f"doc_id {kind}, body string, n bigint, marked boolean, first bigint, second bigint")


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Texts (key, one, two, body) as stored rows (key, one, two, chunk, piece), spread whatever text they are of."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, one, two, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                body = text.as_py()
                for at in range(0, len(body), 64 * chunk):
                    pieces = [body[i : i + chunk] for i in range(at, min(len(body), at + 64 * chunk), chunk)]
                    same = [pa.array([v.as_py()] * len(pieces), t) for v, t in ((key, pa.string()), (one, pa.int64()), (two, pa.int64()))]
                    yield pa.RecordBatch.from_arrays(
                        [*same, pa.array(range(at // chunk, at // chunk + len(pieces)), pa.int64()), pa.array(pieces, pa.string())],
                        names=["key", "one", "two", "chunk", "piece"],
                    )

    cut = in_arrow(rows.select("key", "one", "two", "body"), work, "key string, one bigint, two bigint, chunk bigint, piece string")
    return stored(cut.repartition("key", "chunk"), "chunks")


def _scanned(pieces: DataFrame, both: Automaton) -> DataFrame:
    """The function of every chunk: (key, one, two, chunk, chars, to, ends), stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).to_pylist()
            made = [both.function(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([len(t) for t in texts], pa.int64()), pa.array([m[0].tolist() for m in made], pa.list_(pa.int64())), pa.array([m[1].tolist() for m in made], pa.list_(pa.int64()))],
                names=["key", "one", "two", "chunk", "chars", "to", "ends"],
            )

    schema = "key string, one bigint, two bigint, chunk bigint, chars bigint, to array<bigint>, ends array<bigint>"
    return stored(in_arrow(pieces.select("key", "one", "two", "chunk", "piece"), work, schema), "chunk-functions")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups dealt over all cores: their rows are few bytes, which adaptive execution would put into one task."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _in_order(part: pd.DataFrame, by: str) -> tuple[pd.DataFrame, list]:
    part = part.sort_values(by)
    return part, list(zip(part["to"], part["ends"], strict=True))


def cut_chunks(pieces: DataFrame, units: Automaton = LINES, marks: Sequence[str] = MARKS, block: int = BLOCK) -> DataFrame:
    """(key, n, marked, first, second) of texts given as ``chunks``: units, whether a mark occurs, and the cuts in characters."""
    both = side_by_side(units, holding(marks))
    states = len(both.step)
    inner = states // len(units.step)
    scanned = _scanned(pieces, both).withColumn("block", F.floor(F.col("chunk") / block))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part, functions = _in_order(part, "chunk")
        to, ends = composed(functions, states)
        head = part.iloc[0]
        return pd.DataFrame([{"key": head["key"], "one": head["one"], "two": head["two"], "block": head["block"], "chars": part["chars"].sum(), "to": to, "ends": ends}])

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        part, functions = _in_order(part, "block")
        met, chars = entered(functions, 0), np.concatenate(([0], part["chars"].cumsum()))
        left, seen = met[-1]
        n, head = seen + both.last[left], part.iloc[0]
        out = []
        for which, wanted in enumerate(_targets(n, int(head["one"]), int(head["two"]))):
            row = {"key": head["key"], "n": n, "marked": left % inner == inner - 1, "which": which, "at": 0 if wanted == 0 else int(chars[-1])}
            if 0 < wanted <= seen:
                i = next(i for i in range(len(part)) if met[i + 1][1] >= wanted)
                row |= {"at": int(chars[i]), "block": int(part["block"].iloc[i]), "state": met[i][0], "wanted": wanted - met[i][1]}
            out.append(row)
        return pd.DataFrame(out, columns=["key", "n", "marked", "which", "at", "block", "state", "wanted"]).astype({c: "Int64" for c in ("block", "state", "wanted")})

    def narrow(part: pd.DataFrame) -> pd.DataFrame:
        part, functions = _in_order(part, "chunk")
        head = part.iloc[0]
        met = entered(functions, int(head["state"]))
        i = next(i for i in range(len(part)) if met[i + 1][1] >= head["wanted"])
        row = {"key": head["key"], "which": head["which"], "chunk": part["chunk"].iloc[i], "state": met[i][0], "wanted": head["wanted"] - met[i][1]}
        return pd.DataFrame([row | {"at": head["at"] + part["chars"].iloc[:i].sum()}])

    blocks = _spread(scanned, "key", "block").groupBy("key", "block").applyInPandas(fold, "key string, one bigint, two bigint, block bigint, chars bigint, to array<bigint>, ends array<bigint>")
    texts = stored(_spread(blocks, "key").groupBy("key").applyInPandas(resolve, "key string, n bigint, marked boolean, which int, at bigint, block bigint, state bigint, wanted bigint"), "text-functions")
    asked = texts.where(F.col("block").isNotNull()).select("key", "which", "at", "block", "state", "wanted")
    within = scanned.select("key", "block", "chunk", "chars", "to", "ends").join(small(asked), ["key", "block"])
    inside = stored(_spread(within, "key", "which").groupBy("key", "which").applyInPandas(narrow, "key string, which int, chunk bigint, state bigint, wanted bigint, at bigint"), "chunks-with-cuts")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.to_pydict()
            rows = zip(held["piece"], held["state"], held["wanted"], held["at"], strict=True)
            at = [before + units.where(text, state // inner, [wanted])[0] for text, state, wanted, before in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], names=["key", "which", "at"])

    chosen = pieces.select("key", "chunk", "piece").join(small(inside), ["key", "chunk"]).select("key", "which", "piece", "state", "wanted", "at")
    found = texts.where(F.col("block").isNull()).select("key", "which", "at").unionByName(in_arrow(chosen, look, "key string, which int, at bigint"))
    facts = texts.where(F.col("which") == 0).select("key", "n", "marked")
    cuts = found.groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("second"))
    return facts.join(cuts, "key")


def _cut_long(rows: DataFrame, units: Automaton, marks: Sequence[str], chunk: int) -> DataFrame:
    """``_cut_whole`` of longer texts. Rows of one id and one text have the same cuts."""
    key = F.concat(F.sha2(F.col("body").cast("binary"), 256), F.coalesce(F.concat(F.lit("/"), F.col("doc_id").cast("string")), F.lit("")))
    keyed = rows.withColumn("key", key)
    cuts = stored(cut_chunks(chunks(keyed.dropDuplicates(["key"]), chunk), units, marks), "cuts")
    return keyed.join(small(cuts), "key").select("doc_id", "body", "n", "marked", "first", "second")


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    units: Automaton = LINES,
    marks: Sequence[str] = MARKS,
    chunk: int = CHUNK,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document row: doc_id, n (its units), form, prefix_chars, middle_chars, output.

    Prefix and middle end after units that id and seed decide, and so is the form: of every hundred texts about
    ``rate`` are rearranged, of those about ``spm_rate`` with the suffix first. A text that is empty, null or holds
    a mark stays as it is (``plain``, null lengths), as ``restored`` could not undo it. Null ids count as
    empty, repeated rows give equal rows, an empty table an empty one; other columns are ignored.
    """
    one, two, three, four = draws(F.col("doc_id"), seed)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.select("doc_id", "body", one.alias("one"), two.alias("two"))
    long = F.length("body") > chunk
    cut = _cut_whole(rows.where(~long), units, marks).unionByName(_cut_long(rows.where(long), units, marks, chunk))
    body, first, second = F.col("body"), F.col("first").cast("int"), F.col("second").cast("int")
    form = F.when((body == "") | F.col("marked") | (three % 100 >= rate), "plain").when(four % 100 < spm_rate, "spm").otherwise("psm")
    prefix, middle, suffix = body.substr(F.lit(1), first), body.substr(first + 1, second - first), body.substr(second + 1, F.length(body))
    p, s, m = map(F.lit, marks)
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.col("first")).alias("prefix_chars"),
        F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(~moved, body).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle)).alias("output"),
    )


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output of ``fill_in_middle`` was made of."""
    p, s, m = marks
    parts = F.split(output, "|".join(rf"\Q{mark}\E" for mark in (p, s, m)), -1)
    psm, spm = (F.concat(*(F.get(parts, i) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
