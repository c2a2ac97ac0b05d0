"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps a fixed number of open windows. A piece goes to the open window that it fills
best; if none has room, the fullest window is emitted and a new one opened. Windows that are still open
at the end of a partition are merged, as whole windows, with those of other partitions, in rounds
that each join a bounded number of partitions, until one partition is left.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import SLICE_ROWS, in_arrow, map_column
from tidemark.llm.storage import stored

#: Open windows of each partition, and partitions whose left-over windows one task merges.
OPEN_WINDOWS, MERGED_PARTITIONS = 32, 16
#: Pieces, of ``capacity`` ids at most, that a task holds before it hands them on.
FLUSHED_PIECES = 500
#: Entries of a worker's cache of chunk encodings, and characters of the longest chunk kept there.
CACHE_CHUNKS, CACHE_CHARS = 600_000, 48
#: Marks after a chunk's letters that the tokenizer takes as one word.
_MARKS = ".,;:!?*$%&#|"
#: White space besides blank, tab and line ends, and what may be read as such: texts with it are encoded whole.
_ODD_BLANKS = [chr(c) for c in (*range(0x0B, 0x0D), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
#: Below this character letters have one form, and their lower case does not depend on what stands beside them.
_PLAIN_BELOW = "\u0250"

_loaded: dict[str, "ChunkEncoder"] = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level models have for each byte: itself if it is printable, else one above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class ChunkIds(dict):
    """Ids of chunks as bytes, made when they are first asked for."""

    def __init__(self, make: Callable[[str, "ChunkIds"], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        found = self.make(chunk, self)
        if len(chunk) <= CACHE_CHARS:
            self[chunk] = found
        return found


class ChunkEncoder:
    """Ids of whole texts, as little-endian 32-bit integers, from a tokenizer that drops white space.

    Such a tokenizer never joins what white space parts. Each distinct chunk between blanks is encoded
    once and remembered, and the ids of a text are those of its chunks in order. Letters with marks
    after them are two words to it, and plain letters go to its model in lower case without its other
    steps. A full cache, of about 100 MB, is emptied. Probes decide whether the tokenizer at hand is of
    that kind; if not, and for texts with odd white space, whole texts are encoded.
    """

    #: Blanks, marks, letters, digits and combining characters next to white space.
    PROBE = "It's  A\tprobe:\n'tis \u00e9 \u0301x 12 3.4\r\n\n\u00c9t\u00c9 ... a'b 's &amp; \u03a3\u03a3 \u4e2d\u6587 <|x|> #*$%& "
    #: Letters, with capitals and accents, and with marks after them.
    WORDS = "Words OF internationalization qxzvk \u00c9t\u00c9 stra\u00dfe \u0153uvre ma\u00f1ana, end. what?! a### B&&& c$%*"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.plain = False
        self.cache = ChunkIds(self._make)
        self.chunked = True
        self.chunked = self.encode([self.PROBE]) == self._whole([self.PROBE])
        self.plain = True
        words = self.WORDS.split()
        self.plain = [self._make(w, ChunkIds(self._make)) for w in words] == self._whole(words)
        self.forget()

    def forget(self) -> None:
        """Empties the caches."""
        self.cache = ChunkIds(self._make)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _make(self, chunk: str, known: ChunkIds) -> bytes:
        if self.plain and chunk.isascii() and chunk.isalpha():
            if not chunk.islower():
                return known[chunk.lower()]
            ids = [t.id for t in self.model.tokenize(chunk)]
            return struct.pack(f"<{len(ids)}I", *ids)
        core = chunk.rstrip(_MARKS) if self.plain else ""
        if not core.isalpha() or max(core) >= _PLAIN_BELOW:
            return self._whole([chunk])[0]
        lower = core.lower()
        if lower == chunk:
            ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, chunk.encode())))]
            return struct.pack(f"<{len(ids)}I", *ids)
        if not lower.isalpha() or max(lower) >= _PLAIN_BELOW:
            return self._whole([chunk])[0]
        return known[lower] + known[chunk[len(core) :]] if len(core) < len(chunk) else known[lower]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if not self.chunked or any(c in text for c in _ODD_BLANKS):
                out.append(self._whole([text])[0])
                continue
            if len(self.cache) > CACHE_CHUNKS:
                self.cache.clear()
            out.append(b"".join(map(self.cache.__getitem__, text.split())))
        return out


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of the tokenizer file at ``path``, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every document row: its tokens as little-endian 32-bit integers, then ``end_id``."""
    ids_of = _text_ids(tokenizer, end_id)

    def make(texts: list[str | None]) -> dict:
        return {"ids": pa.array(ids_of(texts), pa.binary())}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    return map_column(rows, ["doc_id"], F.col("body"), make, "ids binary")


class Windows:
    """The open windows of one task, by free room, so that the first with enough of it is the best fit."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit, self.open = capacity, limit, []  # (room, number, items), by room
        self.next = 0

    def place(self, size: int, item: object) -> tuple[int, int, list] | None:
        """Puts an item of ``size`` at most the capacity into a window; a window that this closes is returned."""
        best = next((i for i, w in enumerate(self.open) if w[0] >= size), None)
        closed = None
        if best is None:
            if len(self.open) >= self.limit:
                closed = self.open.pop(0)
            window = (self.capacity, self.next, [])
            self.next += 1
        else:
            window = self.open.pop(best)
        window[2].append(item)
        room = window[0] - size
        if room == 0:
            return (0, window[1], window[2]) if closed is None else self._both(closed, window)
        at = next((i for i, w in enumerate(self.open) if w[0] >= room), len(self.open))
        self.open.insert(at, (room, window[1], window[2]))
        return closed

    def _both(self, closed: tuple[int, int, list], full: tuple[int, int, list]) -> tuple[int, int, list]:
        self.open.insert(0, (0, full[1], full[2]))  # no room: it is the next to be emitted
        return closed


def _parts(batch: pa.RecordBatch, ids_of: Callable[[list], list[bytes]]) -> Iterator[tuple[object, bytes, int]]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        yield from zip(part.column(0).to_pylist(), ids_of(part.column(1).to_pylist()), part.column(2).to_pylist(), strict=True)


def _text_ids(tokenizer: str, end_id: int) -> Callable[[list[str | None]], list[bytes]]:
    """Ids of texts, null as empty, each followed by ``end_id``; the encoder is loaded where it is used."""
    last = np.array([end_id], "<u4").tobytes()
    return lambda texts: [x + last for x in encoder(tokenizer).encode([t or "" for t in texts])]


def _pack_partition(capacity: int, limit: int, id_bytes: bool, ids_of: Callable[[list], list[bytes]]):
    names = ["doc_id", "start", "length", "doc_tokens", "part", "window", "offset", "closed"] + ["ids"] * id_bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(capacity, limit)
        rows: list[tuple] = []
        kind, part = None, 0

        def emit(window: tuple[int, int, list], closed: bool) -> None:
            offset = 0
            for key, start, length, total, ids in window[2]:
                rows.append((key, start, length, total, part, window[1], offset, closed, ids))
                offset += length

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)][: len(names)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, ids, part in _parts(batch, ids_of):
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    piece = (key, start, length, total, ids[4 * start : 4 * (start + length)] if id_bytes else None)
                    done = windows.place(length, piece)
                    if done is not None:
                        emit(done, True)
                if len(rows) >= FLUSHED_PIECES:
                    yield flush()
        for window in windows.open:
            emit(window, window[0] == 0)
        if kind is not None and rows:
            yield flush()
        for used in _loaded.values():
            used.forget()

    return work, names


def _merge(capacity: int, limit: int, last: bool):
    """One round: whole left-over windows (part, window, used) of a group, packed again best-fit, the fullest first."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("used", "descending"), ("part", "ascending"), ("window", "ascending")])
        windows = Windows(capacity, limit)
        out: list[tuple] = []

        def emit(window: tuple[int, int, list], closed: bool) -> None:
            offset = 0
            for part, number, used in window[2]:
                out.append((part, number, group, window[1], offset, capacity - window[0], closed))
                offset += used

        for part, number, used in zip(*(table.column(c).to_pylist() for c in ("part", "window", "used")), strict=True):
            done = windows.place(used, (part, number, used))
            if done is not None:
                emit(done, True)
        for window in windows.open:
            emit(window, last or window[0] == 0)
        names = ["part", "window", "to_part", "to_window", "shift", "filled", "closed"]
        types = [pa.int64()] * 6 + [pa.bool_()]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return work


def pack(
    tokens: DataFrame,
    capacity: int = 4096,
    open_windows: int = OPEN_WINDOWS,
    merged_partitions: int = MERGED_PARTITIONS,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of tokenised documents (doc_id, ids) and where they lie: doc_id, start, length, doc_tokens,
    sequence_id, offset, and with ``keep_ids`` the piece's ids.

    A document longer than ``capacity`` is cut into full pieces and a rest; every id lies in exactly
    one piece, and a sequence's pieces leave no gap from 0. Repeated and null doc_ids are packed like any
    others; a row with null or no ids gives no piece; no rows give no sequences. Sequences are to be
    padded to ``capacity``, or left at their length where that is a power of two.

    A task holds ``open_windows`` windows. The rows of one partition are packed in their order, and the
    result is stored before its left-over windows are merged, so that a task that is run again
    cannot change what others have read. A merging task reads at most ``merged_partitions`` times
    ``open_windows`` window sizes, no ids.
    """
    rows = tokens.where(F.length("ids") >= 4).select("doc_id", F.col("ids").alias("value"))
    return _packed(rows, lambda ids: ids, capacity, open_windows, merged_partitions, keep_ids)


def pack_texts(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    open_windows: int = OPEN_WINDOWS,
    merged_partitions: int = MERGED_PARTITIONS,
    keep_ids: bool = True,
) -> DataFrame:
    """``pack`` of ``tokenize``, in one Python worker a task: the ids of texts go straight into windows.

    A null text is empty: its only id is ``end_id``. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("value"))
    return _packed(rows, _text_ids(tokenizer, end_id), capacity, open_windows, merged_partitions, keep_ids)


def _packed(
    rows: DataFrame, ids_of: Callable[[list], list[bytes]], capacity: int, open_windows: int, merged_partitions: int, keep_ids: bool
) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    work, _ = _pack_partition(capacity, open_windows, keep_ids, ids_of)
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, part bigint, `window` bigint, offset bigint, closed boolean"
    rows = rows.select("doc_id", "value", F.spark_partition_id().cast("long").alias("part"))
    pieces = stored(in_arrow(rows, work, schema + ", ids binary" * keep_ids), "pieces")

    open_ = pieces.where(~F.col("closed")).groupBy("part", "window").agg(F.sum("length").alias("used"))
    # what became of each first window: where it lies now, and how far in
    places = open_.select("part", "window", F.col("part").alias("at_part"), F.col("window").alias("at_window"), F.lit(0).cast("long").alias("at"), "used")
    places = stored(places, "open-windows")
    parts = (places.agg(F.max("part")).first()[0] or 0) + 1
    merged_schema = "part bigint, `window` bigint, to_part bigint, to_window bigint, shift bigint, filled bigint, closed boolean"
    level, done = 0, []
    while True:
        level += 1
        parts = -(-parts // merged_partitions)
        now = places.groupBy(F.col("at_part").alias("part"), F.col("at_window").alias("window")).agg(F.max("used").alias("used"))
        group = F.floor(F.col("part") / merged_partitions).cast("long")
        moved = (
            now.withColumn("group", group)
            .groupBy("group")
            .applyInArrow(_merge(capacity, open_windows, parts == 1), merged_schema)
            .withColumnsRenamed({"part": "old_part", "window": "old_window"})
        )
        joined = places.join(moved, (F.col("at_part") == F.col("old_part")) & (F.col("at_window") == F.col("old_window")))
        step = stored(
            joined.select(
                "part",
                "window",
                F.col("to_part").alias("at_part"),
                F.col("to_window").alias("at_window"),
                (F.col("at") + F.col("shift")).alias("at"),
                F.col("filled").alias("used"),
                "closed",
            ),
            f"merged-{level}",
        )
        done.append(step.where("closed").select("part", "window", _sequence(level, "at_part", "at_window").alias("seq"), "at"))
        places = step.where(~F.col("closed")).drop("closed")
        if parts == 1:
            break
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    ends = ends.withColumnsRenamed({"part": "end_part", "window": "end_window"})
    whole = pieces.where("closed").withColumns({"sequence_id": _sequence(0, "part", "window")}).drop("part", "window", "closed")
    rest = (
        pieces.where(~F.col("closed"))
        .join(ends, (F.col("part") == F.col("end_part")) & (F.col("window") == F.col("end_window")))
        .withColumns({"sequence_id": F.col("seq"), "offset": F.col("offset") + F.col("at")})
        .select(*whole.columns)
    )
    return whole.unionByName(rest)


def _sequence(level: int, part: str, window: str) -> Column:
    """A sequence's number: the round that closed it, then the task, then the window within that."""
    return F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft(F.col(part), 34) + F.col(window)
