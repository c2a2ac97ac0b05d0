"""Language identification by rank order: the most frequent n-grams of a text against each language's.

A profile is the list of a language's most frequent character n-grams, in order of frequency. A
text's own list is compared with each: every n-gram adds how far out of place it is, or the
greatest distance where the profile lacks it; the language with the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import map_column
from tidemark.llm.storage import stored

#: n-grams of one to three characters; so many make a profile.
LONGEST, RANKS = 3, 400
#: At most about so many documents of each language are learnt from; of a language with fewer, all.
SAMPLE_DOCS = 2_000
#: Characters of a text that are counted at one time, and counts that a task holds before it hands them on.
PIECE, HELD_COUNTS = 1 << 20, 1 << 20
#: Parts of a language's n-grams that are ranked apart before the best of all are.
PARTS = 64

#: Languages at most; a column of more different values names no languages.
MAX_LANGS = 10_000

_BITS, _BLANK = 21, 32  # of a code point; the code of a space


def _pieces(text: str, piece: int) -> Iterator[np.ndarray]:
    """The n-grams of a text, lower-cased letters with one space for all between words, piece by piece.

    What the next n-grams begin with, two codes at most, is carried over the edge of a piece, and so is an
    open space, so a piece's length changes nothing. The whole text is lower-cased at once.
    """
    held = np.array([_BLANK], np.int64)
    text = text.lower()
    for at in range(0, len(text) + 1, piece):
        part = text[at : at + piece] + (" " if at + piece > len(text) else "")
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letters = np.array([c for c in np.unique(codes).tolist() if chr(c).isalpha()], np.int64)
        near = np.searchsorted(letters, codes).clip(max=max(len(letters) - 1, 0))
        codes = np.where(letters[near] == codes, codes, _BLANK) if len(letters) else np.full_like(codes, _BLANK)
        blank = codes == _BLANK
        codes = codes[~(blank & np.concatenate(([held[-1] == _BLANK], blank[:-1])))]
        run, out = np.concatenate([held, codes]), []
        wide, carried = run, len(held)
        for n in range(1, LONGEST + 1):
            if n > 1:
                wide = (wide[:-1] << _BITS) | run[n - 1 :]
            out.append(wide[max(0, carried - n + 1) :])
        joined = np.concatenate(out)
        yield joined[joined != _BLANK]
        held = run[-(LONGEST - 1) :]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as sorted integers."""
    return np.sort(np.concatenate(list(_pieces(text, PIECE))))


def counted(text: str, piece: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text and how often it has each; a long text's are counted piece by piece."""
    parts = [_counted(np.sort(found)) for found in _pieces(text, piece or PIECE)]
    return parts[0] if len(parts) == 1 else _summed(parts)


def ranked(text: str, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, most frequent first; of equally frequent ones the smaller integer."""
    return _top(*counted(text), ranks)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys)))


def _top(keys: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    return keys[np.argsort(-counts, kind="stable")[:ranks]]


@dataclass(frozen=True)
class Profiles:
    """The languages, every n-gram of their profiles in order, and its rank in each (``ranks``: absent)."""

    langs: list[str]
    keys: np.ndarray
    places: np.ndarray
    ranks: int

    def guess(self, text: str | None) -> tuple[str, float]:
        """(language, score). ``und`` and 0 for null, for a text without letters, or if nothing was learnt."""
        if not text or not self.langs:
            return "und", 0.0
        own = ranked(text, self.ranks)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.keys, own).clip(max=len(self.keys) - 1)
        known = self.keys[at] == own
        distance = np.full((len(own), len(self.langs)), self.ranks)
        held = self.places[at[known]]
        moved = np.abs(held - np.flatnonzero(known)[:, None])
        distance[known] = np.where(held == self.ranks, self.ranks, moved)
        sums = distance.sum(0)
        best = int(np.argmin(sums))
        return self.langs[best], 1.0 - float(sums[best]) / (self.ranks * len(own))


def id_remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(
    docs: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    ranks: int = RANKS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Profiles:
    """Profiles of the languages that ``lang`` names, from rows whose id has no remainder 2 of 4.

    Learnt from is a sample, about ``sample_docs`` documents of each language, chosen by a hash of the
    id; rows with null id, text or language are left out. Every language gets a profile; a column of more
    than ``MAX_LANGS`` different values raises ValueError, as the profiles are held by the driver and every task.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & (id_remainder(F.col("id")) != 2)
    )
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if sizes.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} different values of {lang!r}")
    share = sizes.select("lang", F.least(F.lit(1.0), sample_docs / F.col("n")).alias("share"))
    chosen = (
        rows.where(F.col("body").isNotNull())
        .join(F.broadcast(share), "lang")  # at most MAX_LANGS rows
        .where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
        .select("lang", "body")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def summed() -> Iterator[pd.DataFrame]:
            for name, parts in held.items():
                keys, counts = _summed(parts)
                yield pd.DataFrame({"lang": name, "gram": keys, "n": counts})

        for batch in batches:
            for name, text in zip(batch["lang"], batch["body"], strict=True):
                held.setdefault(name, []).append(counted(text))
                size += len(held[name][-1][0])
                if size > HELD_COUNTS:
                    yield from summed()
                    held, size = {}, 0
        yield from summed()

    grams_of = chosen.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).orderBy(*order)
    best = Window.partitionBy("lang").orderBy(*order)  # of ``ranks`` n-grams of each part
    top = (
        grams_of.withColumn("place", F.row_number().over(part))
        .where(F.col("place") <= ranks)
        .withColumn("place", F.row_number().over(best) - 1)
        .where(F.col("place") < ranks)
        .select("lang", "gram", "place")
        .toPandas()  # ``ranks`` rows a language
    )
    if not len(top):
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), ranks)
    langs = sorted(top["lang"].unique())
    keys = np.unique(top["gram"].to_numpy(np.int64))
    places = np.full((len(keys), len(langs)), ranks, np.int64)
    column = {name: i for i, name in enumerate(langs)}
    places[np.searchsorted(keys, top["gram"].to_numpy()), top["lang"].map(column).to_numpy(int)] = top["place"].to_numpy()
    return Profiles(langs, keys, places, ranks)


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score (1: every n-gram in its place).

    held_out is true where crc32 of the id modulo 4 is 2, and false for a null id. Null texts and texts
    without a letter are ``und`` with score 0; of equally near languages the first by name wins. Other
    columns are ignored.
    """

    def make(texts: list[str | None]) -> dict:
        said = [profiles.guess(t) for t in texts]
        return {"lang_pred": pa.array([s[0] for s in said], pa.string()), "score": pa.array([s[1] for s in said], pa.float64())}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    found = map_column(rows, ["doc_id"], F.col("body"), make, "lang_pred string, score double")
    held = F.coalesce(id_remainder(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
