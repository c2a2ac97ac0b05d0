"""The automaton scan and fill-in-the-middle against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import automata, fim

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = LINE.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    one, two = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:one], units[one:two], units[two:]))
    if not text or any(k in text for k in fim.MARKS) or c % 100 >= rate:
        return n, "plain", None, None, text
    if d % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts(seed, many):
    dice = random.Random(seed)
    parts = ["\n", "a", "é😀", "<", "P", ">", "<P", "<S>", "line of words\n", "\r", "<<M", "x" * 30, "\n\n"]
    return ["".join(dice.choices(parts, k=dice.randrange(60))) for _ in range(many)]


def test_a_function_does_what_the_characters_do_one_by_one():
    both = automata.side_by_side(automata.LINES, automata.holding(fim.MARKS))
    for text in some_texts(1, 200):
        to, ends = both.function(text)
        for state in range(len(both.step)):
            at, seen = state, 0
            for c in text:
                of = both.classes.get(c, 0)
                seen, at = seen + both.ends[at][of], both.step[at][of]
            assert (to[state], ends[state]) == (at, seen)


def test_functions_of_any_cut_compose_to_that_of_the_whole():
    both = automata.side_by_side(automata.LINES, automata.holding(fim.MARKS))
    dice = random.Random(2)
    for text in some_texts(3, 100):
        cuts = sorted(dice.choices(range(len(text) + 1), k=5))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        to, ends = automata.composed([both.function(p) for p in parts], len(both.step))
        whole = both.function(text)
        assert to.tolist() == whole[0].tolist() and ends.tolist() == whole[1].tolist()
        inner = len(both.step) // 2
        assert (to[0] % inner == inner - 1) == any(m in text for m in fim.MARKS)
        assert ends[0] + both.last[to[0]] == len(LINE.findall(text))


def test_units_end_where_the_pattern_says():
    for text in some_texts(4, 100):
        units = LINE.findall(text)
        wanted = list(range(len(units) + 1))
        assert automata.LINES.where(text, 0, wanted) == [len("".join(units[:k])) for k in wanted]
    assert automata.WORDS.where("two words", 0, [1, 2]) == [4, 9]


@pytest.mark.parametrize("chunk", [3, 7, 1 << 15])
def test_every_chunk_size_gives_what_plain_python_gives(spark, chunk):
    texts = some_texts(5, 60) + ["", None, "\n", "one line", "<P>", "a<S" + ">", "\n" * 50]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id\nhere", None), (3, texts[3], "repeated"), (3, "another\ntext of an id\n", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string")
    found = fim.fill_in_middle(docs, chunk=chunk).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in found)
    want = []
    for doc_id, text, _ in rows:
        n, form, p, m, output = brute(doc_id, text)
        want.append((str(doc_id), n, form, str(p), str(m), output))
    assert got == sorted(want)
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t, _ in rows)


def test_blocks_of_chunks_are_composed(spark):
    text = "".join(f"line {i}\n" for i in range(400)) + "<M" + ">" + "no end"
    row = spark.createDataFrame([("k", 100, 250, text), ("l", 0, 401, text[:-1]), ("m", 5, 7, "x" * 1000)], "key string, one bigint, two bigint, body string")
    found = {r["key"]: r for r in fim.cut_chunks(fim.chunks(row, 11), block=4).collect()}
    places = [len("".join(LINE.findall(text)[:k])) for k in range(402)]
    assert (found["k"]["n"], found["k"]["marked"], found["k"]["first"], found["k"]["second"]) == (401, True, places[100], places[250])
    assert (found["l"]["first"], found["l"]["second"]) == (0, len(text) - 1)
    assert (found["m"]["n"], found["m"]["marked"], found["m"]["first"], found["m"]["second"]) == (1, False, 1000, 1000)


def test_rates_and_units(spark):
    docs = spark.createDataFrame([(i, f"some words of number {i}") for i in range(300)], "doc_id bigint, text string")
    forms = {r["form"]: r["count"] for r in fim.fill_in_middle(docs, rate=50, spm_rate=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 100 < forms["psm"] < 200
    assert {r["n"] for r in fim.fill_in_middle(docs, units=automata.WORDS).collect()} == {5}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
