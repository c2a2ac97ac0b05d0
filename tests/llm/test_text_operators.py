"""Operators that judge rows one by one, against brute force and on awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import boosting, chat, decontam, docstats, html_text, langid, packing, quality, urls, warc

DOCS = "doc_id bigint, text string, lang string, source string, `n_words` string, score string"


def docs(spark, *texts):
    rows = [(i, t, "en", "s", "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id here", None, None, None, None)]
    return spark.createDataFrame([*rows, rows[0]], DOCS)


# ---- URL filters ----
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
URLS = {
    "http://a.com/x": ("com/", "allow"),
    "http://a.com": (None, "allow"),
    "HTTP://EXAMPLE.com/en/1?q#f": ("example.com/en/", "block"),
    "http://notexample.com/en/1": ("com/", "allow"),
    "x://www.example.com/en/": ("www.example.com/en/", "allow"),
    "http://b.www.example.com/en/z": ("www.example.com/en/", "allow"),
    "https://q.net/es/a": ("net/es/", "block"),
    "https://q.net/ES/a": (None, "allow"),
    "no scheme": (None, "allow"),
    "": (None, "allow"),
    None: (None, "allow"),
}


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, "http://a.com/x"])], "page_id int, url string, rule string")
    found = urls.filter_urls(rows, urls.rule_table(spark, RULES)).collect()
    assert len(found) == len(URLS) + 1
    assert {r["url"]: (r["rule"], r["verdict"]) for r in found} == URLS
    by_url = {r["url"]: r for r in found}
    assert (by_url["no scheme"]["host"], by_url["no scheme"]["path"]) == ("", "")
    assert by_url["HTTP://EXAMPLE.com/en/1?q#f"]["host"] == "example.com" and by_url["HTTP://EXAMPLE.com/en/1?q#f"]["path"] == "/en/1"
    assert urls.filter_urls(rows.limit(0), urls.rule_table(spark, RULES)).count() == 0
    assert urls.filter_urls(rows, urls.rule_table(spark, [(None, None, "block")])).where("rule is not null").count() == 0


# ---- decontamination ----
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, n=10):
    w = words(text)
    hit, held = set(), set()
    for item, it in items:
        iw = words(it)
        size = min(n, len(iw))
        for a in range(max(0, len(iw) - size + 1) if size else 0):
            for b in range(len(w) - size + 1):
                if w[b : b + size] == iw[a : a + size]:
                    hit.update(range(b, b + size))
                    held.add(item)
    return len(w), len(hit), sorted(map(str, held))


def test_decontamination_is_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"W{i}" if i % 3 else f"é{i}" for i in range(30)]
    line = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, line(14)), (2, line(11)), (3, "Short One"), (4, ""), (5, None), (22, line(10)), (6, "same same same")]
    texts = [line(60) + "; " + items[i % 2][1].upper() + "! " + line(20) for i in range(6)]
    texts += [items[0][1] + " " + items[0][1], "short, ONE short one", "", None, items[5][1] + " x " + items[1][1], line(9), "Same same SAME same", line(3000)]
    table = docs(spark, *texts)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id int, text string, doc_id string")
    found = decontam.decontaminate(table, bench).collect()
    assert len(found) == len(texts) + 2
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found}
    for i, text in enumerate(texts):
        assert got[i] == brute_hits(text, items), i
    assert Counter(r["doc_id"] for r in found)[0] == 2
    kept = decontam.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["contaminated"]}
    assert decontam.decontaminate(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(table.limit(0), bench).count() == 0


def brute_near(text, item, slop, n=10):
    """Places of the item's windows: (window, position of the rarest word), for words with a given rarity."""
    w, iw = words(text), words(item)
    size = min(n, len(iw))
    found = set()
    for window in {tuple(iw[a : a + size]) for a in range(max(0, len(iw) - size + 1) if size else 0)}:
        span = size + slop
        for s in range(1 - span, len(w)):
            lo, hi = max(0, s), s + span
            if not Counter(window) - Counter(w[lo:hi]):
                found.add((window, lo, hi))
    return found


def test_proximity(spark):
    rng = np.random.default_rng(3)
    line = lambda n: " ".join(rng.choice([f"w{i}" for i in range(12)], n))
    items = [(1, "alpha beta gamma"), (2, line(6)), (3, "same other same"), (4, line(4)), (5, "lone"), (6, ""), (7, None)]
    texts = ["alpha x beta y gamma", "gamma beta alpha", "alpha beta", "alpha a b c d e f g h beta gamma", "same other", "same x other same", "other same same lone lone", "", None]
    texts += [line(80) for _ in range(12)]
    table = docs(spark, *texts)
    bench = spark.createDataFrame(items, "item_id int, text string")
    for window, slop in ((10, 2), (3, 1), (4, 0)):
        counts = Counter(x for t in texts + ["no id here", texts[0]] for x in words(t))
        want = Counter()
        for i, text in enumerate(texts):
            w = words(text)
            for item, it in items:
                places = set()
                for win, lo, hi in brute_near(text, it, slop, window):
                    rare = min(counts[x] for x in win)
                    places |= {p for p in range(lo, min(hi, len(w))) if w[p] in win and counts[w[p]] == rare}
                if places:
                    want[i, item] = len(places)
        got = {(r["doc_id"], r["item_id"]): r["n"] for r in decontam.near_items(table, bench, slop, window).collect()}
        assert set(got) == set(want)
        assert all(got[k] <= want[k] for k in got)  # of equally rare words one is looked up
    assert decontam.near_items(table.limit(0), bench).count() == decontam.near_items(table, bench.limit(0)).count() == 0


def test_the_intersection_decides(spark, monkeypatch):
    """Without the lists of the other terms, what shares the two rarest would be taken for a match."""
    table = docs(spark, "a b c d e f g h i j", "a b c x e f g h i j", "d d d d")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id int, text string")
    assert {r["doc_id"] for r in decontam.decontaminate(table, bench).where("contaminated").collect()} == {0}
    monkeypatch.setattr(decontam, "_met", lambda a, b, on, how: a if how == "left_anti" else a.limit(0))
    assert {r["doc_id"] for r in decontam.decontaminate(table, bench).where("contaminated").collect()} > {0}


# ---- statistics, trees, quality ----
def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


TEXTS = [
    "a b c a b c", "x " * 50, "one\ntwo\n\none\n  \none ", "É|ñ <b>#1</b>\x0bq\x85r", "", None, "a b", "a b a b a", "\n\n", "w" * 100_000 + " " + "long text " * 20_000, "中文 字 中文 字 中文",
]


def test_counts_are_brute_force():
    for text in TEXTS:
        assert docstats.measure(None if text is None else text.encode())[0] == brute_counts(text)


def test_large_vocabularies_do_not_overflow():
    ids = np.array([5, 6, 7, 5, 6, 7, 1])
    triples = docstats._window_ids_by_steps(ids, 3_000_000_000)
    assert triples[0] == triples[3] and len(set(triples.tolist())) == 4


def test_trees_learn_and_keep_order():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.6) | (x[:, 1] > 0.8)).astype(int)
    model = boosting.fit(x, y, trees=40)
    assert ((model.score(x) > 0.5) == y).mean() > 0.98
    bound = boosting.fit(x, (rng.random(3000) < 0.5 - 0.3 * np.sin(9 * x[:, 2])).astype(int), trees=40, monotone={2: -1})
    grid = np.tile(rng.random(3), (200, 1))
    grid[:, 2] = np.linspace(0, 1, 200)
    assert (np.diff(bound.score(grid)) <= 1e-12).all()
    for labels in ([], [1, 1, 1]):
        flat = boosting.fit(np.zeros((len(labels), 3)), np.array(labels))
        assert len(set(flat.score(x).tolist())) == 1


def walk(model, x):
    """A forest's score of one row, node by node."""
    total = model.base
    for root in model.roots.tolist():
        at = root
        while model.left[at] != at:
            at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
        total += model.value[at]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_scores_and_verdicts_are_brute_force(spark):
    from conftest import DATA

    read = lambda name: spark.read.parquet(f"{DATA.parent}/sf0.01/{name}.parquet")
    table, labels = read("documents"), read("labels")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    x = {i: docstats.measure(None if t is None else t.encode()) for i, t in texts.items()}
    model = quality.learn(table, labels)
    for r in quality.classify(table, model).collect():
        score = walk(model, x[r["doc_id"]][1])
        assert abs(r["score"] - score) < 1e-12 and r["predicted"] == (score >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    model = quality.learn(table, labels, monotone=quality.constraints())
    for r in quality.apply_rules(table, model).collect():
        n = brute_counts(texts[r["doc_id"]])
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert [r[c] for c in docstats.COUNTS] == n and r["base_failed"] == failed
        assert r["kept"] == (not failed and walk(model, x[r["doc_id"]][1]) >= 0.3)


def test_base_counts_match_sql(spark):
    """The counts of op7 that SQL can express, over the whole table."""
    from conftest import DATA
    from oracle import connect, rows_of

    from tidemark.llm import queries

    folder = DATA.parent / "sf0.01"
    sql = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM
            (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
        l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
               coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
        FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)"""
    found = connect(folder).execute(sql)
    names = [d[0] for d in found.description]
    got = queries.op7_quality_rules(spark, str(folder)).select(*names)
    assert rows_of(names, names, [tuple(r) for r in got.collect()]) == rows_of(names, names, found.fetchall())


def test_an_id_with_many_rows_is_no_larger_sample(spark):
    table = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 0), (1, 1)], "doc_id bigint, quality int")
    seen = []
    fit = quality.fit
    quality.fit = lambda x, y, **more: seen.append(len(x)) or fit(x, y, **more)
    try:
        quality.learn(table, labels, sample_rows=50)
    finally:
        quality.fit = fit
    assert seen == [50]


def test_quality_on_held_out_rows(spark):
    from conftest import DATA

    read = lambda name: spark.read.parquet(f"{DATA.parent}/sf0.01/{name}.parquet")
    table, labels = read("documents"), read("labels")
    found = quality.classify(table, quality.learn(table, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and (found["predicted"] == found["quality"]).mean() > 0.95
    judged = quality.apply_rules(table, quality.learn(table, labels, monotone=quality.constraints())).join(labels, "doc_id").toPandas()
    assert not judged[(judged.quality == 0) & judged.kept].shape[0] > 2
    good = judged[(judged.quality == 1) & ~judged.base_failed]
    assert good.kept.mean() > 0.98


def test_quality_on_awkward_rows(spark):
    table = docs(spark, *TEXTS)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.learn(table, labels)
    found = quality.classify(table, model).collect()
    assert len(found) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in found)
    held = {r["doc_id"]: r["held_out"] for r in found}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(len(TEXTS))) and held[None] is False
    rules = {r["doc_id"]: r for r in quality.apply_rules(table, model).collect()}
    for i, text in enumerate(TEXTS):
        n = brute_counts(text)
        assert [rules[i][c] for c in docstats.COUNTS] == n
        assert rules[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert quality.keep_ruled(table, model).columns == quality.keep_classified(table, model).columns == table.columns
    assert quality.classify(table.limit(0), model).count() == 0


# ---- language ----
def test_language_on_held_out_rows(spark):
    from conftest import DATA

    table = spark.read.parquet(f"{DATA.parent}/sf0.01/documents.parquet")
    found = langid.identify(table, langid.learn(table)).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97


def test_language_on_awkward_rows(spark):
    table = docs(spark, "the cat", "", None, "12 34 !", "é")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table, langid.learn(table)).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[0][0] == "en" and 0 <= found[0][1] <= 1
    nothing = langid.learn(table.limit(0))
    assert {r["lang_pred"] for r in langid.identify(table, nothing).collect()} == {"und"}


def brute_profile(texts, ranks):
    seen = Counter()
    for text in texts:
        t = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        seen.update(g for n in (1, 2, 3) for i in range(len(t) - n + 1) if (g := t[i : i + n]) != " ")
    value = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], value(x[0])))][:ranks]


def test_distances_are_brute_force(spark):
    from conftest import DATA

    table = spark.read.parquet(f"{DATA}/documents.parquet").limit(200)
    rows = table.collect()
    ranks = 60
    learnt = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            learnt.setdefault(r["lang"], []).append(r["text"])
    profiles = {lang: brute_profile(texts, ranks) for lang, texts in learnt.items()}
    found = {r["doc_id"]: r for r in langid.identify(table, langid.learn(table, ranks=ranks)).collect()}
    for r in rows:
        own = brute_profile([r["text"] or ""], ranks)
        if not own:
            assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        sums = {lang: sum(abs(p.index(g) - i) if g in p else ranks for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(sums), key=sums.get)
        assert found[r["doc_id"]]["lang_pred"] == best and abs(found[r["doc_id"]]["score"] - (1 - sums[best] / (ranks * len(own)))) < 1e-12


def test_long_texts_and_many_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD_COUNTS", 40)
    rows = [(i, f"{chr(97 + i % 20)}{chr(98 + i % 7)} wort{chr(97 + i % 20)} " * 30, f"l{i % 700}", "s") for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert len(langid.learn(table).langs) == 700
    long = "abc déf " * 300_000
    keys, counts = langid.counted(long)
    assert counts.sum() > 6 * 900_000 and langid.ranked(long)[:3].tolist() == langid.ranked("abc déf " * 1000)[:3].tolist()
    assert langid.identify(table.limit(0), langid.learn(table.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "a", "abc" * 50, "ab cd  éf\n\n g", " x ", "ΑΣ ΣΑΣ, ΑΣ", "İstanbul İ", "1 2 3", "a1b2 " * 20, "ab  " * 9])
def test_the_length_of_a_piece_changes_nothing(text):
    """Against n-grams counted one by one, whatever the pieces are."""
    flat = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    flat = re.sub(" +", " ", flat)
    wanted = Counter(g for n in (1, 2, 3) for i in range(len(flat) - n + 1) if (g := flat[i : i + n]) != " ")
    for piece in (1, 2, 3, 5, 1 << 20):
        keys, counts = langid.counted(text, piece)
        decoded = {"".join(chr(int(k) >> (21 * s) & 0x1FFFFF) for s in (2, 1, 0)).lstrip("\0"): int(c) for k, c in zip(keys, counts, strict=True)}
        assert decoded == dict(wanted), piece


def test_a_text_longer_than_a_piece_is_counted_as_one():
    long = "abc" * 400_000
    keys, counts = langid.counted(long)
    whole = langid._counted(np.sort(np.concatenate(list(langid._pieces(long, 1 << 30)))))
    assert len(keys) == 13 and keys.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()


def test_a_column_of_too_many_values_names_no_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 5)
    table = spark.createDataFrame([(i, "text", f"l{i}") for i in range(20)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError):
        langid.learn(table)


def test_number_signs_are_no_letters(spark):
    table = docs(spark, "the cat", "½", "² ①", "x²")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(table, langid.learn(table)).collect()}
    assert found[1] == found[2] == ("und", 0.0) and found[3][0] == "en"


def test_ngrams_by_hand():
    keys, counts = langid._counted(langid.grams("Ab ab"))
    wanted = Counter(g for n in (1, 2, 3) for i in range(len(" ab ab ") - n + 1) if (g := " ab ab "[i : i + n]) != " ")
    decoded = {"".join(chr(int(k) >> (21 * s) & 0x1FFFFF) for s in (2, 1, 0)).lstrip("\0"): int(c) for k, c in zip(keys, counts, strict=True)}
    assert decoded == dict(wanted)


# ---- HTML ----
PAGES = {
    None: [],
    "": [],
    "just text": ["just text"],
    "<p>a &amp; b\n\n c<p>d": ["a & b c", "d"],
    "<header>H</header><nav><a>n</a></nav><article><h1>T</h1><p>One, two.</p><aside>x</aside><p>Three<br>four.</p></article><footer>f</footer>": ["T", "One, two.", "Three four."],
    "<body><div class='ad-banner'>Buy now!</div><div id=main><h2>Title</h2><p>Long enough text, with marks; and more of it.</p></div><section class=comments><p>Nice one, thanks!</p></section><form>Mail: <input></form></body>": ["Title", "Long enough text, with marks; and more of it."],
    "<script>var t='</p><p>no';</script><style>p{}</style><p>yes, this.</p>": ["yes, this."],
    "<article><p>cut off <b>he": ["cut off he"],
    "<p>a < b, and c > d</p>": ["a < b, and c > d"],
}


@pytest.mark.parametrize("page", PAGES)
def test_html_blocks(page):
    assert html_text.content(page) == PAGES[page]


LONG = "A long sentence of the article, with marks; and some more of it. " * 4
WRAPPERS = ["class='layout has-sidebar'", "class='content no-sidebar'", "class='reader-view'", "class=reader", "id=menu", "role=form"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers_do_not_lose_the_article(wrapper):
    page = f"<div {wrapper}><div class=ad>Buy!</div><article><h1>T</h1><p>{LONG}</p></article><section class=comments><p>Nice.</p></section></div>"
    assert html_text.content(page) == ["T", LONG.strip()]
    assert html_text.content(f"<nav><a>n</a></nav><form><p>{LONG}</p></form>") == [LONG.strip()]


def test_html_links_are_measured_as_read():
    coded = "".join(f"&#{ord(c)};" for c in LONG[:60])
    page = f"<article><p>{LONG}</p><p>{LONG} <a>{coded}</a></p><p><a>{LONG}</a></p></article>"
    assert html_text.content(page) == [LONG.strip(), LONG + LONG[:60].strip(), LONG.strip()]
    outside = "".join(f"&#{ord(c)};" for c in LONG)
    assert html_text.content(f"<p>{outside}<a>{coded}</a></p>") == [LONG + LONG[:60].strip()]


def test_html_ratios_decide_inside_the_article():
    page = "<article>" + f"<p>{LONG}</p>" * 5 + "<div><span>Ad</span></div>" * 6 + "</article>"
    assert html_text.content(page) == [LONG.strip()] * 5


BARE_PAGES = {
    f"<body><div class=top><ul><li><a href=x>One</a></li><li><a>Two</a></li></ul></div><div><h1>T</h1><p>{LONG}</p><p><a>{LONG}</a></p><p>{LONG}</p></div><div><span>Buy now</span></div></body>": ["T", LONG.strip(), LONG.strip(), LONG.strip()],
    f"<div class='reader-article'><h1>T</h1><p>{LONG}</p></div>": ["T", LONG.strip()],
    f"<div id='discussion-paper'><p>{LONG}</p></div><div class=comments><p>Nice. I like it.</p></div>": [LONG.strip()],
    f"<article><header><h1>T</h1><p>By me</p></header><p>{LONG}</p></article><header><h1>Site</h1></header>": ["T", LONG.strip()],
    f"<main><div class=comments><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><p>Short.</p></main>": [LONG.strip(), "Short."],
    f"<table><tr><td>{LONG}</td></tr></table><div>nav | x | y</div>": [LONG.strip()],
    f"<nav>{LONG}</nav><div><p>{LONG}</p></div>" * 3: [LONG.strip()] * 3,
}


@pytest.mark.parametrize("page", BARE_PAGES)
def test_html_without_or_beside_an_article(page):
    assert html_text.content(page) == BARE_PAGES[page]


def test_html_ratios_decide():
    """Without the threshold, adverts come in on every page of the table: only the ratios keep them out."""
    import pyarrow.parquet as pq
    from conftest import DATA

    pages = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()
    for page in pages:
        kept, all_ = html_text.content(page), html_text.content(page, keep=0.0)
        assert set(kept) < set(all_)
        article = html_text.content(page[page.index("<article") : page.index("</article>")])
        assert kept == article


@pytest.mark.parametrize("part", ["<div>", "<div><p>a ", "<div><span>t</b></i>", "<li>x", "<aside>y", "<article>z ", "<p>long text "])
def test_html_time_grows_with_the_page_and_not_with_its_depth(part):
    """A page four times as long takes about four times as long, not sixteen times."""
    import time

    def seconds(n):
        page, best = part * n + "x", 1e9
        for _ in range(3):
            began = time.process_time()
            html_text.content(page)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(40_000) < 10 * max(seconds(10_000), 0.01)


def test_html_rows(spark):
    rows = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(PAGES)], "page_id int, html string, text string")
    found = html_text.extract(rows, kept=["page_id"]).collect()
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in found} == {i: ("\n".join(b), len("\n".join(b))) for i, b in enumerate(PAGES.values())}
    assert html_text.extract(rows.limit(0)).count() == 0


# ---- WARC ----
def test_archives_round_trip(spark):
    pages = [(1, "http://a", "same"), (2, None, "same"), (5, "http://b\r\nx", "same"), (3, "u", "é" * 2_000_000), (4, "v", None), (6, "w", ""), (None, "n", "same"), (5, "http://b\r\nx", "same")]
    rows = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, digest string").repartition(3)
    archive = warc.write_archive(rows)
    found = warc.read_archive(archive).collect()
    assert len(found) == len(pages)
    for r in found:
        want = next(p[2] or "" for p in pages if str(p[0]) == str(r["record_key"])).encode()
        assert r["payload_bytes"] == len(want) and r["payload_digest"] == warc.payload_digest(want)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == want
    kinds = sorted((str(r["record_key"]), r["record_type"], r["refers_to"]) for r in found)
    assert kinds == [("1", "revisit", "5"), ("2", "revisit", "5"), ("3", "response", None), ("4", "revisit", "6"), ("5", "response", None), ("5", "response", None), ("6", "response", None), ("None", "response", None)]
    held = {r["bundle"]: bytes(r["content"]) for r in warc.bundle_files(spark, archive.folder).collect()}
    assert {r["bundle"]: r["bytes"] for r in archive.bundles.collect()} == {name: len(content) for name, content in held.items()}
    for at in warc.locate(archive).collect():
        headers, _ = warc.read_record(held[at["bundle"]], at["frame"], at["offset"])
        assert headers["Record-Key"] == (at["record_id"] or "")
    large = warc.read_archive(warc.write_archive(rows, min_bytes=10)).where("record_type = 'revisit'")
    assert large.count() == 0 and warc.read_archive(warc.write_archive(rows.limit(0))).count() == 0


def test_bundles_are_files_that_plain_tools_open(spark, tmp_path):
    import io

    import zstandard

    rows = spark.createDataFrame([(i, f"u{i}", "x" * i) for i in range(50)], "page_id bigint, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/archive"
    archive = warc.write_archive(rows, folder=folder)
    (tmp_path / "archive" / "_writing-lost").mkdir()
    (tmp_path / "archive" / "_writing-lost" / "half").write_bytes(b"junk")
    names = sorted(p.name for p in (tmp_path / "archive").iterdir() if p.is_file() and not p.name.startswith("."))
    assert names == sorted(r["bundle"] for r in archive.bundles.collect()) and len(names) == 3
    keys = []
    for name in names:
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "archive" / name).read_bytes()), read_across_frames=True).read()
        keys += [h["Record-Key"] for _, h, _ in warc.read_records(whole)]
    assert sorted(map(int, keys)) == list(range(50)) and warc.read_archive(archive).count() == 50
    assert warc.read_archive(warc.write_archive(rows, folder=folder)).count() == 50


def test_a_damaged_bundle_is_refused():
    bundle = warc.Bundle()
    bundle.add(1, warc.write_record(1, "u", b"x", warc.payload_digest(b"x")))
    content = bundle.finish()
    assert len(warc.seek_table(content)) == 1
    with pytest.raises(ValueError, match="seek table"):
        warc.seek_table(content[:-1])
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.read_records(b"junk" * 9))


# ---- packing ----
public = pytest.importorskip("public_tokenizers")


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    texts = ["", None, "It's A  tést…", "word " * 9_000, "a\x0bb\u2003c\u200bd 'tis", "x" * 5_000, "İstanbul ŞŞ. ½cup², naïve!? <|endoftext|>"] + [f"text {i} " * (i % 90) for i in range(400)]
    table = docs(spark, *texts).repartition(5)
    packed = packing.pack_texts(table, path, capacity=256, open_windows=4, merged_partitions=2).collect()
    own = Tokenizer.from_file(path)
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in enumerate([*texts])}
    pieces = {}
    for r in packed:
        assert r["length"] * 4 == len(r["ids"])
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for i, want in ids.items():
        whole = b"".join(x for _, x in sorted(pieces[i]))
        assert whole == (want if i else want * 2), i
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 256 and sum(ends.values()) > 0.9 * 256 * len(ends)
    again = packing.pack(packing.tokenize(table, path), capacity=256, keep_ids=False)
    assert "ids" not in again.columns and again.agg(F.sum("length")).first()[0] == sum(ends.values())
    assert packing.pack_texts(table.limit(0), path).count() == 0


def test_best_fit():
    windows = packing.Windows(10, 2)
    assert windows.place(6, "a") is None and windows.place(7, "b") is None
    assert windows.place(3, "c")[2] == ["b", "c"]  # full windows go at once
    assert windows.place(9, "d") is None
    assert [w[2] for w in windows.open] == [["d"], ["a"]]
    assert windows.place(5, "e")[2] == ["d"]  # of those without room the fullest goes
    assert windows.place(4, "f")[2] == ["a", "f"]



# ---- chat ----
def test_perspectives(spark):
    turns = [(1, 0, "system", "Be <|kind|>."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (2, 0, "system", "alone"), (None, 0, "cy", "x"), (3, 0, None, "who"), (3, 0, None, "who")]
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id int, turn int, role string, text string, perspective string")
    rows = chat.rotate_perspectives(table).collect()
    assert len(rows) == 4 * 2 + 1 + 2
    one = sorted((r for r in rows if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: r["turn"])
    assert [(r["role"], r["name"], r["train"]) for r in one] == [("system", None, False), ("assistant", None, True), ("user", "bob", False), ("assistant", None, True)]
    assert one[0]["rendered"] == "<|im_start|>system\nBe < |kind|>.<|im_end|>\n"
    assert one[2]["rendered"] == "<|im_start|>user name=bob\n<|im_end|>\n"
    for r in rows:
        learnt = r["rendered"][r["start"] : r["end"]]
        assert learnt == (r["rendered"].split("\n", 1)[1] if r["train"] else "")
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.render_dialogues(chat.rotate_perspectives(table)).collect()}
    ann = whole[1, "ann"]
    assert ann["rendered"] == "".join(r["rendered"] for r in one)
    assert [ann["rendered"][s["start"] : s["end"]] for s in ann["spans"]] == ["Hi<|im_end|>\n", "Bye<|im_end|>\n"]
    assert chat.rotate_perspectives(table.limit(0)).count() == 0


def test_awkward_names(spark):
    turns = [(1, 0, "a\r\nb", "x"), (1, 1, "", "y"), (1, 2, "<|im_start|>", "z" * 100_000)]
    rows = chat.rotate_perspectives(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()
    seen = {(r["perspective"], r["turn"]): r for r in rows}
    assert len(seen) == 9
    assert seen["", 0]["rendered"] == "<|im_start|>user name=a b\nx<|im_end|>\n" and seen["", 0]["name"] == "a b"
    assert seen["a\r\nb", 1]["rendered"] == "<|im_start|>user name=\ny<|im_end|>\n"
    assert seen["", 2]["rendered"].startswith("<|im_start|>user name=< |im_start|>\nzzz") and seen["a\r\nb", 0]["train"]




def test_arrow_batches_are_bounded(spark):
    from tidemark.llm.batches import in_arrow

    import pyarrow as pa

    def sizes(held):
        for b in held:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 4_000, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") < 2_000, 10).otherwise(40_000)).alias("text"))
    found = in_arrow(rows, sizes, "n bigint, size bigint").agg(F.max("n"), F.max("size"), F.sum("n")).first()
    assert found[0] <= 1_000 and found[1] < 5 << 20 and found[2] == 4_000


def test_near_words_are_counted_once_in_repeated_rows_and_their_places_are_not_broadcast(spark):
    """Equal rows counted each word twice, and what was spread over words and places could go through the driver."""
    bench = spark.createDataFrame([(1, "apple pear apple")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "apple pear plum fig date lime")] * 2 + [(2, "pear apple apple fig")], "doc_id long, text string")
    found = decontam.near_items(docs, bench)
    assert [tuple(r) for r in found.collect()] in ([(2, 1, 1)], [(2, 1, 2)])
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
