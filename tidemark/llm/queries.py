"""The queries opN_<name>: each applies its operator to whole tables. SQL to match where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, fim, html_text, jaccard, langid, packing, quality, ranking, shards, urls, warc

#: The rules of op1: fixed values.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.filter_urls(pages, urls.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontam.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents have the words of a window of an item near together: proximity matches of op2's index."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.near_items(docs, _read(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.learn(docs, _read(spark, sf_dir, "labels")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"), kept=["page_id", "url"])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_classes(docs).select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.learn(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.apply_rules(docs, quality.learn(docs, _read(spark, sf_dir, "labels"), monotone=quality.constraints()))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(_read(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select(
        F.col("record_key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_texts(docs, tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_read(spark, sf_dir, "conversations"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return ranking.rank(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", "rank", "doc_id", "score")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_html_text": op4_html_text,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language": op6_language,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_perspectives": op10_perspectives,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_lexical_search": op12_lexical_search,
    "op13_sharding": op13_sharding,
    "benchmark_proximity": benchmark_proximity,
}

#: The words of op2: fixed values.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rebalanced_sql(held: str, to: str, n: int = 8) -> str:
    """The map ``to`` that a rebalancing makes of ``held`` (v, sh), by the sizes ``size`` (v, b)."""
    return f"""
        {to}_a AS MATERIALIZED (
            SELECT {held}.v AS v, sh, coalesce(b, 0) AS b, coalesce(b, 0) = 0 OR row_number() OVER w = 1
                   OR {n} * sum(coalesce(b, 0)) OVER (w ROWS UNBOUNDED PRECEDING) <= (SELECT sum(b) FROM size) AS stays
            FROM {held} LEFT JOIN size USING (v) WINDOW w AS (PARTITION BY sh ORDER BY coalesce(b, 0) DESC, {held}.v)
        ), {to}_r AS (
            SELECT range AS sh, (SELECT sum(b) FROM size) - {n} * coalesce((SELECT sum(b) FROM {to}_a a WHERE a.sh = range AND stays), 0) AS room FROM range({n})
        ), {to}_i AS (
            SELECT sh, 2 * (sum(room) OVER (ORDER BY room DESC, sh) - room) AS lo, 2 * sum(room) OVER (ORDER BY room DESC, sh) AS hi FROM {to}_r WHERE room > 0
        ), {to}_f AS (
            SELECT v, {n} * (2 * sum(b) OVER (ORDER BY b DESC, v) - b) AS mid FROM {to}_a WHERE NOT stays
        ), {to} AS MATERIALIZED (
            SELECT {to}_a.v AS v, coalesce({to}_i.sh, {to}_a.sh) AS sh FROM {to}_a LEFT JOIN {to}_f ON {to}_f.v = {to}_a.v LEFT JOIN {to}_i ON mid >= lo AND mid < hi
        )"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM cut
        ), rules(h, p, v) AS (
            VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}
        )
        SELECT page_id, host, path,
               (SELECT arg_max(h || p, length(h || p)) FROM rules
                WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
               coalesce((SELECT arg_max(v, length(h || p)) FROM rules
                WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
        FROM parts
    """,
    "op2_decontaminate": rf"""
        WITH doc AS (
            SELECT row_number() OVER () AS k, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
        ), item AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM win
        ), grams AS (
            SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes)
        ), hit AS (SELECT k, grams.n AS n, i, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n
        ), cover AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k
        ), held AS (
            SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
            FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY k
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN cover USING (k) LEFT JOIN held USING (k)
    """,
    "op5_jaccard_join": rf"""
        WITH RECURSIVE doc AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
        ), sets AS MATERIALIZED (
            SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
            FROM doc WHERE len(w) > 0
        ), keyed AS MATERIALIZED (SELECT doc_id, sha256(array_to_string(s, '|')) AS k, len(s) AS n, s FROM sets
        ), one AS MATERIALIZED (SELECT k, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS copy_of, count(*) AS rows FROM keyed GROUP BY k
        ), gram AS MATERIALIZED (SELECT k, n, unnest(s) AS g FROM one
        ), link AS MATERIALIZED (
            SELECT a.k AS a, b.k AS b FROM gram a JOIN gram b ON a.g = b.g AND a.k <> b.k AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
            GROUP BY a.k, b.k, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))
        ), reach(k, r) AS (SELECT k, k FROM one UNION SELECT link.b, r FROM reach JOIN link ON link.a = reach.k
        ), class AS (SELECT reach.k, min(other.copy_of) AS class_id FROM reach JOIN one other ON other.k = r GROUP BY reach.k
        ), links AS (SELECT a AS k, count(*) AS n_links FROM link GROUP BY a)
        SELECT documents.doc_id, coalesce(class_id, documents.doc_id) AS class_id, coalesce(copy_of, documents.doc_id) AS copy_of,
               coalesce(rows - 1, 0) AS n_copies, coalesce(n_links, 0) AS n_links
        FROM documents LEFT JOIN keyed ON keyed.doc_id = documents.doc_id LEFT JOIN one ON one.k = keyed.k
             LEFT JOIN class ON class.k = keyed.k LEFT JOIN links ON links.k = keyed.k
    """,
    "benchmark_proximity": rf"""
        WITH doc AS MATERIALIZED (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
        ), item AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark
        ), win AS MATERIALIZED (
            SELECT row_number() OVER () AS v, item_id, words, len(words) + 2 AS span FROM (
                SELECT DISTINCT item_id, w[i:i + 9] AS words
                FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item WHERE len(w) > 0))
        ), token AS MATERIALIZED (SELECT k, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM doc
        ), term AS (SELECT v, unnest(words) AS t, unnest(range(len(words))) AS o FROM win
        ), freq AS (SELECT t, count(*) AS df FROM token GROUP BY t
        ), rare AS (SELECT v, arg_min(term.t, (coalesce(df, 0), o)) AS t FROM term LEFT JOIN freq USING (t) GROUP BY v
        ), need AS (SELECT v, list({{'t': t, 'n': n}}) AS needs FROM (SELECT v, t, count(*) AS n FROM term GROUP BY ALL) GROUP BY v
        ), cand AS (
            SELECT doc_id, item_id, p, span, needs, w[greatest(1, p - span + 1):p + span - 1] AS around, least(p, span) AS own
            FROM rare JOIN token USING (t) JOIN win USING (v) JOIN need USING (v) JOIN doc USING (k)
            WHERE len(list_filter(needs, lambda x: NOT list_contains(w[greatest(1, p - span + 1):p + span - 1], x.t))) = 0
        ), near AS (
            SELECT DISTINCT doc_id, item_id, p FROM cand
            WHERE len(list_filter(range(1, own + 1), lambda s: len(list_filter(needs, lambda x:
                len(list_filter(around[s:s + span - 1], lambda y: y = x.t)) < x.n)) = 0)) > 0
        )
        SELECT doc_id, item_id, count(*) AS n FROM near GROUP BY ALL
    """,
    "op10_perspectives": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS speech
            FROM conversations
        ), who AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker <> 'system'
        ), seen AS (
            SELECT conv_id, perspective, turn, speech, speaker = perspective AS train,
                   CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
                   CASE WHEN speaker NOT IN (perspective, 'system') THEN regexp_replace(replace(speaker, '<|', '< |'), '[\r\n]+', ' ', 'g') END AS name
            FROM said JOIN who ON conv_id IS NOT DISTINCT FROM c
        ), cut AS (
            SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head,
                   speech || '<|im_end|>' || chr(10) AS body FROM seen
        )
        SELECT conv_id, perspective, turn, role, name, head || body AS rendered, length(head) AS start,
               CASE WHEN train THEN length(head) + length(body) ELSE length(head) END AS "end", train
        FROM cut
    """,
    "op11_fill_in_middle": r"""
        WITH doc AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                   sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), drawn AS (
            SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 THEN 'plain'
                        WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM doc
        ), cut AS (
            SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s
            FROM drawn
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM cut
    """,
    "op12_lexical_search": r"""
        WITH doc AS MATERIALIZED (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '@U', '@L'), '@T') AS w FROM documents
        ), item AS (
            SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '@U', '@L'), '@T'))) AS t FROM benchmark
        ), sums AS (SELECT count(*) AS nd, sum(len(w)) AS nt FROM doc WHERE len(w) > 0
        ), tf AS MATERIALIZED (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM doc) GROUP BY k, t
        ), df AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, sums GROUP BY t
        ), size AS (SELECT k, doc_id, 50 + (50 * len(w) * CAST(nd AS BIGINT)) // CAST(nt AS BIGINT) AS m FROM doc, sums WHERE len(w) > 0
        ), total AS (
            SELECT item_id, k, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM item JOIN df USING (t) JOIN tf USING (t) JOIN size USING (k) GROUP BY item_id, k
        ), placed AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM total JOIN size USING (k) WHERE score > 0
        )
        SELECT * FROM placed WHERE rank <= 50
    """.replace("@U", _UPPER).replace("@L", _LOWER).replace("@T", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    "op13_sharding": f"""
        WITH steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step
        ), doc AS MATERIALIZED (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
                   ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), text, ''))[1:8])::BIGINT AS place
            FROM documents
        ), held AS MATERIALIZED (
            SELECT doc_id, size, place % 8192 AS v, (place // 8192) % 16 AS part,
                   xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, step[1 + xor(c, b) % 256])), 4294967295) AS text_crc32
            FROM doc, steps
        ), size AS MATERIALIZED (SELECT v, sum(size) AS b FROM held GROUP BY v
        ), m0 AS (SELECT range AS v, range % 8 AS sh FROM range(8192)
        ), {_rebalanced_sql("m0", "m1")}, {_rebalanced_sql("m1", "m2")}, {_rebalanced_sql("m2", "m3")}
        SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(sh AS INTEGER) AS shard,
               row_number() OVER (PARTITION BY sh ORDER BY v, part, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM held JOIN m3 USING (v)
    """,
    "op8_warc": r"""
        WITH payload AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   array_to_string(list_transform(string_split(sha1(encode(coalesce(html, ''))), ''),
                       lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits
            FROM pages
        ), named AS (
            SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
                + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
                + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest
            FROM payload
        ), last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM named)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < largest THEN largest END AS refers_to
        FROM last
    """,
}
