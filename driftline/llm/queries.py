"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import audit, bpe, exact, html, language, lines, mixing, pieces, resample, shards, simhash, topk, warc
from driftline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op3_exact_dedup", f"""
WITH t AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256, {LOWER_SQL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY norm)""")
def op3_exact_dedup(spark, folder):
    return exact.exact_duplicates(table(spark, folder, "documents"))


@query("op7_mix_sources", """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n)::DOUBLE * 1.0 / (SELECT count(*) FROM n) / n AS rate FROM n),
span AS (SELECT source, rate, greatest(0, floor(rate - 12 * sqrt(rate) - 30))::BIGINT AS a,
 ceil(rate + 12 * sqrt(rate) + 30)::BIGINT AS b FROM r),
k AS (SELECT source, rate, a, unnest(generate_series(a, b)) AS k FROM span),
logs AS (SELECT *, sum(CASE WHEN k > a THEN ln(rate / k) ELSE 0.0 END) OVER (PARTITION BY source ORDER BY k) AS l FROM k),
terms AS (SELECT *, exp(l - max(l) OVER (PARTITION BY source)) AS t FROM logs),
cdf AS (SELECT source, a, sum(t) OVER (PARTITION BY source ORDER BY k) / sum(t) OVER (PARTITION BY source) AS c FROM terms),
u AS (SELECT *, ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
drawn AS (SELECT u.doc_id, (max(a) + count(*) FILTER (c <= u))::INT AS copies FROM u JOIN cdf ON cdf.source IS NOT DISTINCT FROM u.source GROUP BY u.doc_id),
rows AS (SELECT doc_id, unnest(generate_series(1, copies))::INT AS copy FROM drawn)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy,
 ('0x' || substr(md5('8:' || d.doc_id || ':' || copy), 1, 13))::BIGINT AS mix_key FROM rows JOIN documents d USING (doc_id)""")
def op7_mix_sources(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents"))


#: The line rules of driftline.llm.lines in this dialect; both follow the same fixed patterns.
_N = r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(x, '{pattern}')) > {lines.NOISY_WORDS} * {_N}"


_NOTICES = lines.BOILERPLATE.replace("\\u00a9", "©")
_FAILS = f"""(regexp_matches(x, '{_NOTICES}') AND len(regexp_extract_all(x, '{_NOTICES}')) * {lines.NOTICE_WORDS} >= {_N} OR {_count("[|»›·>]")}
 OR {_count(r"[#*$%&<>{}\\]+")} OR {_count("[!?]{2,}")})"""


@query("op9_line_quality", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, i, words[i:i+4] AS v FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM p WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM twice, generate_series(0, 4) AS g(k) GROUP BY doc_id),
l AS (SELECT doc_id, text, words, lines, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl,
 list_filter(lines, lambda x: NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR NOT {_FAILS}) AS pl FROM p),
m AS (SELECT l.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(fl) - len(list_distinct(fl)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
 len(fl) AS n_lines, len(lines) - len(pl) AS n_failed_lines, array_to_string(pl, chr(10)) AS clean_text
 FROM l LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0
 THEN length(regexp_replace(clean_text, '[\x20\x09-\x0D]+', '', 'g'))::DOUBLE / word_chars ELSE 1.0 END AS left_share FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_share >= {lines.LEAST_LEFT} AS kept,
 n_lines, n_failed_lines, left_share, clean_text FROM f""")
def op9_line_quality(spark, folder):
    return lines.clean_lines(table(spark, folder, "documents"))


@query("op6_piece_counts")
def op6_piece_counts(spark, folder):
    return pieces.count_pieces(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


@query("op10_bpe")
def op10_bpe(spark, folder):
    coded = bpe.encode_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op2_simhash")
def op2_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op1_language_id")
def op1_language_id(spark, folder):
    return language.identify_languages(table(spark, folder, "documents"))


@query("op4_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload, strlen(payload) AS payload_bytes, array_to_string(list_transform(generate_series(0, 31),
 lambda i: substr('{warc.BASE32}', (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM f""")
def op4_warc(spark, folder):
    return warc.archive_round_trip(table(spark, folder, "pages"), scratch_path(spark, "warc"))


@query("op5_main_text")
def op5_main_text(spark, folder):
    return html.extract_text(table(spark, folder, "pages"))


@query("op8_training_order")
def op8_training_order(spark, folder):
    import public_tokenizers

    out = scratch_path(spark, "shards")
    shards.write_shards(table(spark, folder, "documents"), out, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = shards.read_shards(spark, out)
    return rows.select("slot", "doc_id", "seq", "n_ids", F.sha2("ids", 256).alias("ids_sha256"))


@query("op11_top_scores", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20""")
def op11_top_scores(spark, folder):
    return topk.top_scores(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


# The SQL takes the CRC-32 of distinct words: their bytes through the table of all bytes, one after the other.
@query("op12_resample", r"""
WITH bits AS (SELECT b, list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS t
 FROM range(256) AS r(b)),
tab AS (SELECT list(t ORDER BY b) AS t FROM bits),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bench AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM bench),
names AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
 lambda x, y: xor(x >> 8, t[(xor(x, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM names, tab),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM dw JOIN crc USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS g
 FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
 FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked""")
def op12_resample(spark, folder):
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
letters AS (SELECT i, substr('ABCDE', i + 1, 1) AS x FROM range(5) AS r(i)),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
 WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, step, 1 << o[step]::INT AS bit, coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i::INT)), 0)::INT AS before FROM orders, range(1, 6) AS r(step)),
m AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
 sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
 sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
 sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM m""")
def op13_filter_audit(spark, folder):
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
