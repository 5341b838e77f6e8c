"""The numbered queries over the corpus tables, thin digests of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, collocations, embedding_join, importance, language_id, license_scan, minhash_join, packing, prefix_free, quality_lm, repetition, token_counts, warc_revisits
from .common import table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_lm.classify(table(spark, sf_dir, "documents"), trusted).select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve(warc_revisits.captures(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    return found.select("record_id", "url", "ts", "outcome", "ref_id", h["etag"].alias("etag"), h["cache-control"].alias("cache_control"), h["date"].alias("date"), h["content-length"].alias("content_length"), h["content-type"].alias("content_type"), F.sha2("payload", 256).alias("payload_sha256"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = language_id.fold(F.col("doc_id"))
    known = docs.select("doc_id", "lang").where("lang is not null")
    found = language_id.identify(docs, known.where(fold >= 2), known.where(fold == 1))
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_free.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE)))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_classifier, op3_quality_rules, op4_warc_revisits, op5_bpe_round_trip, op6_language_id, op7_token_counts, op8_suffix_array_dedup, op9_embedding_near_dedup, op10_best_fit_packing, op11_importance_resampling, op12_phrase_collocations, op13_license_scan)}

_TEMPLATES = ", ".join(f"({i}, '{label}', {k}, [{', '.join(repr(w.decode()) for w in words)}])" for i, label, k, words in license_scan.templates())
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)""",
    "op3_quality_rules": f"""
WITH w AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS n))),
k AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS k, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS r FROM g),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS j FROM k WHERE k > 1 AND (n = 3 OR r > 1)),
v AS (SELECT c.doc_id, c.n, count(*) AS words, sum(length(w.w[c.j])) AS chars FROM c JOIN w USING (doc_id) GROUP BY ALL),
t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
d AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM t WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
q AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (again) AS dup, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (again), 0) AS dup_chars FROM d GROUP BY ALL),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
x AS (SELECT doc_id, coalesce(max(words) FILTER (n = 3), 0) AS n_repeat_words FROM b LEFT JOIN v USING (doc_id) GROUP BY ALL),
y AS (SELECT b.doc_id, bool_or(v.chars / b.word_chars > CASE v.n WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 7 THEN 0.13 WHEN 8 THEN 0.12 WHEN 9 THEN 0.11 ELSE 0.1 END) AS dense FROM b JOIN v USING (doc_id) WHERE v.n >= 5 GROUP BY ALL),
z AS (SELECT b.*, coalesce(q.dup, 0)::BIGINT AS n_dup_lines, x.n_repeat_words::BIGINT AS n_repeat_words, b.n_words < 50 OR 100 * x.n_repeat_words > 50 * b.n_words AS base_failed,
 coalesce(y.dense, false) OR coalesce(q.dup / q.lines > 0.3, false) OR coalesce(q.dup_chars / q.chars > 0.2, false) AS repetitive FROM b JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT repetitive AS kept FROM z""",
    "op4_warc_revisits": r"""
WITH p AS (SELECT page_id, html, '"' || substr(md5(html), 1, 16) || '"' AS tag, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
p1 AS (SELECT page_id, html, tag, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM p),
p2 AS (SELECT page_id, html, tag, regexp_replace(lower(regexp_extract(u, '^[^/?]*')) || regexp_replace(u, '^[^/?]*', ''), '^www\.', '') AS u FROM p1),
p3 AS (SELECT page_id, html, tag, regexp_replace(regexp_replace(u, '^([^/?:]*):(80|443)([/?]|$)', '\1\3'), '([?&])(utm_[a-z]+|ref|sessionid)=[^&]*', '\1', 'g') AS u FROM p2),
p4 AS (SELECT page_id, html, tag, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '[?]&+', '?', 'g'), '&&+', '&', 'g'), '[?&]+$', ''), '/index\.html?$', '/'), '/+$', '') AS url FROM p3),
r AS (SELECT page_id * 3 AS id, url, page_id * 60 AS ts, tag, strlen(html)::VARCHAR AS size, sha256(html) AS sha FROM p4),
v AS (SELECT page_id * 3 + 1 AS id, url, page_id * 60 + page_id % 11 * 40000 + 30 AS ts, CASE WHEN page_id % 5 = 0 THEN '"stale"' WHEN page_id % 5 = 1 THEN 'W/' || tag ELSE tag END AS tag FROM p4
 UNION ALL SELECT page_id * 3 + 2, url, page_id * 60 - 15, tag FROM p4),
a AS (SELECT v.id, v.url, v.ts, v.tag, max(struct_pack(ts := r.ts, id := r.id, tag := r.tag, size := r.size, sha := r.sha)) AS r FROM v LEFT JOIN r ON r.url = v.url AND r.ts < v.ts GROUP BY ALL),
b AS (SELECT *, CASE WHEN r.id IS NULL THEN 'no_response' WHEN tag IS NULL THEN 'no_validator' WHEN regexp_replace(tag, '^W/', '') = r.tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM a)
SELECT id AS record_id, url, ts, outcome, r.id AS ref_id, CASE WHEN outcome = 'resolved' THEN tag END AS etag, CASE WHEN outcome = 'resolved' THEN 'max-age=' || (((ts % 7) + 7) % 7)::VARCHAR END AS cache_control,
 CASE WHEN outcome = 'resolved' THEN 't' || ts::VARCHAR END AS date, CASE WHEN outcome = 'resolved' THEN r.size END AS content_length, CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type, CASE WHEN outcome = 'resolved' THEN r.sha END AS payload_sha256 FROM b""",
    "op8_suffix_array_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM h)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM w JOIN f USING (s) WHERE m < doc_id),
n AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 49 AS b FROM n GROUP BY ALL),
q AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM r),
c AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY k) AS head, max(b) AS b, sum(b - a + 1) AS gone, count(*) AS spans FROM q JOIN h USING (doc_id) GROUP BY ALL)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * b + 1), h))) AS kept_sha256 FROM h LEFT JOIN c USING (doc_id)""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)""",
    "op11_importance_resampling": r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
w AS (SELECT src, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT 'd' AS src, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark)),
f AS (SELECT src, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: (16 * (position(h[2 * i + 1] IN '0123456789ABCDEF') - 1) + position(h[2 * i + 2] IN '0123456789ABCDEF') - 1)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS b FROM h, tab),
c AS (SELECT src, doc_id, b FROM f JOIN k USING (f)),
t AS (SELECT b, count(*) FILTER (src = 'd') AS s, count(*) FILTER (src = 'b') AS t FROM c GROUP BY b),
z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM t),
g AS (SELECT b, floor(1000 * ln((t.t + 1)::DOUBLE * (z.s + 10000) / ((t.s + 1)::DOUBLE * (z.t + 10000))))::BIGINT AS g FROM t, z),
x AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM c JOIN g USING (b) WHERE src = 'd' GROUP BY doc_id),
y AS (SELECT w.doc_id, len(w.w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN x USING (doc_id) WHERE src = 'd'),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM y),
r AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (words >= 20) OVER () AS n FROM s)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM r""",
    "op12_phrase_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) - d + 2), lambda i: w[i:i + d - 1])) AS p FROM w, range(1, 5) d(d)),
f AS (SELECT lang, array_to_string(p, ' ') AS phrase, p, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(p) > 1 AND a >= 30),
k AS (SELECT lang, phrase, p, a, unnest(range(1, len(p))) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, 2000000 * k.a::HUGEINT // (x.a + y.a) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.p[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.p[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, p, a, d, unnest(range(1, len(p) - d + 2)) AS i FROM c, range(2, 4) d(d) WHERE d < len(p)),
m AS (SELECT lang, array_to_string(p[i:i + d - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b LEFT JOIN m USING (lang, phrase) WHERE coalesce(100 * longer < 80 * a, true))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_license_scan": r"""
WITH t(t, label, k, w) AS (VALUES """ + _TEMPLATES + r"""),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tg AS (SELECT t, label, k, len(w) AS n, i, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM t)),
dg AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM d, (VALUES (2), (4)) k(k))),
h AS (SELECT doc_id, t, label, k, n, dg.i - tg.i AS diag, dg.i AS pos FROM dg JOIN tg USING (k, g)),
l AS (SELECT doc_id, t, label, k, n, diag, count(DISTINCT pos) AS votes, min(pos) AS lo, max(pos + k) AS hi FROM h GROUP BY ALL),
m AS (SELECT *, sum((k = 2 OR coalesce(diag - before > 8, true))::INT) OVER (PARTITION BY doc_id, t ORDER BY diag) AS grp FROM (SELECT *, lag(diag) OVER (PARTITION BY doc_id, t ORDER BY diag) AS before FROM l)),
s AS (SELECT *, sum(votes) OVER (PARTITION BY doc_id, t, grp) AS every FROM m),
c AS (SELECT * FROM s WHERE CASE WHEN k = 2 THEN votes = n - 1 ELSE 100 * every >= 40 * (n - k + 1) END),
p AS (SELECT c.doc_id, c.t, c.label, c.k, c.n, c.grp, c.diag, unnest(range(c.lo, c.hi)) AS pos FROM c),
v AS (SELECT p.doc_id, p.label, p.k, p.n, p.grp, min(p.diag) AS diag, count(DISTINCT pos - p.diag) AS same FROM p JOIN d USING (doc_id) JOIN t ON t.t = p.t WHERE d.w[pos + 1] = t.w[pos - p.diag + 1] GROUP BY p.doc_id, p.t, p.label, p.k, p.n, p.grp),
f AS (SELECT * FROM v WHERE 100 * same >= CASE WHEN k = 2 THEN 100 ELSE 75 END * n),
r AS (SELECT doc_id, count(*) FILTER (k = 2) AS n_base, min(diag) FILTER (k = 2) AS first_word, max(diag) FILTER (k = 2) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k = 2) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(same / n) AS score FROM f GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (doc_id)""",
}
