"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (byte_bpe, centroids, filter_audit, line_dedup, lm_scoring, mixing, quality, shuffle, simhash_dedup, suffix_dedup, token_files, topk,
               url_filter)
from .common import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return register


@query("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_digest(spark, read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op2_url_filters", r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (
  SELECT *, (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS a,
         (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS b,
         (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS c,
         (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS d FROM s)
SELECT page_id, host, path,
       CASE WHEN a THEN 'example.net/en/' WHEN b THEN 'example.com/de/' WHEN c THEN 'net/' WHEN d THEN 'org/fr/' END AS rule,
       CASE WHEN a THEN 'allow' WHEN b THEN 'block' WHEN c THEN 'block' ELSE 'allow' END AS verdict
FROM j""")
def op2_url_filters(spark, sf_dir):
    return url_filter.judge_urls(spark, read_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, url_filter.RULES))


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_shards(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_shards(spark, manifest, docs.select("doc_id"))


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(spark, read_table(spark, sf_dir, "documents"), words_each=4, most=4)


@query("op5_exact_topk", r"""
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op5_exact_topk(spark, sf_dir):
    return topk.search(spark, read_table(spark, sf_dir, "embeddings"), k=5, query_every=50)


@query("op6_sharding")
def op6_sharding(spark, sf_dir):
    return shuffle.shard_documents(spark, read_table(spark, sf_dir, "documents"), 40)


@query("op7_quality_rules", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IS NULL THEN 'null' ELSE 'lang ' || lang END AS lang FROM documents),  -- null is one of its own
w AS (
  SELECT doc_id, lang, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
         unnest(range(0, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) AS pos FROM d),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
g AS (
  SELECT doc_id, pos, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN
         word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS g
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g WHERE g IS NOT NULL),
rep AS (
  SELECT doc_id, count(*) AS n_repeat FROM (SELECT DISTINCT doc_id, pos + o AS pos FROM again, (SELECT unnest(range(0, 5)) AS o) WHERE times > 1) GROUP BY doc_id),
l AS (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, sum(times - 1) AS n_dup FROM (SELECT doc_id, line, count(*) AS times FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
cls AS (
  SELECT doc_id, lang, length(text) AS chars, unnest(['a-z', 'A-Z', '0-9', '\x20\x09-\x0D', '.,;:!?''"()\-', '\x{80}-\x{10FFFF}']) AS c, text FROM d),
seven AS (
  SELECT doc_id, lang, chars, c, chars - length(regexp_replace(text, '[' || c || ']', '', 'g')) AS k FROM cls
  UNION ALL
  SELECT doc_id, lang, chars, 'symbol', chars - sum(chars - length(regexp_replace(text, '[' || c || ']', '', 'g'))) FROM cls GROUP BY doc_id, lang, chars),
sizes AS (SELECT lang, count(*) AS size FROM w GROUP BY lang),
known AS (SELECT lang, size FROM sizes WHERE size >= 500),
refc AS (SELECT lang, c, sum(k) / sum(sum(k)) OVER (PARTITION BY lang) AS q FROM seven WHERE lang IN (SELECT lang FROM known) GROUP BY lang, c),
jc AS (
  SELECT s.doc_id, min(s.chars) AS chars, sum(CASE WHEN k > 0 THEN k / s.chars * log2(k / s.chars / ((k / s.chars + q) / 2)) ELSE 0 END) AS dp,
         sum(CASE WHEN q > 0 THEN q * log2(q / ((k / s.chars + q) / 2)) ELSE 0 END) AS dq
  FROM seven s JOIN refc r ON r.lang = s.lang AND r.c = s.c WHERE s.chars >= 200 GROUP BY s.doc_id),
low AS (SELECT doc_id, lang, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM w),
ranked AS (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM low GROUP BY lang, word),
top AS (SELECT t.lang, word, n / size AS q FROM ranked t JOIN known k ON k.lang = t.lang WHERE place <= 100),
own AS (
  SELECT doc_id, lang, coalesce(t.word, '') AS bin, count(*) AS k FROM (SELECT low.doc_id, low.lang, top.word FROM low LEFT JOIN top ON top.lang = low.lang AND top.word = low.word) t GROUP BY 1, 2, 3),
refw AS (SELECT lang, word AS bin, q FROM top UNION ALL SELECT lang, '', 1 - sum(q) FROM top GROUP BY lang),
jw AS (
  SELECT o.doc_id, min(n.n_words) AS n, sum(o.k / n.n_words * log2(o.k / n.n_words / ((o.k / n.n_words + r.q) / 2))) AS dp,
         sum(CASE WHEN r.q > 0 THEN r.q * log2(r.q / ((o.k / n.n_words + r.q) / 2)) ELSE 0 END) + 1 - sum(r.q) AS dq
  FROM own o JOIN n ON n.doc_id = o.doc_id JOIN refw r ON r.lang = o.lang AND r.bin = o.bin WHERE n.n_words >= 50 GROUP BY o.doc_id),
a AS (
  SELECT d.doc_id, coalesce(n.n_words, 0) AS n_words, coalesce(n.word_chars, 0) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n_dup, 0) AS n_dup_lines, coalesce(rep.n_repeat, 0) AS n_repeat_words,
         CASE WHEN jc.dp IS NOT NULL THEN sqrt(greatest(0, (jc.dp + jc.dq) / 2)) END AS by_class, jc.chars, CASE WHEN jw.dp IS NOT NULL THEN sqrt(greatest(0, (jw.dp + jw.dq) / 2)) END AS by_word
  FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id
  LEFT JOIN jc ON jc.doc_id = d.doc_id LEFT JOIN jw ON jw.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM a)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND NOT coalesce(by_class > 0.2 + 3 / sqrt(chars), false) AND NOT coalesce(by_word > 0.15 + 4 / sqrt(n_words), false) AS kept,
       round(by_class, 6) AS class_distance, round(by_word, 6) AS word_distance
FROM b""")
def op7_quality_rules(spark, sf_dir):
    out = quality.judge(spark, read_table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@query("op8_line_dedup", r"""
WITH l AS (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS line, unnest(range(0, len(str_split(text, chr(10))))) AS i,
         len(str_split(text, chr(10))) AS total FROM documents),
w AS (
  SELECT doc_id, i, total, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
f AS (
  SELECT doc_id, i, array_to_string(ws, ' ') AS norm, len(ws) AS n, row_number() OVER d - 1 AS k, coalesce(lead(i) OVER d, total) - 1 AS stop
  FROM w WHERE len(ws) > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS until, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS since FROM f),
p AS (
  SELECT a.doc_id, a.k AS first, b.k AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.until >= a.since + 50),
win AS (
  SELECT doc_id, first, min(last) AS last FROM p GROUP BY doc_id, first
  UNION SELECT doc_id, max(first), last FROM p GROUP BY doc_id, last),
t AS (
  SELECT win.doc_id, win.first, win.last, string_agg(c.norm, chr(10) ORDER BY c.k) AS content, min(c.i) AS a, max(c.stop) AS z
  FROM win JOIN c ON c.doc_id = win.doc_id AND c.k BETWEEN win.first AND win.last GROUP BY 1, 2, 3),
h AS (
  SELECT content, min(struct_pack(d := doc_id, a := a, z := z)) AS head FROM t GROUP BY content HAVING count(*) > 1),
g AS (
  SELECT t.doc_id, CASE WHEN t.doc_id = h.head.d THEN greatest(t.a, h.head.z + 1) ELSE t.a END AS a, t.z, h.head.d AS source
  FROM t JOIN h ON t.content = h.content WHERE NOT (t.doc_id = h.head.d AND t.a = h.head.a AND t.z = h.head.z)),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n FROM l
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND l.i BETWEEN g.a AND g.z) GROUP BY l.doc_id),
s AS (SELECT doc_id, min(source) AS first_source FROM g WHERE a <= z GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text,
       CAST(CASE WHEN s.doc_id IS NULL THEN 0 ELSE len(str_split(d.text, chr(10))) - coalesce(kept.n, 0) END AS INTEGER) AS removed_lines,
       s.first_source
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""")
def op8_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(spark, docs)
    return out.select("doc_id", "text", "removed_lines", F.array_min("copied_from").alias("first_source"))


@query("op9_mixing", r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at FROM w),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at)) AS target FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""")
def op9_mixing(spark, sf_dir):
    planned = mixing.plan_mix(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    doc_id, size, total, target, _, copies = planned.columns
    return planned.select("doc_id", F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(target).alias("target"),
                          (F.col(size) * F.col(copies)).alias("taken"))


@query("op10_lm_scoring")
def op10_lm_scoring(spark, sf_dir):
    import public_tokenizers
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return lm_scoring.score_documents(spark, read_table(spark, sf_dir, "documents"), ranks)


def _cluster_sql(k: int, rounds: int) -> str:
    """Plain rounds: every vector against every centroid."""
    parts = [f"""WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.e) AS e, min(struct_pack(d := list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.e, c.e)]), c := c.c)) AS near
  FROM v, c{i} c GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT c, list(s ORDER BY i) AS e FROM (
    SELECT c, i, floor(sum(x) / count(*)) AS s FROM (SELECT near.c AS c, unnest(e) AS x, unnest(range(0, 64)) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, near.c AS cluster, CAST(near.d AS BIGINT) AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS BIGINT) FOR x IN c.e], ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.near.c"""


@query("op11_centroids", _cluster_sql(8, 10))
def op11_centroids(spark, sf_dir):
    return centroids.cluster_vectors(spark, read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")


@query("op12_suffix_dedup", r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING count(*) > 1),
f AS (
  SELECT s.doc_id, s.i, s.i - lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS gap FROM s JOIN m ON s.g = m.g WHERE s.doc_id > m.least),
n AS (
  SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM f),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, span),
q AS (
  SELECT d.doc_id, p.a, p.z, substr(h, 2 * p.z + 1, 2 * (coalesce(lead(p.a) OVER (PARTITION BY d.doc_id ORDER BY p.a), length(h) // 2) - p.z)) AS behind,
         substr(h, 1, 2 * min(p.a) OVER (PARTITION BY d.doc_id)) AS before FROM p JOIN d ON d.doc_id = p.doc_id),
k AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, any_value(before) || string_agg(behind, '' ORDER BY a) AS kept FROM q GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id""")
def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.remove_repeats(spark, read_table(spark, sf_dir, "documents"), length=50))


@query("op13_filter_audit", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
f AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
k AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT f.part, concat(CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END,
         CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END,
         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN f.doc_id > least THEN 'E' ELSE '' END) AS fails,
         coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic FROM f LEFT JOIN k ON k.doc_id = f.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (
  SELECT part, fails, n, good, toxic, filter_order, least(
           CASE WHEN contains(fails, 'A') THEN instr(filter_order, 'A') ELSE 9 END, CASE WHEN contains(fails, 'B') THEN instr(filter_order, 'B') ELSE 9 END,
           CASE WHEN contains(fails, 'C') THEN instr(filter_order, 'C') ELSE 9 END, CASE WHEN contains(fails, 'D') THEN instr(filter_order, 'D') ELSE 9 END,
           CASE WHEN contains(fails, 'E') THEN instr(filter_order, 'E') ELSE 9 END) AS goes FROM c, o),
s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, sum(CASE WHEN goes > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN goes = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN goes < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN goes = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN goes = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM r, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s""")
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
