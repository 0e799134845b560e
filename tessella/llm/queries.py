"""The numbered queries and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontamination, embedding_dedup, hard_negatives, html_extraction, language, line_dedup, mixing, near_duplicates, nearest, pii, quality, spelling, substring_dedup

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark, sf_dir):
    return html_extraction.extract_main_text(_t(spark, sf_dir, "pages"))


def op2_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicate_groups(_t(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(_t(spark, sf_dir, "documents")))


def op4_quality_classifier(spark, sf_dir):
    return quality.digest(quality.classify(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.dedup_lines(_t(spark, sf_dir, "documents")))


def op6_benchmark_decontamination(spark, sf_dir):
    return decontamination.digest(decontamination.decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.dedup_substrings(_t(spark, sf_dir, "documents")))


def op8_language_id(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return language.digest(language.identify(docs, language.learn_profiles(docs)))


def op9_exact_top_k(spark, sf_dir):
    return nearest.top_k(nearest.integer_vectors(_t(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


def op10_mix_sources(spark, sf_dir):
    return mixing.mix(_t(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(_t(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_embeddings(_t(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(hard_negatives.labelled_vectors(_t(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_near_duplicates, op3_pii, op4_quality_classifier, op5_line_dedup, op6_benchmark_decontamination, op7_substring_dedup, op8_language_id, op9_exact_top_k, op10_mix_sources, op11_spelling_variants, op12_embedding_near_dedup, op13_hard_negatives, pipeline)}

#: RE2 spells of the patterns: the same matches without possessive repeats and look-behinds.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"(?:token|secret|password|passwd|api_key|apikey)[\x22\x27]?[ ]{0,2}[=:][ ]{0,2}[\x22\x27]?[A-Za-z0-9_/+.-]{16,}",
}
_DIG = "regexp_replace(v, '[^0-9]', '', 'g')"
_ALONE = "NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(a, '^[A-Za-z0-9]')"
_PII_CHECK = f"""CASE kind WHEN 'email' THEN true
WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: NOT regexp_matches(regexp_replace(p, '^0+', ''), '^([0-9]{{0,2}}|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])$'))) = 0
WHEN 'card' THEN length({_DIG}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIG}) + 1), lambda i:
  CASE WHEN (length({_DIG}) - i) % 2 = 0 THEN ascii({_DIG}[i]) - 48 ELSE (ascii({_DIG}[i]) - 48) * 2 - CASE WHEN ascii({_DIG}[i]) >= 53 THEN 9 ELSE 0 END END)) % 10 = 0
WHEN 'phone' THEN length({_DIG}) BETWEEN 10 AND 15
WHEN 'iban' THEN {_ALONE} AND list_reduce(list_prepend(0, list_transform(string_split(v[5:] || v[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda r, c: CASE WHEN c < 10 THEN (r * 10 + c) % 97 ELSE (r * 100 + c) % 97 END) = 1
WHEN 'ssn' THEN {_ALONE} AND NOT regexp_matches(v, '^(000|666|9)') AND NOT regexp_matches(v, '-00-') AND NOT regexp_matches(v, '0000$')
  AND regexp_matches(lower(t[greatest(1, st - 39):st]), 'ssn|social|security|tax')
ELSE true END"""

ORACLE = {
    "op2_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(3, len(ws)) - 1], chr(10)) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(doc_id, o) AS (SELECT u, u FROM e UNION SELECT e.v, r.o FROM r JOIN e ON e.u = r.doc_id),
c AS (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.o, w.doc_id) AS component_id, coalesce(c.o, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op3_pii": "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(
        f"SELECT r, t, {i} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS vs, regexp_split_to_array(t, '{p}') AS ps FROM d" for i, (kind, p) in enumerate(_PII.items())
    )
    + f"""),
u AS (SELECT r, t, k, kind, vs[i] AS v, ps[i] AS b, ps[i + 1] AS a, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st
      FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM m WHERE len(vs) > 0)),
s AS (SELECT r, k, kind, CASE WHEN kind = 'secret' THEN st + length(v) - length(regexp_extract(v, '[A-Za-z0-9_/+.-]{{16,}}$')) ELSE st END AS st, st + length(v) AS en FROM u WHERE {_PII_CHECK}),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
      string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) FILTER (k < 4) AS base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""",
    "op6_benchmark_decontamination": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS s
        FROM (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
ks AS (SELECT DISTINCT k FROM win),
g AS (SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS s
      FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w CROSS JOIN ks WHERE len(words) >= k)),
hits AS (SELECT doc_id, g.k, i, item_id FROM g JOIN win ON g.k = win.k AND g.s = win.s),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_exact_top_k": """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_mix_sources": """
WITH RECURSIVE n AS (SELECT source, count(*) AS n, greatest(1, CAST(round(sqrt(count(*)) * 1000000) AS HUGEINT)) AS a FROM documents GROUP BY source),
sh AS (SELECT source, a, (n + 15) // 16 AS blocks, row_number() OVER (ORDER BY coalesce(source, ''), source IS NULL) AS s, CAST(sum(a) OVER () AS HUGEINT) AS total FROM n),
g AS (SELECT list(a ORDER BY s) AS a, list(blocks ORDER BY s) AS blocks, max(total) AS total, max((blocks * total + a - 1) // a) AS last FROM sh),
edf(t, got, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM g
  UNION ALL
  SELECT t, list_transform(got, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT edf.t + 1 AS t, got, CAST(list_min(list_filter(list_transform(got, lambda x, i: CASE WHEN x < blocks[i] AND x * total // a[i] <= edf.t + 1
      THEN {'d': ((x + 1) * total + a[i] - 1) // a[i], 's': i} END), lambda y: y IS NOT NULL)).s AS BIGINT) AS p
    FROM edf, g WHERE edf.t + 1 < last)),
k AS (SELECT pick AS s, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM edf WHERE t >= 0 AND pick IS NOT NULL),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix:' || CAST(doc_id AS VARCHAR))) - 1 AS r FROM documents)
SELECT doc_id, d.source, k.slot, CAST(r % 16 AS INTEGER) AS slot_row
FROM d JOIN sh ON sh.source IS NOT DISTINCT FROM d.source JOIN k ON k.s = sh.s AND k.k = r // 16""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT id, run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM o),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tb),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(k) >= 3 AND length(word) >= 5),
d AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS u, b.word AS v FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.word <> b.word UNION ALL SELECT DISTINCT d.word, w.word FROM d JOIN w ON w.word = d.s UNION ALL SELECT DISTINCT w.word, d.word FROM d JOIN w ON w.word = d.s),
m AS (SELECT u, v, w.n, row_number() OVER (PARTITION BY u ORDER BY w.n DESC, v) AS r, count(*) OVER (PARTITION BY u) AS near FROM p JOIN w ON w.word = v),
f AS (SELECT word, CASE WHEN m.n >= 2 * w.n THEN v END AS form, w.n, CAST(coalesce(near, 0) AS BIGINT) AS n_near, CASE WHEN m.n >= 2 * w.n THEN m.n END AS form_n FROM w LEFT JOIN m ON m.u = word AND r = 1),
t AS (SELECT word, word AS cur, form AS nxt FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.nxt)
SELECT f.word, f.form, t.cur AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.nxt IS NULL""",
    "op12_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
r(vec_id, o) AS (SELECT u, u FROM l UNION SELECT l.v, r.o FROM r JOIN l ON l.u = r.vec_id),
c AS (SELECT vec_id, min(o) AS o FROM r GROUP BY 1), n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT i.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.o, i.vec_id) AS component_id, coalesce(c.o, i.vec_id) = i.vec_id AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) i LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op13_hard_negatives": """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
