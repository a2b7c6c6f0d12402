"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import foldwise
from foldwise.llm import decontaminate, licenses, lm, media, mixing, neardup, quality, sharding, substring, wrappers
from foldwise.llm.base import table


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    found = substring.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_chunks", "n_repeated", "repeat_bytes", "dup_bytes", "kept_bytes", (F.col("repeat_bytes") > 0).alias("repeats"), "first_ids", "spans")


def op3_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    stored = media.to_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tensors = media.decoded(stored)
    return tensors.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb")


def op5_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    sharded = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return sharded.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_union_free_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    return wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tested = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return tested.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    foldwise.ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE k % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM s
), o AS (
  SELECT *, (coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3.0)::DOUBLE AS stopped,
    sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing,
    row_number() OVER (ORDER BY source_size / weight, source) AS place FROM w
), f AS (
  SELECT *, min(CASE WHEN (total - stopped) * weight / sharing < source_size * 3.0::DOUBLE THEN place END) OVER () AS free FROM o
), t AS (
  SELECT f.source, f.source_size, CASE WHEN f.place >= f.free THEN (g.total - g.stopped) * f.weight / g.sharing ELSE f.source_size * 3.0::DOUBLE END AS target
  FROM f LEFT JOIN f g ON g.place = f.free
), c AS (
  SELECT source, length(bin(size + 1)) - 1 AS class, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), r AS (
  SELECT c.source, class, source_size, target,
    coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavier,
    sum(words * (class + 8)::DOUBLE) OVER (PARTITION BY c.source ORDER BY class) AS mass
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT source, source_size, target, class, CASE WHEN mass > 0 THEN (target - 3.0::DOUBLE * heavier) / mass ELSE 0.0::DOUBLE END AS rate FROM r
), p AS (
  SELECT source, any_value(source_size) AS source_size, any_value(target) AS target,
    coalesce(max_by(rate, CASE WHEN rate * (class + 8)::DOUBLE <= 3.0::DOUBLE * (1 + 1e-12::DOUBLE) THEN class END), min_by(rate, class)) AS rate
  FROM q GROUP BY source
), e AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, greatest(0.0::DOUBLE, least(3.0::DOUBLE, p.rate * (length(bin(d.size + 1)) + 7)::DOUBLE)) AS expected,
    (('0x' || substr(md5('7|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), x AS (
  SELECT *, floor(expected + 1e-9::DOUBLE) AS whole, CASE WHEN expected - floor(expected + 1e-9::DOUBLE) > 1e-9::DOUBLE THEN expected - floor(expected + 1e-9::DOUBLE) ELSE 0 END AS part FROM e
), y AS (
  SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rank, target - sum(size * whole) OVER (PARTITION BY source) AS open FROM x
), z AS (
  SELECT *, CASE WHEN part > 0 THEN sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size) END AS run FROM y
), a AS (
  SELECT *, coalesce(run <= open, false) AS drawn, open - coalesce(max(CASE WHEN run <= open THEN run END) OVER (PARTITION BY source), 0) AS lacking FROM z
), b AS (
  SELECT *, CASE WHEN part > 0 AND NOT drawn AND abs(size - lacking) < lacking
    THEN row_number() OVER (PARTITION BY source ORDER BY CASE WHEN part > 0 AND NOT drawn AND abs(size - lacking) < lacking THEN 0 ELSE 1 END, abs(size - lacking), rank, doc_id) = 1 ELSE false END AS extra FROM a
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + (drawn OR extra)::INT))::BIGINT AS taken, (whole + (drawn OR extra)::INT)::BIGINT AS copies FROM b
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT item, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k, w FROM i WHERE len(w) > 0
), v AS (
  SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM p
), l AS (SELECT DISTINCT n FROM v
), g AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, l WHERE len(w) >= n
), h AS (
  SELECT g.r, g.k, g.n, v.item FROM g JOIN v ON g.n = v.n AND array_to_string(g.w[g.k:g.k + g.n - 1], ' ') = v.gram
), n AS (
  SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS spot FROM h) GROUP BY r
), m AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""


def _op9_sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    known = ", ".join(f"({i}, '{label}', {str(exact).lower()}, {k}, '{' '.join(words)}')" for i, label, exact, k, words in licenses.known_templates())
    near, slack = licenses.NEAR_DIAGONALS, licenses.SLACK
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), t(template, label, exact, k, words) AS (VALUES {known}
), tp AS (
  SELECT template, label, exact, k, string_split(words, ' ') AS words, len(string_split(words, ' ')) AS n, unnest(range(0, len(string_split(words, ' ')) - k + 1)) AS t_pos FROM t
), tg AS (
  SELECT template, label, exact, k, n, n - k + 1 AS whole, t_pos, array_to_string(words[t_pos + 1:t_pos + k], ' ') AS gram FROM tp
), p AS (
  SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM t)
), g AS (
  SELECT r, k, pos, array_to_string(w[pos + 1:pos + k], ' ') AS gram FROM p
), diagonals AS (
  SELECT r, template, label, exact, g.k, n, whole, pos - t_pos AS diagonal, count(DISTINCT t_pos) AS hits, min(pos) AS first, max(pos) AS last FROM g JOIN tg ON g.k = tg.k AND g.gram = tg.gram GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) > {near} OR first - lag(last) OVER o > n OR lag(last) OVER o IS NULL THEN 1 ELSE 0 END AS apart
  FROM diagonals WHERE NOT exact AND hits < whole WINDOW o AS (PARTITION BY r, template ORDER BY first, diagonal)
), islands AS (
  SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY first, diagonal) AS island FROM marked
), merged AS (
  SELECT r, label, min(first) AS begin_, max(last) - min(first) + k AS length_, n, least(1.0::DOUBLE, sum(hits)::DOUBLE / whole) AS share FROM islands GROUP BY r, template, label, k, n, whole, island
), found AS (
  SELECT r, label, exact, diagonal AS begin_, 1.0::DOUBLE AS share FROM diagonals WHERE hits = whole
  UNION ALL SELECT r, label, false AS exact, begin_, share FROM merged WHERE share >= 0.6::DOUBLE AND length_ <= n + greatest({2 * near}, n // {slack})
), s AS (
  SELECT r, count(*) FILTER (exact) AS n_base, min(begin_) FILTER (exact) AS first_word, max(begin_) FILTER (exact) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN s USING (r)
"""


def _op10_sql() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT r, gram FROM (SELECT r, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS k FROM d WHERE len(w) > 0))
), n AS (
  SELECT r, count(*) AS size FROM g GROUP BY r
), p AS (
  SELECT a.r AS a, b.r AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY a.r, b.r
), e AS (
  SELECT a, b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * common >= 85 * (x.size + y.size - common)
), reached AS (
  SELECT r AS a, r AS b FROM n UNION SELECT reached.a, e.b FROM reached JOIN e ON e.a = reached.b
), c AS (
  SELECT reached.a AS r, min(d.doc_id) AS component_id FROM reached JOIN d ON d.r = reached.b GROUP BY reached.a
), every AS (
  SELECT doc_id, r FROM d UNION ALL SELECT doc_id, NULL AS r FROM documents WHERE text IS NULL
)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM every LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_pareto_mixing, op2_gear_chunks, op3_crf_quality, op4_progressive_jpeg, op5_hypergeometric_sharding, op6_union_free_wrappers, op7_bloom_lm, op8_aho_corasick, op9_diagonal_voting, op10_bayes_minhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_pareto_mixing": OP1_SQL, "op8_aho_corasick": OP8_SQL, "op9_diagonal_voting": _op9_sql(), "op10_bayes_minhash": _op10_sql()}
