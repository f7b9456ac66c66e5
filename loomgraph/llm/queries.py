"""The queries opN_<name> over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat_format, decontaminate, language_id, near_dedup, secret_scan, source_mixing, substring_dedup, suffix_dedup, topk_search, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold() -> Column:
    """crc32 of doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"), window=35)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(_table(spark, sf_dir, "documents"), length=400, digest_only=True)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_table(spark, sf_dir, "documents"), max_epochs=4.0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs, fold() != 0))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold() != 0, window_words=toxicity.WORST_WINDOW)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_secret_scan, op3_near_dedup, op4_substring_dedup, op5_suffix_dedup, op6_source_mixing, op7_language_id, op8_toxicity, op9_chat_format, op10_decontamination, pipeline)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

_OP2_RULES = (
    ("assign", """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    ("git_token", "gh[opsru]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 0),
)


def _op2() -> str:
    """Matches are marked with two characters of the private use area, and places counted in the pieces between them."""
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{kind}' AS kind, '{pattern}' AS re, {group} AS least_of, {least} AS least, string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS p FROM d"
        for k, (kind, pattern, group, least) in enumerate(_OP2_RULES)
    )
    lengths = " ".join(f"WHEN {k} THEN length(regexp_extract(m, '{pattern}', {group})) >= {least}" for k, (_, pattern, group, least) in enumerate(_OP2_RULES))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), marked AS (
  {found}
), pieces AS (
  SELECT r, k, kind, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM marked WHERE len(p) > 1
), placed AS (
  SELECT *, split_part(x, chr(57345), 1) AS m,
    sum(length(x) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a
  FROM pieces
), spans AS (
  SELECT r, k, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(m) AS BIGINT) AS s FROM placed WHERE i > 1 AND CASE k {lengths} END
), joined AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(s, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(s, ',' ORDER BY a, k) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""


_OP3 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), hits AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM hits JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), e AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r
), c AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP4 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p
), r AS (
  SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r
), lost AS (
  SELECT doc_id, list(j) AS js, count(*) AS n_removed FROM gone GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP5 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), p AS (
  SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400
), g AS (
  SELECT r, i, md5_number(array_slice(b, i, i + 399)) AS h FROM p
), hits AS (
  SELECT r, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)
), opened AS (
  SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS fresh FROM hits
), numbered AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM opened
), spans AS (
  SELECT r, min(i) AS a, max(i) + 400 AS z FROM numbered GROUP BY r, k
), cuts AS (
  SELECT r, a, z, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM spans
), left_over AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed,
    CASE WHEN min(a) > 1 THEN hex(array_slice(any_value(b), 1, min(a) - 1)) ELSE '' END
    || string_agg(CASE WHEN z < coalesce(next, octet_length(b) + 1) THEN hex(array_slice(b, z, coalesce(next, octet_length(b) + 1) - 1)) ELSE '' END, '' ORDER BY a) AS kept
  FROM cuts JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""

_OP6 = """
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents
), sizes AS (
  SELECT source, sum(tokens) AS n, count(*) AS n_docs FROM t GROUP BY source
), whole AS (
  SELECT sum(n) AS total, max(n) AS largest, min(n) FILTER (n > 0) AS least, count(*) FILTER (n > 0) AS k FROM sizes
), heat AS (
  SELECT *, CASE WHEN total = 0 OR k < 2 THEN 1.0 WHEN largest = least THEN 0.0 ELSE greatest(0.0, 1 - ln(4) / ln(largest / least)) END AS alpha FROM whole
), budgets AS (
  SELECT source, n, CAST(ceil(sqrt(n_docs)) AS BIGINT) AS n_blocks,
    CASE WHEN n > 0 THEN greatest(CAST(round(exp(alpha * ln(n / total)) * total * exp((1 - alpha) * ln(largest / total))) AS BIGINT), n) ELSE 0 END AS budget
  FROM sizes, heat
), dealt AS (
  SELECT t.*, n, budget, CAST('0x' || substr(md5('block|' || coalesce(doc_id, 0) || '|0'), 1, 12) AS BIGINT) % n_blocks AS b
  FROM t JOIN budgets ON t.source IS NOT DISTINCT FROM budgets.source
), blocks AS (
  SELECT source, b, row_number() OVER w AS block, sum(sum(tokens)) OVER (w ROWS UNBOUNDED PRECEDING) - sum(tokens) AS ahead
  FROM dealt GROUP BY source, b WINDOW w AS (PARTITION BY source ORDER BY md5('order|' || b || '|0'), b)
), placed AS (
  SELECT *, row_number() OVER w AS place, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) - tokens AS before
  FROM dealt WINDOW w AS (PARTITION BY source, b ORDER BY md5(concat_ws('|', 'doc', doc_id, '0')), doc_id NULLS FIRST, tokens)
), timed AS (
  SELECT p.doc_id, p.source, p.tokens, block, place, CASE WHEN n > 0 THEN budget // n ELSE 1 END
    + CASE WHEN p.tokens > 0 AND before + ahead < budget - budget // n * n THEN 1 ELSE 0 END AS times
  FROM placed p JOIN blocks q ON p.source IS NOT DISTINCT FROM q.source AND p.b = q.b
)
SELECT doc_id, source, tokens, CAST(unnest(range(CAST(times AS BIGINT))) AS INTEGER) AS epoch, block, place FROM timed
"""

_OP9 = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), o AS (
  SELECT *, md5(length(role) || ':' || role || text) AS h FROM t
), r AS (
  SELECT *, row_number() OVER w AS k, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn, h)
), ends AS (
  SELECT conv_id, max(k) AS n, arg_max(upto, k) AS body FROM r GROUP BY conv_id
), uniq AS (
  SELECT body, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM ends GROUP BY body, n
), proper AS (
  SELECT DISTINCT r.upto FROM r JOIN ends USING (conv_id) WHERE r.k < ends.n
), kept AS (
  SELECT conv_id, n AS n_turns, n_copies FROM uniq WHERE body NOT IN (SELECT upto FROM proper)
)
SELECT conv_id, n_turns, n_copies, (k - 1) // 256 AS part,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM r JOIN kept USING (conv_id) GROUP BY ALL
"""

_OP10 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM win
), spots AS (
  SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN sizes ON len(w) >= k
), hit AS (
  SELECT doc_id, i, spots.k, item FROM spots JOIN win ON win.k = spots.k AND win.g = array_to_string(w[i:i + spots.k - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) + CAST(max(item IS NULL) AS INT) AS n_items, array_to_string(list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)), ',') AS names FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("{lower}", _LOWER)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute force or held-out accuracy."""
    return {"op1_topk_search": _OP1, "op2_secret_scan": _op2(), "op3_near_dedup": _OP3, "op4_substring_dedup": _OP4, "op5_suffix_dedup": _OP5, "op6_source_mixing": _OP6, "op9_chat_format": _OP9, "op10_decontamination": _OP10}
