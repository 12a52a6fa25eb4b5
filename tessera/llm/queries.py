"""The registered queries of this subpackage and their DuckDB statements.

Each query applies its operator with production parameters to the whole of its
table and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum_mix, decontaminate, embed_dedup, jaccard_join, language_id, line_dedup, minimax_shards, quality_nbsvm, secret_scan, url_equivalence
from .language_id import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("match")).select("doc_id", "match.*")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, ranks=secret_scan.ranked_words(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: the spans of the fixed patterns, without those of the method."""
    return secret_scan.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_mix.mix_sources(_table(spark, sf_dir, "documents"))
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(float("inf")))  # what is not taken comes last
    return mixed.orderBy(first, "doc_id").select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("times"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = minimax_shards.shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_equivalence.classify_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~held_out()))
    return language_id.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_nbsvm.train(docs, _table(spark, sf_dir, "labels").filter(~held_out()))
    scored = quality_nbsvm.score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality_nbsvm.THRESHOLD).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_secret_scan, op3_curriculum_mix, op4_line_dedup, op5_jaccard_join, op6_embed_dedup, op7_minimax_shards, op8_url_equivalence, op9_language_id, op10_quality_nbsvm, secret_base_spans)}


_OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size,
         COALESCE(md5(CAST(doc_id AS VARCHAR)), '') AS turn
  FROM documents
), sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         ROW_NUMBER() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap, (SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM sources
), filled AS (
  SELECT *, COALESCE(SUM(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS held_before,
         SUM(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed
), flagged AS (
  SELECT *, cap / weight <= (budget - held_before) / weight_left AS held FROM filled
), targets AS (
  SELECT source, source_size,
         CASE WHEN held THEN cap ELSE
           (budget - SUM(CASE WHEN held THEN cap ELSE 0.0::DOUBLE END) OVER ()) / SUM(CASE WHEN held THEN 0.0::DOUBLE ELSE weight END) OVER () * weight
         END AS target
  FROM flagged
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, first_taken + second_taken AS taken, CAST(first_taken > 0 AS INT) + CAST(second_taken > 0 AS INT) AS times
FROM (SELECT *, GREATEST(0, LEAST(size, CAST(FLOOR(target) AS BIGINT) - ahead)) AS first_taken,
             GREATEST(0, LEAST(size, CAST(FLOOR(target) AS BIGINT) - ahead - source_size)) AS second_taken FROM placed)
"""

_OP8 = r"""
WITH parsed AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, html,
         COALESCE(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parsed
), rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, url, rule_host || rule_path AS rule, action,
         ROW_NUMBER() OVER (PARTITION BY page_id, url ORDER BY length(rule_host || rule_path) DESC, action) AS place
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), judged AS (
  SELECT s.page_id, s.url, s.html, s.host, s.path, f.rule, f.action,
         regexp_replace(s.host, '^www\.', '') || regexp_replace(s.path, '/+$', '') AS base,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(s.url, '\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'gi'), '&{2,}', '&', 'g'), '^&|&$', '', 'g') AS query
  FROM split s LEFT JOIN fits f ON s.page_id IS NOT DISTINCT FROM f.page_id AND s.url = f.url AND f.place = 1
), nodes AS (
  SELECT *, CASE WHEN strpos(url, '://') > 0 THEN base || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS node FROM judged
), links AS (
  SELECT node, host, regexp_extract(url, '^([^:/?#]+)://', 1) AS scheme, COALESCE(NULLIF(regexp_extract(path, '^(.*/)?'), ''), '/') AS folder,
         unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1),
                 regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*[''"]?([^"''>\s]+)', 1)]) AS link
  FROM nodes WHERE node IS NOT NULL
), targets AS (
  SELECT node, CASE WHEN strpos(link, '://') > 0 THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
                    WHEN starts_with(link, '/') THEN scheme || '://' || host || link ELSE scheme || '://' || host || folder || link END AS target
  FROM (SELECT node, scheme, host, folder, replace(link, '&amp;', '&') AS link FROM links) WHERE link <> ''
), edges AS (
  SELECT node, regexp_replace(lower(regexp_extract(target, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(target, '://[^/?#]*([^?#]*)', 1), '/+$', '')
         || CASE WHEN q = '' THEN '' ELSE '?' || q END AS other
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(target, '\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'gi'), '&{2,}', '&', 'g'), '^&|&$', '', 'g') AS q FROM targets)
), both_ways AS (
  SELECT node AS a, other AS b FROM edges UNION SELECT other, node FROM edges
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM (SELECT a, b FROM reach) r JOIN both_ways e ON r.b = e.a
), classes AS (
  SELECT a AS node, LEAST(a, MIN(b)) AS class FROM reach GROUP BY a
), classed AS (
  SELECT n.*, COALESCE(c.class, n.node) AS class FROM nodes n LEFT JOIN classes c ON n.node = c.node
), status AS (
  SELECT class, bool_or(action = 'allow') AS allowed, bool_or(action = 'block') AS blocked FROM classed WHERE action IS NOT NULL GROUP BY class
)
SELECT page_id, host, path, rule,
       COALESCE(action, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM classed LEFT JOIN status ON classed.class = status.class
"""


_OP4 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(COALESCE(text, ''), chr(10))) AS line, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owners AS (
  SELECT key, MIN(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.place, k.line, COALESCE(o.owner <> k.doc_id, FALSE) AS gone FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, COUNT(*) AS n_lines, CAST(COUNT(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


_OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, GREATEST(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places
), sizes AS (
  SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id
), shared_counts AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT o.a, o.b FROM shared_counts o JOIN sizes x ON o.a = x.doc_id JOIN sizes y ON o.b = y.doc_id WHERE 100 * o.common >= 75 * (x.n + y.n - o.common)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, MIN(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, COALESCE(s.n, 0) AS n_shingles, LEAST(d.doc_id, COALESCE(l.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least l ON d.doc_id = l.a
"""

_OP6 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
  SELECT vec_id, v FROM vectors
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), found AS (
  SELECT v.vec_id, (SELECT COUNT(*) FROM links WHERE a = v.vec_id) AS n_links, LEAST(v.vec_id, COALESCE((SELECT MIN(b) FROM reach WHERE a = v.vec_id), v.vec_id)) AS component_id
  FROM vectors v
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""


_SECRETS = r"""
WITH RECURSIVE assigns(doc_id, rest, ahead, found) AS (
  SELECT doc_id, text, CAST(0 AS BIGINT), regexp_extract(text, 'ASSIGN') FROM documents WHERE regexp_matches(text, 'ASSIGN')
  UNION ALL
  SELECT doc_id, substr(rest, strpos(rest, found) + length(found)), ahead + strpos(rest, found) - 1 + length(found),
         regexp_extract(substr(rest, strpos(rest, found) + length(found)), 'ASSIGN')
  FROM assigns WHERE found <> ''
), assign_spans AS (
  SELECT doc_id, ahead + strpos(rest, found) - 1 AS a, ahead + strpos(rest, found) - 1 + length(found) AS b FROM assigns
  WHERE found <> '' AND length(regexp_extract(found, 'ASSIGN', 2)) >= 8
), accesses(doc_id, rest, ahead, found) AS (
  SELECT doc_id, text, CAST(0 AS BIGINT), regexp_extract(text, 'AKIA[A-Z0-9]{12,}') FROM documents WHERE regexp_matches(text, 'AKIA[A-Z0-9]{12,}')
  UNION ALL
  SELECT doc_id, substr(rest, strpos(rest, found) + length(found)), ahead + strpos(rest, found) - 1 + length(found), regexp_extract(substr(rest, strpos(rest, found) + length(found)), 'AKIA[A-Z0-9]{12,}')
  FROM accesses WHERE found <> ''
), hexes(doc_id, rest, ahead, found) AS (
  SELECT doc_id, text, CAST(0 AS BIGINT), regexp_extract(text, '[0-9a-f]{32,}') FROM documents WHERE regexp_matches(text, '[0-9a-f]{32,}')
  UNION ALL
  SELECT doc_id, substr(rest, strpos(rest, found) + length(found)), ahead + strpos(rest, found) - 1 + length(found), regexp_extract(substr(rest, strpos(rest, found) + length(found)), '[0-9a-f]{32,}')
  FROM hexes WHERE found <> ''
), spans AS (
  SELECT doc_id, 0 AS k, 'assign' AS kind, a, b FROM assign_spans
  UNION ALL SELECT doc_id, 1, 'access', ahead + strpos(rest, found) - 1, ahead + strpos(rest, found) - 1 + length(found) FROM accesses WHERE found <> ''
  UNION ALL SELECT doc_id, 2, 'hex', ahead + strpos(rest, found) - 1, ahead + strpos(rest, found) - 1 + length(found) FROM hexes WHERE found <> ''
), joined AS (
  SELECT doc_id, COUNT(*) FILTER (k = 0) AS n0, COUNT(*) FILTER (k = 1) AS n1, COUNT(*) FILTER (k = 2) AS n2, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS written
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(n0, 0) AS n_assign, COALESCE(n1, 0) AS n_access, COALESCE(n2, 0) AS n_hex, sha256(COALESCE(written, '')) AS base_sha256
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
""".replace("ASSIGN", "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")


def oracle_sql() -> dict[str, str]:
    return {"secret_base_spans": _SECRETS, "op5_jaccard_join": _OP5, "op6_embed_dedup": _OP6, "op4_line_dedup": _OP4, "op3_curriculum_mix": _OP3, "op8_url_equivalence": "WITH RECURSIVE" + _OP8.lstrip().removeprefix("WITH")}
