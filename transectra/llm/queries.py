"""The registered queries, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, interactions, jaccard, language, mixture, packing, pieces, quality, secrets, tokenfile, urls, variants, vectors
from .frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


def op9_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date: the table has none, so a page's number gives its day of one year."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(page_id % 365 as int))").alias("fetched"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries made of the pages' own hosts and paths, so that they grow with the table.

    Hashes of the patterns choose which are listed, when, for how long, and whether they
    come back later.
    """
    url = F.col("url")
    host = urls.host_of(url)
    parent = F.substring_index(host, ".", -3)
    first = F.concat(host, F.lit("/"), F.regexp_extract(url, "^[a-z]+://[^/?#]+/([^/?#]*)", 1))

    def listed(name: str, kind: str, pattern, below: str):
        return F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(below).alias("below"))

    each = F.array(listed("hosts", "host", host, "6"), listed("domains", "domain", parent, "4"), listed("paths", "prefix", first, "4"))
    seen = pages.select(F.explode(each).alias("e")).select("e.*").filter("pattern IS NOT NULL").distinct()
    code = F.md5(F.concat("list", "pattern").cast("binary"))
    day = F.conv(F.substring(code, 5, 4), 16, 10).cast("int") % 200
    span = F.conv(F.substring(code, 9, 4), 16, 10).cast("int") % 100 + 1

    def step(action: str, at):
        return F.struct(F.lit(action).alias("action"), at.alias("day"))

    steps = F.array(step("add", day), step("remove", day + span), F.when(F.substring(code, 13, 1) < "8", step("add", day + 2 * span)))
    chosen = seen.filter(F.substring(code, 1, 1) < F.col("below")).withColumn("s", F.explode(steps)).filter("s IS NOT NULL")
    return chosen.select("list", "kind", "pattern", "s.action", F.expr("date_add(DATE'2024-01-01', s.day)").alias("at"))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urls.judge(page_captures(pages), page_lists(pages))
    return found.select("page_id", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "blocked", "n_matches", "matched")


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.document_variants(table(spark, sf_dir, "documents"))


QUERIES.update({f.__name__: f for f in (
    op1_quality, op2_vectors, op3_language, op4_packing, op5_token_file, op6_secrets, op7_exact_dedup, op8_pieces, op9_similar,
    op10_url_lists, op11_interactions, op12_mixture, op13_variants)})

ORACLES["op7_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

ORACLES["op2_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""

ORACLES["op9_similar"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * o >= 75 * (zx.n + zy.n - o)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""

ORACLES["op10_url_lists"] = r"""
WITH u AS (
  SELECT page_id, url, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         DATE '2024-01-01' + (page_id % 365)::INT AS fetched
  FROM pages),
seen AS (
  SELECT DISTINCT unnest([
    {'list': 'hosts', 'kind': 'host', 'pattern': host, 'below': '6'},
    {'list': 'domains', 'kind': 'domain', 'pattern': array_to_string(list_slice(string_split(host, '.'), -3, -1), '.'), 'below': '4'},
    {'list': 'paths', 'kind': 'prefix', 'pattern': host || '/' || regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1), 'below': '4'}]) AS e
  FROM u WHERE host IS NOT NULL),
coded AS (SELECT e.list AS list, e.kind AS kind, e.pattern AS pattern, e.below AS below, md5(e.list || e.pattern) AS c FROM seen),
timed AS (SELECT list, kind, pattern, c, ('0x' || substr(c, 5, 4))::INT % 200 AS d, ('0x' || substr(c, 9, 4))::INT % 100 + 1 AS s
          FROM coded WHERE substr(c, 1, 1) < below),
active AS (
  SELECT list, kind, pattern, d AS a, d + s AS b FROM timed
  UNION ALL SELECT list, kind, pattern, d + 2 * s, 100000 FROM timed WHERE substr(c, 13, 1) < '8'),
parts AS (SELECT page_id, fetched, host, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments
          FROM u WHERE host IS NOT NULL),
keys AS (
  SELECT page_id, fetched, 'host' AS kind, host AS pattern FROM parts
  UNION ALL SELECT page_id, fetched, 'domain', array_to_string(list_slice(labels, i, len(labels)), '.')
            FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM parts)
  UNION ALL SELECT page_id, fetched, 'prefix', host || '/' || array_to_string(list_slice(segments, 1, i), '/')
            FROM (SELECT *, unnest(range(0, len(segments) + 1)) AS i FROM parts)),
hits AS (
  SELECT k.page_id, count(*) AS n, min(a.list || ':' || a.kind || ':' || a.pattern) AS m
  FROM keys k JOIN active a ON a.kind = k.kind AND a.pattern = k.pattern
       AND k.fetched - DATE '2024-01-01' >= a.a AND k.fetched - DATE '2024-01-01' < a.b
  GROUP BY k.page_id)
SELECT u.page_id, strftime(u.fetched, '%Y-%m-%d') AS fetched, h.n IS NOT NULL AS blocked, coalesce(h.n, 0) AS n_matches, h.m AS matched
FROM u LEFT JOIN hits h ON h.page_id = u.page_id
"""

ORACLES["op11_interactions"] = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails),
a(i, v) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq
      FROM a, a AS b, a AS c, a AS d, a AS e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
z AS (SELECT c.*, o.*, list_min(list_filter([1, 2, 3, 4, 5], lambda k: fails[seq[k]])) AS gone FROM c, o),
s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM z),
r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
         coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone < step AND fails[seq[step]]), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails[seq[step]] AND len(list_filter(fails, lambda b: b)) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (gone = step), 0)::BIGINT AS good_lost,
         coalesce(sum(x) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""

ORACLES["op12_mixture"] = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (
  SELECT a.source, a.source_size, a.weight,
         2 * sum(least(2 * b.source_size * a.weight, 2 * a.source_size * b.weight)) <= 3 * sum(b.source_size) * a.weight AS filled
  FROM w a, w b GROUP BY a.source, a.source_size, a.weight),
u AS (SELECT sum(source_size) AS total, sum(weight) AS weights, sum(CASE WHEN filled THEN 2 * source_size ELSE 0 END) AS taken,
             sum(CASE WHEN filled THEN weight ELSE 0 END) AS used FROM f),
t AS (SELECT source, source_size, CASE WHEN filled THEN (2 * source_size)::DOUBLE
             ELSE (weight * (3 * total - 2 * taken))::DOUBLE / (2 * (weights - used))::DOUBLE END AS target
      FROM f, u),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
