"""The registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfair.llm import (
    context_tree,
    divergence,
    filters,
    fingerprint,
    jaccard,
    lines,
    mixing,
    passages,
    quality,
    sentencepieces,
    suffixes,
    vectors,
    warc,
)
from counterfair.llm.common import ORACLES, QUERIES, query, read  # noqa: F401

SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX_WEIGHTS = {"src0": 30} | {f"src{i}": 3 + i % 2 for i in range(1, 20)} | {mixing.OTHER: 1}
MIX_BLOCK = 32
_WEIGHT_ROWS = ", ".join(f"('{k}', {v})" for k, v in MIX_WEIGHTS.items())

MIX_SQL = f"""WITH RECURSIVE weights(cls, w) AS (VALUES {_WEIGHT_ROWS}),
named AS (
  SELECT doc_id, source, CASE WHEN source IN (SELECT cls FROM weights WHERE cls <> '*') THEN source ELSE '*' END AS cls
  FROM documents),
sizes AS (SELECT cls, w, count(*) AS n, (count(*) + {MIX_BLOCK - 1}) // {MIX_BLOCK} AS m
  FROM named JOIN weights USING (cls) GROUP BY cls, w),
total AS (SELECT CAST(sum(w) AS BIGINT) AS q FROM sizes),
windows AS (
  SELECT cls, w, q, i, (i * q) // w AS release, ((i + 1) * q + w - 1) // w AS due
  FROM sizes, total, LATERAL (SELECT unnest(range(CAST(w AS BIGINT))) AS i)),
frame(t, done, cls, k) AS (
  SELECT CAST(-1 AS BIGINT), MAP(list(cls ORDER BY cls), list(CAST(0 AS BIGINT) ORDER BY cls)), NULL::VARCHAR, NULL::BIGINT
  FROM sizes
  UNION ALL
  SELECT f.t + 1, map_from_entries(list_transform(map_entries(f.done),
      lambda e: {{'k': e.key, 'v': e.value + CASE WHEN e.key = p.cls THEN 1 ELSE 0 END}})), p.cls, p.i
  FROM frame f, total, LATERAL (
    SELECT arg_min(wi.cls, (wi.due, wi.cls)) AS cls, arg_min(wi.i, (wi.due, wi.cls)) AS i FROM windows wi
    WHERE wi.i = f.done[wi.cls] AND wi.release <= f.t + 1) p
  WHERE f.t + 1 < total.q),
slots AS (SELECT cls, k, t AS slot FROM frame WHERE t >= 0),
final AS (
  SELECT max(((m - 1) // w) * q + slot + 1) AS t_end
  FROM sizes JOIN slots USING (cls), total WHERE k = (m - 1) % w),
owned AS (
  SELECT s.cls, s.w, s.m, q, CAST((t_end // q) * s.w
    + (SELECT count(*) FROM slots x WHERE x.cls = s.cls AND x.slot < t_end % q) AS BIGINT) AS blocks
  FROM sizes s, total, final),
ranked AS (
  SELECT doc_id, source, cls, row_number() OVER (PARTITION BY cls ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r
  FROM named),
shown AS (
  SELECT r.*, r.r // {MIX_BLOCK} AS block, o.w, o.m, o.q, unnest(range((o.blocks - 1 - r.r // {MIX_BLOCK}) // o.m + 1)) AS epoch
  FROM ranked r JOIN owned o USING (cls))
SELECT doc_id, source, block, epoch, ((block + epoch * m) // w) * q + slot AS slot,
  (((block + epoch * m) // w) * q + slot) * {MIX_BLOCK} + r % {MIX_BLOCK} AS position
FROM shown JOIN slots USING (cls) WHERE slots.k = (block + epoch * m) % w"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mixing.mix(docs, MIX_WEIGHTS, block_rows=MIX_BLOCK)
    return mixed.select("row.doc_id", "row.source", "block", "epoch", "slot", "position")


WARC_SQL = """WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM o"""


@query("op2_warc_archive", WARC_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(read(spark, sf_dir, "pages"), min_bytes=1000)
    records = warc.read(index, payload=False)
    return records.select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


LINES_SQL = f"""WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, {LOWER_SQL.format(f"trim(line, {SPACE_SQL})")} AS key FROM l),
shared AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keep IS NOT NULL AND keep <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN shared USING (key) GROUP BY doc_id"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.line_dedup(docs, min_chars=40, min_docs=5)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_versions(read(spark, sf_dir, "documents"))


@query("op10_sentencepieces")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(read(spark, sf_dir, "documents"))


KEEP_SCORE = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Trees:
    """Trees for ``labels.quality``, learned from the rows that are not held out."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.train(docs.select("doc_id", "text"), labels.where(quality.is_training(F.col("doc_id"))))


@query("op4_quality_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select(
        "row.doc_id",
        (~quality.is_training(F.col("row.doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )


@query("op9_jaccard_classes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


@query("op5_shared_passages")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(read(spark, sf_dir, "documents"))


VECTORS_SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id"""


@query("op7_near_vectors", VECTORS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op3_context_tree_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(read(spark, sf_dir, "documents"))


FAILURES = {
    "A": filters.few_words(200),
    "B": filters.repeated_words(50),
    "C": filters.many_capitals(3),
    "D": filters.holds("[#$%&*|]"),
}
AUDIT_SQL = r"""WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS fails
  FROM w LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM m GROUP BY part, fails),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS state
  FROM orders, range(1, 6) r(step)),
audit AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (fails & (state | bit) = 0) AS kept,
    sum(n) FILTER (fails & state = 0 AND fails & bit <> 0) AS removed,
    sum(n) FILTER (fails & state <> 0 AND fails & bit <> 0) AS redundant,
    sum(n) FILTER (fails = bit) AS unique_fails,
    sum(n_good) FILTER (fails & state = 0 AND fails & bit <> 0) AS good_lost,
    sum(n_toxic) FILTER (fails & state = 0 AND fails & bit <> 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM audit"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return filters.filter_audit(docs, FAILURES, labels, copies="E")


DIVERGENCE_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
t AS (SELECT lang, source, i, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM t GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
s AS (
  SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(v.nl, 0) AS nl,
    coalesce((SELECT sum(c.n) FROM c JOIN k USING (lang, term) WHERE c.lang = g.lang AND c.source = g.source), 0) AS ns
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang)),
grid AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.ns + s.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (s.nl + s.v)::HUGEINT AS q
  FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


SUFFIX_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM d),
w AS (SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS BIGINT), 100) AS g FROM n, LATERAL (SELECT unnest(range(0, n_bytes - 49)) AS s)),
first AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
gone AS (SELECT doc_id, s FROM w JOIN first USING (g) WHERE doc_id > m),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked),
spans AS (SELECT doc_id, island, min(s) AS a, max(s) + 50 AS b FROM numbered GROUP BY doc_id, island),
edges AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
cut AS (
  SELECT n.doc_id, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
    substr(any_value(h), 1, CAST(2 * min(a) AS BIGINT))
      || string_agg(substr(h, CAST(2 * b + 1 AS BIGINT), CAST(2 * (coalesce(next, n_bytes) - b) AS BIGINT)), '' ORDER BY a) AS left_over
  FROM edges JOIN n USING (doc_id) GROUP BY n.doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id)"""


@query("op13_suffix_dedup", SUFFIX_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.suffix_dedup(read(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
