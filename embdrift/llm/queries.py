"""Registered queries of this package: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embdrift.llm import compression, filters, hnsw, lm, mixing, packing, rules, sharding, simhash, tokens, toxicity, vafile, whitening
from embdrift.llm.common import bounded_sample, crc_class, label_share, marks, read, stored
from embdrift.sources.tables import table_path

#: Bounds of the samples on which classifiers are fitted: rows of either label, characters of a text.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 30_000


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on rows whose crc32(doc_id) mod 4 is not 2."""
    keep = crc_class("doc_id", 4) != 2
    sample = bounded_sample(docs, labels, "toxic", keep, SAMPLE_ROWS, SAMPLE_CHARS)
    return toxicity.fit(sample, share=label_share(docs, labels, "toxic", keep))


def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    scored = stored(toxicity.score(spark, docs, model).select(
        "doc_id", "lang", (crc_class("doc_id", 4) == 2).alias("held_out"), "score"), "op1")
    limits = toxicity.language_thresholds(scored.where("not held_out").join(marks(read(spark, sf_dir, "labels"), "toxic"), "doc_id"))
    limit = toxicity.threshold_column(limits)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         limit.alias("lang_threshold"), (F.col("score") >= limit).alias("flagged"))


def op4_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(read(spark, sf_dir, "documents"), tokens.vocabulary(), end_id=1)


def op5_pack_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack(packing.cut_pieces(docs, tokens.vocabulary(), capacity=2048, end_id=0), capacity=2048)


def op6_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stats = stored(rules.text_stats(docs).drop("text"), "op6-stats")  # computed once, for learning and for the verdict
    learned = rules.learn_rules(stats.join(marks(read(spark, sf_dir, "labels"), "quality"), "doc_id"))
    return rules.apply_rules(stats, learned).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_model(docs: DataFrame, labels: DataFrame) -> compression.Model:
    """Fitted on rows whose crc32(doc_id) mod 5 is not 0."""
    return compression.fit(bounded_sample(docs, labels, "quality", crc_class("doc_id", 5) != 0, SAMPLE_ROWS, SAMPLE_CHARS))


def op7_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = compression.score(spark, docs, quality_model(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_class("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")


def op2_lm_eliasfano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), crc_class("doc_id", 7) == 2)


def op3_mix_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_repeat=2)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=4, distance=4).select("doc_id", "fingerprint", "component_id")


def op10_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(spark, table_path(sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_topk_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op13_whiten_qd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity_cnn, op2_lm_eliasfano, op3_mix_systematic, op4_token_parquet, op5_pack_dominance, op6_rule_list, op7_quality_zstd,
        op8_embedding_hnsw, op9_simhash_anchors, op10_shard_bytes, op11_filter_audit, op12_topk_vafile, op13_whiten_qd)
}

_OP3_SQL = r"""
WITH r0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5(coalesce(text, '')) AS mark FROM documents),
r AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) * 8 + (size * 8) // (1::BIGINT << (length(bin(size)) - 1)) ELSE -1 END AS cls,
             ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || mark), 1, 8))::BIGINT % 64 AS bucket FROM r0),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(most) OVER o - most))
                / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level FROM w
      WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM f) * weight, most)) AS target FROM l),
k AS (SELECT r.*, t.source_size, t.target,
             row_number() OVER (PARTITION BY r.source ORDER BY cls, bucket, size, doc_id NULLS LAST, mark) AS place,
             CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0.0::DOUBLE END AS e,
             (('0x' || substr(md5('1|' || coalesce(r.source, '')), 1, 8))::BIGINT % 1000003) / 1000003.0::DOUBLE AS u
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(place * e + u) - floor((place - 1) * e + u) AS BIGINT) * size AS taken FROM k"""

# crc32 by the table that its polynomial makes, over the bytes of each text.
_OP10_SQL = r"""
WITH RECURSIVE crc(n, k, v) AS (
  SELECT n, 0, n FROM range(256) t(n)
  UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
tbl AS (SELECT list(v ORDER BY n) AS t FROM crc WHERE k = 8),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
      FROM b, tbl),
o AS (SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(crc AS VARCHAR)), 1, 8))::BIGINT % 1024 AS bucket FROM c),
p AS (SELECT *, sum(size) OVER q - size AS start, sum(size) OVER () AS total FROM o
      WINDOW q AS (ORDER BY bucket, doc_id NULLS LAST, crc, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST((start * 16) // total AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, len(e) AS d FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.d = b.d AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) m LEFT JOIN n USING (vec_id)"""

_OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, min(quality) FILTER (quality IN (0, 1)) = 1 AS good, min(toxic) FILTER (toxic IN (0, 1)) = 1 AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
p(filter_order, step, bit, before) AS (
  SELECT '', 0, 0, 0
  UNION ALL SELECT filter_order || f.letter, step + 1, f.b, before + bit
  FROM p, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, b) WHERE NOT contains(filter_order, f.letter)),
whole AS (SELECT a.filter_order, s.step, s.bit, s.before FROM p a JOIN p s ON s.step > 0 AND a.filter_order[1:s.step] = s.filter_order WHERE a.step = 5),
parts AS (SELECT DISTINCT part FROM c)
SELECT parts.part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM parts CROSS JOIN whole JOIN c ON c.part = parts.part GROUP BY parts.part, filter_order, step"""

_OP12_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT vec_id, list_transform(e, lambda c: floor(256 * c)) AS x FROM v
      WHERE len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM x q JOIN x c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

#: Only what DuckDB can say: the other operators rest on trained models, XXH64 or the tokenizer.
ORACLES: dict[str, str] = {"op3_mix_systematic": _OP3_SQL, "op8_embedding_hnsw": _OP8_SQL, "op10_shard_bytes": _OP10_SQL,
                           "op11_filter_audit": _OP11_SQL, "op12_topk_vafile": _OP12_SQL}
