"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreledger.llm.common import table
from acreledger.llm.mixing_sql import taken_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from acreledger.llm.pieces import encode_digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@register
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.simhash import classes

    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@register
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.decontam import contaminated, find

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLES["op6_decontamination"] = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), split AS (
  SELECT kind, id, r, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered
), windows AS (
  SELECT DISTINCT id AS item_id, least(13, len(w)) AS size, w[p : p + least(13, len(w)) - 1] AS win
  FROM (SELECT id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM split WHERE kind = 'b' AND len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), spots AS (
  SELECT id, r, p, size, w[p : p + size - 1] AS win
  FROM (SELECT id, r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM split, sizes WHERE kind = 'd' AND len(w) >= size)
), hits AS (
  SELECT s.r, s.p, s.size, b.item_id FROM spots s JOIN windows b ON s.size = b.size AND s.win = b.win
), covered AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r
)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM split d LEFT JOIN covered c ON c.r = d.r LEFT JOIN named i ON i.r = d.r WHERE d.kind = 'd'
"""


@register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.langid import fit, held_out_fold, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs, ~held_out_fold()))
    return found.select("doc_id", F.coalesce(held_out_fold(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.toxicity import fit, held_out_fold, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out_fold()))
    return found.select("doc_id", F.coalesce(held_out_fold(), F.lit(False)).alias("held_out"), "score", "predicted")


@register
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.quality import fit, held_out_fold, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out_fold()))
    return found.select("doc_id", F.coalesce(held_out_fold(), F.lit(False)).alias("held_out"), "score", "predicted")


@register
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@register
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.embeddings import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


ORACLES["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 95e-2
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.vec_id) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.a = v.vec_id
"""


@register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("notices.license")), ",").alias("licenses"))


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


ORACLES["op11_hard_negatives"] = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positive AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


@register
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


ORACLES["op12_mixing"] = taken_sql()


@register
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from acreledger.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLES["op13_collocations"] = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, words, array_to_string(w[i : i + words - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split), (SELECT unnest([1, 2, 3]) AS words) WHERE i + words - 1 <= len(w)
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), total AS (
  SELECT lang, count(*) AS n FROM grams WHERE words = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.words, c.phrase, c.f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS front, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest
  FROM f c, (SELECT unnest([1, 2]) AS k) WHERE k < c.words
), scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.front AND l.words = c.k JOIN f r ON r.lang = c.lang AND r.phrase = c.rest AND r.words = c.words - c.k
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[1 + o : 2 + o], ' ') AS phrase, max(f) AS longer FROM f, (SELECT unnest([0, 1]) AS o) WHERE words = 3 GROUP BY ALL
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN inside i ON s.words = 2 AND i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
