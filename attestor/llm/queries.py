"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import ann, bpe, hard_negatives, langid, packing, phrases, pii, quality, simhash, substrings, token_files, toxicity, vector_dedup
from attestor.llm.shared import fold, labelled, passing, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of each vector whose id is divisible by 100."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).withColumnRenamed("id", "vec_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the class of near-duplicates that it is in."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's chance of good quality, by a model of labelled rows outside of the held-out fifth."""
    docs, held_out = _table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    known = labelled(docs, _table(spark, sf_dir, "labels").where(~held_out), "doc_id", "text", "quality")
    found = quality.predict(docs.select("doc_id", "text"), quality.fit(known))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from labelled rows outside of the held-out third."""
    return toxicity.fit(labelled(docs, labels.where(fold("doc_id", 3) != 1), "doc_id", "text", "toxic"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into sequences."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links at cosine 0.98 within its label, and the class of near-duplicates that it is in."""
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each document's ids and decoded text as digests; ``path`` is a tokenizer file."""
    found = bpe.digests(_table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's chance of being toxic and its offending sentences, by a model of labelled rows outside of the held-out third."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    found = toxicity.predict(docs.select("doc_id", "text"), toxicity_model(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "sentences")


def op6_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Write all documents' token ids as files in the shared folder, and read each document back from them."""
    folder = passing(spark, shared_dir(spark))
    parts = token_files.write(_table(spark, sf_dir, "documents"), folder, path or public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, folder, parts)


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the rows outside of the held-out third."""
    return langid.fit(docs.where(fold("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), "text", "lang"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, by models of the rows outside of the held-out third."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    found = langid.predict(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's personal data, plain and disguised."""
    return pii.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the words of 20-word windows that start earlier too."""
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of all documents, grouped by their text; ids of ``documents`` do not repeat.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM w WHERE nth > 1),
k AS (SELECT doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d) t LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 phrases of two and three words that most belong together."""
    return phrases.mine(_table(spark, sf_dir, "documents"))


#: ``documents`` cut into pieces and words, all n-grams counted, and scored in 128-bit arithmetic.
PHRASES_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces) WHERE len(ws) > 0),
g1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM p) GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM g1 GROUP BY lang),
g2 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM p WHERE len(ws) > 1) GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM p WHERE len(ws) > 2) GROUP BY ALL HAVING count(*) >= 10),
c3 AS (SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || g3.z AS phrase, g3.f AS a, gx.f AS l1, yz.f AS r1, xy.f AS l2, gz.f AS r2,
    (1000000::HUGEINT * g3.f * g3.f) // (gx.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * g3.f * g3.f) // (xy.f::HUGEINT * gz.f) AS s2
  FROM g3 JOIN g1 gx ON gx.lang = g3.lang AND gx.w = g3.x JOIN g1 gz ON gz.lang = g3.lang AND gz.w = g3.z
    JOIN g2 xy ON xy.lang = g3.lang AND xy.x = g3.x AND xy.y = g3.y JOIN g2 yz ON yz.lang = g3.lang AND yz.x = g3.y AND yz.y = g3.z),
c2 AS (SELECT g2.lang, g2.x || ' ' || g2.y AS phrase, g2.f AS a, gx.f AS l, gy.f AS r, (1000000::HUGEINT * g2.f * g2.f) // (gx.f::HUGEINT * gy.f) AS score
  FROM g2 JOIN g1 gx ON gx.lang = g2.lang AND gx.w = g2.x JOIN g1 gy ON gy.lang = g2.lang AND gy.w = g2.y
  WHERE NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND g3.x = g2.x AND g3.y = g2.y AND 100 * g3.f >= 50 * g2.f)
    AND NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND g3.y = g2.x AND g3.z = g2.y AND 100 * g3.f >= 50 * g2.f)),
c AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, CASE WHEN s2 < s1 THEN s2 ELSE s1 END FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM c)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN t USING (lang) WHERE rank <= 2000
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each vector whose id is divisible by 100; labels of every seventh vector are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


#: Every anchor against all rows; inner products of whole numbers this small are exact in doubles.
NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE alike) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_language_id": op7_language_id,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_pii": op10_pii,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The others can't be said in SQL; tests compare them with brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {"op11_substring_dedup": REPEATS_SQL, "op12_phrase_mining": PHRASES_SQL, "op13_hard_negatives": NEGATIVES_SQL}
