"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import cosine, entropy, language, lattice, mixing, negatives, phrases, pieces, quality, ranking, simhash, substrings, winnowing
from terrane.llm.shared import tables


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fold(parts: int) -> Column:
    """CRC-32 of doc_id as text, modulo `parts`."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compared(spark, tables(spark, sf_dir, "documents"))


def op2_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_duplicates(spark, tables(spark, sf_dir, "embeddings"))


def op3_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables(spark, sf_dir, "labels")
    return entropy.scores(spark, tables(spark, sf_dir, "documents"), labels.filter("quality = 1").select("doc_id"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(spark, tables(spark, sf_dir, "documents"), fold(4) != 2)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(spark, tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice.token_counts(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, tables(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")
    found = quality.scores(spark, docs, labels, fold(3) != 1)
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, tables(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(tables(spark, sf_dir, "documents"), piece_model())


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spark, tables(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(spark, tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.hits(spark, tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


QUERIES = {
    "op1_phrases": op1_phrases,
    "op2_cosine": op2_cosine,
    "op3_entropy": op3_entropy,
    "op4_language": op4_language,
    "op5_substrings": op5_substrings,
    "op6_tokens": op6_tokens,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_negatives": op11_negatives,
    "op12_ranking": op12_ranking,
    "op13_winnowing": op13_winnowing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_cosine": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), d AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN d ON d.a = e.vec_id""",
    "op5_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 19, 0) + 1)) AS p FROM w),
placed AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(words[p : p + 19], ' ') ORDER BY doc_id, p) AS k FROM starts),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM placed, range(0, 20) t(o) WHERE k > 1),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id AND g.i = e.i) GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op11_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, b.n AS b, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) AS k FROM s WHERE same QUALIFY k <= 5
), m AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST, s.b) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3""",
    "op12_ranking": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT item_id, row_number() OVER () AS i, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
s AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM t WHERE len(terms) > 0),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM t) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(s.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY 1),
x AS (SELECT tf.d, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * len(t.terms) * s.n) // s.l))) AS x FROM tf JOIN w USING (term) JOIN t USING (d), s),
q AS (SELECT i, item_id, unnest(terms) AS term FROM i),
r AS (SELECT i, any_value(item_id) AS item_id, d, CAST(sum(x) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY i, d HAVING sum(x) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r JOIN (SELECT d, doc_id FROM t) USING (d) QUALIFY rank <= 50""",
    "op13_winnowing": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[p : p + least(10, len(words)) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p FROM i WHERE len(words) > 0)),
dw AS (SELECT d, n, p, array_to_string(words[p : p + n - 1], ' ') AS w FROM (SELECT d, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM t, (SELECT DISTINCT n FROM iw))),
h AS (SELECT DISTINCT d, dw.n, p, item FROM dw JOIN iw ON iw.w = dw.w AND iw.n = dw.n),
hit AS (SELECT d, count(DISTINCT p + o) AS n_hit FROM h, range(0, 10) t(o) WHERE o < n GROUP BY 1),
its AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT d, item FROM h WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN hit USING (d) LEFT JOIN its USING (d)""",
}
