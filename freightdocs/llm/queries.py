"""One query for each operator: it applies the operator to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightdocs.llm import alignment, classifier, codes, licenses, line_chunks, minhash, packing, passages, pieces, quality_rules, secrets, top_scores, vectors
from freightdocs.llm.common import read_table, tokenizer_path
from freightdocs.llm.registry import CHECKS, QUERIES, register

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN text_words IS NULL OR len(text_words) = 0 THEN []
    WHEN len(text_words) < 3 THEN [text_words]
    ELSE list_distinct([text_words[i:i + 2] FOR i IN range(1, len(text_words) - 1)]) END AS shingles
  FROM (SELECT doc_id, words AS text_words FROM w)),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meet JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
  WHERE 100 * n >= 85 * (len(p.shingles) + len(q.shingles) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, edges.b FROM reach r JOIN edges ON edges.a = r.other)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
part AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN part USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@register("op2_embedding_near_dedup", VECTOR_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read_table(spark, sf_dir, "embeddings"), 0.9)


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@register("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_chunks.deduplicated(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "cut_lines", "cut_chunks")


@register("op4_minhash_near_dedup", NEAR_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, num=85, den=100)


@register("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.Model(tokenizer_path("piece_bpe_32k.model"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.decode(pieces.encode(docs, model), model)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@register("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(read_table(spark, sf_dir, "documents"))


@register("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [secrets.counted(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *kinds, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


@register("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_rows(read_table(spark, sf_dir, "labels"))
    return quality_rules.score_documents(read_table(spark, sf_dir, "documents"), trusted)


@register("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


CODES_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT row_number() OVER () AS row, * FROM good),
dims AS (SELECT row, vec_id, unnest(range(len(v))) AS d, unnest(v) AS x, len(v) // 16 AS w FROM r),
x AS (SELECT row, d // w AS part, d % w AS pos, x FROM dims),
seed AS (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM r QUALIFY entry < 64),
book AS (
  SELECT 0 AS round, part, entry, pos, x AS c FROM x JOIN seed USING (row)
  UNION ALL
  (WITH d AS (SELECT x.row, b.part, b.entry, sum((x.x - b.c) * (x.x - b.c)) AS e FROM x JOIN book b ON b.part = x.part AND b.pos = x.pos WHERE b.round < 2 GROUP BY ALL),
   near AS (SELECT row, part, arg_min(entry, e * 64 + entry) AS entry FROM d GROUP BY ALL),
   mean AS (SELECT x.part, near.entry, x.pos, CAST(floor(CAST(sum(x.x) AS DOUBLE) / count(*)) AS BIGINT) AS c
     FROM x JOIN near ON near.row = x.row AND near.part = x.part GROUP BY ALL)
   SELECT b.round + 1, b.part, b.entry, b.pos, coalesce(mean.c, b.c) FROM book b LEFT JOIN mean ON mean.part = b.part AND mean.entry = b.entry AND mean.pos = b.pos
   WHERE b.round < 2)),
last AS (SELECT * FROM book WHERE round = 2),
d AS (SELECT x.row, b.part, b.entry, sum((x.x - b.c) * (x.x - b.c)) AS e FROM x JOIN last b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL),
near AS (SELECT row, part, arg_min(entry, e * 64 + entry) AS entry, min(e) AS e FROM d GROUP BY ALL),
coded AS (SELECT row, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(e) AS BIGINT) AS error FROM near GROUP BY row),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM last)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN r USING (row), digest
"""


@register("op11_vector_codes", CODES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(read_table(spark, sf_dir, "embeddings"))


@register("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
  c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id QUALIFY rank <= 5
"""


@register("op13_top_scores", TOP_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores.top_scores(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


__all__ = ["CHECKS", "QUERIES"]
