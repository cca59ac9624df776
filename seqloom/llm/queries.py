"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import collide, licenses, packing, pii, quality, simhash, urlmodel, vptree, warc, wfst
from seqloom.llm.common import read_table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_dedup(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op4_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlmodel.judge(read_table(spark, sf_dir, "pages"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its surrogate text, and how many entities of which types were replaced."""
    found = pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities")), ",").alias("kinds"))


def op7_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.digests(read_table(spark, sf_dir, "documents"))


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its evidence, the shift of its site, the probability that it is good, and the decision."""
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("rid")


def op9_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collide.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor 1: the triangle inequality unrelaxed, so the search is exact."""
    return vptree.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_revisits, op2_best_fit_packing, op3_license_diagonals, op4_url_markov, op5_simhash_pivots, op6_pii_surrogates, op7_sentencepiece_wfst, op8_quality_bayes, op9_collision_counting, op10_vantage_points)}

_VECTORS = """SELECT vec_id, row_number() OVER () AS rid, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""
_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"

_LINKS = f"""
WITH RECURSIVE vectors AS ({_VECTORS}),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.rid <> b.rid AND {_COSINE} >= 0.95),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links,
       least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS kept
FROM embeddings
"""

_NEAREST = f"""
WITH vectors AS ({_VECTORS}),
scored AS (SELECT a.vec_id AS query_id, a.rid, b.vec_id, {_COSINE} AS score FROM vectors a JOIN vectors b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op1_warc_revisits": warc.ORACLE, "op4_url_markov": urlmodel.oracle_sql(), "op9_collision_counting": _LINKS, "op10_vantage_points": _NEAREST}
