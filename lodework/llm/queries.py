"""The pN_ queries of the operators in this subpackage, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.llm import keyness, leakage, markup, mixing, names, spans, splitting, vectors
from lodework.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]

#: Ranks of the public tokenizer by which sizes are measured.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.link(table(spark, d, "entities")))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity (least vertex_id) of every person, studio and organisation row."""
    return names.link(table(spark, d, "entities")).select("vertex_id", "entity")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_chunks").where((F.col("embedding_version") == "sim-embed/96/v2") & vectors.usable(F.col("vector"), 96))
    return vectors.nearest(rows, "chunk_no", "tenant_id", "vector", k=5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = _nearest(spark, d).where("cosine >= 0.8")
    return near.select(F.least("key", "other").alias("chunk_no_a"), F.greatest("key", "other").alias("chunk_no_b")).distinct()


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar chunks of every usable chunk."""
    return _nearest(spark, d).withColumnsRenamed({"key": "chunk_no", "other": "neighbour_no"}).withColumn("cosine", F.round("cosine", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue(spread(table(spark, d, "blocks")), markup.trained()).select("block_no", "family").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every block's text and table rows without markup."""
    return markup.cleaned(spread(table(spark, d, "blocks")), markup.trained())


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """z-score of every term of every chunk within its tenant."""
    s = keyness.log_odds(keyness.postings(table(spark, d, "lexical_docs")))
    return s.select(F.col("record_id").alias("chunk_no"), F.col("group_id").alias("tenant_id"), "term", "tf", "document_frequency", F.round("z", 6).alias("z"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms by their counts alone, which is what is asked for; p5_scores weighs the same counts."""
    s = keyness.counted(keyness.postings(table(spark, d, "lexical_docs")))
    s = s.where((F.col("tf") >= 3) & F.col("document_frequency").between(2, 8))
    return s.select(F.col("record_id").alias("chunk_no"), "term").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.block_pieces(table(spark, d, "blocks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.block_pieces(table(spark, d, "blocks")).where("piece_no > 0").select("block_no").distinct()


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "queries"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("longest_run >= 12").select("doc_id", "query_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Scored alignments, edited copies included."""
    return _leaks(spark, d).where("similarity >= 0.5 or longest_run >= 12").withColumn("similarity", F.round("similarity", 4))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets"), VOCABULARY)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).rows


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares


def _spans(spark: SparkSession, d: str) -> spans.SharedSpans:
    return spans.SharedSpans(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).document_pairs()


def p9_portion(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).shared_portion()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_nearest, p3_found, p3_clean, p5_found, p5_scores, p6_found, p6_pieces, p7_found, p7_leaks, p8_mix, p8_shares, p9_found, p9_portion)}


_POSTINGS = """
WITH d AS (SELECT DISTINCT chunk_no, tenant_id, term_frequencies FROM lexical_docs),
e AS (SELECT chunk_no, tenant_id, unnest(map_entries(term_frequencies)) AS x FROM d),
p AS (SELECT chunk_no, tenant_id, x.key AS term, CAST(x.value AS BIGINT) AS tf FROM e WHERE x.value > 0),
t AS (SELECT tenant_id, term, count(*) AS document_frequency, sum(tf) AS y_all FROM p GROUP BY ALL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _POSTINGS + "SELECT DISTINCT chunk_no, term FROM p JOIN t USING (tenant_id, term) WHERE tf >= 3 AND document_frequency BETWEEN 2 AND 8",
        "p5_scores": _POSTINGS + """,
r AS (SELECT chunk_no, sum(tf) AS n FROM p GROUP BY 1), g AS (SELECT tenant_id, sum(tf) AS big FROM p GROUP BY 1),
v AS (SELECT p.chunk_no, tenant_id, term, tf, document_frequency, y_all AS a, y_all - tf AS rest, n, big, big - n AS rest_n
      FROM p JOIN t USING (tenant_id, term) JOIN r USING (chunk_no) JOIN g USING (tenant_id))
SELECT chunk_no, tenant_id, term, tf, document_frequency,
  CASE WHEN n + big - tf - a > 0 AND rest_n + big - rest - a > 0 THEN
  round((ln((tf + a) / (n + big - tf - a)) - ln((rest + a) / (rest_n + big - rest - a))) / sqrt(1.0 / (tf + a) + 1.0 / (rest + a)), 6) END AS z FROM v""",
        "p6_found": r"SELECT block_no FROM blocks WHERE coalesce(kind NOT IN ('heading', 'record'), true) AND len(regexp_extract_all(text, '[^ \t\n]+')) > 400",
    }
