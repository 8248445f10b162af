"""Running question sets: outcomes, ablations, summaries of corpora, and the shape of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.operators import guards, metrics


class CorpusError(ValueError):
    """A corpus with nothing to evaluate on."""


def corpus_summary(documents: DataFrame, source: str, least_chars: int) -> DataFrame:
    """(source, documents, usable, chars, longest); a null source is a source. Nothing is dropped: `usable` counts what is long enough."""
    n = F.coalesce(F.length("text"), F.lit(0))
    return documents.groupBy(F.coalesce(F.col(source), F.lit("none")).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(n >= least_chars).alias("usable"), F.sum(n).alias("chars"), F.max(n).alias("longest"),
    )


def preflight(documents: DataFrame, queries: DataFrame) -> None:
    """Raises before anything runs where there is no text or no question."""
    if documents.where("trim(text) <> ''").isEmpty():
        raise CorpusError("the corpus has no text")
    if queries.isEmpty():
        raise CorpusError("there are no questions")


def outcomes(analysed: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, outcome, reason, intent, n_hits): what came of every query; a refusal is a row, not a failure of the run."""
    rows = analysed.join(hits, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    bad = guards.violation(F.col("query_text"))
    outcome = F.when(bad.isNotNull(), "refused").when(F.col("intent") == "clarify", "clarified").when(F.col("n_hits") > 0, "answered").otherwise("empty")
    return rows.select("query_id", outcome.alias("outcome"), F.coalesce(bad, "reason").alias("reason"), "intent", F.when(bad.isNull(), F.col("n_hits")).otherwise(0).alias("n_hits"))


def question_set(hybrid: DataFrame, vector: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10, passing: float = 0.5) -> DataFrame:
    """Per category: questions, those with something relevant, mean recall both ways over these, passes both ways, what only one solved.

    A question passes from a recall of `passing`; one with nothing relevant passes where nothing was returned.
    """
    ways = []
    for ranked, name in ((hybrid, "hybrid"), (vector, "vector")):
        m = metrics.ranking_metrics(ranked, relevant, queries, k)
        n = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        m = m.join(n, "query_id", "left")
        ok = F.when(F.col("n_relevant") == 0, F.coalesce("n", F.lit(0)) == 0).otherwise(F.col("recall") >= passing)
        ways.append(m.select("query_id", "n_relevant", F.col("recall").alias(f"{name}_recall"), ok.alias(f"{name}_ok")))
    rows = queries.select("query_id", "category").join(ways[0], "query_id").join(ways[1].drop("n_relevant"), "query_id")
    scored = lambda c: F.round(F.avg(F.when(F.col("n_relevant") > 0, F.col(c))), 6).alias(c)
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_relevant") > 0).alias("n_scored"), scored("hybrid_recall"), scored("vector_recall"),
        F.count_if("hybrid_ok").alias("hybrid_passed"), F.count_if("vector_ok").alias("vector_passed"),
        F.count_if(F.col("hybrid_ok") & ~F.col("vector_ok")).alias("only_hybrid"), F.count_if(~F.col("hybrid_ok") & F.col("vector_ok")).alias("only_vector"),
    )


def shape(hits: DataFrame, nodes: DataFrame, requests: DataFrame, top_k: int) -> DataFrame:
    """(query_id, rank, doc, subgraph_nodes): the first top_k passages; the subgraph's size is null unless it was asked for."""
    guards.in_bounds("top_k", top_k)
    n = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = hits.where(F.col("rank") <= top_k).join(requests, "query_id").join(n, "query_id", "left")
    return rows.select("query_id", "rank", "doc", F.when(F.col("include_subgraph"), F.coalesce("n", F.lit(0))).alias("subgraph_nodes"))
