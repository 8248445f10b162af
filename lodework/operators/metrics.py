"""Evaluation: retrieval metrics, percentiles, stage shares, lift, gates, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall, precision, reciprocal rank, nDCG and hit at k.

    With nothing relevant, recall, nDCG and hit are 1 and the rest 0 (n_relevant tells). Precision is over what was
    returned. ranked (query_id, doc, rank), relevant (query_id, doc).
    """
    rel = relevant.select("query_id", "doc").distinct()
    got = ranked.where(F.col("rank") <= k).join(rel.withColumn("rel", F.lit(1)), ["query_id", "doc"], "left")
    gain = 1 / F.log2(F.col("rank") + 1)
    per = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_returned"), F.count("rel").alias("n_hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") == 1, gain).otherwise(0.0)).alias("dcg"))
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = queries.select("query_id").distinct().join(n, "query_id", "left").join(per, "query_id", "left").fillna(0, ["n_relevant", "n_returned", "n_hit"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    none = F.col("n_relevant") == 0
    return rows.select(
        "query_id", "n_relevant",
        F.round(F.when(none, 1.0).otherwise(F.col("n_hit") / F.col("n_relevant")), 6).alias("recall"),
        F.round(F.when(F.col("n_returned") == 0, 0.0).otherwise(F.col("n_hit") / F.col("n_returned")), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(none, 1.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"),
        F.when(none | (F.col("n_hit") > 0), 1.0).otherwise(0.0).alias("hit"),
    )


def nearest_ranks(rows: DataFrame, key: str, value: str, ps: dict[str, float]) -> DataFrame:
    """(key, one column per percentile): the values at the nearest ranks, exact.

    Equal values are counted first; a key's counts are then summed in the order of values, so no task holds all values
    of a key in one buffer.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(key)
    counts = counts.withColumns({"upto": F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.sum("c").over(whole)})
    return counts.groupBy(key).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(p)), F.col("v"))).alias(name) for name, p in ps.items()])


def stage_report(steps: DataFrame, step: str = "step", latency: str = "latency_ms") -> DataFrame:
    """Per step: calls, mean, p50, p95, p99, and the share of the total time."""
    per = steps.groupBy(F.col(step).alias("step")).agg(F.count(F.lit(1)).alias("calls"), F.sum(latency).alias("total"), F.round(F.avg(latency), 4).alias("mean"))
    ranks = nearest_ranks(steps.select(F.col(step).alias("step"), F.col(latency).alias("latency")), "step", "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    whole = per.agg(F.sum("total").alias("whole"))
    return per.join(ranks, "step", "left").crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.col("total") / F.col("whole"), 6)).drop("whole", "total")


def by_category(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Means overall (category null, is_total) and per category in one pass."""
    aggs = [F.round(F.avg(n), 6).alias(n) for n in names]
    return metrics.groupingSets([["category"], []], "category").agg(F.grouping("category").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), *aggs)


def lift(base: DataFrame, other: DataFrame, metric: str) -> DataFrame:
    """Per category: mean of both configurations over the same queries, their difference, and who solved what alone."""
    rows = base.select("query_id", "category", F.col(metric).alias("a")).join(other.select("query_id", F.col(metric).alias("b")), "query_id")
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("base"), F.round(F.avg("b"), 6).alias("other"),
        F.round(F.avg(F.col("b") - F.col("a")), 6).alias("lift"), F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("only_other"),
    )


def multi_hop(rows: DataFrame) -> DataFrame:
    """rows (query_id, requires_multi_hop, a, b) into means of both ways and their difference, apart for multi-hop questions and others."""
    hop = F.coalesce("requires_multi_hop", F.lit(False)).alias("multi_hop")
    return rows.groupBy(hop).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"), F.round(F.avg("b") - F.avg("a"), 6).alias("advantage"))


def gates(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule (name, op, target, hard) against values (name, value): passed is false for a missing value."""
    rows = rules.join(values, "name", "left")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).when(F.col("op") == "<=", F.col("value") <= F.col("target")).otherwise(F.col("value") == F.col("target"))
    return rows.withColumn("passed", F.coalesce(ok, F.lit(False)))


def telemetry(steps: DataFrame, contract: list[str], calls: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """Per request and contract step the latency, 0 where the step didn't run, with the request's total and cost."""
    spark = steps.sparkSession
    names = spark.createDataFrame([(c,) for c in contract], "step string")
    per = steps.groupBy("request_id", "step").agg(F.sum("latency_ms").alias("latency_ms"))
    total = steps.groupBy("request_id").agg(F.round(F.sum("latency_ms"), 4).alias("total_ms"))
    grid = total.crossJoin(F.broadcast(names)).join(per, ["request_id", "step"], "left").withColumn("latency_ms", F.round(F.coalesce("latency_ms", F.lit(0.0)), 4))
    if calls is None or prices is None:
        return grid
    c = calls.join(F.broadcast(prices), "model", "left")
    cost = F.coalesce("prompt_tokens", F.lit(0)) * F.coalesce("input_usd", F.lit(0.0)) / 1_000_000 + F.coalesce("completion_tokens", F.lit(0)) * F.coalesce("output_usd", F.lit(0.0)) / 1_000_000
    c = c.groupBy("request_id").agg(F.round(F.sum(cost), 8).alias("cost_usd"), F.min(F.col("input_usd").isNotNull()).alias("priced"))
    return grid.join(c, "request_id", "left").fillna(0.0, ["cost_usd"])


def slowest(steps: DataFrame, n: int, contract: list[str]) -> DataFrame:
    """The n slowest requests with a column per step; only they are pivoted."""
    total = steps.groupBy("request_id").agg(F.round(F.sum("latency_ms"), 4).alias("total_ms")).orderBy(F.desc("total_ms"), "request_id").limit(n)
    return steps.join(F.broadcast(total), "request_id").groupBy("request_id", "total_ms").pivot("step", contract).agg(F.round(F.sum("latency_ms"), 4)).fillna(0.0)


# The configurations that are compared, by the paths they use.
CONFIGURATIONS = [
    ("A", "Vector", "vector", False, False), ("B", "BM25", "lexical", False, False), ("C", "Graph", "graph", False, False), ("D", "Vector+BM25", "vector lexical", False, False),
    ("E", "Vector+Graph", "vector graph", False, False), ("F", "Hybrid", "vector lexical graph", False, False), ("G", "Hybrid+RRF", "vector lexical graph", True, False), ("H", "Full+Reranker", "vector lexical graph", True, True),
]


# The rules a case may be judged by.
RULES = ["rejects", "abstains", "routes_to", "clarifies", "retrieves_graph", "retrieves_text", "retrieves_any"]


def pass_rule(rule: Column, texts: Column, expected: Column, forbidden: Column, intent: Column, want_intent: Column, graph_edges: Column, least_edges: Column, passages: Column, rejected: Column) -> Column:
    """Whether a case passes by its own rule. Missing lists are empty; an unknown rule asks for any passage."""
    none = F.array().cast("array<string>")
    joined = F.lower(F.array_join(F.coalesce(texts, none), " "))
    holds = lambda words, test: test(F.coalesce(words, none), lambda t: F.contains(joined, F.lower(t)))
    return (
        F.when(rule == "rejects", rejected)
        .when(rejected, F.lit(False))
        .when(rule == "abstains", ~holds(forbidden, F.exists))
        .when(rule == "routes_to", intent.eqNullSafe(want_intent))
        .when(rule == "clarifies", intent.eqNullSafe(F.lit("clarify")))
        .when(rule == "retrieves_graph", graph_edges >= F.greatest(F.lit(1), F.coalesce(least_edges, F.lit(1))))
        .when(rule == "retrieves_text", holds(expected, F.forall))
        .otherwise(passages > 0)
    )
