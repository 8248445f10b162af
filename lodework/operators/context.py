"""Packing a context: graph passages first, near-duplicates out, the best that fits a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.functions import text as tx

# Fixed values of the context model.
BUDGET, LEAST, DUPLICATE = 3000, 24, 0.82


def pack(ranked: DataFrame, budget: int = BUDGET, most: int = 20, passages: DataFrame | None = None) -> DataFrame:
    """(query_id, position, doc, text, tokens, truncated) of what fits, in order of rank.

    A text whose token set overlaps an accepted one by 0.82 or more is skipped; one that doesn't fit is cut at a
    sentence where at least 24 tokens are left, else skipped. Graph passages come first and may take half the budget.
    The candidates of a query are few (they were ranked and cut before), so the fold runs over one array per query,
    on the JVM.
    """
    rows = ranked.select("query_id", F.struct(F.lit(1).alias("part"), F.col("rank").cast("int").alias("rank"), F.col("doc").cast("string").alias("doc"), "text").alias("x"))
    if passages is not None:
        rows = rows.unionByName(passages.select("query_id", F.struct(F.lit(0).alias("part"), F.col("rank").cast("int").alias("rank"), F.lit(None).cast("string").alias("doc"), F.col("passage").alias("text")).alias("x")))
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    kind = "array<struct<doc:string,text:string,tokens:int,truncated:boolean,words:array<string>>>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        words = F.array_distinct(tx.plain_tokens(x["text"]))
        graph = x["part"] == 0
        n = tx.token_count(x["text"])
        room = F.when(graph, F.lit(budget // 2)).otherwise(F.lit(budget)) - acc["used"]
        twin = F.exists(acc["kept"], lambda k: tx.jaccard(k["words"], words) >= DUPLICATE)
        shorter = tx.cut_at_sentence(x["text"], room)
        fits = n <= room
        cut = ~fits & ~graph & (room >= LEAST) & (F.length(shorter) > 0)
        body = F.when(fits, x["text"]).otherwise(shorter)
        size = F.when(fits, n).otherwise(tx.token_count(shorter))
        take = (F.size(acc["kept"]) < most) & ~twin & (fits | cut)
        item = F.struct(x["doc"].alias("doc"), body.alias("text"), size.alias("tokens"), cut.alias("truncated"), words.alias("words"))
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(item).cast(kind))).otherwise(acc["kept"]).alias("kept"), F.when(take, acc["used"] + size).otherwise(acc["used"]).alias("used"))

    packed = lists.select("query_id", F.aggregate("xs", start, step).alias("p"))
    out = packed.select("query_id", F.posexplode("p.kept").alias("position", "k"))
    return out.select("query_id", "position", F.col("k.doc").alias("doc"), F.col("k.text").alias("text"), F.col("k.tokens").alias("tokens"), F.col("k.truncated").alias("truncated"))


def summary(packed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per query: passages, tokens, and the part of the budget used."""
    rows = packed.groupBy("query_id").agg(F.count(F.lit(1)).alias("passages"), F.sum("tokens").alias("tokens"))
    return rows.withColumn("budget_used_pct", F.round(100 * F.col("tokens") / budget, 1))
