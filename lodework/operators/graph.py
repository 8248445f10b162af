"""The property graph: gates, upserts, bounded traversal, edge recovery, pruning, and the bridges to text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the graph model.
LEAST_CONFIDENCE, MOST_DEPTH, MOST_NODES, SEED_ENTITIES, MOST_CHUNKS, SEED_CHUNKS, EXPANSION_NODES = 0.80, 3, 100, 25, 30, 8, 60
HUB_TYPES = ["HAS_ATTRIBUTE", "ASSOCIATED_WITH"]


def entity_reason(allowed: list[str]) -> Column:
    """Why an entity row is refused; null where it is accepted."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank("entity_id"), "missing_id").when(blank("entity_name"), "missing_name").when(~F.coalesce(F.col("label").isin(allowed), F.lit(False)), "label_not_in_schema")


def edge_gate(edges: DataFrame, vertices: DataFrame, allowed: list[str]) -> DataFrame:
    """edges with the first reason against each, null where it is accepted: schema, confidence, dangling, self-loop.

    vertices has (tenant_id, entity_id). A null confidence counts as 1, as for edges that state none.
    """
    ids = vertices.select("tenant_id", "entity_id").distinct()
    rows = edges
    for side in ("source", "target"):
        known = ids.select("tenant_id", F.col("entity_id").alias(f"{side}_id"), F.lit(True).alias(f"has_{side}"))
        rows = rows.join(known, ["tenant_id", f"{side}_id"], "left")
    kind = F.upper("edge_type")
    reason = (
        F.when(~F.coalesce(kind.isin(allowed), F.lit(False)), "not_in_schema")
        .when(F.coalesce("confidence", F.lit(1.0)) < LEAST_CONFIDENCE, "low_confidence")
        .when(F.col("has_source").isNull() | F.col("has_target").isNull(), "dangling")
        .when(F.col("source_id") == F.col("target_id"), "self_loop")
    )
    return rows.withColumn("reason", reason).drop("has_source", "has_target")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per (tenant, source, type, target): the greatest confidence and how many rows support it; self-loops go."""
    rows = edges.where("source_id <> target_id").withColumn("edge_type", F.upper("edge_type"))
    return rows.groupBy("tenant_id", "source_id", "edge_type", "target_id").agg(
        F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"), F.count(F.lit(1)).alias("support_count"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key (null keys are equal). new must be unique by key."""
    cond = reduce(lambda a, b: a & b, [old[k].eqNullSafe(new[k]) for k in keys])
    return old.join(new, cond, "left_anti").unionByName(new, allowMissingColumns=True)


def canonical_entities(entities: DataFrame) -> DataFrame:
    """One row per (tenant, entity_id): the most confident name, the mention counts added, aliases united."""
    rank = F.struct(F.coalesce("confidence", F.lit(-1.0)), "vertex_id")
    return entities.where("entity_id is not null").groupBy("tenant_id", "entity_id").agg(
        F.max_by("label", rank).alias("label"), F.max_by("entity_name", rank).alias("entity_name"),
        F.sum(F.coalesce("mention_count", F.lit(0))).alias("mention_count"), F.max("confidence").alias("confidence"),
    )


def clamp_depth(depth: int) -> int:
    return min(max(int(depth), 1), MOST_DEPTH)


def clamp_limit(limit: int) -> int:
    return min(max(int(limit), 1), MOST_NODES)


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = MOST_NODES, types: list[str] | None = None) -> DataFrame:
    """Nodes within `depth` hops of each seed's query: (query_id, tenant_id, entity_id, hop), undirected, nearest hop.

    Beyond one hop, edges of hub types are left out. An empty list of types gives nothing beyond the seeds. Each hop is one equi-join of
    the frontier with the edges; nodes seen before are not expanded again, so a hop costs no more than the edges at its
    frontier. limit keeps the nearest nodes per query by (hop, entity_id).
    """
    depth = clamp_depth(depth)
    e = edges.where("source_id <> target_id").withColumn("edge_type", F.upper("edge_type"))
    if types is not None:
        e = e.where(F.col("edge_type").isin(types))
    if depth > 1:
        e = e.where(~F.col("edge_type").isin(HUB_TYPES))
    both = e.select("tenant_id", F.col("source_id").alias("x"), F.col("target_id").alias("y")).unionByName(e.select("tenant_id", F.col("target_id").alias("x"), F.col("source_id").alias("y"))).distinct()
    frontier = seeds.select("query_id", "tenant_id", "entity_id").distinct()
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        step = frontier.join(both, (frontier["tenant_id"] == both["tenant_id"]) & (frontier["entity_id"] == both["x"])).select("query_id", frontier["tenant_id"], F.col("y").alias("entity_id")).distinct()
        frontier = step.join(seen, ["query_id", "tenant_id", "entity_id"], "left_anti")
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
        if limit is not None and hop < depth:  # nodes further away would be cut off below: such a query needs no further hop
            full = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
            frontier = frontier.join(full, "query_id", "left_anti")
    if limit is None:
        return seen
    w = Window.partitionBy("query_id").orderBy("hop", "entity_id")
    return seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def recover_edges(edges: DataFrame, nodes: DataFrame, limit: int = MOST_NODES) -> DataFrame:
    """Edges between nodes of one query: distinct triples, the first `limit` by (source, type, target)."""
    n = nodes.select("query_id", "tenant_id", "entity_id").distinct()
    e = edges.select("tenant_id", "source_id", F.upper("edge_type").alias("edge_type"), "target_id").distinct()
    rows = e.join(n.withColumnRenamed("entity_id", "source_id"), ["tenant_id", "source_id"]).join(n.withColumnRenamed("entity_id", "target_id"), ["query_id", "tenant_id", "target_id"])
    w = Window.partitionBy("query_id").orderBy("source_id", "edge_type", "target_id")
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    return rows.select("query_id", "tenant_id", "source_id", "edge_type", "target_id")


def graph_to_text(nodes: DataFrame, mentions: DataFrame, limit: int = MOST_CHUNKS, seeds: int = SEED_ENTITIES) -> DataFrame:
    """Chunks that mention the first entities of a query: (query_id, chunk_id, n_entities, rank), most entities first.

    Mentions are made distinct together with the join, so a hot entity's repeated rows meet map-side first.
    """
    w = Window.partitionBy("query_id").orderBy("hop", "entity_id")
    first = nodes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= seeds).select("query_id", "tenant_id", "entity_id")
    pairs = mentions.where("entity_id is not null and chunk_id is not null").select("tenant_id", "entity_id", "chunk_id").distinct()
    rows = pairs.join(first, ["tenant_id", "entity_id"]).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_entities"))
    over = Window.partitionBy("query_id").orderBy(F.desc("n_entities"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= limit)


def text_to_graph(hits: DataFrame, mentions: DataFrame, limit: int = EXPANSION_NODES, chunks: int = SEED_CHUNKS) -> DataFrame:
    """Entities mentioned in the first chunks of a query: (query_id, tenant_id, entity_id, n_chunks, rank)."""
    first = hits.where(F.col("rank") <= chunks).select("query_id", "tenant_id", "chunk_id")
    pairs = mentions.where("entity_id is not null").select("tenant_id", "chunk_id", "entity_id").distinct()
    rows = pairs.join(first, ["tenant_id", "chunk_id"]).groupBy("query_id", "tenant_id", "entity_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chunks"), "entity_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def merge_nodes(first: DataFrame, more: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """Nodes of two subgraphs of the same queries, each once: as in the first where it is in both; the first `most` per query."""
    rows = first.select("query_id", "tenant_id", "entity_id", "hop").withColumn("part", F.lit(0)).unionByName(more.select("query_id", "tenant_id", "entity_id", "hop").withColumn("part", F.lit(1)))
    one = rows.groupBy("query_id", "tenant_id", "entity_id").agg(F.min(F.struct("part", "hop")).alias("x"))
    w = Window.partitionBy("query_id").orderBy("x.part", "x.hop", "entity_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "tenant_id", "entity_id", "x.hop", "x.part", "rank")


def merge_edges(first: DataFrame, more: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges of two subgraphs both ends of which are among the nodes."""
    keys = ["query_id", "tenant_id", "source_id", "edge_type", "target_id"]
    rows = first.select(*keys).unionByName(more.select(*keys)).distinct()
    ids = nodes.select("query_id", "tenant_id", "entity_id")
    for side in ("source_id", "target_id"):
        rows = rows.join(ids.withColumnRenamed("entity_id", side), ["query_id", "tenant_id", side], "left_semi")
    return rows


def expand(hits: DataFrame, edges: DataFrame, mentions: DataFrame, hops: int = 1, limit: int = MOST_CHUNKS) -> DataFrame:
    """Chunks around the entities of a query's best chunks that it didn't return yet: (query_id, chunk_id, n_entities, rank).

    hits has (query_id, tenant_id, chunk_id, rank). Text to graph, a walk of `hops`, graph to text, less what was returned.
    """
    seeds = text_to_graph(hits, mentions).select("query_id", "tenant_id", "entity_id")
    found = graph_to_text(traverse(edges, seeds, hops), mentions, limit)
    return found.join(hits.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")


def widen(found: DataFrame, wanted: DataFrame, pool: DataFrame, limit: int = 200) -> DataFrame:
    """Candidates of a query (query_id, tenant_id, entity_id, widened): those found, and where they are fewer than wanted
    (query_id, tenant_id, n) the first `limit` entities of the tenant that weren't."""
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    short = wanted.join(have, "query_id", "left").where(F.coalesce("have", F.lit(0)) < F.col("n")).select("query_id", "tenant_id")
    first = pool.select("tenant_id", "entity_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("tenant_id").orderBy("entity_id"))).where(F.col("r") <= limit).drop("r")
    extra = short.join(first, "tenant_id").join(found.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
    return found.select("query_id", "tenant_id", "entity_id", F.lit(False).alias("widened")).unionByName(extra.select("query_id", "tenant_id", "entity_id", F.lit(True).alias("widened")))


def prune(nodes: DataFrame, edges: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The `keep` nodes of a query's subgraph by (seed, degree, id), and the edges that still have both ends."""
    ends = edges.select("query_id", F.explode(F.array("source_id", "target_id")).alias("entity_id")).groupBy("query_id", "entity_id").agg(F.count(F.lit(1)).alias("degree"))
    w = Window.partitionBy("query_id").orderBy(F.desc("is_seed"), F.desc("degree"), "entity_id")
    rows = nodes.join(ends, ["query_id", "entity_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    ids = rows.select("query_id", "entity_id")
    left = edges.join(ids.withColumnRenamed("entity_id", "source_id"), ["query_id", "source_id"], "left_semi").join(ids.withColumnRenamed("entity_id", "target_id"), ["query_id", "target_id"], "left_semi")
    return rows, left


def passages(edges: DataFrame, names: DataFrame, seeds: DataFrame, limit: int = 15) -> DataFrame:
    """Edges as sentences, those at a seed first, then by confidence: (query_id, rank, passage)."""
    n = names.select("tenant_id", "entity_id", "entity_name")
    rows = edges.join(n.withColumnsRenamed({"entity_id": "source_id", "entity_name": "source_name"}), ["tenant_id", "source_id"]).join(n.withColumnsRenamed({"entity_id": "target_id", "entity_name": "target_name"}), ["tenant_id", "target_id"])
    s = seeds.select("query_id", F.col("entity_id").alias("seed")).groupBy("query_id").agg(F.collect_set("seed").alias("seeds"))
    rows = rows.join(s, "query_id", "left")
    at_seed = F.coalesce(F.array_contains("seeds", F.col("source_id")) | F.array_contains("seeds", F.col("target_id")), F.lit(False))
    w = Window.partitionBy("query_id").orderBy(F.desc("at_seed"), F.desc("confidence"), "source_id", "edge_type", "target_id")
    rows = rows.withColumn("at_seed", at_seed).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    verb = F.lower(F.regexp_replace("edge_type", "_", " "))
    return rows.select("query_id", "rank", F.concat_ws(" ", "source_name", verb, F.concat("target_name", F.lit("."))).alias("passage"))
