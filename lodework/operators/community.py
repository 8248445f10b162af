"""Communities: label propagation in synchronous rounds, ranking, and extractive reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodework.session import stored

# Fixed values of the community model.
ROUNDS, LEAST_MEMBERS, MOST_COMMUNITIES = 12, 3, 200


def adjacency(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct directed pairs (tenant_id, x, y) of both directions, known ends only, no loops."""
    ids = vertices.select("tenant_id", "entity_id").distinct()
    e = edges.where("source_id <> target_id").select("tenant_id", "source_id", "target_id")
    e = e.join(ids.withColumnRenamed("entity_id", "source_id"), ["tenant_id", "source_id"], "left_semi").join(ids.withColumnRenamed("entity_id", "target_id"), ["tenant_id", "target_id"], "left_semi")
    return e.select("tenant_id", F.col("source_id").alias("x"), F.col("target_id").alias("y")).unionByName(e.select("tenant_id", F.col("target_id").alias("x"), F.col("source_id").alias("y"))).distinct()


def propagate(adjacent: DataFrame, rounds: int = ROUNDS, cut_every: int = 4) -> DataFrame:
    """(tenant_id, entity_id, community) after `rounds` synchronous rounds.

    Every node takes the most frequent label of its neighbours, the least of equals; labels start as the node's own id.
    Rounds are synchronous, so a round is one join and one aggregation however large the graph, and the outcome doesn't
    depend on any order; it can differ from a sequential pass. A node whose label is as frequent as the best keeps it,
    which ends most two-step oscillation. Lineage is cut in the shared folder every `cut_every` rounds.
    """
    labels = adjacent.select("tenant_id", F.col("x").alias("entity_id")).distinct().withColumn("community", F.col("entity_id"))
    for i in range(rounds):
        seen = adjacent.join(labels.withColumnRenamed("entity_id", "y"), ["tenant_id", "y"]).groupBy("tenant_id", "x", "community").agg(F.count(F.lit(1)).alias("n"))
        own = labels.select("tenant_id", F.col("entity_id").alias("x"), F.col("community").alias("own"))
        votes = seen.join(own, ["tenant_id", "x"])
        best = votes.groupBy("tenant_id", "x").agg(F.min_by("community", F.struct((-F.col("n")).alias("n"), (F.col("community") != F.col("own")).alias("o"), "community")).alias("community"))
        labels = best.withColumnRenamed("x", "entity_id")
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            labels = stored(labels, "labels")
    return labels


def rank_communities(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities of at least 3 members, the 200 largest per tenant: members, internal edges, density."""
    sizes = labels.groupBy("tenant_id", "community").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= LEAST_MEMBERS)
    e = edges.where("source_id <> target_id").select("tenant_id", "source_id", F.upper("edge_type").alias("edge_type"), "target_id").distinct()
    a = labels.select("tenant_id", F.col("entity_id").alias("source_id"), F.col("community").alias("ca"))
    b = labels.select("tenant_id", F.col("entity_id").alias("target_id"), F.col("community").alias("cb"))
    inside = e.join(a, ["tenant_id", "source_id"]).join(b, ["tenant_id", "target_id"]).where("ca = cb").groupBy("tenant_id", F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("internal_edges"))
    rows = sizes.join(inside, ["tenant_id", "community"], "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    w = Window.partitionBy("tenant_id").orderBy(F.desc("members"), "community")
    rows = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= MOST_COMMUNITIES)
    return rows.withColumn("density", F.round(F.col("internal_edges") / F.col("members"), 4))


#: Relations a report tells, members it lists and names in its title (fixed values of the report).
TOLD_RELATIONS, TOLD_MEMBERS = 6, 15


def reports(labels: DataFrame, ranked: DataFrame, adjacent: DataFrame, names: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Extractive reports: (tenant_id, community, title, summary, members). The title names the two best connected.

    With edges, the first six relations inside the community (by source, type, target) are told.
    """
    degree = adjacent.groupBy("tenant_id", F.col("x").alias("entity_id")).agg(F.count(F.lit(1)).alias("degree"))
    n = names.groupBy("tenant_id", "entity_id").agg(F.min("entity_name").alias("name"), F.min("label").alias("label"))
    rows = labels.join(ranked.select("tenant_id", "community", "members", "internal_edges"), ["tenant_id", "community"]).join(degree, ["tenant_id", "entity_id"], "left").join(n, ["tenant_id", "entity_id"], "left")
    rows = rows.withColumn("name", F.coalesce("name", "entity_id"))
    w = Window.partitionBy("tenant_id", "community").orderBy(F.desc("degree"), "entity_id")
    top = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOLD_MEMBERS)
    lists = top.groupBy("tenant_id", "community", "members", "internal_edges").agg(F.sort_array(F.collect_list(F.struct("r", "name"))).alias("x"))
    kinds = rows.groupBy("tenant_id", "community", F.coalesce("label", F.lit("Entity")).alias("label")).count()
    kinds = kinds.groupBy("tenant_id", "community").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "label"))).alias("k"))
    who = F.transform("x", lambda s: s["name"])
    what = F.array_join(F.transform("k", lambda s: F.concat((-s["c"]).cast("string"), F.lit(" "), s["label"])), ", ")
    out = lists.join(kinds, ["tenant_id", "community"])
    told = F.lit("")
    if edges is not None:
        e = edges.where("source_id <> target_id").select("tenant_id", "source_id", F.upper("edge_type").alias("edge_type"), "target_id").distinct()
        for side in ("source", "target"):
            e = e.join(rows.select("tenant_id", F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("community").alias(f"{side}_c")), ["tenant_id", f"{side}_id"])
        w = Window.partitionBy("tenant_id", "source_c").orderBy("source_id", "edge_type", "target_id")
        e = e.where("source_c = target_c").withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOLD_RELATIONS)
        line = F.concat_ws(" ", "source_name", F.lower(F.regexp_replace("edge_type", "_", " ")), "target_name")
        e = e.groupBy("tenant_id", F.col("source_c").alias("community")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("line")))), lambda s: s["line"]), "; ").alias("told"))
        out = out.join(e, ["tenant_id", "community"], "left")
        told = F.coalesce(F.concat(F.lit(" Key relations: "), "told", F.lit(".")), F.lit(""))
    summary = F.concat(F.lit("A group of "), "members", F.lit(" ("), what, F.lit(") with "), "internal_edges", F.lit(" relations."), told, F.lit(" Members: "), F.array_join(who, ", "), F.lit("."))
    return out.select("tenant_id", "community", F.substring(F.array_join(F.slice(who, 1, 2), " & "), 1, 80).alias("title"), summary.alias("summary"), "members")


REPORT = "community_report"


def report_chunks(told: DataFrame) -> DataFrame:
    """Reports as chunks, so that a search over chunks finds them: of kind community_report, in a document 'communities'."""
    return told.select(
        "tenant_id", F.concat_ws(":", F.lit("community"), "tenant_id", "community").alias("chunk_id"), F.lit("communities").alias("doc"), F.lit(REPORT).alias("kind"),
        F.concat_ws("\n", "title", "summary").alias("text"), F.concat(F.lit("Community report · "), "title").alias("citation"),
    )


def of_kind(chunks: DataFrame, reports_only: bool, kind: str = "kind") -> DataFrame:
    """Chunks that are reports, or those that aren't; a chunk of no kind isn't."""
    is_report = F.coalesce(F.col(kind) == REPORT, F.lit(False))
    return chunks.where(is_report if reports_only else ~is_report)
