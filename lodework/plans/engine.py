"""The engine: provision, ingest, search, evaluate. A batch of queries is one plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodework.functions import text as tx
from lodework.functions import vocabulary as vo
from lodework.operators import chunking, community, context, extract, graph, guards, metrics, resolve, retrieval, routing, structured, understand
from lodework.operators.embedding import HASHED as EMBEDDING_VERSION
from lodework.session import REQUIRED, kept, stored
from lodework.sources.cache import LEXICAL_TTL, VECTOR_TTL, VersionCache
from lodework.sources.store import Store

@dataclass
class Result:
    plan: DataFrame
    hits: DataFrame
    nodes: DataFrame
    edges: DataFrame
    context: DataFrame
    questions: DataFrame  # what is asked back, for queries that name nothing


@dataclass
class Engine:
    spark: SparkSession
    root: str
    domains: dict[str, str] = field(default_factory=dict)  # the vocabulary of each tenant; others are generic
    store: Store = field(init=False)
    cache: VersionCache = field(default_factory=VersionCache)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)

    def provision(self, tenant: str) -> None:
        self.store.provision(guards.Tenant(tenant))

    def verify(self, tenant: str) -> DataFrame:
        return self.store.verify(guards.Tenant(tenant))

    def ready(self) -> list[str]:
        """What stands against working: settings that results rely on, and a root that can't be reached. Empty where all is well."""
        wrong = [f"{k} should be {v}" for k, v in REQUIRED.items() if self.spark.conf.get(k, None) != v]
        try:
            self.store.tenants()
        except Exception as e:  # noqa: BLE001  reported, not hidden
            wrong.append(f"the store can't be read: {e}")
        return wrong

    def _vocabulary(self, t: guards.Tenant) -> dict[str, list[str]]:
        return vo.DOMAINS[self.domains.get(t.name, "generic")]

    def ingest(self, tenant: str, documents: DataFrame) -> DataFrame:
        """Markdown documents (doc_id, text) into chunks, entities, edges and mentions; returns counts per table.

        Prose is read for names and relations, tables for what their columns say. Re-ingesting a document replaces its
        chunks and mentions. Rejected chunks are dropped before chunks are linked, and merged names take their mentions
        with them.
        """
        t = guards.Tenant(tenant)
        blocks = chunking.parse_markdown(documents, "doc_id", "text").withColumn("tenant_id", F.lit(t.name))
        blocks = stored(blocks.withColumn("doc", F.col("doc").cast("string")), "blocks")
        packed = chunking.validate(chunking.chunk_blocks(blocks, "doc")).where("valid").drop("issues", "valid")
        chunks = stored(chunking.linked(packed).withColumn("embedding_version", F.lit(EMBEDDING_VERSION)), "chunks")
        found = stored(extract.extract(chunks.where(routing.method(F.col("kind")) == "prose"), self.domains), "extracted")
        prose = extract.vertices(found).select("tenant_id", "entity_id", "label", "entity_name", "confidence", "mention_count")
        numbered = blocks.withColumns({"block_no": F.xxhash64("doc", "block_pos"), "source_uri": F.col("doc")})
        rows = routing.table_records(numbered).withColumn("record_id", F.xxhash64("block_no", "row_index"))
        told, said = structured.record_graph(rows, structured.profile_columns(rows))
        tables = told.select("tenant_id", "entity_id", "label", F.col("name").alias("entity_name"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("mention_count"))
        edges = extract.edges(found).unionByName(said.groupBy("tenant_id", "source_id", "edge_type", "target_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("support_count")), allowMissingColumns=True)
        return self._write(t, chunks, prose.unionByName(tables), edges, extract.mentions(found), documents.select(F.col("doc_id").alias("doc")))

    def ingest_records(self, tenant: str, records: DataFrame) -> DataFrame:
        """Rows of sheets (record_id, source_uri, row_index, cells) into record chunks, entities with aliases, edges and mentions.

        Columns are profiled over all rows at once; a row is a chunk of its sheet's document, told by its columns' roles.
        """
        t = guards.Tenant(tenant)
        r = stored(records.select("record_id", F.lit(t.name).alias("tenant_id"), F.coalesce("source_uri", F.lit("records")).alias("source_uri"), "row_index", "cells"), "records")
        profiles = stored(structured.profile_columns(r), "profiles")
        place = r.select("record_id", F.col("source_uri").alias("doc"), F.row_number().over(Window.partitionBy("source_uri").orderBy("row_index", "record_id")).alias("n"))
        texts = structured.verbalize(r, profiles).join(place, "record_id")
        chunks = texts.select("record_id", F.lit(t.name).alias("tenant_id"), "doc", (F.col("n") - 1).alias("chunk_index"), F.lit("record").alias("kind"), "text", tx.token_count(F.col("text")).alias("token_count"), F.lit(EMBEDDING_VERSION).alias("embedding_version"))
        chunks = stored(chunking.linked(chunks), "chunks")
        told, said = structured.record_graph(r, profiles)
        said = stored(said, "said").join(chunks.select("record_id", "chunk_id"), "record_id")
        entities = told.select("tenant_id", "entity_id", "label", F.col("name").alias("entity_name"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("mention_count"))
        names = structured.aliases(r, profiles).groupBy("tenant_id", "entity_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
        edges = said.groupBy("tenant_id", "source_id", "edge_type", "target_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("support_count"), F.min("chunk_id").alias("chunk_id"), F.lit(None).cast("string").alias("evidence"))
        mentions = said.select("tenant_id", "chunk_id", F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct()
        return self._write(t, chunks.drop("record_id"), entities, edges, mentions, r.select(F.col("source_uri").alias("doc")), names, gate=False)

    def _write(self, t: guards.Tenant, chunks: DataFrame, vertices: DataFrame, edges: DataFrame, mentions: DataFrame, documents: DataFrame, aliases: DataFrame | None = None, gate: bool = True) -> DataFrame:
        """Merges names, gates edges by the tenant's vocabulary and known ends, and writes all four tables, chunks first."""
        vertices = stored(vertices, "vertices")
        merged = resolve.greedy_merge(vertices.withColumn("vertex_id", F.xxhash64("tenant_id", "entity_id")).dropDuplicates(["vertex_id"]))
        ids = vertices.select(F.xxhash64("tenant_id", "entity_id").alias("vertex_id"), "entity_id").distinct()
        canon = stored(merged.join(ids, "vertex_id").join(ids.withColumnsRenamed({"vertex_id": "canonical_id", "entity_id": "canonical"}), "canonical_id").select("entity_id", "canonical"), "canonical")
        to = lambda df, c: df.join(canon.withColumnRenamed("entity_id", c), c, "left").withColumn(c, F.coalesce("canonical", c)).drop("canonical")
        best = F.struct("confidence", "entity_name")
        entities = to(vertices, "entity_id").groupBy("tenant_id", "entity_id").agg(F.max_by("label", best).alias("label"), F.max_by("entity_name", best).alias("entity_name"), F.max("confidence").alias("confidence"), F.sum("mention_count").alias("mention_count"))
        if aliases is not None:
            entities = entities.join(to(aliases, "entity_id").groupBy("tenant_id", "entity_id").agg(F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases")), ["tenant_id", "entity_id"], "left")
        entities = stored(entities, "entities")
        edges = to(to(edges, "source_id"), "target_id").where("source_id <> target_id")
        edges = edges.groupBy("tenant_id", "source_id", "edge_type", "target_id").agg(F.max("confidence").alias("confidence"), F.sum("support_count").alias("support_count"), F.min("chunk_id").alias("chunk_id"), F.min("evidence").alias("evidence"))
        known = entities.select("tenant_id", "entity_id").unionByName(self.store.read(t, "entities").select("tenant_id", "entity_id"))
        types = sorted({*self._vocabulary(t)["edges"], *vo.DOMAINS["generic"]["edges"]}) if gate else sorted({*vo.DOMAINS["generic"]["edges"], *(e for _, e in structured.EDGES)})
        edges = graph.edge_gate(edges, known, types).where("reason is null").drop("reason")
        mentions = to(mentions, "entity_id").distinct().join(known.distinct(), ["tenant_id", "entity_id"], "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        self.store.upsert(t, "chunks", chunks, documents)
        self.store.upsert(t, "entities", entities)
        self.store.upsert(t, "edges", edges)
        self.store.upsert(t, "mentions", mentions, documents)
        return self.verify(t.name)

    def counts(self, tenant: str) -> DataFrame:
        """(table, kind, rows): chunks by kind, entities by label, edges by type."""
        t = guards.Tenant(tenant)
        parts = [self.store.read(t, table).groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table"), "kind", "rows") for table, c in (("chunks", "kind"), ("entities", "label"), ("edges", "edge_type"))]
        return reduce(DataFrame.unionByName, parts)

    def search(self, tenant: str, queries: DataFrame, top_k: int = 5) -> Result:
        """queries (query_id, query_text) answered from the tenant's tables, all in one plan."""
        t = guards.Tenant(tenant)
        guards.in_bounds("top_k", top_k)
        bad = queries.where(guards.violation(F.col("query_text")).isNotNull()).limit(1).collect()
        if bad:
            raise guards.GuardError(f"query {bad[0]['query_id']} is refused")
        read = lambda name: self.store.read(t, name)
        chunks = read("chunks")
        told = community.of_kind(chunks, True).select("tenant_id", F.col("chunk_id").alias("doc"), "text")
        plain = community.of_kind(chunks, False)
        docs = plain.select("tenant_id", F.col("chunk_id").alias("doc"), "text")
        postings = self.cache.get((t.name, "postings"), self.store.version(t, "chunks"), LEXICAL_TTL, lambda: retrieval.build_index(docs, "doc").postings)
        vectors = self.cache.get((t.name, "vectors"), self.store.version(t, "chunks"), VECTOR_TTL, lambda: retrieval.hash_rows(docs))
        return hybrid(queries.withColumn("tenant_id", F.lit(t.name)), plain, read("entities"), read("edges"), read("mentions"), top_k, told, postings, vectors)

    def communities(self, tenant: str) -> DataFrame:
        """Finds the communities of a tenant, tells them, and stores the reports as chunks that searches find."""
        t = guards.Tenant(tenant)
        e, v = self.store.read(t, "edges"), self.store.read(t, "entities")
        adjacent = kept(community.adjacency(e, v))
        labels = community.propagate(adjacent)
        told = stored(community.reports(labels, community.rank_communities(labels, e), adjacent, v, e), "reports")
        chunks = community.report_chunks(told).withColumns({"token_count": tx.token_count(F.col("text")), "embedding_version": F.lit(EMBEDDING_VERSION)})
        self.store.upsert(t, "chunks", chunks)
        return told

    @staticmethod
    def evaluate(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        return metrics.ranking_metrics(ranked, relevant, queries, k)


def _walk(edges: DataFrame, seeds: DataFrame, plan: DataFrame, depth: str) -> DataFrame:
    """Nodes around the seeds of each query, as many hops away as the plan's column says."""
    deep = stored(seeds.join(plan.select("query_id", F.col(depth).alias("depth")), "query_id"), "seeds")
    depths = sorted(r["depth"] for r in deep.select("depth").distinct().collect()) or [1]  # three at most
    return stored(reduce(DataFrame.unionByName, [graph.traverse(edges, deep.where(F.col("depth") == d), d) for d in depths]), "walked")


def _reports(queries: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(tenant_id, doc, text): the community reports of the tenants that the queries are of."""
    asked = queries.select("tenant_id").distinct()
    e, v = (df.join(asked, "tenant_id", "left_semi") for df in (edges, entities))
    adjacent = stored(community.adjacency(e, v), "adjacent")
    labels = stored(community.propagate(adjacent), "communities")
    told = community.reports(labels, community.rank_communities(labels, e), adjacent, v, e)
    return told.select("tenant_id", F.concat_ws(":", F.lit("community"), "tenant_id", "community").alias("doc"), F.concat_ws("\n", "title", "summary").alias("text"))


def hybrid(queries: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame, top_k: int = 5, reports: DataFrame | None = None, postings: DataFrame | None = None, vectors: DataFrame | None = None) -> Result:
    """Understand, plan, search by words, hashed vectors and the graph, fuse by the plan's weights, expand, rerank, pack.

    After the fusion come, as the plan says, chunks around the entities of the best chunks and community reports; all are
    reranked together. A query that names nothing gets a question back and no search; one whose plan found nothing is
    swept by words. Every path stays within the tenant of the query. reports, postings and vectors may be given where
    they are kept; reports are else made here.
    """
    plan = stored(understand.plan(understand.analyse(queries), top_k), "plan")
    many = max(4 * top_k, 20)
    docs = chunks.select("tenant_id", F.col("chunk_id").alias("doc"), "text")
    index = retrieval.build_index(docs, "doc") if postings is None else retrieval.index_of(postings)
    by_words = retrieval.top(retrieval.bm25(index, retrieval.query_terms(plan.where("intent <> 'clarify'"))), many).select("query_id", "doc", F.lit("lexical").alias("path"), "rank")
    by_words = stored(by_words, "words")
    lexical = by_words.join(plan.where("use_lexical").select("query_id", "lexical_k"), "query_id").where("rank <= lexical_k").drop("lexical_k")
    q = retrieval.hash_rows(plan.where("use_vector"), "query_id", "query_text")
    vector = retrieval.hashed_search(q, retrieval.hash_rows(docs) if vectors is None else vectors, many).select("query_id", "doc", F.lit("vector").alias("path"), "rank")
    vector = vector.join(plan.select("query_id", "vector_k"), "query_id").where("rank <= vector_k").drop("vector_k")
    asked = plan.where("use_graph").select("query_id", "tenant_id", F.explode("mentions").alias("mention"))
    known = entities if "aliases" in entities.columns else entities.withColumn("aliases", F.lit(None).cast("array<string>"))
    linked = stored(resolve.link_mentions(asked, known), "linked")
    seeds = linked.select("query_id", "tenant_id", "entity_id").distinct()
    walked = _walk(edges, seeds, plan, "graph_depth")
    by_graph = graph.graph_to_text(walked, mentions).select("query_id", F.col("chunk_id").alias("doc"), F.lit("graph").alias("path"), "rank")
    lists = lexical.unionByName(vector).unionByName(by_graph).join(plan.select("query_id", "w_vector", "w_lexical", "w_graph"), "query_id")
    weight = F.when(F.col("path") == "vector", F.col("w_vector")).when(F.col("path") == "lexical", F.col("w_lexical")).otherwise(F.col("w_graph"))
    fused = stored(retrieval.fuse(lists.withColumn("weight", weight), many), "fused")
    first = fused.join(plan.where("use_expansion").select("query_id", "tenant_id"), "query_id").withColumnRenamed("doc", "chunk_id")
    expanded = _walk(edges, graph.text_to_graph(first, mentions).select("query_id", "tenant_id", "entity_id"), plan, "expansion_hops")
    around = graph.graph_to_text(expanded, mentions).select("query_id", F.col("chunk_id").alias("doc"), F.lit("expansion").alias("path"), "rank")
    after = fused.select("query_id", "doc", "path", "rank").withColumn("list_no", F.lit(0)).unionByName(around.withColumn("list_no", F.lit(1)))
    texts, wide = docs.select("doc", "text"), plan.where("use_community")
    if not wide.isEmpty():
        told = stored(_reports(wide, edges, entities) if reports is None else reports, "reports")
        q = retrieval.hash_rows(wide, "query_id", "query_text")
        near = retrieval.hashed_search(q, retrieval.hash_rows(told), many).drop("tenant_id").join(wide.select("query_id", "community_k"), "query_id").where("rank <= community_k")
        after = after.unionByName(near.select("query_id", "doc", F.lit("community").alias("path"), "rank", F.lit(2).alias("list_no")))
        texts = texts.unionByName(told.select("doc", "text"))
    sweep = by_words.join(plan.select("query_id").join(after.select("query_id").distinct(), "query_id", "left_anti"), "query_id")
    after = after.unionByName(sweep.select("query_id", "doc", F.lit("fallback").alias("path"), "rank", F.lit(3).alias("list_no")))
    after = stored(retrieval.first_seen(after), "candidates")
    best = retrieval.rerank(after, queries, texts, many + graph.MOST_CHUNKS).where(F.col("rank") <= 2 * top_k)
    hits = best.join(after.select("query_id", "doc", "path"), ["query_id", "doc"]).join(fused.select("query_id", "doc", F.col("score").alias("rrf_score")), ["query_id", "doc"], "left").join(texts, "doc")
    both = walked.unionByName(expanded).groupBy("query_id", "tenant_id", "entity_id").agg(F.min("hop").alias("hop"))
    both = both.join(seeds.withColumn("is_seed", F.lit(True)), ["query_id", "tenant_id", "entity_id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    found = graph.recover_edges(edges, walked).unionByName(graph.recover_edges(edges, expanded)).distinct()
    nodes, subgraph = graph.prune(both, found, graph.MOST_NODES)
    nodes = nodes.select("query_id", "tenant_id", "entity_id", "hop")
    scored = subgraph.join(edges.select("tenant_id", "source_id", F.upper("edge_type").alias("edge_type"), "target_id", "confidence").dropDuplicates(["tenant_id", "source_id", "edge_type", "target_id"]), ["tenant_id", "source_id", "edge_type", "target_id"])
    told = graph.passages(scored, known, seeds)
    questions = plan.where("intent = 'clarify'").select("query_id", "reason", understand.clarification(F.col("reason"), F.col("query_text")).alias("prompt"))
    return Result(plan, hits, nodes, subgraph, context.pack(hits, most=top_k, passages=told), questions)
