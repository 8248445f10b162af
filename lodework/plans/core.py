"""Queries of the core operators over the test tables. Their SQL is in core_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.functions import text as tx
from lodework.operators import chunking, community, context, extract, graph, guards, matching, metrics, multivalue, proposals, resolve, retrieval, structured, understand
from lodework.plans import engine
from lodework.session import kept
from lodework.streaming import streams
from lodework.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The indexed chunks, once each: (tenant_id, doc, chunk_id, text)."""
    rows = table(spark, d, "lexical_docs").groupBy("tenant_id", F.col("chunk_no").alias("doc")).agg(F.max("chunk_id").alias("chunk_id"), F.max("text").alias("text"))
    return rows.where("text is not null")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries")


# ---------------------------------------------------------------- several values in one field


@_query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of the cells that hold two or more."""
    return p4_values(spark, d).where("n_values > 1").drop("n_values").distinct()


@_query
def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every list cell."""
    return multivalue.split_values(spread(table(spark, d, "records").select("record_id", "cells")))


# ---------------------------------------------------------------- scalars


@_query
def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities")
    return e.select("vertex_id", tx.normalize_name(F.col("entity_name")).alias("norm"), tx.entity_id(F.col("label"), F.col("entity_name")).alias("canonical"), tx.slug(F.col("label")).alias("slug"))


@_query
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _chunks(spark, d).select("doc", tx.token_count(t).alias("tokens"), F.round(tx.alpha_share(t), 6).alias("alpha"), F.size(tx.sentences(t)).alias("n_sentences"), tx.tail_words(t, 20).alias("tail"), F.size(tx.terms(t)).alias("n_terms"))


@_query
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").select(F.explode("cells").alias("c")).select(F.col("c.column_name").alias("column_name"), F.col("c.cell_value").alias("v"))
    return rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.is_null_token(F.col("v"))).alias("n_null"), F.count_if(tx.is_null_token(F.col("v"), tx.NULLS_COLUMN)).alias("n_null_wide"))


@_query
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hash_embed(_chunks(spark, d)).withColumn("weight", F.round("weight", 6))


@_query
def key_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subjects").select("entity_id", tx.fingerprint(F.col("entity_id")).alias("fingerprint"))


# ---------------------------------------------------------------- ranking


def _index(spark: SparkSession, d: str) -> retrieval.Index:
    i = retrieval.build_index(_chunks(spark, d), "doc")
    return retrieval.Index(kept(i.postings), i.stats)


@_query
def bm25_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.index_stats(retrieval.build_index(_chunks(spark, d), "doc"))


@_query
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.top(retrieval.bm25(_index(spark, d), retrieval.query_terms(_queries(spark, d))), 10)
    return hits.select("query_id", "doc", "rank", "relative", F.round("score", 4).alias("score"))


@_query
def bm25_phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    scored = retrieval.bm25(_index(spark, d), retrieval.query_terms(q, text="passage"))
    phrases = q.select("query_id", F.col("expected_text").alias("phrases"))
    return retrieval.top(retrieval.boost_phrases(scored, _chunks(spark, d).select("doc", "text"), phrases), 5).select("query_id", "doc", "rank", "hits")


@_query
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every 50th usable vector against all of its tenant."""
    rows = table(spark, d, "indexed_chunks").where("embedding_version = 'sim-embed/96/v2' and size(vector) = 96").select("tenant_id", F.col("chunk_no").alias("doc"), "vector")
    rows = rows.where(F.forall("vector", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return retrieval.exact_search(rows.where("doc % 50 = 0").withColumnRenamed("doc", "query_id"), rows, 10, "tenant_id")


@_query
def knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return retrieval.exact_search(rows.where("doc % 50 = 0").withColumnRenamed("doc", "query_id"), rows, 10)


@_query
def knn_hashed(spark: SparkSession, d: str) -> DataFrame:
    """The 10 chunks of a query's own tenant that are nearest by hashed embedding."""
    q = retrieval.hash_rows(_queries(spark, d), "query_id", "query_text")
    return retrieval.hashed_search(q, retrieval.hash_rows(_chunks(spark, d)), 10).select("query_id", "doc", "score", "rank")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists per query: BM25 over the query text, and over its passage."""
    index = _index(spark, d)
    a = retrieval.top(retrieval.bm25(index, retrieval.query_terms(_queries(spark, d))), 20)
    b = retrieval.top(retrieval.bm25(index, retrieval.query_terms(_queries(spark, d), text="passage")), 20)
    one = a.select("query_id", "doc", F.lit("text").alias("path"), "rank", F.lit(1).alias("list_no"))
    return one.unionByName(b.select("query_id", "doc", F.lit("passage").alias("path"), "rank", F.lit(2).alias("list_no")))


@_query
def rrf_fused(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_lists(spark, d), 10).select("query_id", "doc", "rank", "path", "score")


@_query
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_lists(spark, d), 10, {"text": 0.7, "passage": 1.6}).select("query_id", "doc", "rank", "path", "score")


@_query
def lists_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.first_seen(_lists(spark, d))


@_query
def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse(_lists(spark, d), 20)
    return retrieval.rerank(fused, _queries(spark, d), _chunks(spark, d), 5).select("query_id", "doc", "rank", "score")


@_query
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    found = _lists(spark, d).where("path = 'text' and rank <= 3").select("query_id", "doc", "path", "rank")
    sweep = _lists(spark, d).where("path = 'passage' and rank <= 3").select("query_id", "doc", "path", "rank")
    return retrieval.with_fallback(found, _queries(spark, d), sweep)


# ---------------------------------------------------------------- evaluation


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the tenant that mention an expected entity of the query."""
    q = _queries(spark, d).select("query_id", "tenant_id", F.explode("expected_entities").alias("entity_id"))
    m = table(spark, d, "mentions").where("chunk_id is not null").select("tenant_id", "entity_id", "chunk_id").distinct()
    rows = m.join(q, ["tenant_id", "entity_id"]).join(_chunks(spark, d).select("doc", "chunk_id"), "chunk_id")
    return rows.select("query_id", "doc").distinct()


@_query
def marker_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain an expected text of a query, in any case: the held-out markers against every document."""
    q = _queries(spark, d).select(F.explode("expected_text").alias("marker")).distinct()
    found = matching.phrases_in(table(spark, d, "documents").select("doc_id", "text"), q.withColumnRenamed("marker", "phrase"))
    n = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return q.withColumn("phrase", F.lower("marker")).join(n, "phrase").select("marker", "n")


@_query
def relevant_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _relevant(spark, d)


def _metrics(spark: SparkSession, d: str, text: str) -> DataFrame:
    q = _queries(spark, d)
    ranked = retrieval.top(retrieval.bm25(_index(spark, d), retrieval.query_terms(q, text=text)), 10)
    return metrics.ranking_metrics(ranked, _relevant(spark, d), q).join(q.select("query_id", "category"), "query_id")


@_query
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d, "query_text").drop("category")


@_query
def metrics_by_category(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_category(_metrics(spark, d, "query_text"), ["recall", "precision", "mrr", "ndcg", "hit"])


@_query
def configuration_lift(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lift(_metrics(spark, d, "query_text"), _metrics(spark, d, "passage"), "recall")


@_query
def configurations(spark: SparkSession, d: str) -> DataFrame:
    """Quality of eight configurations over the same questions: which lists they stack, fuse and rerank."""
    q = _queries(spark, d).withColumn("query_text", F.col("passage"))
    c = _chunks(spark, d)
    lexical = retrieval.top(retrieval.bm25(_index(spark, d), retrieval.query_terms(q)), 30).select("query_id", "doc", F.lit("lexical").alias("path"), "rank")
    vector = retrieval.hashed_search(retrieval.hash_rows(q, "query_id", "query_text"), retrieval.hash_rows(c), 30).select("query_id", "doc", F.lit("vector").alias("path"), "rank")
    nodes = graph.traverse(table(spark, d, "edges"), _seeds(spark, d), 1)
    by_graph = graph.graph_to_text(nodes, table(spark, d, "mentions")).join(c.select("doc", "chunk_id"), "chunk_id").select("query_id", "doc", F.lit("graph").alias("path"), "rank")
    order = F.when(F.col("path") == "vector", 1).when(F.col("path") == "lexical", 2).otherwise(3)
    lists = kept(lexical.unionByName(vector).unionByName(by_graph).withColumn("list_no", order))
    relevant = kept(_relevant(spark, d))
    out = None
    for key, name, paths, rrf, again in metrics.CONFIGURATIONS:
        own = lists.where(F.col("path").isin(paths.split()))
        ranked = retrieval.fuse(own, 30) if rrf else retrieval.first_seen(own)
        ranked = retrieval.rerank(ranked, q, c, 10) if again else ranked
        m = metrics.ranking_metrics(ranked, relevant, q).where("n_relevant > 0")
        row = m.agg(F.lit(key).alias("config"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x), 6).alias(x) for x in ("recall", "precision", "mrr", "ndcg")])
        out = row if out is None else out.unionByName(row)
    return out


@_query
def passed_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every question by a rule: refusals by intent, the rest by whether its expected text was retrieved."""
    q = _queries(spark, d)
    hits = retrieval.top(retrieval.bm25(_index(spark, d), retrieval.query_terms(q, text="passage")), 5).join(_chunks(spark, d).select("doc", "text"), "doc")
    got = hits.groupBy("query_id").agg(F.collect_list("text").alias("texts"), F.count(F.lit(1)).alias("passages"))
    a = understand.analyse(q).select("query_id", "intent").join(got, "query_id", "left")
    rows = q.join(a, "query_id")
    rule = F.when(F.col("rule") == "REFUSES", "abstains").when(F.col("rule") == "ANSWERS", "retrieves_any").otherwise("retrieves_text")
    null = F.lit(None).cast("string")
    ok = metrics.pass_rule(rule, F.col("texts"), F.col("expected_text"), F.col("expected_text"), F.col("intent"), null, F.lit(0), F.lit(None).cast("int"), F.coalesce("passages", F.lit(0)), F.lit(False))
    return rows.select("query_id", rule.alias("rule"), ok.alias("passed"))


@_query
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d, "query_text").agg(F.avg("recall").alias("r"), F.avg("mrr").alias("m"))
    values = m.select(F.explode(F.array(F.struct(F.lit("recall").alias("name"), F.round("r", 4).alias("value")), F.struct(F.lit("mrr").alias("name"), F.round("m", 4).alias("value")))).alias("x")).select("x.*")
    rules = spark.createDataFrame([("recall", ">=", 0.7, False), ("mrr", ">=", 0.6, False), ("isolation", ">=", 1.0, True)], "name string, op string, target double, hard boolean")
    return metrics.gates(values, rules)


@_query
def stage_report(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.stage_report(table(spark, d, "events"), "event_type", "value")
    return r.select("step", "calls", F.round("mean", 4).alias("mean"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"), F.round("share", 4).alias("share"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("request_id"), F.col("event_type").alias("step"), F.col("value").alias("latency_ms"))


@_query
def telemetry_grid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.telemetry(_steps(spark, d), ["click", "view", "purchase", "signup", "error", "never_run"])


@_query
def slowest_requests(spark: SparkSession, d: str) -> DataFrame:
    return metrics.slowest(_steps(spark, d), 20, ["click", "view", "purchase", "signup", "error"])


# ---------------------------------------------------------------- graph


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select("tenant_id", "entity_id", "entity_name", "label")
    return e.unionByName(table(spark, d, "subjects").select("tenant_id", "entity_id", "entity_name", "label")).where("entity_id is not null")


_TYPES = sorted({t for x in ("film", "ai_research", "generic") for t in engine.extract.vo.DOMAINS[x]["edges"]})


@_query
def edge_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.edge_gate(table(spark, d, "edges"), _vertices(spark, d), _TYPES)
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@_query
def entity_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").withColumn("reason", graph.entity_reason(["Person", "Studio", "Organization", "Film", "Model"]))
    return rows.groupBy("tenant_id", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@_query
def edges_deduped(spark: SparkSession, d: str) -> DataFrame:
    return graph.dedupe_edges(table(spark, d, "edges"))


@_query
def entities_canonical(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical_entities(table(spark, d, "entities"))


@_query
def entities_upserted(spark: SparkSession, d: str) -> DataFrame:
    """The shared subjects, overwritten by the canonical entities of the same id."""
    new = graph.canonical_entities(table(spark, d, "entities")).select("tenant_id", "entity_id", "label", "entity_name")
    return graph.upsert(table(spark, d, "subjects").select("tenant_id", "entity_id", "label", "entity_name"), new, ["tenant_id", "entity_id"])


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", "tenant_id", F.explode("expected_entities").alias("entity_id")).distinct()


@_query
def traverse_1hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(table(spark, d, "edges"), _seeds(spark, d), 1)


@_query
def traverse_2hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(table(spark, d, "edges"), _seeds(spark, d), 2)


@_query
def traverse_3hop_typed(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(table(spark, d, "edges"), _seeds(spark, d), 9, types=_TYPES)


@_query
def recovered_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.recover_edges(table(spark, d, "edges"), graph.traverse(table(spark, d, "edges"), _seeds(spark, d), 2))


@_query
def graph_to_text(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_to_text(graph.traverse(table(spark, d, "edges"), _seeds(spark, d), 1), table(spark, d, "mentions"))


@_query
def text_to_graph(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.top(retrieval.bm25(_index(spark, d), retrieval.query_terms(_queries(spark, d), text="passage")), 8)
    hits = hits.join(_chunks(spark, d).select("doc", "chunk_id"), "doc").select("query_id", "tenant_id", "chunk_id", "rank")
    return graph.text_to_graph(hits, table(spark, d, "mentions"))


def _subgraph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = graph.traverse(table(spark, d, "edges"), _seeds(spark, d), 2)
    return nodes.withColumn("is_seed", F.col("hop") == 0), graph.recover_edges(table(spark, d, "edges"), nodes)


@_query
def pruned_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune(*_subgraph(spark, d), 10)[0].select("query_id", "entity_id", "degree", "rank")


@_query
def pruned_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune(*_subgraph(spark, d), 10)[1].select("query_id", "source_id", "edge_type", "target_id")


@_query
def graph_passages(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.dedupe_edges(table(spark, d, "edges"))
    found = _subgraph(spark, d)[1].join(edges, ["tenant_id", "source_id", "edge_type", "target_id"])
    names = _vertices(spark, d).groupBy("tenant_id", "entity_id").agg(F.min("entity_name").alias("entity_name"))
    return graph.passages(found, names, _seeds(spark, d), 5)


@_query
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunks and deliveries per entity; a hot entity is pre-aggregated map-side."""
    m = table(spark, d, "mentions").where("entity_id is not null")
    return m.groupBy("tenant_id", "entity_id").agg(F.countDistinct("mention_id").alias("mentions"), F.countDistinct("chunk_id").alias("chunks"), F.max("seen_at").alias("last_seen"))


# ---------------------------------------------------------------- communities


def _adjacent(spark: SparkSession, d: str) -> DataFrame:
    return kept(community.adjacency(table(spark, d, "edges"), _vertices(spark, d)))


@_query
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return _adjacent(spark, d)


@_query
def communities(spark: SparkSession, d: str) -> DataFrame:
    return community.propagate(_adjacent(spark, d))


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = _adjacent(spark, d)
    labels = kept(community.propagate(a))
    return a, labels, community.rank_communities(labels, table(spark, d, "edges"))


@_query
def communities_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)[2]


@_query
def community_reports(spark: SparkSession, d: str) -> DataFrame:
    a, labels, ranked = _ranked(spark, d)
    return community.reports(labels, ranked, a, _vertices(spark, d), table(spark, d, "edges"))


@_query
def community_report_chunks(spark: SparkSession, d: str) -> DataFrame:
    return community.report_chunks(community_reports(spark, d))


# ---------------------------------------------------------------- blocks and chunks


@_query
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.parse_markdown(spread(table(spark, d, "documents").select("doc_id", "text"))).drop("table_headers", "table_rows")


@_query
def document_headings(spark: SparkSession, d: str) -> DataFrame:
    b = chunking.parse_markdown(spread(table(spark, d, "documents").select("doc_id", "text")))
    return b.where("kind = 'heading'").groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("headings"), F.min("heading_level").alias("top_level"))


@_query
def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.linked(chunking.validate(chunking.chunk_blocks(table(spark, d, "blocks"))).where("valid").drop("issues", "valid"))


@_query
def block_issues(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").select("block_no", "kind", "text", tx.token_count(F.col("text")).alias("token_count"))
    rows = chunking.validate(b)
    return rows.select("block_no", F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(":"), i["severity"])), ",").alias("issues"), "valid")


@_query
def sibling_links(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("doc_key is not null").select("tenant_id", F.col("doc_key").alias("doc"), F.col("block_pos").alias("chunk_index"), "block_no")
    return chunking.linked(b).select("block_no", "chunk_id", "prev_chunk_id", "next_chunk_id")


@_query
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.table_chunks(table(spark, d, "blocks"))


@_query
def record_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.record_blocks(table(spark, d, "records"))


@_query
def block_citations(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks")
    return b.select("block_no", tx.cite(F.col("source_uri"), F.col("page"), F.col("row_index"), F.col("section_path")).alias("citation"), chunking.contextual(F.col("section_path"), F.col("text"), F.col("kind")).alias("embedded"))


@_query
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    return chunking.document_summary(table(spark, d, "blocks"))


# ---------------------------------------------------------------- structured records


@_query
def column_profiles(spark: SparkSession, d: str) -> DataFrame:
    return structured.profile_columns(table(spark, d, "records")).drop("ordinal")


@_query
def record_edges(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records")
    return structured.record_graph(r, structured.profile_columns(r))[1]


@_query
def record_vertices(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records")
    return structured.record_graph(r, structured.profile_columns(r))[0]


@_query
def records_verbalized(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records")
    return structured.verbalize(r, structured.profile_columns(r))


# ---------------------------------------------------------------- extraction and resolution


#: The vocabulary of each tenant of the test tables.
DOMAINS = {"movies_bot": "film", "ai_trends_bot": "ai_research"}


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(spread(_chunks(spark, d)), DOMAINS)


@_query
def extracted_entities(spark: SparkSession, d: str) -> DataFrame:
    return extract.vertices(_extracted(spark, d))


@_query
def extracted_edges(spark: SparkSession, d: str) -> DataFrame:
    return extract.edges(_extracted(spark, d))


@_query
def resolution_matches(spark: SparkSession, d: str) -> DataFrame:
    return resolve.matches(resolve.candidates(resolve.names_of(table(spark, d, "entities")))).select("a", "b", "norm_a", "norm_b", "score")


@_query
def resolution_greedy(spark: SparkSession, d: str) -> DataFrame:
    return resolve.greedy_merge(table(spark, d, "entities"))


@_query
def linked_mentions(spark: SparkSession, d: str) -> DataFrame:
    asked = understand.analyse(_queries(spark, d), "passage").select("query_id", "tenant_id", F.explode("mentions").alias("mention"))
    return resolve.link_mentions(asked, table(spark, d, "entities"))


@_query
def mentions_remapped(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").where("entity_id is not null").select("tenant_id", "entity_id", tx.entity_id(F.col("label"), F.col("entity_name")).alias("canonical_id"))
    e = e.groupBy("tenant_id", "entity_id").agg(F.min("canonical_id").alias("canonical_id"))
    return resolve.remap(table(spark, d, "mentions"), e)


_GENERIC = engine.extract.vo.DOMAINS["generic"]


@_query
def coerced_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("vertex_id", proposals.coerce_label(F.col("label"), _GENERIC["labels"]).alias("label"))


@_query
def coerced_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select("edge_type", proposals.coerce_relation(F.col("edge_type"), _GENERIC["edges"]).alias("coerced"), "n")


# ---------------------------------------------------------------- queries


@_query
def query_analysis(spark: SparkSession, d: str) -> DataFrame:
    a = understand.analyse(_queries(spark, d))
    return a.select("query_id", F.array_join("mentions", "|").alias("mentions"), F.array_join("identifiers", "|").alias("identifiers"), "hops", "global_score", "local_score", "lexical_score", "intent", "confidence")


@_query
def query_plans(spark: SparkSession, d: str) -> DataFrame:
    p = understand.plan(understand.analyse(_queries(spark, d)))
    return p.select("query_id", "intent", "use_vector", "use_lexical", "use_graph", "use_community", "use_expansion", "vector_k", "lexical_k", "graph_depth", "expansion_hops", "w_vector", "w_lexical", "w_graph", "w_community")


@_query
def context_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The queries of a tenant as one conversation, every seventh turn a bare follow-up."""
    q = _queries(spark, d)
    said = F.when(F.col("query_id") % 14 == 0, "what about it?").when(F.col("query_id") % 7 == 0, "more").otherwise(F.col("query_text"))
    return understand.resolve_context(q.select(F.col("tenant_id").alias("conv_id"), F.col("query_id").alias("turn"), said.alias("text")))


@_query
def clarifications(spark: SparkSession, d: str) -> DataFrame:
    """What is asked back for the questions of a conversation that name nothing, where every seventh turn is such a one."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("it", "more", "herbs", "other documents", "what about that?")]), (F.col("query_id") % 5 + 1).cast("int"))
    q = _queries(spark, d).select("query_id", F.when(F.col("query_id") % 7 == 0, said).otherwise(F.col("query_text")).alias("query_text"))
    a = understand.analyse(q).where("reason is not null")
    return a.select("query_id", "reason", "intent", understand.clarification(F.col("reason"), F.col("query_text")).alias("prompt"))


@_query
def input_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", guards.violation(F.col("text")).alias("violation"))
    return rows.where("violation is not null")


@_query
def tenant_purity(spark: SparkSession, d: str) -> DataFrame:
    """Entities mentioned by chunks of another tenant."""
    m = table(spark, d, "mentions").where("entity_id is not null and chunk_id is not null")
    c = table(spark, d, "indexed_chunks").select("chunk_id", F.col("tenant_id").alias("chunk_tenant"))
    rows = m.join(c, "chunk_id")
    return rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tenant_id") != F.col("chunk_tenant")).alias("foreign_rows"))


@_query
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    return guards.arrivals_in_window(table(spark, d, "events"), "user_id", "ts", 3600, 3).select("event_id", "arrivals", "over")


@_query
def rate_limit_exact(spark: SparkSession, d: str) -> DataFrame:
    return streams.Limiter(3600, 3).batch(table(spark, d, "events")).select("event_id", "allowed")


@_query
def latency_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.latency_windows(table(spark, d, "events"))


# ---------------------------------------------------------------- the whole way


def _hybrid(spark: SparkSession, d: str) -> engine.Result:
    e = table(spark, d, "entities").where("entity_id is not null").select("tenant_id", "entity_id", "label", "entity_name", "aliases")
    c = _chunks(spark, d).select("tenant_id", "chunk_id", "text")
    return engine.hybrid(_queries(spark, d).select("query_id", "tenant_id", F.col("passage").alias("query_text")), c, e, graph.dedupe_edges(table(spark, d, "edges")), table(spark, d, "mentions"))


@_query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).hits.select("query_id", "doc", "path", "rank", "score", "rrf_score")


@_query
def hybrid_context(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).context


@_query
def context_packed(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.top(retrieval.bm25(_index(spark, d), retrieval.query_terms(_queries(spark, d), text="passage")), 10)
    return context.pack(hits.join(_chunks(spark, d).select("doc", "text"), "doc"), 400, 5)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval: words and a second formulation ranked by BM25, fused by rank."""
    return rrf_fused(spark, d)


def queries() -> dict[str, Query]:
    from lodework.plans import extended

    return _ALL | extended.queries()


def oracle_sql() -> dict[str, str]:
    from lodework.plans.core_sql import SQL
    from lodework.plans.extended_sql import SQL as MORE

    return {k: v for k, v in (SQL | MORE).items() if k in queries()}
