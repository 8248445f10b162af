"""Further queries over the test tables: the engine's helpers around retrieval, graph, access, versions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodework.functions import registry
from lodework.functions import text as tx
from lodework.operators import chunking, community, embedding, graph, guards, metrics, report, retrieval, routing, structured, understand
from lodework.plans import core, evaluate
from lodework.sources import sql
from lodework.tables import spread, table

_ALL: dict[str, core.Query] = {}


def _query(f: core.Query) -> core.Query:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, core.Query]:
    return dict(_ALL)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The first 8 chunks of every query by the words of its passage."""
    found = retrieval.top(retrieval.bm25(core._index(spark, d), retrieval.query_terms(core._queries(spark, d), text="passage")), 8)
    return found.join(core._chunks(spark, d).select("doc", "chunk_id"), "doc").select("query_id", "tenant_id", "chunk_id", "rank")


# ---------------------------------------------------------------- graph and retrieval


@_query
def expanded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks one hop around the entities of the first hits, without the hits."""
    return graph.expand(_hits(spark, d), table(spark, d, "edges"), table(spark, d, "mentions"), 1)


@_query
def merged_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The nodes one hop around the expected entities, then those two hops around, each once."""
    e = table(spark, d, "edges")
    return graph.merge_nodes(graph.traverse(e, core._seeds(spark, d), 1), graph.traverse(e, core._seeds(spark, d), 2))


@_query
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the names in a passage, widened where fewer were found than names are in it."""
    a = understand.analyse(core._queries(spark, d), "passage").select("query_id", "tenant_id", "mentions")
    named = a.select("query_id", "tenant_id", F.explode("mentions").alias("m")).select("query_id", "tenant_id", tx.normalize_name(F.col("m")).alias("norm")).distinct()
    e = table(spark, d, "entities").where("entity_id is not null").select("tenant_id", "entity_id", tx.normalize_name(F.col("entity_name")).alias("norm")).distinct()
    found = named.join(e, ["tenant_id", "norm"]).select("query_id", "tenant_id", "entity_id").distinct()
    return graph.widen(found, a.select("query_id", "tenant_id", F.size("mentions").alias("n")), e)


@_query
def foreign_hits(spark: SparkSession, d: str) -> DataFrame:
    """Per way of searching: hits, and those that are chunks of another tenant than the query's; these must be 0."""
    q, c = core._queries(spark, d), core._chunks(spark, d)
    owner = c.select(F.col("doc"), F.col("tenant_id").alias("chunk_tenant"))
    vector = retrieval.hashed_search(retrieval.hash_rows(q, "query_id", "query_text"), retrieval.hash_rows(c), 10).select(F.lit("vector").alias("path"), "query_id", "doc")
    words = retrieval.top(retrieval.bm25(core._index(spark, d), retrieval.query_terms(q)), 10).select(F.lit("lexical").alias("path"), "query_id", "doc")
    rows = vector.unionByName(words).join(owner, "doc").join(q.select("query_id", "tenant_id"), "query_id")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("tenant_id").eqNullSafe(F.col("chunk_tenant"))).alias("foreign_rows"))


@_query
def sql_parameters(spark: SparkSession, d: str) -> DataFrame:
    """A query as text with bound parameters and a cap."""
    text = "SELECT tenant_id, source_id, upper(edge_type) AS edge_type, target_id, max(confidence) AS confidence FROM {edges} WHERE tenant_id = :tenant AND confidence >= :least GROUP BY ALL"
    return sql.run(spark, text, {"edges": table(spark, d, "edges")}, {"tenant": "movies_bot", "least": 0.8}, ["source_id", "edge_type", "target_id"], 200)


@_query
def shaped_response(spark: SparkSession, d: str) -> DataFrame:
    """The first 3 passages of every query, with its subgraph's size only where the query wants the graph."""
    hits = _hits(spark, d).withColumnRenamed("chunk_id", "doc")
    nodes = graph.traverse(table(spark, d, "edges"), core._seeds(spark, d), 1)
    return evaluate.shape(hits, nodes, core._queries(spark, d).select("query_id", F.col("requires_multi_hop").alias("include_subgraph")), 3)


# ---------------------------------------------------------------- access, versions, kinds


@_query
def access_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every question as a request with a key: of its tenant or an unknown one, for its own tenant or another, to read or to write."""
    q = core._queries(spark, d)
    keys = q.select("tenant_id").distinct().select(F.concat(F.lit("key-"), "tenant_id").alias("api_key"), "tenant_id", F.when(F.col("tenant_id") == "movies_bot", F.array(F.lit("admin"))).when(F.col("tenant_id") == "ai_trends_bot", F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read"))).alias("scopes"))
    n = F.col("query_id")
    requests = q.select(
        n.alias("request_id"), F.when(n % 11 == 0, "key-nobody").otherwise(F.concat(F.lit("key-"), "tenant_id")).alias("api_key"),
        F.when(n % 5 == 0, "ai_trends_bot").when(n % 5 == 1, F.concat(F.lit(" "), F.upper("tenant_id"))).when(n % 35 == 2, "never_bot").alias("claimed"), F.when(n % 3 == 0, "write").otherwise("read").alias("scope"),
    )
    return guards.access(keys, requests, q.select("tenant_id").distinct())


@_query
def embedding_versions(spark: SparkSession, d: str) -> DataFrame:
    """Vectors per tenant by whether a query of the current version may be compared with them, and how many have a text to be embedded anew."""
    rows = table(spark, d, "indexed_chunks").select("tenant_id", "chunk_id", embedding.version_state(F.col("embedding_version"), "sim-embed/96/v2").alias("state"))
    texts = core._chunks(spark, d).select("chunk_id", F.lit(1).alias("has"))
    rows = rows.join(texts, "chunk_id", "left")
    return rows.groupBy("tenant_id", "state").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("n_texts"))


@_query
def reembedded(spark: SparkSession, d: str) -> DataFrame:
    """The stale vectors made anew by the hashed embedding: per tenant and version the vectors, and those of the new size."""
    rows = table(spark, d, "indexed_chunks").select("chunk_id", "tenant_id", "vector", "embedding_version").where(F.coalesce(F.col("embedding_version") != "sim-embed/96/v2", F.lit(True)))
    texts = core._chunks(spark, d).select("chunk_id", "text")
    encode = lambda t: embedding.hashed_vectors(t.withColumn("g", F.lit("-")), group="g")
    out = embedding.reembed(rows, texts, embedding.HASHED, encode)
    return out.groupBy("tenant_id", F.coalesce("embedding_version", F.lit("none")).alias("version")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("vector") == 384).alias("n_new"))


@_query
def chunk_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by kind, those of the index without reports and the reports."""
    plain = community.of_kind(table(spark, d, "indexed_chunks").select("tenant_id", F.col("chunk_kind").alias("kind")), False)
    told = community.of_kind(core.community_report_chunks(spark, d).select("tenant_id", "kind"), True)
    return plain.unionByName(told).groupBy("tenant_id", "kind").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- ingestion


@_query
def routed_methods(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and characters per way of extraction."""
    b = table(spark, d, "blocks").select("tenant_id", F.coalesce(routing.method(F.col("kind")), F.lit("none")).alias("method"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return b.groupBy("tenant_id", "method").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("chars"))


@_query
def table_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables as records, told as text."""
    rows = routing.table_records(table(spark, d, "blocks"))
    return rows.select("block_no", "row_index", F.size("cells").alias("n_cells"), chunking.record_text(F.col("cells")).alias("text"))


@_query
def record_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Further names of a record's subject, from the columns that hold its name in another language."""
    r = table(spark, d, "records").withColumn("cells", F.transform("cells", lambda c: F.struct(F.when(c["column_name"] == "tagline", "local title").otherwise(c["column_name"]).alias("column_name"), c["cell_value"].alias("cell_value"))))
    return structured.aliases(r, structured.profile_columns(r))


@_query
def plain_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraphs(spread(table(spark, d, "documents").select("doc_id", "text")))


# ---------------------------------------------------------------- evaluation


@_query
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents, usable ones (of 200 characters or more) and characters per source."""
    return evaluate.corpus_summary(table(spark, d, "documents"), "source", 200)


@_query
def case_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What came of every question, with what led to it: refused, asked back, answered or empty."""
    q = core._queries(spark, d)
    hits = retrieval.top(retrieval.bm25(core._index(spark, d), retrieval.query_terms(q)), 5).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return evaluate.outcomes(understand.analyse(q), hits)


@_query
def question_set(spark: SparkSession, d: str) -> DataFrame:
    """The question set by category: recall and passes of words and vectors fused, and of vectors alone."""
    q, c = core._queries(spark, d).withColumn("query_text", F.col("passage")), core._chunks(spark, d)
    vector = retrieval.hashed_search(retrieval.hash_rows(q, "query_id", "query_text"), retrieval.hash_rows(c), 20).select("query_id", "doc", F.lit("vector").alias("path"), "rank")
    words = retrieval.top(retrieval.bm25(core._index(spark, d), retrieval.query_terms(q)), 20).select("query_id", "doc", F.lit("lexical").alias("path"), "rank")
    return evaluate.question_set(retrieval.fuse(words.unionByName(vector), 10), vector, core._relevant(spark, d), q)


@_query
def rules_passed(spark: SparkSession, d: str) -> DataFrame:
    """Every question by each of the seven rules a case may be judged by."""
    q, e = core._queries(spark, d), table(spark, d, "edges")
    hits = retrieval.top(retrieval.bm25(core._index(spark, d), retrieval.query_terms(q, text="passage")), 5).join(core._chunks(spark, d).select("doc", "text"), "doc")
    got = hits.groupBy("query_id").agg(F.collect_list("text").alias("texts"), F.count(F.lit(1)).alias("passages"))
    around = graph.recover_edges(e, graph.traverse(e, core._seeds(spark, d), 1)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges"))
    rows = q.join(understand.analyse(q).select("query_id", "intent"), "query_id").join(got, "query_id", "left").join(around, "query_id", "left")
    rows = rows.withColumn("rule", F.explode(F.array(*[F.lit(r) for r in metrics.RULES])))
    bad = guards.violation(F.col("query_text")).isNotNull()
    ok = metrics.pass_rule(F.col("rule"), F.col("texts"), F.col("expected_text"), F.col("expected_text"), F.col("intent"), F.lit("local"), F.coalesce("n_edges", F.lit(0)), F.col("hops"), F.coalesce("passages", F.lit(0)), bad)
    return rows.select("query_id", "rule", ok.alias("passed"))


@_query
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions, called from SQL."""
    registry.register(spark)
    return spark.sql("SELECT vertex_id, lode_entity_id(label, entity_name) AS canonical, lode_token_count(entity_name) AS tokens, round(lode_cosine(array(1D, cast(vertex_id % 7 AS DOUBLE)), array(2D, 1D)), 6) AS cosine FROM {e}", e=table(spark, d, "entities"))


@_query
def passage_citations(spark: SparkSession, d: str) -> DataFrame:
    """Where a passage is from, in one line, and the first 80 characters of it at a blank."""
    rows = table(spark, d, "blocks").select("block_no", "doc_key", "section_path", "kind", "text")
    return rows.select("block_no", tx.cite_passage(F.col("doc_key"), F.col("section_path"), F.col("kind")).alias("citation"), tx.truncate(F.col("text"), 80).alias("head"))


@_query
def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The metrics by category as the lines of a report."""
    m = core.metrics_by_category(spark, d).select(F.coalesce("category", F.lit("all")).alias("category"), "n", "recall", "mrr", "ndcg")
    return report.markdown(m, [F.col("category")], "Retrieval by category")


@_query
def multi_hop_advantage(spark: SparkSession, d: str) -> DataFrame:
    """Recall of two formulations, apart for questions that need more than one hop."""
    q = core._queries(spark, d)
    a, b = (core._metrics(spark, d, t).select("query_id", F.col("recall").alias(n)) for t, n in (("query_text", "a"), ("passage", "b")))
    return metrics.multi_hop(a.join(b, "query_id").join(q.select("query_id", "requires_multi_hop"), "query_id"))


@_query
def first_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the edges of each tenant in the order they are met, source before target, each once."""
    e = table(spark, d, "edges").where("source_id is not null and target_id is not null")
    rows = e.select("tenant_id", F.posexplode(F.array("source_id", "target_id")).alias("side", "entity_id"), "source_id", "target_id", F.upper("edge_type").alias("edge_type"))
    one = rows.groupBy("tenant_id", "entity_id").agg(F.min(F.struct("source_id", "edge_type", "target_id", "side")).alias("x"))
    w = Window.partitionBy("tenant_id").orderBy("x", "entity_id")
    return one.select("tenant_id", "entity_id", F.row_number().over(w).alias("place"))
