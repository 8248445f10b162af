"""Ranking: BM25, exact cosine search, fusion, reranking, and the statistics of an index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.functions import text as tx

# Fixed values of the retrieval model.
K1, B, PHRASE_BOOST, RRF_K = 1.5, 0.75, 0.5, 60


@dataclass
class Index:
    """postings (tenant_id, doc, term, tf, doc_len) and stats (tenant_id, n_docs, avg_len)."""

    postings: DataFrame
    stats: DataFrame


def build_index(docs: DataFrame, doc: str = "chunk_no", text: str = "text") -> Index:
    """One row per document and term. Documents without a term don't count; rows of one key are one document.

    Documents are tokenised once, as arrays; length and term counts come from the same array.
    """
    rows = docs.groupBy("tenant_id", F.col(doc).alias("doc")).agg(F.max(text).alias("t"))
    rows = rows.select("tenant_id", "doc", tx.terms(F.col("t")).alias("w")).where(F.size("w") > 0)
    each = rows.select("tenant_id", "doc", F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    postings = each.groupBy("tenant_id", "doc", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w")).alias("avg_len"))
    return Index(postings, stats)


def index_of(postings: DataFrame) -> Index:
    """The index whose postings these are; the statistics follow from them."""
    docs = postings.groupBy("tenant_id", "doc").agg(F.max("doc_len").alias("doc_len"))
    return Index(postings, docs.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len")))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, tenant_id, term, times): a repeated query term counts again."""
    rows = queries.select(F.col(query).alias("query_id"), "tenant_id", F.explode(tx.terms(F.col(text))).alias("term"))
    return rows.groupBy("query_id", "tenant_id", "term").agg(F.count(F.lit(1)).alias("times"))


#: A term in at least this part of a tenant's documents (so that few terms are) is dealt out over salts.
HOT_PART, SALTS = 0.05, 32


def bm25(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, tenant_id, doc, score) of all documents that hold a term of the query.

    Only postings of terms that some query asks for are shuffled. A term in a large part of all documents is salted: its
    postings are dealt out by document and its query rows repeated per salt, so no task gets all of its postings. (Where
    the query rows are few, AQE sends them to the postings and nothing is shuffled by term at all.)
    """
    asked = terms.select("tenant_id", "term").distinct()
    postings = index.postings.join(asked, ["tenant_id", "term"], "left_semi")
    df = postings.groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(index.stats), "tenant_id")  # one row a tenant
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hot = (F.col("df") >= HOT_PART * F.col("n_docs")) & (F.col("df") > SALTS * SALTS)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    want = terms.join(df.select("tenant_id", "term", "avg_len", idf.alias("idf"), F.explode(salts).alias("salt")), ["tenant_id", "term"])
    often = df.where(hot).select("tenant_id", "term", F.lit(True).alias("hot"))
    dealt = postings.join(often, ["tenant_id", "term"], "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hot")
    hits = dealt.join(want, ["tenant_id", "term", "salt"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return hits.groupBy("query_id", "tenant_id", "doc").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", key: str = "doc", digits: int = 6) -> DataFrame:
    """The k best per query with their rank, on the rounded score and then the key. score is relative to the best, to 4 digits."""
    w = Window.partitionBy("query_id").orderBy(F.desc("__s"), key)
    rows = scored.withColumn("__s", F.round(score, digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = F.max("__s").over(Window.partitionBy("query_id"))
    return rows.withColumn("relative", F.round(F.col("__s") / best, 4)).drop("__s")


def boost_phrases(scored: DataFrame, texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Scores times 1 + 0.5 per phrase of the query that the text contains, in any case."""
    rows = scored.join(texts, "doc").join(phrases, "query_id", "left")
    n = F.size(F.filter(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: tx.contains_fold(F.col("text"), p)))
    return rows.withColumn("hits", n).withColumn("score", F.col("score") * (1 + PHRASE_BOOST * n)).drop("text", "phrases")


def index_stats(index: Index) -> DataFrame:
    terms = index.postings.groupBy("tenant_id").agg(F.countDistinct("term").alias("n_terms"))
    return index.stats.join(terms, "tenant_id").select("tenant_id", "n_docs", "n_terms", F.round("avg_len", 1).alias("avg_len"))


def _scores(items: pd.DataFrame, queries: pd.DataFrame, k: int | None, least: float, same: bool) -> list[tuple]:
    """The k best (or all) items per query by dot product of unit vectors, above `least`, ranked after rounding to 6 digits."""
    a, b = np.stack(queries["unit"].to_numpy()), np.stack(items["unit"].to_numpy())
    ids, docs = queries["query_id"].to_numpy(), items["doc"].to_numpy()
    order = np.argsort(docs, kind="stable")  # ties go to the lesser key
    docs, b = docs[order], b[order]
    out = []
    for lo in range(0, len(a), 1024):
        s = np.round(a[lo : lo + 1024] @ b.T, 6)
        if same:
            s[ids[lo : lo + 1024, None] == docs[None, :]] = -1
        for r, row in enumerate(s):
            best = np.flatnonzero(row >= least) if k is None else np.argsort(-row, kind="stable")[:k]
            out += [(ids[lo + r], docs[c], row[c]) for c in best if row[c] > 0 and row[c] >= least]
    return out


def _search_block(items: pd.DataFrame, queries: pd.DataFrame, k: int | None, least: float, same: bool, dim: int | None) -> pd.DataFrame:
    def unit(f: pd.DataFrame) -> pd.DataFrame:
        if dim is not None:  # sparse vectors of unit length
            rows = []
            for at, w in zip(f["buckets"], f["weights"], strict=True):
                v = np.zeros(dim)
                v[np.asarray(at, dtype=np.int64)] = w
                rows.append(v)
            return f.assign(unit=rows, size=dim)
        vectors = [np.asarray(v, dtype=np.float64) for v in f["vector"]]
        norms = [np.linalg.norm(v) for v in vectors]
        keep = [n > 0 for n in norms]
        return f.assign(unit=[v / n if n > 0 else v for v, n in zip(vectors, norms, strict=True)], size=[len(v) for v in vectors])[keep]

    out: list[tuple] = []
    if len(items) and len(queries):
        i, q = unit(items), unit(queries)
        for n in sorted(set(q["size"]) & set(i["size"])):
            out += _scores(i[i["size"] == n], q[q["size"] == n], k, least, same)
    return pd.DataFrame(out, columns=["query_id", "doc", "score"])


def _in_blocks(queries: DataFrame, items: DataFrame, group: str | None, block: int, columns: list[str], **how: object) -> DataFrame:
    """queries (query_id, ...) against all items (doc, ...) of their group, in pairs of blocks: (group, query_id, doc, score).

    A task holds one block of items and one of queries. How many blocks a group has follows from its rows, counted first.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("~")) if group else F.lit("~")
    q, i = queries.select(g.alias("g"), "query_id", *columns), items.select(g.alias("g"), "doc", *columns)
    q, i = q.toDF("g", "query_id", *columns), i.toDF("g", "doc", *columns)  # both may come from one table
    parts = lambda df, n: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    sizes = parts(i, "n_i").join(parts(q, "n_q"), "g")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = i.join(sizes, "g").withColumn("bi", F.pmod(F.xxhash64("doc"), "n_i").cast("int")).withColumn("bq", each("n_q")).drop("n_i", "n_q")
    right = q.join(sizes, "g").withColumn("bq", F.pmod(F.xxhash64("query_id"), "n_q").cast("int")).withColumn("bi", each("n_i")).drop("n_i", "n_q")
    kinds = dict(q.dtypes)["query_id"], dict(i.dtypes)["doc"]
    keys = ["g", "bi", "bq"]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = _search_block(a, b, **how)
        found.insert(0, "g", key[0])
        return found

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"g string, query_id {kinds[0]}, doc {kinds[1]}, score double")


def _ranked(scored: DataFrame, k: int, group: str | None) -> DataFrame:
    w = Window.partitionBy("g", "query_id").orderBy(F.desc("score"), "doc")
    rows = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("score", 4))
    if group:
        rows = rows.withColumn(group, F.when(F.col("g") != "~", F.substring("g", 2, 1_000_000)))
    return rows.drop("g")


def exact_search(queries: DataFrame, items: DataFrame, k: int, group: str | None = None, block: int = 32_768) -> DataFrame:
    """Brute-force cosine search of a stated query set: (query_id, doc, score, rank), score > 0, an item never itself.

    queries (query_id, vector[, group]) meet every item (doc, vector[, group]) of their group, in blocks of items: a
    task holds one block and the queries in parts of the same size, multiplies them as matrices, and passes on k rows
    per query. A group of any size is many blocks. Vectors of other sizes, zero vectors and nulls match nothing.
    Cosines are in double, ranked after rounding to 6 digits, ties by key. For all-pairs search there is the graph index.
    """
    has = lambda df: df.where("vector is not null")
    scored = _in_blocks(has(queries), has(items), group, block, ["vector"], k=k, least=0.0, same=True, dim=None)
    return _ranked(scored, k, None).select("query_id", "doc", "score", "rank")


def fuse(lists: DataFrame, k: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, doc, path, rank): score, paths, and path 'fused' where several found it.

    A path without a weight has weight 1. Lists are stacked, not joined, so any number of paths costs one shuffle.
    """
    w = F.lit(1.0)
    for path, x in (weights or {}).items():
        w = F.when(F.col("path") == path, x).otherwise(w)
    if "weight" in lists.columns:
        w = F.col("weight")
    rows = lists.groupBy("query_id", "doc").agg(F.round(F.sum(w / (RRF_K + F.col("rank"))), 6).alias("score"), F.array_sort(F.collect_set("path")).alias("paths"))
    rows = rows.withColumn("path", F.when(F.size("paths") > 1, "fused").otherwise(F.col("paths")[0]))
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    rows = rows.withColumn("rank", F.row_number().over(over))
    return rows.where(F.col("rank") <= k) if k else rows


def first_seen(lists: DataFrame) -> DataFrame:
    """Lists one after the other without repeats: (query_id, doc, path, rank), by list number, then rank."""
    w = Window.partitionBy("query_id", "doc").orderBy("list_no", "rank")
    rows = lists.withColumn("r", F.row_number().over(w)).where("r = 1")
    over = Window.partitionBy("query_id").orderBy("list_no", "rank", "doc")
    return rows.select("query_id", "doc", "path", F.row_number().over(over).alias("rank"))


def overlap_score(query: Column, text: Column) -> Column:
    """0.75 of the query's distinct tokens that the text holds + 0.25 of their number over the root of its length (at most 1)."""
    q, t = F.array_distinct(tx.plain_tokens(query)), tx.plain_tokens(text)
    shared = F.size(F.array_intersect(q, t))
    score = 0.75 * shared / F.size(q) + 0.25 * F.least(shared / F.sqrt(F.size(t).cast("double")), F.lit(1.0))
    return F.when((F.size(q) > 0) & (F.size(t) > 0), F.round(score, 4)).otherwise(F.lit(0.0))


def rerank(ranked: DataFrame, queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The k best of the first max(4k, 20) by lexical overlap; ties keep their former order."""
    rows = ranked.where(F.col("rank") <= max(4 * k, 20)).select("query_id", "doc", F.col("rank").alias("before"))
    rows = rows.join(queries.select("query_id", "query_text"), "query_id").join(texts.select("doc", "text"), "doc")
    rows = rows.withColumn("score", overlap_score(F.col("query_text"), F.col("text"))).drop("query_text", "text")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "before", "doc")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_fallback(found: DataFrame, queries: DataFrame, sweep: DataFrame) -> DataFrame:
    """found, and for queries that have nothing in it their rows of a broader sweep, marked as path 'fallback'."""
    none = queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    extra = sweep.join(none, "query_id").withColumn("path", F.lit("fallback"))
    return found.unionByName(extra.select(*found.columns))


def hash_embed(docs: DataFrame, doc: str = "doc", text: str = "text", dim: int = 384) -> DataFrame:
    """Sparse signed-hash embedding of unit length: (doc, bucket, weight), zero weights left out."""
    tokens = docs.select(F.col(doc).alias("doc"), F.explode(tx.plain_tokens(F.col(text))).alias("t")).groupBy("doc", "t").count()
    parts = tokens.select("doc", "count", F.explode(tx.hash_buckets(F.col("t"), dim)).alias("x"))
    sums = parts.groupBy("doc", F.col("x.bucket").alias("bucket")).agg(F.sum(F.col("x.weight") * F.col("count")).alias("w")).where("w <> 0")
    sizes = sums.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return sums.join(sizes, "doc").select("doc", "bucket", (F.col("w") / F.col("size")).alias("weight"))


def hash_rows(docs: DataFrame, doc: str = "doc", text: str = "text", group: str = "tenant_id", dim: int = 384) -> DataFrame:
    """The hashed embedding with one row per group and document: (group, doc, buckets, weights). Texts without a token give no row."""
    keyed = docs.select(F.struct(F.col(group).alias("g"), F.col(doc).alias("d")).alias("doc"), F.col(text).alias("text"))
    rows = hash_embed(keyed, dim=dim).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("x"))
    return rows.select(F.col("doc.g").alias(group), F.col("doc.d").alias("doc"), F.transform("x", lambda s: s["bucket"]).alias("buckets"), F.transform("x", lambda s: s["weight"]).alias("weights"))


def hashed_search(queries: DataFrame, items: DataFrame, k: int, group: str = "tenant_id", dim: int = 384, block: int = 8_192) -> DataFrame:
    """The k best items of a query's own group by cosine of hashed embeddings (`hash_rows`): (group, query_id, doc, score, rank).

    As `exact_search`: dense blocks, no row of another group is ever compared. Scores above 0 only.
    """
    scored = _in_blocks(queries.withColumnRenamed("doc", "query_id"), items, group, block, ["buckets", "weights"], k=k, least=0.0, same=False, dim=dim)
    return _ranked(scored, k, group)


def hashed_pairs(queries: DataFrame, items: DataFrame, least: float, group: str = "tenant_id", dim: int = 384, block: int = 8_192) -> DataFrame:
    """All (group, query_id, doc, score) of one group whose hashed embeddings have a cosine of at least `least`."""
    scored = _in_blocks(queries.withColumnRenamed("doc", "query_id"), items, group, block, ["buckets", "weights"], k=None, least=least, same=False, dim=dim)
    return scored.select(F.when(F.col("g") != "~", F.substring("g", 2, 1_000_000)).alias(group), "query_id", "doc", "score")
