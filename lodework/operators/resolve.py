"""Resolving entities: blocking, matching, merging, and linking mentions of a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.functions import text as tx
from lodework.functions.similarity import Likeness, hashed_cosine_of, jaro_winkler, jaro_winkler_unaccented
from lodework.operators import retrieval
from lodework.operators.skew import join_stats
from lodework.session import stored

# Fixed values of the match model.
SAME, RESCUE_FROM, RESCUE_COSINE, RESCUE_COSINE_PART, LINK_FROM, LINK_COSINE, LINK_COSINE_PART = 0.85, 0.60, 0.80, 0.6, 0.55, 0.70, 0.7


#: A blocking key that more names than this hold is dealt out in parts, each pair of which is a block of its own.
PART = 1024
#: Pairs that are looked at together.
PAIRS = 1_000_000


def blocking_keys(entities: DataFrame, *more: str) -> DataFrame:
    """(tenant_id, id, key) and more: a label with the first three letters of the name, and with each of its longer tokens."""
    tokens = F.filter(F.split("norm", "_"), lambda t: F.length(t) >= 4)
    keys = F.array_union(F.array(F.concat("label", F.lit(":"), F.substring("norm", 1, 3))), F.transform(tokens, lambda t: F.concat("label", F.lit(":tok:"), t)))
    return entities.select("tenant_id", "id", *more, F.explode(keys).alias("key"))


def names_of(entities: DataFrame) -> DataFrame:
    """(tenant_id, label, norm, id, n): distinct normalised names; equal names of a label are one from the start."""
    rows = entities.where("entity_name is not null").select("tenant_id", "label", tx.normalize_name(F.col("entity_name")).alias("norm"), "vertex_id").where("norm <> ''")
    return rows.groupBy("tenant_id", "label", "norm").agg(F.min("vertex_id").alias("id"), F.count(F.lit(1)).alias("n"))


def candidates(names: DataFrame) -> DataFrame:
    """Pairs (tenant_id, label, a, b, norm_a, norm_b) of distinct names that share a key, each once, a before b.

    Names, not rows, are paired, so repeated spellings cost nothing. For collections where single tokens are shared by
    a large part of all names, the MinHash linker of the training-data package is the better blocking.
    """
    keyed = blocking_keys(names).join(names.select("id", "norm", "label"), "id")
    a = keyed.select("tenant_id", "label", "key", F.col("id").alias("a"), F.col("norm").alias("norm_a"))
    b = keyed.select("tenant_id", "key", F.col("id").alias("b"), F.col("norm").alias("norm_b"))
    return a.join(b, ["tenant_id", "key"]).where("a < b").select("tenant_id", "label", "a", "b", "norm_a", "norm_b").distinct()


def matches(pairs: DataFrame, least: float = SAME) -> DataFrame:
    """Pairs whose names, without accents, are alike."""
    return pairs.withColumn("score", F.round(jaro_winkler_unaccented("norm_a", "norm_b"), 4)).where(F.col("score") >= least)


def _may_match(a: str, b: str, least: float) -> Column:
    """Whether a Jaro-Winkler similarity of `least` is possible at all, by lengths, shared letters and common prefix."""
    n, m = F.length(a), F.length(b)
    k = F.least(n - F.length(F.expr(f"translate({a}, {b}, '')")), m - F.length(F.expr(f"translate({b}, {a}, '')")))
    jaro = F.when(k > 0, (k / n + k / m + 1) / 3).otherwise(0.0)
    prefix = sum((F.when(F.substring(a, 1, i) == F.substring(b, 1, i), 1).otherwise(0) for i in range(1, 5)), F.lit(0))
    return jaro + prefix * 0.1 * (1 - jaro) >= least - 1e-4


def _blocks(names: DataFrame, part: int) -> DataFrame:
    """Names by (tenant_id, key, p, q), sorted: parts p and q of the names of a key, side telling which; p = q is one part by itself."""
    keyed = blocking_keys(names, "norm").where("tenant_id is not null and key is not null")
    counts = keyed.groupBy("tenant_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = join_stats(keyed, counts, ["tenant_id", "key"], "n", keyed.count())
    parts = F.ceil(F.col("n") / part).cast("int")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    block = ["tenant_id", "key", "p", "q"]
    placed = placed.select("tenant_id", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("side"), "id", "norm")
    spark = names.sparkSession  # what a block costs goes by its pairs, not by its bytes, so the number of partitions is given
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return placed.repartition(many, *block).sortWithinPartitions(*block, "side")


def _linked(f: pd.DataFrame, first: np.ndarray) -> Iterator[pd.DataFrame]:
    """The links within the blocks of f, which begin at the rows first."""
    like, ids = Likeness(f["norm"].tolist()), f["id"].to_numpy()
    fewest = like.fewest(RESCUE_COSINE)
    n = len(f)
    size = np.diff(np.append(first, n))
    end = np.repeat(first + size, size)
    side = f["side"].to_numpy(dtype=bool)
    crossed = f["p"].to_numpy() != f["q"].to_numpy()
    other = np.repeat(first + size - np.add.reduceat(side.astype(np.int64), first), size)  # where the second part begins
    start = np.where(crossed, other, np.arange(n) + 1)
    many = np.where(crossed & side, 0, end - start)
    upto = np.cumsum(many)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + PAIRS, side="right")))
        count = many[row:to]
        a = np.repeat(np.arange(row, to), count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + start[a]
        row = to
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        most = like.may_reach(a, b)
        may = most >= RESCUE_FROM - 1e-6
        a, b, most = a[may], b[may], most[may]
        x = np.zeros(len(a))
        high = most >= SAME - 1e-6
        x[high] = np.round(like.jaro_winkler(a[high], b[high], SAME), 9)
        alike = x >= SAME
        rest = np.flatnonzero(~alike)
        rest = rest[like.common_buckets(a[rest], b[rest]) >= np.maximum(fewest[a[rest]], fewest[b[rest]])]
        rest = rest[like.near_cosine(a[rest], b[rest]) >= RESCUE_COSINE - 1e-4]
        y = np.round(like.jaro_winkler(a[rest], b[rest], RESCUE_FROM), 9)
        rest, y = rest[y >= RESCUE_FROM], y[y >= RESCUE_FROM]
        c = np.array([hashed_cosine_of(like.names[i], like.names[j]) for i, j in zip(a[rest], b[rest], strict=True)], dtype=float)
        rest, y, c = rest[c >= RESCUE_COSINE], y[c >= RESCUE_COSINE], c[c >= RESCUE_COSINE]
        yield pd.DataFrame({"a": ids[a[alike]], "b": ids[b[alike]], "x": x[alike], "c": np.nan})
        yield pd.DataFrame({"a": ids[a[rest]], "b": ids[b[rest]], "x": y, "c": c})


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by block. The last block of a frame waits for the next, as it may go on there."""
    kept = None
    for f in frames:
        f = f if kept is None else pd.concat([kept, f], ignore_index=True)
        new = (f[["tenant_id", "key", "p", "q"]] != f[["tenant_id", "key", "p", "q"]].shift()).any(axis=1)
        first = np.flatnonzero(new.to_numpy())
        kept = f.iloc[first[-1] :] if len(first) else None
        if len(first) > 1:
            yield from _linked(f.iloc[: first[-1]], first[:-1])
    if kept is not None:
        yield from _linked(kept, np.array([0]))


def links(names: DataFrame, part: int = PART) -> DataFrame:
    """(a, b, score, method) of all pairs of candidates that match: by string, or by string and hashed embedding together.

    The pairs are those of `candidates`, but they are made and compared within the task that has their block, many at
    once; only links leave it. Pairs that can't reach the lower bound of either way are left out before any similarity
    is computed. The same for any part.
    """
    pairs = _blocks(names, part).mapInPandas(_links, "a long, b long, x double, c double")
    pairs = pairs.select("a", "b", "x", F.nanvl("c", F.lit(None)).alias("c")).distinct()
    score = F.when(F.col("c").isNull(), F.col("x")).otherwise(F.round(RESCUE_COSINE_PART * F.col("c") + (1 - RESCUE_COSINE_PART) * F.col("x"), 4))
    return pairs.select("a", "b", score.alias("score"), F.when(F.col("c").isNull(), "string_match").otherwise("vector_assisted").alias("method"))


def canonical_names(names: DataFrame, matched: DataFrame) -> DataFrame:
    """(id) of the names that become canonical when all are gone through by id: those that match no earlier canonical one.

    In each round the names without an open earlier match become canonical and the later matches of these are merged;
    only matches of two names that are both still open go on to the next round, in the shared folder. Rounds are as many
    as the longest chain of such decisions.
    """
    e = matched.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"))
    merged = None
    while True:
        early = e.select(F.col("early").alias("id")).distinct()
        now = early.join(e.select(F.col("late").alias("id")).distinct(), "id", "left_anti").withColumnRenamed("id", "won")
        gone = e.join(now, e["early"] == now["won"], "left_semi").select(F.col("late").alias("gone")).distinct()
        gone = stored(gone, "merged")
        if gone.isEmpty():
            break
        merged = gone if merged is None else merged.unionByName(gone)
        e = e.join(gone, e["late"] == gone["gone"], "left_anti").join(gone, e["early"] == gone["gone"], "left_anti")
        e = stored(e, "open")
    return names.select("id") if merged is None else names.select("id").join(merged.withColumnRenamed("gone", "id"), "id", "left_anti")


def greedy_merge(entities: DataFrame) -> DataFrame:
    """(vertex_id, canonical_id, score, method): the order-dependent merge, per tenant and label, by vertex_id.

    A row joins the best matching canonical name made before it (the earlier of equals), else makes its own. What matches
    is found set-wise over names that share a blocking key, so no task goes through a label row by row; only the order of
    decisions is kept, in rounds over the matching names. Rows without a name, or with signs only, are left out.
    """
    norm = tx.normalize_name(F.col("entity_name"))
    rows = entities.where("entity_name is not null").select("tenant_id", "label", norm.alias("norm"), "vertex_id").where("norm <> ''")
    names = stored(names_of(entities), "names")
    matched = stored(links(names), "matches")
    canon = canonical_names(names, matched).withColumn("is_canon", F.lit(True))
    total = names.agg(F.sum("n")).first()[0] or 0
    key = lambda df: df.withColumn("k", F.struct(*[F.coalesce(F.concat(F.lit("="), c), F.lit("~")).alias(c) for c in ("tenant_id", "label", "norm")]))
    known = key(names.join(canon, "id", "left")).select("k", "id", "n", F.coalesce("is_canon", F.lit(False)).alias("is_canon"))
    placed = join_stats(key(rows).select("k", "vertex_id"), known, ["k"], "n", total)
    own = placed.where("is_canon").select("vertex_id", F.col("id").alias("canonical_id"), F.lit(1.0).alias("score"), F.when(F.col("vertex_id") == F.col("id"), "new").otherwise("exact").alias("method"))
    both = matched.unionByName(matched.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "method"))
    near = both.join(canon.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"), F.col("a").alias("canonical_id"), "score", "method")
    met = placed.where("not is_canon").select("vertex_id", "id").join(near, "id").where("canonical_id < vertex_id")
    best = met.groupBy("vertex_id").agg(F.min_by(F.struct("canonical_id", "score", "method"), F.struct(-F.col("score"), "canonical_id")).alias("x"))
    return own.unionByName(best.select("vertex_id", "x.canonical_id", F.round("x.score", 4).alias("score"), "x.method"))


def _cosines(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(tenant_id, norm, enorm, cosine): names of a tenant whose hashed embeddings have a cosine of at least 0.70."""
    text = lambda df, c: retrieval.hash_rows(df.select("tenant_id", F.col(c).alias("doc"), F.translate(c, "_", " ").alias("text")))
    found = retrieval.hashed_pairs(text(asked, "norm"), text(known, "enorm"), LINK_COSINE)
    return found.select("tenant_id", F.col("query_id").alias("norm"), F.col("doc").alias("enorm"), F.round("score", 4).alias("cosine"))


def link_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Best entity per (query_id, mention): exact name or alias, Jaro-Winkler of at least 0.85, or 0.55 with a cosine of 0.70.

    mentions has (query_id, tenant_id, mention). Every distinct mention meets every distinct name of its tenant; only
    pairs that can't reach 0.85 are left out before Jaro-Winkler is computed. The cosine is that of the hashed embedding,
    whose pairs share a bucket; its matches score 0.7 of the cosine and 0.3 of the string similarity. Returns query_id,
    tenant_id, mention, entity_id, label, score, method.
    """
    m = mentions.withColumn("norm", tx.normalize_name(F.col("mention"))).where("norm <> ''")
    names = F.array_distinct(F.array_compact(F.concat(F.array("entity_name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    e = entities.where("entity_id is not null").select("tenant_id", "entity_id", "label", F.explode(names).alias("n")).select("tenant_id", "entity_id", "label", tx.normalize_name(F.col("n")).alias("enorm")).where("enorm <> ''")
    e = e.groupBy("tenant_id", "entity_id", "enorm").agg(F.min("label").alias("label"))
    asked, known = m.select("tenant_id", "norm").distinct(), e.select("tenant_id", "enorm").distinct()
    alike = asked.join(known, "tenant_id").where(_may_match("norm", "enorm", SAME)).withColumn("score", F.when(F.col("norm") == F.col("enorm"), 1.0).otherwise(F.round(jaro_winkler("norm", "enorm"), 4))).where(F.col("score") >= SAME)
    alike = alike.withColumn("method", F.when(F.col("norm") == F.col("enorm"), "exact").otherwise("string_match"))
    near = _cosines(asked, known).withColumn("x", jaro_winkler("norm", "enorm")).where((F.col("x") >= LINK_FROM) & (F.round("x", 4) < SAME))
    near = near.select("tenant_id", "norm", "enorm", F.round(LINK_COSINE_PART * F.col("cosine") + (1 - LINK_COSINE_PART) * F.col("x"), 4).alias("score"), F.lit("vector_knn").alias("method"))
    rows = m.join(alike.unionByName(near), ["tenant_id", "norm"]).join(e, ["tenant_id", "enorm"])
    w = Window.partitionBy("query_id", "mention").orderBy(F.desc("score"), "entity_id", "method")
    rows = rows.withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.select("query_id", "tenant_id", "mention", "entity_id", "label", "score", "method")


def remap(mentions: DataFrame, canonical: DataFrame) -> DataFrame:
    """mentions with entity_id replaced by its canonical id where there is one; distinct (tenant, entity, chunk)."""
    c = canonical.select("tenant_id", "entity_id", "canonical_id")
    rows = mentions.where("entity_id is not null and chunk_id is not null").select("tenant_id", "entity_id", "chunk_id").distinct()
    rows = rows.join(c, ["tenant_id", "entity_id"], "left")
    return rows.select("tenant_id", F.coalesce("canonical_id", "entity_id").alias("entity_id"), "chunk_id").distinct()
