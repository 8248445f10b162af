"""Versions of stored vectors: what is compatible, what is stale, and embedding again in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.operators import retrieval

#: Stamp of the built-in embedding: kind, size, version.
HASHED = "lexical-hash/384/v1"

#: What turns rows (doc, text) into (doc, vector): a model behind a pandas UDF, loaded once a worker.
Encoder = Callable[[DataFrame], DataFrame]


class EmbeddingError(RuntimeError):
    """No encoder that may be used."""


def mode(encoder: Encoder | None) -> str:
    """The mode a search runs in, for reports and health: 'model' or 'lexical-hash'."""
    return "model" if encoder else "lexical-hash"


def version_state(version: Column, current: str) -> Column:
    """'current', 'stale' or 'unversioned'. Only current vectors may be compared with a query of the current version."""
    return F.when(version.isNull() | (F.trim(version) == ""), "unversioned").when(version == current, "current").otherwise("stale")


def compatible(rows: DataFrame, current: str, version: str = "embedding_version") -> DataFrame:
    """Rows of the current version; stale and unversioned vectors live in another space and are left out."""
    return rows.where(F.col(version) == current)


def hashed_vectors(docs: DataFrame, doc: str = "doc", text: str = "text", group: str = "tenant_id", dim: int = 384) -> DataFrame:
    """(group, doc, vector): the hashed embedding as a dense array."""
    rows = retrieval.hash_rows(docs, doc, text, group, dim)
    at = F.map_from_arrays("buckets", "weights")
    return rows.select(group, "doc", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0)).cast("float")).alias("vector"))


def reembed(rows: DataFrame, texts: DataFrame, current: str, encoder: Encoder | None, key: str = "chunk_id") -> DataFrame:
    """rows (key, vector, embedding_version, ...) with vectors made anew where the version isn't current.

    Only those rows are joined with their texts (key, text) and encoded; the others are passed through. Without an
    encoder nothing is touched and EmbeddingError raised: vectors of a model must not be overwritten by hashes unasked.
    """
    if encoder is None:
        raise EmbeddingError("there is no encoder; vectors stay as they are")
    is_current = F.coalesce(F.col("embedding_version") == current, F.lit(False))
    old = rows.where(~is_current)
    made = encoder(old.select(F.col(key).alias("doc")).join(texts.select(F.col(key).alias("doc"), "text"), "doc").dropDuplicates(["doc"]))
    made = made.select(F.col("doc").alias(key), F.col("vector").alias("__new"))
    fresh = old.join(made, key, "left")
    fresh = fresh.withColumn("vector", F.coalesce("__new", "vector")).withColumn("embedding_version", F.when(F.col("__new").isNotNull(), F.lit(current)).otherwise(F.col("embedding_version"))).drop("__new")
    return rows.where(is_current).unionByName(fresh)
