"""Sinks: one folder per tenant and table, keyed upserts by bucket, provisioning and verification."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodework.operators import graph
from lodework.operators.guards import Tenant, TenantError

#: Tables of a tenant: schema, key.
TABLES = {
    "chunks": (
        "tenant_id string, chunk_id string, doc string, chunk_index int, kind string, text string, token_count int, section_path array<string>, "
        "has_overlap boolean, prev_chunk_id string, next_chunk_id string, embedding_version string, citation string",
        ["chunk_id"],
    ),
    "entities": ("tenant_id string, entity_id string, label string, entity_name string, confidence double, mention_count long, aliases array<string>", ["entity_id"]),
    "edges": ("tenant_id string, source_id string, edge_type string, target_id string, confidence double, support_count long, chunk_id string, evidence string", ["source_id", "edge_type", "target_id"]),
    "mentions": ("tenant_id string, entity_id string, chunk_id string", ["entity_id", "chunk_id"]),
}
#: Buckets of a table. A write touches those of its keys only.
BUCKETS = 64


def document_of(chunk_id: Column) -> Column:
    """The document a chunk id belongs to."""
    return F.regexp_replace(chunk_id, r"_c\d+$", "")


def _bucket_key(table: str) -> Column:
    """What rows are bucketed by: a part of the key, so that one key is always in one bucket, and a document's chunks and mentions too."""
    return {"entities": F.col("entity_id"), "edges": F.col("source_id")}[table] if table in ("entities", "edges") else document_of(F.col("chunk_id"))


class Store:
    """Tables under root/tenant_id=<t>/<table>. A manifest names the folder of every bucket; a write makes new folders for
    the buckets it touches and then replaces the manifest.

    Readers see the folders the manifest names, so a failed or repeated write never shows half a table. Folders that
    neither the new nor the last manifest names are deleted. One writer at a time per table.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, tenant: Tenant, table: str) -> str:
        return f"{self.root}/tenant_id={tenant.name}/{table}"

    def exists(self, tenant: Tenant) -> bool:
        return self._fs.exists(self._path(f"{self.root}/tenant_id={tenant.name}"))

    def tenants(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(n.split("=", 1)[1] for n in names if n.startswith("tenant_id="))

    def provision(self, tenant: Tenant) -> None:
        """Makes the tenant's empty tables; what exists stays."""
        for table in TABLES:
            if not self._fs.exists(self._path(f"{self._folder(tenant, table)}/MANIFEST")):
                self._put(tenant, table, {"version": uuid.uuid4().hex, "buckets": {}, "last": []})

    def drop(self, tenant: Tenant) -> None:
        self._fs.delete(self._path(f"{self.root}/tenant_id={tenant.name}"), True)

    def _manifest(self, tenant: Tenant | None, table: str) -> dict:
        if tenant is None:
            raise TenantError("no tenant is bound to this access")
        at = self._path(f"{self._folder(tenant, table)}/MANIFEST")
        if not self._fs.exists(at):
            raise TenantError(f"tenant {tenant.name} has no table {table}; it was never provisioned")
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, tenant: Tenant, table: str, manifest: dict) -> None:
        out = self._fs.create(self._path(f"{self._folder(tenant, table)}/MANIFEST"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def version(self, tenant: Tenant, table: str) -> str:
        """Changes with every write; what was computed from another version is out of date."""
        return self._manifest(tenant, table)["version"]

    def _rows(self, table: str, paths: list[str]) -> DataFrame:
        schema = StructType.fromDDL(TABLES[table][0])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, tenant: Tenant | None, table: str) -> DataFrame:
        """A table of a tenant; never made on reading."""
        return self._rows(table, sorted(set(self._manifest(tenant, table)["buckets"].values())))

    def upsert(self, tenant: Tenant, table: str, new: DataFrame, documents: DataFrame | None = None) -> None:
        """Rows of `new` in place of those of the same key. Rows of another tenant, or twice the same key, fail.

        documents (doc): all rows of these documents go first (chunks and mentions only), so that what a shorter text no
        longer has doesn't stay. Only the buckets of the new keys and of these documents are read and written.
        """
        schema, keys = TABLES[table]
        want = StructType.fromDDL(schema)
        tenant_id = F.coalesce("tenant_id", F.lit(tenant.name)) if "tenant_id" in new.columns else F.lit(tenant.name)
        new = new.withColumn("tenant_id", tenant_id)
        new = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
        guard = F.when(F.col("tenant_id") != tenant.name, F.raise_error(F.lit("row of another tenant")).cast("string")).otherwise(F.col("tenant_id"))
        new = new.withColumn("tenant_id", guard)
        if not new.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{table}: a key occurs twice in one write")
        manifest = self._manifest(tenant, table)
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
        touched = new.select(bucket(_bucket_key(table)).alias("b"))
        if documents is not None:
            if table not in ("chunks", "mentions"):
                raise ValueError(f"{table}: rows don't belong to one document")
            documents = documents.select(F.col("doc").cast("string").alias("doc")).distinct()
            touched = touched.unionByName(documents.select(bucket(F.col("doc")).alias("b")))
        numbers = sorted(str(r["b"]) for r in touched.distinct().collect())  # at most BUCKETS
        old = self._rows(table, sorted({manifest["buckets"][n] for n in numbers if n in manifest["buckets"]}))
        if documents is not None:
            old = old.withColumn("__doc", _bucket_key(table)).join(documents.withColumnRenamed("doc", "__doc"), "__doc", "left_anti").select(*want.names)
        folder = f"{self._folder(tenant, table)}/v-{uuid.uuid4().hex}"
        out = graph.upsert(old, new, keys).withColumn("bucket", bucket(_bucket_key(table)))
        out.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        buckets = {n: p for n, p in manifest["buckets"].items() if n not in numbers}
        found = {s.getPath().getName().split("=", 1)[1] for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()}
        buckets |= {n: f"{folder}/bucket={n}" for n in found}
        stale = sorted(set(manifest["buckets"].values()) - set(buckets.values()))
        self._put(tenant, table, {"version": uuid.uuid4().hex, "buckets": buckets, "last": stale})
        for path in manifest["last"]:  # those before the last manifest: no reader is left
            self._fs.delete(self._path(path), True)

    def verify(self, tenant: Tenant) -> DataFrame:
        """(table, rows, duplicate_keys, foreign_rows) of each table."""
        parts = []
        for table, (_, keys) in TABLES.items():
            df = self.read(tenant, table)
            dup = df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
            n = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("tenant_id").eqNullSafe(F.lit(tenant.name))).alias("foreign_rows"))
            parts.append(n.crossJoin(F.broadcast(dup)).select(F.lit(table).alias("table"), "rows", "duplicate_keys", "foreign_rows"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def missing(self, tenant: Tenant) -> dict[str, list[str]]:
        """Tables that should be there and aren't, and folders that are no table."""
        there = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/tenant_id={tenant.name}"))} if self.exists(tenant) else set()
        return {"missing": sorted(set(TABLES) - there), "extra": sorted(there - set(TABLES))}
