"""Guards: identifiers, tenants, query text, and rate limits. A failure is an exception or a reason, never an empty result."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the guard model.
IDENTIFIER, TENANT, MOST_CHARS = r"^[A-Za-z][A-Za-z0-9_]{0,62}$", r"^[a-z][a-z0-9_]{1,62}$", 2000
DANGEROUS = [
    (r"(?i);\s*(?:DROP|DELETE|DETACH|CREATE|MERGE|SET|REMOVE|ALTER|TRUNCATE)\b", "statement chaining"),
    (r"(?i)\b(?:DROP|TRUNCATE)\s+(?:DATABASE|TYPE|VERTEX|EDGE|INDEX|BUCKET)\b", "schema destruction"),
    (r"(?i)\bDETACH\s+DELETE\b", "destructive delete"),
    (r"(?i)\bLOAD\s+CSV\b", "external data load"),
    (r"(?i)\bUNION\s+(?:ALL\s+)?MATCH\b", "query union injection"),
    (r"(?i)\bCALL\s+(?:db|dbms|apoc)\b", "procedure invocation"),
    (r"/\*|\*/", "block comment"),
    (r"(?:^|\s)--(?:\s|$)", "line comment"),
    (r"\$\{", "template interpolation"),
    (r"(?i)\bJAVASCRIPT\b|\bSCRIPT\s*:", "script execution"),
]


class GuardError(ValueError):
    """Input that must not be answered."""


class TenantError(PermissionError):
    """Access without a tenant, or to another's data."""


def safe_identifier(name: str) -> str:
    if not re.fullmatch(IDENTIFIER[1:-1], name or ""):
        raise GuardError(f"not an identifier: {name!r}")
    return name


def tenant_of(name: str) -> str:
    """A tenant id in its one form; anything else is refused, not repaired."""
    t = (name or "").strip().lower()
    if not re.fullmatch(TENANT[1:-1], t):
        raise GuardError(f"not a tenant id: {name!r}")
    return t


def violation(text: Column) -> Column:
    """Why a query text is refused, by the first rule against it; null where it passes."""
    out = F.when(F.length(text) > MOST_CHARS, "too long").when(F.contains(text, F.lit("\x00")), "null byte")
    for pattern, name in DANGEROUS:
        out = out.when(text.rlike(pattern), name)
    return out


@dataclass(frozen=True)
class Tenant:
    """Every read and write of the engine is bound to one; there is no default."""

    name: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "name", tenant_of(self.name))

    def only(self, df: DataFrame) -> DataFrame:
        """Rows of this tenant. With tables partitioned by tenant_id, other tenants' files are never opened."""
        if "tenant_id" not in df.columns:
            raise TenantError("the table has no tenant_id")
        return df.where(F.col("tenant_id") == self.name)


def scoped(df: DataFrame, tenant: Tenant | None) -> DataFrame:
    if tenant is None:
        raise TenantError("no tenant is bound to this access")
    return tenant.only(df)


def leaks(df: DataFrame, tenant: Tenant) -> DataFrame:
    """Rows that belong to another tenant: must be empty."""
    return df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant.name)))


def tenant_for_key(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, api_key, claimed) with the tenant of their key: 401 for an unknown key, 403 where another tenant is claimed."""
    rows = requests.join(keys.select("api_key", "tenant_id"), "api_key", "left")
    status = F.when(F.col("tenant_id").isNull(), 401).when(F.col("claimed").isNotNull() & (F.lower(F.trim("claimed")) != F.col("tenant_id")), 403).otherwise(200)
    return rows.select("request_id", F.when(status == 200, F.col("tenant_id")).alias("tenant_id"), status.alias("status"))


def arrivals_in_window(events: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 140) -> DataFrame:
    """Every event with the number of arrivals of its key in the window up to it, and whether that is over the limit."""
    w = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("arrivals", F.count(F.lit(1)).over(w)).withColumn("over", F.col("arrivals") > limit)


def battery(spark: SparkSession, payloads: list[tuple[str, str, bool]]) -> DataFrame:
    """(category, checks, passed) for payloads (category, text, must be refused)."""
    df = spark.createDataFrame(payloads, "category string, text string, refuse boolean")
    rows = df.withColumn("ok", violation(F.col("text")).isNotNull() == F.col("refuse"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("checks"), F.count_if("ok").alias("passed"))


#: Scopes a key can have; the admin scope includes the others.
SCOPES = ("read", "write", "admin")


def access(keys: DataFrame, requests: DataFrame, provisioned: DataFrame) -> DataFrame:
    """requests (request_id, api_key, claimed, scope) with tenant_id and status, the first that applies:

    401 unknown key, 403 another tenant claimed (but by an admin key) or a scope the key lacks, 404 a tenant that was never
    provisioned, 200. keys has (api_key, tenant_id, scopes), provisioned has (tenant_id). tenant_id is given with 200 only.
    """
    k = keys.select("api_key", F.col("tenant_id").alias("own"), "scopes")
    rows = requests.join(k, "api_key", "left")
    admin = F.array_contains("scopes", "admin")
    target = F.coalesce(F.lower(F.trim("claimed")), F.col("own"))
    rows = rows.withColumn("target", target).join(provisioned.select(F.col("tenant_id").alias("target"), F.lit(True).alias("is_there")).distinct(), "target", "left")
    status = (
        F.when(F.col("own").isNull(), 401)
        .when((F.col("target") != F.col("own")) & ~admin, 403)
        .when(~admin & ~F.array_contains("scopes", F.col("scope")), 403)
        .when(F.col("is_there").isNull(), 404)
        .otherwise(200)
    )
    return rows.select("request_id", F.when(status == 200, F.col("target")).alias("tenant_id"), status.alias("status"))


def allowed_types(requested: list[str] | None, schema: list[str], defaults: list[str]) -> list[str]:
    """The requested edge types that the schema has, in its spelling; the defaults where none is left."""
    known = {t.upper(): t for t in schema}
    return [known[t.upper()] for t in dict.fromkeys(requested or []) if t.upper() in known] or list(defaults)


#: Bounds of a request (fixed values of the API).
BOUNDS = {"depth": (1, 3), "top_k": (1, 20), "query": (2, 2000), "content": (10, 1_000_000)}


def in_bounds(name: str, value: int) -> int:
    """value, or GuardError where it is out of the bounds of `name`."""
    lo, hi = BOUNDS[name]
    if not lo <= value <= hi:
        raise GuardError(f"{name} must be between {lo} and {hi}")
    return value
