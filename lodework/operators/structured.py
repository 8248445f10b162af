"""Tables of uploaded records: column profiles and roles, subjects, and what they say about the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.functions import text as tx

# Fixed values of the profile model: column-name families, narrowest first.
ALIAS = r"\b(?:hindi|marathi|tamil|telugu|bengali|sanskrit|urdu|arabic|chinese|spanish|french|german|latin|local|native|vernacular|regional|alternate|alternative|other)\s+(?:name|title|term)\b|\b(?:name|title)\s+in\s+\w+\b"
ROLES = [
    (r"\b(?:id|uuid|index|key|row|serial|no|number)\b", "ignore"),
    (r"\b(?:url|link|href|image|photo|src)\b", "ignore"),
    (r"\b(?:description|summary|notes?|comment|text|content|detail|recommendation|recommendations|instruction|advice|prognosis|diagnosis|guideline)\b", "freetext"),
    (r"\b(?:severity|duration|frequency|type|category|class|group|status|level|stage|gender|sex|season|seasonal|dosha|doshas|prakriti|constitution|age|grade|rating|score|region|pattern|patterns)\b", "attribute"),
    (r"\b(?:name|title|disease|condition|herb|herbs|drug|product|company|organization|person|author|entity|item|ingredient|symptom|symptoms|treatment|remedy|remedies|formulation|therapy)\b", "entity"),
]
LABELS = [
    (r"\b(?:person|author|doctor|patient|practitioner|name)\b", "Person"),
    (r"\b(?:company|organization|institution|manufacturer|brand)\b", "Organization"),
    (r"\b(?:product|formulation|remedy|medicine|drug|item|artifact|document|book|text)\b", "Artifact"),
    (r"\b(?:disease|condition|symptom|concept|topic|technique|method|therapy|treatment|practice)\b", "Concept"),
]
EDGES = [
    (r"\b(?:symptom|effect|complication|risk|cause|treat|remedy|herb|medicine|drug|intervention|therapy|prevention|indication)\b", "AFFECTS"),
    (r"\b(?:ingredient|component|part|contains|composition|includes)\b", "PART_OF"),
    (r"\b(?:source|origin|derived|extracted|obtained|from)\b", "DERIVED_FROM"),
    (r"\b(?:reference|citation|cited|bibliography)\b", "CITES"),
    (r"\b(?:history|prior|previous|before|after|next|stage|progression)\b", "PRECEDES"),
]
MOST_DISTINCT, MOST_ATTRIBUTE, MOST_ENTITY, LEAST_ROWS, NEAR_UNIQUE, MOST_VALUES, MOST_CELL = 40, 40, 80, 20, 0.95, 8, 120


def _first_match(c: Column, families: list[tuple[str, str]], default: Column) -> Column:
    out = default
    for pattern, value in reversed(families):
        out = F.when(c.rlike(pattern), value).otherwise(out)
    return out


def cells_of(records: DataFrame) -> DataFrame:
    """(record_id, tenant_id, source_uri, ordinal, column, value) of the filled cells."""
    rows = records.select("record_id", "tenant_id", "source_uri", F.posexplode("cells").alias("ordinal", "c"))
    rows = rows.select("record_id", "tenant_id", "source_uri", "ordinal", F.col("c.column_name").alias("column"), F.trim("c.cell_value").alias("value"))
    return rows.where(~tx.is_null_token(F.col("value"), tx.NULLS_COLUMN) & F.col("column").isNotNull())


def profile_columns(records: DataFrame) -> DataFrame:
    """Per tenant and column: occurrences, distinct values, mean length, whether cells hold several, role and label.

    Whether a column holds several values is decided over all its cells. A name family decides before statistics do.
    Cells are aggregated by value before anything is counted distinct, so a column of few values moves few rows.
    """
    cells = cells_of(records)
    multi = cells.groupBy("tenant_id", "column").agg(F.max(F.col("value").rlike(tx.MULTI_VALUE)).alias("multi_valued"), F.min("ordinal").alias("ordinal"))
    per_value = cells.groupBy("tenant_id", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = per_value.join(multi, ["tenant_id", "column"])
    values = F.when(F.col("multi_valued"), tx.split_values(F.col("value"), tx.NULLS_COLUMN)).otherwise(F.array("value"))
    each = rows.select("tenant_id", "column", "multi_valued", "ordinal", "n", F.explode(values).alias("v"))
    each = each.groupBy("tenant_id", "column", "multi_valued", "ordinal", F.lower("v").alias("low")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.length("v")).alias("chars"))
    sums = each.groupBy("tenant_id", "column", "multi_valued", "ordinal").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("distinct_values"), F.sum("chars").alias("chars"))
    mean = F.col("chars") / F.col("occurrences")
    name = F.regexp_replace(F.lower("column"), "_", " ")
    hinted = _first_match(name, ROLES, F.lit(None).cast("string"))
    by_numbers = (
        F.when(mean > MOST_ENTITY, "freetext")
        .when((F.col("occurrences") >= LEAST_ROWS) & (F.col("distinct_values") / F.col("occurrences") > NEAR_UNIQUE), "ignore")
        .when((F.col("distinct_values") <= MOST_DISTINCT) & (mean <= MOST_ATTRIBUTE), "attribute")
        .otherwise("entity")
    )
    role = F.when(name.rlike(ALIAS), "alias").when((hinted == "entity") & (mean > MOST_ENTITY), "freetext").otherwise(F.coalesce(hinted, by_numbers))
    rows = sums.withColumns({"mean_length": F.round(mean, 4), "role": role})
    label = F.when(F.col("role") == "attribute", "Attribute").when(F.col("role") == "entity", _first_match(name, LABELS, F.lit("Entity"))).otherwise("Entity")
    return rows.withColumn("label", label).drop("chars")


def subject_column(profiles: DataFrame) -> DataFrame:
    """Per tenant the column that names a row: an entity column, single-valued before multi-valued, leftmost first.

    Where a tenant has alias columns its leftmost entity column is the subject whatever it holds: the aliases are its names.
    """
    told = profiles.groupBy("tenant_id").agg(F.max(F.col("role") == "alias").alias("has_alias"))
    rows = profiles.where("role = 'entity'").join(told, "tenant_id")
    best = F.min_by("column", F.struct(F.when(F.col("has_alias"), 0).otherwise(F.col("multi_valued").cast("int")).alias("m"), "ordinal", "column"))
    return rows.groupBy("tenant_id").agg(best.alias("subject"))


def record_graph(records: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (tenant_id, entity_id, label, name) and edges (tenant_id, source_id, edge_type, target_id, record_id, confidence).

    The subject of a row is linked with up to 8 values of each other entity or attribute column; long cells, free text
    and ignored columns are left out. Confidence is 1, as tables state facts.
    """
    roles = profiles.select("tenant_id", "column", "role", "label", "multi_valued")
    subjects = subject_column(profiles)
    cells = cells_of(records).join(roles, ["tenant_id", "column"]).join(subjects, "tenant_id")
    named = cells.where("column = subject").groupBy("record_id", "tenant_id").agg(F.min_by("value", "ordinal").alias("subject_name"), F.first("label").alias("subject_label"))
    values = F.when(F.col("multi_valued"), tx.split_values(F.col("value"))).otherwise(F.array("value"))
    other = cells.where("column <> subject and role in ('entity', 'attribute')").where(F.length("value") <= MOST_CELL)
    other = other.select("record_id", "tenant_id", "column", "role", "label", F.explode(F.slice(values, 1, MOST_VALUES)).alias("value"))
    both = other.join(named, ["record_id", "tenant_id"])
    name = F.regexp_replace(F.lower("column"), "_", " ")
    edge = F.when(F.col("role") == "attribute", "HAS_ATTRIBUTE").otherwise(_first_match(name, EDGES, F.lit("ASSOCIATED_WITH")))
    edges = both.select("tenant_id", tx.entity_id(F.col("subject_label"), F.col("subject_name")).alias("source_id"), edge.alias("edge_type"), tx.entity_id(F.col("label"), F.col("value")).alias("target_id"), "record_id", F.lit(1.0).alias("confidence")).where("source_id <> target_id").distinct()
    vertices = named.select("tenant_id", tx.entity_id(F.col("subject_label"), F.col("subject_name")).alias("entity_id"), F.col("subject_label").alias("label"), F.col("subject_name").alias("name"))
    vertices = vertices.unionByName(both.select("tenant_id", tx.entity_id(F.col("label"), F.col("value")).alias("entity_id"), "label", F.col("value").alias("name")))
    return vertices.groupBy("tenant_id", "entity_id", "label").agg(F.min("name").alias("name")), edges


def verbalize(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """(record_id, text): the subject as a heading, then 'column: value' lines without ignored columns."""
    roles = profiles.select("tenant_id", "column", "role")
    cells = cells_of(records).join(roles, ["tenant_id", "column"]).join(subject_column(profiles), "tenant_id", "left").where("role <> 'ignore'")
    line = F.when(F.col("column") == F.col("subject"), F.concat(F.lit("# "), "value")).otherwise(F.concat("column", F.lit(": "), "value"))
    first = F.when(F.col("column") == F.col("subject"), 0).otherwise(1)
    rows = cells.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct(first.alias("f"), "ordinal", line.alias("line")))).alias("x"))
    return rows.select("record_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def aliases(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """(tenant_id, entity_id, alias): values of alias columns (the name in another language) of the rows a subject names.

    The subject's own name is no alias; cells of several values give several.
    """
    roles = profiles.select("tenant_id", "column", "role", "label", "multi_valued")
    cells = cells_of(records).join(roles, ["tenant_id", "column"]).join(subject_column(profiles), "tenant_id")
    named = cells.where("column = subject").groupBy("record_id", "tenant_id").agg(F.min_by("value", "ordinal").alias("name"), F.first("label").alias("label"))
    values = F.when(F.col("multi_valued"), tx.split_values(F.col("value"))).otherwise(F.array("value"))
    other = cells.where("role = 'alias'").select("record_id", "tenant_id", F.explode(values).alias("alias"))
    rows = other.join(named, ["record_id", "tenant_id"]).where(F.lower("alias") != F.lower("name"))
    return rows.select("tenant_id", tx.entity_id(F.col("label"), F.col("name")).alias("entity_id"), "alias").distinct()


def last_row(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row per key, as a table that is overwritten key by key would hold it."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
