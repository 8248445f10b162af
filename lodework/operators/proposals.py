"""Entities and relations proposed by a provider (a language model or a service), made to fit a vocabulary.

A provider is any function from DataFrame (chunk_id, text) to proposals; there is none by default. Labels are coerced
before they are refused, relations are refused rather than given a wrong type.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.functions import text as tx

#: Turns rows (chunk_id, text) into rows (chunk_id, answer), the answer a text with a JSON object in it.
Provider = Callable[[DataFrame], DataFrame]
#: Characters of a chunk that a provider is shown (a fixed value of the extraction model).
MOST_SHOWN = 6000
_ANSWER = "entities array<struct<name:string,label:string,confidence:double>>, relations array<struct<source:string,relation:string,target:string,confidence:double>>"


def propose(chunks: DataFrame, provider: Provider | None) -> tuple[DataFrame, DataFrame]:
    """What a provider proposes for chunks (chunk_id, text): entities and relations, as `accept` takes them.

    Without a provider nothing is proposed. Of an answer the outermost object counts, whatever stands around it; an
    answer without one, or with other fields, proposes nothing.
    """
    shown = chunks.select("chunk_id", F.substring("text", 1, MOST_SHOWN).alias("text"))
    answers = shown.select("chunk_id", F.lit(None).cast("string").alias("answer")).where("false") if provider is None else provider(shown)
    told = answers.select("chunk_id", tx.tolerant_json(F.col("answer"), _ANSWER).alias("x"))
    entities = told.select("chunk_id", F.inline("x.entities"))
    return entities, told.select("chunk_id", F.inline("x.relations"))

# Fixed values of the coercion: near-misses of labels and of relations.
LABELS = {
    "people": "Person", "human": "Person", "individual": "Person", "author": "Person", "doctor": "Person", "patient": "Person",
    "company": "Organization", "institution": "Organization", "corporation": "Organization", "org": "Organization", "lab": "Organization",
    "product": "Artifact", "document": "Artifact", "work": "Artifact", "medicine": "Artifact", "drug": "Artifact", "formulation": "Artifact", "book": "Artifact", "paper": "Artifact", "model": "Artifact",
    "idea": "Concept", "topic": "Concept", "theme": "Concept", "condition": "Concept", "disease": "Concept", "symptom": "Concept", "technique": "Concept", "method": "Concept", "process": "Concept",
    "property": "Attribute", "category": "Attribute", "value": "Attribute", "type": "Attribute", "status": "Attribute", "level": "Attribute", "thing": "Entity", "object": "Entity", "item": "Entity",
}
RELATIONS = {
    "treats": "AFFECTS", "causes": "AFFECTS", "influences": "AFFECTS", "impacts": "AFFECTS", "prevents": "AFFECTS", "cures": "AFFECTS",
    "has": "HAS_ATTRIBUTE", "has_property": "HAS_ATTRIBUTE", "is_a": "HAS_ATTRIBUTE", "type_of": "HAS_ATTRIBUTE",
    "contains": "PART_OF", "includes": "PART_OF", "member_of": "PART_OF", "belongs_to": "PART_OF", "component_of": "PART_OF",
    "from": "DERIVED_FROM", "source": "DERIVED_FROM", "based_on": "DERIVED_FROM", "extracted_from": "DERIVED_FROM",
    "references": "CITES", "mentions": "CITES", "before": "PRECEDES", "followed_by": "PRECEDES", "leads_to": "PRECEDES",
    "related": "RELATED_TO", "linked_to": "ASSOCIATED_WITH", "associated": "ASSOCIATED_WITH", "correlated_with": "ASSOCIATED_WITH",
}
MOST_NAME = 120


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def coerce_label(c: Column, allowed: list[str]) -> Column:
    """A label of the vocabulary: as it is, in its case, by synonym, else Entity where there is that label; null otherwise."""
    fallback = F.lit("Entity") if "Entity" in allowed else F.lit(None).cast("string")
    by_case = _lookup(F.lower(c), {a.lower(): a for a in allowed})
    by_synonym = _lookup(F.regexp_replace(F.lower(c), " ", "_"), {k: v for k, v in LABELS.items() if v in allowed} or {"": ""})
    return F.when(c.isin(allowed), c).otherwise(F.coalesce(by_case, by_synonym, fallback))


def coerce_relation(c: Column, allowed: list[str]) -> Column:
    """A relation of the vocabulary: normalised, by synonym, else null."""
    plain = F.regexp_replace(F.upper(c), "[ -]", "_")
    by_synonym = _lookup(F.regexp_replace(F.lower(c), " ", "_"), {k: v for k, v in RELATIONS.items() if v in allowed} or {"": ""})
    return F.when(plain.isin(allowed), plain).otherwise(by_synonym)


def accept(entities: DataFrame, relations: DataFrame, labels: list[str], edges: list[str], least: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """Proposed entities (chunk_id, name, label, confidence) and relations (chunk_id, source, relation, target, confidence)
    with a reason against each that isn't accepted, the first that applies; accepted ones have entity_id or edge_type."""
    e = entities.withColumn("coerced", coerce_label(F.col("label"), labels))
    size = F.coalesce(F.length(F.trim("name")), F.lit(0))
    reason = F.when((size < 1) | (size > MOST_NAME), "bad_name").when(F.col("coerced").isNull(), "unknown_label").when(F.coalesce("confidence", F.lit(0.0)) < least, "low_confidence")
    e = e.withColumn("reason", reason).withColumn("entity_id", F.when(F.col("reason").isNull(), tx.entity_id(F.col("coerced"), F.col("name"))))
    known = e.where("reason is null").select("chunk_id", F.lower(F.trim("name")).alias("low")).distinct()
    r = relations.withColumn("edge_type", coerce_relation(F.col("relation"), edges))
    for side in ("source", "target"):
        k = known.select("chunk_id", F.col("low").alias(f"{side}_low"), F.lit(True).alias(f"has_{side}"))
        r = r.withColumn(f"{side}_low", F.lower(F.trim(side))).join(k, ["chunk_id", f"{side}_low"], "left")
    why = (
        F.when(F.col("edge_type").isNull(), "unknown_relation").when(F.coalesce("confidence", F.lit(0.0)) < least, "low_confidence")
        .when(F.col("has_source").isNull() | F.col("has_target").isNull(), "endpoint_not_extracted").when(F.col("source_low") == F.col("target_low"), "self_loop")
    )
    return e, r.withColumn("reason", why).drop("has_source", "has_target", "source_low", "target_low")
