"""Functions for SQL: scalar UDFs and table functions under fixed names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodework.functions import similarity, text

_EXTRA: dict[str, object] = {}


@F.udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("term", StringType())]))
class Terms:
    """SELECT * FROM lode_terms('...') or LATERAL lode_terms(t.text): index terms with their position."""

    def eval(self, value: str) -> Iterator[tuple[int, str]]:
        found = re.findall(text.TERM, (value or "").lower())
        yield from enumerate(t for t in found if t not in text.STOPWORDS)


@F.udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("sentence", StringType())]))
class Sentences:
    def eval(self, value: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(s for s in re.split(text.SENTENCE_GAP, value or "") if s.strip())


@F.udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("kind", StringType()), StructField("body", StringType())]))
class Blocks:
    """Blocks of a markdown text: SELECT t.id, b.* FROM t, LATERAL lode_blocks(t.text) b."""

    def eval(self, value: str) -> Iterator[tuple[int, str, str]]:
        from lodework.operators.chunking import markdown_blocks_of

        for i, (kind, body, *_) in enumerate(markdown_blocks_of(value or "")):
            yield i, kind, body


@F.udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("name", StringType()), StructField("label", StringType())]))
class Names:
    """Names in a text with their labels, by the vocabulary of a domain: LATERAL lode_names(t.text, 'film')."""

    def eval(self, value: str, domain: str) -> Iterator[tuple[int, str, str]]:
        from lodework.operators.extract import mentions_of

        for m in mentions_of(value or "", domain):
            yield m.start, m.name, m.label


#: Functions written in SQL: the optimizer sees through them.
_SQL = {
    "lode_normalize_name": ("s STRING", "STRING", r"trim(BOTH '_' FROM regexp_replace(regexp_replace(lower(trim(s)), '(?U)[^\\w\\s-]', ''), '[\\s-]+', '_'))"),
    "lode_entity_id": ("label STRING, name STRING", "STRING", "concat('canon_', lower(label), '_', lode_normalize_name(name))"),
    "lode_token_count": ("s STRING", "INT", r"CASE WHEN regexp_count(s, '(?U)\\w+|[^\\w\\s]') = 0 THEN 0 ELSE cast(greatest(1, floor(regexp_count(s, '(?U)\\w+|[^\\w\\s]') * 1.3)) AS INT) END"),
    "lode_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "lode_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) > 0 AND size(a) = size(b) AND lode_dot(a, a) > 0 AND lode_dot(b, b) > 0 THEN lode_dot(a, b) / sqrt(lode_dot(a, a) * lode_dot(b, b)) ELSE 0D END"),
}


def extend(name: str, function: Callable | object) -> None:
    """Adds a pandas UDF or UDTF of your own to what register() puts into a session."""
    _EXTRA[name] = function


def register(spark: SparkSession) -> list[str]:
    """Registers everything and returns the names."""
    for name, (args, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udf.register("lode_jaro_winkler", similarity.jaro_winkler)
    spark.udf.register("lode_hashed_cosine", similarity.hashed_cosine)
    tables = {"lode_terms": Terms, "lode_sentences": Sentences, "lode_blocks": Blocks, "lode_names": Names}
    for name, table in tables.items():
        spark.udtf.register(name, table)
    for name, function in _EXTRA.items():
        is_table = isinstance(getattr(function, "func", None), type)
        (spark.udtf if is_table else spark.udf).register(name, function)
    return [*_SQL, "lode_jaro_winkler", "lode_hashed_cosine", *tables, *_EXTRA]
