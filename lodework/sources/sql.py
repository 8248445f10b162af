"""Queries as text with bound parameters, over stated tables, with a cap on the rows that come back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Rows a query gives back at most.
ROW_CAP = 50_000


class QueryError(ValueError):
    """A text that isn't one reading query."""


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame], params: dict[str, object] | None = None, order: list[str] | None = None, row_cap: int = ROW_CAP) -> DataFrame:
    """The rows of a query over {name} tables with :name parameters, in order, at most row_cap.

    Values are bound, never pasted into the text. One SELECT (or WITH ... SELECT) is allowed; anything else raises.
    Without an order the rows are ordered by all columns, so that the cap always cuts at the same place.
    """
    plain = re.sub(r"'(?:[^']|'')*'", "''", text).strip().rstrip(";")
    if ";" in plain or not re.match(r"(?is)(?:select|with)\b", plain) or re.search(r"(?i)\b(?:insert|update|delete|merge|drop|create|alter|truncate|set)\b", plain):
        raise QueryError("only one reading query is allowed")
    out = spark.sql(text.strip().rstrip(";"), args=params or {}, **tables)
    return out.orderBy(*(order or out.columns)).limit(row_cap)
