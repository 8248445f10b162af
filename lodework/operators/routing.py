"""Which way a block is extracted: records and table rows by their columns, prose by its names."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that are taken as records (a fixed value of the extraction model).
MOST_ROWS = 200

#: Finders of names by preference: the library each needs, None for what is built in.
BACKENDS: dict[str, str | None] = {"gliner": "gliner", "spacy": "spacy", "regex": None}
_FINDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_backend(name: str, needs: str | None, finder: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a finder of names: rows (tenant_id, chunk_id, text) into those of extract.extract."""
    BACKENDS[name] = needs
    _FINDERS[name] = finder


def backend(wanted: str = "gliner") -> str:
    """The first finder from the wanted one on whose library is there; the built-in one at last."""
    names = list(BACKENDS)
    for name in names[names.index(wanted) :] if wanted in names else names:
        if BACKENDS[name] is None or (importlib.util.find_spec(BACKENDS[name]) is not None and name in _FINDERS):
            return name
    return "regex"


def method(kind: Column) -> Column:
    """record, table or prose; None for headings, which are extracted with what stands under them."""
    return F.when(kind == "record", "record").when(kind == "table", "table").when(kind == "heading", None).otherwise("prose")


def table_records(blocks: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Rows of tables as records: (tenant_id, source_uri, block_no, row_index, cells).

    Cells are matched with headers by place; a row longer than the header, cells without a header and null cells are cut
    off or left out, a table without headers or rows gives nothing. The first `most` rows of a table count.
    """
    rows = blocks.where((F.col("kind") == "table") & (F.size("table_headers") > 0)).select("tenant_id", "source_uri", "block_no", "table_headers", F.posexplode(F.slice("table_rows", 1, most)).alias("row_index", "r"))
    pair = F.zip_with("table_headers", F.slice("r", F.lit(1), F.size("table_headers")), lambda h, c: F.struct(h.alias("column_name"), c.alias("cell_value")))
    cells = F.filter(pair, lambda x: x["column_name"].isNotNull() & x["cell_value"].isNotNull())
    return rows.where("r is not null").select("tenant_id", "source_uri", "block_no", "row_index", cells.alias("cells")).where(F.size("cells") > 0)
