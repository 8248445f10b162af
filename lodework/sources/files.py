"""Sources: delimited files, JSON, text, markdown, HTML, spreadsheets and rich documents; by suffix and by folder.

Records come as (source_uri, source_format, row_index, cells), prose as (source_uri, source_format, text). Values of
records are strings; nothing is inferred. What can't be read without an absent library raises.
"""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodework.session import stored

RECORD = "source_uri string, source_format string, row_index long, cells array<struct<column_name:string,cell_value:string>>"
PROSE = "source_uri string, source_format string, text string"
SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "xlsx", ".xls": "xlsx", ".txt": "txt", ".md": "md", ".markdown": "md", ".rst": "txt", ".html": "html", ".htm": "html", ".pdf": "pdf", ".docx": "docx", ".pptx": "pptx"}


class SourceError(ValueError):
    """A file that can't be read faithfully."""


def format_of(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise SourceError(f"no reader for {suffix or path!r}")
    return SUFFIXES[suffix]


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", max_rows: int | None = None) -> DataFrame:
    """Rows of a delimited file with a header, all strings, cells in the order of the header.

    Quoted cells may hold line breaks. row_index counts within a file in reading order. A byte order mark is dropped.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, sep=delimiter, multiLine=True, quote='"', escape='"', encoding="UTF-8", mode="PERMISSIVE")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if max_rows is not None:
        df = df.limit(max_rows)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("cell_value")) for c in df.columns])
    # a multi-line file is one split, so the id counts its rows from a multiple of 2^33
    return df.select(F.input_file_name().alias("source_uri"), F.lit("csv" if delimiter == "," else "tsv").alias("source_format"), (F.monotonically_increasing_id() % F.lit(2**33)).alias("row_index"), cells.alias("cells"))


def _rows_of_json(value: object) -> list[dict]:
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if isinstance(value, dict):
        for x in value.values():
            if isinstance(x, list) and x and all(isinstance(y, dict) for y in x):
                return x
        return [value]
    raise SourceError("the JSON holds no rows")


def _cells(row: dict, columns: list[str]) -> list[dict]:
    show = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else str(v)
    return [{"column_name": c, "cell_value": show(row.get(c))} for c in columns]


def _json_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for uri, text in zip(f["source_uri"], f["text"], strict=True):
            rows = _rows_of_json(json.loads(text.lstrip("\ufeff")))
            columns = list(dict.fromkeys(k for r in rows for k in r))
            yield pd.DataFrame([(uri, "json", i, _cells(r, columns)) for i, r in enumerate(rows)], columns=["source_uri", "source_format", "row_index", "cells"])


def _json_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for uri, n, line in zip(f["source_uri"], f["n"], f["line"], strict=True):
            row = json.loads(line.lstrip("\ufeff"))
            if isinstance(row, dict):
                out.append((uri, n, _cells(row, list(row))))
        yield pd.DataFrame(out, columns=["source_uri", "n", "cells"])


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of JSON files: a list, the first list of objects in an object, or one object; with lines, one object a line.

    Columns are the union of keys in first-seen order, per file. Malformed JSON fails the job. A JSON document is one row
    while it is read; lines are split like any text, so one large file is many tasks.
    """
    if not lines:
        return _whole(spark, path).mapInPandas(_json_files, RECORD)
    text = spark.read.text(path).select(F.input_file_name().alias("source_uri"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    rows = text.where(F.trim("line") != "").mapInPandas(_json_lines, "source_uri string, n long, cells array<struct<column_name:string,cell_value:string>>")
    rows = stored(rows.withColumn("split", F.shiftright("n", 33)), "lines")
    # rows are numbered within their split, and splits carry on where the ones before them in the file end
    counts = rows.groupBy("source_uri", "split").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("source_uri").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("source_uri", "split", before.alias("before"))
    near = F.row_number().over(Window.partitionBy("source_uri", "split").orderBy("n")) - 1
    keys = rows.select("source_uri", "n", F.posexplode("cells").alias("pos", "c")).groupBy("source_uri", "c.column_name").agg(F.min(F.struct("n", "pos")).alias("first"))
    keys = keys.groupBy("source_uri").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "column_name"))), lambda x: x["column_name"]).alias("columns"))
    own = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["column_name"], c["cell_value"])))
    rows = rows.withColumn("near", near).join(counts, ["source_uri", "split"]).join(keys, "source_uri")
    cells = F.transform("columns", lambda k: F.struct(k.alias("column_name"), F.coalesce(F.try_element_at(own, k), F.lit("")).alias("cell_value")))
    return rows.select("source_uri", F.lit("jsonl").alias("source_format"), (F.col("before") + F.col("near")).alias("row_index"), cells.alias("cells"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_uri"), F.col("value").alias("text"))


def read_text(spark: SparkSession, path: str, kind: str = "txt") -> DataFrame:
    return _whole(spark, path).select("source_uri", F.lit(kind).alias("source_format"), "text")


def html_text(column: str) -> F.Column:
    """Text of an HTML page as light markdown: scripts out, headings, list items and paragraphs on their own lines."""
    c = F.regexp_replace(column, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    for n in range(1, 7):
        c = F.regexp_replace(c, rf"(?is)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n")
    c = F.regexp_replace(c, r"(?i)<li\b[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"(?i)</?(?:p|div|br|tr|table|ul|ol|section|article|li)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).select("source_uri", F.lit("html").alias("source_format"), html_text("text").alias("text"))


def _need(module: str, what: str) -> None:
    if importlib.util.find_spec(module) is None:
        raise SourceError(f"{what} needs the library {module}, which isn't installed")


def _sheets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    import openpyxl

    for f in frames:
        for uri, content in zip(f["path"], f["content"], strict=True):
            rows = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True).worksheets[0].iter_rows(values_only=True)
            header = [str(h) if h is not None else f"column_{i}" for i, h in enumerate(next(rows, ()))]
            out = [(uri, "xlsx", i, _cells(dict(zip(header, r, strict=False)), header)) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["source_uri", "source_format", "row_index", "cells"])


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    _need("openpyxl", "a spreadsheet")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_sheets, RECORD)


def _pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    import pypdf

    for f in frames:
        out = []
        for uri, content in zip(f["path"], f["content"], strict=True):
            for n, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1):
                try:
                    text = page.extract_text() or ""
                except Exception:  # noqa: BLE001  a broken page doesn't take the file with it
                    continue
                out += [(uri, "pdf", n, p.strip()) for p in text.split("\n\n") if len(p.strip()) >= 20]
        yield pd.DataFrame(out, columns=["source_uri", "source_format", "page", "text"])


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of at least 20 characters with their page."""
    _need("pypdf", "a PDF")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_pages, "source_uri string, source_format string, page int, text string")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Records or prose of a file by its suffix; the columns tell which."""
    kind = format_of(path)
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, "," if kind == "csv" else "\t")
    if kind in ("json", "jsonl"):
        return read_json(spark, path, lines=kind == "jsonl")
    if kind == "xlsx":
        return read_sheet(spark, path)
    if kind == "html":
        return read_html(spark, path)
    if kind == "pdf":
        return read_pdf(spark, path)
    if kind in ("docx", "pptx"):
        _need("docling", "a rich document")
        raise SourceError("rich documents are converted outside and read as markdown")
    return read_text(spark, path, kind)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.{md,txt,rst}", least_chars: int = 0, max_files: int | None = None) -> DataFrame:
    """Prose files of a folder and the folders below it; unreadable files are skipped, short texts are left out.

    With max_files the first so many by path are read.
    """
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    uri = F.input_file_name()
    suffix = F.lower(F.regexp_extract(uri, r"\.[A-Za-z0-9]+$", 0))
    kind = F.lit("txt")
    for end, name in SUFFIXES.items():
        kind = F.when(suffix == end, name).otherwise(kind)
    rows = df.select(uri.alias("source_uri"), kind.alias("source_format"), F.col("value").alias("text")).where(F.length("text") >= least_chars)
    return rows if max_files is None else rows.orderBy("source_uri").limit(max_files)


def films(movies: DataFrame, credits: DataFrame) -> DataFrame:
    """Films with their credits: the last credit row per title counts; lists of objects come as JSON text."""
    names = lambda c: F.transform(F.from_json(c, "array<struct<name:string,job:string>>"), lambda x: x["name"])
    crew = F.from_json("crew", "array<struct<name:string,job:string>>")
    c = credits.groupBy("title").agg(F.max_by(F.struct("cast", "crew"), F.col("row_index")).alias("c")).select("title", F.col("c.cast").alias("cast"), F.col("c.crew").alias("crew"))
    rows = movies.join(c, "title", "left")
    return rows.select(
        "title", F.substring("release_date", 1, 4).alias("year"), names(F.col("genres")).alias("genres"), "overview",
        F.transform(F.filter(crew, lambda x: x["job"] == "Director"), lambda x: x["name"]).alias("directors"), F.slice(names(F.col("cast")), 1, 5).alias("cast"),
    )


def render_film() -> F.Column:
    """A film row as prose."""
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", "), F.lit(".")))
    head = F.concat(F.lit("# "), "title", F.when(F.length("year") == 4, F.concat(F.lit(" ("), "year", F.lit(")"))).otherwise(F.lit("")))
    return F.concat_ws("\n", head, "overview", line("Directed by ", F.col("directors")), line("Starring ", F.col("cast")), line("Genres: ", F.col("genres")))
