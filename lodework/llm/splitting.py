"""Cutting oversized items at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab and newline.
WORD = re.compile(r"[^ \t\n]+")
#: Ends of paragraphs, lines and sentences, strongest first.
ENDS = (re.compile(r"\n[ \t]*\n\s*"), re.compile(r"\n"), re.compile(r"[.!?…][\"')\]»”]*[ \t\n]+"))


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """Pieces of text as (first word, last word + 1, character start, character end, kind of the cut at its end).

    Word offsets are laid out once; the word index of every boundary is found by binary search in them and kept as a
    sorted array per kind. A piece starts at a word, takes the last paragraph end within the limit, else the last line
    end, else the last sentence end, else is cut hard at the limit. A natural end is taken only beyond half the limit,
    so pieces don't become crumbs. The next piece starts overlap words before the end of the last one, and always
    makes progress. A text within the limit is one piece; one without words gives none.
    """
    spans = np.array([m.span() for m in WORD.finditer(text)], dtype=np.int64).reshape(-1, 2)
    n = len(spans)
    if n == 0:
        return []
    starts = spans[:, 0]
    bounds = []
    for pattern in ENDS:
        ends = np.array([m.end() for m in pattern.finditer(text)], dtype=np.int64)
        bounds.append(np.unique(np.searchsorted(starts, ends, side="left")))
    pieces, first = [], 0
    while True:
        stop, kind = first + limit, "hard"
        if stop >= n:
            pieces.append((first, n, int(starts[first]), int(spans[n - 1, 1]), "end"))
            return pieces
        least = first + max(overlap + 1, limit // 2)
        for at, name in zip(bounds, ("paragraph", "line", "sentence"), strict=True):
            k = int(np.searchsorted(at, stop, side="right")) - 1
            if k >= 0 and at[k] >= least:
                stop, kind = int(at[k]), name
                break
        pieces.append((first, stop, int(starts[first]), int(spans[stop - 1, 1]), kind))
        first = stop - overlap


def _pieces(frames: Iterator[pd.DataFrame], limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for key, text in zip(f["item_key"], f["item_text"], strict=True):
            for i, (a, b, s, e, kind) in enumerate(cut(text, limit, overlap)):
                out.append((key, i, a, b, s, e, kind, text[s:e]))
        yield pd.DataFrame(out, columns=["item_key", "piece_no", "word_start", "word_end", "char_start", "char_end", "cut", "piece"])


def n_words(col: str) -> F.Column:
    """Number of words of a text column, on the JVM; null for null."""
    return F.regexp_count(F.col(col), F.lit(r"[^ \t\n]+"))


def split_oversized(items: DataFrame, key: str, text: str, limit: int = 400, overlap: int = 40) -> DataFrame:
    """Pieces of every item whose text has more than `limit` words; smaller, empty and null texts give no row.

    Returns item_key, piece_no (from 0), word_start, word_end, char_start, char_end, cut, piece. Offsets are code
    points. Items with the same key are cut each for itself, so keys should be unique. Only oversized texts leave the
    JVM; each is one row, whatever its length, and the work is linear in the text. No shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    over = items.where((F.length(text) > 2 * limit) & (n_words(text) > limit)).select(F.col(key).alias("item_key"), F.col(text).alias("item_text"))
    kind = dict(over.dtypes)["item_key"]
    schema = f"item_key {kind}, piece_no int, word_start int, word_end int, char_start int, char_end int, cut string, piece string"
    return over.mapInPandas(partial(_pieces, limit=limit, overlap=overlap), schema)


def section_of(blocks: DataFrame, wanted: DataFrame, bucket: int = 512) -> DataFrame:
    """For every wanted row (document, pos, key) the level and path of the last heading before it in its document.

    blocks has doc, pos, is_heading, level, path. Documents of very many blocks are cut into ranges of `bucket`
    positions: the last heading is found within each range, and the last one of earlier ranges is carried over ranges
    rather than rows. Rows before any heading get nulls, rows of a null document or position too.
    """
    head = F.when(F.col("is_heading"), F.struct("level", "path"))
    rows = wanted.select("doc", "pos", "key", F.lit(None).cast("struct<level:int,path:array<string>>").alias("head")).unionByName(
        blocks.where("is_heading").select("doc", "pos", F.lit(None).cast(dict(wanted.dtypes)["key"]).alias("key"), head.alias("head"))
    )
    rows = rows.withColumn("range", F.floor(F.col("pos") / bucket))
    near = Window.partitionBy("doc", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("near", F.last("head", ignorenulls=True).over(near))
    last = rows.where("head is not null").groupBy("doc", "range").agg(F.max_by("head", "pos").alias("tail"))
    # ranges without a heading still need what comes before them
    ranges = rows.select("doc", "range").distinct().join(last, ["doc", "range"], "left")
    far = Window.partitionBy("doc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("doc", "range", F.last("tail", ignorenulls=True).over(far).alias("far"))
    found = rows.where("head is null").join(carried, ["doc", "range"], "left")
    top = F.coalesce("near", "far")
    return found.select("key", top["level"].alias("near_level"), top["path"].alias("near_path"))


def block_pieces(blocks: DataFrame, limit: int = 400, overlap: int = 40) -> DataFrame:
    """Pieces of all oversized blocks other than headings and records, with the section they belong to.

    section_path is the block's own, else that of the nearest heading before it; heading_level is the block's own,
    else that heading's. Blocks of a null kind are cut too. Returns block_no, piece_no, the offsets, cut, n_words,
    piece, heading_level, section_path.
    """
    body = blocks.where(F.coalesce(~F.col("kind").isin("heading", "record"), F.lit(True)))
    pieces = split_oversized(body, "block_no", "text", limit, overlap)
    doc = F.concat_ws("\x1f", F.coalesce("tenant_id", F.lit("\x00")), "doc_key")
    doc = F.when(F.col("doc_key").isNotNull(), doc)
    cols = blocks.select(
        doc.alias("doc"), F.col("block_pos").alias("pos"), (F.col("kind") == "heading").alias("is_heading"),
        F.col("heading_level").cast("int").alias("level"), F.col("section_path").alias("path"),
    )
    over = body.where((F.length("text") > 2 * limit) & (n_words("text") > limit))
    wanted = over.select(doc.alias("doc"), F.col("block_pos").alias("pos"), F.col("block_no").alias("key"))
    own = over.select(F.col("block_no").alias("key"), F.col("heading_level").cast("int").alias("own_level"), F.col("section_path").alias("own_path"))
    meta = own.join(section_of(cols.where("doc is not null and pos is not null"), wanted), "key", "left")
    out = pieces.join(meta.withColumnRenamed("key", "item_key"), "item_key", "left")
    return out.select(
        F.col("item_key").alias("block_no"), "piece_no", "word_start", "word_end", "char_start", "char_end", "cut",
        (F.col("word_end") - F.col("word_start")).alias("n_words"), "piece",
        F.coalesce("own_level", "near_level").alias("heading_level"), F.coalesce("own_path", "near_path").alias("section_path"),
    )
