"""Finding many phrases in many texts in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of phrases that one pass holds in every task; more phrases are dealt out over several passes.
PASS_CHARS = 20_000_000


def _find(frames: Iterator[pd.DataFrame], phrases: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(p, p)
    automaton.make_automaton()
    for f in frames:
        out = [(key, p) for key, text in zip(f["key"], f["text"], strict=True) for p in {p for _, p in automaton.iter(text)}]
        yield pd.DataFrame(out, columns=["key", "phrase"])


def phrases_in(texts: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """(key, phrase): which phrases (column phrase, in lower case) stand in which texts, in any case; a multi-pattern automaton.

    phrases is a stated set, held in every task in parts of at most about pass_chars characters; the texts are only streamed.
    Blank and null phrases are found nowhere; texts without a phrase give no row. No shuffle.
    """
    want = phrases.where(F.trim("phrase") != "").select(F.lower("phrase").alias("phrase")).distinct()
    size = want.agg(F.sum(F.length("phrase"))).first()[0] or 0
    passes = max(1, -(-size // pass_chars))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    schema = f"key {dict(rows.dtypes)['key']}, phrase string"
    found = []
    for i in range(passes):
        own = want.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == i) if passes > 1 else want
        held = tuple(r["phrase"] for r in own.collect())
        if held:
            found.append(rows.mapInPandas(partial(_find, phrases=held), schema))
    return reduce(DataFrame.unionByName, found) if found else rows.select("key", F.col("text").alias("phrase")).where("false")
