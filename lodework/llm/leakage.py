"""Evaluation passages that stand, wholly or partly, in a training corpus.

Stage 1 reads every document once and keeps those in which an n-gram of any test passage occurs. Stage 2 aligns (Smith-
Waterman over words) every kept document with each passage of which it holds any n-gram, and reports score and longest
exact run. Every n-gram is a seed, however common: were only rare ones taken, an exact copy of a passage would make the
n-grams that an edited copy kept the common ones, and push the edited copy out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run of letters or digits, in lower case.
WORD = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Grams:
    """The n-grams of all passages, over ids of the passages' own words."""

    def __init__(self, passages: list[tuple[int, str | None]], n: int) -> None:
        self.n = n
        self.items: dict[tuple[str, ...], list[int]] = defaultdict(list)  # equal passages are one item
        for query_id, text in sorted(passages, key=lambda x: x[0]):
            self.items[tuple(words(text))].append(query_id)
        self.texts = [w for w in self.items if len(w) >= n]
        vocabulary = sorted({w for text in self.texts for w in text})
        self.word_id = {w: i for i, w in enumerate(vocabulary)}
        self.coded = [np.array([self.word_id[w] for w in text], dtype=np.int64) for text in self.texts]
        self.gram_id: dict[tuple[int, ...], int] = {}
        self.grams_of: list[list[int]] = []
        for code in self.coded:
            self.grams_of.append([self.gram_id.setdefault(tuple(code[i : i + n].tolist()), len(self.gram_id)) for i in range(len(code) - n + 1)])

    def code(self, text: str) -> np.ndarray:
        get = self.word_id.get
        return np.fromiter((get(w, -1) for w in WORD.findall(text.lower())), dtype=np.int64)

    def hits(self, code: np.ndarray) -> tuple[list[int], list[int]]:
        """Positions and ids of the grams that stand in a coded text."""
        n = self.n
        if len(code) < n:
            return [], []
        unknown = np.concatenate(([0], np.cumsum(code < 0)))
        at, ids = [], []
        for i in np.flatnonzero(unknown[n:] == unknown[:-n]).tolist():
            g = self.gram_id.get(tuple(code[i : i + n].tolist()))
            if g is not None:
                at.append(i)
                ids.append(g)
        return at, ids


def _mark(frames: Iterator[pd.DataFrame], grams: Grams) -> Iterator[pd.DataFrame]:
    for f in frames:
        held = [bool(text) and bool(grams.hits(grams.code(text))[0]) for text in f["doc_text"]]
        if any(held):
            yield f[held]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two coded texts (Smith-Waterman, linear gaps): its score, and the longest exact run."""
    steps = np.arange(len(b) + 1) * -GAP
    above, runs = np.zeros(len(b) + 1, dtype=np.int64), np.zeros(len(b) + 1, dtype=np.int64)
    best = longest = 0
    for x in a:
        same = (b == x) if x >= 0 else np.zeros(len(b), dtype=bool)
        here = np.zeros(len(b) + 1, dtype=np.int64)
        np.maximum(above[:-1] + np.where(same, MATCH, MISMATCH), above[1:] + GAP, out=here[1:])
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + steps) - steps
        grown = np.zeros_like(runs)
        grown[1:] = np.where(same, runs[:-1] + 1, 0)
        above, runs = here, grown
        best, longest = max(best, int(here.max())), max(longest, int(grown.max()))
    return best, longest


def _align(frames: Iterator[pd.DataFrame], grams: Grams) -> Iterator[pd.DataFrame]:
    items_of = defaultdict(list)
    for item, own in enumerate(grams.grams_of):
        for g in set(own):
            items_of[g].append(item)
    for f in frames:
        out = []
        for key, text in zip(f["doc_key"], f["doc_text"], strict=True):
            code = grams.code(text)
            at, ids = grams.hits(code)
            places = defaultdict(list)
            for i, g in zip(at, ids, strict=True):
                for item in items_of[g]:
                    places[item].append(i)
            for item, where in places.items():
                passage = grams.coded[item]
                score = longest = 0
                for lo, hi in _stretches(where, len(passage), len(code)):
                    s, r = align(passage, code[lo:hi])  # the shorter first: align loops over its words
                    score, longest = max(score, s), max(longest, r)
                for query_id in grams.items[grams.texts[item]]:
                    out.append((key, query_id, score, score / (MATCH * len(passage)), longest, len(passage)))
        yield pd.DataFrame(out, columns=["doc_id", "query_id", "score", "similarity", "longest_run", "passage_words"])


def _stretches(where: list[int], size: int, length: int) -> Iterator[tuple[int, int]]:
    """Parts of a text around its hits, each with room for the passage and as many gaps, overlapping ones joined."""
    lo, hi = where[0] - 2 * size, where[0] + 2 * size
    for i in where[1:]:
        if i - 2 * size > hi:
            yield max(0, lo), min(length, hi)
            lo = i - 2 * size
        hi = i + 2 * size
    yield max(0, lo), min(length, hi)


#: Words of test passages that one pass over the corpus holds in every task.
PASS_WORDS = 5_000_000


def leaks(documents: DataFrame, queries: DataFrame, n: int = 6, doc_key: str = "doc_id", doc_text: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per document and test item that share an n-gram: score, similarity, longest_run, passage_words.

    queries (query_id, passage) is the held-out set; the corpus is only ever streamed. Passages are held in memory, at
    most about pass_words words at once: a larger set is dealt out over several passes of the corpus, equal passages to
    one. similarity is the alignment's score over that of the whole passage: edited and paraphrased
    copies keep a high one though longest_run is short. Null, blank and short (under n words) passages and texts give no row; equal
    passages give a row per query_id; a document key that occurs twice is looked at twice.
    """
    held = queries.select(F.col("query_id").cast("long").alias("query_id"), "passage").where("passage is not null and query_id is not null").distinct()
    size = held.agg(F.sum(F.regexp_count("passage", F.lit(r"(?U)[\p{L}\p{N}]+")))).first()[0] or 0
    passes = max(1, -(-size // pass_words))
    docs = documents.select(F.col(doc_key).alias("doc_key"), F.col(doc_text).alias("doc_text"))
    kind = dict(docs.dtypes)["doc_key"]
    schema = f"doc_id {kind}, query_id long, score int, similarity double, longest_run int, passage_words int"
    # the documents left are few and costly: they are dealt out over all cores, and over more tasks the larger the corpus is
    spread = max(2 * documents.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 8)
    found = []
    for i in range(passes):
        own = held.where(F.pmod(F.xxhash64(F.lower("passage")), F.lit(passes)) == i) if passes > 1 else held
        grams = Grams([(r["query_id"], r["passage"]) for r in own.collect()], n)
        marked = docs.mapInPandas(partial(_mark, grams=grams), f"doc_key {kind}, doc_text string")
        found.append(marked.repartition(spread).mapInPandas(partial(_align, grams=grams), schema))
    return reduce(DataFrame.unionByName, found)
