"""Long exact spans that stand in more than one record.

Cut points come from a gear rolling hash: a point is one where the hash is the least of some window of neighbours, so
it depends on the text around it only and moves along with insertions. A chunk goes from a sparse cut point to the
first dense one at least LEAST characters on. Windows are chosen so that any shared run of `least_run` characters holds
a whole chunk of both texts; equal digests therefore find every such run, and only those candidates are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodework.session import stored

_GEAR = np.random.default_rng(20_240_101).integers(0, 2**32, 4096, dtype=np.uint32)


@dataclass(frozen=True)
class Cutting:
    """Windows in characters: of the hash (a power of two), of sparse starts and of dense ends."""

    least_run: int = 300
    hash_window: int = 16
    start_window: int = 96
    end_window: int = 40

    @property
    def least_chunk(self) -> int:
        """Shortest chunk such that a run holds one: the first start in a run, plus this, plus one end window, fit in it."""
        return self.least_run + 2 - self.hash_window - self.start_window - self.end_window

    @property
    def reach(self) -> int:
        """How far a shared run can go on beyond the chunks found in it."""
        return self.hash_window + self.start_window + self.end_window

    def check(self) -> None:
        if self.least_chunk < self.start_window:
            raise ValueError("least_run is too short for these windows")


def _gear(points: np.ndarray, window: int) -> np.ndarray:
    """Gear hash of the `window` characters up to each position, by doubling."""
    h, done = _GEAR[(points ^ (points >> 12)) & 4095], 1
    while done < window:
        h[done:] += h[:-done] << np.uint32(done)
        done *= 2
    return h


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of `window` keys, by doubling; shorter by window - 1."""
    m, done = keys, 1
    while done < window:
        step = min(done, window - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    return m


def _cuts(keys: np.ndarray, window: int, valid: np.ndarray) -> np.ndarray:
    """Positions that are the least (the rightmost of equals) of some run of `window` neighbours.

    valid tells for each position how many valid positions follow it, itself included: runs of neighbours must be
    valid throughout, so they never reach from one text into another.
    """
    if len(keys) < window:
        return np.empty(0, dtype=np.int64)
    low = _least(keys, window)[valid[: len(keys) - window + 1] >= window]
    at = 0xFFFFFFFF - (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at


def chunks(text: str, c: Cutting) -> list[tuple[int, int]]:
    """Chunks of one text as (start, end)."""
    _, starts, ends, _ = _chunks_of([text], c)
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def _chunks_of(texts: list[str], c: Cutting) -> tuple[np.ndarray, ...]:
    """Text number, start, end and digest of all chunks of texts; the arithmetic runs over all texts at once."""
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(data, dtype=np.uint32)
    if not len(points):
        return (np.empty(0, dtype=np.int64),) * 4
    hashes = _gear(points, c.hash_window).astype(np.uint64)
    n = len(points)
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    number = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n) - firsts[number]
    valid = np.where((place >= c.hash_window - 1) & (sizes[number] >= c.least_run), sizes[number] - place, 0)
    starts, ends = _cuts(keys, c.start_window, valid), _cuts(keys, c.end_window, valid)
    k = np.searchsorted(ends, starts + c.least_chunk)
    starts, ends = starts[k < len(ends)], ends[k[k < len(ends)]]
    inside = number[starts] == number[ends]  # a chunk of two texts isn't one
    starts, ends = starts[inside], ends[inside]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(view[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    of = number[starts]
    return of, starts - firsts[of], ends - firsts[of], digests.view(np.int64)


#: Characters handled at once: arrays of this size stay in the cache.
_AT_ONCE = 40_000


def _emit(frames: Iterator[pd.DataFrame], c: Cutting) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts, keys, parts, i = f["text"].tolist(), f["doc_id"].to_numpy(), [], 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) <= _AT_ONCE:
                size += len(texts[j])
                j += 1
            number, start, end, digests = _chunks_of(texts[i:j], c)
            parts.append((digests, keys[i:j][number], start.astype(np.int32), end.astype(np.int32)))
            i = j
        if parts:
            yield pd.DataFrame({k: np.concatenate(x) for k, x in zip(("digest", "doc_id", "start", "end"), zip(*parts, strict=True), strict=True)})


def _windows(frames: Iterator[pd.DataFrame], c: Cutting) -> Iterator[pd.DataFrame]:
    """For chunks of hot digests: a key for every run of least_run characters around the chunk."""
    digest = xxhash.xxh3_64_intdigest
    for f in frames:
        out = []
        for d, doc, a, e, text in zip(f["digest"], f["doc_id"], f["start"], f["end"], f["text"], strict=True):
            for t in range(max(0, c.least_run - (len(text) - a)), min(a, c.least_run - (e - a)) + 1):
                k = digest(f"{d}:{t}:{text[a - t : a - t + c.least_run]}".encode("utf-8", "surrogatepass"))
                out.append((k - 2**64 if k >= 2**63 else k, doc, a, e, a - t))
        yield pd.DataFrame(out, columns=["digest", "doc_id", "start", "end", "at"])


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        left = [common_prefix(x[::-1], y[::-1]) for x, y in zip(f["left_a"], f["left_b"], strict=True)]
        right = [common_prefix(x, y) for x, y in zip(f["right_a"], f["right_b"], strict=True)]
        g = f[["doc_a", "doc_b"]].copy()
        g["start_a"], g["start_b"] = f["start_a"] - left, f["start_b"] - left
        g["length"] = f["length"] + np.array(left, dtype=np.int64) + np.array(right, dtype=np.int64)
        yield g


def _islands(col: str) -> Column:
    """Overlapping intervals of a sorted array of (start, end) merged."""
    kind = "array<struct<start:int,end:int>>"
    def step(acc: Column, x: Column) -> Column:
        top = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= top["end"]), grown).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.sort_array(col), F.array().cast(kind), lambda acc, x: step(acc, x).cast(kind))


class SharedSpans:
    """Runs of at least c.least_run equal characters between texts.

    Texts that are wholly equal form a class, represented by its least key: `classes` (doc_id, class_id) lists the
    classes of two or more. `runs` (doc_a, doc_b, start_a, start_b, length) has every longest run between two
    representatives. Null texts and texts shorter than least_run share nothing. Rows of one doc_id are one document,
    and a run that a text shares with itself doesn't count.
    """

    def __init__(self, documents: DataFrame, c: Cutting = Cutting(), hot: int = 64) -> None:  # noqa: B008
        c.check()
        self.c = c
        docs = documents.select("doc_id", "text").where(F.length("text") >= c.least_run)
        self.docs = docs
        same = docs.select("doc_id", F.md5("text").alias("m"), F.length("text").alias("n_chars"))
        least = same.groupBy("m", "n_chars").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("most")).where("class_id < most")
        self.classes = stored(same.join(least.drop("most"), ["m", "n_chars"]).select("doc_id", "class_id", "n_chars").distinct(), "classes")
        kind = dict(docs.dtypes)["doc_id"]
        schema = f"digest long, doc_id {kind}, start int, end int"
        found = stored(docs.mapInPandas(partial(_emit, c=c), schema), "chunks")
        shared = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        copies = self.classes.where("doc_id <> class_id").select("doc_id")
        rows = found.join(shared.select("digest", "n"), "digest").join(copies, "doc_id", "left_anti")
        rows = stored(rows, "shared")
        few = rows.where(F.col("n") <= hot).drop("n")
        self.windows = rows.where(F.col("n") > hot).drop("n").join(docs, "doc_id").mapInPandas(partial(_windows, c=c), f"{schema}, at int")
        self.few_runs = self._runs(self._pairs(few))
        self.runs = self._runs(self._pairs(few).unionByName(self._pairs(self.windows)))

    def _runs(self, pairs: DataFrame) -> DataFrame:
        """Longest runs of at least least_run characters around the chunks that two texts share."""
        docs, c = self.docs, self.c
        kind = dict(docs.dtypes)["doc_id"]
        spans = pairs.groupBy("doc_a", "doc_b", "shift").agg(F.collect_set(F.struct("start", "end")).alias("x"))
        spans = spans.select("doc_a", "doc_b", "shift", F.explode(_islands("x")).alias("x"))
        spans = spans.select("doc_a", "doc_b", F.col("x.start").alias("start_a"), (F.col("x.start") - F.col("shift")).alias("start_b"), (F.col("x.end") - F.col("x.start")).alias("length"))
        for side in ("a", "b"):
            own = docs.withColumnsRenamed({"doc_id": f"doc_{side}", "text": "t"})
            start, stop = F.col(f"start_{side}"), F.col(f"start_{side}") + F.col("length")
            back = F.least(start, F.lit(c.reach))
            spans = spans.join(own, f"doc_{side}").withColumns({
                f"left_{side}": F.substr("t", start - back + 1, back), f"right_{side}": F.substr("t", stop + 1, F.lit(c.reach)),
            }).drop("t")
        grown = spans.mapInPandas(_extend, f"doc_a {kind}, doc_b {kind}, start_a int, start_b int, length int")
        return grown.where(F.col("length") >= c.least_run).distinct()

    @staticmethod
    def _pairs(rows: DataFrame) -> DataFrame:
        a = rows.select("digest", F.col("doc_id").alias("doc_a"), F.col("start"), F.col("end"))
        b = rows.select("digest", F.col("doc_id").alias("doc_b"), F.col("start").alias("start_b"))
        both = a.join(b, "digest").where("doc_a < doc_b")
        return both.select("doc_a", "doc_b", (F.col("start") - F.col("start_b")).alias("shift"), "start", "end")

    def document_pairs(self) -> DataFrame:
        """Every pair of documents that share a run, members of classes included: (doc_id_a, doc_id_b), distinct."""
        links = self.runs.select("doc_a", "doc_b").distinct()
        member = self.classes.select("doc_id", "class_id")
        for side in ("a", "b"):
            m = member.withColumnsRenamed({"doc_id": "m", "class_id": f"doc_{side}"})
            links = links.join(m, f"doc_{side}", "left").withColumn(f"doc_{side}", F.coalesce("m", f"doc_{side}")).drop("m")
        within = member.join(member.withColumnRenamed("doc_id", "other"), "class_id").where("doc_id < other")
        lo, hi = F.least("doc_a", "doc_b"), F.greatest("doc_a", "doc_b")
        pairs = links.select(lo.alias("doc_id_a"), hi.alias("doc_id_b")).unionByName(within.select(F.col("doc_id").alias("doc_id_a"), F.col("other").alias("doc_id_b")))
        return pairs.distinct()

    def shared_portion(self) -> DataFrame:
        """Per document that shares a run: class_id, n_chars, shared_chars, shared_portion, links.

        Passages in at most `hot` texts are extended pair by pair; of commoner ones every window of least_run characters
        that a second text holds is counted, so a passage in n texts costs n rows for each of its windows and no pair.
        links is the number of other texts with which a run of the first kind is shared, or of those that hold the
        commonest window where that is more, and the other members of the class.
        """
        r, most = self.few_runs, self.c.least_run
        a = r.select(F.col("doc_a").alias("class_id"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("length")).alias("end"), F.col("doc_b").alias("other"))
        b = r.select(F.col("doc_b").alias("class_id"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("length")).alias("end"), F.col("doc_a").alias("other"))
        sides = a.unionByName(b)
        linked = sides.groupBy("class_id").agg(F.countDistinct("other").alias("linked"))
        held = stored(self.windows.select("digest", F.col("doc_id").alias("class_id"), "at").distinct(), "windows")
        of = held.select("digest", "class_id").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
        common = held.join(of, "digest").groupBy("class_id", F.col("at").alias("start")).agg(F.max("texts").alias("texts"))
        spans = sides.select("class_id", "start", "end", F.lit(0).cast("long").alias("texts")).unionByName(common.select("class_id", "start", (F.col("start") + most).alias("end"), "texts"))
        spans = spans.groupBy("class_id", "start").agg(F.max("end").alias("end"), F.max("texts").alias("texts"))
        # a position is covered once: a span counts from where all earlier ones of its text end
        before = F.max("end").over(Window.partitionBy("class_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
        spans = spans.withColumn("free", F.greatest("start", F.coalesce(before, F.lit(0))))
        covered = spans.groupBy("class_id").agg(F.sum(F.greatest(F.col("end") - F.col("free"), F.lit(0))).cast("int").alias("covered"), F.max("texts").alias("texts"))
        sizes = self.classes.groupBy("class_id").agg((F.count(F.lit(1)) - 1).alias("copies"))
        docs = self.docs.select("doc_id", F.length("text").alias("n_chars")).join(self.classes.select("doc_id", "class_id"), "doc_id", "left").distinct()
        docs = docs.withColumn("class_id", F.coalesce("class_id", "doc_id"))
        out = docs.join(covered, "class_id", "left").join(linked, "class_id", "left").join(sizes, "class_id", "left").where("covered is not null or copies is not null")
        chars = F.when(F.col("copies").isNotNull(), F.col("n_chars")).otherwise(F.col("covered"))
        others = F.greatest(F.coalesce("linked", F.lit(0)), F.coalesce(F.col("texts") - 1, F.lit(0)))
        return out.select("doc_id", "class_id", "n_chars", chars.alias("shared_chars"), (chars / F.col("n_chars")).alias("shared_portion"), (others + F.coalesce("copies", F.lit(0))).alias("links"))
