"""Mixing sources to target weights: exact shares, capped repeats, and a Pfair interleaving.

Every source gets release times and deadlines for its blocks from its weight, and earliest-deadline-first among the
released blocks decides which source fills a slot. Weights are whole parts of a period, so after a period every source
has had exactly its part and the schedule starts anew: one period, computed on the driver, serves any size.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lodework.session import stored

#: Fewest parts into which the total weight is divided (shares are exact to one part), and most: the slot table has as many rows.
PERIOD, LONGEST = 10_000, 2_000_000
#: How the vocabulary file's tokenizer splits text before merging (a fixed value of that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE_LIMIT = 1_000_000


@lru_cache(maxsize=2)
def _encoder(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, encode, cache: dict[str, int]) -> int:  # noqa: ANN001
    """Tokens of text. A lone space always opens a token of its own word, so words can be counted one by one."""
    if "  " in text:
        return len(encode(text))
    first, *rest = text.split(" ")
    total = len(encode(first)) if first else 0
    for w in rest:
        n = cache.get(w)
        if n is None:
            if len(cache) >= _CACHE_LIMIT:
                cache.clear()
            n = cache[w] = len(encode(" " + w))
        total += n
    return total


def _count(frames: Iterator[pd.DataFrame], vocabulary: str) -> Iterator[pd.DataFrame]:
    encode, cache = _encoder(vocabulary).encode_ordinary, {}
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "n_tokens": [count_tokens(t, encode, cache) for t in f["text"]]})


def tidy_source(col: str) -> F.Column:
    """A source name without stray blanks, capitals and underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), "[_ ]+", "-")


def token_counts(documents: DataFrame, sources: list[str], vocabulary: str) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of the given sources. Null and blank texts are left out."""
    rows = documents.select("doc_id", tidy_source("source").alias("source"), "text")
    rows = rows.where(F.col("source").isin(sources) & (F.trim("text") != ""))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(partial(_count, vocabulary=vocabulary), f"doc_id {kind}, source string, n_tokens long")


def period_of(weights: dict[str, float]) -> int:
    """Parts of a period in which the least weight still has one of its own (and no source more than its due by rounding)."""
    total, least = sum(weights.values()), min(weights.values())
    period = max(PERIOD, math.ceil(total / least), 2 * len(weights))
    if period > LONGEST:
        raise ValueError(f"a share of {least / total:.1e} of the whole is below 1 / {LONGEST}")
    return period


def whole_parts(weights: dict[str, float], period: int | None = None) -> dict[str, int]:
    """Weights as whole parts of the period, by largest remainder; a positive weight gets at least one part."""
    period = period or period_of(weights)
    if len(weights) > period:
        raise ValueError("a period must have a part for every source")
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    parts = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (parts[k] - exact[k], k))
    left = period - sum(parts.values())
    for i in range(left):
        parts[order[i % len(order)]] += 1
    over = [(-(parts[k] - exact[k]), k) for k in parts if parts[k] > 1]
    heapq.heapify(over)
    for _ in range(-left):  # parts given to the smallest are taken where most is over
        d, k = heapq.heappop(over)
        parts[k] -= 1
        if parts[k] > 1:
            heapq.heappush(over, (d + 1, k))
    return parts


def pfair(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """One period of the schedule as (source, number of its block, slot).

    Block j of a source with p of P parts is released at floor(j * P / p) and due by ceil((j + 1) * P / p); in every
    slot the released block with the earliest deadline runs. Before each slot, every source has had its weight times
    the slots so far to within less than one block.
    """
    period = sum(parts.values())
    waiting = [(0, k, 0) for k in sorted(parts)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[k]), k, j))
        _, k, j = heapq.heappop(ready)
        out.append((k, j, slot))
        if j + 1 < parts[k]:
            heapq.heappush(waiting, ((j + 1) * period // parts[k], k, j + 1))
    return out


def plan(available: dict[str, int], targets: list[Row], total_tokens: int | None) -> dict[str, dict]:
    """What each source contributes. Sources without tokens can't contribute: the others' shares grow in proportion.

    Without total_tokens the mixture is the largest in which every share is exact: the scarcest capped source decides
    (with no cap at all, the tokens there are). With total_tokens a source gives at most its cap, and the report shows
    what is missing. Targets of one tidied name are added, the smaller cap holds; null or non-positive shares are void.
    """
    share: dict[str, float] = {}
    cap: dict[str, int | None] = {}
    for t in targets:
        if t["source"] is not None and t["target_share"] is not None and t["target_share"] > 0:
            share[t["source"]] = share.get(t["source"], 0.0) + t["target_share"]
            caps = [c for c in (cap.get(t["source"]), t["max_repeats"]) if c is not None]
            cap[t["source"]] = min(caps) if caps else None
    live = {k: w for k, w in share.items() if available.get(k, 0) > 0 and (cap[k] is None or cap[k] > 0)}
    scale = sum(live.values()) or 1.0
    bounds = [cap[k] * available[k] * scale / w for k, w in live.items() if cap[k] is not None]
    total = total_tokens if total_tokens is not None else (min(bounds) if bounds else sum(available[k] for k in live))
    out = {}
    for k, w in share.items():
        have = available.get(k, 0)
        need = 0
        if k in live:
            need = int(total * live[k] / scale)
            need = need if cap[k] is None else min(need, cap[k] * have)
        out[k] = {"target": w, "weight": live.get(k, 0.0) / scale, "cap": cap[k], "have": have, "need": need, "passes": need // have if have else 0, "rest": need % have if have else 0}
    return out


def _positions(tokens: DataFrame, counts: dict[str, int], bucket: int) -> DataFrame:
    """tokens with the tokens before each document in its source, in a fixed pseudo-random order.

    A source may hold any number of rows: its hash range is cut into ranges of about `bucket` documents, summed within
    each, and the sums of whole ranges are carried over.
    """
    spark = tokens.sparkSession
    n = spark.createDataFrame([(k, max(1, -(-c // bucket))) for k, c in counts.items()], "source string, n_ranges long")
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    rows = tokens.join(F.broadcast(n), "source").withColumn("h", h)
    rows = rows.withColumn("range", (F.col("h") * F.col("n_ranges") / F.lit(float(2**31))).cast("long")).drop("n_ranges")
    sums = rows.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("range_tokens").over(over), F.lit(0)).alias("before_range"))
    near = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.coalesce(F.sum("n_tokens").over(near), F.lit(0)))
    rows = rows.join(sums, ["source", "range"])
    return rows.select("source", "doc_id", "n_tokens", (F.col("before_range") + F.col("near")).alias("before"))


class Mixture:
    """A drawn mixture: `rows` (the schedule) and `shares` (the report)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str, block_tokens: int = 4096, total_tokens: int | None = None, bucket: int = 8192) -> None:
        """targets (source, target_share, max_repeats) is a small table of settings and read by the driver.

        vocabulary is the path of a public tokenizer's ranks. A document counts whole; the last pass of a source takes
        documents while they fit, so a source stays under its need by less than one document. Repeated doc_ids are
        documents of their own. With no usable document the mixture is empty.
        """
        spark = documents.sparkSession
        wanted = targets.select(tidy_source("source").alias("source"), "target_share", "max_repeats").collect()
        names = sorted({t["source"] for t in wanted if t["source"] is not None})
        tokens = stored(token_counts(documents, names, vocabulary), "tokens")
        totals = {r["source"]: r for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c")).collect()}
        self.plan = plan({k: r["t"] for k, r in totals.items()}, wanted, total_tokens)
        live = {k: p for k, p in self.plan.items() if p["need"] > 0}
        parts = whole_parts({k: p["need"] for k, p in live.items()}) if live else {}
        slots = spark.createDataFrame(pfair(parts), "source string, nth long, period_slot long")
        settings = spark.createDataFrame([(k, p["have"], p["passes"], p["rest"], parts[k]) for k, p in live.items()], "source string, have long, passes long, rest long, parts long")
        rows = _positions(tokens, {k: r["c"] for k, r in totals.items()}, bucket).join(F.broadcast(settings), "source")
        extra = (F.col("before") + F.col("n_tokens") <= F.col("rest")).cast("long")
        rows = rows.withColumn("uses", F.col("passes") + extra).where("uses > 0")
        rows = rows.withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
        rows = rows.withColumn("position", F.col("pass_no") * F.col("have") + F.col("before"))
        rows = rows.withColumn("block_no", F.floor(F.col("position") / block_tokens))
        rows = rows.withColumn("nth", F.col("block_no") % F.col("parts")).join(slots, ["source", "nth"])
        slot = F.floor(F.col("block_no") / F.col("parts")) * F.lit(sum(parts.values())) + F.col("period_slot")
        self.rows = rows.select(slot.alias("slot"), "source", "block_no", "doc_id", "pass_no", "position", "n_tokens")

    @property
    def shares(self) -> DataFrame:
        """Per target source: target and reached share, tokens, documents, and how often the most used one is drawn."""
        spark = self.rows.sparkSession
        per_doc = self.rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("t"))
        used = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
        told = spark.createDataFrame([(k, p["target"], p["weight"], p["cap"], p["have"]) for k, p in self.plan.items()], "source string, target_share double, feasible_share double, max_repeats int, available_tokens long")
        rows = told.join(F.broadcast(used), "source", "left").fillna(0, ["tokens", "documents", "most_uses"])
        whole = rows.agg(F.sum("tokens").alias("all_tokens"))
        return rows.crossJoin(F.broadcast(whole)).select(
            "source", "target_share", "feasible_share", (F.col("tokens") / F.nullif("all_tokens", F.lit(0))).alias("actual_share"),
            "tokens", "available_tokens", "documents", "most_uses", "max_repeats",
        )
