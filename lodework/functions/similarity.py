"""Jaro-Winkler similarity, which Spark has no built-in for."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=200_000)
def jaro_winkler_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used, seen = [False] * m, []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                seen.append(x)
                break
    k = len(seen)
    if not k:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(seen, other, strict=True)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    if jaro <= 0.7:  # a common beginning counts for names that are alike at all
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(maxsize=200_000)
def unaccented(s: str) -> str:
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


@F.pandas_udf(DoubleType())
def jaro_winkler_unaccented(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(unaccented(x), unaccented(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either is null."""
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@lru_cache(maxsize=200_000)
def _hashed(name: str, dim: int) -> dict[int, float]:
    """The signed-hash embedding of a normalised name, of unit length; what retrieval.hash_embed gives for its words."""
    v: dict[int, float] = {}
    for t in re.findall("[a-z0-9]+", name.lower().replace("_", " ")):
        h = hashlib.sha1(t.encode()).digest()  # noqa: S324
        sign = 1.0 if h[8] % 2 == 1 else -1.0
        for at, w in ((0, sign), (4, sign / 2)):
            b = int.from_bytes(h[at : at + 4], "big") % dim
            v[b] = v.get(b, 0.0) + w
    size = sum(w * w for w in v.values()) ** 0.5
    return {b: w / size for b, w in v.items()} if size else {}


def hashed_cosine_of(a: str, b: str, dim: int = 384) -> float:
    x, y = _hashed(a, dim), _hashed(b, dim)
    return round(sum(w * y.get(k, 0.0) for k, w in x.items()), 6)


@F.pandas_udf(DoubleType())
def hashed_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the hashed embeddings of two normalised names; 0 where one has no word, null where either is null."""
    return pd.Series([None if x is None or y is None else hashed_cosine_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@lru_cache(maxsize=200_000)
def _buckets(name: str, dim: int) -> tuple[tuple[int, ...], tuple[float, ...]]:
    v = _hashed(name, dim)
    return tuple(v), tuple(v.values())


class Likeness:
    """Jaro-Winkler similarities and hashed cosines of many pairs of a list of names at once, pairs being arrays of positions a and b.

    Equal to jaro_winkler_of and hashed_cosine_of. Places of a letter in a name are the bits of one word; names of more
    than 64 letters, or with letters that are rare among the given names, are compared one pair at a time.
    """

    ALPHABET, LETTERS, REPEATS, PAIRS = 128, "abcdefghijklmnopqrstuvwxyz_", 6, 16_384

    def __init__(self, names: list[str], dim: int = 384) -> None:
        self.names, self.dim = names, dim
        self.size = np.array([len(n) for n in names], dtype=np.int64)
        code = {c: i for i, (c, _) in enumerate(Counter("".join(names)).most_common(self.ALPHABET))}
        self.pad = len(code)
        self.codes = np.full((len(names), min(int(self.size.max(initial=0)), 64)), self.pad, dtype=np.uint8)
        self.odd = np.zeros(len(names), dtype=bool)
        counts = np.zeros((len(names), len(self.LETTERS) + 1), dtype=np.int64)  # the last: all other letters
        for i, n in enumerate(names):
            own = [code.get(c, -1) for c in n]
            if len(own) > 64 or -1 in own:
                self.odd[i] = True
                for c in n:
                    counts[i, self.LETTERS.find(c)] += 1  # -1 where it is another
            else:
                self.codes[i, : len(own)] = own
        self.places = np.zeros((len(names), self.pad + 1), dtype=np.uint64)
        each = np.arange(len(names))
        for j in range(self.codes.shape[1]):
            self.places[each, self.codes[:, j]] |= np.uint64(1 << j)
        self.places[:, self.pad] = 0
        for c, i in code.items():
            counts[:, self.LETTERS.find(c)] += np.bitwise_count(self.places[:, i])
        bits = np.concatenate([counts > r for r in range(self.REPEATS)], axis=1)  # a letter's first occurrences, one bit each
        self.held = self._words(bits)
        self.more = np.maximum(counts - self.REPEATS, 0).sum(axis=1)
        self.start = self.codes[:, :4] if not self.odd.any() else np.array([[ord(c) for c in n[:4].ljust(4, "\0")] for n in names], dtype=np.uint32)
        found = [_buckets(n, dim) for n in names]
        row = np.repeat(each, [len(k) for k, _ in found])
        at = np.fromiter((b for k, _ in found for b in k), dtype=np.int64, count=len(row))
        self.vectors = np.zeros((len(names), dim), dtype=np.float32)
        self.vectors[row, at] = np.fromiter((w for _, v in found for w in v), dtype=np.float32, count=len(row))
        self.filled = self._words(self.vectors != 0)

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1).view(np.uint64)

    def may_reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What Jaro-Winkler is at most, by lengths, common letters and common beginning."""
        k = np.minimum(self.more[a], self.more[b])
        for w in range(self.held.shape[1]):
            k += np.bitwise_count(self.held[a, w] & self.held[b, w])
        jaro = (k / self.size[a] + k / self.size[b] + 1) / 3
        same, run = np.ones(len(a), dtype=bool), np.zeros(len(a))
        for j in range(self.start.shape[1]):
            same = same & (self.start[a, j] == self.start[b, j])
            run += same
        return jaro + run * 0.1 * (1 - jaro)

    def fewest(self, cosine: float) -> np.ndarray:
        """How many buckets of each name must be filled in another one too for that cosine, by Cauchy and Schwarz; more than all where it can't be."""
        mass = np.cumsum(np.sort(self.vectors.astype(np.float64) ** 2, axis=1)[:, ::-1], axis=1)
        return (mass < cosine * cosine - 1e-4).sum(axis=1) + 1

    def common_buckets(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(self.filled[a, w] & self.filled[b, w]).astype(np.int64) for w in range(self.filled.shape[1]))

    def near_cosine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosines to five digits or so."""
        out = np.empty(len(a))
        for i in range(0, len(a), self.PAIRS):
            x, y = a[i : i + self.PAIRS], b[i : i + self.PAIRS]
            out[i : i + self.PAIRS] = np.einsum("ij,ij->i", self.vectors[x], self.vectors[y])
        return out

    def jaro_winkler(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Jaro-Winkler similarities; 0 instead of some that are below least."""
        out = np.zeros(len(a))
        odd = self.odd[a] | self.odd[b]
        for i in np.flatnonzero(odd):
            out[i] = jaro_winkler_of(self.names[a[i]], self.names[b[i]])
        rest = np.flatnonzero(~odd)
        for i in range(0, len(rest), self.PAIRS):
            at = rest[i : i + self.PAIRS]
            out[at] = self._jaro_winkler(a[at], b[at], least)
        return out

    def _jaro_winkler(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        ones = np.array([(1 << i) - 1 for i in range(65)], dtype=np.uint64)
        none, one = np.uint64(0), np.uint64(1)
        n, m = self.size[a], self.size[b]
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        used, mine = np.zeros(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.uint64)
        flat, wide = self.places.ravel(), self.pad + 1
        row = b * wide
        for i in range(int(n.max())):
            seen = flat[row + self.codes[a, i]] & ones[np.minimum(m, i + reach + 1)] & ~ones[np.clip(i - reach, 0, 64)] & ~used
            bit = seen & (~seen + one)  # the first of them
            used |= bit
            mine |= (bit != none).astype(np.uint64) << np.uint64(i)
        k = np.bitwise_count(used).astype(np.int64)
        out = np.zeros(len(a))
        prefix = np.cumprod((self.codes[a, :4] == self.codes[b, :4]) & (self.codes[a, :4] != self.pad), axis=1).sum(axis=1)
        on = np.flatnonzero(k)
        best = (k[on] / n[on] + k[on] / m[on] + 1) / 3
        on = on[best + prefix[on] * 0.1 * (1 - best) >= least - 1e-6]
        if not len(on):
            return out
        a, k, n, m, row, used, mine, prefix = (x[on] for x in (a, k, n, m, row, used, mine, prefix))
        wrong = np.zeros(len(on), dtype=np.int64)
        for i in range(int(n.max())):
            own = (mine >> np.uint64(i)) & one
            bit = np.where(own == one, used & (~used + one), none)
            wrong += (bit != none) & ((flat[row + self.codes[a, i]] & bit) == none)
            used ^= bit
        jaro = (k / n + k / m + (k - wrong // 2) / k) / 3
        jaro = np.where(jaro <= 0.7, jaro, jaro + prefix * 0.1 * (1 - jaro))
        out[on] = np.where((n == m) & (k == n) & (wrong == 0), 1.0, jaro)
        return out
