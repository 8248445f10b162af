"""String, array and vector expressions. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the retrieval model.
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the to was were will with this these those there their they them then than".split()
TERM = r"[a-z0-9]+(?:[-_][a-z0-9]+)*"
PLAIN = r"[a-z0-9]+"
PIECE = r"(?U)\w+|[^\w\s]"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z])"
MULTI_VALUE = r"(?i)\s*[;,/|]\s*|\s+and\s+"
NULLS_CELL = ["", "na", "n/a", "none", "null", "nil", "-", "--", "unknown", "not applicable", "not specified", "nan"]
NULLS_RECORD = [*NULLS_CELL, "varies"]
NULLS_COLUMN = [*NULLS_RECORD, "any", "all", "other", "others"]


def is_null_token(c: Column, words: list[str] = NULLS_CELL) -> Column:
    """Null, blank, or one of the words that stand for no value."""
    return c.isNull() | F.lower(F.trim(c)).isin(words)


def slug(c: Column, limit: int = 60) -> Column:
    s = F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    s = F.substring(F.lower(s), 1, limit)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit("untitled")).otherwise(s)


def normalize_name(c: Column) -> Column:
    """Lower case, punctuation dropped, runs of blanks and dashes to one underscore."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s-]", "")
    return F.trim(F.regexp_replace(s, r"[\s-]+", "_"), F.lit("_"))


def entity_id(label: Column, name: Column) -> Column:
    return F.concat(F.lit("canon_"), F.lower(label), F.lit("_"), normalize_name(name))


def terms(c: Column) -> Column:
    """Terms of the lexical index, in order, with repeats; hyphenated identifiers stay whole."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(STOPWORDS))


def plain_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(PLAIN), F.lit(0))


def token_count(c: Column) -> Column:
    """Estimated tokens: 1.3 per word or sign, at least one where there is any."""
    n = F.regexp_count(c, F.lit(PIECE))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 1.3))).cast("int")


def tail_words(c: Column, budget: int) -> Column:
    """The last words of a text that make up about `budget` tokens."""
    n = max(1, int(budget / 1.3))
    w = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " ")


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_GAP)


def split_values(c: Column, nulls: list[str] = NULLS_RECORD) -> Column:
    """Values of a cell by the plain delimiters; multivalue.split_values is the careful way."""
    cut = F.transform(F.split(c, MULTI_VALUE), lambda v: F.trim(v, F.lit(" .;,")))
    return F.filter(cut, lambda v: ~is_null_token(v, nulls))


def alpha_share(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / n).otherwise(F.lit(0.0))


def cut_at_sentence(c: Column, limit: int) -> Column:
    """Whole sentences from the start that fit in `limit` estimated tokens."""
    def add(acc: Column, s: Column) -> Column:
        used = acc["used"] + token_count(s)
        fits = acc["open"] & (used <= limit)
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"), F.when(fits, used).otherwise(acc["used"]).alias("used"), fits.alias("open"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(True).alias("open"))
    return F.array_join(F.aggregate(sentences(c), start, add, lambda a: a["kept"]), " ")


def cite(uri: Column, page: Column, row: Column, path: Column) -> Column:
    """file · p.N · row N · a > b, without what is missing."""
    name = F.regexp_extract(uri, r"([^/\\]+)$", 1)
    return F.concat_ws(
        " · ", F.nullif(name, F.lit("")), F.concat(F.lit("p."), page), F.concat(F.lit("row "), row),
        F.when(F.size(path) > 0, F.array_join(path, " > ")),
    )


def hash_buckets(token: Column, dim: int = 384) -> Column:
    """Two (bucket, weight) pairs per token: a signed feature hash with a half-weight second bucket."""
    h = F.sha1(token)
    number = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(h, 17, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    return F.array(
        F.struct((number(1) % dim).cast("int").alias("bucket"), sign.alias("weight")),
        F.struct((number(9) % dim).cast("int").alias("bucket"), (sign * 0.5).alias("weight")),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of different sizes and zero vectors."""
    n = norm(a) * norm(b)
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0)
    return F.when(ok, dot(a, b) / n).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def contains_fold(text: Column, phrase: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lower(phrase)), F.lit(False))


def fingerprint(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 12)


def tolerant_json(c: Column, schema: str) -> Column:
    """The object in a text that may have words or a code fence around it; null where there is none or it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)


def cite_passage(doc: Column, path: Column, via: Column) -> Column:
    """doc · a > b · via path, without what is missing."""
    return F.concat_ws(" · ", doc, F.when(F.size(path) > 0, F.array_join(path, " > ")), F.concat(F.lit("via "), via))


def truncate(c: Column, limit: int) -> Column:
    """The first `limit` characters, cut back to the last blank among them where there is one; shorter texts as they are."""
    head = F.substring(c, 1, limit)
    return F.when(F.length(c) <= limit, c).otherwise(F.coalesce(F.nullif(F.rtrim(F.regexp_extract(head, r"(?s)^(.*)\s", 1)), F.lit("")), head))
