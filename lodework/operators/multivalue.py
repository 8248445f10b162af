"""Several values packed in one field: one row per value, with its position.

Structured cells (JSON and list literals) and quoted values say what whole values look like; they make a dictionary per
column family. In every other cell a multi-pattern automaton marks the known whole values that lie between delimiters,
and dynamic programming picks the cheapest cover of the cell, so a delimiter inside a known or plausible value holds.
"""

from __future__ import annotations

import ast
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.session import stored

# Fixed values of the data model: list columns with the sort of their values, and the words that stand for no value.
LIST_COLUMNS = {"genres": "word", "keywords": "word", "production_countries": "word", "cast_names": "person", "production_companies": "firm"}
NULL_WORDS = {"", "n/a", "none", "unknown", "-", "--"}
#: Dictionary entries that go into the automaton: those with at least 1 / ENTRIES of all occurrences, so at most ENTRIES.
ENTRIES = 50_000
#: Parts that may be merged without being known as a whole: two names with a joint, a firm with kin and legal form.
_UNKNOWN_PARTS = 3

_LEGAL = r"(?:Ltd|Inc|LLC|L\.L\.C|Co|Corp|GmbH|AG|SA|S\.A|plc|Limited|Incorporated|Corporation)\.?"
_KIN = r"(?:Sons|Daughters|Brothers|Bros\.?|Co\.?|Company|Partners|Associates|Family)"
_FIRM_SHAPES = (
    re.compile(rf"[^,;|/&\n\t\r•·]+, {_LEGAL}", re.I),
    re.compile(rf"[^,;|/&\s]+(?: & | and )[^,;|/&\s]+(?:, {_LEGAL})", re.I),
    re.compile(rf"[^,;|/&\n\t\r•·]+ (?:and|&) {_KIN}(?:, {_LEGAL})?", re.I),
)
_SLASHED = re.compile(r"[^\s,;|/&]+/[^,;|/&\n\t\r•·]+")
_DELIMITER = re.compile(r"(?<!\\)\s*[;|•·\n\t\r,/]\s*(?:(?:and|&)\s+)?|\s+(?:and|&)\s+", re.I)
_STRONG, _JOINT = re.compile(r"[;|•·\n\t\r,]"), re.compile(r"^\s*(?:/|and|&)?\s*$", re.I)
_PERSON = re.compile(r"[^\W\d_][\w.'’-]*(?: [^\W\d_][\w.'’-]*){1,3}")
_GIVEN = re.compile(r"[^\W\d_][\w.'’-]*, [^\W\d_][\w.'’-]*(?: [^\W\d_][\w.'’-]*)?")


def family_of(column: Column, columns: dict[str, str] = LIST_COLUMNS) -> Column:  # noqa: B006
    """The list column a heading stands for, in any case and with blanks or dashes; null for other columns."""
    name = F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_")
    return F.when(name.isin(list(columns)), name)


def structured(text: str) -> list[str] | None:
    """Values of a JSON or list literal, or None where text isn't one. Of an object its name counts."""
    t = text.strip()
    if not (t[:1] in "[{" and t[-1:] in "]}") or not t:
        return None
    value = None
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(t)
            break
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
    if not isinstance(value, list | tuple | dict | set):
        return None
    out: list[str] = []

    def walk(v: object) -> None:
        if isinstance(v, dict):
            named = next((v[k] for k in ("name", "title", "value", "label") if v.get(k) is not None), None)
            out.append(str(named if named is not None else next((x for x in v.values() if isinstance(x, str)), "")))
        elif isinstance(v, list | tuple | set):
            for x in v:
                walk(x)
        elif v is not None:
            out.append(str(v))

    walk(value)
    return out


def pieces(text: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """Parts of text between delimiters as (part, quoted), and the delimiters between them. Quotes protect what they hold."""
    parts, marks, i, n = [], [], 0, len(text)
    start = 0
    while True:
        while start < n and text[start] == " ":
            start += 1
        quoted = None
        if start < n and text[start] in "\"'":
            q, j, buffer = text[start], start + 1, []
            while j < n:
                if text[j] == "\\" and j + 1 < n:
                    buffer.append(text[j + 1])
                    j += 2
                elif text[j] == q:
                    if text[j + 1 : j + 2] == q:
                        buffer.append(q)
                        j += 2
                        continue
                    m = _DELIMITER.match(text, j + 1)
                    if m or not text[j + 1 :].strip():
                        quoted = ("".join(buffer), j + 1)
                        break
                    if q == '"':
                        break
                    buffer.append(q)
                    j += 1
                else:
                    buffer.append(text[j])
                    j += 1
        i = quoted[1] if quoted else start
        m = _DELIMITER.search(text, i)
        if quoted:
            parts.append((quoted[0].strip(), True))
        else:
            parts.append((text[start : m.start() if m else n].strip(), False))
        if not m:
            return parts, marks
        marks.append(m.group())
        start = m.end()


def bare(text: str) -> str:
    t = re.sub(r"\\([,;|/&\"'\\])", r"\1", text.strip())
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        t = t[1:-1]
    return t.strip().strip('"').strip()


class Dictionary:
    """Known whole values per column family, with the last words that firms are known by.

    columns tells the sort of each family. ends gives the last words where they were counted over more entries than these.
    """

    def __init__(self, entries: list[tuple[str, str]], columns: dict[str, str] = LIST_COLUMNS, ends: frozenset[str] | None = None) -> None:  # noqa: B006
        self.columns = columns
        self.known: dict[str, set[str]] = defaultdict(set)
        for family, value in entries:
            self.known[family].add(value)
        self.automata = {}
        for family, values in self.known.items():
            a = ahocorasick.Automaton()
            for v in values:
                a.add_word(v, len(v))
            a.make_automaton()
            self.automata[family] = a
        if ends is None:
            counts: dict[str, int] = defaultdict(int)
            firms = [v for f in self.known if columns.get(f) == "firm" for v in self.known[f]]
            for v in firms:
                counts[v.rsplit(" ", 1)[-1]] += 1
            ends = frozenset(w for w, n in counts.items() if n > max(2, len(firms) // 200))
        self.firm_ends = ends

    def cover(self, family: str, text: str, extra: frozenset[str] = frozenset()) -> list[str]:
        """Values of an unstructured cell, null words and empty entries left out. extra: further known values of this cell."""
        parts, marks = pieces(text)
        if len(parts) == 1:
            return self._values([parts[0][0]])
        flat, at = self._flat(parts, marks)
        low = flat.lower()
        starts, stops = {a: i for i, (a, _) in enumerate(at)}, {b: i for i, (_, b) in enumerate(at)}
        known: set[tuple[int, int]] = set()
        if family in self.automata:
            for end, size in self.automata[family].iter(low):
                i, j = starts.get(end + 1 - size), stops.get(end + 1)
                if i is not None and j is not None:
                    known.add((i, j))
        for value in extra:
            at_char = low.find(value)
            while at_char >= 0:
                i, j = starts.get(at_char), stops.get(at_char + len(value))
                if i is not None and j is not None:
                    known.add((i, j))
                at_char = low.find(value, at_char + 1)
        from_of: dict[int, list[int]] = defaultdict(list)
        for i, j in known:
            if j - i >= _UNKNOWN_PARTS:
                from_of[j].append(i)
        quotes = [0]
        for _, q in parts:
            quotes.append(quotes[-1] + q)
        strong = any(_STRONG.search(m) for m in marks)
        n = len(parts)
        best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in [*sorted(from_of[j - 1]), *range(max(0, j - _UNKNOWN_PARTS), j)]:
                if j - i > 1 and quotes[j] > quotes[i]:
                    continue
                span = flat[at[i][0] : at[j - 1][1]]
                c = best[i] + self._cost(family, span, j - i, parts[i][1], (i, j - 1) in known, strong, marks[i : j - 1])
                if c < best[j] - 1e-9:
                    best[j], back[j] = c, i
        out, j = [], n
        while j:
            i = back[j]
            out.append(parts[i][0] if j - i == 1 else flat[at[i][0] : at[j - 1][1]])
            j = i
        return self._values(out[::-1])

    @staticmethod
    def _flat(parts: list[tuple[str, bool]], marks: list[str]) -> tuple[str, list[tuple[int, int]]]:
        """The cell with its delimiters spelt evenly, and where each part lies in it."""
        out, at, size = [], [], 0
        for i, (p, _) in enumerate(parts):
            if i:
                m = marks[i - 1]
                core = m.strip()
                even = {",": ", ", "/": "/", "&": " & ", ";": "; "}.get(core, f" {core} " if core.lower() == "and" else ", " + core[1:].strip() + " " if core[:1] == "," else m)
                out.append(even)
                size += len(even)
            out.append(p)
            at.append((size, size + len(p)))
            size += len(p)
        return "".join(out), at

    def _cost(self, family: str, span: str, count: int, quoted: bool, known: bool, strong: bool, inner: list[str]) -> float:
        """Lower is likelier. Merging parts is only allowed for known values, known shapes, and names beside a stronger delimiter."""
        if quoted or span.strip().lower() in NULL_WORDS:
            return 0.0
        if known:
            return 0.1
        sort = self.columns.get(family, "word")
        if sort == "firm":
            if any(s.fullmatch(span) for s in _FIRM_SHAPES):
                first = re.split(r" & | and ", span)[0]
                return 0.5 if count == 1 or len(first.split()) < 2 or first.rsplit(" ", 1)[-1].lower() not in self.firm_ends else 2.0
            ends = span.rsplit(" ", 1)[-1].lower() in self.firm_ends
            if count == 1:
                return 0.4 if ends else 1.0
            if _SLASHED.fullmatch(span) and ends and " " in span.split("/")[-1]:
                return 0.6
        elif sort == "person":
            if count == 1:
                return 0.4 if _PERSON.fullmatch(span) else 2.0
            if count == 2 and _GIVEN.fullmatch(span):
                return 0.5
            return float("inf")
        elif count == 1:
            return 1.0
        if strong and count == 2 and all(_JOINT.match(m) for m in inner):
            return 1.2
        return float("inf")

    @staticmethod
    def _values(values: list[str]) -> list[str]:
        tidy = [bare(v) for v in values]
        return [v for v in tidy if v.lower() not in NULL_WORDS]


def split_cell(family: str, text: str, words: Dictionary, extra: frozenset[str] = frozenset()) -> list[str]:
    found = structured(text)
    return Dictionary._values(found) if found is not None else words.cover(family, text.strip(), extra)


# ---------------------------------------------------------------- over tables


def _learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for family, text in zip(f["family"], f["value"], strict=True):
            found = structured(text)
            values = found if found is not None else [p for p, quoted in pieces(text.strip())[0] if quoted]
            out += [(family, v.lower()) for v in Dictionary._values(values)]
        yield pd.DataFrame(out, columns=["family", "value"])


@lru_cache(maxsize=2)
def _dictionary(entries: tuple[tuple[str, str], ...], columns: tuple[tuple[str, str], ...], ends: frozenset[str]) -> Dictionary:
    return Dictionary(list(entries), dict(columns), ends)


def _spans(frames: Iterator[pd.DataFrame], inner: int) -> Iterator[pd.DataFrame]:
    """Every run of at most inner + 1 parts of the unstructured cells: what a known value could be."""
    for f in frames:
        out = []
        for key, family, text in zip(f["cell_key"], f["family"], f["value"], strict=True):
            if structured(text) is None:
                parts, marks = pieces(text.strip())
                flat, at = Dictionary._flat(parts, marks)
                for i in range(len(parts)):
                    for j in range(i, min(len(parts), i + inner + 1)):
                        out.append((key, family, flat[at[i][0] : at[j][1]].lower()))
        yield pd.DataFrame(out, columns=["cell_key", "family", "value"])


def _split(frames: Iterator[pd.DataFrame], entries: tuple[tuple[str, str], ...], columns: tuple[tuple[str, str], ...], ends: frozenset[str]) -> Iterator[pd.DataFrame]:
    words = _dictionary(entries, columns, ends)
    for f in frames:
        rows = []
        for key, column, family, text, extra in zip(f["record_id"], f["column_name"], f["family"], f["value"], f["extra"], strict=True):
            values = split_cell(family, text, words, frozenset(extra) if extra is not None else frozenset())
            rows += [(key, column, i, v, len(values)) for i, v in enumerate(values)]
        yield pd.DataFrame(rows, columns=["record_id", "column_name", "pos", "item", "n_values"])


def list_cells(records: DataFrame, columns: dict[str, str] = LIST_COLUMNS) -> DataFrame:  # noqa: B006
    """(record_id, cell_key, column_name, family, value) of the filled cells of list columns."""
    rows = records.select("record_id", F.posexplode("cells").alias("cell_no", "cell"))
    rows = rows.select("record_id", "cell_no", F.col("cell.column_name").alias("column_name"), F.col("cell.cell_value").alias("value"))
    rows = rows.withColumn("family", family_of(F.col("column_name"), columns)).where(F.col("family").isNotNull() & (F.trim("value") != ""))
    return rows.withColumn("cell_key", F.concat_ws(":", "record_id", "cell_no"))


def split_values(records: DataFrame, entries: int = ENTRIES, columns: dict[str, str] = LIST_COLUMNS) -> DataFrame:  # noqa: B006
    """One row per value of every list cell: record_id, column_name, pos (from 0), item, n_values.

    columns names the list columns and the sort of their values: word, person or firm. Null and blank cells and cells of
    null words alone give no row; a repeated value, a repeated column and a repeated record give rows of their own (cells
    are told apart by record_id and place). The dictionary is counted over all cells. Entries with at least 1 / `entries`
    of all occurrences (so at most `entries`) go to every task in the automaton; all others are matched by a join with the
    runs of parts that occur in cells, so the rows don't depend on `entries`. The last words of firms, each that of more
    than a 200th of the firms, are counted over all entries. Data of no list column, or no row at all, gives an empty table.
    """
    cells = list_cells(records, columns)
    learnt = cells.where(F.col("value").rlike(r"[\[{\"']")).select("family", "value").mapInPandas(_learn, "family string, value string")
    counted = stored(learnt.groupBy("family", "value").count(), "dictionary")
    total = counted.agg(F.sum("count")).first()[0] or 0
    floor = max(1, -(-total // entries))
    often = tuple(sorted((r["family"], r["value"]) for r in counted.where(F.col("count") >= floor).collect()))
    firms = counted.where(F.col("family").isin([k for k, sort in columns.items() if sort == "firm"])).select("family", "value")
    least = max(2, firms.count() // 200)
    last = F.element_at(F.split("value", " "), -1)
    ends = frozenset(r["w"] for r in firms.groupBy(last.alias("w")).count().where(F.col("count") > least).collect())
    if floor > 1:
        rare = counted.where(F.col("count") < floor).select("family", "value")
        inner = rare.agg(F.max(F.regexp_count("value", F.lit(r"(?i)[;|•·\n\t\r,/]|\s(?:and|&)\s")))).first()[0] or 0
        runs = cells.select("cell_key", "family", "value").mapInPandas(partial(_spans, inner=inner), "cell_key string, family string, value string").distinct()
        extra = runs.join(rare, ["family", "value"]).groupBy("cell_key").agg(F.collect_set("value").alias("extra"))
        cells = cells.join(extra, "cell_key", "left")
    else:
        cells = cells.withColumn("extra", F.lit(None).cast("array<string>"))
    kind = dict(cells.dtypes)["record_id"]
    given = cells.select("record_id", "column_name", "family", "value", "extra")
    return given.mapInPandas(partial(_split, entries=often, columns=tuple(columns.items()), ends=ends), f"record_id {kind}, column_name string, pos int, item string, n_values int")
