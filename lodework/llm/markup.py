"""Markup residue (HTML, Markdown, wiki, LaTeX): tolerant parse into nodes, scoring, decoding, and clean text.

A text becomes a tree of candidate nodes, whole or broken. Gradient-boosted trees score each node from its own tokens
and attributes, its surroundings, its place in the tree (depth, siblings) and the density of its subtree. Decoding then
picks the likeliest consistent set: what stands inside an accepted code fence is code, and a tag, list item or table
row that is accepted brings along the open element of its own family that holds it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.llm.trees import Boosted

FAMILIES = ("html", "markdown", "wiki", "latex")
_FAMILY = {"h": "html", "m": "markdown", "w": "wiki", "l": "latex"}

#: Candidate tokens in order of precedence; the first letter of a name is its family. m: multi-line.
_TOKENS = [
    ("m_fence", r"^[ \t]*(?:```+|~~~+)[^\n`]*$"),
    ("h_comment", r"<!--(?:(?:(?!-->)[\s\S])*-->)?|-->"),
    ("h_raw", r"<(?P<raw>script|style|SCRIPT|STYLE)\b[^>]*>[\s\S]*?</(?P=raw)\s*>"),
    ("m_auto", r"<(?:https?|ftp|mailto):[^<>\s]+>"),
    ("h_doctype", r"<![A-Za-z][^<>\n]*>|<\?[a-z][^<>\n]*\?>"),
    ("h_tag", r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s(?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)?/?>"),
    ("h_cut", r"<[A-Za-z][A-Za-z0-9:-]*(?:\s+[A-Za-z-]+\s*=\s*(?:\"[^\"<>\n]*\"?|'[^'<>\n]*'?|[^\s<>\"']+))+|</?[A-Za-z][A-Za-z0-9]*(?=[\s.,;:!?)]|$)"),
    ("h_tail", r"(?<![\w<&/-])/[A-Za-z][A-Za-z0-9]*>|(?<=[\"'])/?>"),
    ("h_entity", r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});?"),
    ("w_table", r"^[ \t]*\{\|[^\n]*|^[ \t]*\|\}"),
    ("w_row", r"^[ \t]*\|[-+](?!-*[ \t]*\|)[^\n|]*$"),
    ("m_separator", r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$"),
    ("m_row", r"^[ \t]*\|(?=[^\n]*\|[ \t]*$)"),
    ("w_cell", r"^[ \t]*[|!](?![\[|])(?=[ \t]*\S[^\n]*$)"),
    ("w_magic", r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|NOINDEX)__|^#(?:REDIRECT|redirect)\b|~~~~~?(?!~)"),
    ("w_heading", r"^[ \t]*(?P<eq>={2,6})(?=[^=\n][^\n]*?(?P=eq)[ \t]*$)|(?<=[^=\n])={2,6}[ \t]*$|^[ \t]*={2,6}(?=[ \t]*[^=\s][^=\n]*$)"),
    ("m_underline", r"^[ \t]*(?:={3,}|-{3,}|\*{3,}|_{3,})[ \t]*$"),
    ("m_heading", r"^[ \t]{0,3}#{1,6}(?=[ \t]+\S)"),
    ("m_quote", r"^[ \t]{0,3}(?:>[ \t]?)+(?=\S)"),
    ("m_define", r"^[ \t]*\[[^\]\n]{1,60}\]:[ \t]+\S+"),
    ("m_bullet", r"^[ \t]*[-*+][ \t]+(?=\S)"),
    ("w_external", r"(?<!\])\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*\]|\])?"),
    ("w_link", r"\[\[|\]\](?!\()"),
    ("m_image", r"!\["),
    ("m_target", r"\]\((?:[^()\s]*|\([^()\s]*\))*(?:[ \t]+\"[^\"\n]*\")?\)|\]\((?:https?:|\.?/|#|\w+/)[^()\s]*"),
    ("m_ref", r"\](?:[ \t])?\[[^\]\[\n]{0,40}\]"),
    ("w_template", r"\{\{|\}\}"),
    ("w_quotes", r"'{2,5}"),
    ("l_env", r"\\(?:begin|end)[ \t]*\{[A-Za-z]+\*?\}?(?:\[[^\]\n]*\])?"),
    ("l_command", r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"),
    ("l_group", r"\{\\[A-Za-z]+(?=[ \t\n])"),
    ("l_item", r"\\item\b"),
    ("l_display", r"\\\[|\\\]"),
    ("l_inline", r"\\\(|\\\)"),
    ("l_break", r"\\\\(?=[\s\[]|$)"),
    ("l_escape", r"\\[%&$#_{}](?!\w*\\)"),
    ("m_escape", r"\\[*`\[\]>~|!+.-]"),
    ("l_bare", r"\\[A-Za-z]+"),
    ("l_math", r"\$\$?"),
    ("m_strong", r"\*\*\*?|(?<![A-Za-z0-9_])___?(?=[^\s_])|(?<=[^\s_])___?(?![A-Za-z0-9_])"),
    ("m_strike", r"~~(?!~)"),
    ("m_code", r"`+"),
    ("m_em", r"(?<![\w*])\*(?=[^\s*])|(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])|(?<=[^\s_])_(?![\w_])"),
    ("brace", r"[{}]"),
    ("bracket", r"\["),
]
#: No token starts with another character, so most places of a text are passed over by one look.
_STARTS = r"(?=[<&|{}\[\]\\$*_~`'!#>=/+-]|^[ \t])"
_SCAN = re.compile(_STARTS + "(?:" + "|".join(f"(?P<{n}>{p})" for n, p in _TOKENS) + ")", re.MULTILINE)
KINDS = [n for n, _ in _TOKENS if n not in ("brace", "bracket")] + ["m_link"]
_KIND_NO = {k: i for i, k in enumerate(KINDS)}
#: Kinds that come as an opener and a closer of their own spelling.
_PAIRED = {"m_strong", "m_strike", "m_code", "m_em", "w_quotes", "l_math", "m_fence"}

# Names of elements and commands in common use.
HTML_NAMES = set(
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figcaption "
    "figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main mark meta nav nowiki ol "
    "option p pre q ref s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
LATEX_NAMES = set(
    "alpha beta gamma delta epsilon lambda mu sigma omega pi theta phi frac sqrt sum prod int lim infty cdot times leq geq neq approx "
    "textbf textit texttt emph underline section subsection subsubsection paragraph chapter title author cite citep citet ref eqref "
    "label footnote url href caption item begin end it bf em tt sc sl rm large small centering maketitle includegraphics usepackage "
    "documentclass hline noindent newline par ldots dots quad mathbf mathrm mathcal left right".split()
)
_URL = re.compile(r"(?:https?:)?//|www\.")
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s<>]+)")
_DIGIT, _MATH_SIGN = re.compile(r"\d"), re.compile(r"[\\^_{}=+]")
_NAME, _TAG_ENDS, _NOT_NAME = re.compile(r"[a-z]+[1-6]?"), re.compile(r"^</?[A-Za-z0-9:-]+|/?>$"), re.compile(r"[^A-Za-z0-9]")
_DRIVE = re.compile(r"[A-Za-z]:(?:\\[\w.-]+)*$")


@dataclass
class Node:
    kind: str
    start: int  # of the opener
    mid: int  # end of the opener
    close: int  # start of the closer; = end where there is none
    end: int
    paired: bool
    parent: int = -1
    depth: int = 0
    children: list[int] = field(default_factory=list)
    score: float = 0.0
    taken: bool = False

    @property
    def family(self) -> str:
        return _FAMILY[self.kind[0]]


def parse(text: str) -> list[Node]:
    """Candidate nodes of text, by start; parent points to the smallest node around."""
    nodes: list[Node] = []
    open_braces: list[tuple[str, int]] = []  # kind ('l' command or group, '{' plain, 'w' template) and node or -1
    open_of: dict[str, list[int]] = {}
    brackets: list[tuple[int, str]] = []

    def add(kind: str, m: re.Match[str]) -> int:
        nodes.append(Node(kind, m.start(), m.end(), m.end(), m.end(), False))
        return len(nodes) - 1

    def close(i: int, m: re.Match[str], width: int | None = None) -> None:
        n = nodes[i]
        n.close, n.end, n.paired = m.start(), m.start() + (width if width is not None else len(m.group())), True

    for m in _SCAN.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind in ("raw", "eq"):
            kind = "h_raw" if kind == "raw" else "w_heading"
        if kind == "bracket":
            brackets.append((m.start(), "["))
        elif kind == "m_image":
            brackets.append((m.start(), "!"))
            add(kind, m)
        elif kind in ("m_target", "m_ref"):
            if brackets and "\n\n" not in text[brackets[-1][0] : m.start()]:
                at, sort = brackets.pop()
                if sort == "!":
                    i = next(i for i in range(len(nodes) - 1, -1, -1) if nodes[i].start == at)
                else:
                    nodes.append(Node("m_link", at, at + 1, at + 1, at + 1, False))
                    i = len(nodes) - 1
                n = nodes[i]
                n.close, n.end, n.paired = m.start(), m.end(), token.endswith((")", "]"))
            elif kind == "m_target":
                add(kind, m)
        elif kind == "brace":
            if token == "{":
                open_braces.append(("{", -1))
            elif open_braces:
                sort, i = open_braces.pop()
                if sort == "l":
                    close(i, m)
        elif kind == "w_template":
            if token == "{{":
                open_braces.append(("w", add(kind, m)))
            elif open_braces and open_braces[-1][0] == "w":
                close(open_braces.pop()[1], m)
            elif len(open_braces) > 1 and open_braces[-1][0] != "w" and open_braces[-2][0] != "w":
                for width in (1, 2):  # the braces of two commands, one within the other
                    sort, i = open_braces.pop()
                    if sort == "l":
                        close(i, m, width)
            elif any(s == "w" for s, _ in open_braces):
                while open_braces[-1][0] != "w":
                    open_braces.pop()
                close(open_braces.pop()[1], m)
            else:
                add(kind, m)
        elif kind in ("l_command", "l_group"):
            open_braces.append(("l", add(kind, m)))
        elif kind == "w_link":
            stack = open_of.setdefault("w_link", [])
            if token == "[[":
                stack.append(add(kind, m))
            elif stack:
                close(stack.pop(), m)
            else:
                add(kind, m)
        elif kind in ("l_display", "l_inline"):
            stack = open_of.setdefault(kind, [])
            if token in ("\\[", "\\("):
                stack.append(add(kind, m))
            elif stack:
                close(stack.pop(), m)
            else:
                add(kind, m)
        elif kind == "w_table":
            stack = open_of.setdefault(kind, [])
            if "{|" in token:
                stack.append(add(kind, m))
            elif stack:
                close(stack.pop(), m)
            else:
                add(kind, m)
        elif kind == "w_heading":
            stack = open_of.setdefault(kind, [])
            opens = m.start() == 0 or text[m.start() - 1] == "\n"
            if opens:
                stack.append(add(kind, m))
            elif stack and "\n" not in text[nodes[stack[-1]].start : m.start()]:
                close(stack.pop(), m)
            elif len(token.strip()) != 2 or text[m.start() - 1] not in "<>!=":
                add(kind, m)
        elif kind == "l_env":
            stack = open_of.setdefault(kind, [])
            if token.startswith("\\begin"):
                stack.append(add(kind, m))
            elif stack:
                close(stack.pop(), m)
            else:
                add(kind, m)
        elif kind == "h_tag":
            name = re.match(r"</?([A-Za-z0-9:-]+)", token).group(1).lower()
            stack = open_of.setdefault("h_" + name[:1] * (name[:1] == "h" and name[1:].isdigit()) + ("" if name[1:].isdigit() else name), [])
            if token.startswith("</"):
                if stack:
                    close(stack.pop(), m)
                else:
                    add(kind, m)
            elif token.endswith("/>"):
                add(kind, m)
            else:
                stack.append(add(kind, m))
        elif kind in _PAIRED:
            key = kind + ("" if kind in ("m_fence", "w_quotes") else token)
            last = open_of.get(key, [])
            if last and (kind == "m_fence" or _may_close(kind, text, nodes[last[-1]], m)):
                close(last.pop(), m)
            else:
                if kind != "m_fence" and last:
                    last.pop()
                open_of[key] = [add(kind, m)]
        else:
            add(kind, m)
    for i in open_of.get("m_fence", []):
        nodes[i].close = nodes[i].end = len(text)
    nodes.sort(key=lambda n: (n.start, -n.end))
    stack2: list[int] = []
    for i, n in enumerate(nodes):
        while stack2 and nodes[stack2[-1]].end <= n.start:
            stack2.pop()
        for j in reversed(stack2):
            if nodes[j].end >= n.end:
                n.parent, n.depth = j, nodes[j].depth + 1
                nodes[j].children.append(i)
                break
        stack2.append(i)
    return nodes


def _may_close(kind: str, text: str, opener: Node, m: re.Match[str]) -> bool:
    inner = text[opener.mid : m.start()]
    if not inner or "\n\n" in inner:
        return False
    if kind == "l_math":  # a display formula may go over lines, though not over a blank one
        return m.group() == "$$" or "\n" not in inner
    if kind in ("m_code", "w_quotes"):
        return True
    return not inner[0].isspace() and not inner[-1].isspace()


def _class(c: str) -> int:
    if not c or c.isspace():
        return 0
    if c.isalnum():
        return 1
    return 3 if c in "([{\"'“‘<" else 2


_BLOCKS = ("prose", "list", "table", "caption", "heading")
_MARKED = re.compile(r"[ \t]*(?:[-*+|>!#]|\{\||\{\{|\d+[.)])")
N_FEATURES = len(KINDS) + 54


def features(text: str, block_kind: str, nodes: list[Node]) -> np.ndarray:
    """One row per node; see the module's docstring."""
    out = np.zeros((len(nodes), N_FEATURES), dtype=np.float64)
    per_kind, per_family = Counter(n.kind for n in nodes), Counter(n.kind[0] for n in nodes)
    base, roots = len(KINDS), [n for n in nodes if n.parent < 0]
    order: Counter[tuple[int, str]] = Counter()
    for i, n in enumerate(nodes):
        token, inner = text[n.start : n.mid], text[n.mid : n.close]
        before, after = text[n.start - 1 : n.start], text[n.mid : n.mid + 1]
        row = out[i]
        row[_KIND_NO[n.kind]] = 1
        beyond = text[n.mid : n.mid + 8].lstrip()[:1]
        head = n.start == 0 or before == "\n"
        tail = n.end >= len(text) or text[n.end] == "\n"
        name = _NOT_NAME.sub("", token.split()[0] if token.split() else "").lower()
        letters = _NAME.match(name)
        name = letters.group(0) if letters and n.kind[0] != "h" else name
        attributes = _ATTRIBUTE.findall(token) if n.kind[0] == "h" else []
        rest = _TAG_ENDS.sub("", token) if n.kind[0] == "h" else ""
        loose = len(_ATTRIBUTE.sub(" ", rest).split())
        line_a = text.rfind("\n", 0, n.start) + 1
        previous = text[text.rfind("\n", 0, max(0, line_a - 1)) + 1 : max(0, line_a - 1)] if line_a else ""
        line_end = text.find("\n", n.end)
        line = text[line_a : line_end if line_end >= 0 else len(text)]
        entity = html.unescape(token if token.endswith(";") else token + ";") if n.kind == "h_entity" else ""
        siblings = nodes[n.parent].children if n.parent >= 0 else roots
        order[(n.parent, n.kind)] += 1
        marks = sum(nodes[j].mid - nodes[j].start + nodes[j].end - nodes[j].close for j in n.children) + (n.mid - n.start) + (n.end - n.close)
        f = (
            n.paired, head, head and tail, n.start == 0, tail,
            *(_class(before) == k for k in range(4)), *(_class(after) == k for k in range(4)),
            _class(text[n.end : n.end + 1]) == 1,
            inner[:1].isspace(), inner[-1:].isspace(), inner[:1].isdigit(),
            math.log1p(len(inner)), min(20, len(inner.split())),
            len(_DIGIT.findall(inner, 0, 200)) / max(1, min(200, len(inner))), len(_MATH_SIGN.findall(inner, 0, 200)), bool(_URL.search(text[n.start : n.end][:300])), "|" in inner, "\n" in inner,
            name in HTML_NAMES, name in LATEX_NAMES, len(name), token.endswith(";"), len(entity) == 1 and bool(entity), len(token),
            len(attributes), loose, any(a.lower() in ("href", "src", "class", "id", "style", "title", "alt", "name") for a, _ in attributes),
            n.depth, len(n.children), len(siblings), order[(n.parent, n.kind)],
            n.parent >= 0 and nodes[n.parent].kind[0] == n.kind[0], n.parent >= 0 and nodes[n.parent].kind == "m_fence",
            marks / max(1, n.end - n.start), per_kind[n.kind], per_family[n.kind[0]],
            bool(previous.strip()), len(line), bool(_DRIVE.search(text[max(0, n.start - 60) : n.start])),
            token.startswith("</"), beyond.isdigit(), beyond.isupper(), _class(beyond) == 2, len(token.strip()), previous.rstrip().endswith((".", "!", "?", ":")), bool(_MARKED.match(previous)),
        )
        row[base : base + len(f)] = f
        row[base + len(f)] = _BLOCKS.index(block_kind) if block_kind in _BLOCKS else 0
    return out


#: Formulas: their source is kept, and what stands in them is theirs.
_MATH = {"l_math", "l_display", "l_inline"}


def decode(nodes: list[Node]) -> None:
    """Marks the nodes of the likeliest consistent set, by their scores (log-odds).

    Per node the best of taking it or leaving it, children first. Below a taken fence nothing can be taken, below a taken formula nothing of another family. A node
    without a score of its own above zero is taken with its children of the same family if together they gain.
    """
    take, leave = [0.0] * len(nodes), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        fence, formula = n.kind == "m_fence", n.kind in _MATH
        holds = n.kind in ("h_tag", "w_table", "l_env")
        for j in n.children:
            child = max(take[j], leave[j])
            same = nodes[j].kind[0] == n.kind[0]
            if not fence and (same or not formula):
                take[i] += child
            same = same and holds
            leave[i] += leave[j] if same else child
        take[i] += n.score
        if fence and n.score > 0:  # a fence stands by itself, whatever its code looks like
            leave[i] = -math.inf
    state = [False] * len(nodes)
    for i, n in enumerate(nodes):  # parents come first
        barred = False
        up = n.parent
        if up >= 0:
            p = nodes[up]
            holds = p.kind in ("h_tag", "w_table", "l_env") and p.kind[0] == n.kind[0]
            formula = p.kind in _MATH and p.kind[0] != n.kind[0]
            opaque = p.taken and (p.kind == "m_fence" or formula)
            barred = opaque or state[up] or (holds and not p.taken)
            state[i] = state[up] or opaque
        n.taken = not barred and take[i] > leave[i]


def analyse(text: str, block_kind: str, model: Boosted) -> list[Node]:
    nodes = parse(text)
    if nodes:
        for n, s in zip(nodes, model.score(features(text, block_kind, nodes)), strict=True):
            n.score = float(s)
        decode(nodes)
    return nodes


# ---------------------------------------------------------------- clean text

_DROPPED = {"cite", "citep", "citet", "ref", "eqref", "label", "includegraphics", "usepackage", "documentclass", "url"}
_HEADS = {"section": 1, "chapter": 1, "title": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


#: Commands and environments whose source is a formula, wherever they stand.
_FORMULA_COMMANDS = set("frac dfrac tfrac sqrt binom overline underline hat bar vec tilde dot mathbf mathrm mathcal mathbb mathit operatorname".split()) - {"underline"}
_FORMULA_ENVS = re.compile(r"\{(?:equation|align|gather|multline|eqnarray|math|displaymath)\*?\}")
_TABLE_ENVS = re.compile(r"\{(?:tabular|tabularx|array|longtable)\*?\}")
_COMMAND = re.compile(r"~?\\([A-Za-z]+)")


def _is_formula(text: str, n: Node) -> bool:
    if n.kind in _MATH:
        return True
    token = text[n.start : n.mid]
    if n.kind == "l_command":
        return _COMMAND.match(token).group(1) in _FORMULA_COMMANDS
    return n.kind == "l_env" and n.paired and bool(_FORMULA_ENVS.search(token))


def _in_formula(text: str, nodes: list[Node], n: Node) -> bool:
    while n.parent >= 0:
        n = nodes[n.parent]
        if n.taken and _is_formula(text, n):
            return True
    return False


def _group_end(text: str, at: int) -> int:
    """The end of the brace group that opens at `at`; `at` itself where none does, or it never closes."""
    if text[at : at + 1] != "{":
        return at
    depth = 0
    for m in re.finditer(r"\\[{}]|[{}]", text[at:]):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0:
            return at + m.end()
    return at


def _heading(text: str, n: Node, level: int) -> tuple[str, str]:
    """What opens and closes a heading of its own line."""
    before, after = text[: n.start].rstrip(" \t"), text[n.end :].lstrip(" \t")
    return ("" if not before or before.endswith("\n") else "\n") + "#" * level + " ", "" if not after or after.startswith("\n") else "\n"


def clean(text: str, nodes: list[Node]) -> str:
    """text without its taken markup; unchanged where none is taken.

    Headings stand on lines of their own with one '#' per level, list items get a dash, code its fence (one, for code
    within preformatted text), table cells a bar; formulas keep their source, a link keeps its text.
    """
    if not any(n.taken for n in nodes):
        return text
    edits: list[tuple[int, int, str]] = []
    for n in nodes:
        if not n.taken or _in_formula(text, nodes, n):
            continue
        token, inner, name = text[n.start : n.mid], text[n.mid : n.close], ""
        start, mid = n.start, n.mid
        if n.kind == "h_tag":
            name = re.match(r"</?([A-Za-z0-9:-]+)", token).group(1).lower()
        opening, closing = "", ""
        if n.kind in ("m_fence", "m_bullet", "m_heading", "m_row", "m_separator") or _is_formula(text, n):
            continue  # these are the structure that is kept
        if n.kind in ("h_comment", "h_raw", "h_doctype", "w_magic", "m_define", "w_row"):
            opening = ""
        elif n.kind == "h_entity":
            opening = html.unescape(token if token.endswith(";") else token + ";")
        elif re.fullmatch(r"h[1-6]", name):
            opening, closing = ("" if token.startswith("</") else "\n" + "#" * int(name[1]) + " "), "\n"
        elif name == "li":
            opening, closing = ("" if token.startswith("</") else "\n- "), "\n"
        elif name in ("p", "div", "br", "tr", "ul", "ol", "table"):
            opening = closing = "\n"
        elif name in ("pre", "code") and n.paired and "\n" in inner:
            up = n.parent
            while up >= 0 and not (nodes[up].taken and nodes[up].kind == "h_tag" and re.match(r"<(?:pre|code)\b", text[nodes[up].start :], re.I)):
                up = nodes[up].parent
            if up < 0:
                opening, closing = "\n```\n", "\n```\n"
        elif name in ("td", "th"):
            closing = " | "
        elif n.kind == "w_template" and n.paired:
            edits.append((n.start, n.end, ""))
            continue
        elif n.kind == "w_link" and n.paired:
            if re.match(r"(?i)\s*(category|file|image)\s*:", inner):
                edits.append((n.start, n.end, ""))
                continue
            if "|" in inner:
                edits.append((n.mid, n.mid + inner.rindex("|") + 1, ""))
        elif n.kind == "w_external":
            label = re.match(r"\[\S+[ \t]*([^\]]*)\]?", token)
            opening = label.group(1) if label else ""
        elif n.kind == "m_auto":
            opening = token[1:-1]
        elif n.kind == "w_heading" and token.strip():
            if n.start == 0 or text[n.start - 1] == "\n":
                opening = "#" * len(token.strip()) + " "
                mid += len(text[mid:]) - len(text[mid:].lstrip(" \t"))
        elif n.kind == "w_cell":
            opening = "| "
        elif n.kind == "m_escape" or n.kind == "l_escape":
            opening = token[1:]
        elif n.kind == "l_item":
            opening = "- "
        elif n.kind == "l_break":
            opening = "\n"
        elif n.kind == "l_bare":
            opening = token if token[1:] in LATEX_NAMES and token[1:] not in ("maketitle", "centering", "noindent", "hline", "par", "it", "bf", "em") else ""
        elif n.kind == "l_command":
            command = _COMMAND.match(token).group(1)
            if command == "href" and n.paired and _group_end(text, n.end) > n.end:
                stop = _group_end(text, n.end)
                edits += [(n.start, n.end + 1, ""), (stop - 1, stop, "")]
                continue
            if command in _DROPPED and n.paired:
                edits.append((n.start, n.end, ""))
                continue
            if command in _HEADS:
                opening, closing = _heading(text, n, _HEADS[command])
                if closing:
                    edits.append((n.close, n.end + len(text[n.end :]) - len(text[n.end :].lstrip(" \t")), closing))
                    edits.append((start, mid, opening))
                    continue
            elif command == "footnote":
                opening, closing = "(", ")"
        elif n.kind == "l_env" and _TABLE_ENVS.search(token):
            mid = _group_end(text, mid)
            if token.startswith("\\begin") and n.paired:
                edits += [(n.mid + m.start(), n.mid + m.end(), " | ") for m in re.finditer(r"[ \t]*(?<!\\)&[ \t]*", inner) if n.mid + m.start() >= mid]
        elif n.kind == "m_underline" and "=" in token:
            opening = ""
        edits.append((start, mid, opening))
        if n.paired and n.end > n.close:
            edits.append((n.close, n.end, closing))
    out, at = [], 0
    for a, b, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a < at:
            continue  # inside something that was dropped whole
        out += [text[at:a], new]
        at = b
    out.append(text[at:])
    result = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", result).strip("\n")


# ---------------------------------------------------------------- over tables

_SUSPECT = r"[<>&*_`#\[\]{}\\$|~=+]|''|(?m)^\s*-"


def _candidates(blocks: DataFrame) -> DataFrame:
    cells = F.filter(F.flatten(F.array_compact(F.coalesce("table_rows", F.array().cast("array<array<string>>")))), lambda c: c.rlike(_SUSPECT))
    rows = blocks.where(F.coalesce(~F.col("kind").isin("code", "record"), F.lit(True)))
    rows = rows.select("block_no", F.coalesce("kind", F.lit("prose")).alias("kind"), "text", F.coalesce(cells, F.array().cast("array<string>")).alias("cells"))
    return rows.where(F.coalesce(F.col("text").rlike(_SUSPECT), F.lit(False)) | (F.size("cells") > 0))


def _families(frames: Iterator[pd.DataFrame], model: Boosted) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for no, kind, text, cells in zip(f["block_no"], f["kind"], f["text"], f["cells"], strict=True):
            found: dict[str, tuple[int, float]] = {}
            for i, t in enumerate([text or "", *cells]):
                for n in analyse(t, kind if i == 0 else "table", model):
                    if n.taken:
                        count, top = found.get(n.family, (0, -math.inf))
                        found[n.family] = (count + 1, max(top, n.score))
            out += [(no, family, count, top) for family, (count, top) in found.items()]
        yield pd.DataFrame(out, columns=["block_no", "family", "n_nodes", "score"])


def residue(blocks: DataFrame, model: Boosted) -> DataFrame:
    """(block_no, family, n_nodes, score) for each markup family found in the text or a cell of a block.

    Code and record blocks are program code and data and are left out; null texts, null rows and null cells hold
    nothing; a null kind counts as prose. Blocks without any character markup could use never leave the JVM. A block_no
    that occurs twice gives its rows twice. No shuffle.
    """
    rows = _candidates(blocks)
    no = dict(rows.dtypes)["block_no"]
    return rows.mapInPandas(partial(_families, model=model), f"block_no {no}, family string, n_nodes int, score double")


def _cleaned(frames: Iterator[pd.DataFrame], model: Boosted) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts, rows = [], []
        for kind, text, table in zip(f["kind"], f["text"], f["table_rows"], strict=True):
            skip = kind in ("code", "record")
            texts.append(text if skip or text is None else clean(text, analyse(text, kind or "prose", model)))
            done = None
            if table is not None:
                done = [None if r is None else [c if skip or c is None else clean(c, analyse(c, "table", model)) for c in r] for r in table]
            rows.append(done)
        yield pd.DataFrame({"block_no": f["block_no"], "clean_text": texts, "clean_rows": rows})


def cleaned(blocks: DataFrame, model: Boosted) -> DataFrame:
    """(block_no, clean_text, clean_rows) of every block; code and record blocks unchanged, nulls stay null.

    Blocks without any character that markup could use are passed through on the JVM; only the others go to Python.
    """
    rows = blocks.select("block_no", "kind", "text", "table_rows")
    no = dict(rows.dtypes)["block_no"]
    cells = F.exists("table_rows", lambda r: F.exists(r, lambda c: c.rlike(_SUSPECT)))
    suspect = (F.coalesce(F.col("text").rlike(_SUSPECT), F.lit(False)) | F.coalesce(cells, F.lit(False))) & ~F.coalesce(F.col("kind").isin("code", "record"), F.lit(False))
    done = rows.where(suspect).mapInPandas(partial(_cleaned, model=model), f"block_no {no}, clean_text string, clean_rows array<array<string>>")
    return done.unionByName(rows.where(~suspect).select("block_no", F.col("text").alias("clean_text"), F.col("table_rows").alias("clean_rows")))


@lru_cache(maxsize=2)
def trained(size: int = 4000, seed: int = 7) -> Boosted:
    """The model, fitted on `size` generated and labelled texts (the bound of the sample) once per driver."""
    from lodework.llm.markup_samples import labelled

    x, y = labelled(size, seed)
    return Boosted().fit(x, y)
