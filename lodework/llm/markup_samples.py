"""Generated texts with labelled markup and look-alikes, for fitting and testing the residue model.

Nothing here comes from the data: sentences are drawn from a small word list, constructs from templates per family,
whole or with a part missing, and look-alikes are symbols meant literally. The labels are exact by construction.
"""

from __future__ import annotations

import random

import numpy as np

from lodework.llm.markup import FAMILIES, features, parse

_WORDS = (
    "amber basin candle delta engine forest garden hollow island jacket kettle ladder meadow nickel orchard paper quarry river "
    "signal timber under valley winter yellow almost bright clear distant early famous gentle heavy inner late modern narrow"
).split()
_NAMES = "Alder Benton Corvin Dalby Esker Fenwick Garrow Holt Ivers Jorund Kelso Lindqvist-4 Marlow Norde R2-Unit Stellan".split()


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.pool = [x for _ in range(40) for x in self.look_alikes()]

    def word(self) -> str:
        return self.r.choice(_NAMES) if self.r.random() < 0.25 else self.r.choice(_WORDS)

    def words(self, lo: int = 1, hi: int = 4) -> str:
        if self.r.random() < 0.06:
            return str(self.n())
        out = [self.word() for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.1:
            out[-1] += self.r.choice(".,")
        if self.r.random() < 0.1:
            out.insert(0, str(self.r.randint(2, 2030)))
        return " ".join(out)

    def n(self, lo: int = 1, hi: int = 2000) -> int:
        return self.r.randint(lo, hi)

    # each construct is a list of (text, is markup); "\n" at an end asks for a line of its own
    def html(self) -> list[tuple[str, bool]]:
        r, w = self.r, self.words()
        tag = r.choice(["b", "i", "em", "strong", "p", "div", "span", "u", "small", "code", "blockquote", "sup", "sub", "td", "li", "font", "center"])
        attribute = r.choice(["", "", ' class="x"', " id=s", " class='hl' data-x=\"4\"", ' style="color:red"', " align=left"])
        k = r.randint(0, 13)
        if k == 0:
            return [(f"<{tag}{attribute}>", True), (w, False), (f"</{tag}>", True)]
        if k == 1:
            tag = tag.upper() if r.random() < 0.5 else tag
            return [(r.choice([f"<{tag}{attribute}>", f"</{tag}>", f"</{tag}>"]), True)]
        if k == 2:
            return [(r.choice(["<br>", "<br/>", "<br />", "<hr/>", '<img src="a.png">', '<img alt="dusk" src=x.png>', '<br class="s">', "<input type=text>"]), True)]
        if k == 3:
            return [(f'<a href="https://{self.word().lower()}.example/{self.n()}">', True), (w, False), ("</a>", True)]
        if k == 4:
            return [(r.choice(["&amp;", "&nbsp;", "&mdash;", "&nbsp;&mdash;", "&#8217;", "&#x2019;", "&quot;", "&eacute;", "&hellip;", "&lt;", "&copy;", "&nbsp", "&#160"]), True)]
        if k == 5:
            e = r.choice(["i", "b", "em", "p"])
            return [(f"&lt;{e}&gt;", True), (w, False), (f"&lt;/{e}&gt;", True)]
        if k == 6:
            return [(r.choice([f"<!-- {w} -->", f"<!--{w}-->", f"<!-- {w}"]), True)] if r.random() < 0.8 else [("-->", True)]
        if k == 7:
            return [(r.choice([f"<script>var q={self.n()};</script>", "<style>p { color: red }</style>", '<script src="a.js"></script>']), True)]
        if k == 8:
            h = r.randint(1, 6)
            return [(f"<h{h}{attribute}>", True), (w, False), (f"</h{r.choice([h, h, h, 3])}>", True)]
        if k == 9:
            return [(r.choice([f'<{tag} class="s"', f"<a href='x{self.n()}'", f'<img src="p{self.n()}.png"', f"<{tag} id=k{self.n()}"]), True)]
        if k == 10:
            return [(r.choice(["<br", f"</{tag}", "<ul", "</div"]), True)]
        if k == 11:
            return [("\n<ul>", True), ("\n", False), ("<li>", True), (w, False), ("</li>", True), ("\n", False), ("<li>", True), (self.words(), False), ("</li>", True), ("\n", False), ("</ul>\n", True)]
        if k == 12:
            return [("\n<table>", True), ("<tr>", True), ("<td>", True), (w, False), ("</td>", True), ("</tr>", True), ("</table>\n", True)]
        return [(r.choice(["<!DOCTYPE html>", "<html>", "<body>", "</body>", "</html>", "<tbody>", "<p>", "<p>"]), True)]

    def markdown(self) -> list[tuple[str, bool]]:
        r, w = self.r, self.words()
        k = r.randint(0, 14)
        if k <= 1:
            return [("\n" + "#" * r.randint(1, 6) + " ", True), (w + "\n", False)]
        if k <= 3:
            m = r.choice(["**", "**", "__", "***", "~~", "~~"])
            return [(m, True), ("-" if m == "~~" and r.random() < 0.1 else w, False), (m, True)]
        if k == 4:
            m = r.choice(["*", "_"])
            return [(m, True), (w, False), (m, True)]
        if k == 5:
            return [("`", True), (w, False), ("`", True)]
        if k == 6:
            return [("[", True), (w, False), (r.choice([f"](https://{self.word().lower()}.example/p{self.n()})", "](/docs/a.md)", '](http://a.example "t")']), True)]
        if k == 7:
            return [("![", True), (self.word(), False), (f"](img/{self.word().lower()}.png)", True)]
        if k == 8:
            return [("[", True), (w, False), (f"][{self.n(1, 9)}]", True)] if r.random() < 0.5 else [(f"\n[{self.n(1, 9)}]: https://{self.word().lower()}.example/r{self.n()}\n", True)]
        if k == 9:
            code = r.choice(["for (int i = 0; i < n; i++) {\n  t += a[i] * w[i];\n}", "def f(*args, **kw):\n    return [a for a in args]", "#include <map>\nList<Map<K, V>> m;", "SELECT a, b FROM t WHERE x >= 3 -- gate", 'x = a_b ** 2\nprint(f"{x!r}")', "echo $HOME | sort > out_file"])
            end = [("\n```\n", True)] if r.random() < 0.85 else []
            return [("\n```" + r.choice(["", "python", "c"]), True), ("\n" + code, False), *end]
        if k == 10:
            return [("\n" + r.choice(["> ", "> ", ">", ">> "]), True), (self.words(3, 8), False)]
        if k == 11:
            return [(self.words(2, 5), False), ("\n" + r.choice("=-") * r.randint(5, 14) + "\n", True)]
        if k == 12:
            return [("\n| ", True), (self.word(), False), (" | ", False), (self.word(), False), (" |\n", False), ("| --- | :-: |\n", True), ("| ", True), (self.word(), False), (" | ", False), (str(self.n()), False), (" |\n", False)]
        if k == 13:
            m = r.choice(["**", "**", "~~", "__"])
            return [(m, True), (w, False)] if r.random() < 0.5 else [(w, False), (m, True)]
        return [("\n" + r.choice(["* ", "- ", "+ "]), True), (self.words(3, 7), False), ("\n" + r.choice(["* ", "- "]), True), (self.words(3, 7) + "\n", False)] if r.random() < 0.5 else [(r.choice(["\\*", "\\_", "\\#"]), True)]

    def wiki(self) -> list[tuple[str, bool]]:
        r, w = self.r, self.words()
        k = r.randint(0, 11)
        if k == 0:
            return [("[[", True), (w, False), ("]]", True)]
        if k == 1:
            return [("[[" + self.word() + "|", True), (w, False), ("]]", True)]
        if k == 2:
            return [(f"[[Category:{self.word()}s]]", True)]
        if k == 3:
            return [(f"{{{{cite {r.choice(['web', 'book', 'news'])}|title={self.word()}|year={self.n(1900, 2030)}}}}}", True)]
        if k == 4:
            return [(f"\n{{{{Infobox {self.word()}\n| name = {w}\n| year = {self.n(1900, 2030)}\n}}}}\n", True)]
        if k == 5:
            e = "=" * r.randint(2, 4)
            return [(f"\n{e} ", True), (w, False), (f" {e}\n", True)]
        if k == 6:
            q = r.choice(["'''", "'''", "''", "'''''"])
            return [(q, True), (w, False), (q, True)]
        if k == 7:
            return [(f"[https://{self.word().lower()}.example/{self.n()}{r.choice([' ' + w, ''])}]", True)]
        if k == 8:
            return [(f"{{{{{r.choice(['dead link', 'citation needed', 'main|' + self.word(), 'refn|a'])}}}}}", True)]
        if k == 9:
            return [(f"\n{{| class=\"wikitable\"\n! {self.word()}\n|-\n| {self.n()}\n|}}\n", True)]
        if k == 10:
            return [(r.choice(["[[", "{{", "'''"]), True), (w, False)] if r.random() < 0.5 else [(w, False), (r.choice(["]]", "}}", "'''"]), True)]
        return [(r.choice(["__TOC__", "__NOTOC__", "~~~~", "\n#REDIRECT "]), True)]

    def latex(self) -> list[tuple[str, bool]]:
        r, w = self.r, self.words()
        k = r.randint(0, 12)
        if k <= 1:
            return [("\\" + r.choice(["textbf", "textit", "emph", "texttt", "underline"]) + "{", True), (w, False), ("}", True)]
        if k == 2:
            return [("\\" + r.choice(["section", "subsection", "subsection*", "paragraph", "caption"]) + "{", True), (w, False), ("}", True)]
        if k == 3:
            return [(r.choice(["~\\cite{a2004}", "\\cite{b1999}", "\\label{s2}", "\\ref{f1}", "~\\ref{f1}"]), True)]
        if k == 4:
            return [("\\footnote{", True), (w, False), ("}", True)]
        if k == 5:
            return [(r.choice(["$x_{2}^2 + \\alpha$", "$n$", "$a < b$", "$E = mc^2$", "$\\beta_1$", "$$\\sum_i w_i$$", "$k+1$", "$O(n \\log n)$"]), True)]
        if k == 6:
            return [(r.choice(["\\[ \\sum_{i=1}^{n} w_i \\]", "\\(\\frac{3}{n}\\)", "\\(x+y\\)", "\\[ a = b \\]"]), True)]
        if k == 7:
            return [("{\\" + r.choice(["it", "bf", "em", "tt"]) + " ", True), (w, False), ("}", True)]
        if k == 8:
            return [("\n\\begin{itemize}", True), ("\n", False), ("\\item ", True), (w, False), ("\n", False), ("\\item ", True), (self.words(), False), ("\n", False), ("\\end{itemize}\n", True)]
        if k == 9:
            return [("\n\\begin{equation}\n", True), ("E = mc^2", False), ("\n\\end{equation}\n", True)]
        if k == 10:
            return [(r.choice(["\\textbf{", "\\emph{", "\\section{"]), True), (w, False)]
        if k == 11:
            return [(r.choice(["\\maketitle", "\\noindent", "\\hline", "\\%", "\\&", "\\\\ ", "\\ldots", "\\begin{center}", "\\end{itemize}", "\\alpha"]), True)]
        return [("\\href{https://a.example}{", True), (w, False), ("}", True)]

    def literal(self) -> str:
        return self.r.choice(self.pool)

    def look_alikes(self) -> list[str]:
        return [
            f"{self.n(1, 40)} < {self.n(1, 40)}", f"held for {self.word()} > {self.n(1, 9)} in both", "R&D", "K&L", "AT&T", f"room {self.n(1, 9)} & wait", "<unk>", "the <pad> token", "a <mask> slot",
            f"{self.n(1, 9)} * {self.n(1, 9)} * {self.n(1, 9)}", f"{self.word().lower()}_{self.word().lower()}_v{self.n(1, 9)}", f"A_{self.n(1, 9)} and B_{self.n(1, 9)}", f"x_v{self.n(1, 9)}", "C#", f"#{self.n(1, 9)}",
            f"ranked #{self.n(1, 9)} in", f"${self.n()} and later ${self.n()}", f"for {self.n()}$ or ${self.n()},", f"${self.n()}", f"{self.n(2, 9)}^{self.n(2, 9)} crowns", f"~{self.n()} units", f"+/- 0.2 or ~{self.n(1, 9)}.",
            f"[{self.word()}]", f"note [{self.n(1, 30)}] - and note [{self.n(1, 30)}] - for", "[sic]", "[a] or [b]", f"{{{self.word()}}}", f"{self.n(1, 99)} %", f"= {self.n()} == {self.n()},", f"x => {self.word()} -> y", "a/b/c/d", "yes/no",
            f"C:\\{self.word().lower()}\\{self.word().lower()}", f"D:\\{self.word().lower()}\\tmp", f"Rated ** of five", f"a * of {self.word()}", "** stars", "-- and so", f"{self.word()} | {self.word()}", f"{self.word()}'s", "'quoted'", "rock 'n' roll", "the '90s",
            f"cost ${self.n()}, then ${self.n()}. It", f"i.e. {self.n()}, per", f"f(x) = {self.n()}", "a != b", "x <= 3 and y >= 4", f"<{self.n()} items", f"{self.word()}@mail.example", "https://site.example/a_b_c", "snake_case_name", f"{self.n()}-{self.n()}", "(*) marked", f"* {self.n()} per",
            f"\n> {self.n()} in both runs", f"\n= {self.n()}", f"\n== {self.n()}, said", "\n- and then", f"\n# {self.n()} of", f"\n{self.n()}. ", "\n** of five", "\n* of", f"\n| {self.n()}", "{ a, b }", "}", "{", "$", "`", "~", "^", "\n+ 3", "press [x] and type", f"5' {self.n(1, 11)}''", "\\o/", "50% & more",
        ]

    def sentence(self) -> str:
        s = self.words(5, 12)
        return s[0].upper() + s[1:] + "."

    def made(self, family: str) -> list[tuple[str, int]]:
        """A construct of a family as (text, number of the family whose markup it is, 0 for plain text)."""
        return [(t, FAMILIES.index(family) + 1 if m else 0) for t, m in getattr(self, family)()]

    def sample(self) -> tuple[str, str, np.ndarray]:
        """text, block kind, and per character the number of the family whose markup it is (0: none)."""
        r = self.r
        kind = r.choice(["prose", "prose", "prose", "list", "table", "caption", "heading"])
        pieces: list[tuple[str, int]] = []
        n = 1 if kind in ("table", "caption", "heading") else r.randint(1, 6)
        rich = r.random() < 0.75
        family = r.choice([*FAMILIES, ""])
        for _ in range(n):
            if kind == "list":
                dash = [("- ", 0)]
                if rich and r.random() < 0.06:  # markup around the dash
                    dash = r.choice([[("> ", 2), *dash], [("~~", 2), ("-", 0), ("~~", 2), (" ", 0)], [("<p>", 1), *dash]])
                pieces += [("\n", 0), *dash]
            body = [(self.words(1, 3) if n == 1 else self.sentence(), 0)]
            for _ in range(r.randint(0, 2)):
                body.append((" " + self.literal() + r.choice([" ", " ", ", ", ". "]), 0))
                body.append((self.words(), 0))
            if rich and r.random() < 0.7:
                made = self.made(family or r.choice(FAMILIES))
                if kind in ("table", "caption", "heading") and any("\n" in t for t, _ in made) and r.random() < 0.6:
                    made = self.made(r.choice(["html", "latex"]))
                if r.random() < 0.12:  # one construct within another
                    i = next((i for i, (t, m) in enumerate(made) if not m and "\n" not in t), None)
                    if i is not None:
                        made[i : i + 1] = self.made(r.choice(FAMILIES))
                glue = "" if r.random() < 0.3 else " "
                at = r.randint(0, len(body))
                body[at:at] = [(glue, 0), *made, (glue, 0)]
            if len(body) == 1 and r.random() < 0.5 and kind == "heading" and rich:
                body = self.made(r.choice(FAMILIES))
            pieces += [*body, (" ", 0)]
        if r.random() < 0.25:  # white space gone astray in running text
            pieces = [(t if m else "".join(r.choice("\n\t ") + " " * (r.random() < 0.3) if c == " " and r.random() < 0.25 else c for c in t), m) for t, m in pieces]
        text = "".join(t for t, _ in pieces)
        label = np.concatenate([np.full(len(t), m) for t, m in pieces]) if text else np.zeros(0, dtype=int)
        cut = len(text) - len(text.lstrip("\n"))
        return text[cut:], kind, label[cut:]


def labelled(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all candidate nodes of `size` generated texts. A node is positive within markup of its own family."""
    maker, xs, ys = _Maker(seed), [], []
    for _ in range(size):
        text, kind, label = maker.sample()
        nodes = parse(text)
        if nodes:
            xs.append(features(text, kind, nodes))
            # a line's node may open with blanks or at a dash of the text: its last character decides
            own = [FAMILIES.index(n.family) + 1 for n in nodes]
            ys.append(np.array([label[max(n.start, n.mid - 1)] == k or label[n.start] == k for n, k in zip(nodes, own, strict=True)], dtype=float))
    return np.concatenate(xs), np.concatenate(ys)
