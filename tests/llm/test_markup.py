from __future__ import annotations

import pytest

from lodework.llm import markup
from lodework.llm.markup_samples import labelled


@pytest.fixture(scope="module")
def model():
    return markup.trained()


def families(text, model, kind="prose"):
    return {n.family for n in markup.analyse(text, kind, model) if n.taken}


def test_held_out_accuracy(model):
    x, y = labelled(600, 1234)
    assert ((model.score(x) > 0) == (y > 0)).mean() > 0.975


@pytest.mark.parametrize(("text", "want"), [
    ("The <b>old</b> mill closed.", {"html"}), ("It cost 4 &euro;&nbsp;a day", {"html"}), ("a broken <span class='x' tag", {"html"}), ("## Heading\nand text", {"markdown"}), ("a **bold** and ~~gone~~ word", {"markdown"}),
    ("see [the site](https://a.example/x) now", {"markdown"}), ("see [[Main Page|here]] and {{cite web|title=x}}", {"wiki"}), ("== History ==\nIt began", {"wiki"}), ("'''bold''' words", {"wiki"}),
    ("as \\textbf{shown} in~\\cite{a2001}", {"latex"}), ("the sum $x_{2}^2 + \\alpha$ grows", {"latex"}), ("<p>both</p> and \\emph{more}", {"html", "latex"}),
    ("12 < 15 and R&D at 3 > 2", set()), ("it costs $838 and later $312", set()), ("rated ** of five, 7 * 5 * 7", set()), ("C# ranked #4 on C:\\temp\\x", set()), ("snake_case_name and A_2", set()), ("note [5] and [sic]", set()), ("", set()),
])
def test_residue_and_look_alikes(text, want, model):
    assert families(text, model) == want


def test_fence_holds_code(model):
    text = "Look:\n```\nif (a < b) { x = \"<b>\" + $y; }\n\\section{x}\n```\nend"
    assert families(text, model) == {"markdown"}
    assert markup.clean(text, markup.analyse(text, "prose", model)) == text


def test_clean(model):
    done = lambda t: markup.clean(t, markup.analyse(t, "prose", model))
    assert done("The <b>old</b> mill &amp; barn") == "The old mill & barn"
    assert done("<h2>Title</h2>\ntext here") == "## Title\n\ntext here"
    assert done("see [[Main Page|here]] now {{cite web|title=x}} ok") == "see here now  ok"
    assert done("\\section{Methods}\nWe \\emph{only} use $x_{2}^2 + \\alpha$ here") == "# Methods\nWe only use $x_{2}^2 + \\alpha$ here"
    assert done("<ul>\n<li>one</li>\n<li>two</li>\n</ul>") == "- one\n\n- two"
    assert done("plain 12 < 15 text") == "plain 12 < 15 text"


def test_decoding_is_consistent():
    outer, inner = markup.Node("m_fence", 0, 3, 50, 53, True, score=5.0), markup.Node("h_tag", 5, 8, 8, 8, False, parent=0, depth=1, score=3.0)
    outer.children = [1]
    markup.decode([outer, inner])
    assert outer.taken and not inner.taken
    ul, li = markup.Node("h_tag", 0, 4, 20, 25, True, score=-1.0), markup.Node("h_tag", 5, 9, 9, 9, False, parent=0, depth=1, score=4.0)
    ul.children = [1]
    markup.decode([ul, li])
    assert ul.taken and li.taken
    ul.score, li.score = -5.0, 4.0
    markup.decode([ul, li])
    assert not ul.taken and not li.taken


def test_table(spark, model):
    schema = "block_no long, kind string, text string, table_rows array<array<string>>, family string, score int"
    rows = [
        (1, "prose", "a <b>b</b>", None, "x", 1), (1, "prose", "a <b>b</b>", None, "x", 1), (2, "code", "<b>", [["<b>"]], None, None), (3, None, None, [None, [None, "''x'' and [[y]]"]], None, None),
        (4, "table", "k: v", [["**x**"]], None, None), (5, "record", "<b>x</b>", None, None, None), (6, "prose", "word " * 60_000 + "<br/>", None, None, None), (None, "list", "- plain item", None, None, None), (7, "prose", "", [], None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["block_no"], r["family"]) for r in markup.residue(df, model).collect())
    assert got == [(1, "html"), (1, "html"), (3, "wiki"), (4, "markdown"), (6, "html")]
    clean = {r["block_no"]: r for r in markup.cleaned(df, model).collect()}
    assert clean[2]["clean_text"] == "<b>" and clean[3]["clean_rows"] == [None, [None, "x and y"]] and clean[3]["clean_text"] is None and clean[1]["clean_text"] == "a b"
    assert markup.residue(df.limit(0), model).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("<pre><code>a = 1\nb = 2</code></pre>", "```\na = 1\nb = 2\n```"),
    ("the ratio \\frac{a}{b} grows", "the ratio \\frac{a}{b} grows"),
    ("see \\href{https://x.example/}{the \\emph{long} report} now", "see the long report now"),
    ("\\begin{tabular}{ll}\na & b \\\\\nc & d\n\\end{tabular}", "a | b\n\nc | d"),
    ("\\section{Results} We \\emph{found} it", "# Results\nWe found it"),
    ("== Plot ==\nA [[city|town]] sleeps", "## Plot\nA town sleeps"),
    ("As $$\n\\frac{a}{b} + \\sqrt{c}\n$$ shows, \\emph{indeed}", "As $$\n\\frac{a}{b} + \\sqrt{c}\n$$ shows, indeed"),
    ("<ul><li>one</li><li><b>two</b></li></ul>", "- one\n\n- two"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", "a | b |"),
    ("an <em>open tag and a &nbsp;space", "an open tag and a \xa0space"),
    ("''slanted'' with {{cite|x={{y}}}} gone", "slanted with  gone"),
    ("trailing blanks   \n\n\n\nstay where there is no markup", "trailing blanks   \n\n\n\nstay where there is no markup"),
    ("", ""),
])
def test_clean_structure(text, want, model):
    assert markup.clean(text, markup.analyse(text, "prose", model)).strip() == want.strip()
    assert markup.clean(text, []) == text
