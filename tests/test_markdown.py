"""Links, headings and anchors of Markdown texts."""

import time

import pytest
from pyspark.sql import functions as F

from anchorage.functions import markdown


@pytest.fixture(scope="module")
def links(spark):
    def run(text):
        df = spark.createDataFrame([(text,)], "text string")
        return [(r.line, r.link) for r in markdown.with_links_and_headings(df, "text", links="l").collect()[0].l]

    return run


@pytest.fixture(scope="module")
def heads(spark):
    def run(text):
        df = spark.createDataFrame([(text,)], "text string")
        found = markdown.with_links_and_headings(df, "text", headings="h")
        row = found.select("h", markdown.anchors(F.col("h")).alias("a")).collect()[0]
        return row.h, row.a

    return run


LINK_CASES = [
    ("inline", "a [b](c.md) d", [(1, "c.md")]),
    ("title", "[a](b 'c') [d](e \"f\") [g](h (i))", [(1, "b"), (1, "e"), (1, "h")]),
    ("angle", "[a](<b c>) [d](<>)", [(1, "b c"), (1, "")]),
    ("empty", "[]() [a]()", [(1, ""), (1, "")]),
    ("parens", "[a](b(c)d) [e](f\\)g)", [(1, "b(c)d"), (1, "f)g")]),
    ("not inline: unbalanced", "[a](b", []),
    ("image", "![a](b.png)", []),
    ("linked image", "[![a](b.png)](c.md)", [(1, "c.md")]),
    ("link in image text", "![a [b](c.md)](d.png)", [(1, "c.md")]),
    ("inner link wins", "[a [b](c.md) d](e.md)", [(1, "c.md")]),
    ("nested brackets", "[a [b] c](d.md)", [(1, "d.md")]),
    ("wrapped link counts at its end", "[a\nb](c.md) [d](\n e.md)", [(2, "c.md"), (3, "e.md")]),
    ("not across paragraphs", "[a\n\nb](c.md)", []),
    ("escapes", "\\[a](b.md) [c](d\\_e\\*.md)", [(1, "d_e*.md")]),
    ("entities", "[a](b?c&amp;d&#65;&#x42;)", [(1, "b?c&dAB")]),
    ("named entities", "[a](b&auml;.md&nope;&copy;&NotEqualTilde;)", [(1, "bä.md&nope;©≂̸")]),
    ("code span", "`[a](b.md)` ``[c](d.md) ` ``", []),
    ("unclosed code span", "` [a](b.md)", [(1, "b.md")]),
    ("code in text", "[`]`](a.md)", [(1, "a.md")]),
    ("fence", "```\n[a](b.md)\n```\n[c](d.md)", [(4, "d.md")]),
    ("fence with shorter fence inside", "````\n```\n[a](b.md)\n````\n[c](d.md)", [(5, "d.md")]),
    ("unclosed fence", "~~~\n[a](b.md)\n```\n[c](d.md)", []),
    ("quoted fence ends with the quote", "> ```\n> [a](b.md)\n\n[c](d.md)", [(4, "d.md")]),
    ("fence in list", "1. x\n\n    ```\n    [a](b.md)\n    ```\n\n2. [c](d.md)", [(7, "d.md")]),
    ("indented code", "a\n\n    [b](c.md)\n\nd", []),
    ("indented continuation is no code", "a\n    [b](c.md)", [(2, "c.md")]),
    ("list continuation is no code", "- a\n\n    [b](c.md)", [(3, "c.md")]),
    ("html comment", "a\n\n<!-- [b](c.md)\n\n[d](e.md) -->\n\n[f](g.md)", [(7, "g.md")]),
    ("html block", "<div>\n[a](b.md)\n</div>\n\n[c](d.md)", [(5, "d.md")]),
    ("html tag hides its attributes", 'a <b title="[c](d.md)">[e](f.md)</b>', [(1, "f.md")]),
    ("html link is none", '<a href="b.md">b</a>', []),
    ("autolinks", "<http://a/b?c> <d@e.example> <f g> http://bare", [(1, "http://a/b?c"), (1, "d@e.example")]),
    ("full, collapsed, shortcut", "[a][B] [b][] [b]\n\n[b]: c.md", [(1, "c.md")] * 3),
    ("undefined label", "[a][b] [c]\n\n[d]: e.md", []),
    ("first definition wins", "[a]\n\n[A]: first.md\n[a]: second.md", [(1, "first.md")]),
    ("definition before use", "[a]: <b c> 'd'\n\n[ a ]", [(3, "b c")]),
    ("definition does not interrupt a paragraph", "x\n[a]: b.md\n\n[a]", []),
    ("label spaces and case", "[x][Foo\n  BAR]\n\n[foo bar]: y.md", [(2, "y.md")]),
    ("crlf", "a\r\n[b](c.md)\r\n\r\n[d](e.md)\r\n", [(2, "c.md"), (4, "e.md")]),
    ("quote and table", "> [a](b.md)\n\n| [c](d.md) | e |\n", [(1, "b.md"), (3, "d.md")]),
    ("unicode", "ééé [ü](ö.md)", [(1, "ö.md")]),
    ("definition below a long heading", "# " + "h" * 2000 + "\n[a]: x.md\n\n[a]", [(4, "x.md")]),
    ("definition below an empty heading", "#\n[a]: x.md\n\n[a]", [(4, "x.md")]),
    ("definition below a wide heading with a link", "## [b](c.md) " + " " * 300 + "\n[a]: x.md\n\n[a]", [(1, "c.md"), (4, "x.md")]),
    ("many blanks at a paragraph's end", "a" + " " * 400 + "\n    [b](c.md)", [(2, "c.md")]),
    ("a line of many blanks is blank", "a\n" + " " * 400 + "\n    [b](c.md)\n\n[d](e.md)", [(5, "e.md")]),
    ("brackets in brackets", "[a [b [c] d] e](f.md) " + "[" * 20 + "x" + "]" * 20 + "(g.md)", [(1, "f.md"), (1, "g.md")]),
    ("parentheses in parentheses", "[a](b(c(d(e(f)g)h)i)j)", [(1, "b(c(d(e(f)g)h)i)j")]),
    ("private character", "# \u0002\n[a]: x.md\n\n[a]", [(4, "x.md")]),
    ("code in a list item", "- a\n\n      [b](no.md)\n\n  [c](d.md)", [(5, "d.md")]),
    ("code deep in lists and quotes", "> 1. - a\n>\n>          [b](no.md)\n>\n>      [c](d.md)", [(5, "d.md")]),
    ("fence in a quote in a list", "- > ~~~\n  > [a](no.md)\n\n  [b](c.md)", [(4, "c.md")]),
    ("lazy line", "> [a\nb](c.md)\n>\n> - [d\ne](f.md)", [(2, "c.md"), (5, "f.md")]),
    ("quote ends a paragraph", "[a\n> b](c.md)\n> [d](e.md)", [(3, "e.md")]),
    ("items are paragraphs of their own", "- [a\n- b](c.md)\n  [d](e.md)", [(3, "e.md")]),
    ("tabs", "-\ta\n\n\t\t[b](no.md)\n\n\t[c](d.md)", [(5, "d.md")]),
    ("html in a list item", "- <div>\n  [a](no.md)\n\n  [b](c.md)", [(4, "c.md")]),
    ("definition in a quote", "> [a]: b.md\n> 'c'\n\n[a] > [a]", [(4, "b.md"), (4, "b.md")]),
    ("number that opens no list", "a\n  2. [b](c.md)\n\n        [d](no.md)", [(2, "c.md")]),
    ("empty items", "-\n  [a](b.md)\n-\n\n      [c](no.md)", [(2, "b.md")]),
    ("labels in a row", "[a [z]][x] [x][y][x] [y][]\n\n[x]: 1.md", [(1, "1.md"), (1, "1.md")]),
    ("label of a text with a link", "[a [b](c.md) d][x]\n\n[x]: 1.md", [(1, "c.md"), (1, "1.md")]),
    ("label of an image in a link", "[a ![b [c]][x] d](e.md)\n\n[x]: 1.png", [(1, "e.md")]),
    ("33 levels", "[" * 33 + "x" + "]" * 33 + "(y.md)", [(1, "y.md")]),
    ("10000 levels", "[" * 10_000 + "x" + "]" * 10_000 + "(y.md)", [(1, "y.md")]),
    ("brackets across paragraphs", "[[a\n\nb]](c.md) [[d]](e.md)", [(3, "e.md")]),
    ("nested brackets over lines", "[a [b\nc]\nd](e.md)\n\n[[f]]\n(g.md) <http://h/>", [(3, "e.md"), (6, "http://h/")]),
    ("nothing", "plain", []),
]


@pytest.mark.parametrize("name,text,expected", LINK_CASES, ids=[c[0] for c in LINK_CASES])
def test_links(links, name, text, expected):
    assert links(text) == expected


HEADING_CASES = [
    ("atx", "# A\n##  B ##\n### C #d\n####### no\n#no", ["A", "B", "C #d"]),
    ("setext", "A\n===\nB\nC\n---\n", ["A", "BC"]),
    ("rule is no setext", "- a\n---\n\n---\nB\n---", ["B"]),
    ("front matter", "---\ntitle: x\n---\n# A", ["title: x", "A"]),
    ("code", "# A `b_*`\n```\n# no\n```\n\n    # no\n", ["A `b_*`"]),
    ("markup", "# *A* **b** __c__ d_e_f [g](h) ![i](j) <b>k</b> \\*l\\* &amp; m", ["A b c d_e_f g i k *l* & m"]),
    ("nested markup", "# *a **b *c **d** e* f** g* ![[x](y)](z)", ["a b c d e f g x"]),
    ("above a definition", "# Long heading\n[a]: x.md\n# `B` #\n[b]: y.md", ["Long heading", "`B`"]),
    ("named entities", "# A&nbsp;B &copy; &Zfr;", ["A\u00a0B © ℨ"]),
    ("containers", "> # A\n- # B\n1. # C", ["A", "B", "C"]),
    ("empty", "#\n## \n", ["", ""]),
    ("setext in a quote", "> Title\n> ===", ["Title"]),
    ("setext with a lazy line", "> - A\nB\n>   ---\n> C\n---", ["AB"]),
    ("setext in a list", "1. A\n   ===\n   - B\n     b\n     ---\n", ["A", "Bb"]),
    ("setext after a definition", "> [x]: y.md\n> A [x]\n> ===\n> [z]: y.md\n> ===", ["A x"]),
    ("marked headings in code of a list", "- a\n\n      # no\n\n  # B", ["B"]),
    ("label of no definition", "# [x][y] z\n## See [docs]", ["[x][y] z", "See [docs]"]),
    ("label of a definition", "# [x][Y] z\n## See [docs] [docs][]\n\n[y]: 1\n[docs]: 2", ["x z", "See docs docs"]),
    ("brackets in headings", "# a [b [c](d) e](f) [g\\]] ![h [i]](j) `[k](l)`", ["a [b c e](f) [g]] h [i] `[k](l)`"]),
]


@pytest.mark.parametrize("name,text,expected", HEADING_CASES, ids=[c[0] for c in HEADING_CASES])
def test_headings(heads, name, text, expected):
    assert heads(text)[0] == expected


def test_anchors_number_repeats_by_raw_text(heads):
    _, anchors = heads("# Foo\n# foo\n# Foo\n# Foo!\n# Foo\n")
    assert sorted(anchors) == ["foo", "foo-1", "foo-2"]


def test_slug_lowers_ascii_only(heads):
    assert heads("# Été À La\n# Tab\there, x_y - z\n")[1] == ["Été-À-la", "tabhere-x_y---z"]


def test_long_lines_do_not_overflow_the_stack(links, heads):
    assert links("word " * 40_000 + "[a](b)") == [(1, "b")]
    assert links("[" + "\\[" * 50_000 + "](x)") == [(1, "x")]
    assert links("[" * 50_000) == []
    assert len(links("* [a](b)\n" * 20_000)) == 20_000
    assert len(heads("# H\n" * 20_000)[1]) == 20_000
    assert heads("# " + "*a " * 20_000)[0] != []


def _seconds(links, heads, text, headings=False):
    started = time.perf_counter()
    (heads if headings else links)(text)
    return time.perf_counter() - started


@pytest.mark.parametrize("unit", ["w <!-- ", "[ <!-- ", "<? [x ", "<!X `` ", "` ", "<!-- - ", "[x](y \"z ", "<a b=\"c "])
def test_openers_that_nothing_closes_take_linear_time(links, heads, unit):
    links(unit * 20_000)
    small = min(_seconds(links, heads, unit * 20_000) for _ in range(2))
    assert _seconds(links, heads, unit * 200_000) < 12 * max(small, 0.3)


@pytest.mark.parametrize("unit", ["a * ", "*a ", "[a ", "`b ", "_c "])
def test_headings_of_many_openers_take_linear_time(links, heads, unit):
    heads("# " + unit * 4_000)
    small = min(_seconds(links, heads, "# " + unit * 4_000, True) for _ in range(2))
    assert _seconds(links, heads, "# " + unit * 40_000, True) < 12 * max(small, 0.3)


def test_marks_in_openers_change_no_link(links):
    text = "`a` ``[b](c.md)`` <!-- [d](e.md) --> <? [f](g.md) ?> ``` [h](i.md) ` [j](k.md) <!-- [l](m.md)"
    paragraphs = 30
    expected = links(text)
    assert [x for _, x in expected] == ["i.md", "k.md", "m.md"]
    assert links("\n\n".join([text] * paragraphs)) == [(2 * p + n, x) for p in range(paragraphs) for n, x in expected]


def test_containers_take_linear_time(links, heads):
    item = "- a [b](c.md)\n\n      [code](no.md)\n  > d\n"
    assert len(links(item * 100)) == 100
    small = min(_seconds(links, heads, item * 2_000) for _ in range(2))
    assert _seconds(links, heads, item * 20_000) < 12 * max(small, 0.3)


def test_number_repeats_matches_a_count(spark):
    rows = spark.range(200).select(
        F.transform(F.sequence(F.lit(1), F.col("id") % 17), lambda i: ((i * (F.col("id") + 3)) % 5).cast("string")).alias("t")
    )
    for r in rows.select("t", markdown.number_repeats(F.col("t")).alias("n")).collect():
        expected = {(i, text, r.t[:i].count(text)) for i, text in enumerate(r.t)}
        assert {(n.pos, n.text, n.nth) for n in r.n} == expected
