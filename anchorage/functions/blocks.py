"""Containers of a Markdown text (quotes and list items of any depth) taken off, line by line.

One fold over the lines keeps the stack of open containers and the open leaf block.  A line first continues
the containers that it can, then opens new ones, then adds to the leaf; a line that continues a paragraph
may leave out markers of its containers.  What comes out has as many lines as the text:

* ``START`` begins the first line of every paragraph, ``HEADING`` (after it) that of a heading with ``#``;
* the underline of a heading is the single character ``UNDERLINE``;
* lines of code, of raw HTML, rules and blank lines are empty.

Every line begins with a newline, and the text of a line without blanks before it.  The characters used as
marks are spaces where the text holds them.  Finished lines are kept in pieces, so that the fold is linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

START, UNDERLINE, HEADING = "\u0003", "\u0004", "\u0006"
MARKS = START + UNDERLINE + HEADING

# HTML tags that open a raw block, from the public CommonMark specification.
BLOCK_TAGS = """
address article aside base basefont blockquote body caption center col colgroup dd details dialog
dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header
hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param section
source summary table tbody td tfoot th thead title tr track ul
""".split()
BULLET = r"(?:[-*+]|\d{1,9}[.)])"
RULE = r" {0,3}(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)"
ATX = r"#{1,6}(?=[ \t\n]|\z)"

#: Leaf blocks that a line can leave open.
_NONE, _PARAGRAPH, _FENCE, _CODE, _HTML = range(5)
_QUOTE, _ITEM = 0, 1
_STACK = "array<struct<kind:int,width:int>>"
_PIECE = 1 << 10
#: Text that no block begins with.
_PLAIN_TEXT = r"^ {0,3}[^ >#`~<*_=+0-9-]"
_ITEM_START = r"^( {0,3})([-*+]|\d{1,9}[.)])( +|\z)"
_FENCE_START = r"^ {0,3}(?:(`{3,})[^`]*+|(~{3,}).*+)\z"
#: How raw HTML begins, and what ends it on a line; nothing but a blank line ends the last two.
_HTML_KINDS = [
    (r"^ {0,3}<(?i:script|pre|style|textarea)(?=[\s>]|\z)", r"(?i)</(?:script|pre|style|textarea)>"),
    (r"^ {0,3}<!--", r"-->"),
    (r"^ {0,3}<\?", r"\?>"),
    (r"^ {0,3}<![A-Z]", r">"),
    (r"^ {0,3}<!\[CDATA\[", r"\]\]>"),
    (rf"^ {{0,3}}</?(?i:{'|'.join(BLOCK_TAGS)})(?=[\s/>]|\z)", None),
]


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def _after(line: Column, n: Column) -> Column:
    return F.substring(line, n + 1, F.length(line))


def _expanded(line: Column) -> Column:
    """Tabs before the text of a line, and after its first marker, as spaces."""
    wide = F.regexp_replace(line, r"\G(?: {4}| {0,3}\t)", "    ")
    wide = F.regexp_replace(F.regexp_replace(wide, r"^(?:([-*+>])\t)", "$1   "), r"^(\d[.)]|[ ][-*+>])\t", "$1  ")
    return F.when(line.contains("\t"), wide).otherwise(line)


def _continue(seen: Column, container: Column) -> Column:
    """One container more, or not, that a line continues: what is left of the line, and how many so far."""
    rest = seen["rest"]

    def struct(left: Column, n: Column, on: Column) -> Column:
        return F.struct(left.alias("rest"), n.alias("n"), on.alias("on"))

    more = seen["n"] + 1
    quote = F.when(rest.rlike("^ {0,3}>"), struct(F.regexp_replace(rest, "^ {0,3}> ?", ""), more, F.lit(True)))
    item = F.when((rest == "") | (_indent(rest) >= container["width"]), struct(_after(rest, container["width"]), more, F.lit(True)))
    stop = struct(rest, seen["n"], F.lit(False))
    found = F.when(container["kind"] == _QUOTE, quote.otherwise(stop)).otherwise(item.otherwise(stop))
    return F.when(seen["on"], found).otherwise(seen)


def _new_containers(rest: Column, in_paragraph: Column) -> Column:
    """``rest, added``: the containers that a line opens, and what is left of it."""

    def opened(seen: Column, kind: int, width: Column, left: Column) -> Column:
        new = F.array(F.struct(F.lit(kind).alias("kind"), width.alias("width")))
        return F.struct(left.alias("rest"), F.concat(seen["added"], new).alias("added"), F.lit(True).alias("on"))

    def item(seen: Column, sizes: Column) -> Column:
        before = sizes["before"]
        content = F.ltrim(_after(seen["rest"], before + sizes["blanks"]))
        # an item cannot interrupt a paragraph if it is empty or begins with another number than 1
        allowed = ~(in_paragraph & (F.size(seen["added"]) == 0)) | ((content != "") & seen["rest"].rlike(r"^ {0,3}(?:[-*+]|1[.)]) "))
        narrow = (content == "") | (sizes["blanks"] > 4)
        width = before + F.when(narrow, 1).otherwise(sizes["blanks"])
        stop = F.struct(seen["rest"].alias("rest"), seen["added"].alias("added"), F.lit(False).alias("on"))
        return F.when(allowed, opened(seen, _ITEM, width, _after(seen["rest"], width))).otherwise(stop)

    def step(seen: Column, _: Column) -> Column:
        line = seen["rest"]
        stop = F.struct(line.alias("rest"), seen["added"].alias("added"), F.lit(False).alias("on"))
        sizes = F.struct(
            (F.length(F.regexp_extract(line, _ITEM_START, 1)) + F.length(F.regexp_extract(line, _ITEM_START, 2))).alias("before"),
            F.length(F.regexp_extract(line, _ITEM_START, 3)).alias("blanks"),
        )
        return (
            F.when(~seen["on"], seen)
            .when(line.rlike("^ {0,3}>"), opened(seen, _QUOTE, F.lit(0), F.regexp_replace(line, "^ {0,3}> ?", "")))
            .when(line.rlike(rf"^{RULE}\z"), stop)
            .when(line.rlike(_ITEM_START), let(sizes, lambda z: item(seen, z)))
            .otherwise(stop)
        )

    # no more containers than markers before the text
    markers = F.regexp_extract(rest, r"^(?:[ >]|[-*+](?= |\z)|\d{1,9}[.)](?= |\z))*+", 0)
    most = F.length(F.replace(markers, F.lit(" "), F.lit("")))
    start = F.struct(rest.alias("rest"), F.array().cast(_STACK).alias("added"), F.lit(True).alias("on"))
    none = F.struct(rest.alias("rest"), F.array().cast(_STACK).alias("added"))
    return F.when(most == 0, none).otherwise(
        F.aggregate(F.array_repeat(F.lit(0), most), start, step, lambda s: F.struct(s["rest"].alias("rest"), s["added"].alias("added")))
    )


def _decision(stack: Column, leaf: Column, text: Column, fence: Column | None = None, html: Column | None = None) -> Column:
    return F.struct(
        stack.alias("stack"),
        (F.lit(leaf) if isinstance(leaf, int) else leaf).alias("leaf"),
        (F.lit("") if fence is None else fence).alias("fence"),
        (F.lit(0) if html is None else html).alias("html"),
        text.alias("text"),
    )


def _html_kind(rest: Column, whole_tag: str, may_be_tag: Column) -> Column:
    """1 to 6 for the kinds above, 7 for a line that is one tag, 0 for none."""
    kind = F.when(~rest.rlike("^ {0,3}<"), 0)
    for n, (begin, _) in enumerate(_HTML_KINDS, 1):
        kind = kind.when(rest.rlike(begin), n)
    return kind.when(may_be_tag & rest.rlike(rf"^ {{0,3}}{whole_tag} *\z"), 7).otherwise(0)


def _html_ends(rest: Column, kind: Column) -> Column:
    ends = F.when(kind > 5, rest == "")
    for n, (_, end) in enumerate(_HTML_KINDS[:5], 1):
        ends = ends.when(kind == n, rest.rlike(end))
    return ends.otherwise(F.lit(False))


def _new_leaf(state: Column, seen: Column, opened: Column, whole_tag: str) -> Column:
    """What a line is that continues no code and no HTML."""
    rest, added = opened["rest"], opened["added"]
    same = (F.size(added) == 0) & (state["leaf"] == _PARAGRAPH)
    whole = seen["n"] == F.size(state["stack"])
    in_paragraph, lazy = same & whole, same & ~whole
    stack = F.concat(F.slice(state["stack"], F.lit(1), seen["n"]), added)
    body = F.ltrim(rest)
    indented = _indent(rest) >= 4
    begin = F.concat(F.lit(START), body)
    fence = F.concat(F.regexp_extract(rest, _FENCE_START, 1), F.regexp_extract(rest, _FENCE_START, 2))
    nothing = F.lit("")

    def html_or_text(kind: Column) -> Column:
        return (
            F.when((kind > 0) & _html_ends(rest, kind), _decision(stack, _NONE, nothing))
            .when(kind > 0, _decision(stack, _HTML, nothing, html=kind))
            .when(lazy, _decision(state["stack"], _PARAGRAPH, body))
            .when(in_paragraph, _decision(stack, _PARAGRAPH, body))
            .otherwise(_decision(stack, _PARAGRAPH, begin))
        )

    return (
        F.when(body == "", _decision(stack, _NONE, nothing))
        .when(indented & lazy, _decision(state["stack"], _PARAGRAPH, body))
        .when(indented & in_paragraph, _decision(stack, _PARAGRAPH, body))
        .when(indented, _decision(stack, _CODE, nothing))
        .when(body.rlike(rf"^{ATX}"), _decision(stack, _NONE, F.concat(F.lit(START + HEADING), body)))
        .when(in_paragraph & body.rlike(r"^(?:=++|-++) *\z"), _decision(stack, _NONE, F.lit(UNDERLINE)))
        .when(rest.rlike(_FENCE_START), _decision(stack, _FENCE, nothing, fence=fence))
        .when(rest.rlike(rf"^{RULE}\z"), _decision(stack, _NONE, nothing))
        .otherwise(let(_html_kind(rest, whole_tag, ~same), html_or_text))
    )


def _step(whole_tag: str):
    def decide(state: Column, seen: Column) -> Column:
        rest, leaf, fence = seen["rest"], state["leaf"], state["fence"]
        bare = F.trim(rest)
        # at least as many of the same character, and nothing else
        closes = (_indent(rest) < 4) & (bare != "") & bare.startswith(fence) & (F.replace(bare, F.substring(fence, 1, 1), F.lit("")) == "")
        nothing, stack = F.lit(""), state["stack"]
        whole = seen["n"] == F.size(stack)
        in_paragraph = whole & (leaf == _PARAGRAPH)
        code = F.when(closes, _decision(stack, _NONE, nothing)).otherwise(_decision(stack, _FENCE, nothing, fence=fence))
        html = F.when(_html_ends(rest, state["html"]), _decision(stack, _NONE, nothing)).otherwise(
            _decision(stack, _HTML, nothing, html=state["html"])
        )
        # what begins like no block is text, and continues a paragraph even where containers are left out
        ends_here = F.concat(F.slice(stack, F.lit(1), seen["n"]), F.array().cast(_STACK))
        body = F.ltrim(rest)
        text = F.when(leaf == _PARAGRAPH, _decision(stack, _PARAGRAPH, body)).otherwise(_decision(ends_here, _PARAGRAPH, F.concat(F.lit(START), body)))
        return (
            F.when(whole & (leaf == _FENCE), code)
            .when(whole & (leaf == _HTML), html)
            .when(whole & (leaf == _CODE) & ((rest == "") | (_indent(rest) >= 4)), _decision(stack, _CODE, nothing))
            .when(rest == "", _decision(ends_here, _NONE, nothing))
            .when(rest.rlike(_PLAIN_TEXT), text)
            .otherwise(let(_new_containers(rest, in_paragraph), lambda opened: _new_leaf(state, seen, opened, whole_tag)))
        )

    def step(state: Column, line: Column) -> Column:
        start = F.struct(line.alias("rest"), F.lit(0).alias("n"), F.lit(True).alias("on"))
        before = state["open"]
        full = F.octet_length(before["piece"]) > _PIECE
        piece = F.when(full, F.lit("")).otherwise(before["piece"])

        def kept(d: Column) -> Column:
            return F.struct(*[d[c].alias(c) for c in ("stack", "leaf", "fence", "html")], F.concat(piece, F.lit("\n"), d["text"]).alias("piece"))

        seen = F.when(F.size(before["stack"]) == 0, start).otherwise(F.aggregate(before["stack"], start, _continue))
        now = let(let(seen, lambda s: decide(before, s)), kept)
        # finished pieces stay outside of what is evaluated once, which is copied
        done = F.when(full, F.array_append(state["done"], before["piece"])).otherwise(state["done"])
        return F.struct(now.alias("open"), done.alias("done"))

    return step


def without_containers(text: Column, whole_tag: str) -> Column:
    """The lines of ``text`` (with ``\\n`` alone, no blanks at their ends) as said above; ``whole_tag`` matches an HTML tag."""
    lines = F.transform(F.split(F.translate(text, MARKS, " " * len(MARKS)), "\n", -1), _expanded)
    start = F.struct(
        F.array().cast(_STACK).alias("stack"), F.lit(_NONE).alias("leaf"), F.lit("").alias("fence"), F.lit(0).alias("html"), F.lit("").alias("piece")
    )
    start = F.struct(start.alias("open"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(lines, start, _step(whole_tag), lambda s: F.concat(F.array_join(s["done"], ""), s["open"]["piece"]))
