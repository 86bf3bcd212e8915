"""Markdown as native expressions: links with their lines, headings, anchors.

A document is scanned once by one regular expression that walks over the text from left to
right and yields *tokens*: whole blocks in which nothing is parsed (fenced and indented code, raw
HTML, link definitions), inline spans that hide their content (code, escapes, tags, images), link
candidates, and newlines.  Only the newlines of a hidden token matter, so lines stay exact.

Where containers matter (quotes, code and other blocks in lists), they are taken off first by a fold over the lines
(``blocks``); where brackets are nested, they are tokens of their own and are matched (``brackets``).

Every loop in the patterns is possessive, which the JVM runs without recursion and without
backtracking, so very long lines are safe, and a scan is linear in the text: where there are many openers
that could read on to the end of their paragraph (``<!--``, ``<?``, ``<!X``, runs of backticks), those that
nothing closes are marked first.

Grammar subset: inline, full / collapsed / shortcut reference links and autolinks, brackets nested to any
depth; ATX and setext headings; fenced and indented code, code spans; HTML blocks and inline tags; quotes
and lists of any depth with lazy continuation; backslash escapes, named and numeric entities.  Parentheses
in destinations may nest ``_PARENS_DEPTH`` levels, a limit that the specification allows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, brackets
from .blocks import BLOCK_TAGS
from .named import on_columns
from .text import ascii_lower, count_newlines, let, map_matches, unescape

_SEP = "\u0001"  # ends a link candidate inside a scanned line

# --- pieces ----------------------------------------------------------------------------------
_EOL = r"(?=\n|\z)"
# a newline that does not end the paragraph
_SOFT = rf"\n(?![ \t]*+(?:\n|\z)|[{blocks.START}{blocks.UNDERLINE}]| {{0,3}}(?:>|(?:[-*+]|1[.)])[ \t]|#{{1,6}}[ \t]))"
_REST = r"[^\n]*+"
_BULLET = blocks.BULLET
_AFTER_BLANK = r"(?<![^\n])"  # the line before is blank; prepare() strips blanks at line ends
_CLOSES_NOTHING = "\u0005"  # within an opener that nothing closes
_AFTER_HEADING = "\u0002"  # prepare() puts it at the end of a heading that a link definition may follow
_DOUBLE = rf'"(?:[^"\\\n]++|\\.|\\|{_SOFT})*+"'
_SINGLE = rf"'(?:[^'\\\n]++|\\.|\\|{_SOFT})*+'"
_PAREN = rf"\((?:[^()\\\n]++|\\.|\\|{_SOFT})*+\)"
_TITLE = rf"(?:{_DOUBLE}|{_SINGLE}|{_PAREN})"
# Parentheses in destinations, written out this deep: the specification lets implementations set a limit.
_PARENS_DEPTH = 32
_PARENS = r"\((?:[^\s()\\]++|\\.)*+\)"
for _ in range(_PARENS_DEPTH - 1):
    _PARENS = rf"\((?:[^\s()\\]++|\\.|{_PARENS})*+\)"
_DEST = rf"(?:<(?:[^<>\\\n]++|\\.)*+>|(?!<)(?:[^\s()\\]++|\\[^\s]|\\|{_PARENS})++)"
_GAP = r"[ \t]*+(?:\n[ \t]*+)?+"
_LABEL = rf"(?:[^\[\]\\\n]++|\\.|{_SOFT})++"
_ATTR_TEXT = rf'(?:[^<>"\'\n]++|"(?:[^"\n]++|{_SOFT})*+"|\'(?:[^\'\n]++|{_SOFT})*+\'|{_SOFT})*+'
_TAG = rf"</?[A-Za-z][A-Za-z0-9-]*+(?=[\s/>]){_ATTR_TEXT}>"
_AUTO_URL = r"[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*+"
_AUTO_MAIL = (
    r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?+"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?+)*+"
)
_AUTOLINK = rf"<(?:{_AUTO_URL}|{_AUTO_MAIL})>"
_ESCAPE = r"\\[!-/:-@\[-`{-~]"


def _code_span(group: str) -> str:
    # A run of n backticks up to the next run of exactly n.
    return (
        rf"(?<![`{_CLOSES_NOTHING}])(?<{group}>`++)(?:[^`\n]++|{_SOFT}|(?!\k<{group}>(?!`))`++)*+\k<{group}>(?!`)"
    )


def _html_inline() -> str:
    return rf"(?:{_TAG}|<!--(?:[^-\n]++|{_SOFT}|-(?!->))*+-->|<\?(?:[^?\n]++|{_SOFT}|\?(?!>))*+\?>|<![A-Z](?:[^>\n]++|{_SOFT})*+>)"


def _link_text(group: str) -> str:
    image = (
        rf"!\[(?:[^\[\]\\\n]++|\\.|{_SOFT}|\[[^\[\]\n]*+\])*+\]"
        rf"(?:\((?:[^()\n]++|\([^()\n]*+\))*+\)|\[[^\[\]\n]*+\])?+"
    )
    return (
        rf"(?:[^\[\]\\`<!\n]++|\\.|\\|{_SOFT}|{_code_span(group)}|`++|{_AUTOLINK}|{_html_inline()}|<"
        rf"|{image}|!)*+"
    )


_INLINE_TAIL = rf"\({_GAP}(?:{_DEST}(?:(?=[ \t\n]){_GAP}{_TITLE})?+)?+{_GAP}\)"


def _fence(group: str, prefix: str, body: str, close_prefix: str) -> str:
    opener = rf"(?:(?<{group}b>`{{3,}}+)(?![^\n]*`)|(?<{group}t>~{{3,}}+)){_REST}"
    # A group that took no part never matches, so exactly one of the two closers can apply.
    close = rf"\n{close_prefix}(?:\k<{group}b>`*+|\k<{group}t>~*+)[ \t]*+{_EOL}"
    return rf"\n{prefix}{opener}(?:(?!{close}){body})*+(?:{close})?+"


_FENCES = r"(?=\n[^\n`~]*+(?:`{3}|~{3}))(?:" + "|".join(
    (
        _fence("fa", r" {0,3}", rf"\n{_REST}", r" {0,3}"),
        # in a list item, or indented: ends at the latest with the first line that is not indented
        _fence(
            "fb",
            rf"(?:[ \t]*+{_BULLET}[ \t]++|[ \t]++)",
            rf"\n(?:[ \t]{{2,}}{_REST}|[ \t]*+{_EOL})",
            r"[ \t]*+",
        ),
        _fence("fc", r" {0,3}>[> \t]*+", rf"\n {{0,3}}>{_REST}", r" {0,3}>[> \t]*+"),
    )
) + ")"
_INDENTED = (
    rf"(?=\n(?: {{4}}| {{0,3}}\t)){_AFTER_BLANK}\n(?: {{4}}| {{0,3}}\t)[ \t]*+[^\s]{_REST}"
    rf"(?:(?:\n[ \t]*+{_EOL})*+\n(?: {{4}}| {{0,3}}\t)[ \t]*+[^\s]{_REST})*+"
)
_TO_BLANK = rf"{_REST}(?:\n(?![ \t]*+{_EOL}){_REST})*+"
_HTML_BLOCK_OPEN = (
    rf"(?:<(?i:script|pre|style)(?=[\s>])|<!--|<\?|<![A-Z]|</?(?i:{'|'.join(BLOCK_TAGS)})(?=[\s/>]|\z))"
)
_HTML_BLOCK = r"(?=\n {0,3}<)(?:" + "|".join(
    (
        rf"\n {{0,3}}<(?i:script|pre|style)(?=[\s>])(?s:.*?)(?:</(?i:script|pre|style)>{_REST}|\z)",
        rf"\n {{0,3}}<!--(?s:.*?)(?:-->{_REST}|\z)",
        rf"\n {{0,3}}<\?(?s:.*?)(?:\?>{_REST}|\z)",
        rf"\n {{0,3}}<!\[CDATA\[(?s:.*?)(?:\]\]>{_REST}|\z)",
        rf"\n {{0,3}}<![A-Z](?s:.*?)(?:>{_REST}|\z)",
        rf"\n {{0,3}}</?(?i:{'|'.join(BLOCK_TAGS)})(?=[\s/>]|\z){_TO_BLANK}",
        rf"{_AFTER_BLANK}\n {{0,3}}{_TAG}[ \t]*+(?=\n|\z){_TO_BLANK}",
    )
) + ")"
_DEF_LINE = (
    rf"\n{blocks.START}?+ {{0,3}}\[{_LABEL}\]:{_GAP}{_DEST}(?:(?:[ \t]++|[ \t]*+\n[ \t]*+){_TITLE}(?=[ \t]*+(?:\n|\z)))?+"
    rf"[ \t]*+{_EOL}"
)
_DEFINITIONS = (
    rf"(?=\n {{0,3}}\[)(?:{_AFTER_BLANK}|(?<={_AFTER_HEADING}))(?:{_DEF_LINE})++"
)
_OPAQUE_BLOCKS = f"{_FENCES}|{_INDENTED}|{_HTML_BLOCK}"
# The same where containers are taken off: a paragraph may begin with definitions.
_FLAT_DEFINITIONS = rf"(?=\n{blocks.START}\[)(?:{_DEF_LINE})++"

# Lines that hold nothing of interest, taken many at a time.
_PLAIN_LINES = rf"(?:\n(?! {{4}}| {{0,3}}\t)[^\n\[!<`~\\]*+{_EOL})++"

# Each scan matches everywhere: first the text up to the next character that can start a token, in
# one tight loop, then the token in group 1 (at worst that single character, or nothing at the end).
_STARTS = r"\n\[!<`\\"
def _link_scan(*block_patterns: str) -> str:
    inline = (
        r"\n",
        _ESCAPE,
        _code_span("sc"),
        r"`++",
        rf"\[{_link_text('la')}\](?:{_INLINE_TAIL}|\[{_LABEL}\])",
        rf"\[{_LABEL}\](?:\[\])?+",
        rf"!\[{_link_text('im')}\](?:{_INLINE_TAIL}|\[{_LABEL}\]|\[\])?+",
        _AUTOLINK,
        _html_inline(),
        rf"[{_STARTS}]",
        r"\z",
    )
    return rf"[^{_STARTS}]*+(" + "|".join((*block_patterns, *inline)) + ")"


LINK_SCAN = _link_scan(_PLAIN_LINES, _OPAQUE_BLOCKS, _DEFINITIONS)
FLAT_LINK_SCAN = _link_scan(_FLAT_DEFINITIONS)
# Brackets one by one, for texts where they are nested.
_FLAT_STARTS = r"\n\[\]!<`\\"
FLAT_SCAN = (
    rf"[^{_FLAT_STARTS}]*+("
    + "|".join(
        (
            _FLAT_DEFINITIONS,
            rf"(\n)(?=\n|\z|[{blocks.START}{blocks.UNDERLINE}])",
            r"\n",
            _ESCAPE,
            _code_span("nc"),
            r"`++",
            r"!?\[",
            rf"\](?:{_INLINE_TAIL})?+",
            _AUTOLINK,
            _html_inline(),
            rf"[{_FLAT_STARTS}]",
            r"\z",
        )
    )
    + ")"
)
_TAIL_DEST = rf"^\]\({_GAP}({_DEST})?+"
_INLINE_LINK = rf"^\[{_link_text('t')}\]\({_GAP}({_DEST})?+(?:(?=[ \t\n]){_GAP}{_TITLE})?+{_GAP}\)$"
_DEF_PARTS = rf"\n{blocks.START}?+ {{0,3}}\[({_LABEL})\]:{_GAP}({_DEST})"

# --- preparation -----------------------------------------------------------------------------
#: So many openers are read to the end of their paragraph each before it is looked up which of them are closed.
_MANY_OPENERS = 64
_CONTAINERS = rf"\n {{0,3}}(?:>|{_BULLET}(?:[ \t]|(?=\n|\z)))"
# Lines of a list that can be more than text: code, quotes, underlines, marks after a marker.
_DEEP = (
    rf"\n {{6}}|\n *+\t|\n {{0,5}}>|\n {{1,5}}(?:=++|-++)(?=\n|\z)|\n {{1,5}}(?:`{{3}}|~{{3}}|<|\[[^\n]*\]:)"
    rf"|\n {{0,3}}{_BULLET}[ \t]++(?:`{{3}}|~{{3}}|<|\[[^\n]*\]:|{_BULLET}[ \t])"
)
_LIST_REGION = (
    rf"\n {{0,3}}{_BULLET}(?:[ \t]{_REST}|{_EOL})"
    rf"(?:(?:\n[ \t]*+(?=\n))++(?=\n(?:[ \t]++\S|{_BULLET}[ \t]))"
    rf"|\n[ \t]++[^\s]{_REST}|\n(?![#`~])[^\s]{_REST})*+"
)
_LIST_OR_FENCE = rf"[^\n]*+(?:{_FENCES}|{_LIST_REGION}|\n|\z)"
# A bracket inside brackets, other than an image, as far as one pattern can tell.
_NESTED = r"(?:^|[^!\\])\[(?:[^\[\]!\\]++|\\.|!(?!\[)|!\[[^\[\]]*+\])*+!?\["


def _occurrences(text: Column, of: str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(of), F.lit("")))) / len(of)


def _last_closed(text: Column, closer: str, opener: str) -> Column:
    """``opener`` (a pattern of two groups) is broken up by a mark where no ``closer`` follows."""
    head = F.regexp_extract(text, rf"(?s)\A(.*{closer})", 1)
    return let(head, lambda h: F.concat(h, F.regexp_replace(F.substring(text, F.length(h) + 1, F.length(text)), opener, f"$1{_CLOSES_NOTHING}$2")))


def _backticks_closed(text: Column) -> Column:
    """The last run of backticks of each length gets a mark: it can close a code span, and open none."""
    runs = F.regexp_extract_all(text, F.lit("`++"), F.lit(0))

    def marked(found: Column) -> Column:
        by_length = F.sort_array(F.transform(found, lambda r, i: F.struct(F.length(r).alias("n"), i.alias("at"))))

        def last(ordered: Column) -> Column:
            rows = F.transform(
                ordered, lambda r, k: F.struct(r["at"].alias("at"), F.coalesce(F.get(ordered, k + 1)["n"] != r["n"], F.lit(True)).alias("last"))
            )
            return F.sort_array(rows)

        shown = let(by_length, lambda o: F.transform(
            let(o, last), lambda r: F.concat(F.when(r["last"], _CLOSES_NOTHING).otherwise(""), F.get(found, r["at"]))))
        gaps = F.split(F.regexp_replace(text, "`++", "`"), "`", -1)
        return F.array_join(F.zip_with(gaps, shown, lambda gap, run: F.concat(gap, F.coalesce(run, F.lit("")))), "")

    return let(runs, marked)


def _closed(text: Column) -> Column:
    """Marks in openers of code spans and raw HTML that nothing closes in their paragraph, so that none is read twice.

    Each paragraph is looked at once for the last closer of each kind; the result of a scan stays the same.
    """
    paragraphs = F.split(F.replace(text, F.lit(_CLOSES_NOTHING), F.lit(" ")), rf"(?<=\n)(?=\n)|(?=\n[{blocks.START}])", -1)

    def close(p: Column) -> Column:
        p = let(p, lambda t: _last_closed(t, "-->", "(<)(!--)"))
        p = let(p, lambda t: _last_closed(t, r"\?>", r"(<)(\?)"))
        p = let(p, lambda t: _last_closed(t, ">", "(<)(![A-Z])"))
        return let(p, _backticks_closed)

    many = (_occurrences(text, "<!") + _occurrences(text, "<?") + _occurrences(text, "`")) > _MANY_OPENERS
    return F.when(many, F.array_join(F.transform(paragraphs, close), "")).otherwise(text)


def _lines(text: Column) -> Column:
    """Every line begins with a newline and ends without blanks; headings that a definition may follow are marked."""
    lines = F.concat(F.lit("\n"), F.replace(text, F.lit("\r\n"), F.lit("\n")))

    def tidied(t: Column) -> Column:
        blanks = t.contains(" \n") | t.contains("\t\n") | t.endswith(" ") | t.endswith("\t")
        return F.when(blanks, F.regexp_replace(t, rf"[ \t]++{_EOL}", "")).otherwise(t)

    def marked(t: Column) -> Column:
        clean = F.when(t.contains(_AFTER_HEADING), F.replace(t, F.lit(_AFTER_HEADING), F.lit(" "))).otherwise(t)
        heading = r"(\n {0,3}#{1,6}(?:[ \t][^\n]*+)?+)(?=\n {0,3}\[)"
        return F.when(t.contains("#") & t.contains("]:"), F.regexp_replace(clean, heading, f"$1{_AFTER_HEADING}")).otherwise(clean)

    return let(let(lines, tidied), marked)


def _unindent_lists(lines: Column) -> Column:
    # the parts cover the text, so joining them again gives all of it
    parts = F.transform(
        F.regexp_extract_all(lines, F.lit(_LIST_OR_FENCE), F.lit(0)),
        lambda part: F.when(
            part.rlike(rf"^[^\n]*+\n {{0,3}}{_BULLET}[ \t]*+(?!`{{3}}|~{{3}})"),
            F.regexp_replace(part, r"\n[ \t]+(?=[^\s])", "\n "),
        ).otherwise(part),
    )
    dedent = F.array_join(parts, "")
    indented = lines.contains("\n    ") | lines.contains("\t")
    needs = indented & lines.rlike(rf"\n {{0,3}}{_BULLET}[ \t]")
    return F.when(needs, dedent).otherwise(lines)


def _is_deep(t: Column) -> Column:
    """Whether containers matter: other lists look the same to the scans once their lines are not indented."""
    return t.rlike(_CONTAINERS) & t.rlike(_DEEP)


def _is_nested(t: Column) -> Column:
    return t.contains("[") & t.rlike(_NESTED)


def _taken_off(lines: Column, flat: Column) -> Column:
    plain = F.replace(F.substring(lines, F.lit(2), F.length(lines)), F.lit(_AFTER_HEADING), F.lit(""))
    return F.when(flat, blocks.without_containers(plain, _TAG)).otherwise(_unindent_lists(lines))


# --- links -----------------------------------------------------------------------------------
def normalize_label(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def _clean_dest(dest: Column) -> Column:
    return unescape(
        let(
            dest,
            lambda d: F.when(d.startswith("<"), F.substring(d, F.lit(2), F.length(d) - 2)).otherwise(d),
        )
    )


def _is_autolink(token: Column) -> Column:
    return token.startswith("<") & token.rlike(rf"^{_AUTOLINK}$")


def _is_link(token: Column) -> Column:
    return token.startswith("[") | _is_autolink(token)


def _scanned_line(token: Column) -> Column:
    newlines = F.when(
        token.contains("\n"), F.repeat(F.lit("\n"), count_newlines(token))
    ).otherwise(F.lit(""))
    return (
        F.when(token == "\n", token)
        .when(_is_link(token), F.concat(newlines, F.translate(token, "\n\u0001", "  "), F.lit(_SEP)))
        .otherwise(newlines)
    )


_DEFINITION_TYPE = "array<struct<label:string,dest:string>>"


def _definitions(tokens: Column) -> Column:
    """All link definitions of a document as ``array<struct<label, dest>>``, in order."""
    blocks = F.filter(tokens, lambda t: t.contains("]:") & t.rlike(f"^{_DEF_PARTS}"))
    lines = F.flatten(
        F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(_DEF_LINE), F.lit(0)))
    )
    return F.transform(
        lines,
        lambda line: F.struct(
            normalize_label(F.regexp_extract(line, _DEF_PARTS, 1)).alias("label"),
            _clean_dest(F.regexp_extract(line, _DEF_PARTS, 2)).alias("dest"),
        ),
    )


def _label_of(token: Column) -> Column:
    return normalize_label(
        F.regexp_extract(F.regexp_replace(token, r"\[\]$", ""), rf"\[({_LABEL})\]$", 1)
    )


def _resolve(token: Column, labels: Column, dests: Column) -> Column:
    """The url of one link candidate; NULL when its label is not defined."""
    inline = _clean_dest(F.regexp_extract(token, _INLINE_LINK, 2))
    auto = F.substring(token, F.lit(2), F.length(token) - 2)
    # array_position finds the first definition, which is the one that counts; 0 means none
    defined = let(
        F.array_position(labels, _label_of(token)).cast("int"),
        lambda at: F.when(at > 0, F.get(dests, at - 1)),
    )
    return (
        F.when(token.startswith("<"), auto)
        .when(token.endswith(")"), inline)
        .when(F.size(labels) > 0, defined)
    )


def _links_of(tokens: Column) -> Column:
    scanned = F.split(F.array_join(F.transform(tokens, _scanned_line), ""), "\n", -1)
    numbered = F.filter(
        F.transform(scanned, lambda line, i: F.struct(i.alias("line"), line.alias("tokens"))),
        lambda row: row["tokens"] != "",
    )
    candidates = F.flatten(
        F.transform(
            numbered,
            lambda row: F.transform(
                F.filter(F.split(row["tokens"], _SEP, -1), lambda t: t != ""),
                lambda t: F.struct(row["line"].alias("line"), t.alias("token")),
            ),
        )
    )

    def resolved(defs: Column) -> Column:
        return let(
            F.struct(defs["label"].alias("labels"), defs["dest"].alias("dests")),
            lambda d: F.filter(
                F.transform(
                    candidates,
                    lambda c: F.struct(
                        c["line"].alias("line"),
                        _resolve(c["token"], d["labels"], d["dests"]).alias("link"),
                    ),
                ),
                lambda c: c["link"].isNotNull(),
            ),
        )

    return let(_definitions(tokens), resolved)


LINK_TYPE = "array<struct<line:int,link:string>>"


def _tail_dest(closing: Column) -> Column:
    return _clean_dest(F.regexp_extract(closing, _TAIL_DEST, 1))


def _link_tokens(text: Column, flat: Column) -> Column:
    return F.when(flat, F.regexp_extract_all(text, F.lit(FLAT_LINK_SCAN), F.lit(1))).otherwise(
        F.regexp_extract_all(text, F.lit(LINK_SCAN), F.lit(1))
    )


def _nested_links(text: Column) -> Column:
    def row(places: Column, at: Column, end: Column, link: Column) -> Column:
        return F.struct(at.alias("at"), brackets.line_of(places, end).alias("line"), link.alias("link"))

    def listed(tokens: Column, _: Column, places: Column, resolved: Column) -> Column:
        found = F.transform(F.filter(resolved, lambda x: ~x["image"]), lambda x: row(places, x["open"], x["end"], x["dest"]))
        auto = F.transform(tokens, lambda t, i: F.when(_is_autolink(t), row(places, i, i, F.substring(t, F.lit(2), F.length(t) - 2))))
        ordered = F.sort_array(F.concat(found, F.filter(auto, lambda x: x.isNotNull())))
        return F.transform(ordered, lambda x: F.struct(x["line"].alias("line"), x["link"].alias("link")))

    return brackets.matched_brackets(text, FLAT_SCAN, _definitions, normalize_label, _tail_dest, listed)


def _all_links(text: Column, flat: Column, nested: Column) -> Column:
    scanned = let(_link_tokens(text, flat), _links_of)
    found = F.when(nested, _nested_links(text)).otherwise(scanned)
    return F.when(text.isNull() | ~(text.contains("[") | text.contains("<")), F.array().cast(LINK_TYPE)).otherwise(found)


# --- headings --------------------------------------------------------------------------------
_CONTAINER = rf"(?:[ \t]{{0,3}}(?:>|{_BULLET}(?=[ \t]))[ \t]{{0,4}})*+"
_ATX = rf"\n{_CONTAINER} {{0,3}}#{{1,6}}(?=[ \t\n]|\z){_REST}"
_UNDERLINE = r" {0,3}(?:=++|-++)[ \t]*+"
_RULE = rf" {{0,3}}(?:(?:\*[ \t]*+){{3,}}+|(?:-[ \t]*+){{3,}}+|(?:_[ \t]*+){{3,}}+){_EOL}"
_STOP = (
    rf"(?:[ \t]*+{_EOL}|{_UNDERLINE}{_EOL}| {{0,3}}(?:#{{1,6}}(?=[ \t\n]|\z)|`{{3}}|~{{3}}|>|[-*+][ \t]|1[.)][ \t]"
    rf"|{_HTML_BLOCK_OPEN})|{_RULE})"
)
_CONTINUED = rf"(?:\n(?!{_STOP})[^\n]++)*+"
_CONTAINER_LINES = rf"\n {{0,3}}(?:>|{_BULLET}(?=[ \t\n]|\z)){_REST}{_CONTINUED}"
_PARAGRAPH = rf"\n {{0,3}}[^\s]{_REST}{_CONTINUED}(?:\n{_UNDERLINE}{_EOL})?+"
HEADING_SCAN = (
    r"[^\n]*+("
    + "|".join(
        (_OPAQUE_BLOCKS, _DEFINITIONS, _ATX, rf"\n{_RULE}", _CONTAINER_LINES, _PARAGRAPH, r"\n", r"\z")
    )
    + ")"
)

# ASCII punctuation and the private-use characters that stand in for it while markup is stripped.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STAND_IN = "".join(chr(0xF100 + i) for i in range(len(_PUNCTUATION)))


def _is_heading(token: Column) -> Column:
    atx = token.contains("#") & token.rlike(rf"^{_ATX}\z")
    setext = token.rlike(rf"\n{_UNDERLINE}\z") & token.rlike(
        rf"^\n {{0,3}}(?!>|{_BULLET}[ \t])[^\n]+\n"
    )
    return atx | setext


def _heading_source(token: Column) -> Column:
    token = F.replace(token, F.lit(_AFTER_HEADING), F.lit(""))
    atx = F.regexp_replace(
        F.regexp_replace(token, rf"^\n{_CONTAINER} {{0,3}}#{{1,6}}[ \t]*+", ""),
        r"(?:^|[ \t]++)#*[ \t]*\z",
        "",
    )
    setext = F.regexp_replace(token, rf"\n{_UNDERLINE}\z", "")
    source = F.when(token.rlike(rf"^{_ATX}\z"), atx).otherwise(setext)
    return F.regexp_replace(F.regexp_replace(source, r"^\s+|\s+\z", ""), r"[ \t]*\\?\n[ \t]*", "\n")


# Headings where containers are taken off: a line with #, or a paragraph with its underline.
_PART = rf"[^\n{blocks.MARKS}]++"
_FLAT_HEADING = rf"\n{blocks.START}(?:{blocks.HEADING}{_PART}|{_PART}(?:\n{_PART})*+\n{blocks.UNDERLINE})"


def _flat_headings(text: Column) -> Column:
    """The sources of the headings; what definitions leave of a paragraph may be one, or nothing."""
    def source(token: Column) -> Column:
        kept = F.regexp_replace(token, rf"\A{_FLAT_DEFINITIONS}", "\n")
        kept = F.regexp_replace(kept, rf"(?<=\A\n)\n", "")
        kept = F.regexp_replace(kept, rf"\n{blocks.UNDERLINE}\z", "")
        return _heading_source(F.translate(kept, blocks.MARKS, ""))

    found = F.transform(F.regexp_extract_all(text, F.lit(_FLAT_HEADING), F.lit(0)), lambda t: F.struct(t.startswith(f"\n{blocks.START}{blocks.HEADING}").alias("marked"), source(t).alias("source")))
    return F.transform(F.filter(found, lambda h: h["marked"] | (h["source"] != "")), lambda h: h["source"])


def _protect(match: Column) -> Column:
    code = F.regexp_extract(match, r"(?s)^(`++)(.*?)`+$", 2)
    code = F.replace(code, F.lit("\n"), F.lit(" "))
    code = F.when(code.rlike(r"^ .*\S.* $|^ .*\S $|^ \S.* $"), F.substring(code, F.lit(2), F.length(code) - 2)).otherwise(code)
    literal = F.when(match.startswith("\\"), F.substring(match, 2, 1)).otherwise(
        F.concat(F.lit("`"), code, F.lit("`"))
    )
    return F.translate(literal, _PUNCTUATION, _STAND_IN)


def _without_emphasis(text: Column) -> Column:
    text = F.regexp_replace(text, r"(\*{1,3})(?=[^\s*])([^*]++)(?<=\S)\1", "$2")
    return F.regexp_replace(
        text, r"(?U)(?<!\w)(_{1,3})(?=[^\s_])((?:[^_]++|(?<=\w)_++(?=\w))*+)(?<=[^\s_])\1(?!\w)", "$2"
    )


def _all_emphasis(text: Column) -> Column:
    """Emphasis taken off from the inside out, as often as it can be nested: no deeper than runs that can open or can close."""
    opening = F.size(F.regexp_extract_all(text, F.lit(r"[*_]++(?=[^\s*_])"), F.lit(0)))
    closing = F.size(F.regexp_extract_all(text, F.lit(r"(?<=[^\s*_])[*_]++"), F.lit(0)))
    return F.aggregate(F.array_repeat(F.lit(0), 3 * F.least(opening, closing)), text, _until_the_same)


def _until_the_same(text: Column, _: Column) -> Column:
    # a text without a pair of runs around something is left alone at the cost of one look
    return F.when(text.rlike(r"[*_](?=[^\s*_])[^*]*+[*]|_"), _without_emphasis(text)).otherwise(text)


def _without_markup(source: Column) -> Column:
    """The text of a heading whose links are taken off: other markup removed, inline code kept in backticks."""
    text = map_matches(source, rf"{_ESCAPE}|{_code_span('hc')}", _protect)
    text = F.regexp_replace(text, rf"<({_AUTO_URL}|{_AUTO_MAIL})>", "$1")
    text = F.regexp_replace(text, _html_inline(), "")
    text = let(text, lambda t: F.when(t.rlike("[*_]"), let(t, _all_emphasis)).otherwise(t))
    text = unescape(F.replace(text, F.lit("\n"), F.lit("")))
    return F.translate(text, _STAND_IN + _CLOSES_NOTHING, _PUNCTUATION)


def _heading_texts(sources: Column) -> Column:
    return F.transform(sources, lambda s: F.when(s.rlike(r"[\\`*_<&\n]"), _without_markup(s)).otherwise(s))


def _heading_tokens(text: Column, flat: Column) -> Column:
    """Headings and link definitions."""
    return F.regexp_extract_all(F.when(~flat, text), F.lit(HEADING_SCAN), F.lit(1))


def _heading_sources(text: Column, flat: Column, tokens: Column) -> Column:
    return F.when(flat, _flat_headings(text)).otherwise(F.transform(F.filter(tokens, _is_heading), _heading_source))


def _heading_definitions(text: Column, flat: Column, tokens: Column) -> Column:
    of_flat = F.regexp_extract_all(F.when(flat & text.contains("]:"), text), F.lit(_FLAT_DEFINITIONS), F.lit(0))
    return F.coalesce(_definitions(F.coalesce(of_flat, tokens)), F.array().cast(_DEFINITION_TYPE))


def _all_headings(text: Column, flat: Column) -> Column:
    def on_tokens(tokens: Column) -> Column:
        def on_sources(sources: Column) -> Column:
            # headings with brackets are one text, with a blank line between them
            def stripped(joined: Column) -> Column:
                defs = _heading_definitions(text, flat, tokens)
                without = brackets.matched_brackets(
                    joined, FLAT_SCAN, lambda _: defs, normalize_label, _tail_dest, lambda t, p, _, r: brackets.without_brackets(t, p, r)
                )
                return F.when(joined.contains("["), F.split(without, "\n\n", -1)).otherwise(sources)

            return let(let(F.array_join(sources, "\n\n"), stripped), _heading_texts)

        return let(_heading_sources(text, flat, tokens), on_sources)

    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(let(_heading_tokens(text, flat), on_tokens))


# --- documents -------------------------------------------------------------------------------
def with_links_and_headings(df: DataFrame, text: str, links: str | None = None, headings: str | None = None) -> DataFrame:
    """``df`` with the links (``array<struct<line, link>>``) and heading texts (``array<string>``) of the column ``text``.

    Both are in document order, and null where the text is.  The line is that of the *end* of the link,
    counting ``\\n`` from 1.  Each step is a projection, so what several expressions use is computed once.
    """
    given = df.columns
    lines, deep, nested, flat, prepared = (f"_md_{n}" for n in ("lines", "deep", "nested", "flat", "text"))
    has_links = F.col(text).contains("[") | F.col(text).contains("<")
    has_headings = F.col(text).rlike(r"#|(?:^|\n)[ \t>]*+[=-]")
    wanted = has_links if headings is None else has_headings if links is None else has_links | has_headings
    df = df.withColumn(lines, F.when(wanted, on_columns(_lines, text)))
    df = df.withColumns({deep: on_columns(_is_deep, lines), nested: on_columns(_is_nested, lines)})
    df = df.withColumn(flat, F.col(deep) | F.col(nested))
    df = df.withColumn(prepared, on_columns(_taken_off, lines, flat)).drop(lines, deep)
    df = df.withColumn(prepared, on_columns(_closed, prepared))
    found = {}
    if links is not None:
        found[links] = on_columns(_all_links, prepared, flat, nested)
    if headings is not None:
        found[headings] = on_columns(_all_headings, prepared, flat)
    there = F.col(text).isNotNull()
    return df.withColumns({n: F.when(there, c) for n, c in found.items()}).select(*given, *found)


# --- anchors ---------------------------------------------------------------------------------
def heading_slug(text: Column) -> Column:
    """Drop all but word characters, spaces and hyphens; lower ASCII only; spaces to hyphens."""
    kept = F.regexp_replace(text, r"(?U)[^\w -]", "")
    return F.replace(ascii_lower(kept), F.lit(" "), F.lit("-"))


def number_repeats(texts: Column) -> Column:
    """``array<struct<text, pos, nth>>``: nth counts the earlier equal texts (0 for the first).

    Sorting brings equal texts together; their rank is the distance to the start of the run.
    This is n log n within the row, with no shuffle and no growing accumulator.
    """
    ordered = F.sort_array(
        F.transform(texts, lambda t, i: F.struct(t.alias("text"), i.alias("pos")))
    )
    unique = F.transform(
        texts, lambda t, i: F.struct(t.alias("text"), i.alias("pos"), F.lit(0).alias("nth"))
    )

    def ranked(rows: Column) -> Column:
        starts = F.filter(
            F.transform(
                rows,
                lambda row, i: F.when(
                    (i == 0) | ~row["text"].eqNullSafe(F.get(rows, i - 1)["text"]), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda s: F.flatten(
                F.transform(
                    s,
                    lambda first, r: F.transform(
                        F.sequence(first, F.coalesce(F.get(s, r + 1), F.size(rows)) - 1),
                        lambda p: F.struct(
                            F.get(rows, p)["text"].alias("text"),
                            F.get(rows, p)["pos"].alias("pos"),
                            (p - first).alias("nth"),
                        ),
                    ),
                )
            ),
        )

    return F.when(F.size(F.array_distinct(texts)) == F.size(texts), unique).otherwise(let(ordered, ranked))


def anchors(headings: Column, slug: Callable[[Column], Column] = heading_slug) -> Column:
    """The distinct anchors (``array<string>``) of heading texts in document order."""
    ids = F.transform(
        number_repeats(headings),
        lambda h: F.when(h["nth"] == 0, slug(h["text"])).otherwise(
            F.concat(slug(h["text"]), F.lit("-"), h["nth"].cast("string"))
        ),
    )
    return F.array_distinct(ids)
