"""Links by matched brackets, nested to any depth.

The text of some paragraphs is cut into tokens; what hides its content (code, tags, escapes) is one token.
A bracket's level is a running sum over the tokens, and an opening and a closing bracket belong together if
they are neighbours among those of their paragraph and level; so matching is a sort.  A pair is a link or
an image by what follows it (a destination, a label) or by its own text being a label.  A link holds no
other link: the inner one wins.  Of pairs in a row, each may be the label of the one before it, from the
left: whether it is used up is the parity of its place in the run.

This takes several steps, each bound to a variable, as the ones after it use it more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import running_max, running_sum
from .text import count_newlines, let

_HALF = _PARAGRAPH = 1 << 32


def _places(tokens: Column, hard: Column) -> Column:
    def place(token: Column, i: Column) -> Column:
        ends = (F.get(hard, i) != "") | (token.startswith("\n") & (F.length(token) > 1))
        lines = F.when(token.contains("\n"), count_newlines(token)).otherwise(F.lit(0)).cast("bigint")
        return F.when(ends, lines + _PARAGRAPH).otherwise(lines)

    return running_sum(tokens, place)


def line_of(places: Column, at: Column) -> Column:
    return (F.get(places, at) % _PARAGRAPH).cast("int")


def _opens(token: Column) -> Column:
    return token.isin("[", "![")


def _brackets(tokens: Column) -> Column:
    """Running numbers of closing (low half) and opening brackets (high half)."""
    return running_sum(tokens, lambda t, _: F.when(_opens(t), F.lit(_HALF)).when(t.startswith("]"), 1).otherwise(0))


def _rows(tokens: Column, places: Column, seen: Column) -> Column:
    def row(token: Column, i: Column) -> Column:
        opened, closed = F.shiftright(F.get(seen, i), 32), F.get(seen, i) % _HALF
        level = opened - closed + F.when(_opens(token), 0).otherwise(1)
        paragraph = F.shiftright(F.get(places, i), 32)
        fields = {"paragraph": paragraph, "level": level, "at": i, "opens": _opens(token), "count": opened + closed}
        return F.when(_opens(token) | token.startswith("]"), F.struct(*[c.alias(n) for n, c in fields.items()]))

    return F.sort_array(F.filter(F.transform(tokens, row), lambda r: r.isNotNull()))


def _matched(rows: Column) -> Column:
    """``close, open, inner``: the matched brackets in the order of their ends, with the number of pairs within."""

    def pair(row: Column, k: Column) -> Column:
        following = F.get(rows, k + 1)
        fits = row["opens"] & ~following["opens"] & (row["paragraph"] == following["paragraph"]) & (row["level"] == following["level"])
        inner = F.shiftright(following["count"] - row["count"] - F.lit(1), 1)
        return F.when(fits, F.struct(following["at"].alias("close"), row["at"].alias("open"), inner.alias("inner")))

    return F.sort_array(F.filter(F.transform(rows, pair), lambda p: p.isNotNull()))


def _texts(tokens: Column, pieces: Column, matched: Column, normalize) -> Column:
    """The normalized text of each pair that holds no other; NULL for the others."""

    def text(pair: Column) -> Column:
        between = F.array_join(F.slice(pieces, pair["open"] + F.lit(2), pair["close"] - pair["open"]), "")
        size = F.length(between) - F.length(F.get(tokens, pair["close"]))
        return F.when(pair["inner"] == 0, normalize(F.substring(between, F.lit(1), size)))

    return F.transform(matched, text)


def _own_dests(tokens: Column, matched: Column, texts: Column, defs: Column, tail_dest) -> Column:
    """Where each pair leads by what follows it in parentheses, or by its own text."""

    def dest(pair: Column, q: Column) -> Column:
        closing, own = F.get(tokens, pair["close"]), F.get(texts, q)
        # the first definition counts; 0 means none
        at = F.array_position(defs["label"], own).cast("int")
        return F.when(F.length(closing) > 1, tail_dest(closing)).when(own != "", F.get(defs["dest"], F.nullif(at, F.lit(0)) - F.lit(1)))

    return F.transform(matched, dest)


def _targets(tokens: Column, pieces: Column, matched: Column, texts: Column, own: Column) -> Column:
    """The pairs with their destinations, and whether the pair behind is their label."""

    def target(pair: Column, q: Column) -> Column:
        after, text = F.get(matched, q + F.lit(1)), F.get(texts, q + F.lit(1))
        adjacent = (after["open"] == pair["close"] + F.lit(1)) & (F.get(pieces, pair["close"] + F.lit(1)) == "[") & (after["inner"] == 0)
        followed = F.coalesce((F.get(tokens, pair["close"]) == "]") & adjacent, F.lit(False))
        inline_label = F.length(F.get(tokens, after["close"])) > 1
        by_label = F.when(~inline_label, F.when(text == "", F.get(own, q)).otherwise(F.get(own, q + F.lit(1))))
        fields = {
            "close": pair["close"], "open": pair["open"], "inner": pair["inner"], "image": F.get(tokens, pair["open"]) == "![",
            "labelled": followed & ~F.coalesce(inline_label, F.lit(False)), "dest": F.when(followed, by_label).otherwise(F.get(own, q)),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return F.transform(matched, target)


def _sums(pairs: Column) -> Column:
    """Running number of the pairs that are links by what follows them, but for labels of images."""

    def one(p: Column, q: Column) -> Column:
        before = F.get(pairs, q - F.lit(1))
        of_image = F.coalesce(before["image"] & before["labelled"], F.lit(False))
        return F.when(p["dest"].isNotNull() & ~p["image"] & ~of_image, 1).otherwise(0)

    return running_sum(pairs, one)


def _able(pairs: Column, sums: Column) -> Column:
    def able(p: Column, q: Column) -> Column:
        upto = F.coalesce(F.get(sums, q - F.lit(1)), F.lit(0))
        holds_link = (p["inner"] > 0) & (upto > F.coalesce(F.get(sums, q - p["inner"] - F.lit(1)), F.lit(0)))
        return p["dest"].isNotNull() & (p["image"] | ~holds_link)

    return F.transform(pairs, able)


def _begins(pairs: Column, able: Column) -> Column:
    """For each pair the last one up to it that is no label of the pair before."""

    def begin(p: Column, q: Column) -> Column:
        is_label = F.coalesce(F.get(able, q - F.lit(1)) & F.get(pairs, q - F.lit(1))["labelled"], F.lit(False))
        return F.when(~is_label, q)

    return running_max(pairs, begin)


def _chosen(pairs: Column, able: Column, begins: Column) -> Column:
    def one(p: Column, q: Column) -> Column:
        used_up = (q - F.get(begins, q)) % F.lit(2) == 1
        end = F.when(p["labelled"], F.get(pairs, q + F.lit(1))["close"]).otherwise(p["close"])
        row = F.struct(p["open"].alias("open"), p["close"].alias("close"), end.alias("end"), p["image"].alias("image"), p["dest"].alias("dest"))
        return F.when(F.get(able, q) & ~used_up, row)

    return F.filter(F.transform(pairs, one), lambda r: r.isNotNull())


def matched_brackets(
    text: Column,
    scan: str,
    definitions: Callable[[Column], Column],
    normalize: Callable[[Column], Column],
    tail_dest: Callable[[Column], Column],
    body: Callable[[Column, Column, Column, Column], Column],
) -> Column:
    """``body(tokens, pieces, places, resolved)`` for the brackets of ``text``.

    Pieces cover the text, each ends with its token.  Group 1 of ``scan`` is the token, group 2 is not empty
    where a paragraph ends.  ``places`` are running sums: newlines (low half) and ends of paragraphs (high half)
    up to and with the token.  ``resolved`` are the links and images, in the order of their ends: ``open, close,
    end, image, dest``, the tokens of the brackets, the last token that belongs to it (of another pair where that
    is its label) and the destination.  ``definitions`` gives the link definitions (``label, dest``) from the tokens.
    """

    def group(n: int) -> Column:
        return F.regexp_extract_all(text, F.lit(scan), F.lit(n))

    def on_tokens(tokens: Column, pieces: Column, places: Column) -> Column:
        def on_matched(matched: Column) -> Column:
            def on_texts(texts: Column) -> Column:
                own = let(definitions(tokens), lambda defs: _own_dests(tokens, matched, texts, defs, tail_dest))
                return let(own, lambda dests: _targets(tokens, pieces, matched, texts, dests))

            return let(let(_texts(tokens, pieces, matched, normalize), on_texts), on_pairs)

        def on_pairs(pairs: Column) -> Column:
            able = let(_sums(pairs), lambda sums: _able(pairs, sums))
            return let(able, lambda a: let(let(_begins(pairs, a), lambda begins: _chosen(pairs, a, begins)), lambda r: body(tokens, pieces, places, r)))

        rows = let(_brackets(tokens), lambda seen: _rows(tokens, places, seen))
        return let(let(rows, _matched), on_matched)

    def on_groups(tokens: Column) -> Column:
        places = let(group(2), lambda hard: _places(tokens, hard))
        return let(group(0), lambda pieces: let(places, lambda p: on_tokens(tokens, pieces, p)))

    return let(group(1), on_groups)


def without_brackets(tokens: Column, pieces: Column, resolved: Column) -> Column:
    """The text without the brackets, destinations and labels of ``resolved`` links and images."""
    token, all_of = 1, 2

    def mark(at: Column, what: int) -> Column:
        return F.struct(at.alias("at"), F.lit(what).alias("what"))

    def of_link(x: Column) -> Column:
        label = F.filter(F.sequence(x["close"], x["end"]), lambda i: i > x["close"])
        return F.concat(F.array(mark(x["open"], token), mark(x["close"], token)), F.transform(label, lambda i: mark(i, all_of)))

    marks = F.flatten(F.transform(resolved, of_link))
    ordered = F.sort_array(F.concat(F.transform(tokens, lambda _, i: mark(i, 0)), marks))

    def shown(row: Column, k: Column, rows: Column) -> Column:
        piece, following = F.get(pieces, row["at"]), F.get(rows, k + F.lit(1))
        marked = F.coalesce(following["at"] == row["at"], F.lit(False))
        no_token = F.substring(piece, F.lit(1), F.length(piece) - F.length(F.get(tokens, row["at"])))
        return F.when(row["what"] > 0, F.lit("")).when(~marked, piece).when(following["what"] == all_of, F.lit("")).otherwise(no_token)

    return let(ordered, lambda rows: F.array_join(F.transform(rows, lambda r, k: shown(r, k, rows)), ""))
