r"""Conversation structure repair by a streamed dynamic program.

Rows are dealt by conversation and sorted by turn; a stream over each partition carries the state of a
dynamic program from one Arrow batch to the next.  Each row is kept (free), given the role user or assistant
(``REROLE``) or deleted (``DELETE``; blank and duplicate rows have to be), and empty rows of user or
assistant are inserted (``INSERT``) so that the roles become ``(s?(ua)+)?``, an optional system row before
pairs of user and assistant; a truncated row that is not deleted costs ``TRUNCATED``.  Among the cheapest
repairs the one with the smallest sequence of letters ``K R D I`` is taken.

*State.*  After each row there are at most four ways to stand: nothing yet, after a system, a user or an
assistant row.  All that later rows need of them is how much dearer each is than the cheapest and how their
letters so far compare; two different sequences over the same rows never are a prefix of one another when
both end with the letter of a row.  So few states occur, each transition is computed once, and a row's
backpointer is the number of its transition.

*Giant conversations.*  Backpointers of more than ``block_rows`` rows leave the task as rows of the staged
result, a block at a time, packed to 4 bytes a row; a second stream reads these blocks backwards and writes
the letters.  So a task holds one block however long a conversation is.  Whether a text was seen earlier is
decided by a window in Spark within the same partitioning, not by a set in the stream.

Defined results: a null conversation id is a conversation.  Null turns come first and do not count for
gaps; rows of one turn go by role, then by text.  Null and empty texts are blank; null roles are empty ones.
Roles count by their first letter; one that is not s, u or a cannot be kept.  Identical rows are duplicates
of the first of them.  A very long text is one row of a batch.  An empty table gives no rows.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import stage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK_ROWS = 1 << 20
# What counts as blank, and what ends a sentence.
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_FAR = 1 << 30
#: A way to stand that is dearer than the cheapest by more than this never wins: the cheapest can follow it for at
#: most two inserted rows, or for deleting a system row that only the start can keep and inserting one row.
_HOPELESS = max(2 * INSERT, DELETE + INSERT)
#: Empty rows that can be inserted from a state: user after anything but user, assistant after user.
_NEXT_INSERTED = {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER, _USER: _ASSISTANT}


def _inserted(state: int) -> list[tuple[int, str]]:
    """(state, letters) after no, one or two inserted rows; more only return to a state that was there."""
    one = _NEXT_INSERTED[state]
    return [(state, ""), (one, "I"), (_NEXT_INSERTED[one], "II")]


def _row_edits(state: int, initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, str]]:
    """(new state, cost, letter) for one row."""
    out = [(state, DELETE, "D")]
    if not must_go:
        extra = TRUNCATED if truncated else 0
        kept = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}.get(initial)
        fits = {_SYSTEM: state == _START, _USER: state != _USER, _ASSISTANT: state == _USER}
        if kept is not None and fits[kept]:
            out.append((kept, extra, "K"))
        out.append((_NEXT_INSERTED[state], REROLE + extra, "R"))
    return out


class Program:
    """The dynamic program as an automaton that is built as it runs.

    A state is ``(cost over the cheapest, rank of the letters)`` of each of the four ways to stand, a row's
    type ``(initial, must_go, truncated)``.  A transition leads to another state, adds to the cost, and has
    for each way to stand where it came from and the letters that were added, packed in a backpointer: 8 bits
    each, the way before (2 bits) and the letters (an index into ``LETTERS``).
    """

    LETTERS = [i + letter for i, letter in product(("", "I", "II"), "DKR")]
    FIRST = ((0, 0), (_FAR, 0), (_FAR, 0), (_FAR, 0))

    def __init__(self) -> None:
        self.known: dict = {}

    def step(self, state: tuple, row: tuple[str, bool, bool]) -> tuple[tuple, int, int]:
        """(new state, cost that all ways share, backpointer)."""
        found = self.known.get((state, row))
        if found is None:
            found = self.known[state, row] = self._transition(state, row)
        return found

    def _transition(self, state: tuple, row: tuple[str, bool, bool]) -> tuple[tuple, int, int]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for way, (cost, rank) in enumerate(state):
            if cost >= _FAR:
                continue
            for between, letters in _inserted(way):
                for after, extra, letter in _row_edits(between, *row):
                    offer = (cost + INSERT * len(letters) + extra, rank, letters + letter, way)
                    if after not in best or offer < best[after]:
                        best[after] = offer
        least = min(offer[0] for offer in best.values())
        best = {way: offer for way, offer in best.items() if offer[0] - least <= _HOPELESS}
        ranked = sorted(best, key=lambda way: best[way][1:3])
        back = sum((best[way][3] | self.LETTERS.index(best[way][2]) << 2) << 8 * way for way in best)
        new = tuple((best[w][0] - least, ranked.index(w)) if w in best else (_FAR, 0) for w in range(4))
        return new, least, back

    @staticmethod
    def end(state: tuple) -> tuple[int, int, str]:
        """(way, cost, inserted letters) of the best end: nothing at all, or after an assistant row."""
        offers = []
        for way, (cost, rank) in enumerate(state):
            for after, letters in _inserted(way):
                if cost < _FAR and (after == _ASSISTANT or (after == _START and not letters)):
                    offers.append((cost + INSERT * len(letters), rank, letters, way))
        cost, _, letters, way = min(offers)
        return way, cost, letters

    @classmethod
    def trace(cls, back: np.ndarray, way: int) -> tuple[str, int]:
        """(letters of a block of rows that ends in ``way``, the way before it)."""
        out = []
        for pointer in back[::-1].tolist():
            entry = pointer >> 8 * way & 0xFF
            out.append(cls.LETTERS[entry >> 2])
            way = entry & 3
        return "".join(out[::-1]), way


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_EDITS = "conv string, block bigint, last boolean, back binary, way int, audit string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
#: Adjacent roles that are in order.
_IN_ORDER = {"su", "ua", "au"}


class _Conversation:
    """What the stream holds of the conversation that it is in."""

    def __init__(self, conv: str | None, program: Program, block_rows: int):
        self.conv, self.program, self.block_rows = conv, program, block_rows
        self.state, self.cost, self.back, self.block = Program.FIRST, 0, array("I"), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.initial = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        if self.initial is not None:
            self.illegal += self.initial + initial not in _IN_ORDER
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.state, cost, back = self.program.step(self.state, (initial, fault in (1, 2), fault == 3))
        self.cost += cost
        self.back.append(back)

    def full(self) -> tuple | None:
        """The row of a full block, which leaves the task."""
        if len(self.back) < self.block_rows:
            return None
        row = (self.conv, self.block, False, self.back.tobytes(), None, None, *[None] * len(_COUNTS))
        self.back, self.block = array("I"), self.block + 1
        return row

    def closed(self) -> tuple:
        way, cost, letters = Program.end(self.state)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost)
        audit, before = Program.trace(np.frombuffer(self.back, np.uint32), way)
        return (self.conv, self.block, True, None, before, audit + letters, *counts)


def _edit_stream(block_rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, current = Program(), None
        names = [part.split()[0] for part in _EDITS.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names, dtype=object)
            return out.astype({"block": "int64", "way": "Int32", **{c: "Int64" for c in _COUNTS}})

        for rows in frames:
            out = []
            columns = (rows[c].tolist() for c in ("conv", "dropped", "no_turn", "turn", "initial", "fault"))
            for conv, dropped, no_turn, turn, initial, fault in zip(*columns):
                if current is None or conv != current.conv:
                    if current is not None:
                        out.append(current.closed())
                    current = _Conversation(conv, program, block_rows)
                if dropped:
                    continue
                current.add(None if no_turn else turn, initial, fault)
                if (full := current.full()) is not None:
                    out.append(full)
            if out:
                yield frame(out)
        if current is not None:
            yield frame([current.closed()])

    return run


def _trace_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each conversation from the last one backwards become ``conv, block, piece``."""
    way = 0
    for rows in frames:
        pieces = []
        for last, back, at_end, audit in zip(rows["last"], rows["back"], rows["way"], rows["audit"]):
            if last:
                piece, way = audit, int(at_end)
            else:
                piece, way = Program.trace(np.frombuffer(back, np.uint32), way)
            pieces.append(piece)
        yield pd.DataFrame({"conv": rows["conv"], "block": rows["block"], "piece": pieces})


def _prepared(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, dropped: str | None) -> DataFrame:
    gone = F.coalesce(rows[dropped], F.lit(False)) if dropped else F.lit(False)
    return rows.select(
        rows[id_col].cast("string").alias("conv"),
        gone.alias("dropped"),
        rows[turn_col].isNull().alias("no_turn"),
        F.coalesce(rows[turn_col].cast("bigint"), F.lit(0)).alias("turn"),
        F.when(gone, F.lit("")).otherwise(F.coalesce(rows[role_col], F.lit(""))).alias("role"),
        F.when(gone, F.lit("")).otherwise(F.coalesce(rows[text_col], F.lit(""))).alias("text"),
    )


#: The order of the stream: dropped rows first, then by turn (null first), role and text.
_ORDER = ("conv", "dropped DESC", "no_turn DESC", "turn", "role", "text")


def _order(*more: str) -> list[Column]:
    return [F.col(k.split()[0]).desc() if k.endswith(" DESC") else F.col(k).asc_nulls_first() for k in (*_ORDER, *more)]


def _whole_audits(edits: DataFrame) -> DataFrame:
    """One row per conversation; the letters of giant ones are put together from their blocks."""
    blocks = edits.filter((F.col("block") > 0) | ~F.col("last")).select("conv", "block", "last", "back", "way", "audit")
    backwards = blocks.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    pieces = backwards.mapInPandas(_trace_back, "conv string, block bigint, piece string").groupBy("conv")
    whole = pieces.agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("pieces"))
    whole = whole.select(F.col("conv").alias("giant"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("whole"))
    ends = edits.filter("last")
    joined = ends.join(whole, ends["conv"].eqNullSafe(whole["giant"]), "left")
    return joined.select("conv", F.coalesce("whole", "audit").alias("audit"), *_COUNTS)


def plan_edits(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    dropped: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``conv, audit, gaps, blank, duplicate, truncated, illegal, cost``: one row per conversation.

    ``conv`` is the id as a string.  Rows whose column ``dropped`` is true count for nothing, but for their
    conversation being listed.  ``blank``, ``duplicate`` and ``truncated`` count the first fault of each row;
    ``illegal`` counts neighbours whose roles are not in order.
    """
    chosen = _prepared(rows, id_col, turn_col, role_col, text_col, dropped)
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    own = F.when(last == "", 1).when(~last.isin(*SENTENCE_ENDS), 3).otherwise(0)
    # the window and the stream share one exchange, by conversation
    earlier = Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.col("no_turn").desc(), "turn")
    marked = chosen.repartition("conv").withColumns({"own": own, "again": F.row_number().over(earlier) > 1})
    fault = F.when((F.col("own") != 1) & F.col("again"), 2).otherwise(F.col("own")).alias("fault")
    ordered = marked.sortWithinPartitions(*_order("again"))
    slim = ordered.select("conv", "dropped", "no_turn", "turn", F.substring("role", 1, 1).alias("initial"), fault)
    return _whole_audits(stage(slim.mapInPandas(_edit_stream(block_rows), _EDITS), "edits"))


_REPAIRED = "conv string, at bigint, role string, text string, edit string"


def _repair_stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, those of a conversation after its letters, become the rows of the repaired conversation."""
    names = [part.split()[0] for part in _REPAIRED.split(", ")]
    conv, letters, at, taken, way = None, "", 0, 0, _START
    ways = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
    roles = {_USER: "user", _ASSISTANT: "assistant"}
    out: list[tuple] = []

    def insert() -> None:
        nonlocal at, taken, way
        while taken < len(letters) and letters[taken] == "I":
            way = _NEXT_INSERTED[way]
            out.append((conv, at, roles[way], "", "I"))
            at, taken = at + 1, taken + 1

    for rows in frames:
        for own, audit, role, text in zip(rows["conv"].tolist(), rows["audit"].tolist(), rows["role"].tolist(), rows["text"].tolist()):
            if audit is not None:
                insert()
                conv, letters, at, taken, way = own, audit, 0, 0, _START
                continue
            insert()
            letter, taken = letters[taken], taken + 1
            if letter != "D":
                way = _NEXT_INSERTED[way] if letter == "R" else ways[role[0]]
                out.append((conv, at, roles[way] if letter == "R" else role, text, letter))
                at += 1
        if out:
            yield pd.DataFrame(out, columns=names)
            out.clear()
    insert()
    if out:
        yield pd.DataFrame(out, columns=names)


def repaired_rows(
    rows: DataFrame,
    edits: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    dropped: str | None = None,
) -> DataFrame:
    """``conv, at, role, text, edit``: the rows of the repaired conversations, by the ``edits`` of ``plan_edits``.

    ``at`` counts from 0, ``edit`` is K, R or I.  A conversation's rows are in one partition, in order.
    """
    chosen = _prepared(rows, id_col, turn_col, role_col, text_col, dropped).filter(~F.col("dropped"))
    # the letters go before the rows of their conversation: dropped rows come first, and these are none
    audits = edits.select("conv", F.lit(True).alias("dropped"), F.lit(True).alias("no_turn"), F.lit(0).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = chosen.withColumn("audit", F.lit(None).cast("string")).unionByName(audits)
    ordered = both.repartition("conv").sortWithinPartitions(*_order())
    return ordered.select("conv", "audit", "role", "text").mapInPandas(_repair_stream, _REPAIRED)


def _digest_stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, digest = None, None
    for rows in frames:
        out = []
        for own, at, role, text in zip(rows["conv"].tolist(), rows["at"].tolist(), rows["role"].tolist(), rows["text"].tolist()):
            if at == 0:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = own, hashlib.sha256()
            digest.update(("\n" if at else "").encode() + f"{role}:{text}".encode())
        if out:
            yield pd.DataFrame(out, columns=["conv", "sha256"])
    if digest is not None:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """``conv, sha256``: hex digest of the ``role:text`` of each conversation of ``repaired_rows``, newline-joined.

    It streams over the partitions of ``repaired_rows`` as they are, so it has to follow it directly.
    """
    return repaired.select("conv", "at", "role", "text").mapInPandas(_digest_stream, "conv string, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows of ``conversations`` damaged by a checksum of id and turn.

    Of ``crc32("id:turn") % 20``, 0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it,
    4 makes its role user.  Nulls count as one space in the key, the role and the text.
    """

    def shown(c: str) -> Column:
        return F.coalesce(rows[c].cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), SENTENCE_ENDS, "")).otherwise(shown("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("dropped"), F.explode(copies).alias("copy"),
    ).drop("copy")
