import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from anchorage.llm.conversations import Program, _edit_stream, damaged, digests, plan_edits, repaired_rows
from anchorage.llm.queries import op11_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, audit string, dropped_at int"
BLANK = " \t\n\x0b\x0c\r"


def ids_of(rows):
    return [(c, t, r, x, "clash", "clash", 1) for c, t, r, x in rows]


def faults(rows):
    """0 none, 1 blank, 2 duplicate, 3 truncated, for (role, text) rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        out.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, letters) by keeping every cheapest sequence of letters for each row and role sequence state."""
    found = {(): {"": 0}}  # the last role letter, or none -> letters -> cost

    def inserted(states):
        out = {k: dict(v) for k, v in states.items()}
        for _ in range(3):
            for last, ways in list(out.items()):
                new = ("a",) if last == ("u",) else ("u",)
                for letters, cost in list(ways.items()):
                    if letters.endswith("III"):
                        continue
                    here = out.setdefault(new, {})
                    here[letters + "I"] = min(here.get(letters + "I", 99999), cost + 3)
        return out

    for (role, text), fault in zip(rows, faults(rows)):
        after = {}
        for last, ways in inserted(found).items():
            for letters, cost in ways.items():
                offers = [(last, letters + "D", cost + 4)]
                if fault not in (1, 2):
                    more = 3 if fault == 3 else 0
                    allowed = {(): "su", ("s",): "u", ("u",): "a", ("a",): "u"}[last]
                    if role[:1] and role[0] in allowed:
                        offers.append(((role[0],), letters + "K", cost + more))
                    offers += [((x,), letters + "R", cost + 3 + more) for x in allowed if x != "s"]
                for state, new, price in offers:
                    here = after.setdefault(state, {})
                    here[new] = min(here.get(new, 99999), price)
        # letters that cost more than the cheapest of the same state by far can't be needed
        found = {s: {k: v for k, v in w.items() if v <= min(w.values())} for s, w in after.items()}
    ends = inserted(found)
    offers = [(cost, letters) for last in ((), ("a",)) for letters, cost in ends.get(last, {}).items() if last or "I" not in letters[-1:]]
    return min(offers)


def repaired(rows, letters):
    out, at, last = [], 0, ""
    for letter in letters:
        new = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((new, ""))
        else:
            role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            out.append((new if letter == "R" else role, text))
        last = out[-1][0][0]
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def expected(turns):
    """The contract's row for (turn, role, text) rows after damage, which are in order."""
    rows = [(r, t) for _, r, t in turns]
    kinds = faults(rows)
    numbers = {t for t, _, _ in turns if t is not None}
    initials = [r[:1] for r, _ in rows]
    cost, letters = cheapest(rows) if rows else (0, "")
    body = "\n".join(f"{r}:{t}" for r, t in repaired(rows, letters))
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        kinds.count(1), kinds.count(2), kinds.count(3),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, letters, hashlib.sha256(body.encode()).hexdigest(),
    )


def damage(conv, turn, role, text):
    def shown(x):
        return " " if x is None else str(x)

    kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
    role, text = shown(role), shown(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def samples(seed, conversations, longest):
    rng, out = random.Random(seed), []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randrange(longest + 1)):
            turn += rng.choice([1, 1, 1, 2, 5])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", " \t", "", None, "Why?", "é!", "a\nb", f"t{turn}."])
            out.append((conv if conv != 3 else None, turn if rng.random() < 0.97 else None, role, text))
    return out


def test_against_brute_force(spark):
    rows = samples(1, 150, 9)
    table = spark.createDataFrame(ids_of(rows), SCHEMA).repartition(5)
    hurt = damaged(table)
    edits = plan_edits(hurt, dropped="dropped")
    texts = {r["conv"]: r["sha256"] for r in digests(repaired_rows(hurt, edits, dropped="dropped")).collect()}
    ours = {}
    for r in edits.collect():
        empty = hashlib.sha256(b"").hexdigest()
        ours[r["conv"]] = (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), texts.get(r["conv"], empty))
    theirs = {}
    for conv in {r[0] for r in rows}:
        after = [x for c, t, r, s in rows if c == conv for x in damage(c, t, r, s)]
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        theirs[None if conv is None else str(conv)] = expected(after)
    assert ours == theirs


def test_query_over_the_whole_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    theirs = set()
    for conv in {r[0] for r in rows}:
        after = [x for c, t, r, s in rows if c == conv for x in damage(c, t, r, s)]
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        theirs.add((conv, *expected(after)))
    ours = [tuple(r) for r in op11_conversation_repair(spark, sf).collect()]
    assert len(ours) == len(theirs) and set(ours) == theirs


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_blocks_of_backpointers_leave_the_task_and_come_back(spark, block_rows):
    rows = samples(2, 20, 30)
    table = spark.createDataFrame(ids_of(rows), SCHEMA)
    whole = {tuple(r) for r in plan_edits(table).collect()}
    assert {tuple(r) for r in plan_edits(table, block_rows=block_rows).collect()} == whole


def test_state_is_carried_over_arrow_batches(spark):
    rows = samples(4, 8, 60)
    table = spark.createDataFrame(ids_of(rows), SCHEMA)
    whole = {tuple(r) for r in plan_edits(table).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        edits = plan_edits(table)
        assert {tuple(r) for r in edits.collect()} == whole
        small = sorted(map(tuple, digests(repaired_rows(table, edits)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == sorted(map(tuple, digests(repaired_rows(table, plan_edits(table))).collect()), key=str)


def test_a_giant_conversation_holds_a_third_of_all_rows(spark):
    many = [(7, t, "user" if t % 2 else "assistant", f"text {t % 1000}.") for t in range(20_000)]
    others = [(100 + t // 4, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(40_000)]
    table = spark.createDataFrame(ids_of(many + others), SCHEMA)
    found = {r["conv"]: r for r in plan_edits(table, block_rows=512).collect()}
    # the first row is an assistant's; only the first 1000 texts are new
    assert (found["7"]["duplicate"], found["7"]["cost"], len(found["7"]["audit"])) == (19_000, 19_000 * 4 + 6, 20_002)
    assert found["7"]["audit"] == "IK" + "K" * 999 + "D" * 19_000 + "I"
    assert len(found) == 10_001 and all(r["cost"] == 0 for c, r in found.items() if c != "7")


def test_states_of_the_program_are_few():
    program = Program()
    for row in product("sua?", (False, True), (False, True)):
        program.step(Program.FIRST, row)
    for _ in range(12):
        for state in {s for s, _, _ in program.known.values()}:
            for row in product("sua?", (False, True), (False, True)):
                program.step(state, row)
    assert len({s for s, _, _ in program.known.values()}) < 500


def test_empty_table_and_conversations_that_vanish(spark):
    empty = spark.createDataFrame([], SCHEMA)
    edits = plan_edits(damaged(empty), dropped="dropped")
    assert edits.count() == 0 and repaired_rows(empty, edits).count() == 0
    table = spark.createDataFrame(ids_of([(c, 0, "user", "Hm.") for c in range(100)]), SCHEMA)
    hurt = damaged(table)
    edits = plan_edits(hurt, dropped="dropped")
    gone = {str(c) for c in range(100) if not damage(c, 0, "user", "Hm.")}
    found = {r["conv"]: tuple(r)[1:] for r in edits.collect()}
    assert len(found) == 100 and gone and all(found[c] == ("", 0, 0, 0, 0, 0, 0) for c in gone)


def test_very_long_text(spark):
    text = "x" * 3_000_000 + "."
    table = spark.createDataFrame(ids_of([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", text)]), SCHEMA)
    edits = plan_edits(table)
    assert [tuple(r) for r in edits.collect()] == [("1", "KKD", 0, 0, 1, 0, 0, 4)]
    digest = hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest()
    assert [tuple(r) for r in digests(repaired_rows(table, edits)).collect()] == [("1", digest)]


def test_no_frames_no_rows():
    assert list(_edit_stream(10)(iter([]))) == []
