"""Conversation structure repair: the lightest derivation of a well-formed conversation from what is left of one.

A conversation is an optional system turn before one or more pairs of a user's and an assistant's turn, or nothing. Items of the
deduction are (rows still to take, state), for the state of what has been derived behind them. They are derived from the end of a
conversation to its start, as edits then go in front of what they lead to: putting one letter before two audits keeps their order, so every edit is
a monotone function of (cost, rows taken, audit), and a superior one, as it never makes that value less. So Knuth's
agenda may finalise the least item each time, and the goal's first value is the least cost with the ASCII-least audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fissure.llm.shared import materialise, table

#: What edits cost, and the blank characters.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: States by what has been derived: nothing, or something that starts with an assistant's, a user's or the system's turn; and the goal.
NOTHING, A, U, S, GOAL = range(5)
#: What a state becomes with a turn in front.
BEFORE = {"a": {NOTHING: A, U: A}, "u": {A: U}, "s": {U: S}}
WHOLE = (NOTHING, U, S)
#: A row's mark: its role's initial in the two low bits, then whether it must go, then whether it is truncated.
INITIALS = {"s": 1, "u": 2, "a": 3}
LETTERS = {v: k for k, v in INITIALS.items()}
MUST_GO, CUT_SHORT = 4, 8
#: Rows that one agenda takes; the next one goes on from its four finalised items.
WINDOW = 64


def _steps(mark: int) -> list[tuple[str, str, int]]:
    """Edits of one row: letter, the initial that it leaves ("" for none), cost."""
    out = [("D", "", DELETE)]
    if not mark & MUST_GO:
        more, initial = TRUNCATED if mark & CUT_SHORT else 0, LETTERS.get(mark & 3)
        if initial:
            out.append(("K", initial, KEEP + more))
        out += [("R", role, REROLE + more) for role in "ua"]
    return out


def _agenda(marks: bytes, axioms: list[tuple[int, str, int]], last: bool, first: bool) -> dict[int, tuple[int, str, int]]:
    """Finalised items in front of some rows, from those behind them: state to (cost, letters of these rows, state behind them).

    axioms: (cost, rank of the audit so far, state). Letters end with that rank, which orders equal letters
    by what follows them. An insertion right in front of an axiom is part of that axiom already, but at the last rows.
    """
    n, done, steps = len(marks), {}, {}
    waiting = [(cost, 0, rank, state, state) for cost, rank, state in axioms]
    heapq.heapify(waiting)
    while waiting:
        cost, taken, audit, state, behind = heapq.heappop(waiting)
        if state == GOAL:
            return {GOAL: (cost, audit[:-1], behind)}
        if (taken, state) in done:
            continue
        done[taken, state] = (cost, audit[:-1], behind)
        if taken < n:
            mark = marks[n - 1 - taken]
            for letter, initial, more in steps.get(mark) or steps.setdefault(mark, _steps(mark)):
                to = BEFORE[initial].get(state) if initial else state
                if to is not None:
                    heapq.heappush(waiting, (cost + more, taken + 1, letter + audit, to, behind))
        elif first and state in WHOLE:
            heapq.heappush(waiting, (cost, taken, audit, GOAL, behind))
        if taken or last:
            for initial in "ua":
                to = BEFORE[initial].get(state)
                if to is not None:
                    heapq.heappush(waiting, (cost + INSERT, taken, "I" + audit, to, behind))
    return {state: value for (taken, state), value in done.items() if taken == n}


def lightest(marks: bytes, window: int = WINDOW) -> tuple[int, str]:
    """The least cost of edits that leave a well-formed conversation, and of those edits' letters the ASCII-least."""
    axioms, behind = [(0, "\0", NOTHING)], []
    starts = list(range(0, max(len(marks), 1), window))
    for at in reversed(starts):
        found = _agenda(marks[at : at + window], axioms, at == starts[-1], at == 0)
        behind.append(found)
        ranks = {state: rank for _, rank, state in axioms}
        whole = {state: letters + ranks[b] for state, (_, letters, b) in found.items()}
        places = {audit: chr(i) for i, audit in enumerate(sorted(set(whole.values())))}
        axioms = [(cost, places[whole[state]], state) for state, (cost, _, _) in found.items()]
    state, audit = GOAL, []
    cost = behind[-1][GOAL][0]
    for found in reversed(behind):
        _, letters, state = found[state]
        audit.append(letters)
    return cost, "".join(audit)


def _seen(turns: list[int | None], marks: bytearray) -> tuple[int, int]:
    """Turns missing between the least and the greatest, and neighbours whose roles may not follow each other."""
    here = [t for t in turns if t is not None]
    gaps = here[-1] - here[0] + 1 - len(here) if here else 0
    initials = bytes(m & 3 for m in marks)
    legal = {bytes([INITIALS[x], INITIALS[y]]) for x, y in ("su", "ua", "au")}
    return gaps, sum(initials[i : i + 2] not in legal for i in range(len(initials) - 1))


REPAIR = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over rows (conv_id, turn, initial, blank, first, truncated, copies) in the order of conversations: a row for each.

    Of a conversation it holds a byte for each row and each turn's number, and no text.
    """
    names = [c.split()[0] for c in REPAIR.split(", ")]
    held, turns, marks, counts = (), [], bytearray(), [0, 0, 0]

    def closed() -> list:
        gaps, illegal = _seen(turns, marks)
        return [held[0], gaps, *counts, illegal, *lightest(bytes(marks))]

    def flushed(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        out = []
        for conv, turn, initial, blank, first, truncated, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held != (conv,):
                if held:
                    out.append(closed())
                held, turns, marks, counts = (conv,), [], bytearray(), [0, 0, 0]
            if not copies:
                continue  # a row that was lost tells of its conversation alone
            if turn is not None and (not turns or turns[-1] != turn):
                turns.append(turn)
            code = INITIALS.get(initial, 0)
            if blank:
                counts[0] += copies
                marks += bytes([code | MUST_GO]) * copies
                continue
            if first:
                counts[2] += truncated
                marks.append(code | (CUT_SHORT if truncated else 0))
            again = copies - bool(first)
            counts[1] += again
            marks += bytes([code | MUST_GO]) * again
        if out:
            yield flushed(out)
    if held:
        yield flushed([closed()])


ROLES = {"u": "user", "a": "assistant"}


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over each conversation's repair and then its rows in order (conv_id, kind, role, text, copies, and the repair's columns).

    Gives the repair with a hash of the repaired text; one text is held at a time.
    """
    names = [*[c.split()[0] for c in REPAIR.split(", ")], "repaired_sha256"]
    repair, at, before, hashed = None, 0, "", None

    def put(role: str, text: str) -> None:
        nonlocal before
        hashed.update(f"{chr(10) if before else ''}{role}:{text}".encode())
        before = role[0]

    def due() -> str:
        """The role that must stand here, unless the system's turn does."""
        return ROLES["a" if before == "u" else "u"]

    def inserted() -> None:
        nonlocal at
        while repair["audit"][at : at + 1] == "I":
            put(due(), "")
            at += 1

    def closed() -> dict:
        inserted()
        return repair | {"repaired_sha256": hashed.hexdigest()}

    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for i, (kind, role, text, copies) in enumerate(zip(*columns, strict=True)):
            if kind == 0:
                if repair is not None:
                    out.append(closed())
                repair, at, before, hashed = {n: batch.column(n)[i].as_py() for n in names[:-1]}, 0, "", hashlib.sha256()
                continue
            for _ in range(copies):
                inserted()
                letter = repair["audit"][at]
                at += 1
                if letter != "D":
                    put(role if letter == "K" else due(), text)
        if out:
            yield pa.RecordBatch.from_pylist(out, _WRITTEN)
    if repair is not None:
        yield pa.RecordBatch.from_pylist([closed()], _WRITTEN)


_WRITTEN = pa.schema([*[(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as a faulty export leaves them, with copies: how often a row then stands there.

    By the checksum of `conv_id:turn` modulo 20, a row is lost (0), emptied (1), loses its full stops, exclamation and question marks (2),
    stands twice (3) or becomes the user's (4). Nulls are one space, but turn stays null. A lost row stays with 0 copies, to tell of its conversation.
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    lost = code == 0
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(~lost, F.col("turn").cast("long")).alias("turn"),
        F.when(lost, "").when(code == 4, "user").otherwise(role).alias("role"),
        F.when(lost | (code == 1), "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(lost, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, copies): its faults and its lightest repair.

    A row's first fault counts: blank (no visible character), duplicate (its role and text stood earlier), truncated (its last visible
    character ends no sentence). Blank and duplicate rows must go. Keep costs 0, a change of role to user or assistant 2, deletion 3, an empty turn
    put in 2, and a truncated row that stays 1. Equal rows are counted before anything is shuffled by conversation; the derivation
    takes a byte for each row, and texts only stream past the finished audit, so a conversation of any size needs little memory besides its audit.

    Rows follow by turn (nulls first), those of one turn by role and by the MD5 of their text; equal rows stand side by side. A role
    that is empty or starts with none of s, u and a can't be kept. A null conv_id is a conversation of its own. Conversations without rows (0 copies) give
    zeros, an empty audit and the hash of nothing. An empty table gives no rows; other columns are ignored.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    same = ["conv_id", "turn", "role", "text"]
    counted = rows.groupBy(*same).agg(F.sum("copies").alias("copies"))
    there = F.col("copies") > 0
    earliest = Window.partitionBy("conv_id", "role", "text", there).orderBy(F.col("turn").asc_nulls_first())
    visible = F.rtrim(F.col("text"), F.lit(BLANKS))
    marked = counted.select(
        *same, "copies", (F.row_number().over(earliest) == 1).alias("first"), (visible == "").alias("blank"), (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.md5(F.col("text").cast("binary")).alias("tie"),
    )
    marked = materialise(marked, "marked")
    slim = marked.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", "first", "truncated", "copies", "role", "tie")
    slim = slim.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).drop("role", "tie")
    repairs = slim.mapInArrow(_derive, REPAIR)

    gone = F.col("blank") | ~F.col("first")  # their texts aren't needed
    lines = marked.filter(there).select(F.lit(1).alias("kind"), "role", F.when(~gone, F.col("text")).alias("text"), "copies", "conv_id", "turn", "tie")
    both = repairs.withColumn("kind", F.lit(0)).unionByName(lines, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    columns = [c.split()[0] for c in REPAIR.split(", ")]
    return both.select("kind", "role", "text", "copies", *columns).mapInArrow(_write, REPAIR + ", repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
