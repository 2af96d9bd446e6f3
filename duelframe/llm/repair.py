r"""Conversation structure repair by signature deduplication.

A row's role initial and its first fault become one character; the characters of a
conversation, in order, are its signature. Few signatures differ, whatever the texts: each
distinct one is solved once, by memoised recursion over (place, state of the role pattern), and
the cheapest edits are joined back and replayed on the rows.

Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty user or
assistant text 3; a truncated row that is not deleted costs 3 more. Blank and duplicate rows
have to go. Role initials must then read ``(s?(ua)+)?``; of equally cheap edits those whose
initials are least in ASCII order are taken.

Long conversations are cut into pieces of ``piece`` rows. A piece's least costs from each state
to each other one (again once for each distinct piece) are chained from the last piece to the
first, so no signature exceeds the piece. Rows of one conversation are numbered and replayed as
a sorted stream that holds no more than a piece's edits.

Rows are ordered by turn (null first), then role and text. Null roles and texts are one
space. A null conv_id is a conversation of its own. Repeated rows are rows of their own, so the
second is a duplicate. Other columns are left aside, whatever their names. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, prepare, stream, written

PIECE = 2048
NOT_SPACE = r"[^\x20\x09-\x0D]"
ENDS = ".!?"
#: States of the role pattern: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: More consecutive inserts than two only go in a circle.
INSERTS = 2
#: Costs of what may follow the last row in each state: nothing, or the inserts that close the pattern.
CLOSED_BY = ("", "ua", "a", "")
CLOSING = tuple(INSERT * len(x) for x in CLOSED_BY)
NEVER = 1 << 60
GONE = "x"
LEGAL = ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: faults by the rows' own checksums, for tests and the query.

    crc32 of ``conv_id:turn`` (null: one space) modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it the user's.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat_ws(":", named("conv_id"), named("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), named("role").alias("role"), named("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with place (from 0, in order), fault (blank, duplicate, truncated or none), code and illegal (as a pair with the row before)."""
    spaced = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    initial = F.substring("role", 1, 1)
    placed = spaced.select("*", (F.row_number().over(order) - 1).cast("long").alias("place"), F.concat(F.lag(initial).over(order), initial).alias("pair"))
    # The same exchange serves: rows of one conversation are together already.
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    last = F.regexp_extract("text", rf"({NOT_SPACE})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(NOT_SPACE), "blank").when(earlier, "duplicate").when(~last.isin(*ENDS), "truncated")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    illegal = F.coalesce(~F.col("pair").isin(*LEGAL), F.lit(False))
    return placed.withColumn("fault", fault).select("conv_id", "turn", "place", "role", "text", "fault", code.alias("code"), illegal.alias("illegal"))


# --- the solver: one signature ---


def _choices(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, apart from inserts before it."""
    out = [("D", DELETE, state)]
    if code != GONE:
        own, more = code.lower(), TRUNCATED * code.isupper()
        if own == EXPECTED[state] or own == "s" and state == START:
            out.append(("K", more, AFTER[own]))
        out.append(("R", REROLE + more, AFTER[EXPECTED[state]]))
    return out


class _Solver:
    """The least cost of a signature's rest from each place and state, remembered."""

    def __init__(self, signature: str, rest: tuple[int, ...]) -> None:
        self.signature, self.rest = signature, rest
        self.best = cache(self._best)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * (INSERTS + 1) * len(signature) + 1000))
        for at in range(len(signature), -1, -64):  # from behind, so that the recursion stays shallow
            for state in range(4):
                self.best(at, state, INSERTS)

    def _best(self, at: int, state: int, inserts: int) -> tuple[int, str, int]:
        """(cost, letter, next state); of equal costs the least letter."""
        if at == len(self.signature):
            return self.rest[state], "", state
        options = [(cost + self.best(at + 1, to, INSERTS)[0], letter, to) for letter, cost, to in _choices(self.signature[at], state)]
        if inserts:
            to = AFTER[EXPECTED[state]]
            options.append((INSERT + self.best(at, to, inserts - 1)[0], "I", to))
        return min(options)

    def edits(self, state: int) -> tuple[list[str], int]:
        """For each row its letter, the new initial if that is R, and the initials of the roles inserted before it; the state at the end."""
        out, at, own, inserts = [], 0, "", INSERTS
        while at < len(self.signature):
            _, letter, to = self.best(at, state, inserts)
            if letter == "I":
                own, inserts = own + EXPECTED[state], inserts - 1
            else:
                out.append(letter + (EXPECTED[state] if letter == "R" else "") + own)
                at, own, inserts = at + 1, "", INSERTS
            state = to
        return out, state


def solve(signature: str) -> tuple[int, list[str], str]:
    """cost, edits by row and the initials inserted at the end, for a whole conversation."""
    solver = _Solver(signature, CLOSING)
    edits, end = solver.edits(START)
    return solver.best(0, START, INSERTS)[0], edits, CLOSED_BY[end]


def crossing(signature: str) -> list[int]:
    """The least costs of a piece from each state (row) to each state (column), 16 numbers."""
    columns = [_Solver(signature, tuple(0 if s == end else NEVER for s in range(4))) for end in range(4)]
    return [min(NEVER, c.best(0, state, INSERTS)[0]) for state in range(4) for c in columns]


# --- Spark ---

SOLVED = "array<struct<edits:array<string>,closing:string,end:int>>"
EDITED = "conv_id long, at long, edit string, role string, text string, turn long, fault string, illegal boolean, cost long"
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, piece, signature, last (of its conversation), from numbered rows."""
    number = F.floor(F.col("place") / piece).cast("long")
    codes = F.array_sort(F.collect_list(F.struct("place", "code")))  # no more than a piece's rows
    own = rows.groupBy("conv_id", number.alias("piece")).agg(F.array_join(F.transform(codes, lambda x: x["code"]), "").alias("signature"))
    return own.withColumn("last", F.col("piece") == F.max("piece").over(Window.partitionBy("conv_id")))


def _map_rows(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([fn(*r) for r in b.itertuples(index=False)], columns=names)

    return df.mapInPandas(run, schema)


def _chained(cut_up: DataFrame) -> DataFrame:
    """cut_up with rest: the least cost of what follows a piece, by the state there.

    Conversations of one piece have the closing costs. Of others each piece counts by 16
    numbers, so that a conversation's pieces are small together.
    """
    alone = F.col("last") & (F.col("piece") == 0)
    closing = F.array(*(F.lit(c).cast("long") for c in CLOSING))
    long = cut_up.where(~alone)
    crossings = _map_rows(long.select("signature").distinct(), lambda s: (s, crossing(s)), "signature string, costs array<long>")

    def chain(own: pd.DataFrame) -> pd.DataFrame:
        own, rest, out = own.sort_values("piece"), np.array(CLOSING), []
        for costs in own["costs"].to_numpy()[::-1]:
            out.append(rest.tolist())
            rest = np.minimum((np.asarray(costs).reshape(4, 4) + rest).min(1), NEVER)
        return own.drop(columns="costs").assign(rest=out[::-1])

    of_long = long.join(crossings, "signature").select("conv_id", "piece", "signature", "last", "costs").groupBy("conv_id").applyInPandas(chain, "conv_id long, piece long, signature string, last boolean, rest array<long>")
    return cut_up.where(alone).withColumn("rest", closing).unionByName(of_long)


def solved(cut_up: DataFrame) -> DataFrame:
    """conv_id, piece, solved: the edits of each piece by the state before it; a conversation's first begins with nothing."""
    chained = _chained(cut_up).withColumn("first", F.col("piece") == 0)
    key = ("signature", "rest", "last", "first")

    def one(signature: str, rest: np.ndarray, last: bool, first: bool) -> tuple:
        solver = _Solver(signature, tuple(int(x) for x in rest))
        found = [solver.edits(state) for state in range(1 if first else 4)]
        return signature, rest, last, first, [{"edits": edits, "closing": CLOSED_BY[end] if last else "", "end": end} for edits, end in found]

    by_signature = _map_rows(chained.select(*key).distinct(), one, f"signature string, rest array<long>, last boolean, first boolean, solved {SOLVED}")
    return chained.join(by_signature, list(key)).select("conv_id", "piece", "solved")


def repair(conversations: DataFrame, conv_ids: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """The edits of each conversation as rows, in order: edit (K, R, D or I) with the role and text that it leaves.

    conversations: conv_id, turn, role, text; conv_ids: conversations to list though they may
    have no rows, each of which gives one row without an edit then. Deleted rows have no role and
    text; inserted ones no turn and fault. fault and illegal (the pair with the row before) describe
    the row as it was. A conversation's rows come in order, all in one partition; only a
    stored copy would have to be sorted again, by conv_id and at.
    """
    prepare(conversations.sparkSession)
    rows = written(numbered(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")))
    edits = solved(cut(pieces(rows, piece)))
    columns = {"turn": "long", "role": "string", "text": "string", "fault": "string", "illegal": "boolean", "solved": SOLVED}
    align = lambda df, kind, place: df.select("conv_id", place.cast("long").alias("place"), F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items()))
    both = align(edits, 1, F.col("piece") * piece).unionByName(align(rows, 2, F.col("place")))
    if conv_ids is not None:
        both = both.unionByName(align(conv_ids.select(F.col("conv_id").cast("long")).distinct(), 0, F.lit(0)))
    return stream(both.repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind"), _replayed, EDITED)


def _replayed(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv_id, own in groupby(rows, key=lambda r: r[0]):
        state, edits, closing, at = START, [], "", 0
        for _, _, kind, turn, role, text, fault, illegal, alternatives in own:
            if kind == 1:
                found = alternatives[state if len(alternatives) > 1 else 0]
                state, edits, closing = found["end"], iter(found["edits"]), found["closing"]
            elif kind == 2:
                edit = next(edits)
                letter, new = edit[0], edit[1:2]
                for initial in edit[2:] if letter == "R" else edit[1:]:
                    yield conv_id, at, "I", ROLES[initial], "", None, None, None, INSERT
                    at += 1
                more = TRUNCATED if fault == "truncated" else 0
                left, cost = {"K": ((role, text), more), "R": ((ROLES.get(new), text), REROLE + more), "D": ((None, None), DELETE)}[letter]
                yield conv_id, at, letter, *left, turn, fault, illegal, cost
                at += 1
        for initial in closing:
            yield conv_id, at, "I", ROLES[initial], "", None, None, None, INSERT
            at += 1
        if not at:
            yield conv_id, 0, None, None, None, None, None, None, 0


def audits(edited: DataFrame) -> DataFrame:
    """What repair() found in each conversation and did to it, with the digest of its repaired rows; edited comes straight from repair()."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, own in groupby(rows, key=lambda r: r[0]):
            faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
            illegal, cost, audit, repaired, empty = 0, 0, [], hashlib.sha256(), True
            low, high, distinct = None, None, 0
            for _, _, edit, role, text, turn, fault, bad, price in own:
                cost += price
                audit.append(edit or "")
                illegal += bool(bad)
                if fault:
                    faults[fault] += 1
                if turn is not None and turn != high:  # turns come in order
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
                if edit in ("K", "R", "I"):
                    repaired.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            gaps = high - low + 1 - distinct if distinct else 0
            yield conv_id, gaps, *faults.values(), illegal, cost, "".join(audit), repaired.hexdigest()

    return stream(edited, run, AUDITS)
