import hashlib
import itertools
import random
import re
import zlib

import pytest
from duelframe.llm import repair as R
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(codes):
    """(cost, audit, roles inserted or changed) by trying edits in order of cost: uniform-cost search over whole scripts."""
    best = {}
    frontier = [(0, "", "", 0)]
    while frontier:
        cost, audit, roles, at = frontier.pop(frontier.index(min(frontier)))
        state = (at, roles if len(roles) < 2 else roles[:1].replace("u", "").replace("a", "") + roles[-1])
        if state in best and best[state] < (cost, audit):
            continue
        if at == len(codes) and PATTERN.fullmatch(roles):
            return cost, audit, roles
        best.setdefault(state, (cost, audit))
        prefix = lambda x: re.fullmatch(r"s?(ua)*u?", x)
        for new in "ua":
            if prefix(roles + new) and audit[-2:] != "II":
                frontier.append((cost + 3, audit + "I", roles + new, at))
        if at < len(codes):
            c, more = codes[at].lower(), 3 * codes[at].isupper()
            frontier.append((cost + 4, audit + "D", roles, at + 1))
            if c != "x":
                if c != "o" and prefix(roles + c):
                    frontier.append((cost + more, audit + "K", roles + c, at + 1))
                frontier += [(cost + 3 + more, audit + "R", roles + new, at + 1) for new in "ua" if prefix(roles + new)]
    raise AssertionError


@pytest.mark.parametrize("length", range(5))
def test_signatures_equal_a_search_over_scripts(length):
    every = ["".join(c) for c in itertools.product("suaUAxoO", repeat=length)]
    for codes in every if len(every) < 600 else random.Random(1).sample(every, 400):
        cost, edits, closing = R.solve(codes)
        audit = "".join("I" * len(e[1 + (e[0] == "R") :]) + e[0] for e in edits) + "I" * len(closing)
        assert (cost, audit) == cheapest(codes)[:2], codes


def brute(rows, listed):
    """The contract, literally: damaged rows to one result row for each listed conversation."""
    out = []
    for conv in listed:
        own = [(None if t == (0, 0) else t[1], role, text) for t, role, text in sorted(((0, 0) if t is None else (1, t), role or " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv)]
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in own:
            kept = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        codes = "".join("x" if f in ("blank", "duplicate") else (i if i in ("s", "u", "a") else "o").upper() if f == "truncated" else i if i in ("s", "u", "a") else "o" for i, f in zip(initials, faults, strict=True))
        cost, audit, roles = cheapest(codes)
        lines, at, rest = [], 0, list(roles)
        for letter in audit:
            name = None if letter == "D" else {"u": "user", "a": "assistant", "s": None}[rest.pop(0)]
            if letter == "I":
                lines.append(f"{name}:")
            else:
                if letter != "D":
                    lines.append(f"{own[at][1] if letter == 'K' else name}:{own[at][2]}")
                at += 1
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            new = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text)
            out += [new] * (2 if kind == 3 else 1)
    return out


@pytest.fixture(scope="module")
def talks():
    r = random.Random(2)
    said = ["Yes.", "No!", "cut", "", " \t", "Why?  ", "é.", "a\n", None]
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "éa", None]), r.choice(said)) for c in range(120) for t in range(r.randint(1, 7))]
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "none."), (500, None, None, None), (501, 3, "user", "x." * 100_000), rows[0], rows[0]]
    return rows


def test_contract_equals_brute_force(spark, talks):
    df = spark.createDataFrame(talks, SCHEMA).repartition(3, "text").selectExpr("*", "1 AS place", "2 AS piece", "'z' AS fault", "3 AS copy", "4 AS kind")
    got = R.audits(R.repair(R.damaged(df), df)).collect()
    assert sorted(map(tuple, got), key=str) == brute(damaged(talks), {r[0] for r in talks})


@pytest.mark.parametrize("piece", [1, 2, 3])
def test_pieces_of_long_conversations_chain_exactly(spark, talks, piece):
    df = spark.createDataFrame(talks, SCHEMA)
    got = R.audits(R.repair(df, piece=piece)).collect()
    assert sorted(map(tuple, got), key=str) == brute(talks, {r[0] for r in talks})


def test_edits_are_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", ""), (1, 5, "tool", "cut")]
    edits = R.repair(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1,), (9,)], "conv_id long")).collect()
    assert [(r.edit, r.role, r.text, r.fault, r.cost) for r in sorted(edits, key=lambda r: (r.conv_id, r.at))] == [
        ("K", "system", "Be kind.", None, 0), ("I", "user", "", None, 3), ("K", "assistant", "Hi.", None, 0), ("D", None, None, "blank", 4), ("D", None, None, "truncated", 4), (None, None, None, None, 0),
    ]
    empty = spark.createDataFrame([], SCHEMA)
    assert R.audits(R.repair(R.damaged(empty), empty)).collect() == []


def test_a_hot_conversation_in_pieces(spark):
    hot = spark.range(12_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 1, "assistant").otherwise("user").alias("role"), F.format_string("turn %d.", "id").alias("text"))
    row = R.audits(R.repair(hot)).first()
    cost, edits, closing = R.solve("uau" * 4000)
    assert row.cost == cost and row.audit == "".join("I" * len(e[1 + (e[0] == "R") :]) + e[0] for e in edits) + "I" * len(closing) and row.illegal == 3999
