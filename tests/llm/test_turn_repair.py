"""Repair of turns against a plain search over edits."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pandas as pd
import pytest

from cellweave.llm.queries import damaged, op12_turn_repair, oracle_sql
from cellweave.llm.turn_repair import BLOCK, Parser, repair, replay

SF = "/root/testdata/sf0.001"
ROLES = {"u": "user", "a": "assistant"}
#: state: letter -> state, for (s?(ua)+)?; 0 and 3 accept.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def search(rows):
    """The cheapest edits of rows (role, text, fault), ties by audit: cost, audit, repaired turns."""
    heap, seen = [(0, "", 0, 0, [])], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, out
        if (at, state) in seen:
            continue
        seen.add((at, state))
        for letter, to in NEXT[state].items():
            if letter in ROLES:
                heapq.heappush(heap, (cost + 3, audit + "I", at, to, [*out, ROLES[letter] + ":"]))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            for letter, to in NEXT[state].items() if fault in ("good", "cut") else ():
                more = 3 if fault == "cut" else 0
                if letter == role[:1]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, [*out, f"{role}:{text}"]))
                elif letter in ROLES:
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, to, [*out, f"{ROLES[letter]}:{text}"]))


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(rows):
    """Every column of the contract for one conversation's rows (turn, role, text), in order."""
    faults, seen, n = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else "good"
        seen.add((role, text))
        if fault != "good":
            n["truncated" if fault == "cut" else fault] += 1
        faults.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = search(faults)
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha(out)


def broken(rows):
    """The damage of the contract on rows (conv, turn, role, text), in plain Python."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 1:
            text = ""
        elif how == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif how == 4:
            role = "user"
        mine += [] if how == 0 else [(turn, role, text)] * (2 if how == 3 else 1)
    return {c: plain(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, r in out.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_chart_against_search():
    rng = random.Random(7)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " ", ""]), rng.choice("xyz"), rng.choice(["good", "good", "cut", "drop"])) for _ in range(rng.randint(0, 9))]
        parser = Parser()
        for r in rows:
            parser.row(*r)
        cost, audit, out = search(rows)
        assert parser.end() == (cost, audit, sha(out))
        assert replay([r[:2] for r in rows], audit) == out


def test_long_conversation():
    parser = Parser()
    for k in range(3 * BLOCK):
        parser.row(("user", "assistant")[k % 2], f"text {k}.", "good")
    parser.row("user", "last.", "good")
    cost, audit, digest = parser.end()
    assert (cost, audit) == (3, "K" * (3 * BLOCK + 1) + "I")
    assert digest == sha([f"{('user', 'assistant')[k % 2]}:text {k}." for k in range(3 * BLOCK)] + ["user:last.", "assistant:"])


def test_query(spark):
    got = by_conversation(op12_turn_repair(spark, SF))
    rows = pd.read_parquet(f"{SF}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
    assert got == broken(list(rows.itertuples(index=False, name=None)))


def test_sql(spark):
    """The query's SQL gives the same rows, nulls and hard texts included."""
    rng = random.Random(8)
    rows = [(None, None, None, None), (1, None, "user", None), (1, 2, None, "x. \n")]
    rows += [(rng.randint(2, 12), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", " \t", "é!\x0b", "line\nline?", "wait..."])) for _ in range(70)]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("frame", conversations)
    con.execute("CREATE TABLE conversations AS SELECT * FROM frame")
    want = {r[0]: r[1:] for r in con.execute(oracle_sql()["op12_turn_repair"]).fetchall()}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert by_conversation(repair(damaged(df), gone="gone")) == want


def test_hard_rows(spark):
    """Nulls everywhere, repeated rows, other initials, a hot conversation with one text many times, and clashing names."""
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (5, None, "user", "a."), (5, None, "user", "a."), (6, 2, None, "x"), (7, 3, "user", None), (8, 4, "tool", "t.")]
    rows += [(9, k % 50 if k % 7 else None, rng.choice(["user", "assistant", "system", "umpire"]), rng.choice(["same.", "same.", f"other {k}", "", " ", "é!"])) for k in range(400)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema + ", h int, again string").repartition(3)
    assert by_conversation(repair(damaged(df), gone="gone")) == broken(rows)
    turns = {r.conv_id: r for r in repair(damaged(df), gone="gone", with_turns=True).collect()}
    assert all(sha(r.repaired) == r.repaired_sha256 for r in turns.values())
    assert repair(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("conv", [0, 1])
def test_dropped_conversation(spark, conv):
    """All rows gone: zeros, an empty audit and the digest of nothing."""
    df = spark.createDataFrame([(conv, 1, "user", "x.", True)], "conv_id int, turn int, role string, text string, gone boolean")
    assert by_conversation(repair(df, gone="gone")) == {conv: (0, 0, 0, 0, 0, 0, "", sha([]))}
