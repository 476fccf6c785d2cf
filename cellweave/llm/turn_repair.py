"""Operator 12: repair of a conversation's turn structure by error-correcting Earley parsing.

A weighted grammar says which roles may follow each other; error productions delete a turn, give it another role or insert an empty one. A
chart item keeps the cheapest way to it, cost and audit (the initials of its edits). The completed chart yields the repair.

The grammar is left-recursive, so every item begins before the first turn, and a column of the chart has a few items however long the
conversation is: turns stream through in order, and an item carries the digest of its repair so far instead of the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, spread_join, stored, tune

#: C is empty or turns; turns are (ua)+ after at most one s. Nonterminals stand first in a rule only.
GRAMMAR = (("C", ()), ("C", ("T",)), ("T", ("u", "a")), ("T", ("s", "u", "a")), ("T", ("T", "u", "a")))
NAMES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
WHITE = " \t\n\x0b\x0c\r"
KEEP, DROP, CUT = "good", "drop", "cut"
LEGAL = {"su", "ua", "au"}
BLOCK = 4096


class Column(NamedTuple):
    """The items over the turns so far, what each costs beyond the cheapest, and the rank of its audit among theirs."""

    items: tuple[tuple[int, int], ...]
    costs: tuple[int, ...]
    ranks: tuple[int, ...]


class Way(NamedTuple):
    """What leads on to an item: cost, rank of the audit it goes on from, the edits added, and the roles they write (None: the turn as it is)."""

    cost: int
    rank: int
    edits: str
    roles: tuple[str | None, ...]


def _closure(column: Column) -> dict[tuple[int, int], Way]:
    """The items of a column with their completions and insertions. Everything begins before the first turn, so a completed
    nonterminal goes on in the rules that begin with it."""
    found = {item: Way(c, k, "", ()) for item, c, k in zip(*column, strict=True)}
    agenda = list(found)
    while agenda:
        r, dot = item = agenda.pop()
        way, (left, right) = found[item], GRAMMAR[r]
        new = []
        if dot == len(right):
            new = [((q, 1), way) for q, (_, body) in enumerate(GRAMMAR) if body and body[0] == left]
        elif right[dot] in NAMES:
            new = [((r, dot + 1), Way(way.cost + INSERT, way.rank, way.edits + "I", (*way.roles, "I" + right[dot])))]
        for other, w in new:
            if other not in found or w[:3] < found[other][:3]:
                found[other] = w
                agenda.append(other)
    return found


@lru_cache(1 << 14)
def _scan(column: Column, initial: str, fault: str) -> tuple[Column, tuple[Way, ...], int]:
    """The next column over a turn, the way to each of its audits by rank, and what the cheapest item costs. fault: KEEP, CUT or DROP, which must be deleted.

    No audit of a column begins with another one, as all have an edit for each turn and end with it: so ranks decide, and
    equal ranks by what is added."""
    best: dict[tuple[int, int], Way] = {}
    more = TRUNCATED if fault == CUT else 0
    for (r, dot), (cost, rank, edits, roles) in _closure(column).items():
        right = GRAMMAR[r][1]
        ways = [((r, dot), Way(cost + DELETE, rank, edits + "D", roles))]
        if fault != DROP and dot < len(right):
            want = right[dot]
            if want == initial:
                ways.append(((r, dot + 1), Way(cost + more, rank, edits + "K", (*roles, None))))
            elif want in NAMES:
                ways.append(((r, dot + 1), Way(cost + REROLE + more, rank, edits + "R", (*roles, "R" + want))))
        for item, way in ways:
            if item not in best or way[:3] < best[item][:3]:
                best[item] = way
    hows = sorted({w[1:] for w in best.values()}, key=lambda h: h[:2])
    rank = {h[:2]: k for k, h in enumerate(hows)}
    least = min(w.cost for w in best.values())
    column = Column(tuple(best), tuple(w.cost - least for w in best.values()), tuple(rank[w[1:3]] for w in best.values()))
    return column, tuple(Way(0, *h) for h in hows), least


#: The items that wait for a turn before the first one.
START = Column(*zip(*[((r, 0), 0, 0) for r, (_, right) in enumerate(GRAMMAR) if not right or right[0] not in {left for left, _ in GRAMMAR}], strict=True))


class Parser:
    """A conversation's chart, column by column; for each audit its blocks and tail, the digest of the repair, and whether that has turns."""

    def __init__(self):
        self.column, self.base = START, 0
        self.kept = [(None, "", hashlib.sha256(), False)]

    def row(self, role: str, text: str, fault: str) -> None:
        self.column, ways, least = _scan(self.column, role[:1], fault)
        self.base += least
        self.kept = [self._go(w, role, text) for w in ways]

    def _go(self, way: Way, role: str = "", text: str = "") -> tuple:
        blocks, tail, digest, some = self.kept[way.rank]
        tail += way.edits
        if len(tail) >= BLOCK:
            blocks, tail = (blocks, tail), ""
        if way.roles:
            digest = digest.copy()
            for r in way.roles:
                line = f"{role}:{text}" if r is None else f"{NAMES[r[1]]}:" + (text if r[0] == "R" else "")
                digest.update((("\n" if some else "") + line).encode())
                some = True
        return blocks, tail, digest, some

    def end(self) -> tuple[int, str, str]:
        """Cost and audit of the cheapest repair, and the SHA-256 of its text."""
        done = [way for (r, dot), way in _closure(self.column).items() if GRAMMAR[r][0] == "C" and dot == len(GRAMMAR[r][1])]
        way = min(done, key=lambda w: w[:3])
        blocks, tail, digest, _ = self._go(way)
        parts = [tail]
        while blocks:
            blocks, part = blocks
            parts.append(part)
        return self.base + way.cost, "".join(reversed(parts)), digest.hexdigest()


def replay(rows: list[tuple[str, str]], audit: str) -> list[str]:
    """The repaired turns, `role:text`, of rows under an audit."""
    out, before, at = [], "", 0
    for edit in audit:
        if edit != "I":
            role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "K":
            out.append(f"{role}:{text}")
            before = role[:1]
        else:
            before = "a" if before == "u" else "u"
            out.append(f"{NAMES[before]}:" + (text if edit == "R" else ""))
    return out


RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<string>"


class Conversation:
    def __init__(self, conv_id, with_turns: bool):
        self.conv_id, self.parser, self.rows = conv_id, Parser(), [] if with_turns else None
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        again = again or self.before == (turn, role, text)
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in LEGAL
        self.before = (turn, role, text)
        solid = text.rstrip(WHITE)
        fault = KEEP
        if not solid:
            self.blank, fault = self.blank + 1, DROP
        elif again:
            self.duplicate, fault = self.duplicate + 1, DROP
        elif solid[-1] not in ".!?":
            self.truncated, fault = self.truncated + 1, CUT
        self.parser.row(role, text, fault)
        if self.rows is not None:
            self.rows.append((role, text))

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, digest = self.parser.end()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest, None if self.rows is None else replay(self.rows, audit)


def repair(turns: DataFrame, gone: str | None = None, with_turns: bool = False) -> DataFrame:
    """A row for each conv_id of turns(conv_id, turn, role, text): gaps, faults by kind, cost and audit of the cheapest repair, its SHA-256, and `repaired`, the turns, on request.

    A conversation's turns are taken by turn (null first), those of one turn by role and text. Null role or text is one space. A turn's first fault counts: blank; duplicate of an earlier one (role and text);
    truncated (its last character but white space is none of . ! ?). Blank and duplicate turns must be deleted. A null conv_id is a conversation as any
    other; rows whose column `gone` is true only make their conversation appear: without other rows it has zeros, an empty audit and the digest of an
    empty text. Roles go by their first letter; one without a place in the grammar gets another or goes. Repeated rows are duplicates. Other columns are not read. An empty table gives none.

    A recurring turn is found by grouping 128-bit digests of conversation, role and text over all rows; copies of one turn are no single key of the join.
    A conversation then streams through one task, sorted: a digest is sequential. The task holds a column of the chart and the audit (a letter for each edit), unless the turns are asked for.
    """
    tune(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    rows = rows.withColumn("h", F.unhex(F.md5(F.concat(sized("role"), sized("text"), conv))))
    seen = rows.filter("not gone").groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
    again = stored(seen.filter("n > 1"), "turns-again")
    total = again.agg(F.sum("n")).first()[0] or 0
    marked = spread_join(rows, again, ["h"], "n", total, ["conv_id", "turn"], "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    dealt = marked.select("conv_id", "turn", "role", "text", "gone", later.alias("again")).repartition("conv_id")
    order = [F.asc_nulls_first("conv_id"), F.asc("gone"), F.asc_nulls_first("turn"), "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        now, done = None, []
        for batch in batches:
            for conv_id, turn, role, text, is_gone, is_again in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id, with_turns)
                if not is_gone:
                    now.add(turn, role, text, is_again)
            if len(done) >= 500:
                yield packed(done)
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield packed(done)

    types = [pa_type(kind), *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.string())]
    names = [c.split()[0] for c in RESULT.format(kind).split(", ")]

    def packed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    out = dealt.sortWithinPartitions(*order).mapInArrow(run, RESULT.format(kind))
    return out if with_turns else out.drop("repaired")


def pa_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]
