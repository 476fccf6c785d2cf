"""Operator 13: alignment of two tokenizers' tokens by the bytes they stand for.

A text's B tokens are a static interval index: their byte ranges, sorted. Each A token asks it, by bisection, for the first
and the last B token that its own range stabs; the byte offsets that no token of either side spans cut both lists into groups.

Both tokenizers break before a space or line feed that follows a character other than white space, and between a letter and a sign,
whatever stands around (checked on the vocabulary), so a text is a sequence of segments whose alignments are computed apart: a worker
aligns each distinct segment that it meets once, within a bound.

How many documents hold an id pair linked is counted over all documents: partial counts in the tasks, then a shuffle by pair.
The pairs of the highest counts, `frequent` of them at most, since counts add up to a known total, are sent to the tasks that
look them up; the links of all other pairs find their counts by a join.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, stored, texts, tune, utf8

#: A pair of ids in one number: A's id times this, plus B's.
SIDE = 1 << 20
#: Letters and digits, and the signs but the apostrophe, which belongs to word ends: no piece has one of the first before one of the second.
LETTERS, SIGNS = "0-9A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: Segments end before a space or line feed after another character than white space, and between a letter or digit and a sign.
SEGMENT = re.compile(rf"(?=[\s\S])\s*+(?:[{LETTERS}]++(?![{SIGNS} \n])|[^{LETTERS}\s]|[^\S \n]\s*+)*+(?:[{LETTERS}]++)?+")
#: Segments beyond this length are aligned each time they occur.
KEPT_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def overlaps(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first B token that overlaps each A token, how many do, and the ends that both sides share; the lengths cover the same bytes."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    first = np.searchsorted(b_end, a_end - a_len, "right")
    last = np.searchsorted(b_end - b_len, a_end, "left")
    return first, last - first, np.intersect1d(a_end, b_end, assume_unique=True)


def within(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each entry, n long, one after the other."""
    total = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(first - total[:-1], n) + np.arange(total[-1])


class Bytes:
    """A byte string for each id."""

    def __init__(self, values: list[bytes]):
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.starts, self.pool = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(values), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[within(self.starts[ids], self.sizes[ids])]

    def give(self, ids: np.ndarray, n: np.ndarray, want: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts, the bytes `want` from at[i] on, their n[i] ids give back."""
        have, to = self.of(ids), np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(n)])]
        if np.array_equal(to, at) and np.array_equal(have, want):
            return np.ones(len(n), bool)
        return np.array([np.array_equal(have[to[i] : to[i + 1]], want[at[i] : at[i + 1]]) for i in range(len(n))], bool)


class Aligner:
    """Segments with their alignments, each computed once while it is kept: `limit` at most, of about 300 bytes each."""

    _of: dict[tuple, "Aligner"] = {}

    @classmethod
    def at(cls, a_path: str, b_path: str, limit: int) -> "Aligner":
        key = (a_path, b_path, limit)
        if key not in cls._of:
            cls._of[key] = cls(*key)
        return cls._of[key]

    def __init__(self, a_path: str, b_path: str, limit: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in self.a.get_vocab().items()}
        self.a_bytes = Bytes([vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        crosses = re.compile(rf"[^▁]▁|\n|[{LETTERS}][{SIGNS}]").search
        if any(crosses(p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))) or len(self.b.encode("\n")) != 2:
            raise ValueError("a piece of the second tokenizer goes on beyond a segment's end")
        self.b_bytes = Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = Bytes([str(i).encode() for i in range(max(len(self.a_bytes.sizes), len(pieces)))])
        if len(self.digits.sizes) > SIDE:
            raise ValueError(f"token ids of {SIDE} or more")
        self.limit = limit
        self.known: dict[str, int] = {}
        self.long: list[str] = []  # the last ones entered, to be forgotten by the next call of find
        self.groups: list[bytes] = []
        self.sizes = np.zeros((1024, 4), np.int64)  # tokens of A, tokens of B, groups, links; -1 where the bytes differ
        self.at_pair = np.zeros(1025, np.int64)
        self.pairs = np.zeros(4096, np.int64)

    def ids_of(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """B puts a space before a text; a line feed keeps it apart, and both tokens go."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return a, [i[2:] for i in self.b.encode(["\n" + s for s in segments], num_threads=1)]

    def add(self, segments: list[str]) -> None:
        """Align new segments, all at once: one after the other they are one long text."""
        x, y = self.ids_of(segments)
        want, at = utf8(pa.array(segments, pa.large_string()))
        n_a, n_b = np.fromiter(map(len, x), np.int64), np.fromiter(map(len, y), np.int64)
        a, b = np.fromiter(itertools.chain.from_iterable(x), np.int64), np.fromiter(itertools.chain.from_iterable(y), np.int64)
        good = self.a_bytes.give(a, n_a, want, at) & self.b_bytes.give(b, n_b, want, at)
        if not good.all():
            a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], np.where(good, n_a, 0), np.where(good, n_b, 0)
        a_len, b_len = self.a_bytes.sizes[a], self.b_bytes.sizes[b]
        first, n, cuts = overlaps(a_len, b_len)
        pairs = np.repeat(a, n) * SIDE + b[within(first, n)]
        a_at = np.concatenate([[0], np.cumsum(n_a)])
        ends = np.searchsorted(cuts, np.concatenate([[0], np.cumsum(a_len)])[a_at], "right")
        self._write(a, b, a_len, b_len, cuts, ends)
        m, k = len(self.groups) - len(segments), len(segments)
        while m + k > len(self.sizes):
            self.sizes = np.append(self.sizes, np.zeros_like(self.sizes), 0)
            self.at_pair = np.append(self.at_pair, np.zeros(len(self.at_pair) - 1, np.int64))
        n_links = np.diff(np.concatenate([[0], np.cumsum(n)])[a_at])
        self.sizes[m : m + k] = np.stack([n_a, n_b, np.diff(ends), n_links], 1)
        self.sizes[m : m + k][~good] = -1
        used = int(self.at_pair[m])
        self.at_pair[m + 1 : m + k + 1] = used + np.cumsum(n_links)
        while used + len(pairs) > len(self.pairs):
            self.pairs = np.append(self.pairs, np.zeros_like(self.pairs))
        self.pairs[used : used + len(pairs)] = pairs
        self.known.update(zip(segments, range(m, m + k), strict=True))

    def _write(self, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> None:
        """The groups of each segment as text, `a1,a2|b1` by `;`; `ends` counts the groups before each segment's begin and end."""
        place, marks = [], []
        for side, size, last in ((0, a_len, b"|"), (1, b_len, b";")):
            end = np.cumsum(size)
            group = np.searchsorted(cuts, end)
            place.append(2 * group + side)
            marks.append(np.where(cuts[group] == end, last[0], ord(",")).astype(np.uint8) if len(cuts) else np.zeros(0, np.uint8))
        order = np.argsort(np.concatenate(place), kind="stable")
        ids, mark, place = np.concatenate([a, b])[order], np.concatenate(marks)[order], np.concatenate(place)[order]
        size = self.digits.sizes[ids] + 1
        stop = np.cumsum(size)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
        spots = np.ones(len(out), bool)
        spots[stop - 1] = False
        out[stop - 1] = mark
        out[spots] = self.digits.of(ids)
        raw, at = out.tobytes(), np.concatenate([[0], stop])[np.searchsorted(place, 2 * ends)].tolist()
        self.groups += [raw[i : max(i, j - 1)] for i, j in zip(at, at[1:], strict=False)]

    def find(self, segments: list[str]) -> list[int]:
        """The entries of segments, valid until the next call. New ones are entered; the youngest half goes when there are too many."""
        if self.long:
            for segment in self.long:
                del self.known[segment]
            del self.groups[len(self.known) :]
            self.long = []
        found = list(map(self.known.get, segments))
        if None in found:
            new = list(dict.fromkeys(s for s, i in zip(segments, found, strict=True) if i is None))
            if len(self.known) + len(new) > self.limit and len(self.known) > self.limit // 2:
                self.shrink(self.limit // 2)
                return self.find(segments)
            self.long = [s for s in new if len(s) > KEPT_CHARS]
            self.add([s for s in new if len(s) <= KEPT_CHARS] + self.long)
            found = [self.known[s] if i is None else i for s, i in zip(segments, found, strict=True)]
        return found

    def shrink(self, keep: int) -> None:
        """Keep the `keep` segments met first: they tend to be frequent."""
        self.known = {s: i for s, i in self.known.items() if i < keep}
        del self.groups[keep:]

    def align(self, parts: Iterator[list[int]], with_groups: bool = False) -> tuple[np.ndarray, str, np.ndarray, np.ndarray, str | None]:
        """Of a text as entries, part by part: sizes, SHA-256 of the groups, the distinct pairs with their numbers of links, and the groups."""
        sizes, digest, held, written = np.zeros(4, np.int64), hashlib.sha256(), [], []
        for k, entries in enumerate(parts):
            at = np.array(entries, np.int64)
            s = self.sizes[at]
            if s.min() < 0:
                sizes[:] = 0
                break
            sizes += s.sum(0)
            groups = b";".join(map(self.groups.__getitem__, entries))
            digest.update(b";" + groups if k else groups)
            if with_groups:
                written.append(groups.decode())
            n = s[:, 3]
            held.append(np.unique(self.pairs[within(self.at_pair[at], n)], return_counts=True))
        if not sizes[0]:
            return sizes, "", np.zeros(0, np.int64), np.zeros(0, np.int64), "" if with_groups else None
        pairs, counts = held[0] if len(held) == 1 else merged(held)
        return sizes, digest.hexdigest(), pairs, counts, ";".join(written) if with_groups else None

    def align_many(self, texts: list[str], with_groups: bool = False, at_once: int = 1 << 20) -> Iterator[tuple]:
        """`align` of each text; new segments of many short texts are entered together, a long text goes part by part."""
        held: list[list[str]] = []
        size = 0

        def flush() -> Iterator[tuple]:
            entries, at = self.find([s for segments in held for s in segments]), 0
            for segments in held:
                yield self.align([entries[at : at + len(segments)]] if segments else [], with_groups)
                at += len(segments)

        for text in texts:
            if size + len(text) > at_once and held:
                yield from flush()
                held, size = [], 0
            if len(text) > at_once:
                yield self.align(map(self.find, self.parts(text, at_once)), with_groups)
                continue
            held.append(SEGMENT.findall(" " + text) if text else [])
            size += len(text)
        yield from flush()

    @staticmethod
    def parts(text: str, size: int) -> Iterator[list[str]]:
        """The segments of a text in lists of about `size` characters."""
        held, n = [], 0
        for m in SEGMENT.finditer(" " + text):
            held.append(m.group())
            n += len(held[-1])
            if n >= size:
                yield held
                held, n = [], 0
        if held:
            yield held


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key of (keys, numbers) lists."""
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, where, np.concatenate([p[1] for p in parts]))
    return keys, out


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, links array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", kept: int = 500_000, with_groups: bool = False) -> DataFrame:
    """Each row's tokens aligned, with its distinct id pairs (`pairs`) and their numbers of links (`links`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        aligner = Aligner.at(a_path, b_path, kept)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            done = zip(ids, aligner.align_many(texts(batch.column(1)), with_groups), strict=True)
            while rows := [(i, *r) for i, r in itertools.islice(done, 500)]:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.stack([r[1] for r in rows])
        columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array(sizes[:, k]) for k in range(4)), pa.array([r[2] for r in rows]), pa.array([r[5] for r in rows], pa.string()), lists([r[3] for r in rows], pa.int64()), lists([r[4] for r in rows], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ALIGNED)


def held_pairs(rows: DataFrame, at_once: int = 1 << 22) -> DataFrame:
    """(pair, n): in how many rows each pair stands, summed in the tasks first; a task holds about twice `at_once` pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = [], []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if held:
                sums.append(np.unique(np.concatenate(held), return_counts=True))
                held.clear()
            if sums and (last or sum(len(s[0]) for s in sums) > at_once):
                keys, n = merged(sums)
                sums.clear()
                if last or len(keys) > at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
                else:
                    sums.append((keys, n))

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            if sum(map(len, held)) > at_once:
                yield from flush(False)
        yield from flush(True)

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def cross_tokenizer(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", frequent: int = 1 << 22, kept: int = 500_000, with_groups: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and `groups` on request.

    A link is a pair of an A and a B token whose byte ranges overlap; its count is the number of rows that hold its id pair
    linked. n_best: links whose count is the highest of their A id; count_sum: the counts of all links, added up.
    Null and empty texts, and those that the tokens of a side do not give back byte for byte, have zeros and an empty digest.
    Repeated rows count and stay each, a null doc_id stays null; other columns of docs are not read. An empty table gives none.
    frequent: how many pairs a task may hold with their counts; kept: how many distinct segments a worker keeps aligned.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = stored(aligned(docs, a_path, b_path, text, doc_id, kept, with_groups).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(held_pairs(rows), "pairs")
    best = counts.groupBy(F.shiftright("pair", 20).alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A
    counted = counts.withColumn("a", F.shiftright("pair", 20)).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    counted = stored(counted, "counted")
    discard(counts)
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = total // frequent  # fewer than `frequent` pairs can have more
    top = counted.filter(F.col("n") > least).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast((top.column("pair").to_numpy()[order], top.column("n").to_numpy()[order], top.column("best").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, is_best = sent.value
        for batch in batches:
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            pairs, links = batch.column("pairs").flatten().to_numpy(), batch.column("links").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sums, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(sums, owner[hit], links[hit] * n[at[hit]])
            np.add.at(bests, owner[hit], links[hit] * is_best[at[hit]])
            left = [np.zeros(0, np.int64)] * len(sizes) if hit.all() else np.split(pairs[~hit], np.cumsum(np.bincount(owner[~hit], minlength=len(sizes)))[:-1])
            more = [np.zeros(0, np.int64)] * len(sizes) if hit.all() else np.split(links[~hit], np.cumsum(np.bincount(owner[~hit], minlength=len(sizes)))[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(bests), pa.array(sums), lists(left, pa.int64()), lists(more, pa.int64())], ["row", "n_best", "count_sum", "pairs", "links"])

    schema = "row long, n_best long, count_sum long, pairs array<long>, links array<long>"
    looked = rows.select("row", "pairs", "links").mapInArrow(look_up, schema)
    kept_columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    if not counted.filter(F.col("n") <= least).isEmpty():
        looked = stored(looked, "looked")
        rare = looked.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("k"))
        rest = rare.join(counted.filter(F.col("n") <= least), "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
        looked = looked.drop("pairs", "links").join(rest, "row", "left").select("row", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
    return rows.drop("pairs", "links").join(looked.select("row", "n_best", "count_sum"), "row").select(*kept_columns)
