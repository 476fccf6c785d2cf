"""Exact removal of long repeated byte strings by a sampled suffix array with deep-shallow sorting.

Suffixes are sampled where :mod:`.windows` puts the key of a window, so a repeated string has a sampled suffix at the
same place in each copy. The suffixes to the right of a key, and the reversed ones to its left, are sorted by multikey
quicksort over 8-byte characters to a shallow depth; groups that still agree there have long common prefixes, which blind
tries order. Neighbours' common prefixes on both sides then tell every window that occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import windows
from .common import texts

SHALLOW = 32


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> list[tuple[int, int]]:
    """Numbers of the strings in sorted order, each with the length of its prefix in common with the one before (0 for the first).

    A node keeps a depth and one branch for each next byte (-1 at an end), no text: a string goes down blindly to some
    leaf, one comparison with that leaf's string gives the depth of the difference, and the branch is put there.
    """
    root: list | tuple = ([0], len(strings[0]))  # a leaf: numbers of equal strings, their length
    for i in range(1, len(strings)):
        s = strings[i]
        node, path = root, []
        while isinstance(node, list):
            c = s[node[0]] if node[0] < len(s) else -1
            if c not in node[1]:
                c = next(iter(node[1]))
            path.append((node, c))
            node = node[1][c]
        other = strings[node[0][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[0].append(i)
            continue
        here, there = (s[depth] if depth < len(s) else -1), (other[depth] if depth < len(other) else -1)
        k = 0
        while k < len(path) and path[k][0][0] < depth:
            k += 1
        below = path[k][0] if k < len(path) else node
        if isinstance(below, list) and below[0] == depth:
            below[1][here] = ([i], len(s))
            continue
        new = [depth, {there: below, here: ([i], len(s))}]
        if k:
            path[k - 1][0][1][path[k - 1][1]] = new
        else:
            root = new
    out, stack = [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, tuple):
            out += [(i, shared if not n else node[1]) for n, i in enumerate(node[0])]
        else:
            branches = [node[1][c] for c in sorted(node[1])]
            stack += [(b, node[0]) for b in branches[:0:-1]] + [(branches[0], shared)]
    return out


def multikey_quicksort(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `keys` (their characters) within their groups, and which places begin a run of equal rows.

    `group` is sorted. All segments of a level are parted at once, each around its own pivot (the middle one of three
    characters) into less, equal and greater; equal ones go on to the next character.
    """
    n, depths = keys.shape
    order, edge = np.arange(n), np.append(True, group[1:] != group[:-1])[:n]
    at = np.arange(n)  # places in segments that are still open
    depth = np.zeros(n, np.int64)
    while True:
        start = edge[at]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(at)))
        part = np.cumsum(start) - 1
        open_ = ((size > 1) & (depth[at[first]] < depths))[part]
        at = at[open_]
        if not len(at):
            return order, edge
        first = np.flatnonzero(edge[at])
        size = np.diff(np.append(first, len(at)))
        part = np.cumsum(edge[at]) - 1
        c = keys[order[at], depth[at]]
        pivot = np.sort(np.stack([c[first], c[first + size // 2], c[first + size - 1]]), axis=0)[1][part]
        side = part * 3 + (c > pivot) - (c < pivot)
        moved = np.argsort(side, kind="stable")
        order[at], side = order[at][moved], side[moved]
        depth[at] += side % 3 == 0
        edge[at] = np.append(True, side[1:] != side[:-1])


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and the common prefix of each with the one before it (-1: another group)."""
    n = len(strings)
    keys = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64)
    order, edge = multikey_quicksort(keys, group)
    own, starts = group[order], np.append(np.flatnonzero(edge), n)
    prefix = np.zeros(n, np.int64)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a > 1:
            deep = blind_trie([strings[i] for i in order[a:b]])
            prefix[a:b] = [p for _, p in deep]
            order[a:b] = order[a:b][[i for i, _ in deep]]
    for a in starts[:-1].tolist():
        prefix[a] = -1 if a == 0 or own[a] != own[a - 1] else common_prefix(strings[order[a - 1]], strings[order[a]])
    return order, prefix


def recurring(window: int):
    """For windows.covered: the windows of each context that start in another place as well."""

    def resolve(h: np.ndarray, geo: np.ndarray, cnt: np.ndarray, first: list, body: list[bytes]) -> Iterator[tuple[int, int, int, int | None]]:
        n = len(h)
        if not n:
            return
        off, low = geo & 255, (geo & 255) - (geo >> 8) + 1
        sides = []
        for strings in ([b[o:] for b, o in zip(body, off.tolist(), strict=True)], [b[:o][::-1] for b, o in zip(body, off.tolist(), strict=True)]):
            sides.append(deep_shallow(strings, h))
        (right, right_prefix), (left, left_prefix) = sides
        yes = np.zeros((n, int(off.max()) + 1), bool)
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        for d in range(int(low.min()), int(off.max()) + 1):  # windows that start d bytes before the key
            rows = np.flatnonzero((low <= d) & (d <= off))
            if not len(rows):
                continue
            a[left] = np.cumsum(left_prefix < d)
            b[right] = np.cumsum(right_prefix < window - d)
            key = a[rows] * (n + 1) + b[rows]
            _, which = np.unique(key, return_inverse=True)
            yes[rows, d] = np.bincount(which, cnt[rows])[which] > 1
        for r in range(n):
            i = np.flatnonzero(yes[r, low[r] : off[r] + 1][::-1])
            if len(i):
                gaps = np.flatnonzero(np.diff(i) > 1)
                for s, e in zip(i[np.append(0, gaps + 1)].tolist(), i[np.append(gaps, len(i) - 1)].tolist(), strict=True):
                    yield r, s, e, first[r]

    return resolve


def part_of(body: bytes, a: int, b: int) -> bytes:
    return body[a:b]


def cut_bytes(text: str, at: list[tuple[int, int]]) -> list[bytes]:
    data = text.encode()
    return [data[p : p + n] for p, n in at]


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, text, spans: byte ranges that strings of `length` bytes starting in two places cover."""
    gram = length // 2
    if not 60 < gram < 128:
        raise ValueError("length must be between 122 and 255")
    spans = windows.covered(docs, windows.byte_symbols, cut_bytes, part_of, recurring(length), length, gram, earlier=False, every_context=False, most=20_000)
    return windows.with_spans(docs, spans)


def removal(spanned: DataFrame) -> DataFrame:
    """Digest and remaining bytes of each row of repeated_spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                data, at, kept = text.encode(), 0, []
                ranges = windows.union(spans)
                for s, e in ranges:
                    kept.append(data[at:s])
                    at = e
                rest = b"".join([*kept, data[at:]])
                for column, v in zip(out, (len(data), len(data) - len(rest), len(ranges), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return spanned.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers if that string also starts anywhere else.

    One row for each input row: doc_id, n_bytes, n_removed, n_spans (maximal removed ranges), kept_sha256 and kept (the
    bytes left). Null texts are empty; texts shorter than `length` stay whole; rows with a null doc_id count like others;
    repeated rows are copies of each other. Other columns of docs are ignored; an empty table gives no rows.
    """
    return removal(repeated_spans(docs, length))
