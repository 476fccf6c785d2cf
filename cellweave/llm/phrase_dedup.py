"""Removal of repeated word passages by repeated-phrase automata.

:mod:`.windows` brings together the places where a passage may recur. In each shard the phrases of `length` words that
occur twice are confirmed word by word, compiled into an Aho-Corasick automaton over the shard's word numbers, and every
context of the documents that may hold one is streamed through it: each hit is an occurrence of a confirmed phrase.
Copies of a context, the same to 128 bits, are streamed once for all of them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import windows
from .common import texts, utf8, words

FIRST_CHAR, SURROGATES = 1, range(0xD800, 0xE000)


def word_symbols(column: pa.Array):
    data, offsets = utf8(column)
    _, _, hashes, first = words(data, offsets)
    return (lambda lo, hi: hashes[lo:hi]), first


def cut_words(text: str, at: list[tuple[int, int]]) -> list[bytes]:
    every = text.encode().split()
    return [b" ".join(every[p : p + n]) for p, n in at]


def part_of(body: bytes, a: int, b: int) -> bytes:
    return b" ".join(body.split(b" ")[a:b])


def numbered(bodies: list[bytes]) -> list[str]:
    """Each body as a string with one character for each word; equal words of the shard share a character."""
    number: dict[bytes, str] = {}
    out = []
    for body in bodies:
        own = []
        for w in body.split(b" "):
            c = number.get(w)
            if c is None:
                k = len(number) + FIRST_CHAR
                c = number[w] = chr(k if k < SURROGATES.start else k + len(SURROGATES))  # beyond the last character: ValueError
            own.append(c)
        out.append("".join(own))
    return out


def occurrences(length: int):
    """For windows.covered: every occurrence of a confirmed phrase, with the smallest doc_id that has the phrase."""

    def shard(h: list, cnt: list, first: list, streams: list[str]) -> Iterator[tuple[int, int, int, int | None]]:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        a = 0
        while a < len(h):
            b = a + 1
            while b < len(h) and h[b] == h[a]:
                b += 1
            times: Counter[str] = Counter()
            for r in range(a, b):
                s = streams[r]
                for i in range(len(s) - length + 1):
                    times[s[i : i + length]] += cnt[r]
            for phrase, n in times.items():
                if n > 1:
                    automaton.add_word(phrase, len(automaton))
            a = b
        if not len(automaton):
            return
        automaton.make_automaton()
        least: dict[int, int] = {}
        hits = []
        for r, s in enumerate(streams):
            found = [(e - length + 1, phrase) for e, phrase in automaton.iter(s)]
            hits.append(found)
            if first[r] is not None:
                for _, phrase in found:
                    if first[r] < least.get(phrase, first[r] + 1):
                        least[phrase] = first[r]
        for r, found in enumerate(hits):
            a = 0
            while a < len(found):  # neighbours with one smallest document make one range
                b = a
                while b + 1 < len(found) and found[b + 1][0] == found[b][0] + 1 and least.get(found[b + 1][1]) == least.get(found[a][1]):
                    b += 1
                if found[a][1] in least:
                    yield r, found[a][0], found[b][0], least[found[a][1]]
                a = b + 1

    def resolve(h: np.ndarray, geo: np.ndarray, cnt: np.ndarray, first: list, body: list[bytes]):
        keys, counts = h.tolist(), cnt.tolist()
        a, size = 0, 0
        for r in range(1, len(keys) + 1):
            size += len(body[r - 1])
            if r == len(keys) or (keys[r] != keys[r - 1] and size > 1 << 18):
                for row, i0, i1, m in shard(keys[a:r], counts[a:r], first[a:r], numbered(body[a:r])):
                    yield a + row, i0, i1, m
                a, size = r, 0

    return resolve


def phrase_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove each word covered by a window of `length` words that also starts in a document with a smaller doc_id.

    Words are runs of characters other than ASCII white space. One row for each input row: doc_id, n_words, n_removed,
    kept_sha256 and kept (the words left, joined by one space). Null texts have no words; a null doc_id is neither
    smaller nor larger than another, so such rows stay whole and take nothing from others; rows that share a doc_id take
    nothing from each other. Other columns are ignored; an empty table gives no rows.
    """
    spans = windows.covered(docs, word_symbols, cut_words, part_of, occurrences(length), length, length // 2, earlier=True, every_context=True, most=1_000)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                every = text.encode().split()
                at, kept = 0, []
                for s, e in windows.union(spans):
                    kept += every[at:s]
                    at = e
                kept += every[at:]
                rest = b" ".join(kept)
                for column, v in zip(out, (len(every), len(every) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode()), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return windows.with_spans(docs, spans).mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
