"""Repeated windows of fixed length, at any size of corpus, found without shuffling every position.

A window of W symbols is keyed by the smallest hash among its K-grams (leftmost on ties). The key and its place in the
window depend on the window alone, so equal windows share both. Consecutive windows with one key form a *context*: one
row of about (W - K) / 2 windows. Only contexts whose key occurs again go further, and equal contexts (by 128 bits of
hashes) are merged before any of their text moves. The caller's `resolve` then compares the different contexts of a key
by its own method. A key with very many contexts is divided first: a window of it has a certain stretch in common with
all windows that begin as far before the key or farther, or as near or nearer, and that stretch gives the new keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FIRST, PIECE, SECOND, U, discard, mix, signed, spread_join, stored, tune, utf8

ID = ["h", "ch", "geo"]
RUNS = "h long, ch long, geo int, doc_id long, fp long, pos long"
#: A context, or the part of it whose windows begin lo to hi symbols before the key's place; shift: the windows before that part.
CONTEXTS = "h long, ch long, geo int, cnt long, first_doc long, body binary, key long, part int, shift int, lo int, hi int"
FOUND = "h long, ch long, geo int, cnt long, i0 int, i1 int, first_doc long"
POSITION = U((1 << 20) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours by minima within blocks from both sides."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, U)
    blocks[: len(x)] = x
    rows = blocks.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def contexts(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, content hash, geometry, text number and first window of each context of the texts [starts, ends)."""
    n = np.maximum(ends - starts - window + 1, 0)
    if not n.sum():
        z = np.zeros(0, np.int64)
        return z.view(U), z.view(U), z, z, z
    sums = FIRST.sums(symbols)
    grams = mix(FIRST.windows(sums, gram))
    low = sliding_min((grams & ~POSITION) | np.arange(len(grams), dtype=U), window - gram + 1)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    anchor = (low[at] & POSITION).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1])
    last = np.append(first[1:], len(at)) - 1
    p0, p1, a = at[first], at[last], anchor[first]
    geo = ((p1 - p0 + 1) << 8) | (a - p0)
    content = mix(SECOND.spans(SECOND.sums(symbols), p0, p1 + window) ^ geo.astype(U) * U(0x9E3779B97F4A7C15))
    return grams[a], content, geo, np.searchsorted(starts, p0, "right") - 1, p0


def pieces(offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """First and last text and symbol range of slices of bounded size; a long text comes in slices that share window - 1 symbols."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        if offsets[j] - offsets[i] <= PIECE:
            yield i, j, int(offsets[i]), int(offsets[j])
        else:
            for s in range(int(offsets[i]), int(offsets[j]), PIECE):
                yield i, j, s, min(s + PIECE + window - 1, int(offsets[j]))
        i = j


def runs(symbols_of: Callable, window: int, gram: int) -> Callable:
    """mapInArrow function: (doc_id, fp, text) to RUNS. symbols_of gives the symbols of a slice and the offsets of the texts in symbols."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, fp = batch.column("doc_id"), batch.column("fp")
            symbols, offsets = symbols_of(batch.column("text"))
            for i, j, lo, hi in pieces(offsets, window):
                bounds = np.clip(offsets[i : j + 1], lo, hi) - lo
                h, ch, geo, text, at = contexts(symbols(lo, hi), bounds[:-1], bounds[1:], window, gram)
                take = pa.array(text + i)
                pos = at + lo - offsets[i + text]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(ch)), pa.array(geo.astype(np.int32)), doc.take(take), fp.take(take), pa.array(pos)], names=["h", "ch", "geo", "doc_id", "fp", "pos"])

    return rows


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and fp, a hash of the text that tells rows with one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), F.col("text").cast("string").alias("text"))


def same(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.fp == b.fp)


def covered(docs: DataFrame, symbols_of: Callable, bodies_of: Callable, cut: Callable, resolve: Callable, window: int, gram: int, earlier: bool, every_context: bool, most: int) -> DataFrame:
    """Ranges [s, e) of symbols of each (doc_id, fp) that repeated windows cover, as an array `spans`.

    earlier: only windows that also start in a document with a smaller doc_id count; otherwise any window that starts
    twice. bodies_of(text, positions, lengths): the symbols of each context as bytes; cut(body, a, b): those from a to b.
    resolve(key, part, cnt, first_doc, body) yields (row, i0, i1, first_doc) for its windows that recur; a task gets whole
    keys, of `most` contexts at most. every_context: equal contexts without others under their key are resolved as well.
    """
    tune(docs.sparkSession, 500, 4)
    docs = keyed(docs)
    every = docs.mapInArrow(runs(symbols_of, window, gram), RUNS)
    again = stored(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    total = again.agg(F.sum("n")).first()[0] or 0
    kept = stored(spread_join(every, again, ["h"], "n", total, ["doc_id", "pos"]).drop("n"), "runs")
    discard(again)
    merged = kept.groupBy(*ID).agg(F.count("*").alias("cnt"), F.min("doc_id").alias("first_doc"), F.min(F.struct("doc_id", "fp", "pos")).alias("at"))
    merged = stored(merged, "contexts")
    merged = spread_join(merged, merged.groupBy("h").agg(F.count("*").alias("kinds")), ["h"], "kinds", merged.count(), ["ch"])
    alone = merged.filter("kinds = 1 and cnt > 1").select(*ID, "cnt", F.lit(0).alias("i0"), (F.shiftright("geo", 8) - 1).alias("i1"), "first_doc")
    mixed = merged.filter("kinds > 1 or cnt > 1" if every_context else "kinds > 1").groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.fp").alias("fp"))
    mixed = mixed.agg(F.collect_list(F.struct(*ID, "cnt", "first_doc", F.col("at.pos").alias("pos"))).alias("wanted"))
    joined = docs.join(mixed, same(docs, mixed)).select(docs.text, mixed.wanted)
    bodies = stored(joined.mapInArrow(cutter(bodies_of, window, window - gram), CONTEXTS), "bodies")
    near, found = divided(bodies, cut, window, most)
    found = found.unionByName(near.repartition("key").sortWithinPartitions("key").mapInArrow(resolver(resolve), FOUND))
    if not every_context:
        found = found.unionByName(alone)
    found = found.groupBy(*ID).agg(F.max("cnt").alias("cnt"), F.collect_set(F.struct("i0", "i1", "first_doc")).alias("ranges"))  # one for each window of a context at most
    hits = spread_join(kept, stored(found, "found"), ID, "cnt", kept.count(), ["doc_id", "pos"]).withColumn("r", F.explode("ranges"))
    if earlier:
        hits = hits.filter("r.first_doc < doc_id")
    span = F.struct((F.col("pos") + F.col("r.i0")).alias("s"), (F.col("pos") + F.col("r.i1") + window).alias("e"))
    return stored(hits.groupBy("doc_id", "fp").agg(F.collect_set(span).alias("spans")), "spans")


def cutter(bodies_of: Callable, window: int, reach: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("h", "ch", "geo", "cnt", "first_doc", "body")}
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                at = [(x["pos"], (x["geo"] >> 8) + window - 1) for x in wanted]
                out["body"] += bodies_of(text.as_py() or "", at)
                for k in ("h", "ch", "geo", "cnt", "first_doc"):
                    out[k] += [x[k] for x in wanted]
            zero = np.zeros(len(out["h"]), np.int32)
            out |= {"key": out["h"], "part": out["geo"], "shift": zero, "lo": zero, "hi": zero + reach}
            yield as_contexts(out)

    return rows


def as_contexts(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"cnt": pa.int64(), "first_doc": pa.int64(), "body": pa.binary(), "h": pa.int64(), "ch": pa.int64(), "key": pa.int64()}
    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[k], kinds.get(k, pa.int32())) for k in names], names=names)


def divided(contexts: DataFrame, cut: Callable, window: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of which a key has `most` at most, and, as FOUND, the windows that came to stand alone under a key with more.

    Each round halves the range of a large key's windows by how far before the key's place they begin. All windows of a half
    cover a common stretch; its hash is the new key, so equal windows stay together. What is left of a range of one is
    the window itself: such rows are grouped by it.
    """
    near, found = [], contexts.limit(0).select(*ID, "cnt", F.lit(0).alias("i0"), F.lit(0).alias("i1"), "first_doc")
    while True:
        sizes = stored(contexts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "large")
        if sizes.isEmpty():
            near.append(contexts)
            break
        sized = spread_join(contexts, sizes, ["key"], "n", contexts.count(), ["ch", "shift"], "left")
        near.append(stored(sized.filter("n is null").drop("n"), "near"))
        single = stored(sized.filter("n is not null and lo = hi").dropDuplicates(["key", *ID]), "single")
        groups = single.groupBy("key", "body").agg(F.sum("cnt").alias("times"), F.min("first_doc").alias("least"), F.count("*").alias("n")).filter("times > 1")
        one = spread_join(single.drop("n"), stored(groups, "groups"), ["key", "body"], "n", single.count(), ["ch"])
        found = found.unionByName(one.select(*ID, "cnt", F.col("shift").alias("i0"), F.col("shift").alias("i1"), F.col("least").alias("first_doc")))
        contexts = stored(sized.filter("n is not null and lo < hi").drop("n").mapInArrow(halves(cut, window), CONTEXTS), "halves")
    out = near[0]
    for df in near[1:]:
        out = out.unionByName(df)
    return out, found


def halves(cut: Callable, window: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in batch.schema.names}
            for x in batch.to_pylist():
                off, n, mid = x["part"] & 255, x["part"] >> 8, (x["lo"] + x["hi"]) // 2
                for lo, hi in ((x["lo"], mid), (mid + 1, x["hi"])):
                    far, close = min(hi, off), max(lo, off - n + 1)
                    if far < close:
                        continue
                    common = cut(x["body"], off - lo, off + window - hi)
                    key = hashlib.blake2b(common, digest_size=8, key=x["key"].to_bytes(8, "little", signed=True) + bytes([lo, hi])).digest()
                    body = cut(x["body"], off - far, off - close + window)
                    own = {"body": body, "key": int.from_bytes(key, "little", signed=True), "part": (far - close + 1) << 8 | far, "shift": x["shift"] + off - far, "lo": lo, "hi": hi}
                    for k, v in (x | own).items():
                        out[k].append(v)
            yield as_contexts(out)

    return rows


def resolver(resolve: Callable, most_bytes: int = 8 << 20) -> Callable:
    """Feeds `resolve` whole keys, a few MB of bodies at a time; rows come sorted by key."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in ("key", *ID, "shift")], axis=1)
        t = t.take(np.sort(np.unique(key, axis=0, return_index=True)[1]))  # repeated rows of a table bring a context twice
        col = {k: t.column(k).to_numpy() for k in (*ID, "cnt", "key", "part", "shift")}
        first, body = t.column("first_doc").to_pylist(), t.column("body").to_pylist()
        order = np.argsort(col["key"], kind="stable")
        r, i0, i1, m = [], [], [], []
        for row, a, b, least in resolve(col["key"][order], col["part"][order].astype(np.int64), col["cnt"][order], [first[i] for i in order], [body[i] for i in order]):
            r.append(order[row])
            i0.append(a + col["shift"][order[row]])
            i1.append(b + col["shift"][order[row]])
            m.append(least)
        take = np.asarray(r, np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(col[k][take]) for k in (*ID, "cnt")), pa.array(i0, pa.int32()), pa.array(i1, pa.int32()), pa.array(m, pa.int64())], names=[*ID, "cnt", "i0", "i1", "first_doc"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < most_bytes:
                continue
            h = batch.column("key").to_numpy()
            edge = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if edge == 0 and h[0] == (held[-2].column("key")[-1].as_py() if len(held) > 1 else h[0]):
                continue  # one key so far in this batch: wait for its end
            held[-1] = batch.slice(0, edge)
            yield flush([x for x in held if x.num_rows] or [batch.slice(0, 0)])
            held, size = [batch.slice(edge)], batch.slice(edge).nbytes
        if held:
            yield flush(held)

    return rows


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and spans of every row of docs; null spans where nothing repeats."""
    docs = keyed(docs)
    return docs.join(spans, same(docs, spans), "left").select(docs.doc_id, docs.text, spans.spans)


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint, sorted, maximal ranges."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def byte_symbols(column: pa.Array) -> tuple[Callable, np.ndarray]:
    from .common import BYTES

    data, offsets = utf8(column)
    return lambda lo, hi: BYTES[data[lo:hi]], offsets
