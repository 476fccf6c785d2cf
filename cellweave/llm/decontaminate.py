"""Benchmark decontamination by greedy string tiling.

Runs of `least` words that a document shares with a benchmark item are seeds: equal Karp-Rabin hashes, found by a join of
documents' and items' runs. A bitmap of fixed size over the items' hashes spares the join nearly all runs of documents.
The seeds of a document and an item make matches, of which the longest that is still free is marked again and again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, LOWER_BYTES, SECOND, U, mix, signed, spread_join, stored, tune, utf8, words

OVERLAP = "array<struct<item_id: long, n_matched: int, n_tokens: int, n_tiles: int, coverage: double>>"
TILED = "struct<n_matched: int, n_tiles: int>"
RUNS = "id long, fp long, n_tokens int, g1 long, g2 long, at int"
#: The bitmap has 2 ** BITS bits, in chunks of the size of Spark's bitmap functions.
BITS, CHUNK = 27, 1 << 15


def runs(least: int, bitmap=None):
    """mapInArrow function: (id, fp, text) to RUNS, a row for each run of `least` words, or for each that the bitmap may know."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bitmap is None else bitmap.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            _, _, hashes, first = words(data, offsets, LOWER_BYTES)
            if len(hashes) < least:
                continue
            g1 = mix(FIRST.windows(FIRST.sums(hashes), least))
            hit = np.flatnonzero(known[(g1 >> U(67 - BITS)).astype(np.int64)] >> ((g1 >> U(64 - BITS)) & U(7)).astype(np.uint8) & 1) if known is not None else np.arange(len(g1))
            text = np.searchsorted(first, hit, "right") - 1
            hit, text = hit[hit + least <= first[text + 1]], text[hit + least <= first[text + 1]]
            g2 = SECOND.spans(SECOND.sums(mix(hashes)), hit, hit + least)
            take = pa.array(text)
            n = np.diff(first)[text]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("fp").take(take), pa.array(n.astype(np.int32)), pa.array(signed(g1[hit])), pa.array(signed(g2)), pa.array((hit - first[text]).astype(np.int32))], names=["id", "fp", "n_tokens", "g1", "g2", "at"])

    return rows


def tiles(seeds: list[tuple[int, int]], least: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds, places (in item and document) of equal runs of `least` words: (item position, document position, length), longest first.

    Seeds that follow each other on a diagonal make maximal matches; the longest whose words are all unmarked is marked
    first (ties: first in the item, then in the document); a match that is partly marked goes back with what is left of it.
    """
    heap: list[tuple[int, int, int]] = []
    run: list[int] = []
    for d, p in [*sorted((q - p, p) for p, q in seeds), (0, -2)]:
        if run and d == run[0] and p == run[2] + 1:
            run[2] = p
            continue
        if run:
            heap.append((run[1] - run[2] - least, run[1], run[1] + run[0]))
        run = [d, p, p]
    heapq.heapify(heap)
    low = min(q for _, q in seeds)
    in_item, in_doc, out = np.zeros(n_item, bool), np.zeros(max(q for _, q in seeds) + least - low, bool), []
    while heap:
        n, p, q = heapq.heappop(heap)
        free = ~(in_item[p : p - n] | in_doc[q - low : q - low - n])
        if free.all():
            in_item[p : p - n] = in_doc[q - low : q - low - n] = True
            out.append((p, q, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, p + a, q + a))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("fp"), text.alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, fp (a hash of the text) and item_id, n_matched, n_tokens, n_tiles, coverage of each document and item of which tiles cover `threshold` or more.

    Rows that share doc_id and text are one document here.
    """
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.filter("item_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("fp"), F.col("text").cast("string").alias("text"))
    grams = stored(items.mapInArrow(runs(least), RUNS).toDF("item_id", "item_fp", "n_tokens", "g1", "g2", "p").distinct(), "grams")
    bit = F.shiftrightunsigned("g1", 64 - BITS)
    chunks = grams.groupBy(F.floor(bit / CHUNK).alias("chunk")).agg(F.bitmap_construct_agg((bit % CHUNK).cast("long")).alias("bits"))
    known = np.zeros(1 << (BITS - 3), np.uint8)
    for r in chunks.toLocalIterator():  # 2 ** BITS bits at most
        known[r.chunk * (CHUNK // 8) : (r.chunk + 1) * (CHUNK // 8)] = np.frombuffer(r.bits, np.uint8)
    at = keyed(docs).mapInArrow(runs(least, spark.sparkContext.broadcast(known)), RUNS).drop("n_tokens").withColumnRenamed("at", "q")
    at = stored(at.distinct(), "seeds")  # repeated rows of a table
    per = at.groupBy("g1", "g2").agg(F.count("*").alias("times"))
    one = grams.groupBy("g1", "g2").agg(F.collect_list(F.struct("item_id", "item_fp", "n_tokens", "p")).alias("places")).join(per, ["g1", "g2"])
    seeds = spread_join(at, one, ["g1", "g2"], "times", at.count(), ["id", "q"]).withColumn("i", F.explode("places"))
    pairs = seeds.groupBy("id", "fp", "i.item_id", "i.item_fp", "i.n_tokens").agg(F.collect_list(F.struct(F.col("i.p").alias("p"), "q")).alias("seeds"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct("seeds.p"), lambda p: F.sequence(p, p + least - 1)))))
    pairs = pairs.filter(covered >= F.col("n_tokens") * threshold)  # all seeds together

    @F.arrow_udf(TILED)
    def tiled(seeds: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for own, k in zip(seeds.to_pylist(), n.to_pylist(), strict=True):
            t = tiles([(s["p"], s["q"]) for s in own], least, k)
            out.append({"n_matched": sum(x[2] for x in t), "n_tiles": len(t)})
        return pa.array(out, pa.struct([("n_matched", pa.int32()), ("n_tiles", pa.int32())]))

    found = pairs.withColumn("t", tiled("seeds", "n_tokens")).select(F.col("id").alias("doc_id"), "fp", "item_id", "t.n_matched", "n_tokens", "t.n_tiles", (F.col("t.n_matched") / F.col("n_tokens")).alias("coverage"))
    return found.filter(F.col("n_matched") >= F.col("n_tokens") * threshold)


def with_matches(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs joined with found(doc_id, fp, ...) on the text's hash and the doc_id; columns of docs have the names c0, c1, ..."""
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}").cast("string")
    return own.join(found, (F.xxhash64(text) == found.fp) & doc.eqNullSafe(found.doc_id), how)


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """docs with `overlaps`: the benchmark items of which tiles of at least `least` words cover a share of `threshold` or more.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased. Items with fewer than `least` words, a
    null text or a null item_id match nothing; null and empty texts have no overlaps; repeated rows are each treated
    alone, repeated items count once; items that share an item_id are each treated alone; an input column named overlaps
    is replaced; empty tables give no rows or no overlaps.
    """
    docs = docs.drop("overlaps")
    found = matches(docs, benchmark, least, threshold)
    found = found.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list(F.struct("item_id", "n_matched", "n_tokens", "n_tiles", "coverage"))).alias("overlaps"))
    out = with_matches(docs, stored(found, "overlaps"), "left")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), F.coalesce("overlaps", F.array().cast(OVERLAP)).alias("overlaps"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs without overlaps."""
    found = stored(matches(docs, benchmark, **how).select("doc_id", "fp").distinct(), "overlaps")
    return with_matches(docs, found, "left_anti").toDF(*docs.columns)
