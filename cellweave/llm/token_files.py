"""Token ids as Simple-8b shard files.

A shard is a file: magic, then as big-endian integers the numbers of its part and of itself within the part (32 bits
each) and of its documents, ids, blocks and the ids before it in its part (64 bits each), then little-endian the documents' doc_ids and id counts, the
number of words before each block of BLOCK ids, the 64-bit words, and a line feed. The four high bits of a word select how
many values of how many bits the other 60 hold. A value of 60 bits or more is escaped: a word with selector 15 and a full
payload, then the value in a word of its own. A block begins at a word, so any block can be decoded alone, and within a
block all words of one selector are decoded at once. Spark's own writer makes the files, a shard in each, so a lost
executor leaves none half written and any store that Spark writes to can hold them; `read_shard` needs only their bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PieceCache, U, texts, tune
from .packing import offsets as partition_offsets

#: How many integers of how many bits each selector packs.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BITS = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)
MAGIC, BLOCK, FULL = b"S8BTOK02", 16384, (1 << 60) - 1
HEAD = struct.Struct(">8sIIQQQQ")


def encode_block(values: np.ndarray) -> np.ndarray:
    """Greedy packing: each word takes the selector with the most values that all fit."""
    n = len(values)
    small = not n or int(values.max()) < len(BITS)
    values = values.astype(U)
    escaped = values >= U(FULL)
    bits = BITS[values] if small else np.zeros(n, np.uint8)
    left = values.copy() if not small else values[:0]
    for shift in (32, 16, 8, 4, 2, 1):
        if small or shift > 1 and not (left >> U(shift)).any():
            continue
        big = (left >> U(shift)) > 0
        bits[big] += shift
        left[big] >>= U(shift)
    if not small:
        bits += left > 0
    room, best = bits, np.full(n, 15, np.uint8)  # selector 15 takes one value
    size = 1
    for selector in range(14, -1, -1):
        count, width = SELECTORS[selector]
        if n < count or room.min() > width:
            break
        while size < count:  # room[i]: bits that values i .. i + size - 1 need
            step = min(size, count - size)
            room = np.maximum(room[:-step], room[step:])
            size += step
        best[: len(room)][room <= width] = selector
    steps, at, i = np.array([c for c, _ in SELECTORS])[best].tolist(), [], 0
    while i < n:
        at.append(i)
        i += steps[i]
    at = np.array(at, np.int64)
    chosen = best[at]
    extra = escaped[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(extra)[:-1]])
    out = np.zeros(len(at) + int(extra.sum()), U)
    for selector in np.unique(chosen):
        count, width = SELECTORS[selector]
        rows = np.flatnonzero(chosen == selector)
        word = np.full(len(rows), U(int(selector) << 60))
        if width:
            block = values[at[rows][:, None] + np.arange(count)]
            for j in range(count):
                word |= np.minimum(block[:, j], U(FULL)) << U(j * width)
        out[place[rows]] = word
    out[place[extra] + 1] = values[at[extra]]
    return out


def decode_block(words: np.ndarray) -> np.ndarray:
    """All words of a selector at once."""
    raw = np.zeros(len(words), bool)
    full = np.flatnonzero(words == U((15 << 60) | FULL)).tolist()
    last = -2
    for i in full:  # a raw word may look like an escape
        if i != last + 1 or not raw[i]:
            raw[i + 1] = True
            last = i
    kept = np.flatnonzero(~raw)
    selectors = (words[kept] >> U(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), U)
    for selector in np.unique(selectors):
        count, width = SELECTORS[selector]
        if width:
            rows = np.flatnonzero(selectors == selector)
            shifts = (np.arange(count) * width).astype(U)
            out[starts[rows][:, None] + np.arange(count)] = (words[kept[rows]][:, None] >> shifts) & U((1 << width) - 1)
    escapes = kept[np.flatnonzero(np.append(raw[1:], False)[kept])]
    if len(escapes):
        out[starts[np.searchsorted(kept, escapes)]] = words[escapes + 1]
    return out


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray], part: int = 0, shard: int = 0, local: int = 0) -> bytes:
    every = np.concatenate([np.zeros(0, np.uint16), *ids])
    blocks = [encode_block(every[i : i + BLOCK]) for i in range(0, len(every), BLOCK)]
    before = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], "u1")
    head = HEAD.pack(MAGIC, part, shard, len(doc_ids), len(every), len(blocks), local)
    return b"".join([head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(x) for x in ids], "<u8").tobytes(), before.tobytes(), *(b.astype("<u8").tobytes() for b in blocks)])


def read_shard(image: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """doc_ids and the ids of each document."""
    doc_ids, sizes, every = decode_shard(image)
    ends = np.cumsum(sizes)
    return doc_ids, [every[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def decode_shard(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, the number of ids of each document, and all ids."""
    magic, _, _, docs, total, blocks, _ = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size
    known = np.frombuffer(image, "u1", docs, at)
    doc_ids = np.frombuffer(image, "<i8", docs, at + docs).tolist()
    sizes = np.frombuffer(image, "<u8", docs, at + 9 * docs).astype(np.int64)
    before = np.frombuffer(image, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)
    words = np.frombuffer(image, "<u8", int(before[-1]), at + 17 * docs + 8 * (blocks + 1))
    every = np.empty(total, U)
    for k, (a, b) in enumerate(zip(before[:-1], before[1:], strict=True)):
        own = every[k * BLOCK : (k + 1) * BLOCK]
        own[:] = decode_block(words[a:b])[: len(own)]
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], sizes, every


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shard_ids: int = 1 << 21, cached: int = 1_300_000) -> None:
    """Write all documents' ids, in ascending doc_id order, as shard files into the new folder `path`.

    Null texts are empty and have their end id alone; null doc_ids come first; rows with one doc_id come in the order of
    their texts; a long text may make a shard larger than shard_ids. An empty table gives no shards.
    """
    tune(docs.sparkSession, 1000, 8)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, shard, size = PieceCache.at(tokenizer, cached), TaskContext.get().partitionId(), 0, 0
        local = 0
        end = np.array([end_id], cache.dtype)
        doc_ids: list = []
        ids: list = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([write_shard(doc_ids, ids, part, shard, local)], pa.binary())], names=["image"])

        for batch in batches:
            for doc, own in zip(batch.column("doc_id").to_pylist(), cache.encode_many(texts(batch.column("text"))), strict=True):
                doc_ids.append(doc)
                ids.append(np.append(own, end))
                size += len(ids[-1])
                if size >= shard_ids:
                    yield flush()
                    local, shard, doc_ids, ids, size = local + size, shard + 1, [], [], 0
        if ids:
            yield flush()

    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    images = ordered.mapInArrow(rows, "image binary").select(F.col("image").cast("string").alias("value"))  # the bytes as they are
    images.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read the shard files of a folder: doc_id, start (ids before it in all shards), n_tokens, ids_crc32 and, if asked for, ids of each document."""
    tune(spark, 1000, 8)
    files = spark.read.format("binaryFile").load(path).filter("length > 1").select("content")
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long")
    totals = files.select(number(9, 4).alias("part"), number(25, 8).alias("doc_tokens"))
    placed = files.withColumn("part", number(9, 4)).withColumn("local", number(41, 8)).join(F.broadcast(partition_offsets(totals)), "part")  # a row for each part
    placed = placed.select("content", (F.col("base") + F.col("local")).alias("start"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, n, every = decode_shard(batch.column("content")[k].as_buffer())
                start = batch.column("start")[k].as_py() + np.cumsum(n) - n
                wide = memoryview(every.astype("<u4")).cast("B") if len(every) else memoryview(b"")
                ends = (4 * np.cumsum(n)).tolist()
                own = [wide[e - 4 * k : e] for e, k in zip(ends, n.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64()), *([pa.array([bytes(x) for x in own], pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
