"""Concatenate and cut: fixed windows over the stream of all documents' tokens.

Pass one encodes each partition once and writes the ids with each document's place in its partition. The partitions'
totals, a row for each, give the global offsets by a prefix sum. Pass two cuts where a multiple of the window length
falls; a sequence that crosses partitions is put together from the boundary records of both by its number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PieceCache, stored, texts, tune

TOKENS = "part int, doc_id long, local long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, cached: int = 1_000_000) -> DataFrame:
    """One row for each document: its partition, the partition's ids before it, and its ids (little-endian uint32 or uint16) with end_id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, local = PieceCache.at(tokenizer, cached), 0
        end, part = np.array([end_id], cache.dtype).tobytes(), TaskContext.get().partitionId()
        for batch in batches:
            ids = [x.tobytes() + end for x in cache.encode_many(texts(batch.column("text")))]
            n = np.array([len(x) // cache.dtype.itemsize for x in ids], np.int64)
            starts = local + np.cumsum(n) - n
            local += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column("doc_id"), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["part", "doc_id", "local", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, TOKENS)


def offsets(tokens: DataFrame) -> DataFrame:
    """part and base, the ids before it, from rows (part, doc_tokens): a row for each partition, however many documents there are."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of documents, each with its sequence and place there; sequences are full but for the last.

    Columns of PIECES, ids only if asked for: the piece's ids as little-endian unsigned 32-bit integers. A null text is empty and gives
    its end id alone. A null doc_id, repeated rows and texts longer than many sequences are packed like others. The order
    is that of the partitions read. An empty table gives no rows.
    """
    tune(docs.sparkSession, 1000, 8)
    tokens = stored(tokenised(docs, tokenizer, end_id), "tokens")
    placed = tokens.join(F.broadcast(offsets(tokens)), "part")  # a row for each partition of the input

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "base", "local", "doc_tokens", "ids")]
            for doc, base, local, n, ids in zip(*columns, strict=True):
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                at, done = base + local, 0
                while done < n:
                    offset = (at + done) % length
                    take = min(length - offset, n - done)
                    own = wide[4 * done : 4 * (done + take)]
                    for column, v in zip(out, (doc, done, take, zlib.crc32(own), n, (at + done) // length, offset, own), strict=True):
                        column.append(v)
                    done += take
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            columns = [*(pa.array(c, pa.int64()) for c in out[:7]), *([pa.array(out[7], pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return placed.mapInArrow(rows, PIECES if with_ids else PIECES.removesuffix(", ids binary"))


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences: ids joined in order and padded to `length`, except where their number is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts, n in zip(batch.column("parts").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                own = b"".join(p["ids"] for p in parts)
                ids.append(own if n & (n - 1) == 0 else own + np.full(length - n, pad_id, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("n_tokens"), pa.array(ids, pa.binary())], names=["sequence_id", "n_tokens", "ids"])

    return whole.mapInArrow(rows, "sequence_id long, n_tokens long, ids binary")
