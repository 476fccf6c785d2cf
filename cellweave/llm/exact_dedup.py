"""Exact deduplication: groups by a 128-bit content hash, then by the bytes themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import fresh, spread_join, stored, tune, utf8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def normalised(text: pa.Array) -> tuple[memoryview, list[int]]:
    """The texts' bytes with A-Z in lower case, and where each begins; null is empty."""
    data, offsets = utf8(text)
    return memoryview(LOWER[data]), offsets.tolist()


def hashes(text: pa.Array, kind: str) -> list:
    data, at = normalised(text)
    return [hashlib.new(kind, data[a:b], usedforsecurity=False) for a, b in zip(at, at[1:], strict=False)]


@F.arrow_udf(BinaryType())
def fingerprint(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """128 bits of each normalised text's content."""
    fresh()
    for text in parts:
        yield pa.array([h.digest() for h in hashes(text, "md5")], pa.binary())


@F.arrow_udf(StructType([StructField("h", BinaryType()), StructField("sha", StringType())]))
def digests(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """128 bits of each normalised text's content, and its SHA-256."""
    fresh()
    for text in parts:
        h, sha = [h.digest() for h in hashes(text, "md5")], [h.hexdigest() for h in hashes(text, "sha256")]
        yield pa.StructArray.from_arrays([pa.array(h, pa.binary()), pa.array(sha, pa.string())], ["h", "sha"])


@F.arrow_udf(BinaryType())
def norm(text: pa.Array) -> pa.Array:
    data, at = normalised(text)
    return pa.array([data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Each input row with keep_id, group_size, kept and text_sha256.

    Rows are equal when their normalised texts are byte for byte the same (null is empty, A-Z count as a-z). Of a group the
    row with the smallest doc_id stays, or the largest with keep="largest". A null doc_id loses to any other; a group of
    null ids only has a null keep_id and keeps all its rows. Rows that repeat the kept doc_id with the same text are all
    marked kept (distinct doc_ids are the caller's business). Other columns stay, whatever their names; input columns with
    the names of the new ones are replaced. An empty table gives no rows.

    The fingerprints of all rows are grouped first, pre-aggregated on the map side. Only rows whose fingerprint recurs are
    grouped by their bytes, which settles collisions. A hot text is no single key of a join.
    """
    tune(docs.sparkSession)
    best = {"smallest": F.min, "largest": F.max}[keep]
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names of the input cannot clash with those below
    doc, text = f"c{names.index('doc_id')}", F.col(f"c{names.index('text')}").cast("string")
    prints = own.select(F.col(doc).alias("doc"), fingerprint(text).alias("h"))
    again = stored(prints.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    total = docs.count()
    rows = spread_join(own.select(F.col(doc).alias("doc"), text.alias("text"), fingerprint(text).alias("h")), again, ["h"], "n", total, ["doc"])
    groups = rows.select("h", "doc", norm("text").alias("norm")).groupBy("h", "norm").agg(best("doc").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(groups.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"), "groups")
    out = own.withColumn("d", digests(text)).select(*own.columns, "d.h", "d.sha")
    out = spread_join(out, groups, ["h", "sha"], "group_size", total, [doc], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col(doc)).otherwise(F.col("keep_id"))
    new = {"keep_id": keep_id, "group_size": F.coalesce("group_size", F.lit(1).cast("long")), "kept": F.col(doc).eqNullSafe(keep_id), "text_sha256": F.col("sha")}
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in new), *(v.alias(k) for k, v in new.items()))
