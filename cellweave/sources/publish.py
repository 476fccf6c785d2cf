"""A sink that shows a table only when it is whole: staged by key, checked against the expected keys, published by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"
#: Rows of a split that go to one task together.
BLOCK = 1 << 18


class Incomplete(ValueError):
    """Expected keys without rows, or rows of keys that nobody expects."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    part, fs = _fs(spark, f"{path}.part-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs
    to, _ = _fs(spark, path)
    context = options.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(options.Options.Rename, 1)
    rename[0] = options.Options.Rename.OVERWRITE
    context.rename(part, to, rename)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file; Spark's readers skip names that begin with an underscore."""
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stage(df: DataFrame, path: str) -> str:
    """Write one shard beside the place where the whole table will be; its folder."""
    where = f"{path}.staged/{uuid.uuid4().hex}"
    df.write.parquet(where)
    return where


def publish(spark: SparkSession, shards: list[str], path: str, key: str, expected: DataFrame) -> dict:
    """Merge staged shards into a table at `path`, partitioned by `key`, if the keys of their rows are those of expected(key); else
    Incomplete and nothing is there. Readers see no table or all of it. The manifest beside the data counts rows by key.

    A null key is an error; shards may share keys. The shards stay until the table is published, so a failed run goes on where it was.
    A place that is taken is refused.
    """
    if exists(spark, path):
        raise FileExistsError(path)
    rows = spark.read.parquet(*shards)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    odd = counts.join(expected.select(key, F.lit(True).alias("wanted")).distinct(), counts[key].eqNullSafe(expected[key]), "full").filter(counts[key].isNull() | F.col("wanted").isNull() | F.col("n").isNull())
    if wrong := odd.select(F.coalesce(counts[key], expected[key]).cast("string").alias("k"), F.col("n").isNull().alias("missing")).limit(20).collect():
        raise Incomplete(f"missing {sorted(str(r.k) for r in wrong if r.missing)}, unexpected {sorted(str(r.k) for r in wrong if not r.missing)}")
    whole = f"{path}.whole-{uuid.uuid4().hex}"
    block = F.floor(F.monotonically_increasing_id() / BLOCK)  # so that no task holds a whole key
    rows.repartition(F.col(key), block).write.partitionBy(key).parquet(whole)
    told = spark.read.parquet(whole).groupBy(key).count()
    total, n_keys = told.agg(F.sum("count"), F.count("*")).first()
    told.select(F.col(key).cast("string").alias("key"), "count").coalesce(1).write.json(f"{whole}/_counts")
    manifest = {"key": key, "keys": n_keys, "rows": total or 0}
    write_text(spark, f"{whole}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    source, fs = _fs(spark, whole)
    target, _ = _fs(spark, path)
    if not fs.rename(source, target):
        raise FileExistsError(path)
    for shard in shards:
        p, fs = _fs(spark, shard)
        fs.delete(p, True)
    return manifest
