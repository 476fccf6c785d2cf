"""Sources and sinks: typed scans, comment lines, headerless rosters, append-once and write-once outputs."""

from __future__ import annotations

import functools
import io
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, sql: str | None = None) -> SparkSession:
    """The tables of the folder that `sql` names (all without it) as temporary views; a file's footer is read to make a view,
    its data only by the query, and then only the columns it uses."""
    for name in TABLES:
        if sql is None or re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a type and a section, from events: x is the value, y the user, the section the day of the month."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("cell_id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("event_type").alias("cell_type"), F.dayofmonth("ts").cast("long").alias("sample"))


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, comment: str | None = None) -> DataFrame:
    """A text table with declared types. Words such as NA are data; only an empty field is empty."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", "\u0000").option("emptyValue", "")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_first(spark: SparkSession, sources: list[tuple[str, str]], schema: str) -> DataFrame:
    """The first of (format, path) that exists; ValueError if none does."""
    for kind, path in sources:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.read.schema(schema).format(kind).option("header", True).load(path)
    raise ValueError(f"none of {[p for _, p in sources]} exists")


def write_once(df: DataFrame, path: str) -> None:
    """Write; if the output is there already it must have the same rows."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        old = df.sparkSession.read.schema(df.schema).parquet(path)
        if not old.exceptAll(df).isEmpty() or not df.exceptAll(old).isEmpty():
            raise ValueError(f"{path} holds other rows") from e


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the output lacks."""
    spark = df.sparkSession
    try:
        df = df.join(spark.read.schema(df.schema).parquet(path).select(*keys).distinct(), keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """The objects of the array `rows` of JSON documents, one row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(rows).alias("r")).select("r.*")


def read_tree(spark: SparkSession, path: str, schema: str, pattern: str, names: list[str], kind: str = "parquet") -> DataFrame:
    """All files under a folder, with the groups of `pattern` in each file's path as columns."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("header", True).format(kind).load(path)
    return df.select("*", *[F.regexp_extract(F.col("_metadata.file_path"), pattern, i + 1).alias(n) for i, n in enumerate(names)])


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per key; rows are dealt by key and a salt first, so that a task opens few folders and a hot key has several."""
    df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(*by).parquet(path)


def read_blocks(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """A sparse matrix kept as Parquet triples (row, col, value): the rows of several ranges [start, end), one under the other.
    The ranges reach the scan as a filter, so files and row groups outside them are not read."""
    wanted = functools.reduce(operator.or_, [(F.col("row") >= a) & (F.col("row") < b) for a, b in ranges], F.lit(False))
    return spark.read.schema("row long, col long, value double").parquet(path).filter(wanted)


def read_npz(spark: SparkSession, path: str, schema: str, mask: str | None = None) -> DataFrame:
    """Arrays of NPZ files as columns, one row for each place along the first axis and the file's path as `file`.

    Scalars are repeated for all rows, further axes become nested arrays; `mask` names a boolean array that keeps rows. A file
    whose arrays differ in length fails. A file is read by one task; pickled objects are refused.
    """
    kind = StructType.fromDDL(f"{schema}, file string")
    names = [f.name for f in kind.fields[:-1]]
    target = spark.createDataFrame([], kind).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    own = {n: z[n] for n in names}
                    keep = z[mask].astype(bool) if mask else None
                lengths = {len(a) for a in own.values() if a.ndim} | ({len(keep)} if keep is not None else set())
                if len(lengths) > 1:
                    raise ValueError(f"arrays of {file} differ in length: {sorted(lengths)}")
                n = lengths.pop() if lengths else 1
                columns = [np.repeat(a[None], n) if not a.ndim else a for a in own.values()]
                columns = [(a if keep is None else a[keep]).tolist() for a in columns]
                rows = len(columns[0]) if columns else 0
                yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, target, strict=False)], pa.array([file] * rows, pa.string())], schema=target)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInArrow(run, kind)


def write_grids(grids: DataFrame, stats: DataFrame, path: str) -> None:
    """Sparse grids by sample, and a table of what was measured on them, under one folder; the stats are written last, so a folder
    with stats is complete."""
    write_partitioned(grids, f"{path}/grids", ["sample"])
    stats.write.mode("overwrite").parquet(f"{path}/stats")
