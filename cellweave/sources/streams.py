"""A large delimited table read in parts as files arrive, routed by the suffix of its ids. Structured Streaming keeps track of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import exists


def routed(rows: DataFrame, vocabulary: DataFrame, length: int) -> DataFrame:
    """rows(cell_id, label) with barcode (the first `length` characters), separator, sample (what follows it), and code of the label, null for an unknown one."""
    cut = rows.select(F.substring("cell_id", 1, length).alias("barcode"), F.substring("cell_id", length + 1, 1).alias("separator"), F.expr(f"substring(cell_id, {length + 2})").alias("sample"), "label")
    return cut.join(vocabulary.select("label", "code"), "label", "left")


def route_stream(spark: SparkSession, folder: str, out: str, vocabulary: DataFrame, allowed: DataFrame, length: int, sep: str = "\t", files: int = 1, before_write: Callable[[int], None] = lambda batch: None) -> tuple[DataFrame, DataFrame]:
    """Read the files of `folder` (header cell_id, label), `files` at a time, into tables under `out`: kept rows of the samples in allowed(sample), by
    sample, and counts of all rows by sample, label and whether the label is known. Returns both.

    A batch writes into a folder of its own number, replacing what a killed run left there, and is done when its counts are there; so a run
    that goes on after a failure ends with the same tables. A kept row whose separator is not `_` fails the run.
    """
    lines = spark.readStream.schema("cell_id string, label string").option("sep", sep).option("header", True).option("maxFilesPerTrigger", files).csv(folder)

    def batch(df: DataFrame, number: int) -> None:
        before_write(number)
        rows = routed(df, vocabulary, length)
        kept = rows.join(allowed.select("sample"), "sample", "left_semi")
        checked = kept.withColumn("separator", F.when(F.col("separator") == "_", "_").otherwise(F.raise_error(F.concat(F.lit("no _ after the barcode: "), "barcode"))))
        checked.filter("separator = '_'").select("barcode", "sample", "code").write.mode("overwrite").partitionBy("sample").parquet(f"{out}/rows/batch={number}")
        counts = rows.groupBy("sample", "label", F.col("code").isNotNull().alias("known")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{out}/{name}") if exists(spark, f"{out}/{name}") else spark.createDataFrame([], schema)
    rows, counts = read("rows", "barcode string, code long, batch long, sample string"), read("counts", "sample string, label string, known boolean, n long, batch long")
    return rows.drop("batch"), counts.groupBy("sample", "label", "known").agg(F.sum("n").alias("n"))
