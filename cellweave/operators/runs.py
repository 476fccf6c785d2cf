"""Connected components of lattice masks by runs: maximal stretches of a row, (sample, iy, x0, x1).

A background of millions of pixels is a few runs a row. Strips of rows are contracted in one pass each; only runs that meet at the
border of two strips go through the rounds of `graph.components`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut, components, merged

#: A strip holds at most STRIP times half the lattice's width runs, whatever the section's height.
STRIP = 256
NUMBER = "sample * 1099511627776L + iy * 1048576L + {}"


def runs(mask: DataFrame) -> DataFrame:
    """The runs of a mask without repeated pixels."""
    row = Window.partitionBy("sample", "iy").orderBy("ix")
    stretch = mask.select("sample", "iy", "ix", (F.col("ix") - F.row_number().over(row)).alias("k"))
    return stretch.groupBy("sample", "iy", "k").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1")).drop("k")


def pixels(runs: DataFrame, *more: str) -> DataFrame:
    return runs.select("sample", "iy", F.explode(F.sequence("x0", "x1")).alias("ix"), *more)


def gaps(runs: DataFrame, sides: DataFrame) -> DataFrame:
    """The runs of the rest of each lattice; sides(sample, nx, ny) has the lattices to look at."""
    row = Window.partitionBy("sample", "iy").orderBy("x0")
    ends = sides.select("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny").cast("long") - 1)).alias("iy"), F.col("nx").cast("long").alias("x0"), F.col("nx").cast("long").alias("x1"))
    every = runs.select("sample", "iy", "x0", "x1").unionByName(ends)
    return every.select("sample", "iy", (F.lag("x1", 1, -1).over(row) + 1).alias("a"), (F.col("x0") - 1).alias("b")).filter("a <= b").select("sample", "iy", F.col("a").alias("x0"), F.col("b").alias("x1"))


def touching(iy: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs (sorted by iy and x0) in rows one below the other that share a column, or come within `reach` of it."""
    wide = int(x1.max()) + 3
    first = np.searchsorted(iy * wide + x1, (iy + 1) * wide + x0 - reach, "left")
    last = np.searchsorted(iy * wide + x0, (iy + 1) * wide + x1 + reach, "right")
    n = np.maximum(last - first, 0)
    total = np.cumsum(n)
    return np.repeat(np.arange(len(iy)), n), np.arange(total[-1]) - np.repeat(total - n - first, n)


def labelled(runs: DataFrame, eight: bool = False) -> DataFrame:
    """runs with `region`: the smallest pixel number of their 4- or 8-connected component within a sample."""
    reach = 1 if eight else 0

    def strip(table: pa.Table) -> pa.Table:
        table = table.sort_by([("iy", "ascending"), ("x0", "ascending")])
        iy, x0, x1, node = (table.column(c).to_numpy() for c in ("iy", "x0", "x1", "node"))
        return table.append_column("root", pa.array(node[merged(len(iy), *touching(iy, x0, x1, reach))]))

    numbered = runs.select("sample", F.col("iy").cast("long"), F.col("x0").cast("long"), F.col("x1").cast("long"), F.expr(NUMBER.format("x0")).alias("node"), F.floor(F.col("iy") / STRIP).alias("strip"))
    kind = runs.schema["sample"].dataType.simpleString()
    rooted = numbered.groupBy("sample", "strip").applyInArrow(strip, f"sample {kind}, iy long, x0 long, x1 long, node long, strip long, root long").drop("node", "strip")
    return _joined_strips(rooted, reach)


def _joined_strips(rooted: DataFrame, reach: int) -> DataFrame:
    """Runs whose strips' roots are joined where they touch across a border."""
    rooted = _cut(rooted)
    upper = F.pmod("iy", F.lit(STRIP)) == STRIP - 1
    border = rooted.filter(upper | (F.pmod("iy", F.lit(STRIP)) == 0)).select("sample", F.floor((F.col("iy") + 1) / STRIP).alias("pair"), upper.alias("upper"), (2 * F.col("x0") - reach).alias("x0"), (2 * F.col("x1") + reach).alias("x1"), "root")  # half a pixel more on all sides: runs of a row stay apart
    before = Window.partitionBy("sample", "pair").orderBy("x0")
    other = lambda side: F.last(F.when(F.col("upper") == side, F.struct("root", "x1")), ignorenulls=True).over(before)
    seen = border.withColumn("other", F.when(F.col("upper"), other(False)).otherwise(other(True))).filter("other.x1 >= x0")
    edges = seen.select(F.col("root").alias("a"), F.col("other.root").alias("b")).distinct()
    if edges.isEmpty():
        return rooted.withColumnRenamed("root", "region")
    joined = components(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges)
    return rooted.join(joined, rooted.root == joined.node, "left").select("sample", "iy", "x0", "x1", F.coalesce("component", "root").alias("region"))
