"""Neighbour densities, keep tables, cohorts, parted scans and complete sinks as queries; SQL for lattice queries that had none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import evaluation, quality, regions, spatial
from cellweave.operators.graph import _cut
from cellweave.sources import publish, streams
from cellweave.sources.tables import cells, table

from . import raster_sql as sql
from .catalog import QUERIES, framed_mask, query
from .framed_queries import FRAMED
from .relational import CELLS

PLACED = "placed AS (SELECT sample, CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(x / 10) AS BIGINT) AS ix, cell_type FROM cells), counts AS (SELECT sample, iy, ix, count(*) AS n FROM placed GROUP BY 1, 2, 3), mask AS (SELECT DISTINCT sample, iy, ix FROM placed WHERE cell_type = 'purchase')"
FRAME = f"WITH RECURSIVE {FRAMED}, {PLACED}"
PIXELS = "SELECT sample, iy, ix FROM out_"
for _name, _sql in {
    "r3_gaussian_density_framed": f"{FRAME}, {sql.blur('d', 'counts', 1.0)} SELECT sample, count(*) AS n_pixels, round(max(n), 6) AS peak, round(sum(n), 4) AS mass, count(CASE WHEN n > 0.5 THEN 1 END) AS dense FROM d GROUP BY sample",
    "r5_closing": f"{FRAME}, {sql.closed('out_', 'mask', 1, False)} {PIXELS}",
    "r7_fill_holes": f"{FRAME}, {sql.filled('out_', 'mask', 4)} {PIXELS}",
    "r11_tissue": f"{FRAME}, {sql.blur('d', 'counts', 1.0)}, h AS (SELECT sample, iy, ix FROM d WHERE n > 0.015), {sql.closed('c', 'h', 1, False)}, {sql.filled('out_', 'c')} {PIXELS}",
    "r22_mask_from_cells": f"{FRAME}, {sql.closed('c', 'mask', 3, False)}, {sql.filled('out_', 'c')} {PIXELS}",
}.items():
    QUERIES[_name] = (QUERIES[_name][0], _sql)


@query(f"{FRAME}, g AS {sql.grid('mask')}, {sql.nearest('o', 'g', 'mask')} SELECT sample, iy, ix, d2, jy, jx FROM o")
def r9_nearest_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask pixel nearest to each pixel, of equally near ones the first by row and column."""
    d = spatial.distance_fields(*framed_mask(spark, sf_dir))
    return d.select(*spatial.KEY, F.col("o2").alias("d2"), "jy", "jx")


NEIGHBOURS = f"""WITH {CELLS}, p AS (SELECT a.sample, a.cell_id AS a, b.cell_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cells a JOIN cells b ON a.sample = b.sample AND a.cell_id <> b.cell_id WHERE a.cell_type = 'click' AND b.cell_type = 'click'),
  r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p), n AS (SELECT a, count(CASE WHEN d <= 10 THEN 1 END) AS n_10, count(CASE WHEN d <= 20 THEN 1 END) AS n_20, count(CASE WHEN d <= 50 THEN 1 END) AS n_50, avg(CASE WHEN k <= 5 THEN d END) AS m FROM r GROUP BY a)
  SELECT sample, cell_id, coalesce(n_10, 0) AS n_10, coalesce(n_20, 0) AS n_20, coalesce(n_50, 0) AS n_50, round(m, 6) AS mean_d FROM cells LEFT JOIN n ON a = cell_id WHERE cell_type = 'click'"""


@query(NEIGHBOURS)
def j15_density_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within 10, 20 and 50 and the mean distance of the 5 nearest, among the clicks of a section."""
    return regions.density_features(cells(spark, sf_dir).filter("cell_type = 'click'")).withColumn("mean_d", F.round("mean_d", 6))


KEEP_SQL = """m AS (SELECT o_custkey AS cell_id, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) > 0 AS out_of_focus, max(o_totalprice) < 60000 AS no_visible_nucleus, CASE WHEN min(o_totalprice) > 2000 THEN min(o_totalprice) > 150000 END AS featureless FROM orders GROUP BY o_custkey),
  k AS (SELECT c_custkey AS cell_id, c_nationkey AS block, c_nationkey <> 7 AS has_model, c_nationkey = 7 AS drop_no_model, c_acctbal < -500 AS drop_blank, coalesce(out_of_focus, false) AS drop_out_of_focus, coalesce(no_visible_nucleus, false) AS drop_no_visible_nucleus, coalesce(featureless, false) AS drop_featureless FROM customer LEFT JOIN m ON cell_id = c_custkey),
  kept AS (SELECT *, NOT (drop_no_model OR drop_blank OR drop_out_of_focus OR drop_no_visible_nucleus OR drop_featureless) AS keep FROM k)"""


def kept_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for cells, nations for blocks, their orders for focus measures; a customer without orders was not measured."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell_id"))
    focus = o.agg((F.count_if(F.col("o_orderstatus") == "P") > 0).alias("out_of_focus"), (F.max("o_totalprice") < 60000).alias("no_visible_nucleus"), F.when(F.min("o_totalprice") > 2000, F.min("o_totalprice") > 150000).alias("featureless"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("block"), (F.col("c_nationkey") != 7).alias("has_model"), (F.col("c_acctbal") < -500).alias("drop_blank"))
    return quality.cell_keep(c, focus)


@query(f"WITH {KEEP_SQL} SELECT * FROM kept")
def c6_cell_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_cells(spark, sf_dir)


@query(f"WITH {KEEP_SQL} SELECT block, count(*) AS n_cells, count(CASE WHEN keep THEN 1 END) AS n_keep, round(count(CASE WHEN keep THEN 1 END) / count(*), 6) AS frac_keep, bool_or(has_model) AS has_model, count(CASE WHEN keep THEN 1 END) > 0 AND count(CASE WHEN keep THEN 1 END) / count(*) <= 0.8 AS blur FROM kept GROUP BY block")
def c6_block_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.block_report(kept_cells(spark, sf_dir))


WEAK_SQL = "w AS (SELECT l_suppkey AS field, count(CASE WHEN l_returnflag <> 'A' THEN 1 END) AS n_tiles, avg(CASE WHEN l_returnflag <> 'A' THEN CASE WHEN l_discount < 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS share FROM lineitem GROUP BY l_suppkey), weak AS (SELECT field, n_tiles, round(share, 6) AS weak_frac, coalesce(n_tiles >= 30 AND share > 0.5, false) AS weak FROM w)"


def weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for fields, their lines for tiles: one with return flag A is not measured, a small discount is weak."""
    return quality.weak_fields(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("field"), F.when(F.col("l_returnflag") != "A", F.col("l_discount") < 0.05).alias("weak")))


@query(f"WITH {WEAK_SQL} SELECT * FROM weak")
def c6_weak_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak(spark, sf_dir)


COHORT_SQL = f"""WITH {WEAK_SQL}, b AS (SELECT l_suppkey AS field, avg(CASE WHEN l_tax < 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY l_suppkey),
  f AS (SELECT s_suppkey AS field, s_acctbal < -800 AS lowqc, weak_frac, CASE WHEN s_suppkey % 9 > 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS n_keep, CAST(round(frac, 6) AS DOUBLE) AS blur_frac, CASE WHEN s_nationkey <> 3 THEN s_nationkey <> 5 END AS has_table FROM supplier LEFT JOIN weak ON weak.field = s_suppkey LEFT JOIN b ON b.field = s_suppkey),
  c AS (SELECT *, concat_ws(',', CASE WHEN lowqc THEN 'lowqc' END, CASE WHEN weak_frac IS NULL OR weak_frac > 0.5 THEN 'weak' END, CASE WHEN coalesce(n_keep, 0) <= 0 THEN 'zero_keep' END, CASE WHEN blur_frac < 0.5 THEN 'blur' END, CASE WHEN has_table IS NULL THEN 'no_folder' WHEN NOT has_table THEN 'no_table' END) AS causes FROM f)
  SELECT field, lowqc, weak_frac, n_keep, blur_frac, causes, causes = '' AS kept FROM c"""


@query(COHORT_SQL)
def c7_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n_keep = F.when(F.col("s_suppkey") % 9 > 0, F.floor("s_acctbal"))
    fields = s.select(F.col("s_suppkey").alias("field"), (F.col("s_acctbal") < -800).alias("lowqc"), n_keep.alias("n_keep")).join(weak(spark, sf_dir).select("field", "weak_frac"), "field", "left")
    blur = table(spark, sf_dir, "lineitem").filter("l_suppkey % 4 <> 0").groupBy(F.col("l_suppkey").alias("field")).agg(F.round(F.avg((F.col("l_tax") < 0.05).cast("double")), 6).alias("frac_keep"))
    index = s.filter("s_nationkey <> 3").select(F.col("s_suppkey").alias("field"), (F.col("s_nationkey") != 5).alias("has_table"))
    return quality.cohort(fields, blur, index).drop("has_table")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder."""
    _cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/cellweave-{name}-{uuid.uuid4().hex}"


WORDS = ("click", "view", "purchase", "signup")


@query("SELECT CAST(day(ts) AS VARCHAR) AS sample, event_type AS label, event_type <> 'error' AS known, count(*) AS n, coalesce(sum(CASE WHEN day(ts) % 3 = 1 THEN 1 END), 0) AS routed FROM events GROUP BY 1, 2, 3".replace("coalesce(sum(CASE WHEN day(ts) % 3 = 1 THEN 1 END), 0)", "CAST(coalesce(sum(CASE WHEN day(ts) % 3 = 1 THEN 1 END), 0) AS BIGINT)"))
def s4_routed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a delimited label table in several files, scanned file by file: counts of all rows, and of the rows routed to a third of the samples. An error is a label beyond the vocabulary."""
    folder, out = scratch(spark, "labels"), scratch(spark, "routed")
    e = table(spark, sf_dir, "events").select(F.concat(F.lpad(F.col("event_id").cast("string"), 10, "0"), F.lit("_"), F.dayofmonth("ts").cast("string")).alias("cell_id"), F.col("event_type").alias("label"))
    e.repartition(3, "cell_id").write.option("sep", "\t").option("header", True).csv(folder)
    vocabulary = spark.createDataFrame([(w, k) for k, w in enumerate(WORDS)], "label string, code long")
    allowed = e.select(F.substring_index("cell_id", "_", -1).alias("sample")).distinct().filter("sample % 3 = 1")
    rows, counts = streams.route_stream(spark, folder, out, vocabulary, allowed, 10)
    routed = rows.join(vocabulary, "code", "left").groupBy("sample", F.coalesce("label", F.lit("error")).alias("label")).agg(F.count("*").alias("routed"))
    return counts.join(routed, ["sample", "label"], "left").fillna(0, ["routed"]).select("sample", "label", "known", "n", "routed")


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def k1_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two staged shards of lines, published under their return flags, read back."""
    lines, path = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_linestatus"), scratch(spark, "published")
    shards = [publish.stage(lines.filter(F.col("l_linestatus") == s), path) for s in ("O", "F")]
    publish.publish(spark, shards, path, "l_returnflag", lines.select("l_returnflag").distinct())
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query()
def l1_class_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of log scores by class: a search, so without SQL; held against a plain one. Order priorities are the classes, scores come from prices and dates."""
    o = table(spark, sf_dir, "orders").withColumn("y", F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    noise = lambda j: F.pmod(F.xxhash64("o_orderkey", F.lit(j)), F.lit(1000)) / 1000.0
    lf = F.array(*[noise(j) + F.when(F.col("y") == j, 0.3).otherwise(0.0) - 0.12 * j for j in range(5)])
    offsets, f1 = evaluation.class_offsets(o.select("y", lf.alias("lf")), 5)
    return spark.createDataFrame([(j, b, f1) for j, b in enumerate(offsets)], "class int, offset double, macro_f1 double")
