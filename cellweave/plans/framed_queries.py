"""Raster queries on each section's own frame, as r1_grid_frame has it: `NAME_framed` for the queries NAME whose SQL fixes the
lattice at x < 500, y < 150. Their SQL is derived from that of NAME: cells counted from the frame's corner, no rim, the frame's grid."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import regions, spatial

from .catalog import GRID, QUERIES, _sql, framed_cells, framed_density, framed_mask, query
from .region_queries import SQL as REGION_SQL
from .relational import CELLS, SQL, oracle
from .section_queries import FRAME

FRAMED = f"{CELLS.replace('cells AS', 'raw AS', 1)}, {FRAME.replace('FROM cells', 'FROM raw')}, cells AS (SELECT raw.cell_id, raw.x - frame.x0 AS x, raw.y - frame.y0 AS y, raw.cell_type, raw.sample FROM raw JOIN frame ON raw.sample = frame.sample)"
FRAMED_GRID = "grid AS (SELECT sample, iy, unnest(range(0, nx)) AS ix FROM (SELECT sample, nx, unnest(range(0, ny)) AS iy FROM frame WHERE sample IN (SELECT sample FROM mask)) f)"


def framed_sql(sql: str) -> str:
    sql = re.sub(r"greatest\(0, least\((?:14|49), (floor\((?:\w+\.)?[xy] / 10\))\)\)", r"\1", sql.replace(CELLS, FRAMED))
    return re.sub(re.escape(GRID) + r", grid AS \(.*?iy_, ix_\)", lambda _: FRAMED_GRID, sql)


for _name in ("a5_histogram_2d", "r4_relative_threshold", "r18_ownership", "r20_subsume"):
    _text = framed_sql((SQL | REGION_SQL)[_name])
    QUERIES[f"{_name}_framed"] = (_sql(_text), oracle(_text))


def framed(f):
    """Registers f as NAME_framed with the framed SQL of NAME."""
    name = f.__name__.removesuffix("_framed")
    QUERIES[f.__name__] = (f, framed_sql(QUERIES[name][1]))
    return f


def layer(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    points, nx, ny = framed_cells(spark, sf_dir)
    return spatial.rasterise(points.filter(F.col("cell_type") == kind), nx, ny)


@framed
def tumor_boundary_distance_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nx, ny = framed_cells(spark, sf_dir)
    sdf = spatial.signed_distance(*framed_mask(spark, sf_dir))
    return spatial.at_pixel(points, nx, ny).join(sdf, spatial.KEY).select("cell_id", "sample", F.round("sdf", 6).alias("dist_um"), (F.col("sdf") <= 0).alias("inside"))


@framed
def r9_signed_distance_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.signed_distance(*framed_mask(spark, sf_dir)).withColumn("sdf", F.round("sdf", 6))


@framed
def r5_dilate_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return spatial.dilate(m, 2, nx, ny)


@framed
def r5_erode_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return spatial.erode(spatial.dilate(m, 2, nx, ny), 2)


@framed
def r6_disk_count_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nx, ny = framed_cells(spark, sf_dir)
    return spatial.disk_count(spatial.rasterise(points, nx, ny), 2, nx, ny).filter("n >= 5")


@framed
def r8_components_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.remove_small(framed_mask(spark, sf_dir)[0], 3).select("sample", "iy", "ix", "region", "size")


@framed
def r10_interface_distance_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return regions.interface_distance(m, layer(spark, sf_dir, "view"), nx, ny).withColumn("distance", F.round("distance", 6))


@framed
def r17_halo_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return regions.halo(m, layer(spark, sf_dir, "view"), 2, nx, ny)


@framed
def r27_tile_components_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.remove_small(framed_mask(spark, sf_dir)[0], 2, eight=True).select("sample", "iy", "ix", "region", "size")


@framed
def r29_shell_index_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return regions.shell_index(m, layer(spark, sf_dir, "click"), 2, nx, ny).withColumn("shell_index", F.round("shell_index", 6))


@framed
def r32_surface_metrics_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    d = regions.surface_metrics(m, layer(spark, sf_dir, "view").select(*spatial.KEY), nx, ny)
    return d.select("sample", *[F.round(c, 6).alias(c) for c in ("surface_dice", "assd", "hd95")])


@framed
def x15_thickest_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.thickest(*framed_mask(spark, sf_dir)).withColumn("diameter", F.round("diameter", 6))


@query(f"WITH {FRAMED}, n AS (SELECT sample, CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(x / 10) AS BIGINT) AS ix, count(*) AS n FROM cells GROUP BY 1, 2, 3), {FRAMED_GRID.replace('FROM mask', 'FROM n')} SELECT g.sample, g.iy, g.ix, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS total FROM grid g LEFT JOIN n ON n.sample = g.sample AND n.iy BETWEEN g.iy - 2 AND g.iy + 2 AND n.ix BETWEEN g.ix - 2 AND g.ix + 2 GROUP BY 1, 2, 3")
def w12_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nx, ny = framed_cells(spark, sf_dir)
    return spatial.window_sum(spatial.rasterise(points, nx, ny), 2, nx, ny)


def r3_gaussian_density_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL, whose kernel tables are of one size."""
    d = framed_density(spark, sf_dir)[0]
    return d.groupBy("sample").agg(F.count("*").alias("n_pixels"), F.round(F.max("density"), 6).alias("peak"), F.round(F.sum("density"), 4).alias("mass"), F.count_if(F.col("density") > 0.5).alias("dense"))


QUERIES["r3_gaussian_density_framed"] = (r3_gaussian_density_framed, None)
