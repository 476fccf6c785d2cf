"""Serpentine order, coverage by tiles and linearity in space as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import layout
from cellweave.sources.tables import cells, table

from .catalog import framed_mask, query
from .framed_queries import FRAMED
from .relational import CELLS


@query(f"WITH {CELLS}, f AS (SELECT sample, min(y) AS low, max(y) - min(y) AS span, CAST(greatest(1, round_even(sqrt(count(*)), 0)) AS BIGINT) AS k FROM cells GROUP BY 1), b AS (SELECT c.sample, cell_id, x, CASE WHEN span > 0 THEN least(CAST(floor((y - low) / span * k) AS BIGINT), k - 1) ELSE 0 END AS band FROM cells c JOIN f USING (sample)) SELECT sample, cell_id AS id, row_number() OVER (PARTITION BY sample ORDER BY band, CASE WHEN band % 2 = 0 THEN x ELSE -x END, cell_id) AS place FROM b")
def w7_serpentine_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About sqrt(n) bands of a section's own height."""
    return layout.serpentine(cells(spark, sf_dir).select("sample", F.col("cell_id").alias("id"), "x", "y"))


TILES = "tiles AS (SELECT p_partkey % 30 + 1 AS sample, p_size % 30 AS y0, p_partkey % 53 AS x0, 3 + p_size % 9 AS h, 4 + p_partkey % 13 AS w FROM part)"


@query(f"WITH {FRAMED}, mask AS (SELECT DISTINCT sample, CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(x / 10) AS BIGINT) AS ix FROM cells WHERE cell_type = 'purchase'), {TILES} SELECT m.sample, m.iy, m.ix, count(t.y0) AS covered FROM mask m LEFT JOIN tiles t ON t.sample = m.sample AND m.iy >= y0 AND m.iy < y0 + h AND m.ix >= x0 AND m.ix < x0 + w GROUP BY 1, 2, 3")
def w13_tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tiles, of sizes of their own, lie over each mask pixel; parts stand for tiles."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    tiles = p.select((key % 30 + 1).alias("sample"), (size % 30).alias("y0"), (key % 53).alias("x0"), (3 + size % 9).alias("h"), (4 + key % 13).alias("w"))
    return layout.coverage(tiles, framed_mask(spark, sf_dir)[0])


SPACE = f"""WITH {CELLS}, v AS (SELECT cell_id, x, y, sample * 4.0::DOUBLE AS z FROM cells WHERE cell_type = 'click'), s AS (SELECT a.cell_id, count(*) AS n, covar_pop(b.x, b.x) AS xx, covar_pop(b.y, b.y) AS yy, covar_pop(b.z, b.z) AS zz, covar_pop(b.x, b.y) AS xy, covar_pop(b.x, b.z) AS xz, covar_pop(b.y, b.z) AS yz FROM v a JOIN v b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 144 GROUP BY 1),
  m AS (SELECT *, xx + yy + zz AS t, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS u, xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy AS d FROM s),
  q AS (SELECT *, t * t - 3 * u AS f, t * t * t - 4.5 * t * u + 13.5 * d AS g FROM m), e AS (SELECT cell_id, n, t, (t + 2 * sqrt(f) * cos(acos(greatest(-1, least(1, g / sqrt(f * f * f)))) / 3)) / 3 AS top FROM q WHERE n >= 5 AND f > 0)
  SELECT s.cell_id, s.n, CASE WHEN t - top > 0.0000001 * top THEN round(top / (t - top), 4) END AS linearity FROM s LEFT JOIN e USING (cell_id)"""


@query(SPACE)
def x8_linearity_in_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of sections 4 apart, neighbours within 12, from five points on."""
    v = cells(spark, sf_dir).filter("cell_type = 'click'").select("cell_id", "x", "y", (F.col("sample") * 4.0).alias("z"))
    return layout.linearity_in_space(v, 12.0, 5).withColumn("linearity", F.round("linearity", 4))
