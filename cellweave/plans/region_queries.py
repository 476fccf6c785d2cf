"""Queries over regions, tiles, sections and resamples; registered in the catalog when the package is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators import grouped, linking, regions, spatial
from cellweave.operators.graph import _cut, components
from cellweave.sources.tables import cells, table

from .catalog import DISK, MASK, NX, NY, QUERIES, _sql, framed_cells, framed_density, framed_mask, mask, query
from .relational import CELLS, SCORES, oracle

PX = f"{CELLS}, px AS (SELECT cell_id, sample, cell_type, x, y, CAST(greatest(0, least({NY - 1}, floor(y / 10))) AS BIGINT) AS iy, CAST(greatest(0, least({NX - 1}, floor(x / 10))) AS BIGINT) AS ix FROM cells)"


def _values(name: str, columns: str, rows) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(map(str, rows))}) AS t({columns}))"


AROUND = _values("around", "dy, dx", [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
HANN = "greatest(CAST(0.05 AS DOUBLE), 0.5 - 0.5 * cos(2 * pi() * (g.iy - t.y0 + 1) / 11)) * greatest(CAST(0.05 AS DOUBLE), 0.5 - 0.5 * cos(2 * pi() * (g.ix - t.x0 + 1) / 11))"

SQL: dict[str, str | tuple[str, str]] = {
    "r4_relative_threshold": f"WITH {PX}, g AS (SELECT sample, iy, ix, count(*) AS n FROM px GROUP BY 1, 2, 3) SELECT sample, iy, ix, n FROM (SELECT *, max(n) OVER (PARTITION BY sample) AS peak FROM g) t WHERE n > 0.5 * peak",
    "r18_ownership": f"WITH {PX} SELECT sample, iy, ix, min(cell_id % 7) AS first_come, max(cell_id % 7) AS last_painted FROM px GROUP BY sample, iy, ix",
    "r21_adaptive_radii": f"WITH {PX}, d AS (SELECT sample, count(*) / greatest((max(x) - min(x)) * (max(y) - min(y)) / 1000000, 0.000001) AS density FROM px GROUP BY sample) SELECT sample, round(45 * least(2.0, greatest(0.5, pow(CAST(300 AS DOUBLE) / greatest(density, 0.000001), 0.5))), 6) AS link_um, round(30 * least(1.5, greatest(0.5, pow(CAST(300 AS DOUBLE) / greatest(density, 0.000001), 0.25))), 6) AS grab_um FROM d",
    "r24_covering_tiles": (
        "SELECT s_suppkey, CAST(start AS BIGINT) AS start FROM (SELECT s_suppkey, explode(array_distinct(concat(sequence(0, n - 20, 12), array(n - 20)))) AS start FROM (SELECT s_suppkey, greatest(20, 15 + s_nationkey) AS n FROM supplier) s) t",
        "SELECT s_suppkey, CAST(unnest(list_distinct(list_append(range(0, n - 19, 12), n - 20))) AS BIGINT) AS start FROM (SELECT s_suppkey, CAST(greatest(20, 15 + s_nationkey) AS BIGINT) AS n FROM supplier) s",
    ),
    "r25_region_tiles": (
        f"WITH {CELLS}, b AS (SELECT sample, cell_type, min(x) AS x0, max(x) AS x1 FROM cells GROUP BY 1, 2) SELECT sample, cell_type, CAST(k AS BIGINT) AS tile, round(x0 + 64 * k, 6) AS centre FROM (SELECT *, explode(sequence(0, CAST(ceil((x1 - x0) / 64) AS INT))) AS k FROM b) t WHERE x0 + 64 * k < x1",
        f"WITH {CELLS}, b AS (SELECT sample, cell_type, min(x) AS x0, max(x) AS x1 FROM cells GROUP BY 1, 2) SELECT sample, cell_type, CAST(k AS BIGINT) AS tile, round(x0 + 64 * k, 6) AS centre FROM (SELECT *, unnest(range(0, CAST(ceil((x1 - x0) / 64) AS BIGINT) + 1)) AS k FROM b) t WHERE x0 + 64 * k < x1",
    ),
    "r28_bivariate_moran": f"""WITH {PX}, {AROUND}, g AS (SELECT sample, iy, ix, CAST(count_if(cell_type = 'click') AS DOUBLE) AS a, CAST(count_if(cell_type = 'error') AS DOUBLE) AS b FROM px GROUP BY 1, 2, 3),
      s AS (SELECT sample, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM g GROUP BY sample HAVING count(*) >= 4 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0),
      z AS (SELECT g.sample, iy, ix, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM g JOIN s ON g.sample = s.sample),
      m AS (SELECT sample, za, (iy + dy + {NY}) % {NY} AS jy, (ix + dx + {NX}) % {NX} AS jx, iy, ix FROM z CROSS JOIN around),
      v AS (SELECT m.sample, m.iy, m.ix, m.za, avg(z.zb) AS nb FROM m JOIN z ON m.sample = z.sample AND m.jy = z.iy AND m.jx = z.ix GROUP BY 1, 2, 3, 4) SELECT sample, round(avg(za * nb), 6) AS moran FROM v GROUP BY sample""",
    "r33_hann_blend": f"""WITH {PX}, g AS (SELECT sample, iy, ix, count(*) AS n FROM px GROUP BY 1, 2, 3), {_values("t", "y0, x0", [(y, x) for y in (0, 5) for x in range(0, 45, 5)])},
      h AS (SELECT g.sample, t.y0, t.x0, g.iy, g.ix, {HANN} AS w, avg(g.n) OVER (PARTITION BY g.sample, t.y0, t.x0) AS v FROM g JOIN t ON g.iy >= t.y0 AND g.iy < t.y0 + 10 AND g.ix >= t.x0 AND g.ix < t.x0 + 10) SELECT sample, iy, ix, round(sum(w * v) / sum(w), 6) AS blended FROM h GROUP BY sample, iy, ix""",
    "r34_edge_artifacts": f"""WITH {CELLS}, f AS (SELECT sample, cell_type, (x < 40 OR y < 2) AS band, x < 20 AS zone_hit, cell_id % 3 = 0 AS touch FROM cells), k AS (SELECT *, band AND (zone_hit OR touch) AS kill FROM f)
      SELECT sample, cell_type, count_if(kill) AS killed, coalesce(avg(CASE WHEN kill THEN CAST(1 AS DOUBLE) ELSE 0 END) >= 0.8 OR avg(CASE WHEN zone_hit AND band THEN CAST(1 AS DOUBLE) ELSE 0 END) >= 0.35 OR avg(CASE WHEN touch AND band THEN CAST(1 AS DOUBLE) ELSE 0 END) >= 0.5, true) AS dropped FROM k GROUP BY sample, cell_type""",
    "w13_coverage": f"""WITH r AS (SELECT s_suppkey % 11 AS y0, s_nationkey AS x0 FROM supplier), c AS (SELECT y0 AS iy, x0 AS ix, 1 AS d FROM r UNION ALL SELECT y0 + 4, x0, -1 FROM r UNION ALL SELECT y0, x0 + 6, -1 FROM r UNION ALL SELECT y0 + 4, x0 + 6, 1 FROM r),
      {_values("ys", "iy", [f"({i})" for i in range(15)])}, {_values("xs", "ix", [f"({i})" for i in range(32)])}, g AS (SELECT ys.iy, xs.ix, coalesce(sum(c.d), 0) AS d FROM ys CROSS JOIN xs LEFT JOIN c ON c.iy = ys.iy AND c.ix = xs.ix GROUP BY 1, 2),
      a AS (SELECT iy, ix, sum(d) OVER (PARTITION BY iy ORDER BY ix ROWS UNBOUNDED PRECEDING) AS d FROM g) SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, CAST(sum(d) OVER (PARTITION BY ix ORDER BY iy ROWS UNBOUNDED PRECEDING) AS BIGINT) AS covered FROM a""",
    "j23_positional": """WITH a AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click'), b AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view'),
      n AS (SELECT user_id FROM events GROUP BY user_id HAVING count_if(event_type = 'click') = count_if(event_type = 'view')) SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM a JOIN b ON a.user_id = b.user_id AND a.k = b.k JOIN n ON a.user_id = n.user_id""",
    "j24_point_in_polygon": f"""WITH {CELLS}, {_values("edge", "x0, y0, x1, y1", ["(20.0, 1.0, 200.0, 3.0)", "(200.0, 3.0, 160.0, 70.0)", "(160.0, 70.0, 90.0, 8.0)", "(90.0, 8.0, 30.0, 90.0)", "(30.0, 90.0, 20.0, 1.0)"])}
      SELECT c.cell_id FROM cells c JOIN edge e ON (e.y0 > c.y) <> (e.y1 > c.y) AND c.x < (e.x1 - e.x0) * (c.y - e.y0) / (e.y1 - e.y0) + e.x0 GROUP BY c.cell_id HAVING count(*) % 2 = 1""",
    "j25_layer_touch": f"""WITH {CELLS}, r AS (SELECT sample, cell_type, avg(x) AS cx, avg(y) AS cy, sqrt(var_pop(x) + var_pop(y)) AS rad FROM cells GROUP BY sample, cell_type), p AS (SELECT a.sample, a.cell_type AS a, b.cell_type AS b, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d, a.rad + b.rad AS reach FROM r a JOIN r b ON b.sample = a.sample + 1)
      SELECT sample, a, b, round(d, 6) AS d FROM p WHERE d < 800 AND d - reach <= 10""",
    "r20_subsume": f"""WITH {PX}, t AS (SELECT DISTINCT sample, iy, ix FROM px WHERE cell_type IN ('click', 'view')), b AS (SELECT DISTINCT sample, cell_id % 5 AS body, iy, ix FROM px WHERE cell_type IN ('click', 'error')),
      c AS (SELECT b.sample, b.body, count(t.iy) / CAST(count(*) AS DOUBLE) AS covered FROM b LEFT JOIN t ON b.sample = t.sample AND b.iy = t.iy AND b.ix = t.ix GROUP BY b.sample, b.body) SELECT sample, count_if(covered > 0.6) AS n_covered, count_if(covered > 0.6) >= 2 AS replaces FROM c GROUP BY sample""",
    "x19_quality_summary": "SELECT n.n_name, count(c.c_custkey) AS n, CASE WHEN count(c.c_custkey) > 0 THEN round(percentile(c.c_acctbal, 0.5), 4) END AS median FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY n.n_name",
    "x12_collinear_join": f"""WITH {CELLS}, s AS (SELECT sample, cell_type, avg(x) AS cx, avg(y) AS cy, regr_slope(y, x) AS m, max(x) AS x1, min(x) AS x0 FROM cells GROUP BY sample, cell_type) SELECT a.sample, a.cell_type AS a, b.cell_type AS b FROM s a JOIN s b ON a.sample = b.sample AND a.cell_type < b.cell_type
      WHERE abs(atan(a.m) - atan(b.m)) <= radians(5) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 150""",
    "x1_feature_match": f"""WITH {CELLS}, r AS (SELECT sample, cell_type, CAST(floor(y / 40) AS BIGINT) AS lane, avg(x) AS cx, avg(y) AS cy, count(*) AS area FROM cells GROUP BY 1, 2, 3), p AS (SELECT a.sample, a.cell_type, a.lane AS a, b.lane AS b, (1 - sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / 300) * least(1, sqrt(CAST(least(a.area, b.area) AS DOUBLE) / 20)) AS score FROM r a JOIN r b ON b.sample = a.sample + 1 AND b.cell_type = a.cell_type WHERE least(a.area, b.area) >= 0.3 * greatest(a.area, b.area)),
      k AS (SELECT *, row_number() OVER (PARTITION BY sample, cell_type, a ORDER BY round(score, 9) DESC, b) AS i, row_number() OVER (PARTITION BY sample, cell_type, b ORDER BY round(score, 9) DESC, a) AS j FROM p WHERE score > 0) SELECT sample, cell_type, a, b, round(score, 6) AS score FROM k WHERE i = 1 AND j = 1""",
    "j16_adaptive_links": f"""WITH {CELLS}, r AS (SELECT sample AS z, cell_type, CAST(floor(y / 40) AS BIGINT) AS lane, avg(x) AS cx, avg(y) AS cy, 10 * sqrt(count(*) / pi()) AS rad FROM cells GROUP BY 1, 2, 3), p AS (SELECT a.z, a.cell_type, a.lane AS a, b.lane AS b, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d, greatest(15 + 2 * (b.z - a.z), 0.8 * (a.rad + b.rad)) AS tolerance FROM r a JOIN r b ON b.z = a.z + 1 AND b.cell_type = a.cell_type),
      k AS (SELECT *, row_number() OVER (PARTITION BY z, cell_type, a ORDER BY round(d, 9), b) AS i, row_number() OVER (PARTITION BY z, cell_type, b ORDER BY round(d, 9), a) AS j, lead(d) OVER (PARTITION BY z, cell_type, a ORDER BY round(d, 9), b) AS second FROM p)
      SELECT z, cell_type, a, b, round(d, 6) AS d, round(tolerance, 6) AS tolerance, round(second / nullif(d, 0), 6) AS margin FROM k WHERE i = 1 AND j = 1 AND d <= tolerance""",
    "x3_anchors_per_square":f"WITH {CELLS} SELECT sample, qy, qx, cell_id FROM (SELECT sample, cell_id, CAST(floor(y / 50) AS BIGINT) AS qy, CAST(floor(x / 100) AS BIGINT) AS qx, row_number() OVER (PARTITION BY sample, floor(y / 50), floor(x / 100) ORDER BY cell_id % 97 DESC, cell_id) AS k FROM cells) t WHERE k = 1",
    "x14_gap_rescue": f"""WITH {CELLS}, r AS (SELECT sample, cell_type, avg(x) AS cx, avg(y) AS cy FROM cells GROUP BY sample, cell_type), m AS (SELECT a.sample + 1 AS sample, a.cell_type, (a.cx + b.cx) / 2 AS cx, (a.cy + b.cy) / 2 AS cy FROM r a JOIN r b ON b.sample = a.sample + 2 AND b.cell_type = a.cell_type)
      SELECT m.sample, m.cell_type, count(*) AS n FROM m JOIN cells c ON c.sample = m.sample AND sqrt((c.x - m.cx) * (c.x - m.cx) + (c.y - m.cy) * (c.y - m.cy)) <= 30 GROUP BY m.sample, m.cell_type HAVING count(*) >= 8""",
    "g6_bridged_ends": f"""WITH {CELLS}, r AS (SELECT sample AS z, cell_type, avg(x) AS cx, avg(y) AS cy, count(*) AS area FROM cells GROUP BY 1, 2), p AS (SELECT a.z AS z, a.cell_type AS a, b.z AS z2, b.cell_type AS b, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d FROM r a JOIN r b ON b.z = a.z + 2 WHERE least(a.area, b.area) >= 0.3 * greatest(a.area, b.area)),
      k AS (SELECT *, row_number() OVER (PARTITION BY z, a ORDER BY round(d, 9), b) AS i, row_number() OVER (PARTITION BY z2, b ORDER BY round(d, 9), a) AS j FROM p) SELECT z, a, z2, b, round(d, 6) AS d FROM k WHERE i = 1 AND j = 1""",
    "s13_row_count": "SELECT count(*) AS n FROM lineitem",
    "s2_sample_scan": "SELECT event_id, user_id FROM events WHERE user_id = 7",
    "s3_listed_scan": "SELECT e.event_id, e.value FROM events e WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_nationkey < 5)",
    "s9_panel_lookup": "SELECT l_suppkey, l_orderkey, sum(l_quantity) AS n FROM lineitem WHERE l_suppkey IN (3, 5) GROUP BY l_suppkey, l_orderkey HAVING sum(l_quantity) >= 20",
}
for _name, _text in SQL.items():
    QUERIES[_name] = (_sql(_text if isinstance(_text, str) else _text[0]), oracle(_text))


def j16_adaptive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of a cell type that are nearest to each other in successive sections, without a table of all pairs of lanes."""
    n = cells(spark, sf_dir).groupBy(F.col("sample").alias("z"), F.col("cell_type").alias("kind"), F.floor(F.col("y") / 40).alias("lane")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), (10 * F.sqrt(F.count("*") / F.pi())).alias("rad"))
    a = _cut(n)
    b = a.withColumn("z", F.col("z") - 1)
    to, back = linking.lane_nearest(a, b, 40.0), linking.lane_nearest(b, a, 40.0, k=1)
    key = ["z", "kind"]
    pairs = to.groupBy(*key, F.col("lane").alias("a")).agg(*[F.max(F.when(F.col("rank") == i, F.col(c))).alias(k) for i, c, k in ((1, "to", "b"), (1, "d", "d"), (2, "d", "second"))])
    mutual = pairs.join(back.select(*key, F.col("lane").alias("b"), F.col("to").alias("a")), [*key, "a", "b"])
    size = lambda df, k: df.select(*key, F.col("lane").alias(k), F.col("rad").alias(f"rad_{k}"))
    full = mutual.join(size(a, "a"), [*key, "a"]).join(size(b, "b"), [*key, "b"]).withColumn("tolerance", F.greatest(F.lit(17.0), 0.8 * (F.col("rad_a") + F.col("rad_b"))))
    margin = F.round(F.col("second") / F.nullif(F.col("d"), F.lit(0.0)), 6).alias("margin")
    return full.filter(F.col("d") <= F.col("tolerance")).select("z", F.col("kind").alias("cell_type"), "a", "b", F.round("d", 6).alias("d"), F.round("tolerance", 6).alias("tolerance"), margin)


QUERIES["j16_adaptive_links"] = (j16_adaptive_links, QUERIES["j16_adaptive_links"][1])


def layer(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return spatial.rasterise(cells(spark, sf_dir).filter(F.col("cell_type") == kind), NX, NY)


def one_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells counted from the corner of one frame around all sections, for what compares pixels of different sections."""
    every = cells(spark, sf_dir)
    points, nx, ny = spatial.framed(every.withColumn("section", F.col("sample")).withColumn("sample", F.lit(0)))
    nx, ny = (every.select("sample").distinct().crossJoin(F.broadcast(n.select("n"))) for n in (nx, ny))
    return points.withColumn("sample", F.col("section")).drop("section"), nx, ny


OTHER = f"other AS (SELECT DISTINCT sample, CAST(greatest(0, least({NY - 1}, floor(y / 10))) AS BIGINT) AS iy, CAST(greatest(0, least({NX - 1}, floor(x / 10))) AS BIGINT) AS ix FROM cells WHERE cell_type = 'view')"
CROSS = "(ABS(dy) + ABS(dx) <= 1)"
FACE = f"inner_ AS (SELECT m.sample, m.iy, m.ix FROM mask m CROSS JOIN disk d JOIN mask e ON e.sample = m.sample AND e.iy = m.iy + d.dy AND e.ix = m.ix + d.dx WHERE {CROSS} GROUP BY 1, 2, 3 HAVING count(*) = 5), near_ AS (SELECT DISTINCT o.sample, o.iy + dy AS iy, o.ix + dx AS ix FROM other o, disk), face AS (SELECT m.* FROM mask m ANTI JOIN inner_ USING (sample, iy, ix) SEMI JOIN near_ USING (sample, iy, ix))"


@query(f"WITH {MASK}, {OTHER}, {DISK}, {FACE}, d AS (SELECT g.sample, g.iy, g.ix, min((g.iy - f.iy) * (g.iy - f.iy) + (g.ix - f.ix) * (g.ix - f.ix)) AS d FROM grid g JOIN face f ON g.sample = f.sample GROUP BY 1, 2, 3) SELECT d.sample, d.iy, d.ix, CASE WHEN d = 0 THEN 0.0::DOUBLE ELSE round(sqrt(d) * 10 * CASE WHEN m.sample IS NULL THEN 1 ELSE -1 END, 6) END AS distance FROM d LEFT JOIN mask m ON d.sample = m.sample AND d.iy = m.iy AND d.ix = m.ix")
def r10_interface_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.interface_distance(mask(spark, sf_dir), layer(spark, sf_dir, "view"), NX, NY).withColumn("distance", F.round("distance", 6))


@query()
def r11_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nx, ny = framed_cells(spark, sf_dir)
    return regions.tissue(spatial.rasterise(points, nx, ny), nx, ny, 1.0, 0.015, 1)


@query()
def r12_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.local_maxima(framed_density(spark, sf_dir)[0], 3)


@query()
def r14_merged_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, nx, ny = framed_density(spark, sf_dir)
    return regions.merge_basins(grouped.watershed(d, nx, ny), d, 0.5)


@query(f"WITH {MASK}, {OTHER}, {DISK} SELECT DISTINCT o.sample, o.iy, o.ix FROM other o JOIN mask m ON o.sample = m.sample JOIN disk d ON o.iy = m.iy + d.dy AND o.ix = m.ix + d.dx")
def r17_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.halo(mask(spark, sf_dir), layer(spark, sf_dir, "view"), 2, NX, NY)


@query()
def r22_mask_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return spatial.fill_holes(spatial.closing(m, 3, nx, ny), nx, ny)


@query()
def r23_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nx, ny = framed_cells(spark, sf_dir)
    seeds = points.groupBy("sample", F.crc32("cell_type").alias("region")).agg(F.round(F.avg("y") / 10).cast("long").alias("iy"), F.round(F.avg("x") / 10).cast("long").alias("ix"), F.least(F.count("*"), F.lit(12)).alias("target"))
    return grouped.grow(seeds, spatial.rasterise(points, nx, ny).select(*spatial.KEY).toDF(*spatial.KEY))


@query(f"WITH RECURSIVE {MASK}, m AS (SELECT *, sample * 1099511627776 + iy * 1048576 + ix AS node FROM mask), e AS (SELECT a.node AS a, b.node AS b FROM m a JOIN m b ON a.sample = b.sample AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1), r AS (SELECT node AS a, node AS b FROM m UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS node, min(b) AS region FROM r GROUP BY a), s AS (SELECT region, count(*) AS size FROM c GROUP BY region) SELECT m.sample, m.iy, m.ix, c.region, s.size FROM m JOIN c USING (node) JOIN s USING (region) WHERE s.size >= 2")
def r27_tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.remove_small(mask(spark, sf_dir), 2, eight=True).select("sample", "iy", "ix", "region", "size")


@query(f"WITH {MASK}, {DISK}, n AS (SELECT sample, CAST(greatest(0, least({NY - 1}, floor(y / 10))) AS BIGINT) AS iy, CAST(greatest(0, least({NX - 1}, floor(x / 10))) AS BIGINT) AS ix, count(*) AS n FROM cells WHERE cell_type = 'click' GROUP BY 1, 2, 3), rim AS (SELECT DISTINCT g.* FROM grid g JOIN mask m ON g.sample = m.sample JOIN disk d ON g.iy = m.iy + d.dy AND g.ix = m.ix + d.dx ANTI JOIN mask k ON k.sample = g.sample AND k.iy = g.iy AND k.ix = g.ix), a AS (SELECT sample, count(*) AS a, sum(coalesce(n, 0)) AS n FROM mask LEFT JOIN n USING (sample, iy, ix) GROUP BY sample), o AS (SELECT sample, count(*) AS a, sum(coalesce(n, 0)) AS n FROM rim LEFT JOIN n USING (sample, iy, ix) GROUP BY sample) SELECT a.sample, CAST(a.n AS BIGINT) AS n_in, CAST(coalesce(o.n, 0) AS BIGINT) AS n_out, CASE WHEN o.a IS NULL THEN NULL WHEN a.n > 0 THEN round((o.n / o.a) / (a.n / a.a), 6) WHEN o.n > 0 THEN 'inf'::DOUBLE END AS shell_index FROM a LEFT JOIN o USING (sample)")
def r29_shell_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.shell_index(mask(spark, sf_dir), layer(spark, sf_dir, "click"), 2, NX, NY).withColumn("shell_index", F.round("shell_index", 6))


@query()
def r31_supported_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nx, ny = one_frame(spark, sf_dir)
    return regions.supported(points.filter("cell_type = 'click'"), nx, ny, planes=2, cells=4, single=50, around=3, box=2)


SQUARE = "sq AS (SELECT dy, dx FROM (SELECT unnest(range(-1, 2)) AS dy) a, (SELECT unnest(range(-1, 2)) AS dx) b)"


def _edge(name: str) -> str:
    return f"{name}_s AS (SELECT m.* FROM {name} m ANTI JOIN (SELECT m.sample, m.iy, m.ix FROM {name} m CROSS JOIN sq d JOIN {name} e ON e.sample = m.sample AND e.iy = m.iy + d.dy AND e.ix = m.ix + d.dx GROUP BY 1, 2, 3 HAVING count(*) = 9) w USING (sample, iy, ix))"


@query(f"WITH {MASK}, {OTHER}, {SQUARE}, {_edge('mask')}, {_edge('other')}, p AS (SELECT a.sample, a.iy, a.ix, 1 AS k, sqrt(min((a.iy - b.iy) * (a.iy - b.iy) + (a.ix - b.ix) * (a.ix - b.ix))) * 10 AS d FROM mask_s a JOIN other_s b ON a.sample = b.sample GROUP BY 1, 2, 3 UNION ALL SELECT a.sample, a.iy, a.ix, 2, sqrt(min((a.iy - b.iy) * (a.iy - b.iy) + (a.ix - b.ix) * (a.ix - b.ix))) * 10 FROM other_s a JOIN mask_s b ON a.sample = b.sample GROUP BY 1, 2, 3), e AS (SELECT sample FROM mask UNION SELECT sample FROM other) SELECT e.sample, coalesce(round(avg(CASE WHEN d <= 20 THEN 1.0 WHEN d > 20 THEN 0.0 END), 6), 0) AS surface_dice, round(avg(d), 6) AS assd, round(quantile_cont(d, 0.95), 6) AS hd95 FROM e LEFT JOIN p ON e.sample = p.sample GROUP BY e.sample")
def r32_surface_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = regions.surface_metrics(mask(spark, sf_dir), layer(spark, sf_dir, "view").select(*spatial.KEY), NX, NY)
    return m.select("sample", *[F.round(c, 6).alias(c) for c in ("surface_dice", "assd", "hd95")])


@query(f"WITH {CELLS}, p AS (SELECT a.sample, a.cell_id AS a, b.cell_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cells a JOIN cells b ON a.sample = b.sample WHERE a.cell_type = 'click' AND b.cell_type = 'error') SELECT sample, a, b, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p) t WHERE k = 1")
def j12_nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = cells(spark, sf_dir).filter("cell_type = 'click'"), cells(spark, sf_dir).filter("cell_type = 'error'")
    return regions.nearest_any(a, b, 15.0, 960.0).withColumn("d", F.round("d", 6))


@query()
def j21_best_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as they were (one half of the order lines) and are (the other half), matched by the parts they share."""
    half = lambda k: table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") % 2 == k).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").cast("long").alias("sample"), F.col("l_suppkey").cast("long").alias("id"), (F.col("l_partkey") % 200).alias("m")).distinct()
    old, new = half(0).withColumnRenamed("id", "old"), half(1).withColumnRenamed("id", "new")
    return grouped.best_sets(old, new)


@query("WITH RECURSIVE o AS (SELECT o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders), e AS (SELECT DISTINCT a.c AS a, b.c AS b FROM o a JOIN (SELECT v, min(c) AS c FROM o GROUP BY v) b ON a.v = b.v), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT c AS a, c AS b FROM o UNION SELECT r.a, f.b FROM r JOIN f ON r.b = f.a) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def g3_shared_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers joined by a shared value: each value links its customers to the smallest, a star in place of all pairs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.floor("o_totalprice").alias("v"))
    e = o.join(o.groupBy("v").agg(F.min("a").alias("b")), "v").select("a", "b").filter("a <> b")
    return components(o.select(F.col("a").alias("node")), e)


def section_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).groupBy(F.crc32("cell_type").alias("k"), "sample").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    b = c.select("k", F.col("sample").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = c.join(b, "k").filter("b > sample and b - sample <= 3")
    return near.select(F.col("k").alias("sample"), F.col("sample").alias("a"), "b", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")).alias("w"), (F.col("bx") - F.col("x")).alias("d"))


@query()
def g4_spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.spanning_tree(section_edges(spark, sf_dir))


@query()
def g5_chained_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = grouped.spanning_tree(section_edges(spark, sf_dir))
    return grouped.chain(tree.select("sample", "a", "b", F.array(F.lit(1.0), F.lit(0.0), F.col("w"), F.lit(0.0), F.lit(1.0), -F.col("w")).alias("m")))


@query()
def g9_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.consensus(section_edges(spark, sf_dir), 30.0)


@query()
def a33_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return grouped.shape(spatial.lattice_components(spatial.dilate(m, 2, nx, ny)))


@query(f"WITH RECURSIVE {CELLS}, p AS (SELECT a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON a.sample = b.sample AND a.cell_id <> b.cell_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4), k AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 3), h AS (SELECT p.a, p.b FROM p JOIN k ON p.a = k.a), e AS (SELECT a, b FROM h UNION SELECT b, a FROM h), r AS (SELECT cell_id AS a, cell_id AS b FROM cells UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def x10_dense_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.dense_components(cells(spark, sf_dir), 4.0, 3)


@query(f"WITH {CELLS}, s AS (SELECT a.cell_id, count(*) AS n, var_pop(b.x) AS p, var_pop(b.y) AS q, covar_pop(b.x, b.y) AS r FROM cells a JOIN cells b ON a.sample = b.sample AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 10 GROUP BY a.cell_id), t AS (SELECT *, sqrt(pow((p - q) / 2, 2) + r * r) AS root FROM s) SELECT cell_id, n, CASE WHEN n >= 4 AND (p + q) / 2 + root > 0 THEN round(2 * root / ((p + q) / 2 + root), 5) END AS linearity FROM t")
def x8_linearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.linearity(cells(spark, sf_dir), 10.0, 4).withColumn("linearity", F.round("linearity", 5))


@query(f"WITH {MASK}, rest AS (SELECT g.* FROM grid g ANTI JOIN mask m USING (sample, iy, ix)), d AS (SELECT m.sample, m.iy, m.ix, min((m.iy - r.iy) * (m.iy - r.iy) + (m.ix - r.ix) * (m.ix - r.ix)) AS d FROM mask m JOIN rest r ON m.sample = r.sample GROUP BY 1, 2, 3) SELECT sample, round(20 * sqrt(max(d)), 6) AS diameter FROM d GROUP BY sample")
def x15_thickest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.thickest(mask(spark, sf_dir), NX, NY).withColumn("diameter", F.round("diameter", 6))


def uniform(*key: str):
    """In 0..1 from 20 bits of the key's MD5, which every engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key])), 1, 5), 16, 10).cast("long") / float(1 << 20)


def uniform_sql(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 5))::BIGINT / 1048576.0::DOUBLE)"


def poisson(*key: str):
    """A resampling weight of mean 1 from a hash of the key: the same on every run and however rows are dealt."""
    u = uniform(*key)
    return F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.9810, 3).otherwise(4)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", ((F.col("n_chars") % 997) / F.lit(997.0)).alias("p"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(d, "doc_id")


TEXTS = "WITH s AS (SELECT l.doc_id, l.quality AS y, d.source, d.lang, (d.n_chars % 997) / 997.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))"


@query(f"""{TEXTS}, g AS (SELECT lang, source, count(*) AS n, sum(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END - CASE WHEN (p >= 0.3) = (y = 1) THEN 1 ELSE 0 END) AS d FROM s GROUP BY 1, 2), u AS (SELECT *, {uniform_sql('lang', 'source', 'rep')} AS u FROM g, range(0, 1000) r(rep)),
  w AS (SELECT *, CASE WHEN u < 0.3679 THEN 0 WHEN u < 0.7358 THEN 1 WHEN u < 0.9197 THEN 2 WHEN u < 0.9810 THEN 3 ELSE 4 END AS w FROM u), m AS (SELECT lang, rep, sum(w * d) / nullif(sum(w * n), 0)::DOUBLE AS m FROM w GROUP BY 1, 2) SELECT lang, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m GROUP BY lang""")
def a24_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of the difference of two scorers' accuracy: patients are resampled within their stratum, after their
    rows were added up, so replicates multiply patients and never rows."""
    s = scores(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int") - ((F.col("p") >= 0.3).cast("int") == F.col("y")).cast("int")).alias("d"))
    r = s.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn("w", poisson("lang", "source", "rep"))
    m = r.groupBy("lang", "rep").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    return m.groupBy("lang").agg(F.round(F.expr("percentile(m, 0.025)"), 8).alias("low"), F.round(F.expr("percentile(m, 0.975)"), 8).alias("high"))


@query(f"""{TEXTS}, c AS (SELECT count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM s), d AS (SELECT s.*, rep FROM s, c, range(0, 100) r(rep) WHERE y = 0 OR {uniform_sql('doc_id', 'rep')} < least(1.0::DOUBLE, 0.05 / 0.95::DOUBLE * neg / pos)), t AS (SELECT rep, p, count(*) AS n, sum(y) AS k FROM d GROUP BY 1, 2),
  a AS (SELECT *, sum(k) OVER w AS tp, sum(n) OVER w AS at_ FROM t WINDOW w AS (PARTITION BY rep ORDER BY p DESC)), m AS (SELECT rep, sum(k * tp / at_::DOUBLE) / nullif(sum(k), 0) AS ap FROM a GROUP BY rep) SELECT round(avg(ap), 8) AS mean_ap, round(stddev_samp(ap), 8) AS sd_ap FROM m""")
def a25_prevalence_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision at a prevalence of 0.05: negatives stay, positives are drawn by hash at the rate that gives it; 100 draws."""
    s = scores(spark, sf_dir)
    c = s.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    rate = F.least(F.lit(1.0), 0.05 / 0.95 * F.col("neg") / F.col("pos"))
    u = uniform("doc_id", "rep")
    drawn = s.crossJoin(F.broadcast(c)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(99)))).filter((F.col("y") == 0) | (u < rate))
    t = drawn.groupBy("rep", "p").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    up = Window.partitionBy("rep").orderBy(F.desc("p"))
    a = t.withColumn("tp", F.sum("k").over(up)).withColumn("at", F.sum("n").over(up)).groupBy("rep").agg((F.sum(F.col("k") * F.col("tp") / F.col("at")) / F.nullif(F.sum("k"), F.lit(0))).alias("ap"))
    return a.agg(F.round(F.avg("ap"), 8).alias("mean_ap"), F.round(F.stddev_samp("ap"), 8).alias("sd_ap"))


@query(f"""WITH {CELLS}, m AS (SELECT sample, avg(x) AS v FROM cells GROUP BY 1), r AS (SELECT *, CASE WHEN rep = 0 THEN sample / 1000.0::DOUBLE ELSE {uniform_sql('sample', 'rep')} END AS place FROM m, range(0, 201) r(rep)), s AS (SELECT rep, abs(v - lag(v) OVER (PARTITION BY rep ORDER BY place, sample)) AS step FROM r), t AS (SELECT rep, sum(step) AS total FROM s GROUP BY rep)
  SELECT round(a.total, 6) AS real, (1 + count(CASE WHEN b.total <= a.total THEN 1 END)) / (1 + count(*))::DOUBLE AS p_value FROM t a JOIN t b ON a.rep = 0 AND b.rep > 0 GROUP BY a.total""")
def a30_permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of 200 reorderings of the sections whose summed step of neighbouring sections' means is no larger than the real one."""
    m = cells(spark, sf_dir).groupBy("sample").agg(F.avg("x").alias("v"))
    r = m.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(200))))
    order = F.when(F.col("rep") == 0, F.col("sample") / 1000.0).otherwise(uniform("sample", "rep"))
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("rep").orderBy(order, "sample")))
    t = r.withColumn("step", step).groupBy("rep").agg(F.sum("step").alias("total"))
    real = t.filter("rep = 0").select(F.col("total").alias("real"))
    return t.filter("rep > 0").crossJoin(F.broadcast(real)).groupBy("real").agg(((1 + F.count_if(F.col("total") <= F.col("real"))) / (1 + F.count("*"))).alias("p_value")).withColumn("real", F.round("real", 6))


@query()
def g8_linked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions followed through the sections by the pixels they share; `track` is the smallest member."""
    points, nx, ny = one_frame(spark, sf_dir)
    m = spatial.rasterise(points.filter("cell_type = 'purchase'"), nx, ny).select(*spatial.KEY)
    r = spatial.lattice_components(spatial.dilate(m, 2, nx, ny))
    links = grouped.link(regions.overlaps(r, r.withColumn("sample", F.col("sample") - 1)).select("sample", "a", "b", F.greatest("of_a", "of_b").alias("share")))
    c = components(r.select(F.col("region").alias("node")), links.select("a", "b"))
    spans = c.join(r.select(F.col("region").alias("node"), "sample").distinct(), "node")
    long = spans.groupBy("component").agg(F.countDistinct("sample").alias("n")).filter("n >= 3").select("component")
    return spans.join(long, "component", "left_semi").select("sample", F.col("node").alias("region"), F.col("component").alias("track"))
