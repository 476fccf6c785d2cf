"""Every query by name: (function of session and data folder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import grouped, spatial
from cellweave.operators.graph import components
from cellweave.sources.tables import cells, table, views

from .relational import CELLS, SQL, oracle, plain_counts

NX, NY = 50, 15
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: views(spark, sf_dir, text).sql(text)


for _name, _text in SQL.items():
    QUERIES[_name] = (_sql(_text if isinstance(_text, str) else _text[0]), oracle(_text))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql and plain_counts(sql))
        return f

    return add


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.rasterise(cells(spark, sf_dir).filter("cell_type = 'purchase'"), NX, NY).select("sample", "iy", "ix")


def framed_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells counted from the corner of their section's own frame, with the frames' nx and ny."""
    return spatial.framed(cells(spark, sf_dir))


def framed_mask(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, nx, ny = framed_cells(spark, sf_dir)
    return spatial.rasterise(points.filter("cell_type = 'purchase'"), nx, ny).select(*spatial.KEY), nx, ny


def framed_density(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, nx, ny = framed_cells(spark, sf_dir)
    return spatial.gaussian(spatial.rasterise(points, nx, ny), 1.0, nx, ny), nx, ny


GRID = f"iy_(iy) AS (SELECT unnest(range(0, {NY}))), ix_(ix) AS (SELECT unnest(range(0, {NX})))"
MASK = f"{CELLS}, mask AS (SELECT DISTINCT sample, CAST(greatest(0, least({NY - 1}, floor(y / 10))) AS BIGINT) AS iy, CAST(greatest(0, least({NX - 1}, floor(x / 10))) AS BIGINT) AS ix FROM cells WHERE cell_type = 'purchase'), {GRID}, grid AS (SELECT s.sample, iy, ix FROM (SELECT DISTINCT sample FROM mask) s, iy_, ix_)"
SDF = """rest AS (SELECT g.* FROM grid g ANTI JOIN mask m USING (sample, iy, ix)),
  o AS (SELECT g.sample, g.iy, g.ix, min((g.iy - m.iy) * (g.iy - m.iy) + (g.ix - m.ix) * (g.ix - m.ix)) AS d FROM grid g JOIN mask m ON g.sample = m.sample GROUP BY 1, 2, 3),
  i AS (SELECT g.sample, g.iy, g.ix, min((g.iy - m.iy) * (g.iy - m.iy) + (g.ix - m.ix) * (g.ix - m.ix)) AS d FROM grid g JOIN rest m ON g.sample = m.sample GROUP BY 1, 2, 3),
  sdf AS (SELECT o.sample, o.iy, o.ix, (sqrt(o.d) - sqrt(coalesce(i.d, 0))) * 10 AS sdf FROM o LEFT JOIN i USING (sample, iy, ix))"""


@query(f"WITH {MASK}, {SDF} SELECT c.cell_id, c.sample, round(s.sdf, 6) AS dist_um, s.sdf <= 0 AS inside FROM cells c JOIN sdf s ON c.sample = s.sample AND s.iy = greatest(0, least({NY - 1}, floor(c.y / 10))) AND s.ix = greatest(0, least({NX - 1}, floor(c.x / 10)))")
def tumor_boundary_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each cell's signed distance to the boundary of its section's tumour mask."""
    points = cells(spark, sf_dir)
    sdf = spatial.signed_distance(mask(spark, sf_dir), NX, NY)
    at = points.withColumn("iy", spatial.pixel("y", 10.0, NY)).withColumn("ix", spatial.pixel("x", 10.0, NX))
    return at.join(sdf, spatial.KEY).select("cell_id", "sample", F.round("sdf", 6).alias("dist_um"), (F.col("sdf") <= 0).alias("inside"))


@query(f"WITH {MASK}, {SDF} SELECT sample, iy, ix, round(sdf, 6) AS sdf FROM sdf")
def r9_signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.signed_distance(mask(spark, sf_dir), NX, NY).withColumn("sdf", F.round("sdf", 6))


DISK = "disk AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy) a, (SELECT unnest(range(-2, 3)) AS dx) b WHERE dy * dy + dx * dx <= 4)"
DILATED = "dil AS (SELECT DISTINCT g.sample, g.iy, g.ix FROM grid g, disk d, mask m WHERE m.sample = g.sample AND m.iy = g.iy + d.dy AND m.ix = g.ix + d.dx)"


@query(f"WITH {MASK}, {DISK}, {DILATED} SELECT * FROM dil")
def r5_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.dilate(mask(spark, sf_dir), 2, NX, NY)


@query(f"WITH {MASK}, {DISK}, {DILATED} SELECT l.sample, l.iy, l.ix FROM dil l, disk d JOIN dil e ON e.sample = l.sample AND e.iy = l.iy + d.dy AND e.ix = l.ix + d.dx GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM disk)".replace("dil l, disk d JOIN dil e ON", "dil l CROSS JOIN disk d JOIN dil e ON"))
def r5_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.erode(spatial.dilate(mask(spark, sf_dir), 2, NX, NY), 2)


@query(f"WITH {MASK}, {DISK}, n AS (SELECT sample, CAST(greatest(0, least({NY - 1}, floor(y / 10))) AS BIGINT) AS iy, CAST(greatest(0, least({NX - 1}, floor(x / 10))) AS BIGINT) AS ix, count(*) AS n FROM cells GROUP BY 1, 2, 3) SELECT g.sample, g.iy, g.ix, CAST(sum(n.n) AS BIGINT) AS n FROM grid g CROSS JOIN disk d JOIN n ON n.sample = g.sample AND n.iy = g.iy + d.dy AND n.ix = g.ix + d.dx GROUP BY 1, 2, 3 HAVING sum(n.n) >= 5")
def r6_disk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.disk_count(spatial.rasterise(cells(spark, sf_dir), NX, NY), 2, NX, NY).filter("n >= 5")


def _weights(n: int) -> str:
    return ", ".join(f"({t}, {s}, {w!r}::DOUBLE)" for t, s, w in spatial.kernel(n, 1.0))


@query(f"WITH {CELLS}, n AS (SELECT sample, CAST(greatest(0, least({NY - 1}, floor(y / 10))) AS BIGINT) AS iy, CAST(greatest(0, least({NX - 1}, floor(x / 10))) AS BIGINT) AS ix, count(*) AS n FROM cells GROUP BY 1, 2, 3), kx(t, s, w) AS (VALUES {_weights(NX)}), ky(t, s, w) AS (VALUES {_weights(NY)}), r AS (SELECT sample, iy, t AS ix, sum(n * w) AS n FROM n JOIN kx ON ix = s GROUP BY 1, 2, 3), d AS (SELECT sample, t AS iy, ix, sum(n * w) AS density FROM r JOIN ky ON iy = s GROUP BY 1, 2, 3) SELECT sample, count(*) AS n_pixels, round(max(density), 6) AS peak, round(sum(density), 4) AS mass, count_if(density > 0.5) AS dense FROM d GROUP BY sample")
def r3_gaussian_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spatial.gaussian(spatial.rasterise(cells(spark, sf_dir), NX, NY), 1.0, NX, NY)
    return d.groupBy("sample").agg(F.count("*").alias("n_pixels"), F.round(F.max("density"), 6).alias("peak"), F.round(F.sum("density"), 4).alias("mass"), F.count_if(F.col("density") > 0.5).alias("dense"))


@query(f"WITH RECURSIVE {MASK}, m AS (SELECT *, sample * 1099511627776 + iy * 1048576 + ix AS node FROM mask), e AS (SELECT a.node AS a, b.node AS b FROM m a JOIN m b ON a.sample = b.sample AND abs(a.iy - b.iy) + abs(a.ix - b.ix) = 1), r AS (SELECT node AS a, node AS b FROM m UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS node, min(b) AS region FROM r GROUP BY a), s AS (SELECT region, count(*) AS size FROM c GROUP BY region) SELECT m.sample, m.iy, m.ix, c.region, s.size FROM m JOIN c USING (node) JOIN s USING (region) WHERE s.size >= 3")
def r8_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.remove_small(mask(spark, sf_dir), 3).select("sample", "iy", "ix", "region", "size")


@query()
def r7_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.fill_holes(*framed_mask(spark, sf_dir), 4)


@query()
def r5_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return spatial.closing(m, 1, nx, ny)


@query()
def r13_watershed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.watershed(*framed_density(spark, sf_dir))


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = cells(spark, sf_dir)
    return points.filter("cell_type = 'click'"), points.filter("cell_type = 'error'")


NEAR = f"{CELLS}, p AS (SELECT a.sample, a.cell_id AS a, b.cell_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cells a JOIN cells b ON a.sample = b.sample WHERE a.cell_type = 'click' AND b.cell_type = 'error'), q AS (SELECT * FROM p WHERE d <= 15)"


@query(f"WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM q) SELECT sample, a, b, round(d, 6) AS d FROM r WHERE k = 1")
def j13_nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(*split(spark, sf_dir), 15.0).withColumn("d", F.round("d", 6))


@query(f"WITH {CELLS} SELECT a.sample, a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON a.sample = b.sample AND a.cell_id < b.cell_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4")
def j14_range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cells(spark, sf_dir)
    return spatial.near_pairs(points, points, 4.0).filter("a < b").select("sample", "a", "b")


@query(f"WITH {CELLS} SELECT a.cell_id, count(b.cell_id) AS n FROM cells a LEFT JOIN cells b ON a.sample = b.sample AND a.cell_id <> b.cell_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 10 GROUP BY a.cell_id")
def j15_neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cells(spark, sf_dir)
    n = spatial.near_pairs(points, points, 10.0).filter("a <> b").groupBy("a").agg(F.count("*").alias("n"))
    return points.join(n, points.cell_id == n.a, "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i, row_number() OVER (PARTITION BY b ORDER BY d, a) AS j FROM q) SELECT sample, a, b, round(d, 6) AS d FROM r WHERE i = 1 AND j = 1")
def j16_mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mutual_nearest(*split(spark, sf_dir), 15.0).withColumn("d", F.round("d", 6))


@query()
def j18_greedy_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.near_pairs(*split(spark, sf_dir), 15.0)
    return grouped.greedy_iou(pairs.select("sample", F.col("a").alias("gold"), F.col("b").alias("pred"), (1 - F.col("d") / 15).alias("iou")), 0.5)


@query()
def j19_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's clicks against the same layer moved by 3 along x."""
    a, _ = split(spark, sf_dir)
    return grouped.optimal_pairs(a, a.withColumn("x", F.col("x") + 3.0))


@query(f"WITH RECURSIVE {CELLS}, e AS (SELECT a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON a.sample = b.sample WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4), r AS (SELECT cell_id AS a, cell_id AS b FROM cells UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def g1_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.linkage(cells(spark, sf_dir), 4.0)


@query()
def g2_bipartite_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL: a recursive closure of all orders compares all pairs of a group."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.lit(-1) - F.col("o_orderkey") % 5000).alias("b"))
    return components(e.select(F.col("a").alias("node")).union(e.select("b")), e)


@query("WITH t AS (SELECT * FROM range(0, 101) r(k)), s AS (SELECT l.quality AS y, (d.n_chars % 997) / 997.0 AS p FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT k, count_if(y = 1 AND p >= k / 100.0) AS tp, count_if(y = 0 AND p >= k / 100.0) AS fp, count_if(y = 1 AND p < k / 100.0) AS fn FROM t, s GROUP BY k), d AS (SELECT k, round(2.0 * tp / greatest(2 * tp + fp + fn, 1), 8) AS dice FROM c) SELECT k / 100.0 AS threshold, dice FROM d ORDER BY dice DESC, k LIMIT 1")
def a21_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are counted in bins between thresholds first, so the sweep costs 101 rows whatever the input."""
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    k = F.floor((F.col("n_chars") % 997) / F.lit(997.0) * 100 + 1e-9)
    bins = s.groupBy(k.alias("k")).agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"))
    t = spark.range(101).withColumnRenamed("id", "t")
    c = t.join(F.broadcast(bins)).groupBy("t").agg(F.sum(F.when(F.col("k") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("t"), F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("k") < F.col("t"), F.col("pos")).otherwise(0)).alias("fn"))
    d = c.withColumn("dice", F.round(2.0 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 8))
    return d.orderBy(F.desc("dice"), "t").limit(1).select((F.col("t") / 100).alias("threshold"), "dice")


@query("SELECT label, i - 1 AS pos, round(avg(embedding[i]::DOUBLE), 5) AS mean, max(embedding[i]::DOUBLE) AS peak FROM embeddings, range(1, 65) r(i) GROUP BY label, i HAVING count(*) >= 5")
def a27_pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"), F.max(F.col("v").cast("double")).alias("peak"), F.count("*").alias("n")).filter("n >= 5").drop("n")


@query()
def m2_balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("group")).agg(F.count_if(F.col("c_acctbal") > 5000).alias("pos"), F.count("*").alias("size"))
    return grouped.balanced_folds(g, 5)


@query()
def a9_bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard error of the median over 200 weighted resamples: each replicate's weights come from a seeded hash."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    u = F.pmod(F.xxhash64("o_orderkey", "rep"), F.lit(1 << 20)) / float(1 << 20)
    weight = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.9810, 3).otherwise(4)
    m = grouped.replicate_medians(o, "o_orderpriority", "o_totalprice", weight, 200)
    return m.groupBy("o_orderpriority").agg(F.stddev_samp("m").alias("se"))
