"""Queries over split regions, tracts, links through sections, affine maps and stitched evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import evaluation, linking, pieces, regions, spatial
from cellweave.sources.tables import cells, table

from .catalog import MASK, NX, NY, QUERIES, _sql, framed_cells, framed_density, framed_mask, mask, query
from .relational import CELLS, oracle

SIDE, BASE = 10, 5
FRAME = "frame AS (SELECT sample, min(x) - 100 AS x0, min(y) - 100 AS y0, CAST(ceil((max(x) - min(x) + 200) / 10) AS BIGINT) AS nx, CAST(ceil((max(y) - min(y) + 200) / 10) AS BIGINT) AS ny FROM cells GROUP BY sample)"

SQL = {
    "r1_grid_frame": f"WITH {CELLS}, {FRAME} SELECT sample, round(x0, 6) AS x0, round(y0, 6) AS y0, nx, ny FROM frame",
    "r2_rasterise": f"WITH {CELLS}, {FRAME}, p AS (SELECT c.sample, CAST(greatest(0, least(ny - 1, floor((y - y0) / 10))) AS BIGINT) AS iy, CAST(greatest(0, least(nx - 1, floor((x - x0) / 10))) AS BIGINT) AS ix FROM cells c JOIN frame f ON c.sample = f.sample) SELECT sample, iy, ix, count(*) AS n FROM p GROUP BY sample, iy, ix",
    "o1_mixed_order": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
    "o2_ranked_order": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice, o_orderkey) AS k FROM orders) t WHERE k = 1",
    "o5_top_clusters": f"WITH {CELLS}, c AS (SELECT sample, cell_type, CAST(floor(y / 10) AS BIGINT) AS lane, avg(CASE WHEN cell_type <> 'click' THEN x END) AS p, count(*) AS n FROM cells GROUP BY 1, 2, 3) SELECT sample, cell_type, lane, n FROM (SELECT *, row_number() OVER (PARTITION BY sample, cell_type ORDER BY round(coalesce(p, n), 9) DESC, lane) AS k FROM c) t WHERE k <= 3",
    "e2_z_sum": "WITH g AS (SELECT l_orderkey AS cell, l_linenumber AS gene, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT gene, avg(v) AS m, stddev_pop(v) AS sd FROM g GROUP BY gene), k AS (SELECT * FROM (VALUES ('one', 2), ('two', 3), ('two', 5), ('lost', 4), ('lost', 99)) AS t(gene_set, gene)), few AS (SELECT k.gene_set FROM k JOIN s ON k.gene = s.gene GROUP BY k.gene_set HAVING count(*) < 2) SELECT k.gene_set, g.cell, round(sum((g.v - s.m) / s.sd), 6) AS score FROM k JOIN few ON k.gene_set = few.gene_set JOIN s ON k.gene = s.gene JOIN g ON g.gene = s.gene WHERE s.sd > 0 GROUP BY k.gene_set, g.cell",
}
for _name, _text in SQL.items():
    QUERIES[_name] = (_sql(_text), oracle(_text))


def tissue_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nx, ny = framed_mask(spark, sf_dir)
    return spatial.lattice_components(spatial.dilate(m, 2, nx, ny))


@query()
def r15_neck_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.neck_split(tissue_regions(spark, sf_dir), *framed_density(spark, sf_dir), hole=3, neck=2.0)


@query()
def r16_oversized_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nx, ny = framed_cells(spark, sf_dir)
    return pieces.oversized_split(tissue_regions(spark, sf_dir), spatial.rasterise(points, nx, ny), nx, ny, most=60, broad=2.0, fine=1.0, apart=3, close=1, open_=1, hole=3, neck=1.0)


@query()
def x21_valley_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.valley_split(tissue_regions(spark, sf_dir), *framed_density(spark, sf_dir), apart=3, saddle=0.8, least=8)


@query()
def r19_tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, nx, ny = framed_cells(spark, sf_dir)
    t = pieces.tracts(points.filter("cell_type = 'click'"), nx, ny, link=8.0, reach=10.0, least=3, wide=1, major=20.0, aspect=1.5)
    return t.select("sample", "tract", "n", "major", "minor", "solidity", "linear_density", "median_nn", F.size("pixels").alias("n_pixels"))


@query()
def r30_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return pieces.clustering(c.select("sample", F.floor(F.col("x") / 100).cast("long").alias("region"), "x", "y", (F.col("cell_type") == "error").alias("marked")))


def section_regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions of all sections, and the sections at 5 µm from each other."""
    r = tissue_regions(spark, sf_dir)
    return r, table(spark, sf_dir, "events").select(F.dayofmonth("ts").cast("long").alias("sample")).distinct().select("sample", F.col("sample").alias("place"), (F.col("sample") * 5.0).alias("z"))


@query()
def x11_drifting_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, sections = section_regions(spark, sf_dir)
    return linking.drifting_links(r, sections, base=5.0, drift=1.0)


@query()
def g7_merged_lobes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains: regions of a cell type followed by their lane; shares: overlap of their pixels on each section."""
    c = spatial.rasterise(cells(spark, sf_dir).withColumn("sample", F.col("sample") * 1000 + F.crc32("cell_type") % 5 * 10 + F.floor(F.col("x") / 60).cast("long") % 10), None, None)
    px = c.select((F.col("sample") % 1000).alias("region"), F.floor(F.col("sample") / 1000).alias("sample"), "iy", "ix")
    shares = regions.overlaps(px, px).filter("a < b").select(F.lit(0).cast("long").alias("sample"), F.col("sample").alias("z"), "a", "b", F.greatest("of_a", "of_b").alias("share"))
    members = px.select(F.lit(0).cast("long").alias("sample"), F.col("region").alias("chain"), F.col("sample").alias("z"), "region").distinct()
    return linking.merge_lobes(members, shares)


@query()
def x13_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre lines of cell types, cut every few sections, joined again; other cells support the gaps."""
    c = cells(spark, sf_dir).withColumn("z", F.col("sample") * 10.0).withColumn("case", F.lit(0).cast("long"))
    line = c.filter("sample % 5 > 0").groupBy("case", (F.crc32("cell_type") % 1000 * 100 + F.floor(F.col("sample") / 5)).cast("long").alias("object"), "z").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    points = c.filter("sample % 5 = 0").select(F.col("case").alias("sample"), "z", "x", "y")
    return linking.stitch(line.withColumnRenamed("case", "sample"), points, base=40.0, farthest=60.0, radius=20.0)


def _fit(name: str, source: str) -> str:
    mean = ", ".join(f"sum(w * {k}) / sum(w) AS m{k}" for k in "xyuv")
    sums = ", ".join(f"sum(w * ({p} - m{p}) * ({q} - m{q})) AS {p}{q}" for p, q in ("xx", "xy", "yy", "xu", "yu", "xv", "yv"))
    return f"""{name}_m AS (SELECT sample, {mean} FROM {source} GROUP BY sample), {name}_s AS (SELECT sample, mx, my, mu, mv, {sums} FROM {source} JOIN {name}_m USING (sample) GROUP BY ALL),
      {name}_l AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS c, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS d FROM {name}_s WHERE xx * yy - xy * xy > 1e-9 * xx * yy),
      {name} AS (SELECT sample, a, b, c, d, mu - a * mx - b * my AS e, mv - c * mx - d * my AS f FROM {name}_l)"""


@query(f"""WITH {CELLS}, r AS (SELECT sample, cell_type, floor(y / 20) AS lane, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM cells GROUP BY ALL), p AS (SELECT a.sample, a.cx AS x, a.cy AS y, b.cx AS u, b.cy AS v, CAST(least(a.n, b.n) AS DOUBLE) AS w FROM r a JOIN r b ON b.sample = a.sample + 1 AND b.cell_type = a.cell_type AND b.lane = a.lane),
  {_fit("g", "p")}, q AS (SELECT p.*, sqrt(pow(a * x + b * y + e - u, 2) + pow(c * x + d * y + f - v, 2)) AS r FROM p JOIN g USING (sample)), lim AS (SELECT sample, greatest(15.0, 2.5 * quantile_cont(r, 0.5)) AS lim, count(*) AS n FROM q GROUP BY sample),
  k AS (SELECT q.*, n, r <= lim AS good, count(CASE WHEN r <= lim THEN 1 END) OVER (PARTITION BY q.sample) AS k FROM q JOIN lim USING (sample)), t AS (SELECT * FROM k WHERE good OR k < 4), {_fit("h", "t")}
  SELECT h.sample, n, n_kept, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c, round(d, 5) AS d, round(e, 4) AS e, round(f, 4) AS f FROM h JOIN (SELECT sample, n, count(*) AS n_kept FROM t GROUP BY sample, n) USING (sample)""")
def x2_robust_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cells(spark, sf_dir).groupBy("sample", "cell_type", F.floor(F.col("y") / 20).alias("lane")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    to = r.select((F.col("sample") - 1).alias("sample"), "cell_type", "lane", F.col("x").alias("u"), F.col("y").alias("v"), F.col("n").alias("m"))
    pairs = r.join(to, ["sample", "cell_type", "lane"]).select("sample", "x", "y", "u", "v", F.least("n", "m").cast("double").alias("w"))
    return linking.robust_affine(pairs).select("sample", "n", "n_kept", *[F.round(k, 5).alias(k) for k in "abcd"], *[F.round(k, 4).alias(k) for k in "ef"])


@query(f"""WITH {MASK}, n AS (SELECT sample, CAST(greatest(0, least({NY - 1}, floor(y / 10))) AS BIGINT) AS iy, CAST(greatest(0, least({NX - 1}, floor(x / 10))) AS BIGINT) AS ix, count(*) AS n FROM cells GROUP BY ALL), t AS (SELECT y0, x0 FROM range(0, {NY - SIDE + 1}, {BASE}) a(y0), range(0, {NX - SIDE + 1}, {BASE}) b(x0)),
  w AS (SELECT n.sample, t.y0, t.x0, n.iy, n.ix, n.n / (1.0::DOUBLE + avg(n.n) OVER (PARTITION BY n.sample, t.y0, t.x0)) AS p, greatest(0.05, 0.5 - 0.5 * cos(2 * pi() * (n.iy - t.y0 + 1) / {SIDE + 1})) * greatest(0.05, 0.5 - 0.5 * cos(2 * pi() * (n.ix - t.x0 + 1) / {SIDE + 1})) AS w FROM n JOIN t ON n.iy >= y0 AND n.iy < y0 + {SIDE} AND n.ix >= x0 AND n.ix < x0 + {SIDE}),
  s AS (SELECT sample, iy, ix, sum(w * p) / sum(w) AS p FROM w GROUP BY ALL), truth AS (SELECT g.sample, g.sample % 7 AS patient, g.iy, g.ix, CASE WHEN m.sample IS NULL THEN 0 ELSE 1 END AS y FROM grid g LEFT JOIN mask m USING (sample, iy, ix)),
  b AS (SELECT truth.sample, patient, y, s.p IS NULL AS gap, least(19, coalesce(floor(round(s.p, 9) * 20), 0)) AS k FROM truth LEFT JOIN s USING (sample, iy, ix)),
  c AS (SELECT sample, patient, t.k, count(CASE WHEN y = 1 AND b.k >= t.k THEN 1 END) AS tp, count(CASE WHEN b.k >= t.k THEN 1 END) + sum(y) AS total, count(CASE WHEN gap THEN 1 END) AS gap FROM b, range(1, 20) t(k) GROUP BY ALL),
  d AS (SELECT patient, k, avg(CASE WHEN total = 0 THEN 1.0 ELSE 2.0 * tp / total END) AS dice, sum(gap) AS gap FROM c GROUP BY ALL), m AS (SELECT k, round(avg(dice), 8) AS dice, CAST(sum(gap) AS BIGINT) AS n_uncovered FROM d GROUP BY k)
  SELECT k / 20.0 AS threshold, dice, n_uncovered FROM m ORDER BY dice DESC, abs(2 * k - 20), k LIMIT 1""")
def x20_stitched_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spatial.rasterise(cells(spark, sf_dir), NX, NY)
    starts = lambda c, size: F.expr(f"filter(sequence(0, {size - SIDE}, {BASE}), s -> s <= {c} and s > {c} - {SIDE})")
    at = n.withColumn("y0", F.explode(starts("iy", NY))).withColumn("x0", F.explode(starts("ix", NX)))
    mean = at.groupBy("sample", "y0", "x0").agg(F.avg("n").alias("m"))
    tiles = at.join(mean, ["sample", "y0", "x0"]).withColumn("p", F.col("n") / (1.0 + F.col("m")))
    m = mask(spark, sf_dir).distinct().withColumn("y", F.lit(1))
    truth = spatial.lattice(m, NX, NY).join(m, spatial.KEY, "left").select(*spatial.KEY, (F.col("sample") % 7).alias("patient"), F.coalesce("y", F.lit(0)).alias("y"))
    return evaluation.threshold_choice(truth, evaluation.overlap_add(tiles, SIDE))


@query()
def x16_weight_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a polygon of six corners around the middle of a 32-pixel crop."""
    corner = lambda k: F.struct((16 + (F.col("s_nationkey") % 9 + 4) * F.cos(F.lit(k * 1.0471975512))).alias("x"), (16 + (F.col("s_suppkey") % 7 + 4) * F.sin(F.lit(k * 1.0471975512))).alias("y"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.array(F.array(*[corner(k) for k in range(6)])).alias("rings"))
    return evaluation.weight_maps(p, side=32, patch=4, sigma=1.5)


@query()
def x3_spread_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).filter("cell_type = 'purchase'")
    return evaluation.spread_anchors(c.select("sample", F.col("cell_id").alias("id"), "x", "y", (F.col("cell_id") % 97).cast("double").alias("score")), square=150.0, first=60.0, last=20.0, step=10.0)


@query()
def m1_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as patients, market segments as classes."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("group"), F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n"))
    return evaluation.stratified_folds(c, 5)


@query()
def m3_load_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patients of their nation's cancer, weighted by their orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group"), F.col("c_nationkey").cast("long").alias("sample"))
    return evaluation.load_folds(o.join(c, "group"), 5)


@query()
def x9_curve_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).groupBy((F.floor(F.col("y") / 10)).cast("long").alias("object"), "cell_type", "sample").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return linking.curve_models(c.select((F.crc32("cell_type") % 1000).cast("long").alias("sample"), "object", "x", "y", (F.col("sample") * 20.0).alias("z")), rms=60.0)
