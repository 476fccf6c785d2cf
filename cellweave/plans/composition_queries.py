"""Whole recipes as queries, with SQL from their definitions. The tables' sections are small, so constants are too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators import bodies, compositions, spatial, structures
from cellweave.operators.bodies import BodyRules
from cellweave.operators.compositions import BoundaryRules
from cellweave.operators.structures import CoreRules
from cellweave.sources.tables import cells

from . import raster_sql as sql
from .catalog import query
from .framed_queries import FRAMED

RULES = BoundaryRules(tissue_sigma=2, tissue_least=0.1, tissue_close=5, sigma=1.5, share=0.45, close=2, hole=12, open_=1, area=12, normal_area=8, seeds=10)


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for tumour cells, views for normal ones."""
    kind = F.when(F.col("cell_type") == "purchase", "Tumor").when(F.col("cell_type") == "view", "Normal").otherwise("Other")
    return cells(spark, sf_dir).withColumn("kind", kind)


def _class(name: str, kind: str, r: BoundaryRules) -> str:
    seeds = f"{name}_n AS (SELECT sample, iy, ix, count(*) AS n FROM placed WHERE kind = '{kind}' AND sample IN (SELECT sample FROM placed WHERE kind = '{kind}' GROUP BY sample HAVING count(*) >= {r.seeds}) GROUP BY 1, 2, 3)"
    high = f"{name}_h AS (SELECT sample, iy, ix FROM (SELECT *, max(n) OVER (PARTITION BY sample) AS peak FROM {name}_b) t WHERE n > {r.share} * peak)"
    chain = [seeds, sql.blur(f"{name}_b", f"{name}_n", r.sigma), high, sql.closed(f"{name}_c", f"{name}_h", r.close), sql.filled(f"{name}_f", f"{name}_c", r.hole), sql.opened(f"{name}_o", f"{name}_f", r.open_), sql.large(f"{name}_l", f"{name}_o", r.area)]
    return ", ".join([*chain, f"{name} AS (SELECT sample, iy, ix FROM {name}_l SEMI JOIN tissue USING (sample, iy, ix))"])


def boundary_layers(r: BoundaryRules) -> str:
    """The masks tissue, tumor and normal, and `placed`, the cells at their pixels."""
    placed = "placed AS (SELECT cell_id, sample, CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(x / 10) AS BIGINT) AS ix, CASE cell_type WHEN 'purchase' THEN 'Tumor' WHEN 'view' THEN 'Normal' ELSE 'Other' END AS kind FROM cells)"
    counts = "counts AS (SELECT sample, iy, ix, count(*) AS n FROM placed GROUP BY 1, 2, 3)"
    tissue = [sql.blur("t_b", "counts", r.tissue_sigma), f"t_h AS (SELECT sample, iy, ix FROM t_b WHERE n > {r.tissue_least})", sql.closed("t_c", "t_h", r.tissue_close), sql.filled("tissue", "t_c")]
    rest = "rest AS (SELECT n.* FROM norm n ANTI JOIN tumor t USING (sample, iy, ix))"
    return ", ".join([FRAMED, placed, counts, *tissue, _class("tumor", "Tumor", r), _class("norm", "Normal", r), rest, sql.large("normal", "rest", r.normal_area)])


NAMES = ", ".join([
    sql.parts("tp", "tumor"), sql.parts("np", "normal"),
    "sizes AS (SELECT sample, 0 AS rank, 'Tumor' AS kind, part, count(*) AS size FROM tp GROUP BY sample, part UNION ALL SELECT sample, 1, 'Normal', part, count(*) FROM np GROUP BY sample, part)",
    "ids AS (SELECT *, kind || '-' || row_number() OVER (PARTITION BY sample ORDER BY rank, size DESC, part) AS name FROM sizes)",
    "names AS (SELECT p.sample, p.iy, p.ix, i.name FROM (SELECT *, 'Tumor' AS kind FROM tp UNION ALL SELECT *, 'Normal' FROM np) p JOIN ids i USING (sample, kind, part))",
])
FACE = ", ".join([sql.erode("core", "tumor", 1), sql.dilate("wide", "normal", 2), "face AS (SELECT t.* FROM tumor t ANTI JOIN core c USING (sample, iy, ix) SEMI JOIN wide w USING (sample, iy, ix))"])
AT = f"px AS (SELECT DISTINCT sample, iy, ix FROM placed), outer_ AS (SELECT g.* FROM {sql.grid('tumor')} g ANTI JOIN tumor t USING (sample, iy, ix)), {sql.nearest('o', 'px', 'tumor')}, {sql.nearest('i', 'px', 'outer_')}, {sql.nearest('fd', 'px', 'face')}"
BOUNDARY = f"""WITH RECURSIVE {boundary_layers(RULES)}, {NAMES}, {FACE}, {AT}
  SELECT a.cell_id, a.sample, coalesce(n.name, 'Unassigned') AS region, CASE WHEN n.name LIKE 'Tumor-%' THEN 'Tumor' ELSE 'Normal' END AS side, round((sqrt(o.d2) - sqrt(coalesce(i.d2, 0))) * 10, 1) AS dist_sdf_um, coalesce(m.name, '') AS dist_sdf_region,
    round(sqrt(fd.d2) * 10 * CASE WHEN n.name LIKE 'Tumor-%' AND fd.d2 > 0 THEN -1 ELSE 1 END, 1) AS dist_iface_um
  FROM placed a LEFT JOIN names n USING (sample, iy, ix) LEFT JOIN o USING (sample, iy, ix) LEFT JOIN i USING (sample, iy, ix) LEFT JOIN fd USING (sample, iy, ix) LEFT JOIN names m ON m.sample = a.sample AND m.iy = o.jy AND m.ix = o.jx"""


@query(BOUNDARY)
def c1_tumor_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compositions.boundary(kinds(spark, sf_dir), RULES)


AREA = f"""WITH RECURSIVE {boundary_layers(RULES)}, {sql.parts('tp', 'tumor')}, a AS (SELECT sample, count(*) AS n_tumor_regions, sum(n) AS px, max(n) AS largest FROM (SELECT sample, part, count(*) AS n FROM tp GROUP BY 1, 2) t GROUP BY 1),
  b AS (SELECT sample, count(*) AS tissue FROM tissue GROUP BY 1), c AS (SELECT sample, count(*) AS n_cells, count(CASE WHEN kind = 'Tumor' THEN 1 END) AS n_tumor_cells FROM placed GROUP BY 1)
  SELECT c.sample, coalesce(n_tumor_regions, 0) AS n_tumor_regions, round(coalesce(px, 0) * 0.0001::DOUBLE, 6) AS tumor_mm2, round(coalesce(largest, 0) * 0.0001::DOUBLE, 6) AS largest_mm2, round(coalesce(tissue, 0) * 0.0001::DOUBLE, 6) AS tissue_mm2,
    CASE WHEN tissue > 0 THEN round(100.0::DOUBLE * coalesce(px, 0) / tissue, 4) ELSE 0.0::DOUBLE END AS tumor_percent, n_tumor_cells, n_cells FROM c LEFT JOIN a USING (sample) LEFT JOIN b USING (sample)"""


@query(AREA)
def c1_tumor_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compositions.tumor_area(compositions.layers(kinds(spark, sf_dir), RULES), RULES)


#: Clicks stand for B cells, purchases for T cells, errors for plasma cells, signups for lymph vessels. The gates are met by some and failed by others.
#: neck is above 1, the depth of a border pixel: at 1 no core has a neck.
CORES = CoreRules(pad=100.0, tissue_sigma=2, tissue_least=0.1, tissue_close=3, sigma=1.5, share=0.3, close=2, hole=12, open_=1, apart=4, saddle=0.8, fine=1.0, broad=1.5, big=0.02, rel=0.3, core_close=1, core_open=1, core_hole=3, neck=2.0, resplit_apart=3, points=6, area=0.002, density=1_800, big_density=1_200, halo=40.0, region_area=0.012, partners=8, all_density=3_000, region_density=900)
LETTERS = {"click": "B", "purchase": "T", "error": "P", "signup": "L"}


def lettered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("O")
    for word, letter in LETTERS.items():
        kind = F.when(F.col("cell_type") == word, letter).otherwise(kind)
    return cells(spark, sf_dir).withColumn("kind", kind)


@query()
def c2_lymphoid_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole recipe. Without SQL: a watershed; its gates are c2_gated_cores."""
    return structures.lymphoid_structures(lettered(spark, sf_dir), CORES)[0]


@query()
def c3_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores of T cells; those are aggregates that pass both gates and touch no lymphoid structure. Without SQL: a watershed."""
    points = lettered(spark, sf_dir)
    found = structures.aggregates(points, "T", CORES, structures.lymphoid_structures(points, CORES)[1])
    return found.withColumn("aggregate", F.col("gate").isNull() & ~F.col("touches"))


PLAIN = CoreRules(halo=30.0, axis_ratio=0.0, circularity=0.0, points=5, area=0.0015, density=2_600, big_density=3_000, region_area=0.011, partners=20, all_density=5_900, region_density=2_050)
COUNTED = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k.lower()}" for k in "BTPL")
LETTER = " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in LETTERS.items())
GATED = f"""WITH RECURSIVE {FRAMED}, placed AS (SELECT sample, CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(x / 10) AS BIGINT) AS ix, CASE cell_type {LETTER} ELSE 'O' END AS kind FROM cells),
  click AS (SELECT DISTINCT sample, iy, ix FROM placed WHERE kind = 'B'), {sql.dilate('wide', 'click', 1)}, {sql.parts('p', 'wide')}, every AS (SELECT DISTINCT sample, iy, ix FROM placed), {sql.dilate('ground', 'every', 2)},
  core AS (SELECT sample, iy, ix, dense_rank() OVER (PARTITION BY sample ORDER BY part) AS core FROM p), n AS (SELECT sample, iy, ix, {COUNTED}, count(*) AS n_all FROM placed GROUP BY 1, 2, 3),
  c AS (SELECT sample, core, count(*) > 60 AS big, count(*) AS core_px, coalesce(sum(n_b), 0) AS n_b FROM core LEFT JOIN n USING (sample, iy, ix) GROUP BY 1, 2),
  g AS (SELECT *, CASE WHEN n_b < {PLAIN.points} OR core_px < {int(PLAIN.area * 1e4)} THEN 'size' WHEN n_b / (core_px * 0.0001::DOUBLE) < CASE WHEN big THEN {PLAIN.big_density} ELSE {PLAIN.density} END THEN 'density' END AS early FROM c),
  {sql._disk('halo', 3)}, region AS (SELECT DISTINCT c.sample, c.core, c.iy + dy AS iy, c.ix + dx AS ix FROM core c JOIN g ON g.sample = c.sample AND g.core = c.core AND g.early IS NULL CROSS JOIN halo_disk JOIN ground r ON r.sample = c.sample AND r.iy = c.iy + dy AND r.ix = c.ix + dx),
  a AS (SELECT sample, core, count(*) AS px, coalesce(sum(n_b), 0) AS n_b_around, coalesce(sum(n_t), 0) AS n_t_around, coalesce(sum(n_p), 0) AS n_p_around FROM region LEFT JOIN n USING (sample, iy, ix) GROUP BY 1, 2),
  j AS (SELECT g.sample, g.core, big, core_px, n_b, coalesce(px, 0) AS px, coalesce(n_b_around, 0) AS n_b_around, coalesce(n_t_around, 0) AS n_t_around, coalesce(n_p_around, 0) AS n_p_around,
    CASE WHEN early IS NOT NULL THEN early WHEN coalesce(px, 0) < {int(PLAIN.region_area * 1e4)} THEN 'region_area' WHEN coalesce(n_t_around, 0) < {PLAIN.partners} THEN 'partners' WHEN (n_b_around + n_t_around + n_p_around) / (px * 0.0001::DOUBLE) < {PLAIN.all_density} THEN 'all_density' WHEN n_b_around / (px * 0.0001::DOUBLE) < {PLAIN.region_density} THEN 'region_density' END AS gate FROM g LEFT JOIN a USING (sample, core)),
  i AS (SELECT sample, core, row_number() OVER (PARTITION BY sample ORDER BY core) AS id FROM j WHERE gate IS NULL), o AS (SELECT sample, iy, ix, min(id) AS id FROM region JOIN i USING (sample, core) GROUP BY 1, 2, 3),
  w AS (SELECT sample, id, count(*) AS owned_px, coalesce(sum(n_b), 0) AS n_b_owned, coalesce(sum(n_t), 0) AS n_t_owned, coalesce(sum(n_p), 0) AS n_p_owned, coalesce(sum(n_l), 0) AS n_l_owned, coalesce(sum(n_all), 0) AS n_all_owned FROM o LEFT JOIN n USING (sample, iy, ix) GROUP BY 1, 2)
  SELECT j.*, id, {', '.join(f'CASE WHEN id IS NOT NULL THEN coalesce({c}, 0) END AS {c}' for c in ('owned_px', 'n_b_owned', 'n_t_owned', 'n_p_owned', 'n_l_owned', 'n_all_owned'))}, CASE WHEN id IS NOT NULL THEN CASE WHEN coalesce(n_l_owned, 0) > 0 THEN 'mature' ELSE 'immature' END END AS status
  FROM j LEFT JOIN i USING (sample, core) LEFT JOIN w USING (sample, id)"""


@query(GATED)
def c2_gated_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade, ownership and recount on cores that SQL can find: components of pixels near clicks. No core counts as long or ragged."""
    moved, nx, ny = spatial.framed(lettered(spark, sf_dir))
    at = spatial.at_pixel(moved, nx, ny).select("kind", *spatial.KEY)
    parts = spatial.lattice_components(spatial.dilate(at.filter("kind = 'B'").select(*spatial.KEY).distinct(), 1, nx, ny))
    number = F.dense_rank().over(Window.partitionBy("sample").orderBy("region")).cast("long")
    cores = parts.select("sample", number.alias("core"), (F.count("*").over(Window.partitionBy("sample", "region")) > 60).alias("big"), "iy", "ix")
    ground = spatial.dilate(at.select(*spatial.KEY).distinct(), 2, nx, ny)
    return structures.structures(cores, at, ground, nx, ny, PLAIN)[0]


BODIES = BodyRules(pad=100.0, sigma=1.5, least=5, peak=0.12, count_radius=20.0, count=5, close=10.0, apart=3, gap=40.0, split=4, aspect=1.8, minor=20.0, major=60.0, small_density=900.0, large_density=1_200.0, linear=30.0, reference=600.0, link=12.0, loose_all=0.0, loose_high=700.0, loose_low=100.0, tract_major=60.0, tract_aspect=1.8, tract_wide=1, reach=20.0, reach_share=0.5)


@query()
def c5_region_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are the marked points. Without SQL: a watershed and spanning trees; tests hold it against planted shapes."""
    out = bodies.region_operator(cells(spark, sf_dir).withColumn("marked", F.col("cell_type") == "click"), BODIES)
    return out.select("sample", "cluster", "n", *[F.round(c, 6).alias(c) for c in ("area_mm2", "areal_density", "linear_density", "aspect", "solidity", "median_nn")], "shape", "confidence", "kind")


LINKS = """WITH n AS (SELECT o_custkey AS sample, count(*) AS n, sum(o_totalprice) / 100000 AS area_mm2 FROM orders GROUP BY 1), d AS (SELECT sample, n / area_mm2 AS density FROM n),
  l AS (SELECT *, 50 * greatest(0.9::DOUBLE, least(1.8::DOUBLE, pow(90 / greatest(density, 0.000001), 0.165))) AS link FROM d) SELECT sample, round(density, 6) AS density, round(link, 6) AS link, round(link * greatest(0, least(1, (25 - density) / 22)), 6) AS halo FROM l"""


@query(LINKS)
def c5_adapted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power law of links and halos, customers' orders for a section's points."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("n"), (F.sum("o_totalprice") / 100000).alias("area_mm2"))
    return bodies.adapted(n, BodyRules()).select("sample", *[F.round(c, 6).alias(c) for c in ("density", "link", "halo")])
