"""Bodies and tracts of sparse marked points: a branch by shape, gates by shape, links whose length follows the section's density, and confidence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut
from .grouped import shape
from .pieces import _each, basins_of, boxed, tracts
from .regions import nearest_any, nearest_k
from .spatial import KEY, at_pixel, closing, cut, disk_count, framed, gaussian, lattice_components, linkage, opening


@dataclass(frozen=True)
class BodyRules:
    """Lengths in points' units, areas in square millimetres, densities for each of them. Fixed values of the recipe are the defaults."""

    size: float = 10.0
    pad: float = 200.0
    sigma: float = 4
    least: int = 5
    confident: int = 15
    peak: float = 0.086
    count_radius: float = 35.0
    count: int = 5
    open_: float = 10.0
    close: float = 20.0
    apart: int = 4
    gap: float = 50.0
    split: int = 6
    aspect: float = 3.0
    area_cut: float = 0.10
    small_density: float = 250.0
    large_density: float = 500.0
    solidity: float = 0.50
    minor: float = 25.0
    major: float = 150.0
    linear: float = 30.0
    spacing: float = 30.0
    link: float = 50.0
    reference: float = 90.0
    power: float = 0.165
    scale_min: float = 0.9
    scale_max: float = 1.8
    loose_high: float = 25.0
    loose_low: float = 3.0
    loose_all: float = 8.0
    tract_major: float = 105.0
    tract_aspect: float = 2.2
    tract_linear: float = 10.0
    tract_wide: int = 2
    reach: float = 90.0
    reach_share: float = 0.6
    subsumed: float = 0.6
    added: int = 2


def axes(pixels: DataFrame, size: float, *by: str) -> DataFrame:
    """by, px, major, minor and aspect (999 for a line, 1 for a point) from second moments of pixels(by, iy, ix)."""
    m = pixels.groupBy(*by).agg(F.count("*").alias("px"), F.var_pop("iy").alias("p"), F.var_pop("ix").alias("q"), F.covar_pop("iy", "ix").alias("r"))
    half, root = (F.col("p") + F.col("q")) / 2, F.sqrt(F.pow((F.col("p") - F.col("q")) / 2, F.lit(2.0)) + F.col("r") * F.col("r"))
    low = F.when(half - root > 1e-9 * half, half - root).otherwise(0.0)
    major, minor = 4 * size * F.sqrt(half + root), 4 * size * F.sqrt(low)
    return m.select(*by, "px", major.alias("major"), minor.alias("minor"), F.when(minor > 0, major / minor).when(major > 0, 999.0).otherwise(1.0).alias("aspect"))


def parts_by_shape(parts: DataFrame, at: DataFrame, density: DataFrame, nx: DataFrame, ny: DataFrame, r: BodyRules) -> DataFrame:
    """(sample, region, piece, iy, ix): long parts are split between groups of linked points, each pixel to its nearest point; compact ones
    by a watershed from their peaks of density. at(sample, cell_id, iy, ix): the marked points' pixels."""
    shaped = axes(parts, r.size, "sample", "region").select("sample", "region", (F.col("aspect") >= r.aspect).alias("long"))
    parts = _cut(parts.join(shaped, ["sample", "region"]))
    round_ = boxed(parts.filter("not long").select("sample", "region", "iy", "ix"), density, nx, ny, 0)

    def split(m: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        return basins_of(d, m, r.apart, r.peak / top if (top := float(d[m].max())) > 0 else 0.0, np.inf) if m.any() and d[m].max() >= r.peak else m.astype(np.int64)

    compact = _each(round_, split)
    long = parts.filter("long")
    own = at.join(long, KEY).select(F.col("region").alias("sample"), "cell_id", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    group = linkage(own, max(r.gap / r.size, 1.0)).join(own, F.col("node") == own.cell_id)
    size = F.count("*").over(Window.partitionBy("component"))
    big = group.withColumn("n", size).filter(F.col("n") >= r.split).select("sample", "cell_id", "x", "y", "component")
    cells = long.select(F.col("region").alias("sample"), (F.col("iy") * (1 << 21) + F.col("ix")).alias("cell_id"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    near = nearest_any(cells, big, 8.0, float(1 << 21)).select(F.col("sample").alias("region"), "a", F.col("b").alias("cell_id")).join(big.select("cell_id", "component"), "cell_id")
    number = F.dense_rank().over(Window.partitionBy("region").orderBy("component")).cast("long")
    of = near.select("region", F.floor(F.col("a") / (1 << 21)).alias("iy"), (F.col("a") % (1 << 21)).alias("ix"), number.alias("piece"))
    stretched = long.join(of, ["region", "iy", "ix"], "left").select("sample", "region", F.coalesce("piece", F.lit(1).cast("long")).alias("piece"), "iy", "ix")
    return compact.select("sample", "region", "piece", "iy", "ix").unionByName(stretched)


def bodies(marked: DataFrame, nx: DataFrame, ny: DataFrame, r: BodyRules) -> tuple[DataFrame, DataFrame]:
    """Bodies of marked(sample, cell_id, x, y) in frames: a row for each candidate of at least `least` points with its figures and whether it passes the gates of its shape; and
    the candidates' pixels (sample, body, iy, ix). Bodies are numbered in each section."""
    at = _cut(at_pixel(marked, nx, ny, r.size))
    counts = at.groupBy(*KEY).agg(F.count("*").alias("n"))
    density = _cut(gaussian(counts, r.sigma, nx, ny))
    dense = disk_count(counts, max(round(r.count_radius / r.size), 1), nx, ny).filter(F.col("n") >= r.count)
    parts = lattice_components(opening(dense.select(*KEY), max(round(r.open_ / r.size), 1), nx, ny))
    pieces = parts_by_shape(parts, at, density, nx, ny, r)
    number = F.dense_rank().over(Window.partitionBy("sample").orderBy("region", "piece")).cast("long")
    numbered = _cut(pieces.select("sample", number.alias("body"), "iy", "ix"))
    keyed = numbered.select(F.struct("sample", "body").alias("sample"), "iy", "ix")
    wide = closing(keyed, max(round(r.close / r.size), 1), None, None).select("sample.*", "iy", "ix")
    pixels = _cut(cut(wide.groupBy(*KEY).agg(F.min("body").alias("body")), nx, ny))  # a pixel of several belongs to the first
    members = _cut(at.join(pixels, KEY).select("sample", "body", "cell_id", "x", "y"))
    node = F.col("sample") * (1 << 32) + F.col("body")
    apart = nearest_k(*[members.select(node.alias("sample"), "cell_id", "x", "y")] * 2, 1, r.spacing).groupBy(F.col("sample").alias("node")).agg(F.expr("percentile(d, 0.5)").alias("median_nn"))
    solid = shape(pixels.withColumnRenamed("body", "region")).select("sample", F.col("region").alias("body"), "solidity")
    n = members.groupBy("sample", "body").agg(F.count("*").alias("n")).filter(F.col("n") >= r.least)
    found = n.join(axes(pixels, r.size, "sample", "body"), ["sample", "body"]).join(solid, ["sample", "body"]).withColumn("node", node).join(apart, "node", "left").drop("node")
    area = F.col("px") * (r.size**2 / 1e6)
    found = found.withColumn("area_mm2", area).withColumn("areal_density", F.col("n") / area).withColumn("linear_density", F.when(F.col("major") > 0, F.col("n") / (F.col("major") / 1000)).otherwise(0.0))
    enough = (F.col("areal_density") >= F.when(F.col("area_mm2") <= r.area_cut, r.small_density).otherwise(r.large_density)) & F.coalesce(F.col("median_nn") <= r.spacing, F.lit(False))
    elongated = F.col("aspect") >= r.aspect
    fit = F.when(elongated, enough & (F.col("minor") >= r.minor) & (F.col("major") >= r.major) & (F.col("linear_density") >= r.linear)).otherwise(enough & (F.col("solidity") >= r.solidity))
    return _cut(found.withColumn("shape", F.when(elongated, "elongated").otherwise("compact")).withColumn("passed", fit)), pixels


def adapted(counts: DataFrame, r: BodyRules) -> DataFrame:
    """(sample, density, link, halo) from counts(sample, n, area_mm2): links grow with falling density by a power law within bounds; loose points count near bodies, everywhere where few are."""
    d = F.col("n") / F.col("area_mm2")
    clip = lambda v, a, b: F.greatest(F.lit(a), F.least(F.lit(b), v))
    link = r.link * clip(F.pow(r.reference / F.greatest(F.col("density"), F.lit(1e-6)), F.lit(r.power)), r.scale_min, r.scale_max)
    return counts.withColumn("density", d).withColumn("link", link).withColumn("halo", F.col("link") * clip((r.loose_high - F.col("density")) / (r.loose_high - r.loose_low), 0.0, 1.0)).select("sample", "density", "link", "halo")


def region_operator(points: DataFrame, r: BodyRules = BodyRules()) -> DataFrame:
    """Bodies and tracts of points(sample, cell_id, x, y, marked): sample, cluster (numbered, bodies first), n, area_mm2, areal_density, linear_density, aspect, solidity, median_nn, shape,
    confidence (high from `confident` points on) and kind (body or tract).

    A section with fewer than `least` marked points has none. A tract replaces the bodies that it covers if these are two or more, or if it adds points.
    """
    moved, nx, ny = framed(points, r.size, r.pad)
    moved, nx, ny = _cut(moved), _cut(nx), _cut(ny)
    enough = moved.filter("marked").groupBy("sample").agg(F.count("*").alias("n")).filter(F.col("n") >= r.least)
    marked = _cut(moved.filter("marked").join(enough, "sample", "left_semi").select("sample", "cell_id", "x", "y"))
    found, pixels = bodies(marked, nx, ny, r)
    good = found.filter("passed")
    body_px = _cut(pixels.join(good.select("sample", "body"), ["sample", "body"], "left_semi"))
    # the frame's area, which the points span with the pad around
    area = points.groupBy("sample").agg(((F.max("x") - F.min("x") + 2 * r.pad) * (F.max("y") - F.min("y") + 2 * r.pad) / 1e6).alias("area_mm2"))
    scale = _cut(adapted(enough.join(area, "sample"), r))
    inside = at_pixel(marked, nx, ny, r.size).join(body_px.select(*KEY), KEY, "left_semi").select("sample", "cell_id", "x", "y")
    near = nearest_any(marked, inside, r.link, r.link * r.scale_max).select("sample", F.col("a").alias("cell_id"), "d")
    eligible = marked.join(scale, "sample").join(near, ["sample", "cell_id"], "left").filter((F.col("density") <= r.loose_all) | (F.col("d") == 0) | ((F.col("halo") > 0) & (F.col("d") <= F.col("halo"))))
    drawn = _cut(tracts(eligible.select("sample", "cell_id", "x", "y"), nx, ny, scale, r.reach, r.least, r.tract_wide, r.tract_major, r.tract_aspect, r.tract_linear, r.spacing, r.reach_share, r.size, r.link * r.scale_max))
    tract_px = drawn.select("sample", "tract", F.explode("pixels").alias("p")).select("sample", "tract", "p.iy", "p.ix")
    shared = tract_px.join(body_px, KEY).groupBy("sample", "tract", "body").agg(F.count("*").alias("shared")).join(good.select("sample", "body", "px", F.col("n").alias("n_body")), ["sample", "body"])
    covered = shared.filter(F.col("shared") > r.subsumed * F.col("px"))
    judged = drawn.join(covered.groupBy("sample", "tract").agg(F.count("*").alias("k"), F.sum("n_body").alias("held")), ["sample", "tract"], "left").fillna(0, ["k", "held"])
    kept = judged.filter((F.col("k") >= 2) | (F.col("n") - F.col("held") >= r.added))
    left = good.join(covered.join(kept.select("sample", "tract"), ["sample", "tract"], "left_semi").select("sample", "body").distinct(), ["sample", "body"], "left_anti")
    own = ["sample", "n", "area_mm2", "areal_density", "linear_density", "aspect", "solidity", "median_nn"]
    px_mm2 = F.size("pixels") * (r.size**2 / 1e6)
    lines = kept.withColumn("area_mm2", px_mm2).withColumn("areal_density", F.col("n") / px_mm2).withColumn("aspect", F.col("major") / F.col("minor"))
    both = left.select(*own, "shape", F.lit("body").alias("kind"), F.col("body").alias("at")).unionByName(lines.select(*own, F.lit("elongated").alias("shape"), F.lit("tract").alias("kind"), F.col("tract").alias("at")))
    cluster = F.row_number().over(Window.partitionBy("sample").orderBy("kind", "at")).cast("long")
    return both.select("sample", cluster.alias("cluster"), *own[1:], "shape", F.when(F.col("n") >= r.confident, "high").otherwise("low").alias("confidence"), "kind")
