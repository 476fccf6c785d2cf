"""Dense cores of one kind of point and the structures around them: a gate cascade that keeps the first failure, and ownership of shared pixels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut
from .pieces import BASIN, REGION, _dealt, _each, _of, basins_of, boxed, labels, oversized_split, tight
from .regions import tissue
from .spatial import KEY, PIXELS_AT_ONCE, Side, at_pixel, closing, dilate, fill_holes, framed, gaussian, lattice_components, opening
from .tiles import whole_groups


@dataclass(frozen=True)
class CoreRules:
    """Lengths and areas of gates in points' units and square millimetres, all others in pixels of `size`. Fixed values of the recipe are the defaults."""

    size: float = 10.0
    pad: float = 200.0
    tissue_sigma: float = 10
    tissue_least: float = 0.015
    tissue_close: int = 10
    sigma: float = 4
    share: float = 0.08
    close: int = 10
    hole: int = 50_000
    open_: int = 3
    apart: int = 25
    saddle: float = 0.5
    fine: float = 1.5
    broad: float = 4.0
    big: float = 0.1
    rel: float = 0.30
    core_close: int = 3
    core_open: int = 2
    core_hole: int = 30
    connect: float = 0.5
    neck: float = 3.0
    resplit_apart: int = 15
    resplit_merge: float = 0.8
    resplit_rel: float = 0.45
    points: int = 50
    area: float = 0.01
    density: float = 8_000
    big_density: float = 4_000
    halo: float = 150.0
    axis_ratio: float = 0.50
    circularity: float = 0.65
    region_area: float = 0.08
    partners: int = 60
    all_density: float = 3_000
    region_density: float = 920


def dense_cores(counts: DataFrame, within: DataFrame, nx: Side, ny: Side, r: CoreRules) -> DataFrame:
    """(sample, core, big, iy, ix) from counts(sample, iy, ix, n) of one kind: a clean density mask, parted at saddles between its peaks; of each
    basin the dense parts of its own points, at a broad scale for big ones; oversized small cores are parted again. Cores are numbered in each section."""
    d = _cut(gaussian(counts, r.sigma, nx, ny))
    high = d.join(d.groupBy("sample").agg(F.max("density").alias("peak")), "sample").filter(F.col("density") > r.share * F.col("peak"))
    mask = opening(fill_holes(closing(high, r.close, nx, ny, rim=True), nx, ny, r.hole), r.open_, nx, ny).join(within, KEY, "left_semi")
    basins = _each(boxed(lattice_components(mask), d, nx, ny, 0), lambda m, v: basins_of(v, m, r.apart, 0.0, r.saddle)).withColumnRenamed("piece", "basin")
    most = round(r.big * 1e6 / r.size**2)
    basins = _cut(basins.withColumn("big", F.count("*").over(Window.partitionBy(*BASIN)) > most))
    number = lambda *by: F.dense_rank().over(Window.partitionBy("sample").orderBy(*by)).cast("long")
    parts = [tight(basins.filter(F.col("big") == big).drop("big"), counts, nx, ny, sigma, r.rel, r.core_close, r.core_open, r.core_hole, r.connect, r.neck).withColumn("big", F.lit(big)) for big, sigma in ((False, r.fine), (True, r.broad))]
    cores = _cut(parts[0].unionByName(parts[1]).withColumn("core", number("region", "basin", "part", "piece")).select("sample", "core", "big", "iy", "ix"))
    small = cores.filter("not big").select("sample", F.col("core").alias("region"), "iy", "ix")
    again = oversized_split(small, counts, nx, ny, most, r.sigma, r.fine, r.resplit_apart, r.resplit_merge, r.resplit_rel, r.core_close, r.core_open, r.core_hole, r.connect, r.neck)
    both = again.withColumn("big", F.lit(False)).unionByName(cores.filter("big").select("sample", F.col("core").alias("region"), F.lit(1).cast("long").alias("piece"), "iy", "ix", "big"))
    return _cut(both.withColumn("core", number("region", "piece")).select("sample", "core", "big", "iy", "ix"))


def perimeter(mask: np.ndarray) -> float:
    """Length of a mask's border: border pixels weighed by how they go on, straight 1, diagonal sqrt 2, between them the mean."""
    m = np.pad(mask, 2)
    edge = m & ~(m & np.roll(m, 1, 0) & np.roll(m, -1, 0) & np.roll(m, 1, 1) & np.roll(m, -1, 1))
    e = edge.astype(np.int64)
    straight = sum(np.roll(e, s, a) for s in (1, -1) for a in (0, 1))
    diagonal = sum(np.roll(e, (s, t), (0, 1)) for s in (1, -1) for t in (1, -1))
    kind = np.where(edge, 1 + 2 * straight + 10 * diagonal, 0)
    # Neighbourhood codes of a border that goes on straight, diagonally, or changes between.
    return float(np.isin(kind, (5, 7, 15, 17, 25, 27)).sum() + np.sqrt(2) * np.isin(kind, (21, 33)).sum() + (1 + np.sqrt(2)) / 2 * np.isin(kind, (13, 23)).sum())


def clipped(mask: np.ndarray, core: np.ndarray, axis_ratio: float, circularity: float) -> bool:
    """Whether a region is long or ragged and a stretch of it along its main axis, around its core, could stand for it.

    Ratio of the axes and circularity are those of the part with most of the core."""
    number, n = labels(mask)
    part = mask if n == 1 else number == np.bincount(number[core & mask], minlength=2)[1:].argmax() + 1 if (core & mask).any() else number == np.bincount(number[mask])[1:].argmax() + 1
    y, x = np.nonzero(part)
    low, high = np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(np.stack([y, x]).astype(float), bias=True)), 0)) * 4
    around = perimeter(part)
    ratio, round_ = low / high if high > 0 else 1.0, 4 * np.pi * len(y) / around**2 if around > 0 else 0.0
    own = np.argwhere(mask).astype(float)
    if not (high > 0 and len(own) >= 5 and (ratio < axis_ratio or round_ < circularity)):
        return False
    centre = own.mean(0)
    along = np.linalg.eigh(np.cov((own - centre).T, bias=True))[1][:, -1]
    at, core_at = (own - centre) @ along, (np.argwhere(core) - centre) @ along
    half = min((at.max() - at.min()) / 2, low / axis_ratio / 2)
    return bool((np.abs((np.argwhere(core & mask) - centre) @ along - np.median(core_at)) <= half).any())


def reshaped(region: DataFrame, cores: DataFrame, r: CoreRules) -> DataFrame:
    """(sample, core, reshaped) of region(sample, core, iy, ix), many cores in a row in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of in whole_groups(batches, key, PIXELS_AT_ONCE):
            y, x, within, inside = _of(t, "iy", "ix", "within", "inside")
            first, found = np.searchsorted(of, np.arange(of[-1] + 2)), []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                at = y[a:b] - y[a], x[a:b] - x[a:b].min()  # rows are sorted
                mask, core = np.zeros((2, at[0][-1] + 1, at[1].max() + 1), bool)
                mask[at], core[at] = within[a:b], inside[a:b]
                found.append(bool(mask.any()) and clipped(mask, core, r.axis_ratio, r.circularity))
            yield pa.RecordBatch.from_arrays([*(pa.array(k[first[:-1]]) for k in _of(t, *key)), pa.array(found, pa.bool_())], [*key, "reshaped"])

    key = ["sample", "core"]
    own = [*key, "iy", "ix"]
    both = region.select(*own, F.lit(True).alias("within")).join(cores.select(*own, F.lit(True).alias("inside")), own, "full").fillna(False, ["within", "inside"])
    return _dealt(both, key).mapInArrow(run, "sample long, core long, reshaped boolean")


#: Gates in their order, and what each rejects.
GATES = ("size", "density", "reshape_too_small", "region_area", "partners", "all_density", "region_density")


def structures(cores: DataFrame, points: DataFrame, within: DataFrame, nx: Side, ny: Side, r: CoreRules) -> tuple[DataFrame, DataFrame]:
    """A row for each core with its figures, the first gate that it fails (null if none) and, if it passes, its number `id`, pixels and points of the structure;
    and the structures' pixels (sample, id, iy, ix).

    cores(sample, core, big, iy, ix); points(sample, iy, ix, kind), kind B, T, P (plasma), L (lymph vessel) or another. A structure is the core's halo
    within the tissue. Structures are numbered in each section by core; a pixel of several belongs to the first, and everything is counted again on owned pixels.
    """
    mm2, own = r.size**2 / 1e6, ["sample", "core"]
    counts = _cut(points.groupBy(*KEY).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in "BTPL"], F.count("*").alias("n_all")))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    core = cores.join(counts.select(*KEY, "n_b"), KEY, "left").groupBy(*own).agg(F.first("big").alias("big"), F.count("*").alias("core_px"), some("n_b"))
    density = F.col("n_b") / (F.col("core_px") * mm2)
    first = F.when((F.col("n_b") < r.points) | (F.col("core_px") < int(r.area * 1e6 / r.size**2)), "size").when(density < F.when(F.col("big"), r.big_density).otherwise(r.density), "density")
    core = _cut(core.withColumn("gate", first))
    left = cores.join(core.filter("gate is null").select(*own), own, "left_semi")
    keyed = left.select(F.struct(*own).alias("sample"), "iy", "ix")
    side = lambda n: n if isinstance(n, int) else left.select(*own).distinct().join(n, "sample").select(F.struct(*own).alias("sample"), "n")
    halo = dilate(keyed, round(r.halo / r.size), side(nx), side(ny)).select("sample.*", "iy", "ix")
    region = _cut(halo.join(within.select(*KEY), KEY, "left_semi"))
    around = region.join(counts, KEY, "left").groupBy(*own).agg(F.count("*").alias("px"), some("n_b"), some("n_t"), some("n_p"))
    around = around.select(*own, "px", *[F.col(c).alias(f"{c}_around") for c in ("n_b", "n_t", "n_p")])
    full = core.join(around, own, "left").join(reshaped(region, left, r), own, "left").fillna(0, ["px", "n_b_around", "n_t_around", "n_p_around"])
    b, t, p, area = F.col("n_b_around"), F.col("n_t_around"), F.col("n_p_around"), F.col("px") * mm2
    small = F.col("px") < int(r.region_area * 1e6 / r.size**2)
    gate = F.when(F.col("gate").isNotNull(), F.col("gate")).when(small & F.coalesce("reshaped", F.lit(False)), "reshape_too_small").when(small, "region_area").when(t < r.partners, "partners")
    gate = gate.when((b + t + p) / area < r.all_density, "all_density").when(b / area < r.region_density, "region_density")
    judged = _cut(full.withColumn("gate", gate))
    number = F.row_number().over(Window.partitionBy("sample").orderBy("core")).cast("long")
    passed = judged.filter("gate is null").select(*own, number.alias("id"))
    owned = _cut(region.join(passed, own).groupBy(*KEY).agg(F.min("id").alias("id")))
    again = owned.join(counts, KEY, "left").groupBy("sample", "id").agg(F.count("*").alias("owned_px"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_owned") for c in ("n_b", "n_t", "n_p", "n_l", "n_all")])
    out = judged.join(passed, own, "left").join(again, ["sample", "id"], "left")
    names = ["owned_px", *[f"{c}_owned" for c in ("n_b", "n_t", "n_p", "n_l", "n_all")]]
    mature = F.when(F.col("id").isNotNull(), F.when(F.coalesce("n_l_owned", F.lit(0)) > 0, "mature").otherwise("immature"))
    none = [F.when(F.col("id").isNotNull(), F.coalesce(c, F.lit(0))).alias(c) for c in names]  # all its pixels may belong to others
    return out.select(*own, "big", "core_px", "n_b", "gate", "px", "n_b_around", "n_t_around", "n_p_around", "id", *none, mature.alias("status")), owned


def lymphoid_structures(points: DataFrame, r: CoreRules = CoreRules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`structures` of points(cell_id, sample, x, y, kind), their pixels, and the tissue's."""
    moved, nx, ny = framed(points, r.size, r.pad)
    at, nx, ny = _cut(at_pixel(moved, nx, ny, r.size).select("kind", *KEY)), _cut(nx), _cut(ny)
    counted = lambda df: df.groupBy(*KEY).agg(F.count("*").alias("n"))
    ground = _cut(fill_holes(closing(gaussian(counted(at), r.tissue_sigma, nx, ny).filter(F.col("density") > r.tissue_least), r.tissue_close, nx, ny, rim=True), nx, ny))
    return *structures(dense_cores(counted(at.filter("kind = 'B'")), ground, nx, ny, r), at, ground, nx, ny, r), ground


def aggregates(points: DataFrame, kind: str, r: CoreRules, taken: DataFrame | None = None) -> DataFrame:
    """Cores of another kind, (sample, core, big, core_px, n, gate, touches): the gates `size` and `density`; a core that touches a pixel of
    `taken` (sample, iy, ix, in the same frame) is no aggregate."""
    moved, nx, ny = framed(points, r.size, r.pad)
    at, nx, ny = _cut(at_pixel(moved, nx, ny, r.size).select("kind", *KEY)), _cut(nx), _cut(ny)
    counted = lambda df: df.groupBy(*KEY).agg(F.count("*").alias("n"))
    ground = tissue(counted(at), nx, ny, r.tissue_sigma, r.tissue_least, r.tissue_close)
    own = counted(at.filter(F.col("kind") == kind))
    cores = dense_cores(own, ground, nx, ny, r).join(own, KEY, "left")
    hit = F.lit(False) if taken is None else F.col("hit").isNotNull()
    cores = cores if taken is None else cores.join(taken.select(*KEY, F.lit(1).alias("hit")).distinct(), KEY, "left")
    per = cores.groupBy("sample", "core").agg(F.first("big").alias("big"), F.count("*").alias("core_px"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max(hit).alias("touches"))
    density = F.col("n") / (F.col("core_px") * (r.size**2 / 1e6))
    gate = F.when((F.col("n") < r.points) | (F.col("core_px") < int(r.area * 1e6 / r.size**2)), "size").when(density < F.when(F.col("big"), r.big_density).otherwise(r.density), "density")
    return per.withColumn("gate", gate)
