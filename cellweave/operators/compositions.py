"""Whole recipes over points: each is a chain of the lattice operators, with every constant a parameter."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut
from .regions import interface
from .runs import labelled, pixels, runs
from .spatial import KEY, Side, at_pixel, closing, distance_fields, fill_holes, framed, gaussian, opening, remove_small


@dataclass(frozen=True)
class BoundaryRules:
    """Lengths of points' units: size and pad; all others in pixels of `size`. Fixed values of the recipe are the defaults."""

    size: float = 10.0
    pad: float = 100.0
    tissue_sigma: float = 10
    tissue_least: float = 0.015
    tissue_close: int = 10
    sigma: float = 5
    share: float = 0.1
    close: int = 5
    hole: int = 50_000
    open_: int = 3
    area: int = 500
    normal_area: int = 3_000
    seeds: int = 10


#: Thin strands of tumour, as in the pancreas.
STRANDS = replace(BoundaryRules(), sigma=3, share=0.03, close=2, area=100)


def class_mask(counts: DataFrame, nx: Side, ny: Side, rules: BoundaryRules) -> DataFrame:
    """Where one class is dense, cleaned: share of the section's highest density, close, fill holes, open, drop small parts."""
    d = gaussian(counts, rules.sigma, nx, ny)
    high = d.join(d.groupBy("sample").agg(F.max("density").alias("peak")), "sample").filter(F.col("density") > rules.share * F.col("peak"))
    filled = fill_holes(closing(high, rules.close, nx, ny, rim=True), nx, ny, rules.hole)
    return remove_small(opening(filled, rules.open_, nx, ny), rules.area).select(*KEY)


@dataclass
class Layers:
    """Points at their pixels, the frames' sides, and the masks of a section's tumour, normal and tissue."""

    points: DataFrame
    nx: DataFrame
    ny: DataFrame
    tissue: DataFrame
    tumor: DataFrame
    normal: DataFrame


def layers(points: DataFrame, rules: BoundaryRules) -> Layers:
    """points(cell_id, sample, x, y, kind), kind Tumor, Normal or another. A section with fewer than `seeds` points of a class has no mask of it."""
    moved, nx, ny = framed(points, rules.size, rules.pad)
    at = _cut(at_pixel(moved, nx, ny, rules.size).select("cell_id", "kind", *KEY))
    nx, ny = _cut(nx), _cut(ny)
    counts = at.groupBy(*KEY, "kind").agg(F.count("*").alias("n"))
    dense = gaussian(counts.groupBy(*KEY).agg(F.sum("n").alias("n")), rules.tissue_sigma, nx, ny).filter(F.col("density") > rules.tissue_least)
    tissue = _cut(fill_holes(closing(dense, rules.tissue_close, nx, ny, rim=True), nx, ny))
    enough = counts.groupBy("sample", "kind").agg(F.sum("n").alias("all")).filter(F.col("kind").isin("Tumor", "Normal") & (F.col("all") >= rules.seeds))
    class_of = F.col("sample") * 2 + (F.col("kind") == "Normal").cast("long")  # both classes at once, as sections of their own
    twice = lambda n: n.select(F.explode(F.array(F.col("sample") * 2, F.col("sample") * 2 + 1)).alias("sample"), "n")
    seeds = counts.join(enough, ["sample", "kind"], "left_semi").select(class_of.alias("sample"), "iy", "ix", "n")
    both = class_mask(seeds, twice(nx), twice(ny), rules).select(F.floor(F.col("sample") / 2).alias("sample"), "iy", "ix", (F.col("sample") % 2 == 0).alias("tumor"))
    both = _cut(both.join(tissue, KEY, "left_semi"))
    tumor = both.filter("tumor").select(*KEY)
    normal = _cut(remove_small(both.filter("not tumor").select(*KEY).join(tumor, KEY, "left_anti"), rules.normal_area).select(*KEY))
    return Layers(at, nx, ny, tissue, tumor, normal)


def named_regions(tumor: DataFrame, normal: DataFrame) -> DataFrame:
    """Pixels with the name of their region: Tumor-1 onwards by falling size, then Normal with the next numbers; equal sizes by their first pixel."""
    parts = [labelled(runs(m)).withColumn("kind", F.lit(k)).withColumn("rank", F.lit(i)) for i, (k, m) in enumerate((("Tumor", tumor), ("Normal", normal)))]
    both = parts[0].unionByName(parts[1])
    size = both.groupBy("sample", "rank", "kind", "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
    number = F.row_number().over(Window.partitionBy("sample").orderBy("rank", F.desc("size"), "region"))
    named = size.select("sample", "kind", "region", F.concat_ws("-", "kind", number.cast("string")).alias("name"))
    return pixels(both.join(named, ["sample", "kind", "region"]), "name")


def boundary(points: DataFrame, rules: BoundaryRules = BoundaryRules()) -> DataFrame:
    """A row for each point: its region (Unassigned outside), its side, the signed distance to the section's tumour (negative inside) with the
    name of the tumour region nearest to its pixel (of equally near pixels the first by row and column), and the signed distance to the
    interface of tumour and normal. Distances are rounded to 0.1; without a tumour, or an interface, they are null and the name is empty.
    """
    l = layers(points, rules)
    names = _cut(named_regions(l.tumor, l.normal))
    fields = distance_fields(l.tumor, l.nx, l.ny)
    sdf = fields.select(*KEY, ((F.sqrt("o2") - F.sqrt(F.coalesce("i2", F.lit(0)))) * rules.size).alias("sdf"), "jy", "jx")
    face = distance_fields(interface(l.tumor, l.normal, l.nx, l.ny), l.nx, l.ny).select(*KEY, (F.sqrt("o2") * rules.size).alias("face"))
    near = names.select("sample", F.col("iy").alias("jy"), F.col("ix").alias("jx"), F.col("name").alias("near"))
    at = l.points.join(sdf, KEY, "left").join(face, KEY, "left").join(names, KEY, "left").join(near, ["sample", "jy", "jx"], "left")
    inside = F.col("name").startswith("Tumor-")
    sign = F.when(inside & (F.col("face") > 0), -1.0).otherwise(1.0)
    return at.select(
        "cell_id", "sample", F.coalesce("name", F.lit("Unassigned")).alias("region"), F.when(inside, "Tumor").otherwise("Normal").alias("side"),
        F.round("sdf", 1).alias("dist_sdf_um"), F.coalesce("near", F.lit("")).alias("dist_sdf_region"), F.round(F.col("face") * sign, 1).alias("dist_iface_um"),
    )


def boundary_by_kind(points: DataFrame, rules: dict[str | None, BoundaryRules]) -> DataFrame:
    """`boundary` with rules by the column `cancer`; None has those of all other values."""
    named = [k for k in rules if k is not None]
    other = ~F.coalesce(F.col("cancer").isin(named), F.lit(False))
    parts = [boundary(points.filter(other if k is None else F.col("cancer") == k).drop("cancer"), r) for k, r in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tumor_area(l: Layers, rules: BoundaryRules) -> DataFrame:
    """A row for each section: tumour regions, areas in square millimetres of all tumour, its largest region and the tissue, tumour per cent of tissue (0 without tissue), and points."""
    mm2 = rules.size**2 / 1e6
    part = labelled(runs(l.tumor)).groupBy("sample", "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("px"))
    tumor = part.groupBy("sample").agg(F.count("*").alias("n_tumor_regions"), F.sum("px").alias("px"), F.max("px").alias("largest"))
    tissue = l.tissue.groupBy("sample").agg(F.count("*").alias("tissue"))
    cells = l.points.groupBy("sample").agg(F.count_if(F.col("kind") == "Tumor").alias("n_tumor_cells"), F.count("*").alias("n_cells"))
    both = cells.join(tumor, "sample", "left").join(tissue, "sample", "left").fillna(0, ["n_tumor_regions", "px", "largest", "tissue"])
    percent = F.when(F.col("tissue") > 0, F.round(100.0 * F.col("px") / F.col("tissue"), 4)).otherwise(0.0)
    area = lambda c, name: F.round(F.col(c) * mm2, 6).alias(name)
    return both.select("sample", "n_tumor_regions", area("px", "tumor_mm2"), area("largest", "largest_mm2"), area("tissue", "tissue_mm2"), percent.alias("tumor_percent"), "n_tumor_cells", "n_cells")
