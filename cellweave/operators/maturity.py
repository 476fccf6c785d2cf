"""Development of a structure from what could be measured: axes of available terms, rungs, confidence, composition, and tiers of linked objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MaturityRules:
    """Weights of the axes, values at which a share counts in full, and cuts. Fixed values of the recipe are the defaults; tau and tau_low come with the score's method."""

    weights: tuple[float, float, float, float] = (0.45, 0.20, 0.15, 0.20)
    full_aicda: float = 0.024
    full_bcl6: float = 0.05
    full_mki67: float = 0.03
    full_tfh: float = 0.10
    full_plasma: float = 0.20
    tau: float | None = -0.012307288311421869
    tau_low: float | None = -0.19203557074069977
    least_b: int = 50
    least_aicda: int = 4
    aicda_low: float = 0.004
    aicda_active: float = 0.013
    gcb: float = 0.07
    tfh: float = 0.05
    mki67: float = 0.013
    bcl6: float = 0.02
    few_aicda: int = 6
    plasma_high: float = 0.20
    plasma_low: float = 0.08


def share(c: str | Column, full: float | Column) -> Column:
    """c / full within 0 and 1; null where either is missing or nothing is full."""
    c = F.col(c) if isinstance(c, str) else c
    full = full if isinstance(full, Column) else F.lit(full)
    return F.when((full > 0) & c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / full)))


def available(*terms: tuple[float, Column]) -> Column:
    """The weighted mean of the terms that are there; null without any."""
    weight, total = F.lit(0.0), F.lit(0.0)
    for w, t in terms:
        weight, total = weight + F.when(t.isNotNull(), w).otherwise(0.0), total + F.coalesce(w * t, F.lit(0.0))
    return F.when(weight > 0, total / weight)


def section_norms(regions: DataFrame) -> DataFrame:
    """(sample, lamp3_mean, lamp3_std, hev_p90, area_p90) over a section's regions; the deviation of a single one is 0."""
    return regions.groupBy("sample").agg(F.avg("lamp3_density").alias("lamp3_mean"), F.stddev_pop("lamp3_density").alias("lamp3_std"), F.expr("percentile(hev_density, 0.9)").alias("hev_p90"), F.expr("percentile(area_mm2, 0.9)").alias("area_p90"))


def maturity(regions: DataFrame, r: MaturityRules = MaturityRules()) -> DataFrame:
    """regions with axes, score, rung (0 quiet, 1 low, 2 active), its path, confidence and composition.

    Columns: sample, aicda_frac, bcl6_frac, mki67_frac, gcb_frac, tfh_frac, plasma_frac, lamp3_density, hev_density, area_mm2, circularity, shell_index, moran, n_aicda,
    gc_score (mean; null: not scored), n_scored. A missing measure is null and leaves its term out. Norms are those of the section's regions.
    """
    out = regions.join(section_norms(regions), "sample", "left")
    z = F.when(F.col("lamp3_std") > 0, (F.col("lamp3_density") - F.col("lamp3_mean")) / F.col("lamp3_std"))
    one = lambda *terms: available(*[(1.0, t) for t in terms])
    axes = {
        "gc_axis": available((1.0, share("aicda_frac", r.full_aicda)), (1.0, share("bcl6_frac", r.full_bcl6)), (0.5, share("mki67_frac", r.full_mki67))),
        "tfh_axis": one(share("tfh_frac", r.full_tfh), share(z + 2, 4.0), share("hev_density", F.col("hev_p90"))),
        "plasma_axis": one(share("plasma_frac", r.full_plasma), share(F.col("shell_index") - 0.5, 1.5)),
        "structure_axis": one(share(0.5 - F.col("moran"), 1.0), share("circularity", 1.0), share("area_mm2", F.col("area_p90"))),
    }
    out = out.withColumns(axes).withColumn("score", available(*zip(r.weights, map(F.col, axes), strict=True)))
    scored = F.col("gc_score").isNotNull() if r.tau is not None else F.lit(False)
    enough = F.coalesce("n_aicda", F.lit(0)) >= r.least_aicda
    high = F.when(scored, (F.col("gc_score") >= (r.tau or 0.0)) & enough & (F.coalesce("n_scored", F.lit(0)) >= r.least_b)).otherwise((F.col("aicda_frac") >= r.aicda_active) & enough)
    high = F.coalesce(high, F.lit(False))
    both = F.coalesce((F.col("gcb_frac") >= r.gcb) & (F.col("tfh_frac") >= r.tfh) & (F.col("aicda_frac") >= r.aicda_low), F.lit(False))
    low = F.coalesce(F.col("aicda_frac") >= r.aicda_low, F.lit(False)) | (scored & (F.col("gc_score") >= r.tau_low) if r.tau_low is not None else F.lit(False))
    witness = F.coalesce(F.col("mki67_frac") >= r.mki67, F.lit(False)) | F.coalesce(F.col("bcl6_frac") >= r.bcl6, F.lit(False)) | F.coalesce(F.col("tfh_frac") >= r.tfh, F.lit(False))
    doubtful = high & F.col("n_aicda").between(r.least_aicda, r.few_aicda) & ~witness
    return out.withColumns({
        "rung": F.when(high | both, 2).when(low, 1).otherwise(0),
        "path": F.when(high & scored, "score").when(high, "frac").when(both, "path2").otherwise("none"),
        "confidence": F.when(doubtful, "LOW").otherwise("HIGH"),
        "composition": F.when(F.col("plasma_frac") >= r.plasma_high, "plasma_dominant").when(F.col("plasma_frac") < r.plasma_low, "b_dominant").otherwise("mixed"),
    }).drop("lamp3_mean", "lamp3_std", "hev_p90", "area_p90")


def tiers(objects: DataFrame, sections: int = 4, margins: float = 0.75, area: float | None = None) -> DataFrame:
    """objects(n_sections, margin_frac, median_area) with tier: A with at least `sections` sections, a share of `margins` of clear links and, if asked for, a median
    area; C on a single section; else B. Missing values count as 0."""
    sure = (F.col("n_sections") >= sections) & (F.coalesce("margin_frac", F.lit(0.0)) >= margins)
    if area is not None:
        sure = sure & (F.coalesce("median_area", F.lit(0.0)) >= area)
    return objects.withColumn("tier", F.when(sure, "A").when(F.col("n_sections") >= 2, "B").otherwise("C"))
