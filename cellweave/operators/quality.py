"""Which cells, fields and samples stay: reasons by row, reports by block, and the cohort with every cause of exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REASONS = ("drop_no_model", "drop_blank", "drop_out_of_focus", "drop_no_visible_nucleus", "drop_featureless")


def cell_keep(cells: DataFrame, focus: DataFrame | None, allow_missing: bool = False) -> DataFrame:
    """cells(cell_id, block, has_model, drop_blank, ...) with the five reasons and `keep`. focus(cell_id, out_of_focus, no_visible_nucleus, featureless) has one
    row for each measured cell; a cell without one, and a null flag, has no reason there. Without focus measures ValueError, unless they may be missing."""
    if focus is None and not allow_missing:
        raise ValueError("no focus measures: three of the five rules cannot be judged")
    if focus is None:
        out = cells.withColumns({r: F.lit(None).cast("boolean") for r in REASONS[2:]})
    else:
        out = cells.join(focus.select("cell_id", *[F.col(r.removeprefix("drop_")).alias(r) for r in REASONS[2:]]), "cell_id", "left")
    out = out.withColumn("drop_no_model", ~F.col("has_model")).withColumns({r: F.coalesce(r, F.lit(False)) for r in REASONS})
    return out.withColumn("keep", ~F.greatest(*REASONS))


def block_report(kept: DataFrame, blurred: float = 0.80) -> DataFrame:
    """By block: cells, kept cells, their share, whether it has a model, and the mark of blur: some cells are kept, but at most `blurred` of all."""
    by = kept.groupBy("block").agg(F.count("*").alias("n_cells"), F.count_if("keep").alias("n_keep"), F.max("has_model").alias("has_model"))
    share = F.col("n_keep") / F.col("n_cells")
    return by.select("block", "n_cells", "n_keep", F.round(share, 6).alias("frac_keep"), "has_model", ((share <= blurred) & (F.col("n_keep") > 0)).alias("blur"))


def weak_fields(tiles: DataFrame, least: int = 30, most: float = 0.50) -> DataFrame:
    """tiles(field, weak), weak null where not measured: a field is weak with at least `least` measured tiles and more than `most` of them weak; without any, its share is null."""
    by = tiles.groupBy("field").agg(F.count("weak").alias("n_tiles"), F.avg(F.col("weak").cast("double")).alias("share"))
    return by.select("field", "n_tiles", F.round("share", 6).alias("weak_frac"), F.coalesce((F.col("n_tiles") >= least) & (F.col("share") > most), F.lit(False)).alias("weak"))


def cohort(fields: DataFrame, blur: DataFrame, index: DataFrame, weak_max: float = 0.5, blur_min: float = 0.50) -> DataFrame:
    """fields(field, lowqc, weak_frac, n_keep, ...) with `causes`, joined by commas in their fixed order, and `kept`. blur(field, frac_keep) has the fields with
    a blur map; index(field, has_table) those with a folder. A missing weak_frac excludes, a missing n_keep counts as 0, a missing blur map does not exclude."""
    all_ = fields.join(blur.select("field", F.col("frac_keep").alias("blur_frac")), "field", "left").join(index.select("field", "has_table"), "field", "left")
    cause = lambda name, when: F.when(F.coalesce(when, F.lit(False)), name)
    causes = F.concat_ws(",", cause("lowqc", F.col("lowqc")), cause("weak", F.col("weak_frac").isNull() | (F.col("weak_frac") > weak_max)), cause("zero_keep", F.coalesce("n_keep", F.lit(0)) <= 0), cause("blur", F.col("blur_frac") < blur_min), F.when(F.col("has_table").isNull(), "no_folder").when(~F.col("has_table"), "no_table"))
    return all_.withColumn("causes", causes).withColumn("kept", F.col("causes") == "")
