"""Class metrics at size: curves from fixed bins, exact ranks and precision by running sums within bins, errors of composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores lie in 0..1; this many bins carry the totals on which running sums within a bin are built.
CUTS = 1024


def binned_roc(scores: DataFrame, bins: int = 200_000) -> DataFrame:
    """By class of scores(class, y, p): positives, negatives and the area under the curve through the bins' edges, by trapezoids; null without positives or negatives.

    p = 1 falls in the last bin. Only counts by bin are sorted, so the window has at most `bins` rows for each class."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    n = scores.groupBy("class", bin_.alias("bin")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    down = Window.partitionBy("class").orderBy(F.desc("bin"))
    step = n.withColumn("tp", F.sum("pos").over(down)).select("class", "pos", "neg", (F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2).alias("area"))
    total = step.groupBy("class").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("area").alias("area"))
    return total.select("class", "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("area") / F.col("positives") / F.col("negatives")).alias("auc"))


def _above(counts: DataFrame, order: list, *sums: str) -> DataFrame:
    """counts(class, p, ...) with, for each of `sums`, its running total from the highest p on, the row's own included: `upto_...`. Rows of one class
    and score bin are sorted in one task, totals of bins in another; rows that `order` does not tell apart may come in any order."""
    binned = counts.withColumn("bin", F.least(F.floor(F.col("p") * CUTS), F.lit(CUTS - 1)))
    before = Window.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy("class", "bin").agg(*[F.sum(s).alias(f"all_{s}") for s in sums])
    starts = totals.select("class", "bin", *[F.coalesce(F.sum(f"all_{s}").over(before), F.lit(0)).alias(f"from_{s}") for s in sums])
    within = Window.partitionBy("class", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return binned.join(starts, ["class", "bin"]).withColumns({f"upto_{s}": F.col(f"from_{s}") + F.sum(s).over(within) for s in sums})


def one_vs_rest(scores: DataFrame) -> DataFrame:
    """By class of scores(class, y, p): positives, negatives and the exact AUROC (ties count half), null for a class without positives or negatives; and
    `__MACRO__`, the mean of the others. Equal scores are counted first."""
    n = scores.groupBy("class", "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    ranked = _above(n, [F.desc("p")], "pos")
    wins = F.col("neg") * (F.col("upto_pos") - F.col("pos") / 2)
    c = ranked.groupBy("class").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(wins).alias("wins"))
    c = c.select("class", "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("wins") / F.col("positives") / F.col("negatives")).alias("auroc"))
    return c.unionByName(c.agg(F.lit("__MACRO__").alias("class"), F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"), F.avg("auroc").alias("auroc")))


def weighted_precision(scores: DataFrame) -> DataFrame:
    """By class of scores(class, id, y, p, w): average precision with row weights, from the highest p on, equal ones by id; null without weight on either side."""
    rows = scores.select("class", "id", "p", (F.col("w") * F.col("y")).alias("tp"), F.col("w").cast("double").alias("w"))
    ranked = _above(rows, [F.desc("p"), "id"], "tp", "w")
    c = ranked.groupBy("class").agg(F.sum("tp").alias("pos"), F.sum("w").alias("all"), F.sum(F.col("tp") * F.col("upto_tp") / F.greatest(F.col("upto_w"), F.lit(1e-12))).alias("s"))
    return c.select("class", F.when((F.col("pos") > 0) & (F.col("all") > F.col("pos")), F.col("s") / F.col("pos")).alias("ap"))


def composition_errors(cells: DataFrame, unscored: str, eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Errors of patients' composition, from cells(patient, truth, pred): by basis and class the mean |difference of log(share + eps)| over patients that have
    the class, and how many; by basis the mean of these over classes, and the mean L1 distance of shares over scored and over all classes.

    Basis all: shares of all cells. Basis scored: of cells in scored classes only, on either side. A class nobody has is left out of the mean."""
    side = lambda c, n: cells.groupBy("patient", F.col(c).alias("class")).agg(F.count("*").alias(n))
    both = side("truth", "t").join(side("pred", "p"), ["patient", "class"], "full").fillna(0, ["t", "p"])
    per = Window.partitionBy("basis", "patient")
    kinds = F.explode(F.array(F.lit("all"), F.lit("scored"))).alias("basis")
    long = both.select("*", kinds).filter((F.col("basis") == "all") | (F.col("class") != unscored))
    share = lambda c: F.when(F.sum(c).over(per) > 0, F.col(c) / F.sum(c).over(per)).otherwise(0.0)
    long = long.withColumn("ts", share("t")).withColumn("ps", share("p")).withColumn("scored", F.col("class") != unscored)
    present = long.filter("scored and t > 0")
    by_class = present.groupBy("basis", "class").agg(F.avg(F.abs(F.log(F.col("ps") + eps) - F.log(F.col("ts") + eps))).alias("log_error"), F.count("*").alias("n_patients"))
    l1 = F.abs(F.col("ps") - F.col("ts"))
    patient = long.groupBy("basis", "patient").agg(F.sum(F.when(F.col("scored"), l1).otherwise(0.0)).alias("scored"), F.sum(l1).alias("every"))
    means = patient.groupBy("basis").agg(F.avg("scored").alias("l1_scored"), F.avg("every").alias("l1_all"))
    return by_class, by_class.groupBy("basis").agg(F.avg("log_error").alias("log_error")).join(means, "basis")
