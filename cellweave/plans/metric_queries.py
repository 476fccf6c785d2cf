"""Class metrics as queries; their SQL ranks and integrates directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import metrics
from cellweave.sources.tables import table

from .catalog import query

CLASSES = ("click", "view", "purchase", "signup", "error")
#: A made-up score of event and class from the event's number, higher for its own class.
SCORE = "((e.event_id * (37 + 12 * c.k) + 101 * c.k) % 997) / 1250.0::DOUBLE + CASE WHEN e.event_type = c.class THEN 0.2::DOUBLE ELSE 0 END"
LONG = f"c(class, k) AS (VALUES {', '.join(f'({w!r}, {k})' for k, w in enumerate(CLASSES))}), s AS (SELECT c.class, c.k, e.event_id AS id, e.user_id, e.event_type, CASE WHEN e.event_type = c.class THEN 1 ELSE 0 END AS y, {SCORE} AS p, 1 + e.event_id % 3 AS w FROM events e CROSS JOIN c)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class, k, id, user_id, event_type, y, p, w): a row for each event and class."""
    kinds = F.posexplode(F.array(*map(F.lit, CLASSES))).alias("k", "class")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", kinds)
    own = F.col("event_type") == F.col("class")
    p = ((F.col("id") * (37 + 12 * F.col("k")) + 101 * F.col("k")) % 997) / 1250.0 + F.when(own, 0.2).otherwise(0.0)
    return e.select("class", "k", "id", "user_id", "event_type", own.cast("int").alias("y"), p.alias("p"), (1 + F.col("id") % 3).alias("w"))


@query(f"WITH {LONG}, b AS (SELECT class, least(floor(p * 200000), 199999) AS bin, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1, 2), d AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY bin DESC) AS tp, sum(neg) OVER (PARTITION BY class ORDER BY bin DESC) AS fp FROM b), t AS (SELECT *, coalesce(lag(tp) OVER (PARTITION BY class ORDER BY bin DESC), 0) AS tp0, coalesce(lag(fp) OVER (PARTITION BY class ORDER BY bin DESC), 0) AS fp0 FROM d) SELECT class, CAST(max(tp) AS BIGINT) AS positives, CAST(max(fp) AS BIGINT) AS negatives, round(sum((fp - fp0) * (tp + tp0) / 2.0::DOUBLE) / max(tp) / max(fp), 8) AS auc FROM t GROUP BY class")
def a18_roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binned_roc(scored(spark, sf_dir)).withColumn("auc", F.round("auc", 8))


@query(f"WITH {LONG}, r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2.0::DOUBLE AS rk FROM s), a AS (SELECT class, CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) - sum(y) AS BIGINT) AS negatives, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))::DOUBLE) AS auroc FROM r GROUP BY class) SELECT class, positives, negatives, round(auroc, 8) AS auroc FROM a UNION ALL SELECT '__MACRO__', CAST(sum(positives) AS BIGINT), CAST(sum(negatives) AS BIGINT), round(avg(auroc), 8) FROM a")
def a17_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.one_vs_rest(scored(spark, sf_dir)).withColumn("auroc", F.round("auroc", 8))


@query(f"WITH {LONG}, d AS (SELECT class, w * y AS tp, sum(w * y) OVER (PARTITION BY class ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS a, sum(w) OVER (PARTITION BY class ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS b FROM s) SELECT class, round(sum(tp * a / b::DOUBLE) / sum(tp), 8) AS ap FROM d GROUP BY class")
def a19_weighted_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_precision(scored(spark, sf_dir)).withColumn("ap", F.round("ap", 8))


COMPOSED = f"""{LONG}, m AS (SELECT id, user_id % 20 AS patient, event_type AS truth, arg_max(class, round(p * 10000) * 10 - k) AS pred FROM s GROUP BY 1, 2, 3), u AS (SELECT patient, truth AS class, 1 AS t, 0 AS p FROM m UNION ALL SELECT patient, pred, 0, 1 FROM m), n AS (SELECT patient, class, sum(t) AS t, sum(p) AS p FROM u GROUP BY 1, 2),
  x AS (SELECT 'all' AS basis, * FROM n UNION ALL SELECT 'scored', * FROM n WHERE class <> 'error'), h AS (SELECT *, t / sum(t) OVER (PARTITION BY basis, patient)::DOUBLE AS ts, p / sum(p) OVER (PARTITION BY basis, patient)::DOUBLE AS ps FROM x)"""


def composed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users in 20 patients; an event's prediction is its best class, of equal ones the first; `error` is not scored."""
    best = scored(spark, sf_dir).groupBy("id", (F.col("user_id") % 20).alias("patient"), F.col("event_type").alias("truth")).agg(F.max_by("class", F.struct(F.round(F.col("p") * 10000), -F.col("k"))).alias("pred"))
    return metrics.composition_errors(best, "error")


@query(f"WITH {COMPOSED} SELECT basis, class, round(avg(abs(ln(ps + 0.000001) - ln(ts + 0.000001))), 6) AS log_error, count(*) AS n_patients FROM h WHERE class <> 'error' AND t > 0 GROUP BY 1, 2")
def a23_class_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composed(spark, sf_dir)[0].withColumn("log_error", F.round("log_error", 6))


@query(f"WITH {COMPOSED}, ce AS (SELECT basis, class, avg(abs(ln(ps + 0.000001) - ln(ts + 0.000001))) AS e FROM h WHERE class <> 'error' AND t > 0 GROUP BY 1, 2), l AS (SELECT basis, patient, sum(CASE WHEN class <> 'error' THEN abs(ps - ts) ELSE 0 END) AS a, sum(abs(ps - ts)) AS b FROM h GROUP BY 1, 2) SELECT basis, round((SELECT avg(e) FROM ce WHERE ce.basis = l.basis), 6) AS log_error, round(avg(a), 6) AS l1_scored, round(avg(b), 6) AS l1_all FROM l GROUP BY basis")
def a23_patient_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composed(spark, sf_dir)[1].select("basis", *[F.round(c, 6).alias(c) for c in ("log_error", "l1_scored", "l1_all")])
