"""Maturity and tiers as queries: suppliers stand for regions, their nations for sections, shares of their lines for the measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.maturity import maturity, tiers
from cellweave.sources.tables import table

from .catalog import query

ROUNDED = ("gc_axis", "tfh_axis", "plasma_axis", "structure_axis", "score")
LINES = """f AS (SELECT l_suppkey AS k, CAST(sum(CASE WHEN l_quantity = 7 AND l_tax < 0.03 THEN 1 ELSE 0 END) AS BIGINT) AS n_aicda, avg(CASE WHEN l_quantity = 7 AND l_tax < 0.03 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS aicda_frac, avg(CASE WHEN l_quantity < 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bcl6_frac,
  avg(CASE WHEN l_quantity = 9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS mki67_frac, avg(CASE WHEN l_quantity < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS gcb_frac, avg(CASE WHEN l_discount = 0.04 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tfh_frac, avg(CASE WHEN l_discount < 0.02 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS plasma_frac,
  avg(l_quantity) AS lamp3_density, CASE WHEN l_suppkey % 3 > 0 THEN avg(l_tax) END AS hev_density, sum(l_extendedprice) / 1e7::DOUBLE AS area_mm2, CAST(count(*) AS BIGINT) AS n_scored FROM lineitem GROUP BY l_suppkey)"""
MATURE = f"""WITH {LINES}, g AS (SELECT s_nationkey AS sample, s_suppkey AS region, f.*, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal / 10000 END AS circularity, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal / 5000 END AS shell_index, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal / 20000 END AS moran, CASE WHEN s_suppkey % 2 > 0 THEN s_acctbal / 40000 - 0.15 END AS gc_score FROM supplier JOIN f ON k = s_suppkey),
  n AS (SELECT sample AS s, avg(lamp3_density) AS m, stddev_pop(lamp3_density) AS sd, quantile_cont(hev_density, 0.9) AS h, quantile_cont(area_mm2, 0.9) AS a FROM g GROUP BY 1),
  t AS (SELECT *, greatest(0, least(1, aicda_frac / 0.024)) AS g1, greatest(0, least(1, bcl6_frac / 0.05)) AS g2, greatest(0, least(1, mki67_frac / 0.03)) AS g3, list_filter([least(1, tfh_frac / 0.1), CASE WHEN sd > 0 THEN greatest(0, least(1, ((lamp3_density - m) / sd + 2) / 4)) END, CASE WHEN h > 0 AND hev_density IS NOT NULL THEN least(1, hev_density / h) END], lambda v: v IS NOT NULL) AS tf,
    list_filter([least(1, plasma_frac / 0.2), CASE WHEN shell_index IS NOT NULL THEN greatest(0, least(1, (shell_index - 0.5) / 1.5)) END], lambda v: v IS NOT NULL) AS pl, list_filter([CASE WHEN moran IS NOT NULL THEN greatest(0, least(1, 0.5 - moran)) END, CASE WHEN circularity IS NOT NULL THEN greatest(0, least(1, circularity)) END, least(1, area_mm2 / a)], lambda v: v IS NOT NULL) AS st FROM g JOIN n ON s = sample),
  x AS (SELECT *, (g1 + g2 + 0.5 * g3) / 2.5 AS gc_axis, list_avg(tf) AS tfh_axis, list_avg(pl) AS plasma_axis, list_avg(st) AS structure_axis, coalesce(CASE WHEN gc_score IS NOT NULL THEN gc_score >= -0.012307288311421869 AND n_aicda >= 4 AND n_scored >= 50 ELSE aicda_frac >= 0.013 AND n_aicda >= 4 END, false) AS high, gcb_frac >= 0.07 AND tfh_frac >= 0.05 AND aicda_frac >= 0.004 AS duo FROM t)
  SELECT sample, region, round(gc_axis, 6) AS gc_axis, round(tfh_axis, 6) AS tfh_axis, round(plasma_axis, 6) AS plasma_axis, round(structure_axis, 6) AS structure_axis, round(0.45 * gc_axis + 0.2 * tfh_axis + 0.15 * plasma_axis + 0.2 * structure_axis, 6) AS score,
    CASE WHEN high OR duo THEN 2 WHEN aicda_frac >= 0.004 OR coalesce(gc_score >= -0.19203557074069977, false) THEN 1 ELSE 0 END AS rung, CASE WHEN high AND gc_score IS NOT NULL THEN 'score' WHEN high THEN 'frac' WHEN duo THEN 'path2' ELSE 'none' END AS path,
    CASE WHEN high AND n_aicda BETWEEN 4 AND 6 AND mki67_frac < 0.013 AND bcl6_frac < 0.02 AND tfh_frac < 0.05 THEN 'LOW' ELSE 'HIGH' END AS confidence, CASE WHEN plasma_frac >= 0.2 THEN 'plasma_dominant' WHEN plasma_frac < 0.08 THEN 'b_dominant' ELSE 'mixed' END AS composition FROM x"""


@query(MATURE)
def c4_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    q, tax, off = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("region")).agg(
        F.count_if((q == 7) & (tax < 0.03)).alias("n_aicda"), share((q == 7) & (tax < 0.03)).alias("aicda_frac"), share(q < 3).alias("bcl6_frac"), share(q == 9).alias("mki67_frac"), share(q < 5).alias("gcb_frac"), share(off == 0.04).alias("tfh_frac"),
        share(off < 0.02).alias("plasma_frac"), F.avg(q).alias("lamp3_density"), F.avg(tax).alias("hev"), (F.sum("l_extendedprice") / 1e7).alias("area_mm2"), F.count("*").alias("n_scored"),
    )
    every = lambda k, v: F.when(F.col("region") % k > 0, v)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("region"), F.col("s_nationkey").alias("sample"), F.col("s_acctbal").alias("v"))
    g = s.join(f, "region").select("*", every(3, F.col("hev")).alias("hev_density"), every(4, F.col("v") / 10000).alias("circularity"), every(5, F.col("v") / 5000).alias("shell_index"), every(7, F.col("v") / 20000).alias("moran"), every(2, F.col("v") / 40000 - 0.15).alias("gc_score"))
    return maturity(g).select("sample", "region", *[F.round(c, 6).alias(c) for c in ROUNDED], "rung", "path", "confidence", "composition")


TIERS = "WITH o AS (SELECT o_custkey AS object, count(DISTINCT o_orderpriority) AS n_sections, avg(CASE WHEN o_orderstatus <> 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS margin_frac, CASE WHEN o_custkey % 6 > 0 THEN quantile_cont(o_totalprice, 0.5) / 2e6::DOUBLE END AS median_area FROM orders GROUP BY 1)"


@query(f"{TIERS} SELECT object, CASE WHEN n_sections >= 4 AND margin_frac >= 0.75 THEN 'A' WHEN n_sections >= 2 THEN 'B' ELSE 'C' END AS linked, CASE WHEN n_sections >= 4 AND margin_frac >= 0.75 AND coalesce(median_area, 0) >= 0.05 THEN 'A' WHEN n_sections >= 2 THEN 'B' ELSE 'C' END AS tier FROM o")
def c8_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of customers as objects, of linking alone and with the later rule's area."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("object"))
    o = o.agg(F.countDistinct("o_orderpriority").alias("n_sections"), F.avg((F.col("o_orderstatus") != "O").cast("double")).alias("margin_frac"), F.expr("percentile(o_totalprice, 0.5)").alias("m"))
    o = o.withColumn("median_area", F.when(F.col("object") % 6 > 0, F.col("m") / 2e6))
    return tiers(tiers(o).withColumnRenamed("tier", "linked"), area=0.05).select("object", "linked", "tier")
