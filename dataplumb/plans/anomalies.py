"""Queries of the anomaly functions; the clusters' SQL is the textbook form over windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly
from .checks import table


def anomaly_dbscan(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 0).alias("p"))
    return anomaly.dbscan(df, "p", 20.0, 4, "clusters", id_column="o_orderkey").select(F.col("id").alias("o_orderkey"), "value", "cluster_id", "point_type", "neighbor_count", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


_DBSCAN = """
WITH f AS (SELECT o_orderkey, round(o_totalprice, 0) AS v, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders),
n AS (SELECT *, count(*) OVER (ORDER BY v RANGE BETWEEN 20.0 PRECEDING AND 20.0 FOLLOWING) - 1 AS nb FROM f),
g AS (SELECT v, rn, CASE WHEN v - lag(v) OVER (ORDER BY v, rn) > 20 THEN 1 ELSE 0 END AS new FROM n WHERE nb + 1 >= 4),
r AS (SELECT v, rn, sum(new) OVER (ORDER BY v, rn) AS run FROM g),
k AS (SELECT run, row_number() OVER (ORDER BY min(rn)) - 1 AS cluster FROM r GROUP BY run),
c AS (SELECT DISTINCT v, cluster FROM r JOIN k USING (run)),
b AS (SELECT n.v, min(c.cluster) AS border FROM (SELECT DISTINCT v FROM n WHERE nb + 1 < 4) n JOIN c ON c.v BETWEEN n.v - 20 AND n.v + 20 GROUP BY n.v),
e AS (SELECT n.*, coalesce(c.cluster, b.border, -1) AS cluster, CASE WHEN nb + 1 >= 4 THEN 'CORE' WHEN b.border IS NOT NULL THEN 'BORDER' ELSE 'NOISE' END AS kind FROM n LEFT JOIN c ON c.v = n.v LEFT JOIN b ON b.v = n.v),
m AS (SELECT max(nb)::DOUBLE AS m FROM e)
SELECT o_orderkey, v AS value, cluster::INT AS cluster_id, kind AS point_type, nb AS neighbor_count,
  round(CASE kind WHEN 'NOISE' THEN 1.0 WHEN 'CORE' THEN 0.1 + 0.2 * (1 - nb / m) ELSE 0.3 + 0.3 * (1 - nb / m) END, 6) AS anomaly_score, kind = 'NOISE' AS is_anomaly FROM e, m
"""


def anomaly_forest(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 1000 == 0, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice")).alias("p"))
    return anomaly.isolation_forest(df, "p", 50, 256, 0.01, "scores", 42, "o_orderkey").where("is_anomaly").select("id", "value", "is_anomaly")


def _unit(k, salt: int):
    """A number in -1..1 made from a whole one; exact, so that SQL needn't make it too."""
    return F.pmod(k * 7919 + salt, F.lit(2001)) / 1000 - 1


def _share(df, planted) -> float:
    """The contamination that lets exactly as many rows be flagged as are planted. Runs a count."""
    n, m = df.agg(F.count("*"), F.count(F.when(planted, 1))).first()
    return (m - 0.5) / max(n - 1, 1)


def _flagged(df, columns, planted, *args, **options):
    out = anomaly.isolation_forest_mv(df, columns, 100, 256, _share(df, planted), "scores", 42, *args, id_column="o_orderkey", **options)
    return out.where("is_anomaly").select(F.col("id").alias("o_orderkey"))


_PLANTED = "SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 0"


def anomaly_forest_mixed(spark, sf_dir):
    """Planted rows have categories of their own and other prices: they and no others are flagged."""
    planted = F.col("o_orderkey") % 100 == 0
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(planted, F.concat(F.lit("odd"), F.col("o_orderkey") % 5)).otherwise(F.col("o_orderpriority")).alias("kind"), F.when(planted, F.col("o_totalprice") * 3 + 2e6).otherwise(F.col("o_totalprice")).alias("price"))
    return _flagged(df, "kind,price", planted)


def anomaly_forest_planes(spark, sf_dir):
    """Two numbers that go together, but for the planted rows; each number alone is as in other rows."""
    k, planted = F.col("o_orderkey"), F.col("o_orderkey") % 100 == 0
    x, noise = _unit(k, 0), _unit(F.floor(k / 3), 17) / 100
    far = F.when(x < 0, -0.4).otherwise(0.4) + x / 3
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(planted, far).otherwise(x).alias("x"), F.when(planted, -far).otherwise(x + noise).alias("y"))
    return _flagged(df, "x,y", planted, 2, "normal", ntry=10, prob_pick_avg_gain=0.5)


def anomaly_forest_density(spark, sf_dir):
    """One value stands in large leaves, the planted ones in leaves of their own.

    The planted values lie closer together than they are from the other one, however large the keys: spread by the keys themselves, the
    least of them come to lie below every tree's split, in the other value's leaf.
    """
    planted = F.col("o_orderkey") % 100 == 0
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(planted, 1000.0 + _unit(F.col("o_orderkey"), 0)).otherwise(5.0).alias("v"))
    return _flagged(df, "v", planted, 1, "uniform", "density")


def anomaly_forest_weights(spark, sf_dir):
    """A value that is rare among the rows and common in samples by weight: flagged without weights, and not with them."""
    planted = F.col("o_orderkey") % 100 == 0
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(planted, 1000.0).otherwise(_unit(F.col("o_orderkey"), 3)).alias("v"), F.when(planted, 1e5).otherwise(1.0).alias("w"))
    plain, weighted = _flagged(df, "v", planted), _flagged(df, "v", planted, weight_column="w")
    both = df.where(planted).select("o_orderkey").join(plain.withColumn("plain", F.lit(True)), "o_orderkey", "left").join(weighted.withColumn("weighted", F.lit(True)), "o_orderkey", "left")
    return both.select("o_orderkey", F.coalesce("plain", F.lit(False)).alias("plain"), F.coalesce("weighted", F.lit(False)).alias("weighted"))


QUERIES = {"anomaly_dbscan": anomaly_dbscan, "anomaly_forest": anomaly_forest, "anomaly_forest_mixed": anomaly_forest_mixed, "anomaly_forest_planes": anomaly_forest_planes, "anomaly_forest_density": anomaly_forest_density, "anomaly_forest_weights": anomaly_forest_weights}
ORACLES = {
    "anomaly_dbscan": _DBSCAN, "anomaly_forest_mixed": _PLANTED, "anomaly_forest_planes": _PLANTED, "anomaly_forest_density": _PLANTED,
    "anomaly_forest_weights": "SELECT o_orderkey, true AS plain, false AS weighted FROM orders WHERE o_orderkey % 100 = 0",
}
