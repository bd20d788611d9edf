"""Clusters of one column against a plain version, with rounded distances, dense stretches and values in many ranges."""

import random

import pytest

from dataplumb.operators import anomaly


def plain(values, eps, min_pts):
    """(cluster, kind, neighbours) of each value, in order of rows."""
    near = [[j for j, w in enumerate(values) if abs(v - w) <= eps] for v in values]
    core = [len(n) >= min_pts for n in near]
    cluster, label = 0, [None] * len(values)
    for k in range(len(values)):
        if core[k] and label[k] is None:
            todo, label[k] = [k], cluster
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] is None:
                        label[j] = cluster
                        todo.append(j)
            cluster += 1
    out = []
    for k, n in enumerate(near):
        reach = [label[j] for j in n if core[j]]
        kind = "CORE" if core[k] else "BORDER" if reach else "NOISE"
        out.append((label[k] if core[k] else min(reach) if reach else -1, kind, len(n) - 1))
    return out


CASES = {
    "tenths": ([k / 10 for k in range(60)] + [0.1 + 0.2, 7.3, 7.6, 7.9], 0.3, 4),
    "normal": ([random.Random(1).gauss(0, 1) for _ in range(700)], 0.02, 5),
    "gaps": ([random.Random(2).choice([0, 5, 9]) + random.Random(k).random() for k in range(400)], 0.05, 6),
    "repeats": ([round(random.Random(k).gauss(0, 3)) / 2 for k in range(500)], 0.5, 40),
    "signs": ([-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, -1.5, 1e-3, -1e-3], 0.5, 3),
    "one": ([3.0], 0.5, 1),
}


@pytest.mark.parametrize("name", CASES)
def test_one_column(spark, name):
    values, eps, min_pts = CASES[name]
    values = list(values)
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").coalesce(1)
    got = {r.id: (r.cluster_id, r.point_type, r.neighbor_count) for r in anomaly.dbscan(df, "v", eps, min_pts, "clusters", "k").collect()}
    assert [got[k] for k in range(len(values))] == plain(values, eps, min_pts)


def test_a_dense_stretch_makes_no_pairs(spark):
    """300,000 values within eps of each other."""
    df = spark.range(300_000).selectExpr("id / 300000D AS v")
    total = anomaly.dbscan(df, "v", 5.0, 10).first()
    assert (total.cluster_count, total.noise_count, total.largest_cluster_size) == (1, 0, 300_000)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,), (1.0,)], "v double")
    got = sorted((r.point_type, r.neighbor_count) for r in anomaly.dbscan(df, "v", 0.5, 2, "clusters").collect())
    assert got == [("CORE", 1), ("CORE", 1), ("NOISE", 0), ("NOISE", 0)]
    assert anomaly.dbscan(df.limit(0), "v").first().message == "No rows to evaluate (column is empty or all NULL)"
