"""Forests: categories, hyperplanes, guided splits, weights, scores by leaf sizes, ties and arguments."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from dataplumb.operators import forest
from dataplumb.operators.forest import Forest, Tree, average_path, isolation_forest, isolation_forest_mv, keys


def scores(df, columns, *args, id_column="id", contamination=0.1, **options):
    out = isolation_forest_mv(df, columns, 100, 256, contamination, "scores", 42, *args, id_column=id_column, **options)
    return {r.id: (r.anomaly_score, r.is_anomaly) for r in out.collect()}


def top(found):
    return max(found, key=lambda k: found[k][0])


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, "A", 10.0), (2, "A", 11.0), (3, "A", 10.5), (4, "B", 20.0), (5, "B", 21.0), (6, "B", 20.5), (7, "C", 100.0)]
    return spark.createDataFrame(rows, "id int, category string, value double")


@pytest.fixture(scope="module")
def plane(spark):
    rows = [(1.0, 1.0), (1.1, 1.1), (1.2, 0.9), (0.9, 1.2), (1.05, 1.05), (10.0, 10.0)]
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], "id int, x double, y double")


def test_categories(spark, mixed):
    found = scores(mixed, "category,value")
    assert top(found) == 7 and all(0 <= s <= 1 for s, _ in found.values())
    rare = spark.createDataFrame([(k, "common") for k in range(1, 10)] + [(10, "rare")], "id int, category string")
    assert top(scores(rare, "category")) == 10
    two = spark.createDataFrame([(1, "X", "P", 10.0), (2, "X", "P", 11.0), (3, "X", "Q", 10.5), (4, "Y", "P", 20.0), (5, "Y", "Q", 21.0), (6, "Y", "P", 20.5), (7, "Z", "R", 100.0)], "id int, a string, b string, value double")
    assert top(scores(two, "a,b,value")) == 7
    only = spark.createDataFrame([(k, "only") for k in range(5)], "id int, category string")
    assert not any(flag for _, flag in scores(only, "category").values())
    gaps = spark.createDataFrame([(1, "A", 10.0), (2, None, 11.0), (3, "A", 10.5), (4, "B", None), (5, "B", 21.0), (6, "B", float("nan"))], "id int, category string, value double")
    assert set(scores(gaps, "category,value")) == {1, 3, 5}
    many = spark.createDataFrame([(k, f"c{k}") for k in range(1, 21)] + [(21, "c1")], "id int, category string")
    assert len(scores(many, "category")) == 21
    assert scores(many.limit(0), "category") == {}


def test_rare_categories_among_many_rows(spark):
    """More rows than a sample: categories that no tree knows are scored too."""
    rows = [(k, f"rare{k}" if k % 1000 == 7 else "ab"[k % 2], float(k % 13)) for k in range(4000)]
    found = scores(spark.createDataFrame(rows, "id int, category string, value double").repartition(3), "category,value", contamination=0.002)
    assert {k for k, (_, flag) in found.items() if flag} <= {k for k in range(4000)} and len(found) == 4000
    normal = np.median([s for k, (s, _) in found.items() if k % 1000 != 7])
    assert all(0 <= s <= 1 for s, _ in found.values()) and normal < 0.6


def test_hyperplanes_find_what_single_columns_miss():
    misses = hits = 0
    for seed in range(3):
        draw = np.random.default_rng(seed)
        t = draw.uniform(-1, 1, 1000)
        x = np.vstack([np.column_stack([t + draw.normal(0, 0.02, 1000), t + draw.normal(0, 0.02, 1000)]), [0.2, -0.2]])
        place = []
        for ndim in (1, 2):
            trees = []
            for k in range(100):
                rng = np.random.default_rng([seed, k])
                some = rng.choice(len(x), 256, replace=False)
                trees.append(Tree(x[some], np.zeros((256, 0), int), rng, 9, ndim=ndim, normal=True))
            s = Forest(trees, [[] for _ in trees], 256, "depth").score(x, [])
            place.append(int((s > s[-1]).sum()))
        misses += place[0] >= 25
        hits += place[1] < 25
    assert misses == 3 and hits == 3


@pytest.mark.parametrize("args", [(2,), (2, "normal"), (2, "uniform", "density"), (1, "uniform", "adj_depth"), (1, None, None, None, 10, 1.0), (2, "uniform", "depth", None, 10, 1.0)])
def test_options_find_the_outlier_again(plane, args):
    found = scores(plane, "x,y", *args)
    assert len(found) == 6 and max(s for s, _ in found.values()) > min(s for s, _ in found.values())
    assert found == scores(plane, "x,y", *args)
    if "density" not in args:
        assert top(found) == 6 and all(0 <= s <= 1 for s, _ in found.values())
        assert [k for k, (_, flag) in found.items() if flag] == [6]
    else:
        assert all(s <= 0 for s, _ in found.values())


def test_depth_and_adjusted_depth_agree(plane):
    assert scores(plane, "x,y") == scores(plane, "x,y", 1, "uniform", "adj_depth")


def test_density_is_the_mean_logarithm_of_leaf_sizes():
    tree = Tree(np.array([[0.0], [0.0], [0.0], [9.0]]), np.zeros((4, 0), int), np.random.default_rng(1), 4)
    s = Forest([tree], [[]], 4, "density").score(np.array([[0.0], [9.0]]), [])
    assert np.allclose(s, [-math.log(3), 0.0])


def test_one_column_is_looked_up_as_it_is_walked():
    draw = np.random.default_rng(3)
    x = np.round(draw.standard_normal((3000, 1)), 2)
    trees = [Tree(x[draw.choice(3000, 64, replace=False)], np.zeros((64, 0), int), np.random.default_rng(k), 7) for k in range(30)]
    made = Forest(trees, [[] for _ in trees], 64, "depth")
    at = np.concatenate([x, made.steps[0][:, None], [[-1e300], [1e300]]])
    assert np.array_equal(made.steps[1][np.searchsorted(made.steps[0], at[:, 0], side="right")], made._walk(at, np.zeros((len(at), 0), int)))


def test_weighted_samples_have_the_odds_of_draws_without_replacement():
    """Of four rows with weights 1, 2, 3, 4 two are drawn: shares against the exact ones."""
    w = np.array([1.0, 2.0, 3.0, 4.0])
    exact = np.zeros(4)
    for i in range(4):
        for j in range(4):
            if i != j:
                exact[[i, j]] += w[i] / w.sum() * w[j] / (w.sum() - w[i])
    made = keys(np.arange(1, 5), w, np.arange(40_000), 9)
    shares = np.bincount(np.argsort(made, axis=0)[:2].reshape(-1), minlength=4) / 40_000
    assert np.abs(shares - exact).max() < 0.01
    assert np.isinf(keys(np.array([1]), np.array([0.0]), np.arange(3), 1)).all()


def test_weights(spark):
    rows = [(1, 100.0, 1.0), (2, 101.0, 1.0), (3, 102.0, 0.0), (4, 103.0, 1.0), (5, 500.0, None), (6, 500.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, value double, weight double")
    assert set(scores(df, "value", 1, None, None, "weight")) == {1, 2, 3, 4, 6}
    with pytest.raises(ValueError, match="cannot contain negative"):
        scores(df.withColumn("weight", -F.col("weight")), "value", 1, None, None, "weight")
    assert {s for s, _ in scores(df.withColumn("weight", F.lit(0)), "value", 1, None, None, "weight").values()} == {0.0}
    # A heavy group is in nearly all samples and so looks normal; without weights it is rare.
    many = spark.createDataFrame([(k, float(k % 10) if k % 100 else 60.0 + k % 7, 1.0 if k % 100 else 500.0) for k in range(4000)], "id int, value double, weight double").repartition(3)
    light, heavy = scores(many, "value"), scores(many, "value", 1, None, None, "weight")
    mean = lambda found: np.mean([found[k][0] for k in range(0, 4000, 100)])
    assert mean(light) > mean(heavy) + 0.1


def test_a_bound_that_leaves_too_few_is_raised(spark):
    """Two rows have nearly all the weight, so that the first bound is far too low for the others."""
    rows = [(k, float(k), 1e9 if k < 2 else 1.0) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, value double, weight double").repartition(3)
    prepared, numbers, texts = forest._prepared(df, ["value"], "weight", "id", True, "isolation_forest_mv")
    trees, _, size = forest._trees(prepared, numbers, texts, 5, 64, 1, {})
    assert size == 64 and len(trees) == 5 and all(len(t.nodes) > 20 for t in trees)


def test_infinite_values_and_messages(spark):
    rows = [(k, 1.0 + k % 3) for k in range(30)] + [(30, float("inf")), (31, float("nan")), (32, None)]
    df = spark.createDataFrame(rows, "id int, value double")
    got = {r.id: r for r in isolation_forest(df, "value", 50, 256, 0.0, "scores", 1, "id").collect()}
    assert set(got) == set(range(31)) and got[30].anomaly_score == 1.0 and [k for k, r in got.items() if r.is_anomaly] == [30]
    total = isolation_forest(df, "value", 50, 256, 0.0, "summary", 1).first()
    assert (total.status, total.outlier_count, total.total_count, total.avg_value, total.message) == ("fail", 1, 31, 2.0, "1 anomalies detected")
    none = isolation_forest(df.limit(0), "value").first()
    assert (none.status, none.total_count, none.avg_value, none.message) == ("pass", 0, None, "No anomalies detected")
    several = isolation_forest_mv(df, "id,value", None, None, None, None).first()
    assert several.n_columns == 2 and several.n_trees == 100 and several.contamination == 0.1


@pytest.mark.parametrize(
    ("options", "message"),
    [({"ndim": 5}, r"ndim \(5\) must not exceed the number of columns \(2\)"), ({"ndim": 0}, "ndim must be >= 1"), ({"coef_type": "x"}, "coef_type must be"), ({"scoring_metric": "x"}, "scoring_metric must be"), ({"ntry": 0}, "ntry must be >= 1"), ({"prob_pick_avg_gain": 1.5}, "prob_pick_avg_gain must be"), ({"output_mode": "all"}, "output_mode must be")],
)
def test_arguments(plane, options, message):
    with pytest.raises(ValueError, match=message):
        isolation_forest_mv(plane, "x,y", **options)


def test_columns_of_other_kinds(plane):
    with pytest.raises(ValueError, match="must be numeric"):
        isolation_forest(plane.withColumn("t", F.lit("a")), "t")
    with pytest.raises(ValueError, match="numeric or categorical"):
        isolation_forest_mv(plane.withColumn("d", F.current_date()), "x,d")
    assert len(scores(plane.withColumn("b", F.col("x") > 2), "b,x")) == 6


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1 and abs(average_path(256) - 10.244) < 0.01
