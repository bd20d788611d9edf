"""What only larger tables showed: results that left their SQL, and work that stood in one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dataplumb.functions import pii, pii_text
from dataplumb.operators import anomaly, checks, forest


def test_small_changes_are_rounded(spark):
    """Two changes below 0.001, as SQL writes them when rounded."""
    days = spark.range(4).selectExpr("date_add(date '2024-01-01', cast(id AS int)) AS d", "cast(element_at(array(5000, 5000, 4999, 5004), cast(id + 1 AS int)) AS int) AS n")
    df = days.select("d", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    rows = checks.rel_count_change(df, "d", start_date="2024-01-02", end_date="2024-01-04").collect()
    assert [r.message.split(" of baseline")[0] for r in rows] == ["Count 5000 on 2024-01-02 is within 0.0", "Count 4999 on 2024-01-03 is within -0.0", "Count 5004 on 2024-01-04 is within 0.001"]


def test_planted_values_have_leaves_of_their_own_at_any_keys(spark, tmp_path):
    """The first key is planted too, however far the last one is."""
    from dataplumb.plans import QUERIES

    spark.range(1_000_000, numPartitions=4).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["anomaly_forest_density"](spark, str(tmp_path))
    assert found.count() == 10_000 and found.where("o_orderkey % 100 <> 0").count() == 0


def test_digits_of_an_account_are_no_card():
    """The last 14 digits of the account pass a card's check digit; looked for alone they are no card either."""
    text = "Konto DE04 9898\n2029 6397043571, 4111 1111 1111 1111"
    assert pii_text.iban_ok("DE04 9898 2029 6397043571") and [(t, text[a:b]) for t, a, b in pii.matches(text)][0][0] == "IBAN"
    for alone in (("CREDIT_CARD",), ("CREDIT_CARD", "PHONE")):
        assert [text[a:b] for _, a, b in pii.matches(text, alone)] == ["4111 1111 1111 1111"]
    # Where the account's check digits are wrong, its last digits are a card as before.
    assert [text[a:b] for _, a, b in pii.matches("Konto DE05 9898\n2029 6397043571", ("CREDIT_CARD",))] == ["2029 6397043571"]


def test_work_by_row_is_dealt_over_tasks(spark, tmp_path):
    """A table of one row group is one task's to read, but not to look through."""
    from dataplumb.plans import QUERIES

    spark.range(2_000).selectExpr("id AS c_custkey", "0.5D AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("pii_formats", "pii_functions", "pii_settings", "pii_strategies", "pii_audit_notes", "scalar_identifiers_more", "scalar_identifiers", "scalar_phone", "scalar_phone_regions"):
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 16, name
    scan = QUERIES["pii_scan_notes"](spark, str(tmp_path))
    assert "ArrowEvalPython" not in scan._jdf.queryExecution().toString()
    assert {r.pii_type: r.match_count for r in scan.collect()} == {"EMAIL": 2000, "IP_ADDRESS": 2000, "DATE_OF_BIRTH": 667, None: 0}


@pytest.mark.parametrize("block, step, n_columns, spread", [(1024, 512, 2, 0.8), (7, 5, 4, 0.5)])
def test_clusters_of_several_columns_make_no_pairs(spark, monkeypatch, block, step, n_columns, spread):
    """Against a plain version, with blocks of a few points too: dense and sparse stretches, repeated points, two columns and four."""
    monkeypatch.setattr(anomaly, "BLOCK", block)
    monkeypatch.setattr(anomaly, "STEP", step)
    at = random.Random(n_columns)
    points = [tuple(round(at.gauss(at.choice([0, 3, 9]), spread), 1) for _ in range(n_columns)) for _ in range(300)]
    points += points[:20]
    near = [[j for j, q in enumerate(points) if math.sqrt(sum((a - b) * (a - b) for a, b in zip(p, q, strict=True))) <= 0.9] for p in points]
    core = [len(n) >= 4 for n in near]
    label, clusters = [None] * len(points), 0
    for k in range(len(points)):
        if core[k] and label[k] is None:
            todo, label[k] = [k], clusters
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] is None:
                        label[j] = clusters
                        todo.append(j)
            clusters += 1
    want = {k: (label[k] if core[k] else min((label[j] for j in n if core[j]), default=-1), len(n) - 1) for k, n in enumerate(near)}
    names = [f"x{i}" for i in range(n_columns)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], ["k", *names]).coalesce(1)
    got = {r.id: (r.cluster_id, r.neighbor_count) for r in anomaly.dbscan_mv(df, names, 0.9, 4, "clusters", "k").collect()}
    assert got == want and clusters > 1 and any(not c for c in core)


def test_forest_rows_are_dealt_over_tasks(spark, monkeypatch):
    """Rows that one task reads are drawn from and scored in many."""
    parts, kept = {}, forest.stored

    def seen(df, name):
        parts[name] = df.rdd.getNumPartitions()
        return kept(df, name)

    monkeypatch.setattr(forest, "stored", seen)
    df = spark.range(400).selectExpr("id", "cast(id % 10 AS double) AS v").coalesce(1)
    assert forest.isolation_forest(df, "v", 5, 32, 0.1, "scores", 1, "id").count() == 400 and parts["forest_rows"] == 16
