"""Tables between the steps of an operator: what they leave on disk, and components of little and much."""

import os
import random
import time

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from dataplumb import _tables  # noqa: E402
from dataplumb.llm import jaccard  # noqa: E402


def shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def settled(spark, before):
    """What is new since, once what is being deleted is gone."""
    for _ in range(20):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_stored_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(20_000).select((F.col("id") % 3000).alias("k")).repartition(3, "k").groupBy("k").count()
    out = _tables.stored(rows.join(rows.withColumnRenamed("count", "n"), "k"), "test")
    assert not settled(spark, before)
    assert out.count() == 3000
    assert spark.conf.get(_tables.CLEANUP, None) is None
    _tables.drop_stored(out)


def test_steps_of_the_join_leave_no_shuffle_files(spark, monkeypatch):
    """Of all queries that classes() runs until its last one, none keeps its shuffle files until garbage is collected."""
    monkeypatch.setattr(jaccard, "release", lambda spark: None)
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abcdefghijkl") * 2 for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame([(k, texts[k % 60] + (" x" if k >= 60 else "")) for k in range(120)], "doc_id long, text string")
    before = shuffle_files(spark)
    out = jaccard.classes(docs)
    assert not settled(spark, before)
    assert {r.doc_id: r.component_id for r in out.collect()} == {k: k % 60 for k in range(120)}


@pytest.mark.parametrize("kind", ["long", "int"])
@pytest.mark.parametrize("few", [0, 1000])
def test_components_on_the_driver_and_in_spark(spark, few, kind):
    draw = random.Random(2)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(50)] + [(None, 3), (5, None), (7, 7)]
    found = _tables.components(spark.createDataFrame(edges, f"a {kind}, b {kind}"), few)
    least = {x: x for e in edges[:50] for x in e}
    for _ in least:
        for a, b in edges[:50]:
            least[a] = least[b] = min(least[a], least[b])
    linked = {x for a, b in edges[:50] for x in (a, b) if a != b}
    assert {r.node: r.component for r in found.collect()} == {x: least[x] for x in linked}
    assert dict(found.dtypes)["component"] == {"long": "bigint", "int": "int"}[kind]
    _tables.drop_stored(found)
    assert _tables.components(spark.createDataFrame([], f"a {kind}, b {kind}"), few).count() == 0
