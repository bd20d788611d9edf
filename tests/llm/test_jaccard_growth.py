"""What the Jaccard join shuffles, and what it takes for a family."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from dataplumb.llm import jaccard  # noqa: E402


def written(spark):
    """Rows written to shuffle files so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def near_copies(n):
    draw = random.Random(4)
    base = [f"w{k}" for k in range(160)]
    texts = []
    for k in range(n):
        words = list(base)
        for _ in range(draw.randint(1, 2)):
            words[draw.randrange(160)] = f"x{k}"
        texts.append(" ".join(words))
    return texts


def test_shuffled_rows_of_near_copies_grow_with_their_number(spark):
    """Not with its square: four times as many near copies of one text."""
    figures = []
    for n in (500, 2000):
        docs = spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string").repartition(4)
        before = written(spark)
        assert {r.component_id for r in jaccard.classes(docs).collect()} == {0}
        figures.append(written(spark) - before)
    assert figures[1] < 4.4 * figures[0], figures


def test_texts_are_no_family_by_one_common_beginning(spark):
    """What more than LIST texts have in common links none of them that have nothing else in common."""
    draw = random.Random(6)
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    common = words(14)
    texts = [f"{common} {words(60)}" for _ in range(300)]
    texts += [x + " end" for x in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = jaccard.stored(jaccard.described(docs, 4), "sets")
    families = jaccard.components(jaccard.candidate_pairs(docs, sets, 4, 85)).groupBy("component").count()
    assert max(r["count"] for r in families.collect()) == 2
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == {k: k if k < 300 else k - 300 for k in range(320)}
