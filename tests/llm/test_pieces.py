"""Training texts are cut from all over a long text."""

from pyspark.sql import functions as F

from dataplumb.llm._common import pieces


def test_pieces(spark):
    texts = [None, "", "x" * 100, "".join(chr(65 + k // 100) for k in range(2600))]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(pieces(F.col("t"), 100)).collect()]
    assert got[:3] == texts[:3]
    parts = got[3].split(" ")
    assert [len(p) for p in parts] == [10] * 10 and parts[0] == "A" * 10 and parts[-1] == "Z" * 10 and len({p[0] for p in parts}) == 10
