"""Order statistics against numpy on values that are hard to cut into cells."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from dataplumb._order import order_statistics

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def series():
    draw = np.random.default_rng(1)
    return {
        "even": np.arange(1001.0),
        "normal": draw.standard_normal(5000),
        "tails": draw.standard_normal(3000) ** 31,
        "tiny": draw.standard_normal(2000) * 1e-300,
        "huge": draw.choice([-1.0, 1.0], 2000) * 10.0 ** draw.uniform(-300, 308, 2000),
        "few": draw.integers(0, 3, 4000).astype(float),
        "same": np.full(50, 7.25),
        "close": 1.7e9 + draw.uniform(0, 1e-3, 3000),
        "one": np.array([3.0]),
        "zeros": np.array([-0.0, 0.0, 0.0, 1.0]),
    }


@pytest.fixture(scope="module")
def frame(spark):
    made = series()
    n = max(map(len, made.values()))
    rows = [tuple(float(v[k]) if k < len(v) else None for v in made.values()) + (None,) for k in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*made, "none"])).repartition(5)


def test_all_columns_at_once(frame):
    got = order_statistics(frame, {c: (F.col(c), FRACTIONS) for c in frame.columns}).first()
    for c, v in series().items():
        for f, x in zip(FRACTIONS, got[c], strict=True):
            want = np.quantile(v, f)
            assert x == want or abs(x - want) <= 1e-14 * np.abs(v).max(), (c, f, x, want)
    assert got["none"] == [None] * len(FRACTIONS)


def test_lower(frame):
    got = order_statistics(frame, {"normal": (F.col("normal"), FRACTIONS), "few": (F.col("few"), [0.5])}, lower=True).first()
    v = np.sort(series()["normal"])
    assert got["normal"] == [v[int(np.floor(f * (len(v) - 1)))] for f in FRACTIONS]
    assert got["few"] == [np.sort(series()["few"])[1999]]


def test_no_rows(frame):
    assert order_statistics(frame.limit(0), {"even": (F.col("even"), [0.5])}).first()["even"] == [None]
