"""Product codes against plain rounds of Lloyd's method in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from dataplumb.llm import vectorcode


def plain(rows, parts=4, entries=256, rounds=4):
    """{row number: (code, error)} and the digest of the codebooks, of rows (id, vector, label) all coded."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    whole = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    w = len(whole[0]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for v in whole]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in cut:
                members.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*members[j], strict=True)) if j in members else e for j, e in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for f in found], hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, error string").repartition(3)


def compare(spark, rows, kind="float"):
    got = vectorcode.report(frame(spark, [(*r, "mine", "mine") for r in rows], kind)).collect()
    want, digest = plain([(i, [float(np.float32(x)) if kind == "float" else x for x in v], g) for i, v, g in rows])
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in got) == sorted((i is None, i or 0, c, e) for (i, _, _), (c, e) in zip(rows, want, strict=True))
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = {}
    for (_, _, g), (_, e) in zip(rows, want, strict=True):
        sums[g] = sums.get(g, 0) + e
    by_code = {}
    for (i, _, g), (c, e) in zip(rows, want, strict=True):
        by_code.setdefault((i, c), set()).add(sums[g])
    assert all(r.label_error in by_code[r.vec_id, r.code] for r in got)


def test_rounds(spark):
    draw = random.Random(1)
    compare(spark, [(k, [draw.gauss(0, 0.3) for _ in range(16)], draw.choice([None, 1, 2])) for k in range(400)])


def test_ties_repeats_and_null_ids(spark):
    """Few distinct parts, so that entries are equal, unused and equally near."""
    draw = random.Random(2)
    compare(spark, [(draw.choice([None, k, k // 3]), [draw.randint(-2, 2) / 1024 for _ in range(8)], 7) for k in range(350)])


def test_large_numbers_are_exact(spark):
    draw = random.Random(3)
    rows = [(k, [draw.gauss(0, 1) * 10 ** draw.choice([0, 0, 0, 5]) for _ in range(4)], k % 2) for k in range(300)]
    compare(spark, rows, "double")


def test_bounds_spare_scans_and_never_change_a_code():
    draw = np.random.default_rng(4)
    centres = draw.integers(-3000, 3000, (40, 8))
    x = (centres[draw.integers(0, 40, 4000)] + draw.integers(-60, 60, (4000, 8))).astype(float)
    entries = [tuple(int(v) for v in r) for r in x[:64]]
    part = vectorcode._Part(entries, None)
    code, upper, lower, seen = part.assign(x, np.zeros(len(x), int), np.full(len(x), np.inf), np.full(len(x), -np.inf))
    scans = [seen]
    for _ in range(6):
        after = [tuple(int(v) for v in np.floor(x[code == j].mean(0))) if (code == j).any() else e for j, e in enumerate(entries)]
        part, entries = vectorcode._Part(after, entries), after
        code, upper, lower, seen = part.assign(x, code, upper, lower)
        scans.append(seen)
        assert (code == part.scan(x)[0]).all()
        d = np.sqrt(((x[:, None, :] - part.c) ** 2).sum(2))
        assert (upper >= d[np.arange(len(x)), code]).all()
        d[np.arange(len(x)), code] = np.inf
        assert (lower <= d.min(1)).all()
    assert scans[0] > 0.9 * len(x) and scans[-1] < len(x) / 3, scans


def test_odd_rows(spark):
    rows = [(k, [float(k), 1.0, 2.0, -1.0], None, "", "") for k in range(5)]
    odd = [(10, None, 1, "", ""), (11, [1.0, None, 2.0, 3.0], 1, "", ""), (12, [float("nan"), 1.0, 1.0, 1.0], 1, "", ""), (13, [1.0, float("inf"), 1.0, 1.0], 1, "", "")]
    other = [(20, [1.0, 2.0], 3, "", ""), (21, [], 3, "", "")]
    got = {r.vec_id: r for r in vectorcode.report(frame(spark, rows + odd + other)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 20, 21}
    assert got[20].code is None and got[21].error is None and got[20].label_error is None
    assert [got[k].code for k in range(5)] == [f"{k:02x}000000" for k in range(5)] and got[0].error == 0
    assert vectorcode.report(frame(spark, rows).limit(0)).collect() == []
    assert vectorcode.report(frame(spark, other[1:])).first().code is None


def test_decode(spark):
    rows = [(k, [k / 8, -k / 4, 0.5, 0.25], None, "", "") for k in range(9)]
    codes, books = vectorcode.compress(frame(spark, rows))
    for r in vectorcode.decode(codes, books).where(F.col("code").isNotNull()).collect():
        assert np.allclose(r.vector, rows[r.vec_id][1], atol=1 / 1024)


def test_a_hot_label(spark):
    """Sums of every label come back, the largest ones by broadcast."""
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("label"), F.col("id").alias("error"))
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    got = vectorcode.with_sums(rows, sums, "label")
    want = {r.label: r.label_error for r in sums.collect()}
    found = got.collect()
    assert len(found) == 5000 and all(want[r.label] == r.label_error for r in found)
