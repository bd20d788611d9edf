"""Exact order statistics by counting: no task and no buffer holds a column's values.

Values are counted in fixed cells of a logarithmic scale, then those of the cell that holds a wanted rank in even cells
between its least and its largest value, then the distinct values of the cell found there. Cells only have to be in the order
of the values: rounding moves a value to a neighbouring cell and never past another one. Each step is one scan with partial
counts; running sums run over the counts of cells, at most CELLS for a column or rank, and of the distinct values of the last cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
#: Cells to a factor of e; logarithms of doubles stay below 710.
SCALE = CELLS / 2 / 712


def _wide(x: Column) -> Column:
    """The cell of a value on the logarithmic scale; infinite values have cells of their own."""
    size = F.least(F.log1p(F.abs(x)), F.lit(711.0)) * SCALE
    return F.floor(F.when(x < 0, -size).otherwise(size)).cast("int")


def order_statistics(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]], lower: bool = False) -> DataFrame:
    """One row: for each name an array with the column's value at each fraction of its non-null values' ranks.

    Between two ranks the value is interpolated, as by percentile_cont, or with lower that of the lower rank. Values are
    doubles that aren't NaN; a column without values gives an array of nulls. df is scanned three times.
    """
    names = list(wanted)
    xs = [F.col(f"x{i}") for i in range(len(names))]
    df = df.select(*(wanted[c][0].cast("double").alias(f"x{i}") for i, c in enumerate(names)))
    # Ranks: number of the column, fraction, and whether it's the upper of the two.
    ranks = [(i, float(f), up) for i, c in enumerate(names) for f in wanted[c][1] for up in ((False,) if lower else (False, True))]
    place = lambda f, n: F.lit(f) * (n - 1)

    cells = df.select(F.explode(F.array_compact(F.array(*(F.when(x.isNotNull(), F.struct(F.lit(i).alias("i"), _wide(x).alias("cell"), x.alias("x"))) for i, x in enumerate(xs))))).alias("e")).select("e.*")
    cells = cells.groupBy("i", "cell").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    every = Window.partitionBy("i")
    cells = cells.withColumn("n", F.sum("c").over(every)).withColumn("before", F.sum("c").over(every.orderBy("cell")) - F.col("c"))
    aims = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), (F.ceil(place(f, F.col("n"))) if up else F.floor(place(f, F.col("n")))).alias("rank")) for t, (i, f, up) in enumerate(ranks)))
    found = cells.select("*", F.explode(F.filter(aims, lambda a: (a["i"] == F.col("i")) & (a["rank"] >= F.col("before")) & (a["rank"] < F.col("before") + F.col("c")))).alias("a"))
    found = found.select("a.t", "a.rank", "n", "before", "lo", "hi")

    def inside(found: DataFrame, key) -> DataFrame:
        """Rows of df with a rank's bounds, for each rank whose cell they are in; key makes of it what is counted."""
        one = found.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("lo", "hi")))).alias("at"))
        bounds = F.broadcast(one.select(*(F.element_at("at", t)[side].alias(f"{side}{t}") for t in range(len(ranks)) for side in ("lo", "hi"))))
        entries = [F.when((xs[i] >= F.col(f"lo{t}")) & (xs[i] <= F.col(f"hi{t}")), F.struct(F.lit(t).alias("t"), key(xs[i], F.col(f"lo{t}"), F.col(f"hi{t}")).alias("key"), xs[i].alias("x"))) for t, (i, _, _) in enumerate(ranks)]
        return df.crossJoin(bounds).select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")

    even = lambda x, lo, hi: F.when(hi > lo, F.floor(F.least((x / 2 - lo / 2) / (hi / 2 - lo / 2), F.lit(1.0)) * (CELLS - 1))).otherwise(0).cast("int")
    order = Window.partitionBy("t")
    fine = inside(found, even).groupBy("t", "key").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    fine = fine.withColumn("upto", F.sum("c").over(order.orderBy("key")))
    fine = fine.join(F.broadcast(found.select("t", "rank", "n", F.col("before").alias("outside"))), "t").withColumn("before", F.col("outside") + F.col("upto") - F.col("c"))
    found = fine.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).select("t", "rank", "n", "before", "lo", "hi")

    values = inside(found, lambda x, lo, hi: x).groupBy("t", "x").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(order.orderBy("x")))
    values = values.join(F.broadcast(found.select("t", "rank", "n", "before")), "t").where(F.col("before") + F.col("upto") > F.col("rank"))
    values = values.groupBy("t").agg(F.min("x").alias("x"), F.first("n").alias("n"))
    at = values.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("x", "n")))).alias("at"))

    def value(t: int, f: float) -> Column:
        a = F.element_at("at", t)
        if lower:
            return a["x"]
        b, p = F.element_at("at", t + 1), place(f, a["n"])
        return F.when(a["x"] == b["x"], a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * (p - F.floor(p)))

    step, out, t = 1 if lower else 2, [], 0
    for c in names:
        parts = []
        for f in wanted[c][1]:
            parts.append(value(t, float(f)))
            t += step
        out.append(F.array(*parts).cast("array<double>").alias(c))
    return at.select(*out)


def ranked_values(df: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, rank and value: of each group of df(*by, x) the value at each rank (from 0) that ranks(*by, rank) asks for.

    As order_statistics, with the cells of each group. ranks is broadcast: one row for each question.
    """
    by = list(by)
    ranks = F.broadcast(ranks)
    asked = df.join(F.broadcast(ranks.select(*by).distinct()), by, "left_semi")
    cells = asked.select(*by, "x", _wide(F.col("x")).alias("cell")).groupBy(*by, "cell").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    cells = cells.withColumn("before", F.sum("c").over(Window.partitionBy(*by).orderBy("cell")) - F.col("c"))
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
    found = cells.join(ranks, by).where(inside).select(*by, "rank", "before", "lo", "hi")
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    even = F.when(hi > lo, F.floor(F.least((x / 2 - lo / 2) / (hi / 2 - lo / 2), F.lit(1.0)) * (CELLS - 1))).otherwise(0).cast("int")
    within = df.join(F.broadcast(found), by).where((x >= lo) & (x <= hi))
    fine = within.groupBy(*by, "rank", "before", even.alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    fine = fine.withColumn("before", F.col("before") + F.sum("c").over(Window.partitionBy(*by, "rank").orderBy("cell")) - F.col("c"))
    found = fine.where(inside).select(*by, "rank", "before", "lo", "hi")
    values = df.join(F.broadcast(found), by).where((x >= lo) & (x <= hi)).groupBy(*by, "rank", "before", "x").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*by, "rank").orderBy("x")))
    return values.where("upto > rank").groupBy(*by, "rank").agg(F.min("x").alias("value"))
