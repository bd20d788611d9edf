"""Anomalies: density clusters; forests stand in forest.py."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._base import Relation, col, column_names, finite, relation, with_row_ids
from .._tables import components, spread, stored
from .forest import isolation_forest, isolation_forest_mv

__all__ = ["dbscan", "dbscan_mv", "isolation_forest", "isolation_forest_mv", "numbered"]

#: Columns along which points are cut into cells: 3 ** GRID neighbours of each.
GRID = 3
#: Points of a block of a cell, about; so many others meet them at once.
BLOCK, STEP = 1024, 512
#: Ranges of values that one column's values are counted in.
PARTS = 64


def numbered(df: DataFrame, columns: list[str], id_column: str | None) -> DataFrame:
    """row_id from 1 in the order of the scan, with the columns as doubles x0, x1, ... and the id passed through."""
    ids = [col(df, id_column).alias("id")] if id_column else []
    return with_row_ids(df.select(*ids, *(col(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))))


def _in_parts(values: DataFrame, x: str) -> Column:
    """The range of values that x falls into, of PARTS about as full ones, as a column of values with the bounds joined to it."""
    return F.size(F.filter("bounds", lambda b: b <= F.col(x)))


def _bounds(values: DataFrame, x: str) -> DataFrame:
    return F.broadcast(values.agg(F.coalesce(F.percentile_approx(x, [k / PARTS for k in range(1, PARTS)]), F.array().cast("array<double>")).alias("bounds")))


def _over_parts(rows: DataFrame, first: Column, last: Column, **sums: Column) -> DataFrame:
    """For each part of rows: what its neighbours end with (before_last: the last there is in a part before; after_first) and the
    sums over all parts before. There are PARTS rows."""
    parts = rows.groupBy("part").agg(first.alias("first_"), last.alias("last_"), *(c.alias(f"sum_{n}") for n, c in sums.items()))
    up, down = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("part", F.last("last_", ignorenulls=True).over(up).alias("before_last"), F.last("first_", ignorenulls=True).over(down).alias("after_first"), *(F.coalesce(F.sum(f"sum_{n}").over(up), F.lit(0)).alias(f"before_{n}") for n in sums)))


def _neighbours(values: DataFrame, eps: float, bounds: DataFrame) -> DataFrame:
    """(value, neighbours) of values(value, c): how many rows are at most eps away, itself left out.

    Each value asks at value - eps and value + eps for the rows up to there, by a running count over all values and questions in order,
    within ranges of values. Where a place is rounded, the nearest value on either side is judged by its difference instead.
    """
    none = F.lit(None).cast("double")
    kind = lambda at, order, v, c: F.struct(at.alias("at"), F.lit(order).alias("order"), v.alias("w"), c.alias("c"), F.col("value").alias("value"))
    v, nothing = F.col("value"), F.lit(0).cast("long")
    events = values.select(F.explode(F.array(kind(v - eps, 0, none, nothing), kind(v, 1, v, F.col("c")), kind(v + eps, 2, none, nothing))).alias("e")).select("e.*").crossJoin(bounds)
    events = events.withColumn("part", _in_parts(events, "at")).drop("bounds")
    here = F.when(F.col("order") == 1, F.struct("w", "c"))
    parts = _over_parts(events, F.min(here), F.max(here), count=F.sum("c"))
    up, down = Window.partitionBy("part").orderBy("at", "order"), Window.partitionBy("part").orderBy(F.desc("at"), F.desc("order"))
    events = events.select("*", F.sum("c").over(up).alias("upto"), F.last(here, ignorenulls=True).over(up).alias("lower"), F.last(here, ignorenulls=True).over(down).alias("upper"))
    asked = events.where("order <> 1").join(parts, "part").select("value", "order", (F.col("upto") + F.col("before_count")).alias("upto"), F.coalesce("lower", "before_last").alias("lower"), F.coalesce("upper", "after_first").alias("upper"))
    # Of the rows up to the place those count that are not in reach (order 0), or that are (order 2).
    left, right = F.when(v - F.col("lower.w") <= eps, -F.col("lower.c")).otherwise(0), F.when(v - F.col("upper.w") > eps, F.col("upper.c")).otherwise(0)
    near, far = F.when(F.col("lower.w") - v > eps, -F.col("lower.c")).otherwise(0), F.when(F.col("upper.w") - v <= eps, F.col("upper.c")).otherwise(0)
    fixed = F.col("upto") + F.when(F.col("order") == 0, F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))).otherwise(F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)))
    return asked.groupBy("value").agg((F.max(F.when(F.col("order") == 2, fixed)) - F.max(F.when(F.col("order") == 0, fixed)) - 1).alias("neighbours"))


def dbscan(table: Relation, column: str, eps: float = 0.5, min_pts: int = 5, output_mode: str = "summary", id_column: str | None = None) -> DataFrame:
    """Density clusters of one column, exactly.

    Neighbours are counted by running sums over distinct values in ranges of values, so that neither a dense stretch nor a frequent value
    makes pairs, and no task holds all values. Cores without a gap above eps are one cluster, stitched where ranges meet; clusters are
    numbered by their first core row; a border point belongs to the cluster of the smaller number of the cores next to it.
    """
    if not eps > 0 or min_pts < 1:
        raise ValueError("eps must be positive and min_pts at least 1")
    if output_mode not in ("summary", "clusters"):
        raise ValueError("output_mode must be 'summary' or 'clusters'")
    rows = numbered(relation(table), [column], id_column).where("x0 is not null").withColumnRenamed("x0", "value")
    good = finite(F.col("value"))
    values = stored(rows.where(good).groupBy("value").agg(F.count("*").alias("c"), F.min("row_id").alias("first_row")), "values")
    bounds = _bounds(values, "value")
    counted = values.join(_neighbours(values, eps, bounds), "value").withColumn("core", F.col("neighbours") + 1 >= min_pts).crossJoin(bounds)
    counted = stored(counted.withColumn("part", _in_parts(counted, "value")).drop("bounds"), "counted")
    # Runs of core values: a core begins one if the core before it, in its range or one before, is farther than eps away.
    v, up = F.col("value"), Window.partitionBy("part").orderBy("value")
    cores = counted.where("core")
    cores = cores.join(_over_parts(cores, F.min("value"), F.max("value")), "part")
    cores = cores.withColumn("new", F.coalesce((v - F.coalesce(F.lag("value").over(up), "before_last") > eps).cast("int"), F.lit(1))).select("part", "value", "first_row", "new")
    cores = cores.withColumn("run", F.sum("new").over(up)).join(_over_parts(cores, F.min("value"), F.max("value"), run=F.sum("new")), "part")
    cores = cores.select("part", "value", "first_row", (F.col("run") + F.col("before_run")).alias("run"))
    runs = cores.groupBy("run").agg(F.min("first_row").alias("k"))
    runs = runs.withColumn("cluster", F.row_number().over(Window.orderBy("k")) - 1)
    cores = stored(cores.join(runs.select("run", "cluster"), "run").select("part", "value", "cluster"), "cores")
    # The core next to a value on each side.
    there = F.when(F.col("cluster").isNotNull(), F.struct("value", "cluster"))
    known = counted.select("part", "value", "neighbours", "core").join(cores.select("value", "cluster"), "value", "left")
    down = Window.partitionBy("part").orderBy(F.desc("value"))
    known = known.select("*", F.last(there, ignorenulls=True).over(up).alias("lower"), F.last(there, ignorenulls=True).over(down).alias("upper")).join(_over_parts(known, F.min(there), F.max(there)), "part")
    lower, upper = F.coalesce("lower", "before_last"), F.coalesce("upper", "after_first")
    border = F.least(F.when(v - lower["value"] <= eps, lower["cluster"]), F.when(upper["value"] - v <= eps, upper["cluster"]))
    known = known.select("value", "neighbours", "core", "cluster", F.when(~F.col("core"), border).alias("border"))
    out = rows.join(known, "value", "left")
    return _clustered(out, good, ["value"], eps, min_pts, output_mode, id_column)


class Counts:
    """Of each point of a block the sum of v over what is near."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.total = ids, np.zeros(len(ids))

    def meet(self, near: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.total += near.astype(np.float64) @ v.astype(np.float64)

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ids, self.total.astype(np.int64)


class Least:
    """Of each point of a block the least v of what is near, where something is."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.best = ids, np.full(len(ids), np.iinfo(np.int64).max)

    def meet(self, near: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.best = np.minimum(self.best, np.where(near, v, np.iinfo(np.int64).max).min(1))

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        some = self.best < np.iinfo(np.int64).max
        return self.ids[some], self.best[some]


class Links:
    """Links that span what a block's points and those near them hang together by: one for each point near, one for each two parts joined."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.part, self.out = ids, np.arange(len(ids)), []

    def meet(self, near: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        at = np.flatnonzero(near.any(0))
        self.out.append((self.ids[near[:, at].argmax(0)], ids[at]))
        # By part of the block: a point near two parts joins them.
        order = np.argsort(self.part, kind="stable")
        parts, begin = np.unique(self.part[order], return_index=True)
        if len(parts) == 1 or not len(at):
            return
        joins = np.logical_or.reduceat(near[order][:, at], begin, axis=0)
        root = np.arange(len(parts))
        for column in np.unique(joins[:, joins.sum(0) > 1], axis=1).T:
            roots = np.unique(root[column])
            if len(roots) > 1:
                self.out.append((np.full(len(roots) - 1, self.ids[parts[roots[0]]]), self.ids[parts[roots[1:]]]))
                root[np.isin(root, roots)] = roots[0]
        self.part = parts[root[np.searchsorted(parts, self.part)]]

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        nothing = np.zeros(0, np.int64)
        a, b = (np.concatenate([nothing, *(o[k] for o in self.out)]) for k in range(2))
        return a[a != b], b[a != b]


def _met(left: DataFrame, right: DataFrame, xs: list[str], eps: float, make: type) -> DataFrame:
    """(a, b): what make tells of blocks of left(p, xs) and the points of right(p, v, xs) at most eps away.

    Rows come by block, its own points first; of the others so many are held at a time as STEP says.
    """
    grid = xs[:GRID]
    cells = [f"g{i}" for i in range(len(grid))]
    places = [F.floor(F.col(x) / eps).alias(g) for x, g in zip(grid, cells, strict=True)]
    left, right = left.select("p", F.lit(0).cast("long").alias("v"), *xs, *places), right.select("p", "v", *xs, *places)
    blocks = left.groupBy(*cells).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = left.join(blocks, cells).withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int"))
    for g in cells:
        right = right.withColumn(g, F.explode(F.array(*(F.col(g) + k for k in (-1, 0, 1)))))
    right = right.join(blocks, cells).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [*cells, "block", "kind", "p", "v", *xs]
    met = left.withColumn("kind", F.lit(0)).select(*columns).union(right.withColumn("kind", F.lit(1)).select(*columns))
    met = spread(met, *cells, "block").sortWithinPartitions(*cells, "block", "kind")
    n_keys = len(cells) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, state = None, [], None

        def told(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            found = []
            whole = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_keys + 3)], 1)
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys + 3, batch.num_columns)], 1)
            # Runs of one block and one kind.
            starts = np.flatnonzero(np.append(True, (whole[1:, : n_keys + 1] != whole[:-1, : n_keys + 1]).any(1))) if len(whole) else []
            for a, b in zip(starts, np.append(starts[1:], len(whole)).astype(int), strict=True):
                now = tuple(whole[a, :n_keys].tolist())
                if now != key:
                    found += [state.end()] if state else []
                    key, own, state = now, [], None
                if whole[a, n_keys] == 0:
                    own.append((whole[a:b, n_keys + 1], x[a:b]))
                    continue
                if state is None:
                    ids, ours = (np.concatenate([o[k] for o in own]) for k in range(2))
                    state = make(ids)
                for c in range(a, b, STEP):
                    d = min(c + STEP, b)
                    squares = [(ours[:, None, k] - x[None, c:d, k]) for k in range(len(xs))]
                    state.meet(np.sqrt(reduce(np.add, (q * q for q in squares))) <= eps, whole[c:d, n_keys + 1], whole[c:d, n_keys + 2])
            yield told(found)
        yield told([state.end()] if state else [])

    return met.mapInArrow(run, "a long, b long")


def dbscan_mv(table: Relation, columns: str | list[str], eps: float = 0.5, min_pts: int = 5, output_mode: str = "summary", id_column: str | None = None) -> DataFrame:
    """Density clusters of several columns by Euclidean distance, exactly.

    Points are cut into cells of width eps along the first GRID columns, so that neighbours are in adjacent cells, and equal
    points are one with a count. A cell's points are cut into blocks; each block meets the points of the cells around it in one
    task, a few at a time, and tells counts, spanning links and least clusters instead of pairs. Distances of all points in
    adjacent cells are still computed. Clusters are connected components of the cores; numbers and border points follow
    dbscan. A row with a null is left out, one with a number that isn't finite has no neighbours.
    """
    if not eps > 0 or min_pts < 1:
        raise ValueError("eps must be positive and min_pts at least 1")
    if output_mode not in ("summary", "clusters"):
        raise ValueError("output_mode must be 'summary' or 'clusters'")
    df = relation(table)
    names = column_names(df, columns)
    xs = [f"x{i}" for i in range(len(names))]
    rows = numbered(df, names, id_column).where(reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in xs)))
    good = reduce(lambda a, b: a & b, (finite(F.col(x)) for x in xs))
    # A point's number is its first row.
    points = stored(rows.where(good).groupBy(*xs).agg(F.count("*").alias("c"), F.min("row_id").alias("p")), "points")
    counts = _met(points.select("p", *xs), points.select(F.col("c").alias("v"), "p", *xs), xs, eps, Counts)
    counted = points.join(counts.select(F.col("a").alias("p"), (F.col("b") - 1).alias("neighbours")), "p").withColumn("core", F.col("neighbours") + 1 >= min_pts)
    counted = stored(counted.drop("c"), "counted")
    cores = counted.where("core").select("p", *xs)
    parts = components(_met(cores, cores.withColumn("v", F.lit(0).cast("long")), xs, eps, Links))
    of = cores.select("p").join(parts, F.col("p") == F.col("node"), "left").select("p", F.coalesce("component", "p").alias("k"))
    numbers = of.select("k").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("k")) - 1)
    of = stored(of.join(numbers, "k").select("p", "cluster"), "clusters")
    border = _met(counted.where("not core").select("p", *xs), cores.join(of, "p").withColumn("v", F.col("cluster").cast("long")), xs, eps, Least)
    border = border.select(F.col("a").alias("p"), F.col("b").cast("int").alias("border"))
    known = counted.join(of, "p", "left").join(border, "p", "left").drop("p")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{x}") == F.col(f"k.{x}") for x in xs))
    out = rows.alias("r").join(known.alias("k"), same, "left").select("r.*", "neighbours", "core", "cluster", "border")
    return _clustered(out, good, [], eps, min_pts, output_mode, id_column, len(names))


def _clustered(out: DataFrame, good: Column, values: list[str], eps: float, min_pts: int, output_mode: str, id_column: str | None, n_columns: int | None = None) -> DataFrame:
    """The rows of out(row_id, neighbours, core, cluster, border) as points of clusters, or their summary."""
    alone = F.lit(min_pts == 1) & ~good
    kind = F.when(F.col("core"), "CORE").when(F.col("border").isNotNull(), "BORDER").when(alone, "CORE").otherwise("NOISE")
    cluster = F.coalesce("cluster", "border", F.lit(-1)).cast("int")
    out = out.select("row_id", *(["id"] if id_column else []), *values, cluster.alias("cluster_id"), kind.alias("point_type"), F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbor_count"))
    if output_mode == "clusters":
        most = out.agg(F.max("neighbor_count").alias("most"))
        out = out.crossJoin(F.broadcast(most))
        density = F.coalesce(F.try_divide(F.col("neighbor_count").cast("double"), F.col("most")), F.lit(0.0))
        score = F.when(F.col("point_type") == "NOISE", 1.0).when(F.col("point_type") == "CORE", 0.1 + 0.2 * (1 - density)).otherwise(0.3 + 0.3 * (1 - density))
        return out.withColumn("anomaly_score", score).withColumn("is_anomaly", F.col("point_type") == "NOISE").drop("most")
    sizes = out.groupBy("cluster_id").agg(F.count("*").alias("c"))
    total = sizes.agg(F.count(F.when(F.col("cluster_id") >= 0, 1)).alias("cluster_count"), F.coalesce(F.sum(F.when(F.col("cluster_id") < 0, F.col("c"))), F.lit(0)).alias("noise_count"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_count"), F.coalesce(F.max(F.when(F.col("cluster_id") >= 0, F.col("c"))), F.lit(0)).alias("largest_cluster_size"))
    rate = F.coalesce(F.try_divide(F.col("noise_count").cast("double"), F.col("total_count")), F.lit(0.0))
    message = F.when(F.col("total_count") == 0, "No rows to evaluate (column is empty or all NULL)").otherwise(F.concat(F.col("cluster_count").cast("string"), F.lit(" cluster(s) and "), F.col("noise_count").cast("string"), F.lit(" noise point(s)")))
    more = [F.lit(n_columns).cast("int").alias("n_columns")] if n_columns else []
    return total.select(F.when(F.col("noise_count") > 0, "fail").otherwise("pass").alias("status"), "cluster_count", "noise_count", "total_count", rate.alias("noise_rate"), "largest_cluster_size", F.lit(float(eps)).alias("eps"), F.lit(int(min_pts)).cast("long").alias("min_pts"), *more, message.alias("message"))
