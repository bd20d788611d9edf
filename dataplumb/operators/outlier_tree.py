"""Outliers explained by the group they stand in: for each column a tree of conditions on the other columns.

The trees of all columns are grown level by level, a few aggregations for each level: counts, order statistics and what each possible split
gains, of all groups at once. Rows stay where they are; the driver sees some rows for each group. What is flagged goes to a table of the shared folder.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._base import Relation, col, column_names, finite, is_numeric, relation, with_row_ids
from .._order import ranked_values
from .._tables import drop_stored, stored

#: What makes the median and the mean of absolute deviations comparable to a standard deviation.
MAD_SCALE, MEAN_SCALE, ZERO = 1.4826, math.sqrt(math.pi / 2), 1e-10


@dataclass(frozen=True)
class Condition:
    """column <= value or one of its values; no turns it round."""

    index: int
    name: str
    value: float | str
    numeric: bool
    no: bool = False

    def holds(self) -> Column:
        c = F.col(f"x{self.index}")
        if self.numeric:
            return finite(c) & ((c > self.value) if self.no else (c <= self.value))
        return (c != self.value) if self.no else (c == self.value)

    def text(self) -> str:
        if self.numeric:
            return f"{self.name} {'>' if self.no else '<='} {self.value:g}"
        return f"{self.name} {'NOT IN' if self.no else 'IN'} ('{self.value}')"

    def json(self) -> str:
        name = json.dumps(self.name, ensure_ascii=False)
        if self.numeric:
            return f'{{"column":{name},"type":"numeric","operator":"{">" if self.no else "<="}","value":{self.value:g}}}'
        return f'{{"column":{name},"type":"categorical","operator":"{"not_in" if self.no else "in"}","values":[{json.dumps(self.value, ensure_ascii=False)}]}}'


@dataclass
class Group:
    """One of a target's groups: its rows are those whose node column of the target is `node`."""

    target: int
    node: int
    conditions: list[Condition]
    depth: int
    n: int = 0
    #: Finite values of each number; kinds, commonest value, its count and the sum of c * log2(c) of each other column.
    numbers: dict[int, int] = field(default_factory=dict)
    others: dict[int, tuple] = field(default_factory=dict)
    splits: list[Condition] = field(default_factory=list)
    stats: dict = field(default_factory=dict)


KEY = ["target", "node"]


@dataclass
class Tree:
    """All targets' trees, grown level by level: every step is one aggregation over the groups of all targets at once, with a row
    for each row and target. Jobs are bounded by the depth; the driver sees a few rows for each group."""

    rows: DataFrame
    names: list[str]
    numeric: list[bool]
    max_depth: int
    max_share: float
    least_numeric: int
    least_other: int
    z_norm: float
    z_outlier: float
    groups: int = 0
    deepest: int = 0
    nodes: int = 0
    found: list[DataFrame] = field(default_factory=list)

    def grow(self) -> None:
        spark, n = self.rows.sparkSession, len(self.names)
        level = [Group(t, 0, [], 0) for t in range(n)]
        rows = self.rows.select("*", *(F.lit(0).alias(f"g{t}") for t in range(n)))
        made = None
        while level:
            stood = F.array_compact(F.array(*(F.when(F.col(f"g{t}").isNotNull(), F.struct(F.lit(t).alias("target"), F.col(f"g{t}").alias("node"))) for t in range(n))))
            nums = F.array(*(F.col(f"x{p}") if num else F.lit(None).cast("double") for p, num in enumerate(self.numeric)))
            texts = F.array(*(F.lit(None).cast("string") if num else F.col(f"x{p}") for p, num in enumerate(self.numeric)))
            long = rows.select("row_id", "id", nums.alias("nums"), texts.alias("texts"), F.explode(stood).alias("e")).select("row_id", "id", "nums", "texts", "e.*")
            long = long.withColumn("x", F.element_at("nums", F.col("target") + 1)).withColumn("s", F.element_at("texts", F.col("target") + 1))
            level = self.counted(long, level)
            if not level:
                break
            self.groups += len(level)
            self.deepest = max(self.deepest, level[0].depth)
            known = self.ranked(long, level)
            self.measured(long, level)
            self.flag(long, level, known)
            parts, moves = [], {}
            for g in level:
                best = self.best(g)
                if best is not None:
                    no = Condition(best.index, best.name, best.value, best.numeric, True)
                    pair = [Group(g.target, self.nodes + k, [*g.conditions, c], g.depth + 1) for k, c in ((1, best), (2, no))]
                    self.nodes += 2
                    parts += pair
                    moves.setdefault(g.target, []).append((g.node, best, no, pair))
            level = parts
            if level:
                columns = {}
                for t in range(n):
                    to = F.lit(None).cast("int")
                    for node, best, no, (left, right) in moves.get(t, ()):
                        here = F.col(f"g{t}") == node
                        to = F.when(here & best.holds(), left.node).when(here & no.holds(), right.node).otherwise(to)
                    columns[f"g{t}"] = to
                rows = stored(rows.withColumns(columns), "groups")
                if made is not None:
                    drop_stored(made)
                made = rows
        if made is not None:
            drop_stored(made)

    def counted(self, long: DataFrame, level: list[Group]) -> list[Group]:
        """The groups that are large enough, with their counts."""
        numbers = [p for p, num in enumerate(self.numeric) if num]
        finite_at = lambda p: finite(F.element_at("nums", p + 1))
        plain = long.groupBy(*KEY).agg(F.count("*").alias("n"), *(F.count(F.when(finite_at(p), 1)).alias(f"m{p}") for p in numbers)).collect()
        by_key = {(g.target, g.node): g for g in level}
        for r in plain:
            g = by_key[r.target, r.node]
            g.n, g.numbers = r.n, {p: r[f"m{p}"] for p in numbers}
        others = [p for p, num in enumerate(self.numeric) if not num]
        if others:
            each = long.select(*KEY, "row_id", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.element_at("texts", p + 1).alias("v")) for p in others))).alias("e")).select(*KEY, "row_id", "e.*")
            sizes = each.groupBy(*KEY, "p", "v").agg(F.count("*").alias("c"), F.min("row_id").alias("first"))
            tops = sizes.groupBy(*KEY, "p").agg(F.count("*").alias("kinds"), F.max(F.struct("c", -F.col("first"), "v")).alias("top"))
            for r in tops.collect():
                by_key[r.target, r.node].others[r.p] = (r.kinds, r.top.v, r.top.c)
        return [g for g in level if g.n >= (self.least_numeric if self.numeric[g.target] else self.least_other) and g.n > 0]

    def ranked(self, long: DataFrame, level: list[Group]) -> dict[tuple, float]:
        """Medians of the targets, and into the groups the conditions that are tried: at the quarters of each number, and the commonest
        value of each other column."""
        places, asked = {}, set()
        for g in level:
            if self.numeric[g.target] and g.numbers[g.target]:
                asked.add((g.target, g.node, g.target, g.numbers[g.target] // 2))
            for p in range(len(self.names)):
                if p == g.target or g.depth >= self.max_depth:
                    continue
                if not self.numeric[p]:
                    kinds, value, c = g.others[p]
                    if g.n >= 2 * self.least_other and kinds >= 2 and c >= self.least_other and g.n - c >= self.least_other:
                        g.splits.append(Condition(p, self.names[p], value, False))
                    continue
                m = g.numbers[p]
                if g.n >= 2 * self.least_numeric and m >= 2 * self.least_numeric:
                    ks = [k for q in (0.25, 0.5, 0.75) if 0 < (k := int(q * m)) < m]
                    places[g.target, g.node, p] = ks
                    asked |= {(g.target, g.node, p, k + side) for k in ks for side in (-1, 0)}
        known = {}
        if asked:
            numbers = [p for p, num in enumerate(self.numeric) if num]
            each = long.select(*KEY, F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.element_at("nums", p + 1).alias("x")) for p in numbers))).alias("e")).select(*KEY, "e.*").where(finite(F.col("x")))
            table = long.sparkSession.createDataFrame(sorted(asked), "target int, node int, p int, rank long")
            known = {(r.target, r.node, r.p, r.rank): r.value for r in ranked_values(each, table, [*KEY, "p"]).collect()}
        for g in level:
            for p in range(len(self.names)):
                ks = places.get((g.target, g.node, p), [])
                values = dict.fromkeys((known[g.target, g.node, p, k - 1] + known[g.target, g.node, p, k]) / 2.0 for k in ks)
                g.splits += [Condition(p, self.names[p], v, True) for v in values]
            g.splits.sort(key=lambda c: c.index)
        return known

    def measured(self, long: DataFrame, level: list[Group]) -> None:
        """Into the groups what they and both sides of each split hold: rows, variance or the sum of c * log2(c) of the target."""
        by_key = {(g.target, g.node): g for g in level}
        v = F.when(finite(F.col("x")), F.col("x"))
        is_number = F.element_at(F.array(*map(F.lit, self.numeric)), F.col("target") + 1)
        spare = lambda c: F.sum(c * F.log2(c))
        if any(self.numeric):
            for r in long.where(is_number).groupBy(*KEY).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("var")).collect():
                if (r.target, r.node) in by_key:
                    by_key[r.target, r.node].stats |= {"mean": r["mean"], "sd": r["sd"], "var": r["var"]}
        if not all(self.numeric):
            kinds = long.where(~is_number).groupBy(*KEY, "s").agg(F.count("*").alias("c"))
            for r in kinds.groupBy(*KEY).agg(F.count("*").alias("kinds"), spare(F.col("c")).alias("spare")).collect():
                if (r.target, r.node) in by_key:
                    by_key[r.target, r.node].stats |= {"kinds": r["kinds"], "spare": r["spare"]}
        tried = [(g.target, g.node, k, c.index, c.numeric, float(c.value) if c.numeric else None, None if c.numeric else c.value) for g in level for k, c in enumerate(g.splits)]
        if not tried:
            return
        table = F.broadcast(long.sparkSession.createDataFrame(tried, "target int, node int, k int, p int, number boolean, at double, is string"))
        number, text = F.element_at("nums", F.col("p") + 1), F.element_at("texts", F.col("p") + 1)
        left = F.when(F.col("number"), F.when(finite(number), number <= F.col("at"))).otherwise(text == F.col("is"))
        sides = long.join(table, KEY).select(*KEY, "k", left.alias("left"), "x", "s").where("left is not null")
        which = [*KEY, "k", "left"]
        if any(self.numeric):
            for r in sides.where(is_number).groupBy(*which).agg(F.count("*").alias("n"), F.var_samp(v).alias("var")).collect():
                by_key[r.target, r.node].stats[r.k, r.left] = (r.n, r["var"])
        if not all(self.numeric):
            kinds = sides.where(~is_number).groupBy(*which, "s").agg(F.count("*").alias("c"))
            for r in kinds.groupBy(*which).agg(F.sum("c").alias("n"), spare(F.col("c")).alias("spare")).collect():
                by_key[r.target, r.node].stats[r.k, r.left] = (r.n, r["spare"])

    def best(self, g: Group) -> Condition | None:
        """The split that takes most of the variance or entropy away; the first of equal ones."""
        number = self.numeric[g.target]
        plain = lambda value: 0.0 if value is None or math.isnan(value) else value
        entropy = lambda total, spare: math.log2(total) - spare / total if total else 0.0
        chosen, top = None, 0.0
        for k, c in enumerate(g.splits):
            (a, va), (b, vb) = (g.stats.get((k, left), (0, None)) for left in (True, False))
            if number:
                gain = plain(g.stats.get("var")) - (a * plain(va) + b * plain(vb)) / max(1, a + b)
            else:
                gain = entropy(g.n, g.stats["spare"]) - (a * entropy(a, va or 0.0) + b * entropy(b, vb or 0.0)) / max(1, a + b)
            if min(a, b) >= (self.least_numeric if c.numeric else self.least_other) and gain > top:
                chosen, top = c, gain
        return chosen

    def flag(self, long: DataFrame, level: list[Group], known: dict[tuple, float]) -> None:
        """The level's outlying rows, of each group the `most` that come first and aren't known by a lower score yet, as a stored table."""
        frames = [f for f in (self.far_numbers(long, level, known), self.rare_values(long, level)) if f is not None]
        if not frames:
            return
        out = reduce(DataFrame.unionByName, frames)
        for before in self.found:
            lower = before.select(F.col("row_id").alias("known"), F.col("target").alias("known_target"), F.col("outlier_score").alias("known_score"))
            out = out.join(lower, (F.col("row_id") == F.col("known")) & (F.col("target") == F.col("known_target")) & (F.col("known_score") <= F.col("outlier_score")), "left_anti")
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("order", "row_id"))
        kept = stored(out.withColumn("nth", nth).where("nth <= most").drop("nth", "most", "node"), "outliers")
        if kept.isEmpty():
            drop_stored(kept)
        else:
            self.found.append(kept)

    def given(self, long: DataFrame, groups: list[tuple[Group, tuple]], more: str) -> DataFrame:
        """long's rows of these groups with what is told of them: n, most, conditions and the further columns."""
        table = [(g.target, g.node, g.n, max(1, math.ceil(g.n * self.max_share)), "[" + ",".join(c.json() for c in g.conditions) + "]", _when(g.conditions), *values) for g, values in groups]
        schema = f"target int, node int, n long, most int, conditions string, when string, {more}"
        names = F.element_at(F.array(*map(F.lit, self.names)), F.col("target") + 1)
        return long.join(F.broadcast(long.sparkSession.createDataFrame(table, schema)), KEY).withColumn("column_name", names)

    def far_numbers(self, long: DataFrame, level: list[Group], known: dict[tuple, float]) -> DataFrame | None:
        some = []
        for g in level:
            m = g.numbers.get(g.target, 0)
            if self.numeric[g.target] and m >= 3:
                g.n = m  # of a number only its finite values count from here on
                some.append((g, (known[g.target, g.node, g.target, m // 2],)))
        if not some:
            return None
        off = self.given(long.where(finite(F.col("x"))), some, "median double").select(*KEY, F.abs(F.col("x") - F.col("median")).alias("x"))
        middle = long.sparkSession.createDataFrame([(g.target, g.node, g.n // 2) for g, _ in some], "target int, node int, rank long")
        mads = {(r.target, r.node): r.value for r in ranked_values(off, middle, KEY).collect()}
        means = {(r.target, r.node): r.mean for r in off.groupBy(*KEY).agg(F.avg("x").alias("mean")).collect()}
        told = []
        for g, (median,) in some:
            key = (g.target, g.node)
            spread = next((s for s in (mads[key] * MAD_SCALE, means[key] * MEAN_SCALE, g.stats["sd"] or 0.0) if s >= ZERO), 0.0)
            number = lambda value: value if value is not None and math.isfinite(value) else None
            told.append((g, (median, spread, number(g.stats["mean"]), number(g.stats["sd"]), number(median - self.z_norm * spread), number(median + self.z_norm * spread), f"{median:.2f}", f"{spread:.2f}")))
        rows = self.given(long, told, "median double, spread double, mean double, sd double, low double, high double, median_text string, spread_text string")
        x, z, inf = F.col("x"), F.col("z"), float("inf")
        side = F.when(x == F.col("median"), 0.0).when(x > F.col("median"), inf).otherwise(-inf)
        far = rows.where(~F.isnan(x)).withColumn("z", F.when(F.col("spread") > 0, (x - F.col("median")) / F.col("spread")).otherwise(side)).where(F.abs("z") >= self.z_outlier)
        often = far.groupBy(*KEY, "x").agg(F.count("*").alias("c"), F.first("most").alias("few")).where("c > few").select(*KEY, "x")
        far = far.join(often, [*KEY, "x"], "left_anti")
        shown = lambda c: F.coalesce(F.when(finite(c), F.format_string("%.2f", c)), F.lit("n/a"))
        told = F.concat(F.lit("Value "), _shown(x), F.lit(" for column '"), F.col("column_name"), F.lit("' is unusually "), F.when(x > F.col("median"), "high").otherwise("low"), F.lit(" (median: "), "median_text", F.lit(", MAD: "), "spread_text", F.lit(", z-score: "), shown(z), F.lit(")"), F.col("when"))
        score = F.when(z != 0, 1.0 / (z * z)).otherwise(1.0)
        return far.select("row_id", "id", *KEY, "most", (-F.abs(z)).alias("order"), "column_name", _shown(x).alias("outlier_value"), x.alias("outlier_value_num"), F.col("mean").alias("cluster_mean"), F.col("sd").alias("cluster_sd"), F.col("median").alias("cluster_median"), F.col("spread").alias("cluster_mad"), F.col("n").alias("cluster_size"), F.when(finite(z), z).alias("z_score"), F.col("low").alias("lower_bound"), F.col("high").alias("upper_bound"), "conditions", told.alias("explanation"), score.alias("outlier_score"))

    def rare_values(self, long: DataFrame, level: list[Group]) -> DataFrame | None:
        some = [(g, ()) for g in level if not self.numeric[g.target] and g.n >= 3 and g.stats["kinds"] >= 2]
        if not some:
            return None
        rows = self.given(long, [(g, (None,)) for g, _ in some], "nothing string").drop("nothing")
        share = F.col("c") / F.col("n").cast("double")
        kinds = rows.groupBy(*KEY, "s").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(share < 1.0 / self.z_outlier**2).select(*KEY, "s", share.alias("share"))
        odd = rows.join(kinds, [*KEY, "s"])
        none = F.lit(None).cast("double")
        told = F.concat(F.lit("Value "), "s", F.lit(" for column '"), F.col("column_name"), F.lit("' is unusually rare (cluster size: "), F.col("n").cast("string"), F.lit(")"), F.col("when"))
        blank = [none.alias(c) for c in ("outlier_value_num", "cluster_mean", "cluster_sd", "cluster_median", "cluster_mad")]
        return odd.select("row_id", "id", *KEY, "most", F.col("share").alias("order"), "column_name", F.col("s").alias("outlier_value"), *blank, F.col("n").alias("cluster_size"), (1.0 / F.sqrt("share")).alias("z_score"), none.alias("lower_bound"), none.alias("upper_bound"), "conditions", told.alias("explanation"), F.col("share").alias("outlier_score"))


def _shown(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0\z", "")


def _when(conditions: list[Condition]) -> str:
    return " when " + " AND ".join(c.text() for c in conditions) if conditions else ""


def outlier_tree(table: Relation, columns: str | list[str], output_mode: str | None = "summary", max_depth: int | None = 4, max_perc_outliers: float | None = 0.01, min_size_numeric: int | None = 25, min_size_categ: int | None = 75, z_norm: float | None = 2.67, z_outlier: float | None = 8.0, id_column: str | None = None) -> DataFrame:
    """Summary: one row. 'outliers': one row for each outlying value, with its group's statistics and conditions.

    Rows with a null in a column are left out but keep their number. A null argument is its default.
    """
    given = [max_depth, max_perc_outliers, min_size_numeric, min_size_categ, z_norm, z_outlier]
    depth, share, least, least_other, norm, far = (d if v is None else v for v, d in zip(given, (4, 0.01, 25, 75, 2.67, 8.0), strict=True))
    mode = (output_mode or "summary").strip().lower()
    if mode not in ("summary", "outliers"):
        raise ValueError("output_mode must be 'summary' or 'outliers'")
    if not 1 <= depth <= 1024 or not 0 < share <= 1 or least < 1 or least_other < 1 or not norm > 0 or not far > 0:
        raise ValueError("max_depth in 1..1024, max_perc_outliers above 0 and at most 1, sizes at least 1, z thresholds above 0")
    if id_column and mode == "summary":
        raise ValueError("id_column is for output_mode 'outliers'")
    df = relation(table)
    names = column_names(df, columns)
    numeric = [is_numeric(df.schema[c].dataType) or df.schema[c].dataType.typeName() == "boolean" for c in names]
    values = [(col(df, c).cast("double") if num else col(df, c).cast("string")).alias(f"x{k}") for k, (c, num) in enumerate(zip(names, numeric, strict=True))]
    rows = with_row_ids(df.select((col(df, id_column) if id_column else F.lit(None)).alias("id"), *values)) if id_column else with_row_ids(df.select(*values)).withColumn("id", F.lit(None).cast("string"))
    rows = stored(rows.dropna(subset=[f"x{k}" for k in range(len(names))]), "rows")
    tree = Tree(rows, names, numeric, depth, share, least, least_other, norm, far)
    tree.grow()
    found = tree.found[0] if tree.found else None
    for more in tree.found[1:]:
        found = found.union(more)
    if found is not None:
        # Of a row and column the finding with the lower score.
        lowest = found.groupBy("row_id", "target").agg(F.min_by(F.struct(*found.columns), "outlier_score").alias("best"))
        found = lowest.select("best.*")
    if mode == "summary":
        n = found.count() if found is not None else 0
        total, message = rows.count(), f"{n} outlier(s) detected" if n else "No outliers detected"
        schema = "status string, total_rows long, outlier_count long, columns_analyzed int, clusters_evaluated long, max_depth_reached int, message string"
        return df.sparkSession.createDataFrame([("fail" if n else "pass", total, n, len(names), tree.groups, tree.deepest, message)], schema)
    if found is None:
        empty = rows.limit(0).select("row_id", "id", F.lit(0).alias("target"), F.lit("").alias("column_name"), F.lit("").alias("outlier_value"), *(F.lit(0.0).alias(k) for k in ("outlier_value_num", "cluster_mean", "cluster_sd", "cluster_median", "cluster_mad")), F.lit(0).cast("long").alias("cluster_size"), *(F.lit(0.0).alias(k) for k in ("z_score", "lower_bound", "upper_bound")), F.lit("").alias("conditions"), F.lit("").alias("explanation"), F.lit(0.0).alias("outlier_score"))
        found = empty
    return found.orderBy("target", "outlier_score", "row_id").drop("target", "order", *([] if id_column else ["id"]))
