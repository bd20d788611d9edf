"""Isolation forests over numbers and categories, with hyperplanes, guided splits, row weights and leaf-size scores.

Steps: the rows' columns are stored with their numbers; each tree gets an exact sample of its own, drawn without replacement with
odds by weight: a row's key for a tree is an exponential number with the row's weight as its rate, and the least keys win. Keys are
made from (seed, tree, row number), so that a bound on them, a little above where the last winner is expected, leaves
only some rows for each tree to be shuffled; where too few are left the bound is raised. Each tree is grown in the task
that gets its sample, and the trees, whose size the arguments bound, are broadcast. Every row is scored once; scores are stored, and
the cut among them comes from counts.
"""

from __future__ import annotations

import math
import pickle
import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._base import Relation, col, column_name, column_names, finite, relation, with_row_ids
from .._order import order_statistics
from .._tables import drop_stored, spread, stored, tidy

#: Candidates above the expected number, in standard deviations of it.
MARGIN = 6
#: Rows times trees that keys are made for at once.
BLOCK = 1 << 20
COEFFICIENTS, METRICS = ("uniform", "normal"), ("depth", "density", "adj_depth")


def average_path(n: float) -> float:
    """Of an unsuccessful search in a tree of n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def keys(rows: np.ndarray, weights: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """An exponential number for each row and tree, with the row's weight as its rate; infinite for weight 0."""
    z = rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (trees.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed & (1 << 64) - 1)
    # Two rounds of the usual finalizer of 64-bit hashes.
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(27))
    u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    with np.errstate(divide="ignore"):
        return -np.log(u) / weights[:, None]


class Tree:
    """Nodes as arrays. feature: -1 at a leaf; split: of a number; path and log_size: of a leaf.

    Categories that go left stand in left_of as (node, category) pairs; a hyperplane has its features and coefficients by node.
    """

    def __init__(self, numbers: np.ndarray, categories: np.ndarray, rng: np.random.Generator, limit: int, ndim: int = 1, normal: bool = False, ntry: int = 1, by_gain: float = 0.0):
        self.numbers, self.categories, self.rng = numbers, categories, rng
        n_numbers = numbers.shape[1]
        width = min(ndim, n_numbers)
        plane = width > 1
        nodes: list[list[float]] = []
        planes: list[tuple[np.ndarray, np.ndarray]] = []
        left_of: list[tuple[int, int]] = []
        todo = [(np.arange(len(numbers)), 0, -1, 0)]
        while todo:
            part, depth, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            found = []
            if len(part) > 1 and depth < limit:
                for _ in range(ntry):
                    k = int(rng.integers(n_numbers + categories.shape[1])) if not plane else 0
                    one = self._plane(part, width, normal) if plane else self._number(part, k) if k < n_numbers else self._category(part, k)
                    if one is not None:
                        found.append(one)
            if not found:
                nodes.append([-1, 0, -1, -1, depth + average_path(len(part)), math.log(max(len(part), 1))])
                planes.append((np.zeros(width, int), np.zeros(width)))
                continue
            best = int(rng.integers(len(found))) if len(found) > 1 else 0
            if len(found) > 1 and by_gain > 0 and rng.random() < by_gain:
                best = max(range(len(found)), key=lambda j: (found[j][0], -j))
            _, left, feature, split, features, coefficients, chosen = found[best]
            nodes.append([feature, split, -1, -1, 0, 0])
            planes.append((features, coefficients))
            left_of += [(at, c) for c in chosen]
            todo += [(part[left], depth + 1, at, 0), (part[~left], depth + 1, at, 1)]
        self.nodes = np.array(nodes)
        self.n_numbers, self.plane = n_numbers, plane
        self.features = np.array([f for f, _ in planes]).reshape(len(nodes), -1) if plane else None
        self.coefficients = np.array([c for _, c in planes]).reshape(len(nodes), -1) if plane else None
        self.left_of = np.array(left_of, np.int64).reshape(-1, 2)
        del self.numbers, self.categories, self.rng

    def _split(self, values: np.ndarray, feature: int, features=None, coefficients=None) -> tuple | None:
        low, high = values.min(), values.max()
        if not low < high:
            return None
        split = self.rng.uniform(low, high)
        left = values < split
        n = int(left.sum())
        if n in (0, len(values)):
            return None
        # By how much the split takes the spread down.
        whole = values.var()
        gain = 1 - (n * values[left].var() + (len(values) - n) * values[~left].var()) / (len(values) * whole) if whole > 0 else 0.0
        none = np.zeros(0)
        return gain, left, feature, split, none if features is None else features, none if coefficients is None else coefficients, ()

    def _number(self, part: np.ndarray, k: int) -> tuple | None:
        return self._split(self.numbers[part, k], k)

    def _plane(self, part: np.ndarray, width: int, normal: bool) -> tuple | None:
        features = self.rng.permutation(self.numbers.shape[1])[:width]
        values = self.numbers[part][:, features]
        spread = values.max(0) > values.min(0)
        if not spread.any():
            return None
        coefficients = self.rng.standard_normal(width) if normal else np.where(spread, self.rng.uniform(-1, 1, width), 1.0)
        return self._split(project(values, coefficients), 0, features, coefficients)

    def _category(self, part: np.ndarray, k: int) -> tuple | None:
        values = self.categories[part, k - self.numbers.shape[1]]
        present = np.unique(values)
        if len(present) <= 1:
            return None
        chosen = self.rng.permutation(present)[: int(self.rng.integers(1, len(present)))]
        left = np.isin(values, chosen)
        share = left.mean()
        # The less even, the better: rare categories are to be isolated.
        return 1 - 2 * min(share, 1 - share), left, k, 0.0, np.zeros(0), np.zeros(0), chosen.tolist()

    def leaves(self, numbers: np.ndarray, categories: np.ndarray) -> np.ndarray:
        """The leaf of each row. categories: as numbers of this tree, -1 where it doesn't know one."""
        at = np.zeros(len(numbers), int)
        live = np.flatnonzero(self.nodes[at, 0] >= 0)
        known = int(self.left_of[:, 1].max()) + 1 if len(self.left_of) else 1
        pairs = np.sort(self.left_of[:, 0] * known + self.left_of[:, 1])
        while len(live):
            here = at[live]
            node = self.nodes[here]
            feature = node[:, 0].astype(int)
            if self.plane:
                values = np.take_along_axis(numbers[live], self.features[here], 1)
                left = project(values, self.coefficients[here]) < node[:, 1]
            else:
                left = np.zeros(len(live), bool)
                number = feature < self.n_numbers
                left[number] = numbers[live[number], feature[number]] < node[number, 1]
                other = np.flatnonzero(~number)
                if len(other):
                    code = categories[live[other], feature[other] - self.n_numbers]
                    wanted = here[other] * known + code
                    place = np.searchsorted(pairs, wanted)
                    left[other] = (code >= 0) & (code < known) & (pairs[np.minimum(place, len(pairs) - 1)] == wanted)
            at[live] = np.where(left, node[:, 2], node[:, 3]).astype(int)
            live = live[self.nodes[at[live], 0] >= 0]
        return at


def project(values: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Summed from the left, so that a row's projection is the same wherever it is made."""
    return reduce(np.add, (values[:, k] * coefficients[..., k] for k in range(values.shape[1])))


class Forest:
    """Trees with the categories that each knows, and their scores."""

    def __init__(self, trees: list[Tree], known: list[list[dict[str, int]]], size: int, metric: str):
        self.trees, self.metric = trees, metric
        self.norm = average_path(size)
        n_columns = len(known[0]) if known else 0
        # By column: all categories known to any tree, and what each tree calls them.
        self.names = [sorted({c for tree in known for c in tree[j]}) for j in range(n_columns)]
        self.codes = [[np.array([tree[j].get(c, -1) for c in self.names[j]] + [-1]) for j in range(n_columns)] for tree in known]
        self.steps = None
        if trees and not n_columns and trees[0].n_numbers == 1:
            # With one column a forest is a step function: looked up instead of walked.
            at = np.unique(np.concatenate([t.nodes[t.nodes[:, 0] >= 0, 1] for t in trees]))
            if len(at):
                low = np.append(np.nextafter(at[0], -np.inf), at)
                self.steps = at, self._walk(low[:, None], np.zeros((len(low), 0), int))

    def _walk(self, numbers: np.ndarray, categories: np.ndarray) -> np.ndarray:
        """The sum over all trees of what the metric takes from a leaf."""
        total = np.zeros(len(numbers))
        for t, tree in enumerate(self.trees):
            own = np.column_stack([self.codes[t][j][categories[:, j]] for j in range(categories.shape[1])]) if categories.shape[1] else categories
            total += tree.nodes[tree.leaves(numbers, own), 5 if self.metric == "density" else 4]
        return total

    def score(self, numbers: np.ndarray, categories: list[pa.Array]) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(numbers))
        if self.steps is not None:
            total = self.steps[1][np.searchsorted(self.steps[0], numbers[:, 0], side="right")]
        else:
            total = self._walk(numbers, np.column_stack([self._coded(j, c) for j, c in enumerate(categories)]) if categories else np.zeros((len(numbers), 0), int))
        mean = total / len(self.trees)
        if self.metric == "density":
            return -mean
        return 2.0 ** (-mean / self.norm) if self.norm else np.zeros(len(numbers))

    def _coded(self, j: int, values: pa.Array) -> np.ndarray:
        """Categories by their place among the known ones; others get the last place, which no tree knows."""
        found = values.dictionary_encode()
        place = {c: k for k, c in enumerate(self.names[j])}
        codes = np.array([place.get(c, len(place)) for c in found.dictionary.to_pylist()] or [0])
        return codes[found.indices.fill_null(0).to_numpy(zero_copy_only=False)]


def _prepared(df: DataFrame, names: list[str], weight: str | None, id_column: str | None, categorical: bool, who: str) -> tuple[DataFrame, list[str], list[str]]:
    """row_id, id, numbers x0.., categories c0.., weight w and inside (all numbers finite) of rows that count; the names of both kinds."""
    numbers, texts, parts = [], [], [col(df, id_column).alias("id")] if id_column else []
    for c in [*names, *([weight] if weight else [])]:
        kind = df.schema[c].dataType
        if isinstance(kind, T.NumericType | T.BooleanType):
            if c != weight or c in names:
                numbers.append(f"x{len(numbers)}")
                parts.append((col(df, c).cast("int") if isinstance(kind, T.BooleanType) else col(df, c)).cast("double").alias(numbers[-1]))
        elif isinstance(kind, T.StringType | T.VarcharType | T.CharType) and categorical and c in names:
            texts.append(f"c{len(texts)}")
            parts.append(col(df, c).cast("string").alias(texts[-1]))
        else:
            allowed = "numeric or categorical (a text)" if categorical and c in names else "numeric"
            raise ValueError(f"{who}: column '{c}' must be {allowed}, got {kind.simpleString()}")
    parts.append((col(df, weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    rows = with_row_ids(df.select(*parts))
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*numbers, *texts)] + [~F.isnan(c) for c in numbers] + [F.col("w").isNotNull() & ~F.isnan("w")])
    inside = reduce(lambda a, b: a & b, (finite(F.col(c)) for c in numbers), F.lit(True))
    return rows.where(usable).withColumn("inside", inside), numbers, texts


def _trees(rows: DataFrame, numbers: list[str], texts: list[str], n_trees: int, sample_size: int, seed: int, options: dict) -> tuple[list[Tree], list[list[dict[str, int]]], int]:
    """The trees, grown in tasks, and the size of each one's sample."""
    with tidy(rows.sparkSession):
        state = rows.where("inside").agg(F.count("*").alias("n"), F.count(F.when(F.col("w") > 0, 1)).alias("positive"), F.sum("w").alias("total"), F.min("w").alias("least"), F.max("w").alias("most")).first()
    if state.n and state.least < 0:
        raise ValueError("sample_weights cannot contain negative values")
    if state.n and not math.isfinite(state.total):
        raise ValueError("sample_weights must be finite")
    if not state.positive:
        return [], [], 0
    # Depths and scores go by the size asked for, as far as there are rows; a sample is smaller where weights of 0 leave fewer.
    size, take = min(sample_size, state.n), min(sample_size, state.positive)
    limit = (math.ceil(math.log2(size)) if size > 1 else 0) + 1
    columns = [*numbers, *texts]
    kinds = ", ".join(f"{c} {'double' if c in numbers else 'string'}" for c in columns)

    def draw(bound: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = np.arange(n_trees)
            for batch in batches:
                step = max(1, BLOCK // n_trees)
                for a in range(0, len(batch), step):
                    part = batch.slice(a, step)
                    row, w = (part.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                    made = keys(row, w, trees, seed)
                    at, tree = np.nonzero(made < bound)
                    yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(made[at, tree]), *(c.take(pa.array(at)) for c in part.columns[2:])], names=["tree", "key", *columns])

        return run

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = len(frame)
        frame = frame.sort_values("key").head(take)
        known, codes = [], []
        for c in texts:
            names = sorted(set(frame[c]))
            known.append({name: k for k, name in enumerate(names)})
            codes.append(frame[c].map(known[-1]).to_numpy(int))
        cats = np.column_stack(codes) if codes else np.zeros((len(frame), 0), int)
        tree = Tree(frame[numbers].to_numpy(float).reshape(len(frame), len(numbers)), cats, np.random.default_rng([seed & (1 << 64) - 1, int(key[0])]), limit, **options)
        return pd.DataFrame({"tree": [int(key[0])], "found": [found], "made": [pickle.dumps((tree, known))]})

    expected = take + MARGIN * math.sqrt(take) + 20
    bound = math.inf if state.positive <= 4 * take else expected / state.total
    given = rows.where("inside AND w > 0").select("row_id", "w", *columns)
    while True:
        drawn = given.mapInArrow(draw(bound), f"tree int, key double, {kinds}")
        # A number of partitions of its own: samples are small and trees are not, so that they mustn't be put into few tasks.
        drawn = drawn.repartition(min(n_trees, 4 * rows.sparkSession.sparkContext.defaultParallelism), "tree")
        with tidy(rows.sparkSession):
            made = drawn.groupBy("tree").applyInPandas(grow, "tree int, found long, made binary").collect()
        if bound == math.inf or (len(made) == n_trees and all(r.found >= take for r in made)):
            break
        bound = bound * 8 if bound * state.total < 1e6 * expected else math.inf
    pairs = [pickle.loads(r.made) for r in sorted(made, key=lambda r: r.tree)]
    return [t for t, _ in pairs], [k for _, k in pairs], size


def _scored(df: DataFrame, names: list[str], who: str, n_trees: int, sample_size: int, contamination: float, seed: int | None, id_column: str | None, metric: str = "depth", weight: str | None = None, **options) -> DataFrame:
    """row_id, [id], x0 if it is the only column, inside, anomaly_score and is_anomaly of every row that counts."""
    seed = secrets.randbits(63) if seed is None else int(seed)
    rows, numbers, texts = _prepared(df, names, weight, id_column, "mv" in who, who)
    # Dealt over tasks: they are drawn from and scored in the tasks that read them.
    rows = stored(spread(rows), "forest_rows")
    trees, known, size = _trees(rows, numbers, texts, n_trees, sample_size, seed, options)
    sent = df.sparkSession.sparkContext.broadcast(Forest(trees, known, size, metric))
    kept = ["row_id", *(["id"] if id_column else []), *(["x0"] if numbers == ["x0"] and not texts else []), "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("inside").to_numpy(zero_copy_only=False)
            score = np.ones(len(batch))
            part = batch.filter(batch.column("inside"))
            if len(part):
                values = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in numbers]) if numbers else np.zeros((len(part), 0))
                score[good.astype(bool)] = sent.value.score(values, [part.column(c) for c in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], names=[*kept, "anomaly_score"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("anomaly_score", T.DoubleType())])
    scored = stored(rows.mapInArrow(run, schema), "forest_scores")
    drop_stored(rows)
    return _flagged(scored, contamination)


def _flagged(scored: DataFrame, contamination: float) -> DataFrame:
    """Scores above the one at place floor((1 - contamination) (n - 1)); of ties there all or none."""
    some = scored.where("inside")
    ranked = some.agg(F.count("*").alias("n"), F.max("anomaly_score").alias("top"), F.min("anomaly_score").alias("low"))
    cut = order_statistics(some, {"cut": (F.col("anomaly_score"), [1.0 - contamination])}, lower=True).select(F.get("cut", F.lit(0)).alias("cut"))
    tie = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    score, top = F.col("anomaly_score"), F.col("top")
    place = F.floor(F.lit(1.0 - contamination) * (F.col("n") - 1))
    none = tie(top, F.col("low")) | (place >= F.col("n") - 1)
    flag = F.when(~F.col("inside"), True).when(none, False).when(tie(F.col("cut"), top), tie(score, top)).otherwise((score > F.col("cut")) & ~tie(score, F.col("cut")))
    return scored.crossJoin(F.broadcast(ranked)).crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.coalesce(flag, F.lit(False))).drop("n", "top", "low", "cut")


def _checked(n_trees: int | None, sample_size: int | None, contamination: float | None, output_mode: str | None, who: str) -> tuple[int, int, float, str]:
    """Arguments with None replaced by their defaults."""
    n_trees, sample_size = 100 if n_trees is None else n_trees, 256 if sample_size is None else sample_size
    contamination, output_mode = 0.1 if contamination is None else contamination, (output_mode or "summary").lower()
    if not 1 <= n_trees <= 500 or not 1 <= sample_size <= 10000 or not 0 <= contamination <= 0.5:
        raise ValueError(f"{who}: n_trees in 1..500, sample_size in 1..10000, contamination in 0..0.5")
    if output_mode not in ("summary", "scores"):
        raise ValueError(f"{who}: output_mode must be 'summary' or 'scores'")
    return n_trees, sample_size, contamination, output_mode


def isolation_forest(table: Relation, column: str, n_trees: int | None = 100, sample_size: int | None = 256, contamination: float | None = 0.1, output_mode: str | None = "summary", seed: int | None = None, id_column: str | None = None) -> DataFrame:
    """A forest over one numeric column; rows where it is null or NaN are left out, infinite ones are anomalies of score 1."""
    n_trees, sample_size, contamination, output_mode = _checked(n_trees, sample_size, contamination, output_mode, "isolation_forest")
    df = relation(table)
    out = _scored(df, [column_name(df, column)], "isolation_forest", n_trees, sample_size, contamination, seed, id_column)
    if output_mode == "scores":
        return out.select("row_id", *(["id"] if id_column else []), F.col("x0").alias("value"), "anomaly_score", "is_anomaly")
    return _summary(out, contamination, n_trees, F.avg(F.when(F.col("inside"), F.col("x0"))).alias("avg_value"))


def isolation_forest_mv(
    table: Relation, columns: str | list[str], n_trees: int | None = 100, sample_size: int | None = 256, contamination: float | None = 0.1, output_mode: str | None = "summary", seed: int | None = None,
    ndim: int | None = 1, coef_type: str | None = "uniform", scoring_metric: str | None = "depth", weight_column: str | None = None, ntry: int | None = 1, prob_pick_avg_gain: float | None = 0.0, id_column: str | None = None,
) -> DataFrame:
    """A forest over several columns, numbers or texts (categories).

    With ndim > 1 nodes are hyperplanes of so many numbers with coefficients uniform in -1..1 or normal. Of ntry candidates a node takes
    one at random, or with odds of prob_pick_avg_gain that of the best gain. weight_column: odds of rows in samples; those
    of weight 0 are scored only, null ones left out. scoring_metric: depth and adj_depth go by path lengths, density by the logarithm of
    the sample's rows in a leaf, with a minus sign. None stands for a default.
    """
    who = "isolation_forest_mv"
    n_trees, sample_size, contamination, output_mode = _checked(n_trees, sample_size, contamination, output_mode, who)
    df = relation(table)
    names = column_names(df, columns)
    ndim, ntry, by_gain = 1 if ndim is None else ndim, 1 if ntry is None else ntry, 0.0 if prob_pick_avg_gain is None else prob_pick_avg_gain
    coef_type, metric = (coef_type or "uniform").lower(), (scoring_metric or "depth").lower()
    if ndim < 1:
        raise ValueError(f"{who}: ndim must be >= 1")
    if ndim > len(names):
        raise ValueError(f"{who}: ndim ({ndim}) must not exceed the number of columns ({len(names)})")
    if coef_type not in COEFFICIENTS:
        raise ValueError(f"{who}: coef_type must be 'uniform' or 'normal'")
    if metric not in METRICS:
        raise ValueError(f"{who}: scoring_metric must be 'depth', 'density', or 'adj_depth'")
    if ntry < 1:
        raise ValueError(f"{who}: ntry must be >= 1")
    if not 0 <= by_gain <= 1:
        raise ValueError(f"{who}: prob_pick_avg_gain must be between 0.0 and 1.0 (finite)")
    weight = column_name(df, weight_column) if weight_column else None
    out = _scored(df, names, who, n_trees, sample_size, contamination, seed, id_column, metric, weight, ndim=ndim, normal=coef_type == "normal", ntry=ntry, by_gain=by_gain)
    if output_mode == "scores":
        return out.select("row_id", *(["id"] if id_column else []), "anomaly_score", "is_anomaly")
    return _summary(out, contamination, n_trees, n_columns=len(names))


def _summary(out: DataFrame, contamination: float, n_trees: int, *more: Column, n_columns: int | None = None) -> DataFrame:
    total = out.agg(F.count(F.when(F.col("is_anomaly"), 1)).alias("outlier_count"), F.count("*").alias("total_count"), *more)
    message = F.when(F.col("outlier_count") == 0, "No anomalies detected").otherwise(F.concat(F.col("outlier_count").cast("string"), F.lit(" anomalies detected")))
    middle = [F.lit(n_columns).cast("int").alias("n_columns")] if n_columns else ["avg_value"]
    return total.select(F.when(F.col("outlier_count") > 0, "fail").otherwise("pass").alias("status"), "outlier_count", "total_count", *middle, F.lit(float(contamination)).alias("contamination"), F.lit(n_trees).cast("int").alias("n_trees"), message.alias("message"))
