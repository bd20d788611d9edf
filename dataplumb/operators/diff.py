"""Row-level diffs of two tables by key, and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._base import Relation, column_name, column_names, is_exact, is_numeric, quoted, relation, relation_name

RESERVED = ("diff_type", "changed_columns")


#: Groups of keys whose digests are compared before any row is joined.
DIGESTS = 1 << 16


def _utc(c: Column) -> Column:
    """A zoned timestamp as the plain one that it is in UTC, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01").cast("timestamp_ntz"))


def _text(c: Column, kind: T.DataType) -> Column:
    return F.concat(_utc(c).cast("string"), F.lit("+00")) if isinstance(kind, T.TimestampType) else c.cast("string")


def alike(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType) -> tuple[Column, Column]:
    """Two columns in the forms that are compared: numbers by value; a zoned timestamp with a plain one in UTC; other types by text where they differ."""
    if kind_a == kind_b or (is_numeric(kind_a) and is_numeric(kind_b)):
        return a, b
    plain, zoned = T.TimestampNTZType, T.TimestampType
    if isinstance(kind_a, zoned) and isinstance(kind_b, plain):
        return _utc(a), b
    if isinstance(kind_a, plain) and isinstance(kind_b, zoned):
        return a, _utc(b)
    return _text(a, kind_a), _text(b, kind_b)


def _same(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType, tolerance: float, digits: int | None) -> Column:
    """Whether both are equal in the forms that are compared; NULL equals NULL only."""
    if is_numeric(kind_a) and is_numeric(kind_b):
        inexact = any(isinstance(k, T.FloatType | T.DoubleType) for k in (kind_a, kind_b))
        if inexact and digits is not None:
            return F.round(a.cast("double"), digits).eqNullSafe(F.round(b.cast("double"), digits))
        if tolerance:
            near = F.abs(a.cast("double") - b.cast("double")) <= tolerance
            return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))
        return a.eqNullSafe(b)
    x, y = alike(a, b, kind_a, kind_b)
    return x.eqNullSafe(y)


def _digested(c: Column, kind: T.DataType, other: T.DataType, digits: int | None) -> Column:
    """What is digested of a column: equal wherever _same finds it equal without a tolerance."""
    if is_numeric(kind) and is_numeric(other):
        inexact = any(isinstance(k, T.FloatType | T.DoubleType) for k in (kind, other))
        if inexact and digits is not None:
            return F.round(c.cast("double"), digits)
        if is_exact(kind) and is_exact(other):
            scale = max(k.scale if isinstance(k, T.DecimalType) else 0 for k in (kind, other))
            return c if kind == other else c.try_cast(f"decimal(38,{scale})")
        return c if kind == other else c.cast("double")
    return alike(c, c, kind, other)[0]


def _twice(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """No row; but a key that stands twice is an error when the query runs."""
    counted = df.groupBy(*(F.col(quoted(k)) for k in keys)).agg(F.count("*").alias("_n"))
    text = F.concat_ws(", ", *(F.coalesce(F.col(quoted(k)).cast("string"), F.lit("NULL")) for k in keys))
    # Within the condition, so that no reordering of filters raises it for other keys.
    error = F.raise_error(F.concat(F.lit(f"duplicate key in {what}: "), text)).cast("string")
    return counted.where(F.when(F.col("_n") > 1, error).isNotNull()).select("_n")


def joindiff(source: Relation, target: Relation, keys: str | list[str], compare_columns: list[str] | None = None, include_all: bool = False, float_tolerance: float = 0.0, float_precision: int | None = None, digests: bool = False) -> DataFrame:
    """diff_type, the key, the other columns of target, changed_columns.

    One full outer join on the key where NULL equals NULL; both sides are shuffled by the key once, and the check for
    keys that stand twice uses the same distribution. With digests only rows of groups of keys whose digests (counts and
    two sums of hashes over the compared columns) differ are joined: of tables that are equal no row but its key is
    shuffled. Digests need exact comparisons, hence no tolerance, and don't go with include_all.
    """
    if digests and (include_all or float_tolerance):
        raise ValueError("digests go with neither include_all nor float_tolerance")
    if float_tolerance < 0:
        raise ValueError("float_tolerance must not be negative")
    s, t = relation(source), relation(target)
    if bad := [c for c in t.columns if c.lower() in RESERVED]:
        raise ValueError(f"the target has columns of the result's names: {', '.join(bad)}")
    key_names = column_names(t, keys)
    source_keys = [column_name(s, k) for k in key_names]
    there = {c.lower(): c for c in s.columns}
    lower_keys = {k.lower() for k in key_names}
    shared = [c for c in t.columns if c.lower() in there and c.lower() not in lower_keys]
    compared = [column_name(t, c) for c in compare_columns] if compare_columns else shared
    for c in compared:
        column_name(s, c)
    kinds_s, kinds_t = ({f.name.lower(): f.dataType for f in df.schema} for df in (s, t))
    frames, sides = [], []
    for df, names, mine, its in ((s, source_keys, kinds_s, kinds_t), (t, key_names, kinds_t, kinds_s)):
        pairs = [(c, mine[c.lower()], its[o.lower()]) for c, o in zip(names, key_names if df is s else source_keys, strict=True)]
        keys_ = [F.coalesce(_digested(F.col(quoted(c)), a, b, None).cast("string"), F.lit("")) for c, a, b in pairs]
        sides.append((F.pmod(F.xxhash64(*keys_, *(F.col(quoted(c)).isNull() for c, _, _ in pairs)), F.lit(DIGESTS)), [_digested(F.col(quoted(column_name(df, c))), mine[c.lower()], its[c.lower()], float_precision) for c in compared], keys_))
    if digests:
        s, t = _differing((s, t), sides)
    for df, names, mark, what in ((s, source_keys, "s", relation_name(source, "source")), (t, key_names, "t", relation_name(target, "target"))):
        whole = df if not digests else relation(source if mark == "s" else target)
        marked = df.select(F.lit(True).alias(f"_{mark}"), *(F.col(quoted(c)).alias(f"{mark}_{c.lower()}") for c in df.columns))
        frames.append(marked.join(F.broadcast(_twice(whole, names, what)), F.lit(True), "left_anti"))
    a, b = frames
    on = []
    for x, y in zip(source_keys, key_names, strict=True):
        left, right = alike(F.col(quoted(f"s_{x.lower()}")), F.col(quoted(f"t_{y.lower()}")), kinds_s[x.lower()], kinds_t[y.lower()])
        on.append(left.eqNullSafe(right))
    joined = a.join(b, on, "full_outer")
    changes = F.array_compact(F.array(*(F.when(~_same(F.col(quoted(f"s_{c.lower()}")), F.col(quoted(f"t_{c.lower()}")), kinds_s[c.lower()], kinds_t[c.lower()], float_tolerance, float_precision), F.lit(c)) for c in compared))) if compared else F.array().cast("array<string>")
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    joined = joined.withColumn("changed_columns", F.when(both, changes).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("_s").isNull(), "added").when(F.col("_t").isNull(), "removed").when(F.size("changed_columns") > 0, "changed").otherwise("unchanged")
    out = [kind.alias("diff_type")]
    out += [F.coalesce(F.col(quoted(f"t_{k.lower()}")), F.col(quoted(f"s_{x.lower()}")).cast(kinds_t[k.lower()])).alias(k) for x, k in zip(source_keys, key_names, strict=True)]
    out += [F.col(quoted(f"t_{c.lower()}")).alias(c) for c in t.columns if c.lower() not in lower_keys]
    result = joined.select(*out, "changed_columns")
    return result if include_all else result.where("diff_type <> 'unchanged'")


def _differing(tables: tuple[DataFrame, DataFrame], sides: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Both tables' rows of the groups whose digests differ. The digests are DIGESTS rows a side at most."""
    total = "decimal(38,0)"
    made = []
    for df, (group, compared, keys) in zip(tables, sides, strict=True):
        whole = [*keys, *compared, *(c.isNull() for c in compared)]
        rows = df.select(group.alias("g"), F.xxhash64(*whole).alias("x"), F.xxhash64(F.lit(1), *whole[::-1]).alias("y"))
        made.append(rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("x").cast(total)).alias("x"), F.sum(F.col("y").cast(total)).alias("y")))
    a, b = (d.toDF(*(f"{c}{k}" for c in "gnxy")) for k, d in zip("ab", made, strict=True))
    equal = F.col("na").eqNullSafe(F.col("nb")) & F.col("xa").eqNullSafe(F.col("xb")) & F.col("ya").eqNullSafe(F.col("yb"))
    groups = a.join(b, F.col("ga") == F.col("gb"), "full_outer").where(~equal).select(F.coalesce("ga", "gb").alias("group_"))
    return tuple(df.join(F.broadcast(groups), group == F.col("group_"), "left_semi") for df, (group, _, _) in zip(tables, sides, strict=True))


def hashdiff(source: Relation, target: Relation, keys: str | list[str], float_precision: int | None = None) -> DataFrame:
    """The same over all shared columns, with inexact numbers rounded to float_precision digits if that is given. Digests of groups of
    keys are compared first, and only the rows of those that differ are joined."""
    return joindiff(source, target, keys, float_precision=float_precision, digests=True)


def schema_diff(source: Relation, target: Relation) -> DataFrame:
    """One row for each column: same, added, removed or retyped; source order, then what is added."""
    s, t = ({f.name.lower(): f for f in relation(x).schema} for x in (source, target))
    rows = []
    for name, f in s.items():
        other = t.get(name)
        drift = "removed" if other is None else "same" if other.dataType == f.dataType else "retyped"
        rows.append((f.name, f.dataType.simpleString(), other and other.dataType.simpleString(), drift))
    rows += [(f.name, None, f.dataType.simpleString(), "added") for name, f in t.items() if name not in s]
    return SparkSession.getActiveSession().createDataFrame(rows, "column_name string, source_type string, target_type string, drift string")
