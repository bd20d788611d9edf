"""Column profiles, table summaries and correlations.

All columns' plain statistics come from one aggregation over one scan, quartiles of all columns from counts; distinct counts and the most frequent values come from one
count by (column, value), which combines before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._base import Relation, column_names, finite, is_numeric, quoted, relation
from .._order import order_statistics
from ..functions import phone

TOP = 5
#: The patterns in the order in which they are tried; phone asks phone.phonenumber_is_valid for US instead.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+[.][a-zA-Z]{2,}\z",
    "phone": None,
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "url": r"^https?://.+",
    "ip_address": r"^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\z",
    "iso_date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
    "numeric_string": r"^[0-9]+\z",
}
#: What columns of other kinds are called.
SHAPES = {T.ArrayType: "list", T.MapType: "map", T.StructType: "struct"}
PATTERN_SHARE = 0.8
#: Ranges of values that ranks are counted in.
PARTS = 64
#: Columns of about so many values at most have their table of ranks broadcast.
FEW = 100_000


def bucket(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        return "string"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType | T.DayTimeIntervalType | T.YearMonthIntervalType):
        return "temporal"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.BinaryType):
        return "binary"
    return "complex" if isinstance(kind, T.ArrayType | T.StructType | T.MapType) else "other"


def _good(c: Column, kind: T.DataType) -> Column:
    """The value if it counts for statistics."""
    return F.when(finite(c.cast("double")), c) if isinstance(kind, T.FloatType | T.DoubleType) else c


def _skewness(v: Column) -> Column:
    """Corrected for bias; null below three values or without spread."""
    n = F.count(v).cast("double")
    return F.when((F.count(v) > 2) & (F.stddev_pop(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))


def _kurtosis(v: Column) -> Column:
    n = F.count(v).cast("double")
    return F.when((F.count(v) > 3) & (F.stddev_pop(v) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))


def profile_table(table: Relation, columns: str | list[str] | None = None, sample_size: int | None = 1_000_000, exact: bool = False) -> DataFrame:
    """One row for each column, with the 29 statistics of the output contract.

    Above sample_size rows a fixed random sample of about that size is profiled, unless exact is set.
    """
    df = relation(table)
    names = column_names(df, columns) if columns else df.columns
    df = df.select(*(F.col(quoted(c)) for c in names))
    sampled, size = False, None
    if not exact and sample_size is not None:
        size = df.count()
        if sampled := size > sample_size:
            df = df.sample(sample_size / size, seed=42)
    kinds = {f.name: f.dataType for f in df.schema}
    stats, phones, quartiles = [F.count("*").alias("n")], [], {}
    for i, c in enumerate(names):
        kind, raw, what = kinds[c], F.col(quoted(c)), bucket(kinds[c])
        v, d = _good(raw, kind), _good(raw, kind).cast("double") if what == "numeric" else F.lit(None).cast("double")
        put = lambda key, value, i=i: stats.append(value.alias(f"c{i}_{key}"))
        put("count", F.count(raw))
        if what == "numeric":
            put("mean", F.avg(d)), put("stddev", F.stddev_samp(d))
            quartiles[f"c{i}_q"] = (d, [0.25, 0.5, 0.75])
            put("skewness", _skewness(d)), put("kurtosis", _kurtosis(d))
            put("zero", F.count(F.when(v == 0, 1))), put("negative", F.count(F.when(v < 0, 1)))
            inexact = isinstance(kind, T.FloatType | T.DoubleType)
            put("nan", F.count(F.when(F.isnan(raw), 1)) if inexact else F.lit(0).cast("long"))
            put("inf", F.count(F.when(F.abs(raw) == float("inf"), 1)) if inexact else F.lit(0).cast("long"))
        if what in ("numeric", "string", "temporal", "boolean"):
            put("min", F.min(v).cast("string")), put("max", F.max(v).cast("string"))
        length = F.length(raw) if what == "string" else F.octet_length(raw) if what == "binary" else F.size(raw) if isinstance(kind, T.ArrayType | T.MapType) else None
        if length is not None:
            length = F.when(raw.isNotNull(), length)
            put("avg_length", F.avg(length)), put("min_length", F.min(length)), put("max_length", F.max(length))
        if what == "string":
            for p, pattern in PATTERNS.items():
                # A phone number has seven digits at least: other texts aren't taken to Python.
                digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
                fits = raw.rlike(pattern) if pattern else F.when(digits.between(7, 17), phone.phonenumber_is_valid(F.when(digits.between(7, 17), raw), "US"))
                if pattern:
                    put(p, F.count(F.when(fits, 1)))
                else:
                    phones.append((i, fits))
    if phones:
        df_ = df.select("*", *(fits.alias(f"_phone{i}") for i, fits in phones))
        totals = df_.agg(*stats, *(F.count(F.when(F.col(f"_phone{i}"), 1)).alias(f"c{i}_phone") for i, _ in phones))
    else:
        totals = df.agg(*stats)
    if quartiles:
        totals = totals.crossJoin(F.broadcast(order_statistics(df, quartiles)))

    # (column, value) with its count: distinct numbers and the most frequent values of all columns from one shuffle.
    entries = []
    for i, c in enumerate(names):
        raw, what = F.col(quoted(c)), bucket(kinds[c])
        order = raw.cast("double") if what == "numeric" else F.lit(None).cast("double")
        shown = F.to_json(F.struct(raw)) if what == "complex" else F.hex(raw) if what == "binary" else raw.cast("string")
        good = finite(raw.cast("double")) if isinstance(kinds[c], T.FloatType | T.DoubleType) else F.lit(True)
        entries.append(F.when(raw.isNotNull(), F.struct(F.lit(i).alias("i"), order.alias("o"), shown.alias("v"), good.alias("good"))))
    values = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.i", "e.o", "e.v", "e.good").agg(F.count("*").alias("c"))
    counted = values.groupBy("i").agg(F.count("*").alias("distinct"))
    best = values.where("good").withColumn("nth", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("c"), F.col("o").asc_nulls_last(), "v"))).where(F.col("nth") <= TOP)
    best = best.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("v").alias("value"), F.col("c").alias("count")))), lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))).alias("top_values"))

    def row(i: int, c: str) -> Column:
        what, kind = bucket(kinds[c]), kinds[c]
        there = {s for s in totals.columns if s.startswith(f"c{i}_")}
        get = lambda key, cast: (F.col(f"c{i}_{key}") if f"c{i}_{key}" in there else F.lit(None)).cast(cast)
        n, filled = F.col("n"), F.col(f"c{i}_count")
        pattern = F.lit(None).cast("string")
        if what == "string":
            pattern = reduce(lambda acc, p: acc.when(F.col(f"c{i}_{p}") >= PATTERN_SHARE * filled, p), list(PATTERNS)[1:], F.when(F.col(f"c{i}_email") >= PATTERN_SHARE * filled, "email")).otherwise("mixed")
            pattern = F.when(filled > 0, pattern)
        elif type(kind) in SHAPES:
            pattern = F.lit(SHAPES[type(kind)])
        q = lambda k: F.get(F.col(f"c{i}_q"), F.lit(k)) if what == "numeric" else F.lit(None).cast("double")
        parts = {
            "i": F.lit(i), "column_name": F.lit(c), "column_type": F.lit(kind.simpleString()), "row_count": n, "null_count": n - filled, "null_rate": F.try_divide((n - filled).cast("double"), n),
            "min_val": get("min", "string"), "max_val": get("max", "string"), "mean": get("mean", "double"), "median": q(1), "stddev": get("stddev", "double"), "p25": q(0), "p75": q(2),
            "skewness": get("skewness", "double"), "kurtosis": get("kurtosis", "double"), "avg_length": get("avg_length", "double"), "min_length": get("min_length", "long"), "max_length": get("max_length", "long"),
            "pattern_summary": pattern, "zero_count": get("zero", "long"), "negative_count": get("negative", "long"), "is_sampled": F.lit(sampled), "actual_sample_size": n, "nan_count": get("nan", "long"), "inf_count": get("inf", "long"),
        }
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    rows = totals.select(F.explode(F.array(*(row(i, c) for i, c in enumerate(names)))).alias("r")).select("r.*")
    out = rows.join(F.broadcast(counted), "i", "left").join(F.broadcast(best), "i", "left")
    distinct = F.coalesce("distinct", F.lit(0))
    filled = F.col("row_count") - F.col("null_count")
    out = out.orderBy("i").select(
        "column_name", "column_type", "row_count", "null_count", "null_rate", distinct.alias("distinct_count"), F.try_divide(distinct.cast("double"), F.col("row_count")).alias("distinct_rate"), "min_val", "max_val", "mean", "median", "stddev", "p25", "p75", "skewness", "kurtosis",
        F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")).alias("top_values"), "avg_length", "min_length", "max_length", "pattern_summary", (distinct == filled).alias("is_unique"), (distinct <= 1).alias("is_constant"), "zero_count", "negative_count", "is_sampled", "actual_sample_size", "nan_count", "inf_count",
    )
    return out


def profile_summary(table: Relation) -> DataFrame:
    df = relation(table)
    kinds = [bucket(f.dataType) for f in df.schema]
    n = len(kinds)
    # Maps can't be grouped by: they are taken as text.
    keys = [F.to_json(F.col(quoted(f.name))) if isinstance(f.dataType, T.MapType) else F.col(quoted(f.name)) for f in df.schema]
    nulls = reduce(lambda a, b: a + b, (F.col(quoted(c)).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    rows = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), nulls.alias("nulls")).groupBy(*(f"k{i}" for i in range(n)), "nulls").agg(F.count("*").alias("c"))
    total = rows.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("nulls") * F.col("c")), F.lit(0)).alias("total_nulls"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_row_count"))
    many = lambda *k: F.lit(sum(x in k for x in kinds)).cast("long")
    return total.select(
        "row_count", F.lit(n).cast("long").alias("column_count"), many("numeric").alias("numeric_columns"), many("string").alias("string_columns"), many("temporal").alias("temporal_columns"), many("boolean").alias("boolean_columns"), many("complex").alias("complex_columns"), many("other", "binary").alias("other_columns"),
        "total_nulls", F.try_divide(F.col("total_nulls").cast("double"), F.col("row_count") * n).alias("total_null_rate"), "duplicate_row_count", (F.col("row_count") * n * 8).alias("estimated_memory_bytes"),
    )


def profile_correlations(table: Relation, columns: str | list[str] | None = None) -> DataFrame:
    """Pearson's and Spearman's correlation of each pair of numeric columns over rows where both are finite.

    Ranks are minimum ranks on ties. All Pearson correlations come from one aggregation. Columns that are finite everywhere are
    ranked once each, and all of their pairs come from one more; the ranks of a pair with another column are of
    its rows alone, from counts of distinct values. Runs one aggregation when called, which tells these columns.
    """
    df = relation(table)
    names = column_names(df, columns) if columns else [f.name for f in df.schema if is_numeric(f.dataType)]
    bad = [c for c in names if not is_numeric(df.schema[c].dataType)]
    if bad:
        raise ValueError(f"not numeric: {', '.join(bad)}")
    df = df.select(*(F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(names)))
    clamp = lambda c: F.when(~F.isnan(c), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    couples = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if not couples:
        return SparkSession.getActiveSession().createDataFrame([], "column_a string, column_b string, pearson double, spearman double, n long")
    fit = {(i, j): finite(F.col(f"x{i}")) & finite(F.col(f"x{j}")) for i, j in couples}
    at = lambda i, j, k: F.when(fit[i, j], F.col(f"x{k}"))
    plain = df.agg(*(e for i, j in couples for e in (clamp(F.corr(at(i, j, i), at(i, j, j))).alias(f"p{i}_{j}"), F.count(F.when(fit[i, j], 1)).alias(f"n{i}_{j}"))))
    # A row for each pair: its two numbers, its Pearson value and its count.
    plain = plain.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("pearson"), F.col(f"n{i}_{j}").alias("n")) for i, j in couples))).alias("x")).select("x.*")
    # Which columns are finite everywhere, and about how many values each has.
    xs = [F.col(f"x{i}") for i in range(len(names))]
    known = df.agg(*(F.count(F.when(~F.coalesce(finite(x), F.lit(False)), 1)).alias(f"odd{i}") for i, x in enumerate(xs)), *(F.approx_count_distinct(x).alias(f"many{i}") for i, x in enumerate(xs))).first()
    whole = [i for i in range(len(names)) if not known[f"odd{i}"]]
    frames, together = [], [(i, j) for i, j in couples if i in whole and j in whole]
    if together:
        ranked = df.select(*(f"x{i}" for i in whole))
        for i in whole:
            ranks = _ranks(df.groupBy(f"x{i}").agg(F.count("*").alias("c")), f"x{i}")
            ranked = ranked.join(F.broadcast(ranks) if known[f"many{i}"] <= FEW else ranks, f"x{i}")
        found = ranked.agg(*(clamp(F.corr(F.col(f"rx{i}").cast("double"), F.col(f"rx{j}").cast("double"))).alias(f"s{i}_{j}") for i, j in together))
        frames.append(found.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("spearman")) for i, j in together))).alias("x")).select("x.*"))
    for i, j in couples:
        if (i, j) in together:
            continue
        both = df.select(F.col(f"x{i}").alias("a"), F.col(f"x{j}").alias("b")).where(finite(F.col("a")) & finite(F.col("b")))
        pairs = both.groupBy("a", "b").agg(F.count("*").alias("c"))
        for side in ("a", "b"):
            pairs = pairs.join(_ranks(pairs, side), side)

        def weighted(x: str, y: str) -> Column:
            x, y, c = F.col(x).cast("double"), F.col(y).cast("double"), F.col("c")
            n = F.sum(c)
            mx, my = F.sum(x * c) / n, F.sum(y * c) / n
            cov = F.sum(x * y * c) / n - mx * my
            vx, vy = F.sum(x * x * c) / n - mx * mx, F.sum(y * y * c) / n - my * my
            return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))

        frames.append(pairs.agg(clamp(weighted("ra", "rb")).alias("spearman")).select(F.lit(i).alias("i"), F.lit(j).alias("j"), "spearman"))
    named = F.array(*map(F.lit, names))
    out = plain.join(F.broadcast(reduce(DataFrame.union, frames)), ["i", "j"])
    return out.orderBy("i", "j").select(F.get(named, F.col("i")).alias("column_a"), F.get(named, F.col("j")).alias("column_b"), "pearson", "spearman", "n")


def _ranks(pairs: DataFrame, side: str) -> DataFrame:
    """The minimum rank of each distinct value of side, by running sums within PARTS ranges of values.

    The sums of the ranges before and the running sum inside give the rank, so that no task holds all values. Equal values
    always fall into one range, wherever approximate quantiles put the bounds.
    """
    values = pairs.groupBy(side).agg(F.sum("c").alias("c"))
    bounds = values.agg(F.percentile_approx(side, [k / PARTS for k in range(1, PARTS)]).alias("bounds"))
    values = values.crossJoin(F.broadcast(bounds)).select(side, "c", F.size(F.filter("bounds", lambda b: b <= F.col(side))).alias("part"))
    sums = values.groupBy("part").agg(F.sum("c").alias("all"))
    before = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inner = F.sum("c").over(Window.partitionBy("part").orderBy(side)) - F.col("c")
    return values.withColumn("inner", inner).join(F.broadcast(before), "part").select(side, (F.col("before") + F.col("inner") + 1).alias(f"r{side}"))
