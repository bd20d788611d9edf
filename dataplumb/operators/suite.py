"""The suite runner: many checks from a table of specifications, one row of one schema for each.

Checks of one table, filter and identifier that are plain aggregates are computed in one aggregation, so that a suite
scans a table once and not once a check. A check that cannot be built gives an error row and leaves the others alone.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._base import Relation, col, column_name, column_names, finite, is_exact, lit_double, moment, number, quoted, relation
from . import checks

#: The check types and the keys of their params.
PARAMS = {
    "volume": (),
    "null_rate": (),
    "distinct_count": (),
    "duplicate_count": (),
    "regex_match": ("pattern",),
    "values_in_set": ("allowed_values",),
    "agg": ("agg",),
    "compliance": ("expression",),
    "freshness": ("reference_time",),
    "occurrence": ("mode",),
    "match_rate": ("right_table", "right_keys", "left_keys"),
    "rel_count_change": ("date_column", "count_column", "window_days", "reference_date", "fill_missing_days"),
    "metric_anomaly_iqr": ("date_column", "metric_column", "window_days", "k", "reference_date"),
    "rolling_values_in_set": ("date_column", "allowed_values", "window_days", "reference_date"),
    "schema_check": ("columns",),
}
WITH_IDENTIFIER = ("volume", "null_rate", "distinct_count", "regex_match", "values_in_set", "agg", "duplicate_count", "compliance", "freshness")
SCHEMA = "run_ts timestamp, check_name string, check_type string, table_name string, column_name string, identifier string, value double, lower_threshold double, upper_threshold double, status string, message string"
TRIVIAL = "No value to evaluate; check passed trivially"


@dataclass
class Spec:
    check_name: str
    check_type: str
    table_name: str
    column_name: str | None = None
    params: dict = field(default_factory=dict)
    lower_threshold: float | None = None
    upper_threshold: float | None = None
    monitor_only: bool = False
    identifier_column: str | None = None
    filter_expr: str | None = None
    problem: str | None = None


def read_specs(table: Relation | list[dict]) -> list[Spec]:
    """From a DataFrame, a table name, a file by its suffix, or a list of dicts. The specifications come to the driver."""
    if isinstance(table, str) and re.search(r"\.(csv|tsv|parquet|json|ndjson)$", table):
        from ..sources.files import read

        table = read(SparkSession.getActiveSession(), table)
    rows = table if isinstance(table, list) else [r.asDict() for r in relation(table).collect()]
    specs, seen = [], set()
    for row in rows:
        row = {k.lower(): v for k, v in row.items()}
        name = str(row.get("check_name") or "").strip()
        if not name or name in seen:
            raise ValueError(f"check names must be given, each once: '{name}'")
        seen.add(name)
        for key in ("check_type", "table_name"):
            if not row.get(key):
                raise ValueError(f"check '{name}': {key} is missing")
        spec = Spec(name, str(row["check_type"]).strip().lower(), str(row["table_name"]))
        try:
            spec.params = json.loads(row["params"]) if isinstance(row.get("params"), str) and row["params"].strip() else dict(row.get("params") or {})
        except ValueError as e:
            spec.problem = f"params is no JSON object: {e}"
        for key in ("column_name", "identifier_column", "filter_expr"):
            setattr(spec, key, row.get(key) or None)
        for key in ("lower_threshold", "upper_threshold"):
            setattr(spec, key, None if row.get(key) is None else float(row[key]))
        spec.monitor_only = str(row.get("monitor_only") or "").lower() in ("true", "1", "t", "yes")
        specs.append(spec)
    return specs


#: The column of a filter's verdict.
FILTER = "_filter"


def day_tokens(text: str, today: dt.date) -> str:
    """${today} and ${yesterday}, with days added or taken away, as dates."""

    def put(m: re.Match) -> str:
        shift = int((m[2] or "0").replace(" ", ""))
        return f"DATE '{today + dt.timedelta(days=shift - (m[1].lower() == 'yesterday'))}'"

    return re.sub(r"\$\{\s*(today|yesterday)\s*([+-]\s*[0-9]+)?\s*\}", put, text, flags=re.IGNORECASE)


@contextmanager
def tolerant() -> Iterator[None]:
    """What is resolved inside gives NULL where a value can't be computed (a cast, a division by zero) instead of ending the query.

    Expressions keep the mode in which they were resolved, so that only those of the user are in this one.
    """
    conf = SparkSession.getActiveSession().conf
    before = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        conf.set("spark.sql.ansi.enabled", before)


def with_condition(df: DataFrame, name: str, text: str, today: dt.date) -> DataFrame:
    """df with the user's condition as a column."""
    with tolerant():
        return df.withColumn(name, checks.expression(day_tokens(text, today)).cast("boolean"))


def unevaluated(df: DataFrame, name: str, text: str) -> Column:
    """Whether the condition in column `name` could not be computed on a row.

    It is null where an input is null, and where a cast or an operation fails; where no column that its text names is null it
    failed. (A condition that makes a null of its own from such inputs counts as failed too.)
    """
    bare = re.sub(r"'(?:[^']|'')*'", "''", text).lower()
    named = [c for c in df.columns if c != name and re.search(rf"(?<![\w.]){re.escape(c.lower())}(?!\w)", bare)]
    return reduce(lambda a, b: a & b, (F.col(quoted(c)).isNotNull() for c in named), F.col(name).isNull())


def filtered(df: DataFrame, text: str, today: dt.date) -> DataFrame:
    return with_condition(df, FILTER, text, today).where(FILTER).drop(FILTER)


def _check(spec: Spec) -> None:
    if spec.problem:
        raise ValueError(spec.problem)
    if spec.check_type not in PARAMS:
        raise ValueError(f"unknown check type '{spec.check_type}'")
    known = {*PARAMS[spec.check_type], *(() if spec.check_type == "schema_check" else ("fail_on_empty",))}
    if unknown := sorted(set(spec.params) - known):
        raise ValueError(f"unknown params key(s): {', '.join(unknown)}")
    if spec.lower_threshold is not None and spec.upper_threshold is not None and spec.lower_threshold > spec.upper_threshold:
        raise ValueError("lower_threshold is above upper_threshold")
    if spec.identifier_column and spec.check_type not in WITH_IDENTIFIER:
        raise ValueError(f"identifier_column is not supported by {spec.check_type}")


def _need(spec: Spec, *keys: str) -> list:
    missing = [k for k in keys if (spec.column_name if k == "column_name" else spec.params.get(k)) in (None, "")]
    if missing:
        raise ValueError(f"{', '.join(missing)} must be given")
    return [spec.column_name if k == "column_name" else spec.params[k] for k in keys]


def _aggregate(spec: Spec, df: DataFrame, today: dt.date, condition: str = "") -> Column | None:
    """The value as one aggregate expression, for the types that have one. condition: the column of a compliance's expression."""
    share = lambda hit, among: F.try_divide(F.count(F.when(hit, 1)).cast("double"), F.count(among))
    kind = spec.check_type
    if kind == "volume":
        return F.count("*").cast("double")
    if kind == "duplicate_count":
        (names,) = _need(spec, "column_name")
        keys = F.struct(*(col(df, n).alias(f"k{i}") for i, n in enumerate(column_names(df, names))))
        return (F.count("*") - F.count_distinct(keys)).cast("double")
    if kind == "compliance":
        return share(F.col(condition), F.lit(1))
    if kind in ("null_rate", "distinct_count", "regex_match", "values_in_set", "agg", "freshness"):
        (name,) = _need(spec, "column_name")
        c = col(df, name)
        if kind == "null_rate":
            return F.coalesce(share(c.isNull(), F.lit(1)), F.lit(0.0))
        if kind == "distinct_count":
            return F.count_distinct(c).cast("double")
        if kind == "regex_match":
            return share(c.cast("string").rlike(checks.java_pattern(_need(spec, "pattern")[0])), c)
        if kind == "values_in_set":
            return share(c.cast("string").isin([str(v) for v in _need(spec, "allowed_values")[0]]), c)
        if kind == "agg":
            return checks.aggregate_value(df, name, _need(spec, "agg")[0])[0]
        text = str(spec.params.get("reference_time") or "")
        now = F.lit(text and day_tokens(text, today).removeprefix("DATE ").strip("'") or dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(" ")).cast("timestamp")
        return F.round((F.unix_micros(now) - F.unix_micros(F.max(moment(df, name)).cast("timestamp"))) / 1e6)
    return None


def _extras(spec: Spec, df: DataFrame, today: dt.date, condition: str = "") -> dict[str, Column]:
    """Further aggregates of a check that _aggregate has a value for; messages tell them."""
    n = lambda c: F.count(F.when(c, 1))
    kind = spec.check_type
    if kind == "compliance":
        return {"unevaluated": n(unevaluated(df, condition, day_tokens(spec.params["expression"], today)))}
    if kind == "freshness":
        c = col(df, spec.column_name)
        text = isinstance(df.schema[column_name(df, spec.column_name)].dataType, T.StringType)
        return {"skipped": n(c.isNotNull() & moment(df, spec.column_name).isNull())} if text else {}
    if kind == "agg":
        c, keyword = col(df, spec.column_name), spec.params["agg"].strip().lower()
        numbers = df.schema[column_name(df, spec.column_name)].dataType
        if isinstance(numbers, T.FloatType | T.DoubleType):
            return {"odd": n(c.isNotNull() & ~finite(c.cast("double")))}
        if is_exact(numbers) and keyword in ("min", "max", "sum"):
            wide = c.cast(f"decimal(38,{numbers.scale if isinstance(numbers, T.DecimalType) else 0})")
            return {"exact": {"min": F.min, "max": F.max, "sum": F.try_sum}[keyword](wide).cast("string")}
    return {}


def _samples(spec: Spec, df: DataFrame, key: list[Column]) -> DataFrame | None:
    """(identifier, samples) or (samples): the first offending values as text, for the types that show them."""
    by = ["identifier"] if key else []
    if spec.check_type == "values_in_set":
        value = col(df, spec.column_name).cast("string")
        texts = df.where(value.isNotNull() & ~value.isin([str(v) for v in spec.params["allowed_values"]])).select(*key, value.alias("t")).distinct()
    elif spec.check_type == "duplicate_count":
        names = column_names(df, spec.column_name)
        groups = df.groupBy(*key, *(col(df, n).alias(f"k{i}") for i, n in enumerate(names))).agg(F.count("*").alias("c")).where("c > 1")
        texts = groups.select(*by, checks.key_text([F.col(f"k{i}") for i in range(len(names))]).alias("t"))
    else:
        return None
    if not key:
        return texts.orderBy("t").limit(checks.SAMPLES).agg(F.array_sort(F.collect_list("t")).alias("samples"))
    nth = F.row_number().over(Window.partitionBy("identifier").orderBy("t"))
    return texts.withColumn("nth", nth).where(F.col("nth") <= checks.SAMPLES).groupBy("identifier").agg(F.array_sort(F.collect_list("t")).alias("samples"))


def _single(spec: Spec, df: DataFrame, whole: DataFrame, today: dt.date) -> tuple[DataFrame, Spec, list[Column]]:
    """(value) of one row for the other types, and what their message ends with. There low and high are bounds that the check
    computes, samples offending values, and ref the date judged."""
    p, kind = spec.params, spec.check_type
    ref = p.get("reference_date") and day_tokens(str(p["reference_date"]), today).removeprefix("DATE ").strip("'")
    if kind == "schema_check":
        columns = _need(spec, "columns")[0]
        columns = [c.strip() for c in (columns.split(",") if isinstance(columns, str) else columns)]
        there = {c.lower() for c in df.columns}
        missing = list({c.lower(): c for c in reversed(columns) if c.lower() not in there}.values())[::-1]
        missing = [c for k, c in enumerate(missing) if c.lower() not in {m.lower() for m in missing[:k]}]
        if spec.lower_threshold is None and spec.upper_threshold is None:
            spec.upper_threshold = 0.0
        note = "; missing columns: '" + "', '".join(missing) + "'" if missing else ""
        return SparkSession.getActiveSession().range(1).select(F.lit(float(len(missing))).alias("value")), spec, [F.lit(note)]
    if kind == "occurrence":
        out = checks.occurrence(df, _need(spec, "column_name")[0], p.get("mode", "max"), None, None)
        return out.select(F.col("occurrence").cast("double").alias("value")), spec, []
    if kind == "match_rate":
        right, right_keys = _need(spec, "right_table", "right_keys")
        out = checks.matched(df, relation(right), p.get("left_keys") or _need(spec, "column_name")[0], right_keys)
        nulls = F.when(F.col("null_keys") > 0, F.concat(F.lit("; "), F.col("null_keys").cast("string"), F.lit(" row(s) with a NULL key excluded"))).otherwise("")
        return out.select(F.when(F.col("total_count") > 0, F.col("match_rate")).alias("value"), "samples", "null_keys"), spec, [nulls]
    date = _need(spec, "date_column")[0]
    notes = []
    skipped = df.agg(F.count(F.when(col(df, date).isNotNull() & checks.day(df, date).isNull(), 1)).alias("skipped"))
    if isinstance(df.schema[column_name(df, date)].dataType, T.StringType):
        notes = [F.when(F.col("skipped") > 0, F.concat(F.lit("; "), F.col("skipped").cast("string"), F.lit(f" row(s) skipped ({date} is not a date)"))).otherwise("")]
    if kind == "rel_count_change":
        out = checks.rel_count_change(df, date, p.get("count_column"), int(p.get("window_days", 7)), None, None, ref, fill_missing_days=bool(p.get("fill_missing_days")))
        out = out.select(F.col("rel_change").alias("value"))
    elif kind == "rolling_values_in_set":
        # The default date is that of the whole table, whatever the filter.
        allowed, name = _need(spec, "allowed_values", "column_name")
        last = whole.agg(F.max(checks.day(whole, date)).alias("ref")) if not ref else None
        out = checks.rolling_values_in_set(df, name, allowed, date, int(p.get("window_days", 7)), 0.0, ref, refs=last)
        out = out.select(F.when(F.col("total_count") > 0, F.col("in_set_rate")).alias("value"))
    else:
        metric = p.get("metric_column") or spec.column_name
        if p.get("metric_column") and spec.column_name and p["metric_column"].lower() != spec.column_name.lower():
            raise ValueError(f"column_name '{spec.column_name}' and params.metric_column '{p['metric_column']}' name different columns; set only one")
        out = checks.metric_anomaly_iqr(df, date, metric, int(p.get("window_days", 30)), float(p.get("k", 1.5)), "both", ref)
        out = out.select(F.col("metric_value").alias("value"), F.col("lower_bound").alias("low"), F.col("upper_bound").alias("high"), F.col("reference_date").alias("ref"))
    return out.crossJoin(F.broadcast(skipped)), spec, notes


def _row(spec: Spec, there: set[str], identifier: Column, c=F.col, notes: list[Column] | None = None) -> Column:
    """A suite row as a struct. there: what is known besides value (low, high, samples, unevaluated, skipped, odd, exact, kept, total, ref);
    c gives the column of each."""
    value, fails = c("value"), "warn" if spec.monitor_only else "fail"
    low = c("low") if "low" in there else lit_double(spec.lower_threshold)
    high = c("high") if "high" in there else lit_double(spec.upper_threshold)
    text = lambda x: F.concat(number(x), F.lit(" seconds" if spec.check_type == "freshness" else ""))
    shown, low_text, high_text = text(value), text(low), text(high)
    if "exact" in there:
        scale = F.when(F.instr(c("exact"), ".") > 0, F.length(c("exact")) - F.instr(c("exact"), ".")).otherwise(0)
        shown, low_text, high_text = c("exact"), _plain(spec.lower_threshold, scale), _plain(spec.upper_threshold, scale)
    head = F.concat(F.lit(f"{spec.check_type} value "), shown)
    below, above = F.coalesce(value < low, F.lit(False)), F.coalesce(value > high, F.lit(False))
    null_status, null_message = "pass", F.lit(TRIVIAL)
    if spec.check_type == "freshness":
        null_status, null_message = fails, F.lit("No timestamp values found (table is empty or column is all NULL)")
        if "skipped" in there:
            null_message = F.when(c("skipped") > 0, "No timestamp values found").otherwise(null_message)
    on_empty = bool(spec.params.get("fail_on_empty"))
    if on_empty and "ref" in there and (spec.params.get("metric_column") or spec.column_name):
        null_status, null_message = fails, F.concat(F.lit("No metric value on "), c("ref").cast("string"), F.lit(" (fail_on_empty)"))
    samples = checks._quoted(c("samples")) if "samples" in there else F.lit("")
    nan = F.concat(F.lit(f"{spec.check_type} value is NaN: the column contains "), c("odd").cast("string"), F.lit(" NaN/Inf value(s)")) if "odd" in there else F.lit(f"{spec.check_type} value is NaN")
    status = F.when(value.isNull(), null_status).when(F.isnan(value) | below | above, fails).otherwise("pass")
    within = F.concat(head, F.lit(": no thresholds configured (monitor)" if "low" not in there and spec.lower_threshold is None and spec.upper_threshold is None else " is within thresholds"))
    message = (
        F.when(value.isNull(), null_message)
        .when(F.isnan(value), nan)
        .when(below, F.concat(head, F.lit(" violates thresholds ("), shown, F.lit(" < lower "), low_text, F.lit(")"), samples))
        .when(above, F.concat(head, F.lit(" violates thresholds ("), shown, F.lit(" > upper "), high_text, F.lit(")"), samples))
        .otherwise(within)
    )
    counted = lambda key, what: F.when(c(key) > 0, F.concat(F.lit("; "), c(key).cast("string"), F.lit(what))).otherwise("")
    ends = list(notes or [])
    if "unevaluated" in there:
        ends.append(counted("unevaluated", " row(s) could not be evaluated (counted as non-compliant)"))
    if spec.check_type == "freshness" and "skipped" in there:
        ends.append(counted("skipped", f" row(s) skipped ({spec.column_name} is not a timestamp)"))
    filtered_ = F.concat(F.lit("; filter matched "), c("kept").cast("string"), F.lit("/"), c("total").cast("string"), F.lit(" rows")) if "total" in there else F.lit("")
    message = F.concat(message, *ends, filtered_)
    if on_empty and "kept" in there:
        empty = c("kept") == 0
        none = F.concat(F.lit("No rows to evaluate: filter matched 0/"), c("total").cast("string"), F.lit(" rows (fail_on_empty)")) if "total" in there else F.lit(f"No rows to evaluate: table '{spec.table_name}' is empty (fail_on_empty)")
        value, status, message = F.when(~empty, value), F.when(empty, fails).otherwise(status), F.when(empty, none).otherwise(message)
    parts = {"check_name": F.lit(spec.check_name), "check_type": F.lit(spec.check_type), "table_name": F.lit(spec.table_name), "column_name": F.lit(spec.column_name).cast("string"), "identifier": identifier.cast("string"), "value": value, "lower_threshold": low, "upper_threshold": high, "status": status, "message": message}
    return F.struct(*(x.alias(k) for k, x in parts.items()))


def _plain(threshold: float | None, scale: Column) -> Column:
    """A threshold in decimal with as many places as the value shows at least."""
    if threshold is None:
        return F.lit(None).cast("string")
    digits = format(Decimal(repr(float(threshold))), "f")
    whole, _, part = digits.partition(".")
    part = part.rstrip("0")
    missing = F.greatest(scale - len(part), F.lit(0))
    return F.concat(F.lit(f"{whole}.{part}" if part else whole), F.when((F.lit(len(part)) == 0) & (missing > 0), ".").otherwise(""), F.repeat(F.lit("0"), missing))


def run_checks(table: Relation | list[dict], run_ts: dt.datetime | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row for each check, or for each value of its identifier column; by check_name and identifier, nulls last.

    tables: DataFrames by the names that the checks use; other names are tables and views of the session. Only the
    specifications are read when called; checks run when the result is.
    """
    there = tables or {}
    now = run_ts or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    spark, today = SparkSession.getActiveSession(), now.date()
    groups: dict[tuple, list[tuple[Spec, dict[str, Column], str]]] = {}
    conditions: dict[str, str] = {}
    frames, errors = [], []
    for spec in read_specs(table):
        try:
            _check(spec)
            df = whole = there.get(spec.table_name) or relation(spec.table_name)
            if spec.filter_expr:
                df = filtered(df, spec.filter_expr, today)
            condition = ""
            if spec.check_type == "compliance":
                condition = f"_condition{len(conditions)}"
                conditions[condition] = _need(spec, "expression")[0]
                df = with_condition(df, condition, conditions[condition], today)
            value = _aggregate(spec, df, today, condition)
            if value is None:
                single, spec, notes = _single(spec, df, whole, today)
                if spec.check_type != "schema_check":
                    single = single.crossJoin(F.broadcast(_counts(whole, spec, today)))
                frame = single.select(_row(spec, set(single.columns), F.lit(None), notes=notes).alias("r")).select("r.*")
                frame.schema  # noqa: B018  analysis happens here
                frames.append(frame)
            else:
                found = {"value": value} | _extras(spec, df, today, condition)
                df.agg(*found.values()).schema  # noqa: B018
                if spec.identifier_column:
                    col(df, spec.identifier_column)
                groups.setdefault((spec.table_name, spec.filter_expr, spec.identifier_column), []).append((spec, found, condition))
        except Exception as e:
            cause = str(e).split("\n")[0]
            bad = (now, spec.check_name, spec.check_type, spec.table_name, spec.column_name, None, None, spec.lower_threshold, spec.upper_threshold, "error", f"check '{spec.check_name}' ({spec.check_type}) cannot run: {cause}")
            errors.append(bad)
    for (name, condition, identifier), members in groups.items():
        whole = df = there.get(name) or relation(name)
        if condition:
            df = filtered(df, condition, today)
        for spec, _, made in members:
            if made:
                df = with_condition(df, made, conditions[made], today)
        key = [col(df, identifier).cast("string").alias("identifier")] if identifier else []
        out = df.groupBy(*key).agg(F.count("*").alias("kept"), *(v.alias(f"v{k}_{n}") for k, (_, found, _) in enumerate(members) for n, v in found.items()))
        shared = {"kept"}
        if condition:
            # Of all rows, the filtered ones too; identifiers without any left are told below.
            total = whole.groupBy(*([col(whole, identifier).cast("string").alias("whose")] if identifier else [])).agg(F.count("*").alias("total"))
            out = out.join(total, F.col("identifier").eqNullSafe(F.col("whose")), "left").drop("whose") if identifier else out.crossJoin(F.broadcast(total))
            shared.add("total")
        columns = {}
        for k, (spec, found, _) in enumerate(members):
            columns[k] = {n: f"v{k}_{n}" for n in found} | {n: n for n in shared}
            some = _samples(spec, df, key)
            if some is not None:
                some = some.withColumnRenamed("samples", f"v{k}_samples")
                out = out.join(some.withColumnRenamed("identifier", "whose"), F.col("identifier").eqNullSafe(F.col("whose")), "left").drop("whose") if identifier else out.crossJoin(F.broadcast(some))
                columns[k]["samples"] = f"v{k}_samples"
        rows = F.array(*(_row(s, set(columns[k]), F.col("identifier") if identifier else F.lit(None), lambda n, k=k: F.col(columns[k][n])) for k, (s, _, _) in enumerate(members)))
        frames.append(out.select(F.explode(rows).alias("r")).select("r.*"))
        told = [s for s, _, _ in members if identifier and (condition or s.params.get("fail_on_empty"))]
        if told:
            # Without a row left there is no identifier: one row says so.
            counts = _counts(whole, told[0], today).where("kept = 0")
            nothing = {"value": F.lit(None).cast("double"), "skipped": F.lit(0), "unevaluated": F.lit(0)}
            none = F.array(*(_row(s, {"kept", *(["total"] if condition else [])}, F.lit(None), lambda n: nothing.get(n, F.col(n))) for s in told))
            frames.append(counts.select(F.explode(none).alias("r")).select("r.*"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    frames = [f.select(F.lit(now).cast("timestamp").alias("run_ts"), *names[1:]) for f in frames]
    frames.append(spark.createDataFrame(errors, SCHEMA))
    return reduce(DataFrame.unionByName, frames).orderBy("check_name", F.col("identifier").asc_nulls_last())


def _counts(whole: DataFrame, spec: Spec, today: dt.date) -> DataFrame:
    """One row: kept, the rows that are looked at, and with a filter total, all rows."""
    if not spec.filter_expr:
        return whole.agg(F.count("*").alias("kept"))
    return with_condition(whole, FILTER, spec.filter_expr, today).agg(F.count(F.when(F.col(FILTER), 1)).alias("kept"), F.count("*").alias("total"))


def define_checks(rows: list[dict]) -> DataFrame:
    """A checks table from dicts."""
    kinds = "check_name string, check_type string, table_name string, column_name string, params string, lower_threshold double, upper_threshold double, monitor_only boolean, identifier_column string, filter_expr string"
    keys = [x.split()[0] for x in kinds.split(", ")]
    made = [[json.dumps(r[k]) if k == "params" and isinstance(r.get(k), dict) else float(r[k]) if k.endswith("threshold") and r.get(k) is not None else r.get(k) for k in keys] for r in rows]
    return SparkSession.getActiveSession().createDataFrame(made, kinds)
