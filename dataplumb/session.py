"""Checks and profiles of frames from elsewhere, and table functions inside SQL text.

    dq = Session(spark)
    dq.quality_check(frame, {"volume": {"min_rows": 100}, "null_rate": {"column": "email"}}).status
    dq.sql("SELECT status FROM null_rate('orders', 'o_custkey', 0.01)")
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .functions import pii
from .operators import anomaly, checks, diff, profile, suite
from .operators.outlier_tree import outlier_tree

#: Functions that sql() knows, with the names that SQL calls them by.
TABLE_FUNCTIONS = {
    **{f.__name__: f for f in (checks.volume, checks.null_rate, checks.distinct_count, checks.schema_check, checks.freshness, checks.zscore, checks.iqr, checks.regex_match, checks.values_in_set, checks.agg_check, checks.duplicate_count, checks.occurrence, checks.match_rate, checks.compliance)},
    **{f.__name__: f for f in (checks.rel_count_change, checks.metric_anomaly_iqr, checks.rolling_values_in_set, checks.rel_count_change_events, checks.metric_anomaly_iqr_events, checks.rolling_values_in_set_events)},
    "diff_joindiff": diff.joindiff, "diff_hashdiff": diff.hashdiff, "diff_schema": diff.schema_diff, "run_checks": suite.run_checks,
    "profile_table": profile.profile_table, "profile_summary": profile.profile_summary, "profile_correlations": profile.profile_correlations,
    "dbscan": anomaly.dbscan, "dbscan_mv": anomaly.dbscan_mv, "isolation_forest": anomaly.isolation_forest, "isolation_forest_mv": anomaly.isolation_forest_mv, "outlier_tree": outlier_tree,
    "pii_scan_table": pii.pii_scan_table, "pii_audit_table": pii.pii_audit_table,
}
#: The checks of quality_check and what each takes.
RULES = {"volume": {"min_rows", "max_rows"}, "null_rate": {"column", "max_null_rate"}, "distinct_count": {"column", "min_distinct", "max_distinct"}}
_CALL = re.compile(r"\b(from|join)\s+(" + "|".join(sorted(TABLE_FUNCTIONS, key=len, reverse=True)) + r")\s*\(", re.IGNORECASE)


@dataclass(frozen=True)
class QualityResult:
    """status is "pass" if every check passes; checks has the row of each by name."""

    status: str
    checks: dict[str, dict] = field(default_factory=dict)

    def __getitem__(self, key: str) -> Any:
        return getattr(self, key)


@dataclass(frozen=True)
class ValidationResult:
    """errors: what of a frame isn't as its schema says."""

    valid: bool
    errors: list[str] = field(default_factory=list)


class Session:
    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()

    def frame(self, data: Any) -> DataFrame:
        """A DataFrame as it is; pandas and polars frames, Arrow tables, and tables by name."""
        if isinstance(data, DataFrame):
            return data
        if isinstance(data, str):
            return self.spark.table(data)
        if hasattr(data, "to_arrow"):  # polars
            data = data.to_arrow()
        if hasattr(data, "to_batches") or hasattr(data, "iloc"):  # Arrow, pandas
            return self.spark.createDataFrame(data)
        raise TypeError(f"no frame: {type(data).__name__}")

    def profile(self, data: Any, **options) -> DataFrame:
        return profile.profile_table(self.frame(data), **options)

    def validate(self, data: Any, schema: dict[str, str]) -> ValidationResult:
        """Whether the columns of schema (name: type) are there with these types; others don't matter."""
        there = {f.name.lower(): f.dataType for f in self.frame(data).schema}
        errors = []
        for name, kind in schema.items():
            want, found = T._parse_datatype_string(kind), there.get(name.lower())
            if found is None:
                errors.append(f"column '{name}' is missing")
            elif found != want:
                errors.append(f"column '{name}' is {found.simpleString()}, not {want.simpleString()}")
        return ValidationResult(not errors, errors)

    def quality_check(self, data: Any, rules: dict[str, dict]) -> QualityResult:
        if unknown := [r for r in rules if r not in RULES]:
            raise ValueError(f"unknown rule(s): {', '.join(unknown)}; supported: {', '.join(RULES)}")
        for name, p in rules.items():
            if not isinstance(p, dict) or set(p) - RULES[name] or ("column" in RULES[name] and not p.get("column")):
                raise ValueError(f"{name} takes {', '.join(sorted(RULES[name]))}, a column where it has one")
        df, found = self.frame(data), {}
        for name, p in rules.items():
            if name == "volume":
                out = checks.volume(df, p.get("min_rows", 1), p.get("max_rows"))
            elif name == "null_rate":
                out = checks.null_rate(df, p["column"], p.get("max_null_rate", 0.0))
            else:
                out = checks.distinct_count(df, p["column"], p.get("min_distinct", 1), p.get("max_distinct"))
            found[name] = out.first().asDict(recursive=True)
        return QualityResult("pass" if all(r["status"] == "pass" for r in found.values()) else "fail", found)

    def sql(self, text: str) -> DataFrame:
        """SQL in which table functions of this package stand behind FROM and JOIN, with literal arguments."""
        views = []
        while m := _CALL.search(text):
            end = _closing(text, m.end() - 1)
            args, named = _arguments(text[m.end() : end])
            name = f"_dq_{len(views)}_{abs(hash(text)) % 10**8}"
            TABLE_FUNCTIONS[m[2].lower()](*args, **named).createOrReplaceTempView(name)
            views.append(name)
            text = f"{text[: m.start()]}{m[1]} {name}{text[end + 1 :]}"
        try:
            return self.spark.sql(text)
        finally:
            for name in views:
                self.spark.catalog.dropTempView(name)


def _closing(text: str, at: int) -> int:
    depth, quote = 0, False
    for k in range(at, len(text)):
        if text[k] == "'":
            quote = not quote
        elif not quote:
            depth += (text[k] in "([") - (text[k] in ")]")
            if not depth:
                return k
    raise ValueError("a parenthesis isn't closed")


def _arguments(text: str) -> tuple[list, dict]:
    """Literals: numbers, texts in single quotes, TRUE, FALSE, NULL and lists of these; name := value for named ones."""
    parts, depth, quote, begin = [], 0, False, 0
    for k, c in enumerate(text):
        if c == "'":
            quote = not quote
        elif not quote:
            depth += (c in "[(") - (c in "])")
            if c == "," and not depth:
                parts.append(text[begin:k])
                begin = k + 1
    parts.append(text[begin:])
    args, named = [], {}
    for part in (p.strip() for p in parts):
        m = re.match(r"(\w+)\s*(?::=|=>)\s*(.+)\Z", part, re.DOTALL)
        if m:
            named[m[1].lower()] = _literal(m[2])
        elif part:
            args.append(_literal(part))
    return args, named


def _literal(text: str) -> Any:
    quoted: list[str] = []
    bare = re.sub(r"'(?:[^']|'')*'", lambda m: quoted.append(m[0][1:-1].replace("''", "'")) or f"\0{len(quoted) - 1}\0", text)
    bare = re.sub(r"\b(true|false|null)\b", lambda m: {"true": "True", "false": "False", "null": "None"}[m[0].lower()], bare, flags=re.IGNORECASE)
    return ast.literal_eval(re.sub("\0([0-9]+)\0", lambda m: repr(quoted[int(m[1])]), bare.strip()))
