"""What the operators share: names, tables in the shared folder, connected components."""

from __future__ import annotations

import functools
import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._base import quoted
from .._tables import components, drop_stored, fresh_path, shared_dir, stored, tidy

__all__ = ["WORD", "columns", "components", "documents", "drop_stored", "fresh", "fresh_path", "pieces", "release", "shared_dir", "small", "stored", "tidy", "with_group"]

#: A word: a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does when their handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def columns(df: DataFrame) -> list[Column]:
    """df's own columns, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that none of df's columns has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def pieces(text: Column, chars: int, parts: int = 10) -> Column:
    """A text of at most so many characters as it is; of a longer one as many in all, in pieces from all over it with spaces between."""
    size = chars // parts
    step = (F.length(text) - size) / (parts - 1)
    some = F.concat_ws(" ", *(F.substring(text, F.floor(step * k).cast("int") + 1, F.lit(size)) for k in range(parts)))
    return F.when(F.length(text) > chars, some).otherwise(text)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else Spark chooses another join."""
    with tidy(df.sparkSession):
        few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def with_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str = "n", most: int = 1024) -> DataFrame:
    """rows with the columns of their group (a row for each value of keys, nulls equal), if there is one.

    Groups of more than one row in `most` (by weight) are at most `most` and are broadcast, so that no hot key
    meets a shuffle; of the others Spark gets all if they are few, else it joins as it sees fit.
    """
    with tidy(rows.sparkSession):
        total = groups.agg(F.sum(weight)).first()[0] or 0
    others = [c for c in groups.columns if c not in (*keys, weight)]
    both = groups.select(*(F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)), F.struct(*others).alias("found_"), weight)
    hot = F.col(weight) * most > total

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        same = functools.reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"k_{i}"]) for i, k in enumerate(keys)])
        return left.join(right.drop(weight), same, "left").drop(*(f"k_{i}" for i in range(len(keys))))

    first = joined(rows, F.broadcast(both.where(hot)))
    there = first.where(F.col("found_").isNotNull())
    rest = joined(first.where(F.col("found_").isNull()).drop("found_"), small(both.where(~hot)))
    return there.unionByName(rest).select(*rows.columns, *(F.col("found_")[c].alias(c) for c in others))
