"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of all words by its weight, at most `most` times its own words; what is above goes to the
others by weight. A source whose target is f times its words is taken floor(f) times as a whole (the certain copies).
For the rest each document has a random number u and an inclusion probability p whose odds are proportional to its
words, and documents are ranked by the random odds u / (1 - u) over the inclusion odds p / (1 - p): a fixed-size sample
of unequal probabilities, which here is filled in that order to the rest of the target, in words.

Only DataFrame functions are used. The place where a source's sample ends is found by two histograms of at most
BUCKETS counts for each source and a window over the documents of one cell, 1 in BUCKETS ** 2 of the source, so that a
source with a third of all rows is never in one task. What is joined to documents has a row for each source.

Nulls: a null text has 0 words, a null source is a source of its own (the last one), a null doc_id hashes as "".
Other columns pass through, whatever their names. Documents without words are never taken. Repeated rows have one rank and go together. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, columns, drop_stored, small, stored

BUCKETS = 4096
MOST = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(doc_id: Column, seed: str = "") -> Column:
    """In (0, 1), from 52 bits of the md5 of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source of sizes(source, size): source_size, n_docs (with words), target, whole, rest, mean."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_docs"))
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("cap_rate", F.col("source").asc_nulls_last())
    per = per.withColumn("nth", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("cap_rate", F.col("cap").cast("double") / F.col("weight"))
    every = Window.partitionBy()
    # In the order of cap / weight: words for each unit of weight if all before this source are at their caps.
    per = per.withColumn("place", F.row_number().over(by_cap)).withColumn(
        "rate",
        (F.sum("source_size").over(every) - F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap")).cast("double")
        / (F.sum("weight").over(every) - F.sum("weight").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")),
    )
    per = per.withColumn("rate", F.min_by(F.when(F.col("rate") <= F.col("cap_rate"), F.col("rate")), F.when(F.col("rate") <= F.col("cap_rate"), F.col("place"))).over(every))
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("rate", F.lit(0.0)) * F.col("weight")))
    per = per.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    per = per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return per.select("source", "source_size", "target", "whole", "rest", F.try_divide("source_size", "n_docs").alias("mean"))


def _rank(table: DataFrame, seed: str) -> DataFrame:
    """With q, the random odds over the inclusion odds (null: can't be taken), and its cells of two levels."""
    u, share = uniform(F.col("doc_id"), seed), F.col("rest") / F.col("source_size")
    q = F.when((F.col("size") > 0) & (F.col("rest") > 0), u / (1 - u) / (share / (1 - share) * (F.col("size") / F.col("mean"))))
    table = table.withColumn("q", q)
    place = F.col("q") / (F.col("q") + 1) * BUCKETS
    return table.withColumn("cell", F.floor(place)).withColumn("part", F.floor((place - F.floor(place)) * BUCKETS))


def _end(cells: DataFrame, cell: str) -> DataFrame:
    """For each source the cell in which its words reach the rest, and the words of the cells before."""
    run = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    ran = cells.withColumn("upto", F.col("done") + F.sum("words").over(run))
    ran = ran.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    return ran.select("source", cell, (F.col("upto") - F.col("words")).alias("done"))


MADE = ("size", "source_size", "target", "copies", "taken")


def _mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "") -> DataFrame:
    """What MADE names for each row of docs, and row: all its columns, out of the way of other names."""
    docs = docs.select("doc_id", "source", "text", F.struct(*columns(docs)).alias("row"))
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    sources = stored(source_targets(sizes, weights, most).coalesce(1), "sources")

    def with_sources(table: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return table.join(small(right), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")

    ranked = _rank(with_sources(sizes, sources), seed).where("q is not null")
    cells = ranked.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.lit(0).cast("long").alias("done"))
    ends = stored(_end(cells, "cell"), "ends")
    inner = with_sources(ranked, ends.withColumnRenamed("cell", "end_cell")).where("cell = end_cell")
    cells = inner.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("done").alias("done"))
    parts = stored(_end(cells, "part").withColumnsRenamed({"part": "end_part", "done": "part_done"}), "parts")
    inner = with_sources(inner, parts).where("part = end_part")
    upto = F.col("part_done") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "doc_id"))
    last = inner.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
    last = stored(last.groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("last")), "last")
    # Up to which (q, doc_id) each source takes one more copy: the last one of its end cell or, if none is, all before it.
    cuts = sources
    for right in (ends.select("source", "cell"), parts.select("source", "end_part"), last):
        cuts = with_sources(cuts, right, "left").withColumnRenamed("cell", "end_cell")
    cuts = stored(cuts.coalesce(1), "cuts")
    drop_stored(sizes, sources, ends, parts, last)

    out = docs.withColumn("size", n_words(F.col("text")))
    out = _rank(with_sources(out, cuts), seed)
    before = (F.col("cell") < F.col("end_cell")) | ((F.col("cell") == F.col("end_cell")) & (F.col("part") < F.col("end_part")))
    same = (F.col("cell") == F.col("end_cell")) & (F.col("part") == F.col("end_part")) & (F.struct("q", "doc_id") <= F.col("last"))
    # Without an end the rest takes all (it is all words, or none has words).
    more = F.col("q").isNotNull() & (F.col("end_cell").isNull() | before | F.coalesce(same, F.lit(False)))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select("row", *MADE)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, source, text and any others) with size, source_size, target, copies and taken (copies * size).

    Columns of these names in docs are replaced. No document has more than `most` copies; reruns agree.
    """
    docs = docs.drop(*MADE)
    return _mix(docs, **options).select(*(F.col("row")[c].alias(c) for c in docs.columns), *MADE)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, in docs' columns."""
    out = _mix(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))
