"""Tables in the shared folder, and connected components by them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges that the driver follows at most; more are followed in Spark.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session without it a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if (current := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            return current.get()
        found = f"file://{tempfile.mkdtemp(prefix='dataplumb-')}"
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows dealt evenly or by keys over tasks, a few for each core: for work by row that costs more than reading.

    A file's row group is read by one task, and a table of short rows may be few row groups whatever its length.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries in here delete their shuffle files at their end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: computed once, without lineage, and it outlives executors."""
    path = fresh_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(conf).delete(path, True)


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and of each the smallest one reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        p, q = least[x], least[y]
        if (p == q).all():
            return nodes, nodes[least]
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while (least != least[least]).any():
            least = least[least]


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Connected components of edges (a, b), as (node, component) with the smallest node of each.

    The driver follows up to `few` edges of whole numbers itself: rounds of jobs over little rows cost it more memory
    and time. Of more edges, alternating large and small stars: each round replaces edges by edges to smallest neighbours, and rounds grow with
    the logarithm of the longest path. Every round is two aggregations with partial sums and two joins, which Spark can
    split where a node is hot; nothing is gathered in one task or on the driver but two counters a round then.
    Loops and nulls are dropped; without edges the result is empty.
    """
    kind = edges.schema["a"].dataType
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    with tidy(edges.sparkSession):
        some = now.toArrow() if isinstance(kind, T.IntegralType) and now.count() <= few else None
    if some is not None:
        nodes = pa.table(dict(zip(("node", "component"), least_reached(*(some[k].to_numpy() for k in "uv")), strict=True)))
        out = stored(edges.sparkSession.createDataFrame(nodes, T.StructType([T.StructField(c, kind) for c in nodes.column_names])), "components")
        drop_stored(now)
        return out
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every node with its smaller neighbours, all linked to the smallest of them.
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(after, "edges")
        # A forest of stars is stable: nothing on the right stands on the left too, and each left node stands once.
        with tidy(edges.sparkSession):
            state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_stored(now)
        now = after
        if state == before or not state["n"]:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.union(now.select("v", F.col("v").alias("w")).distinct()).select(F.col("node").cast(kind), F.col("component").cast(kind))
    out._stored_path = now._stored_path
    return out
