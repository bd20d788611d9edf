"""Relations from files, by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV and TSV with a header, JSON (one document) and NDJSON."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if suffix == "tsv" else ",", quote='"', escape='"', multiLine=True)
    if suffix in ("json", "ndjson"):
        return spark.read.json(path, multiLine=suffix == "json")
    raise ValueError(f"no reader for the suffix '{suffix}'")
