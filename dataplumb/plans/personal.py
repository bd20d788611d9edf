"""Queries of the personal-data functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._tables import spread
from ..functions import pii
from .checks import table


def pii_addresses(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(pii.pii_detect(F.col("text"), "IP_ADDRESS")).cast("long").alias("n"))


def pii_scan(spark, sf_dir):
    return pii.pii_scan_table(table(spark, sf_dir, "documents").select("text", "lang", "n_chars"))


def pii_masked(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2(pii.pii_mask(F.col("text"), "partial"), 256).alias("digest"))


QUERIES = {"pii_scan": pii_scan, "pii_masked": pii_masked, "pii_addresses": pii_addresses}
ORACLES: dict[str, str] = {}
