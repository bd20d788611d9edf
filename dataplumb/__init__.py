"""dataplumb: data-quality checks, diffs, profiles, anomaly detection and cleaning on Spark DataFrames."""

__version__ = "0.1.0"
