"""Settings as an immutable value, and as tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

CONTRACT_VERSION = "1"


@dataclass(frozen=True)
class Config:
    email_default_validation: str = "regex"
    email_regex_pattern: str = ""
    email_dns_timeout_ms: int = 1000
    email_dns_tries: int = 1
    email_smtp_port: int = 25
    email_smtp_connect_timeout_ms: int = 5000
    email_smtp_read_timeout_ms: int = 5000
    email_smtp_helo_domain: str = "localhost"
    email_smtp_mail_from: str = ""
    phone_default_region: str = "US"
    postal_data_path: str = ""
    postal_auto_download: bool = False
    trace_enabled: bool = False
    trace_level: str = "info"
    pii_enabled_types: tuple[str, ...] = ()
    pii_min_confidence: float = 0.5
    pii_default_mask_strategy: str = "redact"
    pii_deep_validation: bool = False
    pii_require_checksum: bool = True
    ner_auto_download: bool = False
    ner_model: str = "none"
    ner_device: str = "cpu"
    ner_cache_size: int = 10000
    ner_required: bool = False


#: Settings of a session: dataplumb.<name> in its configuration, lists with commas between.
PREFIX = "dataplumb."


def active(spark: SparkSession | None = None) -> Config:
    """The defaults with what the session sets; functions that aren't given a Config use this one when they are called."""
    spark = spark or SparkSession.getActiveSession()
    found = {}
    for f in fields(Config):
        text = spark.conf.get(PREFIX + f.name, None) if spark else None
        if text is not None:
            found[f.name] = _read(f.name, f.default, text)
    return checked(Config(**found))


def _read(name: str, default, text: str):
    if isinstance(default, bool):
        if text.strip().lower() not in ("true", "false"):
            raise ValueError(f"{name} must be true or false")
        return text.strip().lower() == "true"
    if isinstance(default, tuple):
        return tuple(t.strip().upper() for t in text.split(",") if t.strip())
    return type(default)(text)


def checked(config: Config) -> Config:
    """config with types by their full names; values that no function takes are errors."""
    from .functions.phone import REGIONS
    from .functions.pii import ALIASES, STRATEGIES, TYPES

    types = tuple(ALIASES.get(t, t) for t in config.pii_enabled_types)
    if unknown := [t for t in types if t not in TYPES]:
        raise ValueError(f"pii_enabled_types: unknown type(s) {', '.join(unknown)}")
    if not 0 <= config.pii_min_confidence <= 1:
        raise ValueError("pii_min_confidence must be between 0 and 1")
    if config.pii_default_mask_strategy.lower() not in STRATEGIES:
        raise ValueError(f"pii_default_mask_strategy must be one of {', '.join(STRATEGIES)}")
    if config.phone_default_region.upper() not in REGIONS:
        raise ValueError(f"phone_default_region: unsupported region '{config.phone_default_region}'")
    return replace(config, pii_enabled_types=types, phone_default_region=config.phone_default_region.upper())


def _table(prefix: str, config: Config) -> DataFrame:
    rows = [(f.name, str(getattr(config, f.name))) for f in fields(config) if f.name.startswith(prefix)]
    return SparkSession.getActiveSession().createDataFrame(rows, "setting string, value string")


def email_config(config: Config | None = None) -> DataFrame:
    return _table("email_", config or active())


def pii_config(config: Config | None = None) -> DataFrame:
    return _table("pii_", config or active())


def pii_status() -> DataFrame:
    """The types that are looked for."""
    from .functions.pii import TYPES

    return SparkSession.getActiveSession().createDataFrame([(t, "available") for t in TYPES], "pii_type string, status string")


def phonenumber_status() -> DataFrame:
    from .functions.phone import REGIONS

    return SparkSession.getActiveSession().createDataFrame([("reduced", len(REGIONS))], "metadata string, regions int")


def ner_status() -> DataFrame:
    return SparkSession.getActiveSession().createDataFrame([("none", "NOT_AVAILABLE")], "model string, status string")


def set_trace(config: Config = Config()) -> None:
    """The package's logging, as trace_enabled and trace_level say."""
    logger = logging.getLogger("dataplumb")
    logger.setLevel(config.trace_level.upper() if config.trace_enabled else logging.WARNING)


def contract_version() -> str:
    return CONTRACT_VERSION
