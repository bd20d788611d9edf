"""pytest plugin: with --dq-check, tests marked dq_quality(table, volume_min=..., null_max=..., column=...) first check a table.

Switch it on by `pytest -p dataplumb.pytest_plugin`.
"""

from __future__ import annotations

import pytest


def pytest_addoption(parser: pytest.Parser) -> None:
    parser.addoption("--dq-check", action="store_true", default=False, help="run the checks of marked tests")


def pytest_configure(config: pytest.Config) -> None:
    config.addinivalue_line("markers", "dq_quality(table, **rules): check a table before the test: volume_min=N, null_max=F with column=C")


@pytest.fixture(scope="session")
def dq():
    from .session import Session

    return Session()


def failures(table, volume_min: int | None = None, null_max: float | None = None, column: str | None = None) -> list[str]:
    """Messages of the checks that fail."""
    from .session import Session

    rules = {}
    if volume_min is not None:
        rules["volume"] = {"min_rows": volume_min}
    if null_max is not None:
        rules["null_rate"] = {"column": column, "max_null_rate": null_max}
    found = Session().quality_check(table, rules)
    return [f"{name}: {row['message']}" for name, row in found.checks.items() if row["status"] != "pass"]


def pytest_runtest_setup(item: pytest.Item) -> None:
    if item.config.getoption("--dq-check"):
        for mark in item.iter_markers("dq_quality"):
            if bad := failures(*mark.args, **mark.kwargs):
                pytest.fail("; ".join(bad), pytrace=False)
