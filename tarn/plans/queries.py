"""All registered queries of the library's own operators."""

from __future__ import annotations

from tarn.plans import audits, catalog, graphs, maintenance, prescriptions, readers, records, sections, texts  # noqa: F401
from tarn.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
