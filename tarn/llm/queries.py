"""The queries of this package: opN_<name> for each operator, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from tarn.llm import bpe, crf, jaccard, langid, licenses, mixing, neardup, pii, quality, repeats, spelling, urlfilter, whitening

MODULES = [quality, bpe, urlfilter, langid, licenses, jaccard, neardup, pii, mixing, crf, spelling, repeats, whitening]


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
