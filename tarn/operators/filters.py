"""Predicates over nested records. Each says which way a missing value falls; rows are never lost by an unnoticed null."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import fold
from tarn.session import light


def not_equal(x: Column, value) -> Column:
    """Different from a value, or missing."""
    return ~x.eqNullSafe(F.lit(value))


def present(x: Column) -> Column:
    """Neither missing nor an empty text."""
    return x.isNotNull() & (x != "")


def every(*conditions: Column | None) -> Column:
    """All of the conditions given; those that are None were not asked for."""
    asked = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, asked) if asked else F.lit(True)


def some(*conditions: Column | None) -> Column:
    asked = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, asked) if asked else F.lit(True)


def has_token(x: Column, token: str, mark: str = ";") -> Column:
    """Whether a delimited list holds a token whole."""
    return F.array_contains(F.split(x, re.escape(mark)), token)


def any_has_token(xs: Column, token: str, mark: str = ";") -> Column:
    return F.exists(xs, lambda x: has_token(x, token, mark))


def contains_literal(x: Column, text: str) -> Column:
    """Case-blind containment; the text is no pattern."""
    return F.contains(F.lower(x), F.lit(text.lower()))


def matches(x: Column, pattern: str) -> Column:
    """Case-blind search; the text is a pattern."""
    return x.rlike(f"(?i){pattern}")


def cites(x: Column, term: str) -> Column:
    """A whole word of folded text, with a plural s or without."""
    return fold(x).rlike(rf"\b{re.escape(term)}s?\b")


def in_one_segment(x: Column, expression: str) -> Column:
    """All words of an expression begin words of one and the same clause."""
    words = [w for w in expression.split() if w]
    return F.exists(F.split(fold(x), r"[,;.\n]+"), lambda s: every(*[s.rlike(rf"\b{re.escape(w)}") for w in words]))


def bucket(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step that a value reaches; missing values take the rest."""
    out = F.when(x >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(x >= least, name)
    return out.otherwise(rest)


def first_reason(*reasons: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds, null if none does; an unknown condition doesn't reject."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in reasons], F.lit(None).cast("string"))


def split_kept(df: DataFrame, reason: Column, stage: str) -> DataFrame:
    """Adds reject_reason and reject_stage; no row goes. A row rejected before keeps its first reason."""
    had = "reject_reason" in df.columns
    why = F.coalesce("reject_reason", reason) if had else reason
    at = F.when(F.col("reject_reason").isNotNull(), F.col("reject_stage")).when(reason.isNotNull(), F.lit(stage)) if had else F.when(reason.isNotNull(), F.lit(stage))
    return df.withColumns({"reject_stage": at, "reject_reason": why})


def first_crossed(measures: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Of each rule's ordered conditions (rule, place, measure, least), the first that a row's measures cross. measures: (keys, measure, value)."""
    met = measures.join(light(rules), "measure").where(F.col("value") >= F.col("least"))
    first = met.groupBy(*keys, "rule").agg(F.min(F.struct("place", "measure", "value", "least")).alias("__f"))
    return first.select(*keys, "rule", "__f.*")


def divergence(found: Column, other: Column, broken: str, least: int = 6) -> Column:
    """A title that a pattern calls broken, that is short, or that differs in white space only was extracted badly; else the source changed."""
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return F.when(found.rlike(broken) | (F.length(found) < least) | (bare(found) == bare(other)), "extraction fault").otherwise("changed source")


def visible(df: DataFrame, roles: str, role: str | None, published: str) -> DataFrame:
    """Published rows whose list of roles has the role, or `all`; without a role those for all only."""
    seen = F.array_contains(roles, "all")
    return df.where(F.col(published) & (seen | F.array_contains(roles, role) if role else seen))


def earliest(x: Column, markers: dict[str, tuple[str, ...]], none: str) -> Column:
    """The name whose marker comes first in a text; equals by the order given."""
    at = [F.struct(F.instr(x, w).alias("at"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, words) in enumerate(markers.items()) for w in words]
    return F.coalesce(F.array_min(F.filter(F.array(*at), lambda a: a["at"] > 0))["k"], F.lit(none))


def phrase_or_words(x: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(level, how): the level of the first rule whose phrase a text contains; only where no phrase is contained, that of the first rule all of whose words are."""
    first = lambda holds: F.coalesce(*[F.when(holds(phrase), level) for phrase, level in rules])
    whole = first(lambda p: F.contains(x, F.lit(p)))
    loose = first(lambda p: every(*[F.contains(x, F.lit(w)) for w in p.split()]))
    return F.coalesce(whole, loose), F.when(whole.isNotNull(), "phrase").when(loose.isNotNull(), "words")
