"""Search that forgives spelling: elastic and scattered patterns over titles by a table of letters, and a fuzzy supplement to hits found otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.fuzzy import fuzzy_in, plain_full
from tarn.functions.text import plain

#: Characters that may stand between two of an elastic pattern; length of a part that is looked for scattered; similarity of a candidate; what a similarity counts, and the score that it needs.
BETWEEN, LEAST_PART, SIMILAR, WEIGHT, FLOOR = 2, 3, 0.6, 0.8, 0.15


def letters(x: Column) -> Column:
    """The letters and digits of a text, each with how often it has come before: 'aab' has a1, a2 and b1."""
    own = F.array_sort(F.filter(F.split(F.lower(x), ""), lambda c: c.rlike(r"[\p{L}\p{N}]")))
    return F.transform(own, lambda c, i: F.concat(c, (i + 2 - F.array_position(own, c)).cast("string")))


def postings(titles: DataFrame, key: str, title: str) -> DataFrame:
    """(gram, key): the table that candidates come from: letters with their number, and whole folded words behind a space."""
    words = F.transform(F.array_distinct(F.split(plain(F.col(title)), " ")), lambda w: F.concat(F.lit(" "), w))
    return titles.where(F.col(title).isNotNull()).select(key, F.explode(F.concat(letters(F.col(title)), words)).alias("gram"))


def wanted(query: str) -> list[tuple[str | None, list[str]]]:
    """The ways in which a query may be met, as a pattern and the grams that a title then has: all its letters in order with few between; the letters of one of its longer words in
    order with any between; one of its words as it is (which needs no pattern)."""
    q = plain_full(query)

    def counted(text: str) -> list[str]:
        own = sorted(text)
        return [f"{c}{i + 1 - own.index(c)}" for i, c in enumerate(own)]

    whole = [c for c in q if c.isalnum()]
    ways = [(rf".{{0,{BETWEEN}}}".join(whole), counted("".join(whole)))] if whole else []
    ways += [(".*".join(map(re.escape, part)), counted(part)) for part in dict.fromkeys(q.split()) if len(part) >= LEAST_PART]
    return ways + [(None, [f" {part}"]) for part in dict.fromkeys(q.split())]


def elastic(titles: DataFrame, key: str, title: str, query: str, posted: DataFrame | None = None) -> DataFrame:
    """The titles that a query may mean in any of its ways. Posted letters leave those that have all letters of a way, so patterns run on them only. A query of under three characters
    means nothing."""
    if len(query or "") < LEAST_PART:
        return titles.limit(0)
    ways = wanted(query)
    grams = sorted({g for _, own in ways for g in own})
    hit = (posted if posted is not None else postings(titles, key, title)).where(F.col("gram").isin(*grams)).distinct()
    enough = [F.count_if(F.col("gram").isin(*own)) == len(set(own)) for _, own in ways]
    found = hit.groupBy(key).agg(*[c.alias(f"__w{i}") for i, c in enumerate(enough)]).where(" OR ".join(f"__w{i}" for i in range(len(ways))))
    met = [F.col(f"__w{i}") & (F.col(title).rlike(f"(?is){pattern}") if pattern is not None else F.lit(True)) for i, (pattern, _) in enumerate(ways)]
    keep = met[0]
    for c in met[1:]:
        keep = keep | c
    return titles.join(found, key).where(keep).select(*titles.columns)


def similar(titles: DataFrame, key: str, title: str, query: str, posted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(key, title, similarity): the titles that a query may mean, similar enough to it, the best first. most: how many candidates are looked at, the first by key; none: all."""
    rows = elastic(titles.select(key, title), key, title, query, posted)
    rows = rows.orderBy(key).limit(most) if most is not None else rows
    each = rows.select(title).distinct().withColumn("similarity", fuzzy_in(query, SIMILAR)(F.col(title))).where(F.col("similarity") >= SIMILAR)
    return rows.join(each, title).select(key, title, "similarity")


def supplemented(hits: DataFrame, titles: DataFrame, key: str, title: str, query: str, posted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(key, score, source): hits (key, score) with the titles that only the fuzzy search finds; those count at a share of their similarity and need a floor, as hits do."""
    known = hits.where(F.col("score") >= FLOOR).select(key, "score", F.lit("vector").alias("source"))
    other = similar(titles, key, title, query, posted, most).join(known.select(key), key, "left_anti")
    each = other.select(title).distinct().withColumn("score", WEIGHT * fuzzy_in(query)(F.col(title))).where(F.col("score") >= FLOOR)
    told = other.join(each, title).select(key, "score", F.lit("fuzzy").alias("source"))
    return known.unionByName(told.where(F.col("score") >= FLOOR))
