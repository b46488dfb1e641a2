"""Similarities and texts that no built-in expresses, as Arrow-batched functions. Three measures are kept apart: `ratcliff` (matching
blocks), `indel` (insertions and deletions) and Spark's own levenshtein."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_full(text: str) -> str:
    """Canonical decomposition without marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def plain_full(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", fold_full(text)).split())


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a column of the table at a time as the bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths; 100 for two empty texts."""
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def set_ratio(a: str, b: str) -> float:
    """The ratio of word sets, blind to order: 100 if one holds the other, else the best of the shared words with each rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([indel_ratio(one, two), *([indel_ratio(both, one), indel_ratio(both, two)] if both else [])])


@F.pandas_udf(T.DoubleType())
def ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts in lower case, 0 to 1; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def word_sets(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def best_match(query: str, text: str, threshold: float) -> float:
    """1 for a text that holds the query; else the best similarity of a word of each that reaches the threshold; else that of the
    whole query with as many words of the text on end."""
    q, t = plain_full(query or ""), plain_full(text or "")
    if not query or not text:
        return 0.0
    if q in t:
        return 1.0
    near = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    words, wanted = t.split(), q.split()
    best = max((s for w in set(words) for x in wanted if (s := near(x, w)) >= threshold), default=0.0)
    if best < threshold and len(wanted) > 1:
        best = max([best, *(near(q, " ".join(words[i : i + len(wanted)])) for i in range(len(words) - len(wanted) + 1))])
    return best


def fuzzy_in(query: str, threshold: float = 0.7):
    """A column function: how well a text answers a query."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: best_match(query, t, threshold)).astype("float64")

    return score


def negated_before(text: str, at: int, negators: list[str], reach: int = 24) -> bool:
    """Whether a negator stands in the same clause shortly before a position."""
    clause = re.split(r"[,.;]", text[max(0, at - reach) : at])[-1]
    return any(re.search(rf"\b{re.escape(n)}\b", clause) for n in negators)


def affirmed(term: str, negators: list[str]):
    """A column function: whether a folded text holds a term that isn't negated."""

    @F.pandas_udf(T.BooleanType())
    def holds(text: pd.Series) -> pd.Series:
        found = lambda t: any(not negated_before(t, m.start(), negators) for m in re.finditer(rf"\b{re.escape(term)}s?\b", t))
        return text.map(lambda t: None if t is None else found(fold_full(t))).astype("boolean")

    return holds


def chunks_of(text: str, most: int) -> list[str]:
    """Whole sentences packed greedily into chunks of at most so many characters; a longer sentence is cut."""
    out, held = [], ""
    for sentence in re.findall(r".+?(?:[.!?](?=\s|$)|$)\s*", text or "", re.S):
        for piece in [sentence[i : i + most] for i in range(0, len(sentence), most)]:
            if held and len(held) + len(piece.rstrip()) > most:
                out.append(held.strip())
                held = ""
            held += piece
    return [x for x in [*out, held.strip()] if x]


def sentence_chunks(most: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunks_of(t, most))

    return cut
