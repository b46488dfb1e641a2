"""Documents with every awkward case, and plain Python versions of what the operators count."""

import re

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, h string, __text string, __hash string, __row string, __gone string"
CLASH = ("i", "s", "h", "t", "x", "r", "g")


def awkward(spark, empty=False):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    base = "The quick brown fox jumps over the lazy dog and runs far away from home today. "
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t", None, "a"), (4, base * 3, "en", "a"), (5, base * 3, "en", "b"), (6, (base * 3).upper(), "en", None),
        (7, "un deux trois quatre", "fr", "b"), (8, "un deux trois quatre", "fr", "b"), (9, "\u00e9t\u00e9 \U0001f600 na\u00efve caf\u00e9 <|endoftext|> \u4f60\u597d  x", "fr", "c"),
        (10, "word%d " * 5 % (1, 2, 3, 4, 5) + "mail a.b+c@ex-am.ple.com, ip 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111, tel +1 (555) 010-9999.", "en", "c"),
        (11, " ".join(f"w{i % 7919}" for i in range(200_000)), "xx", "a"), (12, "\u4f60\u597d" * 20_000, None, None), (None, "no id here at all, friend", "en", "a"),
        (13, "1234 !!! ### ", "en", "a"), (4, base * 3, "en", "a"), (14, "a" * 300_000, "en", "b"), (15, "x@y.z" + "@" * 1000 + "1." * 5000 + "+1" * 3000, "en", "b"),
    ]
    return spark.createDataFrame([] if empty else [(i, t, lang, s, None, *CLASH) for i, t, lang, s in rows], SCHEMA)


def table(name, sf="/root/testdata/sf0.001"):
    return duckdb.sql(f"select * from read_parquet('{sf}/{name}.parquet')").fetchall()


def shingles(text, k=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}
