"""Operator 3: URL filters. Pattern rules are indexed by their rarest literal token; the tokens of a URL fetch candidate rules, and only
those run their regular expressions.

A rule is a regular expression over host and path (Java syntax) with the literal tokens that every match holds whole; base rules
(host, path) are compiled to such rules. How rare a token is, is counted over all URLs given. Rules without a whole token are candidates
of every URL. The longest base rule that fits decides; else a block pattern that matches blocks, unless an allow pattern matches; else
the URL is allowed. Rules are a list of the caller, broadcast where their bytes are few; URLs are judged once each, however often they occur.

Cases: a null URL and one without :// have empty host and path and are allowed; rows that repeat a page or a URL give a row each;
URLs of any length are read whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import light

#: The base rules (verdict, host, path).
BASE = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Patterns of hosts and paths to block or allow: (name, verdict, regular expression over host and path, literal tokens that any match holds whole).
PATTERNS = [
    ("pills", "block", r"(^|[.-])cheap-pills[.-]", ("cheap", "pills")),
    ("casino", "block", r"(^|[.-])casino-[a-z]+[.]", ("casino",)),
    ("bets", "block", r"(^|[.-])free-bets[.-]", ("free", "bets")),
    ("adult", "block", r"(^|[.-])adult-x[.-]", ("adult", "x")),
    ("spam", "block", r"(^|[.-])spam-farm[.-]", ("spam", "farm")),
    ("ads", "block", r"(^|[.-])ads-track[.-]", ("ads", "track")),
    ("banner", "block", r"/banners?/[0-9]+x[0-9]+", ()),
    ("doubleclick", "block", r"(^|[.])doubleclick[.](com|net)(/|$)", ("doubleclick",)),
    ("torrent", "block", r"(^|[./-])torrent[./-]", ("torrent",)),
    ("login", "block", r"/wp-login[.]php$", ("wp", "login", "php")),
    ("health", "allow", r"(^|[.])health[.]example[.]org(/|$)", ("health", "example", "org")),
    ("robots", "allow", r"/robots[.]txt$", ("robots", "txt")),
]


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    base: bool


def compiled(base: list[tuple[str, str, str]], patterns: list[tuple[str, str, str, tuple[str, ...]]]) -> list[Rule]:
    """All rules in one form. The last token of a base rule's path is whole only if something that ends a token follows it."""
    out = []
    for verdict, host, path in base:
        text = f"{host}{path}"
        whole = [t for t in re.split(r"[^a-z0-9]+", (text if not re.search(r"[a-z0-9]$", path.lower()) else text[: -len(re.search(r"[A-Za-z0-9]+$", path)[0])]).lower()) if t]
        out.append(Rule(text, verdict, "^([^/]*[.])?" + re.sub(r"([^A-Za-z0-9/])", r"[\1]", text), tuple(dict.fromkeys(whole)), True))
    return out + [Rule(n, v, r, tuple(t), False) for n, v, r, t in patterns]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, pattern, verdict) of every row."""
    spark = pages.sparkSession
    given = pages.select(F.col(id_col), F.col(url_col).alias("url")).select(id_col, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    subject = given.select(F.concat("host", "path").alias("subject")).where("subject != ''").distinct()
    tokens = subject.select("subject", F.explode(F.array_distinct(F.split(F.lower("subject"), "[^a-z0-9]+"))).alias("token")).where("token != ''")
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    seen = {r["token"]: r["n"] for r in tokens.join(light(wanted, 40), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    table = [(min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else None, r.name, r.verdict, r.regex, r.base, len(r.name)) for r in rules]
    index = spark.createDataFrame(table, "token string, rule string, verdict string, regex string, base boolean, size int")
    met = tokens.join(light(index.where("token IS NOT NULL"), 80), "token").where("subject rlike regex").drop("token")
    if any(not r.tokens for r in rules):
        loose = [r for r in rules if not r.tokens]
        every = F.filter(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.base).alias("base"), F.lit(len(r.name)).alias("size"), F.col("subject").rlike(r.regex).alias("hit")) for r in loose]), lambda x: x["hit"])
        met = met.unionByName(subject.select("subject", F.explode(every).alias("r")).select("subject", "r.rule", "r.verdict", "r.regex", "r.base", "r.size"))
    best = met.groupBy("subject").agg(
        F.max(F.when(F.col("base"), F.struct("size", "rule", "verdict"))).alias("b"),
        F.min(F.when(~F.col("base"), F.struct("verdict", "rule"))).alias("p"),  # allow sorts before block
    )
    # URLs without a subject are kept out of the join, where they would be one key
    whole = given.withColumn("subject", F.nullif(F.concat("host", "path"), F.lit("")))
    out = whole.where("subject IS NOT NULL").join(best, "subject", "left").unionByName(whole.where("subject IS NULL"), allowMissingColumns=True)
    return out.select(id_col, "host", "path", F.col("b.rule").alias("rule"), F.col("p.rule").alias("pattern"), F.coalesce("b.verdict", "p.verdict", F.lit("allow")).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), compiled(BASE, PATTERNS))


def url_sql(base=BASE, patterns=PATTERNS) -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(base, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    hit = lambda r: f"regexp_matches(host || path, '{r}')"
    ranked = sorted(patterns, key=lambda r: (r[1], r[0]))
    name = " ".join(f"WHEN {hit(r)} THEN '{n}'" for n, _, r, _ in ranked)
    method = " ".join(f"WHEN {hit(r)} THEN '{v}'" for _, v, r, _ in ranked)
    return f"""
WITH g AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE WHEN host || path = '' THEN NULL {name} END AS pattern,
       CASE {says} {method} ELSE 'allow' END AS verdict FROM g
"""


QUERIES = {"op3_url_filter": op3_url_filter}
SQL = {"op3_url_filter": url_sql()}
