"""Queries over pages and long texts as sections: trees, formats, facts, plans of headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import vocabularies as K
from tarn.plans.registry import Tables, query
from tarn.sources import pages as H

#: The walk through a page in SQL: markup becomes marks. \\1 ends a block, \\2 begins a heading, \\3 stands between its level and its title, \\4 is a bold tag, \\5 an item.
_BLOCKS = "|".join(sorted(H._BLOCK - {"li"}))
_MARKED = f"""
SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
  '(?is)<h([1-6])(?:\\s[^>]*)?>(.*?)</h[1-6]\\s*>', chr(2) || '\\1' || chr(3) || '\\2' || chr(1), 'g'),
  '(?i)<li(?:\\s[^>]*)?>', chr(1) || chr(5), 'g'), '(?i)</li\\s*>', chr(1), 'g'),
  '(?i)</?(?:{_BLOCKS})(?:\\s[^>]*)?/?>', chr(1), 'g'),
  '(?i)<(?:b|strong)(?:\\s[^>]*)?>', chr(4), 'g'), '<[!/a-zA-Z][^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS m
FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS h FROM pages WHERE html IS NOT NULL)
"""
_TRIM = "trim(regexp_replace({}, '[\\s\\x{{a0}}]+', ' ', 'g'))"
_BARE = _TRIM.format("replace(replace(x, chr(4), ''), chr(5), '')")
SECTIONS_SQL = f"""
WITH parts AS (SELECT page_id, unnest(string_split(m, chr(2))) AS part, generate_subscripts(string_split(m, chr(2)), 1) - 1 AS section FROM ({_MARKED})),
cut AS (SELECT page_id, section, CASE WHEN section = 0 THEN 0 ELSE CAST(part[1] AS INTEGER) END AS level,
    CASE WHEN section = 0 THEN '' ELSE {_TRIM.format("split_part(split_part(replace(part, chr(4), ''), chr(3), 2), chr(1), 1)")} END AS title,
    string_split(CASE WHEN section = 0 THEN part ELSE substr(part, instr(part, chr(1)) + 1) END, chr(1)) AS raw FROM parts),
blocked AS (SELECT page_id, section, level, title, list_filter(list_transform(raw, lambda x: {{'text': {_BARE}, 'bold': contains(x, chr(4)), 'item': contains(x, chr(5))}}), lambda b: b.text <> '') AS blocks FROM cut),
tree AS (SELECT a.page_id, a.section, coalesce(max(b.section), -1) AS parent, a.level, a.title, any_value(a.blocks) AS blocks
  FROM blocked a LEFT JOIN blocked b ON a.page_id = b.page_id AND b.section < a.section AND b.level < a.level GROUP BY a.page_id, a.section, a.level, a.title)
"""


def sections(t: Tables) -> DataFrame:
    return H.html_sections(t.pages, "page_id", "html")


@query(f"""{SECTIONS_SQL}
SELECT page_id, section, parent, level, title, len(blocks) AS blocks, len(list_filter(blocks, lambda b: b.bold)) AS bold, len(list_filter(blocks, lambda b: b.item)) AS items,
  md5(list_aggregate(list_transform(blocks, lambda b: b.text), 'string_agg', chr(10))) AS content FROM tree WHERE section > 0 OR len(blocks) > 0
""")
def page_sections(t: Tables) -> DataFrame:
    """The section tree of every page: parents, levels, titles, blocks and how they are set."""
    text = lambda c: F.coalesce(c["text"], F.lit(""))
    count = lambda f: F.size(F.filter("content", f)).cast("long")
    content = F.when(F.size("content") > 0, F.md5(F.array_join(F.transform("content", text), "\n").cast("binary")))
    return sections(t).select("page_id", "section", "parent", "level", "title", F.size("content").cast("long").alias("blocks"), count(lambda c: c["format"]["bold"]).alias("bold"), count(lambda c: c["format"]["list"].isNotNull()).alias("items"), content.alias("content"))


#: Words of titles that choose sections.
TITLES = ["that", "ción", "schen", "eau"]


@query(f"""{SECTIONS_SQL}
SELECT page_id, string_agg(text, ' ' ORDER BY section) AS text FROM (SELECT page_id, section, list_aggregate(list_transform(blocks, lambda b: b.text), 'string_agg', ' ') AS text FROM tree
  WHERE section > 0 AND len(blocks) > 0 AND ({" OR ".join(f"contains(lower(title), '{w}')" for w in TITLES)})) GROUP BY page_id
""")
def section_by_keyword(t: Tables) -> DataFrame:
    """The text of the sections whose title holds a keyword, three levels deep."""
    return H.keyword_text(sections(t), "page_id", TITLES)


@query(f"""{SECTIONS_SQL}
SELECT DISTINCT page_id FROM tree WHERE len(list_filter(blocks, lambda b: regexp_matches(b.text, '(?i)\\d{{3}}|ent[io]n.{{0,4}}the'))) > 0
""")
def nested_regex(t: Tables) -> DataFrame:
    """pages with a block, three levels of sections deep, that matches an expression in any case."""
    return H.pages_with(sections(t), "page_id", r"(?i)\d{3}|ent[io]n.{0,4}the")


@query("""
WITH bare AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') AS bare FROM pages)
SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]+)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1)), '')) AS title,
  coalesce(nullif(regexp_extract(bare, '(?i)mis à jour le\\s*:?\\s*(\\d{2}/\\d{2}/\\d{4})', 1), ''), nullif(regexp_extract(bare, '(?i)jour le\\s*:?\\s*(\\d{2}/\\d{2}/\\d{4})', 1), '')) AS updated,
  nullif(trim(regexp_extract(bare, '(?i)titulaire[^:]{0,60}:\\s*([^.;:]{2,60}?)\\s*(?:[.;]|$)', 1)), '') AS maker,
  list_sort(list_distinct(regexp_extract_all(bare, '\\b(\\d+(?:[.,]\\d+)?\\s?(?:mg|g|µg|ml|UI)(?:/\\w+)?)\\b', 1))) AS dosages FROM bare
""")
def page_facts(t: Tables) -> DataFrame:
    """Title, date of update, maker and dosages of every page."""
    facts = H.page_facts(F.col("html"))
    return t.pages.select("page_id", *[(F.sort_array(c) if k == "dosages" else c).alias(k) for k, c in facts.items()])


#: A long text made of each document's lines: a table of contents, then a section of the plan for each line, with references back at the beginning of lines.
_LONG = """
SELECT doc_id, l, n, 'CONTENTS' || chr(10) || array_to_string(list_transform(range(n), lambda i: plan[i + 1] || '. Part ' || (i + 1)), chr(10)) || chr(10)
  || array_to_string(list_transform(range(n), lambda i: plan[i + 1] || '. Part ' || (i + 1) || chr(10) || '- ' || l[i + 1] || CASE WHEN i % 7 = 3 AND i > 5 THEN '.' || chr(10) || '4.2 is told above.' WHEN i % 5 = 2 THEN '.' || chr(10) || '2 is told above.' ELSE '.' END), chr(10)) || chr(10) || 'see www.ema.europa.eu/x' AS text
FROM (SELECT doc_id, l, CAST(least(len(l), 24) AS INTEGER) AS n, {plan} AS plan FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS l FROM documents))
""".replace("{plan}", str(list(K.PLAN)))


def long_texts(t: Tables) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r"))), lambda x: x != "")
    rows = t.documents.select("doc_id", lines.alias("l")).withColumn("n", F.least(F.size("l"), F.lit(24)))
    plan = F.array(*map(F.lit, K.PLAN))
    number = lambda i: F.concat(F.get(plan, i), F.lit(". Part "), (i + 1).cast("string"))
    more = lambda i: F.when((i % 7 == 3) & (i > 5), ".\n4.2 is told above.").when(i % 5 == 2, ".\n2 is told above.").otherwise(".")
    each = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    toc = F.array_join(F.transform(each, number), "\n")
    body = F.array_join(F.transform(each, lambda i: F.concat(number(i), F.lit("\n- "), F.get("l", i), more(i))), "\n")
    return rows.select("doc_id", F.concat(F.lit("CONTENTS\n"), toc, F.lit("\n"), body, F.lit("\nsee www.ema.europa.eu/x")).alias("text"))


@query(f"""
WITH t AS ({_LONG}), s AS (SELECT doc_id, n, l, unnest(range(n)) AS i FROM t)
SELECT doc_id, {list(K.PLAN)}[i + 1] AS number, md5(' Part ' || (i + 1) || chr(10) || '- ' || l[i + 1] || CASE WHEN i % 7 = 3 AND i > 5 THEN '.' || chr(10) || '4.2 is told above.' WHEN i % 5 = 2 THEN '.' || chr(10) || '2 is told above.' ELSE '.' END || chr(10) || CASE WHEN i = n - 1 THEN 'see www.ema.europa.eu/x' ELSE '' END) AS content,
  CASE WHEN i BETWEEN 4 AND 12 THEN '4' WHEN i BETWEEN 14 AND 16 THEN '5' WHEN i BETWEEN 18 AND 23 THEN '6' END AS parent FROM s
""")
def plan_slices(t: Tables) -> DataFrame:
    """Sections of long texts by the best chain of a plan's numbers, neither contents nor references taken for headings."""
    return H.plan_sections(long_texts(t), "doc_id", "text").select("doc_id", "number", F.md5(F.col("content").cast("binary")).alias("content"), "parent")


@query(f"""
WITH t AS ({_LONG}), s AS (SELECT doc_id, n, unnest(range(n)) AS i FROM t)
SELECT doc_id, count(*) FILTER (i IN (0, 1, 2, 3, 13, 17)) AS sections, CAST(sum(2 + CAST((i % 7 = 3 AND i > 5) OR i % 5 = 2 AS INTEGER) + CAST(i = n - 1 AS INTEGER)) AS BIGINT) AS paragraphs, sections >= 6 AND paragraphs >= 20 AS usable FROM s GROUP BY doc_id
""")
def plan_verdicts(t: Tables) -> DataFrame:
    """Whether a text was cut into enough sections and paragraphs to be kept."""
    return H.plan_usable(H.plan_sections(long_texts(t), "doc_id", "text"), "doc_id")


_PARTS = ["CASE p_size % 6 WHEN 0 THEN '{n} ....... {d} mg' WHEN 1 THEN 'Chaque comprimé contient {d} mg de {n} et 3,5 g de sodium.' WHEN 2 THEN 'contient du {n} (base)' WHEN 3 THEN 'Sodium ..... {d} mg' WHEN 4 THEN 'Activité anti-X de {n} {d} UI' ELSE 'Composition : {n} sous forme {w} {d} ml' END", "'Sodium {n} ..... 1 g'", "CASE WHEN p_size % 4 = 0 THEN 'Excipient : eau' ELSE 'rien' END", "'last {w} ..... 2 mg'"]
_LINES = [x.replace("'{n}", "p_name || '").replace("{n}'", "' || p_name").replace("{n}", "' || p_name || '").replace("{d}", "' || p_size || '").replace("{w}", "' || lower(p_type) || '") for x in _PARTS]


@query("""
SELECT p_partkey, list_concat(CASE WHEN p_size % 6 = 3 THEN [] ELSE [p_name] END, ['Sodium ' || p_name], CASE WHEN p_size % 4 = 0 THEN [] ELSE ['last ' || lower(p_type)] END) AS substances FROM part
""")
def composed_substances(t: Tables) -> DataFrame:
    """The substances that composition lines name; what is no substance alone may be a part of one."""
    lines = F.array(*[F.expr(x) for x in _LINES])
    return t.part.select("p_partkey", H.composition(lines).alias("substances"))
