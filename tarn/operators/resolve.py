"""Entity resolution: candidates with priorities, an alias table, and a cascade of rules, each level for the rows that earlier levels left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.fuzzy import indel, word_sets
from tarn.functions.text import any_of, plain
from tarn.functions.vocabularies import FAMILIES, LINKS, LOCANT
from tarn.operators.windows import keep_best
from tarn.session import light

#: Elements that are no substance by themselves once a salt is taken off.
MINERALS = ["sodium", "potassium", "calcium", "magnesium", "zinc", "iron", "fer", "lithium", "aluminium"]

def candidates(df: DataFrame, key: str, substances: Column, composition: Column, title: Column) -> DataFrame:
    """(key, text, priority): what may name a record's substance: its substances (0), the items of its composition (1), its title (2), of three
    characters or more."""
    items = lambda xs, p: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.struct(F.trim(x).alias("text"), F.lit(p).alias("priority")))
    every = F.concat(items(substances, 0), items(F.split(composition, "[;,]+"), 1), items(F.array(title), 2))
    return df.select(key, F.explode(every).alias("c")).select(key, "c.text", "c.priority").where(F.length("text") > 2)


def aliases(df: DataFrame, key: str, name: str, synonyms: str | None = None) -> DataFrame:
    """(id, norm, kind, prefix): folded names and synonyms; of equal ones the name beats the synonym, then the lesser id."""
    out = df.select(F.col(key).alias("id"), plain(F.col(name)).alias("norm"), F.lit(0).alias("kind"))
    if synonyms:
        out = out.unionByName(df.select(F.col(key).alias("id"), F.explode(synonyms).alias("norm")).select("id", plain(F.col("norm")).alias("norm"), F.lit(1).alias("kind")))
    best = out.where("norm != ''").groupBy("norm").agg(F.min(F.struct("kind", "id")).alias("b"))
    return best.select("b.id", "norm", "b.kind", F.left("norm", F.lit(3)).alias("prefix"))


def reduced(x: Column, salts: list[str], minerals: list[str] = MINERALS) -> Column:
    """A name without salts, in front (salt of name) or behind, up to three; null where that changes nothing, leaves nothing, or leaves a bare
    mineral. Behind a genitive (name de name) nothing is taken off the end."""
    word = any_of(salts)
    out = F.trim(F.regexp_replace(x, rf"^{word}\s+(?:de |d |du |des |of )?", ""))
    out = F.when(out.rlike(r"\s(?:de|du|des|d)\s"), out).otherwise(F.trim(F.regexp_replace(out, rf"(?:\s+{word}){{1,3}}$", "")))
    return F.when((out != "") & (out != x) & ~out.isin(*minerals), out)


def _words(x: Column, places: str = LOCANT) -> Column:
    return F.transform(F.split(x, " "), lambda w: F.regexp_replace(w, places, ""))


def families(x: Column, table: dict[str, tuple[str, ...]] = FAMILIES) -> Column:
    """The chemical families that words of a folded name name."""
    known = F.create_map(*[F.lit(v) for k, words in table.items() for w in words for v in (w, k)])
    return F.array_distinct(F.filter(F.transform(_words(x), lambda w: F.element_at(known, w)), lambda f: f.isNotNull()))


def distinctive(x: Column, table: dict[str, tuple[str, ...]] = FAMILIES, links: tuple[str, ...] = LINKS) -> Column:
    """What is left of a folded name without its chemical families and linking words."""
    common = [w for words in table.values() for w in words] + list(links)
    return F.array_join(F.filter(_words(x), lambda w: (w != "") & ~w.isin(*common)), " ")


def told_apart(a: str, b: str, least: float, table: dict[str, tuple[str, ...]] = FAMILIES, links: tuple[str, ...] = LINKS) -> Column:
    """Whether two names that share a chemical family also agree in what is left without it: the shared word alone makes unlike names alike."""
    x, y = distinctive(F.col(a), table, links), distinctive(F.col(b), table, links)
    shared = F.arrays_overlap(families(F.col(a), table), families(F.col(b), table))
    return ~shared | (x == "") | (y == "") | (F.greatest(indel(x, y), word_sets(x, y)) >= least)


def cascade(items: DataFrame, key: str, name: str, alias: DataFrame, salts: list[str], least: float = 85.0, glossary: DataFrame | None = None) -> DataFrame:
    """(key, id, score, rule): exact 100 or synonym 98, translated 98, reduced 94 and reduced and translated 92, else fuzzy at `least` or more
    within a block of three letters and a length that can reach it. glossary: (source, target), folded.

    Each level joins on equality and hands the rows it didn't match to the next, so the costly one sees the fewest. At `least`, lengths differ
    by at most a known share, so lengths are part of the block's key and a frequent prefix is split by them; Levenshtein's distance, which the
    JVM works out, is at most that of insertions and deletions, so it leaves few pairs to score."""
    rows = items.select(key, plain(F.col(name)).alias("norm")).where("norm != ''")
    none = F.lit(None).cast("string")
    known = light(glossary.select(F.col("source").alias("__s"), F.col("target").alias("__t")).groupBy("__s").agg(F.min("__t").alias("__t"))) if glossary is not None else None

    def translated(df: DataFrame, x: str, to: str) -> DataFrame:
        return df.join(known, F.col(x) == F.col("__s"), "left").withColumn(to, F.col("__t")).drop("__s", "__t") if known is not None else df.withColumn(to, none)

    rows = translated(rows.withColumn("short", reduced(F.col("norm"), salts)), "norm", "other_name")
    rows = translated(rows, "short", "other_short")
    forms = F.array(F.struct(F.col("norm").alias("form"), F.lit(0).alias("level")), F.struct(F.col("other_name").alias("form"), F.lit(1).alias("level")), F.struct(F.col("short").alias("form"), F.lit(2).alias("level")), F.struct(F.col("other_short").alias("form"), F.lit(3).alias("level")))
    each = rows.select(key, F.explode(forms).alias("f")).select(key, "f.*").where("form IS NOT NULL")
    score = F.when((F.col("level") == 0) & (F.col("kind") == 0), 100.0).when(F.col("level") <= 1, 98.0).when(F.col("level") == 2, 94.0).otherwise(92.0)
    rule = F.when((F.col("level") == 0) & (F.col("kind") == 0), "exact").when(F.col("level") == 0, "synonym").when(F.col("level") == 1, "translated").when(F.col("level") == 2, "reduced").otherwise("reduced and translated")
    equal = each.join(alias.select(F.col("norm").alias("form"), "id", "kind"), "form").groupBy(key).agg(F.min(F.struct("level", "kind", "id")).alias("m"))
    equal = equal.select(key, "m.*").select(key, "id", score.alias("score"), rule.alias("rule"))
    share = (200 - least) / least  # of two lengths, the longer is at most so many times the shorter
    rest = rows.join(equal.select(key), key, "left_anti").select(key, "norm", F.left("norm", F.lit(3)).alias("prefix"))
    sized = rest.withColumn("size", F.explode(F.sequence(F.ceil(F.length("norm") / share).cast("int"), F.floor(F.length("norm") * share).cast("int"))))
    block = sized.join(alias.select(F.col("norm").alias("other"), "id", "prefix", F.length("norm").alias("size")), ["prefix", "size"])
    close = block.where(F.levenshtein("norm", "other") <= F.floor((F.length("norm") + F.length("other")) * (1 - least / 100)))
    scored = close.withColumn("score", F.round(indel("norm", "other"), 4)).where(F.col("score") >= least).where(told_apart("norm", "other", least))
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("m")).select(key, (-F.col("m.minus")).alias("id"), "m.score", F.lit("fuzzy").alias("rule"))
    return equal.unionByName(best)


def best_three(found: DataFrame, key: str, least: float = 80.0, k: int = 3) -> DataFrame:
    """(key, ids, score, rule, kind): of what was found (key, id, score, rule, priority) at `least` or more, the best k ids, the best score and its
    rule, and whether that comes from a substance or only from a title."""
    one = found.where(F.col("score") >= least).groupBy(key, "id").agg(F.max(F.struct("score", (-F.col("priority")).alias("p"), "rule")).alias("b"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("b.score")).alias("minus"), "id", F.col("b.rule").alias("rule"), (-F.col("b.p")).alias("priority"))))
    return one.groupBy(key).agg(F.slice(order, 1, k).alias("o")).select(key, F.transform("o", lambda x: x["id"]).alias("ids"), (-F.col("o")[0]["minus"]).alias("score"), F.col("o")[0]["rule"].alias("rule"), F.when(F.col("o")[0]["priority"] == 2, "title").otherwise("substance").alias("kind"))


def match_or_title(records: DataFrame, key: str, title: str, matches: DataFrame, alias: DataFrame, gate: float = 80.0) -> DataFrame:
    """(key, id, score): a match that was worked out before if its score reaches the gate; else the alias that the title equals, else its first
    word, at 85."""
    norm = plain(F.col(title))
    known = matches.where(F.col("score") >= gate).groupBy(key).agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("__m"))
    rows = records.select(key, norm.alias("__norm"), F.split(norm, " ")[0].alias("__word")).join(known, key, "left")
    whole, word = (alias.select(F.col("norm").alias(f"__{c}"), F.col("id").alias(f"__{c}_id")) for c in ("norm", "word"))
    out = rows.join(whole, "__norm", "left").join(word, "__word", "left")
    return out.select(key, F.coalesce(-F.col("__m.minus"), "__norm_id", "__word_id").alias("id"), F.when(F.col("__m").isNotNull(), F.col("__m.score")).when(F.coalesce("__norm_id", "__word_id").isNotNull(), 85.0).alias("score"))


def resolving(items: DataFrame, key: str, text: str, names: DataFrame, least: int = 4) -> DataFrame:
    """(key, phrase, id): texts that name exactly one id, by the shortest run of their first words (of `least` characters or more) that names the
    same one. names: (norm, id)."""
    single = names.groupBy("norm").agg(F.min("id").alias("id"), F.max("id").alias("top")).where("id = top").select("norm", "id")
    words = F.split(plain(F.col(text)), " ")
    runs = items.select(key, F.size(words).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("k", "norm"))
    hit = runs.where((F.length("norm") >= least) | (F.col("k") + 1 == F.col("n"))).join(single, "norm")
    whole = hit.where("k + 1 = n").select(key, F.col("id").alias("__whole"))
    return hit.join(whole, key).where("id = __whole").groupBy(key).agg(F.min_by(F.struct(F.col("norm").alias("phrase"), "id"), "k").alias("b")).select(key, "b.*")


def first_form(items: DataFrame, key: str, forms: str, names: DataFrame, name: str, value: str) -> DataFrame:
    """(key, form, value): the first of a row's written forms that a name equals in lower case."""
    one = items.select(key, F.posexplode(forms).alias("rank", "form"))
    hit = one.join(names.select(F.lower(name).alias("__name"), F.col(value)), F.lower("form") == F.col("__name"))
    return keep_best(hit, [key], F.col("rank"), F.col(value)).select(key, "form", value)
