"""The staged rule engine: candidates with their reasons. Rejected rows stay, with the stage and the reason; what is unknown neither
excludes nor matches. A rule base is a list of the caller, so rules become column expressions and no stage joins rows with rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import fold
from tarn.operators.filters import every, first_reason, present, split_kept
from tarn.operators.sets import union_first
from tarn.session import cut

#: Penalties and thresholds of the safety score.
PENALTY = {"contraindication": 40, "interaction": 20, "interaction_cumulative": 10, "caution": 15, "step": 25}
LEAST_RELEVANT = 40
#: How many treatments and how many candidates a check of interactions takes.
MOST_TREATMENTS, MOST_CANDIDATES = 40, 120
STAGES = ["eligibility", "class", "redundancy", "constraint", "threshold"]
STRINGS = "array<string>"


@dataclass(frozen=True)
class Rule:
    """Matches an item whose name the pattern finds at its level, else one of its classes at the weaker level."""

    name: str
    pattern: str
    classes: tuple[str, ...] = ()
    level: str = "exclude"
    weaker: str = "watch"


@dataclass(frozen=True)
class Case:
    """What is asked: expected classes, groups that are no treatment, classes that only relieve, rules, and the patient's history."""

    expected: tuple[str, ...]
    never: tuple[str, ...] = ()
    relieving: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    history: tuple[str, ...] = ()
    local_routes: str = "(?!)"
    marketed: str = "marketed"


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast(STRINGS)


def known(x: Column) -> Column:
    """An array, empty if it is missing."""
    return F.coalesce(x, F.array().cast(STRINGS))


def own_groups(codes: Column, listed: tuple[str, ...] = ()) -> Column:
    """The groups (three characters) of a substance's codes without codes of combinations, unless it has no others. A full code is one of a
    combination if its rank is 50 or more or its subgroup is listed; a code that is short or has no rank is the substance's own."""
    rank = lambda c: F.substring(c, 6, 2).try_cast("int")
    mixed = lambda c: (F.length(c) >= 7) & rank(c).isNotNull() & ((rank(c) >= 50) | F.left(c, F.lit(5)).isin(*listed))
    tidy = F.filter(F.transform(known(codes), lambda c: F.upper(F.trim(c))), lambda c: c.isNotNull() & (c != ""))
    groups = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda c: F.left(c, F.lit(3)))))
    single = F.filter(tidy, lambda c: ~mixed(c))
    return F.when(F.size(single) > 0, groups(single)).otherwise(groups(tidy))


def eligibility(df: DataFrame, status: str, marketed: str, route: str, local_routes: str) -> DataFrame:
    """Not marketed, or a local route; a missing status or route keeps the row."""
    return split_kept(df, first_reason((present(F.col(status)) & (F.col(status) != marketed), "not marketed"), (fold(F.col(route)).rlike(local_routes), "local route")), "eligibility")


def class_filter(df: DataFrame, own: str, expected: tuple[str, ...], never: tuple[str, ...] = ()) -> DataFrame:
    """Groups that are all no treatment reject; a known class that isn't expected rejects; no class keeps and adds `unclassed`."""
    groups = known(F.col(own))
    some = F.size(groups) > 0
    reasons = [(some & (F.size(F.array_except(groups, strings(never))) == 0), "not a treatment")]
    if expected:
        reasons.append((some & ~F.arrays_overlap(groups, strings(expected)), "class not expected"))
    return split_kept(df.withColumn("unclassed", ~some), first_reason(*reasons), "class")


def redundancy(df: DataFrame, substance: str, own: str, treatments: DataFrame) -> DataFrame:
    """Against existing treatments (t_substance, t_class, cumulative): the same substance stays with an alert, a class that must not
    be doubled rejects, one that may be stays with an alert."""
    same = df.join(treatments.select(F.col("t_substance").alias("__s")).where("__s IS NOT NULL").distinct(), F.col(substance) == F.col("__s"), "left").withColumn("__same", F.col("__s").isNotNull())
    cls = treatments.where("t_class IS NOT NULL").groupBy(F.col("t_class").alias("__c")).agg(F.min(F.col("cumulative").cast("int")).alias("__cumulative"))
    both = same.join(cls, F.col(own) == F.col("__c"), "left")
    alert = F.when(F.col("__same"), "same substance").when(F.col("__cumulative") == 1, "class doubled")
    out = split_kept(both, first_reason((~F.col("__same") & (F.col("__cumulative") == 0), "class must not be doubled")), "redundancy")
    return out.withColumn("alert", alert).drop("__s", "__same", "__c", "__cumulative")


def verdicts(name: Column, own: Column, rules: tuple[Rule, ...]) -> Column:
    """The (rule, level) of the rules that match an item, in the order of the rules."""
    kind = "array<struct<rule:string,level:string>>"
    level = lambda r: F.when(fold(name).rlike(r.pattern), r.level).when(F.arrays_overlap(known(own), strings(r.classes)), r.weaker)
    return F.filter(F.array(*[F.struct(F.lit(r.name).alias("rule"), level(r).alias("level")) for r in rules]).cast(kind), lambda v: v["level"].isNotNull())


def levels(items: DataFrame, key: str, name: str, own: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rule, level): a row for each rule that matches an item."""
    return items.select(key, F.explode(verdicts(F.col(name), F.col(own), rules)).alias("v")).select(key, "v.rule", "v.level")


def constraints(df: DataFrame, name: str, own: str, rules: tuple[Rule, ...]) -> DataFrame:
    """A rule at level `exclude` rejects with its name; adds `demotions`, how many demote, and `watched`, the rules that only watch."""
    v = F.col("__v")
    of = lambda level: F.transform(F.filter(v, lambda x: x["level"] == level), lambda x: x["rule"])
    out = split_kept(df.withColumn("__v", verdicts(F.col(name), F.col(own), rules)), F.get(of("exclude"), F.lit(0)), "constraint")
    return out.withColumns({"demotions": F.size(of("demote")), "watched": of("watch")}).drop("__v")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.;·])\s+"), lambda s: F.trim(s) != "")


def contraindications(text: Column, history: tuple[str, ...]) -> Column:
    """(term, sentence) of each item of a history all of whose words one sentence holds, with the first such sentence."""
    kind = "array<struct<term:string,sentence:string>>"

    def first(item: str) -> Column:
        return F.get(F.filter(sentences(F.coalesce(text, F.lit(""))), lambda s: every(*[F.contains(fold(s), F.lit(w)) for w in item.lower().split()])), F.lit(0))

    return F.filter(F.array(*[F.struct(F.lit(h).alias("term"), first(h).alias("sentence")) for h in history]).cast(kind), lambda c: c["sentence"].isNotNull())


def safety(relevance: Column, contraindicated: Column, interacts: Column, demotions: Column, cumulative: Column) -> Column:
    """The score less its penalties, not under 0."""
    each = F.when(cumulative, PENALTY["interaction_cumulative"]).otherwise(PENALTY["interaction"])
    return F.greatest(F.lit(0), relevance - PENALTY["contraindication"] * contraindicated - each * interacts - PENALTY["caution"] * demotions)


def threshold(df: DataFrame, score: str, raw: str) -> DataFrame:
    """Under the threshold: penalised if the raw score reached it, else without a link."""
    low = F.col(score) < LEAST_RELEVANT
    return split_kept(df, first_reason((low & (F.col(raw) >= LEAST_RELEVANT), "penalised"), (low, "no link to the diagnosis")), "threshold")


def rejected_by_stage(df: DataFrame) -> DataFrame:
    """(stage, place, n) in the order of the stages."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("reject_stage")).cast("int")
    return df.where("reject_stage IS NOT NULL").groupBy(F.col("reject_stage").alias("stage"), order.alias("place")).agg(F.count("*").alias("n"))


def strategy(df: DataFrame, key: str, own: str, among: Column, merit: Column, relieving: tuple[str, ...] = (), causal: bool = False) -> DataFrame:
    """Adds `line` to the rows `among`: first line for the best of each class by merit (least first), or adjuvant if the class only relieves
    and the case also calls for a causal one; alternative for all others and for rows without a class. One row a class is joined, so a class
    with very many rows is never gathered. The rows are cut first, as they are read twice."""
    df = cut(df)
    best = df.where(among & F.col(own).isNotNull()).groupBy(F.col(own).alias("__own")).agg(F.min_by(F.struct(F.col(key).alias("k")), merit).alias("__best"))
    out = df.join(best, F.col(own) == F.col("__own"), "left")
    first = F.col("__best.k") == F.col(key)
    line = F.when(~among, F.lit(None)).when(first & F.lit(causal) & F.col(own).isin(*relieving), "adjuvant").when(first, "first line").otherwise("alternative")
    return out.withColumn("line", line).drop("__own", "__best")


def controls(candidates: DataFrame, case: Case, treatments: DataFrame, interactions: DataFrame) -> DataFrame:
    """All stages in order over (id, title, substance, groups, cls, status, route, notice, raw): constraints and redundancy reject, what a notice
    warns of and interactions weigh on the score, then lines are named and the threshold cuts. treatments: (t_id, t_substance, t_class,
    cumulative); interactions: (src, dst) from a treatment. No row goes."""
    out = eligibility(candidates, "status", case.marketed, "route", case.local_routes)
    out = class_filter(out, "groups", case.expected, case.never)
    out = redundancy(out, "substance", "cls", treatments)
    out = constraints(out, "title", "groups", case.rules)
    out = out.withColumn("warned", F.size(contraindications(F.col("notice"), case.history)) > 0)
    met = interactions.join(treatments.select("t_id"), F.col("src") == F.col("t_id"), "left_semi").select(F.col("dst").alias("__with")).distinct()
    out = out.join(met, F.col("id") == F.col("__with"), "left").withColumn("interacts", F.col("__with").isNotNull()).drop("__with")
    score = safety(F.col("raw"), F.col("warned").cast("int"), F.col("interacts").cast("int"), F.col("demotions"), F.coalesce(F.col("alert") == "class doubled", F.lit(False)))
    out = out.withColumn("score", score)
    kept = F.col("reject_stage").isNull()
    out = strategy(out, "id", "cls", kept, F.struct(-F.col("score"), F.col("id")), case.relieving, any(c not in case.relieving for c in case.expected))
    return threshold(out, "score", "raw")


def capped(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first `most` rows in a total order, each with `truncated`: whether there were more."""
    few = rows.orderBy(*order).limit(most + 1)
    w = Window.partitionBy(F.lit(0))  # of at most `most` + 1 rows
    return few.withColumns({"__n": F.row_number().over(w.orderBy(*order)), "truncated": F.count("*").over(w) > most}).where(F.col("__n") <= most).drop("__n")


def assembled(sources: list[tuple[str, DataFrame, int]], first: str) -> DataFrame:
    """(id, title, similarity, origin, truncated): a pool of candidates from several sources (id, title, similarity), the best of each up to its own limit. An id counts
    for the first source that has it; a candidate of `first` also goes if another source has its title, and stands before all others when shown."""
    parts = [capped(df.select("id", "title", "similarity"), most, F.desc_nulls_last("similarity"), F.asc("id")).withColumn("origin", F.lit(name)) for name, df, most in sources]
    every = cut(union_first(parts, "id"))
    others = every.where(F.col("origin") != first).select("title").distinct()
    return every.where(F.col("origin") != first).unionByName(every.where(F.col("origin") == first).join(others, "title", "left_anti").select(*every.columns))


def pool(found: DataFrame, candidates: DataFrame, case: Case, first: str, most: int = 20) -> DataFrame:
    """(id, origin, similarity, reject_stage, reject_reason, place) of assembled candidates after eligibility and class: what passed has its place, those of `first`
    before others, those without a class last, then by similarity; places beyond `most` are rejected by the stage `pool`. No row goes."""
    rows = found.join(candidates.drop("title"), "id")
    out = class_filter(eligibility(rows, "status", case.marketed, "route", case.local_routes), "groups", case.expected, case.never)
    kept = F.col("reject_stage").isNull()
    order = [(F.col("origin") != first).asc(), F.col("unclassed").asc(), F.desc_nulls_last("similarity"), F.asc("id")]
    placed = out.withColumn("place", F.when(kept, F.row_number().over(Window.partitionBy(kept).orderBy(*order))))  # sources have limits, so these rows are few
    over = kept & (F.col("place") > most)
    return placed.select("id", "origin", "similarity", F.when(over, "pool").otherwise(F.col("reject_stage")).alias("reject_stage"), F.when(over, "beyond the pool").otherwise(F.col("reject_reason")).alias("reject_reason"), F.when(~over, F.col("place")).alias("place"))


def interaction_report(treatments: DataFrame, suggestions: DataFrame, matched: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: the state of a check with how much it rests on. treatments and suggestions: (name, truncated), capped; matched: (side, name), names of either side that
    are known; pairs: the interactions found."""
    no = F.lit(False)
    one = lambda df, kind, cut_short=no: df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), cut_short.alias("cut_short"))
    rows = one(treatments, "treatments", F.col("truncated")).unionByName(one(suggestions, "suggestions", F.col("truncated"))).unionByName(one(matched, F.concat(F.lit("known "), "side"))).unionByName(one(pairs, "found"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counts = rows.agg(n("treatments").alias("treatments"), n("suggestions").alias("suggestions"), n("known treatment").alias("known_treatments"), n("known suggestion").alias("known_suggestions"), n("found").alias("found"), F.coalesce(F.max("cut_short"), no).alias("truncated"))
    state = interaction_state(F.col("treatments"), F.col("suggestions"), F.least("known_treatments", "known_suggestions"), F.col("found"), F.lit(True))
    return counts.select("*", (F.col("known_treatments") * F.col("known_suggestions")).alias("checked"), state.alias("state"))


def expected_classes(text: Column, table: list[tuple[str, tuple[str, ...]]], fallback: list[tuple[str, tuple[str, ...]]] = ()) -> Column:
    """The classes of all conditions that a diagnosis names (whole words, a plural s allowed); those of its aims where it names none."""
    cited = lambda rows: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(fold(text).rlike(rf"\b{term}s?\b"), strings(c)).otherwise(strings(())) for term, c in rows])))) if rows else strings(())
    return F.when(F.size(cited(table)) > 0, cited(table)).otherwise(cited(list(fallback)))


def aims(text: Column, markers: dict[str, tuple[str, ...]]) -> Column:
    """The aims whose markers a text holds, in the order given."""
    holds = lambda words: F.coalesce(sum([F.contains(fold(text), F.lit(w)).cast("int") for w in words], F.lit(0)) > 0, F.lit(False))
    return F.filter(F.array(*[F.when(holds(w), a) for a, w in markers.items()]).cast(STRINGS), lambda a: a.isNotNull())


def indication_verdict(sought: Column, supported: Column) -> Column:
    """yes, no, or unknown where either side is empty: what isn't known is no reason against."""
    return F.when((F.size(sought) == 0) | (F.size(supported) == 0), "unknown").when(F.arrays_overlap(sought, supported), "yes").otherwise("no")


def step_of(code: Column, steps: list[tuple[int, tuple[str, ...]]]) -> Column:
    """The step that a code announces by its prefix, the first that fits; 0 if none does."""
    out = F.when(F.lit(False), 0)
    for step, prefixes in steps:
        for p in prefixes:
            out = out.when(F.upper(F.trim(code)).startswith(p), step)
    return out.otherwise(0)


def step_penalty(step: Column, intensity: Column) -> Column:
    """25 points for each step above a known intensity."""
    return F.when((step > 0) & (intensity > 0) & (step > intensity), PENALTY["step"] * (step - intensity)).otherwise(0)


def relevance(points: list[tuple[str, int, Column]], less: Column) -> tuple[Column, Column]:
    """(score 0 to 100, reasons): points of all conditions that hold, less a penalty; an unknown condition gives none."""
    total = sum([F.when(c, n).otherwise(0) for _, n, c in points], F.lit(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), total - less)), F.filter(F.array(*[F.when(c, r) for r, _, c in points]).cast(STRINGS), lambda r: r.isNotNull())


def section_text(sections: Column, prefix: str) -> Column:
    """The text of the section whose title begins with a number: subsections first, then sections; empty if none has it."""
    starts = lambda x: F.ltrim(x["title"]).startswith(prefix)
    below = F.filter(F.flatten(F.transform(sections, lambda s: F.coalesce(s["subsections"], F.array().cast("array<struct<title:string,text:string>>")))), starts)
    return F.coalesce(F.get(below, F.lit(0))["text"], F.get(F.filter(sections, starts), F.lit(0))["text"], F.lit(""))


def interaction_state(treatments: Column, suggestions: Column, matched: Column, found: Column, loaded: Column) -> Column:
    """Why there are no interactions is part of the answer: each state differs from `none`."""
    return F.when(treatments == 0, "no treatment").when(suggestions == 0, "no suggestion").when(~loaded, "not verifiable").when(matched == 0, "not matched").when(found > 0, "found").otherwise("none")


def first_rule(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The group of the first keyword that a text holds."""
    out = None
    for word, group in rules:
        hit = F.contains(F.lower(x), F.lit(word))
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(default) if out is not None else F.lit(default)


def filled(x: Column, by: Column, rules: list[tuple[str, str]], severity: Column, defaults: dict[str, str]) -> Column:
    """A text kept where there is one; else that of the first key a name holds; else the default of its severity."""
    key = first_rule(by, rules, "")
    table = F.create_map(*[F.lit(v) for kv in defaults.items() for v in kv])
    return F.coalesce(F.nullif(x, F.lit("")), F.nullif(key, F.lit("")), table[severity])


def flags(x: Column, markers: dict[str, tuple[str, ...]]) -> Column:
    """The classes any of whose markers a substance's name holds, sorted."""
    return F.array_sort(aims(x, markers))


def evidence(level: Column, mechanism: Column, management: Column) -> Column:
    """0.3, 0.6 or 1.0 by level, 0.2 more if mechanism and management are known, at most 1."""
    base = F.when(level == "high", 1.0).when(level == "medium", 0.6).otherwise(0.3)
    return F.least(F.lit(1.0), base + F.when(present(mechanism) & present(management), 0.2).otherwise(0.0))


def age_band(age: Column) -> Column:
    """A ten-year band; 90 and over is one; missing stays missing."""
    low = F.floor(age / 10) * 10
    return F.when(age.isNull(), F.lit(None)).when(age >= 90, "90+").otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))


def collected(fields: dict[str, Column], least: int = 10) -> tuple[Column, Column]:
    """(score, missing): the share of checks passed in percent, fields of at least so many characters; and the names of those that fail."""
    ok = {k: F.coalesce(F.length(F.trim(v)) >= least, F.lit(False)) for k, v in fields.items()}
    passed = sum([c.cast("int") for c in ok.values()], F.lit(0))
    return F.round(100.0 * passed / len(ok), 1), F.filter(F.array(*[F.when(~c, k) for k, c in ok.items()]).cast(STRINGS), lambda k: k.isNotNull())
