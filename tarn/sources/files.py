"""Readers of files as tables: CSV, JSON, XML, positional dumps, zipped tables and sheets. Every schema is stated, so no pass infers it; a row
that doesn't fit it keeps its text in `bad`, and nothing is lost in silence.

CSV, JSON lines, text and positional dumps are split over tasks. A zip archive and a sheet are read whole by the task that has the file; many such
files are spread over tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.windows import keep_best

BAD = "bad"


def records(spark: SparkSession, path, schema: str, sep: str = ",", folder_glob: str | None = None) -> DataFrame:
    """CSV with a header line as rows of a schema, by position; a byte order mark belongs to the header line and does no harm. Adds `bad`."""
    reader = spark.read.schema(f"{schema}, {BAD} string").option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"')
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("encoding", "UTF-8").option("ignoreMissingFiles", True)
    return (reader.option("pathGlobFilter", folder_glob) if folder_glob else reader).csv(path)


def array_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is one array (or one object) as rows. Adds `bad`."""
    return spark.read.schema(f"{schema}, {BAD} string").option("multiLine", True).option("columnNameOfCorruptRecord", BAD).json(path)


def named_parts(spark: SparkSession, folder: str, glob: str, schema: str, pattern: str, name: str) -> DataFrame:
    """CSV files of a folder as one table, with a column that their file names give; files that aren't there are no error."""
    rows = records(spark, folder, schema, folder_glob=glob)
    return rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))


@dataclass(frozen=True)
class Load:
    """A keyed CSV: its columns as text, the keys that a row must have, casts, and values where a column is empty."""

    columns: str
    keys: tuple[str, ...]
    casts: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)


#: The columns, keys and defaults of the graph's node and edge files.
LOADS = {
    "drugs": Load("id title generic_name brand_name atc_code therapeutic_class laboratory form dosage route marketing_status source confidence_score", ("id",), {"confidence_score": "int"}, {"confidence_score": 80}),
    "ingredients": Load("name chemical_formula molecular_weight pharmacological_class mechanism_summary source confidence_score", ("name",), {"molecular_weight": "double", "confidence_score": "int"}, {"molecular_weight": 0.0, "confidence_score": 80}),
    "diseases": Load("name symptoms category icd10_code description source confidence_score", ("name",), {"confidence_score": "int"}, {"confidence_score": 80}),
    "effects": Load("id name severity frequency description source confidence_score", ("id",), {"confidence_score": "int"}, {"confidence_score": 80}),
    "contraindications": Load("id name reason severity category source confidence_score", ("id",), {"confidence_score": "int"}, {"confidence_score": 80}),
    "drug_classes": Load("name mechanism_of_action parent_class description", ("name",)),
    "drug_ingredient": Load("drug_id ingredient_name dosage is_active", ("drug_id", "ingredient_name"), {"is_active": "boolean"}, {"is_active": True}),
    "drug_disease": Load("drug_id disease_name rank evidence_level", ("drug_id", "disease_name"), {"rank": "int"}, {"rank": 1, "evidence_level": "Modéré"}),
    "drug_effect": Load("drug_id effect_id severity frequency", ("drug_id", "effect_id")),
    "drug_contraindication": Load("drug_id contraindication_id reason severity", ("drug_id", "contraindication_id"), {}, {"severity": "Absolue"}),
    "interactions": Load("drug_id_1 drug_id_2 severity mechanism recommendation description risk_score", ("drug_id_1", "drug_id_2"), {"risk_score": "int"}, {"risk_score": 0}),
    "fda_labels": Load("spl_id set_id product_ndc brand_name generic_name active_ingredient indications_and_usage", ("spl_id",)),
}


def typed(rows: DataFrame, load: Load) -> DataFrame:
    """Texts trimmed, empty ones missing; casts that fail are missing; defaults where a value is missing; rows without a key go."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    value = lambda c: text(c).try_cast(load.casts[c]) if c in load.casts else text(c)
    out = rows.select(*[F.coalesce(value(c), F.lit(load.defaults[c])).alias(c) if c in load.defaults else value(c).alias(c) for c in load.columns.split()])
    return out.dropna(subset=list(load.keys))


def graph_tables(spark: SparkSession, folder: str, loads: dict[str, Load] | None = None) -> dict[str, DataFrame]:
    """The node and edge files of a folder by name."""
    return {name: typed(records(spark, f"{folder}/{name}.csv", ", ".join(f"{c} string" for c in load.columns.split())), load) for name, load in (loads or LOADS).items()}


def substances_of(rows: DataFrame, key: str, lists: str, prefix: str = "") -> DataFrame:
    """(id, substance) edges from a `;`-separated column; the id takes the prefix; empty items are no edge."""
    one = rows.select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.explode(F.split(F.coalesce(lists, F.lit("")), ";")).alias("substance"))
    return one.select("id", F.trim("substance").alias("substance")).where("id IS NOT NULL AND substance != ''").distinct()


def compounds(rows: DataFrame, source: str, confidence: int, id_col: str, title: str, code: str, family: str) -> DataFrame:
    """Compounds of a registry in the form of drugs; rows without an id go; codes and families are cut at 20 and 100 characters."""
    text = lambda c, n=None: F.coalesce(F.left(F.col(c), F.lit(n)) if n else F.col(c), F.lit(""))
    out = rows.select(F.trim(F.col(id_col)).alias("id"), text(title).alias("title"), text(code, 20).alias("atc_code"), text(family, 100).alias("therapeutic_class"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence_score"))
    return out.where("id != ''")


def nested_edges(rows: DataFrame, id_col: str, edges: str, other: str, *more: str) -> DataFrame:
    """(src, dst, ...) from an array of structs within each row."""
    return rows.select(F.col(id_col).alias("src"), F.explode(edges).alias("__e")).select("src", F.col(f"__e.{other}").alias("dst"), *[F.col(f"__e.{c}").alias(c) for c in more]).where("src IS NOT NULL AND dst IS NOT NULL")


def interactions_of(rows: DataFrame, a: str, b: str, risk: str, default: int = 50) -> DataFrame:
    """Pairs with a risk, the default where it is no integer."""
    return rows.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.coalesce(F.trim(F.col(risk)).try_cast("int"), F.lit(default)).alias("risk")).where("src != '' AND dst != ''")


def label_edges(labels: DataFrame, drugs: DataFrame) -> DataFrame:
    """(label, drug): labels whose generic or brand name a drug has, letters folded by case.

    Sets of names are matched, each pair of them once; labels and drugs are joined through these, so pairs are not sent about again to be told apart."""

    def named(rows: DataFrame, key: str, own: str, *columns: str) -> DataFrame:
        names = F.filter(F.transform(F.array(*columns), lambda x: F.lower(F.trim(x))), lambda x: x != "")
        return rows.groupBy(F.col(key).alias(own)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias(f"{own}_names"))

    one, two = named(labels, "spl_id", "label", "generic_name", "brand_name"), named(drugs, "id", "drug", "title", "generic_name", "brand_name")
    sets = lambda df, c: df.select(c).distinct().select(c, F.explode(c).alias("name"))
    met = sets(one, "label_names").join(sets(two, "drug_names"), "name").select("label_names", "drug_names").distinct()
    return one.join(met, "label_names").join(two, "drug_names").select("label", "drug")


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of a tag as rows of a schema; the file is split at the tag, never held as a tree."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def primary_id(ids: Column) -> Column:
    """The id marked primary in an array of (_VALUE, _primary), else the first; null of none."""
    marked = F.filter(ids, lambda x: x["_primary"] == "true")
    return F.coalesce(F.get(marked, F.lit(0))["_VALUE"], F.get(ids, F.lit(0))["_VALUE"])


def only_wanted(rows: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """The rows whose id is asked for."""
    return rows.join(wanted.select(F.col(wanted.columns[0]).alias("__wanted")), F.col(id_col) == F.col("__wanted"), "left_semi")


def positional(spark: SparkSession, path: str, fields: list[str], key: str) -> DataFrame:
    """Tab-separated dumps without a header: UTF-8 where the whole file is, else Latin-1; blank and short rows go; fields are trimmed; of rows
    that repeat a key the last stands (of several files, in order of their paths), rows without a key go.

    Files are split over tasks by lines, as bytes. Whether a file is UTF-8 is a sum over its lines, joined back to them: a row a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("raw"))
    sound = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"))
    text = F.when(F.col("utf8"), F.col("raw").cast("string")).otherwise(F.decode("raw", "ISO-8859-1"))
    rows = lines.join(sound, "path").select("path", "block", "line", text.alias("text")).where(F.regexp_replace("text", r"\s", "") != "")
    cells = rows.withColumn("cells", F.split("text", "\t")).where(F.size("cells") >= len(fields))
    out = cells.select("path", "block", "line", *[F.regexp_replace(F.col("cells")[i], r"^\s+|\s+$", "").alias(f) for i, f in enumerate(fields)]).where(F.col(key) != "")
    return keep_best(out, [key], F.desc("path"), F.desc("block"), F.desc("line")).drop("path", "block", "line")


def zipped_tables(spark: SparkSession, path: str, sep: str = "\t", rows: int = 2000) -> DataFrame:
    """(archive, member, line, values map): the rows of the tables within zip archives; empty cells are no key."""

    def read(batches: Iterator):
        import csv

        import pandas as pd

        for g in batches:
            for name, content in zip(g["path"], g["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(archive.namelist()):
                        if not member.endswith((".tsv", ".csv", ".txt")):
                            continue
                        held = []
                        with archive.open(member) as f:
                            for i, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""), delimiter=sep)):
                                held.append((name, member, i, {k: v for k, v in row.items() if k and isinstance(v, str) and v.strip() and v != "NaN"}))
                                if len(held) >= rows:
                                    yield pd.DataFrame(held, columns=["archive", "member", "line", "values"])
                                    held = []
                        yield pd.DataFrame(held, columns=["archive", "member", "line", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "archive string, member string, line long, values map<string,string>")


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, cells by column number) of a sheet of an XLSX workbook, one row at a time."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in e.iter() if tag(t) == "t") for _, e in ElementTree.iterparse(f) if tag(e) == "si"]
        names = {e.get("name"): next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if tag(e) == "sheet"}
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter() if tag(e) == "Relationship"}
        target = targets[names[sheet]]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if tag(row) != "row":
                    continue
                cells: dict[int, str] = {}
                for c in row:
                    at = 0
                    for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                        at = at * 26 + ord(letter) - 64
                    kind, text = c.get("t"), "".join(x.text or "" for x in c.iter() if tag(x) in ("v", "t"))
                    cells[at] = shared[int(text)] if kind == "s" and text else text
                yield int(row.get("r")), cells
                row.clear()


def sheets(spark: SparkSession, path: str, sheet: str, header_row: int) -> DataFrame:
    """(workbook, line, values map): the rows under the header row of a sheet; empty cells are no key."""

    def read(batches: Iterator):
        import pandas as pd

        for g in batches:
            for name, content in zip(g["path"], g["content"]):
                header: dict[int, str] = {}
                held = []
                for at, cells in sheet_rows(content, sheet):
                    if at == header_row:
                        header = cells
                    elif at > header_row:
                        held.append((name, at, {header[k]: v for k, v in cells.items() if header.get(k) and v.strip()}))
                yield pd.DataFrame(held, columns=["workbook", "line", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "workbook string, line long, values map<string,string>")


def authorised(rows: DataFrame) -> DataFrame:
    """Human medicines that are authorised and name a substance, from the rows of a sheet."""
    v = lambda name: F.trim(F.coalesce(F.element_at("values", name), F.lit("")))
    substances = F.filter(F.transform(F.split(v("Active substance"), ";"), lambda s: F.trim(s)), lambda s: s != "")
    kept = rows.where((v("Category") == "Human") & (v("Medicine status") == "Authorised")).select("line", v("Name of medicine").alias("name"), v("EMA product number").alias("number"), v("ATC code (human)").alias("atc_code"), substances.alias("substances"))
    return kept.where(F.size("substances") > 0)
