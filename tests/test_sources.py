"""Readers, section trees and sinks on small files with awkward rows."""

import json
import zipfile

from pyspark.sql import functions as F

from tarn.sources import files as S
from tarn.sources import pages as P
from tarn.sources import sinks as K


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv_with_a_byte_order_mark_quotes_and_bad_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿id,name,n\n1,\"a, \"\"b\"\"\nc\",2\n,x,y\n3,é,\n".encode())
    got = S.records(spark, str(path), "id int, name string, n int")
    assert rows(got.select("id", "name", "n")) == sorted([(1, 'a, "b"\nc', 2), (None, "x", None), (3, "é", None)], key=str)
    assert [r["bad"] is not None for r in got.orderBy("name").collect()] == [False, True, False]


def test_json_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"id": "D1", "with": [{"id": "D2", "text": "t"}, {"id": None, "text": "u"}]}, {"id": "D3", "with": None}]))
    got = S.array_of(spark, str(path), "id string, with array<struct<id:string,text:string>>")
    assert got.count() == 2
    assert rows(S.nested_edges(got, "id", "with", "id", "text")) == [("D1", "D2", "t")]


def test_files_with_the_category_in_their_name(spark, tmp_path):
    for letter, body in (("A", "a,b\n1,2\n"), ("B", "a,b\n3,4\n")):
        (tmp_path / f"ddi_code_{letter}.csv").write_text(body)
    (tmp_path / "other.csv").write_text("a,b\n9,9\n")
    got = S.named_parts(spark, str(tmp_path), "ddi_code_*.csv", "a int, b int", r"_code_(\w+)\.", "category")
    assert rows(got.select("a", "b", "category")) == [(1, 2, "A"), (3, 4, "B")]


def test_graph_tables_have_types_defaults_and_keys(spark, tmp_path):
    for name, load in S.LOADS.items():
        columns = load.columns.split()
        line = lambda **kv: ",".join(kv.get(c, "") for c in columns) + "\n"  # noqa: B023, E731
        keyed = {k: f"{k}1" for k in load.keys}
        (tmp_path / f"{name}.csv").write_text(",".join(columns) + "\n" + line(**keyed) + line(**{c: "5" for c in columns if c not in load.keys}) + line(**{k: f"{k}2" for k in load.keys}, **{c: "x" for c in load.casts}))
    got = S.graph_tables(spark, str(tmp_path))
    assert len(got) == 12
    for name, load in S.LOADS.items():
        found = [r.asDict() for r in got[name].collect()]
        assert len(found) == 2, name  # the row without a key goes
        assert all(r[c] == load.defaults.get(c) for r in found for c in r if c not in load.keys), (name, found)
    assert dict(got["drugs"].dtypes)["confidence_score"] == "int" and dict(got["ingredients"].dtypes)["molecular_weight"] == "double"


def test_projections_of_registries(spark):
    raw = spark.createDataFrame([(" D1 ", "n", "A" * 30, "c" * 120), ("", "x", None, None), (None, "y", "a", "b")], "drugbank_id string, name string, atc_codes string, classification string")
    assert rows(S.compounds(raw, "R", 95, "drugbank_id", "name", "atc_codes", "classification")) == [("D1", "n", "A" * 20, "c" * 100, "R", 95)]
    lists = spark.createDataFrame([("1", " a ; b;;a"), ("2", None), (None, "c")], "cis string, substances string")
    assert rows(S.substances_of(lists, "cis", "substances", "ANSM-")) == [("ANSM-1", "a"), ("ANSM-1", "b")]
    pairs = spark.createDataFrame([("a", "b", " 7"), ("a", "c", "x"), ("a", "", "1")], "a string, b string, risk string")
    assert rows(S.interactions_of(pairs, "a", "b", "risk")) == [("a", "b", 7), ("a", "c", 50)]
    labels = spark.createDataFrame([("L1", "Aspirin ", None), ("L2", None, "ACME"), ("L3", "", "")], "spl_id string, generic_name string, brand_name string")
    drugs = spark.createDataFrame([("D1", "aspirin", "aspirin", ""), ("D2", "x", None, "Acme")], "id string, title string, generic_name string, brand_name string")
    assert rows(S.label_edges(labels, drugs)) == [("L1", "D1"), ("L2", "D2")]


def test_xml_elements(spark, tmp_path):
    path = tmp_path / "a.xml"
    drug = lambda ids, name: f"<drug>{''.join(ids)}<name>{name}</name></drug>"
    path.write_text('<?xml version="1.0"?><drugbank>' + drug(['<drugbank-id>S1</drugbank-id>', '<drugbank-id primary="true">D1</drugbank-id>'], "one") + drug(["<drugbank-id>D2</drugbank-id>"], "two") + drug([], "three") + "</drugbank>")
    got = S.xml_records(spark, str(path), "drug", "`drugbank-id` array<struct<_VALUE:string,_primary:string>>, name string")
    named = got.select(S.primary_id(F.col("drugbank-id")).alias("id"), "name")
    assert rows(named) == sorted([("D1", "one"), ("D2", "two"), (None, "three")], key=str)
    assert rows(S.only_wanted(named, "id", spark.createDataFrame([("D2",), ("D9",)], "w string"))) == [("D2", "two")]


def test_positional_dumps(spark, tmp_path):
    (tmp_path / "1.txt").write_bytes("1\tdénomination \tx\r\n\n \t \t\n2\tshort\n1\tlast\ty\n\tno key\tz\n".encode("latin-1"))
    (tmp_path / "2.txt").write_bytes("3\tœuvre\tü\n".encode())
    got = S.positional(spark, str(tmp_path), ["cis", "name", "form"], "cis")
    assert rows(got) == [("1", "last", "y"), ("3", "œuvre", "ü")]
    one = S.positional(spark, str(tmp_path / "1.txt"), ["cis", "name"], "name")
    assert ("1", "dénomination") in rows(one)


def test_positional_dumps_are_split_by_lines(spark, tmp_path):
    """The last row of a key stands, whichever task reads it; a byte that is no UTF-8 in one split decides for the whole file."""
    lines = [f"{i % 500}\tname {i}\té{i}" for i in range(20_000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.txt").write_bytes("\n".join(lines[:300] + ["é\té\té"]).encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        read = S.positional(spark, str(tmp_path), ["key", "name", "more"], "key")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        want = {str(i % 500): (f"name {i}", f"é{i}") for i in range(20_000)} | {str(i): (f"name {i}", f"é{i}") for i in range(300)} | {"é": ("é", "é")}
        assert {r["key"]: (r["name"], r["more"]) for r in read.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rebuilds_switch_only_if_equal(spark, tmp_path):
    folder, df = str(tmp_path / "i"), spark.createDataFrame([(1, "a", [1.0]), (2, None, []), (2, None, [])], "id long, name string, v array<double>")
    assert K.rebuild(df, folder, "v1") == {"ok": True, "expected": 3, "actual": 3, "same_rows": True} and K.current(spark, folder).count() == 3
    for built in (df.limit(2), df.withColumn("name", F.lit("b")), df.union(df.limit(1)), df.limit(2).union(df.where("id = 1")), df.limit(0)):
        found = K.switched(df, built, folder, "v2")
        assert not found["ok"] and found["expected"] == 3 and found["actual"] == built.count() and not found["same_rows"]
    assert K.current(spark, folder).inputFiles()[0].split("/")[-2] == "v1"
    assert K.switched(df, df.orderBy(F.desc("id")).select("v", "name", "id"), folder, "v1")["ok"] and K.switched(df.limit(0), df.limit(0), folder, "v1")["ok"]


def test_zipped_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.tsv", "﻿id\tname\n1\ta\n2\t\n3\tNaN\n")
        z.writestr("readme.md", "no table")
    got = S.zipped_tables(spark, str(tmp_path / "a.zip"), rows=2).orderBy("line").collect()
    assert [(r["member"], r["line"], r["values"]) for r in got] == [("t.tsv", 0, {"id": "1", "name": "a"}), ("t.tsv", 1, {"id": "2"}), ("t.tsv", 2, {"id": "3"})]


def test_sheets(spark, tmp_path):
    head = ["Category", "Medicine status", "Name of medicine", "Active substance", "EMA product number", "ATC code (human)"]
    body = [["Human", "Authorised", "Alpha", " a ; b;", "E1", "A01"], ["Veterinary", "Authorised", "Vet", "v", "E2", ""], ["Human", "Withdrawn", "Old", "o", "E3", ""], ["Human", "Authorised", "None", "", "E4", ""]]
    strings = sorted({x for row in [head, *body] for x in row if x})
    cell = lambda r, c, x: f'<c r="{chr(64 + c)}{r}" t="s"><v>{strings.index(x)}</v></c>' if x else ""
    line = lambda r, row: f'<row r="{r}">' + "".join(cell(r, c, x) for c, x in enumerate(row, 1)) + "</row>"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://r"><sheets><sheet name="Medicine" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + line(1, ["Category"]) + line(3, head) + "".join(line(4 + i, r) for i, r in enumerate(body)) + "</sheetData></worksheet>")
    got = S.authorised(S.sheets(spark, str(tmp_path / "a.xlsx"), "Medicine", 3)).collect()
    assert [(r["name"], r["number"], r["atc_code"], r["substances"]) for r in got] == [("Alpha", "E1", "A01", ["a", "b"])]


PAGE = """<html><head><title>T</title><script>var x = "<h2>no</h2>";</script></head><body><p>before</p><a name="RcpDenomination"></a><p class="DateNotif">Mis à jour le : 05/03/2024</p>
<p class="AmmAnnexeTitre1"><a>1. NAME</a></p><p>Drug <b>X</b>&nbsp;5 mg</p><p class="AmmAnnexeTitre2">1.1 Sub</p><div>inner</div>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><p>2</p></td></tr><tr><td></td><td> </td></tr></table>
<p class="AmmAnnexeTitre3">deep</p>text of deep<p class="AmmAnnexeTitre2">1.2 Sub</p><h1>2. NEXT</h1><p>end<p>unclosed"""


def test_section_trees(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<p>only text")], "page_id long, html string")
    got = {}
    for r in P.html_sections(pages, "page_id", "html").collect():
        got.setdefault(r["page_id"], {})[r["title"]] = (r["parent"], r["level"], [c["text"] if c["kind"] == "text" else (c["rows"], c["headers"]) for c in r["content"]], r["section"])
    one = got[1]
    number = {k: v[3] for k, v in one.items()}
    assert sorted(got) == [1, 4] and got[4][""][2] == ["only text"]
    assert {k: v[1] for k, v in one.items()} == {"": 0, "1. NAME": 1, "1.1 Sub": 2, "deep": 3, "1.2 Sub": 2, "2. NEXT": 1}
    assert one["1. NAME"][2] == ["Drug X 5 mg"] and one["1.1 Sub"][2] == ["inner", ([["a", "b"], ["1", "2"]], ["a", "b"])] and one["deep"][2] == ["text of deep"] and one["2. NEXT"][2] == ["end", "unclosed"]
    assert [one[k][0] for k in ("1. NAME", "1.1 Sub", "deep", "1.2 Sub", "2. NEXT")] == [0, number["1. NAME"], number["1.1 Sub"], number["1. NAME"], 0]
    later = P.html_sections(pages, "page_id", "html", start="RcpDenomination").where("section = 0 AND page_id = 1").first()
    assert [c["text"] for c in later["content"]] == ["Mis à jour le : 05/03/2024"]


DEEP = """<body><h1>One that</h1><p>a</p><h2>That two</h2><ul><li>item <b>x</b></li></ul><ol><li><i>n</i></li></ol><h3>three</h3><p class="AmmListePuces souligne">dot</p><h4>THAT four</h4><p style="text-align: center">deep 123</p>
<h5>that five</h5><p>too deep 456</p><table><tr><th>h</th></tr><tr><td>cell 789</td></tr></table><h2>that last</h2><p class="AmmCorpsTexteGras">bold</p>"""


def test_sections_have_paths_and_blocks_have_formats(spark):
    pages = spark.createDataFrame([(1, DEEP), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    tree = P.html_sections(pages, "page_id", "html")
    rows_of = {r["title"]: r for r in tree.where("page_id = 1").collect()}
    at = {k: r["section"] for k, r in rows_of.items()}
    assert {k: r["path"] for k, r in rows_of.items()} == {"One that": [], "That two": [at["One that"]], "three": [at["One that"], at["That two"]], "THAT four": [at["One that"], at["That two"], at["three"]], "that five": [at["One that"], at["That two"], at["three"], at["THAT four"]], "that last": [at["One that"]]}
    how = lambda title, i: tuple(rows_of[title]["content"][i]["format"])  # noqa: E731  bold, italic, underline, list, align
    assert how("That two", 0) == (True, False, False, "bullet", "left") and how("That two", 1) == (False, True, False, "numbered", "left") and how("three", 0) == (False, False, True, "bullet", "left")
    assert how("THAT four", 0) == (False, False, False, None, "center") and how("that last", 0) == (True, False, False, None, "left") and rows_of["that five"]["content"][1]["format"] is None
    assert rows(P.keyword_text(tree, "page_id", ["that"])) == [(1, "a item x n deep 123 bold")] and rows(P.keyword_text(tree, "page_id", ["five", "a.b"], depth=4)) == [(1, "too deep 456 h cell 789")] and P.keyword_text(tree, "page_id", ["five"]).count() == 0
    assert rows(P.keyword_groups(tree, "page_id", {"x": ["that"], "y": ["three", "last"], "z": ["no"]})) == [(1, "a item x n deep 123 bold", "dot bold", "")]
    assert rows(P.pages_with(tree, "page_id", "[0-9]{3}")) == [(1,)] and P.pages_with(tree, "page_id", "456|789").count() == 0 and rows(P.pages_with(tree, "page_id", "^cell 789$", depth=4)) == [(1,)] and rows(P.pages_with(tree, "page_id", "none")) == [(2,)]


def test_page_facts(spark):
    page = "<h1>Drug X 5 mg</h1><p>ANSM - Mis à jour le : <b>05/03/2024</b></p><p>Titulaire de l'autorisation : ACME Labs. Dose 5 mg, 2,5 mg/ml et 5 mg</p>"
    got = spark.createDataFrame([(page,), ("",)], "html string").select(*[c.alias(k) for k, c in P.page_facts(F.col("html")).items()]).collect()
    assert tuple(got[0]) == ("Drug X 5 mg", "05/03/2024", "ACME Labs", ["5 mg", "2,5 mg/ml"]) and tuple(got[1]) == (None, None, None, [])


def composed(spark, *texts):
    rows = spark.createDataFrame([(x,) for x in texts], "x array<string>").select(P.composition(F.coalesce("x", F.array().cast("array<string>"))).alias("s")).collect()
    return [r["s"] for r in rows]


def test_composition(spark):
    lines = ["Paracétamol (DC) ........ 500,0 mg", "Chaque comprimé contient 5 mg de ramipril et 10 mg d'amlodipine.", "Eau purifiée ..... 3 ml", "contient : acide acétylsalicylique.", "PARACÉTAMOL 500 mg", "rien"]
    assert composed(spark, lines, [], None) == [["Paracétamol", "ramipril", "amlodipine", "Eau purifiée"], [], []]


def test_substances_stand_alone_or_not(spark):
    """Words that are no substance count only alone; measures give way to what they measure; tails, lead-ins and brackets go."""
    one = {
        "Sodium ...... 3 mg": [], "Sodium bicarbonate ...... 3 mg": ["Sodium bicarbonate"], "potassium 5 mg": [], "Potassium (chlorure de) 5 mg": [], "Chlorure de potassium 5 mg": ["Chlorure de potassium"], "Solution ..... 3 ml": [],
        "Magnesium .... 1 g": [], "Excellent produit .... 1 g": ["Excellent produit"], "Composition : Ibuprofène 200 mg": ["Ibuprofène"], "Quantité correspondant à ibuprofène 200 mg": ["ibuprofène"], "Substances actives : kétoprofène ....": ["kétoprofène"],
        "Chaque gélule contient environ 20,5 mg de l'oméprazole (base), soit 2": ["oméprazole"], "Le flacon contient de la vancomycine.": ["vancomycine"], "Activité anti-Xa de daltéparine sodique 5000 UI": ["daltéparine sodique"], "Activité 5000 UI": [],
        "Amoxicilline sous forme trihydratée 500 mg": ["Amoxicilline"], "Insuline par ml 100 UI": ["Insuline"], "Insuline par 3 ml 100 UI": ["Insuline par"], "Ab ..... 1 mg": [], "1 2 3 ..... 4 mg": [], "Fer": [], "Eau pour préparations .... 1 ml": ["Eau pour préparations"],
    }
    assert dict(zip(one, composed(spark, *[[k] for k in one]))) == one
    assert composed(spark, ["Alpha .... 1 mg", "Excipients : lactose", "Beta .... 1 mg"], ["3. FORME PHARMACEUTIQUE", "Beta .... 1 mg"], [f"{c * 4} .... 1 mg" for c in "ABCDEFGH"]) == [["Alpha"], [], [c * 4 for c in "ABCDEF"]]


def test_best_chain_of_landmarks():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(300):
        found = [(rng.randrange(6), rng.randrange(1, 3), 0) for _ in range(rng.randrange(9))]
        got = P.best_chain(found)
        chains = [c for n in range(len(found) + 1) for c in itertools.combinations(range(len(found)), n) if all(found[a][0] < found[b][0] for a, b in itertools.pairwise(c))]
        assert tuple(got) in chains and sum(found[i][1] for i in got) == max(sum(found[i][1] for i in c) for c in chains)


def test_plans_of_long_texts(spark):
    """A table of contents, references at the beginning of a line, sections left out, the closing sentence and the annex."""
    toc = "TABLE\n1. A\n2. B\n4. C\n4.1 D\n4.2 E\n10. F\n"
    body = "1. A\nfirst text\ngoes on.\n- item\n2. B\nsee\n4.2 above.\n12\n4. C\n4.1 D\nd text\n4.2 E\ne text\n4.1 is above\n10. F\nmore http://www.EMA.europa.eu/x end\n11. after\nrest\n"
    df = spark.createDataFrame([(1, toc + body + "ANNEXE II\n12. no\n"), (2, ""), (3, None), (4, "no plan"), (5, "4.1 D\nx\n" + "y" * 900)], "id long, text string")
    got = P.plan_sections(df, "id", "text")
    one = {r["number"]: (r["parent"], r["paragraphs"]) for r in got.where("id = 1").collect()}
    assert one == {"1": (None, ["A first text goes on.", "- item"]), "2": (None, ["B see 4.2 above."]), "4": (None, []), "4.1": ("4", ["D d text"]), "4.2": ("4", ["E e text 4.1 is above"]), "10": (None, ["F more http://www.EMA.europa.eu/x end"])}
    last = got.where("id = 5").collect()
    assert [(r["number"], r["parent"], r["end"] - r["start"]) for r in last] == [("4.1", None, 600)] and got.where("id in (2, 3, 4)").count() == 0
    assert [tuple(r) for r in P.plan_usable(got, "id").orderBy("id").collect()] == [(1, 4, 6, False), (5, 0, 0, False)]


def test_heading_sections_and_plans(spark):
    text = "noise\n1. NAME OF IT\na\n\nb\n1.1 SUB PART\nc\nEND:\n"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id long, text string")
    got = P.heading_sections(docs, "id", "text")
    assert rows(got) == [(1, 1, "1. NAME OF IT", ["a", "b"]), (1, 2, "1.1 SUB PART", ["c"]), (1, 3, "END:", [])]
    assert rows(P.usable(got, "id", 3, 3)) == [(1, 3, 3, True)] and rows(P.usable(got, "id")) == [(1, 3, 3, False)]


def test_versions(spark, tmp_path):
    folder, kind = str(tmp_path / "t"), "id long, name string, made string"
    assert K.current(spark, folder) is None
    first = K.upsert_into(spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], kind), folder, "v1", ["id"], ["made"])
    assert rows(first) == [(1, "a", "x"), (2, "b", "x")]
    second = K.upsert_into(spark.createDataFrame([(2, "c", "y"), (3, "d", "y")], kind), folder, "v2", ["id"], ["made"])
    assert rows(second) == [(1, "a", "x"), (2, "c", "x"), (3, "d", "y")]
    assert not K.publish(second.limit(1), folder, "v3", least=3) and K.current(spark, folder).count() == 3
    assert K.publish(second.where("id > 1"), folder, "v4", least=2) and K.current(spark, folder).count() == 2
    K.export_json(second, str(tmp_path / "json"))
    assert rows(spark.read.schema(kind).json(str(tmp_path / "json"))) == rows(second)


def test_sample_is_the_same_in_every_run(spark):
    df = spark.range(1000).repartition(5)
    assert rows(K.sample_of(df, "id", 10)) == rows(K.sample_of(df.repartition(3), "id", 10)) and K.sample_of(df, "id", 10).count() == 10
    assert rows(K.sample_of(df, "id", 10)) != rows(K.sample_of(df, "id", 10, seed=1))
