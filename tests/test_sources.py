import json
import zipfile

from talentloom.functions.context import expanded, read_request
from talentloom.sources import readers, sinks
from talentloom.streaming import history


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Full Name,E-Mail,e mail\nAnn, a@b.c ,x\n,,\nBob,,\n")
    rows = readers.csv_rows(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["full_name", "e_mail", "e_mail_2"]
    (tmp_path / "b.csv").write_text("Name,NAME ,x\na,b,c\n")
    assert [r.asDict() for r in readers.csv_rows(spark, str(tmp_path / "b.csv")).collect()] == [{"name": "a", "x": "c"}]
    assert sorted(tuple(r) for r in rows.collect()) == [("Ann", "a@b.c", "x"), ("Bob", None, None)]


def test_workbook(spark, tmp_path):
    cell = lambda r, v: f'<c r="{r}" t="s"><v>{v}</v></c>'
    sheet = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{cell("A1", 0)}{cell("B1", 1)}</row><row>{cell("A2", 2)}<c r="B2"><v>5</v></c></row><row></row></sheetData></worksheet>'
    texts = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><t>Years</t></si><si><t>Ann</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as f:
        f.writestr("xl/worksheets/sheet1.xml", sheet)
        f.writestr("xl/sharedStrings.xml", texts)
    (tmp_path / "b.xlsx").write_text("no zip")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.workbook_rows(spark, str(tmp_path)).collect()}
    assert rows["a.xlsx"].cells == {"name": "Ann", "years": "5"} and rows["a.xlsx"].error is None
    assert rows["b.xlsx"].error.startswith("BadZipFile")


def test_named_sheets_and_repeated_headers(spark, tmp_path):
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda *rows: f"<worksheet {space}><sheetData>" + "".join("<row>" + "".join(cell(f"{'ABC'[i]}{k}", v) for i, v in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as f:
        f.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Notes" r:id="r2"/><sheet name="People" r:id="r1"/></sheets></workbook>')
        f.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        f.writestr("xl/worksheets/sheet1.xml", sheet(("Name", "name ", "Age"), ("Ann", "other", "7")))
        f.writestr("xl/worksheets/sheet2.xml", sheet(("Note",), ("n",)))
    (tmp_path / "b.pdf").write_text("x")
    (tmp_path / "c.txt").write_text("x")
    path = str(tmp_path / "a.xlsx")
    assert [(r["at"], r.sheet) for r in readers.sheet_names(spark, path).orderBy("at").collect()] == [(0, "Notes"), (1, "People")]
    assert [r.cells for r in readers.workbook_rows(spark, path).collect()] == [{"note": "n"}]
    assert [r.cells for r in readers.workbook_rows(spark, path, "People").collect()] == [{"name": "Ann", "age": "7"}]
    assert readers.workbook_rows(spark, path, "None").first().error.startswith("KeyError")
    kinds = {r.path.rsplit("/", 1)[1]: (r.kind, r.is_supported) for r in readers.file_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"a.xlsx": ("spreadsheet", True), "b.pdf": ("other", False), "c.txt": ("text", True)}


def test_document_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n  two")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>three</w:t></w:r></w:p><w:p><w:r><w:t>four</w:t></w:r></w:p></w:document>')
    (tmp_path / "c.pdf").write_text("x")
    got = {r.path[-5:]: (r.text, r.error) for r in readers.document_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("one two", None), ".docx"[-5:]: ("three four", None), "c.pdf": (None, "unsupported kind")}


def test_json_values(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps(["Python", "sql", "PYTHON ", "SQL", ""]))
    assert [r[0] for r in readers.json_values(spark, str(tmp_path / "v.json")).collect()] == ["Python", "sql"]


def test_sinks(spark, tmp_path):
    sinks.append_searches(spark.createDataFrame([("u", "q")], "user_id string, query string"), str(tmp_path / "s"), "ai")
    sinks.append_searches(spark.createDataFrame([("v", "r")], "user_id string, query string"), str(tmp_path / "s"), "manual", saved=True)
    rows = spark.read.parquet(str(tmp_path / "s")).collect()
    assert {(r.user_id, r.search_type, r.is_saved) for r in rows} == {("u", "ai", False), ("v", "manual", True)} and len({r.search_id for r in rows}) == 2


def test_report(spark, tmp_path):
    sinks.report(spark.createDataFrame([(1, "ok")], "row int, outcome string"), str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "r")).select("row", "outcome").collect()] == [(1, "ok")]


def test_windowed_counts_of_a_stream(spark, small):
    from pyspark.sql import functions as F

    path = f"{small}/events.parquet"
    rows = lambda df: history.windowed_counts(df.withColumn("ts", F.to_timestamp("ts")))
    sink = rows(history.events_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    sink.awaitTermination()
    want = sorted(map(tuple, rows(spark.read.parquet(path)).collect()))
    assert len(want) > 1 and sorted(map(tuple, spark.table("windowed").collect())) == want


def test_requests():
    r = read_request("Looking for a sales manager with python, sql in Mumbai, minimum 5 years, budget up to 12 lakh, immediate joiner, MBA")
    assert (r.role, r.location, r.min_years, r.max_years, r.max_lakh, r.notice, r.education) == ("sales manager", "mumbai", 5.0, None, 12.0, "immediate", ("MBA",))
    assert {"python", "sql"} <= set(r.skills) and "mumbai" in expanded(r)
    assert (read_request("3 to 5 years experience").min_years, read_request("4 years experience").max_years) == (3.0, 4.5)
