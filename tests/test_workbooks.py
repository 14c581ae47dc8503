"""Spreadsheets read on the executors, single-file sinks, and the sink that commits or leaves nothing."""

from __future__ import annotations

import json
import os
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from visitframe.sources import files
from visitframe.sources.catalog import Catalog
from visitframe.sources.workbook import Workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_workbook(path: str, sheets: dict[str, str], extra: str = "") -> str:
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{k}" Type="x" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {LINKS}>{extra}<sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>subject</t></si><si><r><t>vis</t></r><r><t>it</t></r><rPh><t>x</t></rPh></si><si><t>Àé &amp; b</t></si></sst>")
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return path


VISITS = (
    '<row r="1"/><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>score</t></is></c><c r="D2" t="str"><v>score</v></c><c r="F2" t="str"><v>ok</v></c></row>'
    '<row r="3"><c r="A3"><v>1</v></c><c r="B3" s="1"><v>43831</v></c><c r="C3"><v>1.5</v></c><c r="D3" s="2"><v>3</v></c><c r="F3" t="b"><v>1</v></c></row>'
    '<row r="4"><c r="A4"><v>2</v></c><c r="B4" s="3"><v>43831.5</v></c><c r="C4"><v>2</v></c><c r="D4" t="s"><v>2</v></c><c r="E4" t="e"><v>#N/A</v></c></row>'
    '<row r="5"><c r="C5"/></row><row r="6"><c r="AB6"><v>9</v></c><c><v>10</v></c></row>'
)
OTHER = '<row><c t="s"><v>0</v></c><c t="str"><v>weight</v></c></row><row><c t="str"><v>x</v></c><c><v>70</v></c></row>'


def test_a_sheet_with_every_kind_of_cell(spark, tmp_path):
    path = make_workbook(str(tmp_path / "visits.xlsx"), {"Visits": VISITS, "Other": OTHER})
    df = files.read_any(spark, path)
    assert df.dtypes == [("subject", "bigint"), ("visit", "timestamp"), ("score", "double"), ("score.1", "string"), ("Unnamed: 4", "string"), ("ok", "boolean")]
    rows = [tuple(r) for r in df.orderBy("subject").collect()]
    assert rows[0] == (None,) * 6  # its only cells lie beyond the header
    assert rows[1:] == [(1, datetime(2020, 1, 1), 1.5, "3", None, True), (2, datetime(2020, 1, 1, 12), 2.0, "Àé & b", None, None)]
    other = files.read_excel(spark, path, "Other")
    assert other.dtypes == [("subject", "string"), ("weight", "bigint")] and [tuple(r) for r in other.collect()] == [("x", 70)]
    with pytest.raises(Exception, match="no sheet None of these"):
        files.read_excel(spark, path, "None of these").collect()


def test_all_sheets_and_files_are_partitions(spark, tmp_path):
    for k in range(3):
        make_workbook(str(tmp_path / f"w{k}.xlsx"), {"Visits": VISITS, "Other": OTHER})
    df = files.read_excel(spark, str(tmp_path / "*.xlsx"), "*")
    assert df.rdd.getNumPartitions() == 6 and df.columns[:2] == ["sheet", "subject"] and "weight" in df.columns
    assert {r["sheet"]: r["n"] for r in df.groupBy("sheet").agg(F.count("*").alias("n")).collect()} == {"Visits": 9, "Other": 3}
    assert df.schema["subject"].dataType.simpleString() == "string"  # numbers in one sheet, text in the other


def test_given_schema_and_old_dates(spark, tmp_path):
    path = make_workbook(str(tmp_path / "old.xlsx"), {"A": VISITS}, '<workbookPr date1904="1"/>')
    df = files.read_excel(spark, path, schema="ok boolean, visit timestamp, score long, absent string")
    assert {(r["visit"], r["score"]) for r in df.where("visit is not null").collect()} == {(datetime(2024, 1, 2), None), (datetime(2024, 1, 2, 12), 2)}
    with open(path, "rb") as file:
        assert list(Workbook(file).sheets) == ["A"]
    empty = make_workbook(str(tmp_path / "empty.xlsx"), {"A": ""})
    assert files.read_excel(spark, empty).columns == []


def test_single_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, 3.5)], "n int, name string, mean double")
    files.write_single(df, str(tmp_path / "s.csv"), ["name"], ["n"])
    assert (tmp_path / "s.csv").read_text().splitlines() == ["name,mean,n", "a,2.5,1", ",3.5,2"]
    files.write_single(df, str(tmp_path / "s.txt"))
    assert "mean" in (tmp_path / "s.txt").read_text()
    made = files.write_pair(df, str(tmp_path / "pair"))
    assert json.loads((tmp_path / "pair.json").read_text())[0] == {"n": 1, "name": "a", "mean": 2.5} and all(os.path.isfile(p) for p in made)
    with pytest.raises(ValueError, match="rows"):
        files.write_single(df, str(tmp_path / "t.csv"), most=1)


def everything(root) -> set[str]:
    return {os.path.join(d, f) for d, _, found in os.walk(root) for f in found}


def test_a_version_is_there_when_its_files_are(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    df = spark.range(1000).repartition(4).select("id", F.lit("x").alias("Name"))
    c.store(df, "table", metadata={"Level": "raw"})
    assert c.load_first({"custom.Level": "raw"}).agg(F.sum("id")).first()[0] == 499500
    c.store(df.where("id < 10"), "table", prefix="p", metadata={"Level": "p"})
    c.store(df.limit(0), "table", metadata={"Level": "none"})
    assert c.load_first({"custom.Level": "none"}).count() == 0 and c.load_first({"custom.Level": "p"}).count() == 10
    assert [r["version"] for r in c._log().orderBy("version").collect()] == [1, 2, 3]


def test_a_failed_task_leaves_no_row_and_no_file(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.store(spark.range(5), "good")
    before = everything(tmp_path)
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        c.store(bad, "bad")
    assert everything(tmp_path) == before and c.search({"object_name": "bad"}).count() == 0


def test_any_file_is_uploaded_as_it_is(spark, tmp_path):
    path = make_workbook(str(tmp_path / "in.xlsx"), {"Other": OTHER})
    c = Catalog(spark, str(tmp_path / "store"))
    kept = c.upload_file(path, "book", metadata={"level": "raw"})
    assert open(kept, "rb").read() == open(path, "rb").read()
    assert c.load_first({"object_name": "book"}).first()["weight"] == 70


def test_reversed_tables_are_published_under_their_name(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert c.publish_reversed(spark.range(3), "ABC", "visits_20240101.csv") == "visits_reversed.csv"
    assert c.load_first({"custom.file_code": "ABC", "prefix": "synthetic/reversed"}).count() == 3
