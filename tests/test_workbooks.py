"""Workbooks: what other programs write, own files, many rows."""

import tracemalloc
import zipfile

import pytest

from orgloom.sources import files
from orgloom.sources import workbooks as B

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>' \
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs></styleSheet>'
STRINGS = f'<sst {MAIN}><si><t>기관명</t></si><si><t xml:space="preserve"> 전화번호 </t></si><si><r><t>은혜</t></r><r><rPr><b/></rPr><t xml:space="preserve"> 교회</t></r><rPh sb="0" eb="1"><t>ignored</t></rPh></si>' \
    '<si><t/></si><si><t>a_x000A_b_x005F_x0041_</t></si></sst>'
SHEET = f'''<?xml version="1.0"?><worksheet {MAIN}><sheetData>
<row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row>
<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>0</v></c></row>
<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4"><v>212345678</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" t="s"><v>3</v></c></row>
<row r="5"><c r="B5" s="1"><v>45296</v></c><c r="C5" s="4"><v>0.75</v></c></row>
<row r="6"/><row r="7"><c r="A7" s="2"/></row>
<row><c t="str"><f>A4&amp;"!"</f><v>은혜 교회!</v></c><c s="3"><v>1.5</v></c><c s="2"><v>45296.5</v></c><c t="e"><v>#N/A</v></c><c><v>9</v></c></row>
<row r="20"><c r="A20" t="s"><v>4</v></c><c r="B20"><v>1E+20</v></c></row>
</sheetData></worksheet>'''


def book(path, sheets, active=0, extra="", prefix=""):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{rel}"><workbookPr {extra}/><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{listed}</sheets></workbook>')
        # places in the archive don't follow the order of the sheets
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{prefix}worksheets/s{len(sheets) - i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", STRINGS)
        z.writestr("xl/styles.xml", STYLES)
        for i, text in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{len(sheets) - i}.xml", text)


def test_cells_of_other_programs(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"목록": SHEET})
    df = B.read_workbook(spark, str(tmp_path), header_row=2)
    assert df.columns == ["기관명", "전화번호", "column2", "기관명.1"]
    assert [tuple(r) for r in df.collect()] == [
        ("은혜 교회", "212345678", "True", None), (None, "2024-01-05 00:00:00", "18:00:00", None),
        ("은혜 교회!", "1.5", "2024-01-05 12:00:00", "#N/A"), ("a\nb_x0041_", "1e+20", None, None)]


def one_cell(text):
    return f'<worksheet {MAIN}><sheetData><row><c t="inlineStr"><is><t>h</t></is></c></row><row>{text}</row></sheetData></worksheet>'


def test_sheets_by_number_name_and_activity(spark, tmp_path):
    inline = lambda t: one_cell(f'<c t="inlineStr"><is><t>{t}</t></is></c>')
    book(tmp_path / "a.xlsx", {"one": inline("1st"), "2": inline("2nd"), "three": inline("3rd")}, active=2, prefix="/xl/")
    for sheet, want in ((0, "1st"), (1, "2nd"), ("2", "2nd"), ("three", "3rd"), ("active", "3rd")):
        assert B.read_workbook(spark, str(tmp_path / "a.xlsx"), sheet=sheet).first().h == want
    with pytest.raises(Exception, match="no sheet"):
        B.read_workbook(spark, str(tmp_path), sheet="none").collect()


@pytest.mark.parametrize("extra,number,want", [("", "1", "1900-01-01 00:00:00"), ("", "59", "1900-02-28 00:00:00"), ("", "61", "1900-03-01 00:00:00"), ('date1904="1"', "0", "00:00:00"), ('date1904="1"', "1", "1904-01-02 00:00:00")])
def test_date_systems(spark, tmp_path, extra, number, want):
    book(tmp_path / "a.xlsx", {"s": one_cell(f'<c s="2"><v>{number}</v></c>')}, extra=extra)
    assert B.read_workbook(spark, str(tmp_path)).first().h == want


ODD = [("a\x01\r\nb", 1, 1.5, True, "x"), ("_x0041_ <&>\"'", None, float("nan"), None, ""), (None, -2**40, 1e300, False, " lead "), ("=1+1", 0, -0.5, True, "중 \U0001f600")]


def test_written_workbooks_come_back(spark, tmp_path):
    df = spark.createDataFrame(ODD, "a string, b long, c double, d boolean, `e f` string")
    path = str(tmp_path / "out")
    for part in (1, 3):
        B.write_workbooks(df.repartition(part), path, title="현황\n기준", sheet_name="시트 & 1")
        got = B.read_workbook(spark, path, header_row=2, sheet="시트 & 1")
        text = lambda v: None if v is None or v == "" else str(int(v)) if isinstance(v, float) and v == v and v.is_integer() and abs(v) < 1e15 else str(v)
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(map(text, row))) for row in ODD)
    assert got.rdd.getNumPartitions() == 3 == len(B._list(path))  # what was there before is gone
    B.write_workbooks(df.limit(0), path)
    empty = B.read_workbook(spark, path)
    assert empty.columns == df.columns and empty.count() == 0


def test_workbook_equals_csv(spark, tmp_path):
    rows = [("가", "서울", "02-123-4567", None, None), (None, "x", None, None, None), ("나", None, "0212345678", "m@x.kr", None), (None,) * 5]
    df = spark.createDataFrame(rows, "name string, phone string, fax string, email string, homepage string")
    B.write_workbooks(df.coalesce(1), str(tmp_path / "x"))
    df.coalesce(1).write.csv(str(tmp_path / "c"), header=True)
    csv = files.read_sheet(spark, str(tmp_path / "c"))
    book_rows = B.read_workbook(spark, str(tmp_path / "x"))
    assert csv.columns == book_rows.columns and sorted(map(str, csv.collect())) == sorted(map(str, book_rows.collect()))
    assert sorted(files.positional(book_rows).collect()) == sorted(files.read_sheet_positional(spark, str(tmp_path / "c")).collect())


def test_files_of_other_columns(spark, tmp_path):
    for name, cols in (("a", "x long, y string"), ("b", "y string, z string")):
        B.write_workbooks(spark.createDataFrame([(1, "p")] if name == "a" else [("q", "r")], cols).coalesce(1), str(tmp_path / name))
    (tmp_path / "~$a.xlsx").write_bytes(b"lock file")
    assert sorted(map(tuple, B.read_workbook(spark, str(tmp_path)).collect()), key=str) == [("1", "p"), (None, "q")]


def test_long_sheets(spark, tmp_path, monkeypatch):
    text = "".join(f"<row><c><v>{i}</v></c><c t=\"inlineStr\"><is><t>name {i}</t></is></c></row>" for i in range(150_000))
    book(tmp_path / "a.xlsx", {"s": f"<worksheet {MAIN}><sheetData>{text}</sheetData></worksheet>"})
    size = len(text)
    del text
    tracemalloc.start()
    assert sum(1 for _ in B.Workbook(open(tmp_path / "a.xlsx", "rb")).rows("0")) == 150_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 10_000_000 and peak < 4_000_000
    # a partition longer than a sheet goes to several files
    monkeypatch.setattr(B, "ROWS", 10)
    writer = B._Writer(B.StructType([B.StructField("n", B.StringType())]), {"path": str(tmp_path / "w")}, True)
    saved = writer.write(iter([B.pa.RecordBatch.from_pydict({"n": [str(i) for i in range(25)]})]))
    assert len(saved.paths) == 3 and B._list(str(tmp_path / "w")) == []  # nothing is seen before the commit
    writer.commit([saved])
    assert sorted(int(r.n) for r in B.read_workbook(spark, str(tmp_path / "w")).collect()) == list(range(25))
    again = B._Writer(writer_schema := B.StructType([B.StructField("n", B.StringType())]), {"path": str(tmp_path / "w")}, True)
    again.abort([again.write(iter([]))])
    assert writer_schema and B.read_workbook(spark, str(tmp_path / "w")).count() == 25


def test_workbooks_of_a_table_in_one_file_are_many(spark, small):
    from orgloom.plans import ingest
    from orgloom.sources import tables as T

    path = ingest._written_workbooks(spark, T.organizations(spark, small).select("name", "phone").coalesce(1))
    assert B.read_workbook(spark, path).rdd.getNumPartitions() > 1
