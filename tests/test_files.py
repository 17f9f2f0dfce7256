"""Readers and writers on the layouts the sources come in."""

import json

import pytest
from pyspark.sql import functions as F

from orgloom.operators import ingest as I
from orgloom.sources import files, sinks


def put(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_json_by_category(spark, tmp_path):
    doc = {"churches": [{"name": "A", "phone": "1"}, "not an object"], "centers": [{"name": "B", "homepage": ""}]}
    path = put(tmp_path, "a.json", json.dumps(doc, ensure_ascii=False, indent=2))
    got = {(r.name, r.category, r.phone) for r in files.read_json_by_category(spark, path).collect()}
    assert got == {("A", "churches", "1"), ("B", "centers", None)}
    flat = put(tmp_path, "b.json", json.dumps([{"name": "C", "category": "x"}]))
    assert [tuple(r) for r in files.read_json_by_category(spark, flat).select("name", "category").collect()] == [("C", "x")]


@pytest.mark.parametrize("doc, names", [({"churches": [{"name": "A"}], "metadata": {"n": 1}}, ["A"]), ([{"name": "B"}, {"name": "C"}], ["B", "C"]), ({"name": "D"}, ["D"])])
def test_json_wrapped(spark, tmp_path, doc, names):
    path = put(tmp_path, "w.json", json.dumps(doc, indent=1))
    assert sorted(r.name for r in files.read_json_wrapped(spark, path).collect()) == names


@pytest.mark.parametrize("encoding, bom", [("utf-8", "﻿"), ("cp949", ""), ("euc-kr", "")])
def test_csv_encodings(spark, tmp_path, encoding, bom):
    path = put(tmp_path, "c.csv", bom + '기관명,전화번호,메모\n은혜교회,"032-821-5367, 032-817-5367",\n햇살센터,,"a ""b"""\n', encoding)
    df = files.read_csv_encodings(spark, path)
    assert df.columns == ["기관명", "전화번호", "메모"]
    assert [tuple(r) for r in df.orderBy("기관명").collect()] == [("은혜교회", "032-821-5367, 032-817-5367", None), ("햇살센터", None, 'a "b"')]


def test_latin1_is_the_last_resort(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes(b"name,city\nCaf\xe9,\xff\xfe\x80\n")
    assert files.pick_encoding(spark, str(path)) == "latin1"


def test_sheet_with_title_lines(spark, tmp_path):
    path = put(tmp_path, "s.csv", "지역아동센터 현황,,\n기준 2024,,\n 기관명 ,주소,전화번호\n가,서울,02-123-4567\n,,\n나,,\n")
    df = files.read_sheet(spark, path, header_row=2)
    assert df.columns == ["기관명", "주소", "전화번호"]
    assert [tuple(r) for r in df.orderBy("기관명").collect()] == [("가", "서울", "02-123-4567"), ("나", None, None)]


def test_positional_sheet(spark, tmp_path):
    path = put(tmp_path, "p.csv", "a,b,c,d,e\nX,0212345678,12,m@x.kr,x.kr\n,02-111-2222,,,\n")
    assert [tuple(r) for r in files.read_sheet_positional(spark, path).collect()] == [("X", "02-1234-5678", "12", "m@x.kr", "x.kr")]


def test_keyword_mapping_order():
    got = I.keyword_mapping(["학원명", "도로명주소", "전화번호(팩스)", "연락처", "팩스번호", "E-Mail", "교습과정명", "상호명"])
    assert got == {"name": "상호명", "address": "도로명주소", "phone": "연락처", "fax": "팩스번호", "email": "E-Mail", "category": "교습과정명"}


def test_exact_mapping_later_column_wins():
    assert I.exact_mapping([" 기관명 ", "전화", "전화번호"]) == {"name": " 기관명 ", "phone": "전화번호"}


def test_csv_round_trip(spark, tmp_path):
    # NULL and '' are both written as an empty field
    df = spark.createDataFrame([(1, ' a "q", b ', ""), (2, None, "x\ny")], "id int, a string, b string")
    path = str(tmp_path / "out")
    sinks.write_csv(df, path, sort="id")
    back = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, emptyValue="")
    assert sorted((r.id, r.a, r.b) for r in back.collect()) == [("1", ' a "q", b ', None), ("2", None, "x\ny")]


def test_add_columns_only_when_absent(spark):
    df = spark.createDataFrame([(True,)], "ai_crawled boolean")
    out = I.add_columns_if_absent(df, {"ai_crawled": F.lit(False), "last_crawled_at": F.lit(None).cast("timestamp_ntz")})
    assert out.first().ai_crawled is True and out.columns == ["ai_crawled", "last_crawled_at"]


def test_scratch_folder_only_for_local_sessions():
    from types import SimpleNamespace as N

    from orgloom.session import checkpoint_root

    conf = lambda value: N(get=lambda *_: value)
    assert checkpoint_root(N(conf=conf("hdfs://x/cp/"))) == "hdfs://x/cp"
    local = N(conf=conf(None), sparkContext=N(master="local[2]", applicationId="a"))
    assert checkpoint_root(local) == checkpoint_root(local)
    with pytest.raises(ValueError):
        checkpoint_root(N(conf=conf(None), sparkContext=N(master="spark://m:7077", applicationId="b")))


def test_json_with_other_values_beside_the_lists(spark, tmp_path):
    doc = {"churches": [{"name": "A"}, 3], "meta": {"v": 1}, "n": 4, "none": None}
    path = put(tmp_path, "m.json", json.dumps(doc))
    assert [(r.name, r.category) for r in files.read_json_by_category(spark, path).collect()] == [("A", "churches")]
    assert {r.category: r.n for r in files.count_json_categories(spark, path).collect()} == {"churches": 2, "meta": 1, "n": 1, "none": 1}
    bare = put(tmp_path, "b.json", '[{"name": "B"}, 1]')
    assert {r.category: r.n for r in files.count_json_categories(spark, bare).collect()} == {"total": 2}
    broken = put(tmp_path, "x.json", '{"churches": [')
    assert files.read_json_by_category(spark, broken).count() == 0
    with pytest.raises(Exception, match="no JSON document"):
        files.read_json_by_category(spark, broken, strict=True).collect()


def test_each_file_has_its_encoding(spark, tmp_path):
    for name, encoding in (("a.csv", "utf-8"), ("b.csv", "cp949"), ("c d.csv", "utf-8")):
        put(tmp_path, name, f"기관명,전화\n교회 {name},02\n", encoding)
    assert sorted(r["기관명"] for r in files.read_csv_encodings(spark, str(tmp_path)).collect()) == ["교회 a.csv", "교회 b.csv", "교회 c d.csv"]


def test_sheet_keeps_line_breaks_and_repeated_titles(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        put(tmp_path, name, f'title,,\nname,address,phone\n{name},"line 1\nline 2",1\nname,address,phone\n')
    got = files.read_sheet(spark, str(tmp_path), header_row=1, multi_line=True)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a.csv", "line 1\nline 2", "1"), ("b.csv", "line 1\nline 2", "1"), ("name", "address", "phone"), ("name", "address", "phone")]


def test_readers_leave_the_session_as_it_was(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("기관명\n교회\n".encode("cp949"))
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    assert [r[0] for r in files.read_csv_encodings(spark, str(tmp_path)).collect()] == ["교회"]
    assert spark.conf.get(name, None) == before
    with files.jvm_charsets(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
