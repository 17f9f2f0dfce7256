"""Literal expectations for the number, e-mail, web and address rules."""

import pytest
from pyspark.sql import functions as F

from orgloom.functions import address as A
from orgloom.functions import phone as P
from orgloom.functions import scoring as S
from orgloom.functions import web as W

# input, formatted, strictly valid, verdict, dummy
PHONES = [
    ("02-123-4567", "02-123-4567", True, "valid", True),
    ("02-1234-5678", "02-1234-5678", True, "valid", True),
    ("031-123-4567", "031-123-4567", True, "valid", True),
    ("031-1234-5678", "031-1234-5678", True, "valid", True),
    ("010-1234-5678", "010-1234-5678", True, "valid", True),
    ("070-1234-5678", "070-1234-5678", True, "valid", True),
    ("02 123 4567", "02-123-4567", True, "valid", True),
    ("0212345678", "02-1234-5678", True, "valid", True),
    ("82-2-123-4567", "02-123-4567", True, "area", True),
    ("033-333-3333", "033-333-3333", True, "valid", True),
    ("032-821-5367", "032-821-5367", True, "valid", False),
    ("01-123-4567", None, False, "area", True),
    ("02-12-345", None, False, "length", True),
    ("031-12345-67890", None, False, "length", True),
    ("080-1234-5678", None, False, "area", True),
    ("123-456-7890", None, False, "area", True),
]


def test_phone_table(spark):
    df = spark.createDataFrame([(p[0],) for p in PHONES], "x string")
    got = df.select("x", P.format_phone("x").alias("f"), P.valid_strict("x").alias("s"), P.invalid_reason("x").alias("r"), P.is_dummy("x").alias("d")).collect()
    assert [tuple(r) for r in got] == PHONES


def test_length_table_knows_080(spark):
    df = spark.createDataFrame([("080-1234-5678",), ("080-123-4567",), ("02-12345678",)], "x string")
    assert [r[0] for r in df.select(P.valid_length_table("x")).collect()] == [True, False, True]


def test_format_is_idempotent(spark):
    df = spark.createDataFrame([(p[0],) for p in PHONES], "x string").select(P.format_phone("x").alias("f")).filter("f is not null")
    assert df.filter(F.col("f") != P.format_phone("f")).count() == 0


@pytest.mark.parametrize("a, b, expected", [
    ("02-1234-5678", "02-1234-5678", "exact_match"), ("02-1234-5678", "02-1234-9999", "similar_pattern"),
    ("031-1234-5678", "031-1234-0000", "similar_pattern"), ("031-123-4567", "032-123-4567", "different"), ("02-123-4567", "02-123-4568", "different")])
def test_relation(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(P.relation(F.col("a"), F.col("b"))).first()[0] == expected


def test_fax_similarity(spark):
    rows = [("0433281234", "0433281235", True), ("0433281234", "0433281244", True), ("0433281234", "0433282244", False), ("021234567", "0212345678", False)]
    df = spark.createDataFrame(rows, "a string, b string, e boolean")
    assert df.filter(P.too_similar(F.col("a"), F.col("b")) != F.col("e")).count() == 0


def test_region_policies(spark):
    df = spark.createDataFrame([("032-123-4567", "경기 부천시"), ("031-123-4567", "어딘가"), ("02-123-4567", None)], "p string, a string")
    got = df.select(*[A.phone_fits_region("p", "a", x) for x in ("exact", "neighbour", "strict")]).collect()
    assert [tuple(r) for r in got] == [(False, True, False), (True, False, False), (True, True, False)]


def test_email_classes(spark):
    rows = [("a@naver.com", "포털"), ("a@seoul.go.kr", "정부/공공"), ("a@snu.ac.kr", "교육기관"), ("a@grace-church.com", "기업/조직"), ("a@church.org", "종교기관"), ("a@x.org", "기타")]
    df = spark.createDataFrame(rows, "e string, c string")
    assert df.filter(W.email_class(W.email_domain("e")) != F.col("c")).count() == 0


def test_resolve_url(spark):
    base = "https://a.kr/x/y.html?q=1"
    rows = [("https://b.kr/z", "https://b.kr/z"), ("/c", "https://a.kr/c"), ("d.html", "https://a.kr/x/d.html"), ("#t", base + "#t"), ("./e", "https://a.kr/x/e")]
    df = spark.createDataFrame([(h, base, e) for h, e in rows], "h string, b string, e string")
    assert df.filter(W.resolve_url("h", "b") != F.col("e")).count() == 0


def test_completeness_rounds_half_up(spark):
    df = spark.createDataFrame([("1", "", None, " ", "x")], "phone string, fax string, email string, homepage string, address string")
    assert df.select(S.completeness()).first()[0] == 40


@pytest.mark.parametrize("space", [" ", "　", " ", " "])
def test_numbers_with_any_white_space(spark, space):
    from orgloom.functions import extract as X

    text = f"전화{space}02{space}1234{space}5678 팩스:{space}031{space}123{space}4567"
    row = spark.createDataFrame([(text,)], "text string").select(X.phones("text").alias("p"), X.faxes("text").alias("f")).first()
    assert "02-1234-5678" in row.p and "031-123-4567" in row.f


def test_digits_of_a_number_are_taken_once(spark):
    from orgloom.functions import extract as X

    df = spark.createDataFrame([("전화 02-123-4567 Tel 02-123-4567 +82-31-123-4567",)], "text string")
    for column, most in ((X.phones("text"), 1), (X.helper_phones("text"), 1), (X.search_phones("text"), 2)):
        text = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("[^0-9]") <= most
