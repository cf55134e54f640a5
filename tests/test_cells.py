"""Truth tables of the scalar library."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import scalars as S

KINDS = [
    ("22,5%", "PERCENT", None, 22.5), ("(5,4%)", "PERCENT", None, -5.4), ("-15,4 %", "PERCENT", None, -15.4), ("0.0%", "PERCENT", None, 0.0),
    ("(4.1)", "NOTE", None, None), ("(1-2)", "NOTE", None, None), ("III.1", "NOTE", None, None), ("(3)", "NOTE", None, None), ("1-2", "NOTE", None, None),
    ("(97)", "NUMBER", -97.0, None), ("147 120", "NUMBER", 147120.0, None), ("<123 456>", "NUMBER", -123456.0, None), ("-97", "NUMBER", -97.0, None),
    ("1.234.567,89", "NUMBER", 1234567.89, None), ("1,234,567.89", "NUMBER", 1234567.89, None), ("1.234.567", "NUMBER", 1234567.0, None),
    ("12,5", "NUMBER", 12.5, None), ("1 730 727", "NUMBER", 1730727.0, None), ("1 234", "NUMBER", 1234.0, None),
    ("", "EMPTY", None, None), (None, "EMPTY", None, None), ("-", "EMPTY", None, None), ("N/A", "EMPTY", None, None), (" ", "EMPTY", None, None),
    ("HB1 - Cautions", "TEXT", None, None), ("Total actif", "TEXT", None, None),
]


def test_cells(spark):
    df = spark.createDataFrame([(i, k[0]) for i, k in enumerate(KINDS)], "i int, v string")
    got = df.select("i", S.value_type("v").alias("k"), S.number("v").alias("n"), S.percent("v").alias("p")).orderBy("i").collect()
    for want, row in zip(KINDS, got, strict=True):
        assert (row.k, row.n, row.p) == want[1:], want


HEADERS = [
    ("31/12/2024", "date"), ("2024", "date"), ("31.12.2023", "date"), ("1/1/24", "date"), ("1999", "placeholder"), ("col3", "placeholder"), ("", "placeholder"),
    (None, "placeholder"), ("Libellé", "label"), ("Notes", "note"), ("Montant", "var_amount"), ("En %", "var_percent"), ("Agence", "unresolved"), ("Exercice 2024", "date"),
]


def test_headers(spark):
    df = spark.createDataFrame([(i, *h) for i, h in enumerate(HEADERS)], "i int, v string, want string")
    bad = df.select("v", "want", S.header_role("v").alias("got")).filter("got <> want").collect()
    assert not bad


MERGES = [
    (["Label", "Note", "31/12/2024", "31/12/2023", "Variation", "Montant", "%"], ["Label", "Note", "31/12/2024", "31/12/2023", "Variation Montant", "Variation %"]),
    (["Variation", "31/12/2024", "Montant"], ["Variation", "31/12/2024", "Variation Montant"]), (["En", "%"], ["Variation %"]), (["En"], ["En"]), ([], []),
]


@pytest.mark.parametrize("given,want", MERGES)
def test_merge_headers(spark, given, want):
    row = spark.createDataFrame([(given,)], "h array<string>").select(S.merge_headers("h").alias("m")).first()
    assert row.m == want


def test_format_and_malformed(spark):
    df = spark.createDataFrame([(1234567.0,), (-5.0,), (12.5,), (0.0,)], "n double").select(S.format_number("n").alias("s"))
    assert [r.s for r in df.collect()] == ["1 234 567", "(5)", "12.50", "0"]
    odd = spark.createDataFrame([("123abc", True), ("(12", True), ("1 234 567 890", False), ("12 34 56 78", True), ("1.2.3,4,5", True), ("1.234,5", False), (None, False)], "v string, want boolean")
    assert not odd.select(S.malformed("v").alias("got"), "want").filter("got <> want").collect()


def test_page_numbers(spark):
    df = spark.createDataFrame([(None, 3, [1, 2, 3]), ("1,3-5", 4, [1, 3, 4]), ("[2, 2]", 9, [2]), ("9-7,x", 9, [])], "s string, n int, want array<int>")
    assert not df.select(S.page_numbers("s", "n").alias("got"), "want").filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
