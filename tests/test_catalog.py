"""A sample of the named queries against their SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__
from tests.test_cells import KINDS

SF = "/root/testdata/sf0.001"
NAMES = ("classify_cells", "parse_numbers", "header_roles", "align_rows", "section_totals", "column_shift", "page_merge", "page_title_score", "gap_clusters", "reliability_action", "sign_consistency", "yoy_percent", "table_type", "cashflow_keywords", "parse_responses", "response_cells", "pipe_tables", "largest_cluster", "validated_tables", "validation_log", "validation_report",
         "clean_schema", "project_rows", "label_columns", "ensure_labels", "merge_schemas", "statement_sections", "recomputed_totals", "corrected_totals", "amount_recovery", "safe_shift", "realigned_notes")


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda r: tuple((v is not None, str(float(v)) if isinstance(v, (int, float)) else str(v)) for v in r)
    assert sorted(key(r) for r in got.select(*order).collect()) == sorted(key(r) for r in want.select(*order).fetchall())


def test_sql_functions(spark):
    from tabulon.functions import sql

    sql.register(spark)
    spark.createDataFrame([(i, k[0]) for i, k in enumerate(KINDS)], "i int, v string").createOrReplaceTempView("kinds")
    for want, row in zip(KINDS, spark.sql("SELECT st_classify(v) k, st_parse_number(v) n, st_parse_percent(v) p FROM kinds ORDER BY i").collect(), strict=True):
        assert (row.k, row.n, row.p) == want[1:]
    assert spark.sql("SELECT st_fuzzy_ratio('abcd', 'abed') r").first().r == 75.0
    assert [tuple(r) for r in spark.sql("""SELECT * FROM st_parse_table('{"rows": [{"A": "1"}, {"A')""").collect()] == [(0, "A", "1")]


def test_parsed_keys_and_cells(spark):
    """Repeated keys, keys of later rows, cells beyond the columns, and pipe tables all keep their values."""
    from tabulon.sources import parse

    given = [
        '{"rows": [{"Label": "a", "2024": "1", "2024": "2"}]}', '{"columns": ["L"], "rows": [{"L": "b", "x": "2"}, null, {"y": "3"}]}', '{"columns": ["A"], "rows": [["1", "2"]]}',
        "text\n| H | H |\n|:--|--:|\n| 1 | 2 | 3 |\n\n| 4 |", "a | b", "|---|\n| x |", None, "",
    ]
    parsed = parse.parse_responses(spark.createDataFrame([*enumerate(given)], "table_id int, text string"))
    assert [r["how"] for r in parsed.orderBy("table_id").collect()] == ["salvaged", "fast", "salvaged", "pipe", "failed", "failed", "failed", "failed"]
    cells = {}
    for r in parse.to_cells(parsed).collect():
        cells.setdefault(r["table_id"], {})[r["row_idx"], r["name"]] = r["raw"]
    assert cells[0] == {(0, "Label"): "a", (0, "2024"): "1", (0, "2024_2"): "2"}
    assert cells[1] == {(0, "L"): "b", (0, "x"): "2", (0, "y"): "", (1, "L"): "", (1, "x"): "", (1, "y"): "3"}
    assert cells[2] == {(0, "A"): "1", (0, "_extra_0"): "2"}
    assert cells[3] == {(0, "H"): "1", (0, "H_2"): "2", (0, "_extra_0"): "3", (1, "H"): "4", (1, "H_2"): "", (1, "_extra_0"): ""}


def test_sign_follows_the_amount(spark):
    from tabulon.operators import statements

    rows = spark.createDataFrame([(1, 5.0, -10.0, None, None), (2, 20.0, 10.0, 10.0, 100.0)], "row_idx int, cur double, prev double, var_amount double, var_percent double")
    got = {r["row_idx"]: r for r in statements.variation(rows).collect()}
    assert (got[1]["new_percent"], got[1]["sign_code"]) == (150.0, "sign_consistency_corrected") and got[2]["sign_code"] is None
