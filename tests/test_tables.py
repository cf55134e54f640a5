"""Operators on small tables, and the plans that they must have."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tabulon.functions import patterns as P
from tabulon.operators import merge, pages, statements
from tabulon.sources import parse, sinks
from tabulon.streaming import tables


def cells(spark, rows):
    return spark.createDataFrame([("t", i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "table_id string, row_idx int, col_idx int, raw string")


def test_align(spark):
    got = statements.align_rows(cells(spark, [["Créances (4.1)", "", "1 200", "(97)", "22,5%", "1297"], ["(2.1)", "Dettes", "", "50", "-", "10"], [None, None, "", "-", "", ""]])).orderBy("row_idx").collect()
    assert (got[0].label, got[0].note, got[0].d1, got[0].d2, got[0].var_amount, got[0].var_percent) == ("Créances", "(4.1)", 1200.0, -97.0, 1297.0, 22.5)
    assert (got[1].label, got[1].note, got[1].d1, got[1].d2) == ("Dettes", "(2.1)", 50.0, 10.0)
    assert (got[2].label, got[2].note, got[2].d1) == ("", "", None)


def test_align_does_not_depend_on_row_order(spark):
    df = cells(spark, [["A", "4.1", "100", "90", "1%", "10"], ["B", "", "7", "", "", ""]])
    key = ["table_id", "row_idx"]
    assert statements.align_rows(df).orderBy(*key).collect() == statements.align_rows(df.orderBy(F.rand(3))).orderBy(*key).collect()


def test_totals(spark):
    rows = spark.createDataFrame(
        [("t", 0, "section", "S", None), ("t", 1, "data", "a", 5.0), ("t", 2, "data", "Moins b", 2.0), ("t", 3, "total", "Total S", 7.0), ("t", 4, "data", "c", 9.0), ("t", 5, "total", "Total", 20.0), ("t", 6, "total", "Total general", None)],
        "table_id string, row_idx int, row_type string, label string, cur double",
    )
    got = {r.row_idx: (r.status, r.expected) for r in statements.total_checks(rows, 1.0).collect()}
    assert got == {3: ("ok", 7.0), 5: ("mismatch", 9.0), 6: ("empty", None)}
    assert {r.row_idx: r.expected for r in statements.total_checks(rows, 1.0, subtract_less=True).collect()}[3] == 3.0


def test_parsing(spark):
    texts = ['{"columns": ["A"], "rows": [{"A": "1"}]}', '```json\n{"rows": [{"A": 1, "B": "x"}]}\n```', '{"columns": ["A"], "rows": [{"A": "1"}, {"A": "\\"q"}, {"A": "cu', "{'rows': [{'A': '1',}]}", "nothing", "", None, '{"table": [{"A": "1"}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "table_id int, text string")
    got = {r.table_id: (r.how, r.n) for r in parse.parse_responses(df).select("table_id", "how", F.coalesce(F.size("table.rows"), F.lit(0)).alias("n")).collect()}
    assert [got[i][1] for i in range(8)] == [1, 1, 2, 1, 0, 0, 0, 1]
    assert got[0][0] == "fast" and got[2][0] == "salvaged" and got[4][0] == "failed"
    assert parse.salvage('{"columns": ["A"], "rows": [{"A": "1", "A": "2"}, {"A"')[1] == [{"A": "1", "A_2": "2"}]
    body = sinks.table_json(parse.to_cells(parse.parse_responses(df.filter("table_id = 0")))).first().body
    assert json.loads(body) == {"columns": ["A"], "rows": [{"A": "1"}]}


def test_pages(spark):
    bilan = "Bilan consolidé\nTotal actif, passif"
    df = spark.createDataFrame([(1, 1, "intro"), (1, 2, bilan), (1, 3, "suite: actif, dettes"), (1, 4, "Etat de résultat\nproduits charges"), (1, 30, "Flux de trésorerie\nexploitation financement"), (2, 1, "Engagements hors bilan\nactif passif"), (2, 2, None)], "doc_id int, page_no int, text string")
    got = {(r.doc_id, r.kind): r.pages for r in pages.detect(df).collect()}
    assert got == {(1, "balance_sheet"): [2, 3], (1, "income_statement"): [4]}
    assert pages.indel_ratio("abcd", "abed") == 75.0
    assert [(r.page_no, r.kind) for r in pages.fuzzy_titles(spark.createDataFrame([(1, 1, "etat de resultaf")], "doc_id int, page_no int, text string")).collect()] == [(1, "income_statement")]


def test_merge_and_fuzzy(spark):
    rows = spark.createDataFrame([(1, 1, 0, "A", ["1"]), (1, 2, 0, "a ", ["1"]), (1, 2, 1, "B", ["1"])], "doc_id int, page_no int, row_idx int, label string, values array<string>")
    assert [(r.label, r.merged_idx) for r in merge.merge_pages(rows).orderBy("merged_idx").collect()] == [("A", 0), ("B", 1)]
    long = "immobilisations corporelles et incorporelles nettes de la periode en cours au bilan"
    f = spark.createDataFrame([("t", 0, long, None, None), ("t", 1, long + "s", None, "x"), ("t", 2, "autre", None, None), ("u", 0, long, None, None)], "table_id string, row_idx int, label string, var_percent double, a string")
    assert sorted((r.table_id, r.row_idx) for r in merge.fuzzy_dedup(f).collect()) == [("t", 1), ("t", 2), ("u", 0)]


def test_fuzzy_repeats_against_pairs(spark):
    """The stream of rows against the rule stated pair by pair over lists."""
    from difflib import SequenceMatcher

    base = "immobilisations corporelles et incorporelles nettes de la periode en cours au bilan"
    draw = random.Random(3)
    labels = ["", None, base, base + "s", base.upper(), "Total actif", "TOTAL  actif", "x" * 210, "x" * 209 + "y"]
    rows = [(t, i, draw.choice(["section", "total", "data"]), draw.choice(labels), draw.choice([None, "", "12,5%", "12.5%", " 12,5% "]), draw.choice(["", "1", None])) for t in range(40) for i in range(12)]
    clean = lambda v: re.sub("[^a-z0-9%.,()/-]", "", (v or "").lower())
    want = []
    for t in range(40):
        kept, seen, headings = [], set(), set()
        for row in (r for r in rows if r[0] == t):
            text, share, sign = clean(row[3]), clean(row[4]), (*map(clean, row[3:]), row[2])
            heading = row[2] != "data" and not share and text
            if sign in seen or (heading and text in headings):
                continue
            headings |= {text} if heading else set()
            size = lambda r: sum(bool((v or "").strip()) for v in r[3:])
            for k, other in enumerate(kept):
                if text and clean(other[3]) and share == clean(other[4]) and SequenceMatcher(None, text, clean(other[3])).ratio() >= 0.985:
                    kept[k] = row if size(row) > size(other) else other
                    break
            else:
                seen.add(sign)
                kept.append(row)
        want += kept
    df = spark.createDataFrame(rows, "table_id int, row_idx int, row_type string, label string, var_percent string, a string")
    assert sorted((r[0], r[1]) for r in merge.fuzzy_dedup(df).collect()) == sorted((r[0], r[1]) for r in want)


def test_title_ratios(spark):
    draw = random.Random(1)
    titles = [t for group in P.PAGE_TITLES.values() for t in group]
    runs = ["".join(c if draw.random() > 0.1 else draw.choice("aet é") for c in draw.choice(titles))[draw.randrange(3) :] for _ in range(300)] + ["", "a", "é" * 45]
    got = pages.title_ratios(runs)
    for kind, group in P.PAGE_TITLES.items():
        want = [max((pages.indel_ratio(t, r) for t in group if 200 * min(len(t), len(r)) >= pages.FUZZY * (len(t) + len(r))), default=0.0) for r in runs]
        assert got[kind].tolist() == pytest.approx(want)
    long = "mot " * 60000 + "etat de resultaf"
    df = spark.createDataFrame([(1, 1, long), (1, 2, None), (1, 3, ""), (1, 4, "bilan au"), (1, 4, "bilan au")], "doc_id int, page_no int, text string")
    assert sorted((r.page_no, r.kind) for r in pages.fuzzy_titles(df).collect()) == [(1, "income_statement"), (4, "balance_sheet"), (4, "balance_sheet")]


def test_plans_stay_in_the_jvm(spark):
    df = cells(spark, [["A", "1"]])
    plan = statements.align_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, '{"columns": ["A"], "rows": [{"A": "12"}]}')], "table_id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("table_id int, text string").parquet(str(tmp_path / "in"))
    q = tables.append_tables(tables.typed_cells(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert [(r.vtype, r.num) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("NUMBER", 12.0)]
