"""The chain from responses to validated tables, on hand-made responses."""

import json

from tabulon.plans import chain

HEAD = ["Libellé", "Note", "31/12/2023", "31/12/2024", "Variation Montant", "Variation %"]


def response(rows, head=HEAD):
    return json.dumps({"columns": head, "rows": [dict(zip(head, r, strict=True)) for r in rows]})


def test_chain(spark):
    whole = response([
        ["Actif", "", "", "", "", ""], ["Caisse", "1.1", "20000", "30000", "", "50,0%"], ["Dettes", "", "50000", "4.2", "12abc", ""], ["Prêts", "2.1", "40000", "40000", "9", "1"],
        ["Titres", "3.1", "80000", "60000", "-20000", "25%"], ["Total actif", "", "190000", "130000", "", ""],
    ])
    short = response([["Caisse", "", "1", "2", "9", ""]])
    texts = [(1, whole), (2, short), (3, None), (4, ""), (5, "nothing"), (6, '{"columns": ["Libellé"], "rows": []}'), (None, short)]
    rows, log, report = chain.validate(spark.createDataFrame(texts, "table_id long, text string"))
    got = {r.row_idx: r for r in rows.filter("table_id = 1").collect()}
    assert sorted(r.row_type for r in got.values()) == ["data", "data", "data", "data", "section", "total"]
    assert (got[1].cur, got[1].prev, got[1].var_amount, got[1].var_percent) == (30000.0, 20000.0, 10000.0, 50.0)
    assert (got[2].note, got[2].cur, got[2].var_amount) == ("4.2", None, None)
    assert (got[3].var_amount, got[3].var_percent) == (0.0, 0.0) and (got[4].var_amount, got[4].var_percent) == (-20000.0, -25.0)
    codes = {(r.row_idx, r.field, r.code) for r in log.collect()}
    assert {(1, "var_amount", "variation_amount_computed"), (2, "note", "note_realigned"), (2, "var_amount", "malformed_cleared"), (3, "var_percent", "percent_formatted"), (3, "var_amount", "variation_amount_corrected")} <= codes
    # a table whose gate is shut keeps its values and has no log
    assert [(r.var_amount, r.applies) for r in rows.filter("table_id = 2").collect()] == [(9.0, False)]
    assert {r.table_id for r in log.collect()} == {1}
    assert {r.table_id: (r.mode, r.n_errors, r.n_high) for r in report.collect()} == {1: ("safe", 0, 1), 2: ("none", 0, 0)}


def test_chain_of_nothing(spark):
    for out in chain.validate(spark.createDataFrame([], "table_id long, text string")):
        assert out.count() == 0
