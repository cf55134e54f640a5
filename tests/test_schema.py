"""Schemas, label columns and rewrites on hand-made tables."""

from tabulon.operators import schema, statements


def heads(spark, *tables):
    return spark.createDataFrame([(t, i, n) for t, names in enumerate(tables) for i, n in enumerate(names)], "table_id int, col_idx int, name string")


def test_clean_schema(spark):
    t = heads(spark, ["Label", "Note", "31/12/2024", "31/12/2023", "Variation Montant", "Variation %"], ["col1", "31/12/2024", "31.12.2023", "30.06.2023", "X"], [None, "", "12"], ["2024", "Note"])
    got = {r.table_id: r for r in schema.clean_schema(t).collect()}
    assert (got[0].header_score, got[0].date_format) == (8, "slash") and got[0].names[:2] == ["Label", "Note"]
    # the form with more dates stays, after the other columns; the score is that of three columns
    assert (got[1].names, got[1].header_score, got[1].date_format) == (["Label", "Note", "X", "31.12.2023", "30.06.2023"], 5, "dot")
    assert (got[2].names, got[2].header_score, got[2].date_format) == (["Label", "Note"], -5, "none")
    assert (got[3].names, got[3].header_score) == (["Label", "Note"], -4)
    assert schema.clean_schema(t.limit(0)).count() == 0


def test_project_rows(spark):
    t = heads(spark, ["Label", "31/12/2024"])
    cells = spark.createDataFrame([(0, 0, 0, "LABEL", "a"), (0, 0, 1, "31.12.2024", "1"), (0, 1, 0, "Label", None), (0, 1, 1, "label", "b"), (9, 0, 0, "Label", "gone")], "table_id int, row_idx int, col_idx int, name string, raw string")
    got = {(r.row_idx, r.name): r.raw for r in schema.project_rows(cells, schema.clean_schema(t)).collect()}
    assert got == {(0, "Label"): "a", (0, "Note"): "", (0, "31/12/2024"): "1", (1, "Label"): "", (1, "Note"): "", (1, "31/12/2024"): ""}


def test_labels(spark):
    t = heads(spark, ["Label", "Code", "Nature"], ["A", "B", "C"], ["A", "Label"], ["x"])
    given = {0: [["", "7", "Caisse"], ["", "8", "Titres"], ["Prêts", "9", ""]], 1: [["1", "b", "c"], ["2", "b", "3"], ["d", "b", None]], 2: [["Solde", ""], ["5", " "]]}
    cells = spark.createDataFrame([(k, r, c, v) for k, rows in given.items() for r, row in enumerate(rows) for c, v in enumerate(row)], "table_id int, row_idx int, col_idx int, raw string")
    columns = {r.table_id: (r.label_col, r.how) for r in schema.label_columns(t, cells).collect()}
    assert columns == {0: (0, "name"), 1: (1, "text"), 2: (1, "name"), 3: (None, None)}
    labels = {(r.table_id, r.row_idx): (r.label, r.how) for r in schema.ensure_labels(t, cells).collect()}
    assert labels == {
        (0, 0): ("Caisse", "recovered"), (0, 1): ("Titres", "recovered"), (0, 2): ("Prêts", "given"), (1, 0): ("b", "mapped"), (1, 1): ("b", "mapped"), (1, 2): ("b", "mapped"),
        (2, 0): ("Solde", "recovered"), (2, 1): ("", "none"),
    }


def test_sections(spark):
    rows = [("section", "A"), ("data", "x"), ("total", "Sous-total"), ("data", "y"), ("data", "TOTAL"), ("section", "B"), ("section", "C"), ("data", "z")]
    t = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "table_id int, row_idx int, row_type string, label string")
    got = sorted((r.start_row, r.end_row, r.section_name, r.total_row, r.n_data, r.is_subtotal) for r in statements.sections(t).collect())
    assert got == [(0, 3, "A", 2, 1, True), (3, 5, "A", 4, 1, False), (5, 5, "A", None, 0, False), (5, 6, "B", None, 0, False), (6, 8, "C", None, 1, False)]


def test_totals_are_corrected_by_the_stored_total(spark):
    rows = [("data", "x", 100.0), ("data", "Moins y", 30.0), ("total", "Total", 60.0), ("data", "z", 100.0), ("total", "Total", 190.0), ("data", "w", 100.0), ("total", "Total", 210.0), ("data", "v", 5.0), ("total", "Total", None)]
    t = spark.createDataFrame([(k, i, *r) for k in (1, 2) for i, r in enumerate(rows)], "table_id int, row_idx int, row_type string, label string, cur double")
    kinds = spark.createDataFrame([(1, "balance_sheet", 0.7), (2, "cash_flow", 0.69)], "table_id int, table_type string, confidence double")
    got = sorted((r.table_id, r.row_idx, r.old_value, r.new_value, r.code) for r in statements.recomputed_totals(t, kinds, ("cur",)).collect())
    # 190 against 100 is off by 47 % of what is stored, 210 by 52 %
    assert got == [(1, 2, 60.0, 70.0, "total_corrected"), (1, 4, 190.0, 100.0, "total_corrected"), (1, 8, None, 5.0, "total_computed")]


def test_safe_shift(spark):
    rows = {0: ["", "7", "50000", "60000"], 1: ["1.1", "7", "50000", "60000"], 2: ["-", "70", "50000", "60000"], 3: [None, "50000", "7", ""], 4: ["", "8", "9", "50000"]}
    t = spark.createDataFrame([(1, r, "section" if r == 9 else "data", s, v) for r, vs in {**rows, 9: rows[0]}.items() for s, v in enumerate(vs)], "table_id int, row_idx int, row_type string, slot int, value string")
    got = {}
    for r in statements.safe_shift(t).orderBy("row_idx", "slot").collect():
        got.setdefault(r.row_idx, []).append(r.value)
    assert got[0] == ["7", "50000", "60000", ""] and got[4] == ["9", "8", "50000", ""]
    assert {k: got[k] for k in (1, 2, 3)} == {k: rows[k] for k in (1, 2, 3)} and got[9] == rows[0]
