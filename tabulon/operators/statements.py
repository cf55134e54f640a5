"""Rows of statement tables: alignment, row types, sections, totals and period-over-period rules.

Everything is partitioned by table_id: windows and aggregations of one pipeline reuse that exchange.  Order is
carried by row_idx and col_idx, never by the order of rows in a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import patterns as P
from tabulon.functions import scalars as S

EMBEDDED_NOTE = r"\s*(\(\d+(?:[.-]\d+)?\))\s*$"


def align_rows(cells: DataFrame, date_slots: int = 2) -> DataFrame:
    """(table_id, row_idx, label, note, var_percent, d1.., var_amount) by what each cell holds, not where it stands.

    The longest text is the label (a bracketed number at its end is the note), the first note and percent are
    taken, and numbers fill the date slots from left to right, then the variation.
    """
    typed = cells.select("table_id", "row_idx", "col_idx", S.clean("raw").alias("v"), S.value_type("raw").alias("k"), S.number("raw").alias("num"), S.percent("raw").alias("pct"))
    is_ = lambda k: F.col("k") == k
    a = typed.groupBy("table_id", "row_idx").agg(
        F.max(F.when(is_("TEXT"), F.struct(F.length("v").alias("n"), (-F.col("col_idx")).alias("c"), "v"))).alias("t"),
        F.min(F.when(is_("NOTE"), F.struct("col_idx", "v"))).alias("note"),
        F.min(F.when(is_("PERCENT"), F.struct("col_idx", "pct"))).alias("p"),
        F.array_sort(F.collect_list(F.when(is_("NUMBER"), F.struct("col_idx", "num")))).alias("nums"),
    )
    text, inner = F.coalesce(F.col("t.v"), F.lit("")), F.regexp_extract(F.coalesce(F.col("t.v"), F.lit("")), EMBEDDED_NOTE, 1)
    head = S.clean(F.regexp_replace(text, EMBEDDED_NOTE, ""))
    slot = lambda k: F.try_element_at("nums", F.lit(k))["num"]
    return a.select(
        "table_id", "row_idx", F.when(head == "", text).otherwise(head).alias("label"),
        F.when(inner != "", inner).otherwise(F.coalesce(F.col("note.v"), F.lit(""))).alias("note"), F.col("p.pct").alias("var_percent"),
        *(slot(k + 1).alias(f"d{k + 1}") for k in range(date_slots)), slot(date_slots + 1).alias("var_amount"),
    )


def alignment_gaps(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx): rows where packing numbers to the left moves a value over an empty numeric cell."""
    typed = cells.select("table_id", "row_idx", "col_idx", S.value_type("raw").alias("k"))
    a = typed.groupBy("table_id", "row_idx").agg(F.max(F.when(F.col("k") == "NUMBER", F.col("col_idx"))).alias("last"), F.min(F.when(F.col("k") == "EMPTY", F.col("col_idx"))).alias("gap"))
    return a.filter("gap < last").select("table_id", "row_idx")


def guard_findings(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, code): types that a role forbids."""
    typed = cells.withColumn("k", S.value_type("raw")).join(roles.select("table_id", "col_idx", "role"), ["table_id", "col_idx"])
    bad = (F.col("role").isin("date", "var_amount") & F.col("k").isin("PERCENT", "NOTE")) | ((F.col("role") == "var_percent") & F.col("k").isin("NUMBER", "NOTE"))
    return typed.filter(bad).select("table_id", "row_idx", "col_idx", F.concat_ws("_in_", F.lower("k"), "role").alias("code"))


def row_type(label: Column, has_number: Column) -> Column:
    return F.when(F.lower(label).contains("total"), "total").when(has_number, "data").otherwise("section")


def typed_rows(cells: DataFrame, label_col: int = 0, note_col: int = 1) -> DataFrame:
    """(table_id, row_idx, row_type): total by its label, data by a digit outside label and note, else section."""
    digit = S.clean("raw").rlike(r"\d") & ~S.row_note("raw") & ~F.col("col_idx").isin(label_col, note_col)
    a = cells.groupBy("table_id", "row_idx").agg(F.coalesce(F.max(F.when(F.col("col_idx") == label_col, F.col("raw"))), F.lit("")).alias("label"), F.max(digit).alias("numbers"))
    return a.select("table_id", "row_idx", row_type(F.col("label"), F.coalesce("numbers", F.lit(False))).alias("row_type"))


def is_header_row(label: Column) -> Column:
    """A repeated title, unit or header line; patterns match at the beginning."""
    return F.lower(S.clean(label)).rlike("(?iU)^(?:" + "|".join(P.HEADER_ROWS) + ")")


def drop_header_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_header_row(F.col("label")))


def _order(rows_before: bool = False) -> Window:
    w = Window.partitionBy("table_id").orderBy("row_idx")
    return w.rowsBetween(Window.unboundedPreceding, -1 if rows_before else 0)


def segments(rows: DataFrame) -> DataFrame:
    """rows with segment: rows since the last section or total above; and section_name carried forward."""
    edge = F.col("row_type").isin("section", "total") | F.lower("label").contains("total")
    seg = F.coalesce(F.sum(edge.cast("int")).over(_order(True)), F.lit(0))
    name = F.last(F.when(F.col("row_type") == "section", F.col("label")), ignorenulls=True).over(_order())
    return rows.withColumn("segment", seg).withColumn("section_name", F.coalesce(name, F.lit("")))


def total_checks(rows: DataFrame, tolerance: float, value: str = "cur", subtract_less: bool = False) -> DataFrame:
    """(table_id, row_idx, section_name, n_rows, expected, actual, status) of each total over the data rows of its segment.

    status: ok, mismatch (the difference is above the tolerance), missing (no stored total) or empty (no data rows).
    With ``subtract_less``, rows whose label says MOINS or LESS are subtracted by their magnitude.
    """
    less = F.upper("label").contains("MOINS") | F.upper("label").contains("LESS")
    part = F.when(less, -F.abs(F.col(value))).otherwise(F.col(value)) if subtract_less else F.col(value)
    total = (F.col("row_type") == "total") | F.lower("label").contains("total")
    w = Window.partitionBy("table_id", "segment")
    data = (F.col("row_type") == "data") & ~total
    s = segments(rows).withColumn("expected", F.sum(F.when(data, part)).over(w)).withColumn("n_rows", F.count_if(data).over(w))
    gap = F.abs(F.col("expected") - F.col(value))
    status = F.when(F.col("n_rows") == 0, "empty").when(F.col("expected").isNull(), "empty").when(F.col(value).isNull(), "missing").when(gap > tolerance, "mismatch").otherwise("ok")
    return s.filter(total).select("table_id", "row_idx", "section_name", "n_rows", "expected", F.col(value).alias("actual"), status.alias("status"))


def corrected_totals(checks: DataFrame, tolerance: float = 2.0, most: float = 0.5) -> DataFrame:
    """checks with corrected: missing totals are filled; wrong ones are replaced where they are off by under half of the
    stored total.  A stored 0 is not replaced."""
    off = F.abs(F.try_divide(F.col("expected") - F.col("actual"), F.abs("actual")))
    fix = F.when(F.col("status") == "missing", F.col("expected")).when((F.abs(F.col("expected") - F.col("actual")) > tolerance) & (off < most), F.col("expected"))
    return checks.withColumn("corrected", F.coalesce(fix, F.col("actual"))).withColumn("was_corrected", fix.isNotNull())


def variation(rows: DataFrame, amount_tolerance: float = 1.0, percent_tolerance: float = 0.5) -> DataFrame:
    """rows (cur, prev, var_amount, var_percent) with the expected values and what was done to each.

    Amount: current - previous; filled where missing, replaced beyond the tolerance.  Percent: amount / previous
    times 100; cleared where previous is null or 0; filled or replaced alike; its sign follows the amount.
    Equal periods give 0 and 0.  Codes are null where nothing was done.
    """
    expected = F.col("cur") - F.col("prev")
    code = F.when(expected.isNull(), None).when(F.col("var_amount").isNull(), "variation_amount_computed").when(F.abs(expected - F.col("var_amount")) > amount_tolerance, "variation_amount_corrected")
    amount = F.when(code.isNotNull(), expected).otherwise(F.col("var_amount"))
    share = F.try_divide(F.col("new_amount"), F.col("prev")) * 100
    zero = F.coalesce(F.col("prev"), F.lit(0)) == 0
    pcode = (
        F.when(zero & F.col("var_percent").isNotNull(), "percent_cleared_division_by_zero").when(zero | share.isNull(), None)
        .when(F.col("var_percent").isNull(), "percent_computed").when(F.abs(share - F.col("var_percent")) > percent_tolerance, "percent_corrected")
    )
    out = rows.withColumn("new_amount", amount).withColumn("amount_code", code)
    out = out.withColumn("percent_code", pcode).withColumn("new_percent", F.when(zero, None).when(F.col("percent_code").isNotNull(), share).otherwise(F.col("var_percent")))
    signed = F.signum("new_amount") * F.abs("new_percent")
    wrong = F.col("new_percent").isNotNull() & F.col("new_amount").isNotNull() & (F.signum("new_percent") != F.signum("new_amount"))
    return out.withColumn("sign_code", F.when(wrong, "sign_consistency_corrected")).withColumn("new_percent", F.when(wrong, signed).otherwise(F.col("new_percent")))


def equal_periods(rows: DataFrame) -> DataFrame:
    """Rows whose two periods are equal and whose stored variation is not zero."""
    same = F.col("cur") == F.col("prev")
    return rows.filter(same & ((F.coalesce("var_amount", F.lit(0)) != 0) | (F.coalesce("var_percent", F.lit(0)) != 0)))


def note_findings(rows: DataFrame) -> DataFrame:
    """(table_id, row_idx, note, code, first_row): notes that repeat, no notes by form, or notes on sections and totals."""
    w = Window.partitionBy("table_id", "note").orderBy("row_idx")
    noted = rows.filter("note IS NOT NULL AND note <> ''").withColumn("nth", F.row_number().over(w)).withColumn("first_row", F.first("row_idx").over(w))
    code = F.array_compact(F.array(F.when(F.col("nth") > 1, "duplicate_note"), F.when(S.value_type("note") != "NOTE", "not_a_note"), F.when(F.col("row_type").isin("section", "total"), "note_on_header")))
    return noted.withColumn("code", F.explode(code)).select("table_id", "row_idx", "note", "code", "first_row")


def misplaced_notes(cells: DataFrame) -> DataFrame:
    """Cells of a row whose median magnitude over 50 is at least 50 000: notes by form, or whole numbers up to 50
    that are under a ten-thousandth of it."""
    w = Window.partitionBy("table_id", "row_idx")
    typed = cells.withColumn("k", S.value_type("raw")).withColumn("num", S.number("raw"))
    typed = typed.withColumn("median", F.median(F.when(F.abs("num") > 50, F.abs("num"))).over(w))
    small = (F.col("num") > 0) & (F.col("num") <= 50) & (F.col("num") == F.floor("num")) & (F.col("num") / F.col("median") < 0.0001)
    return typed.filter((F.col("median") >= 50000) & ((F.col("k") == "NOTE") | small)).select("table_id", "row_idx", "col_idx", S.clean("raw").alias("raw"))


def shift_left(slots: DataFrame, misplaced: DataFrame) -> DataFrame:
    """Rows of slots (table_id, row_idx, slot, value), slot 0 being the note: from the first misplaced slot of a row
    on, each takes the next one's value and the last is blank; the misplaced value becomes the note if that is empty."""
    w = Window.partitionBy("table_id", "row_idx").orderBy("slot")
    first = misplaced.groupBy("table_id", "row_idx").agg(F.min("slot").alias("from_slot"))
    met = slots.join(first, ["table_id", "row_idx"], "left").withColumn("next", F.lead("value", 1, "").over(w))
    whole = Window.partitionBy("table_id", "row_idx")
    note = F.max(F.when(F.col("slot") == 0, F.col("value"))).over(whole)
    moved = F.max(F.when(F.col("slot") == F.col("from_slot"), F.col("value"))).over(whole)
    apply = F.col("from_slot").isNotNull() & (F.coalesce(note, F.lit("")) == "")
    out = met.withColumn("apply", apply).withColumn("moved", moved)
    value = F.when(F.col("apply") & (F.col("slot") == 0), F.col("moved")).when(F.col("apply") & (F.col("slot") >= F.col("from_slot")), F.col("next")).otherwise(F.col("value"))
    return out.select("table_id", "row_idx", "slot", value.alias("value"), F.col("apply").alias("was_shifted"))


def sections(rows: DataFrame) -> DataFrame:
    """(table_id, start_row, end_row, section_name, total_row, n_data, is_subtotal): the sections of tables, end_row exclusive.

    A section row opens a section; a total, or a row whose label says so, closes one and the name goes on; what is left at
    the end is open.  Section rows whose predecessor has neither name nor data close nothing.
    """
    up = F.upper("label")
    opens = F.col("row_type") == "section"
    total = ~opens & ((F.col("row_type") == "total") | up.contains("TOTAL"))
    edge = opens | total
    past = _order(True)
    last = F.last(F.when(edge, F.struct("row_idx", opens.alias("opens"))), ignorenulls=True).over(past)
    name = F.coalesce(F.last(F.when(opens, F.col("label")), ignorenulls=True).over(past), F.lit(""))
    s = rows.withColumn("seg", F.coalesce(F.sum(edge.cast("int")).over(past), F.lit(0))).withColumn("last", last).withColumn("name", name)
    start = F.coalesce(F.when(F.col("last.opens"), F.col("last.row_idx")).otherwise(F.col("last.row_idx") + 1), F.lit(0)).cast("int")
    a = s.withColumn("start", start).groupBy("table_id", "seg").agg(
        F.max("start").alias("start_row"), F.max(F.col("row_idx") + F.when(opens, 0).otherwise(1)).cast("int").alias("end_row"), F.max("name").alias("section_name"),
        F.max(F.when(total, F.col("row_idx"))).alias("total_row"), F.count_if((F.col("row_type") == "data") & ~total).alias("n_data"),
        F.coalesce(F.max(F.when(total, up.contains("SOUS") | up.contains("SUB"))), F.lit(False)).alias("is_subtotal"), F.max(opens).alias("by_section"),
    )
    kept = F.col("total_row").isNotNull() | (F.col("n_data") > 0) | (F.col("by_section") & (F.col("section_name") != ""))
    return a.filter(kept).select("table_id", "start_row", "end_row", "section_name", "total_row", "n_data", "is_subtotal")


def recomputed_totals(rows: DataFrame, tables: DataFrame, values: tuple[str, ...] = ("cur", "prev"), tolerance: float = 2.0, least: float = 0.7) -> DataFrame:
    """(table_id, row_idx, table_type, column, old_value, new_value, code): totals filled or replaced in each value column.

    ``tables`` (table_id, table_type, confidence) decides: under ``least`` nothing is done, nor in tables of no type.  Rows
    with MOINS, LESS or (DEDUCTION) in their label count against the sum.
    """
    up = F.upper("label")
    less = up.contains("MOINS") | up.contains("LESS") | up.contains("(DEDUCTION)")
    met = rows.join(tables.filter(F.col("table_type").isNotNull() & (F.col("confidence") >= least)).select("table_id", "table_type"), "table_id")
    s = segments(met)
    total = (F.col("row_type") == "total") | F.lower("label").contains("total")
    data = (F.col("row_type") == "data") & ~total
    each = [F.sum(F.when(data, F.when(less, -F.abs(c)).otherwise(F.col(c)))).alias(f"sum_{c}") for c in values]
    kept = [F.max(F.when(total, F.col(c))).alias(c) for c in values]
    a = s.groupBy("table_id", "segment").agg(F.any_value("table_type").alias("table_type"), F.max(F.when(total, F.col("row_idx"))).alias("row_idx"), *each, *kept).filter("row_idx IS NOT NULL")
    long = a.select("table_id", "row_idx", "table_type", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("old_value"), F.col(f"sum_{c}").alias("new_value")) for c in values))).alias("v")).select("table_id", "row_idx", "table_type", "v.*")
    gap = F.abs(F.col("new_value") - F.col("old_value"))
    code = F.when(F.col("new_value").isNull(), None).when(F.col("old_value").isNull(), "total_computed").when((gap > tolerance) & (F.try_divide(gap, F.abs("old_value")) < 0.5), "total_corrected")
    return long.withColumn("code", code).filter("code IS NOT NULL")


def note_amounts(slots: DataFrame) -> DataFrame:
    """(table_id, n_rows, n_large, has_misplaced) of slots (.., row_type), slot 0 being the note: over 30 % of the rows
    outside sections have a note above 1000 in magnitude."""
    a = slots.filter("slot = 0 AND row_type <> 'section'").groupBy("table_id").agg(F.count("*").alias("n_rows"), F.count_if(F.abs(S.number("value")) > 1000).alias("n_large"))
    return a.withColumn("has_misplaced", F.col("n_large") > 0.3 * F.col("n_rows"))


def amount_recovery(slots: DataFrame, dated: DataFrame) -> DataFrame:
    """(table_id, recovered, reason): whether the notes of a table are its amounts.

    They are where the table has no date column (``dated``: table_id), 70 % of its filled notes are numbers of a median
    magnitude of 1000 or more, and no other slot holds a number above 100.
    """
    filled = (F.col("slot") == 0) & ~S.clean("value").isin("", "-", "—")
    size = F.abs(S.number("value"))
    a = slots.groupBy("table_id").agg(
        F.count_if(filled).alias("n"), F.count_if(filled & size.isNotNull()).alias("n_numbers"), F.median(F.when(filled, size)).alias("median"),
        F.coalesce(F.max((F.col("slot") > 0) & (size > 100)), F.lit(False)).alias("others"),
    )
    met = a.join(dated.select("table_id").distinct().withColumn("dated", F.lit(True)), "table_id", "left")
    reason = (
        F.when(F.col("dated"), "dates").when(F.col("n") == 0, "no_notes").when(F.col("n_numbers") < 0.7 * F.col("n"), "few_numbers")
        .when(F.col("median") < 1000, "small_numbers").when(F.col("others"), "other_numbers").otherwise("recovered")
    )
    return met.select("table_id", (reason == "recovered").alias("recovered"), reason.alias("reason"))


def _middle(values: Column) -> Column:
    """The median of an array of numbers; null for an empty one."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda k: F.get(s, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def safe_shift(slots: DataFrame, least_median: float = 10000, least_other: float = 1000) -> DataFrame:
    """slots (table_id, row_idx, row_type, slot, value) with rows moved left from one slot that holds a note.

    That slot is the first whose magnitude is below 50 and below a hundredth of the row's sum of magnitudes, where the
    median of the row's other magnitudes is ``least_other`` or more, the next slot's is not small, and the note (slot 0)
    is empty.  Only in tables whose magnitudes over 100 have a median of ``least_median``; never in sections.
    """
    size = F.abs(S.number("value"))
    wide = F.median(F.when((F.col("slot") > 0) & (size > 100), size)).alias("median")
    tables = slots.groupBy("table_id").agg(wide).filter(F.col("median") >= least_median)
    cell = F.struct("slot", "value", size.alias("n"))
    rows = slots.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.any_value("row_type").alias("row_type"))
    met = rows.join(tables.select("table_id", F.lit(True).alias("large")), "table_id", "left")
    amounts = F.filter("cells", lambda c: (c["slot"] > 0))
    sizes = F.filter(F.transform(amounts, lambda c: c["n"]), lambda n: n.isNotNull())
    met = met.withColumn("limit", F.least(F.lit(50.0), F.aggregate(sizes, F.lit(0.0), lambda a, n: a + n) * 0.01)).withColumn("amounts", amounts).withColumn("sizes", sizes)

    def odd(c: Column, i: Column) -> Column:
        after = F.try_element_at("amounts", i + 2)["n"]
        other = _middle(F.filter("sizes", lambda n: n != c["n"]))
        return F.when((c["n"] < F.col("limit")) & (other >= least_other) & (after > F.col("limit")), c["slot"])

    note = F.coalesce(F.try_element_at(F.filter("cells", lambda c: c["slot"] == 0), F.lit(1))["value"], F.lit(""))
    free = F.col("large") & (F.col("row_type") != "section") & F.trim(note).isin("", "-", "—") & F.exists("cells", lambda c: c["slot"] == 0)
    met = met.withColumn("at", F.when(free, F.array_min(F.filter(F.transform("amounts", odd), lambda s: s.isNotNull()))))
    moved = F.try_element_at(F.filter("cells", lambda c: c["slot"] == F.col("at")), F.lit(1))["value"]
    out = met.select("table_id", "row_idx", "row_type", "at", moved.alias("moved"), "cells", F.posexplode("cells").alias("pos", "c"))
    after = F.coalesce(F.try_element_at("cells", F.col("pos") + 2)["value"], F.lit(""))
    value = F.when(F.col("at").isNull(), F.col("c.value")).when(F.col("c.slot") == 0, F.col("moved")).when(F.col("c.slot") >= F.col("at"), after).otherwise(F.col("c.value"))
    return out.select("table_id", "row_idx", "row_type", F.col("c.slot").alias("slot"), value.alias("value"), F.col("at").isNotNull().alias("was_shifted"))


def realigned_notes(slots: DataFrame, least_median: float = 10000, least: float = 0.7) -> DataFrame:
    """(table_id, row_idx, slot, value, confidence): notes among numbers that may go to the empty note of their row.

    The slot's column has a median magnitude of ``least_median`` or more and its share of numbers, 0.9 at most, is the
    confidence, ``least`` at least.  The first such slot of a row moves.
    """
    typed = slots.withColumn("k", S.value_type("value")).withColumn("n", F.abs(S.number("value")))
    filled = F.count_if(F.col("k") != "EMPTY")
    cols = typed.filter("slot > 0").groupBy("table_id", "slot").agg(F.median("n").alias("median"), F.least(F.lit(0.9), F.round(F.coalesce(F.try_divide(F.count_if(F.col("k") == "NUMBER"), filled), F.lit(0.0)), 6)).alias("confidence"))
    sure = cols.filter((F.col("median") >= least_median) & (F.col("confidence") >= least)).select("table_id", "slot", "confidence")
    strays = typed.filter("slot > 0 AND k = 'NOTE' AND row_type <> 'section'").join(sure, ["table_id", "slot"])
    first = strays.groupBy("table_id", "row_idx").agg(F.min(F.struct("slot", "value", "confidence")).alias("s"))
    free = slots.filter((F.col("slot") == 0) & S.clean("value").isin("", "-", "–", "—")).select("table_id", "row_idx")
    return first.join(free, ["table_id", "row_idx"], "left_semi").select("table_id", "row_idx", "s.slot", "s.value", "s.confidence")
