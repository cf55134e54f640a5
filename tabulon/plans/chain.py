"""From responses to validated tables, their log of corrections and their report.

Parsed tables meet one row of header roles a table; from there on everything is partitioned by table_id, and rows,
log and report come from the same exchange.  Raw values are columns of their own and never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import scalars as S
from tabulon.operators import checks, columns, statements
from tabulon.sources import parse

SLOTS = ("label", "note", "cur", "prev", "var_amount", "var_percent")
NUMERIC = ("cur", "prev", "var_amount")
#: Numbers of a column whose median magnitude is below this are not told from notes.
LEAST_MEDIAN = 10000


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with the columns of right, a relation of one row a table that may come from left itself: its columns are
    named anew, as the analyzer loses its way in several joins of one lineage."""
    return left.join(right.select(*(F.col(c).alias(c) for c in right.columns)), "table_id", how)


def _kept(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns computed once a row: the optimizer copies no expression over a generator."""
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.explode(F.array(F.struct(*names))).alias("__kept")).select(*others, "__kept.*")


def header_slots(parsed: DataFrame) -> DataFrame:
    """(table_id, the header of each slot or null, header_confidence, n_dates, has_label, has_variation).

    The newest two date headers are the periods, whatever their order; equal years keep the column order.
    """
    roles = columns.header_roles(parsed.select("table_id", F.posexplode("table.columns").alias("col_idx", "name")))
    year = F.coalesce(F.year(S.period("name")), S.header_year("name"))
    has = lambda r: F.col("role") == r
    first = lambda r: F.min(F.when(has(r), F.struct("col_idx", "name")))["name"]
    dates = F.array_sort(F.collect_list(F.when(has("date"), F.struct((-F.coalesce(year, F.lit(0))).alias("y"), "col_idx", "name")))).alias("dates")
    a = columns.header_confidence(roles, *(first(r).alias(f"h_{r}") for r in ("label", "note", "var_amount", "var_percent")), dates)
    a = a.withColumns({"h_cur": F.try_element_at("dates", F.lit(1))["name"], "h_prev": F.try_element_at("dates", F.lit(2))["name"]})
    variation = F.col("h_var_amount").isNotNull() | F.col("h_var_percent").isNotNull()
    return a.select("table_id", *(f"h_{s}" for s in SLOTS), "n_dates", F.col("confidence").alias("header_confidence"), F.col("h_label").isNotNull().alias("has_label"), variation.alias("has_variation"))


def statement_rows(parsed: DataFrame) -> DataFrame:
    """A row a line: its raw slots (raw_label .. raw_var_percent), typed values, row_type and the table's header marks.

    Missing cells are empty, repeated header lines go, a bare number in the percent column is a percent, and malformed
    numbers have no value.  Tables that did not parse or have no rows are not there.
    """
    found = parsed.filter("table IS NOT NULL").select("table_id", "table")
    met = _joined(found, header_slots(found))
    lines = met.select("table_id", "n_dates", "header_confidence", "has_label", "has_variation", *(f"h_{s}" for s in SLOTS), F.posexplode("table.rows").alias("row_idx", "line"))
    raw = {f"raw_{s}": S.clean(F.try_element_at("line", F.col(f"h_{s}"))) for s in SLOTS}
    out = lines.withColumns(raw).drop("line", *(f"h_{s}" for s in SLOTS)).filter(~statements.is_header_row(F.col("raw_label")))
    out = _kept(out, *raw)
    digit = F.greatest(*(F.col(f"raw_{s}").rlike(r"\d") & ~S.row_note(f"raw_{s}") for s in (*NUMERIC, "var_percent")))
    typed = {s: F.when(~S.malformed(f"raw_{s}"), S.number(f"raw_{s}")) for s in NUMERIC}
    typed |= {"label": F.col("raw_label"), "note": F.col("raw_note"), "var_percent": F.coalesce(S.percent("raw_var_percent"), S.number("raw_var_percent"))}
    return _kept(out.withColumns(typed).withColumn("row_type", statements.row_type(F.col("raw_label"), digit)), *typed, "row_type")


def gates(rows: DataFrame) -> DataFrame:
    """(table_id, confidence, mode, applies, n_dates, has_label, label_share, schema_quality): corrections apply to whole
    statements of two periods whose mean confidence of rows and headers is enough for a correction mode."""
    quality = columns.schema_quality(F.col("has_label"), F.col("n_dates"), F.col("has_variation"), F.col("header_confidence"))
    heads = [F.any_value(c).alias(c) for c in ("n_dates", "has_label", "header_confidence")]
    named = F.avg((F.col("label") != "").cast("int")).alias("label_share")
    met = checks.coverage(rows, more=(*heads, named, F.any_value(quality).alias("schema_quality")))
    met = met.withColumn("confidence", F.round((F.col("confidence") + F.col("header_confidence")) / 2, 6))
    mode = F.when(F.col("is_valid") & (F.col("n_dates") >= 2), checks.correction_mode(F.col("confidence"))).otherwise("none")
    return met.withColumn("mode", mode).select("table_id", "confidence", "mode", (F.col("mode") != "none").alias("applies"), "n_dates", "has_label", "label_share", "schema_quality")


def corrected_rows(rows: DataFrame) -> DataFrame:
    """rows with new_* values and the codes of what was done; without codes where the table's gate is shut.

    A note that stands among numbers goes to an empty note cell where the column's median magnitude is large; the
    variation follows from the periods; equal periods vary by nothing.
    """
    whole = Window.partitionBy("table_id")
    met = _joined(rows, gates(rows).select("table_id", "mode", "applies"))
    for s in ("cur", "prev"):
        met = met.withColumn(f"med_{s}", F.median(F.abs(s)).over(whole))
    strays = [F.when((S.value_type(f"raw_{s}") == "NOTE") & (F.col(f"med_{s}") >= LEAST_MEDIAN), F.col(f"raw_{s}")) for s in ("cur", "prev")]
    met = met.withColumn("stray", F.when((F.col("raw_note") == "") & (F.col("row_type") != "section"), F.coalesce(*strays)))
    out = statements.variation(met)
    same = (F.col("cur") == F.col("prev")) & (F.col("row_type") != "section")
    moved = same & ((F.col("new_amount") != 0) | (F.coalesce("new_percent", F.lit(1.0)) != 0))
    out = out.withColumn("equal_code", F.when(moved, "equal_periods")).withColumn("new_amount", F.when(same, 0.0).otherwise(F.col("new_amount"))).withColumn("new_percent", F.when(same, 0.0).otherwise(F.col("new_percent")))
    out = out.withColumn("note_code", F.when(F.col("stray").isNotNull(), "note_realigned"))
    out = out.withColumn("malformed_codes", F.filter(F.array(*(F.when(S.malformed(f"raw_{s}"), F.lit(s)) for s in NUMERIC)), lambda x: x.isNotNull()))
    out = out.withColumn("format_code", F.when(S.value_type("raw_var_percent") == "NUMBER", "percent_formatted"))
    live = F.col("applies") & (F.col("row_type") != "section")
    codes = {c: F.when(live, F.col(c)) for c in ("amount_code", "percent_code", "sign_code", "equal_code", "note_code", "format_code", "malformed_codes")}
    values = {
        "new_amount": F.when(live, F.col("new_amount")).otherwise(F.col("var_amount")), "new_percent": F.when(live, F.col("new_percent")).otherwise(F.col("var_percent")),
        "new_note": F.when(live, F.coalesce("stray", "raw_note")).otherwise(F.col("raw_note")),
    }
    return out.withColumns(codes | values).drop("stray", "med_cur", "med_prev")


def validated_tables(corrected: DataFrame) -> DataFrame:
    """(table_id, row_idx, row_type, label, note, cur, prev, var_amount, var_percent, applies)."""
    return corrected.select("table_id", "row_idx", "row_type", "label", F.col("new_note").alias("note"), "cur", "prev", F.col("new_amount").alias("var_amount"), F.col("new_percent").alias("var_percent"), "applies")


def correction_log(corrected: DataFrame) -> DataFrame:
    """(table_id, row_idx, field, code, old_value, new_value): a row for each thing done; values of numbers only."""
    none = F.lit(None).cast("double")

    def entry(code: Column, field: str, old: Column, new: Column) -> Column:
        return F.when(code.isNotNull(), F.struct(F.lit(field).alias("field"), code.alias("code"), old.alias("old_value"), new.alias("new_value")))

    amount, percent = (F.col("var_amount"), F.col("new_amount")), (F.col("var_percent"), F.col("new_percent"))
    fixed = F.array_compact(F.array(
        entry(F.col("amount_code"), "var_amount", *amount), entry(F.col("percent_code"), "var_percent", *percent), entry(F.col("sign_code"), "var_percent", *percent),
        entry(F.col("equal_code"), "var_percent", *percent), entry(F.col("note_code"), "note", none, none), entry(F.col("format_code"), "var_percent", F.col("var_percent"), F.col("var_percent")),
    ))
    cleared = F.transform(F.coalesce("malformed_codes", F.expr("CAST(array() AS array<string>)")), lambda f: F.struct(f.alias("field"), F.lit("malformed_cleared").alias("code"), none.alias("old_value"), none.alias("new_value")))
    return corrected.select("table_id", "row_idx", F.explode(F.concat(fixed, cleared)).alias("__entry")).select("table_id", "row_idx", "__entry.*")


def penalties(rows: DataFrame) -> DataFrame:
    """(table_id, n_high, penalty): the consistency rule over the slots of rows, as ``checks.consistency`` has it."""
    whole = Window.partitionBy("table_id")
    cells = rows.select("table_id", "row_type", F.explode(F.array(*(F.struct(F.lit(s).alias("role"), F.col(f"raw_{s}").alias("raw")) for s in SLOTS))).alias("c")).select("table_id", "row_type", "c.*")
    cells = cells.withColumns({"k": S.value_type("raw"), "num": F.abs(S.number("raw"))})
    numeric = F.col("role").isin(*NUMERIC)
    cells = cells.withColumn("median", F.median(F.when(numeric, F.col("num"))).over(whole))
    data = F.col("row_type") != "section"
    high = F.coalesce(data & (((F.col("role") == "note") & (F.col("num") > 100)) | (numeric & (F.col("k") == "NOTE"))), F.lit(False))
    medium = data & numeric & (F.col("median") > 10000) & (F.col("num") < 50) & (F.col("num") / F.col("median") < 0.0001)
    a = cells.groupBy("table_id").agg(F.count_if(high).alias("n_high"), F.count_if(medium & ~high).alias("n_medium"), F.count("*").alias("n"))
    return a.select("table_id", "n_high", F.round(F.least(F.lit(0.5), F.col("n_high") * 0.05 + (F.col("n_high") + F.col("n_medium")) / F.col("n") * 0.3), 6).alias("penalty"))


def report(rows: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """A row a table: mode, confidence, faults of totals, consistency penalty, score, reasons and recommended action."""
    totals = statements.total_checks(rows, tolerance, subtract_less=True).groupBy("table_id").agg(F.count_if(F.col("status").isin("mismatch", "missing")).alias("n_errors"), F.count("*").alias("n_totals"))
    met = _joined(_joined(gates(rows), penalties(rows)), totals, "left").fillna(0, ["n_errors", "n_totals"])
    out = checks.reliability(checks.final_score(met))
    return out.select("table_id", "mode", "confidence", "n_errors", "n_totals", "n_high", "penalty", "score", "n_reasons", "is_reliable", "action")


def validate(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated rows, log and report of responses (table_id, text).

    Texts without a table, tables without rows and responses with a null table_id are in none of the three; responses
    that repeat a table_id are one table whose lines meet by row_idx.  Texts are parsed again for each result: write
    ``parse_responses`` first where several are wanted.  A table's headers are matched by name; columns whose header
    says nothing are left out.
    """
    rows = statement_rows(parse.parse_responses(responses))
    corrected = corrected_rows(rows)
    return validated_tables(corrected), correction_log(corrected), report(rows)
