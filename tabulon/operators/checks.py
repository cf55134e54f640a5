"""Coverage, confidence, gating and reliability of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import patterns as P
from tabulon.functions import scalars as S


def coverage(rows: DataFrame, has_numeric_header: Column | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """(table_id, n_rows, n_section, n_data, n_total, confidence, is_valid): what a whole statement has; and further aggregates."""
    n = lambda k: F.count_if(F.col("row_type") == k)
    a = rows.groupBy("table_id").agg(F.count("*").alias("n_rows"), n("section").alias("n_section"), n("data").alias("n_data"), n("total").alias("n_total"), F.min_by(S.clean("label"), "row_idx").alias("first"), F.struct(F.lit(0).alias("_"), *more).alias("more"))
    numeric = has_numeric_header if has_numeric_header is not None else F.lit(True)
    faults = ((F.col("n_rows") < 5, 0.3), (F.col("n_section") == 0, 0.2), (F.col("n_data") == 0, 0.4), (F.col("n_total") == 0, 0.1), (F.coalesce(F.col("first"), F.lit("")) == "", 0.1), (~numeric, 0.3))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.when(c, w).otherwise(0.0) for c, w in faults), F.lit(0.0)))
    clean = ~faults[0][0]
    for c, _ in faults[1:]:
        clean = clean & ~c
    return a.select("table_id", "n_rows", "n_section", "n_data", "n_total", F.round(score, 6).alias("confidence"), clean.alias("is_valid"), "more.*").drop("_")


def extraction_confidence(cover: DataFrame, n_dates: Column, schema_ok: Column, any_role: Column) -> DataFrame:
    """(table_id, confidence): schema 25, rows 20, sections 15, totals 15, periods 25 of 100."""
    n = F.col("n_rows")
    score = (
        F.when(schema_ok, 0.25).when(any_role, 0.15).otherwise(0.0) + F.when(n >= 10, 0.2).when(n >= 5, 0.15).when(n >= 3, 0.1).otherwise(0.0)
        + F.when(F.col("n_section") > 0, 0.15).otherwise(0.0) + F.when(F.col("n_total") > 0, 0.15).otherwise(0.0)
        + F.when(n_dates >= 2, 0.25).when(n_dates >= 1, 0.15).otherwise(0.0)
    )
    return cover.select("table_id", F.round(score, 6).alias("confidence"))


def correction_mode(confidence: Column, aggressive: bool = False) -> Column:
    return F.when(confidence < 0.7, "none").when(confidence < 0.85, "safe").otherwise("aggressive" if aggressive else "safe")


def correction_allowed(confidence: Column, kind: Column, aggressive: bool = False) -> Column:
    """Whether a correction of this kind may be made: the safe kinds in any mode but none, the others in the aggressive one."""
    mode = correction_mode(confidence, aggressive)
    safe = kind.isin("realignment", "warning", "validation")
    return F.coalesce(((mode != "none") & safe) | ((mode == "aggressive") & kind.isin("shift", "recomputation", "cashflow", "total_fix")), F.lit(False))


def consistency(cells: DataFrame, roles: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_id, n_high, n_medium, penalty): numbers over 100 among notes and notes among numbers are high,
    whole numbers under 50 beside a median over 10 000 medium; section rows are left out."""
    typed = cells.join(roles.select("table_id", "col_idx", "role"), ["table_id", "col_idx"]).join(rows.select("table_id", "row_idx", "row_type"), ["table_id", "row_idx"])
    typed = typed.withColumn("k", S.value_type("raw")).withColumn("num", F.abs(S.number("raw")))
    numeric = F.col("role").isin("date", "var_amount")
    medians = typed.filter(numeric).groupBy("table_id").agg(F.median("num").alias("median"))
    met = typed.join(medians, "table_id", "left").filter("row_type <> 'section'")
    high = ((F.col("role") == "note") & (F.col("num") > 100)) | (numeric & (F.col("k") == "NOTE"))
    medium = numeric & (F.col("median") > 10000) & (F.col("num") < 50) & (F.col("num") / F.col("median") < 0.0001)
    sizes = cells.groupBy("table_id").agg(F.count("*").alias("n_cells"))
    a = met.groupBy("table_id").agg(F.count_if(high).alias("n_high"), F.count_if(medium & ~high).alias("n_medium")).join(sizes, "table_id")
    ratio = (F.col("n_high") + F.col("n_medium")) / F.col("n_cells")
    return a.select("table_id", "n_high", "n_medium", F.round(F.least(F.lit(0.5), F.col("n_high") * 0.05 + ratio * 0.3), 6).alias("penalty"))


def final_score(a: DataFrame) -> DataFrame:
    """a (schema_quality, penalty, n_errors, n_totals, n_dates, label_share) with pass_rate, score and action."""
    rate = F.when(F.col("n_totals") > 0, F.greatest(F.lit(0.0), 1 - F.col("n_errors") / F.greatest(F.col("n_totals") * F.col("n_dates"), F.lit(1)))).otherwise(1.0)
    out = a.withColumn("pass_rate", rate)
    base = 0.3 * F.col("schema_quality") + 0.3 * (1 - F.col("penalty")) + 0.2 * F.col("pass_rate") + 0.2 * F.col("label_share")
    score = F.greatest(F.lit(0.0), base - F.col("penalty") - F.least(F.lit(0.3), F.col("n_errors") * 0.05))
    return out.withColumn("score", F.round(score, 6)).withColumn("pass_rate", F.round("pass_rate", 6))


def reliability(a: DataFrame) -> DataFrame:
    """a (n_high, n_errors, n_dates, has_label, score) with n_reasons, is_reliable and action."""
    faults = (F.col("n_high") > 5, F.col("n_errors") > 2, F.col("n_dates") == 0, ~F.col("has_label"), F.col("score") < 0.3)
    reasons = sum((c.cast("int") for c in faults), F.lit(0))
    out = a.withColumn("n_reasons", reasons).withColumn("is_reliable", F.col("n_reasons") == 0)
    action = F.when((F.col("score") >= 0.7) & F.col("is_reliable"), "accept").when((F.col("score") >= 0.4) | (F.col("n_reasons") <= 1), "review").otherwise("reject")
    return out.withColumn("action", action)


def table_types(labels: DataFrame) -> DataFrame:
    """(table_id, table_type) of rows (table_id, label): the type of whose words a table's labels hold most, two at least.

    A word counts once a table and has to stand in one label; ties go to cash flow, balance sheet, income statement in
    that order.  One aggregation with map-side combination.
    """
    low = F.lower(F.coalesce(F.col("label"), F.lit("")))
    has = lambda w: F.max(low.contains(w).cast("int"))
    counts = [sum((has(w) for w in words), F.lit(0)).alias(k) for k, words in P.TABLE_TYPES.items()]
    a = labels.groupBy("table_id").agg(*counts, F.greatest(has("hors bilan"), has("engagement")).alias("off"))
    most = F.greatest(*P.TABLE_TYPES)
    best = F.coalesce(*(F.when(F.col(k) == most, k) for k in P.TABLE_TYPES))
    return a.select("table_id", F.when(F.col("off") == 1, "off_balance").when(most >= 2, best).otherwise("unknown").alias("table_type"))


def cash_flow_tables(labels: DataFrame, least: float = 0.2) -> DataFrame:
    """(table_id, is_cash_flow): over a fifth of the labels hold a cash-flow word."""
    hit = S.any_word(F.lower("label"), P.TABLE_TYPES["cash_flow"]) > 0
    return labels.groupBy("table_id").agg((F.avg(hit.cast("int")) > least).alias("is_cash_flow"))


def truncation_reasons(text: Column, n_rows: Column) -> Column:
    """Why a response looks cut off: its last mark, open braces or brackets, or fewer than three rows."""
    v = S.clean(text)
    count = lambda m: F.length(v) - F.length(F.replace(v, F.lit(m), F.lit("")))
    return F.array_compact(
        F.array(
            F.when(~v.rlike(r"[}\]]$"), "no_closing"), F.when(count("{") > count("}"), "open_brace"),
            F.when(count("[") > count("]"), "open_bracket"), F.when(n_rows < 3, "few_rows"), F.when(count('"') % 2 == 1, "open_quote"),
        )
    )


def next_budget(budget: Column, reasons: Column, parsed: Column) -> Column:
    """Tokens of a retry: half as many again, 8192 at most; the same where no retry helps."""
    structural = F.exists(reasons, lambda r: r != "few_rows")
    return F.when(structural | ~parsed, F.least(F.floor(budget * 1.5), F.lit(8192)).cast("int")).otherwise(budget.cast("int"))
