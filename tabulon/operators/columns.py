"""Column profiles, header roles and schema inference over long-form cells.

Relations: headers (table_id, col_idx, name) and cells (table_id, row_idx, col_idx, raw).  A column's evidence is
one aggregation by (table_id, col_idx); a role is taken by the first column that qualifies, by col_idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import scalars as S


def header_roles(headers: DataFrame) -> DataFrame:
    """headers with role: the first label, note, amount and percent column of a table keep theirs, later ones are
    unresolved; of dates in both slash and dot form only the form that leads stays."""
    first = Window.partitionBy("table_id", "kind").orderBy("col_idx")
    whole = Window.partitionBy("table_id")
    typed = headers.withColumn("kind", S.header_role("name")).withColumn("nth", F.row_number().over(first)).withColumn("fmt", S.date_format("name"))
    day = F.col("kind") == "date"
    slash, dot = (F.sum(F.when(day & (F.col("fmt") == f), 1).otherwise(0)).over(whole) for f in ("slash", "dot"))
    mixed = (slash > 0) & (dot > 0)
    leads = F.when(slash >= dot, "slash").otherwise("dot")
    single = F.col("kind").isin("label", "note", "var_amount", "var_percent")
    role = F.when(single & (F.col("nth") > 1), "unresolved").when(day & mixed & ~F.col("fmt").isin("none") & (F.col("fmt") != leads), "dropped").otherwise(F.col("kind"))
    return typed.withColumn("role", role).drop("kind", "nth", "fmt")


def slot_score(label: Column, note: Column, dates: Column, amount: Column, percent: Column, unresolved: Column) -> Column:
    """The confidence of a header from how many columns take each role; 0.3 at least where it has an amount or a period."""
    score = 0.3 * label + 0.1 * note + F.least(0.2 * dates, F.lit(0.4)) + 0.1 * amount + 0.1 * percent - 0.03 * unresolved
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(((dates > 0) | (amount == 1)) & (score < 0.3), 0.3).otherwise(score)))


def header_confidence(roles: DataFrame, *more: Column) -> DataFrame:
    """(table_id, n_dates, n_unresolved, confidence, is_valid, needs_fallback) from header_roles, and further aggregates."""
    has = lambda r: F.max((F.col("role") == r).cast("int"))
    n = lambda r: F.sum((F.col("role") == r).cast("int"))
    a = roles.groupBy("table_id").agg(has("label").alias("l"), has("note").alias("t"), has("var_amount").alias("a"), has("var_percent").alias("p"), n("date").alias("n_dates"), n("unresolved").alias("n_unresolved"), F.struct(F.lit(0).alias("_"), *more).alias("more"))
    numeric = (F.col("n_dates") > 0) | (F.col("a") == 1)
    score = slot_score(*(F.col(c) for c in ("l", "t", "n_dates", "a", "p", "n_unresolved")))
    valid = (numeric | (F.col("p") == 1)) & (F.col("n_dates") <= 5)
    out = a.select("table_id", "n_dates", "n_unresolved", F.round(score, 6).alias("confidence"), valid.alias("is_valid"), "more.*").drop("_")
    return out.withColumn("needs_fallback", ~F.col("is_valid") | (F.col("confidence") < 0.3) | (F.col("n_dates") == 0))


def profile(cells: DataFrame) -> DataFrame:
    """Per column: counts by value type, the exact median of magnitudes and the share of numbers."""
    kind = F.col("vtype")
    n = lambda k: F.count_if(kind == k)
    typed = cells.withColumn("vtype", S.value_type("raw")).withColumn("num", S.number("raw"))
    out = typed.groupBy("table_id", "col_idx").agg(
        F.count("*").alias("n"), n("EMPTY").alias("n_empty"), n("NUMBER").alias("n_number"), n("PERCENT").alias("n_percent"),
        n("NOTE").alias("n_note"), n("TEXT").alias("n_text"), F.median(F.abs("num")).alias("median_abs"),
    )
    full = F.col("n") - F.col("n_empty")
    return out.withColumn("numeric_ratio", F.when(full > 0, F.round(F.col("n_number") / full, 6)).otherwise(0.0))


def role_by_evidence(profiled: DataFrame) -> DataFrame:
    """profile with role: percent over half, text over half, note over 30 %, numeric over 70 %, empty over 80 %."""
    full = F.col("n") - F.col("n_empty")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), full), F.lit(0.0))
    role = (
        F.when(share("n_percent") > 0.5, "variation_percent").when(share("n_text") > 0.5, "label").when(share("n_note") > 0.3, "note")
        .when(share("n_number") > 0.7, "numeric").when(F.col("n_empty") > 0.8 * F.col("n"), "empty").otherwise("unknown")
    )
    return profiled.withColumn("role", role)


def infer_schema(cells: DataFrame, sample_rows: int = 5, least: float = 0.4) -> DataFrame:
    """(table_id, label_col, note_col, percent_col, numeric_cols) from the first rows of each table.

    A column stands for its leading value type where that has 40 % of the sample; ties go to TEXT, NOTE, NUMBER,
    PERCENT, EMPTY in that order.  Up to three numeric columns, by position.
    """
    kinds = ("TEXT", "NOTE", "NUMBER", "PERCENT", "EMPTY")
    typed = cells.filter(F.col("row_idx") < sample_rows).withColumn("vtype", S.value_type("raw"))
    by = typed.groupBy("table_id", "col_idx").agg(F.count("*").alias("n"), *(F.count_if(F.col("vtype") == k).alias(k) for k in kinds))
    most = F.greatest(*kinds)
    lead = F.coalesce(*(F.when(F.col(k) == most, k) for k in kinds))
    mixed = most < least * F.col("n")
    kind = F.when(mixed & (F.col("NUMBER") + F.col("PERCENT") > 0), "NUMBER").when(mixed, "NONE").otherwise(lead)
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("col_idx")))
    return by.withColumn("kind", kind).groupBy("table_id").agg(
        first("TEXT").alias("label_col"), first("NOTE").alias("note_col"), first("PERCENT").alias("percent_col"),
        F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "NUMBER", F.col("col_idx")))), 1, 3), ",").alias("numeric_cols"),
    )


def unresolved_roles(cells: DataFrame, roles: DataFrame, sample_rows: int = 20) -> DataFrame:
    """Roles of unresolved columns by their first rows: over 30 % percents, else over 30 % numbers (a date), else none."""
    mine = roles.filter("role = 'unresolved'").select("table_id", "col_idx")
    seen = cells.filter(F.col("row_idx") < sample_rows).join(mine, ["table_id", "col_idx"]).withColumn("vtype", S.value_type("raw"))
    share = lambda k: F.avg((F.col("vtype") == k).cast("int"))
    out = seen.groupBy("table_id", "col_idx").agg(share("PERCENT").alias("p"), share("NUMBER").alias("n"))
    return out.select("table_id", "col_idx", F.when(F.col("p") > 0.3, "var_percent").when(F.col("n") > 0.3, "date").otherwise("unresolved").alias("role"))


def date_order(headers: DataFrame) -> DataFrame:
    """(table_id, current_col, previous_col): the newest two periods; equal periods keep the column order."""
    w = Window.partitionBy("table_id").orderBy(F.col("year").desc(), "col_idx")
    dated = headers.withColumn("year", F.coalesce(F.year(S.period("name")), S.header_year("name"))).filter("year IS NOT NULL").withColumn("nth", F.row_number().over(w))
    pick = lambda k: F.max(F.when(F.col("nth") == k, F.col("name")))
    return dated.filter("nth <= 2").groupBy("table_id").agg(pick(1).alias("current_col"), pick(2).alias("previous_col"))


def schema_quality(label: Column, dates: Column, variation: Column, confidence: Column) -> Column:
    return 0.3 * label.cast("int") + 0.3 * F.least(dates / 2, F.lit(1.0)) + 0.2 * variation.cast("int") + 0.2 * confidence
