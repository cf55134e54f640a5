"""Schemas of tables: header scores, cleaning, merging, label columns and header lines inside tables.

Relations: headers (table_id, col_idx, name), cells (table_id, row_idx, col_idx, raw).  The headers of a table are one
array, as wide as the table; rows are grouped by (table_id, row_idx), so a table of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import patterns as P
from tabulon.functions import scalars as S
from tabulon.operators import columns


def artificial(name: Column) -> Column:
    """An empty, generic or wholly numeric header, years included."""
    return S.is_placeholder(name) | S.clean(name).rlike(r"^\d+$")


def score(names: Column) -> Column:
    """How well an array of headers suits a statement: dates 2 each, amount with percent 2, a note 1, two numeric
    columns 1; no dates -2, variations without dates -2 more, under three columns -3."""
    kept = F.filter(names, lambda c: ~artificial(c))
    dates = F.filter(kept, lambda c: S.clean(c).rlike(P.FULL_DATE))
    changes = F.filter(kept, lambda c: ~S.clean(c).rlike(P.FULL_DATE) & S.is_variation_header(c))
    notes = F.exists(kept, lambda c: ~S.is_variation_header(c) & F.lower(S.clean(c)).isin(*P.NOTE_WORDS))
    low = lambda c: F.lower(S.clean(c))
    amount = F.exists(changes, lambda c: low(c).contains("montant") | (low(c).contains("variation") & ~low(c).contains("%")))
    ratio = F.exists(changes, lambda c: low(c).contains("%"))
    n, v = F.size(dates), F.size(changes)
    one = lambda c, w: F.when(c, w).otherwise(0)
    return n * 2 + one(amount & ratio, 2) + one(notes, 1) + one(n + v >= 2, 1) - one(n == 0, 2) - one((n == 0) & (v > 0), 2) - one(F.size(kept) < 3, 3)


def _names(headers: DataFrame) -> DataFrame:
    return headers.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("name", F.lit("")).alias("name")))).alias("cols"))


def header_scores(headers: DataFrame) -> DataFrame:
    """(table_id, header_score); a null header is an empty one."""
    return _names(headers).select("table_id", score(F.transform("cols", lambda c: c["name"])).alias("header_score"))


def clean_schema(headers: DataFrame) -> DataFrame:
    """(table_id, names, header_score, date_format): headers without the artificial ones, Label and Note forced.

    Of dates in both slash and dot form only the form with more columns stays, the first seen on a tie, and dates then
    follow the other columns.  The score is that of the columns before Label and Note are added.
    """
    kept = F.filter("cols", lambda c: ~artificial(c["name"]))
    t = _names(headers).select("table_id", F.transform(kept, lambda c: F.struct(c["col_idx"].alias("i"), c["name"].alias("name"), S.date_format(c["name"]).alias("fmt"))).alias("cols"))
    of = lambda f: F.filter("cols", lambda c: c["fmt"] == f)
    slash, dot = of("slash"), of("dot")
    mixed = (F.size(slash) > 0) & (F.size(dot) > 0)
    more = (F.size(slash) > F.size(dot)) | ((F.size(slash) == F.size(dot)) & (F.try_element_at(slash, F.lit(1))["i"] < F.try_element_at(dot, F.lit(1))["i"]))
    lead = F.when(mixed & more, "slash").when(mixed, "dot").when(F.size(slash) > 0, "slash").when(F.size(dot) > 0, "dot").otherwise("none")
    ordered = F.when(mixed, F.concat(of("none"), F.when(more, slash).otherwise(dot))).otherwise(F.col("cols"))
    t = t.select("table_id", F.transform(ordered, lambda c: c["name"]).alias("names"), lead.alias("date_format"))
    t = t.withColumn("header_score", score(F.col("names")))
    t = t.withColumn("names", F.when(F.array_contains("names", "Label"), F.col("names")).otherwise(F.concat(F.array(F.lit("Label")), "names")))
    return t.withColumn("names", F.when(F.array_contains("names", "Note"), F.col("names")).otherwise(F.array_insert("names", 2, "Note"))).select("table_id", "names", "header_score", "date_format")


def match_key(name: Column | str) -> Column:
    """What two headers are matched by: case, edges and the form of dates do not count."""
    return F.translate(F.lower(S.clean(name)), ".", "/")


def project_rows(cells: DataFrame, schema: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, name, raw): cells (.., name, raw) under the names of ``clean_schema``.

    A column takes the cell of its very name, else the first by position whose key matches, else an empty text.  Tables
    without a schema go.
    """
    rows = cells.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "name", F.coalesce("raw", F.lit("")).alias("raw")))).alias("cells"))
    met = rows.join(schema.select("table_id", "names"), "table_id")
    first = lambda test: F.try_element_at(F.filter("cells", test), F.lit(1))["raw"]
    out = met.select("table_id", "row_idx", "cells", F.posexplode("names").alias("col_idx", "name"))
    raw = F.coalesce(first(lambda c: c["name"] == F.col("name")), first(lambda c: match_key(c["name"]) == match_key("name")), F.lit(""))
    return out.select("table_id", "row_idx", "col_idx", "name", raw.alias("raw"))


def slots(roles: DataFrame) -> DataFrame:
    """(table_id, label, note, dates, var_amount, var_percent, unresolved) from ``columns.header_roles``."""
    has = lambda r: F.col("role") == r
    one = lambda r: F.min(F.when(has(r), F.struct("col_idx", "name")))["name"].alias(r)
    every = lambda r, name: F.transform(F.array_sort(F.collect_list(F.when(has(r), F.struct("col_idx", "name")))), lambda c: c["name"]).alias(name)
    return roles.groupBy("table_id").agg(one("label"), one("note"), every("date", "dates"), one("var_amount"), one("var_percent"), every("unresolved", "unresolved"))


def canonical(label: str = "label", note: str = "note", dates: str = "dates", amount: str = "var_amount", percent: str = "var_percent") -> Column:
    """The known columns in canonical order."""
    return F.array_compact(F.concat(F.array(label, note), F.coalesce(dates, F.expr("CAST(array() AS array<string>)")), F.array(amount, percent)))


def merge_schemas(primary: DataFrame, fallback: DataFrame, most_dates: int = 4) -> DataFrame:
    """The slots of both: a role is the primary's, else the fallback's; distinct dates in order, four at most; columns
    that the fallback knows are no longer unresolved.  With the confidence of what came out."""
    none = F.expr("CAST(array() AS array<string>)")
    single = ("label", "note", "var_amount", "var_percent")
    other = fallback.select("table_id", *(F.col(c).alias(f"f_{c}") for c in (*single, "dates")), canonical().alias("known"))
    met = primary.join(other, "table_id", "full")
    dates = F.slice(F.array_distinct(F.concat(F.coalesce("dates", none), F.coalesce("f_dates", none))), 1, most_dates)
    left = F.array_except(F.coalesce("unresolved", none), F.coalesce("known", none))
    out = met.select("table_id", *(F.coalesce(c, f"f_{c}").alias(c) for c in single), dates.alias("dates"), left.alias("unresolved"))
    there = lambda c: F.col(c).isNotNull().cast("int")
    value = columns.slot_score(there("label"), there("note"), F.size("dates"), there("var_amount"), there("var_percent"), F.size("unresolved"))
    return out.withColumn("confidence", F.round(value, 6))


def schema_checks(slot_rows: DataFrame) -> DataFrame:
    """(table_id, n_columns, is_valid, has_minimum, issues) of slots."""
    n, dates = F.size(canonical()), F.size("dates")
    amount, percent = F.col("var_amount").isNotNull(), F.col("var_percent").isNotNull()
    issues = F.array_compact(F.array(
        F.when(dates == 0, "no_dates"), F.when(~amount & ~percent & (dates < 2), "few_periods"), F.when(n < 3, "few_columns"),
    ))
    return slot_rows.select("table_id", n.alias("n_columns"), (((dates >= 1) | (amount & percent)) & (n >= 3)).alias("is_valid"), (n > 0).alias("has_minimum"), issues.alias("issues"))


def label_columns(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, label_col, name, how): the column that holds a table's labels, null where none does.

    By name (``label``, then a synonym); else of the columns of which over 60 % of the filled cells are text the first
    column, or that with the highest share, the leftmost on a tie; else the first column where over 30 % are.  Columns
    called type or note are not tried.  Tables without rows have none.
    """
    full = S.clean("raw") != ""
    seen = cells.groupBy("table_id", "col_idx").agg(F.count_if(full).alias("n_full"), F.count_if(full & S.is_text("raw")).alias("n_text"))
    met = headers.join(seen, ["table_id", "col_idx"], "left")
    low = F.lower(F.coalesce("name", F.lit("")))
    tried = ~low.isin("type", "note", "notes", "") & (F.col("n_full") > 0)
    share = F.when(tried, F.col("n_text") / F.col("n_full"))
    here = F.struct("col_idx", "name")
    a = met.withColumn("share", share).groupBy("table_id").agg(
        F.min(F.when(low.isin("label", "labels"), here)).alias("named"), F.min(F.when(F.trim(low).isin(*P.LABEL_HEADERS), here)).alias("synonym"),
        F.max(F.when(F.col("share") > 0.6, F.struct("share", (-F.col("col_idx")).alias("c"), "name"))).alias("text"),
        F.min(F.struct("col_idx", "name", "share")).alias("first"), F.count("n_full").alias("n_cells"),
    )
    first = F.struct(F.col("first.col_idx").alias("col_idx"), F.col("first.name").alias("name"))
    best = F.struct((-F.col("text.c")).alias("col_idx"), F.col("text.name").alias("name"))
    pick = (
        F.when(F.col("named").isNotNull(), F.struct("named.*", F.lit("name").alias("how"))).when(F.col("synonym").isNotNull(), F.struct("synonym.*", F.lit("synonym").alias("how")))
        .when(F.col("first.share") > 0.6, F.struct(first["col_idx"].alias("col_idx"), first["name"].alias("name"), F.lit("text").alias("how")))
        .when(F.col("text").isNotNull(), F.struct(best["col_idx"].alias("col_idx"), best["name"].alias("name"), F.lit("text").alias("how")))
        .when(F.col("first.share") > 0.3, F.struct(first["col_idx"].alias("col_idx"), first["name"].alias("name"), F.lit("first").alias("how")))
    )
    a = a.select("table_id", F.when(F.col("n_cells") > 0, pick).alias("p"))
    return a.select("table_id", F.col("p.col_idx").alias("label_col"), F.col("p.name").alias("name"), F.col("p.how").alias("how"))


def no_label_header(name: Column | str) -> Column:
    """Headers whose cells are never labels: notes, variations, amounts, percents, dates, and empty ones."""
    low = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    return (low == "") | (S.any_word(low, ("note", "variation", "%", "montant")) > 0) | F.trim(low).rlike(r"^\d{2}[/.\-]\d{2}[/.\-]\d{4}$")


def ensure_labels(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, label, how): a label for each row.

    ``given``: the row's Label cell.  ``mapped``: where at most half of a table's rows have one, the cell of its label
    column.  ``recovered``: the first text of the row outside ``no_label_header``.  ``none``: an empty label.
    """
    names = headers.select("table_id", "col_idx", "name").join(label_columns(headers, cells).select("table_id", "label_col"), "table_id", "left")
    met = cells.select("table_id", "row_idx", "col_idx", "raw").join(names, ["table_id", "col_idx"])
    own = F.col("name") == "Label"
    fits = ~own & ~no_label_header("name") & S.is_text("raw")
    rows = met.groupBy("table_id", "row_idx").agg(
        F.coalesce(F.max(F.when(own, F.col("raw"))), F.lit("")).alias("given"), F.coalesce(F.max(F.when((F.col("col_idx") == F.col("label_col")) & ~own, F.col("raw"))), F.lit("")).alias("mapped"),
        F.min(F.when(fits, F.struct("col_idx", S.clean("raw").alias("raw"))))["raw"].alias("text"),
    )
    share = rows.groupBy("table_id").agg((F.avg((F.col("given") != "").cast("int")) > 0.5).alias("works"))
    out = rows.join(share, "table_id")
    step = F.when(F.col("given") != "", F.struct(F.col("given").alias("label"), F.lit("given").alias("how"))).when(~F.col("works"), F.struct(F.col("mapped").alias("label"), F.lit("mapped").alias("how"))).otherwise(F.struct(F.lit("").alias("label"), F.lit("none").alias("how")))
    out = out.withColumn("s", step)
    blank = S.clean("s.label") == ""
    found = F.when(~blank, F.col("s")).when(F.col("text").isNotNull(), F.struct(F.col("text").alias("label"), F.lit("recovered").alias("how"))).otherwise(F.struct(F.lit("").alias("label"), F.lit("none").alias("how")))
    return out.withColumn("s", found).select("table_id", "row_idx", "s.label", "s.how")


def embedded_headers(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, header_score): rows from the third on that look like a header line, with a score of 3 at least.

    A header word or a date counts 2, a compound header 3 more.
    """
    v = F.lower(S.clean("raw"))
    one = lambda c, w: F.when(c, w).otherwise(0)
    points = one(v.isin("label", "libellé", "note", "variation", "montant", "%"), 2) + one(v.rlike(r"^\d{2}[/.\-]\d{2}[/.\-]\d{4}$"), 2) + one(v.isin("en %", "en montant", "variation %", "variation montant"), 3)
    a = cells.filter("row_idx >= 2").withColumn("points", points).groupBy("table_id", "row_idx").agg(F.sum("points").cast("int").alias("header_score"))
    return a.filter("header_score >= 3")
