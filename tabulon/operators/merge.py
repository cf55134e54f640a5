"""Deduplication, label recovery and merging of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import scalars as S

#: Lookups of at most so many rows go to every executor; larger ones meet the rows in a shuffle.
BROADCAST_ROWS = 50_000
#: Fixed value: when two labels are the same.
LABEL_RATIO = 0.985


def signature(columns: Sequence[str]) -> Column:
    """What makes two rows the same: the compared form of each column, apart by a control mark."""
    return F.concat_ws("\u0001", *(S.compare_key(c) for c in columns))


def drop_repeats(rows: DataFrame, columns: Sequence[str], table: str = "table_id", order: str = "row_idx") -> DataFrame:
    """The first row, by order, of each signature in a table: one aggregation with map-side combination."""
    names = [c for c in rows.columns if c not in (table, order)]
    first = rows.groupBy(table, signature(columns).alias("__sig")).agg(F.min(F.struct(order, *names)).alias("r"))
    return first.select(table, "r.*")


def duplicate_ratio(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(table_id, n_rows, n_distinct, ratio, is_valid): valid up to a fifth of repeats."""
    a = rows.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.countDistinct(signature(columns)).alias("n_distinct"))
    ratio = 1 - F.col("n_distinct") / F.col("n_rows")
    return a.withColumn("ratio", F.round(ratio, 6)).withColumn("is_valid", ratio <= 0.20)


def fuzzy_dedup(rows: DataFrame, label: str = "label", percent: str = "var_percent", filled: Sequence[str] = (), kind: str = "row_type") -> DataFrame:
    """Greedy pass over each table in row order: a row like an earlier one by label (ratio 0.985 and up) and percent
    replaces it if it has more filled cells, else goes.

    Labels and percents are met in the form of ``compare_key``; percents are alike where they are equal or both empty.
    Sections and totals (``kind``, where there is such a column) without a percent also go where one of that label was
    there before.  Rows with an empty label stay, but for those equal in ``filled`` and kind to a row that stayed.

    The rows of a table lie together, ordered, in a partition and stream through the function, which holds the
    kept rows of one table at a time, by percent; a table is what a page holds.
    """
    columns = rows.columns
    at = {c: i for i, c in enumerate(columns)}
    counted = [at[c] for c in (filled or [c for c in columns if c not in ("table_id", "row_idx", kind)]) if c in at]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, kept = object(), _Kept()
        for part in parts:
            done = []
            for row in part.itertuples(index=False, name=None):
                if row[at["table_id"]] != table:
                    done += kept.rows
                    table, kept = row[at["table_id"]], _Kept()
                values = [_key(row[i]) for i in counted]
                size = sum(1 for i in counted if row[i] is not None and row[i] == row[i] and str(row[i]).strip() != "")
                kept.add(row, _key(row[at[label]]), _key(row[at[percent]]), row[at[kind]] if kind in at else None, values, size)
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(kept.rows, columns=columns)

    return rows.repartition("table_id").sortWithinPartitions("table_id", "row_idx").mapInPandas(run, rows.schema)


def recover_labels(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """rows with empty labels filled from (note, label); a note that is listed twice takes its greatest label."""
    one = lookup.groupBy("note").agg(F.max("label").alias("__label"))
    small = one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(one) if small else one, "note", "left")
    empty = (S.clean("label") == "") & (F.col("row_type") != "section")
    found = empty & F.col("__label").isNotNull()
    return met.withColumn("was_recovered", found).withColumn("label", F.when(found, F.col("__label")).otherwise(F.col("label"))).drop("__label")


def row_hash(label: Column, values: Column) -> Column:
    """Twelve hex digits of the label and the sorted values that hold a digit."""
    digits = F.filter(values, lambda v: v.rlike(r"\d"))
    return F.substring(F.md5(F.concat_ws("|", F.lower(F.trim(label)), F.array_join(F.array_sort(digits), "|"))), 1, 12)


def merge_pages(rows: DataFrame, dedup: bool = True) -> DataFrame:
    """Rows (doc_id, page_no, row_idx, label, values) of the pages of a document in page order; of rows with the
    same hash the first stays.  Only table columns are hashed, so equal rows of different pages do meet."""
    hashed = rows.withColumn("row_hash", row_hash(F.col("label"), F.col("values")))
    if dedup:
        first = hashed.groupBy("doc_id", "row_hash").agg(F.min(F.struct("page_no", "row_idx", "label", "values")).alias("r"))
        hashed = first.select("doc_id", "r.*", "row_hash")
    w = Window.partitionBy("doc_id").orderBy("page_no", "row_idx")
    return hashed.withColumn("merged_idx", F.row_number().over(w) - 1)


def merged_columns(headers: DataFrame) -> DataFrame:
    """(doc_id, columns): names in the order in which the pages show them first."""
    first = headers.groupBy("doc_id", "name").agg(F.min(F.struct("page_no", "col_idx")).alias("at"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("columns"))


def split_tables(rows: DataFrame) -> DataFrame:
    """rows (table_id, row_idx, is_header): a header within a table begins a new part; header rows go."""
    w = Window.partitionBy("table_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.sum(F.col("is_header").cast("int")).over(w)).filter("NOT is_header").drop("is_header")


def net_checks(rows: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """(table_id, row_idx, gross, amort, net, is_consistent): for each net row the last gross and amortisation
    rows within five rows above and four below; net = gross - |amort| up to the tolerance."""
    w = Window.partitionBy("table_id").orderBy("row_idx").rowsBetween(-5, 4)
    low = F.lower("label")
    net, gross, amort = low.contains("net") & ~low.contains("brut"), low.contains("brut"), low.contains("amort")
    last = lambda c: F.max(F.when(c & F.col("cur").isNotNull(), F.struct("row_idx", "cur"))).over(w)["cur"]
    met = rows.withColumn("is_net", net).withColumn("gross", last(gross)).withColumn("amort", last(amort))
    out = met.filter("is_net AND gross IS NOT NULL AND amort IS NOT NULL AND cur IS NOT NULL")
    return out.select("table_id", "row_idx", "gross", "amort", F.col("cur").alias("net"), (F.abs(F.col("cur") - (F.col("gross") - F.abs("amort"))) <= tolerance).alias("is_consistent"))


def balance_identity(rows: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """(table_id, assets, liabilities, equity, difference, is_balanced): assets = liabilities + equity, or liabilities
    alone; the first row of each kind by its label."""
    from tabulon.functions import patterns as P

    low = F.lower(S.clean("label"))
    first = lambda words: F.min(F.when(S.any_word(low, words) > 0, F.struct("row_idx", "cur")))["cur"]
    a = rows.groupBy("table_id").agg(first(P.ASSETS).alias("assets"), first(P.LIABILITIES).alias("liabilities"), first(P.EQUITY).alias("equity"))
    gap = F.least(F.abs(F.col("assets") - F.col("liabilities") - F.coalesce("equity", F.lit(0))), F.abs(F.col("assets") - F.col("liabilities")))
    return a.withColumn("difference", gap).withColumn("is_balanced", F.coalesce(F.col("difference") < tolerance, F.lit(False)))


def _key(value: object) -> str:
    """``compare_key`` of one value; null and NaN are empty."""
    return "" if value is None or value != value else re.sub("[^a-z0-9%.,()/-]", "", str(value).lower())


class _Kept:
    """The rows of one table that stay, in order of their first place."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.signatures: set[tuple] = set()
        self.headings: set[str] = set()
        self.alike: dict[str, list[list]] = {}

    def add(self, row: tuple, text: str, percent: str, kind: str | None, values: list[str], size: int) -> None:
        signature = (*values, kind)
        if signature in self.signatures:
            return
        if kind in ("section", "total") and text and not percent:
            if text in self.headings:
                return
            self.headings.add(text)
        for other in self.alike.get(percent, ()) if text else ():
            if _alike(other[1], text):
                if size > other[2]:
                    self.rows[other[0]] = row
                    other[1:] = [SequenceMatcher(None, "", text), size]
                return
        self.signatures.add(signature)
        if text:
            self.alike.setdefault(percent, []).append([len(self.rows), SequenceMatcher(None, "", text), size])
        self.rows.append(row)


def _alike(matcher: SequenceMatcher, text: str) -> bool:
    """Whether a label is that of the matcher; lengths and counts of characters rule most out first."""
    if text == matcher.b:
        return True
    if 2 * min(len(text), len(matcher.b)) < LABEL_RATIO * (len(text) + len(matcher.b)):
        return False
    matcher.set_seq1(text)
    return matcher.quick_ratio() >= LABEL_RATIO and matcher.ratio() >= LABEL_RATIO
