"""Outputs of a table or a result: CSV, JSON, Parquet, a summary, and the envelope of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, delimiter: str = ",", drop: tuple[str, ...] = ("row_type",)) -> None:
    """Header and rows, without the row type; one folder of part files, written in parallel."""
    rows.drop(*drop).write.option("header", True).option("sep", delimiter).mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_tables(rows: DataFrame, path: str) -> None:
    """Parquet, clustered by table so that a reader of one table skips the other files' row groups."""
    rows.repartition("table_id").sortWithinPartitions("table_id", "row_idx").write.mode("overwrite").parquet(path)


def summary(rows: DataFrame) -> DataFrame:
    """(table_id, row_type, n): counts by row type."""
    return rows.groupBy("table_id", "row_type").agg(F.count("*").alias("n"))


def table_json(cells: DataFrame) -> DataFrame:
    """(table_id, body): each table as one JSON object of columns and rows, rebuilt from its cells."""
    rows = cells.groupBy("table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "name", "raw"))), lambda c: F.struct(c["name"], c["raw"])).alias("pairs"))
    ordered = rows.withColumn("body", F.to_json(F.map_from_entries("pairs"))).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "body"))).alias("rows"))
    names = cells.groupBy("table_id").agg(F.array_sort(F.collect_set(F.struct("col_idx", "name"))).alias("names"))
    met = ordered.join(names, "table_id")
    heads = F.to_json(F.transform("names", lambda n: n["name"]))
    body = F.concat(F.lit('{"columns":'), heads, F.lit(',"rows":['), F.array_join(F.transform("rows", lambda r: r["body"]), ","), F.lit("]}"))
    return met.select("table_id", body.alias("body"))


def envelope(results: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_failed, failed): page results of a document; failures stay visible as page numbers."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("page_no"))))
    return results.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(~F.col("success")).alias("n_failed"), failed.alias("failed"))
