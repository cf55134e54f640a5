"""Structured Streaming over responses and page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import scalars as S
from tabulon.operators import merge
from tabulon.sources import parse


def typed_cells(responses: DataFrame) -> DataFrame:
    """Parse and type a stream of responses; no state, so a lost executor repeats a micro-batch at most."""
    cells = parse.to_cells(parse.parse_responses(responses))
    return cells.withColumn("vtype", S.value_type("raw")).withColumn("num", S.number("raw"))


def distinct_rows(rows: DataFrame, event_time: str, delay: str, label: Column, values: Column) -> DataFrame:
    """A stream of page rows without repeats of a hash within the watermark; state older than that is dropped."""
    hashed = rows.withColumn("row_hash", merge.row_hash(label, values))
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["doc_id", "row_hash"])


def windowed_types(cells: DataFrame, event_time: str, delay: str, width: str) -> DataFrame:
    """Counts of value types by event-time window, for late data up to the delay."""
    return cells.withWatermark(event_time, delay).groupBy(F.window(event_time, width), "vtype").agg(F.count("*").alias("n"))


def append_tables(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends to Parquet; the checkpoint makes its files exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
