"""Responses to tables: JSON in several shapes, pipe tables, and salvage of damaged text.

Two tiers: the JVM parses what is well-formed; only rows that it cannot read go through one Arrow function, which
walks the text with a bracket stack and keeps every complete row object.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The line below the header of a pipe table.
RULE = r"^[\s|:\-]*-[\s|:\-]*$"
TABLE = "struct<columns:array<string>,rows:array<map<string,string>>>"


def unfenced(text: Column) -> Column:
    """Without code fences, from the first brace to the last."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"```[a-zA-Z]*", "")
    return F.regexp_extract(plain, r"(?s)(\{.*\})", 1)


def fast_parse(responses: DataFrame) -> DataFrame:
    """responses with table: read by the JVM where the text is one JSON object with rows, or the older table key."""
    body = unfenced(F.col("text"))
    new = F.from_json(body, TABLE)
    old = F.from_json(body, "struct<table:array<map<string,string>>>")
    rows = F.filter(F.coalesce(new["rows"], old["table"]), lambda r: r.isNotNull())
    # a map cannot hold a key twice: such rows are for the salvage, which renames
    plain = F.forall(rows, lambda r: F.size(F.map_keys(r)) == F.size(F.array_distinct(F.map_keys(r))))
    given = F.coalesce(new["columns"], F.expr("CAST(array() AS array<string>)"))
    names = F.array_distinct(F.concat(given, F.flatten(F.transform(rows, F.map_keys))))
    return responses.withColumn("table", F.when(rows.isNotNull() & plain, F.struct(F.filter(names, lambda c: c != "type").alias("columns"), rows.alias("rows"))))


def pipe_table(text: Column) -> Column:
    """The table of a text with a rule line below a header line, else null; all in the JVM.

    Empty cells are dropped as the marks at the edges are, so values stand to the left; a header that repeats gets _2,
    _3; cells beyond the header are _extra_0, _extra_1.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.contains("|"))
    kinds = F.transform(lines, lambda x: x.rlike(RULE))
    cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
    at = F.array_position(kinds, F.lit(True)).cast("int")
    heads = F.try_element_at(cells, at - 1)
    nth = lambda i, n: F.size(F.filter(F.slice(heads, F.lit(1), i + 1), lambda x: x == n))
    names = F.transform(heads, lambda n, i: F.when(nth(i, n) > 1, F.concat(n, F.lit("_"), nth(i, n).cast("string"))).otherwise(n))
    body = F.transform(F.filter(F.arrays_zip(cells.alias("c"), kinds.alias("k"), F.sequence(F.lit(1), F.size(lines)).alias("at")), lambda z: (z["at"] > at) & ~z["k"]), lambda z: z["c"])
    name = lambda i: F.coalesce(F.try_element_at(names, i + 1), F.concat(F.lit("_extra_"), (i - F.size(names)).cast("string")))
    rows = F.transform(body, lambda r: F.map_from_entries(F.transform(r, lambda c, i: F.struct(name(i), c))))
    columns = F.array_distinct(F.concat(names, F.flatten(F.transform(rows, F.map_keys))))
    return F.when((at > 1) & (F.size(lines) > 1), F.struct(columns.alias("columns"), rows.alias("rows")))


def salvage(text: str | None) -> tuple[list[str], list[dict[str, str]]] | None:
    """Columns and complete rows of damaged text; None where there is none.  Repeated keys get _2, _3."""
    if not text:
        return None
    body = re.sub(r"```[a-zA-Z]*", "", text)
    names = re.search(r'"columns"\s*:\s*(\[[^\[\]]*\])', body)
    columns = _value(names.group(1)) if names else None
    rows, start, depth, quote, escaped = [], -1, 0, False, False
    at = re.search(r'"(?:rows|table)"\s*:\s*\[', body)
    for i in range(at.end() if at else 0, len(body)):
        c = body[i]
        if quote:
            quote = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quote = True
        elif c in "{[":
            if depth == 0:
                start = i
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth < 0:
                break
            if depth == 0 and start >= 0:
                row = _value(body[start : i + 1])
                if isinstance(row, dict):
                    rows.append(row)
                elif isinstance(row, list) and isinstance(columns, list):
                    rows.append({str(c): v for c, v in zip(columns, row, strict=False)} | {f"_extra_{k}": v for k, v in enumerate(row[len(columns) :])})
    if not at and len(rows) == 1 and isinstance(rows[0], dict):
        inner = rows[0].get("rows", rows[0].get("table"))
        columns, rows = rows[0].get("columns", columns), inner if isinstance(inner, list) else []
    rows = [{str(k): "" if v is None else str(v) for k, v in r.items()} for r in rows if isinstance(r, dict)]
    if not rows:
        return None
    given = [str(c) for c in columns] if isinstance(columns, list) else []
    return [c for c in dict.fromkeys([*given, *(k for r in rows for k in r)]) if c != "type"], rows


def _pairs(items: list[tuple]) -> dict:
    out: dict = {}
    for k, v in items:
        n, name = 1, k
        while name in out:
            n += 1
            name = f"{k}_{n}"
        out[name] = v
    return out


def _value(text: str) -> object:
    fixed = re.sub(r",\s*([}\]])", r"\1", text)
    fixed = re.sub(r"}\s*{", "},{", fixed)
    try:
        return json.loads(fixed, object_pairs_hook=_pairs)
    except ValueError:
        try:
            return ast.literal_eval(fixed)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None


def parse_responses(responses: DataFrame) -> DataFrame:
    """responses (table_id, text) with table and how (fast, pipe, salvaged, failed); one scan, failures stay rows."""
    first = fast_parse(responses).withColumn("__pipe", F.when(F.col("table").isNull(), pipe_table(F.col("text"))))

    @F.pandas_udf(TABLE)
    def slow(texts: pd.Series) -> pd.DataFrame:
        found = [salvage(t) for t in texts]
        return pd.DataFrame({"columns": [f and f[0] for f in found], "rows": [f and f[1] for f in found]})

    # the function sees null for rows that are parsed already
    rest = slow(F.when(F.col("table").isNull() & F.col("__pipe").isNull(), F.col("text")))
    met = first.withColumn("__slow", rest)
    ok = F.col("__slow.rows").isNotNull()
    how = F.when(F.col("table").isNotNull(), "fast").when(F.col("__pipe").isNotNull(), "pipe").when(ok, "salvaged").otherwise("failed")
    return met.withColumn("how", how).withColumn("table", F.coalesce("table", "__pipe", F.when(ok, F.col("__slow")))).drop("__slow", "__pipe")


def to_cells(parsed: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, name, raw) of parsed responses, missing cells as empty."""
    rows = parsed.filter("table IS NOT NULL").select("table_id", F.col("table.columns").alias("names"), F.posexplode("table.rows").alias("row_idx", "r"))
    return rows.select("table_id", "row_idx", "r", F.posexplode("names").alias("col_idx", "name")).select("table_id", "row_idx", "col_idx", "name", F.coalesce(F.try_element_at("r", F.col("name")), F.lit("")).alias("raw"))


def pipe_cells(responses: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, name, raw) of pipe tables: a line before a separator line is the header, empty
    cells are dropped as the marks at the edges are, so values stand to the left."""
    lines = responses.select("table_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).filter(F.col("line").contains("|"))
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    marked = lines.withColumn("is_rule", F.col("line").rlike(RULE)).withColumn("cells", cells)
    rule = marked.filter("is_rule").groupBy("table_id").agg(F.min("at").alias("rule_at"))
    met = marked.join(rule, "table_id")
    names = met.filter("at < rule_at").groupBy("table_id").agg(F.max_by("cells", "at").alias("names"))
    body = met.filter("at > rule_at AND NOT is_rule").join(names, "table_id").select("table_id", "at", "names", F.posexplode("cells").alias("col_idx", "raw"))
    first = body.groupBy("table_id").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    out = body.join(first, "table_id").withColumn("row_idx", F.array_position("ats", F.col("at")).cast("int") - 1)
    return out.select("table_id", "row_idx", "col_idx", F.coalesce(F.try_element_at("names", F.col("col_idx") + 1), F.concat(F.lit("_extra_"), F.col("col_idx") - F.size("names"))).alias("name"), "raw")


def list_rows_to_cells(tables: DataFrame) -> DataFrame:
    """Cells of (table_id, columns, rows array<array<string>>): positions are names, short rows are padded, cells
    beyond the columns are _extra_0, _extra_1."""
    rows = tables.select("table_id", "columns", F.posexplode("rows").alias("row_idx", "r"))
    spread = rows.select("table_id", "columns", "row_idx", "r", F.explode(F.sequence(F.lit(0), F.greatest(F.size("columns"), F.size("r")) - 1)).alias("col_idx"))
    name = F.coalesce(F.try_element_at("columns", F.col("col_idx") + 1), F.concat(F.lit("_extra_"), (F.col("col_idx") - F.size("columns")).cast("string")))
    return spread.select("table_id", "row_idx", "col_idx", name.alias("name"), F.coalesce(F.try_element_at("r", F.col("col_idx") + 1), F.lit("")).alias("raw"))


def allowed_file(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1)).isin("png", "jpg", "jpeg", "pdf", "tiff") & name.contains(".")


def scan_files(spark, path: str) -> DataFrame:
    """(path, name, length, is_allowed) of the files of a folder, read by Spark; contents are pruned away."""
    files = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), "length", allowed_file(name).alias("is_allowed"))
