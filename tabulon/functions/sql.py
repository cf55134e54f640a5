"""The scalar library as SQL functions, and the parser as a table function.

The bodies are SQL expressions, so calls are inlined and stay in generated code; only ``st_parse_table`` and
``st_fuzzy_ratio`` are Python, the latter in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabulon.functions import patterns as P


def _bodies() -> dict[str, tuple[str, str]]:
    clean = f"regexp_replace(coalesce(v, ''), r'{P.EDGES}', '')"
    blanks = ", ".join(f"'{b}'" for b in P.BLANKS)
    digits = f"regexp_replace({clean}, '[^0-9,.]', '')"
    sign = f"IF({clean} RLIKE r'[(<]|^\\s*-', -1, 1)"
    grouped = f"replace(replace({digits}, '.', ''), ',', '.')"
    comma = f"concat(replace(regexp_extract({digits}, r'^(.*),(\\d{{1,2}})$', 1), ',', ''), '.', regexp_extract({digits}, r'^(.*),(\\d{{1,2}})$', 2))"
    plain = f"regexp_replace(replace({digits}, ',', ''), r'\\.+$', '')"
    number = f"CASE WHEN {digits} RLIKE r'^\\d{{1,3}}(\\.\\d{{3}})+(,\\d{{1,2}})?$' THEN {grouped} WHEN {digits} RLIKE r'^[^.]*,\\d{{1,2}}$' THEN {comma} ELSE {plain} END"
    kind = f"CASE WHEN {clean} IN ({blanks}) THEN 'EMPTY' WHEN {clean} RLIKE r'{P.PERCENT}' THEN 'PERCENT' WHEN {clean} RLIKE r'{P.NOTE}' THEN 'NOTE' WHEN {clean} RLIKE r'{P.NUMBER}' THEN 'NUMBER' ELSE 'TEXT' END"
    return {
        "st_clean": ("STRING", clean),
        "st_classify": ("STRING", kind),
        "st_is_note": ("BOOLEAN", f"{clean} RLIKE r'{P.NOTE}'"),
        "st_parse_number": ("DOUBLE", f"CASE WHEN ({kind}) = 'NUMBER' THEN {sign} * abs(try_cast({number} AS DOUBLE)) END"),
        "st_parse_percent": ("DOUBLE", f"CASE WHEN ({kind}) = 'PERCENT' THEN {sign} * abs(try_cast(replace({digits}, ',', '.') AS DOUBLE)) END"),
        "st_is_date_header": ("BOOLEAN", f"{clean} RLIKE r'{P.DATE_HEADER}' OR {clean} RLIKE r'{P.YEAR_HEADER}'"),
    }


@F.udtf(returnType="row_idx: int, name: string, raw: string")
class ParseTable:
    """Rows of the cells that a response's text holds; none for text without a table."""

    def eval(self, text: str):
        from tabulon.sources.parse import salvage

        found = salvage(text)
        for i, row in enumerate(found[1] if found else []):
            for name in found[0]:
                yield i, name, row.get(name, "")


def register(spark: SparkSession) -> None:
    """Make st_clean, st_classify, st_is_note, st_parse_number, st_parse_percent, st_is_date_header, st_fuzzy_ratio
    and st_parse_table known to SQL of this session."""
    for name, (kind, body) in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {body}")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from tabulon.operators.pages import indel_ratio

        return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    spark.udf.register("st_fuzzy_ratio", ratio)
    spark.udtf.register("st_parse_table", ParseTable)
