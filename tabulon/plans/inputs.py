"""Inputs of the named queries, derived from the driver's tables by SQL that Spark and other engines both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: lineitem by its key, which the driver's rows repeat.
LINES = """(
  SELECT l_orderkey, l_linenumber, MIN(l_returnflag) AS l_returnflag, MIN(l_linestatus) AS l_linestatus, MAX(l_extendedprice) AS l_extendedprice, MIN(l_quantity) AS l_quantity
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) lines"""

CELLS = f"""
SELECT l_orderkey AS table_id, l_linenumber AS row_idx, c AS col_idx,
  CASE (l_orderkey + l_linenumber * 3 + c * 5) % 23
    WHEN 0 THEN CAST(v AS VARCHAR(20)) WHEN 1 THEN '(' || v || ')' WHEN 2 THEN g || ' ' || r WHEN 3 THEN g || '.' || r || ',' || d
    WHEN 4 THEN q || ',' || (q % 10) WHEN 5 THEN q || ',5%' WHEN 6 THEN '(' || q || ',4%)' WHEN 7 THEN '-' || q || ' %'
    WHEN 8 THEN (q % 9 + 1) || '.' || (q % 8 + 1) WHEN 9 THEN '-' WHEN 10 THEN '' WHEN 11 THEN 'N/A'
    WHEN 12 THEN l_returnflag || ' total actif' WHEN 13 THEN g || ',' || r || '.50' WHEN 14 THEN '-' || v WHEN 15 THEN '<' || v || '>'
    WHEN 16 THEN '(4.' || (q % 9 + 1) || ')' WHEN 17 THEN 'III.' || (q % 9 + 1) WHEN 18 THEN '(' || (q % 9 + 1) || ')' WHEN 19 THEN q || 'abc'
    WHEN 20 THEN '(' || v WHEN 21 THEN g || '.' || r || '.' || r ELSE '  Poste ' || l_linestatus || '  ' END AS raw
FROM (
  SELECT *, CAST(FLOOR(v / 1000) AS BIGINT) AS g, lpad(CAST(v % 1000 AS VARCHAR(4)), 3, '0') AS r, lpad(CAST(q AS VARCHAR(3)), 2, '0') AS d
  FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(ROUND(l_extendedprice) AS BIGINT) AS v, CAST(l_quantity AS BIGINT) AS q FROM {LINES}) x) y
CROSS JOIN (VALUES (0), (1), (2)) AS t(c)
"""

#: One row per line: a label, a note, two periods, a variation and a percent, in one of three column orders.
ROWS = f"""
SELECT l_orderkey AS table_id, l_linenumber AS row_idx, CAST((k + l_orderkey % 3) % 6 AS INT) AS col_idx, k,
  CASE k
    WHEN 0 THEN CASE WHEN l_linenumber % 7 = 6 THEN 'Total ' || l_returnflag ELSE 'Poste ' || l_returnflag || l_linestatus || CASE WHEN l_linenumber % 2 = 0 THEN ' (' || (l_linenumber % 9 + 1) || ')' ELSE '' END END
    WHEN 1 THEN CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linenumber || '.' || (l_orderkey % 9 + 1) END
    WHEN 2 THEN CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE CAST(v AS VARCHAR(20)) END
    WHEN 3 THEN CASE WHEN l_linenumber % 5 = 4 THEN '4.2' ELSE '(' || (v + 1000) || ')' END
    WHEN 4 THEN CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE (v % 90 + 10) || ',5%' END
    ELSE CAST(v % 7000 + 100 AS VARCHAR(20)) END AS raw
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CAST(ROUND(l_extendedprice) AS BIGINT) AS v FROM {LINES}) x
CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(k)
"""

#: Sections by return flag, data rows by brand, totals of which every second table's is wrong; amounts in cents.
STATEMENT = """
WITH d AS (
  SELECT s_nationkey AS table_id, l_returnflag AS section, CASE WHEN p_brand LIKE '%2' THEN 'Moins ' ELSE '' END || p_brand AS label,
         CAST(SUM(CASE WHEN YEAR(l_shipdate) = 1999 THEN CAST(ROUND(l_extendedprice * 100) AS BIGINT) END) AS BIGINT) AS cur,
         CAST(SUM(CASE WHEN YEAR(l_shipdate) = 1998 THEN CAST(ROUND(l_extendedprice * 100) AS BIGINT) END) AS BIGINT) AS prev
  FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {part} ON p_partkey = l_partkey
  GROUP BY s_nationkey, l_returnflag, p_brand),
r AS (
  SELECT table_id, section, 1 AS kind, label, cur, prev FROM d
  UNION ALL SELECT table_id, section, 0, 'Section ' || section, NULL, NULL FROM d GROUP BY table_id, section
  UNION ALL SELECT table_id, section, 2, 'Total ' || section, CASE WHEN table_id % 5 = 4 THEN NULL ELSE CAST(SUM(cur) + CASE WHEN table_id % 2 = 1 THEN 500 ELSE 0 END AS BIGINT) END, CAST(SUM(prev) AS BIGINT)
  FROM d GROUP BY table_id, section),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY table_id ORDER BY section, kind, label) - 1 AS INT) AS row_idx FROM r)
SELECT table_id, row_idx, section, CASE kind WHEN 0 THEN 'section' WHEN 1 THEN 'data' ELSE 'total' END AS row_type, label,
       CASE WHEN row_idx % 4 = 1 THEN (row_idx % 6 + 1) || '.1' WHEN row_idx % 4 = 2 THEN 'voir' ELSE '' END AS note, cur, prev,
       CAST(CASE row_idx % 3 WHEN 0 THEN NULL WHEN 1 THEN cur - prev + 500 ELSE cur - prev END AS BIGINT) AS var_amount,
       CASE row_idx % 4 WHEN 0 THEN NULL WHEN 1 THEN 12.5 ELSE CAST(cur - prev AS DOUBLE) * 100 / prev END AS var_percent
FROM n
"""

#: Statements as the cells of a response: reversed periods, misplaced notes, malformed amounts, bare percents, tables
#: without totals, sections or a second period; c, p, m and pct are what the texts say.
CHAIN = f"""
WITH s AS (
  SELECT *, CASE WHEN label LIKE 'Moins%' THEN -1 ELSE 1 END AS sgn FROM ({STATEMENT}) z),
b AS (
  SELECT table_id, row_idx, row_type, section, label, CASE WHEN row_type = 'section' THEN '' ELSE note END AS note,
    CASE row_type WHEN 'data' THEN coalesce(cur, 0) WHEN 'total' THEN CASE WHEN table_id % 5 = 4 THEN NULL ELSE w + CASE WHEN table_id % 2 = 1 THEN 500 ELSE 0 END END END AS c,
    CASE row_type WHEN 'data' THEN coalesce(prev, 0) WHEN 'total' THEN v END AS p0
  FROM (SELECT *, CAST(SUM(CASE WHEN row_type = 'data' THEN sgn * coalesce(cur, 0) END) OVER (PARTITION BY table_id, section) AS BIGINT) AS w,
          CAST(SUM(CASE WHEN row_type = 'data' THEN sgn * coalesce(prev, 0) END) OVER (PARTITION BY table_id, section) AS BIGINT) AS v FROM s) y
  WHERE NOT (table_id % 6 = 1 AND row_type = 'total') AND NOT (table_id % 6 = 2 AND row_type = 'section')),
d AS (
  SELECT *, row_type = 'data' AND row_idx % 17 = 5 AS stray, row_type = 'data' AND row_idx % 19 = 7 AS bad,
    CASE WHEN row_type = 'section' OR row_idx % 3 = 0 THEN NULL WHEN row_idx % 3 = 1 THEN c - p0 + 500 ELSE c - p0 END AS m0,
    CASE WHEN row_type = 'section' OR row_idx % 4 = 0 THEN NULL WHEN row_idx % 4 = 1 THEN CAST(125 AS BIGINT)
      WHEN p0 <> 0 THEN CAST(FLOOR(CAST(c - p0 AS DOUBLE) * 1000 / CAST(p0 AS DOUBLE)) AS BIGINT) END AS tenths FROM b),
e AS (
  SELECT table_id, row_idx, row_type, section, label, note, c, stray, bad, row_idx % 4 = 2 AND tenths IS NOT NULL AS bare,
    CASE WHEN stray OR table_id % 7 = 3 THEN NULL ELSE p0 END AS p, CASE WHEN bad THEN NULL ELSE m0 END AS m, tenths,
    coalesce(CAST(c AS VARCHAR(20)), '') AS cur_text, CASE WHEN stray THEN '4.2' ELSE coalesce(CAST(p0 AS VARCHAR(20)), '') END AS prev_text,
    CASE WHEN bad THEN '12abc' ELSE coalesce(CAST(m0 AS VARCHAR(20)), '') END AS amount_text,
    CASE WHEN tenths IS NULL THEN '' ELSE CASE WHEN tenths < 0 THEN '-' ELSE '' END || CAST(CAST(FLOOR(abs(tenths) / 10) AS BIGINT) AS VARCHAR(20)) || ',' || CAST(abs(tenths) % 10 AS VARCHAR(2)) || CASE WHEN row_idx % 4 = 2 THEN '' ELSE '%' END END AS percent_text
  FROM d)
SELECT *, CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS INT) AS line FROM e
"""

HEADERS = """
SELECT n_nationkey AS table_id, c AS col_idx,
  CASE n_nationkey % 5
    WHEN 0 THEN CASE c WHEN 0 THEN 'Libellé' WHEN 1 THEN 'Notes' WHEN 2 THEN '31/12/2024' WHEN 3 THEN '31/12/2023' WHEN 4 THEN 'Variation Montant' ELSE 'Variation %' END
    WHEN 1 THEN CASE c WHEN 0 THEN 'Poste' WHEN 1 THEN '2024' WHEN 2 THEN '2023' WHEN 3 THEN 'Variation' WHEN 4 THEN 'Montant' ELSE '%' END
    WHEN 2 THEN CASE c WHEN 0 THEN 'col1' WHEN 1 THEN 'Rubriques' WHEN 2 THEN '31.12.2024' WHEN 3 THEN '31/12/2023' WHEN 4 THEN '30.06.2024' ELSE 'En %' END
    WHEN 3 THEN CASE c WHEN 0 THEN 'Désignation' WHEN 1 THEN 'Designation' WHEN 2 THEN 'Agence' WHEN 3 THEN '12' WHEN 4 THEN 'En' ELSE 'Solde' END
    ELSE CASE c WHEN 0 THEN 'Label' WHEN 1 THEN 'Note' WHEN 2 THEN 'Exercice 2022' WHEN 3 THEN '31-12-2023' WHEN 4 THEN 'En' ELSE 'En Montant' END END AS name
FROM {nation} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(c)
"""

PAGES = """
SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS doc_id, CAST(doc_id % 10 + 1 AS INT) AS page_no,
  CASE (doc_id * 7 + CAST(FLOOR(doc_id / 10) AS BIGINT)) % 11
    WHEN 0 THEN 'Bilan arrêté au 31 décembre' || chr(10) || 'Total actif et passif, capitaux propres' || chr(10)
    WHEN 1 THEN 'Etat de résultat' || chr(10) || 'Produits et charges, marge' || chr(10)
    WHEN 2 THEN 'Flux de trésorerie' || chr(10) || 'exploitation, investissement' || chr(10)
    WHEN 3 THEN 'Engagements hors bilan' || chr(10) WHEN 4 THEN 'Opinion et audit du bilan' || chr(10) || 'actif' || chr(10)
    WHEN 5 THEN 'AC1- caisse' || chr(10) || 'AC2- créances' || chr(10) || 'dettes, actif, passif' || chr(10)
    WHEN 6 THEN 'Suite: actif, passif' || chr(10) || '12 000' || chr(10) || '7' || chr(10)
    WHEN 7 THEN 'PR1- produits' || chr(10) || 'CH1- charges' || chr(10) ELSE '' END || text AS text
FROM {documents}
"""

EVENTS = "SELECT user_id, event_id, CAST(EXTRACT(YEAR FROM ts) * 8784 + EXTRACT(DOY FROM ts) * 24 + EXTRACT(HOUR FROM ts) AS BIGINT) AS hour FROM {events}"

RESPONSES = """
SELECT event_id AS table_id,
  CASE event_id % 6
    WHEN 0 THEN '{{"columns": ["Label", "2024"], "rows": [{{"Label": "' || event_type || '", "2024": "' || user_id || '"}}, {{"Label": "x", "2024": ""}}]}}'
    WHEN 1 THEN '```json' || chr(10) || '{{"columns": ["Label", "2024"], "rows": [{{"Label": "' || event_type || '", "2024": "' || user_id || '"}}]}}' || chr(10) || '```'
    WHEN 2 THEN '{{"columns": ["Label", "2024"], "rows": [{{"Label": "' || event_type || '", "2024": "' || user_id || '"}}, {{"Label": "cut'
    WHEN 3 THEN '{{"table": [{{"Label": "' || event_type || '", "2024": "' || user_id || '"}}]}}'
    WHEN 4 THEN 'nothing to see' ELSE '| Label | 2024 |' || chr(10) || '|---|---|' || chr(10) || '| ' || event_type || ' | ' || user_id || ' |' || chr(10) || '|  | 7 |' END AS text,
  event_type, user_id
FROM {events}
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables that its text names in braces."""
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    out = spark.sql(sql, **tables)
    # texts are columns of a table in practice: keep their made-up expressions from being copied into every use
    made = [c for c in ("raw", "text", "value", "name") if c in out.columns]
    return out.select(*[c for c in out.columns if c not in made], F.explode(F.array(F.struct(*made))).alias("made")).select("*", "made.*").drop("made") if made else out


def plain(sql: str) -> str:
    """The same text with plain table names."""
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
    return sql.format(**{n: n for n in names}).strip()
