"""Registry of the engine's named queries and their SQL.

Each query applies one operator to whole tables of a folder.  Its SQL states the same result in another way over
the same input; queries that SQL cannot state have none and are held against plain Python in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import patterns as P
from tabulon.functions import scalars as S
from tabulon.operators import checks, columns, merge, pages, statements
from tabulon.plans import chain
from tabulon.plans import inputs as I
from tabulon.sources import parse

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(source: str, sql: str | None = None, **more: str) -> Callable:
    """Register a function of the input relations; in ``sql`` they are t and the names of ``more``."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(I.frame(spark, sf_dir, source), **{k: I.frame(spark, sf_dir, v) for k, v in more.items()})

        _QUERIES[f.__name__] = run
        if sql is not None:
            ctes = ", ".join(f"{k} AS ({I.plain(v)})" for k, v in {"t": source, **more}.items())
            body = sql.strip()
            _SQL[f.__name__] = f"WITH RECURSIVE {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# cells

KEY = ("table_id", "row_idx", "col_idx")
V = "trim(raw)"
D = "regexp_replace(raw, '[^0-9,.]', '', 'g')"
IS_EMPTY = f"{V} IN ('', '-', 'N/A')"
IS_PERCENT = f"{V} LIKE '%\\%%' ESCAPE '\\'"
IS_NOTE = rf"regexp_full_match({V}, '\((4|[IVX]+)\.[0-9]+\)|\([1-9]\)|III\.[0-9]|[0-9]{{1,3}}\.[0-9]{{1,3}}')"
IS_NUMBER = rf"regexp_full_match({V}, '[(<]?-?[0-9][0-9 .,]*[)>]?')"
KIND = f"CASE WHEN {IS_EMPTY} THEN 'EMPTY' WHEN {IS_PERCENT} THEN 'PERCENT' WHEN {IS_NOTE} THEN 'NOTE' WHEN {IS_NUMBER} THEN 'NUMBER' ELSE 'TEXT' END"
DIGITS = (
    f"CASE WHEN regexp_full_match({D}, '[0-9]{{1,3}}(\\.[0-9]{{3}})+(,[0-9]{{1,2}})?') THEN replace(replace({D}, '.', ''), ',', '.') "
    f"WHEN regexp_full_match({D}, '[0-9]+,[0-9]{{1,2}}') THEN replace({D}, ',', '.') ELSE replace({D}, ',', '') END"
)
SIGN = f"CASE WHEN contains(raw, '(') OR contains(raw, '<') OR {V} LIKE '-%' THEN -1 ELSE 1 END"
NUM = f"CASE WHEN {KIND} = 'NUMBER' THEN {SIGN} * TRY_CAST({DIGITS} AS DOUBLE) END"
PCT = f"CASE WHEN {KIND} = 'PERCENT' THEN {SIGN} * TRY_CAST(replace({D}, ',', '.') AS DOUBLE) END"


@query(I.CELLS, f"SELECT table_id, row_idx, col_idx, {KIND} AS vtype FROM t")
def classify_cells(t):
    return t.select(*KEY, S.value_type("raw").alias("vtype"))


@query(I.CELLS, f"SELECT table_id, row_idx, col_idx, {NUM} AS num FROM t WHERE {KIND} = 'NUMBER'")
def parse_numbers(t):
    return t.filter(S.value_type("raw") == "NUMBER").select(*KEY, S.number("raw").alias("num"))


@query(I.CELLS, f"SELECT table_id, row_idx, col_idx, {PCT} AS pct FROM t WHERE {KIND} = 'PERCENT'")
def parse_percents(t):
    return t.filter(S.value_type("raw") == "PERCENT").select(*KEY, S.percent("raw").alias("pct"))


@query(I.CELLS, f"SELECT table_id, row_idx, col_idx, {V} AS note FROM t WHERE {KIND} = 'NOTE'")
def note_refs(t):
    return t.filter(S.value_type("raw") == "NOTE").select(*KEY, S.clean("raw").alias("note"))


@query(I.CELLS, f"""
SELECT vtype, count(*) AS n, count(DISTINCT raw) AS n_raw, coalesce(sum(CAST(round(num) AS BIGINT)), 0)::BIGINT AS total
FROM (SELECT raw, {KIND} AS vtype, {NUM} AS num FROM t) GROUP BY vtype""")
def value_type_counts(t):
    typed = t.select("raw", S.value_type("raw").alias("vtype"), S.number("raw").alias("num"))
    return typed.groupBy("vtype").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("n_raw"), F.coalesce(F.sum(F.round("num").cast("long")), F.lit(0)).alias("total"))


@query(I.CELLS, rf"""
SELECT table_id, row_idx, col_idx FROM t
WHERE {V} <> '' AND (regexp_full_match({V}, '[0-9]+[a-zA-Z]+[0-9]*|[a-zA-Z]+[0-9]+')
  OR length(regexp_replace({V}, '[^(\[<]', '', 'g')) <> length(regexp_replace({V}, '[^)\]>]', '', 'g'))
  OR (length(regexp_replace({V}, '[^.]', '', 'g')) > 1 AND length(regexp_replace({V}, '[^,]', '', 'g')) > 1))""")
def malformed_numbers(t):
    return t.filter(S.malformed("raw")).select(*KEY)


@query(I.CELLS, "SELECT key, count(*) AS n FROM (SELECT regexp_replace(lower(raw), '[^a-z0-9%.,()/-]', '', 'g') AS key FROM t) GROUP BY key")
def compare_keys(t):
    return t.groupBy(S.compare_key("raw").alias("key")).agg(F.count("*").alias("n"))


@query(I.CELLS, rf"""
SELECT table_id, row_idx, col_idx,
  CASE WHEN {IS_EMPTY} THEN NULL WHEN contains(raw, '(') OR contains(raw, '<') THEN -1 ELSE 1 END
  * TRY_CAST(CASE WHEN regexp_full_match({D}, '[0-9]+,[0-9]{{1,2}}') THEN replace({D}, ',', '.') ELSE replace({D}, ',', '') END AS DOUBLE) AS num FROM t""")
def legacy_numbers(t):
    return t.select(*KEY, S.legacy_unsigned_number("raw").alias("num"))


@query(I.STATEMENT, """
SELECT table_id, row_idx, CASE WHEN cur % 100 = 0 THEN s ELSE s || '.' || lpad(CAST(abs(cur) % 100 AS VARCHAR), 2, '0') END AS shown
FROM (SELECT table_id, row_idx, cur, replace(format('{:,}', CAST(abs(cur) // 100 AS BIGINT)), ',', ' ') AS s FROM t) WHERE cur IS NOT NULL""")
def format_numbers(t):
    return t.filter("cur IS NOT NULL").select("table_id", "row_idx", S.format_number(F.col("cur") / 100).alias("shown"))


def _beside(x: str, letters: str, digit: str, step: int) -> str:
    """SQL: the letters of x whose neighbour is a digit as the digit; there are no lookarounds in that engine."""
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c, i: CASE WHEN c IN ({letters}) AND i + {step} > 0 AND regexp_matches(substr({x}, i + {step}, 1), '[0-9]') THEN '{digit}' ELSE c END), '')"


@query(I.CELLS, f"""WITH a AS (SELECT table_id, row_idx, col_idx, trim(translate(raw, '10', 'lO')) AS v FROM t), b AS (SELECT *, {_beside('v', "'l', 'I'", '1', -1)} AS w FROM a),
c AS (SELECT *, {_beside('w', "'l', 'I'", '1', 1)} AS x FROM b), d AS (SELECT *, {_beside('x', "'O'", '0', -1)} AS y FROM c), e AS (SELECT *, {_beside('y', "'O'", '0', 1)} AS z FROM d)
SELECT table_id, row_idx, col_idx, CASE WHEN regexp_matches(v, '[0-9]') THEN regexp_replace(z, '\\s+', ' ', 'g') ELSE v END AS repaired FROM e""")
def ocr_repair(t):
    return t.select(*KEY, S.repair_ocr(F.translate("raw", "10", "lO")).alias("repaired"))


# headers

TOKEN = "trim(regexp_replace(translate(lower(name), 'éèêëàâùûîïôö_-', 'eeeeaauuiioo  '), '\\s+', ' ', 'g'))"
HEADER_DATE = "(regexp_full_match(name, '[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}') OR regexp_full_match(name, '20[0-9][0-9]'))"
ROLE = f"""CASE WHEN regexp_full_match(lower(name), 'col[0-9]+') OR (regexp_full_match(name, '[0-9]+') AND NOT regexp_full_match(name, '20[0-9][0-9]')) THEN 'placeholder'
  WHEN {HEADER_DATE} THEN 'date' WHEN {TOKEN} IN ('label', 'libelle', 'poste', 'designation', 'rubriques') THEN 'label' WHEN {TOKEN} LIKE 'note%' THEN 'note'
  WHEN {TOKEN} IN ('variation %', '%', 'en %') THEN 'var_percent' WHEN {TOKEN} IN ('variation montant', 'montant', 'en montant') THEN 'var_amount'
  WHEN regexp_matches({TOKEN}, '(^|\\s)[0-9]{{4}}(\\s|$)') THEN 'date' ELSE 'unresolved' END"""
ROLES_SQL = f"""WITH h AS (SELECT *, {ROLE} AS kind FROM t),
f AS (SELECT table_id, count(*) FILTER (WHERE regexp_full_match(name, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')) AS slash, count(*) FILTER (WHERE regexp_full_match(name, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}')) AS dot FROM h WHERE kind = 'date' GROUP BY table_id),
roles AS (
  SELECT h.table_id, h.col_idx, h.name, CASE
    WHEN kind IN ('label', 'note', 'var_amount', 'var_percent') AND EXISTS (SELECT 1 FROM h o WHERE o.table_id = h.table_id AND o.kind = h.kind AND o.col_idx < h.col_idx) THEN 'unresolved'
    WHEN kind = 'date' AND slash > 0 AND dot > 0 AND ((contains(name, '/') AND dot > slash) OR (regexp_full_match(name, '[0-9.]+') AND contains(name, '.') AND slash >= dot)) THEN 'dropped' ELSE kind END AS role
  FROM h LEFT JOIN f USING (table_id))"""


@query(I.HEADERS, ROLES_SQL + " SELECT * FROM roles")
def header_roles(t):
    return columns.header_roles(t)


@query(I.HEADERS, ROLES_SQL + """, a AS (
  SELECT table_id, count(*) FILTER (WHERE role = 'date') AS n_dates, count(*) FILTER (WHERE role = 'unresolved') AS n_unresolved,
    count(*) FILTER (WHERE role = 'label') AS l, count(*) FILTER (WHERE role = 'note') AS n, count(*) FILTER (WHERE role = 'var_amount') AS a, count(*) FILTER (WHERE role = 'var_percent') AS p
  FROM roles GROUP BY table_id),
s AS (SELECT *, 0.3 * l + 0.1 * n + least(0.2 * n_dates, 0.4) + 0.1 * a + 0.1 * p - 0.03 * n_unresolved AS raw FROM a),
c AS (SELECT *, round(greatest(0, least(1, CASE WHEN (n_dates > 0 OR a > 0) AND raw < 0.3 THEN 0.3 ELSE raw END))::DOUBLE, 6) AS confidence, n_dates + a + p > 0 AND n_dates <= 5 AS is_valid FROM s)
SELECT table_id, n_dates, n_unresolved, confidence, is_valid, NOT is_valid OR confidence < 0.3 OR n_dates = 0 AS needs_fallback FROM c""")
def header_confidence(t):
    return columns.header_confidence(columns.header_roles(t))


@query(I.HEADERS, f"SELECT table_id, col_idx FROM t WHERE {ROLE} = 'placeholder'")
def header_placeholders(t):
    return t.filter(S.is_placeholder("name")).select("table_id", "col_idx")


@query(I.HEADERS, f"SELECT table_id, col_idx, name FROM t WHERE {HEADER_DATE}")
def date_headers(t):
    return t.filter(S.is_date_header("name")).select("table_id", "col_idx", "name")


@query(I.HEADERS, f"""SELECT table_id, col_idx, CASE WHEN {HEADER_DATE} THEN name WHEN {TOKEN} IN ('libelle', 'poste', 'designation', 'rubriques') THEN 'Label' WHEN {TOKEN} = 'notes' THEN 'Note'
  WHEN {TOKEN} IN ('montant', 'en montant') THEN 'Variation Montant' WHEN {TOKEN} IN ('%', 'en %') THEN 'Variation %' ELSE name END AS canonical FROM t""")
def header_names(t):
    return t.select("table_id", "col_idx", S.header_name("name").alias("canonical"))


@query(I.HEADERS, """
SELECT table_id, CASE table_id % 5 WHEN 0 THEN 'Label|Note|31/12/2024|31/12/2023|Variation Montant|Variation %' WHEN 1 THEN 'Label|2024|2023|Variation Montant|Variation %'
  WHEN 2 THEN 'col1|Label|31.12.2024|31/12/2023|30.06.2024|Variation %' WHEN 3 THEN 'Label|Label|Agence|12|En|Solde' ELSE 'Label|Note|Exercice 2022|31-12-2023|Variation Montant' END AS merged
FROM (SELECT DISTINCT table_id FROM t)""")
def header_merge(t):
    whole = t.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "name"))), lambda x: x["name"]).alias("names"))
    return whole.select("table_id", F.array_join(S.merge_headers("names"), "|").alias("merged"))


@query(I.HEADERS, """
WITH y AS (SELECT *, CAST(regexp_extract(name, '(20[0-9][0-9])', 1) AS INTEGER) AS year FROM t WHERE regexp_matches(name, '20[0-9][0-9]')),
r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY year DESC, col_idx) AS nth FROM y)
SELECT table_id, max(name) FILTER (WHERE nth = 1) AS current_col, max(name) FILTER (WHERE nth = 2) AS previous_col FROM r GROUP BY table_id""")
def date_order(t):
    return columns.date_order(t)


# columns

PROFILE_SQL = f"""WITH k AS (SELECT table_id, col_idx, row_idx, {KIND} AS vtype, {NUM} AS num FROM t),
p AS (SELECT table_id, col_idx, count(*) AS n, count(*) FILTER (WHERE vtype = 'EMPTY') AS n_empty, count(*) FILTER (WHERE vtype = 'NUMBER') AS n_number,
  count(*) FILTER (WHERE vtype = 'PERCENT') AS n_percent, count(*) FILTER (WHERE vtype = 'NOTE') AS n_note, count(*) FILTER (WHERE vtype = 'TEXT') AS n_text, median(abs(num)) AS median_abs
  FROM k GROUP BY table_id, col_idx)"""


@query(I.CELLS, PROFILE_SQL + " SELECT *, CASE WHEN n > n_empty THEN round(n_number / (n - n_empty), 6) ELSE 0.0 END AS numeric_ratio FROM p")
def column_profile(t):
    return columns.profile(t)


@query(I.CELLS, PROFILE_SQL + """ SELECT table_id, col_idx, CASE WHEN n_percent > 0.5 * (n - n_empty) THEN 'variation_percent' WHEN n_text > 0.5 * (n - n_empty) THEN 'label'
  WHEN n_note > 0.3 * (n - n_empty) THEN 'note' WHEN n_number > 0.7 * (n - n_empty) THEN 'numeric' WHEN n_empty > 0.8 * n THEN 'empty' ELSE 'unknown' END AS role FROM p""")
def column_roles(t):
    return columns.role_by_evidence(columns.profile(t)).select("table_id", "col_idx", "role")


@query(I.CELLS, f"""WITH k AS (SELECT table_id, col_idx, {KIND} AS vtype FROM t WHERE row_idx < 5),
c AS (SELECT table_id, col_idx, vtype, count(*) AS n, sum(count(*)) OVER (PARTITION BY table_id, col_idx) AS total,
  row_number() OVER (PARTITION BY table_id, col_idx ORDER BY count(*) DESC, list_position(['TEXT', 'NOTE', 'NUMBER', 'PERCENT', 'EMPTY'], vtype)) AS nth,
  bool_or(vtype IN ('NUMBER', 'PERCENT')) OVER (PARTITION BY table_id, col_idx) AS has FROM k GROUP BY table_id, col_idx, vtype),
l AS (SELECT table_id, col_idx, CASE WHEN n < 0.4 * total AND has THEN 'NUMBER' WHEN n < 0.4 * total THEN 'NONE' ELSE vtype END AS kind FROM c WHERE nth = 1)
SELECT table_id, min(col_idx) FILTER (WHERE kind = 'TEXT') AS label_col, min(col_idx) FILTER (WHERE kind = 'NOTE') AS note_col, min(col_idx) FILTER (WHERE kind = 'PERCENT') AS percent_col,
  coalesce(string_agg(CAST(col_idx AS VARCHAR), ',' ORDER BY col_idx) FILTER (WHERE kind = 'NUMBER'), '') AS numeric_cols FROM l GROUP BY table_id""")
def infer_schema_sample(t):
    return columns.infer_schema(t)


@query(I.CELLS, f"""SELECT table_id, col_idx, CASE WHEN avg(({KIND} = 'PERCENT')::INT) > 0.3 THEN 'var_percent' WHEN avg(({KIND} = 'NUMBER')::INT) > 0.3 THEN 'date' ELSE 'unresolved' END AS role
FROM t WHERE col_idx = 2 AND row_idx < 20 GROUP BY table_id, col_idx""")
def unresolved_roles(t):
    roles = t.filter("col_idx = 2").select("table_id", "col_idx").distinct().withColumn("role", F.lit("unresolved"))
    return columns.unresolved_roles(t, roles)


# rows

ROWS_KIND = "CASE WHEN raw = '' THEN 'EMPTY' WHEN k = 0 THEN 'TEXT' WHEN k = 1 OR raw = '4.2' THEN 'NOTE' WHEN k = 4 THEN 'PERCENT' ELSE 'NUMBER' END"
ROWS_NUM = "CASE WHEN raw LIKE '(%' THEN -CAST(raw[2:-2] AS DOUBLE) ELSE CAST(raw AS DOUBLE) END"


@query(I.ROWS, f"""WITH c AS (SELECT *, {ROWS_KIND} AS kind FROM t),
n AS (SELECT table_id, row_idx, {ROWS_NUM} AS num, row_number() OVER (PARTITION BY table_id, row_idx ORDER BY col_idx) AS nth FROM c WHERE kind = 'NUMBER'),
p AS (SELECT table_id, row_idx, max(num) FILTER (WHERE nth = 1) AS d1, max(num) FILTER (WHERE nth = 2) AS d2, max(num) FILTER (WHERE nth = 3) AS var_amount FROM n GROUP BY table_id, row_idx)
SELECT c.table_id, c.row_idx, CASE WHEN contains(c.raw, '(') THEN split_part(c.raw, ' (', 1) ELSE c.raw END AS label,
  CASE WHEN contains(c.raw, '(') THEN '(' || split_part(c.raw, ' (', 2) ELSE coalesce(no.raw, '') END AS note, CAST(replace(rtrim(pc.raw, '%'), ',', '.') AS DOUBLE) AS var_percent, d1, d2, var_amount
FROM c LEFT JOIN p USING (table_id, row_idx) LEFT JOIN (SELECT table_id, row_idx, arg_min(raw, col_idx) AS raw FROM c WHERE kind = 'NOTE' GROUP BY table_id, row_idx) no USING (table_id, row_idx)
LEFT JOIN (SELECT table_id, row_idx, raw FROM c WHERE kind = 'PERCENT') pc USING (table_id, row_idx) WHERE c.k = 0""")
def align_rows(t):
    return statements.align_rows(t)


@query(I.ROWS, f"""SELECT table_id, row_idx FROM t GROUP BY table_id, row_idx
HAVING min(col_idx) FILTER (WHERE raw = '') < max(col_idx) FILTER (WHERE {ROWS_KIND} = 'NUMBER')""")
def alignment_gaps(t):
    return statements.alignment_gaps(t)


_FIXED = {2: "date", 3: "date", 4: "var_percent", 5: "var_amount"}


@query(I.ROWS, "SELECT table_id, row_idx, col_idx, 'note_in_date' AS code FROM t WHERE k = 3 AND raw = '4.2' AND col_idx IN (3) UNION ALL "
       f"SELECT table_id, row_idx, col_idx, lower({ROWS_KIND}) || '_in_' || CASE col_idx WHEN 4 THEN 'var_percent' WHEN 5 THEN 'var_amount' ELSE 'date' END FROM t "
       f"WHERE NOT (k = 3 AND raw = '4.2' AND col_idx IN (3)) AND ((col_idx IN (2, 3, 5) AND {ROWS_KIND} IN ('PERCENT', 'NOTE')) OR (col_idx = 4 AND {ROWS_KIND} IN ('NUMBER', 'NOTE')))")
def row_type_guard(t):
    role = F.coalesce(*(F.when(F.col("col_idx") == k, r) for k, r in _FIXED.items()))
    roles = t.select("table_id", "col_idx").distinct().withColumn("role", role).filter("role IS NOT NULL")
    return statements.guard_findings(t, roles)


@query(I.ROWS, f"""SELECT table_id, row_idx, CASE WHEN lower(coalesce(max(raw) FILTER (WHERE col_idx = 0), '')) LIKE '%total%' THEN 'total'
  WHEN bool_or(col_idx > 1 AND regexp_matches(raw, '[0-9]') AND NOT regexp_full_match(raw, '\\([0-9]+.?[0-9]*\\)')) THEN 'data' ELSE 'section' END AS row_type FROM t GROUP BY table_id, row_idx""")
def row_types(t):
    return statements.typed_rows(t)


@query(I.PAGES, r"""SELECT doc_id, page_no, count(*) AS n FROM (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS label FROM t)
WHERE NOT regexp_matches(lower(trim(label)), '^(?:attijari\s*bank|etat\s*des|arr[eê]t[eé]\s*au|unit[eé]|\(unit[eé]|en\s*milliers|note$|variation$|en\s*montant$|en\s*%$|\d{2}[./]\d{2}[./]\d{4}$)') GROUP BY doc_id, page_no""")
def header_filter(t):
    lines = t.select("doc_id", "page_no", F.explode(F.split("text", "\n")).alias("label"))
    return statements.drop_header_rows(lines).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


# sections and totals

TOTALS = """WITH e AS (SELECT table_id, section, count(*) AS n, sum({part})::BIGINT AS expected FROM t WHERE row_type = 'data' GROUP BY table_id, section),
c AS (SELECT t.table_id, t.row_idx, 'Section ' || t.section AS section_name, e.n AS n_rows, e.expected, t.cur AS actual,
  CASE WHEN e.expected IS NULL THEN 'empty' WHEN t.cur IS NULL THEN 'missing' WHEN abs(e.expected - t.cur) > {tolerance} THEN 'mismatch' ELSE 'ok' END AS status
  FROM t JOIN e USING (table_id, section) WHERE t.row_type = 'total')"""
SIGNED = "CASE WHEN label LIKE 'Moins%' THEN -abs(cur) ELSE cur END"


@query(I.STATEMENT, TOTALS.format(part="cur", tolerance=100) + " SELECT * FROM c")
def section_totals(t):
    return statements.total_checks(t, 100)


@query(I.STATEMENT, TOTALS.format(part=SIGNED, tolerance=200) + " SELECT * FROM c")
def section_totals_less(t):
    return statements.total_checks(t, 200, subtract_less=True)


@query(I.STATEMENT, TOTALS.format(part="cur", tolerance=100) + " SELECT table_id, count(*) FILTER (WHERE status = 'mismatch') AS n_mismatch, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) AS n_totals FROM c GROUP BY table_id")
def total_mismatch(t):
    s = F.col("status")
    return statements.total_checks(t, 100).groupBy("table_id").agg(F.count_if(s == "mismatch").alias("n_mismatch"), F.count_if(s == "missing").alias("n_missing"), F.count("*").alias("n_totals"))


@query(I.STATEMENT, TOTALS.format(part="cur", tolerance=200) + """ SELECT table_id, row_idx, CASE WHEN fix THEN expected ELSE actual END AS corrected, fix AS was_corrected
FROM (SELECT *, coalesce(status = 'missing' OR (abs(expected - actual) > 200 AND abs(expected - actual) * 2 < abs(actual)), false) AS fix FROM c)""")
def corrected_totals(t):
    return statements.corrected_totals(statements.total_checks(t, 200), 200).select("table_id", "row_idx", "corrected", "was_corrected")


@query(I.STATEMENT, "SELECT table_id, row_idx, section, label, CASE WHEN row_type = 'section' THEN label ELSE 'Section ' || section END AS section_name FROM t")
def section_names(t):
    return statements.segments(t).select("table_id", "row_idx", "section", "label", "section_name")


VARIATION = """WITH a AS (SELECT *, cur - prev AS e FROM t WHERE row_type <> 'section'),
b AS (SELECT *, CASE WHEN e IS NULL THEN NULL WHEN var_amount IS NULL THEN 'variation_amount_computed' WHEN abs(e - var_amount) > 100 THEN 'variation_amount_corrected' END AS amount_code FROM a),
c AS (SELECT *, CASE WHEN amount_code IS NULL THEN var_amount ELSE e END AS new_amount FROM b),
d AS (SELECT *, CASE WHEN prev <> 0 THEN new_amount * 100.0 / prev END AS share FROM c),
f AS (SELECT *, CASE WHEN coalesce(prev, 0) = 0 THEN CASE WHEN var_percent IS NOT NULL THEN 'percent_cleared_division_by_zero' END WHEN share IS NULL THEN NULL
  WHEN var_percent IS NULL THEN 'percent_computed' WHEN abs(share - var_percent) > 0.5 THEN 'percent_corrected' END AS percent_code FROM d)"""


def _variation(t: DataFrame) -> DataFrame:
    return statements.variation(t.filter("row_type <> 'section'"), amount_tolerance=100.0)


@query(I.STATEMENT, VARIATION + " SELECT table_id, row_idx, new_amount, amount_code FROM f")
def yoy_variation(t):
    return _variation(t).select("table_id", "row_idx", "new_amount", "amount_code")


@query(I.STATEMENT, VARIATION + " SELECT table_id, row_idx, round(CASE WHEN coalesce(prev, 0) = 0 THEN NULL WHEN percent_code IS NOT NULL THEN share ELSE var_percent END, 4) AS new_percent, percent_code FROM f")
def yoy_percent(t):
    return _variation(t).select("table_id", "row_idx", F.round("new_percent", 4).alias("new_percent"), "percent_code")


@query(I.STATEMENT, VARIATION + " SELECT table_id, count(*) AS n, count(*) FILTER (WHERE sign(coalesce(CASE WHEN percent_code IS NOT NULL THEN share ELSE var_percent END, 0)) <> sign(new_amount) AND coalesce(CASE WHEN percent_code IS NOT NULL THEN share ELSE var_percent END) IS NOT NULL) AS n_wrong FROM f GROUP BY table_id")
def sign_consistency(t):
    return _variation(t).groupBy("table_id").agg(F.count("*").alias("n"), F.count("sign_code").alias("n_wrong"))


@query(I.STATEMENT, "SELECT table_id, row_idx FROM t WHERE coalesce(prev, 0) = 0 AND var_percent IS NOT NULL")
def zero_division(t):
    out = statements.variation(t, 100.0)
    return out.filter("percent_code = 'percent_cleared_division_by_zero'").select("table_id", "row_idx")


@query(I.STATEMENT, "SELECT table_id, row_idx FROM (SELECT *, CASE WHEN row_idx % 3 = 0 THEN prev ELSE cur END AS c2 FROM t) WHERE c2 = prev AND (coalesce(var_amount, 0) <> 0 OR coalesce(var_percent, 0) <> 0)")
def equal_periods(t):
    made = t.withColumn("cur", F.when(F.col("row_idx") % 3 == 0, F.col("prev")).otherwise(F.col("cur")))
    return statements.equal_periods(made).select("table_id", "row_idx")


@query(I.STATEMENT, """WITH n AS (SELECT *, min(row_idx) OVER (PARTITION BY table_id, note) AS first_row FROM t WHERE note <> '')
SELECT table_id, row_idx, note, 'duplicate_note' AS code, first_row FROM n WHERE row_idx > first_row
UNION ALL SELECT table_id, row_idx, note, 'not_a_note', first_row FROM n WHERE note = 'voir'
UNION ALL SELECT table_id, row_idx, note, 'note_on_header', first_row FROM n WHERE row_type <> 'data'""")
def note_duplicates(t):
    return statements.note_findings(t)


BALANCE = f"""
SELECT table_id, row_idx, cur, CASE row_idx WHEN 1 THEN 'Total actif' WHEN 2 THEN 'Total passif' WHEN 3 THEN 'Capitaux propres' WHEN 4 THEN 'Valeur brute' WHEN 5 THEN 'Amortissements' WHEN 6 THEN 'Valeur nette' ELSE 'Poste' END AS label
FROM (
  SELECT l_orderkey AS table_id, l_linenumber AS row_idx, CASE l_linenumber WHEN 1 THEN v + w + l_orderkey % 3 * 8 WHEN 2 THEN v WHEN 3 THEN w WHEN 4 THEN v WHEN 5 THEN -w WHEN 6 THEN v - w + l_orderkey % 4 * 6 ELSE v END AS cur
  FROM (SELECT l_orderkey, l_linenumber, CAST(FLOOR(o_totalprice) AS BIGINT) AS v, CAST(FLOOR(o_totalprice / 7) AS BIGINT) AS w FROM {I.LINES} JOIN {{orders}} ON o_orderkey = l_orderkey) x) y
"""


@query(BALANCE, """WITH a AS (SELECT table_id, arg_min(cur, row_idx) FILTER (WHERE label = 'Total actif') AS assets, arg_min(cur, row_idx) FILTER (WHERE label = 'Total passif') AS liabilities, arg_min(cur, row_idx) FILTER (WHERE label = 'Capitaux propres') AS equity FROM t GROUP BY table_id),
b AS (SELECT *, least(abs(assets - liabilities - coalesce(equity, 0)), abs(assets - liabilities)) AS difference FROM a)
SELECT *, coalesce(difference < 10, false) AS is_balanced FROM b""")
def balance_identity(t):
    return merge.balance_identity(t)


@query(BALANCE, """SELECT n.table_id, n.row_idx, max_by(g.cur, g.row_idx) AS gross, max_by(a.cur, a.row_idx) AS amort, n.cur AS net, abs(n.cur - (max_by(g.cur, g.row_idx) - abs(max_by(a.cur, a.row_idx)))) <= 10 AS is_consistent
FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) AS pos FROM t) n
JOIN (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) AS pos FROM t) g ON g.table_id = n.table_id AND g.label = 'Valeur brute' AND g.pos BETWEEN n.pos - 5 AND n.pos + 4
JOIN (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) AS pos FROM t) a ON a.table_id = n.table_id AND a.label = 'Amortissements' AND a.pos BETWEEN n.pos - 5 AND n.pos + 4
WHERE n.label = 'Valeur nette' GROUP BY n.table_id, n.row_idx, n.cur""")
def net_gross_window(t):
    return merge.net_checks(t.withColumn("label", F.regexp_replace("label", "nette", "net")))


LABELS = """
SELECT c_nationkey AS table_id, CASE WHEN c_custkey % 3 <> c_nationkey % 3 THEN c_mktsegment ELSE CASE c_custkey % 13 WHEN 0 THEN 'Flux de trésorerie' WHEN 1 THEN 'Encaissements' WHEN 2 THEN 'Total actif' WHEN 3 THEN 'Passif' WHEN 4 THEN 'Produits' WHEN 5 THEN 'Charges' ELSE c_mktsegment END END AS label, c_custkey AS row_idx
FROM {customer}
"""


def _count_sql(text: str, words: tuple[str, ...]) -> str:
    return " + ".join(f"(contains({text}, '{w.replace(chr(39), chr(39) * 2)}'))::INT" for w in words)


def _once_sql(words: tuple[str, ...]) -> str:
    """How many of the words stand in some label of a table."""
    return " + ".join(f"max(contains(lower(label), '{w.replace(chr(39), chr(39) * 2)}')::INT)" for w in words)


@query(LABELS, f"""WITH s AS (SELECT table_id, bool_or(contains(lower(label), 'engagement') OR contains(lower(label), 'hors bilan')) AS off, {", ".join(f"{_once_sql(w)} AS {k}" for k, w in P.TABLE_TYPES.items())} FROM t GROUP BY table_id)
SELECT table_id, CASE WHEN off THEN 'off_balance' WHEN greatest(cash_flow, balance_sheet, income_statement) < 2 THEN 'unknown' WHEN cash_flow >= balance_sheet AND cash_flow >= income_statement THEN 'cash_flow'
  WHEN balance_sheet >= income_statement THEN 'balance_sheet' ELSE 'income_statement' END AS table_type FROM s""")
def table_type(t):
    return checks.table_types(t)


@query(LABELS, "SELECT table_id, avg((contains(lower(label), 'flux') OR contains(lower(label), 'encaissements'))::INT) > 0.2 AS is_cash_flow FROM t GROUP BY table_id")
def cashflow_keywords(t):
    return checks.cash_flow_tables(t)


# notes that stand in number columns

SLOTS = f"""
SELECT l_orderkey AS table_id, l_linenumber AS row_idx, s AS slot,
  CASE s WHEN 0 THEN CASE WHEN l_linenumber % 3 = 0 THEN '7' ELSE '' END WHEN 1 THEN CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_linenumber AS VARCHAR(3)) ELSE CAST(v * 10 AS VARCHAR(20)) END
    WHEN 2 THEN CAST(v * 10 + 60000 AS VARCHAR(20)) WHEN 3 THEN CAST(v * 11 + 60000 AS VARCHAR(20)) ELSE CASE WHEN l_linenumber % 2 = 0 THEN '4.1' ELSE CAST(v + 60000 AS VARCHAR(20)) END END AS value
FROM (SELECT l_orderkey, l_linenumber, CAST(FLOOR(l_extendedprice) AS BIGINT) + 6000 AS v FROM {I.LINES}) x CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(s)
"""
MISPLACED = """WITH c AS (SELECT *, CASE WHEN value <> '' AND value <> '4.1' THEN CAST(value AS DOUBLE) END AS num FROM t),
m AS (SELECT *, median(CASE WHEN abs(num) > 50 THEN abs(num) END) OVER (PARTITION BY table_id, row_idx) AS med FROM c),
x AS (SELECT table_id, row_idx, slot, value FROM m WHERE med >= 50000 AND (value = '4.1' OR (num BETWEEN 1 AND 50 AND num / med < 0.0001)))"""


def _misplaced(t: DataFrame) -> DataFrame:
    return statements.misplaced_notes(t.select("table_id", "row_idx", F.col("slot").alias("col_idx"), F.col("value").alias("raw")))


@query(SLOTS, MISPLACED + " SELECT table_id, row_idx, slot AS col_idx, value AS raw FROM x")
def misplaced_notes(t):
    return _misplaced(t)


@query(SLOTS, MISPLACED + """, f AS (SELECT table_id, row_idx, min(slot) AS from_slot FROM x WHERE slot > 0 GROUP BY table_id, row_idx),
a AS (SELECT t.table_id, t.row_idx, t.slot, t.value, from_slot, from_slot IS NOT NULL AND max(CASE WHEN t.slot = 0 THEN t.value END) OVER p = '' AS was_shifted,
  max(CASE WHEN t.slot = from_slot THEN t.value END) OVER p AS moved, lead(t.value) OVER (PARTITION BY t.table_id, t.row_idx ORDER BY t.slot) AS nxt
  FROM t LEFT JOIN f ON f.table_id = t.table_id AND f.row_idx = t.row_idx WINDOW p AS (PARTITION BY t.table_id, t.row_idx))
SELECT table_id, row_idx, slot, CASE WHEN was_shifted AND slot = 0 THEN moved WHEN was_shifted AND slot >= from_slot THEN coalesce(nxt, '') ELSE value END AS value, was_shifted FROM a""")
def column_shift(t):
    found = _misplaced(t).select("table_id", "row_idx", F.col("col_idx").alias("slot")).filter("slot > 0")
    return statements.shift_left(t, found)


# scores

COVERAGE = """WITH a AS (SELECT table_id, count(*) AS n_rows, count(*) FILTER (WHERE row_type = 'section') AS n_section, count(*) FILTER (WHERE row_type = 'data') AS n_data, count(*) FILTER (WHERE row_type = 'total') AS n_total, arg_min(label, row_idx) AS first FROM t GROUP BY table_id),
cover AS (SELECT table_id, n_rows, n_section, n_data, n_total, round(greatest(0, 1 - 0.3 * (n_rows < 5)::INT - 0.2 * (n_section = 0)::INT - 0.4 * (n_data = 0)::INT - 0.1 * (n_total = 0)::INT - 0.1 * (first = '')::INT)::DOUBLE, 6) AS confidence,
  n_rows >= 5 AND n_section > 0 AND n_data > 0 AND n_total > 0 AND first <> '' AS is_valid FROM a)"""
#: Statements of which some lose their totals, sections or most rows.
BROKEN = f"SELECT * FROM ({I.STATEMENT}) z WHERE NOT (table_id % 6 = 1 AND row_type = 'total') AND NOT (table_id % 6 = 2 AND row_type = 'section') AND NOT (table_id % 6 = 3 AND row_idx > 3)"


@query(BROKEN, COVERAGE + " SELECT * FROM cover")
def coverage_score(t):
    return checks.coverage(t)


@query(BROKEN, COVERAGE + " SELECT table_id, round(0.25 + CASE WHEN n_rows >= 10 THEN 0.2 WHEN n_rows >= 5 THEN 0.15 WHEN n_rows >= 3 THEN 0.1 ELSE 0 END + 0.15 * (n_section > 0)::INT + 0.15 * (n_total > 0)::INT + 0.25, 6)::DOUBLE AS confidence FROM cover")
def extraction_confidence(t):
    return checks.extraction_confidence(checks.coverage(t), F.lit(2), F.lit(True), F.lit(True))


@query(BROKEN, COVERAGE + " SELECT table_id, CASE WHEN confidence < 0.7 THEN 'none' WHEN confidence < 0.85 THEN 'safe' ELSE 'aggressive' END AS mode FROM cover")
def gating_mode(t):
    return checks.coverage(t).select("table_id", checks.correction_mode(F.col("confidence"), aggressive=True).alias("mode"))


CONSISTENCY = """WITH c AS (SELECT table_id, row_idx, slot, CASE slot WHEN 0 THEN 'note' WHEN 4 THEN 'var_amount' ELSE 'date' END AS role, CASE WHEN value <> '' AND value <> '4.1' THEN CAST(value AS DOUBLE) END AS num, value FROM t),
m AS (SELECT table_id, median(num) AS med FROM c WHERE slot > 0 GROUP BY table_id),
s AS (SELECT c.table_id, (slot = 0 AND coalesce(num, 0) > 100) OR (slot > 0 AND value = '4.1') AS high, slot > 0 AND med > 10000 AND num < 50 AND num / med < 0.0001 AS medium FROM c JOIN m USING (table_id)),
p AS (SELECT table_id, count(*) AS n, count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE medium AND NOT high) AS n_medium FROM s GROUP BY table_id)"""


@query(SLOTS, CONSISTENCY + " SELECT table_id, n_high, n_medium, round(least(0.5, n_high * 0.05 + (n_high + n_medium)::DOUBLE / n * 0.3), 6) AS penalty FROM p")
def consistency(t):
    cells = t.select("table_id", "row_idx", F.col("slot").alias("col_idx"), F.col("value").alias("raw"))
    role = F.when(F.col("col_idx") == 0, "note").when(F.col("col_idx") == 4, "var_amount").otherwise("date")
    roles = cells.select("table_id", "col_idx").distinct().withColumn("role", role)
    rows = cells.select("table_id", "row_idx").distinct().withColumn("row_type", F.lit("data"))
    return checks.consistency(cells, roles, rows)


REPORT = TOTALS.format(part="cur", tolerance=100) + """, e2 AS (SELECT table_id, count(*) FILTER (WHERE status IN ('mismatch', 'missing')) AS n_errors, count(*) AS n_totals FROM c GROUP BY table_id),
l AS (SELECT table_id, avg((label <> '')::INT) AS label_share, count(*) AS n_rows FROM t GROUP BY table_id),
r AS (SELECT l.table_id, n_errors, n_totals, greatest(0, 1 - n_errors / greatest(n_totals * 2, 1)) AS rate, table_id % 7 AS n_high, least(0.5, (table_id % 7) * 0.05) AS penalty, label_share FROM l JOIN e2 USING (table_id)),
q AS (SELECT *, round(greatest(0, 0.3 * 0.8 + 0.3 * (1 - penalty) + 0.2 * rate + 0.2 * label_share - penalty - least(0.3, n_errors * 0.05))::DOUBLE, 6) AS score FROM r),
z AS (SELECT *, (n_high > 5)::INT + (n_errors > 2)::INT + (score < 0.3)::INT AS n_reasons FROM q)"""


def _report(t: DataFrame) -> DataFrame:
    totals = statements.total_checks(t, 100).groupBy("table_id").agg(F.count_if(F.col("status").isin("mismatch", "missing")).alias("n_errors"), F.count("*").alias("n_totals"))
    rows = t.groupBy("table_id").agg(F.avg((F.col("label") != "").cast("int")).alias("label_share"))
    n_high = F.col("table_id") % 7
    a = rows.join(totals, "table_id").select("*", n_high.alias("n_high"), F.least(F.lit(0.5), n_high * 0.05).alias("penalty"), F.lit(0.8).alias("schema_quality"), F.lit(2).alias("n_dates"), F.lit(True).alias("has_label"))
    return checks.reliability(checks.final_score(a))


@query(I.STATEMENT, REPORT + " SELECT table_id, n_errors, n_totals, round(rate, 6)::DOUBLE AS pass_rate, score FROM z")
def quality_report(t):
    return _report(t).select("table_id", "n_errors", "n_totals", "pass_rate", "score")


@query(I.STATEMENT, REPORT + " SELECT table_id, n_reasons, n_reasons = 0 AS is_reliable, CASE WHEN score >= 0.7 AND n_reasons = 0 THEN 'accept' WHEN score >= 0.4 OR n_reasons <= 1 THEN 'review' ELSE 'reject' END AS action FROM z")
def reliability_action(t):
    return _report(t).select("table_id", "n_reasons", "is_reliable", "action")


@query(I.STATEMENT, VARIATION + " SELECT table_id, row_idx, 'var_amount' AS field, CASE WHEN amount_code LIKE '%computed' THEN NULL ELSE var_amount END AS old_value, new_amount AS new_value, amount_code AS code FROM f WHERE amount_code IS NOT NULL")
def correction_log(t):
    out = _variation(t).filter("amount_code IS NOT NULL")
    old = F.when(~F.col("amount_code").endswith("computed"), F.col("var_amount"))
    return out.select("table_id", "row_idx", F.lit("var_amount").alias("field"), old.alias("old_value"), F.col("new_amount").alias("new_value"), F.col("amount_code").alias("code"))


# the chain from responses to validated tables


def _responses(t: DataFrame) -> DataFrame:
    """A response a table, as JSON text; the periods of odd tables stand in reverse."""
    odd, earlier = F.col("table_id") % 2 == 1, F.when(F.col("table_id") % 7 == 3, "Solde").otherwise("31/12/2023")
    cells = {"Libellé": "label", "Note": "note", "31/12/2024": "cur_text", "Variation Montant": "amount_text", "Variation %": "percent_text"}
    row = F.map_concat(F.create_map(*(x for k, v in cells.items() for x in (F.lit(k), F.col(v)))), F.create_map(earlier, F.col("prev_text")))
    dates = [F.when(odd, earlier).otherwise(F.lit("31/12/2024")), F.when(odd, F.lit("31/12/2024")).otherwise(earlier)]
    names = F.array(F.lit("Libellé"), F.lit("Note"), *dates, F.lit("Variation Montant"), F.lit("Variation %"))
    a = t.select("table_id", "line", row.alias("row"), names.alias("names")).groupBy("table_id", "names").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.to_json("row").alias("j")))), lambda x: x["j"]).alias("rows"))
    return a.select("table_id", F.concat(F.lit('{"columns": '), F.to_json("names"), F.lit(', "rows": ['), F.array_join("rows", ","), F.lit("]}")).alias("text"))


def _chain_rows(t: DataFrame) -> DataFrame:
    return chain.statement_rows(parse.parse_responses(_responses(t)))


CHAINED = """WITH h AS (SELECT table_id, CASE WHEN table_id % 7 = 3 THEN 1 ELSE 2 END AS n_dates, CASE WHEN table_id % 7 = 3 THEN 0.77 ELSE 1.0 END AS hc FROM t GROUP BY table_id),
n AS (SELECT table_id, count(*) AS n_rows, count(*) FILTER (WHERE row_type = 'section') AS ns, count(*) FILTER (WHERE row_type = 'data') AS nd, count(*) FILTER (WHERE row_type = 'total') AS nt, median(abs(p)) AS med FROM t GROUP BY table_id),
g AS (SELECT h.*, nt, n_rows, med, round(((greatest(0, 1 - 0.3 * (n_rows < 5)::INT - 0.2 * (ns = 0)::INT - 0.4 * (nd = 0)::INT - 0.1 * (nt = 0)::INT) + hc) / 2)::DOUBLE, 6) AS confidence, n_rows >= 5 AND ns > 0 AND nd > 0 AND nt > 0 AS whole FROM h JOIN n USING (table_id)),
k AS (SELECT *, CASE WHEN NOT whole OR n_dates < 2 OR confidence < 0.7 THEN 'none' ELSE 'safe' END AS mode FROM g),
r AS (SELECT t.table_id, t.line AS row_idx, row_type, label, t.note, c::DOUBLE AS c, p::DOUBLE AS p, m::DOUBLE AS m, tenths / 10.0::DOUBLE AS pct, stray, bad, bare, mode <> 'none' AS applies, mode <> 'none' AND row_type <> 'section' AS live, med FROM t JOIN k USING (table_id)),
a AS (SELECT *, CASE WHEN c - p IS NULL THEN NULL WHEN m IS NULL THEN 'variation_amount_computed' WHEN abs(c - p - m) > 1 THEN 'variation_amount_corrected' END AS ac FROM r),
b AS (SELECT *, CASE WHEN ac IS NULL THEN m ELSE c - p END AS na FROM a),
s AS (SELECT *, CASE WHEN p <> 0 THEN na / p * 100 END AS share, coalesce(p, 0) = 0 AS zero FROM b),
u AS (SELECT *, CASE WHEN zero THEN CASE WHEN pct IS NOT NULL THEN 'percent_cleared_division_by_zero' END WHEN share IS NULL THEN NULL WHEN pct IS NULL THEN 'percent_computed' WHEN abs(share - pct) > 0.5 THEN 'percent_corrected' END AS pc FROM s),
v AS (SELECT *, CASE WHEN zero THEN NULL WHEN pc IS NOT NULL THEN share ELSE pct END AS np FROM u),
w AS (SELECT *, CASE WHEN sign(np) <> sign(na) THEN 'sign_consistency_corrected' END AS sc, CASE WHEN sign(np) <> sign(na) THEN sign(na) * abs(np) ELSE np END AS sp FROM v),
f AS (SELECT *, CASE WHEN c = p AND (na <> 0 OR coalesce(sp, 1) <> 0) THEN 'equal_periods' END AS ec, live AND stray AND note = '' AND med >= 10000 AS moved,
  CASE WHEN NOT live THEN m WHEN c = p THEN 0 ELSE na END AS fa, CASE WHEN NOT live THEN pct WHEN c = p THEN 0 ELSE sp END AS fp FROM w)"""


@query(I.CHAIN, CHAINED + " SELECT table_id, row_idx, row_type, label, CASE WHEN moved THEN '4.2' ELSE note END AS note, c AS cur, p AS prev, fa AS var_amount, fp AS var_percent, applies FROM f")
def validated_tables(t):
    return chain.validated_tables(chain.corrected_rows(_chain_rows(t)))


@query(I.CHAIN, CHAINED + """ SELECT table_id, row_idx, 'var_amount' AS field, ac AS code, m AS old_value, fa AS new_value FROM f WHERE live AND ac IS NOT NULL
UNION ALL SELECT table_id, row_idx, 'var_percent', code, pct, fp FROM (SELECT *, unnest([pc, sc, ec]) AS code FROM f WHERE live) z WHERE code IS NOT NULL
UNION ALL SELECT table_id, row_idx, 'var_percent', 'percent_formatted', pct, pct FROM f WHERE live AND bare UNION ALL SELECT table_id, row_idx, 'note', 'note_realigned', NULL, NULL FROM f WHERE moved
UNION ALL SELECT table_id, row_idx, 'var_amount', 'malformed_cleared', NULL, NULL FROM f WHERE live AND bad""")
def validation_log(t):
    return chain.correction_log(chain.corrected_rows(_chain_rows(t)))


@query(I.CHAIN, CHAINED + """, x AS (SELECT table_id, unnest([c, p, m]) AS num, unnest([false, stray AND table_id % 7 <> 3, false]) AS high FROM r WHERE row_type <> 'section'),
xm AS (SELECT table_id, median(abs(num)) AS med FROM x GROUP BY table_id),
y AS (SELECT table_id, count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE NOT high AND med > 10000 AND abs(num) < 50 AND abs(num) / med < 0.0001) AS n_medium FROM x JOIN xm USING (table_id) GROUP BY table_id),
sums AS (SELECT table_id, section, sum(CASE WHEN label LIKE 'Moins%' THEN -abs(c) ELSE c END) AS expected FROM t WHERE row_type = 'data' GROUP BY table_id, section),
e AS (SELECT table_id, count(*) FILTER (WHERE c IS NULL OR abs(c - expected) > 2) AS n_errors FROM t JOIN sums USING (table_id, section) WHERE row_type = 'total' GROUP BY table_id),
q AS (SELECT table_id, mode, confidence, n_dates, coalesce(n_errors, 0) AS n_errors, nt AS n_totals, n_high, round(least(0.5, n_high * 0.05 + (n_high + n_medium)::DOUBLE / (n_rows * 6) * 0.3), 6) AS penalty, 0.3 + 0.3 * least(n_dates / 2, 1) + 0.2 + 0.2 * hc AS quality
  FROM k JOIN y USING (table_id) LEFT JOIN e USING (table_id)),
j AS (SELECT *, round(greatest(0, 0.3 * quality + 0.3 * (1 - penalty) + 0.2 * CASE WHEN n_totals = 0 THEN 1 ELSE greatest(0, 1 - n_errors / greatest(n_totals * n_dates, 1)) END + 0.2 - penalty - least(0.3, n_errors * 0.05))::DOUBLE, 6) AS score FROM q),
i AS (SELECT *, (n_high > 5)::INT + (n_errors > 2)::INT + (score < 0.3)::INT AS n_reasons FROM j)
SELECT table_id, mode, confidence, n_errors, n_totals, n_high, penalty, score, n_reasons, n_reasons = 0 AS is_reliable, CASE WHEN score >= 0.7 AND n_reasons = 0 THEN 'accept' WHEN score >= 0.4 OR n_reasons <= 1 THEN 'review' ELSE 'reject' END AS action FROM i""")
def validation_report(t):
    return chain.report(_chain_rows(t))


# dedup and merge

PAGE_ROWS = f"""
SELECT CAST(FLOOR(l_orderkey / 4) AS BIGINT) AS doc_id, l_orderkey % 4 AS page_no, l_linenumber AS row_idx, l_orderkey AS table_id, 'Poste ' || l_returnflag || (l_linenumber % 3) AS label, CAST(l_linenumber AS VARCHAR(3)) AS a, CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR(3)) AS b
FROM {I.LINES}
"""


@query(PAGE_ROWS, "SELECT table_id, min(row_idx) AS row_idx, min(label) AS label, min(b) AS b FROM t GROUP BY table_id, lower(label), b")
def dup_signature(t):
    return merge.drop_repeats(t.select("table_id", "row_idx", "label", "b"), ["label", "b"])


@query(PAGE_ROWS, "WITH a AS (SELECT table_id, count(*) AS n_rows, count(DISTINCT label || '/' || b) AS n_distinct FROM t GROUP BY table_id) SELECT table_id, n_rows, n_distinct, round(1 - n_distinct / n_rows, 6) AS ratio, 1 - n_distinct / n_rows <= 0.2 AS is_valid FROM a")
def dup_ratio(t):
    return merge.duplicate_ratio(t, ["label", "b"])


@query(PAGE_ROWS)
def fuzzy_dedup(t):
    rows = t.select("table_id", "row_idx", F.concat("label", F.lit(" des immobilisations corporelles et incorporelles nettes de la periode "), "b").alias("label"), F.lit(None).cast("double").alias("var_percent"), F.when(F.col("row_idx") % 2 == 0, F.col("a")).alias("a"))
    return merge.fuzzy_dedup(rows)


@query(PAGE_ROWS, "SELECT doc_id, page_no, row_idx, substr(md5(lower(trim(label)) || '|' || CASE WHEN a <= b THEN a || '|' || b ELSE b || '|' || a END), 1, 12) AS row_hash FROM t")
def row_hash(t):
    return t.select("doc_id", "page_no", "row_idx", merge.row_hash(F.col("label"), F.array("a", "b")).alias("row_hash"))


@query(PAGE_ROWS, """WITH k AS (SELECT doc_id, page_no, row_idx, label, row_number() OVER (PARTITION BY doc_id, lower(label), least(a, b), greatest(a, b) ORDER BY page_no, row_idx) AS nth FROM t)
SELECT doc_id, page_no, row_idx, label, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, row_idx) - 1 AS INTEGER) AS merged_idx FROM k WHERE nth = 1""")
def page_merge(t):
    rows = t.select("doc_id", "page_no", "row_idx", "label", F.array("a", "b").alias("values"))
    return merge.merge_pages(rows).select("doc_id", "page_no", "row_idx", "label", "merged_idx")


@query(PAGE_ROWS, "WITH k AS (SELECT doc_id, label, min(page_no * 100 + row_idx) AS pos FROM t GROUP BY doc_id, label) SELECT doc_id, string_agg(label, '|' ORDER BY pos) AS names FROM k GROUP BY doc_id")
def columns_union(t):
    heads = t.select("doc_id", "page_no", F.col("row_idx").alias("col_idx"), F.col("label").alias("name"))
    return merge.merged_columns(heads).select("doc_id", F.array_join("columns", "|").alias("names"))


@query(PAGE_ROWS, "SELECT table_id, row_idx, (SELECT count(*) FROM t h WHERE h.table_id = t.table_id AND h.row_idx <= t.row_idx AND h.row_idx % 4 = 0)::BIGINT AS part FROM t WHERE row_idx % 4 <> 0")
def split_tables(t):
    return merge.split_tables(t.select("table_id", "row_idx", (F.col("row_idx") % 4 == 0).alias("is_header")))


@query(I.STATEMENT, "SELECT t.table_id, t.row_idx, CASE WHEN t.row_idx % 2 = 0 AND t.row_type <> 'section' AND l.label IS NOT NULL THEN l.label WHEN t.row_idx % 2 = 0 THEN '' ELSE t.label END AS label FROM t LEFT JOIN (SELECT n_nationkey || '.1' AS note, n_name AS label FROM nation) l ON l.note = t.note", lookup="SELECT n_nationkey || '.1' AS note, n_name AS label FROM {nation}")
def label_recovery_join(t, lookup):
    blank = t.withColumn("label", F.when(F.col("row_idx") % 2 == 0, "").otherwise(F.col("label")))
    return merge.recover_labels(blank, lookup).select("table_id", "row_idx", "label")


@query(I.ROWS, f"SELECT table_id, row_idx, arg_min(raw, col_idx) AS label FROM t WHERE {ROWS_KIND} = 'TEXT' GROUP BY table_id, row_idx")
def first_text_label(t):
    text = t.filter(S.value_type("raw") == "TEXT")
    return text.groupBy("table_id", "row_idx").agg(F.min_by("raw", "col_idx").alias("label"))


# responses

SELECTION = "SELECT o_orderkey AS doc_id, CAST(o_custkey % 9 + 1 AS INT) AS n, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '1,3-5' WHEN 2 THEN '[2, 4, 2]' ELSE '7-3,99,1' END AS pages FROM {orders}"


@query(SELECTION, """SELECT doc_id, coalesce((SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FROM range(1, n + 1) r(p)
  WHERE pages IS NULL OR (pages = '1,3-5' AND p IN (1, 3, 4, 5)) OR (pages = '[2, 4, 2]' AND p IN (2, 4)) OR (pages = '7-3,99,1' AND p = 1)), '') AS selected FROM t""")
def page_selection(t):
    return t.select("doc_id", F.array_join(S.page_numbers("pages", "n"), ",").alias("selected"))


@query(I.RESPONSES, """SELECT table_id, CASE table_id % 6 WHEN 2 THEN 'no_closing,open_brace,open_bracket,few_rows,open_quote' WHEN 1 THEN 'no_closing,few_rows' WHEN 4 THEN 'no_closing,few_rows' WHEN 5 THEN 'no_closing,few_rows' ELSE 'few_rows' END AS reasons FROM t""")
def truncation_flags(t):
    return t.select("table_id", F.array_join(checks.truncation_reasons(F.col("text"), F.lit(1)), ",").alias("reasons"))


@query(I.RESPONSES, "SELECT table_id, CASE WHEN table_id % 6 IN (0, 3) THEN 4096 ELSE 6144 END::INTEGER AS budget FROM t")
def retry_budget(t):
    return t.select("table_id", checks.next_budget(F.lit(4096), checks.truncation_reasons(F.col("text"), F.lit(1)), F.lit(True)).alias("budget"))


@query(I.RESPONSES, """SELECT table_id, CASE table_id % 6 WHEN 2 THEN 'salvaged' WHEN 4 THEN 'failed' WHEN 5 THEN 'pipe' ELSE 'fast' END AS how,
  (CASE table_id % 6 WHEN 0 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN 2 ELSE 1 END)::INTEGER AS n_rows FROM t""")
def parse_responses(t):
    return parse.parse_responses(t).select("table_id", "how", F.coalesce(F.size("table.rows"), F.lit(0)).alias("n_rows"))


@query(I.RESPONSES, """SELECT table_id, 0 AS row_idx, 0 AS col_idx, 'Label' AS name, event_type AS raw FROM t WHERE table_id % 6 <> 4 UNION ALL
SELECT table_id, 0, 1, '2024', CAST(user_id AS VARCHAR) FROM t WHERE table_id % 6 <> 4 UNION ALL SELECT table_id, 1, 0, 'Label', CASE table_id % 6 WHEN 0 THEN 'x' ELSE '7' END FROM t WHERE table_id % 6 IN (0, 5) UNION ALL
SELECT table_id, 1, 1, '2024', '' FROM t WHERE table_id % 6 IN (0, 5)""")
def response_cells(t):
    return parse.to_cells(parse.parse_responses(t))


@query(I.RESPONSES, """SELECT table_id, 0 AS row_idx, 0 AS col_idx, 'Label' AS name, event_type AS raw FROM t WHERE table_id % 6 = 5 UNION ALL
SELECT table_id, 0, 1, '2024', CAST(user_id AS VARCHAR) FROM t WHERE table_id % 6 = 5 UNION ALL SELECT table_id, 1, 0, 'Label', '7' FROM t WHERE table_id % 6 = 5""")
def pipe_tables(t):
    return parse.pipe_cells(t)


@query(PAGE_ROWS, "SELECT table_id, 0 AS row_idx, (pos - 1)::INTEGER AS col_idx, CASE WHEN pos <= 3 THEN 'c' || pos ELSE '_extra_' || (pos - 4) END AS name, a AS raw FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) AS pos FROM t) p UNION ALL "
       "SELECT k.table_id, 0, c::INTEGER, 'c' || (c + 1), '' FROM (SELECT table_id, count(*) AS n FROM t GROUP BY table_id) k, range(0, 3) r(c) WHERE c >= k.n")
def list_rows(t):
    rows = t.groupBy("table_id").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "a"))), lambda x: x["a"])).alias("rows"))
    return parse.list_rows_to_cells(rows.withColumn("columns", F.array(F.lit("c1"), F.lit("c2"), F.lit("c3"))))


# pages

FOLD = "trim(regexp_replace(translate(lower({0}), 'éèêëàâùûîïôöç', 'eeeeaauuiiooc'), '\\s+', ' ', 'g'))"
BASE = f"""WITH b AS (SELECT doc_id, page_no, {FOLD.format('text')} AS t, {FOLD.format("substr(text, 1, greatest(length(text) // 5, 300)::INT)")} AS head,
  {FOLD.format("array_to_string(string_split(text, chr(10))[1:20], chr(10))")} AS lines, {FOLD.format("substr(text, 1, (length(text) // 2)::INT)")} AS half FROM t), """


def _page_sql(kind: str) -> str:
    hard = lambda c: f"(({_count_sql(c, P.HARD_NEGATIVES[kind])}) > 0 OR ({_count_sql(c, P.SOFT_NEGATIVES[kind]) or '0'}) >= 2)"
    bare = lambda c: f"(regexp_matches({c}, '\\bbilan\\b') AND NOT contains({c}, 'hors'))" if kind == "balance_sheet" else "false"
    no = f"({hard('head')} OR {hard('half')})"
    title = f"CASE WHEN {no} THEN 0 WHEN ({_count_sql('lines', P.PAGE_TITLES[kind])}) > 0 OR {bare('lines')} THEN 100 WHEN ({_count_sql('head', P.PAGE_TITLES[kind])}) > 0 THEN 85 WHEN {bare('head')} THEN 70 ELSE 0 END"
    return f"SELECT doc_id, page_no, '{kind}' AS kind, ({title})::INTEGER AS title_score, ({_count_sql('t', P.PAGE_WORDS[kind])})::INTEGER AS n_words, ({_count_sql('t', P.STRONG_WORDS[kind])})::INTEGER AS n_strong, {no} AS is_rejected FROM b"


EVIDENCE = BASE + "ev AS (" + " UNION ALL ".join(_page_sql(k) for k in P.PAGE_TITLES) + ")"
CANDS = EVIDENCE + ", cand AS (SELECT *, n_words >= 2 AS ok, title_score + CASE WHEN n_words >= 2 THEN 20 ELSE 0 END AS confidence FROM ev WHERE title_score > 0), anc AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY ok DESC, confidence DESC, page_no) = 1)"


@query(I.PAGES, EVIDENCE + " SELECT * FROM ev")
def page_title_score(t):
    return pages.evidence(t)


@query(I.PAGES, EVIDENCE + " SELECT kind, count(*) AS n FROM ev WHERE is_rejected GROUP BY kind")
def page_negative_filter(t):
    return pages.evidence(t).filter("is_rejected").groupBy("kind").agg(F.count("*").alias("n"))


@query(I.PAGES, CANDS + " SELECT doc_id, kind, page_no, confidence::INTEGER AS confidence FROM anc")
def anchor_topk(t):
    return pages.anchors(pages.candidates(pages.evidence(t))).select("doc_id", "kind", "page_no", "confidence")


@query(I.PAGES, CANDS + """ SELECT doc_id, kind, page_no FROM anc UNION ALL SELECT a.doc_id, a.kind, a.page_no + 1 FROM anc a JOIN ev e ON e.doc_id = a.doc_id AND e.kind = a.kind AND e.page_no = a.page_no + 1
WHERE e.n_words >= 2 AND NOT e.is_rejected AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.doc_id = e.doc_id AND o.page_no = e.page_no AND o.kind <> e.kind AND o.title_score > 80)""")
def anchor_expand(t):
    found = pages.evidence(t)
    return pages.expanded(pages.anchors(pages.candidates(found)), found)


@query(I.PAGES)
def page_detect(t):
    return pages.detect(t).select("doc_id", "kind", F.array_join("pages", ",").alias("pages"))


@query(I.PAGES)
def page_fuzzy_titles(t):
    return pages.fuzzy_titles(t)


@query(I.PAGES, r"""WITH l AS (SELECT doc_id, page_no, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM t)
SELECT doc_id, page_no, round(coalesce(length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0), 0), 6)::DOUBLE AS digit_ratio,
  round(coalesce(len(list_filter(ls, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) * 100 >= length(x) * 30)) / nullif(len(ls), 0), 0), 6)::DOUBLE AS line_ratio FROM l""")
def page_density(t):
    return pages.line_density(t)


@query(I.PAGES, r"""WITH l AS (SELECT doc_id, page_no, unnest(string_split(coalesce(text, ''), chr(10))) AS raw_line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM t),
s AS (SELECT doc_id, page_no, i, trim(raw_line) AS s, lower(strip_accents(trim(raw_line))) AS low FROM l),
f AS (SELECT *, CASE WHEN regexp_matches(low, 'bilan|resultat|engagement|flux|balance|income|cash flow') THEN 100 ELSE 0 END + CASE WHEN s = upper(s) THEN 50 ELSE 0 END
  + CASE WHEN regexp_matches(s, '[0-9]') THEN 0 ELSE 30 END - CASE WHEN regexp_matches(s, '[*#%$&|]') THEN 20 ELSE 0 END AS score FROM s WHERE length(s) >= 4 AND length(regexp_replace(s, '[^0-9]', '', 'g')) * 10 <= length(s) * 3),
b AS (SELECT doc_id, page_no, s FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score DESC, i) = 1)
SELECT t.doc_id, t.page_no, coalesce(b.s, 'UNKNOWN') AS title FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND b.page_no = t.page_no""")
def page_best_title(t):
    return pages.best_title(t)


@query(I.EVENTS, """WITH g AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour, event_id) > 5 THEN 1 ELSE 0 END AS far FROM t)
SELECT user_id, event_id, (sum(far) OVER (PARTITION BY user_id ORDER BY hour, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM g""")
def gap_clusters(t):
    return pages.gap_clusters(t, "user_id", "hour", ties=("event_id",)).select("user_id", "event_id", "cluster")


@query(I.EVENTS, """WITH h AS (SELECT DISTINCT user_id, hour FROM t), g AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour) > 5 THEN 1 ELSE 0 END AS far FROM h),
c AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY hour) AS cluster FROM g), s AS (SELECT user_id, cluster, count(*) AS n FROM c GROUP BY user_id, cluster QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, cluster) = 1)
SELECT user_id, hour FROM c JOIN s USING (user_id, cluster)""")
def largest_cluster(t):
    return pages.largest_cluster(t.select("user_id", "hour").distinct(), "user_id", "hour").select("user_id", "hour")
