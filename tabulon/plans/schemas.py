"""Named queries of schemas, label columns, sections, rewrites and small rules, with their SQL; registered in ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import scalars as S
from tabulon.operators import checks, columns, pages, schema, statements
from tabulon.plans import inputs as I
from tabulon.plans.catalog import ROLES_SQL, SLOTS, query

# tables whose label column goes by different names, or none

#: A table a nation, a row a customer; blanks, numbers among labels and repeated header lines.
GRID = """
SELECT table_id, row_idx, k AS col_idx,
  CASE table_id % 6
    WHEN 0 THEN CASE k WHEN 0 THEN 'Label' WHEN 1 THEN 'Note' WHEN 2 THEN '31/12/2024' WHEN 3 THEN '31/12/2023' ELSE 'Variation %' END
    WHEN 1 THEN CASE k WHEN 0 THEN 'Solde' WHEN 1 THEN ' Libellé' WHEN 2 THEN '2024' WHEN 3 THEN 'En Montant' ELSE 'ecart %' END
    WHEN 2 THEN CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN '31.12.2024' WHEN 3 THEN '31/12/2023' ELSE '30.06.2024' END
    WHEN 3 THEN CASE k WHEN 0 THEN 'Code' WHEN 1 THEN 'Genre' WHEN 2 THEN 'Nature' WHEN 3 THEN 'Montant' ELSE '%' END
    WHEN 4 THEN CASE k WHEN 0 THEN 'label' WHEN 1 THEN 'Label' WHEN 2 THEN 'Renvoi' WHEN 3 THEN '31-12-2024' ELSE 'col4' END
    ELSE CASE k WHEN 0 THEN 'Num' WHEN 1 THEN 'Type' WHEN 2 THEN '31.12.2023' WHEN 3 THEN '31/12/2024' ELSE '' END END AS name,
  CASE WHEN row_idx % 11 = 5 THEN CASE k WHEN 0 THEN 'Libellé' WHEN 1 THEN 'Note' WHEN 2 THEN '31/12/2024' WHEN 3 THEN ' En montant ' ELSE '' END
    WHEN row_idx % 13 = 7 THEN CASE k WHEN 2 THEN '%' ELSE '' END
    WHEN (row_idx + k * 2) % 7 = 0 THEN CASE WHEN k = 1 THEN '  ' ELSE '' END
    WHEN table_id % 6 = 0 AND k = 0 THEN CASE WHEN table_id % 12 = 0 AND row_idx % 5 > 1 THEN '' ELSE 'Poste ' || c END
    WHEN table_id % 6 = 1 AND k = 1 THEN ' Poste ' || c || ' '
    WHEN table_id % 6 = 2 AND k = 0 THEN CASE WHEN row_idx % 5 < 2 THEN 'Poste ' || c ELSE CAST(c AS VARCHAR(20)) END
    WHEN table_id % 6 = 3 AND k IN (1, 2) THEN CASE WHEN row_idx % 9 = k THEN '(12,5 %)' ELSE 'Nature ' || (c % 50) END
    WHEN table_id % 6 = 4 AND k < 2 THEN CASE WHEN k = 1 AND table_id % 12 = 4 AND row_idx % 3 > 0 THEN '' ELSE 'Compte ' || c END
    WHEN table_id % 6 = 5 AND k = 1 THEN 'data'
    ELSE CASE c % 6 WHEN 0 THEN '1 234,' || (c % 90) WHEN 1 THEN '(' || c || ')' WHEN 2 THEN '12.' || c WHEN 3 THEN c || ' %' WHEN 4 THEN '1.234.5' ELSE '-' || c END END AS raw
FROM (SELECT c_nationkey AS table_id, c, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c) - 1 AS INT) AS row_idx
      FROM (SELECT c_nationkey, c_custkey AS c FROM {customer} GROUP BY c_nationkey, c_custkey) u) x
CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(k)
"""
HEADS = f"SELECT table_id, col_idx, name FROM ({GRID}) g GROUP BY table_id, col_idx, name"

IS_TEXT = "(trim(raw) <> '' AND TRY_CAST(replace(replace(replace(replace(replace(trim(raw), ' ', ''), ',', '.'), '%', ''), '(', '-'), ')', '') AS DOUBLE) IS NULL)"
GOOD = "NOT (trim(name) = '' OR regexp_full_match(lower(trim(name)), '(col)?[0-9]+'))"
FULL = "regexp_full_match(trim(name), '[0-9]+[./-][0-9]+[./-][0-9]{4}')"
CHANGE = "regexp_matches(lower(name), 'var|montant|ecart|%')"


def _score(source: str) -> str:
    """SQL: the header score of a relation (table_id, name)."""
    return f"""SELECT table_id, (2 * nd + 2 * (amount AND ratio)::INT + note::INT + (nd + nv >= 2)::INT - 2 * (nd = 0)::INT - 2 * (nd = 0 AND nv > 0)::INT - 3 * (n < 3)::INT)::INT AS header_score FROM (
SELECT table_id, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND {FULL}) AS nd, count(*) FILTER (WHERE good AND NOT {FULL} AND {CHANGE}) AS nv,
  coalesce(bool_or(good AND (contains(lower(name), 'montant') OR (contains(lower(name), 'variation') AND NOT contains(name, '%')))), false) AS amount, coalesce(bool_or(good AND contains(name, '%')), false) AS ratio,
  coalesce(bool_or(good AND lower(trim(name)) IN ('note', 'notes', 'ref', 'reference', 'renvoi')), false) AS note
FROM (SELECT *, {GOOD} AS good FROM {source}) q GROUP BY table_id) z"""


@query(HEADS, _score("t"))
def header_score(t):
    return schema.header_scores(t)


CLEAN = f"""WITH k AS (SELECT table_id, col_idx, name, CASE WHEN regexp_full_match(trim(name), '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN 'slash' WHEN regexp_full_match(trim(name), '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') THEN 'dot' ELSE 'none' END AS fmt FROM t WHERE {GOOD}),
f AS (SELECT table_id, fmt, row_number() OVER (PARTITION BY table_id ORDER BY count(*) DESC, min(col_idx)) AS nth, count(*) OVER (PARTITION BY table_id) AS kinds FROM k WHERE fmt <> 'none' GROUP BY table_id, fmt),
g AS (SELECT k.table_id, k.name, row_number() OVER (PARTITION BY k.table_id ORDER BY CASE WHEN kinds = 2 AND k.fmt <> 'none' THEN 1 ELSE 0 END, col_idx) AS pos
  FROM k LEFT JOIN (SELECT * FROM f WHERE nth = 1) f ON f.table_id = k.table_id WHERE k.fmt = 'none' OR k.fmt = f.fmt),
l AS (SELECT table_id, list(name ORDER BY pos) AS ns FROM g GROUP BY table_id), l2 AS (SELECT table_id, CASE WHEN list_contains(ns, 'Label') THEN ns ELSE list_prepend('Label', ns) END AS ns FROM l),
l3 AS (SELECT table_id, CASE WHEN list_contains(ns, 'Note') THEN ns ELSE list_concat(list_append(ns[1:1], 'Note'), ns[2:]) END AS ns FROM l2), sc AS ({_score("g")})"""


@query(HEADS, CLEAN + " SELECT l3.table_id, array_to_string(ns, '|') AS names, header_score, coalesce(f.fmt, 'none') AS date_format FROM l3 JOIN sc USING (table_id) LEFT JOIN (SELECT * FROM f WHERE nth = 1) f USING (table_id)")
def clean_schema(t):
    return schema.clean_schema(t).withColumn("names", F.array_join("names", "|"))


#: The cells under names that differ in case and in the form of dates.
RENAMED = f"SELECT table_id, row_idx, col_idx, CASE row_idx % 3 WHEN 1 THEN upper(replace(name, '/', '.')) ELSE name END AS name, raw FROM ({GRID}) g"


@query(RENAMED, CLEAN.replace("FROM t WHERE", "FROM heads WHERE") + """, s AS (SELECT table_id, unnest(ns) AS name, generate_subscripts(ns, 1) - 1 AS pos FROM l3), r AS (SELECT DISTINCT table_id, row_idx FROM t)
SELECT r.table_id, r.row_idx, s.pos::INT AS col_idx, s.name, coalesce(arg_min(t.raw, CASE WHEN t.name = s.name THEN 0 ELSE 100 END + t.col_idx), '') AS raw
FROM r JOIN s ON s.table_id = r.table_id LEFT JOIN t ON t.table_id = r.table_id AND t.row_idx = r.row_idx AND replace(lower(trim(t.name)), '.', '/') = replace(lower(trim(s.name)), '.', '/') GROUP BY ALL""", heads=HEADS)
def project_rows(t, heads):
    return schema.project_rows(t, schema.clean_schema(heads))


LABEL_COLUMN = f"""s AS (SELECT table_id, col_idx, count(*) FILTER (WHERE trim(raw) <> '') AS nf, count(*) FILTER (WHERE {IS_TEXT}) AS nt FROM t GROUP BY table_id, col_idx),
m AS (SELECT h.*, CASE WHEN lower(name) NOT IN ('type', 'note', 'notes', '') AND nf > 0 THEN nt::DOUBLE / nf END AS share FROM heads h LEFT JOIN s USING (table_id, col_idx)),
p AS (SELECT *, CASE WHEN lower(name) IN ('label', 'labels') THEN 1 WHEN regexp_full_match(lower(trim(name)), 'libell[eé]( poste)?|poste|rubriques|items?') THEN 2 WHEN share > 0.6 AND col_idx = 0 THEN 3 WHEN share > 0.6 THEN 4 WHEN share > 0.3 AND col_idx = 0 THEN 5 END AS step FROM m),
lc AS (SELECT table_id, CASE WHEN step IS NOT NULL THEN col_idx END AS label_col, CASE WHEN step IS NOT NULL THEN name END AS name, CASE step WHEN 1 THEN 'name' WHEN 2 THEN 'synonym' WHEN 3 THEN 'text' WHEN 4 THEN 'text' WHEN 5 THEN 'first' END AS how
  FROM p QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY step NULLS LAST, CASE WHEN step = 4 THEN -share ELSE 0 END, col_idx) = 1)"""


@query(GRID, "WITH " + LABEL_COLUMN + " SELECT * FROM lc", heads=HEADS)
def label_columns(t, heads):
    return schema.label_columns(heads, t)


@query(GRID, "WITH " + LABEL_COLUMN + f""", r AS (
SELECT t.table_id, t.row_idx, coalesce(max(raw) FILTER (WHERE t.name = 'Label'), '') AS g, coalesce(max(raw) FILTER (WHERE col_idx = label_col AND t.name <> 'Label'), '') AS m,
  arg_min(trim(raw), col_idx) FILTER (WHERE t.name <> 'Label' AND {IS_TEXT} AND NOT (t.name = '' OR regexp_matches(lower(t.name), 'note|variation|%|montant') OR regexp_full_match(trim(t.name), '[0-9]{{2}}[./-][0-9]{{2}}[./-][0-9]{{4}}'))) AS x
  FROM t JOIN lc ON lc.table_id = t.table_id GROUP BY t.table_id, t.row_idx), w AS (SELECT *, avg((g <> '')::INT) OVER (PARTITION BY table_id) > 0.5 AS works FROM r)
SELECT table_id, row_idx, CASE WHEN trim(g) <> '' THEN g WHEN g = '' AND NOT works AND trim(m) <> '' THEN m ELSE coalesce(x, '') END AS label,
  CASE WHEN trim(g) <> '' THEN 'given' WHEN g = '' AND NOT works AND trim(m) <> '' THEN 'mapped' WHEN x IS NOT NULL THEN 'recovered' ELSE 'none' END AS how FROM w""", heads=HEADS)
def ensure_labels(t, heads):
    return schema.ensure_labels(heads, t)


@query(GRID, """SELECT table_id, row_idx, sum(CASE WHEN x IN ('label', 'libellé', 'note', 'variation', 'montant', '%') THEN 2 WHEN regexp_full_match(x, '[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}') THEN 2 WHEN x IN ('en %', 'en montant', 'variation %', 'variation montant') THEN 3 ELSE 0 END)::INT AS header_score
FROM (SELECT table_id, row_idx, lower(trim(raw)) AS x FROM t WHERE row_idx > 1) q GROUP BY table_id, row_idx HAVING header_score >= 3""")
def embedded_headers(t):
    return schema.embedded_headers(t)


# slots of schemas


def _slots_sql(name: str, shift: str) -> str:
    one = ", ".join(f"arg_min(name, col_idx) FILTER (WHERE role = '{r}') AS {r}" for r in ("label", "note", "var_amount", "var_percent"))
    every = ", ".join(f"coalesce(list(name ORDER BY col_idx) FILTER (WHERE role = '{r}'), []) AS {c}" for r, c in (("date", "dates"), ("unresolved", "unresolved")))
    return f"{name} AS (SELECT {shift} AS table_id, {one}, {every} FROM roles GROUP BY table_id)"


SHOWN = ("label", "note", "var_amount", "var_percent")
KNOWN = "list_filter(list_concat([label, note], dates, [var_amount, var_percent]), lambda x: x IS NOT NULL)"


@query(I.HEADERS, f"""{ROLES_SQL}, {_slots_sql("a", "table_id")}, {_slots_sql("b0", "(table_id + 1) % 30")}, b AS (SELECT *, {KNOWN} AS known FROM b0),
m AS (SELECT coalesce(a.table_id, b.table_id) AS table_id, {", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in SHOWN)}, list_concat(coalesce(a.dates, []), coalesce(b.dates, [])) AS ds,
  list_filter(coalesce(a.unresolved, []), lambda x: NOT list_contains(coalesce(b.known, []), x)) AS left_over FROM a FULL JOIN b ON a.table_id = b.table_id),
n AS (SELECT *, list_filter(ds, lambda x, i: list_position(ds, x) = i)[1:4] AS dates FROM m),
c AS (SELECT *, 0.3 * (label IS NOT NULL)::INT + 0.1 * (note IS NOT NULL)::INT + least(0.2 * len(dates), 0.4) + 0.1 * (var_amount IS NOT NULL)::INT + 0.1 * (var_percent IS NOT NULL)::INT - 0.03 * len(list_distinct(left_over)) AS v FROM n)
SELECT table_id, label, note, var_amount, var_percent, array_to_string(dates, '|') AS dates, array_to_string(left_over, '|') AS unresolved,
  round(greatest(0, least(1, CASE WHEN (len(dates) > 0 OR var_amount IS NOT NULL) AND v < 0.3 THEN 0.3 ELSE v END))::DOUBLE, 6) AS confidence FROM c""")
def merge_schemas(t):
    mine = schema.slots(columns.header_roles(t))
    other = mine.select(((F.col("table_id") + 1) % 30).cast("int").alias("table_id"), *mine.columns[1:])
    out = schema.merge_schemas(mine, other)
    return out.withColumn("dates", F.array_join("dates", "|")).withColumn("unresolved", F.array_join("unresolved", "|"))


@query(I.HEADERS, f"""{ROLES_SQL}, {_slots_sql("a", "table_id")}, b AS (SELECT *, len({KNOWN}) AS n FROM a)
SELECT table_id, n::INT AS n_columns, (len(dates) > 0 OR (var_amount IS NOT NULL AND var_percent IS NOT NULL)) AND n >= 3 AS is_valid, n > 0 AS has_minimum,
  array_to_string(list_filter([CASE WHEN len(dates) = 0 THEN 'no_dates' END, CASE WHEN var_amount IS NULL AND var_percent IS NULL AND len(dates) < 2 THEN 'few_periods' END, CASE WHEN n < 3 THEN 'few_columns' END], lambda x: x IS NOT NULL), ',') AS issues FROM b""")
def schema_checks(t):
    return schema.schema_checks(schema.slots(columns.header_roles(t))).withColumn("issues", F.array_join("issues", ","))


@query(HEADS, r"""SELECT table_id, col_idx, regexp_matches(lower(name), 'variation|montant|%|var|ecart') AS is_variation, regexp_matches(lower(name), 'var|[eé]cart|mouvement|change|delta|diff|evolution') AS is_change,
  regexp_full_match(trim(name), '[0-9]{1,2}[./-][0-9]{1,2}[./-]([0-9]{2}|[0-9]{3}|[0-9]{4})|[0-9]{4}') OR regexp_matches(lower(trim(name)), '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|février|avril|mai|juin|juillet|août|décembre)') AS is_date FROM t""")
def header_tests(t):
    return t.select("table_id", "col_idx", S.is_variation_header("name").alias("is_variation"), S.is_change_header("name").alias("is_change"), S.is_date_name("name").alias("is_date"))


@query(GRID, rf"""SELECT table_id, row_idx, col_idx, {IS_TEXT} AS is_text, contains(raw, '%') AS is_percent, coalesce(regexp_full_match(replace(replace(trim(raw), ' ', ''), ',', '.'), '[-+]?([0-9]+|[0-9]*\.[0-9]+)'), false) AS is_number,
  regexp_full_match(trim(raw), '\([1-9]\)|[0-9]{{1,2}}\.[0-9]{{1,2}}') AS is_note FROM t""")
def cell_tests(t):
    return t.select("table_id", "row_idx", "col_idx", S.is_text("raw").alias("is_text"), S.percent_like("raw").alias("is_percent"), S.number_like("raw").alias("is_number"), S.loose_note("raw").alias("is_note"))


TITLES = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '  Bilan  arrêté (en milliers) au "' || lang || '"' WHEN 1 THEN 'Compte de resultat (net) l''exercice' WHEN 2 THEN 'Income (a) (b) ' || source WHEN 3 THEN 'Engagements' WHEN 4 THEN '' WHEN 5 THEN 'Balance sheet' || chr(10) || lang ELSE 'résultat' END AS text FROM {documents}"""


@query(TITLES, r"""SELECT doc_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(trim(coalesce(text, '')), '\s+', ' ', 'g'), ' ?\([^)]*\) ?', ' ', 'g'), '"', ''), '''', ''), ' +', ' ', 'g')) AS title,
  CASE WHEN regexp_matches(text, '(?i)bilan|balance') THEN 'balance_sheet' WHEN regexp_matches(text, '(?i)resultat|income') THEN 'income_statement' WHEN regexp_matches(text, '(?i)engagement') THEN 'off_balance' END AS title_type FROM t""")
def titles(t):
    return t.select("doc_id", S.clean_title("text").alias("title"), S.title_type("text").alias("title_type"))


@query("SELECT event_id, CAST(400 + event_id % 1201 AS INT) AS height, CAST(300 + (event_id * 7) % 1501 AS INT) AS width FROM {events}",
       "SELECT event_id, CASE WHEN height > 1200 OR height * width > 1500000 THEN 6144 WHEN height > 700 OR height * width > 800000 THEN 4096 ELSE 2048 END::INT AS budget FROM t")
def token_budgets(t):
    return t.select("event_id", S.token_budget("height", "width").alias("budget"))


KINDS = "(VALUES ('realignment'), ('warning'), ('validation'), ('shift'), ('recomputation'), ('cashflow'), ('total_fix'), ('other')) AS k(kind)"


@query(f"SELECT c_custkey, kind, CAST(c_custkey % 101 AS DOUBLE) / 100 AS confidence FROM {{customer}} CROSS JOIN {KINDS}",
       """SELECT c_custkey, kind, confidence >= 0.7 AND kind IN ('realignment', 'warning', 'validation') AS usual,
  confidence >= 0.7 AND (kind IN ('realignment', 'warning', 'validation') OR (confidence >= 0.85 AND kind <> 'other')) AS aggressive FROM t""")  # fmt: skip
def correction_kinds(t):
    allowed = lambda a: checks.correction_allowed(F.col("confidence"), F.col("kind"), a)
    return t.select("c_custkey", "kind", allowed(False).alias("usual"), allowed(True).alias("aggressive"))


@query(I.PAGES, r"""WITH l AS (SELECT doc_id, page_no, coalesce(text, '') AS x, list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: trim(y) <> '') AS ls FROM t),
s AS (SELECT *, 0.45::DOUBLE * least(1, length(regexp_replace(x, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(x), 1) / 0.22::DOUBLE) + 0.2::DOUBLE * least(1, len(list_filter(ls, lambda y: length(regexp_replace(y, '[^0-9]', '', 'g')) > 3))::DOUBLE / greatest(len(ls), 1) / 0.35::DOUBLE) AS v FROM l)
SELECT doc_id, page_no, round(v, 3) AS table_score, v >= 0.02 AS is_table FROM s""")
def page_table_score(t):
    return pages.table_score(t)


# sections, totals and rewrites

#: Statements with subtotals, totals without data and lines after the last total.
PARTS = f"""SELECT table_id, row_idx, CASE WHEN row_idx % 13 = 6 THEN 'total' WHEN table_id % 4 = 1 AND row_type = 'total' THEN 'data' WHEN table_id % 4 = 2 AND row_idx % 9 = 4 THEN 'section' ELSE row_type END AS row_type,
  CASE WHEN row_idx % 13 = 6 THEN 'Sous-Total ' || section WHEN table_id % 4 = 2 AND row_idx % 9 = 4 AND table_id % 8 = 2 THEN '' ELSE label END AS label FROM ({I.STATEMENT}) z"""


@query(PARTS, """WITH e AS (SELECT *, row_type = 'section' AS opens, row_type <> 'section' AND (row_type = 'total' OR contains(lower(label), 'total')) AS total FROM t),
b AS (SELECT table_id, row_idx, opens, total, label, lag(row_idx) OVER w AS before, lag(opens) OVER w AS after_section FROM e WHERE opens OR total WINDOW w AS (PARTITION BY table_id ORDER BY row_idx)
  UNION ALL SELECT table_id, max(row_idx) + 1, NULL, false, '', max(row_idx) FILTER (WHERE opens OR total), arg_max(opens, row_idx) FILTER (WHERE opens OR total) FROM e GROUP BY table_id),
c AS (SELECT b.table_id, coalesce(CASE WHEN after_section THEN before ELSE before + 1 END, 0) AS start_row, CASE WHEN b.total THEN b.row_idx + 1 ELSE b.row_idx END AS end_row, b.opens, b.total, b.label,
  coalesce((SELECT arg_max(s.label, s.row_idx) FROM e s WHERE s.table_id = b.table_id AND s.opens AND s.row_idx < b.row_idx), '') AS section_name, CASE WHEN b.total THEN b.row_idx END AS total_row,
  (SELECT count(*) FROM e d WHERE d.table_id = b.table_id AND d.row_type = 'data' AND NOT d.total AND d.row_idx > coalesce(before, -1) AND d.row_idx < b.row_idx) AS n_data FROM b)
SELECT table_id, start_row::INT AS start_row, end_row::INT AS end_row, section_name, total_row, n_data, coalesce(total AND regexp_matches(upper(label), 'SOUS|SUB'), false) AS is_subtotal
FROM c WHERE total OR n_data > 0 OR (coalesce(opens, false) AND section_name <> '')""")
def statement_sections(t):
    return statements.sections(t)


#: What kind of statement each table is, and how sure that is.
KINDS_OF = "SELECT n_nationkey AS table_id, CASE n_nationkey % 4 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'cash_flow' END AS table_type, CASE WHEN n_nationkey % 3 = 0 THEN 0.65 ELSE 0.7 END AS confidence FROM {nation}"


@query(I.STATEMENT, """WITH d AS (SELECT table_id, section, CAST(sum(CASE WHEN label LIKE 'Moins%' THEN -abs(cur) ELSE cur END) AS BIGINT) AS c, CAST(sum(CASE WHEN label LIKE 'Moins%' THEN -abs(prev) ELSE prev END) AS BIGINT) AS p FROM t WHERE row_type = 'data' GROUP BY table_id, section),
x AS (SELECT t.table_id, t.row_idx, table_type, unnest(['cur', 'prev']) AS "column", unnest([t.cur, t.prev]) AS old_value, unnest([d.c, d.p]) AS new_value FROM t JOIN d USING (table_id, section) JOIN kinds k ON k.table_id = t.table_id WHERE row_type = 'total' AND k.confidence >= 0.7 AND table_type IS NOT NULL)
SELECT *, CASE WHEN old_value IS NULL THEN 'total_computed' ELSE 'total_corrected' END AS code FROM x WHERE new_value IS NOT NULL AND (old_value IS NULL OR (abs(new_value - old_value) > 2 AND old_value <> 0 AND abs(new_value - old_value) * 2 < abs(old_value)))""", kinds=KINDS_OF)
def recomputed_totals(t, kinds):
    return statements.recomputed_totals(t, kinds)


#: Notes that are amounts in some tables, with and without amounts beside them.
NOTED = f"""SELECT table_id, row_idx, CASE WHEN row_idx % 6 = 0 THEN 'section' ELSE 'data' END AS row_type, slot,
  CASE WHEN slot = 0 THEN CASE WHEN table_id % 5 = 0 THEN '' WHEN row_idx % 4 = 1 THEN '—' WHEN table_id % 5 < 3 OR (table_id % 5 = 3 AND row_idx % 2 = 0) THEN CAST(row_idx * CASE WHEN table_id % 2 = 0 THEN 1500 ELSE 90 END AS VARCHAR(20)) ELSE '4.' || (row_idx % 9) END
    WHEN table_id % 3 = 0 THEN value WHEN table_id % 3 = 1 THEN '' ELSE CAST(row_idx AS VARCHAR(20)) END AS value FROM ({SLOTS}) z"""
DATED = "SELECT o_orderkey AS table_id FROM {orders} WHERE o_orderkey % 7 = 0 GROUP BY o_orderkey"
NOTE_NUMBER = "CASE WHEN regexp_full_match(value, '[0-9]+') THEN value::DOUBLE END"


@query(NOTED, f"""SELECT table_id, count(*) AS n_rows, count(*) FILTER (WHERE {NOTE_NUMBER} > 1000) AS n_large, count(*) FILTER (WHERE {NOTE_NUMBER} > 1000) * 10 > count(*) * 3 AS has_misplaced FROM t WHERE slot = 0 AND row_type = 'data' GROUP BY table_id""")
def note_amounts(t):
    return statements.note_amounts(t)


@query(NOTED, f"""WITH a AS (SELECT table_id, count(*) FILTER (WHERE slot = 0 AND value NOT IN ('', '—')) AS n, count({NOTE_NUMBER}) FILTER (WHERE slot = 0) AS m, median({NOTE_NUMBER}) FILTER (WHERE slot = 0) AS med, coalesce(bool_or(slot > 0 AND {NOTE_NUMBER} > 100), false) AS o FROM t GROUP BY table_id)
SELECT table_id, reason = 'recovered' AS recovered, reason FROM (SELECT a.table_id, CASE WHEN d.table_id IS NOT NULL THEN 'dates' WHEN n = 0 THEN 'no_notes' WHEN m * 10 < n * 7 THEN 'few_numbers' WHEN med < 1000 THEN 'small_numbers' WHEN o THEN 'other_numbers' ELSE 'recovered' END AS reason
FROM a LEFT JOIN (SELECT DISTINCT table_id FROM dated) d ON d.table_id = a.table_id) q""", dated=DATED)
def amount_recovery(t, dated):
    return statements.amount_recovery(t, dated)


#: The same slots with sections, small values in the last slot, blanks and tables of small numbers.
TYPED = f"""SELECT table_id, row_idx, CASE WHEN row_idx % 7 = 5 THEN 'section' ELSE 'data' END AS row_type, slot,
  CASE WHEN slot = 4 AND row_idx % 5 = 1 THEN '12' WHEN slot = 2 AND row_idx % 6 = 2 THEN '' WHEN slot > 0 AND table_id % 16 = 0 AND length(value) > 3 THEN substring(value, 1, 4) ELSE value END AS value FROM ({SLOTS}) z"""
NUMS = f"WITH c AS (SELECT *, {NOTE_NUMBER} AS num FROM t)"


@query(TYPED, NUMS + """, m AS (SELECT table_id, median(num) FILTER (WHERE slot > 0 AND num > 100) >= 10000 AS wide FROM c GROUP BY table_id),
r AS (SELECT table_id, row_idx, least(50, sum(num) FILTER (WHERE slot > 0) * 0.01) AS lim, max(value) FILTER (WHERE slot = 0) = '' AS free FROM c GROUP BY table_id, row_idx),
o AS (SELECT c.table_id, c.row_idx, c.slot, c.num, median(x.num) AS others FROM c JOIN c x ON x.table_id = c.table_id AND x.row_idx = c.row_idx AND x.slot > 0 AND x.num <> c.num WHERE c.slot > 0 AND c.row_type <> 'section' GROUP BY ALL),
h AS (SELECT o.table_id, o.row_idx, min(o.slot) AS hit FROM o JOIN r ON r.table_id = o.table_id AND r.row_idx = o.row_idx JOIN m ON m.table_id = o.table_id JOIN c n ON n.table_id = o.table_id AND n.row_idx = o.row_idx AND n.slot = o.slot + 1
  WHERE wide AND free AND o.num < lim AND others >= 1000 AND n.num > lim GROUP BY o.table_id, o.row_idx)
SELECT c.table_id, c.row_idx, c.row_type, c.slot, CASE WHEN hit IS NULL OR (c.slot > 0 AND c.slot < hit) THEN c.value WHEN c.slot = 0 THEN max(CASE WHEN c.slot = hit THEN c.value END) OVER p ELSE coalesce(lead(c.value) OVER q, '') END AS value, hit IS NOT NULL AS was_shifted
FROM c LEFT JOIN h ON h.table_id = c.table_id AND h.row_idx = c.row_idx WINDOW p AS (PARTITION BY c.table_id, c.row_idx), q AS (PARTITION BY c.table_id, c.row_idx ORDER BY c.slot)""")
def safe_shift(t):
    return statements.safe_shift(t)


@query(TYPED, NUMS + """, s AS (SELECT table_id, slot, least(0.9, round(count(num)::DOUBLE / count(*) FILTER (WHERE value <> ''), 6)) AS confidence FROM c WHERE slot > 0 GROUP BY table_id, slot HAVING median(num) >= 10000 AND count(num)::DOUBLE / count(*) FILTER (WHERE value <> '') >= 0.7)
SELECT c.table_id, c.row_idx, c.slot, c.value, s.confidence FROM c JOIN s ON s.table_id = c.table_id AND s.slot = c.slot JOIN t n ON n.table_id = c.table_id AND n.row_idx = c.row_idx AND n.slot = 0 AND n.value = ''
WHERE c.value LIKE '%.%' AND c.row_type = 'data' QUALIFY row_number() OVER (PARTITION BY c.table_id, c.row_idx ORDER BY c.slot) = 1""")
def realigned_notes(t):
    return statements.realigned_notes(t)
