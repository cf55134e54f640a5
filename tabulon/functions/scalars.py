"""Column expressions for cells and headers; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Null as empty, without white space at the edges (no-break spaces count as white space)."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), P.EDGES, "")


def value_type(c: Column | str) -> Column:
    """EMPTY, PERCENT, NOTE, NUMBER or TEXT, tested in that order."""
    v = clean(c)
    return F.when(v.isin(*P.BLANKS), "EMPTY").when(v.rlike(P.PERCENT), "PERCENT").when(v.rlike(P.NOTE), "NOTE").when(v.rlike(P.NUMBER), "NUMBER").otherwise("TEXT")


def _negative(v: Column) -> Column:
    return v.rlike(r"[(<]|^\s*-")


def _signed(v: Column, digits: Column) -> Column:
    number = digits.try_cast("double")
    return F.when(_negative(v), -F.abs(number)).otherwise(number)


def number(c: Column | str) -> Column:
    """The value of a NUMBER cell: parentheses, angles or a minus are negative, both grouping styles; else null.

    A comma before one or two last digits is a decimal comma where there is no dot.
    """
    v = clean(c)
    d = F.regexp_replace(v, "[^0-9,.]", "")
    grouped = r"^\d{1,3}(\.\d{3})+(,\d{1,2})?$"
    european = F.regexp_replace(F.regexp_replace(d, r"\.", ""), ",", ".")
    head, tail = F.regexp_extract(d, r"^(.*),(\d{1,2})$", 1), F.regexp_extract(d, r"^(.*),(\d{1,2})$", 2)
    comma = F.concat(F.regexp_replace(head, ",", ""), F.lit("."), tail)
    plain = F.regexp_replace(F.regexp_replace(d, ",", ""), r"\.+$", "")
    digits = F.when(d.rlike(grouped), european).when(d.rlike(r"^[^.]*,\d{1,2}$"), comma).otherwise(plain)
    return F.when(value_type(c) == "NUMBER", _signed(v, digits))


def percent(c: Column | str) -> Column:
    """The value of a PERCENT cell, else null."""
    v = clean(c)
    d = F.regexp_replace(F.regexp_replace(v, "[^0-9,.]", ""), ",", ".")
    return F.when(value_type(c) == "PERCENT", _signed(v, d))


def legacy_unsigned_number(c: Column | str) -> Column:
    """The grammar that reads every digit of a cell: a leading minus is dropped, only brackets negate."""
    v = clean(c)
    d = F.regexp_replace(v, "[^0-9,.]", "")
    d = F.when(d.rlike(r",\d{1,2}$") & ~d.contains("."), F.regexp_replace(d, r",(\d{1,2})$", r".$1")).otherwise(d)
    d = F.regexp_replace(d, ",", "")
    n = d.try_cast("double")
    return F.when(v.isin(*P.BLANKS), None).when(v.rlike(r"[(<]"), -F.abs(n)).otherwise(n)


def repair_ocr(c: Column | str) -> Column:
    """Letters l, I and O beside digits as 1 and 0, where the cell has a digit; spaces collapse."""
    v = clean(c)
    ones = F.regexp_replace(F.regexp_replace(v, r"(?<=\d)[lI]", "1"), r"[lI](?=\d)", "1")
    zeros = F.regexp_replace(F.regexp_replace(ones, r"(?<=\d)O", "0"), r"O(?=\d)", "0")
    return F.when(v.rlike(r"\d"), F.regexp_replace(zeros, r"(?U)\s+", " ")).otherwise(v)


def normalized(c: Column | str) -> Column:
    """The text of a typed cell: whole numbers without decimals, percents without the sign, else the cell."""
    n, p = number(c), percent(c)
    whole = F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))
    kind = value_type(c)
    return F.when(kind == "EMPTY", "").when(kind == "NUMBER", F.coalesce(whole, clean(c))).when(kind == "PERCENT", F.coalesce(p.cast("string"), clean(c))).otherwise(clean(c))


def malformed(c: Column | str, allow_groups: bool = True) -> Column:
    """Letters among digits, lone or unbalanced brackets, several dots and commas, or odd groups of digits.

    Well-formed groups of three digits are no fault unless ``allow_groups`` is false.
    """
    v = clean(c)
    groups = r"^\d+\s+\d+\s+\d+\s+\d+"
    odd = v.rlike(groups) & ~v.rlike(r"^\d{1,3}(\s\d{3})+$") if allow_groups else v.rlike(groups)
    letters = v.rlike(r"^\d+[a-zA-Z]+\d*$") | v.rlike(r"^[a-zA-Z]+\d+$")

    def count(marks: str) -> Column:
        return F.length(v) - F.length(F.translate(v, marks, ""))

    return (v != "") & (letters | odd | (count("([<") != count(")]>")) | ((count(".") > 1) & (count(",") > 1)))


def row_note(c: Column | str) -> Column:
    """The note test of the row-type rule: a bracketed number alone."""
    return clean(c).rlike(r"^\(\d+.?\d*\)$")


def compare_key(c: Column | str) -> Column:
    """What two cells are compared by: lower case, and only a-z, digits and %.,()/- ."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9%.,()/-]", "")


def format_number(c: Column | str) -> Column:
    """Display form: groups by space, two decimals unless whole, brackets for negatives."""
    n = _col(c)
    size = F.abs(n)
    text = F.when(n == F.floor(n), F.format_number(size, 0)).otherwise(F.format_number(size, 2))
    text = F.replace(text, F.lit(","), F.lit(" "))
    return F.when(n < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def format_percent(c: Column | str) -> Column:
    """Display form: one decimal and the sign, brackets for negatives."""
    n = _col(c)
    text = F.concat(F.format_number(F.abs(n), 1), F.lit("%"))
    return F.when(n < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def is_text(c: Column | str) -> Column:
    """A filled cell that is no number, percent or bracketed number once spaces go and commas are points."""
    v = clean(c)
    bare = F.replace(F.translate(F.replace(v, F.lit("("), F.lit("-")), ",", "."), F.lit(" "), F.lit(""))
    return (v != "") & ~F.regexp_replace(bare, r"[%)]", "").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def loose_note(c: Column | str) -> Column:
    """The wider note test: two numbers up to 50 beside each other count too."""
    return clean(c).rlike(P.LOOSE_NOTE)


def percent_like(c: Column | str) -> Column:
    return clean(c).contains("%")


def number_like(c: Column | str) -> Column:
    """Digits with at most one point or comma, spaces aside."""
    v = F.translate(F.replace(clean(c), F.lit(" "), F.lit("")), ",", ".")
    return v.rlike(r"^[-+]?\d*\.?\d+$")


# headers


def fold(c: Column | str) -> Column:
    """Lower case without the accents of French."""
    return F.translate(F.lower(clean(c)), P.ACCENTED, P.PLAIN)


def is_date_header(c: Column | str) -> Column:
    v = clean(c)
    return v.rlike(P.DATE_HEADER) | v.rlike(P.YEAR_HEADER)


def header_name(c: Column | str) -> Column:
    """The canonical name of a header, or the header itself; dates stay as they are."""
    key = F.regexp_replace(fold(c), r"\s+", " ")
    names = F.create_map(*(F.lit(x) for pair in P.HEADER_NAMES.items() for x in pair))
    return F.when(is_date_header(c), _col(c)).otherwise(F.coalesce(F.try_element_at(names, key), _col(c)))


def header_token(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"[_\-]", " "), r"\s+", " "))


def is_placeholder(c: Column | str) -> Column:
    """An empty or generic header, or a number that is no year from 2000 to 2099."""
    v = F.lower(clean(c))
    return (v == "") | v.rlike(r"^col\d+$") | v.rlike(r"^column[_\s]?\d+$") | (v.rlike(r"^\d+$") & ~v.rlike(r"^0*20\d{2}$")) | v.isin(*P.PLACEHOLDERS)


def date_format(c: Column | str) -> Column:
    v = clean(c)
    return F.when(v.rlike(P.SLASH_DATE), "slash").when(v.rlike(P.DOT_DATE), "dot").otherwise("none")


def header_role(c: Column | str) -> Column:
    """date, label, note, var_percent, var_amount, unresolved, or placeholder."""
    t = header_token(header_name(c))
    ratio = t.isin(*P.PERCENT_WORDS) | (t.contains("%") & (t.contains("var") | t.contains("en") | t.contains("taux")))
    amount = t.isin(*P.AMOUNT_WORDS) | (t.contains("variation") & (t.contains("montant") | t.contains("amount") | t.contains("ecart"))) | t.contains("en montant")
    return (
        F.when(is_placeholder(c), "placeholder").when(is_date_header(c), "date").when(t.isin(*P.LABEL_WORDS), "label")
        .when(t.isin(*P.NOTE_WORDS) | t.startswith("note"), "note").when(ratio, "var_percent").when(amount, "var_amount")
        .when(t.rlike(P.DATE_TOKEN), "date").otherwise("unresolved")
    )


def is_variation_header(c: Column | str) -> Column:
    return any_word(F.lower(clean(c)), ("variation", "montant", "%", "var", "ecart")) > 0


def is_change_header(c: Column | str) -> Column:
    """The wider test for headers of variations."""
    return any_word(F.lower(clean(c)), P.VARIATION_WORDS) > 0


def is_date_name(c: Column | str) -> Column:
    """A date in either order, a year, or a name that begins with a month."""
    v = F.lower(clean(c))
    return v.rlike(P.DATE_NAMES[0]) | v.rlike(P.DATE_NAMES[1]) | v.rlike(P.DATE_NAMES[2]) | v.rlike(P.DATE_NAMES[3])


def clean_title(c: Column | str) -> Column:
    """A title without bracketed parts and quotes, spaces collapsed; null is empty."""
    plain = F.regexp_replace(clean(c), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\s*\([^)]*\)\s*", " "), "[\"']", ""), r"\s+", " "))


def title_type(c: Column | str) -> Column:
    """balance_sheet, income_statement, off_balance or null by the words of a title."""
    up = F.upper(clean(c))
    return F.when(up.contains("BILAN") | up.contains("BALANCE"), "balance_sheet").when(up.contains("RESULTAT") | up.contains("INCOME"), "income_statement").when(up.contains("ENGAGEMENT"), "off_balance")


def token_budget(height: Column | str, width: Column | str) -> Column:
    """How many tokens a page of this size in pixels may take."""
    h = _col(height)
    area = h.cast("long") * _col(width).cast("long")
    return F.when((h > 1200) | (area > 1500000), 6144).when((h > 700) | (area > 800000), 4096).otherwise(2048)


def period(c: Column | str) -> Column:
    """The date of a header in day, month, year order; null for other headers."""
    v = clean(c)
    return F.coalesce(*(F.try_to_date(v, f) for f in ("d/M/yyyy", "d.M.yyyy", "d-M-yyyy")))


def header_year(c: Column | str) -> Column:
    return F.regexp_extract(clean(c), r"(20\d{2})", 1).try_cast("int")


def any_word(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in the text."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def merge_headers(headers: Column | str) -> Column:
    """An array of headers with a parent (Variation or En) joined to the amount and percent headers after it.

    A fold over the array: under an open parent, Montant and % become Variation Montant and Variation %; a
    parent without such a child stays; every other header takes its canonical name.
    """
    h = _col(headers)
    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("out"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("used"))

    def step(a: Column, c: Column) -> Column:
        low = F.lower(clean(c))
        flushed = F.when(a["parent"].isNotNull() & ~a["used"], F.array_append(a["out"], header_name(a["parent"]))).otherwise(a["out"])
        child = a["parent"].isNotNull() & low.isin("montant", "%", "en %", "en montant")
        name = F.when(low.isin("montant", "en montant"), "Variation Montant").otherwise("Variation %")
        parent = low.isin("variation", "en")
        out = F.when(child, F.array_append(a["out"], name)).when(parent, flushed).otherwise(F.array_append(flushed, header_name(c)))
        return F.struct(out.alias("out"), F.when(child, a["parent"]).when(parent, c).alias("parent"), child.alias("used"))

    def end(a: Column) -> Column:
        return F.when(a["parent"].isNotNull() & ~a["used"], F.array_append(a["out"], header_name(a["parent"]))).otherwise(a["out"])

    return F.aggregate(h, start, step, end)


def page_numbers(selection: Column | str, pages: Column | str) -> Column:
    """Pages of a selection such as ``1,3-5`` or ``[2, 4]``: in range, distinct, ascending; null selects all."""
    s, n = _col(selection), _col(pages).cast("int")
    parts = F.filter(F.split(F.regexp_replace(s, r"[\[\]\s\"]", ""), ","), lambda p: p.rlike(r"^\d{1,9}(-\d{1,9})?$"))
    first, last = (lambda p: F.split(p, "-")[0].cast("int")), (lambda p: F.element_at(F.split(p, "-"), -1).cast("int"))
    low, high = (lambda p: F.greatest(first(p), F.lit(1))), (lambda p: F.least(last(p), n))
    runs = F.transform(parts, lambda p: F.when(low(p) <= high(p), F.sequence(low(p), F.greatest(high(p), low(p)))).otherwise(F.expr("CAST(array() AS array<int>)")))
    return F.when(s.isNull(), F.sequence(F.lit(1), n)).otherwise(F.array_sort(F.array_distinct(F.flatten(runs))))
