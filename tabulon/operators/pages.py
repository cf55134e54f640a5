"""Page classification: negative filters, titles, structure, anchors and clusters.

Relation: page (doc_id, page_no, text).  One projection folds the text once and derives the evidence of all three
statement types; the rest are windows by document over narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import patterns as P
from tabulon.functions import scalars as S

TYPES = tuple(P.PAGE_TITLES)
FUZZY, GAP = 80, 5
#: No run of words longer than this has a ratio of FUZZY to any title.
LONGEST_RUN = max(len(t) for titles in P.PAGE_TITLES.values() for t in titles) * (200 - FUZZY) // FUZZY
RUNS_AT_ONCE = 50000


def folded(text: Column) -> Column:
    """Lower case, without accents, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), P.ACCENTED, P.PLAIN), r"(?U)\s+", " "))


def header_part(text: Column) -> Column:
    """The first fifth of a page, at least 300 characters."""
    return F.substring(text, F.lit(1), F.greatest(F.floor(F.length(text) / 5), F.lit(300)).cast("int"))


def first_lines(text: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def rejected(text: Column, kind: str) -> Column:
    """A hard phrase, or two soft ones."""
    return (S.any_word(text, P.HARD_NEGATIVES[kind]) > 0) | (S.any_word(text, P.SOFT_NEGATIVES[kind]) >= 2)


def title_score(head: Column, lines: Column, half: Column, kind: str) -> Column:
    """100 for a title in the first lines, 85 in the header, 70 for a bare mention of the balance sheet, else 0."""
    titles = P.PAGE_TITLES[kind]
    bare = lambda t: t.rlike(r"\bbilan\b") & ~t.contains("hors") if kind == "balance_sheet" else F.lit(False)
    found = F.when(S.any_word(lines, titles) > 0, 100).when(bare(lines), 100).when(S.any_word(head, titles) > 0, 85).when(bare(head), 70).otherwise(0)
    return F.when(rejected(head, kind) | rejected(half, kind), 0).otherwise(found)


def evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, kind, title_score, n_words, n_strong, is_rejected): a row for each page and type."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = pages.select(
        "doc_id", "page_no", folded(text).alias("t"), folded(header_part(text)).alias("head"), folded(first_lines(text)).alias("lines"),
        folded(F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).alias("half"),
    )
    head, lines, half, t = (F.col(c) for c in ("head", "lines", "half", "t"))
    kinds = F.array(
        *(
            F.struct(
                F.lit(k).alias("kind"), title_score(head, lines, half, k).alias("title_score"), S.any_word(t, P.PAGE_WORDS[k]).alias("n_words"),
                S.any_word(t, P.STRONG_WORDS[k]).alias("n_strong"), (rejected(head, k) | rejected(half, k)).alias("is_rejected"),
            )
            for k in TYPES
        )
    )
    return base.select("doc_id", "page_no", F.explode(kinds).alias("e")).select("doc_id", "page_no", "e.*")


def candidates(found: DataFrame, fallback: bool = False) -> DataFrame:
    """evidence rows that may hold a statement, with confidence: the title's score and 20 for structure; with
    ``fallback`` two strong words and structure stand for a title of 60."""
    valid = F.col("n_words") >= 2
    strong = (F.col("n_strong") >= 2) & valid & ~F.col("is_rejected")
    score = F.when(F.col("title_score") > 0, F.col("title_score")).when(F.lit(fallback) & strong, 60).otherwise(0)
    out = found.withColumn("score", score).withColumn("structure_valid", valid).filter("score > 0")
    return out.withColumn("confidence", F.col("score") + F.when(F.col("structure_valid"), 20).otherwise(0))


def anchors(cands: DataFrame, prefer_early: bool = False) -> DataFrame:
    """The best candidate of each document and type: valid structure first, then confidence, then the first page."""
    early = (F.col("page_no") <= 5).cast("int") if prefer_early else F.lit(0)
    w = Window.partitionBy("doc_id", "kind").orderBy(F.col("structure_valid").desc(), early.desc(), F.col("confidence").desc(), "page_no")
    return cands.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def expanded(anchor: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, kind, page_no): anchors, and the next page where its structure fits, nothing rejects it and it is no
    title page of another type."""
    w = Window.partitionBy("doc_id", "page_no")
    n_titles = F.count_if(F.col("title_score") > 80).over(w) - F.when(F.col("title_score") > 80, 1).otherwise(0)
    fit = found.withColumn("others", n_titles).filter("n_words >= 2 AND NOT is_rejected AND others = 0").select("doc_id", "kind", "page_no")
    after = anchor.select("doc_id", "kind", (F.col("page_no") + 1).alias("page_no")).join(fit, ["doc_id", "kind", "page_no"], "left_semi")
    return anchor.select("doc_id", "kind", "page_no").unionByName(after)


def gap_clusters(points: DataFrame, key: str = "doc_id", at: str = "page_no", gap: int = GAP, ties: tuple[str, ...] = ()) -> DataFrame:
    """points with cluster: a new one begins where the step to the next point is above the gap; ``ties`` order points at one place."""
    w = Window.partitionBy(key).orderBy(at, *ties)
    far = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False)).cast("int")
    return points.withColumn("__far", far).withColumn("cluster", F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__far")


def largest_cluster(points: DataFrame, key: str = "doc_id", at: str = "page_no", gap: int = GAP) -> DataFrame:
    """The points of the largest cluster of each key; the first on ties."""
    marked = gap_clusters(points, key, at, gap)
    size = F.count("*").over(Window.partitionBy(key, "cluster"))
    best = F.first("cluster").over(Window.partitionBy(key).orderBy(F.col("__size").desc(), "cluster"))
    return marked.withColumn("__size", size).withColumn("__best", best).filter("cluster = __best").drop("__size", "__best")


def detect(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, pages): the statements of each document.  Balance sheet and income statement that no title
    gives are looked for by structure on the first ten pages; anchors outside the main cluster go."""
    found = evidence(pages)
    titled = anchors(candidates(found))
    again = candidates(found.filter("page_no <= 10 AND kind <> 'cashflow'"), fallback=True)
    missing = again.join(titled.select("doc_id", "kind"), ["doc_id", "kind"], "left_anti")
    chosen = largest_cluster(titled.unionByName(anchors(missing, prefer_early=True)))
    return expanded(chosen, found).groupBy("doc_id", "kind").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def fuzzy_titles(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, kind, ratio): the best ratio of a title to one to five words of the first lines.

    The ratio is 100 times twice the longest common subsequence over both lengths, so no built-in expression
    has it; batches go through Arrow.  The distinct runs of words of many pages are compared with a title at once, a
    bit of a 64-bit word for each of its characters.  Null and empty pages have no rows; pages that repeat have theirs each.
    """
    rows = pages.select("doc_id", "page_no", folded(first_lines(F.coalesce(F.col("text"), F.lit("")))).alias("lines"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            best = {kind: np.zeros(len(part)) for kind in P.PAGE_TITLES}
            owners, places, number = [], [], {}
            for i, lines in enumerate(part["lines"]):
                for c in word_runs(lines):
                    owners.append(i)
                    places.append(number.setdefault(c, len(number)))
                    if len(owners) >= RUNS_AT_ONCE:
                        _meet(best, owners, places, number)
            _meet(best, owners, places, number)
            keys = part[["doc_id", "page_no"]]
            yield pd.concat([keys[r >= FUZZY].assign(kind=kind, ratio=r[r >= FUZZY].round(4)) for kind, r in best.items()])

    return rows.mapInPandas(run, f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, kind string, ratio double")


def _meet(best: dict[str, np.ndarray], owners: list[int], places: list[int], number: dict[str, int]) -> None:
    """Raise the best ratios of pages by their runs of words, and forget the runs."""
    if owners:
        for kind, ratios in title_ratios(list(number)).items():
            np.maximum.at(best[kind], owners, ratios[places])
    for seen in (owners, places, number):
        seen.clear()


def word_runs(text: str, most: int = 5) -> Iterator[str]:
    """Runs of one to five words that are no longer than a title's ratio allows."""
    words = text.split()
    for i in range(len(words)):
        run = words[i]
        for j in range(i + 1, i + most + 1):
            if len(run) > LONGEST_RUN:
                break
            yield run
            if j >= len(words):
                break
            run = f"{run} {words[j]}"


def title_ratios(runs: list[str]) -> dict[str, np.ndarray]:
    """By statement type, the best ratio of its titles to each run of words; 0 where lengths alone keep it under FUZZY."""
    size = np.array([len(r) for r in runs], dtype=np.int64)
    chars = np.frombuffer("".join(r.ljust(LONGEST_RUN, "\0") for r in runs).encode("utf-32-le"), dtype="<u4").reshape(len(runs), LONGEST_RUN)
    codes = np.where(chars < 128, chars, 0).astype(np.uint8)
    out = {}
    for kind, titles in P.PAGE_TITLES.items():
        best = np.zeros(len(runs))
        for title in titles:
            near = np.flatnonzero(200 * np.minimum(size, len(title)) >= FUZZY * (size + len(title)))
            best[near] = np.maximum(best[near], 200.0 * _common(title, codes[near]) / (size[near] + len(title)))
        out[kind] = best
    return out


def _common(title: str, codes: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a title of ASCII letters and rows of codes, 0 being no letter."""
    places = np.zeros(128, dtype=np.uint64)
    for i, c in enumerate(title):
        places[ord(c)] |= np.uint64(1 << i)
    open_ = np.full(len(codes), (1 << 64) - 1, dtype=np.uint64)
    for column in codes.T:
        met = open_ & places[column]
        open_ = (open_ + met) | (open_ - met)
    return np.bitwise_count(~open_ & np.uint64((1 << len(title)) - 1)).astype(np.int64)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * (longest common subsequence) / (both lengths)."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            held = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = held
    return 200.0 * row[-1] / (len(a) + len(b))


def line_density(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, digit_ratio, line_ratio): how much of a page is digits, and of its lines are mostly so."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    return pages.select(
        "doc_id", "page_no", F.round(F.coalesce(F.try_divide(digits(text), F.length(text)), F.lit(0.0)), 6).alias("digit_ratio"),
        F.round(F.coalesce(F.try_divide(F.size(F.filter(lines, lambda x: digits(x) * 100 >= F.length(x) * 30)), F.size(lines)), F.lit(0.0)), 6).alias("line_ratio"),
    )


def best_title(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, title): the line that looks most like a title; UNKNOWN where none does.

    Lines of four characters and more with at most 30 % digits score 50 in upper case, 30 without digits, 100 with
    a statement word, and lose 20 for odd marks; the first wins ties.
    """
    words = ("bilan", "resultat", "engagement", "flux", "balance", "income", "cash flow")
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("s")))
    fits = F.filter(lines, lambda x: (F.length(x["s"]) >= 4) & (F.length(F.regexp_replace(x["s"], r"\D", "")) * 10 <= F.length(x["s"]) * 3))

    def score(x: Column) -> Column:
        low = folded(x["s"])
        return F.when(S.any_word(low, words) > 0, 100).otherwise(0) + F.when(x["s"] == F.upper(x["s"]), 50).otherwise(0) + F.when(~x["s"].rlike(r"\d"), 30).otherwise(0) - F.when(x["s"].rlike(r"[*#%$&|]"), 20).otherwise(0)

    scored = F.transform(fits, lambda x: F.struct((-score(x)).alias("n"), x["i"].alias("i"), x["s"].alias("s")))
    return pages.select("doc_id", "page_no", F.coalesce(F.array_min(scored)["s"], F.lit("UNKNOWN")).alias("title"))


def table_score(pages: DataFrame, line_score: Column | None = None, least: float = 0.02) -> DataFrame:
    """(doc_id, page_no, table_score, is_table): density of digits, share of lines with four digits, and of ruled lines.

    ``line_score`` (0 to 1) comes from the page's image; without it that part is 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    density = digits(text) / F.greatest(F.length(text), F.lit(1))
    ratio = F.size(F.filter(lines, lambda x: digits(x) >= 4)) / F.greatest(F.size(lines), F.lit(1))
    one = F.lit(1.0)
    score = 0.45 * F.least(one, density / 0.22) + 0.35 * (line_score if line_score is not None else F.lit(0.0)) + 0.2 * F.least(one, ratio / 0.35)
    return pages.select("doc_id", "page_no", F.round(score, 3).alias("table_score"), (score >= least).alias("is_table"))
