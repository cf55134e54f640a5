"""URL filter: block and allow rules, then a character language-model ratio for the URLs that no rule fits.

Two variable-order Markov models over bytes are counted from all URLs that a rule decides: one for allowed,
one for blocked URLs.  A position is counted once, as the packed gram of its symbol and the ``ORDER`` before
it; the lower orders are margins of those counts.  A context is used where it was seen at least ``LEAST`` times,
whatever the size of the corpus, so the models grow with the input and stay distributed tables.
Probabilities interpolate all orders with Witten-Bell weights, down to the uniform distribution.

URLs are scored by their distinct grams: rows are numbered in blocks, a block names each of its grams once, the
ratio of each distinct gram is looked up through the orders (a gram of one order meets the one without its oldest
symbol, at most SYMBOLS to one), and the ratios go back to the blocks that named the gram.  So a gram that every
URL has is a row for each block, not for each URL.

A URL's score is (log P_allowed - log P_blocked) / length.  The threshold is calibrated on a fold of the
labelled URLs that is not counted (a fifth, by a hash of the URL): the score with the best balanced accuracy.  The
models are counted from the other four fifths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common

#: Symbols before the predicted one; packed grams have 7 bits a symbol.
ORDER, BITS, SYMBOLS = 5, 7, 96
#: Sightings from which on a context is used, at any size of the corpus.
LEAST = 2
#: Rows of a block that is scored at once, as a power of two.
BLOCK_POWER = 14
#: Steps of the calibration histogram, in a nat.
STEPS, LIMIT = 1000, 20
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host(url: str) -> F.Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str) -> F.Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(rules: tuple[tuple[str, str], ...], host_col: str, path_col: str) -> F.Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; rules are a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((F.col(host_col) == name) | F.col(host_col).endswith(f".{name}")) & F.col(path_col).startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed gram at every byte, with 0 before a text begins; and where each text begins."""
    data, at = common.flat_utf8(column)
    symbols = np.where((data > 32) & (data < 127), data.astype(np.int64) - 32, 95)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    grams = symbols.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(symbols)
        before[k:] = symbols[: len(symbols) - k] if k < len(symbols) else 0
        grams |= np.where(place >= k, before, 0) << (BITS * k)
    return grams, at


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, good, bad) over all rows of (allowed, text): sightings in both classes; each block is counted before the shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, at = _grams(batch.column(1))
        allowed = np.repeat(np.asarray(batch.column(0).fill_null(False)).astype(np.int64), np.diff(at))
        keys, n = np.unique(grams << 1 | allowed, return_counts=True)
        return pa.record_batch([pa.array(keys >> 1), pa.array(n * (keys & 1)), pa.array(n * (1 - (keys & 1)))], names=["gram", "good", "bad"])

    parts = common.map_text(labelled.select("allowed", "text"), kernel, "gram long, good long, bad long")
    return parts.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def fit(labelled: DataFrame) -> DataFrame:
    """The models of both classes from rows (allowed, text): the counts of all full grams."""
    return common.written(count_grams(labelled), "url-grams")


def _mask(order: int) -> int:
    return (1 << (BITS * (order + 1))) - 1


def gram_ratios(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """(gram, ratio) for the distinct full grams of ``wanted``: log P_allowed - log P_blocked."""
    zero = F.lit(0).cast("long")
    base = models.select("gram", "good", "bad", F.lit(False).alias("asked")).unionByName(wanted.select("gram", zero.alias("good"), zero.alias("bad"), F.lit(True).alias("asked")))
    masks = F.array(*(F.struct(F.lit(k).alias("order"), F.lit(_mask(k)).cast("long").alias("mask")) for k in range(ORDER + 1)))
    full = base.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("asked").alias("asked"))
    each = full.select("good", "bad", "asked", "gram", F.explode(masks).alias("o"))
    margin = each.groupBy(F.col("o.order").alias("order"), F.col("gram").bitwiseAND(F.col("o.mask")).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("asked").alias("asked"))
    # a context has at most SYMBOLS entries
    met = margin.groupBy("order", F.shiftright("gram", BITS).alias("context")).agg(
        *(f(c) for c in ("good", "bad") for f in (lambda c: F.sum(c).alias(f"all_{c}"), lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}"))),
        F.collect_list(F.when(F.col("asked"), F.struct("gram", "good", "bad"))).alias("entries"),
    )
    rows = met.select("order", "all_good", "kinds_good", "all_bad", "kinds_bad", F.explode("entries").alias("e")).select("*", "e.gram", "e.good", "e.bad").drop("e")
    rows = common.written(rows, "url-contexts")
    found = None
    for k in range(ORDER + 1):
        mine = rows.filter(F.col("order") == k)
        if found is None:
            lower = mine.withColumns({"p_good": F.lit(1.0 / SYMBOLS), "p_bad": F.lit(1.0 / SYMBOLS)})
        else:
            lower = mine.withColumn("short", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)).cast("long"))).join(found.withColumnRenamed("gram", "short"), "short")

        def p(c: str, lower: DataFrame = lower) -> F.Column:
            total, kinds = lower[f"all_{c}"], lower[f"kinds_{c}"]
            return F.when(total >= LEAST, (lower[c] + kinds * lower[f"p_{c}"]) / (total + kinds)).otherwise(lower[f"p_{c}"]).alias(f"p_{c}")

        found = lower.select("gram", p("good"), p("bad"))
    return found.select("gram", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def score(df: DataFrame, models: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a column score, the length-normalised log-likelihood difference; 0 for an empty text."""
    names = [c for c in df.columns if c not in (text, "score")]
    # the blocks are fixed by writing them: a repeated task finds the same rows in them
    placed = common.written(df.select(F.shiftright(F.monotonically_increasing_id(), BLOCK_POWER).alias("__block"), F.col(text).alias("__text"), *names), "url-blocks")

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, at = _grams(batch.column(1))
        block = np.repeat(np.asarray(batch.column(0)), np.diff(at))
        ids, of = np.unique(block, return_inverse=True)
        keys = np.unique(of.astype(np.int64) << (BITS * (ORDER + 1)) | grams)
        return pa.record_batch([pa.array(ids[keys >> (BITS * (ORDER + 1))], pa.int64()), pa.array(keys & _mask(ORDER))], names=["__block", "gram"])

    asked = common.written(common.map_text(placed.select("__block", "__text"), named, "__block long, gram long"), "url-asked")
    known = asked.join(gram_ratios(asked.select("gram").distinct(), models), "gram").select("__block", "gram", "ratio")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, at = _grams(left.column("__text").combine_chunks())
        keys, first = np.unique(right.column("gram").to_numpy(), return_index=True)
        ratio = right.column("ratio").to_numpy()[first][np.searchsorted(keys, grams)] if len(keys) else np.zeros(0)
        total = np.append(0.0, np.cumsum(ratio))
        value = (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)
        return left.select(names).append_column("score", pa.array(np.round(value, 9)))

    return placed.groupBy("__block").cogroup(known.groupBy("__block")).applyInArrow(kernel, f"{schema}, score double")


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy over rows (allowed, score); 0 where a class is missing."""
    bin_of = F.floor(F.least(F.greatest(F.col("score"), F.lit(-LIMIT)), F.lit(LIMIT)) * STEPS).cast("int")
    rows = scored.groupBy("allowed", bin_of.alias("bin")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros((2, 2 * LIMIT * STEPS + 1))
    for r in rows:
        counts[int(r["allowed"]), r["bin"] + LIMIT * STEPS] = r["n"]
    if not counts.sum(axis=1).all():
        return 0.0
    blocked, allowed = (np.append(0, np.cumsum(c)) / c.sum() for c in counts)
    gain = blocked - allowed  # at bin b: blocked below it, and allowed from it on
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[len(best) // 2] - LIMIT * STEPS) / STEPS)


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict, else the model's, for every row.

    The models read whole URLs, query and fragment included.  A null URL, or one without ://, has empty host and path
    and so no rule; the score of a null or empty one is 0 and the threshold decides.  A score at the threshold is
    allowed.  Where no URL, or URLs of one class only, are decided by rules, the threshold is 0, so an unscored URL is
    allowed.  Repeated rows are judged alike.  A URL of any length is scored whole.  Empty tables give no rows.  Other
    columns of ``pages`` are not read.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host(url_col).alias("host"), path(url_col).alias("path"), F.coalesce(F.col(url_col), F.lit("")).alias("text"))
    parts = parts.withColumn("best", best_rule(rules, "host", "path")).select(
        "page_id", "host", "path", "best.rule", F.col("best.verdict").alias("decided"), "text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("fold"),
    )
    labelled = parts.filter("decided IS NOT NULL").select((F.col("decided") == "allow").alias("allowed"), "text", "fold")
    models = fit(labelled.filter("NOT fold"))
    scored = common.written(score(parts, models), "url-scores")
    threshold = calibrate(scored.filter("decided IS NOT NULL AND fold").select((F.col("decided") == "allow").alias("allowed"), "score"))
    verdict = F.coalesce("decided", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op1(spark, sf_dir: str) -> DataFrame:
    return filter_urls(common.read(spark, sf_dir, "pages"))
