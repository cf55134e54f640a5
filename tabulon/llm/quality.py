"""Quality scores by Bradley-Terry ranking: logistic loss on feature differences of preference pairs.

One pass over the texts measures each document: shares of kinds of characters, of words and of lines, and how much
repeats.  The measures are written as a narrow table; labels join that table, not the texts.  From a bounded,
documented sample of labelled rows (``sample``), pairs of a good and a bad document are drawn and a linear score
is learned so that the good one of a pair scores higher: loss log(1 + exp(-(s_good - s_bad))), fitted by Newton
steps with a ridge.  The model only ranks, so the threshold comes from the scores' own distribution: the
quantile of the scores of all labelled rows, not only the sampled ones, that cuts off their share of bad documents.
It is exact: histograms narrow the range of the scores that it lies in.  The result is a logistic curve that is
``CUT`` at that threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common

#: Labelled rows that the model is fitted on, as an expected number, and preference pairs drawn from them.
SAMPLE, PAIRS, RIDGE = 20_000, 200_000, 1e-3
#: Scores that the driver sorts at once, and bins of a histogram that finds fewer of them.
HELD, BINS = 100_000, 4096
#: Bytes of text that are measured at once; the arrays take about 40 bytes for each.
BLOCK = 1 << 20
#: The score at the threshold.
CUT = 0.7
NAMES = (
    "log_bytes", "lower", "upper", "digit", "space", "newline", "stop", "comma", "mark", "other", "high",
    "log_words", "mean_word", "long_word", "short_word", "mark_word", "marked_end", "upper_word", "digit_word",
    "distinct", "repeated", "top_word", "log_lines", "repeated_line", "mean_line", "no_stop_line", "empty",
)

_KINDS = np.full(256, 8, np.int8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".!?", b",;:'\"-()", b"#$%&*|<>{}[]\\^~=+_@/`")):
    _KINDS[list(_chars)] = _i
_KINDS[128:] = 9
_LETTER = np.isin(_KINDS, (0, 1, 9))


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    c = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=c[1:])
    return c


def measure(column: pa.Array) -> np.ndarray:
    """A row of the measures NAMES for each text; null counts as empty."""
    data, at = common.flat_utf8(column)
    n = len(at) - 1
    size = np.diff(at)
    kinds = _KINDS[data]
    out = np.zeros((n, len(NAMES)))
    out[:, 0] = np.log1p(size)
    for k in range(10):
        out[:, 1 + k] = np.diff(_before(kinds == k)[at]) / np.maximum(size, 1)
    b, e = common.runs(~common.SPACE[data], at)
    text = np.searchsorted(at, b, side="right") - 1
    words = np.bincount(text, minlength=n)
    each = lambda flags: np.bincount(text, weights=flags, minlength=n) / np.maximum(words, 1)
    long = e - b
    out[:, 11] = np.log1p(words)
    out[:, 12], out[:, 13], out[:, 14] = each(np.minimum(long, 100)), each(long > 12), each(long < 4)

    def inside(flags: np.ndarray) -> np.ndarray:
        c = _before(flags)
        return c[e] - c[b]

    digits = inside(kinds == 2)
    out[:, 15] = each(inside(_LETTER[data]) + digits == 0)
    if len(b):
        out[:, 16] = each(np.isin(kinds[e - 1], (7, 8)) | ((long > 1) & np.isin(data[e - 1], (33, 63)) & np.isin(data[np.maximum(e - 2, 0)], (33, 63))))
    out[:, 17] = each((inside(kinds == 1) > 1) & (inside(kinds == 0) == 0))
    out[:, 18] = each(digits > 0)
    hashes = common.run_hashes(data, b, e)
    if len(b):
        order = np.lexsort((hashes, text))
        t, h = text[order], hashes[order]
        new = np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1]))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(h)))
        out[:, 19] = np.bincount(t[first], minlength=n) / np.maximum(words, 1)
        same = np.append(False, (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]))
        out[:, 20] = each(same)
        top = np.zeros(n)
        np.maximum.at(top, t[first], many)
        out[:, 21] = top / np.maximum(words, 1)
    lb, le = common.runs(data != 10, at)
    line = np.searchsorted(at, lb, side="right") - 1
    lines = np.bincount(line, minlength=n)
    out[:, 24] = np.log1p(size / np.maximum(lines, 1))
    if len(lb):
        out[:, 22] = np.log1p(lines)
        hashes = common.run_hashes(data, lb, le)
        order = np.lexsort((hashes, line))
        h, t = hashes[order], line[order]
        again = np.append(False, (h[1:] == h[:-1]) & (t[1:] == t[:-1]))
        out[:, 23] = np.bincount(t, weights=again, minlength=n) / np.maximum(lines, 1)
        out[:, 25] = np.bincount(line, weights=~np.isin(kinds[le - 1], (5,)), minlength=n) / np.maximum(lines, 1)
    out[:, 26] = size == 0
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the measures of every row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = measure(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
        return pa.record_batch([batch.column(0), lists], names=["doc_id", "x"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_text(given, kernel, common.keyed(given, "x array<double>"), limit=BLOCK)


def expand(x: np.ndarray) -> np.ndarray:
    """The measures and their square roots, so that small shares count."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


@dataclass
class Ranking:
    """The raw score is w . expand(x) + bias; ``sure`` says that no threshold is to be set."""

    weights: np.ndarray
    bias: float
    sure: bool = False


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 5) -> Ranking:
    """Bradley-Terry scores from labelled measures, before a threshold is set.

    With labels of one class only there are no pairs: every score is then 1 (good), 0 (bad), or CUT with no
    label at all.
    """
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    z = expand(x)
    if not len(up) or not len(down):
        sure = 500.0 if len(up) else -500.0 if len(down) else float(np.log(CUT / (1 - CUT)))
        return Ranking(np.zeros(2 * len(NAMES)), sure, True)
    mean, spread = z.mean(axis=0), z.std(axis=0)
    spread[spread < 1e-9] = np.inf
    z = (z - mean) / spread
    draw = np.random.default_rng(seed)
    diff = z[draw.choice(up, pairs)] - z[draw.choice(down, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -50, 50)))
        slope = diff.T @ (p - 1) / pairs + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    shift = w / spread
    return Ranking(shift, float(-mean @ shift))


def nth(values: DataFrame, n: int) -> float:
    """The n-th least (from 0) of the column raw; each round reads the table once and keeps one bin of the last."""
    low, high = None, None
    while True:
        inside = values if low is None else values.filter(F.col("raw").between(F.lit(low), F.lit(high)))
        count, low, high = inside.agg(F.count("*"), F.min("raw"), F.max("raw")).first()
        if low == high:
            return low
        if count <= HELD:
            return float(np.sort(inside.toPandas()["raw"].to_numpy())[n])
        bin_of = F.floor((F.col("raw") - F.lit(low)) / F.lit(high - low) * BINS).cast("int")
        for r in inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).orderBy("bin").collect():
            if n < r["n"]:
                low, high = r["low"], r["high"]
                break
            n -= r["n"]


def threshold(scored: DataFrame) -> float:
    """The exact quantile of the rows (raw, good) that cuts off as many as are bad: midway between the scores beside it."""
    n, good = scored.agg(F.count("*"), F.sum(F.col("good").cast("long"))).first()
    below, above = (nth(scored.select("raw"), k) for k in (n - good - 1, n - good))
    return (below + above) / 2


def raw_score(model: Ranking) -> F.Column:
    """The raw score of the column x."""
    half = len(NAMES)
    plain, root = (F.array(*(F.lit(float(v)) for v in model.weights[a : a + half])) for a in (0, half))
    terms = F.zip_with("x", plain, lambda a, w: a * w), F.zip_with("x", root, lambda a, w: F.sqrt(F.abs(a)) * w)
    return sum((F.aggregate(t, F.lit(0.0), lambda s, v: s + v) for t in terms), F.lit(model.bias))


def rank(docs: DataFrame, labels: DataFrame, train: F.Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; ``train`` says of ``labels`` rows if they may be used.

    Null labels are left out; an id with several labels counts each.  Null and empty texts are scored like any
    other.  Repeated rows score alike; empty tables give no rows; a very long text is measured by itself.  A score at
    the threshold is predicted 1.  The model is fitted on about ``sample`` labelled rows, twice that at most; the
    threshold covers all.  Other columns are not read.
    """
    x = common.written(features(docs, id_col, text_col), "quality")
    given = labels.filter(train & F.col(label_col).isNotNull()).select(F.col("doc_id").alias("__id"), (F.col(label_col) == 1).alias("good"))
    met = x.join(given, F.col("doc_id") == F.col("__id"))
    # a share of the labelled rows by a hash of the id, about ``sample`` of them; the limit holds even where one id has them all
    n, draw = met.count(), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
    drawn = met.select("x", "good", draw.alias("draw")).filter(F.col("draw") < int(min(1.0, sample / max(n, 1)) * (1 << 30)))
    rows = drawn.limit(2 * sample).toPandas().sort_values(["draw", "good"], kind="stable")
    values = np.stack(rows["x"].to_list()).astype(float) if len(rows) else np.zeros((0, len(NAMES)))
    model = fit(values, rows["good"].to_numpy(dtype=bool))
    raw = raw_score(model)
    if not model.sure:
        raw = raw - F.lit(threshold(common.written(met.select(raw.alias("raw"), "good"), "labelled-scores"))) + F.lit(float(np.log(CUT / (1 - CUT))))
    score = 1 / (1 + F.exp(-F.least(F.greatest(raw, F.lit(-500.0)), F.lit(500.0))))
    return x.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op10(spark, sf_dir: str) -> DataFrame:
    out = rank(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), ~common.held_out("doc_id"))
    return out.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", "predicted")
