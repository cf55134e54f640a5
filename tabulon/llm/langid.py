"""Language identification of mixed text: scripts narrow, word scores decide, Viterbi labels spans.

Words are runs of letters of one script, found by code-point ranges.  The script narrows the languages to those
that were seen to be written in it.  A word's score under a language is the mean over n-gram orders 1 to 3 of
the log-probabilities of its letters' n-grams, hashed to tables of ``BUCKETS`` and smoothed, with marks for the
word's begin and end.  A Viterbi pass over the words of a text, with a fixed penalty for a switch of language,
labels each word; it runs over all texts of a block at once, a step for the n-th word of each.  Neighbouring
words of one label are a span.

The model is fitted on a bounded sample of the labelled rows (``per_language``, by a hash of the id); the texts of
the sample are counted whole, on the executors, and only summed counts reach the driver: at most
3 * BUCKETS numbers a language.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common

BUCKETS, ORDERS = 1 << 15, 3
#: Labelled rows of a language that the model is fitted on, as an expected number.
PER_LANGUAGE = 3000
#: Log-probability that a change of language costs.
PENALTY = 9.0
#: A language is written in a script that has at least this share of its letters.
LEAST_SHARE = 0.005
#: Codes of a block; the kernel's arrays take about 60 bytes for each.
BLOCK_CODES = 1 << 20
#: First and last code point of scripts; letters elsewhere are of no listed script.
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F),
    ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F), ("Devanagari", 0x900, 0x97F),
    ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F),
    ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF), ("Tibetan", 0xF00, 0xFFF),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7A3), ("Han", 0x20000, 0x2FA1F),
)
OTHER = 1 + len({s for s, _, _ in SCRIPTS})
MARK = OTHER + 1

_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the number of its script (0: no letter, MARK: a combining mark), and its simple lower-case form."""
    if not _tables:
        lower = np.arange(0x110000, dtype=np.int32)
        letter = np.zeros(0x110000, bool)
        mark = np.zeros(0x110000, bool)
        for i in range(0x110000):
            c = chr(i)
            kind = unicodedata.category(c)[0]
            mark[i] = kind == "M"
            if kind == "L":
                letter[i] = True
                small = c.lower()
                if len(small) == 1:
                    lower[i] = ord(small)
        script = np.where(letter, OTHER, 0).astype(np.uint8)
        numbers = {s: i + 1 for i, s in enumerate(dict.fromkeys(s for s, _, _ in SCRIPTS))}
        for name, first, last in SCRIPTS:
            part = script[first : last + 1]
            part[part > 0] = numbers[name]
        script[mark] = MARK
        _tables.extend((script, lower))
    return _tables[0], _tables[1]


class Words:
    """The words of some texts as arrays: code positions, owner, script, and hashed n-grams."""

    def __init__(self, texts: list[str]):
        script, lower = tables()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.first = np.append(0, np.cumsum([len(t) for t in texts]))
        kinds = script[points]
        marks = kinds == MARK
        if marks.any():
            # a mark is of the script of the letter before it; without one it is no letter
            base = np.maximum.accumulate(np.where(marks, -1, np.arange(len(points))))
            begin = np.repeat(self.first[:-1], np.diff(self.first))
            kinds = np.where(marks, np.where(base >= begin, kinds[np.maximum(base, 0)], 0), kinds)
            kinds[kinds == MARK] = 0
        self.n_codes = len(points)
        letter = kinds > 0
        begin, end = letter.copy(), letter.copy()
        change = kinds[1:] != kinds[:-1]
        begin[1:] &= change
        end[:-1] &= change
        cut = self.first[(self.first > 0) & (self.first < len(points))]
        begin[cut] = letter[cut]
        end[cut - 1] = letter[cut - 1]
        self.begins, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.scripts = kinds[self.begins]
        self.of_text = np.searchsorted(self.first, self.begins, side="right") - 1
        # letters only, so that words are adjacent slices
        sizes = self.ends - self.begins
        self.word_first = np.append(0, np.cumsum(sizes))[:-1]
        codes = lower[points[letter]].astype(np.int64) + 1
        place = np.arange(len(codes)) - np.repeat(self.word_first, sizes)
        p1, p2 = np.zeros_like(codes), np.zeros_like(codes)
        p1[1:], p2[2:] = codes[:-1], codes[:-2]
        p1[place < 1] = 0
        p2[place < 2] = 0
        self.grams = [self._bucket(codes), self._bucket(p1 << 21 | codes), self._bucket(p2 << 42 | p1 << 21 | codes)]
        last = self.word_first + sizes - 1
        before = np.where(sizes > 1, codes[np.maximum(last - 1, 0)], 0) if len(codes) else np.zeros(0, np.int64)
        tail = codes[last] if len(codes) else np.zeros(0, np.int64)
        self.tails = [self._bucket(tail << 21), self._bucket(before << 42 | tail << 21)]

    @staticmethod
    def _bucket(keys: np.ndarray) -> np.ndarray:
        return (common.mix64(keys) & np.uint64(BUCKETS - 1)).astype(np.int32)

    def scores(self, model: np.ndarray) -> np.ndarray:
        """Word by language: ``model`` is (languages, ORDERS, BUCKETS) of log-probabilities."""
        out = np.zeros((len(self.begins), len(model)), np.float32)
        if not len(self.begins):
            return out
        for k, table in enumerate(model):
            each = table[0][self.grams[0]] + table[1][self.grams[1]] + table[2][self.grams[2]]
            out[:, k] = np.add.reduceat(each, self.word_first) + table[1][self.tails[0]] + table[2][self.tails[1]]
        return out / ORDERS


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; texts are the slices first[i]:first[i + 1] of the words."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = first[:-1][order], sizes[order]
    labels = np.zeros(len(scores), np.int32)
    if not len(scores) or not len(order):
        return labels
    many = scores.shape[1]
    value = np.zeros((len(order), many), np.float32)
    stay = np.ones((len(scores), many), bool)
    jump = np.zeros(len(scores), np.int32)
    lives = np.searchsorted(-lengths, -np.arange(int(lengths[0])) - 1, side="right")
    for t, live in enumerate(lives):
        rows = begins[:live] + t
        v = value[:live]
        if t:
            best = v.max(axis=1)
            jump[rows] = v.argmax(axis=1)
            moved = (best - penalty)[:, None]
            stay[rows] = v >= moved
            v = np.maximum(v, moved) - best[:, None]
        value[:live] = v + scores[rows]
    now = value.argmax(axis=1)
    for t in range(len(lives) - 1, -1, -1):
        live = lives[t]
        rows = begins[:live] + t
        labels[rows] = now[:live]
        now[:live] = np.where(stay[rows, now[:live]], now[:live], jump[rows])
    return labels


def _parts(batch: pa.RecordBatch, text: int = 1):
    """Slices of a batch with BLOCK_CODES bytes of text or one row each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    group = np.cumsum(sizes) // BLOCK_CODES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class Model:
    """Log-probability tables, and which languages each script leaves."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=2, keepdims=True)
        self.table = np.log((counts + 0.05) / (total + 0.05 * BUCKETS)).astype(np.float32)
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.narrow = np.where(share >= LEAST_SHARE, 0.0, -1e4).T.astype(np.float32)  # script, language
        self.narrow[~(share >= LEAST_SHARE).any(axis=0)] = 0  # a script that no language has decides nothing


def fit(docs: DataFrame, train: F.Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the languages of the rows where ``train`` holds and the language is not null."""
    rows = docs.filter(train & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, ORDERS, BUCKETS)), np.zeros((0, OTHER + 1)))
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))))
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col).cast("string")), F.lit(1 << 20)) / (1 << 20)
    sample = rows.filter(draw < F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, kinds, keys, n = [], [], [], []
        for part in _parts(batch):
            langs = part.column(0).to_pylist()
            texts = part.column(1).fill_null("").to_pylist()
            for lang in sorted(set(langs)):
                w = Words([t for t, x in zip(texts, langs, strict=True) if x == lang])
                tallies = [np.bincount(w.grams[k], minlength=BUCKETS) for k in range(ORDERS)]
                for k in (1, 2):
                    tallies[k] = tallies[k] + np.bincount(w.tails[k - 1], minlength=BUCKETS)
                tallies.append(np.bincount(w.scripts, weights=w.ends - w.begins, minlength=OTHER + 1).astype(np.int64))
                for k, tally in enumerate(tallies):
                    at = np.flatnonzero(tally)
                    names += [lang] * len(at)
                    kinds.append(np.full(len(at), k, np.int32))
                    keys.append(at)
                    n.append(tally[at])
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kinds, keys, n)]
        return pa.record_batch([pa.array(names, pa.string()), pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64())], names=["lang", "kind", "key", "n"])

    counted = common.map_text(sample, kernel, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    counts, letters = np.zeros((len(languages), ORDERS, BUCKETS)), np.zeros((len(languages), OTHER + 1))
    which = np.searchsorted(languages, counted["lang"].to_numpy(dtype=str)) if len(counted) else np.zeros(0, int)
    kind, key, n = (counted[x].to_numpy(dtype=np.int64) for x in ("kind", "key", "n"))
    gram = kind < ORDERS
    counts[which[gram], kind[gram], key[gram]] = n[gram]
    letters[which[~gram], key[~gram]] = n[~gram]
    return Model(languages, counts, letters)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; spans are (start, end, lang) in code points.

    lang_pred is the language with the most letters, ties going to the first by name; score is its share of
    the letters.  A letter is of Unicode category L; a combining mark goes with the letter before it and is none by
    itself.  A null text, one without letters, or a model without languages gives ``und``, score 0 and no spans.
    Repeated rows are labelled alike; an empty table gives no rows.  A text is never cut: one of n words costs n steps
    of the Viterbi pass, which other texts of its block share.  ``with_text`` adds the column text, as it came.  Other
    columns of ``docs`` are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.narrow))

    def one(part: pa.RecordBatch) -> list:
        languages, table, narrow = sent.value
        w = Words(part.column(1).fill_null("").to_pylist())
        rows = len(part)
        if not languages or not len(w.begins):
            return [part.column(0), ["und"] * rows, np.zeros(rows), np.zeros(rows, np.int64), (np.zeros(0, np.int64),) * 3]
        first = np.searchsorted(w.of_text, np.arange(rows + 1))
        labels = viterbi(w.scores(table) + narrow[w.scripts], first, penalty)
        letters = np.bincount(w.of_text * len(languages) + labels, weights=w.ends - w.begins, minlength=rows * len(languages)).reshape(rows, -1)
        all_, best = letters.sum(axis=1), letters.argmax(axis=1)
        score = np.where(all_ > 0, letters.max(axis=1) / np.maximum(all_, 1), 0.0)
        new = np.append(True, (labels[1:] != labels[:-1]) | (w.of_text[1:] != w.of_text[:-1]))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(labels)) - 1
        owner = w.of_text[at]
        spans = (w.begins[at] - w.first[owner], w.ends[last] - w.first[owner], labels[at])
        names = [languages[b] if a else "und" for a, b in zip(all_ > 0, best, strict=True)]
        return [part.column(0), names, score, np.bincount(owner, minlength=rows), spans]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [one(p) for p in _parts(batch)]
        languages = pa.array([*sent.value[0]], pa.string())
        start, end, label = (np.concatenate([p[4][i] for p in parts]) for i in range(3))
        many = np.concatenate([p[3] for p in parts])
        named = languages.take(pa.array(label.astype(np.int64))) if len(label) else pa.array([], pa.string())
        spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), named], ["start", "end", "lang"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), spans)
        return pa.record_batch([batch.column(0), pa.array([n for p in parts for n in p[1]], pa.string()), pa.array(np.concatenate([p[2] for p in parts])), lists, *text(batch)], names=["doc_id", "lang_pred", "score", "spans", "text"][: 4 + with_text])

    text = lambda batch: [batch.column(1)] if with_text else []
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_text(given, kernel, common.keyed(given, "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>" + ", text string" * with_text))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, ~common.held_out("doc_id")))
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
