"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

The tokens of a BPE tokenizer are fixed by its last token at every position: the last token of a prefix is the
one token v for which the tokens of the rest, ending in u, may stand before v, that is, v's merges and u's do
not disturb each other ("u, v is the encoding of their joined text").  So a state has to know, for every suffix
of what was read that begins some token, only the last token before that suffix and how many tokens less the
text had there.  Reading a character moves to another such state and emits a number: by how much the token
count of the text read so far changes.  The sum of the numbers on a path is the count of its whole text.

States and transitions are compiled on first use and kept for the life of a Python worker, in arrays that numpy
steps through for many rows at once.  A word boundary leads every state to the same one, so the state map of a
chunk that begins at a boundary is one pair (count, exit).  The distinct words of a block are such chunks; the
counts of the texts are differences of the prefix sum of their words' counts.  Long words are cut further: their
chunks run side by side from the states that a short run-up predicts, which makes a state map for each chunk, and the
maps compose pairwise, level by level, as a parallel prefix scan does.  A map holds the entry states that occur; where a
composition asks for another one, all chunks that lack one are run from it at once.

The model is sentencepiece BPE with byte fallback: a space is the mark U+2581, one is put before the text, a
character that is no piece counts its UTF-8 bytes and separates what is around it.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common

MARK = "▁"
#: Symbols of a chunk of a long word, and of the run-up that predicts its entry state.
CHUNK, RUN_UP = 4096, 128
#: Compiled states that a worker keeps; beyond that it begins anew (a bound of memory, not of results).
MAX_STATES = 400_000


def word_hashes(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each of adjacent words: a sum of random numbers, one for each place and character."""
    with np.errstate(over="ignore"):
        place = (np.arange(len(points)) - np.repeat(begins, ends - begins)).astype(np.uint64)
        mixed = common.mix64((place << np.uint64(21) | points.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
        return np.add.reduceat(mixed, begins)


class Merger:
    """Plain BPE by ranks over a list of characters; used to compile, never on texts."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def encode(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


class Transducer:
    """A lazily compiled deterministic transducer whose transitions emit changes of the token count."""

    def __init__(self, pieces: list[str]):
        self.merger = Merger({p: i for i, p in enumerate(pieces)})
        self.pieces = pieces
        self.chars = {c: i + 1 for i, c in enumerate(sorted({p for p in pieces if len(p) == 1}))}
        self.symbol = np.zeros(0x110000, np.int32)
        for c, i in self.chars.items():
            self.symbol[ord(c)] = i
        # a trie of the pieces: children by symbol, and the piece that ends at a node (-1: none)
        self.children: list[dict[int, int]] = [{}]
        self.piece: list[int] = [-1]
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                if c not in self.chars:
                    break
                at = self.children[at].setdefault(self.chars[c], len(self.children))
                if at == len(self.children):
                    self.children.append({})
                    self.piece.append(-1)
            else:
                self.piece[at] = i
        self.allowed: dict[tuple[int, int], bool] = {}
        self.mark = self.chars[MARK]
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.entries: list[tuple] = []
        # open addressing: key = state * symbols + symbol; the row is (key, next, change)
        self.table = np.full((1 << 16, 3), -1, np.int64)
        self.used = 0
        self.start = self._state(((0, -1, 0),), False)

    def _state(self, entries: tuple, spaces: bool) -> int:
        at = self.states.get(key := (entries, spaces))
        if at is None:
            at = self.states[key] = len(self.entries)
            self.entries.append(key)
        return at

    def _may_follow(self, before: int, piece: int) -> bool:
        found = self.allowed.get(key := (before, piece))
        if found is None:
            text = self.pieces[piece]
            want = [text] if before < 0 else [self.pieces[before], text]
            found = self.allowed[key] = self.merger.encode("".join(want)) == want
        return found

    def _move(self, state: int, symbol: int) -> tuple[int, int]:
        entries, spaces = self.entries[state]
        if symbol == self.mark and not spaces:
            entries = ((0, -1, 0),)  # no piece has a mark after another character: a boundary
        last, change, moved = -1, 0, []
        for node, before, less in entries:
            to = self.children[node].get(symbol)
            if to is None:
                continue
            if self.children[to]:
                moved.append((to, before, less))
            if last < 0 and self.piece[to] >= 0 and self._may_follow(before, self.piece[to]):
                last, change = self.piece[to], less + 1
        if last < 0:
            raise ValueError(f"no token ends after symbol {symbol} in state {state}")
        after = sorted((node, before, less - change) for node, before, less in moved)
        return self._state(((0, last, 0), *after), symbol == self.mark), change

    def _put(self, key: int, to: int, change: int) -> None:
        if self.used * 2 >= len(self.table):
            old, self.table = self.table[self.table[:, 0] >= 0], np.full((4 * len(self.table), 3), -1, np.int64)
            mask, left = len(self.table) - 1, old
            at = (common.mix64(left[:, 0]) & np.uint64(mask)).astype(np.int64)
            while len(left):
                free = self.table[at, 0] < 0
                slot, first = np.unique(at[free], return_index=True)
                self.table[slot] = left[free][first]
                stays = np.ones(len(left), bool)
                stays[np.flatnonzero(free)[first]] = False
                left, at = left[stays], (at[stays] + 1) & mask
        mask = len(self.table) - 1
        at = int(common.mix64(np.array([key]))[0]) & mask
        while self.table[at, 0] >= 0:
            at = (at + 1) & mask
        self.table[at] = (key, to, change)
        self.used += 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the table, -1 where a transition is not compiled yet."""
        mask = len(self.table) - 1
        at = (common.mix64(keys) & np.uint64(mask)).astype(np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            held = self.table[at, 0]
            hit = held == keys[open_]
            out[open_[hit]] = at[hit]
            on = ~hit & (held >= 0)
            open_, at = open_[on], (at[on] + 1) & mask
        return out

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the count, for many rows at once."""
        keys = states * (len(self.chars) + 1) + symbols
        at = self._find(keys)
        if (at < 0).any():
            for key in np.unique(keys[at < 0]).tolist():
                self._put(key, *self._move(*divmod(key, len(self.chars) + 1)))
            at = self._find(keys)
        return self.table[at, 1], self.table[at, 2]

    def run(self, symbols: np.ndarray, weights: np.ndarray, begins: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, counts) of the chunks symbols[begins:ends] from the given entry states.

        A symbol 0 is no piece: it counts its weight, its UTF-8 bytes, and the next state is that after a
        boundary.  Rows are ordered by length, so those still running are a prefix.
        """
        order = np.argsort(begins - ends, kind="stable")
        b, n = begins[order], (ends - begins)[order]
        now, count = states[order].astype(np.int64), np.zeros(len(order), np.int64)
        for j in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -j))
            here = symbols[b[:live] + j]
            known = here > 0
            if known.all():
                now[:live], change = self.step(now[:live], here)
                count[:live] += change
            else:
                count[:live] += np.where(known, 0, weights[b[:live] + j])
                now[:live] = np.where(known, now[:live], self.start)
                which = np.flatnonzero(known)
                now[which], change = self.step(now[which], here[which])
                count[which] += change
        exits, counts = np.empty_like(now), np.empty_like(count)
        exits[order], counts[order] = now, count
        return exits, counts

    def scan(self, symbols: np.ndarray, weights: np.ndarray, begin: int, end: int) -> int:
        """The count of one long word: state maps of its chunks, composed pairwise up to the map of the word."""
        begins = np.arange(begin, end, CHUNK)
        ends = np.minimum(begins + CHUNK, end)
        start = np.full(len(begins), self.start)
        entry = self.run(symbols, weights, np.maximum(begins - RUN_UP, begin), begins, start)[0].tolist()
        maps: list[dict[tuple[int, int], tuple[int, int]]] = []  # by level: (block, entry state) to (exit state, count)

        def apply(level: int, blocks: list[int], states: list[int]) -> list[tuple[int, int]]:
            known, asked = maps[level], [*zip(blocks, states, strict=True)]
            lacks = sorted({k for k in asked if k not in known})
            if lacks and level == 0:
                which = np.array([b for b, _ in lacks])
                exits, counts = self.run(symbols, weights, begins[which], ends[which], np.array([s for _, s in lacks]))
                known.update(zip(lacks, zip(exits.tolist(), counts.tolist(), strict=True), strict=True))
            elif lacks:
                left = apply(level - 1, [2 * b for b, _ in lacks], [s for _, s in lacks])
                whole = [k for k, (b, _) in enumerate(lacks) if 2 * b + 1 < sizes[level - 1]]
                right = dict(zip(whole, apply(level - 1, [2 * lacks[k][0] + 1 for k in whole], [left[k][0] for k in whole]), strict=True))
                for k, key in enumerate(lacks):
                    known[key] = (right[k][0], left[k][1] + right[k][1]) if k in right else left[k]
            return [known[k] for k in asked]

        sizes = [len(begins)]
        while True:
            level = len(maps)
            maps.append({})
            apply(level, [*range(sizes[level])], entry[:: 1 << level])
            if sizes[level] == 1:
                return apply(level, [0], [self.start])[0][1]
            sizes.append((sizes[level] + 1) // 2)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Token counts of the texts."""
        if len(self.entries) > MAX_STATES:
            self.reset()
        whole = "".join(MARK + t for t in texts if t).replace(" ", MARK)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if not len(points):
            return np.zeros(len(texts), np.int64)
        symbols = self.symbol[points]
        weights = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        first = np.append(0, np.cumsum(lengths))
        marked = symbols == self.mark
        begins_here = marked & ~np.append(False, marked[:-1])
        begins_here[first[:-1][lengths > 0]] = True
        begins = np.flatnonzero(begins_here)
        ends = np.append(begins[1:], len(points))
        hashes = word_hashes(points, begins, ends)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        # words of one hash are compared with its first word; one that differs stands for itself
        long, model = ends - begins, one[which]
        other = long != long[model]
        at = np.arange(len(points)) + np.repeat(begins[model] - begins, long)
        differ = np.flatnonzero(points[np.minimum(at, len(points) - 1)] != points)
        other[np.searchsorted(begins, differ, side="right") - 1] = True
        if other.any():
            which[other] = len(one) + np.arange(int(other.sum()))
            one = np.append(one, np.flatnonzero(other))
        b, e = begins[one], ends[one]
        short = e - b <= CHUNK
        counts = np.zeros(len(one), np.int64)
        counts[short] = self.run(symbols, weights, b[short], e[short], np.full(int(short.sum()), self.start))[1]
        for i in np.flatnonzero(~short):
            counts[i] = self.scan(symbols, weights, int(b[i]), int(e[i]))
        upto = np.append(0, np.cumsum(counts[which]))
        at = np.searchsorted(begins, first)
        return upto[at[1:]] - upto[at[:-1]]


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a sentencepiece BPE model file, kept by the worker."""
    if path not in _compiled:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]
        inner = [p for p in pieces if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with a mark inside: {inner[:3]}")
        _compiled[path] = Transducer(pieces)
    return _compiled[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null counts as empty, and an empty text has no tokens.  Repeated rows are counted each; an empty table gives no rows.
    A text of any length is counted whole; ``limit`` itself is not over the limit.  Other columns of ``docs`` are not read.  The model file is read on the executors, where the tokenizer package is installed.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = pc.fill_null(batch.column(1), "")
        n = transducer(path).counts(column.to_pylist())
        size = pc.binary_length(column).cast(pa.int64())
        return pa.record_batch([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_text(given, kernel, common.keyed(given, "n_bytes long, n_tokens long, over_limit boolean"))


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
