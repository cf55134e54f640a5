"""Byte-level BPE encoding and decoding with rank files, by rounds over padded matrices.

A text is split by the tokenizer's pattern; every distinct piece of a block is encoded once.  Pieces are put in
buckets by length, a bucket being a padded matrix with a row per piece.  Beside the symbols a second matrix
holds the rank of each adjacent pair, found in a hash table of pairs.  In a round every row merges its leftmost
pair of least rank: both matrices are compacted by one column in that row and the two pairs beside the new
symbol are looked up.  Rows without a pair that merges leave the matrix.

A piece of more than ``LONG`` bytes would need nearly as many rounds as it has bytes, so it is a matrix of one row in
which a round merges all places of the least rank from left to right.  That is the same: the places do not overlap, and
where a new pair would rank lower than the round's, the round merges the leftmost place only.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common

#: Bytes of the longest row of a matrix.
LONG = 256
#: Distinct pieces that a worker remembers; beyond that it begins anew.
MAX_PIECES = 100_000
#: The rank of a pair that does not merge.
NONE = np.int64(1) << 40


class PairTable:
    """Open addressing from a pair of token ids to the id, that is the rank, of their joined bytes."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        size = 1 << int(np.ceil(np.log2(max(4 * len(pairs), 16))))
        self.mask = size - 1
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        at = self._place(pairs)
        left = np.arange(len(pairs))
        while len(left):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            who = np.flatnonzero(free)[first]
            self.keys[slot], self.ranks[slot] = pairs[left[who]], ranks[left[who]]
            stays = np.ones(len(left), bool)
            stays[who] = False
            left, at = left[stays], (at[stays] + 1) & self.mask

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return (common.mix64(pairs) & np.uint64(self.mask)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left.astype(np.int64) << 24 | right
        at = self._place(pairs)
        out = np.full(len(pairs), NONE, np.int64)
        open_ = np.arange(len(pairs))
        while len(open_):
            held = self.keys[at]
            hit = held == pairs[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            on = ~hit & (held >= 0)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out


class _Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        return at


class BytePairs:
    """A tokenizer from a rank file (base64 token and rank on each line) and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("a rank file has every single byte")
        found = [(self.ranks[t[:i]] << 24 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*found, strict=True)))
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_first = np.append(0, np.cumsum(self.token_sizes))[:-1]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _bucket(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes: rounds of merges over one matrix."""
        n = np.array([len(p) for p in pieces])
        inside = np.arange(width) < n[:, None]
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), NONE, np.int64)  # of the pair that begins at a column
        both = inside[:, 1:]
        rank[:, :-1][both] = self.pairs.find(ids[:, :-1][both], ids[:, 1:][both])
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(rows):
            at = rank.argmin(axis=1)
            least = np.take_along_axis(rank, at[:, None], 1)[:, 0]
            ended = least == NONE
            if ended.any():
                for r, row, size in zip(rows[ended], ids[ended], n[ended], strict=True):
                    out[r] = row[:size].astype(np.uint32)
                keep = ~ended
                rows, ids, rank, n, at, least = rows[keep], ids[keep], rank[keep], n[keep], at[keep], least[keep]
                if not len(rows):
                    break
            n = n - 1
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), 1)
            every = np.arange(len(rows))
            ids[every, at] = least
            if (has := at > 0).any():
                rank[every[has], at[has] - 1] = self.pairs.find(ids[every[has], at[has] - 1], least[has])
            rank[every, np.minimum(at, rank.shape[1] - 1)] = NONE
            if (has := at < n - 1).any():
                rank[every[has], at[has]] = self.pairs.find(least[has], ids[every[has], at[has] + 1])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """One long row: a round for each least rank, not for each merge."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) < NONE:
            at = np.flatnonzero(rank == least)
            # of places that overlap, every second from the left
            new = np.append(True, np.diff(at) > 1)
            at = at[(at - at[new][np.cumsum(new) - 1]) % 2 == 0]
            merged, pairs, lower = self._merge(ids, rank, at, least)
            if lower and len(at) > 1:
                merged, pairs, _ = self._merge(ids, rank, at[:1], least)
            ids, rank = merged, pairs
        return ids.astype(np.uint32)

    def _merge(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, new: np.int64) -> tuple[np.ndarray, np.ndarray, bool]:
        """The row and its pair ranks after the pairs at ``at`` became ``new``, and whether a new pair ranks lower."""
        stays = np.ones(len(ids), bool)
        stays[at + 1] = False
        ids = ids.copy()
        ids[at] = new
        ids, rank = ids[stays], np.append(rank, NONE)[stays][:-1]
        now = at - np.arange(len(at))
        near = np.unique(np.concatenate([now - 1, now]))
        near = near[(near >= 0) & (near < len(rank))]
        rank[near] = found = self.pairs.find(ids[near], ids[near + 1])
        return ids, rank, bool((found < new).any())

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        raw = [p.encode() for p in pieces]
        out: list = [None] * len(raw)
        sizes = np.array([len(p) for p in raw])
        for i, p in enumerate(raw):  # a piece that is a token needs no merges
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole], np.uint32)
            elif sizes[i] > LONG:
                out[i] = self._long(p)
        edges = [0, 4, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONG]
        for low, width in zip(edges, edges[1:], strict=False):
            mine = [i for i in np.flatnonzero((sizes > low) & (sizes <= width)) if out[i] is None]
            step = max(1, (1 << 20) // width)
            for k in range(0, len(mine), step):
                for i, ids in zip(mine[k : k + step], self._bucket([raw[i] for i in mine[k : k + step]], width), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text begins (one more than texts)."""
        if len(self.index) > MAX_PIECES:
            self.forget()
        found, sizes = [], []
        for t in texts:
            own = self.pattern.findall(t)
            found += own
            sizes.append(len(own))
        known = len(self.index)
        which = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        if len(self.index) > known:
            new = self.encode_pieces(list(self.index)[known:])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum([len(x) for x in new]))
            self.ids = np.concatenate([self.ids, *new])
        many = self.starts[which + 1] - self.starts[which]
        upto = np.append(0, np.cumsum(many))
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.starts[which] - upto[:-1], many)]
        return ids, upto[np.append(0, np.cumsum(sizes))]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where those of each id begin (one more than ids)."""
        ids = ids.astype(np.int64)
        if len(ids) and (int(ids.max()) >= len(self.token_sizes) or not self.token_sizes[ids].all()):
            raise ValueError("an id that is no token")
        many = self.token_sizes[ids]
        upto = np.append(0, np.cumsum(many))
        return self.token_bytes[np.arange(upto[-1]) + np.repeat(self.token_first[ids] - upto[:-1], many)], upto


_loaded: dict[tuple[str, str], BytePairs] = {}


def tokenizer(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BytePairs(path, pattern)
    return _loaded[path, pattern]


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every row, as little-endian unsigned 32-bit integers in a binary.

    Null counts as empty, and an empty text has no ids.  Strings of special tokens are ordinary text.
    Repeated rows are encoded each.  Other columns of ``docs`` are not read.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = tokenizer(path, pattern).encode(pc.fill_null(batch.column(1), "").to_pylist())
        return pa.record_batch([batch.column(0), _binaries(ids.astype("<u4").view(np.uint8), 4 * at)], names=["doc_id", "ids"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_text(given, kernel, common.keyed(given, "ids binary"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the ids of every row; null ids count as none.

    An id that is no token of the file is an error, as it cannot come from ``encode``.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = common.flat_utf8(batch.column(1).fill_null(b""))
        flat, upto = tokenizer(path, pattern).decode(np.ascontiguousarray(data).view("<u4"))
        return pa.record_batch([batch.column(0), batch.column(1), _binaries(flat, upto[at // 4])], names=["doc_id", "ids", "decoded"])

    given = encoded.select("doc_id", "ids")
    return common.map_text(given, kernel, common.keyed(given, "ids binary, decoded binary"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding every row and decoding its ids.

    The digests of what ``encode`` and ``decode`` give, by the same tokenizer in one pass, so that neither ids nor bytes
    go back to the JVM.  Nulls, empties, repeats and other columns as in ``encode``; a text of any length is encoded whole.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = tokenizer(path, pattern)
        ids, at = model.encode(pc.fill_null(batch.column(1), "").to_pylist())
        data, upto = model.decode(ids)
        raw, data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), memoryview(np.ascontiguousarray(data))
        sums = [[hashlib.sha256(m[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] for m, cut in ((raw, 4 * at), (data, upto[at]))]
        return pa.record_batch([batch.column(0), pa.array(np.diff(at), pa.int64()), *(pa.array(x, pa.string()) for x in sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_text(given, kernel, common.keyed(given, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
