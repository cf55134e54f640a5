"""Exact deduplication against an immutable snapshot, screened by static binary-fuse filters.

1. One pass over the texts takes the SHA-256 of each normalised text (A-Z lower-cased, null as empty).
   Only digests travel from here on.
2. Digests of the snapshot and of the new batch are grouped, each by itself, with partial aggregation,
   so a group of copies that holds a third of all rows is one row before anything is dealt by digest.
3. The snapshot's distinct digests are dealt to shards of about ``SHARD_KEYS`` keys, and every shard is
   compiled to a 3-wise binary fuse filter with 8-bit fingerprints (about 9 bits a key, false positives
   about 1 in 256).  The snapshot never changes: its groups and filters are tables that ``store_snapshot`` writes once
   and ``open_snapshot`` opens for every later batch.
4. The batch's distinct digests are screened: where the filters' counted size allows, on the rows as they lie, else
   shard by shard.  Negatives are new for certain and meet nothing.  Positives join the exact bucket of the snapshot and
   compare the normalised texts byte by byte; only texts of positives are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common

#: Keys of a filter; the number of shards follows the snapshot.
SHARD_KEYS = 4096
#: Bytes of filters, and digests or ids, that are sent to every executor; beyond that they meet in a shuffle.
FILTER_BYTES, BROADCAST_DIGESTS = 64 << 20, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _slots(keys: np.ndarray, seed, length, count) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments and the fingerprint of each key; the parameters are numbers or one for each key."""
    seed, length, count = (np.asarray(v, dtype=np.uint64) for v in (seed, length, count))
    with np.errstate(over="ignore"):
        h = common.mix64(keys + seed * np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * (count * length)) >> np.uint64(32)
    mask = length - np.uint64(1)
    second = (first + length) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2) * length) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)


@dataclass
class FuseFilter:
    """A static filter: no false negatives; built once from distinct 64-bit keys."""

    seed: int
    length: int
    count: int
    table: bytes

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        if n == 0:
            return cls(0, 4, 1, b"")
        length = int(min(1 << 18, 2 ** int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        size = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        count = max(1, int(np.ceil(size / length)) - 2)
        for seed in range(1, 200):
            order = cls._peel(slots := _slots(keys, seed, length, count)[0], (count + 2) * length)
            if order is not None:
                break
            count += seed % 8 == 0
        else:
            raise ValueError("no seed gives a peelable filter")
        prints, table = _slots(keys, seed, length, count)[1], np.zeros((count + 2) * length, np.uint8)
        for who, where in reversed(order):
            a, b, c = slots[:, who]
            table[where] = 0
            table[where] = prints[who] ^ table[a] ^ table[b] ^ table[c]
        return cls(seed, length, count, table.tobytes())

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot that only that key still uses); None where a core remains."""
        n = slots.shape[1]
        uses = np.bincount(slots.ravel(), minlength=size)
        names = np.bincount(slots.ravel(), weights=np.tile(np.arange(n, dtype=float), 3), minlength=size)
        left, rounds = n, []
        while left:
            alone = np.flatnonzero(uses == 1)
            if not len(alone):
                return None
            who, at = np.unique(np.rint(names[alone]).astype(np.int64), return_index=True)
            rounds.append((who, alone[at]))
            gone = slots[:, who].ravel()
            uses -= np.bincount(gone, minlength=size)
            names -= np.bincount(gone, weights=np.tile(who.astype(float), 3), minlength=size)
            left -= len(who)
        return rounds

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if not self.table:
            return np.zeros(len(keys), bool)
        table = np.frombuffer(self.table, np.uint8)
        (a, b, c), prints = _slots(np.asarray(keys, dtype=np.uint64), self.seed, self.length, self.count)
        return (table[a] ^ table[b] ^ table[c]) == prints


class Bank:
    """The filters of all shards as arrays, probed for keys of any shards at once."""

    def __init__(self, rows: list):
        """From rows (shard, seed, length, count, bits); a shard without a row holds nothing."""
        many = max((r[0] for r in rows), default=-1) + 1
        self.seed, self.length, self.count, self.start = (np.zeros(many, np.int64) for _ in range(4))
        self.length[:] = 1
        at = 0
        for shard, seed, length, count, bits in rows:
            self.seed[shard], self.length[shard], self.count[shard], self.start[shard] = seed, length, count, at
            at += len(bits)
        self.table = np.frombuffer(b"".join(bytes(r[4]) for r in rows), np.uint8)

    def may_hold(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        mine = np.flatnonzero(shards < len(self.count))
        mine = mine[self.count[shards[mine]] > 0]
        s = shards[mine]
        slots, prints = _slots(np.asarray(keys[mine], dtype=np.uint64), self.seed[s], self.length[s], self.count[s])
        a, b, c = (self.table[x + self.start[s]] for x in slots)
        out[mine] = (a ^ b ^ c) == prints
        return out


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[8:16] for d in digests), dtype="<u8")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, digest): the SHA-256 of the normalised text of every row, written to the shared folder."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = [hashlib.sha256(t.lower()).digest() for t in common.utf8(batch.column(1))]
        return pa.record_batch([batch.column(2), batch.column(0), pa.array(sums, pa.binary())], names=["row", "doc_id", "digest"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return common.written(common.map_text(given, kernel, "row long, doc_id long, digest binary"), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: its size and the (doc_id, row) that stays, the largest doc_id."""
    return rows.groupBy("digest").agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "row")).alias("stays"))


def _shard(digest: str, shards: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(digest)), F.lit(shards)).cast("int")


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, length, count, bits): the filters of a snapshot's distinct digests; a table to keep."""

    def build(shard: tuple, part: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(_keys(part["digest"]))
        return pd.DataFrame({"shard": [shard[0]], "seed": [f.seed], "length": [f.length], "count": [f.count], "bits": [f.table]})

    return snapshot.select(_shard("digest", shards).alias("shard"), "digest").groupBy("shard").applyInPandas(build, "shard int, seed int, length int, count int, bits binary")


@dataclass
class Snapshot:
    """What is kept of an immutable set of rows: (row, doc_id, digest), groups (digest, size, stays) and filters by shard."""

    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    shards: int


def store_snapshot(rows: DataFrame, path: str) -> Snapshot:
    """Write the rows (row, doc_id, digest) of a snapshot, their groups and filters under ``path``, once."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    grouped(rows).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    shards = max(1, -(-groups.count() // SHARD_KEYS))
    build_filters(groups, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
    return open_snapshot(spark, path)


def open_snapshot(spark, path: str) -> Snapshot:
    filters = spark.read.parquet(f"{path}/filters")
    shards = filters.agg(F.max("shards")).first()[0] or 1
    return Snapshot(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/groups"), filters.drop("shards"), shards)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(digest): those of the batch's distinct digests that the snapshot may hold.

    Filters of up to FILTER_BYTES, a counted size, go to every executor and digests are probed where they lie.  Larger
    ones have so many shards that a shard of a batch is small; batch and filters then meet shard by shard.
    """
    dealt = batch.select(_shard("digest", snapshot.shards).alias("shard"), "digest")
    size = snapshot.filters.agg(F.sum(F.length("bits") + 32)).first()[0] or 0
    if size <= FILTER_BYTES:
        rows = [(r["shard"], r["seed"], r["length"], r["count"], bytes(r["bits"])) for r in snapshot.filters.collect() if r["bits"]]
        sent = batch.sparkSession.sparkContext.broadcast(Bank(rows))

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                maybe = sent.value.may_hold(_keys(part.column(1).to_pylist()), np.asarray(part.column(0)))
                yield pa.record_batch([part.column(1).filter(pa.array(maybe))], names=["digest"])

        return common.in_batches(dealt).mapInArrow(here, "digest binary")

    def probe(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(part), bool)
        if len(found) and len(part):
            f = found.iloc[0]
            maybe = FuseFilter(int(f["seed"]), int(f["length"]), int(f["count"]), bytes(f["bits"])).may_hold(_keys(part["digest"]))
        return part.loc[maybe, ["digest"]]

    return dealt.groupBy("shard").cogroup(snapshot.filters.groupBy("shard")).applyInPandas(probe, "digest binary")


def _few(rows: DataFrame) -> DataFrame:
    """Rows of a digest or an id, for every executor where a count says that they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_DIGESTS else rows


def byte_checked(named: DataFrame, ends: DataFrame) -> DataFrame:
    """(digest): those whose rows ``ends`` (digest, doc_id) have the same normalised bytes.

    A row is found by its id, one without an id by its digest, so that rows without ids do not meet each other.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER).cast("binary")
    given = named.select("doc_id", text.alias("bytes"))
    key = lambda digest: F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("d"), digest)).alias("key")
    wanted = common.written(ends.select(key(F.lower(F.hex("digest")))).distinct(), "ends")
    found = given.withColumn("key", key(F.sha2("bytes", 256))).join(_few(wanted), "key", "left_semi")
    sums = found.select(F.unhex(F.sha2("bytes", 256)).alias("digest"), "bytes").groupBy("digest").agg((F.min("bytes") == F.max("bytes")).alias("same"))
    return sums.filter("same").select("digest")


def exact_dedup(
    docs: DataFrame, in_snapshot: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", snapshot: Snapshot | None = None,
) -> DataFrame:
    """Group equal texts of a snapshot and a new batch; of equal texts the row with the largest id stays.

    ``in_snapshot`` marks the rows of the snapshot by the column doc_id; by default it is the older half of the id range.
    ``snapshot`` is what ``store_snapshot`` kept of those rows, if it was stored before: their texts are then read for
    byte checks only.  Else it is built.
    Returns (row, doc_id, keep_id, group_size, kept, digest), a row for each row of ``docs``.

    Null texts count as empty, so all of them are one group.  A null id is below every other id and goes
    with the batch.  Of repeated rows (same id, same text) exactly one is kept.  Ids are whole numbers; a text id is an
    error or null, by the session's casts.  An empty table gives an empty result.  Other columns of ``docs`` are not
    read, so their names cannot clash.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if in_snapshot is None:
        low, high = named.agg(F.min("doc_id"), F.max("doc_id")).first()
        in_snapshot = F.col("doc_id") <= (low + high) // 2 if low is not None else F.lit(False)
    held = F.coalesce(in_snapshot, F.lit(False))
    if snapshot is None:
        rows = digest_rows(named)
        snapshot = store_snapshot(rows.filter(held), common.shared_path(docs.sparkSession, "snapshot"))
        batch = rows.filter(~held)
    else:
        batch = digest_rows(named.filter(~held))
    old, new = snapshot.groups, common.written(grouped(batch), "batch-groups")
    maybe = _few(common.written(screen(new, snapshot), "maybe"))
    # both sides of a positive; a false one has no row in the snapshot
    bucket = old.join(maybe, "digest", "left_semi").select("digest", F.col("stays.doc_id").alias("doc_id"))
    bucket = common.written(bucket, "buckets")
    twin = new.join(_few(bucket.select("digest")), "digest", "left_semi").select("digest", F.col("stays.doc_id").alias("doc_id"))
    same = _few(common.written(byte_checked(named, bucket.unionByName(twin)).join(_few(bucket.select("digest")), "digest", "left_semi"), "same"))
    stays = F.struct("stays.doc_id", "part", "stays.row").alias("stays")  # rows are numbered within a part
    both = old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1))).select("digest", F.col("size").alias("group_size"), stays, "part")
    alone = both.join(same, "digest", "left_anti")
    met = both.join(same, "digest", "left_semi").groupBy("digest").agg(F.sum("group_size").alias("group_size"), F.max("stays").alias("stays"))
    groups = alone.unionByName(met.select("digest", "group_size", "stays", F.explode(F.array(F.lit(0), F.lit(1))).alias("part")))
    rows = snapshot.rows.withColumn("part", F.lit(0)).unionByName(batch.withColumn("part", F.lit(1)))
    kept = (F.col("row") == F.col("stays.row")) & (F.col("part") == F.col("stays.part"))
    return rows.join(groups, ["digest", "part"]).select("row", "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    Nulls, repeats and empty tables as there: a null text is an empty one, and of rows that repeat an id and a text one
    stays, whatever their other columns.  A column called ``__digest``, ``__kept``, ``__sum`` or ``__gone`` is not
    allowed.
    """
    found = common.written(exact_dedup(docs, None, id_col, text_col).select("doc_id", "kept", "digest"), "dedup")
    n, ids = found.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        return common.without(docs, found.filter("NOT kept").select("doc_id"), id_col)
    kept = found.filter("kept")
    # ids repeat: the digest tells the rows of an id apart, and one of each (id, digest) stays
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    keyed = docs.withColumn("__digest", F.unhex(F.sha2(text.cast("binary"), 256)))
    kept = kept.select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__sum"))
    near = F.col(id_col).eqNullSafe(F.col("__kept")) & (F.col("__digest") == F.col("__sum"))
    return keyed.join(kept, near, "left_semi").dropDuplicates([id_col, "__digest"]).drop("__digest")


def op7(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
