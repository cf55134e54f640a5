"""Helpers that the operators of this subpackage share.

The text operators read a pair (id, text) as Arrow batches.  A batch is cut into blocks of at most
``BLOCK_BYTES`` of text, so that the memory of a kernel does not grow with the number of rows in a batch.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most UTF-8 bytes of text that a kernel sees at once; a single longer text is a block of its own.
BLOCK_BYTES = 2 << 20

#: Most rows and bytes of an Arrow batch between Spark and Python.
BATCH_ROWS, BATCH_BYTES = 4000, 4 << 20

_own_dir: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary folder serves a local session, as in tests; on a cluster it is an error, as
    executors do not see the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tabulon-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the folder is the cluster's to clean
        return


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when Python ends."""
    path = f"{shared_dir(spark)}/tabulon-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back.  It goes with ``drop`` or when Python ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


#: Written tables by the identity of their DataFrame, which is held so that the identity stays its own.
_paths: dict[int, tuple[DataFrame, str]] = {}


def drop(*tables: DataFrame) -> None:
    """Delete written tables whose last reader is done, that is, has been written itself."""
    for t in tables:
        if (held := _paths.pop(id(t), None)) is not None:
            _remove(t.sparkSession, held[1])


#: Ids that are sent to every executor; beyond that they meet the rows in a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows of the ids in ``gone``; the texts stay where they are if those ids are few."""
    ids = written(gone.toDF("__gone"), "gone")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, F.col(id_col) == F.col("__gone"), "left_anti")


def blocks(batch: pa.RecordBatch, text: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each with ``limit`` bytes of text in that column or a single row."""
    column = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each text; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other, and the offset where each begins (one more than texts)."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_ROWS rows and BATCH_BYTES bytes.

    Both sides of the bridge to Python hold whole batches, so their size is memory of every task, in the executor
    as in its worker.  Lower limits of the session stay, where they are plain numbers.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(f"spark.sql.execution.arrow.{name}")).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def keyed(given: DataFrame, rest: str, name: str = "doc_id") -> T.StructType:
    """The schema of a kernel's result: the first column of ``given`` as it is, then ``rest``."""
    return T.StructType([T.StructField(name, given.schema[0].dataType), *T.StructType.fromDDL(rest).fields])


def map_text(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, limit: int = BLOCK_BYTES) -> DataFrame:
    """Apply a kernel to the blocks of a DataFrame of (id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=limit):
                yield kernel(part)
            pa.default_memory_pool().release_unused()  # workers live on; what a batch freed goes back

    return in_batches(df).mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (multiplications and xor-shifts)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(doc_id: str) -> F.Column:
    """The fold of the contracts: crc32 of the id as text, remainder 2 of 4.  A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: The white space of the word contracts: space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def runs(flags: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true flags; a run is cut where a text begins (positions ``cut``)."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    at = cut[cut < len(flags)]
    begin[at] = flags[at]
    end = flags.copy()
    end[:-1] &= ~flags[1:]
    at = cut[(cut > 0) & (cut <= len(flags))] - 1
    end[at] = flags[at]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


#: Bytes of runs that are hashed at once; the arrays take about 60 bytes for each.
HASHED = 1 << 16


def run_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[begin:end] for each run: the sum of random words, one for each (place, byte)."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    parts = np.maximum(1, -(-(ends - begins) // HASHED))
    head = np.cumsum(parts) - parts
    base = (np.arange(int(parts.sum())) - np.repeat(head, parts)) * HASHED
    start = np.repeat(begins, parts) + base
    sizes = np.minimum(np.repeat(ends, parts) - start, HASHED)
    sums = np.zeros(len(sizes), np.uint64)
    cuts = np.searchsorted(np.cumsum(sizes) // HASHED, np.arange(1, int(sizes.sum()) // HASHED + 1))
    edges = np.unique(np.concatenate([[0], cuts, [len(sizes)]]))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        n = sizes[i:j]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        inside = data[at + np.repeat(start[i:j], n)].astype(np.uint64)
        place = (at + np.repeat(base[i:j], n)).astype(np.uint64)
        with np.errstate(over="ignore"):
            sums[i:j] = np.add.reduceat(mix64((place << np.uint64(21) | inside) + np.uint64(0x9E3779B97F4A7C15)), first)
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(sums, head))
