"""What the operators share: shipping the package, cutting lineage, blocks for searches."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.sources.shipping import ship  # noqa: F401  (the operators take it from here)

COLLECT = 4
_computed = itertools.count(1)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: what the cluster names in spark.checkpoint.dir; a temporary one only where the master is this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def collect_garbage(spark: SparkSession) -> None:
    """Called for each table that has been computed; at every COLLECT-th the driver's garbage is collected.

    Plans of such tables are large, and Spark gives up their shuffles and broadcasts only then; otherwise the driver's heap
    grows to its limit with the number of tables.
    """
    if next(_computed) % COLLECT == 0:
        gc.collect()  # else Python's own references keep plans alive
        spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the session's checkpoint folder.

    Partitions keep their numbers, so later jobs see one answer even if an executor is lost.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    collect_garbage(df.sparkSession)
    return out


class Scratch:
    """Tables of one operator in the shared folder: written once, read by the columns that are asked for. remove() once nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of df, computed once. Unlike a checkpoint, the table brings none of its plan's constraints along, which grow in loops."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        collect_garbage(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def wide_hash(column) -> F.Column:
    """128 bits that stand for a string; null for null."""
    return F.unhex(F.md5(column))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores put before it as it takes to differ from every column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """An Arrow list column of equal lengths as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(n, len(values) // n if n else 0)


def release() -> None:
    """What this process has freed goes back to the system, as far as its C library can do that; else it stays with idle workers beside the next tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, a few at a time: a batch may hold ten thousand texts, of which only so many become Python's."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b  # before the next one is read
        release()


def usable(vector, *, zero_too: bool) -> F.Column:
    """True for a vector that has components, none null and all finite (and, unless zero_too, one that is not 0)."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero_too:
        ok = ok & F.exists(wide, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def moments(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """dimension -> (rows, sum, sum of outer products) over all rows of vectors(vector array<double>).

    Each task adds up its own rows; 64 reducers add up the tasks; the driver gets at most 64 times
    (d + d * d) numbers for each dimension, however many rows there are.
    """
    schema = "dim int, salt int, n long, total binary"

    def task_sums(batches):
        from pyspark import TaskContext

        sums: dict[int, list] = {}
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                x = matrix(batch.column(0).filter(pa.array(lengths == d)), np.float64)
                add = np.concatenate([x.sum(0)[None], x.T @ x])
                old = sums.setdefault(int(d), [0, np.zeros_like(add)])
                old[0], old[1] = old[0] + len(x), old[1] + add
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array([*sums], pa.int32()), pa.array([salt] * len(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tobytes() for _, t in sums.values()], pa.binary())],
            names=["dim", "salt", "n", "total"],
        )

    def merged(key, tables):
        n, total = 0, 0
        for t in tables:
            for k, b in zip(t.column("n").to_pylist(), t.column("total").to_pylist()):
                n, total = n + k, total + np.frombuffer(b)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["dim", "salt", "n", "total"])

    import pyarrow.compute  # noqa: F401

    out: dict[int, tuple] = {}
    for r in columns(vectors, "vector").mapInArrow(task_sums, schema).groupBy("dim", "salt").applyInArrow(lambda key, t: _once(merged(key, [t])), schema).collect():
        both = np.frombuffer(r.total).reshape(r.dim + 1, r.dim)
        n, s, g = out.get(r.dim, (0, 0, 0))
        out[r.dim] = (n + r.n, s + both[0], g + both[1:])
    return out


def _once(batches) -> pa.Table:
    return pa.Table.from_batches(batches)


def blocks(n: int, most: int, spark: SparkSession, *, least: int = 512) -> int:
    """Into how many blocks n rows go: at most `most` rows each, more blocks while cores would idle and blocks stay over `least` rows."""
    return max(1, -(-n // most), min(n // least, 2 * spark.sparkContext.defaultParallelism))


def small(df: DataFrame, megabytes: int = 10) -> DataFrame:
    """df, marked for broadcast if its rows hold at most so many bytes (df must be cheap to read: a checkpoint); else as it is, for a shuffled join."""
    return F.broadcast(df) if held_bytes(df) <= megabytes << 20 else df


def held_bytes(df: DataFrame) -> int:
    """Bytes of the rows of df: eight a fixed-size column, and what strings, binaries and arrays hold."""
    width = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        held = F.octet_length(c) if kind in ("string", "binary") else 8 * F.greatest(F.size(c), F.lit(0)) if kind in ("array", "map") else F.lit(0)
        width = width + 8 + F.coalesce(held, F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
