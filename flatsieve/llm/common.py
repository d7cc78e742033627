"""Shared plumbing of the training-data operators: shared scratch tables and Arrow batch walking."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python operator works on at a time; a longer text makes a step of its own.
STEP_BYTES = 4_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root is None:
        held = getattr(scratch_root, "own", None)
        if held is None:
            held = scratch_root.own = "file://" + tempfile.mkdtemp(prefix="flatsieve-scratch-")
            atexit.register(lambda: __import__("shutil").rmtree(held[7:], ignore_errors=True))
        root = held
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a context, so that their Python finds it wherever they run."""
    sc = spark.sparkContext
    if getattr(ship, "to", None) is sc:
        return
    ship.to = sc
    top = Path(__file__).resolve().parents[1]
    if not top.is_dir():  # already imported from an archive
        return
    with tempfile.NamedTemporaryFile(prefix=f"{top.name}-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(f.name)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark hands Python operators batches of about STEP_BYTES, unless the session has a bound of its own.

    By default a batch has 10,000 rows or 64 MB, for which each task of an executor holds up to three times that outside the heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(STEP_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the shuffle files of an action go when it ends, unless the session has a setting of its own.

    By default they stay until the driver collects its garbage, so that on large tables those of several steps lie on the disks at once.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name)


class Scratch:
    """Tables written to the shared scratch folder, so that a lost executor loses none of them.

    A table is removed by ``drop``, or when the driver's interpreter ends, as results that were
    handed out may still read it until then.
    """

    #: Those whose tables haven't been removed, in the order of their making.
    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        Scratch.opened.append(self)
        self.spark, self.path = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.written: set[str] = set()
        atexit.register(self._close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:6]}"
        with bounded_batches(self.spark), shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.written.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, t._scratch_path)
            self.written.discard(t._scratch_path)

    def drop_but(self, *tables: DataFrame) -> None:
        """Removes all its other tables."""
        for path in self.written - {t._scratch_path for t in tables}:
            _remove(self.spark, path)
            self.written.discard(path)

    def close(self) -> None:
        """Removes all its tables; nothing may read them any more."""
        if self in Scratch.opened:
            Scratch.opened.remove(self)
            self._close()
            atexit.unregister(self._close)

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _remove(self.spark, self.path)
        except Exception:  # the JVM may be gone by then  # noqa: BLE001
            pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of the ``text`` column each, so that memory doesn't follow batch size."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        sizes = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        total, start = 0, 0
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths.tolist()):
            total += n
            if total >= limit:
                yield b.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def _give_back() -> None:
    """Memory that this process has freed and still holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def eased(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function of ``mapInArrow``, that gives back its memory at its end, as Spark keeps Python workers for the next task or stage."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return f


def map_steps(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, text: str = "text", limit: int = STEP_BYTES) -> DataFrame:
    """``mapInArrow`` whose per-task function ``make()`` turns columns (name to list) of a bounded step into columns."""

    def run(batches):

        f = make()
        for b in steps(batches, text, limit):
            out = f(b.to_pydict())
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((out[n] for n in names), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    parsed = StructType.fromDDL(schema)
    names, types = parsed.names, [to_arrow_type(x.dataType) for x in parsed.fields]
    return df.mapInArrow(eased(run), parsed)


#: Narrow rows up to which a join may broadcast them; beyond, it shuffles both sides.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, with the hint to broadcast it if it is within BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(df: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` less the rows whose (key, xxhash64 of text) is in ``rows`` (key, whole), a written table; all columns stay as they are."""
    rows = rows.withColumnsRenamed({key: "__fs_key", "whole": "__fs_whole"})
    return df.join(small(rows), df[key].eqNullSafe(rows["__fs_key"]) & (F.xxhash64(df[text]) == rows["__fs_whole"]), "left_anti")


def held_out(remainder: int, modulus: int, key: str = "doc_id"):
    """True where crc32 of the key as text leaves ``remainder``, false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def prefix_sums(df: DataFrame, order: list[str], size: str, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``start`` (sum of ``size`` over the rows before it in ``order``), ``index`` (their number) and ``total``.

    Range partitions add up their own rows in a stream; the partitions' totals, a row for each
    partition, give the offsets. ``df`` should be a written table of a few narrow columns, as the
    range partitioning samples it first. Reads ``df`` twice and writes it once.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def placed(batches):
        import numpy as np
        from pyspark import TaskContext

        part, at, n = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            cols = [*b.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends - sizes), pa.array(np.arange(n, n + len(sizes), dtype=np.int64))]
            at, n = at + (int(ends[-1]) if len(sizes) else 0), n + len(sizes)
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "_part", "_before", "_rows"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    held = scratch.write(dealt.mapInArrow(placed, f"{kinds}_part int, _before long, _rows long"), name)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    totals = held.groupBy("_part").agg(F.sum(size).alias("b"), F.count("*").alias("n"))
    offsets = totals.select("_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.sum("b").over(W.partitionBy()).alias("total"))
    at = held.join(F.broadcast(offsets), "_part")
    return at.select(*df.columns, (F.col("_b") + F.col("_before")).alias("start"), (F.col("_n") + F.col("_rows")).alias("index"), "total")
