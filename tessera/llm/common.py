"""What the operators share: reading the tables, tables in the shared folder, rank and running sums by doc_id."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one block of ids; sums over blocks are a small table.
BLOCK = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_OWN: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, in the session or in the context's settings. Where none is named, one of
    our own, and only with a local master: its executors share the machine's disk."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or _OWN.get(context.applicationId)
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and no step runs twice."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.parquet(path)
    return stored(spark, path, df.schema)


def stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of the shared folder, which ``forget`` and ``clear`` can delete."""
    found = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    _PATHS[found] = path
    _LEFT.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return found


_LEFT: dict[str, set[str]] = {}


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of ``kept`` that nothing reads any more."""
    for table in tables:
        if table is not None and table in _PATHS:
            _delete(table.sparkSession, _PATHS.pop(table))


def settled(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What ``make`` gives, as a table of ``kept``; all other tables that were written for it are deleted."""
    before = set(_LEFT.get(spark.sparkContext.applicationId, ()))
    table = kept(make(), what)
    for path in _LEFT[spark.sparkContext.applicationId] - before - {_PATHS[table]}:
        _delete(spark, path)
    release(spark)
    return table


def clear(spark: SparkSession) -> None:
    """Deletes all tables of ``kept`` that are left, for callers who have written or read the operators' results."""
    for path in list(_LEFT.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    _LEFT.get(spark.sparkContext.applicationId, set()).discard(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def make_room(spark: SparkSession) -> None:
    """Lets executors collect their garbage and give free heap back to the system, before a step whose Python workers need that
    memory: a heap stays as large as the steps before made it. As many tasks as there are cores reach every idle executor."""
    cores = spark.sparkContext.defaultParallelism
    collected = spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')").alias("done"))
    collected.write.format("noop").mode("overwrite").save()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns only."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that tasks can import it there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{top.name}", "zip", top.parent, top.name))
        _SHIPPED.add(app)


#: Bytes of a batch that a function of a batch gets at once, if that is more than a row.
PIECE = 4_000_000


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator]], schema: T.StructType | str, piece: int = PIECE) -> DataFrame:
    """mapInArrow with set-up once per task. ``make`` returns the function of a batch, which gets pieces of a bounded size, so
    what it makes of them stays small; at its end a task gives its worker's free memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            step = max(1, batch.num_rows * piece // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                out = f(batch.slice(at, step))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        _trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


_HELD: dict[str, dict] = {}


def held(what: str, key, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: ``make``'s object for ``key``. Only one operator's objects are kept, so a worker
    that goes on to another step does not hold the models of the one before."""
    if what not in _HELD:
        _drop()
    mine = _HELD.setdefault(what, {})
    if key not in mine:
        mine.clear()
        mine[key] = make()
    return mine[key]


def _drop() -> None:
    """Gives the memory of what is held back to the system."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(values: list, limit: int = 1_000_000) -> Iterator[slice]:
    """Slices of a batch of texts that hold about ``limit`` characters at most (one text at least), so memory stays bounded."""
    a = n = 0
    for k, v in enumerate(values):
        if k > a and n + len(v) > limit:
            yield slice(a, k)
            a, n = k, 0
        n += len(v)
    if a < len(values):
        yield slice(a, len(values))


def with_block(df: DataFrame, size: int = BLOCK) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col("doc_id") / size).cast("long"))


def running_start(df: DataFrame, value: str, out: str, *ties: str) -> DataFrame:
    """out: the sum of ``value`` over all rows before this one by ascending doc_id (then ``ties``; null ids first).

    Blocks of ids are summed first; only their sums, a thousandth of the rows, are put in order in one place.
    """
    blocked = with_block(df)
    sums = blocked.groupBy("__block").agg(F.sum(value).alias("__sum"))
    w = Window.orderBy(F.col("__block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy("doc_id", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums, F.col("__block").eqNullSafe(F.col("__b")), "left")
        .withColumn(out, (F.col("__before") + F.col("__in")).cast("long"))
        .drop("__block", "__b", "__in", "__before")
    )


def held_out(buckets: int, which: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets == which
