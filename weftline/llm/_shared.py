"""Shared folders, written tables and file access that work from the driver and from every executor."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def give_back() -> None:
    """Hands freed memory of this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that hands freed memory back when it ends: workers live on, with what they have grown to."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on this machine only (a test) gets a temporary one; others raise."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


#: Bytes of the Arrow batches that tables are written from.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within get Arrow batches of at most BATCH_BYTES (or one row), so that long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder: it survives lost executors and cuts the lineage."""
    path = fresh_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    give_back()
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read any more, and lets Spark drop the shuffle files of finished jobs."""
    for df in tables:
        drop_folder(df.sparkSession, df._written_at)
    give_back()
    SparkSession.active()._jvm.System.gc()


#: Bits of the filter in `perhaps_listed`: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26


def perhaps_listed(df: DataFrame, key: Column, listed: DataFrame, listed_key: str) -> DataFrame:
    """The rows of df whose 64-bit key is listed, and some others: those that share a bit with a listed key. It goes before a join
    with the list, so that most other rows needn't be shuffled; what is sent to the executors has a fixed size."""
    place = lambda c: F.pmod(c, F.lit(FILTER_BITS)) + 1
    at = place(F.col(listed_key))
    maps = listed.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    columns = df.columns
    rows = df.withColumn("_at", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(maps), "_bucket")  # 2048 rows of 4 KB at most
    bit = F.bitmap_bit_position("_at")
    byte = F.ascii(F.decode(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return rows.where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*columns)


def filter_of(listed: DataFrame, key: str) -> np.ndarray:
    """One bit for each value of 64-bit keys modulo FILTER_BITS: 8 MB, whatever the number of keys."""
    at = F.pmod(F.col(key), F.lit(FILTER_BITS)) + 1
    maps = listed.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).toArrow().to_pydict()
    bits = np.zeros((FILTER_BITS // (1 << 15), 1 << 12), np.uint8)
    for b, m in zip(maps["b"], maps["m"], strict=True):
        bits[b - 1] = np.frombuffer(m, np.uint8)
    return bits.ravel()


def unused(columns: list[str], name: str) -> str:
    """name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def matching(df: DataFrame, key: tuple[Column, Column], pairs: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df, with all their columns whatever their names, whose (id, hash) is (left_anti: is not) among the rows (i, h) of
    pairs; a null id equals a null id, a null hash a null hash."""
    rows = df.select(F.struct(F.struct(*df.columns).alias("row"), key[0].alias("i"), key[1].alias("h")).alias("of"))
    return rows.join(pairs, F.col("of.i").eqNullSafe(pairs["i"]) & F.col("of.h").eqNullSafe(pairs["h"]), how).select("of.row.*")


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, which stand together, as one table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(c)) for c in keys]
        new = np.zeros(len(batch) - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables of so many rows or more, each of which holds all rows of the keys in it; rows of equal keys must stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(len(table), bool)
        for c in keys:
            column = table[c].to_numpy()
            last &= column == column[-1]
        cut = len(table) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one, by Spark's own file system classes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def drop_work(spark: SparkSession) -> None:
    """Deletes every table and file that the operators of this subpackage have left in the shared folder."""
    drop_folder(spark, f"{shared_dir(spark)}/weftline")


def _place(uri: str):
    """(file system or None for local files, path)."""
    if uri.startswith("file:"):
        return None, "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return None, uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def open_new(uri: str) -> Iterator[IO[bytes]]:
    """Writes a file under a temporary name that gets its own when all is written: a task that dies leaves no half file."""
    system, path = _place(uri)
    half = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    if system is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(half, "wb") as out:
                yield out
            os.replace(half, path)
        except BaseException:
            if os.path.exists(half):
                os.remove(half)
            raise
    else:
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(half) as out:
            yield out
        system.move(half, path)


@contextmanager
def open_old(uri: str) -> Iterator[IO[bytes]]:
    """Opens a file for reading with seek."""
    system, path = _place(uri)
    with open(path, "rb") if system is None else system.open_input_file(path) as f:
        yield f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
