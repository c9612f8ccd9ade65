"""What the operators of this package share: Arrow helpers, scratch tables and labelled samples."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word is a run of characters other than ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def binary_cells(column: pa.Array) -> list[bytes | None]:
    """Cells of a string column as UTF-8 bytes, without decoding them. ``bytes.split`` and ``bytes.lower`` then know
    exactly the white space and the capitals that the contracts name."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, after which the worker gives its free memory back: it outlives its task, and others share its machine."""
    return partial(_tidied, f)


def _tidied(f, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from f(batches)
    finally:
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where none is named, a local session gets a folder of its
    own, and a cluster an error: a machine's folder would be lost with the machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tallyforge-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def named(column: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for no column to have them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def plain(df: DataFrame, *keep: str) -> DataFrame:
    """df with columns c0, c1 and so on, but for those to keep: no name of a caller's then clashes with one made here, or is one that
    Spark cannot hand to an Arrow function. ``toDF`` gives the names back."""
    return df.toDF(*(c if c in keep else f"c{i}" for i, c in enumerate(df.columns)))


def hashable(df: DataFrame) -> list[Column]:
    """Columns that Spark can hash and order: all but those with maps or variants in them."""
    return [named(f.name) for f in df.schema if not re.search(r"\b(map<|variant)", f.dataType.simpleString())]


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, emptied at exit."""
    path = f"{scratch_dir(spark)}/tallyforge-{uuid.uuid4().hex}"
    _sweep_at_exit(spark, path)
    return path


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Computes df once, into the shared folder, and cuts its lineage there. Readers survive the loss of any executor."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for df, which nothing will read again."""
    place = (df.sparkSession, df.stored_at)
    _delete(*place)
    _to_sweep.remove(place)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_to_sweep: list[tuple[SparkSession, str]] = []


def _sweep_at_exit(spark: SparkSession, path: str) -> None:
    if not _to_sweep:
        import atexit

        atexit.register(_sweep)
    _to_sweep.append((spark, path))


def _sweep() -> None:
    for spark, path in _to_sweep:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder is the cluster's to empty
            return


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by. A null id has remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by, F.lit(0))


def smallest_hashed(df: DataFrame, key: list[str], by: str, n: int, seed: int) -> DataFrame:
    """(by, key): at most n different keys for each value of ``by``, those whose hash is smallest: a sample that does not depend on
    how rows are dealt out, nor on how often a key is there. Tasks take their own n before they meet, so what is shuffled is the
    keys once and then n a value and task."""
    rank, = unused([by, *key], "rank")
    order = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return df.select(by, *key).distinct().withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n).drop(rank)


def one_label(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label) for each doc_id that has a label; of labels that disagree the smallest."""
    known = labels.select("doc_id", F.col(label).cast("int").alias(label)).filter(f"doc_id is not null and {label} is not null")
    return known.groupBy("doc_id").agg(F.min(label).alias(label))


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first n_keys columns, across batches, from a partition sorted by those columns."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != last:
                if rows:
                    yield last, rows
                last, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield last, rows
