"""Helpers shared by the corpus operators: scratch tables, row keys and word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="docmill-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Where the session sets no bytes of an Arrow batch: these. Ten thousand rows of long texts, the limit that Spark has by itself, fill a task's memory.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session now bounds Arrow batches. All operators that hand texts to Python begin with it, so none depends on what ran before."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES[0], None) is None:
        conf.set(*BATCH_BYTES)
    return df


def stored(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, gives true sizes, survives lost executors.

    group_rows: rows of a Parquet row group, for tables of large rows. Spark's reader decodes up to 4,096 rows of a row group at once, which are gigabytes where
    a row holds a megabyte."""
    spark = bounded(df).sparkSession
    path = f"{scratch_dir(spark)}/docmill-{label}-{uuid.uuid4().hex}"
    writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Key columns of a row, see row_key().
KEY = ("__no", "__rid", "__th")
#: The same as columns of Arrow batches.
KEY_ARROW = [("no", pa.bool_()), ("rid", pa.int64()), ("th", pa.int64())]


def named(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key() -> list[Column]:
    """Key of a row: whether it lacks an id, its id, a 64-bit hash of its text. Without an id a second 64-bit hash of the text stands
    for it, so unlike texts share a key only where both hashes agree, and repeated ids stay apart by their texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    no, rid, th = KEY
    return [F.col("doc_id").isNull().alias(no), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), text)).alias(rid), F.xxhash64(text).alias(th)]


def keyed(docs: DataFrame) -> DataFrame:
    """The key, doc_id and text of each row."""
    return bounded(docs).select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The key, all columns of docs as one struct (__row), and more: so no name of theirs meets one of ours. unpacked() undoes it."""
    return bounded(docs).select(*row_key(), *more, F.struct(*map(named, docs.columns)).alias("__row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("__row.*")


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces_of(text: pa.Array, most: int):
    """(first, rows) of pieces of an array of texts that hold about ``most`` bytes; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, stop - at
        at = stop


def by_bytes(b: pa.RecordBatch, text: int, most: int = 8 << 20):
    """The batch in pieces_of() its texts, column number text."""
    for first, rows in pieces_of(b.column(text), most):
        yield b.slice(first, rows)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sliced(out: pa.RecordBatch, rows: int = 200_000):
    """Pieces of a large batch, so that the JVM side holds a bounded one."""
    for i in range(0, out.num_rows, rows):
        yield out.slice(i, rows)


def concat_positions(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 within each group of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def to_ranges(schema: pa.Schema, kind: int, key: np.ndarray, bits: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Elements dealt into 2**bits ranges of an unsigned 64-bit key: one row a range, (kind, range, an array for each column).
    Far smaller to shuffle than a row for each element."""
    of = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    of = of[order]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(of)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order], type=f.type.value_type)) for c, f in zip(columns, list(schema)[2:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), kind), pa.int32()), pa.array(of[starts], pa.int64()), *lists], schema=schema)


def by_range(batches):
    """Rows of to_ranges, sorted by kind and range, gathered again: (kind, arrays) of one range at a time."""
    open_key, parts = None, []
    for b in batches:
        kind, of = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in b.columns[2:]]
        offsets = [c.offsets.to_numpy() for c in lists]
        values = [c.values.to_numpy(zero_copy_only=False) for c in lists]
        edges = np.append(np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]))), len(of)) if len(of) else [0]
        for i, j in zip(edges[:-1], edges[1:]):
            if open_key != (kind[i], of[i]):
                if parts:
                    yield open_key[0], [np.concatenate(p) for p in zip(*parts)]
                open_key, parts = (kind[i], of[i]), []
            parts.append([v[o[i] : o[j]] for v, o in zip(values, offsets)])
    if parts:
        yield open_key[0], [np.concatenate(p) for p in zip(*parts)]


def range_bits(spark: SparkSession, least: int = 12) -> int:
    """Ranges enough for 16 to each shuffle partition, so that one stays a small part of a task."""
    return max(least, (16 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
