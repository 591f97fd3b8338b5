"""What the operators of this folder share: tables, Arrow batches, shared-folder checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of one call of a Python function hold this many bytes of text at most (or are one row).
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where none is named a temporary one in local mode (tests),
    else an error, as executors don't see each other's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="postlake-checkpoint-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def arrow_schema(fields: Sequence[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


_SPARK = {
    pa.int64(): T.LongType(),
    pa.int32(): T.IntegerType(),
    pa.bool_(): T.BooleanType(),
    pa.string(): T.StringType(),
    pa.float64(): T.DoubleType(),
    pa.binary(): T.BinaryType(),
    pa.list_(pa.int64()): T.ArrayType(T.LongType()),
    pa.list_(pa.int32()): T.ArrayType(T.IntegerType()),
    pa.list_(pa.float64()): T.ArrayType(T.DoubleType()),
}


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts (or lists) together stay under limit; a longer one is a range of its own."""
    size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    begin = total = 0
    for i, n in enumerate(size.to_pylist()):
        n = n or 0
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(column):
        yield begin, len(column)


#: What a Python worker may drop once it works for another module.
_DROP: list[Callable[[], None]] = []
_user = ""


def droppable(drop: Callable[[], None]) -> None:
    """Have a worker's memory of one operator dropped when another operator starts there."""
    _DROP.append(drop)


def claim(user: str) -> None:
    global _user
    if user != _user:
        for drop in _DROP:
            drop()
        _user = user


def give_back() -> None:
    """Return freed memory to the system, as workers idle beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_text(df: DataFrame, text: str, make: Callable[[], Callable[[list], Iterable[Sequence]]], fields: Sequence[tuple[str, pa.DataType]], limit: int = SLICE_BYTES, keep_text: bool = True) -> DataFrame:
    """Add columns that a Python function makes of a text column, in Arrow batches.

    make() runs once in each task and returns the function: a list of texts (null: None) to a
    list of columns (one per field). The other columns pass untouched; a column of df with the
    name of a field is replaced. Without keep_text the text column is not sent back. An empty
    table gives an empty table.
    """
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names]
    if text not in kept:
        raise ValueError(f"{text!r} must stay, or be copied first")
    back = [c for c in kept if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in back] + [T.StructField(n, _SPARK[t]) for n, t in fields])
    types = [t for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(make.__module__)
        f = make()
        for b in batches:
            for i, j in slices(b.column(text), limit):
                part = b.slice(i, j - i)
                made = f(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in back] + [pa.array(x, t) for x, t in zip(made, types, strict=True)], names=[*back, *names])
            give_back()

    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
