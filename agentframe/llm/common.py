"""Helpers the operators share: scratch tables, Arrow text buffers, vectorised hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: The largest slice of text, in bytes, whose numpy temporaries are alive at once.
SLICE_BYTES = 2 << 20
SPACES = b" \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a session within one machine may do without the setting: it then gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="agentframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def long_rows(most: int) -> dict[str, object]:
    """Options for materialise of rows of megabytes: row groups of so many rows at most. Otherwise a writer looks at its size after 100 rows first, and writers and readers hold a row group whole."""
    return {"parquet.block.row.count.limit": most, "parquet.page.size.row.check.min": 1}


def materialise(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends, a lost executor costs nothing. options are the writer's."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/agentframe/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise wrote and that nothing reads any more."""
    for table in tables:
        hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = hadoop(name)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """name as Spark takes it whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str = "") -> DataFrame:
    """df.mapInArrow(run) for a run that yields df's columns, in order, and the added ones (DDL). The columns pass under numbers, so their names may hold dots, blanks or ticks."""
    own = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])
    more = StructType.fromDDL(added) if added else StructType()
    out = df.toDF(*own.names).mapInArrow(run, StructType([*own.fields, *more.fields]))
    return out.toDF(*df.columns, *more.names)


def without(df: DataFrame, *added: str) -> DataFrame:
    """df without the columns that an operator is about to add, whatever their case: the operator's own take their place."""
    names = {a.lower() for a in added}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most limit bytes each, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER_VALUES = BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = BYTE_VALUES[97:123]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text (runs without ASCII white space), and the first word index of each text."""
    n = len(data)
    word = ~_IS_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER_VALUES[data] * powers(_ODD, len(data)), out=total[1:])
    back = powers(_INV, len(data))
    return mix64((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word shingles and the text each belongs to; a text of fewer words is one shingle, one without words none."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][owner]
    length = np.minimum(counts[owner], width)
    out = length.astype(np.uint64) * np.uint64(_ODD)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        out = np.where(k < length, mix64(out * np.uint64(0xA0761D6478BD642F) + padded[at + k]), out)
    return out, owner


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers outlive a task, and what they hold stands beside the next stage's needs."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, releasing memory at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def tidy_table(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run for applyInArrow, releasing memory after each group."""

    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release_memory()

    return tidied
