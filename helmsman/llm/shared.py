"""Helpers shared by the corpus operators: written intermediate tables,
bounded slices of Arrow text columns, and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsman.session import checkpoint_root, sf_path

U64 = np.uint64
SLICE_BYTES = 1 << 20  # text bytes a task holds in numpy arrays at once (a longer text is a slice of its own)
BATCH_BYTES = 4 << 20  # bytes of an Arrow batch between Spark and a Python worker (a larger row is a batch of its own)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's tasks in bytes, unless the session
    sets a bound itself; otherwise 10,000 long texts could make one batch."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in
    the lineage that survives the loss of any executor.  The shuffle files of the write
    go with it, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    bounded_batches(spark)
    path, before = run_folder(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once whatever reads them is written itself."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(sf_path(sf_dir, "documents"))


def column_bytes(df: DataFrame, *names: str) -> int:
    """Bytes of the named columns over all rows (one partial aggregate a task)."""
    size = sum((F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) + 8 for n in names), F.lit(0))
    return int(df.agg(F.sum(size.cast("long"))).first()[0] or 0)


BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size is within ``limit``;
    otherwise as it is, for a shuffled join (AQE splits skewed partitions).
    ``df`` should be a written table, since it is measured first."""
    return F.broadcast(df) if column_bytes(df, *df.columns) <= limit else df


# --- Arrow text columns ------------------------------------------------------

def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts hold about ``limit`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def lower_table(separators: bytes) -> np.ndarray:
    """Byte table: A-Z to a-z, separators to 0, everything else unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
SPACED = lower_table(bytes([0, *WHITESPACE]))  # words [^\x20\x09-\x0D]+; see split_words for NUL
ALNUM = lower_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def split_words(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, bounds): the mapped bytes with a 0 after each row,
    the byte span of each word, and for row r its words bounds[r]:bounds[r+1]."""
    mapped = table[raw]
    nul = raw == 0
    if table[1] == 1 and nul.any():  # a NUL is no separator here: give it a byte that UTF-8 never uses
        mapped[nul] = 0xFF
    buf = np.insert(mapped, off[1:], 0)
    inside = buf != 0
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.searchsorted(starts, off + np.arange(len(off)))
    return buf, starts, ends, bounds


_P = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for key, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            powers = np.full(size, base, U64)
            powers[0] = 1
            _powers[key] = np.cumprod(powers, dtype=U64)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: differences of one running polynomial."""
    p, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of several aligned hash arrays, in their order."""
    out = mix(parts[0] + U64(len(parts)))
    for part in parts[1:]:
        out = mix(out * U64(0xD6E8FEB86659FD93) + part)
    return out
