"""What the operators of this subpackage share: reading tables, the shared folder, vectorised byte work."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import forget_at_exit, materialise, shared_dir  # noqa: F401

#: ASCII white space as the contracts define it: \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to or comes from a Python worker, unless the session sets a limit below it.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in bounded memory: batches are limited by bytes, and a worker gives memory back after each task."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(frugal, schema)


def _bytes(value: str) -> int:
    number = value.strip().lower().rstrip("b")
    return int(float(number.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(number[-1:], 1))


def give_back() -> None:
    """Return freed memory of this process to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of input for a bucket of a stored table, and the most buckets that Spark allows.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 100_000


def bucket_count(df: DataFrame) -> int:
    """How many buckets a copy of df needs: as many as shuffles have partitions, more if Spark's estimate of its size asks for them."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(least, size // BUCKET_BYTES), MOST_BUCKETS) if size < 1 << 60 else least  # beyond that it is unknown


def stored_table(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df in the shared folder, in buckets by a key, so that later joins and groups by it leave the rows where they are."""
    spark, name = df.sparkSession, f"silsila_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{name}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    forget_at_exit(spark, path)
    atexit.register(_drop, spark, name)
    out = spark.table(name)
    out.stored_as = name, path
    return out


def _drop(spark: SparkSession, name: str) -> None:
    """Take a table's name out of the catalogue, if the session still runs; its files go with the driver."""
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def release(stored: DataFrame) -> None:
    """Remove a stored table of which nothing unwritten needs the rows any more."""
    spark, (name, path) = stored.sparkSession, stored.stored_as
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def utf8(col: str) -> Column:
    """The column's UTF-8 bytes; null stays null."""
    return F.col(col).cast("binary")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(batch: pa.RecordBatch, col: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose binary column holds about `limit` bytes, one row at least; a longer row stands alone."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(batch: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end as uint8, and the n+1 row offsets; null counts as empty."""
    values = [v if v is not None else b"" for v in batch.column(batch.schema.get_field_index(col)).to_pylist()]
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return np.frombuffer(b"".join(values), np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = -(-n // 65536) * 65536
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            have = 1
            while have < size:
                more = min(have, size - have)
                p[have : have + more] = p[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n+1 entries). Words never cross rows."""
    n = len(data)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~white
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[edge[:n]] = False
        after[edge[1:]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, by differences of one running polynomial sum."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
