"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters 09 to 0D.
SEPARATORS = r"[\x20\x09-\x0D]+"

_U = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). Where none is set, a temporary one serves a session whose tasks run in this
    machine's own process; on a cluster other machines wouldn't see it, so that raises an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voltaic-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, **options: object) -> DataFrame:
    """Write a table into the shared folder and read it back: compact, and it outlives any executor."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder, deleted at the end of ``intermediates`` if one is open."""
    path = f"{shared_folder(spark).rstrip('/')}/voltaic/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that operators store within, at the end. Results must be written elsewhere by then, as they are read from these."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of rows that may be broadcast.
BROADCAST_BYTES = 32 << 20


def light(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of a table (a stored one, as it is counted) take at most so many bytes in memory."""
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    one = sum(wide, F.lit(32 + 16 * len(df.columns)))
    return (df.agg(F.sum(one.cast("long"))).first()[0] or 0) <= most


def few(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is ``light``; else Spark chooses the join."""
    return F.broadcast(df) if light(df) else df


#: Longs of a Bloom filter: least and most (2 MB), whatever the number of hashes; a fuller one only lets more pass.
BLOOM_LEAST, BLOOM_MOST = 1 << 10, 1 << 18


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """The words of a Bloom filter of the one column of a stored table of distinct 64-bit hashes, with 16 bits for each, or as many as there may be."""
    (name,) = hashes.columns
    size = BLOOM_LEAST
    n = hashes.count()
    while size < BLOOM_MOST and size * 4 < n:
        size *= 2
    bit = hashes.select(F.explode(F.array(*bloom_places(F.col(name), size))).alias("b"))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63).cast("int")))
    t = bit.groupBy(F.shiftright("b", 6).alias("i")).agg(word.alias("x")).toArrow()  # of bounded size
    words = np.zeros(size, np.int64)
    words[t.column("i").to_numpy()] = t.column("x").to_numpy()
    return words


def bloom_places(h: Column, longs: int) -> list[Column]:
    """Two bits of a hash in a filter of so many longs (a power of two)."""
    most = F.lit(longs * 64 - 1).cast("long")
    return [h.bitwiseAND(most), F.shiftrightunsigned(h, 32).bitwiseAND(most)]


def bloom_has(words: np.ndarray) -> Callable[[Column], Column]:
    """A condition on a hash column, with the filter as a constant."""
    table = F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>")  # folded to a constant
    has = lambda b: F.call_function("getbit", F.get(table, F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")) == 1
    return lambda h: has(bloom_places(h, len(words))[0]) & has(bloom_places(h, len(words))[1])


def bloom_test(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same over an array."""
    h, bits = h.view(np.uint64), words.view(np.uint64)
    most = _U(len(words) * 64 - 1)
    out = np.ones(len(h), bool)
    for b in (h & most, (h >> _U(32)) & most):
        out &= (bits[(b >> _U(6)).astype(np.int64)] >> (b & _U(63)) & _U(1)) > 0
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the session, so that a batch of very long texts fits in a Python worker. Returns the table as it is."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 1_024), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, which gives freed memory back to the system when a task ends: Python workers wait for later stages, and their memory counts as the executor's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def words_of(text: str | Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SEPARATORS), "")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, null as empty."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b or b"" for b in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers, vectorised."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Powers of an odd multiplier, for hashes of words by position; words longer than this go through the slow way.
_LONGEST = 1 << 12
_POWERS = np.cumprod(np.full(_LONGEST, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if sizes.max() > _LONGEST:
        import xxhash

        return np.fromiter(
            (xxhash.xxh64_intdigest(w) if len(w) > _LONGEST else int(word_hashes([w])[0]) for w in words),
            np.uint64,
            len(words),
        )
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + _U(1)
    starts = np.zeros(len(words), np.int64)
    np.cumsum(sizes[:-1], out=starts[1:])
    at = np.arange(len(flat)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(flat * _POWERS[at], starts))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)


def sorted_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str], at_least: int = 50_000
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups from batches that are sorted by ``keys``: a table and the offsets at which its groups begin (and the end).

    Groups are gathered until there are ``at_least`` rows, so that many small groups share the cost of one call.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < at_least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        e = edges(t)
        if len(e) > 2:
            yield t.slice(0, int(e[-2])), e[:-1]
            t = t.slice(int(e[-2]))
        held, rows = t.combine_chunks().to_batches(), t.num_rows
        at_least = max(at_least, 2 * rows)
    if rows:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, edges(t)
