"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def shingle_hashes(w: Column, width: int) -> Column:
    """Hashes of the shingles in order."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(width)]))
    return F.when(F.size(w) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns as one, row, beside those named, so that no name clashes; select("row.*") gives them back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where it is unset, a session within one process takes a local one; any other raises, as executors would each write to their own disk."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


_stored: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there. drop_stored deletes what is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_stored(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables stored so far (since: but for the first so many). Only when no result that reads them is still to be computed."""
    while len(_stored) > since:
        delete(spark, _stored.pop())


@contextmanager
def scratch(spark: SparkSession):
    """What is stored within is deleted at the end, so results must be written by then."""
    have = len(_stored)
    try:
        yield
    finally:
        drop_stored(spark, have)


def _bytes(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType):
        text = isinstance(kind.elementType, T.StringType)
        return F.coalesce(F.octet_length(F.concat_ws("", c)) + 8 * F.size(c) if text else 16 * F.size(c), F.lit(0))
    return F.lit(16)


def small(df: DataFrame, size: int = 32 << 20) -> DataFrame:
    """A stored table, marked for broadcast only if its values have at most so many bytes."""
    row = F.lit(0).cast("long")
    for f in df.schema.fields:
        row = row + _bytes(f)
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= size else df


# --- numpy over Arrow buffers -------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits (splitmix)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = _P, inverse
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def buffer_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a line end after each text, and the offset after each text."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    return np.frombuffer(joined, np.uint8), ends


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes; equal runs hash alike wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text how many it has."""
    data, ends = buffer_of(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    stops = np.flatnonzero(edge == 1)
    hashes = hash_runs(data, starts, stops)
    upto = np.searchsorted(starts, ends)
    return hashes, np.diff(np.concatenate(([0], upto)))


def slices(batch, rows: int = 256, size: int = 4 << 20):
    """Parts of an Arrow batch, so that memory doesn't follow the batch size that a session sets: so many rows and, unless of one row, so many bytes at most."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        if part.nbytes > size and part.num_rows > 1:
            yield from slices(part, part.num_rows // 2, size)
        else:
            yield part
