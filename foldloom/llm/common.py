"""Shared plumbing: the shared folder, Arrow text buffers and word boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.shared import bounded, shared_dir, staged

__all__ = ["bounded", "shared_dir", "staged"]
#: Bytes of text that one vectorised step works on (a longer document is one step).
CHUNK_BYTES = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column can clash or be carried."""
    bounded(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets of the rows in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text size."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(name)))
    for i, j in row_chunks(offsets, limit):
        yield batch.slice(i, j - i)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the n+1 word offsets of the rows.

    Row ends cut words.
    """
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n-1 and their inverses, modulo 2^64 (base is odd)."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that neighbouring values part."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        power, self.inverse = _powers(base, len(values))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power)])

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stops] - self.sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64))


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    return Rolling(raw.astype(np.uint64) + np.uint64(1), BASES[0])(starts, ends)


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit halves of a cryptographic digest of each word. Distinct words are digested once."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sizes = ends - starts
    cut = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    data = raw[np.repeat(starts - cut[:-1], sizes) + np.arange(cut[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cut), pa.py_buffer(data)]).dictionary_encode()
    made = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words.dictionary.to_numpy(zero_copy_only=False).tolist())
    halves = np.frombuffer(made, "<u8").reshape(-1, 2)[words.indices.to_numpy()]
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def tidy(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of steps whose result is stored."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", name: str = "row_number") -> tuple[DataFrame, bool]:
    """``df`` with a number of its own for each row, ascending with the id: the id where that is unique and never null;
    else rows are counted in the order of id (null first) and text, and stored, as counting again might differ. Also
    tells whether the number is the id."""
    if not df.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
        return df.withColumn(name, F.col(id_col).cast("long")), True
    rows = df.repartitionByRange(partitions(df.sparkSession), id_col).sortWithinPartitions(id_col, text_col)
    return staged(rows.withColumn(name, F.monotonically_increasing_id()), folder), False


def hashed_sample(df: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``n`` rows (all, if there are no more) that are least by a hash of the key. The hash thins the table out where it
    lies, so that about 2n rows are ordered, whatever its size."""
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32))
    total = df.count()
    thin = df.filter(place < F.lit(int(min(1.0, (2 * n + 100) / max(total, 1)) * (1 << 32))))
    return thin.orderBy(place, key).limit(n)
