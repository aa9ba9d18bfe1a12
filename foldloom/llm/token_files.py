"""Token-id files: one concatenated id array with Elias-Fano encoded document boundaries.

A file (``pack``/``TokenFile``) holds documents in ascending id order. Both the document ids and the ends of the
documents in the id array are Elias-Fano sequences: low bits packed, high bits in unary, with the position of every
256th one kept in 32 bits so that ``select`` reads a bounded stretch. Every offset that is read comes from ``select``.

``write`` stores each file as a file of its own, through Spark's committed text writer: its bytes and one line end,
under ``file=<part>-<number>-<ids of the part before>-<ids>``. So a lost executor leaves no half file, no local disk is
used, any shared store will do, and a reader without Spark can map a file and fetch one document of it
(``TokenFile.open``). A file has ``file_ids`` ids, or one document if that has more.

Defined results: null text is an empty document (only the end id); null document ids come first; repeated ids stay
apart, ordered by text; an empty table gives no file.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm.bpe import encoder
from foldloom.llm.common import bounded, keyed, partitions, text_chunks

MAGIC = b"FLTOKEN2"
SAMPLE = 256
NAME = r"file=(\d+)-(\d+)-(\d+)-(\d+)"


class EliasFano:
    """A non-decreasing sequence of integers from 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n >= 1 << 30:
            raise ValueError("too many values for 32-bit samples")
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.zeros((n, low_bits), np.uint8)
        for k in range(low_bits):
            bits[:, k] = (values >> np.uint64(low_bits - 1 - k)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel()), np.packbits(unary), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        low, high = np.frombuffer(data[at : at + a], np.uint8), np.frombuffer(data[at + a : at + a + b], np.uint8)
        at += a + b
        size = 4 * -(-n // SAMPLE)
        return cls(n, low_bits, low, high, np.frombuffer(data[at : at + size], "<u4")), data[at + size :]

    def _low(self, bit: np.ndarray, size: int) -> np.ndarray:
        """``size`` bits (56 at most) from each of the given bits of ``low`` on."""
        if not size:
            return np.zeros(len(bit), np.uint64)
        byte = bit[:, None] // 8 + np.arange(8)
        near = self.low[np.minimum(byte, len(self.low) - 1)].copy().view(">u8").ravel().astype(np.uint64)
        return (near << (bit % 8).astype(np.uint64)) >> np.uint64(64 - size)

    def select(self, places: np.ndarray) -> np.ndarray:
        """The values at ascending places. Of the unary code only the stretches between the kept positions around them
        are read, one after the other."""
        places = np.asarray(places, np.int64)
        high, block = np.empty(len(places), np.int64), places // SAMPLE
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if len(places) else []
        for a, b in zip(cuts, [*cuts[1:], len(places)], strict=False):
            k = int(block[a])
            first = int(self.samples[k])
            last = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high) - 1
            ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : last // 8 + 1])) + first // 8 * 8
            high[a:b] = ones[np.searchsorted(ones, first) + places[a:b] - k * SAMPLE] - places[a:b]
        bit, size = places * self.low_bits, self.low_bits
        low = self._low(bit, min(size, 32))
        if size > 32:
            low = (low << np.uint64(size - 32)) | self._low(bit + 32, size - 32)
        return (high << size) | low.astype(np.int64)


def pack(doc_ids: list[int | None], ids: list[np.ndarray], vocabulary_size: int) -> bytes:
    """One file. Ids take two bytes where the vocabulary allows it."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    width = 2 if vocabulary_size <= 1 << 16 else 4
    low = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) for x in ids])
    flat = np.concatenate([np.zeros(0, f"<u{width}"), *ids]).astype(f"<u{width}")
    return b"".join([MAGIC, struct.pack("<QQBqQ", len(doc_ids), nulls, width, low, len(flat)), EliasFano.of(known - low).to_bytes(), EliasFano.of(ends).to_bytes(), flat.tobytes()])


class TokenFile:
    """A file over any buffer; only what is asked for is touched."""

    def __init__(self, data: bytes | memoryview | mmap.mmap):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        head = "<QQBqQ"
        self.n, self.nulls, self.width, self.low, n_ids = struct.unpack_from(head, data, 8)
        rest = memoryview(data)[8 + struct.calcsize(head) :]
        self.ids_of_docs, rest = EliasFano.read(rest)
        self.ends, rest = EliasFano.read(rest)
        self.ids = np.frombuffer(rest[: n_ids * self.width], f"<u{self.width}")

    @classmethod
    def open(cls, path: str) -> TokenFile:
        """A file in a local folder, mapped."""
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def documents(self, first: int, stop: int) -> tuple[list[int | None], np.ndarray]:
        """Document ids of the given documents, and their boundaries (one more), by select."""
        nulls = max(0, min(stop, self.nulls) - first)
        known = self.ids_of_docs.select(np.arange(max(first, self.nulls), max(stop, self.nulls)) - self.nulls) + self.low
        bounds = self.ends.select(np.arange(max(first, 1) - 1, stop))
        return [None] * nulls + known.tolist(), bounds if first else np.r_[0, bounds]

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """Document id and ids of the i-th document."""
        keys, (start, stop) = self.documents(i, i + 1)
        return keys[0], self.ids[start:stop]


def write(df: DataFrame, path: str, folder: str, end_id: int = 2, vocabulary_size: int = 50_257, file_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts with the tokenizers library, append ``end_id``, and store files of about ``file_ids`` ids
    under ``folder`` in ascending document order (of their names, too). Returns ``folder``."""
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, True), TaskContext.get().partitionId()
        file, before, docs, ids, size = 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            name = f"{part:06d}-{file:06d}-{before:015d}-{size:015d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack(docs, ids, vocabulary_size)], pa.binary())], ["file", "payload"])

        for batch in batches:
            for piece in text_chunks(batch):
                made, bounds = encode(piece.column(1))
                flat, keys = np.insert(made, bounds[1:], end_id).astype(kind), piece.column(0).to_pylist()
                bounds = bounds + np.arange(len(bounds))
                at = 0
                while at < len(keys):
                    # As many documents as the file still takes, one at least.
                    stop = min(len(keys), int(np.searchsorted(bounds, bounds[at] + file_ids - size)))
                    stop = max(stop, at + 1)
                    docs += keys[at:stop]
                    ids += [flat[a:b] for a, b in zip(bounds[at:stop].tolist(), bounds[at + 1 : stop + 1].tolist(), strict=True)]
                    size += int(bounds[stop] - bounds[at])
                    at = stop
                    if size >= file_ids:
                        yield row()
                        file, before, docs, ids, size = file + 1, before + size, [], [], 0
        if docs:
            yield row()

    rows = keyed(df, id_col, text_col).repartitionByRange(partitions(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(run, "file string, payload binary")
    # The text writer puts the bytes of a string down as they are.
    made.select("file", F.col("payload").cast("string").alias("value")).write.mode("overwrite").partitionBy("file").text(folder)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before the document), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), out of
    the stored files alone. Only one total for each task of the writer reaches the driver."""
    bounded(spark)
    name = lambda k: F.regexp_extract("path", NAME, k).cast("long")
    files = spark.read.format("binaryFile").load(folder).select(name(1).alias("part"), name(3).alias("before"), name(4).alias("n"), "content")
    totals = files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part long, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(memoryview(content.as_buffer()))
                for i in range(0, file.n, 1000):
                    docs, b = file.documents(i, min(i + 1000, file.n))
                    flat = pa.py_buffer(file.ids[b[0] : b[-1]].astype("<u4"))
                    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(4 * (b - b[0])), flat])
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + b[:-1]), pa.array(np.diff(b)), cells.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    placed = files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("first"), "content")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
