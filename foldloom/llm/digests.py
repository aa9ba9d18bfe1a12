"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

For each window of four bytes three triplets are hashed into 128 buckets. A bucket's code is the number of the
document's bucket quartiles that its count exceeds (two bits); a byte with the logarithm of the length goes first.
Two digests are compared by the sum of code differences (a difference of three counts six) and of the lengths,
bounded by what unrelated digests differ by.

Defined results: null text counts as empty, and texts of under three bytes have no triplets, so only their lengths
tell them apart; equal texts have equal digests; repeated ids are ordered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import keyed, partitions, staged, text_chunks

BUCKETS = 128
#: Bytes that are counted at a time.
STRETCH = 1_000_000
#: The bound of the difference: 128 buckets times the mean difference of independent codes.
FAR = 208
#: Triplets in a window of four bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))


def counted(raw: bytes, sizes: np.ndarray, most: int | None = None) -> np.ndarray:
    """(row, bucket) counts of the triplets of rows of the given sizes (of those that start in the first ``most`` bytes)."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    stop = np.repeat(np.cumsum(sizes), sizes)
    place = np.repeat(np.arange(len(sizes), dtype=np.int64) * BUCKETS, sizes)
    counts = np.zeros(len(sizes) * BUCKETS, np.int64)
    for seed, (a, b, c) in enumerate(TRIPLETS):
        n = max(0, min(len(data) - c, most or len(data)))
        inside = np.arange(n) + c < stop[:n]
        mixed = (data[a : a + n] * np.uint32(0x9E3779B1)) ^ (data[b : b + n] * np.uint32(0x85EBCA77)) ^ (data[c : c + n] * np.uint32(0xC2B2AE3D) + np.uint32(seed * 0x27D4EB2F & 0xFFFFFFFF))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount((place[:n] + (mixed >> np.uint32(25)))[inside], minlength=len(counts))
    return counts.reshape(-1, BUCKETS)


def digests(texts: list[str]) -> np.ndarray:
    """(n, 33) bytes: length code, then four codes a byte."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    if sizes.max(initial=0) <= STRETCH:
        counts = counted(b"".join(raw), sizes)
    else:
        # Counts add up, so that a long text is counted in stretches.
        counts = np.zeros((len(raw), BUCKETS), np.int64)
        for k, x in enumerate(raw):
            for at in range(0, len(x), STRETCH):
                part = x[at : at + STRETCH + 3]
                counts[k] += counted(part, np.array([len(part)]), STRETCH)[0]
    ordered = np.sort(counts, axis=1)
    codes = sum((counts > ordered[:, [q]]).astype(np.uint8) for q in (31, 63, 95)).reshape(-1, BUCKETS // 4, 4)
    packed = codes[:, :, 0] | codes[:, :, 1] << 2 | codes[:, :, 2] << 4 | codes[:, :, 3] << 6
    length = np.minimum(255, np.round(12 * np.log2(1 + sizes))).astype(np.uint8)
    return np.concatenate([length[:, None], packed.astype(np.uint8)], axis=1)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 from the bound on."""
    parts = [np.abs((one[:, 1:] >> k & 3).astype(np.int16) - (other[:, 1:] >> k & 3)) for k in (0, 2, 4, 6)]
    difference = sum(np.where(p == 3, 6, p).sum(axis=1) for p in parts)
    difference = difference + np.abs(one[:, 0].astype(np.int16) - other[:, 0])
    return 1 - np.minimum(difference, FAR) / FAR


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and its hexadecimal ``fingerprint``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                made = digests([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes().hex() for x in made], pa.string())], ["doc_id", "fingerprint"])

    return keyed(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    half = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + f[:h] for t, f, h in zip(texts, following, half, strict=True)]
    own, changed, after = digests(texts), digests(edited), digests(following)
    show = lambda x: pa.array([y.tobytes().hex() for y in x], pa.string())
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        show(own), show(changed), pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, after), pa.float64()),
    ]


def compare_neighbours(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every document, of its edited text (its last half gives way to the next document's beginning) and
    their likenesses. The next document is the one of the next smaller id; after the last comes the first.

    The table is dealt out by range once. Only the first and last document of each range meet again, by range number.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def edge(kind: int, row: tuple) -> pa.RecordBatch:
            cells = [pa.array([row[0]], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([*cells, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([row[1]], pa.string())], [*names, "edge", "part", "text"])

        for batch in batches:
            for chunk in text_chunks(batch):
                rows = [(d, t or "") for d, t in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True)]
                if last is None:
                    yield edge(1, rows[0])
                else:
                    rows.insert(0, last)
                last = rows[-1]
                if len(rows) > 1:
                    cells = _compared([d for d, _ in rows[:-1]], [t for _, t in rows[:-1]], [t for _, t in rows[1:]])
                    n = len(rows) - 1
                    yield pa.RecordBatch.from_arrays([*cells, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], [*names, "edge", "part", "text"])
        if last is not None:
            yield edge(2, last)

    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    dealt = keyed(df, id_col, text_col).repartitionByRange(partitions(spark), F.desc_nulls_last("doc_id")).sortWithinPartitions(*order)
    rows = staged(dealt.mapInArrow(run, f"{RESULT}, edge int, part int, text string"), f"{folder}/compared")
    parts = sorted(r.part for r in rows.filter("edge = 1").select("part").collect())
    turn = spark.createDataFrame([(a, parts[(i + 1) % len(parts)]) for i, a in enumerate(parts)], "part int, then int")
    ends, begins = rows.filter("edge = 2").select("part", "doc_id", "text"), rows.filter("edge = 1").select(F.col("part").alias("then"), F.col("text").alias("after"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, after = (batch.column(k).to_pylist() for k in range(3))
            yield pa.RecordBatch.from_arrays(_compared(ids, texts, after), names)

    met = ends.join(turn, "part").join(begins, "then").select("doc_id", "text", "after").mapInArrow(finish, RESULT)
    return rows.filter("edge IS NULL").select(*names).unionByName(met)
