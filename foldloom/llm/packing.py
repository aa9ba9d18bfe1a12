"""Best-fit packing by minimum bin slack.

Every document becomes ids and an end id; documents longer than a sequence are cut into full pieces, the first of
which may be shorter. What is to be packed is then a histogram of at most ``capacity`` lengths, whatever the number of
documents. For each bin the largest length left is taken, and a bitset subset-sum over the lengths that are left finds
the fullest combination beside it. A combination is removed as often as the counts allow at once, which is what
bin-by-bin removal does, so the plan's size depends on ``capacity`` alone.

Defined results: null text is an empty document (the end id alone); repeated ids are packed each; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.bpe import encoder
from foldloom.llm.common import keyed, staged, text_chunks

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def fullest(counts: list[int], room: int, most: int) -> list[int]:
    """Lengths of at most ``most`` whose sum is the largest that ``room`` allows."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, most), 0, -1):
        if not counts[length]:
            continue
        steps.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            wider = reach | (reach << length) & mask
            if wider == reach:
                break
            reach = wider
        if reach >> room & 1:
            break
    left, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        while not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many bins, lengths in each), for all of the histogram."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    bins = []
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            counts[largest] -= 1
            inside = [largest, *fullest(counts, capacity - largest, largest)]
            counts[largest] += 1
            need = Counter(inside)
            times = min(counts[length] // k for length, k in need.items())
            for length, k in need.items():
                counts[length] -= times * k
            bins.append((times, inside))
    return bins


def places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of the stretches of equal place."""
    used, out, sequence = Counter(), defaultdict(list), 0
    for times, inside in bins:
        offset = 0
        for length in inside:
            out[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row a piece; ``rank`` counts pieces of the same length in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path, True), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for chunk in text_chunks(batch):
                ids, bounds = encode(chunk.column(1))
                flat = memoryview(np.insert(ids, bounds[1:], end_id).astype("<u4").tobytes())
                n, begin = np.diff(bounds) + 1, bounds[:-1] + np.arange(chunk.num_rows)
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                stop = n[row] - (count[row] - 1 - piece) * capacity
                start = np.where(piece > 0, stop - capacity, 0)
                length, at = stop - start, begin[row]
                sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip((at + start).tolist(), (at + stop).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                kinds, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(first, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                columns = [chunk.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return keyed(df, id_col, text_col).mapInArrow(run, PIECE)


def pack_documents(df: DataFrame, path: str, folder: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. ``folder``: shared, for the pieces
    (they are numbered by task, so they are stored before they are counted)."""
    spark = df.sparkSession
    rows = staged(pieces(df, path, capacity, end_id, id_col, text_col), f"{folder}/pieces")
    by_task = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length).tolist():
                ranks, sequences, offsets = where.value[size]
                mine = np.flatnonzero(length == size)
                at = np.searchsorted(ranks, rank[mine], "right") - 1
                sequence[mine], offset[mine] = sequences[at] + rank[mine] - ranks[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rows.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
