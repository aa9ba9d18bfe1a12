"""Chat rendering, assistant-only loss masks, length rules, padding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from foldloom.shared import bounded

START, END, NEWLINE, USER, ASSISTANT = 1, 2, 3, 11, 12
IGNORED = -100
CHAT_TOKEN = r"<\|im_start\|>|<\|im_end\|>|\n|[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
#: Tokens whose ids a task remembers, and ids that are labelled in one step (a longer row is one step).
REMEMBERED, CHUNK_IDS = 200_000, 500_000


def turn(of: Callable[[str], Column] = F.col) -> Column:
    """A message (role, content, name, tool_call_id, tool_calls) in the chat template: what it says, then each call with
    its id, name and arguments; an observation says which call it answers."""
    call = lambda c: F.concat_ws(" ", F.lit("<tool_call>"), c["id"], c["function"]["name"], c["function"]["arguments"], F.lit("</tool_call>"))
    answer = F.when((of("role") == "tool") & F.coalesce(of("tool_call_id"), of("name")).isNotNull(), F.concat_ws(" ", F.lit("<tool_response>"), of("tool_call_id"), of("name")))
    body = F.concat_ws("\n", answer, F.nullif(of("content"), F.lit("")), F.nullif(F.array_join(F.transform(of("tool_calls"), call), "\n"), F.lit("")))
    return F.concat(F.lit("<|im_start|>"), of("role"), F.lit("\n"), body, F.lit("<|im_end|>\n"))


def rendered(messages: DataFrame, keys: list[str], order: str = "pos", tools: str = "") -> DataFrame:
    """One chat text for each key. ``tools``: JSON of the tool list, told first."""
    rows = F.sort_array(F.collect_list(F.struct(order, turn().alias("x"))))
    told = f"<|im_start|>system\n# Tools\n{tools}<|im_end|>\n" if tools else ""
    return messages.groupBy(*keys).agg(F.concat(F.lit(told), F.array_join(F.transform(rows, lambda r: r["x"]), "")).alias("chat"))


def token_id(token: Column) -> Column:
    fixed = F.when(token == "<|im_start|>", START).when(token == "<|im_end|>", END).when(token == "\n", NEWLINE).when(token == "user", USER).when(token == "assistant", ASSISTANT)
    return F.coalesce(fixed, 100 + F.conv(F.substring(F.md5(token.cast("binary")), 1, 5), 16, 10).cast("int"))


def encoded(chat: Column) -> Column:
    """Ids of the default chat tokens (the tokenizer is a seam)."""
    return F.transform(F.regexp_extract_all(chat, F.lit(CHAT_TOKEN), F.lit(0)), token_id)


class Ids(dict):
    """Ids of tokens, as ``token_id``; each is made once in a while."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        fixed = {"<|im_start|>": START, "<|im_end|>": END, "\n": NEWLINE, "user": USER, "assistant": ASSISTANT}
        self[token] = out = fixed.get(token) or 100 + int(md5(token.encode()).hexdigest()[:5], 16)
        return out


def with_ids(rows: DataFrame, texts: list[str]) -> DataFrame:
    """The rows with the ids of each of the text columns in its place, as ``encoded``: for many texts, as a token's id
    isn't made anew wherever it stands."""
    bounded(rows.sparkSession)
    places = [rows.columns.index(c) for c in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = re.compile(CHAT_TOKEN).findall, Ids()
        for batch in batches:
            columns = list(batch.columns)
            for p in places:
                cells = [None if x is None else np.fromiter(map(known.__getitem__, found(x)), np.int32) for x in columns[p].to_pylist()]
                columns[p] = pa.array(cells, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    kind = StructType([StructField(f.name, ArrayType(IntegerType())) if f.name in texts else f for f in rows.schema.fields])
    return rows.mapInArrow(run, kind)


def span_labels(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Labels of the flat ids of rows of the given sizes: content and end token of assistant spans keep their ids, all
    else is ignored. A span runs from the first start after the last end, its header to its first line end."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int32)
    p, row = np.arange(n), np.repeat(np.arange(len(sizes)), sizes)
    new = np.r_[True, (row[1:] != row[:-1]) | (ids[:-1] == END)]
    first, span = np.flatnonzero(new), np.cumsum(new) - 1
    start = np.minimum.reduceat(np.where(ids == START, p, n), first)[span]
    line = np.minimum.reduceat(np.where((ids == NEWLINE) & (p > start), p, n), first)[span]
    said = (line == start + 2) & (ids[np.minimum(start + 1, n - 1)] == ASSISTANT)
    return np.where(said & (p > line), ids, IGNORED).astype(np.int32)


def slices(batch: pa.RecordBatch, place: int, limit: int = CHUNK_IDS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` ids (column number ``place``), at least one row each."""
    ends = np.cumsum(batch.column(place).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, before = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(i, j - i)
        i, before = j, int(ends[j - 1])


def masked(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """The rows with ``labels``: one pass over the id arrays, where they lie, in steps of bounded size."""
    bounded(rows.sparkSession)
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, place)):
            lists = batch.column(place)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            labels = span_labels(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(labels))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "labels"])

    kind = StructType([*rows.schema.fields, StructField("labels", ArrayType(IntegerType()))])
    return rows.mapInArrow(run, kind)


def from_target(labels: Column, start: Column) -> Column:
    """Labels before ``start`` are ignored too."""
    return F.transform(labels, lambda x, i: F.when(i < start, F.lit(IGNORED)).otherwise(x))


def trainable(rows: DataFrame, max_len: int) -> DataFrame:
    """Over-long examples go (they are never cut), and those without a label."""
    return rows.filter((F.size("ids") <= max_len) & F.exists("labels", lambda x: x != IGNORED))


def padded(rows: DataFrame, key: str, batch_size: int, pad: int = 0) -> DataFrame:
    """Batches of at most ``batch_size`` neighbouring keys, padded to the longest of the batch.

    A batch is a range of keys, so numbering the rows needs no global order: integer keys are cut evenly, other keys are
    dealt by range and counted within their part.
    """
    if dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        placed = rows.withColumn("batch", F.floor(F.col(key) / batch_size))
    else:
        dealt = rows.repartitionByRange(key).sortWithinPartitions(key)
        placed = dealt.withColumn("batch", F.floor(F.monotonically_increasing_id() / batch_size))
    short = (F.col("most") - F.size("ids")).cast("int")
    return placed.withColumn("most", F.max(F.size("ids")).over(Window.partitionBy("batch"))).select(
        key, "batch", F.concat("ids", F.array_repeat(F.lit(pad), short)).alias("input_ids"), F.concat("labels", F.array_repeat(F.lit(IGNORED), short)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), short)).alias("attention_mask"),
    )
