"""Byte-level BPE encoding by batched merge rounds, and decoding.

Defined results: null text encodes as empty (no ids, decoded empty); a special token's string in a text is that
token's id; repeated rows give repeated results; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldloom.llm.bpe import encoder, vocabulary
from foldloom.llm.common import keyed, text_chunks


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) of the whole text, ``decoded`` (the text those ids stand for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, vocab = encoder(path, False), vocabulary(path)
        for batch in batches:
            for part in text_chunks(batch):
                ids, bounds = encode(part.column(1))
                arrays = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), arrays, vocab.decode(ids, bounds).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return keyed(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
