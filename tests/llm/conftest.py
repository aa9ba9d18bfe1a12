import os
import random

import pytest

SMALL = "/root/testdata/sf0.001"

#: Nulls, empties, ties, repeated rows, odd characters, a long text.
ODD = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, "é 日本 😀 don't we'll"), (5, "x " * 3000), (None, "no id here at all"),
    (7, "same text in two rows " * 6), (7, "same text in two rows " * 6), (9, "<|endoftext|> a\n\n  b <|endoftext|>"), (10, "%41%42 \\u0041 &#65;"), (-4, "below zero"),
]


@pytest.fixture
def odd(spark):
    """The odd rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 1, "x", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, start int, spans string, pos int")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture
def corpus():
    """Documents with shared passages, exact and near copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if i % 5 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passage[rng.randint(0, 30) :]
        if i % 11 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1].split(" ")
            if i % 2 and len(text) > 40:
                text[rng.randrange(len(text))] = "changed"
        rows.append((i * 3, " ".join(text)))
    return rows


def small_documents():
    import pyarrow.dataset as ds

    path = f"{SMALL}/documents.parquet"
    return [(r["doc_id"], r["text"]) for r in ds.dataset(path if os.path.exists(path) else SMALL).to_table(columns=["doc_id", "text"]).to_pylist()]
