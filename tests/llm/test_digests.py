import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from foldloom.llm import common, digests
from tests.llm.conftest import ODD, small_documents


def one(text):
    return digests.digests([text])[0]


def slow_digest(text):
    """The digest spelled out, triplet by triplet."""
    raw, counts, m = text.encode(), [0] * 128, 0xFFFFFFFF
    for seed, (a, b, c) in enumerate(digests.TRIPLETS):
        for i in range(len(raw) - c):
            h = (raw[i + a] * 0x9E3779B1 & m) ^ (raw[i + b] * 0x85EBCA77 & m) ^ ((raw[i + c] * 0xC2B2AE3D + (seed * 0x27D4EB2F & m)) & m)
            h = (h ^ (h >> 15)) * 0x2C1B3C6D & m
            counts[h >> 25] += 1
    q = [sorted(counts)[k] for k in (31, 63, 95)]
    codes = [sum(n > x for x in q) for n in counts]
    return [sum(codes[4 * i + k] << 2 * k for k in range(4)) for i in range(32)]


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = one(text), one(edited), one(after)
        near = lambda x, y: float(digests.likeness(x[None], y[None])[0])
        out.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), near(a, b), near(a, c)))
    return sorted(out)


@pytest.mark.parametrize("text", ["", "ab", "abc", "abcd", "é日本" * 40, "the quick brown fox jumps over it " * 9])
def test_digest_spelled_out(text):
    assert one(text)[1:].tolist() == slow_digest(text)


def test_a_batch_equals_one_by_one():
    texts = [t for _, t in small_documents()[:30]] + ["", "ab", "x"]
    assert [x.tobytes() for x in digests.digests(texts)] == [one(t).tobytes() for t in texts]


def test_likeness_is_bounded_and_finds_edits():
    texts = [t for _, t in small_documents() if len(t) > 1500][:20]
    all_ = digests.digests(texts)
    assert (digests.likeness(all_, all_) == 1).all()
    edited = digests.digests([t[:700] + "changed here" + t[720:] for t in texts])
    others = np.roll(all_, 1, axis=0)
    assert digests.likeness(all_, edited).min() > 0.6
    assert digests.likeness(all_, edited).mean() > digests.likeness(all_, others).mean()
    assert ((0 <= digests.likeness(all_, others)) & (digests.likeness(all_, others) <= 1)).all()


@pytest.mark.parametrize("rows", [small_documents(), ODD, [(4, "only one")], []], ids=["small", "odd", "single", "empty"])
def test_neighbours_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r[0]), *r[1:]) for r in digests.compare_neighbours(df, common.shared_dir(spark)).collect()]
    assert sorted(got) == brute(rows)


def test_stretches_change_nothing(monkeypatch):
    texts = [t for _, t in small_documents()[:30]] + ["", "ab", "é" * 900]
    whole = digests.digests(texts)
    monkeypatch.setattr(digests, "STRETCH", 1000)
    assert (digests.digests(texts) == whole).all()


def test_edits_by_sql(spark):
    """Sizes and edited texts as DuckDB makes them."""
    rows = small_documents()
    text, ids = pa.array([t for _, t in rows], pa.string()), pa.array([d for d, _ in rows])
    documents = pa.table({"doc_id": ids, "text": text})  # noqa: F841
    want = duckdb.sql("""SELECT doc_id, length(text) AS n, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2)) AS e FROM (
        SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first(text) OVER (ORDER BY doc_id DESC)) AS next FROM documents)""").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in digests.compare_neighbours(df, common.shared_dir(spark)).collect()]
    assert sorted(got) == sorted(want)


def test_long_texts(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcdé \n") for _ in range(n))) for k, n in enumerate((1_300_000, 3, 2_100_000))]
    got = [(str(r[0]), *r[1:]) for r in digests.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), common.shared_dir(spark)).collect()]
    assert sorted(got) == brute(rows)
