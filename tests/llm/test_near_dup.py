import functools
import random

import numpy as np
import pytest

from foldloom.llm import common, near_dup
from tests.llm.conftest import ODD


@functools.cache
def labels_of(text):
    words, seen, out = text.split(), {}, []
    for i in range(len(words) - 4):
        g = tuple(words[i : i + 5])
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out, set(out)


def slow_similarity(one, other, least=0.0):
    """Longest common subsequence of all labelled runs of five words, without a band; 0 where even all common runs
    wouldn't reach ``least``."""
    (a, x), (b, y) = labels_of(one), labels_of(other)
    if a and b and (m := len(x & y)) < least * (len(a) + len(b) - m):
        return 0.0
    if not a or not b:
        return float(one.split() == other.split() and bool(one.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def brute(rows, least=0.8):
    rows = [(d, t) for d, t in rows if d is not None]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, t) in enumerate(rows):
        for e, u in rows[i + 1 :]:
            if t and u and min(len(t), len(u)) > 0.5 * max(len(t), len(u)) and slow_similarity(t, u, least) >= least:
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in parent}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture
def families():
    """Families of edited copies, chains of ever more edits, and unrelated texts that share a passage."""
    rng, rows = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(80, 200))]
        rows += [base] + [edited(rng, base, rng.randint(0, 5)) for _ in range(6)]
    chain = [word() for _ in range(150)]
    for _ in range(8):
        rows.append(chain)
        chain = edited(rng, chain, 2)
    rows += [passage + [word() for _ in range(rng.randint(10, 60))] for _ in range(15)]
    rng.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.class_id for r in near_dup.near_duplicates(df, common.shared_dir(spark)).collect()}


def test_similarity_equals_full_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 60))]
        b = edited(rng, a, rng.randint(0, 2)) if rng.random() < 0.8 else a[::-1]
        got, want = near_dup.similarity(" ".join(a).encode(), " ".join(b).encode(), 0.8), slow_similarity(" ".join(a), " ".join(b))
        assert got == pytest.approx(want if want >= 0.8 else 0)


def test_classes_equal_brute_force(spark, families):
    assert run(spark, families) == brute(families)


def test_odd_rows(spark, odd, empty):
    got = [(r.doc_id, r.class_id) for r in near_dup.near_duplicates(odd, common.shared_dir(spark)).collect()]
    assert sorted(got, key=str) == sorted(((d, d) for d, _ in ODD), key=str)
    assert near_dup.near_duplicates(empty, common.shared_dir(spark)).collect() == []


@pytest.fixture
def short():
    """Families of texts of 5 to 40 words with words put on or taken off at their ends, and a line that many share."""
    rng, rows = random.Random(11), [["w1", "w2", "w3", "w4", "w5", "w6", "w7", "w8"], ["w1", "w2", "w3", "w4", "w5", "w6", "w7", "w8", "w9"]]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(7)]
    for n in range(5, 41):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(3):
                front, back = rng.randint(-2, 2), rng.randint(-2, 2)
                rows.append([word() for _ in range(front)] + base[max(0, -front) : n + min(0, back)] + [word() for _ in range(back)])
    rows += [line + [word() for _ in range(rng.randint(0, 4))] for _ in range(30)]
    rng.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def test_short_texts_equal_brute_force(spark, short):
    assert run(spark, short) == brute(short)


def test_prefix_misses_no_pair():
    """All sizes under the limit: with m of a and b labels in common at 0.8, one key at least is equal."""
    rng = np.random.default_rng(2)
    for a in range(1, near_dup.EXACT + 1):
        for b in range(a, near_dup.EXACT + 1):
            m = -(-4 * (a + b) // 9)
            if m <= a:
                labels = rng.integers(0, 1 << 63, a + b - m).astype(np.uint64)
                one, other = (near_dup.keys_of(x, 32, 6, 0.8) for x in (labels[:a], labels[a - m :]))
                assert len(np.intersect1d(one, other))


def test_parity_rules_out_no_similar_pair():
    rng = np.random.default_rng(7)
    for _ in range(2000):
        a, b = rng.integers(1, 400, 2)
        m = rng.integers(0, min(a, b) + 1)
        labels = rng.integers(0, 1 << 63, a + b - m).astype(np.uint64)
        apart = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in near_dup.parity(labels[:a]) ^ near_dup.parity(labels[a - m :]))
        assert apart <= a + b - 2 * m


def stock(n, seed=9):
    """Texts of one header and three of forty stock sentences."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    header, sentences = [word() for _ in range(60)], [[word() for _ in range(12)] for _ in range(40)]
    return [(i, " ".join(header + [w for k in rng.sample(range(40), 3) for w in sentences[k]])) for i in range(n)]


def counted(spark, rows, monkeypatch):
    """Classes, and how many pairs were verified."""
    total, plain = [], near_dup.verified

    def verified(pairs, texts, least):
        total.append(pairs.count())
        return plain(pairs, texts, least)

    monkeypatch.setattr(near_dup, "verified", verified)
    out = run(spark, rows)
    monkeypatch.undo()
    return out, sum(total)


def test_boilerplate_makes_few_pairs(spark, monkeypatch):
    """Texts that share a header and stock sentences: nearly all pairs are ruled out unread, and no link is lost."""
    rows = stock(300)
    got, few = counted(spark, rows, monkeypatch)
    assert got == brute(rows) and few < 900
    many = counted(spark, stock(1200), monkeypatch)[1]
    assert many < 12 * max(few, 300)


def test_long_texts_and_shared_ids(spark):
    rng = random.Random(6)
    long = [f"x{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(edited(rng, long, 500))), (3, " ".join(long[::-1])), (4, "é " * 600_000), (5, "é " * 590_000)]
    assert run(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (None, "a b c d e f g")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.class_id) for r in near_dup.near_duplicates(df, common.shared_dir(spark)).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("None", 1)]


def test_a_hot_lead_is_copied(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SERVED", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(40)]
    assert run(spark, rows) == brute(rows)
