import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from foldloom.llm import common, packing, queries
from tests.llm.conftest import ODD, SMALL, small_documents

PATH = queries.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def test_fullest_combination_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randint(0, 30)
        counts = [0] * 31
        for _ in range(rng.randint(0, 7)):
            counts[rng.randint(1, 30)] += 1
        items = [k for k, n in enumerate(counts) for _ in range(n)]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        got = packing.fullest(counts, room, 30)
        assert sum(got) == best and not Counter(got) - Counter(items)


def test_plan_uses_every_length_once():
    rng = random.Random(3)
    histogram = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    bins = packing.plan(dict(histogram), 2048)
    used = Counter()
    for times, inside in bins:
        assert sum(inside) <= 2048
        for length in inside:
            used[length] += times
    assert used == histogram
    assert sum(t for t, _ in bins) <= -(-sum(k * n for k, n in histogram.items()) // 2048) * 1.01


def check(rows, got, capacity, end):
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for stretch in at.values():
        place = 0
        for offset, length in sorted(stretch):
            assert offset == place
            place += length
        assert place <= capacity
    made = Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for doc, text in rows:
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[str(doc), k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert made == want
    return len(at), sum(r.length for r in got)


def test_query(spark):
    sequences, tokens = check(small_documents(), queries.op9_packing(spark, SMALL).collect(), 2048, 0)
    assert sequences <= 1.05 * -(-tokens // 2048)


def test_odd_rows(spark, odd, empty):
    got = packing.pack_documents(odd, PATH, common.shared_dir(spark), capacity=16, end_id=7).collect()
    check(ODD, got, 16, 7)
    assert packing.pack_documents(empty, PATH, common.shared_dir(spark)).collect() == []


def test_long_texts_and_shared_ids(spark):
    """Texts over several windows, rows that share an id with different texts, repeated rows; each is packed whole."""
    rng = random.Random(6)
    rows = [(1, " ".join(rng.choice(("one", "two", "é", "3")) for _ in range(600_000))), (1, "short"), (1, "short"), (None, None), (2, "x" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sequences, tokens = check(rows, packing.pack_documents(df, PATH, common.shared_dir(spark)).collect(), 2048, 0)
    assert sequences <= 1.05 * -(-tokens // 2048) + 1
