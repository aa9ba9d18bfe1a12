import itertools
import random
import re

from foldloom.llm import common, substring_dedup
from foldloom.llm.substring_dedup import WINDOW
from tests.llm.conftest import ODD, small_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - WINDOW + 1):
            window = tuple(words[s : s + WINDOW])
            if seen.setdefault(window, (doc, s)) != (doc, s):
                gone.update(range(s, s + WINDOW))
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(df, common.shared_dir(spark), **more).collect()}


def test_equals_brute_force(spark, corpus):
    assert run(spark, corpus, batches=3) == brute(corpus)


def test_compaction_changes_nothing(spark, corpus):
    assert run(spark, corpus, batches=5, fanout=2) == brute(corpus)


def test_on_the_small_table(spark):
    rows = small_documents()
    assert run(spark, rows) == brute(rows)


def test_repeats_inside_one_document(spark):
    rows = [(1, " ".join(["a"] * 100)), (2, " ".join(map(str, itertools.chain(range(30), range(30)))))]
    assert run(spark, rows, batches=1) == brute(rows)


def brute_rows(rows):
    """Every row a document of its own, in the order of id (null first) and text."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    return sorted((str(ordered[k][0]), *v) for k, v in brute([(k, t) for k, (_, t) in enumerate(ordered)]).items())


def rows_of(spark, df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(df, common.shared_dir(spark)).collect())


def test_odd_rows(spark, odd, empty):
    assert rows_of(spark, odd) == brute_rows(ODD)
    assert substring_dedup.dedup(empty, common.shared_dir(spark)).collect() == []


def test_rows_that_share_an_id_lose_their_own_repeats(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "a b c " + passage), (2, passage), (2, "other words here"), (2, passage + " z"), (None, passage), (None, "y " + passage), (None, None)]
    assert rows_of(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute_rows(rows)


def test_words_that_collide_in_polynomials(spark):
    """Two words that hash alike under every polynomial modulo 2^64: windows that differ in them aren't equal."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    text = lambda w: " ".join([*(f"w{i}" for i in range(10)), w, *(f"v{i}" for i in range(14))])
    rows = [(1, text(one)), (2, text(other)), (3, text(one))]
    assert run(spark, rows) == brute(rows) and run(spark, rows)[2][1] == 0


def test_hot_passages_over_many_chunks(spark):
    """A passage in every document, in tasks of several chunks: all but the first lose it, wherever it comes."""
    rng = random.Random(3)
    passage, filler = " ".join(f"p{i}" for i in range(40)), lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, f"{filler(rng.randrange(4000))} {passage} {filler(9)} {passage if i % 3 == 0 else ''}") for i in range(120)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)
    prints = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(substring_dedup._fingerprints, "a long, c long, doc_id long, pos int, dup boolean")
    assert prints.filter("NOT dup").groupBy("a", "c").count().agg({"count": "max"}).first()[0] < 30


def test_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(250_000))
    rows = [(1, long), (2, "é " + long[1_000_000:1_200_000]), (3, long + " " + long[:300])]
    assert run(spark, rows) == brute(rows)


def test_a_later_session_opens_the_index(spark, corpus):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    folder, got, tables = common.shared_dir(spark), {}, spark.catalog.listTables()
    for low in range(0, len(corpus), 40):
        index = substring_dedup.FingerprintIndex.open(spark, folder) if low else substring_dedup.FingerprintIndex(spark, folder, buckets=3, fanout=2)
        done = index.add(frame(corpus[low : low + 40]))
        index.close()
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in done.collect()}
        assert spark.catalog.listTables() == tables
    assert got == brute(corpus) and max(level for level, _ in index.runs) > 0


def test_a_second_batch_meets_the_stored_runs(spark, corpus):
    """Incremental use: a batch that comes later, against what the index holds."""
    index = substring_dedup.FingerprintIndex(spark, common.shared_dir(spark), buckets=3, fanout=2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for low in range(0, len(corpus), 30):
        for r in index.add(frame(corpus[low : low + 30])).collect():
            got[r.doc_id] = (r.n_words, r.n_removed, r.kept)
    assert got == brute(corpus) and max(level for level, _ in index.runs) > 0
