import random
import re
from collections import Counter

from foldloom.llm import quality_rules, queries
from tests.llm.conftest import ODD, SMALL, small_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    counts = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
    return *counts, n < 50 or 100 * len(repeated) > 50 * n


def shown(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op5_quality_rules(spark, SMALL).collect()}
    for doc, text in small_documents():
        assert shown(rows[doc]) == base(text)
        assert not (rows[doc].base_failed and rows[doc].kept)


def test_odd_rows(spark, odd, empty):
    rows = [(str(r.doc_id), shown(r)) for r in quality_rules.judge(odd).collect()]
    assert sorted(rows) == sorted((str(d), base(t)) for d, t in ODD)
    assert quality_rules.judge(empty).collect() == []


def test_long_repeats_are_linear(spark):
    text = "\n".join(["a b c d"] * 20_000)
    df = spark.createDataFrame([(1, text), (2, " ".join(map(str, range(60_000))))], "doc_id long, text string")
    got = {r.doc_id: shown(r) for r in quality_rules.judge(df).collect()}
    assert got[1] == (80_000, 80_000, 0, 19_999, 80_000, True)
    assert got[2][0] == 60_000 and got[2][4] == 0


def test_long_text_and_shared_ids(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(("one", "two#", "é", "three\n", "x%d" % rng.randrange(10**6))) for _ in range(400_000))
    rows = [(1, long), (1, "other"), (1, None), (None, long[:2_000])]
    got = sorted((str(r.doc_id), shown(r)) for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((str(d), base(t)) for d, t in rows)


def test_no_user_functions_in_the_plan(spark):
    plan = queries.op5_quality_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_own_rules(spark):
    df = spark.createDataFrame([(1, "the cat sat on " * 20)], "doc_id long, text string")
    assert quality_rules.judge(df, rules=(("mean_word_chars", 99.0, None),)).first().kept is False
