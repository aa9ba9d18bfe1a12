import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foldloom.llm import common, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_later_models_learn_from_out_of_fold_predictions():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 8)) < 0.3).astype(np.float32)
    first = x[:, 0] * (rng.random(600) < 0.9)
    y = np.stack([first, np.where(rng.random(600) < 0.1, np.nan, first)], axis=1)
    chain = toxicity.fit_chain(x, y, np.arange(600) % 5, [np.arange(8)] * 6, np.arange(4, dtype=np.uint64), ("a", "b"), toxicity.Training())
    assert chain.models[1].shape == (10,) and chain.models[1][8] > 0.1
    p = chain.predict(x)
    assert ((p[:, 0] > 0.5) == (first > 0)).mean() > 0.9 and ((p[:, 1] > 0.5) == (first > 0)).mean() > 0.9


def features_of(text):
    """Words and word beginnings of a text with their counts, and its number of words."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return Counter([w for w in words] + [(w[:size], size) for w in words for size in toxicity.BEGINNINGS if len(w) > size]), len(words)


def key_of(feature):
    word, size = feature if isinstance(feature, tuple) else (feature, 0)
    h = int(common.word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]) ^ size
    return h - (1 << 64) if h >> 63 else h


def logistic(x, y, penalty):
    """Newton's method, to the end."""
    x = np.c_[x, np.ones(len(x))]
    keep, w = np.r_[np.full(x.shape[1] - 1, penalty), 0], np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + np.diag(keep + 1e-12), x.T @ (p - y) / len(y) + keep * w)
    return w


def test_chain_against_a_plain_one(spark):
    """Features by fold and models of the chain, as loops over texts; the out-of-fold predictions see nothing of their
    fold."""
    training = toxicity.Training(features=12, folds=3, steps=20_000, penalty=0.01)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.train(docs, labels, common.shared_dir(spark), training=training)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)).alias("fold")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic", fold).orderBy("doc_id").collect()
    found = [features_of(r.text) for r in rows]
    y = np.array([[r.quality, r.toxic] for r in rows], float)

    def choose(kept):
        best = {}
        shown = {kind: Counter() for kind in (0, 1)}
        hits = {(kind, c): Counter() for kind in (0, 1) for c in (0, 1)}
        for i in kept:
            for f, n in found[i][0].items():
                for kind in (0, 1) if n * toxicity.OFTEN >= found[i][1] else (0,):
                    shown[kind][f] += 1
                    for c in (0, 1):
                        hits[kind, c][f] += y[i, c]
        for kind in (0, 1):
            for f, n in shown[kind].items():
                for c in (0, 1):
                    rate = y[kept, c].sum() / len(kept)
                    if n >= 8:
                        best[f] = max(best.get(f, 0.0), (hits[kind, c][f] - n * rate) ** 2 / (n * max(rate * (1 - rate), 1e-9)))
        return sorted(best, key=lambda f: (-best[f], key_of(f)))[: training.features]

    def bits(features):
        return np.array([[float(f in c) for f in features] + [float(c[f] > 0 and c[f] * toxicity.OFTEN >= n) for f in features] for c, n in found])

    everything = list(range(len(rows)))
    folds = [[i for i in everything if rows[i].fold != f] for f in range(3)]
    sets = [choose(kept) for kept in (*folds, everything)]
    assert sorted(map(key_of, sets[-1])) == sorted(chain.features.view(np.int64).tolist())
    oof = np.zeros(len(rows))
    for f in range(3):
        x, w = bits(sets[f]), logistic(bits(sets[f])[folds[f]], y[folds[f], 0], training.penalty)
        mine = [i for i in everything if rows[i].fold == f]
        oof[mine] = toxicity.apply_linear(w, x[mine])
    x = bits(sets[-1])
    first = logistic(x, y[:, 0], training.penalty)
    second = logistic(np.c_[x, oof], y[:, 1], training.penalty)
    p = toxicity.apply_linear(first, x)
    want = np.c_[p, toxicity.apply_linear(second, np.c_[x, p])]
    got = {r.doc_id: (r.p_quality, r.p_toxic) for r in toxicity.predict(docs, chain).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=5e-3)


def test_counts_of_features():
    raw, offsets = common.text_buffer(__import__("pyarrow").array(["Bad bad good", None, "", "verybadword x"]))
    hashes, rows, n = toxicity.tokens(raw, offsets)
    assert n.tolist() == [3, 0, 0, 2] and rows.max() == 3
    bad = hashes[0]
    x = toxicity.counted(hashes, rows, n, np.array([bad]))
    assert x.tolist() == [[1, 1], [0, 0], [0, 0], [0, 0]]


def test_labels_are_found(spark):
    rows = queries.op3_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(rows, on="doc_id", suffixes=("_label", ""))
    toxic = labels.toxic_label == 1
    assert labels.toxic[toxic].mean() > 0.8 and labels.toxic[~toxic].mean() < 0.02
    assert rows.p_toxic.between(0, 1).all() and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (7, None, None), (99, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd, labels, common.shared_dir(spark))
    got = toxicity.predict(odd, chain).collect()
    assert len(got) == 12 and all(0 <= r.p_toxic <= 1 for r in got)
    none = toxicity.train(empty, labels.limit(0), common.shared_dir(spark))
    assert toxicity.predict(empty, none).collect() == [] and toxicity.predict(odd, none).first().p_toxic < 0.01


def test_long_and_shared_rows(spark):
    """Texts over several chunks, and rows that share an id with different texts, are each scored whole."""
    rng = random.Random(1)
    long = " ".join(rng.choice(("good", "fine", "é")) for _ in range(700_000))
    rows = spark.createDataFrame([(1, "bad words bad"), (1, long), (2, long + " bad"), (None, "bad words bad")], "doc_id long, text string")
    bad = common.word_hashes(np.frombuffer(b"bad", np.uint8), np.array([0]), np.array([3]))
    chain = toxicity.Chain(("toxic",), bad, [np.array([3.0, 2.0, -1.0])])
    got = sorted((str(r.doc_id), round(r.p_toxic, 4)) for r in toxicity.predict(rows, chain).collect())
    p = lambda z: round(1 / (1 + np.exp(-z)), 4)
    assert got == sorted([("1", p(4.0)), ("1", p(-1.0)), ("2", p(2.0)), ("None", p(4.0))])
