import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldloom.llm import langid, queries

SF = "/root/testdata/sf0.01"
QUICK = langid.Training(documents=300, steps=60)


def test_gradients_by_differences():
    network = langid.Network(["a", "b"], 3, 1)
    rng = np.random.default_rng(0)
    data, inside, target = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.ones((7, 4), np.float32), np.array([0, 1, 2, 0])
    inside[5:, 1] = 0
    _, grads = network.gradients(data, inside, target)
    for w, g in zip(network.weights(), grads, strict=True):
        at, e = np.unravel_index(np.abs(g).argmax(), g.shape), 1e-2
        old = w[at]
        losses = []
        for x in (old + e, old - e):
            w[at] = x
            losses.append(network.gradients(data, inside, target)[0])
        w[at] = old
        assert (losses[0] - losses[1]) / (2 * e) == pytest.approx(float(g[at]), rel=0.05, abs=1e-4)


def test_pooling_reads_every_byte():
    network = langid.Network(["a", "b"], 4, 3)
    texts = ["x" * n + " é" for n in (0, 1, 61, 62, 63, 64, 200)] + [""]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    together = langid.pooled(network, np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, r in enumerate(raw):
        alone = langid.pooled(network, np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(together[k], alone[0], atol=1e-5)
    data, length, row = langid.stretched(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert length.sum() == offsets[-1] and b"".join(d[:n].tobytes() for d, n in zip(data, length, strict=True)) == b"".join(raw)


def test_held_out_accuracy(spark):
    got = queries.op10_langid(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    rows = got.merge(truth, on="doc_id")
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert len(rows) == len(truth) and (held.lang_pred == held.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()


def plain(network, text):
    """Mean probabilities of a text, byte by byte, one step after the other."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    raw, total, n = text.encode(), np.zeros(len(network.languages) + 1), 0
    for at in range(0, len(raw), langid.STRETCH):
        part = raw[at : at + langid.STRETCH]

        def states(unit, bytes_):
            h, out, k = np.zeros(unit.hidden), [], unit.hidden
            for b in bytes_:
                x = unit.table[b].astype(float)
                z, r = sig(x[:k] + h @ unit.gates[:, :k]), sig(x[k : 2 * k] + h @ unit.gates[:, k:])
                h = (1 - z) * np.tanh(x[2 * k :] + (r * h) @ unit.candidate) + z * h
                out.append(h)
            return out

        both = zip(states(network.forth, part), reversed(states(network.back, part[::-1])), part, strict=True)
        for f, b, byte in both:
            if byte > 32:
                e = np.exp(np.r_[f, b] @ network.out + network.bias)
                total, n = total + e / e.sum(), n + 1
    return total / max(n, 1)


def test_pooled_probabilities_by_a_plain_network(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = langid.train(docs, QUICK)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["é", "日本 語", "x" * 65, "  "]
    raw = [t.encode() for t in texts]
    got = langid.pooled(network, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(got, [plain(network, t) for t in texts], atol=1e-4)
    rows = {r.text: r for r in langid.predict(docs.orderBy("doc_id").limit(25), network).join(docs, "doc_id").collect()}
    for t in texts[:25]:
        p = plain(network, t)[:-1]
        assert rows[t].lang_pred == network.languages[int(p.argmax())] and abs(rows[t].score - p.max()) < 1e-4


STRANGE = ["Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний.", "いろはにほへと ちりぬるを わかよたれそ つねならむ", "a 0123 456789 0123456789 2024-01-01 12:30:55 99 88 77", "xqzj vkwq zzxp qqkj wxvz jjqk zxqv kkwq", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "#$% a {}[]=> ;;; ***** ~~~ ^^^ ||| \\\\ //// ++++ !!!!"]


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    rows = spark.createDataFrame([(k, t, "xx") for k, t in enumerate(STRANGE)], "doc_id long, text string, lang string")
    assert langid.keep_known(rows, network).collect() == []
    assert all(r.score < 0.5 and r.lang_pred in network.languages for r in langid.predict(rows, network).collect())
    kept = langid.keep_known(docs, network)
    mixed = [r.text + end for r in docs.filter("n_chars < 60 AND lang = 'en' AND text NOT LIKE '%=%'").orderBy("doc_id").limit(8).collect() for end in (' token = "9004e046e75240f42eecdbd3dffbc7f3d75db0ff"', " 4397110767823743 +1 (654) 555-4136 x.79@mail5.example.com")]
    assert mixed and langid.keep_known(spark.createDataFrame([(k, t) for k, t in enumerate(mixed)], "doc_id long, text string"), network).count() == len(mixed)
    told = kept.join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert len(told) > 0.995 * docs.count() and (told.lang == told.truth).mean() > 0.97


def test_bytes_in_words():
    raw, offsets = langid.text_buffer(pa.array(["ab, c3 é-x. d=e", "(f)", "x", "\ty z9\n"]))
    data = raw.copy()
    data[~langid.in_words(raw, offsets)] = 46
    assert bytes(data).decode() == "ab,....é-x.....(f)x.y...."


def test_rare_languages_are_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10_000_000 + k, t, "ru") for k, t in enumerate(["широкая электрификация южных губерний даст мощный толчок " * 5] * 3)], docs.schema)
    network = langid.train(docs.unionByName(rare))
    assert "ru" in network.languages
    assert langid.predict(rare.limit(1), network).first().lang_pred == "ru"


def test_long_texts_and_shared_ids(spark):
    network = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), QUICK)
    long = "the thing and the ing of " * 90_000
    rows = spark.createDataFrame([(1, long), (1, "é"), (1, None), (None, "the")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(rows, network).collect())
    assert len(got) == 4 and ("1", "und") in got and ("1", "en") in got


def test_positions_are_labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = langid.train(docs, QUICK)
    text = docs.filter("lang = 'de' AND n_chars > 200").orderBy("doc_id").first().text
    labels = langid.label_positions(network, text)
    assert len(labels) == len(text.encode()) and max(set(labels), key=labels.count) == "de"
    assert langid.label_positions(network, "") == []


def test_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = langid.train(docs, QUICK)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, network).collect()]
    by = {d: (p, s) for d, p, s in got}
    assert len(got) == 12 and all(by[d] == ("und", 0.0) for d in (0, 1, 2)) and by[5][0] != "und"
    assert langid.predict(empty, network).collect() == []
    kept = langid.keep_known(odd, network, most=1.1)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (0, 1, 2)").count() == 0 and kept.count() == 9


def test_nothing_labelled(spark, odd, empty):
    for rows in (odd.withColumn("lang", F.lit(None).cast("string")), empty):
        network = langid.train(rows, QUICK)
        assert {(r.lang_pred, r.score) for r in langid.predict(odd, network).collect()} == {("und", 0.0)}
