import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from foldloom.llm import common, secret_scan
from tests.llm.conftest import SMALL
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_packing import check
from tests.llm.test_substring_dedup import brute as repeats_brute

import __spark_entry__

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark):
    docs = common.documents(spark, SMALL)
    before = {r.doc_id: r for r in docs.collect()}
    folder = common.shared_dir(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, SMALL), f"{folder}/{name}")
        rows = docs.collect()
        if name == "language_id":
            kept = {r.doc_id: r for r in rows}
            assert all(re.search(r"[^\W\d_]", before[d].text) for d in kept) and len(kept) > 0.98 * len(before)
        elif name == "near_dedup":
            classes = near_brute([(d, r.text) for d, r in sorted(kept.items())])
            kept = {d: r for d, r in kept.items() if classes[d] == d}
            assert {r.doc_id: r.text for r in rows} == {d: r.text for d, r in kept.items()}
        elif name == "substring_dedup":
            want = {d: (r.text if not n else text) for (d, r), (_, n, text) in ((x, y) for x, y in zip(sorted(kept.items()), [v for _, v in sorted(repeats_brute([(d, r.text) for d, r in kept.items()]).items())], strict=True)) if not n or text}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows if r.text != kept[r.doc_id].text)
            kept = {r.doc_id: r for r in rows}
        elif name == "secret_scan":
            assert {r.doc_id: r.text for r in rows} == {d: secret_scan.redact(r.text, secret_scan.find_secrets(r.text)) for d, r in kept.items()}
            kept = {r.doc_id: r for r in rows}
        else:
            check([(d, r.text) for d, r in kept.items()], rows, 2048, 0)
        if name != "packing":
            assert docs.columns == COLUMNS
    whole = __spark_entry__.queries()["pipeline"](spark, SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32)
    assert Counter(map(key, whole)) == Counter(map(key, rows))


def test_rows_that_share_ids_keep_their_own_text(spark):
    """Rows with one id and different texts, null ids, repeated rows, empty and long texts: each stage, row by row,
    against plain versions over rows in the order of id (null first) and text."""
    en = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang = 'en' AND n_chars BETWEEN 900 AND 4000").orderBy("doc_id").limit(9).collect()]
    passage = " ".join(en[7].split()[:60])
    rows = [(2, en[0]), (2, en[1] + " " + passage), (2, en[0]), (3, en[0]), (None, en[2] + " " + passage), (None, en[3] + " " + passage), (None, en[2] + " " + passage), (5, passage), (5, en[4] + " password: hunter2hunter2"), (6, None), (6, ""), (7, " ".join(en * 160)), (None, None)]
    df = spark.createDataFrame([(d, t, None, "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    shown = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    ordered = order(rows)
    classes = near_brute([(k, t) for k, (_, t) in enumerate(ordered)])
    extra = df.withColumns({"row_number": F.lit(7), "kept_text": F.lit("k")})
    one = corpus_pipeline.one_of_each_group(spark, extra, SMALL)
    assert one.columns == extra.columns and one.filter("row_number != 7").count() == 0 and shown(one) == Counter(r for k, r in enumerate(ordered) if classes[k] == k)
    cut = repeats_brute([(k, t) for k, (_, t) in enumerate(ordered)])
    want = Counter((d, t if not cut[k][1] else cut[k][2]) for k, (d, t) in enumerate(ordered) if not cut[k][1] or cut[k][2])
    left = corpus_pipeline.without_repeats(spark, extra, SMALL)
    assert left.columns == extra.columns and left.filter("kept_text != 'k'").count() == 0 and shown(left) == want
    clean = corpus_pipeline.without_secrets(spark, df, SMALL)
    assert shown(clean) == Counter((d, t and secret_scan.redact(t, secret_scan.find_secrets(t))) for d, t in rows)
    check(rows, corpus_pipeline.packed(spark, df, SMALL).collect(), 2048, 0)
    labelled = df.withColumn("lang", F.when(F.col("text").isNotNull(), "en"))
    known = corpus_pipeline.known_language(spark, labelled.unionByName(common.documents(spark, SMALL).select(COLUMNS)), SMALL)
    assert known.columns == COLUMNS and Counter((r.doc_id, r.text) for r in known.filter("source = 's'").collect()) == Counter(r for r in rows if r[1])
    assert {r.lang for r in known.filter("source = 's'").collect()} == {"en"}


def test_odd_rows(spark, odd, empty):
    rows = odd.selectExpr("doc_id", "text", "lang", "cast(null as string) AS source", "cast(null as bigint) AS n_chars")
    for docs in (rows, rows.limit(0), rows.withColumn("lang", rows.source)):
        folder = common.shared_dir(spark)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.staged(stage(spark, docs, SMALL), f"{folder}/{name}")
        assert docs.columns[:2] == ["doc_id", "piece"]
