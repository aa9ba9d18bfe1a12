"""Registered queries against DuckDB on the smallest tables (those of this package alone)."""

import os

import duckdb
import pytest

from foldloom.plans import oracle, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.oracle_sql()
#: The rest runs in the driver's own comparison; these cover every operator module in a minute.
CHOSEN = ("fold_points_events", "fold_segments_tokens", "fold_points_conversations", "conv_steps", "conv_step_render", "event_text_of", "identifier_extract", "memory_blocks", "pinned_merge", "rolling_memory", "rolling_examples", "stitched_messages", "stitched_mask", "rendered_chat", "rolling_mask", "gate_decision", "gate_stats", "gate_repair", "gate_repair_stats", "leak_check", "assistant_mask", "pad_batches", "recall_summary", "recall_string_arguments", "recall_sample", "rolling_word_ratio", "avg_compression", "pool_round_trip", "prompt_forward", "prompt_rolling", "folds_online")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def shown(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    spark.catalog.clearCache()
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert shown(tuple(r) for r in got.select(*columns).collect()) == shown(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_online_detection_in_many_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from foldloom.operators.messages import KEY
    from foldloom.streaming import online

    run = queries.Run(spark, SF)
    rows = run.steps.join(run.heads.select(KEY, "head_tokens"), KEY).select(KEY, F.col("step_idx").cast("long").alias("step_idx"), "tokens", "head_tokens", "plan_call", "readonly", "err", "verified")
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for low in (20, 0, 45):
        high = {0: 20, 20: 45, 45: 1000}[low]
        rows.filter(F.col("step_idx").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = online.detect(spark.readStream.schema(online.STEP).parquet(str(tmp_path / "in")), queries.RULES)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset(store)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(KEY, "step_idx", "signal").collect())
    assert got == sorted(tuple(r) for r in run.folds.select(KEY, "step_idx", "signal").collect())
