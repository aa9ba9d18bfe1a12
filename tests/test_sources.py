import json

import pytest
from pyspark.sql import functions as F

from foldloom.operators import messages
from foldloom.operators.messages import KEY
from foldloom.sources import pool


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def record(tid, *msgs):
    return {"trajectory_id": tid, "instance_id": "i" + tid, "trajectory": list(msgs)}


def call(arguments):
    return {"id": "c", "type": "function", "function": {"name": "execute_bash", "arguments": arguments}}


def test_pool_with_both_kinds_of_arguments(spark, tmp_path):
    path = lines(tmp_path / "pool.jsonl", [
        record("a", {"role": "system", "content": "s"}, {"role": "user", "content": None}, {"role": "tool", "content": "stray"},
               {"role": "assistant", "content": None, "tool_calls": [call({"command": "make", "b": 1}), call('{"command": "make"}')]}, {"role": "tool", "content": "ok"}),
        record("b", {"role": "user", "content": "only head"}),
    ])
    rows = pool.messages_of(pool.read_pool(spark, path))
    got = rows.filter("trajectory_id = 'a' AND msg_idx = 3").first().tool_calls
    assert json.loads(got[0].function.arguments) == {"command": "make", "b": 1}
    assert json.loads(got[1].function.arguments) == '{"command": "make"}'
    staged = messages.with_steps(rows)
    assert [r.num_steps for r in messages.step_counts(staged).collect()] == [1]
    assert messages.heads(staged).filter("trajectory_id = 'a'").first().q_msgs == 3


def test_pool_scan_is_strict(spark, tmp_path):
    path = lines(tmp_path / "bad.jsonl", [record("a"), '{"trajectory_id": "b", "traj'])
    with pytest.raises(Exception):
        pool.read_pool(spark, path).collect()


def test_resume_passes_over_broken_lines(spark, tmp_path):
    path = lines(tmp_path / "done.jsonl", [record("a"), record("a"), '{"trajectory_id": "b", "traj'])
    done = pool.done_ids(spark, path)
    assert [r[0] for r in done.collect()] == ["a"]
    plans = spark.createDataFrame([("a",), ("b",), ("c",)], f"{KEY} string")
    assert sorted(r[0] for r in pool.pending(plans, done).collect()) == ["b", "c"]


def test_last_record_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], f"{KEY} string, at int, v string")
    assert sorted((r[0], r.v) for r in pool.last_wins(rows, "at").collect()) == [("a", "y"), ("b", "z")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "i", True, None), ("b", "j", False, "boom")], f"{KEY} string, instance_id string, ok boolean, error string")
    out = str(tmp_path / "out")
    pool.write_split(rows, out)
    pool.write_split(rows, out)
    assert spark.read.json(out).count() == 2
    assert {r.error for r in spark.read.json(out + ".failed").collect()} == {"boom"}
    pool.write_lines(rows.filter("ok"), out)
    assert spark.read.json(out).count() == 1
    pool.write_dataset(rows, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).count() == 2


def test_context_tool_is_added(spark):
    kind = "array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>"
    tools = spark.createDataFrame([([("function", ("context", "d", "{}"))],), ([("function", ("bash", "d", "{}"))],)], f"tools {kind}")
    sizes = lambda df: sorted(r[0] for r in df.select(F.size("tools")).collect())
    assert sizes(pool.with_context_tool(tools, "d")) == [1, 2]
    assert sizes(pool.with_context_tool(tools, "d", always=True)) == [2, 2]


def test_plans_are_read(spark, tmp_path):
    fold = {"step_idx": 3, "signal": "expansion", "q_msgs": 2, "compressible_steps": None, "compressible_tokens": 0, "recent_steps": [0, 3]}
    path = lines(tmp_path / "plans.jsonl", [{"trajectory_id": "a", "instance_id": "i", "num_steps": 9, "head_tokens": 4, "total_step_tokens": 7, "fold_points": [fold]}])
    row = pool.read_plans(spark, path).first()
    assert row.fold_points[0].compressible_steps is None and row.fold_points[0].recent_steps == [0, 3]
