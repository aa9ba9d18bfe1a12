"""Adapters from plain tables to message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.functions.text import calls_type
from foldloom.operators.messages import KEY
from foldloom.shared import buckets


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias(KEY), F.col("turn").alias("msg_idx"), "role", F.col("text").alias("content"), *(F.lit(None).cast("string").alias(c) for c in ("name", "tool_call_id")), F.array().cast(calls_type()).alias("tool_calls"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two messages an event (an action and what it gave), after one system and one user message a user."""
    order = Window.partitionBy(KEY).orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Events are dealt by trajectory once, before their texts are made; the steps' windows need no other order.
    dealt = rows.select(F.col("user_id").alias(KEY), "ts", "event_id", "event_type", F.regexp_extract("props", r"(\d+)", 1).alias("k")).repartition(buckets(rows), KEY)
    events = dealt.select(KEY, (F.row_number().over(order) - 1).cast("long").alias("i"), "event_id", "event_type", "k")
    kind, k = F.col("event_type"), F.col("k")
    path = F.concat(F.lit("src/mod_"), k, F.lit(".py"))
    edit = lambda command, more="": F.concat(F.lit(f'{{"command": "{command}", "path": "'), path, F.lit('"' + more), F.lit("}"))
    code = F.concat(F.lit(', "file_text": "def handle_'), k, F.lit('(value, scale=1.0):\\n    return scale * value + '), k, F.lit('"'))
    run = lambda *command: F.concat(F.lit('{"command": "'), *command, F.lit('"}'))
    arguments = (
        F.when(kind == "view", edit("view"))
        .when(kind == "click", run(F.lit("ls src")))
        .when(kind == "signup", F.concat(F.lit('{"command": "create", "path": "'), path, F.lit('"'), code, F.lit("}")))
        .when(kind == "purchase", run(F.lit("make order_"), F.col("event_id").cast("string")))
        .otherwise(run(F.lit("cat log_"), k))
    )
    seen = (
        F.when(kind == "view", F.concat(F.lit("viewed "), path))
        .when(kind == "click", F.concat(F.lit("item "), k))
        .when(kind == "signup", F.lit("file created"))
        .when(kind == "purchase", F.lit("3 passed"))
        .otherwise(F.concat(F.lit("ValueError: bad k="), k))
    )
    call = lambda n, name, args: F.struct(F.concat(F.lit(f"call_{n}_"), F.col("event_id").cast("string")).alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), args.alias("arguments")).alias("function"))
    tool = F.when(kind.isin("view", "signup"), F.lit("str_replace_editor")).otherwise(F.lit("execute_bash"))
    calls = F.array(call(0, tool, arguments))
    calls = F.when(F.col("event_id") % 97 == 0, F.concat(calls, F.array(call(1, F.lit("task_tracker"), F.lit('{"command": "plan"}'))))).otherwise(calls)
    thought = F.concat(F.lit("Next `step_"), k, F.lit("` with "), kind, F.lit(" on pkg.mod_"), k)
    # Texts are made in a projection, each once: under ``explode`` all is made wherever it is named.
    events = events.select(KEY, "i", thought.alias("thought"), calls.alias("calls"), tool.alias("tool"), seen.alias("seen"))
    none = F.array().cast(calls_type())
    blank = F.lit(None).cast("string")
    message = lambda at, role, content, c, name=blank, answers=blank: F.struct(at.cast("long").alias("msg_idx"), F.lit(role).alias("role"), content.alias("content"), name.alias("name"), answers.alias("tool_call_id"), c.cast(calls_type()).alias("tool_calls"))
    body = F.array(message(2 + 2 * F.col("i"), "assistant", F.col("thought"), F.col("calls")), message(3 + 2 * F.col("i"), "tool", F.col("seen"), none, F.col("tool"), F.col("calls")[0]["id"]))
    head = F.array(
        message(F.lit(0), "system", F.lit("You are a careful engineer."), none),
        message(F.lit(1), "user", F.concat(F.lit("Fix the service of user "), F.col(KEY).cast("string"), F.lit(".")), none),
    )
    return events.select(KEY, F.explode(F.when(F.col("i") == 0, F.concat(head, body)).otherwise(body)).alias("m")).select(KEY, "m.*")
