"""Reading and writing JSON-lines pools, plans, resume state and tool lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.operators.messages import KEY
from foldloom.shared import shared_dir, staged

MESSAGE = "role string, content string, name string, tool_call_id string, tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
POOL = f"trajectory_id string, instance_id string, trajectory array<struct<{MESSAGE.replace(' string', ':string').replace('tool_calls array', 'tool_calls:array')}>>"
FOLD = "struct<step_idx:int,signal:string,q_msgs:int,compressible_steps:array<int>,compressible_tokens:bigint,recent_steps:array<int>,M:string,M_tokens:int,compression_ratio:double,sufficient:boolean>"
PLANS = f"trajectory_id string, instance_id string, num_steps int, head_tokens bigint, total_step_tokens bigint, fold_points array<{FOLD}>"


def read_pool(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """Strict scan, in one pass; a bad line fails it. Arguments stay source text: an object's JSON, or, of a JSON
    string, that string in quotes, so that the two can be told apart. ``position``: a column with each line's place."""
    kind = "array<struct<tool_calls:array<struct<function:struct<arguments:variant>>>>>"
    lines = placed(spark.read.text(path), position).filter("trim(value) != ''")
    # The type of arguments is taken from the variant of the same line.
    parsed = lines.withColumns({"r": F.from_json("value", POOL, {"mode": "FAILFAST"}), "v": F.parse_json("value").cast(f"struct<trajectory:{kind}>")["trajectory"]})
    text = lambda x: F.to_json(F.array(x))
    is_text = lambda i, j: F.schema_of_variant(F.get(F.get(F.col("v"), i)["tool_calls"], j)["function"]["arguments"]) == "STRING"
    quoted = lambda m, i: m.withField("tool_calls", F.transform(m["tool_calls"], lambda c, j: c.withField("function.arguments", F.when(
        is_text(i, j), text(c["function"]["arguments"]).substr(F.lit(2), F.length(text(c["function"]["arguments"])) - 2)).otherwise(c["function"]["arguments"]))))
    return parsed.select("r.trajectory_id", "r.instance_id", F.transform("r.trajectory", quoted).alias("trajectory"), *([position] if position else []))


def placed(rows: DataFrame, name: str | None) -> DataFrame:
    """Rows of files with their place: file, block, and order inside the block."""
    if not name:
        return rows
    return rows.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def last_wins(pool: DataFrame, order: str) -> DataFrame:
    """Of records with one id the last by ``order`` (a file position) stays."""
    return pool.withColumn("r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(order)))).filter("r = 1").drop("r")


def messages_of(pool: DataFrame) -> DataFrame:
    """The long table of messages."""
    return pool.select(KEY, F.posexplode("trajectory").alias("msg_idx", "m")).select(KEY, F.col("msg_idx").cast("long").alias("msg_idx"), "m.role", "m.content", "m.name", "m.tool_call_id", F.coalesce("m.tool_calls", F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")).alias("tool_calls"))


def read_plans(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    return placed(spark.read.schema(PLANS).option("mode", "FAILFAST").json(path), position)


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids in an earlier output; lines that can't be read are passed over."""
    rows = spark.read.schema(f"{KEY} string, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.filter(f"broken IS NULL AND {KEY} IS NOT NULL").select(KEY).distinct()


def pending(plans: DataFrame, done: DataFrame) -> DataFrame:
    return plans.join(done.select(KEY), KEY, "left_anti")


def first_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows that count; filter before, as each stage counts different rows."""
    return rows.orderBy(order).limit(n)


def with_argument_values(messages: Column) -> Column:
    """Messages whose arguments, source text here, are values again when written as JSON: objects or strings."""
    value = lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), F.struct(c["function"]["name"].alias("name"), F.parse_json(c["function"]["arguments"]).alias("arguments")).alias("function"))
    one = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["name"].alias("name"), m["tool_call_id"].alias("tool_call_id"), F.when(F.size(m["tool_calls"]) > 0, F.transform(m["tool_calls"], value)).alias("tool_calls"))
    return F.transform(messages, one)


def write_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; tasks commit whole files."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_split(rows: DataFrame, path: str, ok: str = "ok") -> None:
    """Good rows to ``path``, ids and errors of the others to ``path.failed``. The rows are stored first, so that both
    come from one making of them."""
    rows = staged(rows, shared_dir(rows.sparkSession))
    write_lines(rows.filter(ok).drop(ok, "error"), path, append=True)
    bad = rows.filter(f"NOT {ok}")
    write_lines(bad.select(*[c for c in (KEY, "instance_id", "error") if c in rows.columns]), path + ".failed", append=True)


def write_dataset(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


CONTEXT_NAME = "context"
CONTEXT_TEXT = "Put a structured summary in the place of the history so far; the summary is then your long-term memory."


def read_tools(spark: SparkSession, path: str) -> list[dict]:
    """A JSON list of tools, each brought to its full form. The file is a setting, read by the driver."""
    rows = json.loads(spark.read.text(path, wholetext=True).first().value)
    return [t if "type" in t else {"type": "function", "function": t.get("function", t)} for t in rows]


def write_tools(spark: SparkSession, tools: list[dict], path: str, always: bool = False) -> list[dict]:
    """The tool list with the context tool added if absent, or always."""
    if always or not any(t["function"].get("name") == CONTEXT_NAME for t in tools):
        parameters = {"type": "object", "properties": {"summary": {"type": "string"}}, "required": ["summary"]}
        tools = [*tools, {"type": "function", "function": {"name": CONTEXT_NAME, "description": CONTEXT_TEXT, "parameters": parameters}}]
    spark.createDataFrame([(json.dumps(tools, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return tools


def with_context_tool(tools: DataFrame, description: str, always: bool = False) -> DataFrame:
    """``tools``: one row, array<struct<type,function:struct<name,description,parameters>>>. The context tool is added if
    absent, or always."""
    own = F.struct(F.lit("function").alias("type"), F.struct(F.lit(CONTEXT_NAME).alias("name"), F.lit(description).alias("description"), F.lit('{"type": "object", "properties": {"summary": {"type": "string"}}, "required": ["summary"]}').alias("parameters")).alias("function"))
    added = F.concat("tools", F.array(own))
    if always:
        return tools.withColumn("tools", added)
    return tools.withColumn("tools", F.when(F.exists("tools", lambda t: t["function"]["name"] == CONTEXT_NAME), F.col("tools")).otherwise(added))
