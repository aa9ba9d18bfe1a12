"""Messages to ordered steps.

A message table has trajectory_id, msg_idx, role, content, tool_calls. A step is an assistant message with all
messages up to the next one; what comes before the first is the head (step -1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import text as T

KEY = "trajectory_id"


def with_steps(messages: DataFrame) -> DataFrame:
    """The messages with ``step_idx`` (one window over each trajectory)."""
    order = Window.partitionBy(KEY).orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("step_idx", F.sum((F.col("role") == "assistant").cast("int")).over(order) - 1)


#: Tools whose calls tell what a step does.
EDITOR, SHELL, TRACKER = "str_replace_editor", "execute_bash", "task_tracker"
EDITS = ("create", "str_replace", "insert")


def _told(calls: Column) -> Column:
    """Name and command of each call, and the command of a shell stripped: arguments are parsed once."""
    name, given = lambda c: c["function"]["name"], lambda c: c["function"]["arguments"]
    read = F.transform(calls, lambda c: F.struct(name(c).alias("name"), F.when(name(c).isin(EDITOR, SHELL, TRACKER) & F.startswith(F.ltrim(given(c)), F.lit("{")), T.argument(given(c), "command")).alias("command")))
    return F.transform(read, lambda c: F.struct(c["name"].alias("name"), c["command"].alias("command"), F.when(c["name"] == SHELL, T.strip(c["command"])).alias("ran")))


def _call(test) -> Column:
    return F.exists("told", lambda c: F.coalesce(test(c), F.lit(False)))


def steps(staged: DataFrame) -> DataFrame:
    """One row a step: thought, obs_text, rendered, flags and token counts. ``staged``: from ``with_steps``.

    Calls whose arguments are a JSON string, and other tools, count as reading only.
    """
    said = F.col("role") == "assistant"
    content = F.coalesce("content", F.lit(""))
    rows = staged.filter("step_idx >= 0").withColumn("tokens", T.token_count(T.text_of(F.col("content"), F.col("tool_calls"))))
    grouped = rows.groupBy(KEY, "step_idx").agg(
        F.max(F.when(said, content)).alias("thought"),
        F.max(F.when(said, F.coalesce("tool_calls", F.array().cast(T.calls_type())))).alias("tool_calls"),
        F.sort_array(F.collect_list(F.when(~said, F.struct("msg_idx", content.alias("content"))))).alias("obs"),
        F.sum("tokens").alias("tokens"), F.count("*").alias("n_msgs"), F.min("msg_idx").alias("first_msg"),
    )
    calls = F.col("tool_calls")
    edits = _call(lambda c: (c["name"] == EDITOR) & c["command"].isin(*EDITS))
    acts = _call(lambda c: (c["ran"] != "") & ~c["ran"].rlike(T.READ_ONLY))
    texts = {"obs_text": F.array_join(F.transform("obs", lambda o: F.concat(F.lit("\n"), o["content"])), ""), "told": _told(calls)}
    done = grouped.withColumns(texts).withColumns({
        "plan_call": _call(lambda c: (c["name"] == TRACKER) & (c["command"] == "plan")),
        "file_edit": edits, "readonly": ~(edits | acts),
        "err": T.has_error(F.col("obs_text")), "verified": T.has_verified(F.col("obs_text")),
        "rendered": render(F.col("thought"), calls, F.col("obs_text")),
    })
    return done.drop("obs", "told")


def render(thought: Column, calls: Column, obs: Column) -> Column:
    """Thought, actions and observation, each on its line if there is any."""
    actions = F.array_join(F.transform(calls, lambda c: F.concat(F.coalesce(c["function"]["name"], F.lit("None")), F.lit("("), F.coalesce(c["function"]["arguments"], F.lit("null")), F.lit(")"))), " ; ")
    part = lambda label, x: F.concat(F.lit(label + ": "), F.nullif(x, F.lit("")))
    return F.concat_ws("\n", part("Thought", T.strip(thought)), F.when(F.size(calls) > 0, F.concat(F.lit("Action: "), actions)), part("Observation", T.strip(obs)))


def heads(staged: DataFrame) -> DataFrame:
    """Of each trajectory: head_tokens, q_msgs, and the task (the first user message of the head, 4000 characters)."""
    rows = staged.filter("step_idx < 0").withColumn("tokens", T.token_count(T.text_of(F.col("content"), F.col("tool_calls"))))
    task = F.min_by(F.coalesce("content", F.lit("")), F.when(F.col("role") == "user", F.col("msg_idx")))
    return rows.groupBy(KEY).agg(F.sum("tokens").alias("head_tokens"), F.count("*").alias("q_msgs"), F.substring(F.coalesce(task, F.lit("")), 1, 4000).alias("task"))


def step_counts(staged: DataFrame) -> DataFrame:
    """Steps of each trajectory; those without any are dropped."""
    return staged.groupBy(KEY).agg((F.max("step_idx") + 1).alias("num_steps")).filter("num_steps > 0")
