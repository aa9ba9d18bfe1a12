"""Stitching memories into conversations, and rolling examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import text as T
from foldloom.operators.messages import KEY

#: A message as it goes on: its calls whole, and which call an observation answers.
MESSAGE = ["role", "content", "name", "tool_call_id", "tool_calls"]
OUT = [KEY, "pos", *MESSAGE]


def blocks(folds: DataFrame) -> DataFrame:
    """Folds whose memory is used: of equal comp_lo the last, inside the trajectory, with a memory, and not begun
    inside a used one."""
    good = folds.filter("comp_lo >= 0 AND comp_lo <= comp_hi AND comp_hi < num_steps AND M IS NOT NULL AND M != ''")
    last = good.withColumn("r", F.row_number().over(Window.partitionBy(KEY, "comp_lo").orderBy(F.desc("step_idx")))).filter("r = 1").drop("r")
    s = F.array_sort(F.collect_list(F.struct(F.col("comp_lo").alias("lo"), F.col("comp_hi").alias("hi"), F.col("step_idx").alias("idx"))))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        take = f["lo"] > acc["end"]
        return F.struct(F.when(take, f["hi"].cast("long")).otherwise(acc["end"]).alias("end"), F.when(take, F.concat(acc["out"], F.array(f["idx"].cast("long")))).otherwise(acc["out"]).alias("out"))

    used = last.groupBy(KEY).agg(s.alias("s")).select(KEY, F.explode(F.aggregate("s", start, step)["out"]).alias("step_idx"))
    return last.join(used.hint("merge"), [KEY, "step_idx"], "left_semi")


def context_pair(signal: Column, memory: Column, place: Column) -> Column:
    """The two messages that put a memory into a conversation: a call with the memory as its summary, and its answer.
    The id of the call is a digest of ``place`` and memory."""
    call = F.concat(F.lit("call_ctx_"), F.substring(F.sha2(F.concat_ws("|", place, memory), 256), 1, 24))
    calls = F.array(F.struct(call.alias("id"), F.lit("function").alias("type"), F.struct(F.lit("context").alias("name"), F.to_json(F.struct(memory.alias("summary"))).alias("arguments")).alias("function"))).cast(T.calls_type())
    none, empty = F.lit(None).cast("string"), F.array().cast(T.calls_type())
    one = lambda k, role, content, name, answers, made: F.struct(F.lit(k).cast("long").alias("k"), F.lit(role).alias("role"), content.alias("content"), name.alias("name"), answers.alias("tool_call_id"), made.alias("tool_calls"))
    return F.array(one(0, "assistant", T.phrase(signal), none, none, calls), one(1, "tool", F.lit(T.ACKNOWLEDGED), F.lit("context"), call, empty))


def raw_rows(staged: DataFrame) -> DataFrame:
    """Messages as they came."""
    kept = [c if c in staged.columns else F.lit(None).cast("string").alias(c) for c in MESSAGE[:-1]]
    return staged.select(KEY, "step_idx", "msg_idx", *kept, F.coalesce("tool_calls", F.array().cast(T.calls_type())).alias("tool_calls"))


def stitched(staged: DataFrame, folds: DataFrame) -> DataFrame:
    """Messages of every conversation that uses a memory: raw steps outside used blocks, the pair in a block's place."""
    used = blocks(folds).select(KEY, "comp_lo", "comp_hi", "step_idx", "signal", "M")
    raw = raw_rows(staged).join(used.select(KEY).distinct().hint("merge"), KEY, "left_semi")
    folded = used.select(KEY, F.explode(F.sequence("comp_lo", "comp_hi")).alias("step_idx"))
    open_ = raw.join(folded.hint("merge"), [KEY, "step_idx"], "left_anti")
    pairs = used.select(KEY, F.col("comp_lo").alias("step_idx"), F.explode(context_pair(F.col("signal"), F.col("M"), F.concat_ws("|", KEY, "step_idx"))).alias("m"))
    pairs = pairs.select(KEY, "step_idx", F.col("m.k").alias("msg_idx"), *(f"m.{c}" for c in MESSAGE))
    # As in ``gate.score``: the key has a name of its own in the union, so that its parts stay where they are dealt.
    every = open_.withColumnRenamed(KEY, "of").unionByName(pairs.withColumnRenamed(KEY, "of"))
    pos = F.row_number().over(Window.partitionBy("of").orderBy("step_idx", "msg_idx")) - 1
    return every.withColumn("pos", pos.cast("long")).select(F.col("of").alias(KEY), *OUT[1:])


def stitch_stats(staged: DataFrame, out: DataFrame, folds: DataFrame) -> DataFrame:
    used = blocks(folds).groupBy(KEY).agg(F.count("*").alias("n"))
    before = staged.groupBy(KEY).agg(F.count("*").alias("before"))
    after = out.groupBy(KEY).agg(F.count("*").alias("after"))
    return used.join(before, KEY).join(after, KEY).agg(F.count("*").alias("n_conversations"), F.round(F.avg("n"), 3).alias("avg_folds"), F.sum("before").alias("messages_before"), F.sum("after").alias("messages_after"))


def rolling_examples(staged: DataFrame, chosen: DataFrame, horizon: int = 6) -> DataFrame:
    """Messages of one example a chosen fold (with prev_hi, prev_M, prev_signal, M): head, prior memory, the raw steps
    since, then the new memory (from ``target_from_msg`` on) and what follows."""
    f = chosen.select(KEY, F.col("step_idx").alias("fold"), "signal", "M", "comp_hi", "prev_hi", "prev_M", "prev_signal")
    raw = raw_rows(staged).withColumn("step_idx", F.col("step_idx").cast("long"))
    low, high = F.col("prev_hi").cast("long") + 1, F.col("comp_hi").cast("long") + horizon
    near = f.select(KEY, "fold", "comp_hi", F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.sequence(low, high))).alias("step_idx")).join(raw, [KEY, "step_idx"])
    step, columns = F.col("step_idx"), [KEY, "fold", "part", "msg_idx", *MESSAGE]
    part = F.when(step == -1, 0).when(step <= F.col("comp_hi"), 2).otherwise(4)
    rows = near.withColumn("part", part).select(columns)
    pair = lambda when, k, signal, memory, place: f.filter(when).select(KEY, "fold", F.lit(k).alias("part"), F.explode(context_pair(F.col(signal), F.col(memory), place)).alias("m")).select(KEY, "fold", "part", F.col("m.k").alias("msg_idx"), *(f"m.{c}" for c in MESSAGE))
    prior, own = F.concat_ws("|", KEY, "fold", F.lit("prior")), F.concat_ws("|", KEY, "fold")
    every = rows.unionByName(pair("prev_M IS NOT NULL", 1, "prev_signal", "prev_M", prior)).unionByName(pair("true", 3, "signal", "M", own))
    of = Window.partitionBy(KEY, "fold")
    pos = F.row_number().over(of.orderBy("part", "msg_idx")) - 1
    return every.withColumn("target_from_msg", F.sum((F.col("part") < 3).cast("int")).over(of)).withColumn("pos", pos.cast("long")).select(KEY, "fold", "target_from_msg", *OUT[1:])
