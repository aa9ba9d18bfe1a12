"""Budgets, truncation, healing decisions, the extractive summary, rolling memories, all-or-nothing plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import text as T
from foldloom.operators.folding import in_range
from foldloom.operators.messages import EDITOR, EDITS, KEY, SHELL

ELIDED = "\n\n[... trajectory middle elided for length ...]\n\n"


def budget(tokens: Column, ratio: float = 0.30, most: int = 6000) -> Column:
    return F.greatest(F.lit(128), F.least((tokens * F.lit(ratio)).cast("long"), F.lit(most))).cast("long")


def output_cap(budget_: Column, most: int = 6000, forward: bool = False) -> Column:
    room, least = (768, 1280) if forward else (512, 1024)
    return F.least(F.lit(most + room), F.greatest(F.lit(least), 2 * budget_)).cast("long")


def input_cap(output: Column, continuation_tokens: Column | None = None, model_length: int = 32768) -> Column:
    if continuation_tokens is None:
        return F.lit(model_length) - output - 256
    return F.lit(model_length) - output - continuation_tokens - 384


def truncated(x: Column, cap: Column) -> tuple[Column, Column]:
    """First 60 % and last 40 % of ``cap`` tokens with a mark between, and whether anything was cut. Tokens of the
    default tokenizer are joined by blanks."""
    tok = T.tokens(x)
    head = F.floor(cap * F.lit(0.6)).cast("int")
    tail = F.greatest(F.lit(0), cap - head).cast("int")
    cut = F.size(tok) > cap
    end = F.when(tail > 0, F.array_join(F.slice(tok, F.greatest(F.size(tok) - tail + 1, F.lit(1)), tail), " ")).otherwise(F.lit(""))
    return F.when(cut, F.concat(F.array_join(F.slice(tok, F.lit(1), head), " "), F.lit(ELIDED), end)).otherwise(x), cut


def ratio(memory_tokens: Column, tokens: Column) -> Column:
    return memory_tokens / F.greatest(F.lit(1), tokens)


def ratio_action(value: Column, cut: Column, least: float = 0.18, most: float = 0.60, guard_truncated: bool = True) -> Column:
    """What one healing pass does: strict, expand or accept. A truncated slice isn't expanded if guarded."""
    small = (value < F.lit(least)) & (~cut if guard_truncated else F.lit(True))
    return F.when(value > F.lit(most), "strict").when(small, "expand").otherwise("accept")


def step_facts(steps: DataFrame) -> DataFrame:
    """What a step did, for summaries and the recall audit: arrays of state-changing commands and edited paths,
    of failing commands, and of error lines. Arguments that are JSON strings of an object count as that object."""
    none = F.array().cast("array<string>")
    # Arguments are read, and commands stripped, once a call: each name below is bound by the transform before it.
    held = F.transform("tool_calls", lambda c: F.struct(c["function"]["name"].alias("name"), T.coerced(c["function"]["arguments"]).alias("given")))
    told = F.transform(held, lambda c: F.struct(c["name"].alias("name"), c["given"].alias("given"), F.when(c["name"].isin(EDITOR, SHELL), T.argument(c["given"], "command")).alias("command")))
    edits = lambda c: (c["name"] == EDITOR) & c["command"].isin(*EDITS)
    made = F.transform(told, lambda c: F.struct(F.coalesce(edits(c), F.lit(False)).alias("edits"), F.when(edits(c), T.argument(c["given"], "path")).alias("path"), F.when(c["name"] == SHELL, T.strip(c["command"])).alias("ran")))
    acts = lambda c, pattern: (c["ran"] != "") & ~c["ran"].rlike(pattern)
    present = lambda f: F.filter(F.transform("made", f), lambda x: x.isNotNull() & (x != ""))
    return steps.withColumn("made", made).withColumns({
        "did": present(lambda c: F.when(c["edits"], c["path"]).when(acts(c, T.READ_ONLY), c["ran"])),
        "edited": present(lambda c: c["path"]),
        "ran": present(lambda c: F.when(acts(c, T.READ_ONLY_RECALL), F.substring(c["ran"], 1, 60))),
        "tried": F.when(F.col("err"), present(lambda c: c["ran"])).otherwise(none),
        # Only a step with an error has lines with one.
        "error_lines": F.when(F.col("err"), F.filter(F.transform(T.lines(F.col("obs_text")), T.strip), T.has_error)).otherwise(none),
        "action": F.when(F.col("file_edit"), "edit").when(~F.col("readonly"), "run").when(F.col("plan_call"), "plan").otherwise("read"),
    }).drop("made")


def summaries(folds: DataFrame, facts: DataFrame, heads: DataFrame) -> DataFrame:
    """The offline extractive summary M of each fold's compressed range. It stands in for a language model; its
    figures are its own."""
    some = folds.filter("comp_lo IS NOT NULL")
    rows = in_range(some, facts, F.col("comp_lo"), F.col("comp_hi"), ["did", "error_lines", "tried"])
    order = F.sort_array(F.collect_list(F.struct("step", "did", "error_lines", "tried")))
    each = rows.groupBy(KEY, "fold").agg(order.alias("s"))
    listed = lambda name: F.coalesce(F.nullif(F.array_join(F.array_distinct(F.flatten(F.transform("s", lambda x: x[name]))), "\n"), F.lit("")), F.lit("None yet"))
    told = each.select(KEY, "fold", listed("did").alias("did"), listed("error_lines").alias("feedback"), listed("tried").alias("dead"))
    lasts = facts.select(KEY, F.col("step_idx").alias("comp_hi"), F.when(F.col("err"), T.strip(F.col("obs_text"))).otherwise(F.lit("None yet")).alias("open"))
    nexts = facts.select(KEY, F.col("step_idx").alias("after"), "action")
    met = some.withColumn("after", F.col("comp_hi") + 1).join(nexts.hint("merge"), [KEY, "after"], "left").join(lasts.hint("merge"), [KEY, "comp_hi"]).join(heads.select(KEY, "task").hint("merge"), KEY, "left")
    met = met.withColumn("fold", F.col("step_idx")).join(told.hint("merge"), [KEY, "fold"])
    body = [F.coalesce("task", F.lit("")), F.col("did"), F.col("feedback"), F.lit("None"), F.col("dead"), F.col("open"), F.coalesce("action", F.lit("finish"))]
    parts = [F.concat(F.lit(h + "\n"), b) for h, b in zip(T.HEADERS, body, strict=True)]
    return met.select(*folds.columns, F.concat_ws("\n\n", *parts).alias("M"))


def all_or_nothing(folds: DataFrame, plans: DataFrame, ok: Column) -> DataFrame:
    """Of each plan: number of folds, and whether all are ok (a plan without folds is)."""
    per = folds.groupBy(KEY).agg(F.count("*").alias("n_folds"), F.bool_and(ok).alias("ok"))
    return plans.select(KEY).distinct().join(per, KEY, "left").select(KEY, F.coalesce("n_folds", F.lit(0)).alias("n_folds"), F.coalesce("ok", F.lit(True)).alias("ok"))


def select_rolling(folds: DataFrame) -> DataFrame:
    """Folds that don't begin inside the last kept one, ascending by comp_lo; with ``prev_hi`` (-1 at first)."""
    rest = [c for c in folds.columns if c != KEY]
    s = F.array_sort(F.collect_list(F.struct(F.col("comp_lo").alias("lo"), F.col("comp_hi").alias("hi"), F.col("step_idx").alias("idx"))))
    kind = "array<struct<idx:bigint,prev_hi:bigint>>"
    start = F.struct(F.lit(-1).cast("long").alias("prev"), F.array().cast(kind).alias("out"))

    def step(acc: Column, f: Column) -> Column:
        take = f["lo"] > acc["prev"]
        one = F.array(F.struct(f["idx"].cast("long").alias("idx"), acc["prev"].alias("prev_hi")))
        return F.struct(F.when(take, f["hi"].cast("long")).otherwise(acc["prev"]).alias("prev"), F.when(take, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    kept = folds.filter("comp_lo IS NOT NULL").groupBy(KEY).agg(s.alias("s")).select(KEY, F.explode(F.aggregate("s", start, step)["out"]).alias("k"))
    return folds.join(kept.select(KEY, F.col("k.idx").alias("step_idx"), F.col("k.prev_hi").alias("prev_hi")), [KEY, "step_idx"]).select(KEY, *rest, "prev_hi")


def rolling_memories(chosen: DataFrame) -> DataFrame:
    """M_i of each chosen fold (columns M: its own block, new_pinned: anchor lines of its steps): pinned lines are
    carried forward word for word, by one fold over each trajectory's memories."""
    s = F.array_sort(F.collect_list(F.struct("comp_lo", "step_idx", "new_pinned")))
    kind = "array<struct<idx:bigint,pinned:string>>"

    def step(acc: Column, f: Column) -> Column:
        merged = T.merged_pinned(F.try_element_at(acc, F.lit(-1))["pinned"], f["new_pinned"])
        return F.concat(acc, F.array(F.struct(f["step_idx"].cast("long").alias("idx"), merged.alias("pinned"))))

    # The arrays are never empty; ``explode`` would have them made twice, to filter empty ones before.
    pinned = chosen.groupBy(KEY).agg(s.alias("s")).select(KEY, F.explode_outer(F.aggregate("s", F.array().cast(kind), step)).alias("p"))
    met = chosen.join(pinned.select(KEY, F.col("p.idx").alias("step_idx"), F.col("p.pinned").alias("pinned")), [KEY, "step_idx"])
    return met.withColumn("M", T.with_pinned(F.col("M"), F.col("pinned")))


def pinned_lines(chosen: DataFrame) -> DataFrame:
    """``chosen`` with what the offline summary pins: the lines of its own attempts."""
    lines = F.concat_ws("\n", F.transform(F.split(T.section(F.col("M"), "[Attempts & Results]"), "\n"), lambda x: F.concat(F.lit("- "), x)))
    return chosen.withColumn("new_pinned", lines)


def with_prior(rolling: DataFrame) -> DataFrame:
    """Rolling memories with the one before: prev_M, prev_signal."""
    order = Window.partitionBy(KEY).orderBy("comp_lo")
    return rolling.withColumns({"prev_M": F.lag("M").over(order), "prev_signal": F.lag("signal").over(order)})


def word_budget(words: Column, ratio_: float = 0.30, most: int = 4000) -> Column:
    return F.greatest(F.lit(128), F.least((words * F.lit(1.3) * F.lit(ratio_)).cast("long"), F.lit(most))).cast("long")


def word_ratio(memory: Column, before: Column, new_steps: Column) -> Column:
    """Words of a rolling memory for each word of what it consolidates: the memory before and the new steps."""
    return T.word_count(memory) / F.greatest(F.lit(1), T.word_count(before) + T.word_count(new_steps))
