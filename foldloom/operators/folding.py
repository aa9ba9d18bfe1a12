"""Fold detection and segmentation.

What doesn't depend on acceptance is window work; acceptance itself (the distance to the last fold, tokens since it)
is one ``aggregate`` over the steps' small structs, so no text is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import text as T
from foldloom.operators.messages import KEY


@dataclass(frozen=True)
class FoldRules:
    t_fold: int = 16000
    min_gap: int = 8
    recent_k: int = 6
    err_run: int = 2


def signals(steps: DataFrame, rules: FoldRules) -> DataFrame:
    """The steps with the errors right before them, whether an action came before, and the structural signal."""
    order = Window.partitionBy(KEY).orderBy("step_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    clean = F.coalesce(F.max(F.when(~F.col("err"), F.col("step_idx"))).over(before), F.lit(-1))
    rows = steps.withColumns({
        "error_run": F.col("step_idx") - 1 - clean,
        "seen_action": F.coalesce(F.max((~F.col("readonly")).cast("int")).over(before), F.lit(0)) == 1,
    })
    signal = (
        F.when(F.col("plan_call"), T.PLAN)
        .when(F.col("verified") & ~F.col("err"), T.VERIFIED)
        .when(~F.col("readonly") & ~F.col("seen_action"), T.FIRST_ACTION)
        .when((F.col("error_run") >= rules.err_run) & ~F.col("err"), T.RECOVERY)
    )
    return rows.withColumn("signal", signal)


def accepted(steps: Column, head: Column, rules: FoldRules) -> Column:
    """Accepted (idx, signal) of the ascending structs (idx, signal, tokens) of one trajectory."""
    far = F.lit(-(10**9)).cast("long")
    kind = "array<struct<idx:bigint,signal:string>>"
    start = F.struct(far.alias("last"), head.cast("long").alias("tokens"), F.array().cast(kind).alias("out"))
    last_fold = F.size(steps) - rules.recent_k - 1

    def step(acc: Column, s: Column) -> Column:
        tokens = acc["tokens"] + s["tokens"]
        signal = F.coalesce(s["signal"], F.when(tokens >= rules.t_fold, F.lit(T.EXPANSION)))
        take = signal.isNotNull() & (s["idx"] <= last_fold) & (s["idx"] - acc["last"] >= rules.min_gap)
        return F.struct(
            F.when(take, s["idx"]).otherwise(acc["last"]).alias("last"),
            F.when(take, head.cast("long")).otherwise(tokens).alias("tokens"),
            F.when(take, F.concat(acc["out"], F.array(F.struct(s["idx"].alias("idx"), signal.alias("signal"))))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(steps, start, step)["out"]


def fold_points(steps: DataFrame, heads: DataFrame, rules: FoldRules) -> DataFrame:
    """trajectory_id, num_steps, step_idx, signal, comp_lo, comp_hi, recent_lo, recent_hi of each fold."""
    rows = signals(steps, rules).select(KEY, F.struct(F.col("step_idx").cast("long").alias("idx"), "signal", F.col("tokens").cast("long").alias("tokens")).alias("s"))
    per = rows.groupBy(KEY).agg(F.array_sort(F.collect_list("s")).alias("steps")).join(heads.select(KEY, "head_tokens").hint("merge"), KEY, "left")
    out = per.select(KEY, F.size("steps").cast("long").alias("num_steps"), F.explode(accepted(F.col("steps"), F.coalesce("head_tokens", F.lit(0)), rules)).alias("f"))
    return segmented(out.select(KEY, "num_steps", F.col("f.idx").alias("step_idx"), "f.signal"), rules)


def segmented(folds: DataFrame, rules: FoldRules) -> DataFrame:
    """Ranges of the folds: what is compressed (null if nothing), and the recent steps that stay."""
    start = F.lag("step_idx", 1, -1).over(Window.partitionBy(KEY).orderBy("step_idx")) + 1
    rows = folds.withColumn("start", start).withColumn("recent_lo", F.greatest("start", F.col("step_idx") - rules.recent_k + 1))
    some = F.col("recent_lo") - 1 >= F.col("start")
    return rows.select(
        KEY, "num_steps", "step_idx", "signal", F.when(some, F.col("start")).alias("comp_lo"), F.when(some, F.col("recent_lo") - 1).alias("comp_hi"),
        "recent_lo", F.col("step_idx").alias("recent_hi"),
    )


def fold_tokens(folds: DataFrame, steps: DataFrame) -> DataFrame:
    """The folds with ``comp_tokens``: prefix sums met at both ends, no range join."""
    order = Window.partitionBy(KEY).orderBy("step_idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select(KEY, "step_idx", "tokens").withColumn("upto", F.sum("tokens").over(order))
    low = sums.select(KEY, F.col("step_idx").alias("comp_lo"), (F.col("upto") - F.col("tokens")).alias("before"))
    high = sums.select(KEY, F.col("step_idx").alias("comp_hi"), "upto")
    met = folds.join(low.hint("merge"), [KEY, "comp_lo"], "left").join(high.hint("merge"), [KEY, "comp_hi"], "left")
    return met.withColumn("comp_tokens", F.coalesce(F.col("upto") - F.col("before"), F.lit(0))).drop("upto", "before")


def in_range(folds: DataFrame, steps: DataFrame, low: Column, high: Column, columns: list[str]) -> DataFrame:
    """Fold keys with the steps between ``low`` and ``high`` (expressions over the fold). The range becomes one row a
    step before the join, so that a fold only meets its own steps. Steps are never broadcast: their files' size says
    little of their texts'."""
    f = folds.select(KEY, F.col("step_idx").alias("fold"), low.cast("long").alias("low"), high.cast("long").alias("high")).filter("low <= high")
    each = f.select(KEY, "fold", F.explode(F.sequence("low", "high")).alias("step"))
    return each.join(steps.select(KEY, F.col("step_idx").cast("long").alias("step"), *columns).hint("merge"), [KEY, "step"]).select(KEY, "fold", "step", *columns)


def joined_text(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One text a fold: the column's values in step order, a blank line between."""
    ordered = F.sort_array(F.collect_list(F.struct("step", F.col(column).alias("x"))))
    return rows.groupBy(KEY, "fold").agg(F.array_join(F.transform(ordered, lambda s: s["x"]), "\n\n").alias(name))


def slice_text(folds: DataFrame, steps: DataFrame) -> DataFrame:
    rows = in_range(folds.filter("comp_lo IS NOT NULL"), steps, F.col("comp_lo"), F.col("comp_hi"), ["rendered"])
    return joined_text(rows, "rendered", "slice_text")


NOTHING_LEFT = "(none — this fold is near the end of the trajectory; the task is being finalized)"
NOTHING_LEFT_ROLLING = "(none — near the end of the trajectory; the task is being finalized)"


def cut_observation(rendered: Column, cap: int, always: bool) -> Column:
    """A rendered step with its observation cut where the step is longer than ``cap``; unless ``always``, the mark of
    the cut is only put where the observation itself is longer."""
    at = F.instr(rendered, "Observation:")
    obs = T.strip(F.substring(rendered, at + len("Observation:"), F.length(rendered)))
    mark = F.lit(" …[truncated]")
    cut = F.concat(F.substring(obs, 1, cap), mark)
    body = cut if always else F.when(F.length(obs) > cap, cut).otherwise(obs)
    return F.when((at > 0) & (F.length(rendered) > cap), F.concat(F.substring(rendered, F.lit(1), at - 1), F.lit("Observation: "), body)).otherwise(rendered)


def continuation(folds: DataFrame, steps: DataFrame, horizon: int, cap: int, rolling: bool = False) -> DataFrame:
    """What follows the compressed range, in up to ``horizon`` steps."""
    some = folds.filter("comp_lo IS NOT NULL")
    rows = in_range(some, steps, F.col("comp_hi") + 1, F.col("comp_hi") + horizon, ["rendered"])
    body = cut_observation(F.col("rendered"), cap, rolling)
    shown = body if rolling else F.concat(F.lit("[future step "), F.col("step").cast("string"), F.lit("]\n"), body)
    texts = joined_text(rows.withColumn("shown", shown), "shown", "continuation")
    nothing = NOTHING_LEFT_ROLLING if rolling else NOTHING_LEFT
    kept = some.select(KEY, F.col("step_idx").alias("fold")).join(texts, [KEY, "fold"], "left")
    return kept.withColumn("continuation", F.coalesce(F.nullif("continuation", F.lit("")) if rolling else F.col("continuation"), F.lit(nothing)))
