"""Fold plans: nested records (one a trajectory) to flat rows (one a fold) and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators.messages import KEY


def nested(folds: DataFrame, counts: DataFrame, heads: DataFrame, steps: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """trajectory_id, num_steps, head_tokens, total_step_tokens, fold_points in step order; trajectories without folds
    have none. ``extra``: more fold columns to carry (M and the like)."""
    pair = lambda a, b: F.when(F.col(a).isNotNull(), F.array(F.col(a).cast("int"), F.col(b).cast("int")))
    one = F.struct(
        F.col("step_idx").cast("int").alias("step_idx"), "signal", F.col("q_msgs").cast("int").alias("q_msgs"), pair("comp_lo", "comp_hi").alias("compressible_steps"),
        F.col("comp_tokens").alias("compressible_tokens"), pair("recent_lo", "recent_hi").alias("recent_steps"), *(extra or []),
    )
    per = folds.join(heads.select(KEY, "q_msgs"), KEY, "left").groupBy(KEY).agg(F.sort_array(F.collect_list(one)).alias("fold_points"))
    total = steps.groupBy(KEY).agg(F.sum("tokens").alias("total_step_tokens"))
    rows = counts.join(heads.select(KEY, "head_tokens"), KEY, "left").join(total, KEY, "left").join(per, KEY, "left")
    kind = dict(per.dtypes)["fold_points"]
    return rows.select(KEY, "num_steps", F.coalesce("head_tokens", F.lit(0)).alias("head_tokens"), "total_step_tokens", F.coalesce("fold_points", F.array().cast(kind)).alias("fold_points"))


def flat(plans: DataFrame) -> DataFrame:
    """One row a fold, with the ranges as columns and the carried fields as they are."""
    rows = plans.select(KEY, "num_steps", F.explode("fold_points").alias("f"))
    names = rows.select("f.*").columns
    own = {"compressible_steps", "recent_steps", "compressible_tokens"}
    at = lambda name, k: F.get(F.col(f"f.{name}"), k).cast("long")
    return rows.select(
        KEY, F.col("num_steps").cast("long").alias("num_steps"), *(F.col(f"f.{n}").cast("long").alias(n) if n == "step_idx" else F.col(f"f.{n}") for n in names if n not in own),
        at("compressible_steps", 0).alias("comp_lo"), at("compressible_steps", 1).alias("comp_hi"), at("recent_steps", 0).alias("recent_lo"), at("recent_steps", 1).alias("recent_hi"),
        F.col("f.compressible_tokens").alias("comp_tokens"),
    )
