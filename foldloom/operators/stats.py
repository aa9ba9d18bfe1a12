"""Run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators.messages import KEY


def folds_per_trajectory(folds: DataFrame, counts: DataFrame) -> DataFrame:
    """Number of folds of every trajectory with steps, none included."""
    per = folds.groupBy(KEY).agg(F.count("*").alias("n"))
    return counts.select(KEY).join(per, KEY, "left").select(KEY, F.coalesce("n", F.lit(0)).alias("n_folds"))


def fold_histogram(per: DataFrame) -> DataFrame:
    return per.groupBy("n_folds").agg(F.count("*").alias("n_trajectories"))


def signal_breakdown(folds: DataFrame) -> DataFrame:
    return folds.groupBy("signal").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signal")


def compression(memories: DataFrame, tokens) -> DataFrame:
    """One row: number of memories and the average of their token ratios. ``tokens``: counts tokens of a column."""
    ratio = tokens(F.col("M")) / F.greatest(F.lit(1), F.col("comp_tokens"))
    return memories.agg(F.count("*").alias("n_folds"), F.coalesce(F.round(F.avg(ratio), 3), F.lit(0.0)).alias("avg_ratio"))


def plan_stats(per: DataFrame, folds: DataFrame, steps: DataFrame, heads: DataFrame) -> DataFrame:
    """One row: averages and token sums."""
    a = per.agg(F.count("*").alias("n_trajectories"), F.sum("n_folds").alias("n_folds"), F.round(F.avg("n_folds"), 3).alias("avg_folds"))
    b = folds.agg(F.coalesce(F.round(F.avg(F.nullif("comp_tokens", F.lit(0))), 1), F.lit(0.0)).alias("avg_compressible"))
    c = steps.agg(F.sum("tokens").alias("step_tokens"))
    d = heads.join(per.select(KEY), KEY, "left_semi").agg(F.sum("head_tokens").alias("head_tokens"))
    one = lambda x: x.withColumn("_", F.lit(1))
    return one(a).join(one(b), "_").join(one(c), "_").join(one(d), "_").drop("_")
