"""Audit of what memories keep: edited files, commands, errors, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import text as T
from foldloom.operators.folding import in_range
from foldloom.operators.messages import KEY

FOLD = [KEY, "fold"]
KINDS = ("edited", "command", "error", "decision", "observed")


def items(folds: DataFrame, facts: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Distinct (fold, kind, item) over the compressed range, of the ``kinds`` asked for; observed: seen in observations
    only. Texts are searched for those alone."""
    acted = F.concat_ws("\n", "thought", F.array_join(F.transform("tool_calls", lambda c: F.concat(F.coalesce(c["function"]["name"], F.lit("None")), F.lit("("), T.coerced(c["function"]["arguments"]), F.lit(")"))), "\n"))
    errors = F.regexp_extract_all("obs_text", F.lit(T.ERROR_CLASS), F.lit(1))
    found = dict(zip(KINDS, (F.col("edited"), F.col("ran"), errors, T.identifiers(acted), T.identifiers(F.col("obs_text"))), strict=True))
    read = [k for k in KINDS if k in kinds or (k == "decision" and "observed" in kinds)]
    rows = facts.select(KEY, "step_idx", *(found[k].alias(k) for k in read))
    near = in_range(folds.filter("comp_lo IS NOT NULL"), rows, F.col("comp_lo"), F.col("comp_hi"), read)
    bit = {k: F.lit(1 << i) for i, k in enumerate(KINDS)}
    told = lambda k: F.transform(k, lambda x: F.struct(x.alias("item"), bit[k].alias("bit")))
    # One pass: the kinds that an item has in a fold, as bits, and observed only where it wasn't decided too.
    bits = near.select(*FOLD, F.explode(F.concat(*map(told, read))).alias("x")).groupBy(*FOLD, F.col("x.item").alias("item")).agg(F.bit_or("x.bit").alias("bits"))
    has = lambda k: F.col("bits").bitwiseAND(bit[k]) != 0
    own = [F.when(has(k) & ~has("decision") if k == "observed" else has(k), k) for k in KINDS if k in kinds]
    return bits.select(*FOLD, F.explode(F.array_compact(F.array(*own))).alias("kind"), "item")


def recalls(folds: DataFrame, facts: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Of each fold and kind asked for: items, those kept in M, and their share. Errors must be there to the letter."""
    memory = folds.select(KEY, F.col("step_idx").alias("fold"), "signal", "M")
    hit = F.when(F.col("kind") == "error", F.contains("M", F.col("item"))).otherwise(T.mentioned(F.col("item"), F.col("M")))
    met = items(folds, facts, kinds).join(memory.hint("merge"), FOLD)
    return met.groupBy(*FOLD, "signal", "kind").agg(F.count("*").alias("n_items"), F.sum(hit.cast("int")).alias("n_kept")).withColumn("recall", F.col("n_kept") / F.col("n_items"))


def summary(recalled: DataFrame) -> DataFrame:
    whole = F.floor(100 * F.count_if(F.col("recall") >= 0.999) / F.count("*"))
    return recalled.groupBy("kind").agg(F.round(F.avg("recall"), 6).alias("mean"), F.round(F.percentile("recall", 0.5), 6).alias("median"), whole.cast("long").alias("fully_kept_pct"), F.count("*").alias("n"))


def sampled(folds: DataFrame, n: int = 120) -> DataFrame:
    """The first ``n`` folds of the trajectories in hashed order."""
    return folds.filter("comp_lo IS NOT NULL").orderBy(F.sha2(F.col(KEY).cast("string"), 256), KEY, "step_idx").limit(n)
