"""The sufficiency gate: how much of the continuation's likelihood a memory loses.

The scorer here is offline: an interpolated cache model over the default tokens. It is a surrogate for a language model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import text as T
from foldloom.operators.folding import in_range
from foldloom.operators.messages import KEY
from foldloom.shared import Dealt, shared_dir, staged

FOLD = [KEY, "fold"]
#: Stretches that positions are looked for in.
SLICES = 128
#: A token that is this part of all or more is looked up without moving its rows (there are no more such tokens).
FREQUENT = 100_000


def segments(folds: DataFrame, horizon: int = 4, prefix_steps: int = 4) -> DataFrame:
    """Step ranges of prefix (from p_lo), slice and continuation (c_lo to c_hi; null if nothing follows)."""
    low = F.lit(0) if prefix_steps < 0 else F.greatest(F.lit(0), F.col("comp_lo") - prefix_steps)
    more = F.col("comp_hi") + 1 < F.col("num_steps")
    return folds.filter("comp_lo IS NOT NULL").withColumns({
        "p_lo": low.cast("long"), "c_lo": F.when(more, F.col("comp_hi") + 1),
        "c_hi": F.when(more, F.least(F.col("num_steps") - 1, F.col("comp_hi") + horizon)),
    })


def step_tokens(staged: DataFrame) -> DataFrame:
    """Tokens of each message, with its step (head: -1) and whether the assistant said it."""
    return staged.select(KEY, F.col("step_idx").cast("long").alias("step_idx"), (F.col("role") == "assistant").alias("said"), T.tokens(T.text_of(F.col("content"), F.col("tool_calls"))).alias("tokens"))


def background(told: DataFrame) -> DataFrame:
    """How often each token is there in all (``told``: from ``step_tokens``), stored."""
    return staged(told.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("bg")), shared_dir(told.sparkSession))


def score(parts: DataFrame, told: DataFrame, tau: float = 0.15, max_context: int = 60000, common: DataFrame | None = None, dealt: Dealt | None = None) -> DataFrame:
    """``parts``: from ``segments`` with M; ``told``: from ``step_tokens``. Adds c_tokens, context_tokens, nll_raw,
    nll_folded, delta, sufficient, and the status: scored, no_continuation, too_long or no_tokens. ``common``:
    ``background(told)``, if it is there already. ``dealt``: what stored ``parts`` and ``told`` by trajectory, if anything
    did; then only rows of rare tokens are moved."""
    common = background(told) if common is None else common
    total = common.agg(F.coalesce(F.sum("bg"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    f = parts.select(KEY, F.col("step_idx").alias("fold"), "p_lo", "comp_lo", "comp_hi", "c_lo", "c_hi")
    # The head, each step of prefix, slice and continuation, and the memory (below -1), so that a fold only meets its own.
    own = F.concat(F.array(F.lit(-1).cast("long"), -2 - F.col("fold")), F.sequence(F.col("p_lo").cast("long"), F.coalesce("c_hi", "comp_hi").cast("long")))
    f = f.withColumn("step_idx", F.explode(own))
    # The key has a name of its own here: Spark 4.1 forgets how the parts of a union are dealt, if a filter makes the very
    # column they are dealt by not null.
    memory = parts.select(F.col(KEY).alias("of"), (-2 - F.col("step_idx")).cast("long").alias("at"), F.lit(False).alias("said"), T.tokens(F.col("M")).alias("tokens"))
    texts = told.select(F.col(KEY).alias("of"), F.col("step_idx").alias("at"), "said", "tokens").unionByName(memory)
    step, head = F.col("step_idx"), F.col("step_idx") == -1
    of = lambda test, name: F.when(test, 1).otherwise(0).alias(name)
    each = f.join(texts.hint("merge"), (F.col(KEY) == F.col("of")) & (F.col("step_idx") == F.col("at"))).select(
        *FOLD, "tokens", of(head | step.between(F.col("p_lo"), F.col("comp_hi")), "raw"), of((step < 0) | step.between(F.col("p_lo"), F.col("comp_lo") - 1), "folded"),
        of(F.col("said") & step.between(F.col("c_lo"), F.col("c_hi")), "c"),
    )
    # Messages are dealt by fold (or trajectory) before their tokens part, so that counting them moves nothing more. One
    # row a fold and token: how often both contexts and the continuation have it.
    each = (each if dealt else each.repartition(*FOLD)).select(*FOLD, F.explode("tokens").alias("token"), "raw", "folded", "c")
    per = each.groupBy(*FOLD, "token").agg(*(F.sum(x).alias(x) for x in ("raw", "folded", "c")))
    # Only what the continuation says is scored, so only that meets the background.
    heard = F.collect_list(F.when(F.col("c") > 0, F.struct("token", "raw", "folded", "c")))
    totals = per.groupBy(*FOLD).agg(*(F.sum(x).alias(f"{x}_size") for x in ("raw", "folded", "c")), heard.alias("heard"))
    sizes = [F.col("raw_size").alias("context_tokens"), F.col("folded_size").alias("folded_tokens"), F.col("c_size").alias("c_tokens")]
    words = lambda df: df.select(*FOLD, *sizes, F.explode_outer("heard").alias("h")).select("*", "h.*").drop("h")
    rare = (F.coalesce("bg", F.lit(0)) + 1) / F.lit(float(total["n"] + total["v"]))
    p = lambda n, size_: F.when(F.col(size_) == 0, rare).otherwise(0.5 * F.col(n) / F.col(size_) + 0.5 * rare)
    nll = lambda n, size_: (-F.sum(F.when(F.col("c") > 0, F.col("c") * F.log(p(n, size_))))).alias(f"nll_{n}")
    summed = lambda df: df.groupBy(*FOLD).agg(*(F.first(x).alias(x) for x in ("c_tokens", "context_tokens")), nll("raw", "context_tokens"), nll("folded", "folded_tokens"))
    if dealt is None or total["v"] <= FREQUENT:
        scores = summed(words(totals).join(common, "token", "left"))
    else:
        often = F.col("bg") * FREQUENT >= total["n"]
        spoken = words(dealt(totals)).join(F.broadcast(common.filter(often)), "token", "left")
        seldom = spoken.filter("token IS NOT NULL AND bg IS NULL").drop("bg").join(common.filter(~often), "token", "left")
        more = dealt(dealt.moved(summed(seldom)).select(*FOLD, F.col("nll_raw").alias("more_raw"), F.col("nll_folded").alias("more_folded")))
        known = spoken.withColumn("c", F.when(F.col("bg").isNotNull(), F.col("c")))
        both = lambda x: (F.coalesce(f"nll_{x}", F.lit(0.0)) + F.coalesce(f"more_{x}", F.lit(0.0))).alias(f"nll_{x}")
        scores = summed(known).join(more.hint("merge"), FOLD, "left").select(*FOLD, "c_tokens", "context_tokens", both("raw"), both("folded"))
    met = parts.withColumn("fold", F.col("step_idx")).join(scores.hint("merge"), FOLD, "left")
    context = F.coalesce("context_tokens", F.lit(0))
    status = F.when(F.col("c_lo").isNull(), "no_continuation").when(context > max_context, "too_long").when(F.coalesce("c_tokens", F.lit(0)) == 0, "no_tokens").otherwise("scored")
    met = met.withColumn("status", status)
    only = lambda x: F.when(F.col("status") == "scored", x)
    delta = (F.col("nll_folded") - F.col("nll_raw")) / F.col("c_tokens")
    met = met.withColumns({"delta_nll_per_tok": only(delta), "nll_raw": only(F.col("nll_raw")), "nll_folded": only(F.col("nll_folded"))})
    return met.withColumn("sufficient", F.col("delta_nll_per_tok") <= tau).drop("fold")


#: What scoring adds to a fold.
SCORES = ("c_tokens", "context_tokens", "nll_raw", "nll_folded", "delta_nll_per_tok", "status", "sufficient")


def repair_counts(done: DataFrame) -> DataFrame:
    """One row: folds that were repaired, and those of them that are sufficient now."""
    return done.agg(F.count_if(F.col("repaired") > 0).alias("repaired"), F.count_if((F.col("repaired") > 0) & F.coalesce("sufficient", F.lit(False))).alias("recovered"))


def following_calls(parts: DataFrame, steps: DataFrame) -> DataFrame:
    """Fold keys, step and arguments of the calls in each fold's continuation (c_lo to c_hi)."""
    rows = in_range(parts, steps, F.col("c_lo"), F.col("c_hi"), ["tool_calls"])
    return rows.select(*FOLD, "step", F.explode("tool_calls").alias("c")).select(*FOLD, "step", F.col("c.function.arguments").alias("arguments"))


def rescored(fresh: DataFrame, score_of: Callable[[DataFrame], DataFrame], steps: DataFrame, dealt: Dealt | None = None) -> DataFrame:
    """Folds with a new M, scored anew, with ``leaks``. The new M are stored, as both read them (by ``dealt``, if scoring
    has it)."""
    fresh = fresh.drop(*SCORES)
    fresh = dealt(fresh) if dealt else staged(fresh, shared_dir(fresh.sparkSession))
    done = score_of(fresh)
    leaked = leaks(fresh.select(KEY, F.col("step_idx").alias("fold"), "M"), following_calls(fresh, steps).drop("step")).withColumnRenamed("fold", "step_idx")
    return done.join(leaked, [KEY, "step_idx"])


def passed(scored: DataFrame, drop_insufficient: bool = True, strict: bool = False) -> DataFrame:
    """Folds that go on: unscorable ones too, unless ``strict``."""
    if not drop_insufficient:
        return scored
    return scored.filter("sufficient" if strict else "sufficient IS NULL OR sufficient")


def positional(values: DataFrame, column: str, places: dict[str, Column]) -> DataFrame:
    """One row of values at 0-based places (expressions over n) of the ascending column.

    Counts of distinct values are ranked, not the rows, and they are ranked inside ``SLICES`` stretches of about as many
    values; only the stretches' totals meet in one place.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("k"))
    edges = counts.agg(F.percentile_approx("x", [i / SLICES for i in range(1, SLICES)], 10 * SLICES)).first()[0] or []
    slice_ = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col("x"))) if edges else F.lit(0)
    sliced = counts.withColumn("slice", slice_)
    totals = sliced.groupBy("slice").agg(F.sum("k").alias("total"))
    bases = totals.select("slice", (F.sum("total").over(Window.orderBy("slice")) - F.col("total")).alias("base"), F.sum("total").over(Window.partitionBy()).alias("n"))
    here = F.sum("k").over(Window.partitionBy("slice").orderBy("x"))
    ranked = sliced.join(F.broadcast(bases), "slice").select("x", (F.col("base") + here).alias("upto"), "n")
    return ranked.agg(*(F.min(F.when(F.col("upto") > place, F.col("x"))).alias(name) for name, place in places.items()))


def leaks(memory: DataFrame, continuation: DataFrame) -> DataFrame:
    """``memory``: fold keys and M; ``continuation``: fold keys and the ``arguments`` of the calls that follow. Whether a
    stripped line of 25 characters or more of any string argument is in M."""
    fields = F.map_values(F.from_json("arguments", "map<string,string>"))
    first = F.substring(F.ltrim("arguments"), 1, 1)
    plain = F.from_json(F.concat(F.lit('{"x":'), F.col("arguments"), F.lit("}")), "x string")["x"]
    texts = F.when(first == "{", fields).when(first == '"', F.coalesce(F.map_values(F.from_json(plain, "map<string,string>")), F.array(plain))).otherwise(F.array("arguments"))
    lines = continuation.select(*FOLD, F.explode(texts).alias("t")).select(*FOLD, F.explode(T.lines(F.col("t"))).alias("line")).select(*FOLD, T.strip(F.col("line")).alias("line"))
    found = lines.filter(F.length("line") >= 25).join(memory.select(*FOLD, "M").hint("merge"), FOLD).groupBy(*FOLD).agg(F.bool_or(F.contains("M", F.col("line"))).alias("leaks"))
    return memory.select(*FOLD).join(found.hint("merge"), FOLD, "left").withColumn("leaks", F.coalesce("leaks", F.lit(False)))


def repaired(scored: DataFrame, regenerate, rescore, rounds: int = 1, keep_best: bool = False) -> DataFrame:
    """Repair loop, unrolled: in each round the insufficient folds get a new M by ``regenerate`` (null: stop). It is
    taken if it isn't empty, doesn't leak and can be scored by ``rescore`` (adds ``leaks`` and the scores), even if it
    is no better, unless ``keep_best``."""
    done, columns = scored.withColumn("repaired", F.lit(0)), scored.columns
    for turn in range(1, rounds + 1):
        again = done.filter(F.coalesce(~F.col("sufficient"), F.lit(False)) & (F.col("repaired") == turn - 1))
        rest = done.filter(~(F.coalesce(~F.col("sufficient"), F.lit(False)) & (F.col("repaired") == turn - 1)))
        old = again.select(KEY, "step_idx", F.struct(*columns).alias("old"))
        new = rescore(regenerate(again.select(columns)))
        good = (F.coalesce("M", F.lit("")) != "") & ~F.col("leaks") & F.col("delta_nll_per_tok").isNotNull()
        if keep_best:
            good = good & (F.col("delta_nll_per_tok") < F.col("old.delta_nll_per_tok"))
        met = new.join(old, [KEY, "step_idx"])
        taken = met.select(F.when(good, F.struct(*columns)).otherwise(F.col("old")).alias("r"), F.when(good, turn).otherwise(-turn).alias("repaired")).select("r.*", "repaired")
        done = rest.unionByName(taken)
    return done.withColumn("repaired", F.greatest("repaired", F.lit(0)))
