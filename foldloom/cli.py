"""Stages over JSON lines, from the command line: python -m foldloom.cli STAGE --pool ... --out ...

Stages resume: trajectories in an earlier output are left out, and each run appends.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom import seams
from foldloom.functions import prompts
from foldloom.operators import folding, gate, mask, memory, messages, recall, stats, stitch
from foldloom.operators.messages import KEY
from foldloom.sources import plans as nested_plans
from foldloom.sources import pool
from foldloom.shared import shared_dir, staged


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: What a prompt template holds in the place of the memory and pinned lines so far.
MEMORY_SO_FAR, PINNED_SO_FAR = "<<memory so far>>", "<<pinned so far>>"


class Stage:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.records = pool.read_pool(spark, args.pool, "at")
        if args.duplicates:
            self.records = pool.last_wins(self.records, "at")
        self.staged = messages.with_steps(pool.messages_of(self.records))
        self.steps = messages.steps(self.staged).persist()
        self.heads = messages.heads(self.staged)
        self.counts = messages.step_counts(self.staged)
        self.instances = self.records.select(KEY, "instance_id")

    def waiting(self, in_pool: bool = False) -> DataFrame:
        """Plans that aren't in the output yet, the first --limit of the file. ``in_pool``: only those with a
        trajectory count."""
        rows = pool.read_plans(self.spark, self.args.plans, "at")
        if _there(self.spark, self.args.out):
            rows = pool.pending(rows, pool.done_ids(self.spark, self.args.out))
        if in_pool:
            rows = rows.join(self.records.select(KEY), KEY, "left_semi")
        return (pool.first_n(rows, "at", self.args.limit) if self.args.limit else rows).drop("at")

    def tools(self) -> str:
        """The tool list of --tools-in with the context tool, written beside the output; its JSON."""
        given = pool.read_tools(self.spark, self.args.tools_in) if self.args.tools_in else []
        return json.dumps(pool.write_tools(self.spark, given, self.args.out + ".tools"), ensure_ascii=False)

    def lines(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """One conversation a key, as it is written."""
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*stitch.MESSAGE).alias("m")))), lambda x: x["m"])
        out = rows.groupBy(KEY, *columns).agg(ordered.alias("messages")).join(self.instances, KEY, "left")
        return out.select(KEY, "instance_id", *columns, pool.with_argument_values(F.col("messages")).alias("messages"))

    def plan(self) -> None:
        a = self.args
        rules = folding.FoldRules(a.t_fold, a.min_gap, a.recent_k, a.err_run)
        folds = folding.fold_tokens(folding.fold_points(self.steps, self.heads, rules), self.steps)
        counts = self.counts
        if a.limit:
            counts = pool.first_n(counts.join(self.records.select(KEY, "at"), KEY), "at", a.limit).drop("at")
        counts, steps, heads = counts.persist(), *(x.join(counts.select(KEY), KEY, "left_semi") for x in (self.steps, self.heads))
        folds = folds.join(counts.select(KEY), KEY, "left_semi")
        pool.write_lines(nested_plans.nested(folds, counts, heads, steps), a.out)
        stats.plan_stats(stats.folds_per_trajectory(folds, counts), folds, steps, heads).write.mode("overwrite").json(a.out + ".stats")

    def summarize(self) -> None:
        a, plans = self.args, staged(self.waiting(in_pool=True), shared_dir(self.spark))
        folds = nested_plans.flat(plans).drop("M").filter("comp_lo IS NOT NULL").join(self.counts.select(KEY), KEY, "left_semi")
        if a.url:
            texts = folding.slice_text(folds, self.steps).withColumnRenamed("fold", "step_idx").join(folding.continuation(folds, self.steps, 4, 600).withColumnRenamed("fold", "step_idx"), [KEY, "step_idx"])
            jobs = folds.join(texts, [KEY, "step_idx"]).join(self.heads.select(KEY, "task"), KEY, "left")
            budget = memory.budget(F.col("comp_tokens"), a.ratio, a.max_tokens)
            cap = memory.output_cap(budget, a.max_tokens, forward=True)
            text, cut = memory.truncated(F.col("slice_text"), memory.input_cap(cap, seams.T.token_count(F.col("continuation"))))
            jobs = jobs.withColumns({"max_tokens": cap, "slice_truncated": cut, "tokens": F.col("comp_tokens"), "prompt": prompts.forward_prompt(F.coalesce("task", F.lit("")), F.col("comp_lo"), F.col("comp_hi"), text, F.col("continuation"), budget)})
            done = seams.healed(jobs.drop("slice_text", "continuation", "task"), seams.HttpSummarizer(a.url, a.model, prompts.SYSTEM_FORWARD)).drop("prompt", "max_tokens", "tokens")
        else:
            done = memory.summaries(folds, memory.step_facts(self.steps), self.heads).withColumn("error", F.lit(None).cast("string"))
        done = staged(done, shared_dir(self.spark))
        failures = done.groupBy(KEY).agg(F.first("error", ignorenulls=True).alias("error"))
        ok = memory.all_or_nothing(done, plans, F.col("error").isNull()).join(failures, KEY, "left").join(self.instances, KEY, "left")
        good = ok.filter("ok").select(KEY)
        rows = nested_plans.nested(done.drop("q_msgs").join(good, KEY, "left_semi"), self.counts.join(plans.select(KEY), KEY, "left_semi").join(good, KEY, "left_semi"), self.heads, self.steps, ["M"])
        pool.write_lines(rows, a.out, append=True)
        pool.write_lines(ok.filter("NOT ok").select(KEY, "instance_id", "error"), a.out + ".failed", append=True)
        stats.compression(done.join(good, KEY, "left_semi"), seams.T.token_count).write.mode("overwrite").json(a.out + ".stats")

    def gate(self) -> None:
        a, plans = self.args, self.waiting()
        folds = nested_plans.flat(plans).drop("sufficient").join(self.counts.select(KEY), KEY, "left_semi")
        parts = gate.segments(folds.filter("M IS NOT NULL AND M != ''"), a.horizon, a.prefix_steps)
        if a.score_url:
            score_of = lambda x: seams.scored(x, self.staged, seams.HttpScorer(a.score_url, a.model), a.tau, a.max_context)
        else:
            told = gate.step_tokens(self.staged)
            score_of = lambda x: gate.score(x, told, a.tau, a.max_context)
        keep = lambda df: staged(df, shared_dir(self.spark))
        done = keep(score_of(parts)).withColumn("repaired", F.lit(0))
        if a.repair and a.url:
            teacher = seams.HttpSummarizer(a.url, a.model, prompts.SYSTEM_FORWARD, temperature=0.3)
            again = lambda x: keep(seams.rewritten(x, teacher, self.steps, self.heads, a.horizon))
            done = keep(gate.repaired(done.drop("repaired"), again, lambda x: keep(gate.rescored(x, score_of, self.steps)), a.repair))
        kept = gate.passed(done, a.drop_insufficient).withColumn("delta_nll_per_tok", F.round("delta_nll_per_tok", 4))
        pool.write_lines(nested_plans.nested(kept.drop("q_msgs"), self.counts.join(plans.select(KEY), KEY, "left_semi"), self.heads, self.steps, ["M", "delta_nll_per_tok", "sufficient", "repaired"]), a.out, append=True)
        counts = done.agg(F.count_if(F.col("status") == "scored").alias("scored"), F.count_if(F.col("status") != "scored").alias("skipped"), F.count_if("sufficient").alias("sufficient"))
        one = lambda x: x.withColumn("_", F.lit(1))
        one(counts).join(one(gate.repair_counts(done)), "_").drop("_").write.mode("overwrite").json(a.out + ".stats")

    def stitch(self) -> None:
        self.tools()
        folds = nested_plans.flat(pool.read_plans(self.spark, self.args.plans))
        used = stitch.blocks(folds).groupBy(KEY).agg(F.count("*").alias("num_folds"))
        out = self.lines(stitch.stitched(self.staged, folds).join(used, KEY), ["num_folds"])
        if self.args.limit:
            order = pool.read_plans(self.spark, self.args.plans, "at").select(KEY, "at")
            out = pool.first_n(out.join(order, KEY), "at", self.args.limit).drop("at")
        pool.write_lines(out, self.args.out)

    def rolling(self) -> None:
        """Rolling memories and their training examples, of a model or offline."""
        self.tools()
        a, plans = self.args, staged(self.waiting(), shared_dir(self.spark))
        folds = nested_plans.flat(plans).drop("M").join(self.counts.select(KEY), KEY, "left_semi")
        chosen = staged(memory.select_rolling(folds), shared_dir(self.spark))
        if a.url:
            made = seams.recursive(self.rolling_jobs(chosen), seams.HttpSummarizer(a.url, a.model, prompts.SYSTEM_ROLLING), _rolling_prompt)
            made = staged(made, shared_dir(self.spark))
            bad = made.filter("error IS NOT NULL").select(KEY, "error")
            done = chosen.join(made.filter("error IS NULL").drop("error"), [KEY, "step_idx"])
        else:
            bad = None
            done = memory.rolling_memories(memory.pinned_lines(memory.summaries(chosen, memory.step_facts(self.steps), self.heads)))
        done = staged(memory.with_prior(done), shared_dir(self.spark))
        rows = stitch.rolling_examples(self.staged, done, 6).join(done.select(KEY, F.col("step_idx").alias("fold"), F.col("signal").alias("fold_signal"), "M"), [KEY, "fold"])
        pool.write_lines(self.lines(rows, ["fold", "fold_signal", "M", "target_from_msg"]).drop("fold"), a.out, append=True)
        if bad is not None:
            pool.write_lines(bad, a.out + ".failed", append=True)

    def rolling_jobs(self, chosen: DataFrame) -> DataFrame:
        """The folds with the texts of their prompts."""
        new = folding.joined_text(folding.in_range(chosen, self.steps, F.col("prev_hi") + 1, F.col("comp_hi"), ["rendered"]), "rendered", "new_steps")
        nexts = folding.continuation(chosen, self.steps, 6, 600, rolling=True)
        jobs = chosen.withColumn("fold", F.col("step_idx")).join(new, [KEY, "fold"]).join(nexts, [KEY, "fold"]).join(self.heads.select(KEY, "task"), KEY, "left")
        budget = memory.word_budget(seams.T.word_count(F.col("new_steps")), self.args.ratio)
        prompt = prompts.rolling_prompt(F.coalesce("task", F.lit("")), F.lit(PINNED_SO_FAR), F.lit(MEMORY_SO_FAR), F.col("new_steps"), F.col("continuation"), budget)
        return jobs.select(KEY, "step_idx", "comp_lo", "new_steps", prompt.alias("prompt"), memory.output_cap(budget, 4000, forward=True).alias("max_tokens"))

    def tokenize(self) -> None:
        tools = self.tools()
        folds = nested_plans.flat(pool.read_plans(self.spark, self.args.plans))
        chats = mask.rendered(stitch.stitched(self.staged, folds), [KEY], tools=tools).select(KEY, mask.encoded(F.col("chat")).alias("ids"))
        done = mask.trainable(mask.masked(chats), self.args.max_len)
        pool.write_dataset(done.select(KEY, F.col("ids").alias("input_ids"), "labels", F.size("ids").alias("length")), self.args.out)

    def recall(self) -> None:
        folds = recall.sampled(nested_plans.flat(pool.read_plans(self.spark, self.args.plans)), self.args.sample)
        recall.summary(recall.recalls(folds, memory.step_facts(self.steps))).write.mode("overwrite").json(self.args.out)


def _rolling_prompt(fold: dict, before: str, pinned: str) -> str:
    told = fold["prompt"].replace(PINNED_SO_FAR, pinned or "None yet", 1)
    return told.replace(MEMORY_SO_FAR, before or "None: this is the first.", 1)


STAGES = ("plan", "summarize", "gate", "stitch", "rolling", "tokenize", "recall")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--pool", required=True)
    p.add_argument("--plans")
    p.add_argument("--out", required=True)
    for name, default in (("limit", 0), ("t-fold", 16000), ("min-gap", 8), ("recent-k", 6), ("err-run", 2), ("max-tokens", 6000), ("horizon", 4), ("prefix-steps", 4), ("max-context", 60000), ("max-len", 65536), ("sample", 120), ("repair", 0)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--ratio", type=float, default=0.30)
    p.add_argument("--tau", type=float, default=0.15)
    p.add_argument("--drop-insufficient", action="store_true")
    p.add_argument("--duplicates", action="store_true", help="the pool may hold an id twice; the last record counts")
    p.add_argument("--url", help="of a model server; else the offline summary (for the gate: the teacher of --repair)")
    p.add_argument("--score-url", help="of a model server that scores; else the offline scorer")
    p.add_argument("--tools-in", help="JSON list of the tools that the agent had")
    p.add_argument("--model", default="")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"foldloom {args.stage}").getOrCreate()
    getattr(Stage(spark, args), args.stage)()


if __name__ == "__main__":
    main()
