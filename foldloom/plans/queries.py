"""Registered queries over the test tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.functions import prompts
from foldloom.functions import text as T
from foldloom.operators import folding, gate, mask, memory, messages, recall, stats, stitch
from foldloom.operators.messages import KEY
from foldloom.plans import fixtures
from foldloom.sources import plans as nested_plans
from foldloom.shared import Dealt, buckets
from foldloom.sources import pool

#: Defaults but for the token budget: the fixture's trajectories have about 2,000 tokens.
RULES = folding.FoldRules(t_fold=600)
#: Conversations are short.
SHORT = folding.FoldRules(t_fold=100, min_gap=1, recent_k=1)
#: A context limit that some folds of the fixture exceed.
MAX_CONTEXT = 900
FOLD_KEY = [KEY, "step_idx"]
TOOLS = '[{"name": "context"}]'


def kept(part: Callable[[Run], DataFrame]) -> cached_property:
    """A part (rows of trajectories) that several later ones read: stored by trajectory, so that their plans begin at it
    and move none of its rows."""
    return cached_property(lambda self: self.dealt(part(self)))


class Run:
    """The event fixture, from messages to memories; each part is planned when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, conversations: bool = False):
        self.spark, self.sf_dir, self.rules = spark, sf_dir, SHORT if conversations else RULES
        self.make = fixtures.conversation_messages if conversations else fixtures.event_messages

    @cached_property
    def dealt(self) -> Dealt:
        return Dealt(self.spark, KEY, buckets(self.make(self.spark, self.sf_dir)))

    @cached_property
    def staged(self) -> DataFrame:
        return messages.with_steps(self.make(self.spark, self.sf_dir))

    @cached_property
    def steps(self) -> DataFrame:
        return messages.steps(self.staged)

    @kept
    def sent(self) -> DataFrame:
        """The messages, for queries that read them more than once."""
        return self.staged

    @kept
    def stored(self) -> DataFrame:
        """The steps, for what reads them more than once."""
        return messages.steps(self.sent)

    @cached_property
    def facts(self) -> DataFrame:
        return memory.step_facts(self.stored)

    @cached_property
    def heads(self) -> DataFrame:
        return messages.heads(self.sent)

    @kept
    def folds(self) -> DataFrame:
        return folding.fold_points(self.stored, self.heads, self.rules)

    @cached_property
    def segments(self) -> DataFrame:
        return folding.fold_tokens(self.folds, self.stored)

    @kept
    def memories(self) -> DataFrame:
        return memory.summaries(self.segments, self.facts, self.heads)

    @cached_property
    def widened(self) -> DataFrame:
        """Memories with ranges that overlap and end too late, as no detection gives them."""
        return self.memories.withColumn("comp_hi", F.col("comp_hi") + (F.col("step_idx") % 3) * 4)

    @kept
    def scored(self) -> DataFrame:
        return self.score_of(gate.segments(self.memories))

    @kept
    def tokens(self) -> DataFrame:
        return gate.step_tokens(self.sent)

    @cached_property
    def background(self) -> DataFrame:
        return gate.background(self.tokens)

    def score_of(self, parts: DataFrame) -> DataFrame:
        return gate.score(parts, self.tokens, max_context=MAX_CONTEXT, common=self.background, dealt=self.dealt)

    def recalls(self, *kinds: str) -> DataFrame:
        return self.dealt(recall.recalls(self.memories, self.facts, kinds))

    @kept
    def rolling(self) -> DataFrame:
        chosen = memory.select_rolling(self.widened.filter("comp_hi < num_steps"))
        return memory.with_prior(memory.rolling_memories(memory.pinned_lines(chosen)))

    @kept
    def repaired(self) -> DataFrame:
        """One round of repair, in which a memory gets the whole text of what it replaces."""
        texts = folding.slice_text(self.folds, self.stored).withColumnRenamed("fold", "step_idx")
        more = lambda again: again.join(texts, FOLD_KEY).withColumn("M", F.concat_ws("\n\n", "M", "slice_text")).drop("slice_text")
        return gate.repaired(self.scored, more, lambda fresh: gate.rescored(fresh, self.score_of, self.stored, self.dealt))

    @cached_property
    def examples(self) -> DataFrame:
        return stitch.rolling_examples(self.sent, self.rolling)

    @cached_property
    def stitched(self) -> DataFrame:
        return stitch.stitched(self.sent, self.widened)

    @cached_property
    def conversation_ids(self) -> DataFrame:
        return mask.rendered(self.staged, [KEY], "msg_idx").select(KEY, mask.encoded(F.col("chat")).alias("ids"))

    @cached_property
    def labelled(self) -> DataFrame:
        return mask.masked(self.conversation_ids)


def _events(make: Callable[[Run], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Run(spark, sf_dir))


def _talks(make: Callable[[Run], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Run(spark, sf_dir, conversations=True))


def error_run_lengths(r: Run) -> DataFrame:
    return folding.signals(r.steps, r.rules).select(*FOLD_KEY, F.col("error_run").cast("long").alias("error_run"))


def first_action_steps(r: Run) -> DataFrame:
    return folding.signals(r.steps, r.rules).filter("NOT readonly AND NOT seen_action").select(*FOLD_KEY)


def readonly_commands(r: Run) -> DataFrame:
    call = F.explode("tool_calls").alias("c")
    rows = r.steps.select(*FOLD_KEY, call).filter("c.function.name = 'execute_bash'")
    command = T.argument(F.col("c.function.arguments"), "command")
    return rows.select(*FOLD_KEY, command.alias("command"), T.reads_only(command).alias("reads_only"), T.reads_only(command, T.READ_ONLY_RECALL).alias("reads_only_recall"))


def identifier_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Run(spark, sf_dir)
    of = lambda source, df, key, text: df.select(F.lit(source).alias("source"), F.col(key).cast("long").alias("key"), F.explode(T.identifiers(F.col(text))).alias("identifier"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return of("url", pages, "page_id", "url").unionByName(of("document", docs, "doc_id", "text")).unionByName(of("step", r.steps.withColumn("k", F.col(KEY) * 1000 + F.col("step_idx")), "k", "rendered"))


def memory_budget(r: Run) -> DataFrame:
    b = memory.budget(F.col("comp_tokens"))
    return r.segments.filter("comp_lo IS NOT NULL").select(*FOLD_KEY, b.alias("budget"), memory.output_cap(b).alias("out_cap"), memory.output_cap(b, forward=True).alias("out_cap_forward"),
        memory.input_cap(memory.output_cap(b)).cast("long").alias("in_cap"), memory.word_budget(F.col("comp_tokens")).alias("word_budget"))


def memory_truncate_slice(r: Run) -> DataFrame:
    text, cut = memory.truncated(F.col("slice_text"), F.lit(120))
    return folding.slice_text(r.folds, r.stored).select(KEY, F.col("fold").alias("step_idx"), text.alias("slice_text"), cut.alias("slice_truncated"))


def memory_ratio_decision(r: Run) -> DataFrame:
    share = memory.ratio(T.token_count(F.col("M")), F.col("comp_tokens"))
    cut = F.col("comp_tokens") > 300
    return r.memories.select(*FOLD_KEY, F.round(share, 3).alias("compression_ratio"), memory.ratio_action(share, cut).alias("guarded"), memory.ratio_action(share, cut, guard_truncated=False).alias("unguarded"))


def memory_sections(r: Run) -> DataFrame:
    return r.memories.select(*FOLD_KEY, *(T.section(F.col("M"), h).alias(n) for n, h in zip(("goal", "attempts", "feedback", "constraints", "dead_ends", "open_threads", "next"), T.HEADERS, strict=True)))


def memory_sections_complete(r: Run) -> DataFrame:
    broken = F.when(F.col("step_idx") % 4 == 0, F.replace("M", F.lit("[Dead Ends]"), F.lit(""))).otherwise(F.col("M"))
    return r.memories.select(*FOLD_KEY, T.all_headers(broken).alias("complete"), (~T.all_headers(broken)).alias("rewrite"))


def pinned_set(r: Run) -> DataFrame:
    once = T.with_pinned(F.col("M"), F.lit("- repo: /w"))
    return r.memories.select(*FOLD_KEY, once.alias("pinned_once"), T.with_pinned(once, F.lit("- repo: /v")).alias("pinned_twice"))


def pinned_merge(r: Run) -> DataFrame:
    before = F.lag("did").over(Window.partitionBy(KEY).orderBy("step_idx"))
    bullets = lambda a: F.array_join(F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit("  - "), x, F.lit("  "))), "\n")
    rows = r.facts.select(*FOLD_KEY, bullets(before).alias("carried"), F.concat(bullets(F.col("did")), F.lit("\n- none\n• None yet\n- None yet.")).alias("new"))
    return rows.select(*FOLD_KEY, T.merged_pinned(F.coalesce("carried", F.lit("")), F.col("new")).alias("pinned"))


def _ok() -> F.Column:
    """A stand-in for generation errors: some folds fail."""
    return ~(((F.col(KEY) + F.col("step_idx")) % 13 == 0) & F.col("comp_lo").isNotNull())


def fold_all_or_nothing(r: Run) -> DataFrame:
    return memory.all_or_nothing(r.folds, messages.step_counts(r.staged), _ok())


def rolling_fold_selection(r: Run) -> DataFrame:
    return memory.select_rolling(r.widened).select(*FOLD_KEY, "comp_lo", "comp_hi", "prev_hi")


def rolling_memory(r: Run) -> DataFrame:
    return r.rolling.select(*FOLD_KEY, "pinned", F.col("M").alias("memory"))


def gate_decision(r: Run) -> DataFrame:
    return r.scored.select(*FOLD_KEY, "status", F.round("delta_nll_per_tok", 4).alias("delta_nll_per_tok"), "sufficient")


def gate_nll(r: Run) -> DataFrame:
    return r.scored.select(*FOLD_KEY, F.round("nll_raw", 3).alias("nll_raw"), F.round("nll_folded", 3).alias("nll_folded"), F.coalesce("c_tokens", F.lit(0)).alias("c_tokens"))


def gate_stats(r: Run) -> DataFrame:
    rows = r.scored.select("status", "sufficient", F.round("delta_nll_per_tok", 4).alias("d"))
    at = gate.positional(rows, "d", {"median": F.floor(F.col("n") / 2), "p90": F.floor(F.col("n") * 0.9)})
    counts = rows.agg(F.count_if(F.col("status") == "scored").alias("scored"), F.count_if(F.col("status") != "scored").alias("unscorable"), F.count_if("sufficient").alias("sufficient"))
    return counts.withColumn("_", F.lit(1)).join(at.withColumn("_", F.lit(1)), "_").drop("_")


def gate_by_signal(r: Run) -> DataFrame:
    return r.scored.filter("status = 'scored'").groupBy("signal").agg(F.round(F.avg(F.col("sufficient").cast("int")), 4).alias("sufficiency"), F.count("*").alias("n"))


def leak_check(r: Run) -> DataFrame:
    """Memories of every third fold quote the code that follows."""
    f = gate.segments(r.memories)
    calls = gate.following_calls(f, r.stored)
    quoted = calls.groupBy(KEY, "fold").agg(F.max(T.argument(F.col("arguments"), "file_text")).alias("q"))
    m = f.select(KEY, F.col("step_idx").alias("fold"), "M").join(quoted.hint("merge"), [KEY, "fold"], "left")
    m = m.withColumn("M", F.when(F.col("fold") % 3 == 0, F.concat("M", F.coalesce("q", F.lit("")))).otherwise(F.col("M")))
    return r.dealt(gate.leaks(m, calls.select(KEY, "fold", "arguments"))).select(KEY, F.col("fold").alias("step_idx"), "leaks")


def trigger_phrases(r: Run) -> DataFrame:
    other = F.when(F.col("step_idx") % 5 == 0, F.lit("structural:testpass")).when(F.col("step_idx") % 7 == 0, F.lit("something else")).otherwise(F.col("signal"))
    return r.folds.select(*FOLD_KEY, other.alias("signal"), T.phrase(other).alias("phrase"))


def _calls() -> list[F.Column]:
    """Ids, names and arguments of all calls of a message, as texts."""
    joined = lambda f, by: F.array_join(F.transform("tool_calls", f), by)
    return [joined(lambda c: c["id"], ",").alias("call_ids"), joined(lambda c: c["function"]["name"], ",").alias("call_names"), joined(lambda c: c["function"]["arguments"], "\n").alias("call_arguments")]


def stitched_mask(r: Run) -> DataFrame:
    rows = mask.masked(mask.with_ids(mask.rendered(r.stitched, [KEY]).withColumnRenamed("chat", "ids"), ["ids"]))
    kept = F.filter("labels", lambda x: x != mask.IGNORED)
    return rows.select(KEY, F.size("ids").cast("long").alias("length"), F.size(kept).cast("long").alias("n_labels"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


def recall_string_arguments(r: Run) -> DataFrame:
    """The audit where the arguments of every third step are JSON strings: it reads them as the objects they hold."""
    quote = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)
    quoted = F.transform("tool_calls", lambda c: c.withField("function.arguments", quote(c["function"]["arguments"])))
    steps = r.stored.withColumn("tool_calls", F.when(F.col("step_idx") % 3 == 0, quoted).otherwise(F.col("tool_calls")))
    rows = r.dealt(recall.recalls(r.memories, memory.step_facts(steps)))
    return rows.select(KEY, F.col("fold").alias("step_idx"), "kind", "n_items", "n_kept")


def rolling_word_ratio(r: Run) -> DataFrame:
    """Words of each rolling memory against the memory before and the new steps, and what healing would do."""
    new = folding.joined_text(folding.in_range(r.rolling, r.stored, F.col("prev_hi") + 1, F.col("comp_hi"), ["rendered"]), "rendered", "new_steps")
    rows = r.rolling.withColumn("fold", F.col("step_idx")).join(new, [KEY, "fold"])
    share = memory.word_ratio(F.col("M"), F.coalesce("prev_M", F.lit("")), F.col("new_steps"))
    return rows.select(*FOLD_KEY, F.round(share, 3).alias("word_ratio"), memory.ratio_action(share, F.lit(False), 0.18, 0.62).alias("action"), memory.word_budget(T.word_count(F.col("new_steps"))).alias("budget"))


def assistant_mask(r: Run) -> DataFrame:
    return r.labelled.select(KEY, F.posexplode("labels").alias("pos", "label"))


def mask_filter(r: Run) -> DataFrame:
    return mask.trainable(r.labelled, 500).select(KEY, F.size("ids").cast("long").alias("length"))


def _rolling_ids(r: Run) -> DataFrame:
    """Ids of each example, and how many are its context's, from one pass over its messages. A turn ends with a line
    end, which no token goes past, so context and rest are encoded apart."""
    turns = F.sort_array(F.collect_list(F.struct("pos", mask.turn().alias("x"))))
    rows = r.examples.groupBy(KEY, "fold").agg(turns.alias("t"), F.max("target_from_msg").alias("target"))
    text = lambda test: F.array_join(F.transform(F.filter("t", test), lambda m: m["x"]), "")
    texts = rows.select(KEY, "fold", text(lambda m: m["pos"] < F.col("target")).alias("context"), text(lambda m: m["pos"] >= F.col("target")).alias("rest"))
    return mask.with_ids(texts, ["context", "rest"]).select(KEY, "fold", F.concat("context", "rest").alias("ids"), F.size("context").cast("long").alias("start"))


def rolling_mask(r: Run) -> DataFrame:
    rows = mask.masked(_rolling_ids(r))
    labels = mask.from_target(F.col("labels"), F.col("start"))
    kept = F.filter(labels, lambda x: x != mask.IGNORED)
    return rows.select(KEY, F.col("fold").alias("step_idx"), F.size("ids").cast("long").alias("length"), "start", F.size(kept).cast("long").alias("n_labels"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


def length_stats(r: Run) -> DataFrame:
    rows = r.conversation_ids.select(F.size("ids").cast("long").alias("n"))
    at = gate.positional(rows, "n", {"p95": F.floor(F.col("n") * 0.95)})
    one = rows.agg(F.min("n").alias("shortest"), F.percentile("n", 0.5).cast("long").alias("median"), F.max("n").alias("longest"), F.count("*").alias("examples"))
    return one.withColumn("_", F.lit(1)).join(at.withColumn("_", F.lit(1)), "_").drop("_")


def pad_batches(r: Run) -> DataFrame:
    rows = mask.padded(mask.trainable(r.labelled, 4000), KEY, 8)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(KEY, "batch", F.size("input_ids").cast("long").alias("width"), total("attention_mask").alias("attended"), total("input_ids").alias("id_sum"), total("labels").alias("label_sum"))


def lcp_arrays(r: Run) -> DataFrame:
    a = r.conversation_ids.select(F.col(KEY).alias("a_id"), F.col("ids").alias("a"))
    b = r.conversation_ids.select((F.col(KEY) - 1).alias("a_id"), F.col("ids").alias("b"))
    return a.join(b, "a_id").select("a_id", T.common_prefix(F.col("a"), F.col("b")).alias("lcp"), T.common_prefix(F.col("a"), F.slice("a", F.lit(1), F.lit(5))).alias("own"))


def _recalls(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def make(r: Run) -> DataFrame:
        rows = r.recalls(kind)
        return rows.select(KEY, F.col("fold").alias("step_idx"), "n_items", "n_kept", F.round("recall", 6).alias("recall"))

    return _events(make)


def recall_identifiers(r: Run) -> DataFrame:
    rows = r.recalls("decision", "observed")
    return rows.select(KEY, F.col("fold").alias("step_idx"), "kind", "n_items", "n_kept")


def recall_worst(r: Run) -> DataFrame:
    rows = r.recalls("decision").filter("recall < 1").withColumn("recall", F.round("recall", 2))
    return rows.orderBy("recall", "signal", KEY, "fold").limit(8).select("recall", "signal", KEY, F.col("fold").alias("step_idx"))


def _records(r: Run) -> DataFrame:
    """A pool in which every fifth conversation comes twice, the second time cut after two messages."""
    base = r.staged.groupBy(KEY).agg(F.count("*").alias("n_msgs"), F.max("step_idx").alias("last")).withColumn("at", F.col(KEY))
    again = base.filter(F.col(KEY) % 5 == 0).withColumns({"at": F.col(KEY) + 100000, "n_msgs": F.lit(2).cast("long")})
    return base.unionByName(again)


def pool_last_wins(r: Run) -> DataFrame:
    return pool.last_wins(_records(r), "at").select(KEY, "n_msgs", "at")


def resume_pending(r: Run) -> DataFrame:
    done = r.staged.select(KEY).distinct().filter(F.col(KEY) % 3 == 1)
    return pool.pending(messages.step_counts(r.staged), done).select(KEY, "num_steps")


def limit_processed(r: Run) -> DataFrame:
    return pool.first_n(messages.step_counts(r.staged), KEY, 20).select(KEY, "num_steps")


def tools_with_context(r: Run) -> DataFrame:
    tool = lambda name: F.struct(F.lit("function").alias("type"), F.struct(name.alias("name"), F.lit("d").alias("description"), F.lit("{}").alias("parameters")).alias("function"))
    own = F.when(F.col(KEY) % 4 == 0, F.lit("context")).otherwise(F.lit("execute_bash"))
    rows = messages.step_counts(r.staged).select(KEY, F.array(tool(own)).alias("tools"))
    names = lambda df, name: df.select(KEY, F.array_join(F.transform("tools", lambda t: t["function"]["name"]), ",").alias(name))
    return names(pool.with_context_tool(rows, "Condense."), "if_absent").join(names(pool.with_context_tool(rows, "Condense.", always=True), "always"), KEY)


def pool_round_trip(r: Run) -> DataFrame:
    """Messages as written to JSON lines text and parsed back."""
    shape = "struct<trajectory_id:bigint,trajectory:array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>>"
    per = r.staged.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("msg_idx", *stitch.MESSAGE))).alias("m"))
    text = per.select(F.to_json(F.struct(KEY, F.transform("m", lambda x: F.struct(*(x[c].alias(c) for c in stitch.MESSAGE))).alias("trajectory"))).alias("value"))
    back = text.select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return pool.messages_of(back).select(KEY, "msg_idx", "role", "name", "tool_call_id", F.length("content").cast("long").alias("n_chars"), F.size("tool_calls").cast("long").alias("n_calls"))


def observation_noise(r: Run) -> DataFrame:
    footer = F.concat(F.col("obs_text"), F.lit("\n[Command finished with exit code "), (F.col("step_idx") % 3).cast("string"), F.lit("]\n[ 50%]\n[Current working directory: /w]"))
    return r.steps.select(*FOLD_KEY, prompts.without_noise(footer).alias("obs_text"))


def prompt_text(r: Run) -> DataFrame:
    texts = folding.slice_text(r.folds, r.stored).withColumnRenamed("fold", "step_idx")
    rows = r.segments.join(texts, FOLD_KEY).join(r.heads.select(KEY, "task"), KEY)
    return rows.select(*FOLD_KEY, prompts.slice_prompt(F.col("task"), F.col("comp_lo"), F.col("comp_hi"), F.col("slice_text"), memory.budget(F.col("comp_tokens"))).alias("prompt"))


def prompt_forward(r: Run) -> DataFrame:
    texts = folding.slice_text(r.folds, r.stored).join(folding.continuation(r.folds, r.stored, 4, 120), [KEY, "fold"]).withColumnRenamed("fold", "step_idx")
    rows = r.segments.join(texts, FOLD_KEY).join(r.heads.select(KEY, "task"), KEY)
    at = [F.col(c) for c in ("task", "comp_lo", "comp_hi", "slice_text", "continuation")]
    return rows.select(*FOLD_KEY, prompts.forward_prompt(*at, memory.budget(F.col("comp_tokens"))).alias("forward"), prompts.repair_prompt(*at).alias("repair"))


def prompt_rolling(r: Run) -> DataFrame:
    new = folding.joined_text(folding.in_range(r.rolling, r.stored, F.col("prev_hi") + 1, F.col("comp_hi"), ["rendered"]), "rendered", "new_steps")
    nexts = folding.continuation(r.rolling, r.stored, 6, 120, rolling=True)
    rows = r.rolling.withColumn("fold", F.col("step_idx")).join(new, [KEY, "fold"]).join(nexts, [KEY, "fold"]).join(r.heads.select(KEY, "task"), KEY)
    made = prompts.rolling_prompt(F.col("task"), F.lit(""), F.coalesce("prev_M", F.lit("")), F.col("new_steps"), F.col("continuation"), memory.word_budget(T.word_count(F.col("new_steps"))))
    return rows.select(*FOLD_KEY, made.alias("prompt"))


def plans_round_trip(r: Run) -> DataFrame:
    plans = nested_plans.nested(r.segments, messages.step_counts(r.staged), r.heads, r.stored)
    return nested_plans.flat(plans).select(*FOLD_KEY, "signal", "comp_lo", "comp_hi", "recent_lo", "comp_tokens", "num_steps", F.col("q_msgs").cast("long").alias("q_msgs"))


def folds_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldloom.streaming.online import run_available

    return run_available(spark, Run(spark, sf_dir), RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    segs = [*FOLD_KEY, "comp_lo", "comp_hi"]
    return {
        "fold_points_events": _events(lambda r: r.folds.select(*FOLD_KEY, "signal", "comp_lo", "comp_hi", "recent_lo", "recent_hi")),
        "fold_segments_tokens": _events(lambda r: r.segments.join(r.heads, KEY).select(*segs, "comp_tokens", "q_msgs", "num_steps")),
        "fold_points_conversations": _talks(lambda r: r.folds.select(*FOLD_KEY, "signal", "comp_lo", "comp_hi")),
        "fold_signal_breakdown": _events(lambda r: stats.signal_breakdown(r.folds)),
        "fold_count_histogram": _events(lambda r: stats.fold_histogram(stats.folds_per_trajectory(r.folds, messages.step_counts(r.staged)))),
        "fold_plan_stats": _events(lambda r: stats.plan_stats(stats.folds_per_trajectory(r.folds, messages.step_counts(r.staged)), r.segments, r.stored, r.heads)),
        "error_run_lengths": _events(error_run_lengths),
        "first_action_steps": _events(first_action_steps),
        "conv_steps": _talks(lambda r: r.steps.select(*FOLD_KEY, "thought", "obs_text", "n_msgs")),
        "conv_step_render": _talks(lambda r: r.steps.select(*FOLD_KEY, "rendered")),
        "conv_task_text": _talks(lambda r: messages.heads(r.staged).select(KEY, "task", "q_msgs")),
        "conv_zero_step_drop": _talks(lambda r: messages.step_counts(r.staged).select(KEY, "num_steps")),
        "conv_token_counts": _talks(lambda r: r.steps.groupBy(KEY).agg(F.sum("tokens").alias("step_tokens")).join(r.heads.select(KEY, "head_tokens"), KEY, "left").select(KEY, "step_tokens", F.coalesce("head_tokens", F.lit(0)).alias("head_tokens"))),
        "event_text_of": _events(lambda r: r.staged.select(KEY, "msg_idx", T.text_of(F.col("content"), F.col("tool_calls")).alias("message_text"))),
        "text_error_flags": _events(lambda r: r.steps.select(*FOLD_KEY, "err")),
        "text_verified_flags": _events(lambda r: r.steps.select(*FOLD_KEY, "verified", T.has_testpass(F.col("obs_text")).alias("testpass"))),
        "readonly_commands": _events(readonly_commands),
        "step_action_flags": _events(lambda r: r.steps.select(*FOLD_KEY, "plan_call", "file_edit", "readonly")),
        "fold_slice_text": _events(lambda r: folding.slice_text(r.folds, r.stored).select(KEY, F.col("fold").alias("step_idx"), "slice_text")),
        "fold_continuation_text": _events(lambda r: folding.continuation(r.folds, r.stored, 4, 120).select(KEY, F.col("fold").alias("step_idx"), "continuation")),
        "rolling_continuation_text": _events(lambda r: folding.continuation(r.folds, r.stored, 6, 120, rolling=True).select(KEY, F.col("fold").alias("step_idx"), "continuation")),
        "identifier_extract": identifier_extract,
        "memory_budget": _events(memory_budget),
        "memory_truncate_slice": _events(memory_truncate_slice),
        "memory_ratio_decision": _events(memory_ratio_decision),
        "memory_blocks": _events(lambda r: r.memories.select(*FOLD_KEY, F.col("M").alias("memory"))),
        "memory_sections": _events(memory_sections),
        "memory_sections_complete": _events(memory_sections_complete),
        "pinned_set": _events(pinned_set),
        "pinned_merge": _events(pinned_merge),
        "fold_all_or_nothing": _events(fold_all_or_nothing),
        "fold_failed_ids": _events(lambda r: fold_all_or_nothing(r).filter("NOT ok").select(KEY)),
        "rolling_fold_selection": _events(rolling_fold_selection),
        "rolling_memory": _events(rolling_memory),
        "rolling_examples": _events(lambda r: r.examples.select(KEY, F.col("fold").alias("step_idx"), "target_from_msg", "pos", "role", "content", "name", "tool_call_id", *_calls())),
        "gate_segments": _events(lambda r: gate.segments(r.folds).select(*segs, "p_lo", "c_lo", "c_hi")),
        "gate_segments_whole_prefix": _events(lambda r: gate.segments(r.folds, prefix_steps=-1).select(*segs, "p_lo", "c_lo", "c_hi")),
        "gate_nll": _events(gate_nll),
        "gate_decision": _events(gate_decision),
        "gate_filter": _events(lambda r: gate.passed(r.scored).select(*FOLD_KEY, "status")),
        "gate_stats": _events(gate_stats),
        "gate_by_signal": _events(gate_by_signal),
        "gate_repair": _events(lambda r: r.repaired.select(*FOLD_KEY, F.col("repaired").cast("long").alias("repaired"), F.round("delta_nll_per_tok", 4).alias("delta_nll_per_tok"), "sufficient")),
        "gate_repair_stats": _events(lambda r: gate.repair_counts(r.repaired)),
        "leak_check": _events(leak_check),
        "stitched_messages": _events(lambda r: r.stitched.select(KEY, "pos", "role", "content", "name", "tool_call_id", *_calls())),
        "stitched_mask": _events(stitched_mask),
        "stitch_stats": _events(lambda r: stitch.stitch_stats(r.staged, r.stitched, r.widened)),
        "trigger_phrases": _events(trigger_phrases),
        "rendered_chat": _events(lambda r: r.dealt(mask.rendered(r.stitched, [KEY], tools=TOOLS))),
        "assistant_mask": _talks(assistant_mask),
        "mask_filter": _talks(mask_filter),
        "rolling_mask": _events(rolling_mask),
        "length_cap": _talks(lambda r: r.conversation_ids.filter(F.size("ids") <= 300).select(KEY, F.size("ids").cast("long").alias("length"))),
        "length_stats": _talks(length_stats),
        "pad_batches": _talks(pad_batches),
        "lcp_arrays": _talks(lcp_arrays),
        "recall_edited": _recalls("edited"),
        "recall_commands": _recalls("command"),
        "recall_errors": _recalls("error"),
        "recall_identifiers": _events(recall_identifiers),
        "recall_string_arguments": _events(recall_string_arguments),
        "rolling_word_ratio": _events(rolling_word_ratio),
        "avg_compression": _events(lambda r: stats.compression(r.memories, T.token_count)),
        "recall_summary": _events(lambda r: recall.summary(r.recalls(*recall.KINDS))),
        "recall_worst": _events(recall_worst),
        "recall_sample": _events(lambda r: recall.sampled(r.memories).select(*FOLD_KEY)),
        "pool_last_wins": _talks(pool_last_wins),
        "resume_pending": _talks(resume_pending),
        "limit_processed": _talks(limit_processed),
        "tools_with_context": _talks(tools_with_context),
        "pool_round_trip": _events(pool_round_trip),
        "observation_noise": _events(observation_noise),
        "prompt_text": _events(prompt_text),
        "prompt_forward": _events(prompt_forward),
        "prompt_rolling": _events(prompt_rolling),
        "plans_round_trip": _events(plans_round_trip),
        "folds_online": folds_online,
    }
