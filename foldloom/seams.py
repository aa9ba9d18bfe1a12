"""Seams to models: tokenizer, summariser, scorer, chat template.

The defaults are offline and deterministic (built-in expressions). The HTTP ones speak the OpenAI-compatible protocol
from the executors, one client a task, with a bounded number of requests under way; they never fail a task for one
row's error. Speculative execution should be off where calls cost money.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.functions import prompts
from foldloom.functions import text as T
from foldloom.operators import folding, mask, memory, stitch
from foldloom.operators.messages import KEY
from foldloom.shared import shared_dir, staged


class Tokenizer(Protocol):
    def count(self, text: Column) -> Column: ...


class Summarizer(Protocol):
    def write(self, prompt: str, max_tokens: int) -> tuple[str, bool]:
        """The text, and whether it was cut at max_tokens."""


class Scorer(Protocol):
    def nll(self, ids: list[int], wanted: list[int]) -> tuple[float | None, int]:
        """Negative log-likelihood of the ids at the places ``wanted`` and their number; (None, 0) if it can't be told."""


class DefaultTokenizer:
    def count(self, text: Column) -> Column:
        return T.token_count(text)


@dataclass
class HttpSummarizer:
    url: str
    model: str
    system: str = prompts.SYSTEM
    temperature: float = 0.2
    timeout: float = 600
    retries: int = 5
    extra: dict = field(default_factory=dict)

    def write(self, prompt: str, max_tokens: int) -> tuple[str, bool]:
        chat = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": chat, "max_tokens": max_tokens, "temperature": self.temperature, **self.extra}
        choice = _post(f"{self.url}/chat/completions", body, self.timeout, self.retries)["choices"][0]
        return (choice["message"].get("content") or "").strip(), choice.get("finish_reason") == "length"


@dataclass
class HttpScorer:
    url: str
    model: str
    timeout: float = 600
    retries: int = 5

    def nll(self, ids: list[int], wanted: list[int]) -> tuple[float | None, int]:
        """Negative log-likelihood of the ids at the places ``wanted``; (None, 0) if it can't be told."""
        if not wanted:
            return None, 0
        body = {"model": self.model, "prompt": ids, "max_tokens": 1, "temperature": 0, "prompt_logprobs": 0}
        shown = _post(f"{self.url}/completions", body, self.timeout, self.retries)["choices"][0]["prompt_logprobs"]
        total = 0.0
        for i in wanted:
            entry = (shown[i] if i < len(shown) else None) or {}
            found = entry.get(str(ids[i]), {}).get("logprob")
            if found is None:
                return None, 0
            total -= found
        return total, len(wanted)


def _post(url: str, body: dict, timeout: float, retries: int) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    for left in range(retries, -1, -1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except OSError:
            if not left:
                raise
    raise AssertionError


def written(model: Summarizer, prompt: str, max_tokens: int) -> str:
    """One more try with twice the room, at most 8192 tokens, if the text was cut; it is taken even if cut again."""
    out, cut = model.write(prompt, max_tokens)
    return model.write(prompt, min(2 * max_tokens, 8192))[0] if cut else out


def generate(df: DataFrame, model: Summarizer, workers: int = 8) -> DataFrame:
    """The rows (with prompt, max_tokens) plus ``M`` and ``error``: one of them is null. At most twice ``workers`` rows of a
    task are under way."""

    def one(prompt: str, cap: int) -> tuple[str | None, str | None]:
        try:
            return written(model, prompt, int(cap)), None
        except Exception as e:  # a row's error is its result
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                rows, out = iter(zip(frame["prompt"], frame["max_tokens"], strict=True)), []
                while part := list(islice(rows, 2 * workers)):
                    out += pool.map(lambda r: one(*r), part)
                yield frame.assign(M=[m for m, _ in out], error=[e for _, e in out])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in ("M", "error"))
    return df.drop("M", "error").mapInPandas(run, fields + ", M string, error string")


def healed(jobs: DataFrame, model: Summarizer, least: float = 0.18, most: float = 0.60, sections: bool = True, guard_truncated: bool = True, tokenizer: Tokenizer | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Memories of ``jobs`` (fold keys, prompt, max_tokens, tokens, slice_truncated): missing sections are asked for once,
    then a ratio out of bounds is corrected once; what the last pass gives is taken. Adds M, M_tokens,
    compression_ratio, has_all_sections, error. Each pass is stored (``store``, by default in the shared folder), so
    that a lost executor doesn't ask the model again for what it has said."""
    if store is None:
        folder = shared_dir(jobs.sparkSession)
        store = lambda df, name: staged(df, f"{folder}/{name}")
    count = (tokenizer or DefaultTokenizer()).count
    keep = [c for c in jobs.columns]

    def again(done: DataFrame, when: Column, more: Column, name: str) -> DataFrame:
        first = done.withColumn("redo", F.coalesce(when, F.lit(False)) & F.col("error").isNull())
        new = generate(first.filter("redo").select(*[F.concat("prompt", more).alias("prompt") if c == "prompt" else c for c in keep]), model)
        return store(first.filter("NOT redo").drop("redo").unionByName(new), name)

    done = store(generate(jobs, model), "first")
    if sections:
        done = again(done, ~T.all_headers(F.col("M")), F.lit(prompts.INCOMPLETE), "sections")
    share = memory.ratio(count(F.col("M")), F.col("tokens"))
    action = memory.ratio_action(share, F.col("slice_truncated"), least, most, guard_truncated)
    done = again(done, action != "accept", F.when(action == "strict", prompts.TOO_LONG).otherwise(prompts.TOO_SHORT), "ratio")
    return done.withColumns({"M_tokens": count(F.col("M")), "has_all_sections": T.all_headers(F.col("M"))}).withColumn("compression_ratio", F.round(memory.ratio(F.col("M_tokens"), F.col("tokens")), 3))


def recursive(chosen: DataFrame, model: Summarizer, prompt_of: Callable[[dict, str, str], str], max_tokens: int = 4768, least: float = 0.18, most: float = 0.62, heal: bool = True) -> DataFrame:
    """Rolling memories by a model: the folds of a trajectory one after another (each needs the one before),
    trajectories side by side. ``prompt_of``(fold, memory so far, pinned so far). A memory without all sections, and
    then one whose words are too many or few for those of the memory before and ``new_steps``, is asked for again once.
    Pinned lines are carried on word for word whatever the model does. An error ends the trajectory and is its only
    row's ``error``. ``max_tokens`` of a fold, if it has that column, goes before the argument."""
    out = f"{KEY} {dict(chosen.dtypes)[KEY]}, step_idx long, M string, error string"

    def one(fold: dict, before: str, pinned: str) -> str:
        prompt, cap = prompt_of(fold, before, pinned), int(fold.get("max_tokens") or max_tokens)
        m = written(model, prompt, cap)
        if not heal:
            return m
        if any(h not in m for h in T.HEADERS):
            m = written(model, prompt + prompts.INCOMPLETE, cap)
        share = len(m.split()) / max(1, len((fold.get("new_steps") or "").split()) + len(before.split()))
        if share > most or share < least:
            m = written(model, prompt + (prompts.TOO_LONG if share > most else prompts.TOO_SHORT), cap)
        return m

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, before, pinned = [], "", ""
        key = frame[KEY].iloc[0]
        for fold in frame.sort_values("comp_lo").to_dict("records"):
            try:
                m = one(fold, before, pinned)
            except Exception as e:
                return pd.DataFrame([(key, fold["step_idx"], None, f"{type(e).__name__}: {e}")], columns=[KEY, "step_idx", "M", "error"])
            pinned = merge_lines(pinned, pinned_of(m))
            before = pinned_set(m, pinned)
            rows.append((key, fold["step_idx"], before, None))
        return pd.DataFrame(rows, columns=[KEY, "step_idx", "M", "error"])

    return chosen.groupBy(KEY).applyInPandas(run, out)


def rewritten(again: DataFrame, model: Summarizer, steps: DataFrame, heads: DataFrame, horizon: int = 4, cap: int = 800, max_tokens: int = 4768) -> DataFrame:
    """The folds with an M that the model, shown what follows, writes anew; null where it fails."""
    texts = folding.slice_text(again, steps).join(folding.continuation(again, steps, horizon, cap), [KEY, "fold"]).withColumnRenamed("fold", "step_idx")
    jobs = again.drop("M").join(texts, [KEY, "step_idx"]).join(heads.select(KEY, "task"), KEY, "left")
    prompt = prompts.repair_prompt(F.coalesce("task", F.lit("")), F.col("comp_lo"), F.col("comp_hi"), F.col("slice_text"), F.col("continuation"))
    jobs = jobs.withColumns({"prompt": prompt, "max_tokens": F.lit(max_tokens).cast("long")})
    first = generate(jobs.drop("slice_text", "continuation", "task"), model)
    folder = shared_dir(again.sparkSession)
    first = staged(first, f"{folder}/first").withColumn("redo", F.coalesce(~T.all_headers(F.col("M")), F.lit(False)))
    new = generate(first.filter("redo").drop("redo", "M", "error").withColumn("prompt", F.concat("prompt", F.lit(prompts.INCOMPLETE))), model)
    done = first.filter("NOT redo").drop("redo").unionByName(staged(new, f"{folder}/second"))
    return done.select(again.columns)


def pinned_set(m: str, lines: str) -> str:
    """The memory with these lines as its pinned section, as ``text.with_pinned``."""
    block, (head, there, tail) = f"{T.PINNED}\n{lines}".rstrip(), m.partition(T.PINNED)
    if not there:
        return f"{block}\n\n{m.strip()}"
    rest = min((tail.find(h) for h in T.HEADERS if h in tail), default=len(tail))
    return f"{head}{block}\n\n{tail[rest:]}".strip()


def scored(parts: DataFrame, messages: DataFrame, scorer: Scorer, tau: float = 0.15, max_context: int = 60000, workers: int = 8) -> DataFrame:
    """As ``gate.score``, by a model: each fold's continuation is scored after its raw and its folded context, on the
    tokens that the assistant said. A fold whose continuation can't be told, or has other tokens in the two, isn't scored."""
    f = parts.select(KEY, F.col("step_idx").alias("fold"), "p_lo", "comp_lo", "comp_hi", "c_lo", "c_hi", "signal", "M")
    own = F.concat(F.array(F.lit(-1).cast("long")), F.sequence(F.col("p_lo").cast("long"), F.coalesce("c_hi", "comp_hi").cast("long")))
    raw = stitch.raw_rows(messages).select(KEY, F.col("step_idx").cast("long").alias("step_idx"), "msg_idx", mask.turn().alias("x"))
    near = f.withColumn("step_idx", F.explode(own)).join(raw, [KEY, "step_idx"])
    at = F.col("step_idx")
    part = F.when(at < F.col("comp_lo"), 0).when(at <= F.col("comp_hi"), 1).otherwise(2)
    turns = near.groupBy(KEY, "fold").agg(F.sort_array(F.collect_list(F.struct("step_idx", "msg_idx", part.alias("part"), "x"))).alias("turns"))
    text = lambda *k: F.array_join(F.transform(F.filter("turns", lambda t: t["part"].isin(*k)), lambda t: t["x"]), "")
    pair = stitch.context_pair(F.col("signal"), F.col("M"), F.concat_ws("|", KEY, "fold"))
    memory_text = F.concat(*(mask.turn(lambda c, k=k: pair[k][c]) for k in (0, 1)))
    ids = lambda x: mask.encoded(x)
    rows = turns.join(f.select(KEY, "fold", "signal", "M"), [KEY, "fold"]).select(
        KEY, "fold", ids(text(0, 1, 2)).alias("raw"), ids(text(0, 1)).alias("raw_context"),
        ids(F.concat(text(0), memory_text, text(2))).alias("folded"), ids(F.concat(text(0), memory_text)).alias("folded_context"),
    )
    rows = rows.select(KEY, "fold", "raw", T.common_prefix(F.col("raw_context"), F.col("raw")).alias("raw_start"), "folded", T.common_prefix(F.col("folded_context"), F.col("folded")).alias("folded_start"))

    def told(ids: np.ndarray, start: int) -> tuple[float | None, int]:
        labels = mask.span_labels(np.asarray(ids, np.int64), np.array([len(ids)]))
        return scorer.nll([int(x) for x in ids], [i for i in range(int(start), len(ids)) if labels[i] != mask.IGNORED])

    def one(row: tuple) -> tuple[int, int, float | None, float | None, str | None]:
        if len(row.raw) > max_context:
            return len(row.raw), 0, None, None, None
        try:
            (a, n), (b, m) = told(row.raw, row.raw_start), told(row.folded, row.folded_start)
        except Exception as e:  # a row's error is its result
            return len(row.raw), 0, None, None, f"{type(e).__name__}: {e}"
        return (len(row.raw), n, a, b, None) if a is not None and b is not None and n == m and n else (len(row.raw), 0, None, None, None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                made, left = [], iter(frame.itertuples(index=False))
                while some := list(islice(left, 2 * workers)):
                    made += pool.map(one, some)
                keys = frame[[KEY, "fold"]].reset_index(drop=True)
                yield pd.concat([keys, pd.DataFrame(made, columns=["context_tokens", "c_tokens", "nll_raw", "nll_folded", "error"])], axis=1)

    kind = f"{KEY} {dict(parts.dtypes)[KEY]}, fold long, context_tokens long, c_tokens long, nll_raw double, nll_folded double, error string"
    done = parts.withColumn("fold", F.col("step_idx").cast("long")).join(rows.withColumn("fold", F.col("fold").cast("long")).mapInPandas(run, kind), [KEY, "fold"], "left").drop("fold")
    status = F.when(F.col("c_lo").isNull(), "no_continuation").when(F.col("context_tokens") > max_context, "too_long").when(F.coalesce("c_tokens", F.lit(0)) == 0, "no_tokens").otherwise("scored")
    only = lambda x: F.when(F.col("status") == "scored", x)
    done = done.withColumn("status", status).withColumns({"nll_raw": only(F.col("nll_raw")), "nll_folded": only(F.col("nll_folded"))})
    done = done.withColumn("delta_nll_per_tok", only((F.col("nll_folded") - F.col("nll_raw")) / F.col("c_tokens")))
    return done.withColumn("sufficient", F.col("delta_nll_per_tok") <= tau).drop("error")


def pinned_of(m: str) -> str:
    """The pinned section of a memory."""
    if T.PINNED not in m:
        return ""
    tail = m.split(T.PINNED, 1)[1]
    return tail[: min((tail.find(h) for h in T.HEADERS if h in tail), default=len(tail))].strip(": \n")


def merge_lines(carried: str, new: str) -> str:
    """As ``text.merged_pinned``, for the loop that only runs in Python."""
    lines = {}
    for line in (carried + "\n" + new).splitlines():
        if (s := line.strip()) and s.lower().strip("-• ") not in ("", "none", "none yet"):
            lines.setdefault(s, line.rstrip())
    return "\n".join(lines.values()) or "None yet"
