"""Online fold detection: a stream of step rows, one small state a trajectory.

The state is what acceptance needs: the next step, errors right before, whether an action came before, the last fold
and the tokens since it, and the steps that came before their turn: a file source doesn't promise order across batches,
so a step waits until all before it are there. A step that comes again is passed over. As the end of a trajectory isn't known, a fold is only confirmed once ``recent_k`` more steps
have come, which is the batch rule for finished trajectories.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foldloom.functions import text as T
from foldloom.operators.folding import FoldRules
from foldloom.operators.messages import KEY
from foldloom.shared import shared_dir

STEP = f"{KEY} long, step_idx long, tokens long, head_tokens long, plan_call boolean, readonly boolean, err boolean, verified boolean"
OUT = f"{KEY} long, step_idx long, signal string"


class Step(NamedTuple):
    step_idx: int
    tokens: int
    head_tokens: int
    plan_call: bool
    readonly: bool
    err: bool
    verified: bool


class Detector(StatefulProcessor):
    def __init__(self, rules: FoldRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("step_idx")
        s = json.loads(self.state.get()[0]) if self.state.exists() else {"next": 0, "held": {}, "run": 0, "acted": False, "last": -(10**9), "tokens": None, "open": []}
        for r in batch.itertuples(index=False):
            if r.step_idx >= s["next"]:
                s["held"].setdefault(str(r.step_idx), [int(r.step_idx), int(r.tokens), int(r.head_tokens), *map(bool, (r.plan_call, r.readonly, r.err, r.verified))])
        out = []
        while (step := s["held"].pop(str(s["next"]), None)) is not None:
            r = Step(*step)
            s["next"] += 1
            if s["tokens"] is None:
                s["tokens"] = r.head_tokens
            s["tokens"] += r.tokens
            signal = self._signal(r, s)
            s["acted"] = s["acted"] or not r.readonly
            s["run"] = s["run"] + 1 if r.err else 0
            if signal and r.step_idx - s["last"] >= self.rules.min_gap:
                s["last"], s["tokens"] = r.step_idx, r.head_tokens
                s["open"].append([r.step_idx, signal])
            while s["open"] and r.step_idx - s["open"][0][0] >= self.rules.recent_k:
                out.append((key[0], *s["open"].pop(0)))
        self.state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=[KEY, "step_idx", "signal"])

    def _signal(self, r: Any, s: dict) -> str | None:
        if r.plan_call:
            return T.PLAN
        if r.verified and not r.err:
            return T.VERIFIED
        if not r.readonly and not s["acted"]:
            return T.FIRST_ACTION
        if s["run"] >= self.rules.err_run and not r.err:
            return T.RECOVERY
        return T.EXPANSION if s["tokens"] >= self.rules.t_fold else None

    def close(self) -> None:
        pass


def detect(steps: DataFrame, rules: FoldRules) -> DataFrame:
    """``steps``: a stream of ``STEP`` rows, in any order."""
    return steps.groupBy(KEY).transformWithStateInPandas(Detector(rules), outputStructType=OUT, outputMode="Append", timeMode="None")


def run_available(spark: SparkSession, run: Any, rules: FoldRules) -> DataFrame:
    """All steps that there are, as files through the stream, with a checkpoint; the folds that it wrote. Its folder goes with the session."""
    base = shared_dir(spark, "online")
    rows = run.steps.join(run.heads.select(KEY, "head_tokens"), KEY, "left").select(KEY, F.col("step_idx").cast("long").alias("step_idx"), "tokens", F.coalesce("head_tokens", F.lit(0)).alias("head_tokens"), "plan_call", "readonly", "err", "verified")
    rows.write.parquet(f"{base}/steps")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = detect(spark.readStream.schema(STEP).parquet(f"{base}/steps"), rules)
        found.writeStream.format("parquet").option("path", f"{base}/folds").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(OUT).parquet(f"{base}/folds")
