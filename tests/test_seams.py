import hashlib
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from foldloom import cli, seams
from foldloom.functions import prompts
from foldloom.functions import text as T
from foldloom.operators.messages import KEY

FULL = "\n".join(T.HEADERS)


class Fake:
    """Answers by what the prompt asks for."""

    def write(self, prompt, max_tokens):
        if "boom" in prompt:
            raise ValueError("boom")
        if "cut" in prompt:
            return ("whole", False) if max_tokens > 100 else ("who", True)
        if prompt.endswith(prompts.INCOMPLETE):
            return FULL + " complete", False
        if prompt.endswith(prompts.TOO_LONG):
            return FULL + " short", False
        return ("bare" if "bare" in prompt else FULL + " long" * 50 if "long" in prompt else FULL), False


def jobs(spark, *prompts_):
    rows = [(k, 3, p, 100, 80, False) for k, p in enumerate(prompts_)]
    return spark.createDataFrame(rows, f"{KEY} long, step_idx long, prompt string, max_tokens long, tokens long, slice_truncated boolean")


def test_healing_passes(spark):
    got = {r[KEY]: r for r in seams.healed(jobs(spark, "plain", "bare", "long", "boom", "cut"), Fake()).collect()}
    assert got[0].M == FULL and got[1].M == FULL + " complete" and got[2].M == FULL + " short"
    assert got[3].M is None and got[3].error == "ValueError: boom"
    assert got[4].M == "whole" and got[4].has_all_sections is False


def test_recursive_memories(spark):
    folds = spark.createDataFrame([(1, 5, 0), (1, 9, 6), (2, 4, 0)], f"{KEY} long, step_idx long, comp_lo long")

    class Echo:
        def write(self, prompt, max_tokens):
            if prompt.startswith("2"):
                raise RuntimeError("no")
            return f"[Pinned]\n- a{len(prompt)}\n[Goal] x", False

    prompt = lambda fold, before, pinned: f"{fold[KEY]}|{before}|{pinned}"
    rows = {(r[KEY], r.step_idx): r for r in seams.recursive(folds, Echo(), prompt, heal=False).collect()}
    assert rows[1, 5].M == "[Pinned]\n- a3\n\n[Goal] x" and rows[2, 4].error == "RuntimeError: no"
    assert rows[1, 9].M == f"[Pinned]\n- a3\n- a{len('1|' + rows[1, 5].M + '|- a3')}\n\n[Goal] x"


def test_recursive_memories_are_healed(spark):
    """Missing sections are asked for, then a ratio out of bounds is corrected, against the words of both."""
    folds = spark.createDataFrame([(1, 5, 0, "w " * 10), (2, 5, 0, "w " * 100)], f"{KEY} long, step_idx long, comp_lo long, new_steps string")

    class Model:
        def write(self, prompt, max_tokens):
            return ("bare" if prompt == "p" else FULL + (" short" if prompt.endswith(prompts.TOO_LONG) else " longer" * 20 if prompt.endswith(prompts.TOO_SHORT) else " said")), False

    got = {r[KEY]: r.M for r in seams.recursive(folds, Model(), lambda fold, before, pinned: "p").collect()}
    assert got[1].endswith("short") and got[2].endswith(" longer" * 20) and all(m.startswith("[Pinned]\nNone yet\n\n") for m in got.values())


def test_pinned_set_equals_the_column(spark):
    for m in (FULL, "[Pinned]\n- a\n[Goal] x [Pinned] y", "x [Pinned] y", ""):
        assert seams.pinned_set(m, "- l") == spark.range(1).select(T.with_pinned(F.lit(m), F.lit("- l"))).first()[0]


def test_policy_needs_its_marker():
    assert prompts.POLICY in prompts.SYSTEM_FORWARD
    with pytest.raises(ValueError):
        prompts.with_policy("x", "no policy")


def test_noise_lines_go(spark):
    text = "ok\n[ 42%]\n[Command finished with exit code 0]\n[Command finished with exit code 2]\nYour thought has been logged.\n^C CTRL+C was sent\n[Current working directory: /w]"
    got = spark.range(1).select(prompts.without_noise(F.lit(text))).first()[0]
    assert got == "ok\n[Command finished with exit code 2]\n^C CTRL+C was sent"


def test_prompts_are_whole(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    made = [prompts.slice_prompt(*lit("T", 1, 2, "S", 9)), prompts.forward_prompt(*lit("T", 1, 2, "S", "C", 9)), prompts.rolling_prompt(*lit("T", "", "", "N", "C", 9)), prompts.repair_prompt(*lit("T", 1, 2, "S", "C"))]
    for text in spark.range(1).select(*(m.alias(f"p{i}") for i, m in enumerate(made))).first():
        assert text.startswith("# Task\nT\n")


class Server(http.server.BaseHTTPRequestHandler):
    """Answers chats with a full memory, and scores with 0.5 a token (1.0 in contexts without what a repair adds)."""

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "messages" in body:
            prompt = body["messages"][1]["content"]
            if "BOOM" in prompt:
                self.send_error(400)
                return
            answer = {"choices": [{"message": {"content": FULL + (" repaired" if "lost facts" in prompt else " w" * 60)}, "finish_reason": "stop"}]}
        else:
            marks = spark_ids("repaired")
            price = 0.5 if marks in body["prompt"] or spark_ids("context") not in body["prompt"] else 1.0
            answer = {"choices": [{"prompt_logprobs": [None, *({str(i): {"logprob": -price}} for i in body["prompt"][1:])]}]}
        data = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


def spark_ids(word):
    return 100 + int(hashlib.md5(word.encode()).hexdigest()[:5], 16)


@pytest.fixture
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def record(tid, n, task="fix it"):
    msgs = [{"role": "system", "content": "s"}, {"role": "user", "content": task}]
    for i in range(n):
        call = {"id": f"c{i}", "type": "function", "function": {"name": "execute_bash", "arguments": {"command": f"make t{i}"}}}
        more = {"id": f"d{i}", "type": "function", "function": {"name": "note", "arguments": '{"text": "hm"}'}}
        msgs += [{"role": "assistant", "content": f"try {i}", "tool_calls": [call, more]}, {"role": "tool", "content": "3 passed" if i % 3 else "an error", "name": "execute_bash", "tool_call_id": f"c{i}"}]
    return {"trajectory_id": tid, "instance_id": "i" + tid, "trajectory": msgs}


@pytest.fixture
def stages(tmp_path):
    source = tmp_path / "pool.jsonl"
    source.write_text("".join(json.dumps(r) + "\n" for r in (record("b", 0), record("c", 25), record("a", 30))))
    (tmp_path / "tools.json").write_text('[{"function": {"name": "execute_bash"}}]')
    path = lambda name: str(tmp_path / name)

    def run(stage, plans, out, *more):
        cli.main([stage, "--pool", str(source), "--plans", path(plans), "--out", path(out), "--tools-in", path("tools.json"), *more])

    run("plan", "-", "plans", "--min-gap", "4", "--recent-k", "2")
    return run, path


def test_stages_end_to_end(spark, stages):
    run, path = stages
    plans = spark.read.json(path("plans"))
    assert sorted(r[0] for r in plans.select(KEY).collect()) == ["a", "c"] and plans.selectExpr("min(size(fold_points))").first()[0] > 2
    run("plan", "-", "one", "--limit", "1")
    assert [r[0] for r in spark.read.json(path("one")).select(KEY).collect()] == ["c"]
    run("summarize", "plans", "memories", "--limit", "1")
    assert spark.read.json(path("memories")).count() == 1
    assert spark.read.json(path("memories.stats")).first().avg_ratio > 0
    run("summarize", "plans", "memories")
    assert spark.read.json(path("memories")).count() == 2
    run("gate", "memories", "scored")
    assert spark.read.json(path("scored.stats")).first().repaired == 0
    run("stitch", "scored", "stitched")
    run("tokenize", "scored", "tokens")
    run("recall", "scored", "recall")
    stitched = spark.read.json(path("stitched"))
    assert stitched.count() == 2 and {r.instance_id for r in stitched.collect()} == {"ia", "ic"} and stitched.filter("num_folds < 1").count() == 0
    calls = [c for r in stitched.collect() for m in r.messages for c in m.tool_calls or []]
    kinds = {c.function.name: type(json.loads(c.function.arguments) if c.function.arguments.startswith("{") else c.function.arguments) for c in calls}
    assert set(kinds) == {"context", "execute_bash", "note"} and all(c.id for c in calls)
    lines = [json.loads(x.value) for x in spark.read.text(path("stitched")).collect()]
    made = [c["function"] for r in lines for m in r["messages"] for c in m.get("tool_calls", [])]
    assert all(isinstance(f["arguments"], str if f["name"] == "note" else dict) for f in made) and any(set(f["arguments"]) == {"summary"} for f in made)
    answers = [(m["name"], m["tool_call_id"]) for r in lines for m in r["messages"] if m["role"] == "tool"]
    assert ("context" in {n for n, _ in answers}) and ("execute_bash", "c0") in answers
    tools = json.loads(spark.read.text(path("stitched.tools")).first().value)
    assert [t["function"]["name"] for t in tools] == ["execute_bash", "context"] and all(t["type"] == "function" for t in tools)
    rows = spark.read.parquet(path("tokens"))
    assert rows.count() == 2 and rows.filter("length != size(labels)").count() == 0
    assert spark.read.json(path("recall")).filter("kind = 'command'").first()["mean"] == 1.0
    run("rolling", "plans", "rolling")
    rolling = spark.read.json(path("rolling"))
    assert rolling.count() >= 4 and rolling.filter("target_from_msg < 2 OR fold_signal IS NULL OR NOT startswith(M, '[Pinned]')").count() == 0


def test_stages_with_a_model(spark, stages, url):
    run, path = stages
    model = ("--url", url, "--model", "m")
    run("summarize", "plans", "memories", *model)
    run("gate", "memories", "scored", "--score-url", url, "--repair", "1", *model)
    got = spark.read.json(path("scored.stats")).first()
    assert got.scored > 4 and got.repaired == got.recovered == got.scored == got.sufficient
    assert spark.read.json(path("scored")).filter("exists(fold_points, f -> f.repaired = 1 AND contains(f.M, 'repaired') AND f.sufficient)").count() == 2
    run("rolling", "plans", "rolling", *model)
    assert spark.read.json(path("rolling")).filter("startswith(M, '[Pinned]\nNone yet')").count() >= 4


def test_failures_carry_their_error(spark, tmp_path, url):
    (tmp_path / "pool.jsonl").write_text("".join(json.dumps(r) + "\n" for r in (record("a", 30, "BOOM"), record("c", 25))))
    path = lambda name: str(tmp_path / name)
    run = lambda stage, plans, out, *more: cli.main([stage, "--pool", path("pool.jsonl"), "--plans", path(plans), "--out", path(out), *more])
    run("plan", "-", "plans", "--min-gap", "4", "--recent-k", "2")
    for stage in ("summarize", "rolling"):
        run(stage, "plans", stage, "--url", url)
        bad = spark.read.json(path(f"{stage}.failed")).collect()
        assert [r[KEY] for r in bad] == ["a"] and "400" in bad[0].error
        assert {r[KEY] for r in spark.read.json(path(stage)).select(KEY).collect()} == {"c"}
