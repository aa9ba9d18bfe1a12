"""Hand-worked cases of folding, stitching, pinning, masks and small functions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from foldloom.functions import text as T
from foldloom.operators import folding, gate, mask, memory, messages, stitch
from foldloom.operators.messages import KEY


def steps_of(spark, n, tokens, verified=(), err=(), acts=(), plan=()):
    rows = [(1, i, tokens, i in plan, i not in acts, i in err, i in verified) for i in range(n)]
    return spark.createDataFrame(rows, f"{KEY} long, step_idx long, tokens long, plan_call boolean, readonly boolean, err boolean, verified boolean")


def folds_of(spark, head, steps, rules):
    heads = spark.createDataFrame([(1, head)], f"{KEY} long, head_tokens long")
    rows = folding.fold_tokens(folding.fold_points(steps, heads, rules), steps).orderBy("step_idx").collect()
    return [(r.step_idx, r.signal.split(":")[-1], (r.comp_lo, r.comp_hi) if r.comp_lo is not None else None, r.comp_tokens, (r.recent_lo, r.recent_hi)) for r in rows]


def test_signals_in_order_of_precedence(spark):
    rules = folding.FoldRules(t_fold=80, min_gap=3, recent_k=2, err_run=2)
    steps = steps_of(spark, 20, 10, verified={6}, err={9, 10}, acts={2})
    assert folds_of(spark, 10, steps, rules) == [
        (2, "first_action", (0, 0), 10, (1, 2)), (6, "verified", (3, 4), 20, (5, 6)), (11, "error_recovery", (7, 9), 30, (10, 11)),
    ]


def test_gap_and_error_beat_signals(spark):
    rules = folding.FoldRules(t_fold=1000, min_gap=4, recent_k=3, err_run=2)
    steps = steps_of(spark, 20, 5, plan={0, 1}, verified={4, 19}, err={4}, acts={1, 8})
    assert folds_of(spark, 0, steps, rules) == [(0, "plan", None, 0, (0, 0))]


def test_a_large_head_folds_every_gap(spark):
    rules = folding.FoldRules(t_fold=40, min_gap=5, recent_k=4, err_run=2)
    assert folds_of(spark, 50, steps_of(spark, 20, 1), rules) == [
        (0, "expansion", None, 0, (0, 0)), (5, "expansion", (1, 1), 1, (2, 5)), (10, "expansion", (6, 6), 1, (7, 10)), (15, "expansion", (11, 11), 1, (12, 15)),
    ]


def stitched_of(spark, n, folds):
    """Raw steps as numbers, memories as letters."""
    said = [(1, 2 * i, "assistant", str(i), [], i) for i in range(n)]
    staged = spark.createDataFrame(said, f"{KEY} long, msg_idx long, role string, content string, tool_calls {T.calls_type()}, step_idx long")
    rows = [(1, k, lo, hi, m, "x", n) for k, (lo, hi, m) in enumerate(folds)]
    made = spark.createDataFrame(rows, f"{KEY} long, step_idx long, comp_lo long, comp_hi long, M string, signal string, num_steps long")
    return [json.loads(r.tool_calls[0].function.arguments)["summary"] if r.tool_calls else r.content for r in stitch.stitched(staged, made).orderBy("pos").collect() if r.role == "assistant"]


def test_stitching_skips_unreachable_and_late_blocks(spark):
    assert stitched_of(spark, 10, [(1, 3, "A"), (3, 5, "B"), (6, 7, "C"), (8, 12, "D")]) == ["0", "A", "4", "5", "C", "8", "9"]


def test_stitching_last_of_one_start_wins(spark):
    assert stitched_of(spark, 6, [(1, 2, "A"), (1, 4, "B"), (2, 3, ""), (5, 5, "E")]) == ["0", "B", "E"]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("carried, new, merged", [
    ("- repo: /w\n- none", "  - repo: /w\n- None yet.\n• None yet\n- core: a.py  ", "- repo: /w\n- None yet.\n- core: a.py"),
    ("", "- none", "None yet"),
])
def test_pinned_merge(spark, carried, new, merged):
    assert value(spark, T.merged_pinned(F.lit(carried), F.lit(new))) == merged


def test_sections(spark):
    m = F.lit("[Goal]: fix\n[Next] run; see [Goal] again")
    assert [value(spark, T.section(m, h)) for h in ("[Goal]", "[Next]", T.PINNED)] == ["fix", "run; see", ""]


@pytest.mark.parametrize("ids, labels", [
    ([1, 11, 3, 20, 2, 1, 12, 3, 21, 22, 2], [-100] * 8 + [21, 22, 2]),
    ([1, 12, 3, 21, 22], [-100] * 3 + [21, 22]),
    ([1, 11, 3, 20, 2], [-100] * 5),
    ([], []),
    ([7, 1, 12, 3, 5, 2, 9, 1, 11, 3, 4, 2, 1, 12, 3, 6], [-100] * 4 + [5, 2] + [-100] * 9 + [6]),
])
def test_loss_mask(spark, ids, labels):
    rows = mask.masked(spark.createDataFrame([(1, ids)], "k long, ids array<int>"))
    assert rows.first().labels == labels
    assert mask.trainable(rows, 100).count() == (1 if any(x != -100 for x in labels) else 0)


@pytest.mark.parametrize("a, b, n", [([1, 2, 3], [1, 2, 4, 5], 2), ([1, 2], [1, 2, 3], 2), ([], [1], 0), ([1], [2], 0)])
def test_common_prefix(spark, a, b, n):
    rows = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert rows.select(T.common_prefix(F.col("a"), F.col("b"))).first()[0] == n


def test_positional_median_is_the_upper_one(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "d double")
    assert gate.positional(rows, "d", {"median": F.floor(F.col("n") / 2)}).first().median == 3


@pytest.mark.parametrize("tokens, wanted", [(100, (128, 1024, 1280)), (1000, (300, 1024, 1280)), (50000, (6000, 6512, 6768))])
def test_budgets(spark, tokens, wanted):
    b = memory.budget(F.lit(tokens))
    assert (value(spark, b), value(spark, memory.output_cap(b)), value(spark, memory.output_cap(b, forward=True))) == wanted


@pytest.mark.parametrize("share, cut, action", [(0.61, False, "strict"), (0.60, False, "accept"), (0.18, False, "accept"), (0.17, False, "expand"), (0.17, True, "accept")])
def test_ratio_decision(spark, share, cut, action):
    assert value(spark, memory.ratio_action(F.lit(share), F.lit(cut))) == action


@pytest.mark.parametrize("text, good", [("3 passed", True), ("0 failed", False), ("no errors", False)])
def test_verified_without_error(spark, text, good):
    assert value(spark, T.has_verified(F.lit(text)) & ~T.has_error(F.lit(text))) is good


@pytest.mark.parametrize("command, reads", [("cat a", True), ("  ls", True), ("git diff x", True), ("git push", False), ("catalog", False), ("cd x && make", True), ("cat-file", True)])
def test_read_only_commands(spark, command, reads):
    assert value(spark, T.reads_only(F.lit(command))) is reads


@pytest.mark.parametrize("item, m, hit", [("src/a/Foo.py", "see foo.py", True), ("x/", "y", False), ("a", "a", True)])
def test_mentioned(spark, item, m, hit):
    assert value(spark, T.mentioned(F.lit(item), F.lit(m))) is hit


@pytest.mark.parametrize("n, leaks", [(24, False), (25, True)])
@pytest.mark.parametrize("quoted", [False, True])
def test_leaks(spark, n, leaks, quoted):
    import json

    line = "x" * n
    arguments = json.dumps({"command": f"a\n  {line}  \nb", "n": 3})
    arguments = json.dumps(arguments) if quoted else arguments
    memory_rows = spark.createDataFrame([(1, 1, f"see {line}.")], f"{KEY} long, fold long, M string")
    calls = spark.createDataFrame([(1, 1, arguments)], f"{KEY} long, fold long, arguments string")
    assert gate.leaks(memory_rows, calls).first().leaks is leaks


def test_unscorable_folds_pass_the_gate(spark):
    rows = spark.createDataFrame([(True,), (False,), (None,)], "sufficient boolean")
    assert gate.passed(rows).count() == 2
    assert gate.passed(rows, strict=True).count() == 1
    assert gate.passed(rows, drop_insufficient=False).count() == 3


def test_truncation_keeps_six_and_four_tokens(spark):
    text, cut = memory.truncated(F.lit(" ".join(f"w{i}" for i in range(30))), F.lit(10))
    kept = value(spark, text).split(memory.ELIDED)
    assert [len(x.split()) for x in kept] == [6, 4] and value(spark, cut) is True
    assert value(spark, memory.truncated(F.lit("a b"), F.lit(10))[0]) == "a b"


def test_arguments_that_are_text_count_as_reading(spark):
    call = lambda a: [("c", "function", ("execute_bash", a))]
    rows = [(1, 0, "assistant", "t", call('{"command": "make"}')), (1, 1, "assistant", None, call('"{\\"command\\": \\"make\\"}"')), (1, 2, "user", None, None)]
    staged = messages.with_steps(spark.createDataFrame(rows, f"{KEY} long, msg_idx long, role string, content string, tool_calls {T.calls_type()}"))
    got = messages.steps(staged).orderBy("step_idx").collect()
    assert [(r.readonly, r.obs_text, r.n_msgs) for r in got] == [(False, "", 1), (True, "\n", 2)]


def test_repair_takes_what_can_be_scored(spark):
    rows = spark.createDataFrame([(1, 1, "old", 0.5, False), (1, 2, "fine", 0.1, True), (1, 3, "old", 0.5, False)], f"{KEY} long, step_idx long, M string, delta_nll_per_tok double, sufficient boolean")
    regenerate = lambda df: df.withColumn("M", F.when(F.col("step_idx") == 1, "new").otherwise(""))
    rescore = lambda df: df.withColumns({"leaks": F.lit(False), "delta_nll_per_tok": F.lit(0.7), "sufficient": F.lit(False)})
    got = {r.step_idx: (r.M, r.repaired) for r in gate.repaired(rows, regenerate, rescore, rounds=2).collect()}
    assert got[1] == ("new", 2) and got[2] == ("fine", 0) and got[3] == ("old", 0)
    best = {r.step_idx: r.M for r in gate.repaired(rows, regenerate, rescore, rounds=1, keep_best=True).collect()}
    assert best[1] == "old"


def test_calls_go_through_whole(spark):
    """Two calls in one message, null content, an observation that answers the second."""
    calls = [("c1", "function", ("execute_bash", '{"command": "ls"}')), ("c2", "function", ("task_tracker", '"{\\"command\\": \\"plan\\"}"'))]
    rows = [(1, 0, "user", "do it", None, None, [], -1), (1, 1, "assistant", None, None, None, calls, 0), (1, 2, "tool", "seen", "task_tracker", "c2", [], 0), (1, 3, "assistant", "folded", None, None, calls[:1], 1), (1, 4, "assistant", "end", None, None, [], 2)]
    staged = spark.createDataFrame(rows, f"{KEY} long, msg_idx long, role string, content string, name string, tool_call_id string, tool_calls {T.calls_type()}, step_idx long")
    folds = spark.createDataFrame([(1, 1, 1, 1, "M \"x\"\ny", "expansion", 3)], f"{KEY} long, step_idx long, comp_lo long, comp_hi long, M string, signal string, num_steps long")
    out = stitch.stitched(staged, folds).orderBy("pos").collect()
    assert [r.role for r in out] == ["user", "assistant", "tool", "assistant", "tool", "assistant"]
    assert out[1].content is None and [(c.id, c.function.name, c.function.arguments) for c in out[1].tool_calls] == [(a, n, x) for a, _, (n, x) in calls]
    assert (out[2].name, out[2].tool_call_id) == ("task_tracker", "c2")
    made = out[3].tool_calls[0]
    assert made.function.name == "context" and json.loads(made.function.arguments) == {"summary": 'M "x"\ny'}
    assert made.id.startswith("call_ctx_") and len(made.id) == 33 and out[4].tool_call_id == made.id and out[4].name == "context"
    chat = mask.rendered(stitch.stitched(staged, folds), [KEY], tools="[]").first().chat
    assert chat.startswith("<|im_start|>system\n# Tools\n[]<|im_end|>\n<|im_start|>user\ndo it<|im_end|>\n")
    said = "<tool_call> c1 execute_bash " + calls[0][2][1] + " </tool_call>\n<tool_call> c2 task_tracker " + calls[1][2][1] + " </tool_call>"
    assert f"<|im_start|>assistant\n{said}<|im_end|>\n<|im_start|>tool\n<tool_response> c2 task_tracker\nseen<|im_end|>\n" in chat
    ids = mask.masked(spark.createDataFrame([(chat,)], "chat string").select(mask.encoded(F.col("chat")).alias("ids"))).first()
    kept = [x for x in ids.labels if x != mask.IGNORED]
    assert len(kept) == sum(len(re.findall(mask.CHAT_TOKEN, p)) for p in re.findall(r"<\|im_start\|>assistant\n(.*?<\|im_end\|>)", chat, re.S))


@pytest.mark.parametrize("given, read", [('{"a": 1}', '{"a": 1}'), ('"{\\"a\\": 1}"', '{"a": 1}'), ('"no json"', "{}"), ('"{broken"', "{}"), ("null", "{}"), (None, "{}"), ('""', "{}")])
def test_arguments_are_coerced(spark, given, read):
    assert value(spark, T.coerced(F.lit(given).cast("string"))) == read


def test_positions_over_many_values(spark):
    rows = spark.range(5000).select((F.col("id") % 1700).cast("double").alias("d"))
    got = gate.positional(rows, "d", {"median": F.floor(F.col("n") / 2), "p90": F.floor(F.col("n") * 0.9)}).first()
    plain = sorted(i % 1700 for i in range(5000))
    assert (got.median, got.p90) == (plain[2500], plain[4500])
    assert gate.positional(rows.limit(0), "d", {"median": F.floor(F.col("n") / 2)}).first().median is None


def test_batches_of_text_keys(spark):
    rows = spark.createDataFrame([(f"t{i:02d}", [1] * (i + 1), [1] * (i + 1)) for i in range(23)], "k string, ids array<int>, labels array<int>")
    got = mask.padded(rows.repartition(5), "k", 4).orderBy("k").collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r)
    assert len(got) == 23 and max(map(len, by.values())) <= 4 and len(by) < 23
    for batch in by.values():
        assert {len(r.input_ids) for r in batch} == {max(sum(r.attention_mask) for r in batch)}
        assert all(r.input_ids == [1] * n + [0] * (len(r.input_ids) - n) and r.labels == [1] * n + [-100] * (len(r.labels) - n) for r in batch for n in (sum(r.attention_mask),))
