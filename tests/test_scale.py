"""What keeps the steps bounded: sizes of Arrow work, what is stored, where rows are dealt."""

import pyarrow as pa
from pyspark.sql import functions as F

from foldloom.functions import text as T
from foldloom.operators import gate, mask, memory, messages, recall
from foldloom.plans import fixtures
from foldloom.shared import WHOLE, Dealt


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masks_work_on_slices_of_bounded_size():
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([[1] * n for n in (3, 4, 0, 20, 2, 2)] + [None], pa.list_(pa.int32()))})
    assert [p.num_rows for p in mask.slices(batch, 0, 7)] == [3, 1, 3]
    assert list(mask.slices(batch.slice(0, 0), 0, 7)) == []


def test_batches_of_masks_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    mask.masked(spark.createDataFrame([(1, [1])], "k long, ids array<int>"))
    assert spark.conf.get(key) == "4m"


def test_ids_of_texts_are_those_of_the_expression(spark):
    texts = ["", None, "<|im_start|>user\nGrüße 😀 <|im_end|>\n", "<|im_start|>assistant\n" + "a_b.c\t" * 3000, "\x00\r user assistant"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, x string")
    got = {r.k: r.x for r in mask.with_ids(rows, ["x"]).collect()}
    assert got == {r.k: r.x for r in rows.select("k", mask.encoded(F.col("x")).alias("x")).collect()}


def test_tokens_part_after_they_are_dealt_by_fold(spark):
    parts = spark.createDataFrame([(1, 9, 0, 1, 2, 3, 4, "a b")], "trajectory_id long, step_idx long, p_lo long, comp_lo long, comp_hi long, c_lo long, c_hi long, M string")
    told = spark.createDataFrame([(1, s, True, ["a", f"t{s}"]) for s in range(-1, 6)], "trajectory_id long, step_idx long, said boolean, tokens array<string>")
    scored = gate.score(parts, told)
    assert "RepartitionByExpression [trajectory_id" in plan(scored) and "Window" not in plan(scored)
    r = scored.first()
    assert (r.c_tokens, r.context_tokens, r.status) == (4, 8, "scored")


def test_new_memories_are_stored_before_they_are_scored(spark):
    fresh = spark.createDataFrame([(1, 9, 2, 3, "m")], "trajectory_id long, step_idx long, c_lo long, c_hi long, M string")
    steps = spark.createDataFrame([], f"trajectory_id long, step_idx long, tool_calls {T.calls_type()}")
    seen = []
    gate.rescored(fresh, lambda f: seen.append(f.inputFiles()) or f, steps)
    assert seen[0]


def test_pinned_lines_are_merged_once_a_fold(spark):
    rows = spark.createDataFrame([(1, 10 * i, i, "m", f"- x{i}\n - x0 \nnone") for i in range(3)], "trajectory_id long, comp_lo long, step_idx long, M string, new_pinned string")
    done = memory.rolling_memories(rows)
    assert plan(done).count("array_distinct") == 1
    assert [r.pinned for r in done.orderBy("step_idx").collect()] == ["- x0", "- x0\n- x1", "- x0\n- x1\n- x2"]


def joined(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_dealt_by_trajectory_is_not_moved_again(spark):
    put = Dealt(spark, "trajectory_id", 5)
    rows = put(spark.range(200).selectExpr("id % 7 AS trajectory_id", "id AS step_idx", "'x' AS t"))
    before = {k: spark.conf.get(k) for k in WHOLE}
    both = rows.join(rows.selectExpr("trajectory_id", "step_idx", "t AS u").hint("merge"), ["trajectory_id", "step_idx"])
    for k, v in WHOLE.items():
        spark.conf.set(k, v)
    try:
        assert "Exchange" not in joined(both.groupBy("trajectory_id", "t").count())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert put(both).count() == 200
    assert {k: spark.conf.get(k) for k in WHOLE} == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("foldloom_")]


def test_messages_move_once_as_events(spark):
    made = messages.with_steps(fixtures.event_messages(spark, "/root/testdata/sf0.001"))
    assert joined(made).count("Exchange") == 1


def test_rare_tokens_are_scored_as_those_of_a_small_vocabulary(spark, monkeypatch):
    put = Dealt(spark, "trajectory_id", 3)
    parts = put(spark.createDataFrame([(t, 9, 0, 1, 2, 3, 4, f"a b w{t}" if t % 3 else None) for t in range(20)], "trajectory_id long, step_idx long, p_lo long, comp_lo long, comp_hi long, c_lo long, c_hi long, M string"))
    told = put(spark.createDataFrame([(t, s, s % 2 == 1, ["a", f"t{s}", f"w{t}", f"w{t + 1}"]) for t in range(19) for s in range(-1, 6)], "trajectory_id long, step_idx long, said boolean, tokens array<string>"))
    shown = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(sorted(df.columns)).collect())
    plain = shown(gate.score(parts, told))
    assert shown(gate.score(parts, told, dealt=put)) == plain
    for frequent in (1, 10, 100):
        monkeypatch.setattr(gate, "FREQUENT", frequent)
        assert shown(gate.score(parts, told, dealt=put)) == plain


def test_recall_reads_only_what_its_kinds_need(spark):
    folds = spark.createDataFrame([(1, 9, 0, 1, "s", "a.py ValueError")], "trajectory_id long, step_idx long, comp_lo long, comp_hi long, signal string, M string")
    calls = f"trajectory_id long, step_idx long, thought string, tool_calls {T.calls_type()}, obs_text string, edited array<string>, ran array<string>"
    facts = spark.createDataFrame([(1, 0, "see a.py", [], "ValueError in b.py and a.py", ["a.py"], ["make"]), (1, 1, "`xyz`", [], "KeyError", [], [])], calls)
    every = {tuple(r) for r in recall.items(folds, facts).collect()}
    for kind in recall.KINDS:
        assert {tuple(r) for r in recall.items(folds, facts, (kind,)).collect()} == {r for r in every if r[2] == kind}
    assert {(r[2], r[3]) for r in every} == {("edited", "a.py"), ("command", "make"), ("error", "ValueError"), ("error", "KeyError"), ("decision", "a.py"), ("decision", "xyz"), ("observed", "ValueError"), ("observed", "b.py"), ("observed", "KeyError")}
    errors = recall.recalls(folds, facts, ("error",))
    assert "FileScan" not in plan(errors) and r"[A-Za-z_][A-Za-z0-9_./]{2,60}" not in plan(errors) and "collect_set" not in plan(errors)


def test_arguments_are_read_once_a_call(spark):
    sent = spark.createDataFrame([(1, 0, "assistant", "x", [], 0)], f"trajectory_id long, msg_idx long, role string, content string, tool_calls {T.calls_type()}, step_idx long")
    steps = messages.steps(sent)
    assert plan(steps).count("get_json_object") == 1
    stored = spark.createDataFrame(steps.collect(), steps.schema)
    assert plan(memory.step_facts(stored)).count("get_json_object") == 2  # command and path
    assert plan(stored.select(T.identifiers(F.concat("thought", "obs_text")))).count("concat(thought#") == 1


def test_tokens_are_counted_as_they_are_made(spark):
    texts = ["", None, " \t", "a_b.c  d1 ٣é😀\r\n{\"x\": [1,-2]}", "\x0b__\x00", "aé_1b"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r.n for r in rows.select(T.token_count(F.col("x")).alias("n")).collect()] == [r.n for r in rows.select(F.size(T.tokens(F.col("x"))).alias("n")).collect()]


def test_identifiers_are_those_of_the_plain_patterns(spark):
    parts = ("a.py", "b", ".", "/", ":12", "-3", "x.json", ".cc", "é", "`", "Aa.bb", "KeyError", " ", "_", "(", ":", "pkg.mod_1")
    texts = ["".join(parts[(i * 7 + j * j * (i % 11 + 1) + i // 17 * j) % len(parts)] for j in range(i % 9 + 2)) for i in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    found = lambda p, g: F.regexp_extract_all("x", F.lit(p), F.lit(g))
    cut = lambda a, by: F.transform(a, lambda p: F.split_part(p, F.lit(by), F.lit(1)))
    plain = F.array_distinct(F.concat(cut(found(T.PATH, 0), ":"), cut(found(T.BACKTICK, 1), "("), found(T.DOTTED, 1), found(T.ERROR_CLASS, 1)))
    both = rows.select("x", T.identifiers(F.col("x")).alias("a"), F.filter(plain, lambda p: F.length(p) >= 3).alias("b"))
    assert both.filter("NOT a <=> b").collect() == []
    assert both.filter("size(a) > 1").count() > 300
