"""DuckDB SQL for the registered queries, written from the table rows on its own: steps come straight from event rows,
acceptance from a recursive query, masks from message structure."""

from __future__ import annotations

from foldloom.functions import text as T


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(column: str, markers: tuple[str, ...]) -> str:
    return f"len(list_filter([{', '.join(map(_q, markers))}], lambda m: contains(lower({column}), m))) > 0"


NL, NL2 = "chr(10)", "chr(10) || chr(10)"
TOKEN = r"'[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]'"
TOK = lambda x: f"len(regexp_extract_all({x}, {TOKEN}))"
CHAT = r"'<\|im_start\|>|<\|im_end\|>|\n|[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]'"
PHRASE = lambda s: "CASE " + " ".join(f"WHEN {s} = {_q(k)} THEN {_q(v)}" for k, v in T.PHRASES.items()) + f" ELSE {_q(T.DEFAULT_PHRASE)} END"
ID = "CASE t WHEN '<|im_start|>' THEN 1 WHEN '<|im_end|>' THEN 2 WHEN chr(10) THEN 3 WHEN 'user' THEN 11 WHEN 'assistant' THEN 12 ELSE 100 + list_sum(list_transform(range(1, 6), lambda j: (strpos('0123456789abcdef', substr(md5(t), j, 1)) - 1) * (16 ** (5 - j))::BIGINT)) END"

#: Steps of the event fixture (tid, i), heads and messages.
EVENTS = rf"""
ev AS (SELECT user_id AS tid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id, event_type AS kind, regexp_extract(props, '(\d+)', 1) AS k FROM events),
ey AS (SELECT *, 'src/mod_' || k || '.py' AS path, event_id % 97 = 0 AS plan,
  CASE WHEN kind IN ('view', 'signup') THEN 'str_replace_editor' ELSE 'execute_bash' END AS tool,
  CASE kind WHEN 'click' THEN 'ls src' WHEN 'purchase' THEN 'make order_' || event_id WHEN 'error' THEN 'cat log_' || k END AS cmd,
  'Next `step_' || k || '` with ' || kind || ' on pkg.mod_' || k AS thought,
  CASE kind WHEN 'view' THEN 'viewed src/mod_' || k || '.py' WHEN 'click' THEN 'item ' || k WHEN 'signup' THEN 'file created' WHEN 'purchase' THEN '3 passed' ELSE 'ValueError: bad k=' || k END AS obs FROM ev),
ez AS (SELECT *, CASE kind WHEN 'view' THEN '{{"command": "view", "path": "' || path || '"}}'
  WHEN 'signup' THEN '{{"command": "create", "path": "' || path || '", "file_text": "def handle_' || k || '(value, scale=1.0):\n    return scale * value + ' || k || '"}}'
  ELSE '{{"command": "' || cmd || '"}}' END AS args FROM ey),
st AS (SELECT *, {_any('obs', T.ERROR_MARKERS)} AS err, {_any('obs', T.VERIFY_MARKERS)} AS ver,
  tool = 'str_replace_editor' AND json_extract_string(args, '$.command') IN ('create', 'str_replace', 'insert') AS edit,
  coalesce(NOT regexp_matches(cmd, '{T.READ_ONLY}'), false) AS act,
  thought || {NL} || tool || {NL} || args || CASE WHEN plan THEN {NL} || 'task_tracker' || {NL} || '{{"command": "plan"}}' ELSE '' END AS said,
  'Thought: ' || thought || {NL} || 'Action: ' || tool || '(' || args || ')' || CASE WHEN plan THEN ' ; task_tracker({{"command": "plan"}})' ELSE '' END || {NL} AS pre FROM ez),
sp AS (SELECT *, edit OR act AS sc, {TOK('said')} + {TOK('obs')} AS tok, pre || 'Observation: ' || obs AS rendered, count(*) OVER (PARTITION BY tid) AS n FROM st),
hd AS (SELECT *, {TOK("'You are a careful engineer.'")} + {TOK('task')} AS head FROM (SELECT DISTINCT tid, 'Fix the service of user ' || tid || '.' AS task FROM ev)),
ms AS (SELECT tid, -1 AS step, 0 AS m, 'system' AS role, 'You are a careful engineer.' AS content, 'You are a careful engineer.' AS said, NULL::VARCHAR AS tname, NULL::VARCHAR AS answers, []::VARCHAR[] AS cid, []::VARCHAR[] AS cname, []::VARCHAR[] AS cargs FROM hd
  UNION ALL SELECT tid, -1, 1, 'user', task, task, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] FROM hd
  UNION ALL SELECT tid, i, 2 + 2 * i, 'assistant', thought, said, NULL::VARCHAR, NULL::VARCHAR, ['call_0_' || event_id] || CASE WHEN plan THEN ['call_1_' || event_id] ELSE [] END, [tool] || CASE WHEN plan THEN ['task_tracker'] ELSE [] END, [args] || CASE WHEN plan THEN ['{{"command": "plan"}}'] ELSE [] END FROM sp
  UNION ALL SELECT tid, i, 3 + 2 * i, 'tool', obs, obs, tool, 'call_0_' || event_id, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] FROM sp)"""
#: The same of the conversations.
TALKS = rf"""
ms AS (SELECT conv_id AS tid, turn AS m, role, text AS content, text AS said, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM conversations),
sp AS (SELECT tid, step AS i, max(CASE WHEN role = 'assistant' THEN content END) AS thought, coalesce(string_agg(CASE WHEN role != 'assistant' THEN {NL} || content END, '' ORDER BY m), '') AS obs,
  sum({TOK('content')})::BIGINT AS tok, count(*) AS n_msgs FROM ms WHERE step >= 0 GROUP BY tid, step),
hd AS (SELECT tid, sum({TOK('content')})::BIGINT AS head, count(*) AS q, coalesce(substr(min_by(content, m) FILTER (role = 'user'), 1, 4000), '') AS task FROM ms WHERE step < 0 GROUP BY tid)"""


def _folds(t_fold: int, gap: int, recent: int, run: int) -> str:
    """sg: steps with signals; fp: folds (tid, a, sig) with ranges lo, hi, rlo."""
    keep = f"coalesce(s.sig, CASE WHEN c.t + s.tok >= {t_fold} THEN 'expansion' END)"
    before = "OVER (PARTITION BY tid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
sf AS (SELECT *, i - 1 - coalesce(max(CASE WHEN NOT err THEN i END) {before}, -1) AS run, coalesce(max(sc::INT) {before}, 0) AS acted FROM sp),
sg AS (SELECT *, CASE WHEN plan THEN 'structural:plan' WHEN ver AND NOT err THEN 'structural:verified' WHEN sc AND acted = 0 THEN 'structural:first_action' WHEN run >= {run} AND NOT err THEN 'error_recovery' END AS sig FROM sf),
ac AS (SELECT tid, -1::BIGINT AS i, -1000000000::BIGINT AS last, head::BIGINT AS t, NULL::VARCHAR AS sig FROM hd
  UNION ALL SELECT tid, i, CASE WHEN take THEN i ELSE last END, CASE WHEN take THEN head ELSE t END, CASE WHEN take THEN sig END FROM (
    SELECT s.tid, s.i::BIGINT AS i, c.last, c.t + s.tok AS t, h.head, {keep} AS sig, {keep} IS NOT NULL AND s.i <= s.n - {recent} - 1 AND s.i - c.last >= {gap} AS take
    FROM ac c JOIN sg s ON s.tid = c.tid AND s.i = c.i + 1 JOIN hd h ON h.tid = c.tid)),
fa AS (SELECT tid, i AS a, sig, lag(i, 1, -1) OVER (PARTITION BY tid ORDER BY i) + 1 AS s0 FROM ac WHERE sig IS NOT NULL),
fb AS (SELECT *, greatest(s0, a - {recent} + 1) AS rlo FROM fa),
fp AS (SELECT f.*, CASE WHEN rlo - 1 >= s0 THEN s0 END AS lo, CASE WHEN rlo - 1 >= s0 THEN rlo - 1 END AS hi, x.n FROM fb f JOIN (SELECT tid, max(i) + 1 AS n FROM sp GROUP BY tid) x USING (tid)),
fs AS (SELECT f.tid, f.a, f.lo, f.hi, f.sig, f.n, coalesce((SELECT sum(tok) FROM sp WHERE sp.tid = f.tid AND sp.i BETWEEN f.lo AND f.hi), 0)::BIGINT AS toks FROM fp f)"""


FOLDS = EVENTS + "," + _folds(600, 8, 6, 2)


def _listed(name: str, item: str) -> str:
    return f"""
{name}_d AS (SELECT f.tid, f.a, {item} AS item, min(s.i) AS m FROM fs f JOIN sp s ON s.tid = f.tid AND s.i BETWEEN f.lo AND f.hi WHERE {item} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT tid, a, string_agg(item, {NL} ORDER BY m) AS x FROM {name}_d GROUP BY ALL)"""


MEMORY = FOLDS + "," + ",".join([
    _listed("did", "CASE WHEN s.edit THEN s.path WHEN s.act THEN s.cmd END"), _listed("fbk", "CASE WHEN s.err THEN s.obs END"), _listed("ded", "CASE WHEN s.err THEN s.cmd END"),
]) + f""",
mp AS (SELECT f.tid, f.a, f.lo, f.hi, f.sig, f.n, f.toks, h.task, coalesce(did.x, 'None yet') AS did, coalesce(fbk.x, 'None yet') AS feedback, coalesce(ded.x, 'None yet') AS dead,
  CASE WHEN l.err THEN l.obs ELSE 'None yet' END AS open, CASE WHEN x.tid IS NULL THEN 'finish' WHEN x.edit THEN 'edit' WHEN x.sc THEN 'run' WHEN x.plan THEN 'plan' ELSE 'read' END AS nxt
  FROM fs f JOIN hd h USING (tid) LEFT JOIN did USING (tid, a) LEFT JOIN fbk USING (tid, a) LEFT JOIN ded USING (tid, a)
  JOIN sp l ON l.tid = f.tid AND l.i = f.hi LEFT JOIN sp x ON x.tid = f.tid AND x.i = f.hi + 1 WHERE f.lo IS NOT NULL),
mb AS (SELECT *, '[Goal]' || {NL} || task || {NL2} || '[Attempts & Results]' || {NL} || did || {NL2} || '[Environment Feedback]' || {NL} || feedback || {NL2} || '[Active Constraints]' || {NL} || 'None' || {NL2}
  || '[Dead Ends]' || {NL} || dead || {NL2} || '[Open Threads]' || {NL} || open || {NL2} || '[Next]' || {NL} || nxt AS mem FROM mp)"""  # fmt: skip


def _chosen(filter_: str) -> str:
    """ch: kept folds of the widened ranges, with prev (the end of the one kept before)."""
    return f"""
wd AS (SELECT *, hi + (a % 3) * 4 AS hi2, row_number() OVER (PARTITION BY tid ORDER BY lo) AS rn FROM mb WHERE {filter_}),
gr AS (SELECT tid, 0::BIGINT AS rn, -1::BIGINT AS ends, NULL::BIGINT AS a, -1::BIGINT AS prev FROM (SELECT DISTINCT tid FROM wd)
  UNION ALL SELECT w.tid, w.rn, CASE WHEN w.lo > g.ends THEN w.hi2 ELSE g.ends END, CASE WHEN w.lo > g.ends THEN w.a END, g.ends FROM gr g JOIN wd w ON w.tid = g.tid AND w.rn = g.rn + 1),
ch AS (SELECT w.*, g.prev FROM gr g JOIN wd w ON w.tid = g.tid AND w.a = g.a)"""


#: A message as it goes on, and the two that a memory becomes: a context call whose only argument is the summary, and
#: what the tool says to that call.
SENT = "role, content, tname, answers, cid, cname, cargs"
_call_id = lambda mem, place: f"'call_ctx_' || substr(sha256({place} || '|' || {mem}), 1, 24)"
_told = lambda sig, mem, place: f"'assistant', {PHRASE(sig)}, NULL::VARCHAR, NULL::VARCHAR, [{_call_id(mem, place)}], ['context'], [json_object('summary', {mem})::VARCHAR]"
_answered = lambda mem, place: f"'tool', {_q(T.ACKNOWLEDGED)}, 'context', {_call_id(mem, place)}, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]"
CALLS = "array_to_string(cid, ',') AS call_ids, array_to_string(cname, ',') AS call_names, array_to_string(cargs, chr(10)) AS call_arguments"
USED = MEMORY + "," + _chosen("hi + (a % 3) * 4 < n")
ROLLING = USED + f""",
pn AS (SELECT tid, a, string_agg('- ' || item, {NL} ORDER BY m) AS x FROM (SELECT c.tid, c.a, d.item, min(d.m) AS m FROM ch c JOIN ch e ON e.tid = c.tid AND e.lo <= c.lo JOIN did_d d ON d.tid = e.tid AND d.a = e.a GROUP BY ALL) GROUP BY ALL),
rm AS (SELECT c.*, coalesce(pn.x, 'None yet') AS pinned, '[Pinned]' || {NL} || coalesce(pn.x, 'None yet') || {NL2} || mem AS rmem FROM ch c LEFT JOIN pn USING (tid, a)),
rp AS (SELECT *, lag(rmem) OVER (PARTITION BY tid ORDER BY lo) AS pmem, lag(sig) OVER (PARTITION BY tid ORDER BY lo) AS psig FROM rm),
ra AS (SELECT r.tid, r.a, CASE WHEN step = -1 THEN 0 WHEN step BETWEEN prev + 1 AND hi2 THEN 2 ELSE 4 END AS part, m, {SENT} FROM rp r JOIN ms USING (tid) WHERE step = -1 OR step BETWEEN prev + 1 AND hi2 + 6
  UNION ALL SELECT tid, a, 1, 0, {_told("psig", "pmem", "tid || '|' || a || '|prior'")} FROM rp WHERE pmem IS NOT NULL
  UNION ALL SELECT tid, a, 1, 1, {_answered("pmem", "tid || '|' || a || '|prior'")} FROM rp WHERE pmem IS NOT NULL
  UNION ALL SELECT tid, a, 3, 0, {_told("sig", "rmem", "tid || '|' || a")} FROM rp UNION ALL SELECT tid, a, 3, 1, {_answered("rmem", "tid || '|' || a")} FROM rp),
rx AS (SELECT *, row_number() OVER (PARTITION BY tid, a ORDER BY part, m) - 1 AS pos, count(*) FILTER (part < 3) OVER (PARTITION BY tid, a) AS target FROM ra)"""
STITCHED = USED + f""",
sa AS (SELECT tid, step, m, {SENT} FROM ms WHERE tid IN (SELECT tid FROM ch) AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.tid = ms.tid AND ms.step BETWEEN ch.lo AND ch.hi2)
  UNION ALL SELECT tid, lo, 0, {_told("sig", "mem", "tid || '|' || a")} FROM ch UNION ALL SELECT tid, lo, 1, {_answered("mem", "tid || '|' || a")} FROM ch),
sx AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY step, m) - 1 AS pos FROM sa)"""
GATE = MEMORY + f""",
gs AS (SELECT *, greatest(0, lo - 4) AS plo, CASE WHEN hi + 1 < n THEN hi + 1 END AS clo, CASE WHEN hi + 1 < n THEN least(n - 1, hi + 4) END AS chi FROM mb),
tk AS (SELECT tid, step, role = 'assistant' AS own, unnest(regexp_extract_all(said, {TOKEN})) AS t FROM ms),
bg AS (SELECT t, count(*) AS bg FROM tk GROUP BY t),
tt AS (SELECT sum(bg)::DOUBLE + count(*) AS nv FROM bg),
xr AS (SELECT g.tid, g.a, t, count(*) AS c FROM gs g JOIN tk USING (tid) WHERE step = -1 OR step BETWEEN plo AND hi GROUP BY ALL),
xf AS (SELECT tid, a, t, count(*) AS c FROM (SELECT g.tid, g.a, t FROM gs g JOIN tk USING (tid) WHERE step = -1 OR step BETWEEN plo AND lo - 1 UNION ALL SELECT tid, a, unnest(regexp_extract_all(mem, {TOKEN})) FROM gs) GROUP BY ALL),
cw AS (SELECT g.tid, g.a, t, count(*) AS c FROM gs g JOIN tk USING (tid) WHERE own AND step BETWEEN clo AND chi GROUP BY ALL),
nr AS (SELECT cw.tid, cw.a, -sum(cw.c * ln(0.5::DOUBLE * coalesce(xr.c, 0) / z.c + 0.5::DOUBLE * (bg + 1) / nv)) AS nll FROM cw LEFT JOIN xr USING (tid, a, t) JOIN (SELECT tid, a, sum(c) AS c FROM xr GROUP BY ALL) z USING (tid, a) JOIN bg USING (t), tt GROUP BY ALL),
nf AS (SELECT cw.tid, cw.a, -sum(cw.c * ln(0.5::DOUBLE * coalesce(xf.c, 0) / z.c + 0.5::DOUBLE * (bg + 1) / nv)) AS nll FROM cw LEFT JOIN xf USING (tid, a, t) JOIN (SELECT tid, a, sum(c) AS c FROM xf GROUP BY ALL) z USING (tid, a) JOIN bg USING (t), tt GROUP BY ALL),
gx AS (SELECT gs.*, ct.c AS ct, nr.nll AS nr, nf.nll AS nf, CASE WHEN clo IS NULL THEN 'no_continuation' WHEN cx.c > 900 THEN 'too_long' WHEN coalesce(ct.c, 0) = 0 THEN 'no_tokens' ELSE 'scored' END AS status
  FROM gs LEFT JOIN nr USING (tid, a) LEFT JOIN nf USING (tid, a) LEFT JOIN (SELECT tid, a, sum(c)::BIGINT AS c FROM cw GROUP BY ALL) ct USING (tid, a) LEFT JOIN (SELECT tid, a, sum(c) AS c FROM xr GROUP BY ALL) cx USING (tid, a)),
gd AS (SELECT *, CASE WHEN status = 'scored' THEN (nf - nr) / ct END AS d, CASE WHEN status = 'scored' THEN (nf - nr) / ct <= 0.15 END AS ok FROM gx)"""


def _chat(source: str, keys: str, order: str, text: str) -> str:
    """cl: (keys, pos of the message, j, id, label) of every chat token."""
    return f"""
c1 AS (SELECT {keys}, {order} AS mp, role, regexp_extract_all('<|im_start|>' || role || {NL} || {text} || '<|im_end|>' || {NL}, {CHAT}) AS ts FROM {source}),
c2 AS (SELECT {keys}, mp, role, len(ts) AS size, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS j FROM c1),
cl AS (SELECT {keys}, mp, j, ({ID})::BIGINT AS id, role = 'assistant' AND j > 3 AND j < size AS own, row_number() OVER (PARTITION BY {keys} ORDER BY mp, j) - 1 AS p FROM c2)"""


TALK_IDS = TALKS + "," + _chat("ms", "tid", "m", "content") + ", ln AS (SELECT tid, count(*) AS n, bool_or(own) AS any_own, sum(id)::BIGINT AS ids, sum(CASE WHEN own THEN id ELSE -100 END)::BIGINT AS labels FROM cl GROUP BY tid)"
#: The body of a turn: which call it answers, what it says, its calls.
SPOKEN = """concat_ws(chr(10), CASE WHEN role = 'tool' AND coalesce(answers, tname) IS NOT NULL THEN concat_ws(' ', '<tool_response>', answers, tname) END, nullif(content, ''),
  nullif(array_to_string(list_transform(range(1, len(cid) + 1), lambda k: '<tool_call> ' || cid[k] || ' ' || cname[k] || ' ' || cargs[k] || ' </tool_call>'), chr(10)), ''))"""


def _identifiers(source: str) -> str:
    """Distinct (tid, key columns, item) over the text column x of ``source``."""
    part = lambda e: f"SELECT * EXCLUDE (x), unnest({e}) AS item FROM {source}"
    return f"""(SELECT DISTINCT * FROM ({part(f"list_transform(regexp_extract_all(x, '{T.PATH}'), lambda p: split_part(p, ':', 1))")}
  UNION ALL {part(f"list_transform(regexp_extract_all(x, '{T.BACKTICK}', 1), lambda p: split_part(p, '(', 1))")}
  UNION ALL {part(f"regexp_extract_all(x, '{T.DOTTED}', 1)")} UNION ALL {part(f"regexp_extract_all(x, '{T.ERROR_CLASS}', 1)")}) WHERE length(item) >= 3)"""


HIT = "(contains(mem, item) OR (split_part(item, '/', -1) != '' AND (contains(mem, split_part(item, '/', -1)) OR contains(lower(mem), lower(split_part(item, '/', -1))))))"
RECALL = MEMORY + f""",
ri AS (SELECT DISTINCT m.tid, m.a, m.sig, m.mem, s.i, s.obs, s.path, s.cmd, s.edit, s.tool, s.said, s.thought, s.args, s.plan FROM mb m JOIN sp s ON s.tid = m.tid AND s.i BETWEEN m.lo AND m.hi),
rd0 AS (SELECT tid, a, thought || {NL} || tool || '(' || args || ')' || CASE WHEN plan THEN {NL} || 'task_tracker({{"command": "plan"}})' ELSE '' END AS x FROM ri),
ro0 AS (SELECT tid, a, obs AS x FROM ri),
rd AS {_identifiers('rd0')},
ro AS (SELECT * FROM {_identifiers('ro0')} EXCEPT SELECT * FROM rd),
it AS (SELECT DISTINCT tid, a, 'edited' AS kind, path AS item FROM ri WHERE edit
  UNION ALL SELECT DISTINCT tid, a, 'command', substr(cmd, 1, 60) FROM ri WHERE cmd IS NOT NULL AND NOT regexp_matches(cmd, '{T.READ_ONLY_RECALL}')
  UNION ALL SELECT DISTINCT tid, a, 'error', unnest(regexp_extract_all(obs, '{T.ERROR_CLASS}', 1)) FROM ri
  UNION ALL SELECT tid, a, 'decision', item FROM rd UNION ALL SELECT tid, a, 'observed', item FROM ro),
rc AS (SELECT it.tid, it.a, m.sig, kind, count(*) AS n_items, sum((CASE WHEN kind = 'error' THEN contains(mem, item) ELSE {HIT} END)::INT)::BIGINT AS n_kept FROM it JOIN mb m USING (tid, a) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    made: dict[str, str] = {}

    def add(name: str, chain: str, select: str) -> None:
        made[name] = f"WITH RECURSIVE {chain.strip()}\n{select}"

    key = "tid AS trajectory_id, a AS step_idx"
    step = "tid AS trajectory_id, i AS step_idx"
    talk_folds = TALKS.replace("count(*) AS n_msgs FROM", "count(*) AS n_msgs, false AS plan, false AS sc FROM")
    flagged = talk_folds + f", s0 AS (SELECT *, {_any('obs', T.ERROR_MARKERS)} AS err, {_any('obs', T.VERIFY_MARKERS)} AS ver, count(*) OVER (PARTITION BY tid) AS n FROM sp)"
    short = flagged + ", hx AS (SELECT tid, coalesce(h.head, 0) AS head FROM (SELECT DISTINCT tid FROM sp) LEFT JOIN hd h USING (tid))," + _folds(100, 1, 1, 2).replace("FROM sp)", "FROM s0)", 1).replace("FROM hd\n", "FROM hx\n").replace("JOIN hd h", "JOIN hx h")
    add("fold_points_events", FOLDS, f"SELECT {key}, sig AS signal, lo AS comp_lo, hi AS comp_hi, rlo AS recent_lo, a AS recent_hi FROM fp")
    add("fold_segments_tokens", FOLDS, f"SELECT {key}, lo AS comp_lo, hi AS comp_hi, toks AS comp_tokens, 2::BIGINT AS q_msgs, n AS num_steps FROM fs")
    add("fold_points_conversations", short, f"SELECT {key}, sig AS signal, lo AS comp_lo, hi AS comp_hi FROM fp")
    add("fold_signal_breakdown", FOLDS, "SELECT sig AS signal, count(*) AS n FROM fp GROUP BY sig")
    per = "(SELECT h.tid, count(f.a) AS n_folds FROM hd h LEFT JOIN fp f USING (tid) GROUP BY h.tid)"
    add("fold_count_histogram", FOLDS, f"SELECT n_folds, count(*) AS n_trajectories FROM {per} GROUP BY n_folds")
    add("fold_plan_stats", FOLDS, f"SELECT count(*) AS n_trajectories, sum(n_folds)::BIGINT AS n_folds, round(avg(n_folds), 3) AS avg_folds, (SELECT coalesce(round(avg(nullif(toks, 0)), 1), 0) FROM fs) AS avg_compressible, (SELECT sum(tok)::BIGINT FROM sp) AS step_tokens, (SELECT sum(head)::BIGINT FROM hd) AS head_tokens FROM {per}")
    add("error_run_lengths", FOLDS, f"SELECT {step}, run AS error_run FROM sf")
    add("first_action_steps", FOLDS, "SELECT tid AS trajectory_id, min(i) AS step_idx FROM sp WHERE sc GROUP BY tid")
    add("conv_steps", TALKS, f"SELECT {step}, thought, obs AS obs_text, n_msgs FROM sp")
    add("conv_step_render", TALKS, f"SELECT {step}, concat_ws({NL}, 'Thought: ' || nullif(trim(thought), ''), 'Observation: ' || nullif(trim(ltrim(obs, {NL})), '')) AS rendered FROM sp")
    add("conv_task_text", TALKS, "SELECT tid AS trajectory_id, task, q AS q_msgs FROM hd")
    add("conv_zero_step_drop", TALKS, "SELECT tid AS trajectory_id, count(*) AS num_steps FROM sp GROUP BY tid")
    add("conv_token_counts", TALKS, "SELECT s.tid AS trajectory_id, sum(tok)::BIGINT AS step_tokens, coalesce(any_value(head), 0) AS head_tokens FROM sp s LEFT JOIN hd USING (tid) GROUP BY s.tid")
    add("event_text_of", EVENTS, "SELECT tid AS trajectory_id, m AS msg_idx, said AS message_text FROM ms")
    add("text_error_flags", EVENTS, f"SELECT {step}, err FROM sp")
    add("text_verified_flags", EVENTS, f"SELECT {step}, ver AS verified, ver AS testpass FROM sp")
    add("readonly_commands", EVENTS, f"SELECT {step}, cmd AS command, regexp_matches(cmd, '{T.READ_ONLY}') AS reads_only, regexp_matches(cmd, '{T.READ_ONLY_RECALL}') AS reads_only_recall FROM sp WHERE cmd IS NOT NULL")
    add("step_action_flags", EVENTS, f"SELECT {step}, plan AS plan_call, edit AS file_edit, NOT sc AS readonly FROM sp")
    joined = lambda x: f"string_agg({x}, {NL2} ORDER BY s.i)"
    add("fold_slice_text", FOLDS, f"SELECT f.tid AS trajectory_id, f.a AS step_idx, {joined('s.rendered')} AS slice_text FROM fp f JOIN sp s ON s.tid = f.tid AND s.i BETWEEN f.lo AND f.hi GROUP BY f.tid, f.a")
    cont = lambda x, h, none: f"SELECT f.tid AS trajectory_id, f.a AS step_idx, coalesce({joined(x)}, {_q(none)}) AS continuation FROM fp f LEFT JOIN sp s ON s.tid = f.tid AND s.i BETWEEN f.hi + 1 AND f.hi + {h} WHERE f.lo IS NOT NULL GROUP BY f.tid, f.a"
    add("fold_continuation_text", FOLDS, cont(f"'[future step ' || s.i || ']' || {NL} || s.rendered", 4, "(none — this fold is near the end of the trajectory; the task is being finalized)"))
    add("rolling_continuation_text", FOLDS, cont("CASE WHEN length(s.rendered) > 120 THEN s.rendered || ' …[truncated]' ELSE s.rendered END", 6, "(none — near the end of the trajectory; the task is being finalized)"))
    sources = f"src AS (SELECT 'url' AS source, page_id AS key, url AS x FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'step', tid * 1000 + i, rendered FROM sp)"
    add("identifier_extract", EVENTS + "," + sources, f"SELECT source, key, item AS identifier FROM {_identifiers('src')}")
    add("memory_budget", FOLDS + ", b AS (SELECT *, greatest(128, least(trunc(toks * 0.3::DOUBLE)::BIGINT, 6000)) AS b FROM fs WHERE lo IS NOT NULL)",
        f"SELECT {key}, b AS budget, least(6512, greatest(1024, 2 * b)) AS out_cap, least(6768, greatest(1280, 2 * b)) AS out_cap_forward, 32768 - least(6512, greatest(1024, 2 * b)) - 256 AS in_cap, greatest(128, least(trunc(toks * 1.3::DOUBLE * 0.3::DOUBLE)::BIGINT, 4000)) AS word_budget FROM b")
    add("memory_truncate_slice", FOLDS + f", z AS (SELECT f.tid, f.a, {joined('s.rendered')} AS x FROM fp f JOIN sp s ON s.tid = f.tid AND s.i BETWEEN f.lo AND f.hi GROUP BY f.tid, f.a), zt AS (SELECT *, regexp_extract_all(x, {TOKEN}) AS t FROM z)",
        f"SELECT {key}, CASE WHEN len(t) > 120 THEN array_to_string(t[1:72], ' ') || {NL2} || '[... trajectory middle elided for length ...]' || {NL2} || array_to_string(t[len(t) - 47:], ' ') ELSE x END AS slice_text, len(t) > 120 AS slice_truncated FROM zt")
    add("memory_ratio_decision", MEMORY + f", q AS (SELECT *, {TOK('mem')}::DOUBLE / greatest(1, toks) AS r FROM mb)",
        f"SELECT {key}, round(r, 3) AS compression_ratio, CASE WHEN r > 0.6::DOUBLE THEN 'strict' WHEN r < 0.18::DOUBLE AND toks <= 300 THEN 'expand' ELSE 'accept' END AS guarded, CASE WHEN r > 0.6::DOUBLE THEN 'strict' WHEN r < 0.18::DOUBLE THEN 'expand' ELSE 'accept' END AS unguarded FROM q")
    add("memory_blocks", MEMORY, f"SELECT {key}, mem AS memory FROM mb")
    add("memory_sections", MEMORY, f"SELECT {key}, task AS goal, did AS attempts, feedback, 'None' AS constraints, dead AS dead_ends, open AS open_threads, nxt AS next FROM mb")
    add("memory_sections_complete", MEMORY, f"SELECT {key}, a % 4 != 0 AS complete, a % 4 = 0 AS rewrite FROM mb")
    add("pinned_set", MEMORY, f"SELECT {key}, '[Pinned]' || {NL} || '- repo: /w' || {NL2} || mem AS pinned_once, '[Pinned]' || {NL} || '- repo: /v' || {NL2} || mem AS pinned_twice FROM mb")
    add("pinned_merge", EVENTS + ", d AS (SELECT tid, i, CASE WHEN edit THEN path WHEN act THEN cmd END AS x FROM sp), e AS (SELECT *, lag(x) OVER (PARTITION BY tid ORDER BY i) AS p FROM d)",
        f"SELECT {step}, concat_ws({NL}, '  - ' || p, CASE WHEN x IS DISTINCT FROM p THEN '  - ' || x END, '- None yet.') AS pinned FROM e")
    good = "SELECT h.tid AS trajectory_id, count(f.a) AS n_folds, coalesce(bool_and(NOT ((f.tid + f.a) % 13 = 0 AND f.lo IS NOT NULL)), true) AS ok FROM hd h LEFT JOIN fp f USING (tid) GROUP BY h.tid"
    add("fold_all_or_nothing", FOLDS, good)
    add("fold_failed_ids", FOLDS, f"SELECT trajectory_id FROM ({good}) WHERE NOT ok")
    add("rolling_fold_selection", MEMORY + "," + _chosen("true"), f"SELECT {key}, lo AS comp_lo, hi2 AS comp_hi, prev AS prev_hi FROM ch")
    add("rolling_memory", ROLLING, f"SELECT {key}, pinned, rmem AS memory FROM rm")
    add("rolling_examples", ROLLING, f"SELECT {key}, target AS target_from_msg, pos, role, content, tname AS name, answers AS tool_call_id, {CALLS} FROM rx")
    add("gate_segments", FOLDS, f"SELECT {key}, lo AS comp_lo, hi AS comp_hi, greatest(0, lo - 4) AS p_lo, CASE WHEN hi + 1 < n THEN hi + 1 END AS c_lo, CASE WHEN hi + 1 < n THEN least(n - 1, hi + 4) END AS c_hi FROM fp WHERE lo IS NOT NULL")
    add("gate_segments_whole_prefix", FOLDS, f"SELECT {key}, lo AS comp_lo, hi AS comp_hi, 0::BIGINT AS p_lo, CASE WHEN hi + 1 < n THEN hi + 1 END AS c_lo, CASE WHEN hi + 1 < n THEN least(n - 1, hi + 4) END AS c_hi FROM fp WHERE lo IS NOT NULL")
    add("gate_nll", GATE, f"SELECT {key}, CASE WHEN status = 'scored' THEN round(nr, 3) END AS nll_raw, CASE WHEN status = 'scored' THEN round(nf, 3) END AS nll_folded, coalesce(ct, 0)::BIGINT AS c_tokens FROM gd")
    add("gate_decision", GATE, f"SELECT {key}, status, round(d, 4) AS delta_nll_per_tok, ok AS sufficient FROM gd")
    add("gate_filter", GATE, f"SELECT {key}, status FROM gd WHERE ok IS NULL OR ok")
    add("gate_stats", GATE + ", sd AS (SELECT round(d, 4) AS d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM gd WHERE d IS NOT NULL)",
        "SELECT count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (status != 'scored') AS unscorable, count(*) FILTER (ok) AS sufficient, (SELECT d FROM sd WHERE r = n // 2) AS median, (SELECT d FROM sd WHERE r = floor(n * 0.9::DOUBLE)) AS p90 FROM gd")
    repair = GATE + f""",
zz AS (SELECT f.tid, f.a, string_agg(s.rendered, {NL2} ORDER BY s.i) AS x FROM fp f JOIN sp s ON s.tid = f.tid AND s.i BETWEEN f.lo AND f.hi GROUP BY ALL),
r1 AS (SELECT d.*, d.mem || {NL2} || z.x AS mem2 FROM gd d JOIN zz z USING (tid, a) WHERE NOT ok),
rl AS (SELECT r.tid, r.a, coalesce(bool_or(length(trim(y.line)) >= 25 AND contains(mem2, trim(y.line))), false) AS leak FROM r1 r JOIN sp s ON s.tid = r.tid AND s.i BETWEEN r.clo AND r.chi,
  unnest(flatten(list_transform(list_filter([s.cmd, s.path, json_extract_string(s.args, '$.file_text')], lambda v: v IS NOT NULL), lambda v: string_split(v, {NL})))) AS y(line) GROUP BY ALL),
x2 AS (SELECT tid, a, t, count(*) AS c FROM (SELECT g.tid, g.a, t FROM r1 g JOIN tk USING (tid) WHERE step = -1 OR step BETWEEN plo AND lo - 1 UNION ALL SELECT tid, a, unnest(regexp_extract_all(mem2, {TOKEN})) FROM r1) GROUP BY ALL),
n2 AS (SELECT cw.tid, cw.a, -sum(cw.c * ln(0.5::DOUBLE * coalesce(x2.c, 0) / z.c + 0.5::DOUBLE * (bg + 1) / nv)) AS nll FROM cw LEFT JOIN x2 USING (tid, a, t) JOIN (SELECT tid, a, sum(c) AS c FROM x2 GROUP BY ALL) z USING (tid, a) JOIN bg USING (t), tt GROUP BY ALL),
rr AS (SELECT g.tid, g.a, CASE WHEN r.tid IS NOT NULL AND NOT rl.leak THEN 1 ELSE 0 END AS fixed, CASE WHEN r.tid IS NOT NULL AND NOT rl.leak THEN (n2.nll - g.nr) / g.ct ELSE g.d END AS d2 FROM gd g LEFT JOIN r1 r USING (tid, a) LEFT JOIN rl USING (tid, a) LEFT JOIN n2 USING (tid, a))"""
    add("gate_repair", repair, f"SELECT {key}, fixed::BIGINT AS repaired, round(d2, 4) AS delta_nll_per_tok, d2 <= 0.15 AS sufficient FROM rr")
    add("gate_repair_stats", repair, "SELECT count(*) FILTER (fixed = 1) AS repaired, count(*) FILTER (fixed = 1 AND d2 <= 0.15) AS recovered FROM rr")
    add("gate_by_signal", GATE, "SELECT sig AS signal, round(avg(ok::INT), 4) AS sufficiency, count(*) AS n FROM gd WHERE status = 'scored' GROUP BY sig")
    add("leak_check", GATE + f""", af AS (SELECT g.tid, g.a, g.mem, json_extract_string(s.args, '$.file_text') AS ft, unnest([s.cmd, s.path, json_extract_string(s.args, '$.file_text')]) AS v FROM gs g JOIN sp s ON s.tid = g.tid AND s.i BETWEEN g.clo AND g.chi),
q AS (SELECT tid, a, max(ft) AS q FROM af GROUP BY ALL), l AS (SELECT tid, a, unnest(string_split(v, {NL})) AS line FROM af WHERE v IS NOT NULL)""",
        "SELECT g.tid AS trajectory_id, g.a AS step_idx, coalesce(bool_or(length(trim(line)) >= 25 AND contains(CASE WHEN g.a % 3 = 0 THEN mem || coalesce(q, '') ELSE mem END, trim(line))), false) AS leaks FROM gs g LEFT JOIN q USING (tid, a) LEFT JOIN l USING (tid, a) GROUP BY g.tid, g.a")
    add("stitched_messages", STITCHED, f"SELECT tid AS trajectory_id, pos, role, content, tname AS name, answers AS tool_call_id, {CALLS} FROM sx")
    add("stitched_mask", STITCHED + "," + _chat("sx", "tid", "pos", SPOKEN), "SELECT tid AS trajectory_id, count(*) AS length, count(*) FILTER (own) AS n_labels, coalesce(sum(id) FILTER (own), 0)::BIGINT AS label_sum FROM cl GROUP BY tid")
    add("stitch_stats", STITCHED, "SELECT count(*) AS n_conversations, round(avg(k), 3) AS avg_folds, (SELECT count(*) FROM ms WHERE tid IN (SELECT tid FROM ch)) AS messages_before, (SELECT count(*) FROM sx) AS messages_after FROM (SELECT tid, count(*) AS k FROM ch GROUP BY tid)")
    other = "CASE WHEN a % 5 = 0 THEN 'structural:testpass' WHEN a % 7 = 0 THEN 'something else' ELSE sig END"
    add("trigger_phrases", FOLDS, f"SELECT {key}, {other} AS signal, {PHRASE(other)} AS phrase FROM fp")
    add("rendered_chat", STITCHED, f"""SELECT tid AS trajectory_id, '<|im_start|>system' || {NL} || '# Tools' || {NL} || '[{{"name": "context"}}]' || '<|im_end|>' || {NL} || string_agg('<|im_start|>' || role || {NL} || {SPOKEN} || '<|im_end|>' || {NL}, '' ORDER BY pos) AS chat FROM sx GROUP BY tid""")
    add("assistant_mask", TALK_IDS, "SELECT tid AS trajectory_id, p AS pos, CASE WHEN own THEN id ELSE -100 END AS label FROM cl")
    add("mask_filter", TALK_IDS, "SELECT tid AS trajectory_id, n AS length FROM ln WHERE n <= 500 AND any_own")
    add("rolling_mask", ROLLING + "," + _chat("rx JOIN (SELECT DISTINCT tid AS t2, a AS a2, target AS tg FROM rx) ON t2 = tid AND a2 = a", "tid, a, target", "pos", SPOKEN),
        f"SELECT {key}, count(*) AS length, count(*) FILTER (mp < target) AS start, count(*) FILTER (own AND mp >= target) AS n_labels, coalesce(sum(id) FILTER (own AND mp >= target), 0)::BIGINT AS label_sum FROM cl GROUP BY tid, a")
    add("length_cap", TALK_IDS, "SELECT tid AS trajectory_id, n AS length FROM ln WHERE n <= 300")
    add("length_stats", TALK_IDS + ", r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM ln)",
        "SELECT min(n) AS shortest, trunc(quantile_cont(n, 0.5))::BIGINT AS median, max(n) AS longest, count(*) AS examples, (SELECT n FROM r WHERE k = floor(c * 0.95::DOUBLE)) AS p95 FROM ln")
    add("pad_batches", TALK_IDS + ", t AS (SELECT *, tid // 8 AS batch, max(n) OVER (PARTITION BY tid // 8) AS w FROM ln WHERE n <= 4000 AND any_own)",
        "SELECT tid AS trajectory_id, batch, w AS width, n AS attended, ids AS id_sum, labels - 100 * (w - n) AS label_sum FROM t")
    add("lcp_arrays", TALK_IDS, """SELECT x.tid AS a_id, coalesce((SELECT min(u.p) FROM cl u JOIN cl v ON v.tid = u.tid + 1 AND v.p = u.p WHERE u.tid = x.tid AND u.id != v.id), least(x.n, y.n)) AS lcp, least(5, x.n) AS own FROM ln x JOIN ln y ON y.tid = x.tid + 1""")
    for name, kind in (("recall_edited", "edited"), ("recall_commands", "command"), ("recall_errors", "error")):
        add(name, RECALL, f"SELECT {key}, n_items, n_kept, round(n_kept / n_items, 6) AS recall FROM rc WHERE kind = '{kind}'")
    add("recall_identifiers", RECALL, f"SELECT {key}, kind, n_items, n_kept FROM rc WHERE kind IN ('decision', 'observed')")
    add("recall_summary", RECALL, "SELECT kind, round(avg(n_kept / n_items), 6) AS mean, round(quantile_cont(n_kept / n_items, 0.5), 6) AS median, floor(100 * count(*) FILTER (n_kept / n_items >= 0.999::DOUBLE) / count(*))::BIGINT AS fully_kept_pct, count(*) AS n FROM rc GROUP BY kind")
    add("recall_worst", RECALL, f"SELECT round(n_kept / n_items, 2) AS recall, sig AS signal, {key} FROM rc WHERE kind = 'decision' AND n_kept < n_items ORDER BY 1, 2, 3, 4 LIMIT 8")
    add("recall_string_arguments", RECALL, f"SELECT {key}, kind, n_items, n_kept FROM rc")
    add("recall_sample", MEMORY, f"SELECT {key} FROM mb ORDER BY sha256(tid::VARCHAR), tid, a LIMIT 120")
    add("avg_compression", MEMORY, f"SELECT count(*) AS n_folds, round(avg({TOK('mem')} / greatest(1, toks)), 3) AS avg_ratio FROM mb")
    words = lambda x: f"len(regexp_extract_all({x}, '[^ \\t\\n]+'))"
    add("rolling_word_ratio", ROLLING + f", nx AS (SELECT p.tid, p.a, string_agg(s.rendered, {NL2} ORDER BY s.i) AS x FROM rp p JOIN sp s ON s.tid = p.tid AND s.i BETWEEN p.prev + 1 AND p.hi2 GROUP BY ALL), rw AS (SELECT p.tid, p.a, {words('x')} AS w, {words('rmem')} / greatest(1, {words('x')} + coalesce({words('pmem')}, 0)) AS r FROM rp p JOIN nx USING (tid, a))",
        f"SELECT {key}, round(r, 3) AS word_ratio, CASE WHEN r > 0.62::DOUBLE THEN 'strict' WHEN r < 0.18::DOUBLE THEN 'expand' ELSE 'accept' END AS action, greatest(128, least(trunc(w * 1.3::DOUBLE * 0.3::DOUBLE)::BIGINT, 4000)) AS budget FROM rw")
    records = ", r AS (SELECT tid, count(*) AS n_msgs, tid AS place FROM ms GROUP BY tid), r2 AS (SELECT * FROM r UNION ALL SELECT tid, 2, tid + 100000 FROM r WHERE tid % 5 = 0)"
    add("pool_last_wins", TALKS + records, "SELECT tid AS trajectory_id, arg_max(n_msgs, place) AS n_msgs, max(place) AS at FROM r2 GROUP BY tid")
    counts = "(SELECT tid AS trajectory_id, count(*) AS num_steps FROM sp GROUP BY tid)"
    add("resume_pending", TALKS, f"SELECT * FROM {counts} WHERE trajectory_id % 3 != 1")
    add("limit_processed", TALKS, f"SELECT * FROM {counts} ORDER BY trajectory_id LIMIT 20")
    add("tools_with_context", TALKS, f"SELECT trajectory_id, CASE WHEN trajectory_id % 4 = 0 THEN 'context' ELSE 'execute_bash,context' END AS if_absent, CASE WHEN trajectory_id % 4 = 0 THEN 'context,context' ELSE 'execute_bash,context' END AS always FROM {counts}")
    add("pool_round_trip", EVENTS, "SELECT tid AS trajectory_id, row_number() OVER (PARTITION BY tid ORDER BY m) - 1 AS msg_idx, role, tname AS name, answers AS tool_call_id, length(content) AS n_chars, CASE WHEN role != 'assistant' THEN 0 ELSE 1 + (said LIKE '%task_tracker%')::INT END AS n_calls FROM ms")
    add("observation_noise", EVENTS, f"SELECT {step}, {NL} || obs || CASE WHEN i % 3 = 0 THEN '' ELSE {NL} || '[Command finished with exit code ' || (i % 3) || ']' END AS obs_text FROM sp")
    add("prompt_text", FOLDS + f", z AS (SELECT f.tid, f.a, f.lo, f.hi, f.toks, {joined('s.rendered')} AS x FROM fs f JOIN sp s ON s.tid = f.tid AND s.i BETWEEN f.lo AND f.hi GROUP BY ALL)",
        f"SELECT {key}, '# Task' || {NL} || task || {NL2} || '# History to compress: steps ' || lo || ' to ' || hi || {NL} || x || {NL2} || '# Length' || {NL} || 'About ' || greatest(128, least(trunc(toks * 0.3::DOUBLE)::BIGINT, 6000)) || ' tokens.' || {NL2} || 'Return the memory alone.' AS prompt FROM z JOIN hd USING (tid)")
    head = f"'# Task' || {NL} || task || {NL2} || "
    steps_of = lambda what: f"'# History {what}: steps ' || lo || ' to ' || hi || {NL} || x || {NL2} || "
    add("prompt_forward", FOLDS + f", z AS (SELECT f.tid, f.a, f.lo, f.hi, f.toks, {joined('s.rendered')} AS x FROM fs f JOIN sp s ON s.tid = f.tid AND s.i BETWEEN f.lo AND f.hi GROUP BY ALL), "
        + f"ct AS ({cont(f"'[future step ' || s.i || ']' || {NL} || s.rendered", 4, '(none — this fold is near the end of the trajectory; the task is being finalized)')})",
        f"SELECT {key}, {head}{steps_of('to compress')}'# What comes next, for orientation only' || {NL} || continuation || {NL2} || '# Length' || {NL} || 'About ' || greatest(128, least(trunc(toks * 0.3::DOUBLE)::BIGINT, 6000)) || ' tokens for the first four sections.' || {NL2} || 'Return the seven sections alone.' AS forward, "
        f"{head}{steps_of('that is compressed')}'# What follows' || {NL} || continuation || {NL2} || 'The memory before this lost facts that those steps need. Write all seven sections again with these facts, taken from the history; don''t quote the steps that follow.' AS repair "
        "FROM z JOIN hd USING (tid) JOIN ct ON ct.trajectory_id = z.tid AND ct.step_idx = z.a")  # fmt: skip
    add("prompt_rolling", ROLLING + f", nx AS (SELECT p.tid, p.a, string_agg(s.rendered, {NL2} ORDER BY s.i) AS x FROM rp p JOIN sp s ON s.tid = p.tid AND s.i BETWEEN p.prev + 1 AND p.hi2 GROUP BY ALL), "
        + f"ct AS (SELECT p.tid, p.a, coalesce(string_agg(CASE WHEN length(s.rendered) > 120 THEN s.rendered || ' …[truncated]' ELSE s.rendered END, {NL2} ORDER BY s.i), '(none — near the end of the trajectory; the task is being finalized)') AS c FROM rp p LEFT JOIN sp s ON s.tid = p.tid AND s.i BETWEEN p.hi2 + 1 AND p.hi2 + 6 GROUP BY ALL)",
        f"SELECT {key}, {head}'# Pinned facts so far' || {NL} || 'None yet' || {NL2} || '# Memory so far' || {NL} || coalesce(pmem, 'None: this is the first.') || {NL2} || '# New steps' || {NL} || substr(x, 1, 48000) || {NL2} || '# What comes next, for orientation only' || {NL} || c || {NL2} || '# Length' || {NL} || 'About ' || greatest(128, least(trunc({words('x')} * 1.3::DOUBLE * 0.3::DOUBLE)::BIGINT, 4000)) || ' tokens.' || {NL2} || 'Return all sections.' AS prompt FROM rp JOIN nx USING (tid, a) JOIN ct USING (tid, a)")
    add("plans_round_trip", FOLDS, f"SELECT {key}, f.sig AS signal, f.lo AS comp_lo, f.hi AS comp_hi, rlo AS recent_lo, toks AS comp_tokens, f.n AS num_steps, 2::BIGINT AS q_msgs FROM fs f JOIN (SELECT tid, a, rlo FROM fp) USING (tid, a)")
    add("folds_online", FOLDS, f"SELECT {key}, sig AS signal FROM fp")
    return made
