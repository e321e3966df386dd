"""The queries over the program trace in DuckDB's SQL."""

from __future__ import annotations

from ..functions.text import KINDS, PLAIN, REFERENCES
from ..model import RECORDS, WAIT_NAMES
from ..sources.fixtures import EDGE_SHAPES, SHAPES
from .oracle import DAY_NS, DEFS, EL, HI, K, LO, LOCS, S, T, q


def _values() -> str:
    say = lambda x: "NULL" if x is None else f"'{x}'"
    rows = [f"('{n}', {o}, {r}, {say(g)}, {say(x)})" for n, steps in {**SHAPES, **EDGE_SHAPES}.items() for o, r, g, x in steps]
    return ", ".join(rows)


#: The program's events.
P = f"""{T}, tm(shape, off, rec, reg, lab) AS (VALUES {_values()}),
f AS (SELECT *, ts_ns // {DAY_NS} AS day, lag(ts_ns // {DAY_NS}) OVER (PARTITION BY thread_id ORDER BY ts_ns) AS d1, lead(ts_ns // {DAY_NS}) OVER (PARTITION BY thread_id ORDER BY ts_ns) AS d2 FROM t),
sh AS (SELECT *, CAST(CASE name WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 + k % 3 WHEN 'click' THEN 4 WHEN 'view' THEN 5 ELSE 6 + k % 8 END AS VARCHAR) AS shape FROM f
  UNION ALL SELECT *, 'first' FROM f WHERE d1 IS NULL UNION ALL SELECT *, 'dawn' FROM f WHERE d1 IS NULL OR d1 <> day
  UNION ALL SELECT *, 'dusk' FROM f WHERE d2 IS NULL OR d2 <> day UNION ALL SELECT *, 'last' FROM f WHERE d2 IS NULL),
p AS (SELECT event_id * 1000 + off AS event_id, archive_id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY ts_ns + off) AS seq_no, ts_ns + off AS ts_ns,
    CAST(rec AS INTEGER) AS record, reg AS region, lab AS name, peer, communicator, tag, msg_length, CAST(k AS BIGINT) AS request_id, CAST(k % 5 AS BIGINT) AS lock_id, event_id AS acquisition_order,
    event_id % 50 AS task_id, CAST(k % 16 + 1 AS INTEGER) AS n_threads, CAST(k % 3 AS INTEGER) AS coll_op, CAST(k % 8 AS INTEGER) AS coll_root, msg_length AS size_sent, msg_length * 2 AS size_received, k
  FROM sh JOIN tm ON sh.shape = tm.shape)"""
_NAMES = " ".join(f"WHEN {v} THEN '{k}'" for k, v in RECORDS.items())
#: With phase, label and the running number of open blocks.
PD = f"""{P}, pd AS (SELECT *, CAST(sum(CASE phase WHEN 'E' THEN 1 WHEN 'L' THEN -1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY seq_no) AS BIGINT) AS run FROM (
  SELECT *, CASE WHEN record IN (2, 12, 14) THEN 'E' WHEN record IN (3, 13, 15) THEN 'L' END AS phase,
    CASE WHEN record IN (2, 3) THEN region WHEN record = 58 THEN name WHEN record = 13 THEN 'MPI_COLLECTIVE_BEGIN' WHEN record = 15 THEN 'OMP_FORK' ELSE CASE record {_NAMES} END END AS label FROM p)),
op AS (SELECT thread_id, seq_no, ts_ns, label, run - 1 AS depth FROM pd WHERE phase = 'E')"""
#: The blocks, with parents and exclusive times.
B = f"""{PD}, b0 AS (SELECT e.thread_id, e.depth, e.label, e.seq_no AS enter_seq, e.ts_ns AS start_ns, l.seq_no AS leave_seq, l.ts_ns AS finish_ns, l.ts_ns - e.ts_ns AS duration_ns
  FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, depth ORDER BY seq_no) AS rn FROM op) e
  JOIN (SELECT thread_id, run AS depth, seq_no, ts_ns, row_number() OVER (PARTITION BY thread_id, run ORDER BY seq_no) AS rn FROM pd WHERE phase = 'L') l ON e.thread_id = l.thread_id AND e.depth = l.depth AND e.rn = l.rn),
b1 AS (SELECT b0.*, u.seq_no AS parent_seq, u.ts_ns AS parent_ns FROM b0 ASOF LEFT JOIN op u ON u.thread_id = b0.thread_id AND u.depth = b0.depth - 1 AND b0.enter_seq >= u.seq_no),
b AS (SELECT b1.*, CASE WHEN depth = 0 THEN 0 ELSE duration_ns - coalesce(i.ns, 0) END AS exclusive_ns
  FROM b1 LEFT JOIN (SELECT thread_id, parent_seq, CAST(sum(duration_ns) AS BIGINT) AS ns FROM b1 GROUP BY 1, 2) i ON i.thread_id = b1.thread_id AND i.parent_seq = b1.enter_seq)"""
_IF = lambda c, records: f"CASE WHEN record IN ({records}) THEN {c} END"
_MASK = {
    "region": "2, 3", "peer": "4, 5, 8, 9", "communicator": "4, 5, 8, 9, 13", "tag": "4, 5, 8, 9", "msg_length": "4, 5, 8, 9", "request_id": "5, 6, 7, 9", "lock_id": "16, 17", "acquisition_order": "16, 17",
    "task_id": "18, 19, 20", "n_threads": "14", "coll_op": "13", "coll_root": "13", "size_sent": "13", "size_received": "13", "name": "58",
}
_PAYLOAD = ", ".join(f"{_IF(c, r)} AS {c}" for c, r in _MASK.items())
_TOKEN = " || '|' || ".join(["record", "label", *(f"coalesce(CAST({_IF(c, r)} AS VARCHAR), '')" for c, r in _MASK.items() if c not in ("region", "name"))])
#: Numbers of dictionary entries; texts of events; contents, sequences and loops of blocks.
TOK = f"""tk AS (SELECT *, {_TOKEN} AS token FROM pd),
ev AS (SELECT tk.*, i.event_no FROM tk JOIN (SELECT thread_id, token, row_number() OVER (PARTITION BY thread_id ORDER BY min(seq_no)) - 1 AS event_no FROM tk GROUP BY 1, 2) i ON tk.thread_id = i.thread_id AND tk.token = i.token)"""
SEQ = f"""{B}, {TOK},
co AS (SELECT b.thread_id, b.enter_seq, string_agg(token, ',' ORDER BY tk.seq_no) AS content, count(*) AS n_tokens FROM b JOIN tk ON tk.thread_id = b.thread_id AND tk.seq_no BETWEEN b.enter_seq AND b.leave_seq GROUP BY 1, 2),
s1 AS (SELECT b.*, co.content, co.n_tokens, min(b.enter_seq) OVER (PARTITION BY b.thread_id, co.content) AS first_seq FROM b JOIN co ON b.thread_id = co.thread_id AND b.enter_seq = co.enter_seq),
s2 AS (SELECT *, dense_rank() OVER (PARTITION BY thread_id ORDER BY first_seq) - 1 AS sequence_id FROM s1),
s3 AS (SELECT *, CASE WHEN parent_seq IS NOT NULL AND lag(leave_seq) OVER w + 1 = enter_seq AND lag(sequence_id) OVER w = sequence_id THEN 0 ELSE 1 END AS fresh FROM s2 WINDOW w AS (PARTITION BY thread_id, parent_seq ORDER BY enter_seq)),
s4 AS (SELECT *, max(CASE WHEN fresh = 1 THEN enter_seq END) OVER (PARTITION BY thread_id, parent_seq ORDER BY enter_seq) AS loop FROM s3),
bs AS (SELECT *, row_number() OVER (PARTITION BY thread_id, parent_seq, loop ORDER BY enter_seq) - 1 AS iteration FROM s4),
lp AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY first) - 1 AS loop_id FROM (SELECT thread_id, sequence_id, label AS name, n AS nb_iterations, count(*) AS nb_occurrences, min(loop) AS first
  FROM (SELECT thread_id, parent_seq, loop, sequence_id, label, count(*) AS n FROM bs GROUP BY ALL HAVING count(*) > 1) GROUP BY 1, 2, 3, 4)),
ss AS (SELECT thread_id, sequence_id, label AS name, max(n_tokens) AS n_tokens, count(*) AS n, min(duration_ns) AS min_ns, CAST(sum(duration_ns) // count(*) AS BIGINT) AS mean_ns, max(duration_ns) AS max_ns,
  CAST(sum(duration_ns) AS BIGINT) AS total_ns, CAST(sum(exclusive_ns) AS BIGINT) AS total_exclusive_ns FROM bs GROUP BY 1, 2, 3)"""
_P2P = "{word}=' || peer || ', comm=' || communicator || ', tag=' || tag || ', len=' || msg_length || '{more})'"
TEXT = f"""CASE record WHEN 2 THEN 'Enter (' || region || ')' WHEN 3 THEN 'Leave (' || region || ')'
  WHEN 4 THEN 'MPI_SEND({_P2P.format(word="dest", more="")} WHEN 5 THEN 'MPI_ISEND({_P2P.format(word="dest", more=", req=' || request_id || '")}
  WHEN 6 THEN 'MPI_ISEND_COMPLETE(req=' || request_id || ')' WHEN 7 THEN 'MPI_IRECV_REQUEST(req=' || request_id || ')'
  WHEN 8 THEN 'MPI_RECV({_P2P.format(word="src", more="")} WHEN 9 THEN 'MPI_IRECV({_P2P.format(word="src", more=", req=' || request_id || '")}
  WHEN 12 THEN 'MPI_COLLECTIVE_BEGIN()' WHEN 13 THEN 'MPI_COLLECTIVE_END(op=' || coll_op || ', comm=' || communicator || ', root=' || coll_root || ', sent=' || size_sent || ', recv=' || size_received || ')'
  WHEN 14 THEN 'OMP_FORK(nThreads=' || n_threads || ')' WHEN 15 THEN 'OMP_JOIN()'
  WHEN 16 THEN 'OMP_ACQUIRE_LOCK(lockID=' || lock_id || ', order=' || acquisition_order || ')' WHEN 17 THEN 'OMP_RELEASE_LOCK(lockID=' || lock_id || ', order=' || acquisition_order || ')'
  WHEN 18 THEN 'OMP_TASK_CREATE(taskID=' || task_id || ')' WHEN 19 THEN 'OMP_TASK_SWITCH(taskID=' || task_id || ')' WHEN 20 THEN 'OMP_TASK_COMPLETE(taskID=' || task_id || ')' ELSE name END"""


def _sec(x: str) -> str:
    return f"({x} // 1000000000) || '.' || lpad(CAST({x} % 1000000000 AS VARCHAR), 9, '0')"


_ETOKEN = "'E' || event_no || CASE WHEN record IN (2, 14) THEN 'E' WHEN record IN (3, 15) THEN 'L' ELSE 'S' END"
_LINE = f"{_sec('ts_ns')} || '  T' || thread_id || '  ' || {_ETOKEN} || '  ' || {TEXT} || '  {{k: ' || k || '}}'"
_RUNS = """(SELECT e.thread_id, e.seq_no, e.run, e.phase, e.label, e.record, e.ts_ns, e.event_no, bs.sequence_id, bs.duration_ns, n.times, {text} AS txt, CASE WHEN e.phase = 'E' THEN e.run - 1 ELSE e.run END AS depth
  FROM ev e LEFT JOIN bs ON bs.thread_id = e.thread_id AND bs.enter_seq = e.seq_no LEFT JOIN (SELECT thread_id, loop, count(*) AS times FROM bs GROUP BY 1, 2 HAVING count(*) > 1) n ON n.thread_id = e.thread_id AND n.loop = e.seq_no
  WHERE e.phase IS NULL OR e.phase = 'E')""".format(text=TEXT.replace("name END", "e.name END").replace("region", "e.region"))
_TREE = f"repeat('  ', depth) || CASE WHEN phase = 'E' THEN 'S' || sequence_id || ' ' || label ELSE {_ETOKEN} || ' ' || txt END || '  ' || {_sec('ts_ns')} || CASE WHEN phase = 'E' THEN '  +' || {_sec('duration_ns')} ELSE '' END"
_SKIPPED = "skipped AS (SELECT DISTINCT pd.thread_id, pd.seq_no FROM pd JOIN bs ON bs.thread_id = pd.thread_id AND bs.iteration > 0 AND pd.seq_no BETWEEN bs.enter_seq AND bs.leave_seq)"
_WAITS = ", ".join(f"'{x}'" for x in WAIT_NAMES)
#: Rows of messages: the next wait of an archive, completions of requests in order, channels in order.
MSG = f"""{PD}, wl AS (SELECT archive_id, ts_ns FROM pd WHERE record = 3 AND region IN ({_WAITS})),
x0 AS (SELECT pd.*, o.ts_ns AS open_ns FROM pd ASOF LEFT JOIN op o ON o.thread_id = pd.thread_id AND o.depth = pd.run - 1 AND pd.seq_no >= o.seq_no WHERE record BETWEEN 4 AND 9),
x AS (SELECT x0.*, w.ts_ns AS wait_ns FROM x0 ASOF LEFT JOIN wl w ON w.archive_id = x0.archive_id AND x0.ts_ns < w.ts_ns),
rq AS (SELECT *, row_number() OVER (PARTITION BY archive_id, request_id, record ORDER BY ts_ns) AS k2 FROM x),
sd AS (SELECT archive_id, request_id, i.event_id, i.ts_ns AS issue_ts, c.ts_ns AS done_ts, c.open_ns AS done_open FROM rq i JOIN rq c USING (archive_id, request_id, k2) WHERE i.record = 5 AND c.record = 6),
rd AS (SELECT archive_id, request_id, c.event_id, i.ts_ns AS issue_ts, c.ts_ns AS done_ts FROM rq i JOIN rq c USING (archive_id, request_id, k2) WHERE i.record = 7 AND c.record = 9),
se AS (SELECT x.archive_id AS sender, x.peer AS receiver, x.tag, x.msg_length AS sl, x.ts_ns AS isend_ts, CASE record WHEN 4 THEN x.ts_ns ELSE done_open END AS start_swait_ts, CASE record WHEN 4 THEN wait_ns ELSE done_ts END AS end_swait_ts
  FROM x LEFT JOIN sd ON sd.event_id = x.event_id WHERE record IN (4, 5)),
re AS (SELECT x.peer AS sender, x.archive_id AS receiver, x.tag, x.msg_length AS rl, x.ts_ns AS irecv_ts, CASE record WHEN 8 THEN x.ts_ns ELSE open_ns END AS start_rwait_ts, CASE record WHEN 8 THEN wait_ns ELSE x.ts_ns END AS end_rwait_ts
  FROM x LEFT JOIN rd ON rd.event_id = x.event_id WHERE record = 8 OR record = 9 AND rd.event_id IS NOT NULL),
m AS (SELECT *, least(isend_ts, irecv_ts) AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY sender, receiver, tag ORDER BY isend_ts) AS rn FROM se)
  FULL JOIN (SELECT *, row_number() OVER (PARTITION BY sender, receiver, tag ORDER BY irecv_ts) AS rn FROM re) USING (sender, receiver, tag, rn))"""
_ALLDEFS = f"""{DEFS}, {LOCS}, ad AS (
  SELECT 'strings' AS kind, scope, ref AS id, str AS name, NULL AS detail FROM defs
  UNION ALL SELECT 'regions', 'global', p_partkey, p_name, NULL FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'attributes', 'global', p_partkey, 'attribute ' || p_name, CAST(p_partkey % 26 AS VARCHAR) FROM part WHERE p_partkey < 20
  UNION ALL SELECT 'groups', 'global', r_regionkey, r_name, (SELECT string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) FROM region
  UNION ALL SELECT 'comms', 'global', r_regionkey + 100, 'comm ' || r_name, CAST(r_regionkey AS VARCHAR) FROM region
  UNION ALL SELECT 'location_groups', 'global', id, name, CAST(parent AS VARCHAR) FROM g UNION ALL SELECT 'locations', 'global', id, name, CAST(parent AS VARCHAR) FROM l)"""
_REFS = " ".join(f"WHEN '{k}' THEN '{w} <' || event_id || '>'" for k, w in REFERENCES.items())
_PLAIN = ", ".join(f"'{k}'" for k in PLAIN)
_KINDS = ", ".join(f"'{k}'" for k in KINDS)
_ROT = lambda x, r: f"((({x}) << {r}) | (({x}) >> {32 - r})) & 4294967295"
_MIX = lambda h: f"(({_ROT(h, 13)}) * 5 + 3864292196) & 4294967295"
_WORD = "(" + _ROT("(w * 3432918353) & 4294967295", 15) + ") * 461845907 & 4294967295"
_GAPS = lambda n: f"""SELECT thread_id, list_slice(toks, ix0 - {n}, ix0 - 1) AS body, pos0 - {n} AS start_pos, more // {n} + 1 AS nb_iterations FROM (
  SELECT thread_id, min(ix) AS ix0, min(pos) AS pos0, count(*) AS more, any_value(toks) AS toks FROM (
    SELECT *, ix - row_number() OVER (PARTITION BY thread_id ORDER BY pos) AS island FROM (
      SELECT *, row_number() OVER w AS ix, token = lag(token, {n}) OVER w AS same, list(token) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS toks FROM tok WINDOW w AS (PARTITION BY thread_id ORDER BY pos)) WHERE same)
  GROUP BY thread_id, island HAVING count(*) >= {n})"""  # noqa: E731
_STRETCHES = f"""st AS (SELECT * FROM ({_GAPS(1)}) UNION ALL SELECT * FROM ({_GAPS(2)}) WHERE body[1] <> body[2]
  UNION ALL SELECT * FROM ({_GAPS(3)}) WHERE NOT (body[1] = body[2] AND body[2] = body[3]))"""
LONGEST = 8
_REPEATS = ", ".join(f"min(CASE WHEN s{n} THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS h{n}" for n in range(1, LONGEST + 1))
_LAGS = ", ".join(f"token = lag(token, {n}) OVER w AS s{n}" for n in range(1, LONGEST + 1))
_TAIL = ", ".join(f"lag(token, {n}) OVER w" for n in range(4, 0, -1)) + ", token"

SQL: dict[str, str] = {
    "src_vector": q(T, "SELECT thread_id, name, idx // 1000 AS chunk, list(ts_ns ORDER BY ts_ns) AS timestamps FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, name ORDER BY ts_ns, event_id) - 1 AS idx FROM t) GROUP BY 1, 2, 3"),
    "src_open_trace": q(f"{S}, {_ALLDEFS}", "SELECT 'events' AS what, count(*) AS n, min(ts_ns) AS low, max(ts_ns) AS high FROM t UNION ALL SELECT 'spans', count(*), min(start_ns), max(finish_ns) FROM s UNION ALL SELECT kind, count(*), min(id), max(id) FROM ad GROUP BY kind UNION ALL SELECT 'threads', count(DISTINCT thread_id), min(thread_id), max(thread_id) FROM t UNION ALL SELECT 'archives', count(DISTINCT archive_id), min(archive_id), max(archive_id) FROM t"),
    "sink_store_trace": q(f"{S}, {_ALLDEFS}", "SELECT 'events' AS what, thread_id AS id, CAST(sum(msg_length) AS VARCHAR) AS content FROM t GROUP BY 2 UNION ALL SELECT 'spans', thread_id, CAST(sum(duration_ns + exclusive_ns) AS VARCHAR) FROM s GROUP BY 2 UNION ALL SELECT kind, id, scope || ' ' || name || coalesce(' ' || detail, '') FROM ad"),
    "agg_definitions": q(_ALLDEFS, "SELECT kind, scope, id, name, detail FROM ad"),
    "sink_register_defs": q(_ALLDEFS, "SELECT kind, scope, id, count(*) AS n FROM (SELECT * FROM ad UNION ALL SELECT * FROM ad WHERE id < 5) GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "sink_definition_loader": q(_ALLDEFS, "SELECT kind AS dictionary, scope, id, name FROM ad"),
    "src_callbacks": q(f"{PD}, {_ALLDEFS}", f"SELECT 'event ' || CASE record {_NAMES} END AS callback, count(*) AS n FROM pd WHERE thread_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 'definition ' || kind, count(*) FROM ad WHERE scope = 'global' GROUP BY 1"),
    "sink_record": q(P, f"SELECT thread_id, seq_no, ts_ns, record, {_PAYLOAD} FROM p"),
    "sink_call_adapter": q(P, f"SELECT archive_id, thread_id, seq_no, ts_ns, record, {_IF('peer', _MASK['peer'])} AS peer, {_IF('request_id', _MASK['request_id'])} AS request_id FROM p"),
    "sink_call_print": q(P, f"SELECT thread_id, seq_no, {TEXT} AS text FROM p"),
    "sink_clock": q(T, "SELECT thread_id, event_id, coalesce(last_value(CASE WHEN k % 10 <> 0 THEN ts_ns END IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(CASE WHEN k % 10 <> 0 THEN ts_ns END) OVER (PARTITION BY thread_id)) AS ts_ns FROM t"),
    "enc_masking": q(T, "SELECT event_id, width, upper(list_aggregate([substr(h, 15 - 2 * i, 2) FOR i IN range(width)], 'string_agg', '')) AS masked, msg_length AS value FROM (SELECT *, lpad(hex(msg_length), 16, '0') AS h, CASE WHEN most < 256 THEN 1 WHEN most < 65536 THEN 2 WHEN most < 4294967296 THEN 4 ELSE 8 END AS width FROM (SELECT *, max(msg_length) OVER (PARTITION BY archive_id) AS most FROM t))"),
    "sink_print_events": q(f"{PD}, {TOK}", f"SELECT thread_id, seq_no, {_LINE} AS line FROM ev"),
    "sink_text_dump": q(f"{PD}, {TOK}", f"SELECT {_LINE} AS line FROM ev WHERE thread_id % 3 = 0"),
    "sink_flamegraph": q(f"{B}, pa AS (SELECT thread_id, enter_seq, depth, label AS stack FROM b WHERE depth = 0 UNION ALL SELECT b.thread_id, b.enter_seq, b.depth, pa.stack || ';' || b.label FROM b JOIN pa ON b.thread_id = pa.thread_id AND b.parent_seq = pa.enter_seq)",
        "SELECT stack, CAST(sum(nx - ts_ns) AS BIGINT) AS self_ns FROM (SELECT e.thread_id, e.ts_ns, e.nx, o.seq_no AS open_seq FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY thread_id ORDER BY seq_no) AS nx FROM pd) e ASOF JOIN op o ON o.thread_id = e.thread_id AND o.depth = e.run - 1 AND e.seq_no >= o.seq_no WHERE nx IS NOT NULL) z JOIN pa ON pa.thread_id = z.thread_id AND pa.enter_seq = z.open_seq GROUP BY 1"),
    "sink_structure": q(SEQ, f"SELECT thread_id, seq_no, {_TREE} AS line FROM {_RUNS}"),
    "sink_structure_loops": q(f"{SEQ}, {_SKIPPED}", f"SELECT r.thread_id, r.seq_no, {_TREE} || CASE WHEN times > 1 THEN '  x' || times ELSE '' END AS line FROM {_RUNS} r WHERE NOT EXISTS (SELECT 1 FROM skipped k WHERE k.thread_id = r.thread_id AND k.seq_no = r.seq_no)".replace("SELECT r.thread_id, r.seq_no, repeat", "SELECT r.thread_id, r.seq_no, repeat")),
    "proj_event_data": q(P, f"SELECT thread_id, seq_no, record, {_PAYLOAD} FROM p"),
    "proj_event_name": q(P, f"SELECT thread_id, seq_no, {TEXT} AS text FROM p"),
    "proj_token_string": q(f"{SEQ}", f"SELECT thread_id, seq_no, {_ETOKEN} AS token FROM ev UNION ALL SELECT thread_id, enter_seq, 'S' || sequence_id FROM bs UNION ALL SELECT l.thread_id, l.first, 'L' || l.loop_id FROM lp l"),
    "proj_attribute_print": q(T, f"SELECT event_id, kind, CASE WHEN kind = 'NONE' THEN 'NONE' WHEN kind IN ({_PLAIN}) THEN CAST(event_id AS VARCHAR) WHEN kind IN ('FLOAT', 'DOUBLE') THEN printf('%.6f', k / 8.0) WHEN kind = 'STRING' THEN 'string <' || event_id || '> \"' || name || '\"' ELSE CASE kind {_REFS} END END AS text FROM (SELECT *, [{_KINDS}][1 + event_id % {len(KINDS)}] AS kind FROM t)"),
    "proj_sequence_name": q(SEQ, "SELECT DISTINCT thread_id, sequence_id, CASE WHEN label IN ('MPI_COLLECTIVE_BEGIN', 'OMP_FORK') THEN 'Sequence_' || sequence_id ELSE label END AS name FROM bs"),
    "proj_sequence_names_bulk": q(SEQ, "SELECT DISTINCT s.thread_id, s.sequence_id, CASE WHEN s.sequence_id = 0 THEN 'main' WHEN n_tokens <= 4 AND label NOT IN ('MPI_COLLECTIVE_BEGIN', 'OMP_FORK') THEN label WHEN i.loop_id IS NOT NULL THEN 'Loop_' || i.loop_id ELSE 'Sequence_' || s.sequence_id END AS name FROM bs s LEFT JOIN (SELECT thread_id, sequence_id, min(loop_id) AS loop_id FROM lp GROUP BY 1, 2) i ON i.thread_id = s.thread_id AND i.sequence_id = s.sequence_id"),
    "proj_seq_props": q(SEQ, "SELECT *, 'BLOCK' AS type FROM ss WHERE name NOT IN ('MPI_COLLECTIVE_BEGIN', 'OMP_FORK') UNION ALL SELECT *, 'OTHER' FROM ss WHERE name IN ('MPI_COLLECTIVE_BEGIN', 'OMP_FORK')"),
    "proj_loop_props": q(SEQ, "SELECT thread_id, loop_id, sequence_id, nb_iterations FROM lp"),
    "agg_loop_info": q(SEQ, "SELECT thread_id, loop_id, sequence_id, name, nb_iterations, nb_occurrences FROM lp"),
    "agg_seq_info": q(SEQ, "SELECT ss.*, CASE WHEN n * (mean_ns - min_ns) > d THEN CAST(-1 AS DOUBLE) WHEN d = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(n * (mean_ns - min_ns) AS DOUBLE) / d, 6) END AS contention FROM ss JOIN (SELECT thread_id, max(finish_ns) - min(start_ns) AS d FROM bs GROUP BY 1) w ON w.thread_id = ss.thread_id"),
    "agg_thread_summary": q(SEQ, "SELECT e.archive_id, e.thread_id, 'thread ' || e.thread_id AS name, first_ns, last_ns, last_ns - first_ns AS duration_ns, n_events, n_definitions, n_sequences, coalesce(n_loops, 0) AS n_loops FROM (SELECT archive_id, thread_id, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(*) AS n_events, count(DISTINCT token) AS n_definitions FROM tk GROUP BY 1, 2) e JOIN (SELECT thread_id, count(DISTINCT sequence_id) AS n_sequences FROM bs GROUP BY 1) s ON s.thread_id = e.thread_id LEFT JOIN (SELECT thread_id, count(*) AS n_loops FROM lp GROUP BY 1) l ON l.thread_id = e.thread_id"),
    "agg_snapshot_fast": q(S, f"SELECT thread_id, name, CAST(sum(CAST(round(CASE WHEN l = f THEN CAST(1 AS DOUBLE) ELSE CAST(least(l, {HI}) - greatest(f, {LO}) AS DOUBLE) / (l - f) END * e) AS BIGINT)) AS BIGINT) AS ns FROM (SELECT thread_id, name, idx // 1000 AS c, min(start_ns) AS f, max(finish_ns) AS l, CAST(sum(exclusive_ns) AS BIGINT) AS e FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, name ORDER BY start_ns, finish_ns, event_id) - 1 AS idx FROM s) GROUP BY 1, 2, 3) WHERE l >= {LO} AND f <= {HI} GROUP BY 1, 2"),
    "flt_valid": q(SEQ, "SELECT thread_id, kind, id, kind <> 'I' AS is_valid, kind IN ('S', 'L') AS is_iterable, row_number() OVER (PARTITION BY thread_id ORDER BY CASE kind WHEN 'I' THEN 0 WHEN 'E' THEN 1 WHEN 'S' THEN 2 ELSE 3 END, id) AS place FROM (SELECT DISTINCT thread_id, 'E' AS kind, event_no AS id FROM ev UNION ALL SELECT DISTINCT thread_id, 'S', sequence_id FROM bs UNION ALL SELECT thread_id, 'L', loop_id FROM lp UNION ALL SELECT DISTINCT thread_id, 'I', 0 FROM ev)"),
    "trv_flags": q(f"{SEQ}, {_SKIPPED}, fl AS (SELECT pd.thread_id, pd.seq_no, k.seq_no IS NOT NULL AS skipped, CASE WHEN phase = 'E' THEN run - 1 ELSE run END AS depth, phase FROM pd LEFT JOIN skipped k ON k.thread_id = pd.thread_id AND k.seq_no = pd.seq_no), tp AS (SELECT *, depth = 0 OR depth = 1 AND coalesce(phase, '') <> 'L' AS top FROM fl)",
        "SELECT 'ALL' AS flag, thread_id, seq_no FROM tp UNION ALL SELECT 'SEQUENCES', thread_id, seq_no FROM tp WHERE NOT skipped UNION ALL SELECT 'LOOPS', thread_id, seq_no FROM tp WHERE top UNION ALL SELECT 'NONE', thread_id, seq_no FROM tp WHERE top AND NOT skipped"),
    "trv_next_prev": q(EL, "SELECT thread_id, seq_no, lag(name) OVER w AS prev_name, lead(name) OVER w AS next_name, phase = 'E' AS enters, phase = 'L' AS leaves, coalesce(lead(phase) OVER w = 'L', true) AS ends_block, lead(phase) OVER w IS NULL AS ends_thread FROM el WINDOW w AS (PARTITION BY thread_id ORDER BY seq_no)"),
    "trv_checkpoint": q(EL, "SELECT el.thread_id, seq_no, ts_ns, phase, name FROM el JOIN (SELECT thread_id, count(*) // 2 AS mark FROM el GROUP BY 1) k ON k.thread_id = el.thread_id AND seq_no >= mark"),
    "join_enclosing_enter": q(PD, "SELECT e.thread_id, e.seq_no, o.seq_no AS enclosing_seq, o.ts_ns AS enclosing_ns FROM pd e ASOF LEFT JOIN op o ON o.thread_id = e.thread_id AND o.depth = e.run - 1 AND e.seq_no >= o.seq_no WHERE e.phase IS NULL"),
    "join_request": q(MSG, "SELECT 'send' AS kind, archive_id, request_id, issue_ts, done_ts AS completion_ts FROM sd UNION ALL SELECT 'receive', archive_id, request_id, issue_ts, done_ts FROM rd"),
    "join_wait_asof": q(MSG, "SELECT event_id, ts_ns, wait_ns AS wait_end_ns FROM x"),
    "agg_messages": q(MSG, "SELECT id, sender, receiver, tag, msg_length, isend_ts, start_swait_ts, end_swait_ts, irecv_ts, start_rwait_ts, end_rwait_ts FROM (SELECT *, row_number() OVER (ORDER BY first_ts) AS id, CASE WHEN irecv_ts IS NULL OR isend_ts <= irecv_ts THEN sl ELSE rl END AS msg_length FROM m) WHERE end_swait_ts IS NOT NULL AND start_swait_ts IS NOT NULL AND end_rwait_ts IS NOT NULL"),
    "join_grammar_align": q(SEQ, "SELECT DISTINCT thread_id, sequence_id, dense_rank() OVER (ORDER BY ft, fi) - 1 AS shared_id FROM (SELECT thread_id, sequence_id, first_value(thread_id) OVER w AS ft, first_value(sequence_id) OVER w AS fi FROM bs WINDOW w AS (PARTITION BY content ORDER BY thread_id, sequence_id))"),
    "gram_sequence_dict": q(SEQ, "SELECT thread_id, sequence_id, name, n_tokens, n AS nb_occurrences FROM ss"),
    "gram_close": q(EL, f"SELECT e.thread_id, e.level AS depth, e.name, e.ts_ns AS start_ns, coalesce(l.ts_ns, z.z) AS finish_ns, l.ts_ns IS NULL AS cut FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, level ORDER BY seq_no) AS rn FROM el WHERE phase = 'E' AND ts_ns < {HI}) e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY thread_id, level ORDER BY seq_no) AS rn FROM el WHERE phase = 'L' AND ts_ns < {HI}) l ON l.thread_id = e.thread_id AND l.level = e.level AND l.rn = e.rn JOIN (SELECT thread_id, max(ts_ns) AS z FROM el WHERE ts_ns < {HI} GROUP BY 1) z ON z.thread_id = e.thread_id"),
    "gram_find_loop": q(K, f"SELECT thread_id, pos, CASE {' '.join(f'WHEN h{n} = 1 THEN {n}' for n in range(1, LONGEST + 1))} END AS size FROM (SELECT thread_id, pos, {_REPEATS} FROM (SELECT thread_id, pos, {_LAGS} FROM tok WINDOW w AS (PARTITION BY thread_id ORDER BY pos))) WHERE {' OR '.join(f'h{n} = 1' for n in range(1, LONGEST + 1))}"),
    "gram_loop_squash": q(f"{K}, {_STRETCHES}", "SELECT thread_id, body, nb_iterations, count(*) AS nb_occurrences FROM st GROUP BY 1, 2, 3"),
    "gram_find_sequence": q(f"{K}, dict AS (SELECT DISTINCT list(token ORDER BY pos) AS tokens FROM tok GROUP BY thread_id, ts_ns // {DAY_NS}), tl AS (SELECT thread_id, pos, [{_TAIL}] AS tail FROM tok WINDOW w AS (PARTITION BY thread_id ORDER BY pos))",
        "SELECT thread_id, pos, CAST(min(size) AS INTEGER) AS size FROM (SELECT thread_id, pos, size, list_slice(tail, 6 - size, 5) AS cut FROM tl, (SELECT unnest([2, 3, 4, 5]) AS size) z) x WHERE cut IN (SELECT tokens FROM dict) GROUP BY 1, 2"),
    "gram_sync": q(f"{K}, dy AS (SELECT thread_id, ts_ns // {DAY_NS} AS day, string_agg(sha256('E' || token), ',' ORDER BY pos) AS c, min(pos) AS pos FROM tok GROUP BY 1, 2)",
        "SELECT DISTINCT thread_id, 'E' || token AS id, sha256('E' || token) AS shared FROM tok UNION ALL SELECT thread_id, 'S' || day, sha256('S' || c) FROM dy UNION ALL SELECT thread_id, 'root', sha256('S' || string_agg(sha256('S' || c), ',' ORDER BY pos)) FROM dy GROUP BY 1"),
    "fn_murmur3": q(f"{K}, wd AS (SELECT thread_id, ts_ns // {DAY_NS} AS block, list(CAST(length(token) AS UBIGINT) ORDER BY pos) AS ws FROM tok GROUP BY 1, 2), hs AS (SELECT thread_id, block, list_reduce(list_prepend(CAST(17 AS UBIGINT), ws), lambda h, w: {_MIX(f'xor(h, {_WORD})')}) AS h0, len(ws) * 4 AS n FROM wd), h1 AS (SELECT *, xor(h0, CAST(n AS UBIGINT)) AS a FROM hs), h2 AS (SELECT *, (xor(a, a >> 16) * 2246822507) & 4294967295 AS c FROM h1), h3 AS (SELECT *, (xor(c, c >> 13) * 3266489909) & 4294967295 AS d FROM h2)",
        "SELECT thread_id, block, CAST(xor(d, d >> 16) AS BIGINT) AS hash FROM h3"),
    "stream_comm_over_time": q(T, f"SELECT ts_ns // {DAY_NS} * {DAY_NS} AS start_ns, CAST(sum(msg_length) AS BIGINT) AS bytes, count(*) AS messages FROM t WHERE record IN (4, 5, 8, 9) GROUP BY 1"),
    "stream_spans": q(S, "SELECT thread_id, CAST(level AS INTEGER) AS depth, name, start_ns, finish_ns FROM s"),
}
