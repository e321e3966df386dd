"""The catalogue's queries in DuckDB's SQL. Fixtures are common table expressions."""

from __future__ import annotations

LO, HI = 1704844800_000000000, 1705708800_000000000  # 10 and 20 January 2024
DAY_NS = 86_400_000_000_000
FIRST_DAY = 1704067200_000000000
EDGES = [FIRST_DAY + d * DAY_NS for d in range(31)]
SLICES = [LO + d * DAY_NS for d in range(11)]

T = """t AS (
  SELECT event_id, CAST(user_id % 8 AS INTEGER) AS archive_id, user_id AS thread_id, epoch_us(ts) * 1000 AS ts_ns,
    CAST(CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 WHEN 'click' THEN 8 WHEN 'view' THEN 9 ELSE 58 END AS INTEGER) AS record,
    event_type AS name, CAST(k % 8 AS INTEGER) AS peer, CAST(k % 4 AS INTEGER) AS tag, CAST(round(value * 100) AS BIGINT) AS msg_length,
    event_id AS request_id, 0 AS communicator, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

S = (
    T
    + f""", leaf AS (
  SELECT thread_id, 2 AS level, day, event_id, name, ts_ns AS start_ns,
    least(ts_ns + CAST(k AS BIGINT) * 60000000000, coalesce(lead(ts_ns) OVER (PARTITION BY thread_id, day ORDER BY ts_ns, event_id), ts_ns)) AS finish_ns
  FROM (SELECT *, ts_ns // {DAY_NS} AS day FROM t)),
s AS (
  SELECT *, finish_ns - start_ns AS duration_ns, finish_ns - start_ns AS exclusive_ns FROM leaf
  UNION ALL SELECT d.thread_id, 1, d.day, NULL, 'day', a, b, b - a, b - a - i.inside
    FROM (SELECT thread_id, day, min(start_ns) AS a, max(start_ns) AS b FROM leaf GROUP BY 1, 2) d
    JOIN (SELECT thread_id, day, CAST(sum(finish_ns - start_ns) AS BIGINT) AS inside FROM leaf GROUP BY 1, 2) i ON d.thread_id = i.thread_id AND d.day = i.day
  UNION ALL SELECT thread_id, 0, NULL, NULL, 'main', min(ts_ns), max(ts_ns), max(ts_ns) - min(ts_ns), 0 FROM t GROUP BY 1)"""
)
EL = (
    S
    + """, el AS (
  SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY ts_ns, order_key) AS seq_no, ts_ns, phase, name, level FROM (
    SELECT thread_id, name, level, start_ns AS ts_ns, 'E' AS phase, 10 + level AS order_key FROM s
    UNION ALL SELECT thread_id, name, level, finish_ns, 'L', CASE WHEN level = 2 AND duration_ns > 0 THEN 5 ELSE 20 - level END FROM s))"""
)
K = T + ", tok AS (SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY ts_ns, event_id) AS pos, name AS token, ts_ns FROM t)"
DEFS = "defs AS (SELECT 'global' AS scope, p_partkey AS ref, p_name AS str FROM part UNION ALL SELECT 'local', p_partkey, 'local ' || p_name FROM part WHERE p_partkey % 10 = 0)"
LOCS = """g AS (SELECT CAST(r_regionkey + 1000 AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent FROM region
  UNION ALL SELECT n_nationkey, n_name, n_regionkey + 1000 FROM nation),
l AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS parent FROM supplier)"""
DEFN = "SELECT DISTINCT archive_id, thread_id, record, peer, communicator, tag, msg_length, CASE WHEN record IN (5, 9) THEN request_id END AS request_id FROM t WHERE record IN (4, 5, 8, 9)"
BINS = f"bins AS (SELECT CAST(i AS INTEGER) AS i, {FIRST_DAY} + i * {DAY_NS} AS lo, {FIRST_DAY} + (i + 1) * {DAY_NS} AS hi FROM range(30) r(i))"
EVENT_TEXT = """CASE record WHEN 4 THEN 'MPI_SEND(dest=' || peer || ', comm=' || communicator || ', tag=' || tag || ', len=' || msg_length || ')'
  WHEN 5 THEN 'MPI_ISEND(dest=' || peer || ', comm=' || communicator || ', tag=' || tag || ', len=' || msg_length || ', req=' || request_id || ')'
  WHEN 8 THEN 'MPI_RECV(src=' || peer || ', comm=' || communicator || ', tag=' || tag || ', len=' || msg_length || ')'
  WHEN 9 THEN 'MPI_IRECV(src=' || peer || ', comm=' || communicator || ', tag=' || tag || ', len=' || msg_length || ', req=' || request_id || ')'
  ELSE name END"""
PAIRS = """ch AS (SELECT archive_id AS sender, peer AS receiver, tag, ts_ns AS send_ts, event_id AS send_id, msg_length,
    row_number() OVER (PARTITION BY archive_id, peer, tag ORDER BY ts_ns, event_id) AS rn FROM t WHERE record IN (4, 5)),
rc AS (SELECT peer AS sender, archive_id AS receiver, tag, ts_ns AS recv_ts, event_id AS recv_id,
    row_number() OVER (PARTITION BY peer, archive_id, tag ORDER BY ts_ns, event_id) AS rn FROM t WHERE record IN (8, 9)),
m AS (SELECT ch.*, rc.recv_ts, rc.recv_id FROM ch JOIN rc ON ch.sender = rc.sender AND ch.receiver = rc.receiver AND ch.tag = rc.tag AND ch.rn = rc.rn)"""
WAIT = "w AS (SELECT event_id, archive_id, ts_ns, min(CASE WHEN record = 58 THEN ts_ns END) OVER (PARTITION BY archive_id ORDER BY ts_ns, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS wait_end_ns FROM t)"
CLIP = "CAST(sum(CASE WHEN start_ns >= {a} AND finish_ns <= {b} THEN exclusive_ns ELSE CAST((CAST(exclusive_ns AS HUGEINT) * (least(finish_ns, {b}) - greatest(start_ns, {a}))) // duration_ns AS BIGINT) END) AS BIGINT) AS ns"
IDX = "row_number() OVER (PARTITION BY thread_id, name ORDER BY start_ns, finish_ns, event_id) - 1 AS idx"
EDGES_SQL = "edges AS (SELECT DISTINCT 'U' || (thread_id % 20) AS parent, token AS child FROM tok UNION SELECT 'G' || (thread_id % 5), 'U' || (thread_id % 20) FROM tok UNION SELECT 'R', 'G' || (thread_id % 5) FROM tok)"
TIMES_SQL = """edges AS (SELECT parent, child, CAST(sum(n) AS BIGINT) AS times FROM (
  SELECT 'U' || (thread_id % 20) AS parent, token AS child, 1 AS n FROM tok
  UNION ALL SELECT DISTINCT 'G' || (thread_id % 5), 'U' || (thread_id % 20), 2 FROM tok UNION ALL SELECT DISTINCT 'R', 'G' || (thread_id % 5), 3 FROM tok) GROUP BY 1, 2)"""


def q(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


_COLS = "SELECT event_id, archive_id, thread_id, ts_ns, record FROM t"
_STATS = """SELECT thread_id, name, CAST(min(duration_ns) AS BIGINT) AS min_ns, CAST(sum(duration_ns) // count(*) AS BIGINT) AS mean_ns, max(duration_ns) AS max_ns,
  count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS total_ns, CAST(sum(exclusive_ns) AS BIGINT) AS total_exclusive_ns FROM s GROUP BY 1, 2"""
_BLOCKS = "SELECT thread_id, CAST(level AS INTEGER) AS depth, name, start_ns, finish_ns FROM s"

ORACLE: dict[str, str] = {
    "agg_comm_matrix": q(T, "SELECT peer AS sender, archive_id AS receiver, CAST(sum(msg_length) AS BIGINT) AS bytes FROM t WHERE record IN (8, 9) GROUP BY 1, 2"),
    "agg_comm_matrix_dense": q(T, "SELECT CAST(a.i AS INTEGER) AS sender, CAST(b.i AS INTEGER) AS receiver, CAST(coalesce(sum(msg_length), 0) AS BIGINT) AS bytes FROM range(8) a(i) CROSS JOIN range(8) b(i) LEFT JOIN t ON record IN (8, 9) AND peer = a.i AND archive_id = b.i GROUP BY 1, 2"),
    "agg_comm_matrix_timed": q(T, f"SELECT CASE WHEN record IN (4, 5) THEN archive_id ELSE peer END AS sender, CASE WHEN record IN (4, 5) THEN peer ELSE archive_id END AS receiver, CAST(sum(msg_length) AS BIGINT) AS bytes FROM t WHERE record IN (4, 5, 8, 9) AND ts_ns BETWEEN {LO} AND {HI} GROUP BY 1, 2"),
    "agg_comm_matrix_timed_recv_only": q(T, f"SELECT peer AS sender, archive_id AS receiver, CAST(sum(msg_length) AS BIGINT) AS bytes FROM t WHERE record IN (8, 9) AND ts_ns BETWEEN {LO} AND {HI} GROUP BY 1, 2"),
    "doc_comm_matrix_isend": q(T, f"SELECT archive_id AS sender, peer AS receiver, CAST(sum(msg_length) AS BIGINT) AS bytes FROM ({DEFN}) WHERE record = 5 GROUP BY 1, 2"),
    "agg_msg_size_hist": q(T, f"SELECT msg_length, count(*) AS n FROM ({DEFN}) GROUP BY 1"),
    "agg_msg_size_hist_amount": q(T, f"SELECT msg_length, CAST(sum(msg_length) AS BIGINT) AS n FROM ({DEFN}) GROUP BY 1"),
    "agg_msg_size_hist_weighted": q(T, "SELECT msg_length, count(*) AS n FROM t WHERE record IN (4, 5, 8, 9) GROUP BY 1"),
    "agg_msg_size_hist_local": q(T, f"SELECT msg_length, count(*) AS n FROM ({DEFN}) WHERE archive_id = 3 GROUP BY 1"),
    "agg_comm_over_time": q(f"{T}, {BINS}", "SELECT b.i, CAST(coalesce(sum(msg_length), 0) AS BIGINT) AS bytes FROM bins b LEFT JOIN t ON record IN (4, 5, 8, 9) AND ts_ns <= hi AND (ts_ns > lo OR (b.i = 0 AND ts_ns = lo)) GROUP BY 1"),
    "agg_comm_over_time_count": q(f"{T}, {BINS}", "SELECT b.i, count(t.event_id) AS messages FROM bins b LEFT JOIN t ON record IN (4, 5, 8, 9) AND ts_ns <= hi AND (ts_ns > lo OR (b.i = 0 AND ts_ns = lo)) GROUP BY 1"),
    "agg_comm_over_time_local": q(f"{T}, {BINS}", "SELECT b.i, CAST(coalesce(sum(msg_length), 0) AS BIGINT) AS bytes FROM bins b LEFT JOIN t ON archive_id = 3 AND record IN (4, 5, 8, 9) AND ts_ns <= hi AND (ts_ns > lo OR (b.i = 0 AND ts_ns = lo)) GROUP BY 1"),
    "join_bins": q(f"{T}, {BINS}", "SELECT t.event_id, b.i FROM t JOIN bins b ON ts_ns <= hi AND (ts_ns > lo OR (b.i = 0 AND ts_ns = lo))"),
    "flt_record": q(T, f"{_COLS} WHERE record = 8"),
    "flt_record_in": q(T, f"{_COLS} WHERE record IN (4, 58)"),
    "flt_mpi_class": q(T, "SELECT event_id, record IN (4, 5) AS is_send, record IN (8, 9) AS is_recv, record IN (4, 5, 8, 9) AS is_comm FROM t"),
    "flt_thread": q(T, f"{_COLS} WHERE thread_id = 7"),
    "flt_archive": q(T, f"{_COLS} WHERE archive_id = 3"),
    "flt_time_range": q(T, f"{_COLS} WHERE ts_ns BETWEEN {LO} AND {HI}"),
    "flt_seek": q(T, f"SELECT thread_id, m.t_ns, CAST(coalesce(max(CASE WHEN ts_ns <= m.t_ns THEN idx END), 0) AS BIGINT) AS idx FROM (SELECT thread_id, ts_ns, row_number() OVER (PARTITION BY thread_id ORDER BY ts_ns, event_id) - 1 AS idx FROM t) CROSS JOIN (SELECT {LO} AS t_ns UNION ALL SELECT {HI}) m GROUP BY 1, 2"),
    "flt_contains": q(f"{K}, {EDGES_SQL}, cl AS (SELECT parent AS ancestor, child AS descendant FROM edges UNION SELECT cl.ancestor, e.child FROM cl JOIN edges e ON cl.descendant = e.parent)", "SELECT ancestor, descendant FROM cl"),
    "src_archive": q(T, f"{_COLS} WHERE archive_id = 5"),
    "src_thread": q(T, f"{_COLS} WHERE thread_id = 11"),
    "src_thread_list": q(T, "SELECT DISTINCT archive_id, thread_id FROM t"),
    "src_archives": q(T, "SELECT archive_id, count(DISTINCT thread_id) AS n_threads FROM t GROUP BY 1"),
    "src_threads": q(T, "SELECT thread_id, count(*) AS n FROM t GROUP BY 1"),
    "src_time_bounds": q(T, "SELECT min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM t"),
    "src_locations": q(LOCS, "SELECT l.id, l.name, g.name AS group_name, l.parent FROM l LEFT JOIN g ON l.parent = g.id"),
    "src_strings": q(DEFS, "SELECT ref, str FROM defs WHERE scope = 'global'"),
    "src_regions": "SELECT p.p_partkey AS region_ref, p.p_name AS name FROM part p",
    "src_metadata": "SELECT 'region ' || r_regionkey AS key, r_name AS value FROM region",
    "src_chunk_load": q(T, "SELECT name, idx // 1000 AS chunk, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(*) AS n FROM (SELECT name, ts_ns, row_number() OVER (PARTITION BY name ORDER BY ts_ns, event_id) - 1 AS idx FROM t) GROUP BY 1, 2"),
    "trv_trace_events": q(T, "SELECT row_number() OVER (ORDER BY ts_ns, archive_id, thread_id, event_id) - 1 AS global_pos, thread_id, ts_ns, event_id FROM t"),
    "trv_thread_events": q(T, "SELECT thread_id, event_id, ts_ns, row_number() OVER (PARTITION BY thread_id ORDER BY ts_ns, event_id) - 1 AS pos, row_number() OVER (PARTITION BY thread_id, name ORDER BY ts_ns, event_id) - 1 AS occurrence_idx FROM t"),
    "trv_callstack": q(S, f"SELECT thread_id, m.t_ns, CAST(level AS INTEGER) AS depth, name FROM s JOIN (SELECT {LO} AS t_ns UNION ALL SELECT {HI}) m ON start_ns <= m.t_ns AND m.t_ns < finish_ns"),
    "trv_sequence_content": q(K, f"SELECT thread_id, ts_ns // {DAY_NS} AS block, row_number() OVER (PARTITION BY thread_id, ts_ns // {DAY_NS} ORDER BY pos) - 1 AS i, token FROM tok"),
    "trv_occurrence": q(S, f"SELECT thread_id, name, start_ns, duration_ns FROM (SELECT *, {IDX} FROM s) WHERE idx = 2"),
    "trv_loop_duration": q(K, "SELECT thread_id, token, min(pos) AS start_pos, max(ts_ns) - min(ts_ns) AS duration_ns FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos) - row_number() OVER (PARTITION BY thread_id, token ORDER BY pos) AS island FROM tok) GROUP BY thread_id, token, island HAVING count(*) >= 2"),
    "trv_token_counts": q(f"{K}, {TIMES_SQL}, x AS (SELECT parent AS root, child AS token, times AS n, 1 AS d FROM edges UNION ALL SELECT x.root, e.child, x.n * e.times, d + 1 FROM x JOIN edges e ON x.token = e.parent)", "SELECT root, token, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1, 2"),
    "trv_event_count": q(T, "SELECT thread_id, count(*) AS n FROM t GROUP BY 1"),
    "trv_call_tree_depth": q(EL, "SELECT thread_id, seq_no, CAST(level AS INTEGER) AS depth FROM el WHERE phase = 'E'"),
    "join_enter_leave": q(S, _BLOCKS),
    "gram_durations": q(S, "SELECT thread_id, CAST(level AS INTEGER) AS depth, name, start_ns, duration_ns, exclusive_ns FROM s"),
    "agg_check_durations": q(S, "SELECT count(*) AS n, CAST(0 AS BIGINT) AS violations FROM s"),
    "agg_sequence_stats": q(S, f"SELECT thread_id, name, min_ns, mean_ns, max_ns, n FROM ({_STATS})"),
    "agg_contention": q(S, f"SELECT x.thread_id, name, n, CASE WHEN n * (mean_ns - min_ns) > d THEN CAST(-1 AS DOUBLE) WHEN d = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(n * (mean_ns - min_ns) AS DOUBLE) / d, 6) END AS contention FROM ({_STATS}) x JOIN (SELECT thread_id, max(finish_ns) - min(start_ns) AS d FROM s GROUP BY 1) w ON x.thread_id = w.thread_id"),
    "agg_archive_summary": q(T, "SELECT archive_id, count(DISTINCT thread_id) AS n_threads, count(*) AS n_events FROM t GROUP BY 1"),
    "agg_event_info": q(T, "SELECT thread_id, record, name, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM t GROUP BY 1, 2, 3"),
    "agg_seq_durations": q(S, f"SELECT thread_id, name, idx, duration_ns FROM (SELECT *, {IDX} FROM s) WHERE level = 1"),
    "agg_seq_timestamps": q(S, f"SELECT thread_id, name, idx, start_ns FROM (SELECT *, {IDX} FROM s) WHERE level = 1"),
    "agg_seq_content": q(K, f"SELECT thread_id, ts_ns // {DAY_NS} AS block, list(token ORDER BY pos) AS tokens FROM tok GROUP BY 1, 2"),
    "doc_function_table": q(S, "SELECT name, min(duration_ns) AS min_ns, CAST(sum(duration_ns) // count(*) AS BIGINT) AS mean_ns, max(duration_ns) AS max_ns, count(*) AS n FROM s GROUP BY 1"),
    "doc_duration_hist": q(S, "SELECT name, CAST(least(duration_ns // 600000000000, 20) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1, 2"),
    "agg_snapshot": q(S, f"SELECT thread_id, name, {CLIP.format(a=LO, b=HI)} FROM s WHERE level > 0 AND finish_ns > {LO} AND start_ns < {HI} GROUP BY 1, 2"),
    "agg_snapshot_by_name": q(S, f"SELECT name, {CLIP.format(a=LO, b=HI)} FROM s WHERE level > 0 AND finish_ns > {LO} AND start_ns < {HI} GROUP BY 1"),
    "agg_interval_profile": q(S, f"SELECT CAST(i AS INTEGER) AS slice, thread_id, name, {CLIP.format(a='a', b='b')} FROM s JOIN (SELECT i, {LO} + i * {DAY_NS} AS a, {LO} + (i + 1) * {DAY_NS} AS b FROM range(10) r(i)) x ON finish_ns > a AND start_ns < b WHERE level > 0 GROUP BY 1, 2, 3"),
    "join_interval_clip": q(S, f"SELECT thread_id, name, start_ns, least(finish_ns, {HI}) - greatest(start_ns, {LO}) AS clip_ns FROM s WHERE finish_ns > {LO} AND start_ns < {HI}"),
    "agg_snapshot_exact": q(EL, f"""SELECT thread_id, name, CAST(sum(least(b, {HI}) - greatest(a, {LO})) AS BIGINT) AS ns FROM (
  SELECT e.thread_id, e.ts_ns AS a, e.b, CASE WHEN e.phase = 'E' THEN e.name WHEN e.level = 2 THEN 'day' END AS name
  FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY thread_id ORDER BY seq_no) AS b FROM el) e
  WHERE (e.phase = 'E' AND e.level > 0) OR (e.phase = 'L' AND e.level = 2)) WHERE b > {LO} AND a < {HI} GROUP BY 1, 2"""),
    "agg_duration_vectors": q(S, "SELECT name, count(*) AS n, min(duration_ns) AS min_ns, max(duration_ns) AS max_ns, CAST(sum(duration_ns) // count(*) AS BIGINT) AS mean_ns FROM s GROUP BY 1"),
    "agg_range_sum": q(S, f"SELECT thread_id, name, CAST(sum(duration_ns) AS BIGINT) AS ns, count(*) AS n FROM (SELECT *, {IDX} FROM s) WHERE idx >= 2 AND idx < 7 GROUP BY 1, 2"),
    "quantize_durations": q(S, f"""SELECT thread_id, name, idx, duration_ns, code, CASE WHEN width = 0 THEN lo ELSE lo + CAST((CAST(code AS HUGEINT) * width) // 255 AS BIGINT) END AS quantised_ns FROM (
  SELECT *, CASE WHEN width = 0 THEN 0 ELSE CAST((CAST(duration_ns - lo AS HUGEINT) * 255) // width AS BIGINT) END AS code FROM (
    SELECT thread_id, name, idx, duration_ns, min(duration_ns) OVER c AS lo, max(duration_ns) OVER c - min(duration_ns) OVER c AS width FROM (SELECT *, {IDX} FROM s) WINDOW c AS (PARTITION BY thread_id, name, idx // 1000)))"""),
    "sink_csv": q(EL, """SELECT thread_id AS "Thread", name AS "Function", a AS "Start", b AS "Finish", b - a AS "Duration" FROM (
  SELECT e.thread_id, e.ts_ns AS a, e.b, CASE WHEN e.phase = 'E' THEN e.name WHEN e.level = 2 THEN 'day' ELSE 'main' END AS name, e.phase, e.level
  FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY thread_id ORDER BY seq_no) AS b FROM el) e) WHERE b > a"""),
    "sink_csv_bulk": q(S, 'SELECT thread_id AS "Thread", name AS "Function", start_ns AS "Start", finish_ns AS "Finish", duration_ns AS "Duration" FROM s WHERE level > 0'),
    "sink_recompress": q(T, "SELECT record, count(*) AS n, CAST(sum(ts_ns % 1000003) AS BIGINT) AS check_sum FROM t GROUP BY 1"),
    "proj_event_props": q(T, "SELECT thread_id, name, record, count(*) AS nb_occurrences FROM t GROUP BY 1, 2, 3"),
    "proj_region_name": q(f"{T}, {DEFS}", "SELECT event_id, coalesce(d.str, 'INVALID_REGION') AS region FROM t LEFT JOIN (SELECT * FROM defs WHERE scope = 'global') d ON d.ref = t.event_id % 3000"),
    "proj_attributes": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events",
    "proj_thread_props": q(T, "SELECT thread_id, min(ts_ns) AS first_ns, max(ts_ns) AS finish_ns FROM t GROUP BY 1"),
    "proj_ns2s": q(T, "SELECT event_id, CAST(ts_ns AS DOUBLE) / 1e9 AS seconds FROM t"),
    "join_send_recv": q(f"{T}, {PAIRS}", "SELECT sender, receiver, tag, send_ts, recv_ts FROM m"),
    "join_dictionary": q(f"{T}, {DEFS}", "SELECT event_id, coalesce(lo.str, gl.str) AS str FROM t LEFT JOIN (SELECT * FROM defs WHERE scope = 'local') lo ON lo.ref = t.event_id % 3000 LEFT JOIN (SELECT * FROM defs WHERE scope = 'global') gl ON gl.ref = t.event_id % 3000"),
    "join_location_parent": q(f"{LOCS}, p AS (SELECT id, 0 AS depth, name AS path FROM g WHERE parent IS NULL UNION ALL SELECT x.id, depth + 1, path || '/' || x.name FROM (SELECT * FROM g UNION ALL SELECT id + 10000, name, parent FROM l) x JOIN p ON x.parent = p.id)", "SELECT id, CAST(depth AS INTEGER) AS depth, path FROM p"),
    "join_string_unify": q(DEFS, "SELECT scope, ref, dense_rank() OVER (ORDER BY str) - 1 AS new_ref, str FROM defs"),
    "gram_event_dict": q(K, "SELECT thread_id, token, row_number() OVER (PARTITION BY thread_id ORDER BY p) - 1 AS id, n FROM (SELECT thread_id, token, min(pos) AS p, count(*) AS n FROM tok GROUP BY 1, 2)"),
    "gram_runs": q(K, "SELECT thread_id, token, min(pos) AS start_pos, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos) - row_number() OVER (PARTITION BY thread_id, token ORDER BY pos) AS island FROM tok) GROUP BY thread_id, token, island"),
    "src_config": "SELECT * FROM (VALUES ('compression', 'zstd'), ('encoding', 'none'), ('loopFinding', 'truncated'), ('maxLoopLength', '50'), ('timestampStorage', 'delta'), ('zstdCompressionLevel', '3')) v(key, value)",
    "set_bag_arithmetic": q(K, "SELECT token, CAST(sum(CASE WHEN thread_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS n FROM tok GROUP BY 1 HAVING sum(CASE WHEN thread_id % 2 = 0 THEN 1 ELSE -1 END) <> 0"),
}
