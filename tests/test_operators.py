"""Hand-made traces."""

import random

import pytest
from pyspark.sql import functions as F

from tracelark.functions.murmur import murmur3_words
from tracelark.operators import comm, grammar, order, spans, traverse
from tracelark.sources.store import Trace, read_config


def stream(spark, tokens, thread=1):
    return spark.createDataFrame([(thread, i + 1, t) for i, t in enumerate(tokens)], "thread_id long, pos long, token string")


def test_loop_detection_of_three_hundred_and_three_blocks(spark):
    block = [f"e{k}" for k in range(50)]
    g = grammar.Inducer(100)
    for t in block * 3 + ["m"] + block * 100 + ["m"] + block * 3:
        g.push(t)
    assert [x if x[0] == "E" else (x[0], x[2]) for x in g.items] == [("L", 3), ("E", "m"), ("L", 100), ("E", "m"), ("L", 3)]
    assert g.items[0] == g.items[4] and g.items[0][1] == g.items[2][1]
    assert g.expand() == block * 3 + ["m"] + block * 100 + ["m"] + block * 3


def test_nested_pattern():
    want = (["f0"] + ["f1", "f2"] * 3) * 4
    g = grammar.Inducer()
    for t in want:
        g.push(t)
    assert g.expand() == want
    assert g.text() == "(f0 (f1 f2)x3)x4"


def test_induction_keeps_any_stream():
    r = random.Random(4)
    for _ in range(200):
        want = [r.choice("abc") for _ in range(r.randrange(60))]
        g = grammar.Inducer(r.choice([1, 2, 5, 100]))
        for t in want:
            g.push(t)
        assert g.expand() == want


def test_induction_of_threads(spark):
    both = stream(spark, "ababab", 1).unionByName(stream(spark, "xyz", 2))
    got = {r["thread_id"]: r for r in grammar.induce(both).collect()}
    assert got[1]["grammar"] == "(a b)x3" and got[2]["grammar"] == "x y z"


def test_runs_and_loops(spark):
    t = stream(spark, "aabaac")
    assert sorted((r["token"], r["start_pos"], r["n"]) for r in grammar.runs(t).collect()) == [("a", 1, 2), ("a", 4, 2), ("b", 3, 1), ("c", 6, 1)]
    assert [(r["body"], r["nb_iterations"], r["nb_occurrences"]) for r in grammar.loops(t).collect()] == [(["a"], 2, 2)]
    t = stream(spark, "xababababcabcz")
    assert sorted((r["body"], r["start_pos"], r["nb_iterations"]) for r in grammar.stretches(t, 4).collect()) == [(["a", "b"], 2, 4), (["a", "b", "c"], 8, 2)]


def test_repeats_and_known_sequences_same_as_search(spark):
    r = random.Random(8)
    rows = [(k, i + 1, r.choice("ab" if k % 2 else "abc")) for k in range(6) for i in range(60)]
    t = spark.createDataFrame(rows, "thread_id long, pos long, token string")
    known = [["a", "b"], ["b", "c", "a"], ["c", "c", "c", "c"]]
    got = {(x["thread_id"], x["pos"]): x["size"] for x in grammar.repeats(t, 7).collect()}
    found = {(x["thread_id"], x["pos"]): x["size"] for x in grammar.known_sequences(t, spark.createDataFrame([(k,) for k in known], "tokens array<string>"), 5).collect()}
    want, ends = {}, {}
    for k in range(6):
        x = [c for a, _, c in rows if a == k]
        for e in range(1, 61):
            size = next((n for n in range(1, 8) if 2 * n <= e and x[e - n : e] == x[e - 2 * n : e - n]), None)
            if size:
                want[k, e] = size
            size = next((n for n in range(2, 6) if n <= e and x[e - n : e] in known), None)
            if size:
                ends[k, e] = size
    assert got == want and found == ends


def test_block_grammar_of_nested_loops():
    """Twenty blocks of each size in four outer rounds; a trace that ends inside a block; the three ways to look for loops."""
    trace = [("main", "E")]
    for _ in range(4):
        trace += [("outer", "E")]
        for k in range(1, 11):
            for _ in range(5):
                trace += [(f"s{k}", "E"), *[(f"e{k}.{i}", None) for i in range(k)], (f"x{k}", "L")]
        trace += [("outer end", "L")]
    trace += [("main end", "L")]
    for name, longest in grammar.ALGORITHMS.items():
        g = grammar.BlockInducer(longest)
        for token, phase in trace:
            g.push(token, phase)
        g.end()
        assert g.expand() == [t for t, _ in trace]
        assert sorted(g.count) == [1, 4, *[20] * 10]
        loops = {len(body): body for body in g.bodies}
        assert (not g.bodies) if name == "None" else set(loops) == {1} and len(g.bodies) == 11
    r = random.Random(2)
    for _ in range(100):
        g, want, depth = grammar.BlockInducer(r.choice((0, 1, 3, None))), [], 0
        for _ in range(r.randrange(80)):
            phase = r.choice(("E", None, "L" if depth else None))
            depth += {"E": 1, "L": -1}.get(phase, 0)
            token = f"{phase}{r.randrange(2)}"
            g.push(token, phase)
            want.append(token)
        g.end()
        assert g.expand() == want


def blocks(spark, rows):
    return spark.createDataFrame([(1, i + 1, ts, p, n) for i, (ts, p, n) in enumerate(rows)], "thread_id long, seq_no long, ts_ns long, phase string, name string")


NESTED = [(0, "E", "f"), (10, "E", "g"), (20, "E", "h"), (25, "L", "h"), (30, "L", "g"), (40, "E", "g"), (45, "L", "g"), (60, "L", "f")]


def test_pairs_depths_and_exclusive_times(spark):
    b = spans.with_exclusive(blocks(spark, NESTED))
    got = sorted((r["enter_seq"], r["name"], r["depth"], r["duration_ns"], r["exclusive_ns"], r["parent_seq"], r["parent_ns"], r["leave_seq"]) for r in b.collect())
    assert got == [(1, "f", 0, 60, 0, None, None, 8), (2, "g", 1, 20, 15, 1, 0, 5), (3, "h", 2, 5, 5, 2, 10, 4), (6, "g", 1, 5, 5, 1, 0, 7)]
    assert spans.nesting_violations(spans.pair_blocks(blocks(spark, NESTED))).count() == 0


def test_violations_are_reported(spark):
    bad = [(0, "E", "f"), (5, "E", "g"), (9, "L", "x")]
    assert spans.nesting_violations(spans.pair_blocks(blocks(spark, bad))).count() == 2
    stray = [(0, "L", "x"), (5, "E", "g"), (9, "L", "g"), (12, "L", "y")]
    assert sorted(r["leave_name"] for r in spans.nesting_violations(spans.pair_blocks(blocks(spark, stray))).collect()) == ["x", "y"]
    got = [(r["name"], r["finish_ns"], r["cut"]) for r in spans.closed_at_end(blocks(spark, bad[:2] + [(9, "L", "g")])).collect()]
    assert sorted(got) == [("f", 9, True), ("g", 9, False)]


def recursive(spark, deep, threads=2):
    """Threads that call f within f, `deep` times, and g beside it."""
    rows = []
    for thread in range(threads):
        x = [(k, "E", "f") for k in range(deep)] + [(deep + k, "L", "f") for k in range(deep - 1)] + [(2 * deep, "E", "g"), (2 * deep + 5, "L", "g"), (2 * deep + 6, "L", "f")]
        rows += [(thread, i + 1, ts * 10, p, n) for i, (ts, p, n) in enumerate(x)]
    return spark.createDataFrame(rows, "thread_id long, seq_no long, ts_ns long, phase string, name string")


def test_stacks_of_any_depth(spark):
    e = recursive(spark, 40)
    got = {r["stack"]: r["self_ns"] for r in spans.folded_stacks(e).collect()}
    want: dict = {}
    stack, before = [], None
    for r in e.where("thread_id = 0").orderBy("seq_no").collect():
        if stack and before is not None:
            want[";".join(stack)] = want.get(";".join(stack), 0) + 2 * (r["ts_ns"] - before)
        stack = [*stack, r["name"]] if r["phase"] == "E" else stack[:-1]
        before = r["ts_ns"]
    assert got == want and max(len(k.split(";")) for k in got) == 40
    at = spans.callstack(e, [395, 10, 805, -1, 10**9]).collect()
    assert sorted((r["thread_id"], r["t_ns"], r["depth"], r["name"]) for r in at) == sorted(
        (t, *x) for t in (0, 1) for x in [*((395, k, "f") for k in range(40)), (10, 0, "f"), (10, 1, "f"), (805, 0, "f"), (805, 1, "g")]
    )
    with pytest.raises(ValueError):
        spans.folded_stacks(recursive(spark, spans.MAX_DEPTH + 1, 1))


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_spans_read_their_events_few_times(spark):
    from compare import DATA
    from tracelark.sources import fixtures as fx

    e = fx.trace_enter_leave(spark, f"{DATA}/sf0.001")
    for df in (spans.pair_blocks(e), spans.with_exclusive(e), spans.self_segments(e), spans.snapshot_exact(e, 0, 10**18)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert scans(df) == 1 and plan.count("Exchange") <= 2 and "Join" not in plan


def test_stored_traces_are_pruned(spark, tmp_path):
    from compare import DATA
    from tracelark.sources import fixtures as fx

    t = Trace.store(fx.trace_events(spark, f"{DATA}/sf0.001"), str(tmp_path / "t"), definitions=fx.all_definitions(spark, f"{DATA}/sf0.001"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(archive_id" in plan(t.archive(3)) and "EqualTo(thread_id" in plan(t.thread(7))
    assert "GreaterThanOrEqual(ts_ns" in plan(t.between(5, 9)) and "LessThanOrEqual(ts_ns" in plan(t.between(5, 9))
    assert Trace.open(spark, str(tmp_path / "t")).table("groups").count() == 5
    with pytest.raises(KeyError):
        t.table("spans")
    with pytest.raises(ValueError):
        Trace.store(t.events, str(tmp_path / "u"), definitions={"nonsense": t.events})


def test_scratch_refuses_folders_that_executors_do_not_share():
    from tracelark.scratch import is_local

    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[3,2,1000]") and not is_local("spark://host:7077")


def test_masked_numbers_are_read_again(spark):
    from tracelark.functions import text as tx

    rows = [(v, w) for w, top in ((1, 8), (2, 16), (4, 32), (8, 63)) for v in (0, 1, 7, (1 << top) - 1, 1 << top - 1)]
    df = spark.createDataFrame(rows, "v long, w int").withColumn("raw", tx.masked(F.col("v"), F.col("w")))
    got = df.select("v", "w", "raw", tx.unmasked(F.col("raw")).alias("back")).collect()
    assert all(r["back"] == r["v"] and bytes(r["raw"]) == r["v"].to_bytes(r["w"], "little") for r in got)


def test_mean_of_durations_whose_sum_passes_64_bits(spark):
    long = spark.range(3000).selectExpr("id as thread_id", "'main' as name", "cast(5000000000000000 + id as bigint) as duration_ns")
    assert [tuple(r) for r in spans.name_stats(long).collect()] == [("main", 3000, 5000000000000000, 5000000000002999, 5000000000001499)]


def test_levels_of_any_depth_and_cycles(spark):
    chain = spark.createDataFrame([(k, f"n{k}", k - 1 if k else None) for k in range(22)] + [(90, "orphan", 77)], "id long, name string, parent long")
    got = {r["id"]: r["depth"] for r in traverse.parents(chain).collect()}
    assert got == {**{k: k for k in range(22)}, 90: 0}
    steps = spark.createDataFrame([(f"s{k}", f"s{k + 1}", 2) for k in range(20)], "parent string, child string, times long")
    assert {r["token"]: r["n"] for r in traverse.token_counts(steps).where("root = 's0'").collect()} == {f"s{k}": 2**k for k in range(1, 21)}
    with pytest.raises(ValueError):
        traverse.token_counts(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "parent string, child string, times long"))


def test_seek_same_as_search(spark):
    e = spark.createDataFrame([(t, 10 * k + t, k) for t in (0, 1) for k in range(9)], "thread_id long, ts_ns long, event_id long")
    got = {(r["thread_id"], r["t_ns"]): r["idx"] for r in traverse.seek(e, [-5, 0, 1, 44, 50, 999]).collect()}
    assert got == {(t, m): max([k for k in range(9) if 10 * k + t <= m], default=0) for t in (0, 1) for m in (-5, 0, 1, 44, 50, 999)}


def test_self_time_fills_the_root(spark):
    s = spans.self_segments(blocks(spark, NESTED)).groupBy("name").agg(F.sum(F.col("b") - F.col("a")).alias("ns"))
    assert {r["name"]: r["ns"] for r in s.collect()} == {"f": 35, "g": 20, "h": 5}


def messages(spark, rows):
    cols = "event_id long, archive_id int, thread_id long, ts_ns long, record int, peer int, communicator int, tag int, msg_length long, request_id long"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], cols)


def test_messages_in_order_whichever_side_comes_first(spark):
    e = messages(
        spark,
        [
            (0, 0, 10, 4, 1, 0, 7, 100, None), (0, 0, 20, 4, 1, 0, 7, 200, None), (1, 1, 5, 8, 0, 0, 7, 100, None), (1, 1, 30, 9, 0, 0, 7, 200, 3),
            (0, 0, 40, 4, 1, 0, 9, 300, None),
        ],
    )
    got = sorted((r["send_ts"], r["recv_ts"], r["msg_length"]) for r in comm.match_messages(e).collect())
    assert got == [(10, 5, 100), (20, 30, 200)]


def test_a_tie_belongs_to_the_earlier_interval(spark):
    e = messages(spark, [(0, 0, ts, 4, 1, 0, 0, 1, None) for ts in (0, 10, 11, 20, 30)])
    assert [(r["i"], r["messages"]) for r in comm.traffic(e, [0, 10, 20, 30], messages=True).orderBy("i").collect()] == [(0, 2), (1, 2), (2, 1)]


def test_wait_ends_at_the_next_leave(spark):
    e = messages(spark, [(0, 0, 1, 4, 1, 0, 0, 1, None), (0, 0, 5, 58, None, 0, 0, 0, None), (0, 0, 6, 4, 1, 0, 0, 1, None), (1, 1, 7, 58, None, 0, 0, 0, None)])
    got = {r["event_id"]: r["wait_end_ns"] for r in comm.next_wait(e, F.col("record") == 58).collect()}
    assert got == {0: 5, 1: None, 2: None, 3: None}


def test_next_value_across_parts(spark):
    r = random.Random(3)
    rows = [(g, i, r.choice((None, None, None, i))) for g in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, i long, v long").repartition(9)
    got = {(x["g"], x["i"]): x["n"] for x in order.next_value(df, ["g"], ["i"], F.col("v"), "n").collect()}
    later: dict = {}
    for g, i, v in reversed(rows):
        assert got[g, i] == later.get(g)
        later[g] = i if v is not None else later.get(g)


def program(spark, rows):
    """(archive, thread, ts, record, region, peer, tag, length, request) as events; numbered by time."""
    rows = sorted(rows, key=lambda x: x[2])
    seq: dict = {}
    out = []
    for i, (a, t, ts, rec, region, peer, tag, length, req) in enumerate(rows):
        seq[t] = seq.get(t, 0) + 1
        out.append((i, a, t, seq[t], ts, rec, region, None, peer, 0, tag, length, req))
    return spark.createDataFrame(out, "event_id long, archive_id int, thread_id long, seq_no long, ts_ns long, record int, region string, name string, peer int, communicator int, tag int, msg_length long, request_id long")


def test_message_list_of_a_small_program(spark):
    """Blocking and non-blocking pairs, a receive before its send, order in a channel, a send without completion, a receive without request."""
    n = None
    rows = [
        (0, 0, 10, 2, "MPI_Send", n, n, n, n), (0, 0, 12, 4, n, 1, 7, 100, n), (0, 0, 15, 3, "MPI_Send", n, n, n, n),
        (1, 1, 5, 2, "MPI_Recv", n, n, n, n), (1, 1, 6, 8, n, 0, 7, 111, n), (1, 1, 30, 3, "MPI_Recv", n, n, n, n),  # before its send: its length counts
        (0, 0, 40, 2, "MPI_Isend", n, n, n, n), (0, 0, 41, 5, n, 1, 7, 200, 9), (0, 0, 42, 3, "MPI_Isend", n, n, n, n),
        (0, 0, 50, 2, "MPI_Waitall", n, n, n, n), (0, 0, 55, 6, n, n, n, n, 9), (0, 0, 57, 3, "MPI_Waitall", n, n, n, n),
        (1, 1, 43, 2, "MPI_Irecv", n, n, n, n), (1, 1, 44, 7, n, n, n, n, 3), (1, 1, 45, 3, "MPI_Irecv", n, n, n, n),
        (1, 1, 60, 2, "MPI_Wait", n, n, n, n), (1, 1, 65, 9, n, 0, 7, 200, 3), (1, 1, 66, 3, "MPI_Wait", n, n, n, n),
        (0, 0, 70, 5, n, 1, 8, 300, 4),  # never completes
        (1, 1, 71, 2, "MPI_Recv", n, n, n, n), (1, 1, 72, 8, n, 0, 8, 300, n), (1, 1, 73, 3, "MPI_Recv", n, n, n, n),
        (1, 1, 75, 9, n, 0, 6, 10, 77),  # no request: no message
        (0, 0, 76, 4, n, 1, 6, 10, n), (0, 2, 80, 3, "mpi_wait_", n, n, n, n),  # another thread of the process ends its wait
        (1, 1, 81, 8, n, 0, 6, 10, n),  # no wait ends after it
    ]
    got = [tuple(r) for r in comm.message_list(program(spark, rows)).orderBy("id").collect()]
    assert got == [(1, 0, 1, 7, 111, 12, 12, 15, 6, 6, 30), (2, 0, 1, 7, 200, 41, 50, 55, 65, 60, 65)]


def test_requests_belong_to_the_oldest_that_is_outstanding(spark):
    r = random.Random(5)
    rows = [(0, 0, i, r.choice((5, 6)), None, 1, 0, 1, r.randrange(3)) for i in range(200)]
    e = program(spark, rows)
    got = sorted((x["request_id"], x["issue_ts"], x["completion_ts"]) for x in comm.match_requests(e.where("record = 5"), e.where("record = 6")).collect())
    waiting: dict = {}
    want = []
    for _, _, ts, rec, _, _, _, _, req in rows:
        if rec == 5:
            waiting.setdefault(req, []).append(ts)
        elif waiting.get(req):
            want.append((req, waiting[req].pop(0), ts))
    assert got == sorted(want)


def test_positions_are_the_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), i) for i in range(2000)]
    got = order.with_position(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"]).collect()
    assert [(x["a"], x["b"]) for x in sorted(got, key=lambda x: x["global_pos"])] == sorted(rows)
    assert sorted(x["global_pos"] for x in got) == list(range(2000))


def test_closure_and_counts(spark):
    e = spark.createDataFrame([("r", "s", 2), ("s", "t", 3), ("r", "t", 1), ("t", "e", 5)], "parent string, child string, times long")
    assert sorted(map(tuple, traverse.closure(e).collect())) == [("r", "e"), ("r", "s"), ("r", "t"), ("s", "e"), ("s", "t"), ("t", "e")]
    got = {(x["root"], x["token"]): x["n"] for x in traverse.token_counts(e).collect()}
    assert got["r", "t"] == 7 and got["r", "e"] == 35 and got["s", "e"] == 15


def test_alignment_by_content(spark):
    leaves = spark.createDataFrame([(1, "a1", "x"), (1, "a2", "y"), (2, "b9", "x"), (2, "b7", "y")], "thread_id long, id string, content string")
    edges = spark.createDataFrame(
        [(1, "s", 0, "a1"), (1, "s", 1, "a2"), (2, "q", 0, "b9"), (2, "q", 1, "b7"), (1, "top", 0, "s"), (2, "up", 0, "q"), (2, "up", 1, "b9")],
        "thread_id long, parent string, pos int, child string",
    )
    got = {(r["thread_id"], r["id"]): r["shared"] for r in grammar.align(leaves, edges).collect()}
    with pytest.raises(ValueError):
        grammar.align(leaves, edges.unionByName(spark.createDataFrame([(1, "z", 0, "z")], edges.schema)))
    assert got[1, "s"] == got[2, "q"] and got[1, "a1"] == got[2, "b9"] and got[1, "top"] != got[2, "up"]


def test_local_definitions_win(spark):
    d = spark.createDataFrame([("global", 1, "a"), ("local", 1, "b"), ("global", 2, "c")], "scope string, ref long, str string")
    e = spark.createDataFrame([(1,), (2,), (3,)], "ref long")
    assert {r["ref"]: r["str"] for r in traverse.resolve(e, d).collect()} == {1: "b", 2: "c", 3: None}


@pytest.mark.parametrize("codec", ["none", "zstd", "gzip"])
def test_a_trace_survives_the_store(spark, tmp_path, codec):
    e = messages(spark, [(k % 3, k % 5, k, 4, 1, 0, 0, k, None) for k in range(100)])
    t = Trace.store(e, str(tmp_path / "t"), codec, {"host": "here"}).recompress("gzip")
    assert sorted(r["event_id"] for r in t.events.collect()) == list(range(100)) and t.metadata == {"host": "here"}
    assert t.archive(1).count() == 33 and t.thread(0).count() == 20


def test_config():
    assert read_config("maxLoopLength = 7 # c\n", {"TRACELARK_COMPRESSION": "zstd"})["maxLoopLength"] == "7"
    assert read_config("", {"TRACELARK_COMPRESSION": "zstd"})["compression"] == "zstd"
    with pytest.raises(ValueError):
        read_config("nothing = 1")


def test_murmur_known_values(spark):
    def plain(words, h=17):
        m = 0xFFFFFFFF
        for k in words:
            k = k * 0xCC9E2D51 & m
            k = (k << 15 | k >> 17) & m
            h ^= k * 0x1B873593 & m
            h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
        h ^= 4 * len(words)
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        return h ^ h >> 16

    rows = [([],), ([1],), ([2**32 - 1, 7, 123456789],)]
    got = spark.createDataFrame(rows, "w array<long>").select("w", murmur3_words(F.col("w")).alias("h")).collect()
    assert [r["h"] for r in got] == [plain(r["w"]) for r in got]


def test_calls_become_events(spark):
    from tracelark.functions.text import event_text
    from tracelark.sources.ingest import events_from_calls

    rows = [
        (0, 1, 5, 1, "OmpFork", 4, None, None, None), (0, 1, None, 2, "OmpAcquireLock", None, 7, 1, None), (0, 1, 9, 3, "OmpTaskCreate", None, None, None, 3),
        (0, 1, 9, 4, "Unknown", None, None, None, None), (0, 1, 10, 5, "ThreadJoin", None, None, None, None),
    ]
    calls = spark.createDataFrame(rows, "archive_id int, thread_id long, ts_ns long, call_no long, call string, n_threads int, lock_id long, acquisition_order long, task_id long")
    got = events_from_calls(calls).orderBy("seq_no").select("seq_no", "ts_ns", "record", event_text(full=True).alias("text")).collect()
    assert [tuple(r) for r in got] == [(1, 5, 14, "OMP_FORK(nThreads=4)"), (2, 5, 16, "OMP_ACQUIRE_LOCK(lockID=7, order=1)"), (3, 9, 18, "OMP_TASK_CREATE(taskID=3)"), (4, 10, 26, "THREAD_JOIN()")]
