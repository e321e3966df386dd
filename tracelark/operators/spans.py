"""Blocks: pairing, depth, nesting, statistics, time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCKS, record_name

MAX_DEPTH = 256  # blocks open at once; deeper traces are an error, never cut


def opens() -> Column:
    return F.col("phase") == "E"


def closes() -> Column:
    return F.col("phase") == "L"


def with_phase(events: DataFrame) -> DataFrame:
    """events with phase (E opens a block, L closes one, else null) and label: the region, the event's own name, or the (opening) record's."""
    r = F.col("record")
    phase = F.when(r.isin(*BLOCKS), "E").when(r.isin(*BLOCKS.values()), "L")
    opening = r
    for start, end in BLOCKS.items():
        opening = F.when(r == end, F.lit(start)).otherwise(opening)
    label = F.when(r.isin(2, 3), F.col("region")).when(r == 58, F.col("name")).otherwise(record_name(opening))
    return events.withColumns({"phase": phase, "label": label})


def with_depth(events: DataFrame) -> DataFrame:
    """events (phase E, L or null) with the depth at which they stand: that of their block, 0 outermost, or one below the open block."""
    w = Window.partitionBy("thread_id").orderBy("seq_no")
    running = F.sum(F.when(opens(), 1).when(closes(), -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("depth", (running - F.when(opens(), 1).otherwise(0)).cast("int"))


def _ends(enter_leave: DataFrame) -> DataFrame:
    """ENTER and LEAVE events beside the neighbour of their own depth: where a block is closed these alternate, so it is the block's other end.

    All windows here are by thread, or by thread and more: one exchange serves them all.
    """
    w = Window.partitionBy("thread_id", "depth").orderBy("seq_no")
    d = with_depth(enter_leave.where(F.col("phase").isNotNull()))
    return d.withColumns({
        "closed": F.coalesce(F.lead("phase").over(w) == "L", F.lit(False)), "close_seq": F.lead("seq_no").over(w), "close_ns": F.lead("ts_ns").over(w), "close_name": F.lead("name").over(w),
        "closes": F.coalesce(F.lag("phase").over(w) == "E", F.lit(False)), "open_seq": F.lag("seq_no").over(w),
    })


def pair_blocks(enter_leave: DataFrame) -> DataFrame:
    """(thread_id, depth, name, enter_seq, leave_seq, start_ns, finish_ns, leave_name): each ENTER with the next LEAVE of its depth.

    Blocks that never close have no finish; events that never opened have no start. Nothing is joined or grouped.
    """
    p = _ends(enter_leave).where(opens() | ~F.col("closes"))
    shut = lambda c, own: F.when(opens(), F.when(F.col("closed"), F.col(c))).otherwise(F.col(own))
    own = lambda c: F.when(opens(), F.col(c))
    return p.select(
        "thread_id", "depth", own("name").alias("name"), own("seq_no").alias("enter_seq"), shut("close_seq", "seq_no").alias("leave_seq"),
        own("ts_ns").alias("start_ns"), shut("close_ns", "ts_ns").alias("finish_ns"), shut("close_name", "name").alias("leave_name"),
    )


def nesting_violations(blocks: DataFrame) -> DataFrame:
    """Blocks that don't close, close another name, or end before they begin."""
    return blocks.where(F.col("enter_seq").isNull() | F.col("leave_seq").isNull() | (F.col("name") != F.col("leave_name")) | (F.col("finish_ns") < F.col("start_ns")))


def with_exclusive(enter_leave: DataFrame) -> DataFrame:
    """pair_blocks() of opened blocks, with parent_seq and parent_ns (the block around), duration_ns and exclusive_ns.

    Exclusive time is the duration less that of the blocks directly inside; 0 for the outermost. Each event stands once among
    those of its own depth and an ENTER once more among those a level above, where the last opened block is its parent and a
    running sum holds what lies inside each block. The block's rows are then folded; all of it within the thread's partition.
    """
    p = _ends(enter_leave).where(opens() | F.col("closes"))
    p = p.withColumns({"enter_seq": F.when(opens(), F.col("seq_no")).otherwise(F.col("open_seq")), "duration_ns": F.when(opens() & F.col("closed"), F.col("close_ns") - F.col("ts_ns"))})
    own, up = F.struct(F.col("depth").alias("g"), F.lit(False).alias("inner")), F.struct((F.col("depth") - 1).alias("g"), F.lit(True).alias("inner"))
    p = p.withColumn("at", F.explode(F.when(opens(), F.array(own, up)).otherwise(F.array(own)))).withColumns({"g": F.col("at.g"), "inner": F.col("at.inner")})
    w = Window.partitionBy("thread_id", "g").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    mine = opens() & ~F.col("inner")
    p = p.withColumns({
        "parent_seq": F.last(F.when(mine, F.col("seq_no")), ignorenulls=True).over(w), "parent_ns": F.last(F.when(mine, F.col("ts_ns")), ignorenulls=True).over(w),
        "inside": F.coalesce(F.sum(F.when(F.col("inner"), F.col("duration_ns"))).over(w), F.lit(0)),
    })
    of = lambda c: F.max(F.when(mine, F.col(c)))
    b = p.groupBy("thread_id", "enter_seq").agg(
        F.max("depth").alias("depth"), of("name").alias("name"), of("close_seq").alias("__seq"), F.max(F.when(mine, F.col("closed"))).alias("__closed"), of("ts_ns").alias("start_ns"),
        of("close_ns").alias("__ns"), of("close_name").alias("__name"), F.max(F.when(F.col("inner"), F.col("parent_seq"))).alias("parent_seq"),
        F.max(F.when(F.col("inner"), F.col("parent_ns"))).alias("parent_ns"), of("duration_ns").alias("duration_ns"),
        (F.max(F.when(closes(), F.col("inside"))) - of("inside")).alias("__inside"),
    )
    shut = lambda c, name: F.when(F.col("__closed"), F.col(c)).alias(name)
    exclusive = F.when(F.col("depth") == 0, F.when(F.col("__closed"), 0)).otherwise(F.col("duration_ns") - F.col("__inside"))
    return b.select(
        "thread_id", "depth", "name", "enter_seq", shut("__seq", "leave_seq"), "start_ns", shut("__ns", "finish_ns"), shut("__name", "leave_name"),
        "parent_seq", "parent_ns", "duration_ns", exclusive.cast("long").alias("exclusive_ns"),
    )


def with_open(events: DataFrame) -> DataFrame:
    """events with `at`, the depth of the innermost block that is open after each (-1: none), and its open_seq, open_ns and open_name."""
    d = with_depth(events).withColumn("at", F.when(opens(), F.col("depth")).otherwise(F.col("depth") - 1))
    w = Window.partitionBy("thread_id", "at").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.when(F.col("at") >= 0, F.last(F.when(opens(), F.col(c)), ignorenulls=True).over(w))
    return d.withColumns({"open_seq": last("seq_no"), "open_ns": last("ts_ns"), "open_name": last("name")})


def with_stack(events: DataFrame) -> DataFrame:
    """events with `stack`, the (seq, name) of all blocks that are open after each, outermost first.

    The open block of a level is the last one that was opened there: one window with a column a level, no join and no loop.
    """
    d = with_depth(events)
    levels = (d.agg(F.max("depth").alias("d")).first()["d"] or 0) + 1
    if levels > MAX_DEPTH:
        raise ValueError(f"blocks are nested {levels} deep, more than {MAX_DEPTH}")
    w = Window.partitionBy("thread_id").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    each = [F.last(F.when(opens() & (F.col("depth") == k), F.struct(F.col("seq_no").alias("seq"), "name")), ignorenulls=True).over(w) for k in range(levels)]
    n = F.when(opens(), F.col("depth") + 1).otherwise(F.col("depth"))
    return d.withColumn("stack", F.slice(F.array(*each), F.lit(1), F.greatest(n, F.lit(0))))


def closed_at_end(enter_leave: DataFrame) -> DataFrame:
    """pair_blocks() with blocks that are still open closed at the thread's last time (cut is true)."""
    end = F.max("ts_ns").over(Window.partitionBy("thread_id"))
    b = _ends(enter_leave).withColumn("end", end).where(opens())
    return b.select("thread_id", "depth", "name", F.col("ts_ns").alias("start_ns"), F.when(F.col("closed"), F.col("close_ns")).otherwise(F.col("end")).alias("finish_ns"), (~F.col("closed")).alias("cut"))


def sequence_stats(spans: DataFrame) -> DataFrame:
    """By thread and name: least, mean (cut to an integer), most, count, totals."""
    return spans.groupBy("thread_id", "name").agg(
        F.min("duration_ns").alias("min_ns"), F.expr("sum(duration_ns) div count(*)").alias("mean_ns"), F.max("duration_ns").alias("max_ns"), F.count("*").alias("n"),
        F.sum("duration_ns").alias("total_ns"), F.sum("exclusive_ns").alias("total_exclusive_ns"),
    )


def name_stats(spans: DataFrame) -> DataFrame:
    """By name, all threads together: count, least, most, mean (cut to an integer). The sum is wide, since it passes 2^63 ns."""
    mean = F.expr("sum(cast(duration_ns as decimal(28,0))) div count(*)")
    return spans.groupBy("name").agg(F.count("*").alias("n"), F.min("duration_ns").alias("min_ns"), F.max("duration_ns").alias("max_ns"), mean.alias("mean_ns"))


def contention(spans: DataFrame) -> DataFrame:
    """Share of a thread's time that a name's occurrences take beyond their shortest: n * (mean - min) / duration, -1 if above 1."""
    stats = sequence_stats(spans)
    whole = spans.groupBy("thread_id").agg((F.max("finish_ns") - F.min("start_ns")).alias("thread_ns"))
    delta = F.col("n") * (F.col("mean_ns") - F.col("min_ns"))
    score = F.when(delta > F.col("thread_ns"), -1.0).when(F.col("thread_ns") == 0, 0.0).otherwise(F.round(delta / F.col("thread_ns"), 6))
    return stats.join(whole, "thread_id").select("thread_id", "name", "n", score.cast("double").alias("contention"))


def clipped(start: Column, finish: Column, lo: int, hi: int) -> Column:
    return F.least(finish, F.lit(hi)) - F.greatest(start, F.lit(lo))


def snapshot(spans: DataFrame, lo: int, hi: int, keys: tuple[str, ...] = ("thread_id", "name")) -> DataFrame:
    """Exclusive time of blocks below the root inside [lo, hi]: whole blocks exactly, cut ones in proportion (wide integers)."""
    s = spans.where((F.col("level") > 0) & (F.col("finish_ns") > lo) & (F.col("start_ns") < hi)).withColumn("clip", clipped(F.col("start_ns"), F.col("finish_ns"), lo, hi))
    share = F.expr("cast(cast(exclusive_ns as decimal(20,0)) * cast(clip as decimal(18,0)) div duration_ns as bigint)")
    ns = F.when((F.col("start_ns") >= lo) & (F.col("finish_ns") <= hi), F.col("exclusive_ns")).otherwise(share)
    return s.groupBy(*keys).agg(F.sum(ns).cast("long").alias("ns"))


def interval_profile(spans: DataFrame, edges: list[int]) -> DataFrame:
    """snapshot() of every slice between neighbouring edges, all threads: (slice, thread_id, name, ns).

    A block is exploded to the slices that it meets, which arithmetic finds for equal slices; nothing is joined.
    """
    lo, step, n = edges[0], edges[1] - edges[0], len(edges) - 1
    first = F.greatest(F.expr(f"(start_ns - {lo}) div {step}"), F.lit(0))
    last = F.least(F.expr(f"(finish_ns - {lo}) div {step}"), F.lit(n - 1))
    s = spans.where((F.col("level") > 0) & (F.col("finish_ns") > lo) & (F.col("start_ns") < edges[-1]))
    s = s.withColumn("slice", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    s = s.withColumn("a", F.lit(lo) + F.col("slice") * step).withColumn("b", F.col("a") + step).where("finish_ns > a and start_ns < b")
    s = s.withColumn("clip", F.least("finish_ns", "b") - F.greatest("start_ns", "a"))
    share = F.expr("cast(cast(exclusive_ns as decimal(20,0)) * cast(clip as decimal(18,0)) div duration_ns as bigint)")
    ns = F.when((F.col("start_ns") >= F.col("a")) & (F.col("finish_ns") <= F.col("b")), F.col("exclusive_ns")).otherwise(share)
    return s.groupBy(F.col("slice").cast("int").alias("slice"), "thread_id", "name").agg(F.sum(ns).cast("long").alias("ns"))


def self_segments(enter_leave: DataFrame) -> DataFrame:
    """(thread_id, name, depth, a, b): stretches of time in which a block is the innermost open one, from each event to the next."""
    after = F.lead("ts_ns").over(Window.partitionBy("thread_id").orderBy("seq_no"))
    s = with_open(enter_leave.withColumn("b", after)).where("at >= 0 and b is not null")
    return s.select("thread_id", F.col("open_name").alias("name"), F.col("at").alias("depth"), F.col("ts_ns").alias("a"), "b")


def snapshot_exact(enter_leave: DataFrame, lo: int, hi: int) -> DataFrame:
    """Self time of blocks below the root inside [lo, hi], by thread and name."""
    s = self_segments(enter_leave).where((F.col("depth") > 0) & (F.col("b") > lo) & (F.col("a") < hi))
    return s.groupBy("thread_id", "name").agg(F.sum(clipped(F.col("a"), F.col("b"), lo, hi)).cast("long").alias("ns"))


def chunk_table(spans: DataFrame, size: int = 1000) -> DataFrame:
    """Summary rows of `size` occurrences of a thread's name: first, last, count and sum of exclusive time."""
    w = Window.partitionBy("thread_id", "name").orderBy("start_ns", "finish_ns", "event_id")
    s = spans.withColumn("chunk", F.expr(f"cast(({'idx'}) div {size} as bigint)")) if "idx" in spans.columns else spans.withColumn("idx", F.row_number().over(w) - 1).withColumn("chunk", F.expr(f"cast(idx div {size} as bigint)"))
    return s.groupBy("thread_id", "name", "chunk").agg(F.min("start_ns").alias("first_ns"), F.max("finish_ns").alias("last_ns"), F.count("*").alias("n"), F.sum("exclusive_ns").alias("sum_ns"))


def snapshot_fast(chunks: DataFrame, lo: int, hi: int) -> DataFrame:
    """Approximate snapshot from chunk summaries: each chunk gives its sum in the share of its time range that [lo, hi] covers."""
    c = chunks.where((F.col("last_ns") >= lo) & (F.col("first_ns") <= hi))
    width = F.col("last_ns") - F.col("first_ns")
    weight = F.when(width == 0, 1.0).otherwise(clipped(F.col("first_ns"), F.col("last_ns"), lo, hi) / width)
    return c.groupBy("thread_id", "name").agg(F.sum(F.round(weight * F.col("sum_ns")).cast("long")).cast("long").alias("ns"))


def moments_between(lo: Column, hi: Column, moments: list[int]) -> Column:
    """Those of a sorted list of moments with lo <= moment < hi (a null bound is open), found by a search over literals."""

    def below(x: Column) -> Column:  # how many moments are < x
        def pick(i: int, j: int) -> Column:
            if i == j:
                return F.lit(i)
            mid = (i + j + 1) // 2
            return F.when(x > moments[mid - 1], pick(mid, j)).otherwise(pick(i, mid - 1))

        return pick(0, len(moments))

    first = F.when(lo.isNull(), F.lit(0)).otherwise(below(lo))
    last = F.when(hi.isNull(), F.lit(len(moments))).otherwise(below(hi))
    return F.slice(F.array(*[F.lit(m).cast("long") for m in moments]), first + 1, F.greatest(last - first, F.lit(0)))


def callstack(enter_leave: DataFrame, moments: list[int]) -> DataFrame:
    """(thread_id, t_ns, depth, name): the blocks of a thread open at each of a few moments (start <= t < finish)."""
    after = F.lead("ts_ns").over(Window.partitionBy("thread_id").orderBy("seq_no"))
    s = with_stack(enter_leave.withColumn("__after", after)).where("__after is not null")
    s = s.withColumn("t_ns", F.explode(moments_between(F.col("ts_ns"), F.col("__after"), sorted(set(moments)))))
    return s.select("thread_id", "t_ns", F.posexplode("stack").alias("depth", "block")).select("thread_id", "t_ns", "depth", F.col("block.name").alias("name"))


def folded_stacks(enter_leave: DataFrame) -> DataFrame:
    """(stack, self_ns): time in which exactly these blocks are open, all threads together, for flame graphs; any depth."""
    after = F.lead("ts_ns").over(Window.partitionBy("thread_id").orderBy("seq_no"))
    s = with_stack(enter_leave.withColumn("__after", after)).where("__after is not null and size(stack) > 0")
    stack = F.array_join(F.transform("stack", lambda x: x["name"]), ";")
    return s.groupBy(stack.alias("stack")).agg(F.sum(F.col("__after") - F.col("ts_ns")).cast("long").alias("self_ns"))


def range_sum(spans: DataFrame, lo: int, hi: int) -> DataFrame:
    """Sum of durations of occurrences lo <= index < hi of each thread's name."""
    w = Window.partitionBy("thread_id", "name").orderBy("start_ns", "finish_ns", "event_id")
    s = spans.withColumn("idx", F.row_number().over(w) - 1).where((F.col("idx") >= lo) & (F.col("idx") < hi))
    return s.groupBy("thread_id", "name").agg(F.sum("duration_ns").alias("ns"), F.count("*").alias("n"))


def quantised(spans: DataFrame, size: int = 1000, steps: int = 255) -> DataFrame:
    """Durations rounded down to one of `steps` values between the least and most of their chunk of `size` occurrences."""
    w = Window.partitionBy("thread_id", "name").orderBy("start_ns", "finish_ns", "event_id")
    s = spans.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).withColumn("chunk", F.expr(f"idx div {size}"))
    c = Window.partitionBy("thread_id", "name", "chunk")
    s = s.withColumn("lo", F.min("duration_ns").over(c)).withColumn("width", F.max("duration_ns").over(c) - F.col("lo"))
    code = F.expr(f"cast(cast(duration_ns - lo as decimal(20,0)) * {steps} div width as bigint)")
    back = F.expr(f"lo + cast(cast(code as decimal(20,0)) * width div {steps} as bigint)")
    s = s.withColumn("code", F.when(F.col("width") == 0, F.lit(0).cast("long")).otherwise(code))
    return s.select("thread_id", "name", "idx", "duration_ns", "code", F.when(F.col("width") == 0, F.col("lo")).otherwise(back).alias("quantised_ns"))
