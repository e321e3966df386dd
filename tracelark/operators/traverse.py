"""Orders, neighbours, bookmarks and the grammar's closure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .order import dense_ids, occurrence, with_position
from .spans import moments_between


def merged(events: DataFrame) -> DataFrame:
    """All threads' events in time order, ties by archive, thread and event: global_pos from 0."""
    return with_position(events, ["ts_ns", "archive_id", "thread_id", "event_id"])


def thread_events(events: DataFrame) -> DataFrame:
    """Events with their place in the thread and their index among equal names."""
    return events.withColumn("pos", occurrence(["thread_id"], ["ts_ns", "event_id"])).withColumn("occurrence_idx", occurrence(["thread_id", "name"], ["ts_ns", "event_id"]))


def neighbours(enter_leave: DataFrame) -> DataFrame:
    """Each event as a cursor sees it: what lies before and after, whether it enters or leaves a block, ends its block, or ends the thread."""
    w = Window.partitionBy("thread_id").orderBy("seq_no")
    after = F.lead("phase").over(w)
    return enter_leave.withColumns({
        "prev_name": F.lag("name").over(w), "next_name": F.lead("name").over(w), "enters": F.col("phase") == "E", "leaves": F.col("phase") == "L",
        "ends_block": F.coalesce(after == "L", F.lit(True)), "ends_thread": after.isNull(),
    })


def bookmarks(enter_leave: DataFrame) -> DataFrame:
    """(thread_id, mark): a saved cursor in the middle of each thread."""
    return enter_leave.groupBy("thread_id").agg(F.expr("cast(count(*) div 2 as bigint)").alias("mark"))


def resume(enter_leave: DataFrame, marks: DataFrame) -> DataFrame:
    """The events from each thread's saved cursor on."""
    return enter_leave.join(marks, "thread_id").where("seq_no >= mark").drop("mark")


def seek(events: DataFrame, moments: list[int]) -> DataFrame:
    """(thread_id, t_ns, idx): index of the last event with ts <= t in each thread, 0 if t is before the first.

    Each event answers for the moments up to the next event, found by a search over the literal moments.
    """
    order = Window.partitionBy("thread_id").orderBy("ts_ns", "event_id")
    e = events.withColumns({"idx": occurrence(["thread_id"], ["ts_ns", "event_id"]), "__after": F.lead("ts_ns").over(order)})
    since = F.when(F.col("idx") > 0, F.col("ts_ns"))
    return e.select("thread_id", F.explode(moments_between(since, F.col("__after"), sorted(set(moments)))).alias("t_ns"), "idx")


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant) of every path of an edge list (parent, child): doubling, until nothing new comes."""
    scratch = Scratch(edges.sparkSession)
    have = scratch.table(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct())
    n, m = -1, have.count()
    while m != n:
        step = have.select(F.col("ancestor").alias("via"), F.col("descendant").alias("far"))
        more = have.join(step, have["descendant"] == step["via"]).select("ancestor", F.col("far").alias("descendant"))
        new = scratch.table(have.unionByName(more).distinct())
        scratch.drop(have)
        have, n, m = new, m, new.count()
    return have


def _levels(first: DataFrame, step: Callable[[DataFrame], DataFrame], most: int, scratch: Scratch) -> DataFrame:
    """first, step(first), step(step(first)), … until a level is empty, together; more than `most` levels mean a cycle."""
    parts, level = [], scratch.table(first)
    while not level.isEmpty():
        parts.append(level)
        if len(parts) > most:
            raise ValueError("a definition contains itself")
        level = scratch.table(step(level))
    out = level
    for p in parts:
        out = out.unionByName(p)
    return out


def token_counts(edges: DataFrame) -> DataFrame:
    """(root, token, n): how often each token stands in the full expansion of a sequence, from (parent, child, times).

    A round a level, to the deepest one, whatever its depth; a sequence that contains itself is an error.
    """
    scratch = Scratch(edges.sparkSession)
    base = scratch.table(edges.groupBy("parent", "child").agg(F.sum("times").alias("times")))
    first = base.select(F.col("parent").alias("root"), F.col("child").alias("token"), F.col("times").alias("n"))

    def step(level: DataFrame) -> DataFrame:
        return level.join(base, level["token"] == base["parent"]).groupBy("root", F.col("child").alias("token")).agg(F.sum(F.col("n") * F.col("times")).alias("n"))

    every = _levels(first, step, base.select("parent").distinct().count() + 1, scratch)
    return every.groupBy("root", "token").agg(F.sum("n").alias("n"))


def parents(groups: DataFrame) -> DataFrame:
    """(id, depth, path) of a hierarchy (id, name, parent): from the roots down to the deepest level, a round a level.

    A row whose parent is not in the table is a root; one that is its own ancestor has no path and is left out.
    """
    scratch = Scratch(groups.sparkSession)
    known = groups.select(F.col("id").alias("__id"))
    roots = groups.where("parent is null").unionByName(groups.where("parent is not null").join(known, groups["parent"] == known["__id"], "left_anti"))

    def step(level: DataFrame) -> DataFrame:
        up = level.select(F.col("id").alias("up_id"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
        return groups.join(up, groups["parent"] == up["up_id"]).select("id", (F.col("up_depth") + 1).alias("depth"), F.concat_ws("/", "up_path", "name").alias("path"))

    return _levels(roots.select("id", F.lit(0).alias("depth"), F.col("name").alias("path")), step, groups.count() + 1, scratch)


def signed_counts(left: DataFrame, right: DataFrame, keys: list[str], times: int = -1) -> DataFrame:
    """Bag arithmetic on counts: left + times * right; zeros go."""
    both = left.select(*keys, "n").unionByName(right.select(*keys, (F.col("n") * times).alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def resolve(refs: DataFrame, definitions: DataFrame, ref: str = "ref") -> Column | DataFrame:
    """refs with str: the local definition, else the global one. Both dictionaries come from one pass over the definitions."""
    d = definitions.groupBy(F.col("ref").alias("__ref")).agg(F.coalesce(F.max(F.when(F.col("scope") == "local", F.col("str"))), F.max(F.when(F.col("scope") == "global", F.col("str")))).alias("str"))
    return refs.join(d, refs[ref] == d["__ref"], "left").drop("__ref")


def unified(definitions: DataFrame) -> DataFrame:
    """(scope, ref, new_ref, str): equal strings of all scopes share one id, the smallest of their places in string order."""
    ids = dense_ids(definitions, ["str"], "new_ref")
    return definitions.join(ids, "str").select("scope", "ref", "new_ref", "str")
