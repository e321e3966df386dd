"""Dictionaries and repeated patterns of token streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import payload
from ..scratch import Scratch
from .order import with_position
from .spans import with_depth, with_exclusive, with_phase, with_stack


def event_dictionary(tokens: DataFrame) -> DataFrame:
    """(thread_id, token, id, n): distinct tokens in order of first appearance."""
    d = tokens.groupBy("thread_id", "token").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    return d.withColumn("id", (F.row_number().over(Window.partitionBy("thread_id").orderBy("first_pos")) - 1).cast("long")).select("thread_id", "token", "id", "n")


def runs(tokens: DataFrame, least: int = 1) -> DataFrame:
    """(thread_id, token, start_pos, n): stretches of one repeated token, by gaps and islands."""
    a = F.row_number().over(Window.partitionBy("thread_id").orderBy("pos"))
    b = F.row_number().over(Window.partitionBy("thread_id", "token").orderBy("pos"))
    return (
        tokens.withColumn("island", a - b).groupBy("thread_id", "token", "island").agg(F.min("pos").alias("start_pos"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")
    )


def stretches(tokens: DataFrame, longest: int) -> DataFrame:
    """(thread_id, body, start_pos, nb_iterations): stretches in which a body of up to `longest` tokens repeats at least twice.

    A place continues a stretch of period n if its token is that of n places before; islands of such places are stretches.
    A body that itself repeats a shorter one is left to that one. One window pass a size, over one exchange.
    """
    w = Window.partitionBy("thread_id").orderBy("pos")
    t = tokens.select("thread_id", "pos", "token", F.row_number().over(w).alias("at"))
    out = None
    for n in range(1, longest + 1):
        same = F.coalesce(F.col("token") == F.lag("token", n).over(w), F.lit(False))
        body = F.array(*[F.lag("token", n - k).over(w) for k in range(n)])  # the n tokens before this place
        g = t.withColumns({"same": same, "body": body}).where("same")
        g = g.withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy("thread_id").orderBy("pos")))
        g = g.groupBy("thread_id", "island").agg(F.min_by("body", "at").alias("body"), (F.min("pos") - n).alias("start_pos"), F.count("*").alias("more")).where(F.col("more") >= n)
        for d in range(1, n):
            if n % d == 0:
                g = g.where(F.slice("body", 1, n - d) != F.slice("body", d + 1, n - d))
        g = g.select("thread_id", "body", "start_pos", F.expr(f"cast(more div {n} + 1 as bigint)").alias("nb_iterations"))
        out = g if out is None else out.unionByName(g)
    return out


def loops(tokens: DataFrame, longest: int = 3) -> DataFrame:
    """(thread_id, body, nb_iterations, nb_occurrences): equal stretches are one loop."""
    return stretches(tokens, longest).groupBy("thread_id", "body", "nb_iterations").agg(F.count("*").alias("nb_occurrences"))


def sequences(tokens: DataFrame, block: str = "block") -> DataFrame:
    """(tokens, n): distinct token arrays of blocks (thread_id, block, pos, token), and how often each occurs."""
    arrays = tokens.groupBy("thread_id", block).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    return arrays.groupBy("tokens").agg(F.count("*").alias("n"))


def repeats(tokens: DataFrame, longest: int) -> DataFrame:
    """(thread_id, pos, size): places at which the last `size` tokens equal the `size` before them, the shortest size up to `longest`."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    sizes = range(1, longest + 1)
    t = tokens.select("thread_id", "pos", *[F.coalesce(F.col("token") == F.lag("token", n).over(w), F.lit(False)).alias(f"s{n}") for n in sizes])
    hit = [F.min(f"s{n}").over(w.rowsBetween(1 - n, 0)).alias(f"h{n}") for n in sizes]
    size = F.coalesce(*[F.when(F.col(f"h{n}"), n) for n in sizes])
    return t.select("thread_id", "pos", *hit).select("thread_id", "pos", size.alias("size")).where("size is not null")


def known_sequences(tokens: DataFrame, dictionary: DataFrame, longest: int) -> DataFrame:
    """(thread_id, pos, size): where the last 2 to `longest` tokens up to a place are a known sequence, the shortest one.

    dictionary: (tokens) of known sequences; longer ones than `longest` don't count.
    """
    w = Window.partitionBy("thread_id").orderBy("pos")
    tail = tokens.select("thread_id", "pos", F.array(*[F.lag("token", k).over(w) for k in range(longest - 1, -1, -1)]).alias("tail"))
    size = F.explode(F.sequence(F.lit(2), F.lit(longest)))
    cut = tail.withColumn("size", size).withColumn("tokens", F.expr(f"slice(tail, {longest} - size + 1, size)")).where(F.forall("tokens", lambda x: x.isNotNull()))
    known = dictionary.select("tokens").distinct()
    return cut.join(known, "tokens", "left_semi").groupBy("thread_id", "pos").agg(F.min("size").alias("size"))


def with_tokens(events: DataFrame) -> DataFrame:
    """events of a program with their phase, label and `token`: what makes two events one entry of the dictionary."""
    e = payload(with_phase(events))
    parts = ["record", "label", "peer", "communicator", "tag", "msg_length", "request_id", "lock_id", "acquisition_order", "task_id", "n_threads", "coll_op", "coll_root", "size_sent", "size_received"]
    return e.withColumns({"token": F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]), "name": F.col("label")})


def event_ids(events: DataFrame) -> DataFrame:
    """with_tokens() and event_no: the number of the event's dictionary entry in its thread, in order of first appearance."""
    e = with_tokens(events)
    first = e.groupBy("thread_id", "token").agg(F.min("seq_no").alias("first_seq"))
    ids = first.withColumn("event_no", (F.row_number().over(Window.partitionBy("thread_id").orderBy("first_seq")) - 1).cast("long")).drop("first_seq")
    return e.join(ids, ["thread_id", "token"])


def block_contents(events: DataFrame) -> DataFrame:
    """(thread_id, enter_seq, content, other_content, n_tokens): two hashes of all that stands between a block's ends.

    Each event goes to all blocks that are open around it and is folded into an order-sensitive hash of its token and its
    place, so that no block is ever gathered in one row; partial sums are made before the shuffle.
    """
    s = with_stack(with_tokens(events))
    whole = F.when(F.col("phase") == "L", F.concat("stack", F.array(F.col("own")))).otherwise(F.col("stack"))
    # a LEAVE belongs to the block that it closes
    last = F.last(F.when(F.col("phase") == "E", F.struct(F.col("seq_no").alias("seq"), "name")), ignorenulls=True)
    s = s.withColumn("own", last.over(Window.partitionBy("thread_id", "depth").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)))
    s = s.select("thread_id", "seq_no", "token", F.explode(whole).alias("block")).select("thread_id", F.col("block.seq").alias("enter_seq"), "seq_no", "token")
    place = F.col("seq_no") - F.col("enter_seq")
    return s.groupBy("thread_id", "enter_seq").agg(
        F.bit_xor(F.xxhash64("token", place)).alias("content"), F.bit_xor(F.xxhash64(place, F.lit(7), "token")).alias("other_content"), F.count("*").alias("n_tokens")
    )


def block_sequences(events: DataFrame, scratch: Scratch) -> DataFrame:
    """The blocks of a program (spans.with_exclusive) with content, sequence_id, iteration and loop, written.

    Blocks of a thread with equal content are occurrences of one sequence; ids follow their first appearance, so the
    outermost block is 0. Neighbours of one parent with equal content, and nothing between them, are iterations 0, 1, … of a
    loop; loop is the enter_seq of its first.
    """
    tokens = with_phase(events).withColumn("name", F.col("label"))
    contents = block_contents(events)
    b = with_exclusive(tokens).join(contents, ["thread_id", "enter_seq"])
    first = F.min("enter_seq").over(Window.partitionBy("thread_id", "content", "other_content", "n_tokens"))
    b = b.withColumn("first_seq", first)
    b = b.withColumn("sequence_id", (F.dense_rank().over(Window.partitionBy("thread_id").orderBy("first_seq")) - 1).cast("long"))
    w = Window.partitionBy("thread_id", "parent_seq").orderBy("enter_seq")
    again = F.coalesce((F.lag("leave_seq").over(w) + 1 == F.col("enter_seq")) & (F.lag("sequence_id").over(w) == F.col("sequence_id")), F.lit(False)) & F.col("parent_seq").isNotNull()
    b = b.withColumn("again", again).withColumn("loop", F.last(F.when(~F.col("again"), F.col("enter_seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return scratch.table(b.withColumn("iteration", (F.row_number().over(Window.partitionBy("thread_id", "parent_seq", "loop").orderBy("enter_seq")) - 1).cast("long")).drop("first_seq"))


def block_loops(blocks: DataFrame) -> DataFrame:
    """(thread_id, loop_id, sequence_id, name, nb_iterations, nb_occurrences): repeats of a sequence, equal ones shared; ids by first appearance."""
    runs = blocks.groupBy("thread_id", "parent_seq", "loop", "sequence_id", "name").agg(F.count("*").alias("nb_iterations")).where("nb_iterations > 1")
    same = runs.groupBy("thread_id", "sequence_id", "name", "nb_iterations").agg(F.count("*").alias("nb_occurrences"), F.min("loop").alias("first"))
    ids = (F.row_number().over(Window.partitionBy("thread_id").orderBy("first")) - 1).cast("long")
    return same.withColumn("loop_id", ids).select("thread_id", "loop_id", "sequence_id", "name", "nb_iterations", "nb_occurrences")


def sequence_table(blocks: DataFrame) -> DataFrame:
    """One row a sequence of a thread: its size, how often it occurs, and least, mean, most and total times."""
    return blocks.groupBy("thread_id", "sequence_id", "name").agg(
        F.max("n_tokens").alias("n_tokens"), F.count("*").alias("n"), F.min("duration_ns").alias("min_ns"), F.expr("sum(duration_ns) div count(*)").alias("mean_ns"),
        F.max("duration_ns").alias("max_ns"), F.sum("duration_ns").cast("long").alias("total_ns"), F.sum("exclusive_ns").cast("long").alias("total_exclusive_ns"),
    )


def shared_sequences(blocks: DataFrame) -> DataFrame:
    """(thread_id, sequence_id, shared_id): sequences of all threads renumbered, equal contents alike, in order of their first thread and id."""
    key = ["content", "other_content", "n_tokens"]
    own = blocks.select("thread_id", "sequence_id", *key).distinct()
    first = own.groupBy(*key).agg(F.min(F.struct("thread_id", "sequence_id")).alias("first"))
    first = first.select(*key, F.col("first.thread_id").alias("first_thread"), F.col("first.sequence_id").alias("first_id"))
    ids = with_position(first, ["first_thread", "first_id"], "shared_id")
    return own.join(ids, key).select("thread_id", "sequence_id", "shared_id")


def unrolled(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """(flag, thread_id, seq_no): the events that a cursor meets under each of the four ways to read a thread.

    ALL meets every event; SEQUENCES enters blocks but takes a loop's first iteration only; LOOPS repeats loops but does not
    enter the blocks inside the outermost one; NONE does neither.
    """
    e = with_depth(with_phase(events))
    later = blocks.where("iteration > 0").select("thread_id", F.explode(F.array(F.struct(F.col("enter_seq").alias("s"), F.lit(1).alias("v")), F.struct((F.col("leave_seq") + 1).alias("s"), F.lit(-1).alias("v")))).alias("x"))
    steps = later.select("thread_id", F.col("x.s").alias("seq_no"), F.col("x.v").alias("step")).groupBy("thread_id", "seq_no").agg(F.sum("step").alias("step"))
    w = Window.partitionBy("thread_id").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    e = e.join(steps, ["thread_id", "seq_no"], "left").withColumn("skipped", F.sum(F.coalesce("step", F.lit(0))).over(w) > 0)
    top = (F.col("depth") == 0) | (F.col("depth") == 1) & (F.coalesce(F.col("phase"), F.lit("")) != "L")
    flags = F.array(F.lit("ALL"), F.when(~F.col("skipped"), F.lit("SEQUENCES")), F.when(top, F.lit("LOOPS")), F.when(top & ~F.col("skipped"), F.lit("NONE")))
    return e.select(F.explode(F.array_compact(flags)).alias("flag"), "thread_id", "seq_no")


class Inducer:
    """Turns one thread's tokens into nested loops, as tokens arrive.

    The open level is a list of items: a token, or a loop (body, iterations). After each arrival the shortest body that
    stands twice at the end becomes a loop; a loop whose body has just come again grows. Bodies and loops are interned by
    content, so equal loops share an id wherever they stand.
    """

    def __init__(self, longest: int | None = 100):
        """longest: tokens of a loop's body at most; None sets no limit, 0 looks for no loops."""
        self.longest = longest
        self.items: list[tuple] = []  # ("E", token) or ("L", body id, iterations)
        self.bodies: dict[tuple, int] = {}

    def push(self, token: str) -> None:
        self.items.append(("E", token))
        while self._fold():
            pass

    def _fold(self) -> bool:
        x = self.items
        for size in range(1, len(x) if self.longest is None else min(self.longest, len(x) - 1) + 1):
            tail = tuple(x[-size:])
            before = x[-size - 1]
            if before[0] == "L" and self.bodies.get(tail) == before[1]:
                x[-size - 1 :] = [("L", before[1], before[2] + 1)]
                return True
            if 2 * size <= len(x) and tuple(x[-2 * size : -size]) == tail:
                if size == 1 and tail[0][0] == "L":
                    continue  # two equal loops side by side stay: they differ from one loop of twice the length
                body = self.bodies.setdefault(tail, len(self.bodies))
                x[-2 * size :] = [("L", body, 2)]
                return True
        return False

    def expand(self, items: list[tuple] | tuple | None = None) -> list[str]:
        names = {v: k for k, v in self.bodies.items()}
        out: list[str] = []
        for it in self.items if items is None else items:
            out += [it[1]] if it[0] == "E" else self.expand(names[it[1]]) * it[2]
        return out

    def text(self, items: list[tuple] | tuple | None = None) -> str:
        names = {v: k for k, v in self.bodies.items()}
        return " ".join(it[1] if it[0] == "E" else f"({self.text(names[it[1]])})x{it[2]}" for it in (self.items if items is None else items))


class BlockInducer:
    """The grammar of one thread's blocks, as events arrive: sequences from START to END, loops inside each.

    A block's items are events ("E", token), closed blocks ("S", id) and loops ("L", body id, iterations); equal sequences
    and equal bodies share an id.
    """

    def __init__(self, longest: int | None = 100):
        self.longest = longest
        self.open = [Inducer(longest)]
        self.bodies = self.open[0].bodies
        self.sequences: dict[tuple, int] = {}
        self.count: list[int] = []

    def push(self, token: str, phase: str | None) -> None:
        if phase == "E":
            self.open.append(Inducer(self.longest))
            self.open[-1].bodies = self.bodies
        self._add(("E", token))
        if phase == "L" and len(self.open) > 1:
            self._close()

    def _add(self, item: tuple) -> None:
        self.open[-1].items.append(item)
        while self.open[-1]._fold():
            pass

    def _close(self) -> None:
        items = tuple(self.open.pop().items)
        at = self.sequences.setdefault(items, len(self.sequences))
        if at == len(self.count):
            self.count.append(0)
        self.count[at] += 1
        self._add(("S", at))

    def end(self) -> None:
        """Closes what is still open; the root is what remains."""
        while len(self.open) > 1:
            self._close()

    def expand(self, items: list[tuple] | tuple | None = None) -> list[str]:
        body, seq = ({v: k for k, v in d.items()} for d in (self.bodies, self.sequences))
        out: list[str] = []
        stack = [iter(self.open[0].items if items is None else items)]
        while stack:
            it = next(stack[-1], None)
            if it is None:
                stack.pop()
            elif it[0] == "E":
                out.append(it[1])
            else:
                stack.append(iter(seq[it[1]] if it[0] == "S" else body[it[1]] * it[2]))
        return out


#: Names of the ways to look for loops, and the longest body of each (None: any).
ALGORITHMS = {"None": 0, "Basic": None, "BasicTruncated": 100}


def induce(tokens: DataFrame, longest: int | None = 100) -> DataFrame:
    """(thread_id, n_tokens, n_items, n_loops, grammar): full induction of each thread, one task a thread.

    The method depends on all that came before, so a thread is its unit of work; `longest` bounds the work of a token.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos")
        g = Inducer(longest)
        for t in rows["token"]:
            g.push(t)
        return pd.DataFrame({
            "thread_id": [rows["thread_id"].iloc[0]], "n_tokens": [len(rows)], "n_items": [len(g.items)], "n_loops": [len(g.bodies)], "grammar": [g.text()],
        })

    return tokens.groupBy("thread_id").applyInPandas(one, "thread_id long, n_tokens long, n_items long, n_loops long, grammar string")


def induce_blocks(events: DataFrame, algorithm: str = "BasicTruncated", longest: int | None = None) -> DataFrame:
    """(algorithm, thread_id, kind, id, items, n): the root (kind R), sequences (S) and loop bodies (L) of each thread's grammar.

    items is the right-hand side as text (E token, S id, L id x iterations); n counts a sequence's occurrences.
    """
    most = ALGORITHMS[algorithm] if longest is None else longest

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = BlockInducer(most)
        for token, phase in pdf.sort_values("seq_no")[["token", "phase"]].itertuples(index=False):
            g.push(token, phase if isinstance(phase, str) else None)
        g.end()
        show = lambda items: " ".join(f"E({x[1]})" if x[0] == "E" else f"S{x[1]}" if x[0] == "S" else f"L{x[1]}x{x[2]}" for x in items)
        rows = [("R", 0, show(g.open[0].items), 1)]
        rows += [("S", i, show(items), g.count[i]) for items, i in g.sequences.items()]
        rows += [("L", i, show(items), 0) for items, i in g.bodies.items()]
        out = pd.DataFrame(rows, columns=["kind", "id", "items", "n"])
        out.insert(0, "thread_id", pdf["thread_id"].iloc[0])
        out.insert(0, "algorithm", algorithm)
        return out

    e = with_tokens(events).select("thread_id", "seq_no", "token", "phase")
    return e.groupBy("thread_id").applyInPandas(one, "algorithm string, thread_id long, kind string, id long, items string, n long")


def align(dictionary: DataFrame, edges: DataFrame) -> DataFrame:
    """(thread_id, id, shared): ids of equal content across threads.

    dictionary: (thread_id, id, content) of leaves; edges: (thread_id, parent, pos, child) of sequences. Leaves are equal by
    content, sequences by the content of their children; each round settles at least one more level, and rounds go on until
    every sequence is settled. One that can't be settled, since it contains itself or something unknown, is an error.
    """
    scratch = Scratch(dictionary.sparkSession)
    known = scratch.table(dictionary.select("thread_id", "id", F.sha2(F.concat(F.lit("E"), "content"), 256).alias("shared")))
    n, open_edges = known.count(), scratch.table(edges)
    while not open_edges.isEmpty():
        k = known.select(F.col("thread_id").alias("__thread"), F.col("id").alias("__id"), "shared")
        e = open_edges.join(k, (F.col("thread_id") == F.col("__thread")) & (F.col("child") == F.col("__id")), "left").select("thread_id", "parent", "pos", "child", "shared")
        done = e.groupBy("thread_id", "parent").agg(F.count("*").alias("n"), F.count("shared").alias("ready"), F.array_sort(F.collect_list(F.struct("pos", "shared"))).alias("c")).where("n = ready")
        new = scratch.table(done.select("thread_id", F.col("parent").alias("id"), F.sha2(F.concat(F.lit("S"), F.array_join(F.transform("c", lambda x: x["shared"]), ",")), 256).alias("shared")))
        both = scratch.table(known.unionByName(new).distinct())
        left = scratch.table(open_edges.join(new.select("thread_id", F.col("id").alias("parent")), ["thread_id", "parent"], "left_anti").select("thread_id", "parent", "pos", "child"))
        for old in (known, open_edges):
            scratch.drop(old)
        known, open_edges, m = both, left, both.count()
        if m == n and not open_edges.isEmpty():
            raise ValueError("sequences contain themselves or unknown parts")
        n = m
    return known
