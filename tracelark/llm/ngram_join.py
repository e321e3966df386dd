"""N-gram Jaccard join: all documents whose sets of word shingles overlap by the threshold, as connected groups.

Sets are sorted arrays of 64-bit shingle hashes. Two documents link when 100 * |A and B| >= percent * |A or B|.

1. Equal sets are one node, so copies are never paired. A node has a size band (powers of 100 / percent: sets that may link
   stand in the same band or in neighbouring ones) and hashed bitmaps whose widths follow its size, a small and a full one.
2. Prefix filter: in one total order of shingles (by hash, those that a first look finds often last) two sets that link
   share one of their first n - ceil(percent * n / 100) + 1 shingles. These are the keys of tiles. Any order finds the same
   links, so what the first look sees only bears on speed. Keys that it did not see often meet in one shuffle; those that it
   did are summed before they shuffle and are joined back, so that a key of a third of all rows can be split.
3. Round one pairs each member of a tile with the tile's smallest and largest node: a number of pairs that is linear in the
   tile. Sizes, then the bitmaps' bit counts bound the overlap from above; what remains is decided exactly on sorted arrays
   made from the texts. Links give components. A second such round pairs members outside a tile's largest component with
   members of it, another one by each of ``PIVOTS`` classes of keys.
4. The last round takes the tiles that still hold several components. Tiles with the same largest component become one, in
   which a node stands once however many keys it shares; large ones are cut by size band and into chunks. Members outside
   the largest component are cut into chunks as well, and visit all chunks of their own and the neighbouring bands: a task's
   unit is one chunk of members and one of visitors. Pairs within one component need no look, all others get one, by bitmaps
   first. What passes is decided exactly, and components are closed.

5. Links are counted, for the query only: each component is cut by size band and into chunks, each pair of chunks of the same or
   neighbouring bands meets once, and one matrix product gives all overlaps exactly. Only counts a node leave this step.

No tile is collected whole, no pair within a component is emitted, and every step after the postings works on tables in
the shared folder.

A pair is verified on whole texts: the text of one side is sent once to each block of at most ``HUB`` pairs that it stands in.

Defined cases: fewer words than `width` give the whole sequence as one shingle; texts without words, null texts and null
ids have no set and link with nothing (their component is their own id); rows that repeat a doc_id each contribute their
set; very long texts are one set like any other, compared whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .class_lm import _deal, _packs, _summed, _unpacked
from .common import Scratch, few_texts, hash_words, lean, lean_rows, texts
from .components import connected_components

CACHE = 150_000
SEND_ROWS = 500_000  # so many ids (8 bytes each) may be sent to every executor
FULL = 4  # bits an element of the full bitmaps
CHUNK = 1024  # members of a tile, or visitors, that one chunk holds
HUB = 2048  # pairs with one node that are verified together
LINK_NODES, LINK_SHINGLES = 512, 1_000_000  # a chunk of a component whose links are counted holds about so much
PIVOTS = 16
_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


class Shingler:
    """Sorted distinct shingle hashes of whole texts, with a bounded memory of word hashes."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def of(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            known.update(zip(new, hash_words(new).tolist(), strict=True))
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(known) > CACHE:
            known.clear()
        n = max(len(h) - self.width + 1, 1)
        k = min(self.width, len(h))
        with np.errstate(over="ignore"):
            x = h[:n].copy()
            for j in range(1, k):
                x = (x ^ (x >> np.uint64(29))) * _M + h[j : j + n]
            x = x + np.uint64(k) * _A
            x = (x ^ (x >> np.uint64(30))) * _A
            x = (x ^ (x >> np.uint64(27))) * _B
            x = x ^ (x >> np.uint64(31))
        return np.unique(x)


def node_of(x: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def band_of(n: int, percent: int) -> int:
    """Sets that may link are at most one band apart."""
    return int(math.floor(math.log(n) / math.log(100 / percent) + 1e-9))


def bitmap(x: np.ndarray, bits_each: int = 1) -> bytes:
    """Bits of the hashed elements; the width is a power of two from bits_each times the size up.

    One bit an element rules out unrelated sets: of the elements that the other lacks over a third fall on bits that it has
    not set. Four rule out most sets that are alike but do not link.
    """
    width = max(64, 1 << (bits_each * len(x) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(x >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(sig: np.ndarray, size: int) -> np.ndarray:
    """The bitmap at a smaller width: equal places of its parts fall together."""
    return np.bitwise_or.reduce(sig.reshape(-1, size), axis=0) if len(sig) > size else sig


def may_link(na: int, nb: int, a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """False only if sizes or bitmaps rule a link out: each bit of one side that the other lacks is an element that it lacks."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    most = min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))
    return (100 + percent) * most >= percent * (na + nb)


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class NgramJoin:
    def __init__(self, docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", common: int = 100_000, look: int = 8):
        self.src = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("raw"))
        self.percent, self.width, self.common, self.look = percent, width, common, look
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark)

    def often(self) -> np.ndarray:
        """Shingles that a part of the documents (one in `look`, by hash) holds three times or more, rarest first; the `common` most frequent at most.

        All counts of a shingle meet, so how often it must be seen does not grow with the number of tasks.
        """
        width, parts = self.width, max(64, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, waiting, size = Shingler(width), [], 0

            def deal() -> pa.RecordBatch:
                k, n = np.unique(np.concatenate(waiting), return_counts=True)
                waiting.clear()
                return _packs(_deal(k, parts), k, n.astype(np.int32))

            for b in batches:
                for raw in b.column(1).to_pylist():
                    x = find.of(raw)
                    if len(x):
                        waiting.append(x)
                        size += len(x)
                    if size > 2_000_000:
                        yield deal()
                        size = 0
            if waiting:
                yield deal()

        def count(t: pa.Table) -> pa.Table:
            k, n = _unpacked(t)
            k, n = _summed([k], [n.astype(np.int64)])
            return pa.table({"s": pa.array(k[n >= 3].view(np.int64)), "n": pa.array(n[n >= 3])})

        part = self.src.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(self.look)) == 0)
        seen = part.mapInArrow(few_texts(run), "part long, x binary, y binary").groupBy("part").applyInArrow(lambda t: lean(count, t), "s long, n long")
        got = seen.orderBy(F.desc("n"), "s").limit(self.common).toArrow()
        return got.column("s").to_numpy()[::-1].copy().view(np.uint64)

    def cards(self, often: np.ndarray) -> DataFrame:
        """(doc_id, text_hash, node, n, small, sig, rare, keys) of every row: rare and keys are the prefix of the set, `keys` what is in `often`; told with the bitmaps, small and full, once a task for equal sets."""
        width, percent = self.width, self.percent
        order = np.argsort(often)
        shared = self.spark.sparkContext.broadcast((often[order], order))  # at most `common` entries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            late_keys, ranks = shared.value
            find, told = Shingler(width), set()

            def prefix(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                p = prefix_size(len(x), percent)
                if not len(late_keys):
                    return x[:p], x[:0]
                at = np.minimum(np.searchsorted(late_keys, x), len(late_keys) - 1)
                late = late_keys[at] == x
                first = x[~late][:p]
                return first, x[late][np.argsort(ranks[at[late]])][: p - len(first)]

            for b in batches:
                out = []
                for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = find.of(raw)
                    if not len(x):
                        out.append((None, 0, *[None] * 4))
                        continue
                    node = node_of(x)
                    if i is None or node in told:
                        out.append((node, len(x), *[None] * 4))
                        continue
                    if len(told) > 200_000:
                        told.clear()
                    told.add(node)
                    rare, keys = prefix(x)
                    out.append((node, len(x), bitmap(x), bitmap(x, FULL), rare.view(np.int64), keys.view(np.int64)))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=["doc_id", "text_hash", "node", "n", "small", "sig", "rare", "keys"])

        return self.src.mapInArrow(few_texts(run), "doc_id long, text_hash long, node long, n long, small binary, sig binary, rare array<long>, keys array<long>")

    def tiles(self, cards: DataFrame) -> DataFrame:
        """(key, node, low, high, size), written: the members of each key that several nodes hold, with its smallest and largest node."""
        s = self.scratch
        rare = cards.where("rare is not null").select(F.explode("rare").alias("key"), "node")
        w = Window.partitionBy("key")  # of keys that the first look did not see often
        few = rare.select("key", "node", F.min("node").over(w).alias("low"), F.max("node").over(w).alias("high"), F.count("*").over(w).alias("size")).where("low <> high")
        often = cards.where("keys is not null").select(F.explode("keys").alias("key"), "node")
        ends = s.table(often.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low <> high"))
        out = s.table(few.unionByName(often.join(ends, "key").select("key", "node", "low", "high", "size")))
        s.drop(ends)
        return out

    def bounded(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (u, v) that sizes and bitmaps leave."""
        percent = self.percent
        a = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("small").alias("su"))
        b = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("small").alias("sv"))
        near = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
        both = pairs.join(a, "u").join(b, "v").where(near).select("u", "v", "nu", "nv", "su", "sv")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                u, v, nu, nv, su, sv = (c.to_pylist() for c in t.columns)
                keep = [may_link(p, q, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), percent) for p, q, x, y in zip(nu, nv, su, sv, strict=True)]
                yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(keep, pa.bool_())), t.column(1).filter(pa.array(keep, pa.bool_()))], names=["u", "v"])

        return both.mapInArrow(lean_rows(run), "u long, v long")

    def texts_of(self, asked: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, raw), written: a text of each node that `asked` names."""
        width = self.width
        reps = self.scratch.table(nodes.join(asked, "node", "left_semi").select("node", F.col("rep").alias("rep_id")))
        few = reps.count() <= SEND_ROWS
        own = self.src.join(F.broadcast(reps) if few else reps, self.src["doc_id"] == reps["rep_id"]).select("node", "raw")

        def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Shingler(width)
            for b in batches:  # rows may repeat an id with another text
                keep = [node_of(find.of(raw)) == node for node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield b.filter(pa.array(keep, pa.bool_()))

        got = self.scratch.table(own.mapInArrow(few_texts(same), "node long, raw binary").dropDuplicates(["node"]))
        self.scratch.drop(reps)
        return got

    def exact(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (u, v), u > v, of a written table that link; written. The text of v comes before its pairs in each block."""
        width, percent, s = self.width, self.percent, self.scratch
        asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        held = self.texts_of(asked, nodes)
        hubs = s.table(pairs.groupBy("v").agg(F.ceil(F.count("*") / HUB).cast("int").alias("blocks")))
        of = pairs.join(hubs, "v").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
        left = of.join(held.withColumnRenamed("node", "u"), "u").select("v", "block", "u", "raw")
        right = hubs.join(held.withColumnRenamed("node", "v"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("u"), "raw")
        dealt = left.unionByName(right).repartition("v", "block").sortWithinPartitions("v", "block", F.col("u").asc_nulls_first())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Shingler(width)
            own, mine = None, None
            for t in batches:
                us, vs = [], []
                for v, block, u, raw in zip(*(c.to_pylist() for c in t.columns), strict=True):
                    if u is None:
                        own, mine = (v, block), find.of(raw)
                    elif own == (v, block) and _links(find.of(raw), mine, percent):
                        us.append(u)
                        vs.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        got = s.table(dealt.mapInArrow(few_texts(run), "u long, v long"))
        for old in (held, hubs, pairs):
            s.drop(old)
        return got

    def mixed(self, shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(key, node, comp) of the tiles that hold several components, and (key, top) with each tile's largest one."""
        known = self.scratch.table(shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp")))
        several = self.scratch.table(known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"))
        rows = self.scratch.table(known.join(several, "key").distinct())
        for old in (known, several):
            self.scratch.drop(old)
        parts = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
        return rows, self.scratch.table(parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top")))

    def towards_top(self, rows: DataFrame, tiles: DataFrame) -> DataFrame:
        """Pairs of each member outside a tile's largest component with one of that component, which varies with the key."""
        rows = rows.join(tiles, "key")
        by = F.xxhash64("node", F.pmod("key", F.lit(PIVOTS)))
        ends = self.scratch.table(rows.where("comp = top").groupBy("key").agg(F.min_by("node", by).alias("end")))
        return rows.where("comp <> top").join(ends, "key").select(F.greatest("node", "end").alias("u"), F.least("node", "end").alias("v")).distinct()

    def crossing(self, rows: DataFrame, tiles: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs of different components that meet in a tile and that bitmaps leave."""
        percent = self.percent
        members = self.scratch.table(rows.join(tiles, "key").select("top", "node", "comp").distinct())
        visits = F.col("comp") != F.col("top")
        chunks = [F.greatest(F.ceil(n / CHUNK), F.lit(1)).cast("int").alias(name) for n, name in ((F.count("*"), "chunks"), (F.count_if(visits), "calls"))]
        band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
        small = self.scratch.table(members.groupBy("top").agg(*chunks))
        # what stands in a tile is joined with its bitmap once; only tiles of more than one chunk are cut and visited
        rows = members.join(small, "top").join(nodes.select("node", "n", "sig"), "node").withColumn("visits", visits)
        keys = ["top", "band", "chunk", "call"]
        cols = [*keys, "node", "comp", "n", "sig", "home", "guest", "visits"]
        one = rows.where("chunks = 1").withColumns({"band": F.lit(0), "chunk": F.lit(0), "call": F.lit(0), "home": F.lit(True), "guest": F.col("visits")})
        cut = rows.where("chunks > 1").withColumns({"band": band, "chunk": F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), "call": F.pmod(F.xxhash64("node", F.lit(1)), F.col("calls")).cast("int")})
        stay = cut.withColumn("call", F.explode(F.sequence(F.lit(0), F.col("calls") - 1))).withColumns({"home": F.lit(True), "guest": F.lit(False)})
        visit = (
            cut.where("visits")
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("at", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
            .withColumns({"band": F.col("at"), "home": F.lit(False), "guest": F.lit(True)})
        )
        dealt = one.select(*cols).unionByName(stay.select(*cols)).unionByName(visit.select(*cols)).repartition(*keys).sortWithinPartitions(*keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[tuple[int, int]] = set()
            rest: pa.Table | None = None

            def places(t: pa.Table) -> np.ndarray:
                at = [t.column(k).to_numpy() for k in range(4)]
                return np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1

            def meet_all(t: pa.Table) -> None:
                cut = places(t)
                node, comp, n = (t.column(k).to_numpy() for k in (4, 5, 6))
                sig = t.column(7).to_pylist()
                home, guest, visits = (t.column(k).to_numpy() for k in (8, 9, 10))
                for a, z in zip([0, *cut], [*cut, len(node)], strict=True):
                    _meet(node[a:z], comp[a:z], n[a:z], sig[a:z], home[a:z], guest[a:z], visits[a:z], percent, found)

            for b in batches:
                if not b.num_rows:
                    continue
                t = pa.Table.from_batches([b])
                if rest is not None:
                    t = pa.concat_tables([rest, t])
                cut = places(t)
                start = int(cut[-1]) if len(cut) else 0
                rest = t.slice(start)
                if start:
                    meet_all(t.slice(0, start))
                if len(found) > 200_000:
                    yield _pairs(found)
                    found.clear()
            if rest is not None:
                meet_all(rest)
            yield _pairs(found)

        return dealt.mapInArrow(lean_rows(run), "u long, v long").distinct()

    def link_counts(self, labels: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, linked): rows of other nodes that a node links with, from (node, label) of all nodes that have a link."""
        percent, width = self.percent, self.width
        members = self.scratch.table(labels.join(nodes.select("node", "n", "copies"), "node"))
        chunks = F.greatest(F.ceil(F.count("*") / LINK_NODES), F.ceil(F.sum("n") / LINK_SHINGLES)).cast("int").alias("chunks")
        band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
        cut = F.col("chunks") > 1
        own = (
            members.join(self.scratch.table(members.groupBy("label").agg(chunks)), "label")
            .withColumns({"band": F.when(cut, band).otherwise(0), "chunk": F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")})
            .withColumn("near", F.when(cut, F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array("band")))
        )
        there = F.struct(F.col("b").alias("band"), F.col("c").alias("chunk"))
        here = F.struct("band", "chunk")
        visits = own.withColumn("b", F.explode("near")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        keys = ["label", "lo", "hi"]
        visits = visits.select("label", F.least(here, there).alias("lo"), F.greatest(here, there).alias("hi"), (here <= there).alias("first"), "node", "copies")
        met = visits.join(self.texts_of(labels.select("node"), nodes), "node")
        dealt = met.repartition(*keys).sortWithinPartitions(*keys).select("label", F.to_json(F.array("lo", "hi")).alias("cell"), (F.col("lo") == F.col("hi")).alias("same"), "first", "node", "copies", "raw")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Shingler(width)
            key, same, rows = None, False, []
            nodes, linked = [], []

            def close() -> None:
                if rows:
                    of = [x[0] for x in rows]
                    first, copies = np.array([x[1] for x in rows]), np.array([x[2] for x in rows], dtype=np.int64)
                    nodes.append(np.array(of, dtype=np.int64))
                    linked.append(_count_links([x[3] for x in rows], first, copies, same, percent))

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (nodes, linked)], names=["node", "linked"])
                nodes.clear()
                linked.clear()
                return out

            for t in batches:
                for label, cell, eq, first, node, copies, raw in zip(*(c.to_pylist() for c in t.columns), strict=True):
                    if (label, cell) != key:
                        close()
                        key, same, rows = (label, cell), eq, []
                    rows.append((node, first, copies, find.of(raw)))
                yield flush()
            close()
            yield flush()

        return dealt.mapInArrow(few_texts(run), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))

    def rows(self, links_too: bool) -> DataFrame:
        """(doc_id, text_hash, node, n, component_id) of every row, and n_links if asked for; those without a set have no node."""
        s = self.scratch
        told = s.table(self.cards(self.often()))
        nodes = told.where("node is not null and doc_id is not null").groupBy("node")
        nodes = s.table(nodes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.max("small").alias("small"), F.max("sig").alias("sig")))
        shared = self.tiles(told)
        cards = s.table(told.select("doc_id", "text_hash", "node", "n"))
        s.drop(told)
        star = F.explode(F.array("low", "high")).alias("end")
        pairs = shared.select("node", star).where("node <> end").select(F.greatest("node", "end").alias("u"), F.least("node", "end").alias("v")).distinct()
        links = self.exact(self.likely(pairs, nodes), nodes)
        # in a tile of up to three members round one has seen every pair; tiles of one component stay so
        rows, tops = self.mixed(shared.where("size > 3").select("key", "node"), s.table(connected_components(links, s)))
        s.drop(shared)
        links = s.table(links.unionByName(self.exact(self.likely(self.towards_top(rows, tops), nodes), nodes)))
        old = rows, tops
        rows, tops = self.mixed(rows.select("key", "node"), s.table(connected_components(links, s)))
        for x in old:
            s.drop(x)
        more = self.exact(s.table(self.crossing(rows, tops, nodes)), nodes)
        for x in (rows, tops):
            s.drop(x)
        labels = s.table(connected_components(links.unionByName(more), s))
        least = s.table(labels.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("component_id")))
        linked = s.table(labels.join(least, "label").select("node", "component_id"))
        whole = s.table(nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")))
        if links_too:
            whole = s.table(whole.join(self.link_counts(labels, nodes), "node", "left").join(nodes.select("node", "copies"), "node").select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        return cards.join(whole, "node", "left")

    def likely(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs that sizes and bitmaps leave, written."""
        asked = self.scratch.table(pairs)
        got = self.scratch.table(self.bounded(asked, nodes))
        self.scratch.drop(asked)
        return got

    def groups(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, n_links) of every row."""
        known = F.col("doc_id").isNotNull()
        return self.rows(links_too=True).select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
            F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        )


def _meet(node: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: list[bytes], home: np.ndarray, guest: np.ndarray, visits: np.ndarray, percent: int, found: set[tuple[int, int]]) -> None:
    """Pairs of guests and members at home in one chunk that components, sizes and bitmaps leave."""
    at_home, guests = np.flatnonzero(home), np.flatnonzero(guest)
    if not len(at_home) or not len(guests):
        return
    h_node, h_comp, h_n, h_visits = node[at_home], comp[at_home], n[at_home], visits[at_home]
    sizes = np.array([len(sig[k]) for k in at_home])
    by_size = {int(w): np.flatnonzero(sizes == w) for w in np.unique(sizes)}
    bits = {w: np.frombuffer(b"".join(sig[at_home[k]] for k in at), np.uint8).reshape(len(at), w) for w, at in by_size.items()}
    for g in guests:
        # of two that visit the smaller looks
        ok = (h_comp != comp[g]) & (100 * np.minimum(h_n, n[g]) >= percent * np.maximum(h_n, n[g])) & (~h_visits | (h_node > node[g]))
        if not ok.any():
            continue
        own = np.frombuffer(sig[g], np.uint8)
        for w, at in by_size.items():
            at_ok = ok[at]
            if not at_ok.any():
                continue
            other, size = bits[w][at_ok], min(w, len(own))
            if w > size:
                other = np.bitwise_or.reduce(other.reshape(len(other), -1, size), axis=1)
            mine, k = folded(own, size), at[at_ok]
            most = np.minimum(n[g] - np.bitwise_count(mine & ~other).sum(axis=1, dtype=np.int64), h_n[k] - np.bitwise_count(other & ~mine).sum(axis=1, dtype=np.int64))
            for j in k[(100 + percent) * most >= percent * (n[g] + h_n[k])]:
                a, b = int(node[g]), int(h_node[j])
                found.add((max(a, b), min(a, b)))


def _count_links(sets: list[np.ndarray], first: np.ndarray, copies: np.ndarray, same: bool, percent: int) -> np.ndarray:
    """Copies that each set links with: all others if the chunk meets itself, else those on the other side."""
    out = np.zeros(len(sets), dtype=np.int64)
    left, right = (np.arange(len(sets)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
    if not len(left) or not len(right):
        return out
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, held = np.repeat(np.arange(len(sets)), sizes), n[col] > 1  # what one set alone holds is in no overlap
    row, col = row[held], (np.cumsum(n > 1) - 1)[col[held]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 4096
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, (at, at + step))
        x = np.zeros((len(sets), min(step, int(col[-1]) + 1 - at)), dtype=np.float32)
        x[row[i:j], col[i:j] - at] = 1
        both += x[left] @ x[right].T
    both = both.astype(np.int64)
    links = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    if same:
        np.fill_diagonal(links, False)
        return links @ copies
    out[left], out[right] = links @ copies[right], copies[left] @ links
    return out


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    got = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["u", "v"])


def join_ngrams(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links (other rows that it links with itself)."""
    return NgramJoin(docs, percent, width, id_col, text_col).groups()


def one_of_each_group(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, one row of each group: that of the smallest doc_id, of rows that share it the one with the smallest text hash.

    Rows are told apart by id and text, so a repeated doc_id loses the row whose text links and keeps one whose text does not.
    Of rows equal in id and text one stays, whatever their other columns hold. Null ids and texts without words link with
    nothing and stay.
    """
    join = NgramJoin(docs, percent, width, id_col, text_col)
    s = join.scratch
    got = s.table(join.rows(links_too=False).where("doc_id is not null and node is not null").groupBy("doc_id", "text_hash", "component_id").agg(F.count("*").alias("n")))
    first = s.table(got.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")))
    stays = F.struct("doc_id", "text_hash") == F.col("first")
    decided = s.table(got.join(first, "component_id").withColumn("stays", stays).where("not stays or n > 1").select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_text"), "stays"))
    gone = (docs[id_col].cast("long") == decided["__gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")) == decided["__gone_text"])
    out = docs.join(decided.hint("shuffle_hash"), gone, "left_anti")
    again = decided.where("stays")  # rows that repeat both id and text: one of each
    if again.isEmpty():
        return out
    # at most one row of a group may come back, and copies of a hot row are folded before they shuffle
    keys = [F.col("__gone_id"), F.col("__gone_text")]
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)])
    one = docs.join(again, gone).select(*keys, row.alias("__row")).groupBy("__gone_id", "__gone_text").agg(F.first("__row").alias("__row"))
    return out.unionAll(one.select(*[F.col(f"__row.c{k}").alias(c) for k, c in enumerate(docs.columns)]))


def brute_force(rows: list[tuple[int, str | None]], percent: int = 80, width: int = 5) -> dict[int, tuple[int, int]]:
    """Plain version, for tests: every pair, with the shingles themselves."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((top(a), top(b)))
                    parent[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}
