"""Benchmark decontamination by pigeonhole edit matching.

Documents and items are put in lower case and every run of white space becomes one blank. An item of m characters has an
error budget of k = m // chars_per_error and is cut into k + 1 pieces: a passage of the document within k edits of the
item holds at least one piece unchanged. Items under ``min_chars`` characters have no budget: they match only as they are,
and not inside a longer word. One Aho-Corasick automaton finds all pieces of a block of items in one scan of
the text. A hit is verified upwards through a binary tree over the item's pieces: a node of n pieces must occur within
n - 1 edits near the hit (some leaf always has a path on which this holds, so nothing is lost), and the root decides with
Myers' bit-parallel distance over Python's wide integers.

The items are a stated query set: they reach the executors in blocks of at most ``block_bytes`` bytes, each block one
narrow pass over whole texts. With one block nothing is shuffled and no text leaves its partition. With several, each pass
writes only its hits by a hash of the text, and these are summed up and joined back; the plan doesn't grow with the blocks.

Defined cases: null or empty texts and items, and items without an id, match nothing; rows that repeat an item_id are one
item, which is listed once with its least distance, however the items fall into blocks; equal items of several ids are
listed each; very long texts are scanned whole; an empty benchmark marks nothing; an empty table gives an empty result;
repeated document rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_texts, filter_texts, texts

OUT = "doc_id long, contaminated boolean, n_items int, item_ids array<long>, min_distance int"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def infix_distance(pattern_bits: dict[str, int], m: int, text: str) -> int:
    """Myers: the least edit distance of the pattern to any substring of text."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    get = pattern_bits.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


def budget(m: int, chars_per_error: int, min_chars: int) -> int:
    """Edits that an item of m characters may have."""
    return m // chars_per_error if m >= min_chars else 0


def _runs_on(a: str, b: str) -> bool:
    """True if two neighbouring characters belong to one word; scripts written without blanks have no such words."""
    return a.isalnum() and b.isalnum() and a < "\u2e80" and b < "\u2e80"


def stands_alone(text: str, start: int, end: int) -> bool:
    """False if text[start:end] is cut out of a longer word."""
    return not (start > 0 and _runs_on(text[start - 1], text[start]) or end < len(text) and _runs_on(text[end - 1], text[end]))


def bits_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Pieces of one block of items, ready to scan."""

    def __init__(self, items: list[tuple[int, str]], chars_per_error: int, min_chars: int = 30):
        import ahocorasick

        self.items, self.min_chars = items, min_chars
        self.automaton = ahocorasick.Automaton()
        self.nodes: dict[tuple[int, int, int], tuple[str, dict[str, int]]] = {}
        self.cuts: list[list[int]] = []
        held: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            n = budget(len(text), chars_per_error, min_chars) + 1
            cut = [len(text) * j // n for j in range(n + 1)]
            self.cuts.append(cut)
            for j in range(n):
                held.setdefault(text[cut[j] : cut[j + 1]], []).append((k, j))
        for piece, at in held.items():
            self.automaton.add_word(piece, (len(piece), at))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def _near(self, k: int, a: int, b: int, text: str, at: int) -> int:
        """Distance of pieces a..b of item k to the text around the place `at` where they should begin."""
        got = self.nodes.get((k, a, b))
        if got is None:
            part = self.items[k][1][self.cuts[k][a] : self.cuts[k][b]]
            got = self.nodes[k, a, b] = (part, bits_of(part))
        part, bits = got
        slack = b - a  # one more than the errors allowed
        return infix_distance(bits, len(part), text[max(0, at - slack) : at + len(part) + slack])

    def _verify(self, k: int, j: int, text: str, start: int) -> int | None:
        """The item's distance if it occurs within its budget around piece j, which begins at start."""
        cut = self.cuts[k]
        n, zero = len(cut) - 1, start - cut[j]
        path, a, b = [], 0, n
        while b - a > 1:
            path.append((a, b))
            mid = (a + b) // 2
            a, b = (a, mid) if j < mid else (mid, b)
        d = 0
        for a, b in reversed(path):
            # earlier pieces may have shifted the place by as many characters as the item has errors
            d = self._near(k, a, b, text, zero + cut[a])
            if d > b - a - 1:
                return None
        return d

    def scan(self, text: str) -> dict[int, int]:
        """item_id -> distance of the items that text holds."""
        found: dict[int, int] = {}
        if self.empty or not text:
            return found
        for end, (size, at) in self.automaton.iter(text):
            for k, j in at:
                item = self.items[k][0]
                if found.get(item) == 0:
                    continue
                if len(self.items[k][1]) < self.min_chars and not stands_alone(text, end - size + 1, end + 1):
                    continue
                d = self._verify(k, j, text, end - size + 1)
                if d is not None and d < found.get(item, d + 1):
                    found[item] = d
        return found


_READY: dict[str, Matcher] = {}


def item_blocks(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most block_bytes bytes of text, streamed; one longer item is a block of its own."""
    rows = benchmark.select(benchmark[id_col].cast("long").alias("i"), benchmark[text_col].cast("string").alias("t")).where(
        F.col("i").isNotNull() & F.col("t").isNotNull()
    )
    block, size = [], 0
    for i, t in rows.toLocalIterator():
        x = normalise(t)
        if not x:
            continue
        if block and size + len(x.encode()) > block_bytes:
            yield block
            block, size = [], 0
        block.append((i, x))
        size += len(x.encode())
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    chars_per_error: int = 20,
    min_chars: int = 30,
    block_bytes: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document row: whether it holds a benchmark item, which ones, and the least distance."""
    src = texts(docs, id_col, text_col)
    first, more = _first_block(benchmark, block_bytes, item_id_col, item_text_col)
    if more is None:
        got = _scan_block(src, first, chars_per_error, min_chars)
    else:
        keyed = _keyed(src)
        hits = _all_hits(keyed, [first], more, chars_per_error, min_chars)
        merged = hits.groupBy("h1", "h2", "item").agg(F.min("distance").alias("distance")).groupBy("h1", "h2")
        merged = merged.agg(F.map_from_entries(F.collect_list(F.struct("item", "distance"))).alias("hits"))  # at most the benchmark's ids
        got = keyed.drop("raw").join(merged, ["h1", "h2"], "left").select("doc_id", "hits")
    ids = F.sort_array(F.coalesce(F.map_keys("hits"), F.array().cast("array<long>")))
    return got.select(
        "doc_id",
        (F.coalesce(F.size(F.map_keys("hits")), F.lit(0)) > 0).alias("contaminated"),
        F.size(ids).alias("n_items"),
        ids.alias("item_ids"),
        F.array_min(F.map_values("hits")).alias("min_distance"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    chars_per_error: int = 20,
    min_chars: int = 30,
    block_bytes: int = 4 << 20,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """docs, all columns as they are, without the rows that find_contamination() marks."""
    first, more = _first_block(benchmark, block_bytes, item_id_col, item_text_col)
    if more is None:
        return filter_texts(docs, _keeper(docs, first, chars_per_error, min_chars), text_col)
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    keyed = _keyed(docs.select(raw.alias("raw")))
    hits = _all_hits(keyed, [first], more, chars_per_error, min_chars).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct()
    return docs.join(hits, (F.xxhash64(raw) == hits["__h1"]) & (F.xxhash64(raw, F.lit(1)) == hits["__h2"]), "left_anti")


def _keyed(src: DataFrame) -> DataFrame:
    """src with 128 bits by which its text (raw) is known."""
    return src.withColumns({"h1": F.xxhash64("raw"), "h2": F.xxhash64("raw", F.lit(1))})


def _first_block(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str) -> tuple[list[tuple[int, str]], Iterator[list[tuple[int, str]]] | None]:
    """The first block (perhaps empty), and the rest if there is more than one."""
    blocks = item_blocks(benchmark, block_bytes, id_col, text_col)
    first, second = next(blocks, []), next(blocks, None)
    return first, None if second is None else itertools.chain([second], blocks)


def _all_hits(keyed: DataFrame, first: list, more: Iterator[list[tuple[int, str]]], chars_per_error: int, min_chars: int) -> DataFrame:
    """(h1, h2, item, distance) of all blocks, one written pass a block: few rows, and one automaton at a time."""
    scratch = Scratch(keyed.sparkSession)
    out = None
    for block in itertools.chain(first, more):
        got = scratch.table(_scan_block(keyed.select("h1", "raw", "h2"), block, chars_per_error, min_chars, True))
        out = got if out is None else scratch.table(out.unionByName(got).distinct())
    return out


def _keeper(docs: DataFrame, block: list[tuple[int, str]], chars_per_error: int, min_chars: int) -> Callable[[], Callable[[list[bytes]], list[bool]]]:
    shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def keep() -> Callable[[list[bytes]], list[bool]]:
        m = _matcher(key, shared.value, chars_per_error, min_chars)
        return lambda raws: [not m.scan(normalise(raw.decode("utf-8", "replace"))) for raw in raws]

    return keep


def _matcher(key: str, block: list[tuple[int, str]], chars_per_error: int, min_chars: int) -> Matcher:
    """The block's matcher, made once a worker."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = Matcher(block, chars_per_error, min_chars)
    return _READY[key]


def _scan_block(src: DataFrame, block: list[tuple[int, str]], chars_per_error: int, min_chars: int, flat: bool = False) -> DataFrame:
    """(doc_id, hits) of every row (doc_id, raw); or, flat, (h1, h2, item, distance) of each hit in rows (h1, raw, h2)."""
    shared = src.sparkSession.sparkContext.broadcast(block)  # at most block_bytes
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, shared.value, chars_per_error, min_chars)
        for b in batches:
            found = [m.scan(normalise(raw.decode("utf-8", "replace"))) for raw in b.column(1).to_pylist()]
            if not flat:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x.items()) or None for x in found], pa.map_(pa.int64(), pa.int32()))], names=["doc_id", "hits"])
                continue
            at = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
            items = [pa.array([y[j] for x in found for y in x.items()], t) for j, t in enumerate((pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), *items], names=["h1", "h2", "item", "distance"])

    return src.mapInArrow(few_texts(run), "h1 long, h2 long, item long, distance int" if flat else "doc_id long, hits map<long,int>")


def brute_force(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], chars_per_error: int = 20, min_chars: int = 30) -> dict[int, list[int]]:
    """Plain version, for tests: the whole dynamic programme of every item over every text."""
    out = {}
    for i, t in rows:
        text, got = normalise(t or ""), []
        for k, item in items:
            p = normalise(item or "")
            if k is None or not p:
                continue
            if len(p) < min_chars:
                if any(text.startswith(p, at) and stands_alone(text, at, at + len(p)) for at in range(len(text))):
                    got.append(k)
                continue
            row = list(range(len(p) + 1))
            best = row[-1]
            for c in text:
                new = [0]
                for j, q in enumerate(p):
                    new.append(min(row[j] + (q != c), row[j + 1] + 1, new[j] + 1))
                row = new
                best = min(best, row[-1])
            if best <= budget(len(p), chars_per_error, min_chars):
                got.append(k)
        out[i] = sorted(set(got))
    return out
