"""Language-model scoring with Brown class-based bigrams.

Tokens are words of the text with A-Z in lower case, then one end token. The model learns from rows outside fold 0 of
``folds`` (crc32 of the id as text).

1. One pass over the texts writes them as blocks: a list of the 64-bit hashes of a block's distinct words, and for each token
   its place in that list. All later steps read blocks, with arrays; no text is cut into words again.
2. All training tokens are counted and summed by hash; nothing is left out.
3. Core words are those seen ``min_count`` times or more and the ``head`` most frequent ones: their number grows with the
   corpus. Word bigrams of the core are counted over all training tokens; the rest stand in them as one open class.
4. Exchange clustering. The head is clustered on the driver; the other core words join the class that gains most, and then
   move, some of them a round, while the class-bigram likelihood grows. A round is one pass over the words' neighbour lists.
5. Every other training word goes to the class that gains most by the classes of its own neighbours (one distributed pass).
   No word gets its class from its spelling.
6. P(w | previous) = 0.9 P(class | class before) P(w | class) + 0.1 P(w): transitions are counted over all training tokens
   and smoothed towards the class unigram, emissions by adding ``add`` to each known word and to one unknown word a class;
   a word never seen stands in the class with the most words seen once. P(w) is the base model.

Counts of words stay distributed: each block asks each part of the vocabulary for the counts and classes of its distinct words,
gets them in the order of its question, and is scored beside them. Blocks hold about ``block_bytes`` bytes of whole texts, whatever ids or texts repeat, so there is no
hot group. Counts are summed up within a task before they shuffle, and those of the head's bigrams are dealt by both words.
Of the vocabulary only the core meets in one place, as a hash and a class a word; bigrams and texts never do.

Defined cases: null and empty texts are one end token; a null id counts as fold 0, so it is scored and not learned from;
a very long text is a block of its own, scored whole; repeated rows are learned and scored each time; words that tie join
the class with the lower number; without training rows all counts are 0 and the base score is 0 (one unknown word holds all
probability); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_of, hash_words, lean, lean_rows, py_fold, texts

END = b""  # no word is empty
OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"
BLOCKS = "block long, doc_ids array<long>, lens binary, hashes binary, ids binary"
PART_TOKENS = 1_000_000  # tokens whose counts meet in one part
HELD = 800_000  # counts that a task holds before it sums them up
ROWS = 200  # texts that stand in a worker as Python objects


@dataclass
class ClassModel:
    unknown: int  # class of words never seen
    class_total: np.ndarray  # tokens of the class
    class_types: np.ndarray  # distinct words of the class
    transition: np.ndarray  # P(class | class before)
    tokens: int
    types: int
    add: float
    mix: float


def _find(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return at, sorted_keys[at] == x


_END_HASH = int(hash_words([END]).view(np.int64)[0])


def squeeze(x: np.ndarray) -> bytes:
    """An array of whole numbers, byte plane by byte plane, compressed."""
    head = f"{len(x)} {x.dtype.str} ".encode()
    return head + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else head


def unsqueeze(raw: bytes) -> np.ndarray:
    n, kind, data = raw.split(b" ", 2)
    n, kind = int(n), np.dtype(kind.decode())
    if not n:
        return np.zeros(0, kind)
    flat = pa.decompress(data, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


@dataclass
class Block:
    """Texts as places in the list of their distinct words; place 0 is the end token, which closes each text."""

    block: int
    doc_ids: list[int | None]
    lens: np.ndarray  # tokens of each text, the end token included
    hashes: np.ndarray
    ids: np.ndarray

    def learned(self, folds: int) -> np.ndarray:
        """The tokens of rows to learn from, after one end token."""
        train = np.array([py_fold(i, folds) != 0 for i in self.doc_ids], dtype=bool)
        return np.concatenate([[0], self.ids[np.repeat(train, self.lens)]]) if train.any() else np.zeros(0, np.int64)


def encode(src: DataFrame, block_bytes: int) -> DataFrame:
    """The rows (doc_id, raw) as blocks of about block_bytes bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        places: defaultdict[bytes, int] = defaultdict()
        places.default_factory = places.__len__
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lens = np.array([len(x) for x in ids], dtype=np.int64)
            row = [pa.array([(part << 32) + n]), pa.array([doc_ids], pa.list_(pa.int64()))]
            row += [pa.array([x], pa.binary()) for x in (squeeze(lens), hash_words(list(places)).tobytes(), squeeze(np.concatenate(ids)))]
            doc_ids.clear()
            ids.clear()
            places.clear()
            return pa.RecordBatch.from_arrays(row, names=["block", "doc_ids", "lens", "hashes", "ids"])

        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not places:
                    places[END]  # noqa: B018  its place is 0
                tokens = raw.lower().split()
                x = np.zeros(len(tokens) + 1, dtype=np.int32)
                x[:-1] = np.fromiter(map(places.__getitem__, tokens), dtype=np.int32, count=len(tokens))
                doc_ids.append(i)
                ids.append(x)
                size += len(raw) + 1
                if size >= block_bytes:
                    yield flush()
                    n, size = n + 1, 0
        if ids:
            yield flush()

    return src.mapInArrow(lean_rows(run), BLOCKS)


def _decoded(block: int, doc_ids: list, lens: bytes, hashes: bytes, ids: bytes) -> Block:
    return Block(block, doc_ids, unsqueeze(lens), np.frombuffer(hashes, np.int64), unsqueeze(ids))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield _decoded(*(c[k].as_py() for c in b.columns))


def word_counts(blocks: DataFrame, folds: int) -> DataFrame:
    """(h, n): training tokens by word hash, the end token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            n = np.bincount(x.learned(folds)[1:], minlength=len(x.hashes))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(x.hashes[at]), pa.array(n[at])], names=["h", "n"])

    return blocks.mapInArrow(lean_rows(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _units(x: Block, folds: int, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, units) of the training tokens. Unit 0 is the end, then the core words; len(core) + 1 is any other word."""
    at, hit = _find(core, x.hashes)
    unit = np.where(hit, at + 1, len(core) + 1)
    unit[0] = 0
    p = x.learned(folds)
    return p, unit[p]


def _starts(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = _starts(key)
    return key[at], np.add.reduceat(n, at) if len(n) else n


def _deal(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for each number."""
    with np.errstate(over="ignore"):
        h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _packs(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row a part: its entries of all columns, squeezed."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    at = _starts(part)
    ends = [*at[1:], len(part)]
    rows = [pa.array([squeeze(c[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int64()), *rows], names=["part", *"xyz"[: len(rows)]])


def _unpacked(t: pa.Table) -> list[np.ndarray]:
    """The columns of one part's packs, end to end."""
    return [np.concatenate([unsqueeze(x) for x in t.column(c).to_pylist()]) for c in t.column_names[1:]]


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Values cut at the places `at`, as a binary column."""
    ends = np.append(at, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    col = col.cast(pa.binary())
    if not len(col):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
    return data, np.diff(ends) // data.itemsize


def neighbours(blocks: DataFrame, scratch: Scratch, folds: int, core: np.ndarray, seeds: np.ndarray, parts: int) -> DataFrame:
    """(w, others, counts, head), written: of each core word the units after it, and those before it plus the number of units.

    The end and the open words have lists as well, of each other only, so that every bigram stands in some list. Counts are
    summed within a task; a word's lie in the part of the word, and those of the head, each of which may hold a third of
    all tokens, in parts by both words.
    """
    size = len(core) + 2
    shared = blocks.sparkSession.sparkContext.broadcast((core, seeds))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, seeds = shared.value
        cells: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cell, n = _summed(cells, counts)
            cells.clear()
            counts.clear()
            a, b = cell // size, cell % size
            inside = [(x > 0) & (x < size - 1) for x in (a, b)]
            rest = ~inside[0] & ~inside[1]
            w = np.concatenate([a[inside[0]], b[inside[1]], a[rest]])
            o = np.concatenate([b[inside[0]], a[inside[1]] + size, b[rest]])
            split = np.isin(w, seeds) | (w == 0) | (w == size - 1)
            return _packs(_deal(np.where(split, w * (2 * size) + o, w), parts), w.astype(np.int32), o.astype(np.int32), np.concatenate([n[inside[0]], n[inside[1]], n[rest]]))

        for x in _blocks(batches):
            _, u = _units(x, folds, core)
            if len(u):
                cell, n = np.unique(u[:-1].astype(np.int64) * size + u[1:], return_counts=True)
                cells.append(cell)
                counts.append(n)
            if sum(map(len, cells)) > HELD:
                cell, n = _summed(cells, counts)
                cells[:], counts[:] = [cell], [n]
                if len(cell) > HELD // 2:
                    yield flush()
        if cells:
            yield flush()

    def lists(t: pa.Table) -> pa.Table:
        w, o, n = _unpacked(t)
        key, n = _summed([w.astype(np.int64) * (2 * size) + o], [n])
        w = key // (2 * size)
        at = _starts(w)
        head = np.isin(w[at], shared.value[1]) | (w[at] == 0) | (w[at] == size - 1)
        return pa.table({"w": pa.array(w[at].astype(np.int32)), "others": _binary((key % (2 * size)).astype(np.int32), at), "counts": _binary(n.astype(np.int64), at), "head": head})

    out = "w int, others binary, counts binary, head boolean"
    got = scratch.table(blocks.mapInArrow(lean_rows(pairs), "part long, x binary, y binary, z binary").groupBy("part").applyInArrow(lambda t: lean(lists, t), out))
    empty = F.lit(b"").cast("binary")
    joined = lambda c: F.aggregate("all", empty, lambda a, x: F.concat(a, x[c])).alias(c)
    of = [joined(c) for c in ("others", "counts")]
    head = got.where("head").groupBy("w").agg(F.collect_list(F.struct("others", "counts")).alias("all")).select("w", *of, F.lit(True).alias("head"))
    return got.where("not head").unionByName(scratch.table(head))


def _xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1.0))


def likelihood(n: np.ndarray) -> float:
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=0)).sum() - _xlogx(n.sum(axis=1)).sum())


def join_gains(n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """gain[w, class] of adding each word's counts after (left) and before (right) the classes to that class of the table n."""
    out = np.zeros(left.shape)
    for x, table in ((left, n), (right, n.T)):
        f0, one = _xlogx(table), _xlogx(table + 1) - _xlogx(table)
        w, c = np.nonzero(x)
        if not len(w):
            continue
        v = x[w, c]
        add = one[c]
        more = np.flatnonzero(v > 1)
        add[more] = _xlogx(table[c[more]] + v[more, None]) - f0[c[more]]
        at = _starts(w)
        out[w[at]] += np.add.reduceat(add, at, axis=0)
        total = table.sum(axis=0)
        out -= _xlogx(total[None, :] + x.sum(axis=1)[:, None]) - _xlogx(total)[None, :]
    return out


def _closed(n: np.ndarray) -> np.ndarray:
    """Classes that open words cannot join: the end's, the open one, and empty ones, which all would join at once."""
    closed = n.sum(axis=0) == 0
    closed[[0, -1]] = True
    if closed.all():
        closed[1] = False
    return closed


def move_gains(n: np.ndarray, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
    """gain[class] of adding one word, whose counts n does not hold, to each class."""
    fn = _xlogx(n)
    gain_row = _xlogx(n + right[None, :]) - fn
    gain_col = (_xlogx(n + left[:, None]) - fn).T
    diag = np.diag(n)
    gain = gain_row.sum(axis=1) - np.diag(gain_row) + gain_col.sum(axis=1) - np.diag(gain_col) + _xlogx(diag + right + left + own) - _xlogx(diag)
    rows, cols = n.sum(axis=1), n.sum(axis=0)
    return gain - (_xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols))


def exchange(counts: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each unit: the exchange algorithm on the class-bigram likelihood. Unit 0, the end, keeps class 0 for itself."""
    n_units = len(counts)
    classes = max(2, min(classes, n_units))
    freq = counts.sum(axis=0)
    order = np.argsort(-freq[1:], kind="stable") + 1
    cls = np.zeros(n_units, dtype=np.int64)
    cls[order] = 1 + np.arange(len(order)) % (classes - 1)
    x = counts.astype(float)
    one = np.zeros((n_units, classes))
    one[np.arange(n_units), cls] = 1
    n = one.T @ x @ one
    for _ in range(rounds):
        moved = 0
        for u in order:
            a = cls[u]
            own = x[u, u]
            right = np.bincount(cls, weights=x[u], minlength=classes)
            left = np.bincount(cls, weights=x[:, u], minlength=classes)
            right[a] -= own
            left[a] -= own
            if not right.sum() + left.sum() + own:
                continue
            n[a, :] -= right
            n[:, a] -= left
            n[a, a] -= own
            gain = move_gains(n, right, left, own)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[u] = b
            n[b, :] += right
            n[:, b] += left
            n[b, b] += own
        if not moved:
            break
    return cls


def many_move_gains(n: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, a: np.ndarray) -> np.ndarray:
    """gain[word, class] of each word's place in each class, out of its class a[word], on its own.

    right and left hold a row of class counts a word, own its counts after itself, which those do not hold. This is
    move_gains() of each word on n without that word's counts, at the cost of the word's own neighbour classes.
    """
    words, r = len(a), np.arange(len(a))
    out = np.zeros((words, len(n)))
    for x, table, other in ((right, n, left), (left, n.T, right)):
        f = _xlogx(table)
        i, c = np.nonzero(x)
        v = x[i, c]
        far = c != a[i]
        i2, c2, v2 = i[far], c[far], v[far]
        add = _xlogx(table.T[c2] + v2[:, None]) - f.T[c2]
        k = np.arange(len(c2))
        add[k, c2] = 0  # on the diagonal, below
        mine = table[a[i2], c2]
        add[k, a[i2]] = _xlogx(mine) - _xlogx(mine - v2)
        if len(i2):
            at = _starts(i2)
            out[i2[at]] += np.add.reduceat(add, at, axis=0)
        i2, v2 = i[~far], v[~far]  # the word's own class has lost what the word had on its other side
        if len(i2):
            base = table.T[a[i2]] - other[i2]
            add = _xlogx(base + v2[:, None]) - _xlogx(base)
            add[np.arange(len(i2)), a[i2]] = 0
            out[i2] += add
    own = own[:, None]
    base = np.repeat(np.diag(n)[None, :], words, axis=0)
    base[r, a] -= right[r, a] + left[r, a] + own[:, 0]
    out += _xlogx(base + right + left + own) - _xlogx(base)
    for x, other, total in ((right, left, n.sum(axis=1)), (left, right, n.sum(axis=0))):
        more = x.sum(axis=1, keepdims=True) + own
        base = total[None, :] - other
        base[r, a] -= more[:, 0]
        out -= _xlogx(base + more) - _xlogx(base)
    return out


def class_table(lists: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    """n[class before, class] over all bigrams of units."""
    shared, size = lists.sparkSession.sparkContext.broadcast(cls), len(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cls = np.zeros(classes * classes), shared.value.astype(np.int64)
        for b in batches:
            o, per = _flat(b.column(1), np.int32)
            n, _ = _flat(b.column(2), np.int64)
            k = np.repeat(cls[b.column(0).to_numpy()], per)
            after = o < size
            # pairs of two core words stand in the lists of both
            first = ~after & ((o == size) | (o == 2 * size - 1))
            total += np.bincount(k[after] * classes + cls[o[after]], weights=n[after], minlength=classes * classes)
            total += np.bincount(cls[o[first] - size] * classes + k[first], weights=n[first], minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["cell", "n"])

    return _square(lists.select("w", "others", "counts").mapInArrow(lean_rows(run), "cell long, n long"), classes)


def _square(cells: DataFrame, classes: int) -> np.ndarray:
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(classes, classes)


def among(lists: DataFrame, units: np.ndarray, size: int) -> np.ndarray:
    """Counts of the given units (the first is the end) one after another; at most as many as the head's square."""
    shared = lists.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        for b in batches:
            o, per = _flat(b.column(1), np.int32)
            n, _ = _flat(b.column(2), np.int64)
            w = np.repeat(b.column(0).to_numpy(), per)
            after = (o < size) & np.isin(o, units)
            first = o == size
            x, y = np.concatenate([w[after], np.zeros(first.sum(), np.int32)]), np.concatenate([o[after], w[first]])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.concatenate([n[after], n[first]]))], names=["a", "b", "n"])

    got = lists.where("head").where(F.col("w") < size - 1).select("w", "others", "counts").mapInArrow(lean_rows(run), "a int, b int, n long").toArrow()
    out = np.zeros((len(units), len(units)))
    out[np.searchsorted(units, got.column("a").to_numpy()), np.searchsorted(units, got.column("b").to_numpy())] = got.column("n").to_numpy()
    return out


def moves(lists: DataFrame, cls: np.ndarray, n: np.ndarray, turn: int, parts: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Words and their new classes, each judged by itself against n. Open words all join a class; of the others one in ``parts`` has its turn."""
    classes, size = len(n), len(cls)
    shared = lists.sparkSession.sparkContext.broadcast((cls, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, n = shared.value
        cls = cls.astype(np.int64)
        closed = _closed(n)
        for b in batches:
            w = b.column(0).to_numpy()
            turns = (w > 0) & (w < size - 1) & ((cls[w] == classes - 1) | ((w.astype(np.int64) * 2654435761 >> 7) % parts == turn % parts))
            b = b.filter(pa.array(turns))
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                w = part.column(0).to_numpy()
                o, per = _flat(part.column(1), np.int32)
                c, _ = _flat(part.column(2), np.int64)
                row, a = np.repeat(np.arange(len(w)), per), cls[w]
                after = o < size
                own = np.bincount(row, weights=np.where(o == w[row], c, 0), minlength=len(w))
                right, left = (
                    np.bincount(row[side] * classes + cls[o[side] - shift], weights=c[side], minlength=len(w) * classes).reshape(len(w), classes) for side, shift in ((after, 0), (~after, size))
                )
                r = np.arange(len(w))
                right[r, a] -= own
                left[r, a] -= own
                gain = many_move_gains(n, right, left, own, a)
                is_open = a == classes - 1
                gain[np.ix_(is_open, closed)] = -np.inf
                gain[np.ix_(~is_open, [0, classes - 1])] = -np.inf
                k = np.argmax(gain, axis=1)
                keep = is_open | (gain[r, k] > np.where(is_open, 0, gain[r, a]) + 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(w[keep]), pa.array(k[keep].astype(np.int32))], names=["w", "k"])

    got = lists.select("w", "others", "counts").mapInArrow(lean_rows(run), "w int, k int").toArrow()
    return got.column("w").to_numpy(), got.column("k").to_numpy()


def cluster_core(lists: DataFrame, seeds: np.ndarray, size: int, classes: int, rounds: int = 8, parts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Classes of units and n[class before, class]; 0 is the end's class, the last one that of all words outside the core."""
    cls = np.full(size, classes, dtype=np.int16)
    cls[0] = 0
    if not len(seeds):
        return cls, class_table(lists, cls, classes + 1)
    units = np.concatenate([[0], np.sort(seeds)])
    cls[units] = exchange(among(lists, units, size), classes)
    n = class_table(lists, cls, classes + 1)
    best = (-np.inf, cls, n)
    still = 0
    for turn in range(-1, rounds):
        w, k = moves(lists, cls, n, turn, parts)
        still = 0 if len(w) else still + 1
        if still == parts:
            break
        cls = cls.copy()
        cls[w] = k
        n = class_table(lists, cls, classes + 1)
        if likelihood(n) > best[0]:
            best = (likelihood(n), cls, n)
    return best[1], best[2]


def other_words(blocks: DataFrame, scratch: Scratch, folds: int, core: np.ndarray, cls: np.ndarray, n: np.ndarray, parts: int, step: int = 8_000) -> tuple[DataFrame, np.ndarray]:
    """(h, n, cls) of the words outside the core, and n[class before, class] of all bigrams that hold one of them.

    Such a word has fewer than `min_count` tokens, so that parts by the hash of the word are even.
    """
    classes = len(n)
    shared = blocks.sparkSession.sparkContext.broadcast((core, cls, n))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes before and after each token, two bytes in the order of the words' hashes."""
        core, cls, _ = shared.value
        for x in _blocks(batches):
            p, u = _units(x, folds, core)
            k = cls[u].astype(np.uint16)
            at = np.flatnonzero(u == len(core) + 1)
            if len(at):
                # each text begins after the end token of the one before it, which has the same class as its own
                h = x.hashes[p[at]]
                order = np.argsort(h, kind="stable")
                yield _packs(_deal(h[order].view(np.uint64), parts), h[order], (k[at - 1] * 256 + k[at + 1])[order])

    def assign(t: pa.Table) -> pa.Table:
        n = shared.value[2]
        closed = _closed(n)
        total = np.zeros((classes, classes), dtype=np.int64)
        h, near = _unpacked(t)
        order = np.argsort(h, kind="stable")
        h, near = h[order], near[order].astype(np.int64)
        at = _starts(h)
        ends, out = np.append(at, len(h)), []
        for i in range(0, len(at), step):
            j = min(i + step, len(at))
            word, pair = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), near[ends[i] : ends[j]]
            left, right = (np.bincount(word * classes + y, minlength=(j - i) * classes).reshape(-1, classes) for y in (pair >> 8, pair & 255))
            gain = join_gains(n, left, right)
            gain[:, closed] = -np.inf
            k = np.argmax(gain, axis=1)
            np.add.at(total.T, k, left)
            np.add.at(total, k, right)
            out.append(k)
        total[-1, :] = total[:, -1] = 0  # neighbours outside the core are counted below
        cell = np.flatnonzero(total)
        words = pa.table({"h": pa.array(h[at]), "n": pa.array(np.diff(ends).astype(np.int64)), "cls": pa.array(np.concatenate(out).astype(np.int32)), "cell": pa.nulls(len(at), pa.int64())})
        cells = pa.table({"h": pa.nulls(len(cell), pa.int64()), "n": pa.array(total.ravel()[cell]), "cls": pa.nulls(len(cell), pa.int32()), "cell": pa.array(cell)})
        return pa.concat_tables([words, cells])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of words that are both outside the core."""
        core = shared.value[0]
        for x in _blocks(batches):
            p, u = _units(x, folds, core)
            out = u == len(core) + 1
            at = np.flatnonzero(out[:-1] & out[1:])
            yield pa.RecordBatch.from_arrays([pa.array(x.hashes[p[at]]), pa.array(x.hashes[p[at + 1]])], names=["h", "then"])

    near = blocks.mapInArrow(lean_rows(contexts), "part long, x binary, y binary")
    got = scratch.table(near.groupBy("part").applyInArrow(lambda t: lean(assign, t), "h long, n long, cls int, cell long"))
    words = got.where("h is not null").select("h", "n", "cls")
    first = blocks.mapInArrow(lean_rows(pairs), "h long, then long").join(words.select("h", F.col("cls").alias("a")), "h").select("a", F.col("then").alias("h"))
    both = first.groupBy("a", "h").agg(F.count("*").alias("n")).join(words.select("h", F.col("cls").alias("b")), "h")
    cells = both.select((F.col("a") * classes + F.col("b")).cast("long").alias("cell"), "n")
    return words, _square(got.where("cell is not null").select("cell", "n").unionByName(cells), classes)


def fit(src: DataFrame, scratch: Scratch, folds: int, head: int, min_count: int, classes: int, add: float, mix: float) -> tuple[ClassModel, DataFrame]:
    """learn() from rows (doc_id, raw)."""
    return learn(scratch.table(encode(src, 8 << 20)), scratch, folds, head, min_count, classes, add, mix)


def learn(blocks: DataFrame, scratch: Scratch, folds: int, head: int, min_count: int, classes: int, add: float, mix: float) -> tuple[ClassModel, DataFrame]:
    """The model (bounded by the number of classes) and (h, n, cls) of every training word, distributed."""
    counts = scratch.table(word_counts(blocks, folds))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    parts = int(max(8, -(-whole["n"] // PART_TOKENS)))
    end = counts.where(F.col("h") == _END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    words = counts.where(F.col("h") != _END_HASH)
    top = words.orderBy(F.desc("n"), "h").limit(head).toArrow()
    most = words.where(F.col("n") >= min_count).toArrow()
    scratch.drop(counts)
    known = dict(zip([*top.column("h").to_pylist(), *most.column("h").to_pylist()], [*top.column("n").to_pylist(), *most.column("n").to_pylist()], strict=True))
    core = np.array(sorted(known), dtype=np.int64)
    seeds = np.searchsorted(core, np.sort(top.column("h").to_numpy())) + 1
    lists = neighbours(blocks, scratch, folds, core, seeds, parts)
    cls, n = cluster_core(lists, seeds, len(core) + 2, classes)
    others, pair = other_words(blocks, scratch, folds, core, cls, n, parts)
    n[-1, :] = n[:, -1] = 0
    pair = (pair + n)[:classes, :classes]
    table = pa.table({
        "h": np.append(core, _END_HASH),
        "n": np.array([*(known[h] for h in core.tolist()), end], dtype=np.int64),
        "cls": np.append(cls[1:-1], 0).astype(np.int32),
    })
    words = others.unionByName(blocks.sparkSession.createDataFrame(table).where("n > 0"))
    by_class = {r["cls"]: r for r in words.groupBy("cls").agg(F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).collect()}
    types, once = (np.array([by_class[k][c] if k in by_class else 0 for k in range(classes)], dtype=float) for c in ("v", "once"))
    uni = (pair.sum(axis=0) + 0.5) / (pair.sum() + 0.5 * classes)
    alpha = 5.0
    transition = (pair + alpha * uni) / (pair.sum(axis=1, keepdims=True) + alpha)
    model = ClassModel(1 + int(np.argmax(once[1:])), pair.sum(axis=0), types, transition, int(whole["n"]), int(whole["v"]), add, mix)
    return model, words


def score_documents(
    docs: DataFrame,
    folds: int = 10,
    head: int = 300,
    min_count: int = 50,
    classes: int = 48,
    add: float = 0.1,
    mix: float = 0.9,
    block_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, ClassModel]:
    """(doc_id, n_tokens, n_known, base_score, score) of every row, and the model."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    blocks = scratch.table(encode(texts(docs, id_col, text_col), block_bytes))
    model, counts = learn(blocks, scratch, folds, head, min_count, classes, add, mix)

    parts = int(max(8, -(-model.tokens // PART_TOKENS)))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(hashes, np.int64)
                part = _deal(h, parts)
                order = np.argsort(part, kind="stable")
                at = _starts(part[order])
                yield pa.RecordBatch.from_arrays([pa.array(part[order][at]), pa.array(np.full(len(at), block)), _binary(h[order], at)], names=["part", "block", "hashes"])

    def answer(asked: pa.Table, words: pa.Table) -> pa.Table:
        known = words.column("h").to_numpy()
        order = np.argsort(known)
        known, n, cls = known[order], words.column("n").to_numpy()[order], words.column("cls").to_numpy()[order]
        out: list[list] = [[], []]
        for hashes in asked.column("hashes").to_pylist():
            at, hit = _find(known, np.frombuffer(hashes, np.int64))
            out[0].append(squeeze(np.where(hit, n[at], 0) if len(n) else np.zeros(len(at), np.int64)))
            out[1].append(squeeze((np.where(hit, cls[at], 0) if len(n) else np.zeros(len(at))).astype(np.uint8)))
        return pa.table([asked.column("block"), asked.column("part"), *(pa.array(x, pa.binary()) for x in out)], names=["block", "part", "n", "cls"])

    asked = blocks.select("block", "hashes").mapInArrow(lean_rows(asks), "part long, block long, hashes binary").groupBy("part")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_deal(b.column(0).to_numpy(), parts)), *b.columns], names=["part", "h", "n", "cls"])

    words = counts.select("h", "n", "cls").mapInArrow(dealt, "part long, h long, n long, cls int").groupBy("part")
    answers = asked.cogroup(words).applyInArrow(lambda x, y: lean(answer, x, y), "block long, part long, n binary, cls binary")
    shared = spark.sparkContext.broadcast(model)  # bounded by the number of classes

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        x = _decoded(*(left.column(c)[0].as_py() for c in left.column_names))
        c, cls = np.zeros(len(x.hashes), np.int64), np.zeros(len(x.hashes), np.int64)
        order = np.argsort(_deal(x.hashes, parts), kind="stable")
        at = np.append(_starts(_deal(x.hashes, parts)[order]), len(order))
        said = sorted(zip(right.column("part").to_pylist(), right.column("n").to_pylist(), right.column("cls").to_pylist(), strict=True))
        for k, (_, n, k_cls) in enumerate(said):  # a row a part, in the order in which the block asked
            c[order[at[k] : at[k + 1]]], cls[order[at[k] : at[k + 1]]] = unsqueeze(n), unsqueeze(k_cls)
        base = (c + 0.1) / (m.tokens + 0.1 * (m.types + 1))
        cls = np.where(c > 0, cls, m.unknown)
        cls[0] = 0
        emit = (c + m.add) / (m.class_total[cls] + m.add * (m.class_types[cls] + 1))
        emit[0] = 1.0  # the end has its class for itself
        log_base, known = np.log10(base), c > 0
        last = np.cumsum(x.lens)
        out: list[list] = [[], [], []]
        for i, j in zip(last - x.lens, last, strict=True):
            ids = x.ids[i:j]
            k = cls[ids]
            before = np.concatenate([cls[:1], k[:-1]])
            p = m.mix * m.transition[before, k] * emit[ids] + (1 - m.mix) * base[ids]
            for to, v in zip(out, (int(known[ids].sum()), float(log_base[ids].sum()), float(np.log10(p).sum())), strict=True):
                to.append(v)
        return pa.table({
            "doc_id": pa.array(x.doc_ids, pa.int64()),
            "n_tokens": pa.array(x.lens, pa.int64()),
            "n_known": pa.array(out[0], pa.int64()),
            "base_score": pa.array(out[1], pa.float64()),
            "score": pa.array(out[2], pa.float64()),
        })

    got = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: lean(score, x, y), OUT)
    return got, model


def class_lm_digest(docs: DataFrame) -> DataFrame:
    got, model = score_documents(docs)
    return got.select(
        "doc_id",
        (fold_of(F.col("doc_id"), 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def plain_scores(rows: list[tuple[int | None, str | None]], words: dict[int, tuple[int, int]], folds: int = 10, classes: int = 48, add: float = 0.1, mix: float = 0.9) -> list[float]:
    """Scores by the definition, for tests, with the (count, class) of each known word hash."""
    token = lambda t: (t or "").encode().lower().split() + [END]
    key = lambda w: int(hash_words([w]).view(np.int64)[0])
    train = [token(t) for i, t in rows if py_fold(i, folds)]
    pair = np.zeros((classes, classes))
    for ws in train:
        k = [0, *(words[key(w)][1] for w in ws)]
        for a, b in zip(k, k[1:], strict=False):
            pair[a, b] += 1
    n, v = sum(map(len, train)), len(words)
    types, once = ([sum(c == k and (one or x == 1) for x, c in words.values()) for k in range(classes)] for one in (True, False))
    unknown = max(range(1, classes), key=lambda k: (once[k], -k))
    uni = [(pair[:, k].sum() + 0.5) / (pair.sum() + 0.5 * classes) for k in range(classes)]
    out = []
    for _, t in rows:
        total, before = 0.0, 0
        for w in token(t):
            c, k = words.get(key(w), (0, 0 if w == END else unknown))
            emit = 1.0 if w == END else (c + add) / (pair[:, k].sum() + add * (types[k] + 1))
            move = (pair[before, k] + 5 * uni[k]) / (pair[before].sum() + 5)
            total += np.log10(mix * move * emit + (1 - mix) * (c + 0.1) / (n + 0.1 * (v + 1)))
            before = k
        out.append(float(total))
    return out
