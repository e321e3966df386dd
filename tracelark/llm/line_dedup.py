"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold, reassemble.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Keys of at least ``min_chars``
code points that at least ``min_docs`` documents hold lose all their lines, except in the largest doc_id that holds the key.

Plan: one pass hashes lines to 128 bits on the executors and emits each key once per document row; counting uses two
partial aggregations (distinct (key, doc), then key), so a line held by a third of all documents never meets in one task.
Only keys over the threshold are joined back (an equi-join that adaptive execution may split), grouped by document and
joined with the texts, which shuffle once; the short side is the one that is hashed.

Defined cases: a null or empty text is one empty line; a null doc_id holds no key and loses no line; rows that repeat a
doc_id count as one document and lose the same lines; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, few_texts, texts

HITS = "doc_id long, h1 long, h2 long"
KEPT = "doc_id long, n_lines long, n_dropped long, kept binary"


def _key(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    """At least min_chars code points: bytes that do not continue a character."""
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _hashes(raw: bytes, min_chars: int) -> dict[bytes, bytes]:
    """Digest of each distinct key that is long enough."""
    import xxhash

    keys = {_key(x) for x in raw.split(b"\n")}
    return {k: xxhash.xxh3_128_digest(k) for k in keys if _long_enough(k, min_chars)}


def _as_longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def line_hits(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2): each key of each document row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests = [], []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = _hashes(raw, min_chars).values()
                digests += got
                ids += [i] * len(got)
            both = [_as_longs(d) for d in digests]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())],
                names=["doc_id", "h1", "h2"],
            )

    return texts(docs, id_col, text_col).where("doc_id is not null").mapInArrow(few_texts(run), HITS)


def repeated_lines(hits: DataFrame, min_docs: int = 3) -> DataFrame:
    """(h1, h2, keep_doc): keys that at least min_docs documents hold, and the largest of these."""
    return (
        hits.distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_doc"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keep_doc")
    )


def _drops(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(drop_id, drops): the keys that a document loses."""
    scratch = Scratch(docs.sparkSession)
    hits = scratch.table(line_hits(docs, min_chars, id_col, text_col))  # 24 bytes a line; texts are cut into lines once
    # written first, so that the join below stands directly on two exchanges and adaptive execution may split a hot key
    repeated = scratch.table(repeated_lines(hits, min_docs))
    return (
        hits.join(repeated, ["h1", "h2"])
        .where("doc_id < keep_doc")
        .groupBy(F.col("doc_id").alias("drop_id"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    )


def _kept_lines(raw: bytes, drops: list | None, min_chars: int) -> tuple[int, list[bytes]]:
    lines = raw.split(b"\n")
    if not drops:
        return len(lines), lines
    gone = {(d["h1"], d["h2"]) for d in drops}
    bad = {k for k, d in _hashes(raw, min_chars).items() if _as_longs(d) in gone}
    return len(lines), [x for x in lines if _key(x) not in bad]


def dedup_documents(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with all their columns, their text as dedup_lines() leaves it and, where there is such a column, its new length."""
    drops = _drops(docs, min_chars, min_docs, id_col, text_col).withColumnsRenamed({"drop_id": "__drop_id", "drops": "__drops"})
    both = docs.join(drops.hint("shuffle_hash"), docs[id_col].cast("long") == drops["__drop_id"], "left").select(*[docs[c] for c in docs.columns], "__drops")
    at, size_at = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.columns[:-1]
            texts = cols[at].to_pylist()
            for k, drops in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if drops:
                    texts[k] = b"\n".join(_kept_lines(texts[k].encode(), drops, min_chars)[1]).decode()
            if size_at is not None:
                sizes = [s if t is None or not d else len(t) for s, t, d in zip(cols[size_at].to_pylist(), texts, b.column(b.num_columns - 1).to_pylist(), strict=True)]
                cols[size_at] = pa.array(sizes, cols[size_at].type)
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return both.mapInArrow(few_texts(run), docs.schema)


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document row: doc_id, n_lines (before), n_dropped, kept (the text that stays, as UTF-8 bytes)."""
    drops = _drops(docs, min_chars, min_docs, id_col, text_col)
    src = texts(docs, id_col, text_col)
    both = src.join(drops.hint("shuffle_hash"), src["doc_id"] == drops["drop_id"], "left").select("doc_id", "raw", "drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, drops in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, kept = _kept_lines(raw, drops, min_chars)
                out.append((n, n - len(kept), b"\n".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.binary()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return both.mapInArrow(few_texts(run), KEPT)


def line_digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The contract's row of each document: counts and the SHA-256 of the text that stays."""
    got = dedup_lines(docs, min_chars, min_docs)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    """Plain version, for tests."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    held: dict[str, set[int]] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
