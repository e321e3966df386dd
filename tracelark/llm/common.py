"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir  # noqa: F401
from ..session import ship_package

#: What `[\x20\x09-\x0D]` holds; bytes.split() and bytes.strip() use the same six bytes.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
ROWS = 200  # texts that stand in a worker as Python objects


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text and so falls in fold 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def py_fold(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, raw binary): UTF-8 bytes of the whole text, null as empty."""
    ship_package(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("raw"),
    )


def rows_of(batches: Iterator[pa.RecordBatch], *cols: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each non-empty batch as Python lists."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(c)).to_pylist() for c in cols)


def as_bytes(values: list) -> list[bytes]:
    """Texts of a string or binary column as UTF-8 bytes, null as empty."""
    return [b"" if v is None else v.encode() if isinstance(v, str) else v for v in values]


def filter_texts(docs: DataFrame, keep: Callable[[], Callable[[list[bytes]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text keep()'s function accepts; it is made once a task."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = keep()
        for b in batches:
            yield b.filter(pa.array(accept(as_bytes(b.column(at).to_pylist())), pa.bool_()))

    return docs.mapInArrow(few_texts(run), docs.schema)


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def give_back() -> None:
    """Freed memory of this process goes back to the system: Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def lean(f: Callable, *args: Any) -> Any:
    """f's result; what f has freed goes back to the system."""
    try:
        return f(*args)
    finally:
        give_back()


def lean_rows(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same for a function of mapInArrow, at the end of its task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def few_texts(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """lean_rows() of f, which gets batches in slices of at most ROWS rows: a batch may be all texts of a task."""
    return lean_rows(lambda batches: f(b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)))
