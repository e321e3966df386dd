"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

Each byte is mapped to one character, each vocabulary entry becomes a piece whose score is its negative rank, and the
normaliser is the identity; sentencepiece then merges exactly as the ranks say. Text is cut into pre-tokens by the
public pattern, each is encoded on its own, and ids are decoded by the inverse of the mapping.

Pre-tokens never cross a run of white space (a run's last blank belongs to the word after it), so ids are remembered per
white-space-delimited chunk in a dictionary that is emptied when it is full: memory stays bounded for any input.

Defined cases: null and empty texts give no ids and the digest of nothing; repeated rows give repeated rows; texts of any
length are encoded whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import few_texts, texts

#: Unicode's White_Space, which the pattern means by \s (Python's own \s has four control characters more).
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CACHE = 150_000  # chunks remembered by a worker
LONGEST = 64  # characters of a chunk that is remembered
BLOCK = 64  # texts whose unknown chunks are encoded in one call
SHIFT = 0x100  # byte b is the character SHIFT + b, so that no piece holds a space or control character
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary in order of its ranks, which must be 0, 1, 2, …"""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(b): base64.b64decode(a) for a, b in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise_model(vocab: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown piece, piece r + 1 is the vocabulary's rank r."""
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    out = [_field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2))]
    for rank, piece in enumerate(vocab):
        out.append(_field(1, _field(1, "".join(chr(SHIFT + b) for b in piece).encode()) + score(-float(rank))))
    out.append(_field(2, _field(3, 2) + _field(4, len(vocab) + 1)))  # TrainerSpec: BPE, vocabulary size
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))  # NormalizerSpec: nothing added, removed or escaped
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one worker."""

    def __init__(self, vocab: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.vocab = vocab
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pre = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.map = {b: chr(SHIFT + b) for b in range(256)}
        self.cache: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks: their pre-tokens go to sentencepiece in one call."""
        cut = [self.pre.findall(c) for c in chunks]
        parts = list({p for c in cut for p in c})
        mapped = [p.encode().decode("latin-1").translate(self.map) for p in parts]
        ids = {p: (np.array(i, dtype="<u4") - 1).tobytes() for p, i in zip(parts, self.sp.encode(mapped, num_threads=1), strict=True)}
        return {c: ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x]) for c, x in zip(chunks, cut, strict=True)}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for at in range(0, len(texts), BLOCK):
            cut = [CHUNK.findall(t) for t in texts[at : at + BLOCK]]
            new = {c for x in cut for c in x if c not in cache}
            got = self._learn(list(new)) if new else {}
            long = {c: i for c, i in got.items() if len(c) > LONGEST}
            cache.update(got)
            out += [b"".join(map(cache.__getitem__, x)) for x in cut]
            for c in long:
                del cache[c]
            if len(cache) > CACHE:
                cache.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (the bytes that the ids decode to)."""
    return _run(docs, path, pattern, id_col, text_col, False)


def bpe_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return _run(docs, path, pattern, id_col, text_col, True)


def _run(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    vocab = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, serialise_model(vocab)))  # the vocabulary's size bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*shared.value, pattern)
        for b in batches:
            out = []
            for ids in bpe.encode_all([raw.decode("utf-8", "replace") for raw in b.column(1).to_pylist()]):
                back = bpe.decode(ids)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) if digest else (ids, back))
            if digest:
                cols = [pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.string()) for k in (1, 2))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols = [pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)]
                names = ["doc_id", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return texts(docs, id_col, text_col).mapInArrow(few_texts(run), OUT if digest else "doc_id long, ids binary, decoded binary")
