"""Language identification with interpolated Kneser-Ney character models, one for each language.

Fit: a bounded sample of labelled rows (at most ``rows_per_lang`` rows a language, by a hash of id and text; rows of over
``longest_row`` characters only come after all shorter ones, and the rows together hold at most ``rows_per_lang *
longest_row`` characters, or are one row) trains character n-gram models up to ``order`` on words in lower case, each between two
boundary marks. Counts of the longest n-grams and continuation counts below are interpolated with one absolute discount
an order. The models of all languages share sorted arrays of 64-bit n-gram hashes, with one row of finished
log-probabilities (or back-off weights) a hash and one column a language; a lookup is a binary search.

Prediction: the cross-entropy of a text is the sum over its words' letters and end marks, divided by their number; the
lowest wins, ties go to the language that sorts first. The score is a softmax of the entropies whose temperature is fitted on
held-back sample rows; `rejected` says that even the best entropy is above the ``reject_quantile`` of that language's
held-back rows. Words are scored once and remembered in a dictionary that is emptied when full.

Defined cases: a text that is null or has no letter gives `und`, score 0, not rejected; with no labelled rows at all every
text gives `und`, score 0; rows equal in id, language and text are learned from once, however often they stand there; of
very long texts every word counts; an empty table gives an empty result; other columns are not read; repeated rows give
repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, texts

OUT = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
CACHE = 120_000  # words remembered by a worker
BLOCK = 64  # texts whose unknown words are scored in one call
EDGE = ord(" ")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def letters(token: str) -> str:
    t = token.lower()
    return t if t.isalpha() else "".join(filter(str.isalpha, t))


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashes[o - 1, i]: hash of the o-gram that ends at character i of the padded words; depth: the longest at i within its word; word: index."""
    lens = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    flat = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64) if words else np.zeros(0, np.uint64)
    word = np.repeat(np.arange(len(words)), lens)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    hashes = np.zeros((order, len(flat)), dtype=np.uint64)
    h = np.zeros(len(flat), dtype=np.uint64)
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        for o in range(order):
            moved = np.zeros_like(flat)
            moved[o:] = flat[: len(flat) - o] if o else flat
            h = h + (moved + np.uint64(1)) * weight
            weight = weight * np.uint64(0x100000001B3) + np.uint64(2 * o + 1)
            x = (h ^ (h >> np.uint64(31))) * _MUL
            hashes[o] = x ^ (x >> np.uint64(29)) ^ np.uint64(o)
    return hashes, np.minimum(pos + 1, order), word


class CharModels:
    """Kneser-Ney models of several languages over shared sorted hash arrays."""

    def __init__(self, langs: list[str], order: int):
        self.langs, self.order = langs, order
        self.keys: list[np.ndarray] = []  # by order: sorted hashes of n-grams
        self.logp: list[np.ndarray] = []  # finished log-probability of the last character, a column a language
        self.ctx: list[np.ndarray] = []  # by order from 2: sorted hashes of contexts
        self.back: list[np.ndarray] = []  # log back-off weight
        self.temperature = 1.0
        self.ceiling = np.full(len(langs), np.inf)

    @classmethod
    def fit(cls, texts_by_lang: dict[str, list[str]], order: int = 4, hold: int = 5, reject_quantile: float = 0.995) -> CharModels:
        self = cls(sorted(texts_by_lang), order)
        words = {k: [[w for w in map(letters, t.split()) if w] for t in v] for k, v in texts_by_lang.items()}
        self._count([[w for n, t in enumerate(words[k]) if n % hold for w in t] or [w for t in words[k] for w in t] for k in self.langs])
        self._calibrate([(k, [t for n, t in enumerate(words[name]) if n % hold == 0]) for k, name in enumerate(self.langs)], reject_quantile)
        return self

    def _count(self, words: list[list[str]]) -> None:
        n_lang, order = len(self.langs), self.order
        # by language and order: (n-gram hash, context hash, suffix hash, count) of distinct n-grams
        tables: list[list[tuple[np.ndarray, ...]]] = []
        chars: set[str] = {" "}
        for ws in words:
            chars.update(*ws)
            hashes, depth, _ = _grams(ws, order)
            by_order = []
            above: tuple[np.ndarray, ...] | None = None
            for o in range(order, 0, -1):
                full = depth >= o
                starts = full & (depth == o) if o < order else full
                if o < order:  # n-grams at a word's start have no left neighbour and keep their counts
                    starts &= np.arange(len(depth)) - (o - 1) == np.maximum.accumulate(np.where(depth == 1, np.arange(len(depth)), 0))
                if o == 1:
                    starts &= False  # the opening mark is never predicted
                at = np.flatnonzero(starts)
                prev = hashes[o - 2, np.maximum(at - 1, 0)] if o > 1 else np.zeros(len(at), np.uint64)
                low = hashes[o - 2, at] if o > 1 else np.zeros(len(at), np.uint64)
                key, first, count = np.unique(hashes[o - 1, at], return_index=True, return_counts=True)
                key, prev, low, count = key, prev[first], low[first], count.astype(float)
                if above is not None:  # continuation counts: distinct longer n-grams that end in this one
                    up_low, up_ctx_low, up_low2 = above
                    k2, f2, c2 = np.unique(up_low, return_index=True, return_counts=True)
                    key, prev, low, count = (np.concatenate(x) for x in ((key, k2), (prev, up_ctx_low[f2]), (low, up_low2[f2]), (count, c2.astype(float))))
                    key, first, inv = np.unique(key, return_index=True, return_inverse=True)
                    count = np.bincount(inv, weights=count)
                    prev, low = prev[first], low[first]
                by_order.append((key, prev, low, count))
                if o > 1:
                    # the suffix's context and its own suffix: from any place where the n-gram stands
                    where = np.flatnonzero(full)
                    k3, f3 = np.unique(hashes[o - 1, where], return_index=True)
                    at3 = where[f3][np.searchsorted(k3, key)]
                    above = (low, hashes[o - 3, at3 - 1] if o > 2 else np.zeros(len(key), np.uint64), hashes[o - 3, at3] if o > 2 else np.zeros(len(key), np.uint64))
            tables.append(by_order[::-1])
        uniform = -np.log(len(chars) + 1.0)
        for o in range(1, order + 1):
            keys = np.unique(np.concatenate([t[o - 1][0] for t in tables]))
            lows = np.zeros(len(keys), np.uint64)
            ctxs = np.zeros(len(keys), np.uint64)
            for t in tables:
                at = np.searchsorted(keys, t[o - 1][0])
                lows[at], ctxs[at] = t[o - 1][2], t[o - 1][1]
            ctx = np.unique(ctxs)
            back = np.zeros((len(ctx), n_lang))
            below = np.full((len(keys), n_lang), uniform) if o == 1 else self.logp[o - 2][np.searchsorted(self.keys[o - 2], lows)]
            p = np.zeros((len(keys), n_lang))
            row = np.searchsorted(ctx, ctxs)
            for k, t in enumerate(tables):
                key, prev, _, count = t[o - 1]
                if not len(key):
                    p[:, k] = np.exp(below[:, k])
                    continue
                n1, n2 = (count == 1).sum(), (count == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                at = np.searchsorted(ctx, prev)
                total = np.bincount(at, weights=count, minlength=len(ctx))
                kinds = np.bincount(at, minlength=len(ctx))
                lam = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
                back[:, k] = np.log(lam)
                own = np.zeros(len(keys))
                own[np.searchsorted(keys, key)] = np.maximum(count - d, 0)
                p[:, k] = own / np.maximum(total[row], 1) + lam[row] * np.exp(below[:, k])
            self.keys.append(keys)
            self.logp.append(np.log(p))
            self.ctx.append(ctx)
            self.back.append(back)
        self.floor = self.back[0][0] + uniform if len(self.back[0]) else np.full(n_lang, uniform)

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row a word: the sum of log-probabilities by language, and last the number of predicted characters."""
        n_lang = len(self.langs)
        out = np.zeros((len(words), n_lang + 1))
        at_words = [k for k, w in enumerate(words) if w]
        if not at_words:
            return out
        hashes, depth, word = _grams([words[k] for k in at_words], self.order)
        starts = np.concatenate([[True], word[1:] != word[:-1]])
        todo = np.flatnonzero(~starts)
        total = np.zeros((len(todo), n_lang))
        left = np.arange(len(todo))
        for o in range(self.order, 0, -1):
            here = left[depth[todo[left]] >= o]
            if not len(here):
                continue
            i = todo[here]
            h = hashes[o - 1, i]
            at = np.minimum(np.searchsorted(self.keys[o - 1], h), len(self.keys[o - 1]) - 1)
            hit = self.keys[o - 1][at] == h
            total[here[hit]] += self.logp[o - 1][at[hit]]
            miss = here[~hit]
            if o > 1 and len(miss):
                h = hashes[o - 2, todo[miss] - 1]
                at = np.minimum(np.searchsorted(self.ctx[o - 1], h), len(self.ctx[o - 1]) - 1)
                known = self.ctx[o - 1][at] == h
                total[miss[known]] += self.back[o - 1][at[known]]
            elif len(miss):
                total[miss] += self.floor
            done = np.zeros(len(todo), dtype=bool)
            done[here[hit]] = True
            left = left[~done[left]]
        sums = np.zeros((len(at_words), n_lang))
        np.add.at(sums, word[todo], total)
        out[at_words, :n_lang] = sums
        out[at_words, n_lang] = np.bincount(word[todo], minlength=len(at_words))
        return out

    def entropies(self, sums: np.ndarray) -> np.ndarray:
        return -sums[:-1] / sums[-1]

    def _calibrate(self, held: list[tuple[int, list[list[str]]]], quantile: float) -> None:
        rows, gold = [], []
        for k, docs in held:
            for ws in docs:
                s = self.score_words(ws).sum(axis=0) if ws else None
                if s is not None and s[-1]:
                    rows.append(self.entropies(s))
                    gold.append(k)
        if not rows:
            return
        e, y = np.array(rows), np.array(gold)
        best = (np.inf, 1.0)
        for t in np.geomspace(0.5, 200, 40):
            z = -t * (e - e.min(axis=1, keepdims=True))
            best = min(best, (float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])), float(t)))
        self.temperature = best[1]
        for k in range(len(self.langs)):
            if (y == k).any():
                self.ceiling[k] = np.quantile(e[y == k, k], quantile) * 1.05

    def decide(self, sums: np.ndarray) -> tuple[str, float, float, bool]:
        e = self.entropies(sums)
        k = int(np.argmin(e))
        return self.langs[k], float(1 / np.exp(-self.temperature * (e - e[k])).sum()), float(e[k]), bool(e[k] > self.ceiling[k])


class TextScorer:
    """Sums of word scores over whole texts, with a bounded memory of words."""

    def __init__(self, models: CharModels):
        self.models = models
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(self.models.langs) + 1))

    def sums(self, block: list[str]) -> list[np.ndarray]:
        cut = [t.split() for t in block]
        index = self.index
        new = list({w for x in cut for w in x if w not in index})
        if new:
            got = self.models.score_words([letters(w) for w in new])
            need = len(index) + len(new)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
            self.rows[len(index) : need] = got
            index.update(zip(new, range(len(index), need), strict=True))
        get = index.__getitem__
        out = [self.rows[np.fromiter(map(get, x), dtype=np.int64, count=len(x))].sum(axis=0) for x in cut]
        if len(index) > CACHE:
            self._reset()
        return out


def sample_rows(docs: DataFrame, rows_per_lang: int, longest_row: int, folds: int, held_fold: int) -> list[tuple[str, int, str]]:
    """(lang, doc_id, text) of the rows to learn from.

    Rows are ranked without their texts, after equal ones are folded; the texts of the picked ones are folded again before
    they travel, so one row that repeats a million times is one row here.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(fold_of(F.col("doc_id"), folds) != held_fold)
    train = train.withColumns({"at": F.xxhash64(F.lit(11), F.col("doc_id")), "th": F.xxhash64("text")})
    rows = train.groupBy("lang", "doc_id", "at", "th").agg(F.max(F.length("text")).alias("size"))
    order = Window.partitionBy("lang").orderBy(F.col("size") > longest_row, "at", "doc_id", "th")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows_per_lang)
    so_far = F.sum("size").over(Window.partitionBy("lang").orderBy("rank"))
    picked = ranked.withColumn("so_far", so_far).where((F.col("rank") == 1) | (F.col("so_far") <= rows_per_lang * longest_row)).select("lang", "doc_id", "th")
    # at most rows_per_lang short rows a language
    got = train.join(F.broadcast(picked), ["lang", "doc_id", "th"]).groupBy("lang", "doc_id", "th").agg(F.first("text").alias("text"))
    return sorted((r["lang"], r["doc_id"], r["text"]) for r in got.select("lang", "doc_id", "text").collect())


def learn_models(docs: DataFrame, rows_per_lang: int, longest_row: int, order: int, folds: int, held_fold: int) -> CharModels:
    """Fit on the driver, on a bounded sample."""
    picked: dict[str, list[str]] = {}
    for lang, _, text in sample_rows(docs, rows_per_lang, longest_row, folds, held_fold):
        picked.setdefault(lang, []).append(text)
    return CharModels.fit(picked, order) if picked else CharModels([], order)


def identify_languages(
    docs: DataFrame,
    rows_per_lang: int = 500,
    longest_row: int = 20_000,
    order: int = 4,
    folds: int = 4,
    held_fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document row: doc_id, lang_pred, score, cross_entropy, rejected."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    models = learn_models(narrow, rows_per_lang, longest_row, order, folds, held_fold)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        scorer = TextScorer(models)
        for b in batches:
            raws, out = b.column(1).to_pylist(), []
            for at in range(0, len(raws), BLOCK):
                block = [x.decode("utf-8", "replace") for x in raws[at : at + BLOCK]]
                if not models.langs:
                    out += [("und", 0.0, None, False)] * len(block)
                    continue
                out += [models.decide(s) if s[-1] else ("und", 0.0, None, False) for s in scorer.sums(block)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())))],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, OUT)


def language_digest(docs: DataFrame) -> DataFrame:
    got = identify_languages(docs)
    return got.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def plain_entropy(train: list[str], text: str, order: int = 4) -> float:
    """The cross-entropy of a text under one language's model, by the definition and without arrays, for tests."""
    chars = {" "}
    tables: list[Counter] = [Counter() for _ in range(order + 1)]
    for w in (letters(t) for line in train for t in line.split()):
        chars.update(w)
        w = f" {w} " if w else ""
        for i in range(1, len(w)):
            for o in range(1, order + 1):
                if i - o + 1 >= 0 and (o == order or i - o + 1 == 0):
                    tables[o][w[i - o + 1 : i + 1]] += 1
    for o in range(order - 1, 0, -1):  # continuation counts: distinct longer n-grams
        tables[o].update(k[1:] for k in tables[o + 1])

    def log_of(gram: str) -> float:
        if not gram:
            return 1 / (len(chars) + 1)
        t = tables[len(gram)]
        n1, n2 = (sum(v == n for v in t.values()) for n in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        near = [v for k, v in t.items() if k[:-1] == gram[:-1]]
        below = log_of(gram[1:])
        return max(t[gram] - d, 0) / sum(near) + d * len(near) / sum(near) * below if near else below

    total, n = 0.0, 0
    for w in (letters(t) for t in text.split()):
        w = f" {w} " if w else ""
        for i in range(1, len(w)):
            total += np.log(log_of(w[max(0, i - order + 1) : i + 1]))
            n += 1
    return -total / n
