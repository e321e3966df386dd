"""Toxicity by weak supervision.

1. Mining: over a bounded sample of labelled rows (``rows_per_class`` a class, chosen by a hash of the id; of copies only
   one stays) the executors count, by class, the documents that hold each word and each word beginning of 4 to 6 letters; terms that stand out in
   toxic rows become the lexicon (at most ``max_terms``): at least ``min_docs`` toxic rows, over 20 times as frequent there,
   and a likelihood ratio of at least ``min_evidence`` nats, so that chance among many rare words brings none in.
2. Voters: the lexicon is dealt to ``groups`` word voters and as many stem voters; beside these stand a general list of
   insults, patterns (insult addressed to a reader, masked letters, shouting), voters for clean text, and the annotators.
3. Label model: expectation maximisation estimates for each voter how often it votes toxic, clean or not at all in either
   class; correlations of what the classes leave unexplained lower the weight of voters that repeat each other.
4. A logistic regression on lexicon and pattern features is trained on the posterior labels, and scores every whole text.

Predictions read nothing but the text. Defined cases: null and empty texts get the classifier's score of an empty text;
very long texts are read whole, and words of any length may become terms; of rows that repeat a labelled doc_id one is
learned from, that with the smallest hash of its text; terms that tie are taken in alphabetical order, and a score of
exactly 0.5 predicts toxic; an empty table gives an empty result;
documents with several label rows count as toxic if any of these says so; null labels, ids and rows without a document are
not learned from; without labelled rows, or with one class only, the general list alone decides; repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_texts, filter_texts, fold_of, hash_words, texts

#: General insults.
INSULTS = frozenset(
    """abomination asshole bastard bitch bullshit clown crap creep cretin cunt degenerate dickhead dimwit disgrace disgusting
    douchebag dumb dumbass dunce faggot filth filthy freak fuck fucking garbage idiot idiots idiotic imbecile inbred jackass jerk
    loser losers lowlife maggot moron morons moronic nitwit pathetic pig prick retard retarded scum scumbag shit shitty slut
    stupid trash twat ugly vermin vile whore worthless wretch""".split()
)
#: Words that address a reader.
ADDRESS = frozenset("you your you're youre ur u tu vous toi du ihr dich euch tú usted ustedes".split())
MASKED = re.compile(r"^[^\W\d_]+[*#@$%!]{1,}[^\W\d_]+$")
STRIP = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…¡¿"
STEMS = (4, 5, 6)
CACHE = 120_000
#: Places of the dense features after the lexicon's.
N_WORDS, N_STEMS, SHARE, N_GENERAL, ADDRESSED, N_MASKED, SHOUT, DENSE = range(8)
OUT = "doc_id long, score double, predicted int"


@dataclass
class Model:
    """What executors need to score a text."""

    terms: dict[str, int] = field(default_factory=dict)  # words as they are, stems with a leading "^"
    general: frozenset[str] = INSULTS
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DENSE))
    bias: float = 0.0
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, as lexicon terms."""
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)]


class Evidence:
    """Finds the features of whole texts, with a bounded memory of words."""

    def __init__(self, terms: dict[str, int], general: frozenset[str]):
        self.terms, self.general = terms, general
        self.cache: dict[str, tuple | None] = {}

    def _look(self, token: str) -> tuple | None:
        """(word terms, stem terms, general, masked, address) of a token, or None."""
        low = token.lower().strip(STRIP)
        ids = [(self.terms[t], t[0] == "^") for t in terms_of(low) if t in self.terms] if low else []
        masked = "*" in token or "@" in token or "$" in token or "#" in token
        got = (tuple(i for i, s in ids if not s), tuple(i for i, s in ids if s), low in self.general, bool(masked and MASKED.match(token.strip(".,;:"))), low in ADDRESS)
        return got if any(got) else None

    def of(self, text: str) -> tuple[list[int], np.ndarray]:
        """Lexicon terms that the text holds, and its dense features."""
        tokens = set(text.split())
        cache, hits = self.cache, []
        for t in tokens:
            try:
                x = cache[t]
            except KeyError:
                x = self._look(t)
                if len(t) <= 64:
                    cache[t] = x
            if x is not None:
                hits.append(x)
        if len(cache) > CACHE:
            cache.clear()
        words = {i for x in hits for i in x[0]}
        stems = {i for x in hits for i in x[1]}
        general = sum(x[2] for x in hits)
        evident = sum(bool(x[0] or x[2]) for x in hits)
        d = np.zeros(DENSE)
        d[N_WORDS], d[N_STEMS], d[N_GENERAL], d[N_MASKED] = (math.log1p(n) for n in (len(words), len(stems), general, sum(x[3] for x in hits)))
        d[SHARE] = math.log1p(100.0 * evident / max(len(tokens), 1))
        d[ADDRESSED] = float(general > 0 and any(x[4] for x in hits))
        d[SHOUT] = float(sum(map(str.isupper, tokens)) > 0.5 * len(tokens) + 1.5)  # a few capitals alone shout nothing
        return sorted(words | stems), d


def _sample(docs: DataFrame, labels: DataFrame, rows_per_class: int, folds: int) -> tuple[DataFrame, int, int]:
    """(doc_id, raw, toxic) of the sample, and how many labelled rows of either class may be learned from."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .where(fold_of(F.col("doc_id"), folds) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    neg, pos = n.get(0, 0), n.get(1, 0)
    unit = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 24)) / F.lit(float(1 << 24))
    share = F.when(F.col("toxic") == 1, min(1.0, rows_per_class / max(pos, 1))).otherwise(min(1.0, rows_per_class / max(neg, 1)))
    picked = known.where(unit < share).withColumnRenamed("doc_id", "label_id")  # about 2 * rows_per_class rows at most, so it may be sent everywhere
    src = texts(docs)
    found = src.join(F.broadcast(picked), src["doc_id"] == picked["label_id"])
    return found.groupBy("doc_id", "toxic").agg(F.min_by("raw", F.xxhash64("raw")).alias("raw")).select("doc_id", "raw", "toxic"), neg, pos


def _without_copies(sample: DataFrame, hashes: int = 6, width: int = 5) -> DataFrame:
    """One row of each group of copies of the bounded sample: copies of one text would make its rare words look telling.

    Rows that share any of a few minimum hashes over word shingles count as copies, through the smallest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.random.default_rng(17).integers(1, 1 << 62, size=(hashes, 1), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for b in batches:
            sigs = []
            for raw in b.column(1).to_pylist():
                h = hash_words(raw.lower().split() or [b""])
                with np.errstate(over="ignore"):
                    x = h[: max(len(h) - width + 1, 1)].copy()
                    for k in range(1, min(width, len(h))):
                        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)]
                    x = x ^ (x >> np.uint64(32))
                    sigs.append((x[None, :] * mix).min(axis=1).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "toxic", "sig"])

    rows = sorted(sample.mapInArrow(few_texts(run), "doc_id long, toxic int, sig array<long>").collect())  # bounded by the sample
    seen: set[tuple[int, int, int]] = set()
    keep = []
    for i, toxic, sig in rows:
        keys = {(toxic, k, x) for k, x in enumerate(sig)}
        if not keys & seen:
            keep.append(i)
        seen |= keys
    # from Arrow: rows of Python objects would start a second kind of worker in every executor
    kept = sample.sparkSession.createDataFrame(pa.table({"keep_id": pa.array(keep, pa.int64())}))
    return sample.join(F.broadcast(kept), sample["doc_id"] == kept["keep_id"]).select("doc_id", "raw", "toxic").dropDuplicates(["doc_id"])


def _mine(sample: DataFrame, neg: int, pos: int, max_terms: int, min_docs: int, min_evidence: float) -> tuple[list[str], frozenset[str]]:
    """The lexicon, and the general insults that the labelled rows don't speak against (some are harmless in another language)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["term", "neg", "pos"])
            for c in counts:
                c.clear()
            return out

        for b in batches:
            for raw, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = {t.strip(STRIP) for t in raw.decode("utf-8", "replace").lower().split()}
                counts[toxic].update({t for w in words if len(w) > 1 for t in terms_of(w)})
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield flush()
        yield flush()

    counted = sample.mapInArrow(few_texts(run), "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    score = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    rate = pos / (pos + neg)
    n = F.col("pos") + F.col("neg")
    evidence = F.col("pos") * F.log(F.col("pos") / (n * rate)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - rate)))).otherwise(0.0)
    best = (
        counted.where(F.col("pos") >= min_docs)
        .withColumn("score", F.round(score, 9))
        .where((F.col("score") >= 3.0) & (evidence >= min_evidence))
        .withColumn("worth", F.round(F.col("score") * F.log1p("pos"), 9))
        .orderBy(F.desc("worth"), "term")
        .limit(max_terms)
    )
    doubtful = counted.where(F.col("term").isin(sorted(INSULTS)) & (F.col("neg") >= 2) & (score < 1.5))
    return [r["term"] for r in best.select("term").collect()], INSULTS - {r["term"] for r in doubtful.select("term").collect()}


def votes_of(term_ids: list[int], dense: np.ndarray, n_terms: int, is_stem: np.ndarray, groups: int) -> np.ndarray:
    """1 toxic, 0 clean, -1 no vote, of each voter but the annotators."""
    v = np.full(2 * groups + 6, -1, dtype=np.int8)
    for i in term_ids:
        v[i % groups + (groups if is_stem[i] else 0)] = 1
    v[2 * groups] = 1 if dense[N_GENERAL] > 0 else -1
    v[2 * groups + 1] = 1 if dense[ADDRESSED] else -1
    v[2 * groups + 2] = 1 if dense[N_MASKED] > 0 else -1
    v[2 * groups + 3] = 1 if dense[SHOUT] else -1
    v[2 * groups + 4] = 0 if not term_ids and not dense[N_GENERAL] else -1
    v[2 * groups + 5] = 0 if dense[SHARE] < math.log1p(0.05) else -1
    return v


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 by row, P(vote | class) as [class, voter, vote + 1], and the voters' weights."""
    n, m = votes.shape
    hot = np.stack([votes == k for k in (-1, 0, 1)], axis=2).astype(float)
    lean = hot[:, :, 2].sum(axis=1) - hot[:, :, 1].sum(axis=1)
    q = np.where(lean > 0, 0.9, 0.1)
    weight = np.ones(m)
    p = np.zeros((2, m, 3))
    for r in range(rounds):
        for y, w in ((0, 1 - q), (1, q)):
            p[y] = (np.einsum("n,nmk->mk", w, hot) + 0.5) / (w.sum() + 1.5)
        if r in (rounds // 3, 2 * rounds // 3):  # what the classes do not explain, voters share
            says = hot[:, :, 2] - hot[:, :, 1]
            left = says - ((1 - q)[:, None] * (p[0, :, 2] - p[0, :, 1]) + q[:, None] * (p[1, :, 2] - p[1, :, 1]))
            sd = left.std(axis=0) + 1e-9
            corr = (left - left.mean(axis=0)).T @ (left - left.mean(axis=0)) / n / np.outer(sd, sd)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.maximum(corr, 0).sum(axis=1))
        odds = np.log(prior / (1 - prior)) + np.einsum("nmk,mk->n", hot, weight[:, None] * (np.log(p[1]) - np.log(p[0])))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, p, weight


def _regress(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, n_terms: int, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full-batch Adam."""
    n = len(y)
    w, m, v = np.zeros(n_terms + DENSE + 1), np.zeros(n_terms + DENSE + 1), np.zeros(n_terms + DENSE + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + dense @ w[n_terms:-1] + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(cols, weights=err[rows], minlength=n_terms)[:n_terms], dense.T @ err, [err.sum()]]) / n
        g[:-1] += l2 * w[:-1] / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, rows_per_class: int = 5000, max_terms: int = 2000, min_docs: int = 3, min_evidence: float = 14.0, groups: int = 8, folds: int = 5) -> Model:
    sample, neg, pos = _sample(docs, labels, rows_per_class, folds)
    general = Model(weights=np.eye(DENSE)[N_GENERAL] * 4.0, bias=-2.0)
    if not neg or not pos:
        return general
    sample = _without_copies(sample)
    classes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return general
    kept = [classes[0], classes[1]]
    mined, insults = _mine(sample, *kept, max_terms, min_docs, min_evidence)
    terms = {t: k for k, t in enumerate(mined)}
    stem = np.array([t[0] == "^" for t in terms], dtype=bool)
    n_terms = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Evidence(terms, insults)
        for b in batches:
            got = [find.of(raw.decode("utf-8", "replace")) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1].tolist() for x in got], pa.list_(pa.float64())), b.column(2)],
                names=["doc_id", "terms", "dense", "toxic"],
            )

    rows = sample.mapInArrow(few_texts(run), "doc_id long, terms array<int>, dense array<double>, toxic int").collect()  # bounded by the sample and the lexicon
    rows.sort(key=lambda r: (r["doc_id"], r["terms"], r["dense"]))
    toxic = np.array([r["toxic"] for r in rows])
    if not len(set(toxic.tolist())) == 2:
        return general
    dense = np.array([r["dense"] for r in rows])
    votes = np.stack([np.concatenate([votes_of(r["terms"], d, n_terms, stem, groups), [r["toxic"]]]) for r, d in zip(rows, dense, strict=True)])
    q, p, _ = label_model(votes, float(np.clip(toxic.mean(), 0.02, 0.98)))
    at = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
    cols = np.array([i for r in rows for i in r["terms"]], dtype=np.int64)
    w, bias = _regress(at, cols, dense, q, n_terms)
    # the sample holds either class in another proportion than the labels do
    bias += math.log(pos / neg) - math.log(toxic.sum() / (1 - toxic).sum())
    names = [*(f"words {k}" for k in range(groups)), *(f"stems {k}" for k in range(groups)), "general", "addressed", "masked", "shouting", "no term", "low share", "annotators"]
    return Model(terms, insults, w, bias, {n: (float(p[0, k, 1]), float(p[1, k, 2])) for k, n in enumerate(names)})


class Scorer:
    """The classifier of one worker."""

    def __init__(self, model: Model):
        self.find, self.bias = Evidence(model.terms, model.general), model.bias
        n = len(model.terms)
        self.sparse, self.dense = model.weights[:n], model.weights[n:]

    def score(self, raw: bytes) -> float:
        ids, dense = self.find.of(raw.decode("utf-8", "replace"))
        z = float(dense @ self.dense) + (float(self.sparse[ids].sum()) if ids else 0.0) + self.bias
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_terms entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = [scorer.score(raw) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(few_texts(run), OUT)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows that score_texts() predicts toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep() -> Callable[[list[bytes]], list[bool]]:
        scorer = Scorer(shared.value)
        return lambda raws: [scorer.score(raw) < 0.5 for raw in raws]

    return filter_texts(docs, keep, text_col)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score_texts(docs, learn(docs, labels))
    return got.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def plain_label_model(votes: list[list[int]], prior: float, rounds: int = 30) -> list[float]:
    """The label model's posteriors without arrays, for tests."""
    n, m = len(votes), len(votes[0])
    q = [0.9 if sum((v == 1) - (v == 0) for v in row) > 0 else 0.1 for row in votes]
    weight = [1.0] * m
    for r in range(rounds):
        p = [[{k: (sum(w for w, row in zip(of, votes, strict=True) if row[j] == k) + 0.5) / (sum(of) + 1.5) for k in (-1, 0, 1)} for j in range(m)] for of in ([1 - x for x in q], q)]
        if r in (rounds // 3, 2 * rounds // 3):
            left = [[(row[j] == 1) - (row[j] == 0) - ((1 - x) * (p[0][j][1] - p[0][j][0]) + x * (p[1][j][1] - p[1][j][0])) for x, row in zip(q, votes, strict=True)] for j in range(m)]
            mean = [sum(x) / n for x in left]
            sd = [math.sqrt(sum((y - a) ** 2 for y in x) / n) + 1e-9 for x, a in zip(left, mean, strict=True)]
            corr = lambda i, j: sum((a - mean[i]) * (b - mean[j]) for a, b in zip(left[i], left[j], strict=True)) / n / sd[i] / sd[j]
            weight = [1 / (1 + sum(max(corr(i, j), 0) for j in range(m) if j != i)) for i in range(m)]
        odds = [math.log(prior / (1 - prior)) + sum(weight[j] * (math.log(p[1][j][row[j]]) - math.log(p[0][j][row[j]])) for j in range(m)) for row in votes]
        q = [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in odds]
    return q
