"""Each operator on odd tables, and against brute force or a known answer."""

import hashlib
import random
import time
import zlib

import compare
import numpy as np
import pytest

DATA = str(compare.DATA)


def table(spark, sf, name):
    return spark.read.parquet(f"{DATA}/{sf}/{name}.parquet")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# --- line dedup


def test_line_dedup_odd(spark, odd, odd_rows, clashing, none):
    from tracelark.llm.line_dedup import brute_force, dedup_documents, line_digest

    want = sorted(map(str, brute_force([(r[0], r[1]) for r in odd_rows])))
    for df in (odd, clashing):
        assert sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"])) for r in line_digest(df).collect()) == want
    assert line_digest(none).count() == 0
    got = dedup_documents(clashing)
    assert got.columns == clashing.columns and got.count() == len(odd_rows)


def test_line_dedup_keeps_the_largest_id(spark):
    from tracelark.llm.line_dedup import brute_force, line_digest

    line = "  This Line is long enough to count  "
    rows = [(i, f"own {i}\n{line if i % 2 else line.upper()}\nshort\n") for i in range(6)] + [(9, "x" * 20), (10, "X" * 20 + "\r"), (11, "é" * 19)]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_force(rows))
    assert {g[0] for g in got if g[2]} == {0, 1, 2, 3, 4}


def test_line_dedup_same_as_sql(spark):
    from tracelark.llm.queries import ORACLE, QUERIES

    assert compare.differences(spark, compare.duck("sf0.001"), "sf0.001", QUERIES["op10_line_dedup"], ORACLE["op10_line_dedup"]) == ""


# --- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers as p

    from tracelark.llm.byte_bpe import ByteBpe, read_ranks, serialise_model

    vocab = read_ranks(p.path("byte_bpe_50k.tiktoken"))
    return ByteBpe(vocab, serialise_model(vocab), p.PATTERN)


def test_bpe_same_as_tiktoken(bpe):
    import public_tokenizers as p
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks={x: i for i, x in enumerate(bpe.vocab)}, special_tokens={})
    r = random.Random(1)
    hard = ["don't  it's 's\n\n\n  x\ty  ", " \x1c\x1d a\x85b\xa0c ² Ⅷ ٣ 中文字 🎉🎉 ​᠎", "\r\n\r\n a", "a" * 5000, "", "   ", "'ll 'LL", "<|endoftext|>", "\x00\x01", "▁ ▁x"]
    hard += ["".join(r.choice(" \n\t'sdtlvera0٣²é中!,.\xa0\x1c ") for _ in range(r.randrange(60))) for _ in range(3000)]
    for t, ids in zip(hard, bpe.encode_all(hard), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t
        assert bpe.decode(ids) == t.encode()


def test_bpe_odd(spark, odd, clashing, odd_rows, none):
    from tracelark.llm.byte_bpe import bpe_digest
    import public_tokenizers as p

    for df in (odd, clashing):
        got = bpe_digest(df, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).collect()
        assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in odd_rows)
    assert bpe_digest(none, p.path("byte_bpe_50k.tiktoken"), p.PATTERN).count() == 0


# --- benchmark decontamination


def test_decontamination_same_as_brute_force(spark, words):
    from tracelark.llm.decontaminate import brute_force, drop_contaminated, find_contamination

    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))

    def edit(s, k):
        s = list(s)
        for _ in range(k):
            at = r.randrange(len(s))
            s[at : at + r.choice((0, 1))] = r.choice(("", "q", "zz")[: 2 + r.randrange(2)])
        return "".join(s)

    items = [(k, prose(r.randint(6, 25))) for k in range(6)] + [(90, "too short"), (91, None), (None, prose(20)), (92, ""), (93, "短い問題です")]
    items += [items[0], (0, prose(12)), (94, items[1][1])]  # an id that repeats, and a text of two ids
    rows = [(i, prose(20) + " " + edit(r.choice(items[:6])[1], r.randrange(9)) + "\n" + prose(15)) for i in range(40)] + [(98, None), (99, "")]
    rows += [(95, "It is Too  short, yes"), (96, "too shorter"), (97, "全文短い問題です。"), (100, items[0][1]), (100, items[0][1]), (101, "too short")]
    want = brute_force(rows, items)
    assert want[95] == want[101] == [90] and not want[96] and want[97] == [93] and 0 in want[100]
    for block in (150, 4 << 20):  # a few items a block, and all in one
        got = find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, items), block_bytes=block).collect()
        assert {g["doc_id"]: g["item_ids"] for g in got} == want and len(got) == len(rows)
        assert all(g["n_items"] == len(g["item_ids"]) for g in got)
        kept = drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, items), block_bytes=block)
        assert {g["doc_id"] for g in kept.collect()} == {i for i, x in want.items() if not x}
    assert any(want.values()) and not all(want.values())


def test_decontamination_odd(spark, odd, clashing, odd_rows, none):
    from tracelark.llm.decontaminate import drop_contaminated, find_contamination

    items = bench(spark, [(1, odd_rows[6][1]), (1, odd_rows[6][1])])
    for df in (odd, clashing):
        got = find_contamination(df, items).collect()
        assert len(got) == len(odd_rows) and {g["doc_id"] for g in got if g["contaminated"]} == {6, 7, 8, -3}
        assert drop_contaminated(df, items).columns == df.columns
    assert drop_contaminated(odd, items).count() == len(odd_rows) - 5
    assert find_contamination(none, items).count() == 0
    assert not any(g["contaminated"] for g in find_contamination(odd, bench(spark, [])).collect())


# --- n-gram Jaccard join


def test_join_same_as_brute_force(spark, words, monkeypatch):
    """Families of near copies around the threshold, so that some members link only through others; tiles and hubs of many chunks."""
    from tracelark.llm import ngram_join
    from tracelark.llm.ngram_join import brute_force, join_ngrams

    monkeypatch.setattr(ngram_join, "CHUNK", 9)
    monkeypatch.setattr(ngram_join, "HUB", 4)
    r = random.Random(3)
    rows = []
    for family in range(6):
        base = [r.choice(words) for _ in range(r.choice((12, 40, 150, 300)))]
        for _ in range((3, 8, 60, 25, 1, 2)[family]):
            t = list(base)
            for _ in range(r.randrange(1 + len(t) // 14)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t)))
    passage = " ".join(r.choice(words) for _ in range(55))
    rows += [(len(rows) + k, passage + " " + " ".join(r.choice(words) for _ in range(r.choice((10, 60))))) for k in range(30)]
    rows += [(1000, "a b"), (1001, "A  b"), (1002, "a b c"), (1003, None), (1004, "")]
    want = brute_force(rows)
    got = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 40


@pytest.mark.parametrize("chunk", [512, 7])  # components in one chunk, and cut by bands and into chunks
def test_join_counts_every_link(spark, words, monkeypatch, chunk):
    """Groups of more than three different texts, with copies, some of whose members link only through others."""
    from tracelark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LINK_NODES", chunk)
    r = random.Random(8)
    rows = []
    for size, many in ((40, 12), (150, 40), (300, 5)):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(many):
            t = list(base) + [r.choice(words) for _ in range(r.randrange(1 + size // 8))]
            t[r.randrange(len(t))] = r.choice(words)
            rows += [(len(rows) + k, " ".join(t)) for k in range(r.choice((1, 1, 3)))]
    rows += [(900, "alone here"), (901, None), (902, "")]
    find = ngram_join.Shingler(5)
    sets = {i: find.of((t or "").encode()) for i, t in rows}
    want = {i: sum(j != i and len(x) > 0 and len(y) > 0 and ngram_join._links(x, y, 80) for j, y in sets.items()) for i, x in sets.items()}
    got = {g["doc_id"]: g["n_links"] for g in ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 10


def test_join_finds_often_seen_shingles_over_all_tasks(spark):
    """A passage that each task sees once or twice is known as frequent, so it opens no large tile."""
    from tracelark.llm.ngram_join import NgramJoin, Shingler

    passage = "one passage that many documents of every task hold"
    rows = [(i, f"{passage} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}" if i % 15 == 0 else f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}") for i in range(1_500)]
    join = NgramJoin(spark.createDataFrame(spark.sparkContext.parallelize(rows, 50), "doc_id long, text string"), look=1)  # two in each task
    often = join.often()
    assert set(Shingler(5).of(passage.encode()).tolist()) == set(often.tolist())
    tiles = join.tiles(join.scratch.table(join.cards(often)))
    assert tiles.count() == 0


def test_join_odd(spark, odd, clashing, odd_rows, none):
    from tracelark.llm.ngram_join import join_ngrams, one_of_each_group

    for df in (odd, clashing):
        got = join_ngrams(df).collect()
        assert len(got) == len(odd_rows)
        by = {g["doc_id"]: g for g in got if g["doc_id"] is not None}
        assert by[6]["component_id"] == by[7]["component_id"] == by[8]["component_id"] == 6 and by[10]["component_id"] == 9 and by[10]["n_shingles"] == 1
        assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1
    kept = one_of_each_group(clashing)
    assert kept.columns == clashing.columns and kept.where("doc_id in (7, 8, 10)").count() == 0 and kept.count() == len(odd_rows) - 4
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(6, a), (7, a), (7, b), (20, c), (20, c), (20, c.upper()), (None, a), (None, a), (21, ""), (21, "")]
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["text"].lower()) for r in kept) == [(-1, a), (-1, a), (6, a), (7, b), (20, c), (21, ""), (21, "")]
    assert join_ngrams(none).count() == 0


def test_bitmaps_never_rule_out_a_link():
    from tracelark.llm.ngram_join import _links, bitmap, may_link

    r = np.random.default_rng(2)
    for _ in range(500):
        a = np.unique(r.integers(0, 1 << 63, size=r.integers(1, 200), dtype=np.int64).astype(np.uint64))
        keep = a[r.random(len(a)) < 0.9]
        b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, size=r.integers(0, 20), dtype=np.int64).astype(np.uint64)]))
        if len(b) and _links(a, b, 80):
            for bits in (1, 4):
                assert may_link(len(a), len(b), np.frombuffer(bitmap(a, bits), np.uint8), np.frombuffer(bitmap(b, bits), np.uint8), 80)


def test_components_of_a_long_path_and_a_star(spark):
    from tracelark.llm.common import Scratch
    from tracelark.llm.components import connected_components

    edges = [(k + 1, k) for k in range(100)] + [(1000 + k, 1000) for k in range(1, 50)] + [(5, 5)]
    got = {x["node"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert {got[k] for k in range(101)} == {0} and {got[1000 + k] for k in range(50)} == {1000}


# --- language identification


def test_language_id_held_out(spark):
    from tracelark.llm.queries import QUERIES

    got = QUERIES["op3_language_id"](spark, f"{DATA}/sf0.01").join(table(spark, "sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(g["lang_pred"] == g["lang"] for g in got) / len(got) > 0.97
    assert all(0 <= g["score"] <= 1 for g in got)


def test_language_id_odd(spark, odd, clashing, odd_rows, none):
    from tracelark.llm.language_id import identify_languages

    for df in (odd, clashing):
        got = identify_languages(df).collect()
        assert len(got) == len(odd_rows)
        by = {g["doc_id"]: g["lang_pred"] for g in got}
        assert by[1] == by[2] == by[3] == by[12] == "und" and by[5] != "und"
    assert identify_languages(none).count() == 0
    from pyspark.sql import functions as F

    assert {g["lang_pred"] for g in identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_learns_from_long_and_repeated_rows(spark, words):
    """A language whose rows are all long is learned; a row that repeats is one row of the sample; the entropy is as defined."""
    from tracelark.llm.language_id import CharModels, identify_languages, plain_entropy, sample_rows

    r = random.Random(6)
    other = ["".join(r.choice("kvwxyz") + r.choice("öäü") for _ in range(r.randint(1, 3))) for _ in range(200)]
    prose = lambda of, n: " ".join(r.choice(of) for _ in range(n))
    rows = [(k, prose(words, 30), "aa") for k in range(60)] + [(100 + k, prose(other, 6_000), "bb") for k in range(9)]
    again = next(k for k in range(500, 600) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows += [(again, rows[0][1], "aa")] * 300 + [(900, prose(other, 20), None), (901, None, "aa"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sample_rows(docs, 5, 20_000, 4, 2)
    assert sorted({x[0] for x in got}) == ["aa", "bb"] and 1 <= sum(x[0] == "bb" for x in got) <= 4 and sum(x[0] == "aa" for x in got) == 5
    assert sum(len(x[2]) for x in got if x[0] == "bb") <= 100_000 and sum(x[1] == again for x in sample_rows(docs, 500, 20_000, 4, 2)) == 1
    by = {g["doc_id"]: g["lang_pred"] for g in identify_languages(docs).collect()}
    assert by[900] == "bb" and by[100] == "bb" and by[3] == "aa" and by[901] == by[902] == "und"
    train = [prose(words, 40) for _ in range(8)]
    m = CharModels(["aa"], 4)
    m._count([[w for t in train for w in t.split()]])
    for text in (train[0], prose(words, 20), prose(other, 5), "b"):
        assert abs(float(m.entropies(m.score_words(text.split()).sum(axis=0))[0]) - plain_entropy(train, text)) < 1e-9


def test_character_models_are_distributions():
    from tracelark.llm.language_id import CharModels, _grams

    m = CharModels.fit({"a": ["banana bandana cabana"] * 3, "b": ["obo bob boo xyzzy"] * 3}, order=3)
    for ctx in ("", "b", "an", "zz", "qq"):
        total = np.zeros(2)
        for c in [*"abcdnoxyz", " "]:
            h, _, _ = _grams([ctx + c.strip()], 3)
            i, lp = len(ctx) + 1, np.zeros(2)
            for o in range(min(3, i + 1), 0, -1):
                k = np.searchsorted(m.keys[o - 1], h[o - 1, i])
                if k < len(m.keys[o - 1]) and m.keys[o - 1][k] == h[o - 1, i]:
                    lp += m.logp[o - 1][k]
                    break
                if o == 1:
                    lp += m.floor
                    break
                q = np.searchsorted(m.ctx[o - 1], h[o - 2, i - 1])
                if q < len(m.ctx[o - 1]) and m.ctx[o - 1][q] == h[o - 2, i - 1]:
                    lp += m.back[o - 1][q]
            total += np.exp(lp)
        assert (total < 1 + 1e-9).all() and (total > 0.85).all()  # what is left is kept for letters never seen


# --- class-based n-grams


def test_class_lm_counts_and_base_score(spark, odd, clashing, odd_rows, none):
    import math
    from collections import Counter

    from tracelark.llm.class_lm import class_lm_digest

    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for r in odd_rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), held(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r[1])), 4)) for r in odd_rows)
    for df in (odd, clashing):
        got = class_lm_digest(df).collect()
        assert sorted((str(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 4)) for g in got) == want
        assert all(g["score"] < 0 for g in got)
    assert class_lm_digest(none).count() == 0


def test_class_lm_holds_few_texts_at_once(monkeypatch):
    """Of a large batch only a few texts at a time become Python objects; the blocks stay the same."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from tracelark.llm import class_lm

    monkeypatch.setattr(class_lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = class_lm.encode(SimpleNamespace(mapInArrow=lambda f, schema: f), 100_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000), pa.int64()), pa.array([b"w%d " % (i % 9) * 1_000 for i in range(5_000)])], names=["doc_id", "raw"])
    tracemalloc.start()
    rows = sum(len(x.doc_ids) for x in class_lm._blocks(run(iter([batch]))))
    assert rows == 5_000 and tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_class_lm_score_by_its_definition(spark):
    """The score against a plain version with the model's own classes; texts in blocks of any size; rows that repeat."""
    from tracelark.llm.class_lm import learn, encode, plain_scores, score_documents
    from tracelark.llm.common import Scratch, texts

    r = random.Random(16)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(vocab[int(300 * r.random() ** 3)] for _ in range(r.randrange(50)))) for i in range(120)]
    rows += [(7, rows[7][1])] * 40 + [(500, None), (None, "w1 w2 newword"), (501, "W1  w2\x1c w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, words = learn(Scratch(spark).table(encode(texts(docs), 2_000)), Scratch(spark), 10, 5, 20, 8, 0.1, 0.9)
    by = {x["h"]: (x["n"], x["cls"]) for x in words.collect()}
    got, _ = score_documents(docs, head=5, min_count=20, classes=8, block_bytes=2_000)
    want = plain_scores(rows, by, classes=8)
    have = sorted((str(g["doc_id"]), round(g["score"], 6)) for g in got.collect())
    assert have == sorted((str(i), round(x, 6)) for (i, _), x in zip(rows, want, strict=True))


def test_many_move_gains_same_as_one_by_one():
    from tracelark.llm.class_lm import many_move_gains, move_gains

    r = np.random.default_rng(3)
    classes, units = 6, 40
    cls = r.integers(0, classes, units)
    x = r.integers(0, 4, (units, units)).astype(float) * (r.random((units, units)) < 0.4)
    one = np.eye(classes)[cls]
    n = one.T @ x @ one
    own = np.diag(x)
    right, left = x @ one, x.T @ one
    right[np.arange(units), cls] -= own
    left[np.arange(units), cls] -= own
    got = many_move_gains(n, right, left, own, cls)
    for u in range(units):
        m = n.copy()
        m[cls[u], :] -= right[u]
        m[:, cls[u]] -= left[u]
        m[cls[u], cls[u]] -= own[u]
        assert np.allclose(got[u], move_gains(m, right[u], left[u], own[u]))


def test_class_lm_beats_the_base_on_held_out_texts(spark):
    from tracelark.llm.queries import QUERIES

    got = QUERIES["op2_class_lm"](spark, f"{DATA}/sf0.01").where("held_out").collect()
    assert sum(g["score"] for g in got) > sum(g["base_score"] for g in got)


def test_exchange_finds_planted_classes():
    from tracelark.llm.class_lm import exchange

    r = np.random.default_rng(1)
    kind = np.array([0, *([1, 2, 3] * 8)])
    follow = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0]])
    counts = np.array([[r.integers(20, 40) * follow[kind[a], kind[b]] for b in range(25)] for a in range(25)])
    got = exchange(counts, 4)
    assert all(len({int(got[k]) for k in range(25) if kind[k] == c}) == 1 for c in range(4))


@pytest.mark.parametrize("min_count", [5, 10**9])  # by exchange, and by the pass over words outside the core
def test_class_lm_classes_come_from_neighbours_not_from_endings(spark, min_count):
    """Words with one ending in two kinds of context; all but eight are less frequent than the head."""
    from tracelark.llm.class_lm import fit
    from tracelark.llm.common import Scratch, hash_words, texts

    r = random.Random(4)
    kinds = [[f"{k}{i}xyz" for i in range(40)] for k in "pq"]
    rows = []
    for i in range(600):
        k = r.randrange(2)
        rows.append((i, " ".join(f"{'ab'[k]} {r.choice(kinds[k])} {'cd'[k]}" for _ in range(12))))
    model, words = fit(texts(spark.createDataFrame(rows, "doc_id long, text string")), Scratch(spark), 10, 12, min_count, 8, 0.1, 0.9)
    got = {x["h"]: (x["n"], x["cls"]) for x in words.collect()}
    seen = [np.bincount([got[h][1] for h in hash_words([w.encode() for w in kind]).view(np.int64).tolist()], minlength=8) for kind in kinds]
    assert len(got) == 85 and sum(n for n, _ in got.values()) == model.tokens == model.class_total.sum()
    assert seen[0].argmax() != seen[1].argmax() and min(x.max() for x in seen) >= 36  # a local search may leave a word aside


def test_class_lm_transitions_are_of_all_bigrams(spark):
    """Each bigram of training tokens is in the class table once, inside the core and outside."""
    from collections import Counter

    from tracelark.llm.class_lm import fit
    from tracelark.llm.common import Scratch, hash_words, py_fold, texts

    r = random.Random(6)
    vocab = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(vocab[int(200 * r.random() ** 3)] for _ in range(r.randrange(60)))) for i in range(100)]
    model, words = fit(texts(spark.createDataFrame(rows, "doc_id long, text string")), Scratch(spark), 10, 5, 20, 8, 0.1, 0.9)
    cls = {x["h"]: x["cls"] for x in words.collect()}
    want = np.zeros((8, 8))
    for i, t in rows:
        if py_fold(i, 10):
            k = [cls[h] for h in hash_words([b"", *t.encode().split(), b""]).view(np.int64).tolist()]
            for pair, n in Counter(zip(k, k[1:])).items():
                want[pair] += n
    uni = (want.sum(axis=0) + 0.5) / (want.sum() + 4)
    assert np.allclose(model.class_total, want.sum(axis=0))
    assert np.allclose(model.transition, (want + 5 * uni) / (want.sum(axis=1, keepdims=True) + 5))


# --- licence scan


def test_every_sentence_rule_holds_its_trigger():
    from tracelark.llm.license_scan import RULES, SENTENCES

    names = {s[0] for s in SENTENCES}
    for name, trigger, pattern in SENTENCES:
        assert trigger in pattern, name
    assert {i for _, seq in RULES for i in seq} <= names


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, ["MIT"]),
        ("Released under the MIT License.", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("// Licensed under CC BY-NC 4.0.\nmore | text", ["CC-BY-NC-4.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3"]),
        ("it under the terms. You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published, either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1+"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted.\n* Redistributions of source code must retain the above copyright notice.\n* Redistributions in binary form must reproduce the above copyright notice.", ["BSD-2-Clause"]),
        ("All rights reserved.", ["Proprietary"]),
        ("Redistributions in binary form must reproduce the above copyright notice.", []),
        ("The permission slip is on the table.", []),
    ],
)
def test_licences(text, want):
    from tracelark.llm.license_scan import scan_text

    assert scan_text(text)[0] == want


def test_licence_rules_same_as_brute_force():
    """Random sequences of identifiers, many of one sentence, against the plain search."""
    from tracelark.llm.license_scan import RULES, match_rules, match_rules_plainly

    r = random.Random(4)
    names = sorted({i for _, seq in RULES for i in seq}) + ["Unknown", "BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "MitGrant", "MitNotice"] * 2
    for _ in range(400):
        at, found = 0, []
        for _ in range(r.randrange(30)):
            at += r.choice((0, 0, 1, 1, 2, 9))
            found.append((at, r.choice(names), {"v": "2"}))
        assert match_rules(found) == match_rules_plainly(found)


def test_licence_sentences_far_apart_and_long_rows():
    from tracelark.llm.license_scan import scan_text

    parts = MIT.split("\n\n")
    filler = "Nothing of note stands here. " * 40
    assert scan_text(filler.join(parts))[0] == ["MIT"]
    notice = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published, either version 2 of the License, or (at your option) any later version "
    began = time.time()
    licences, ids = scan_text(notice * 30_000)  # 5 MB without a sentence's end
    assert licences == ["GPL-2+"] and len(ids) == 30_000
    assert scan_text((MIT + "\n\n") * 8_000)[0] == ["MIT"]
    assert time.time() - began < 20


def test_licence_scan_odd(spark, odd, clashing, odd_rows, none):
    from tracelark.llm.license_scan import scan_licences

    for df in (odd, clashing):
        assert all(g["licences"] == [] for g in scan_licences(df).collect()) and scan_licences(df).count() == len(odd_rows)
    rows = [(1, MIT), (1, MIT), (None, MIT), (2, None), (3, ""), (4, MIT.upper() + "\n\n" + MIT)]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((g["doc_id"] or 0, len(g["licences"]), g["n_sentences"]) for g in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 0, 0), (3, 0, 0), (4, 1, 6)]
    assert scan_licences(none).count() == 0


# --- toxicity


def test_toxicity_on_labels(spark):
    from tracelark.llm.queries import QUERIES

    got = QUERIES["op5_toxicity"](spark, f"{DATA}/sf0.1").join(table(spark, "sf0.1", "labels"), "doc_id").where("held_out").collect()
    hit = sum(g["predicted"] for g in got if g["toxic"] == 1) / max(1, sum(g["toxic"] for g in got))
    false = sum(g["predicted"] for g in got if g["toxic"] == 0) / sum(g["toxic"] == 0 for g in got)
    assert hit > 0.8 and false < 0.03
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)


def test_toxicity_odd(spark, odd, clashing, odd_rows, none):
    from tracelark.llm.toxicity import drop_toxic, learn, toxicity_digest

    cols = "doc_id long, quality int, toxic int"
    for labels in ([], [(6, 1, 0), (9, 1, 1), (9, 1, 0), (None, 1, 1), (5, None, None), (77, 0, 1), (11, 1, 1)]):
        lab = spark.createDataFrame(labels, cols)
        for df in (odd, clashing):
            assert toxicity_digest(df, lab).count() == len(odd_rows)
        assert drop_toxic(clashing, learn(clashing, lab)).columns == clashing.columns
    assert toxicity_digest(none, spark.createDataFrame([], cols)).count() == 0


def test_toxicity_learns_once_from_a_repeated_row(spark, words):
    """A labelled doc_id that thousands of rows repeat, words of over 40 letters, and the label model against its plain version."""
    from tracelark.llm.toxicity import _sample, label_model, learn, plain_label_model, score_texts

    r = random.Random(12)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    slur = "zq" * 30
    rows = [(k, prose(30) + (f" {slur}" if k % 4 == 0 else "")) for k in range(400)] + [(8, "again " + slur)] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    sample = _sample(docs, labels, 5000, 5)[0].collect()
    assert len(sample) == len({x["doc_id"] for x in sample}) > 250
    model = learn(docs, labels)
    assert slur in model.terms
    got = score_texts(docs, model).collect()
    assert all(g["predicted"] == int(g["doc_id"] % 4 == 0) for g in got) and len(got) == 3400
    votes = np.array([[r.choice((-1, -1, 1 if k % 3 == 0 else 0)) for _ in range(5)] for k in range(60)])
    votes[:, 4] = votes[:, 3]  # a voter that repeats another
    assert np.allclose(label_model(votes, 0.3)[0], plain_label_model(votes.tolist(), 0.3))


def test_label_model_finds_good_and_bad_voters():
    from tracelark.llm.toxicity import label_model

    r = np.random.default_rng(3)
    y = (r.random(4000) < 0.3).astype(int)
    vote = lambda acc: np.where(r.random(4000) < 0.6, np.where(r.random(4000) < acc, y, 1 - y), -1)
    one = vote(0.9)
    votes = np.stack([one, one, vote(0.85), vote(0.8), vote(0.5)], axis=1)
    q, p, weight = label_model(votes, 0.3)
    assert ((q > 0.5) == y).mean() > 0.85
    assert p[1, 0, 2] > p[1, 4, 2] and weight[0] < weight[3]


# --- main text


def test_html_blocks_and_labels():
    from tracelark.llm.html_extract import PageWriter, blocks_of, label_pages, trained

    assert [b.text for b in blocks_of("<p>a<p>b &amp; c<script>x<p></script><b> d<br>e</p><ul><li>f<li>g</ul>")] == ["a", "b & c", "d e", "f", "g"]
    assert blocks_of("") == [] and blocks_of("plain < text")[0].text == "plain < text"
    w, bad, n = PageWriter(4242), 0, 0
    for _ in range(100):
        doc, y = w.page()
        b = blocks_of(doc)
        assert len(b) == len(y)
        p = label_pages([b], trained())[0]
        bad, n = bad + int(((p >= 0.5) != np.array(y)).sum()), n + len(y)
    assert bad / n < 0.05


def test_html_reads_every_word_and_every_container():
    from tracelark.llm.html_extract import Block, Open, blocks_of, features

    words = [f"word{k}" for k in range(1800)]
    plain = features([Block(" ".join(words), Open("p", "", None, 0), 0)])[0]
    for at in (0, 30, 900, 1799):
        other = features([Block(" ".join([*words[:at], "otherx", *words[at + 1 :]]), Open("p", "", None, 0), 0)])[0]
        assert not np.array_equal(plain[:-10], other[:-10])
    deep = lambda tag: features(blocks_of(f"<{tag}>" + "<div>" * 12 + "<p>text of a block</p>"))[0]
    assert not np.array_equal(deep("aside"), deep("div"))


def _blocks_plainly(doc):
    """(text, path, linked) by the standard library's parser, for pages whose tags all close."""
    from html.parser import HTMLParser

    from tracelark.llm.html_extract import INLINE, RAW, VOID

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.text, self.out, self.raw, self.links, self.linked = [], [], [], 0, 0, 0

        def flush(self):
            t = " ".join("".join(self.text).split())
            if t:
                self.out.append((t, tuple(self.open)))
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag in RAW:
                self.flush()
                self.raw += 1
            elif tag not in INLINE and tag not in VOID:
                self.flush()
                self.open.append(tag)
            elif tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.flush()

        def handle_endtag(self, tag):
            if tag in RAW:
                self.raw -= 1
            elif tag not in INLINE and tag not in VOID:
                self.flush()
                while self.open and self.open.pop() != tag:
                    pass

        def handle_data(self, data):
            if not self.raw:
                self.text.append(data)

    p = Plain()
    p.feed(doc)
    p.close()
    p.flush()
    return p.out


def test_html_blocks_same_as_plain_parser():
    """Random pages of properly closed tags."""
    from tracelark.llm.html_extract import blocks_of

    r = random.Random(9)
    words = ["alpha", "b&amp;c", "x < y", "é", "1&#50;3", "gamma  delta"]

    def node(depth):
        kind = r.choice(("div", "section", "ul", "b", "a", "text", "text", "br", "script", "comment", "article", "table"))
        if kind == "text" or depth > 6:
            return r.choice(words) + " "
        if kind in ("br", "script", "comment"):
            return {"br": "<br>", "script": "<script>if (a < b) x('</p>')</script>", "comment": "<!-- <p> -->"}[kind]
        inner = "".join(node(depth + 1) for _ in range(r.randrange(4)))
        if kind == "ul":
            inner = "".join(f"<li title='a > b'>{node(depth + 1)}</li>" for _ in range(r.randrange(3)))
        if kind == "table":
            inner = "".join(f"<tr><td>{node(depth + 2)}</td><th>x</th></tr>" for _ in range(r.randrange(3)))
        return f'<{kind} class="c{depth}" data-x=">">{inner}</{kind}>'

    for _ in range(300):
        doc = "".join(node(0) for _ in range(4))
        assert [(b.text, tuple(t for t, _ in b.path)) for b in blocks_of(doc)] == _blocks_plainly(doc), doc


@pytest.mark.parametrize("part", ['<a "', "<a ' \" >", "<!", "<head>", "<div>", "<div><p>x", "<center><li></li>", "<i><b></i>", "<head><body>", "</p>", "<a href=x>y", "<li><ul><x>", "<!--", "<script>"])
def test_html_long_pages_take_linear_time(part):
    from tracelark.llm.html_extract import blocks_of

    began = time.time()
    blocks_of(part * (1_500_000 // len(part)))
    blocks_of("<li><ul>" + "<center>" * 50_000 + part * 50_000 + ">")
    assert time.time() - began < 30


def test_html_query_against_the_markup(spark):
    """The network's choice against the article element of the stored pages."""
    from tracelark.llm.html_extract import blocks_of
    from tracelark.llm.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in table(spark, "sf0.001", "pages").collect()}
    same = 0
    for g in QUERIES["op6_html_extract"](spark, f"{DATA}/sf0.001").collect():
        want = "\n\n".join(b.text for b in blocks_of(pages[g["page_id"]] or "") if any(t == "article" for t, _ in b.path))
        same += g["text"] == want
        assert g["n_chars"] == len(g["text"])
    assert same / len(pages) > 0.9


def test_html_odd(spark):
    from tracelark.llm.html_extract import extract_main_text

    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p"), (3, "u", "<div>" * 3000 + "deep"), (4, "u", "<p>" + "word " * 100_000), (4, "u", "<p>" + "word " * 100_000), (5, None, "&#0;&bogus; \x00")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = extract_main_text(df).collect()
    assert len(got) == len(rows) and all(g["text"] == "" for g in got if g["page_id"] in (1, None))
    assert extract_main_text(df.limit(0)).count() == 0


# --- nearest neighbours


def test_neighbours_recall(spark):
    from tracelark.llm.graph_ann import brute_force, nearest_neighbours

    df = table(spark, "sf0.1", "embeddings")
    want = brute_force([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got: dict = {}
    for r in nearest_neighbours(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {i for i, _ in x}) for q, x in want.items())
    assert hits / sum(map(len, want.values())) > 0.95
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False))


def test_neighbours_odd(spark):
    from tracelark.llm.graph_ann import brute_force, nearest_neighbours

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [3.0, 4.0]), (40, [-1.0, 2.0])]
    rows += [(100 + k, [0.5, 0.5]) for k in range(60)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_neighbours(df).collect())
    want = sorted((q, k + 1, i, s) for q, x in brute_force(rows).items() for k, (i, s) in enumerate(x))
    assert got == want
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_neighbours(df, least_shards=2, query_rows=2).collect()) == want  # blocks of queries
    assert nearest_neighbours(df.limit(0)).count() == 0


# --- pipeline


def test_pipeline_against_its_plain_parts(spark, tmp_path):
    """run() on the smallest tables against stages written out plainly."""
    import corpus_pipeline as p
    import public_tokenizers
    import tiktoken

    from tracelark.llm import decontaminate, ngram_join, toxicity
    from tracelark.llm.byte_bpe import read_ranks
    from tracelark.llm.line_dedup import _key

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    docs, labels = table(spark, "sf0.001", "documents"), table(spark, "sf0.001", "labels")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity.score_texts(docs, toxicity.learn(docs, labels)).where("predicted = 1").collect()}
    rows = {i: t for i, t in rows.items() if i not in bad}
    held: dict = {}
    for i, t in rows.items():
        for line in t.encode().split(b"\n"):
            held.setdefault(_key(line), set()).add(i)
    keep = lambda i, x: len(x.decode()) < 20 or len(held[x]) < 3 or max(held[x]) == i
    rows = {i: b"\n".join(x for x in t.encode().split(b"\n") if keep(i, _key(x))).decode() for i, t in rows.items()}
    groups = ngram_join.brute_force(list(rows.items()))
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in table(spark, "sf0.001", "benchmark").collect()]
    m = decontaminate.Matcher([(k, decontaminate.normalise(t)) for k, t in items], 20)
    rows = {i: t for i, t in rows.items() if not m.scan(decontaminate.normalise(t))}
    ranks = {x: k for k, x in enumerate(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, np.array(enc.encode_ordinary(t), dtype="<u4").tobytes()) for i, t in rows.items())
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in p.run(spark, f"{DATA}/sf0.001").collect()) == want


@pytest.mark.parametrize("stage", ["drop_toxic", "line_hits", "cards", "drop_contaminated", "encode_documents"])
def test_pipeline_workers_hold_few_texts_at_once(monkeypatch, stage):
    """Of a batch of all texts of a task only a few at a time become Python objects, and no row is lost."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import public_tokenizers

    from tracelark.llm import byte_bpe, common, decontaminate, line_dedup, ngram_join, toxicity

    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), columns=["doc_id", "text"], schema=None, mapInArrow=lambda f, schema: f)
    docs.where = docs.withColumn = docs.select = lambda *a: docs
    for m in (byte_bpe, decontaminate, line_dedup, ngram_join, toxicity):
        monkeypatch.setattr(m, "texts", lambda *a: docs)
    monkeypatch.setattr(common, "ship_package", lambda s: None)
    monkeypatch.setattr(ngram_join, "Scratch", lambda s: None)
    monkeypatch.setattr(ngram_join.F, "xxhash64", lambda *a: None)
    monkeypatch.setattr(decontaminate, "_first_block", lambda *a: ([(1, "an item of the benchmark that no text holds")], None))
    run = {
        "drop_toxic": lambda: toxicity.drop_toxic(docs, toxicity.Model(bias=-1.0)),
        "line_hits": lambda: line_dedup.line_hits(docs),
        "cards": lambda: ngram_join.NgramJoin(docs).cards(np.zeros(0, np.uint64)),
        "drop_contaminated": lambda: decontaminate.drop_contaminated(docs, None),
        "encode_documents": lambda: byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    }[stage]()
    n = 4_000
    raws = pa.array([b"words of line %d \n" % (i % 50) * 250 for i in range(n)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), raws, pa.array(range(n), pa.int64())], names=["doc_id", "raw", "text_hash"])
    next(iter(run(iter([batch.slice(0, 1)]))))  # imports are not counted
    tracemalloc.start()
    ids = [i for b in run(iter([batch])) for i in {*b.column(0).to_numpy().tolist()}]
    assert tracemalloc.get_traced_memory()[1] < 12_000_000
    tracemalloc.stop()
    assert sorted(ids) == (list(range(n)) if stage != "line_hits" else [])  # no line is long enough


def test_toxicity_starts_one_kind_of_worker(spark, monkeypatch):
    """Rows of Python objects given to Spark would start workers of RDDs beside those of the operators."""
    from pyspark import SparkContext

    from tracelark.llm.toxicity import learn

    docs, labels = table(spark, "sf0.01", "documents"), table(spark, "sf0.01", "labels")

    def refuse(*args):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    assert learn(docs, labels).terms


def test_pipeline_odd(spark, odd_rows, clashing, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns, and an empty table."""
    import corpus_pipeline as p

    for name, docs in (("odd", clashing), ("empty", none)):
        at = tmp_path / name
        docs.coalesce(1).write.parquet(str(at / "documents.parquet"))
        for t in ("labels", "benchmark"):
            table(spark, "sf0.001", t).where("false" if name == "empty" else "true").write.parquet(str(at / f"{t}.parquet"))
        got = p.run(spark, str(at)).collect()
        if name == "empty":
            assert got == []
            continue
        # the line of 6, 7 and -3 stays in 8 alone, so 6 and 7 are left empty; 10 is a copy of 9
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows if r[0] != 10)
        by = {r["doc_id"]: r["n_tokens"] for r in got}
        assert by[1] == by[2] == by[6] == by[7] == 0 and by[8] > 0 and by[4] > 10_000
