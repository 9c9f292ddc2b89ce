"""Substring dedup, phrase collocations and whitening against brute force, with the edges of each."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import collocations, substring_dedup, whitening

# ---- substring dedup ----------------------------------------------------------------------------


def kept_words(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.choice([34, 35, 36, 50, 90]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(w))
    return texts


def test_cover_has_every_difference():
    for period in range(1, 22):
        cover = substring_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(substring_dedup.difference_cover(21)) == 5 and len(substring_dedup.difference_cover(7)) == 3


@pytest.mark.parametrize(("window", "period"), [(35, 21), (35, 7), (35, 35), (5, 3), (4, 1), (1, 1)])
def test_repeats_are_those_of_brute_force(spark, window, period):
    texts = corpus(window * 100 + period, vocabulary=400 if window > 5 else 40)
    texts += [None, "", " \t\n", "a b", texts[3], texts[3], "x " * 80, "tail one \x1c two"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, window=window, period=period).collect()}
    assert got == dict(enumerate(kept_words(texts, window)))


def test_lots_know_what_they_hold_twice(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LOT", 50)
    texts = corpus(3) * 2
    lots = substring_dedup._Lots()
    made = [b for _ in range(5) for b in lots.add(np.arange(40, dtype=np.uint64) % 7, np.zeros(40, np.uint32), np.arange(40), np.arange(40))]
    rows = sum(b.num_rows for b in [*made, *lots.rest()])
    assert rows == 200  # nothing is lost
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {i: k[1] for i, k in enumerate(kept_words(texts, 35))}


def test_repeats_edges(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, key int")
    assert substring_dedup.remove_repeats(empty).count() == 0
    long_text = " ".join(str(i) for i in range(60_000))
    rows = [(None, long_text), (None, "the end"), ("a", long_text + " x"), ("a", None)]
    got = substring_dedup.summary(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"))).collect()
    assert sorted((r.doc_id or "", r.n_words, r.n_removed) for r in got) == [("", 2, 0), ("", 60_000, 60_000), ("a", 0, 0), ("a", 60_001, 60_000)]
    digest = {(r.n_words, r.kept_sha256) for r in got}
    assert (60_001, hashlib.sha256(b"x").hexdigest()) in digest and (0, hashlib.sha256(b"").hexdigest()) in digest
    with pytest.raises(ValueError, match="period"):
        substring_dedup.remove_repeats(empty, window=3, period=4)


# ---- phrase collocations ------------------------------------------------------------------------


def best_phrases(rows, min_count, top, depth=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = {}
    often = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= min_count}
    inner = {}
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inner[lang, p[i : i + m]] = max(a, inner.get((lang, p[i : i + m]), 0))
    for (lang, p), a in often.items():
        if inner.get((lang, p), 0) >= a:
            continue
        n = words[lang]
        score, cut = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:cut]], counts[lang, p[cut:]], n))
    return {(lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, all_ in found.items() for i, (s, a, p, l, r, n) in enumerate(sorted(all_)[:top])}


def phrase_rows(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "süß", "naïve", "x", "日本", "a-b", "\x1c", "1", "é", "long" * 20] + [f"w{i}" for i in range(30)]
    weights = [60, 20, 40, 10, 10, 8, 6, 6, 4, 4, 3, 3] + [1] * 30
    fixed = [["new", "York", "city"], ["of", "the", "the"], ["deep", "blue", "sea", "at", "night", "now"], ["x", "x", "x", "x", "x", "x"]]
    out = []
    for _ in range(n):
        w = rng.choices(vocabulary, weights, k=rng.randrange(0, 30))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(fixed)
        out.append((rng.choice(["en", "en", "de", None, ""]), "".join(x + rng.choice([" ", " ", " ", "\t ", ", ", "\r", "."]) for x in w)))
    return [*out, ("en", None), (None, ""), ("fr", "only one"), ("en", "!?;" * 50)]


@pytest.mark.parametrize(("min_count", "budget", "dictionary", "cells"), [
    (5, 1 << 19, 1 << 17, 1 << 24), (5, 40, 50, 1 << 19), (5, 10, 1 << 17, 1 << 10), (5, 40, 4, 64), (1, 30, 1 << 17, 8), (20, 1, 3, 1 << 19)])
def test_phrases_are_those_of_brute_force(spark, min_count, budget, dictionary, cells):
    rows = phrase_rows(min_count + budget)
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id int, lang string, text string").repartition(4)
    got = collocations.collocations(docs, min_count=min_count, budget=budget, dictionary=dictionary, cell_count=cells, top=300)
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()}
    assert got == best_phrases(rows, min_count, 300)


def test_heavy_words_are_cut_into_longer_prefixes(spark, monkeypatch):
    docs = spark.createDataFrame(phrase_rows(9), "lang string, text string")
    seen, plain = [], collocations.Dictionary.__post_init__
    monkeypatch.setattr(collocations.Dictionary, "__post_init__", lambda self: seen.append(self) or plain(self))
    collocations.frequent_phrases(docs, min_count=5, budget=20)
    depths = Counter(len(seen[-1].split(h)) for h in seen[-1].heavy)
    assert depths[1] >= 2 and depths[2] >= 1 and max(depths) <= 4


def test_subtree_batches_may_cut_nodes(spark):
    rows = phrase_rows(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, min_count=4, top=None).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == best_phrases(rows, 4, None)


def test_codes_are_prefix_free():
    ranks = [0, 191, 192, 193, 12_479, 12_480, 12_481, 900_000]
    codes = [collocations.code(r) for r in ranks]
    assert [len(c) for c in codes] == [1, 1, 2, 2, 2, 3, 3, 3] and codes == sorted(codes)
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    with pytest.raises(ValueError, match="too large"):
        collocations.code(1 << 20)


def test_phrases_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string, score int, phrase string")
    assert collocations.collocations(empty).count() == 0
    rows = [("en", "ab cd " * 30_000)] * 2
    got = collocations.collocations(spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, score int, phrase string")).collect()
    assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == best_phrases(rows, 100, 2000)


# ---- whitening ----------------------------------------------------------------------------------


def whitened(vectors, components=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    centred = once - sums / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1][:components], turned[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ turned / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("block_rows", [7, 64, 1024])
def test_whitening_is_that_of_numpy(spark, block_rows):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(300, 9)) * [5, 4, 3, 2, 1, 1, 1, 1, 1]).astype(np.float32)
    v[100:150] = v[7]  # one vector many times
    rows = [(i, [float(c) for c in x], "extra") for i, x in enumerate(v)]
    bad = [(1000, None, "x"), (1001, [1.0, None] + [0.0] * 7, "x"), (1002, [float("nan")] * 9, "x"), (1003, [float("inf")] + [0.0] * 8, "x"), (1004, [1.0], "x"), (1005, [], "x"), (1006, [1e30] * 9, "x")]
    docs = spark.createDataFrame(rows + bad, "vec_id int, embedding array<float>, n string").repartition(6)
    got = whitening.whiten(docs, block_rows=block_rows).orderBy("vec_id", "component").collect()
    n, deviation, y, share = whitened(v)
    assert [r.vec_id for r in got] == np.repeat(np.arange(300), 4).tolist() and [r.component for r in got] == [1, 2, 3, 4] * 300
    assert {r.n for r in got} == {n} and [r.deviation for r in got] == np.repeat(deviation, 4).tolist()
    made = np.array([r.whitened for r in got]).reshape(-1, 4)
    assert np.allclose(made * np.sign((made * y).sum(axis=0)), y, rtol=1e-9, atol=1e-9)
    assert np.allclose([r.explained for r in got[:4]], share, rtol=1e-9) and {r.identity_error for r in got}.pop() < 1e-9


def test_whitening_edges(spark):
    kind = "vec_id string, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", None)], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 5, kind)).count() == 0  # no spread
    got = whitening.whiten(spark.createDataFrame([(None, [0.0, 0.0, 1.0]), ("b", [1.0, 1.0, 1.0]), ("b", [1.0, 1.0, 1.0])], kind)).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and {r.n for r in got} == {2}  # two vectors: one component
    assert sorted(round(abs(r.whitened), 9) for r in got) == [1, 1, 1] and {r.explained for r in got} == {1.0}
    far = whitening.whiten(spark.createDataFrame([("a", [1e14, 0.0]), ("b", [0.0, 1.0])], kind)).collect()
    assert {r.deviation for r in far} == {None}  # beyond a long


def test_fit_list_numbers_have_no_gaps(spark):
    rows = [(i, [float(i % 50), 1.0]) for i in range(200)]
    found = whitening.whole_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(7))
    assert sorted(r["index"] for r in whitening.fit_list(found).collect()) == list(range(50))
