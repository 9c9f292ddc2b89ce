"""The pipeline's rows against a brute-force version on small tables."""

import re

import numpy as np

import corpus_pipeline
from conftest import SF_SMALL
from riskloom.llm import quality
from riskloom.llm.queries import table
from riskloom.llm.token_ids import default_tokenizer, piece_tokenizer
from test_brute_force import classes, simhash_of


def test_run(spark):
    docs = table(spark, SF_SMALL, "documents")
    good = {r.doc_id: r.text or "" for r in quality.keep_good(docs, table(spark, SF_SMALL, "labels")).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t) for i, t in good.items()}
    best = {}
    for i in good:
        best[norm[i]] = min(best.get(norm[i], i), i, key=lambda k: (-len(good[k]), k))
    ids = sorted(best.values())
    ids = [ids[k] for k, r in enumerate(classes([simhash_of(good[i]) for i in ids])) if r == k]
    word = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    items = [word(r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]

    def leaks(i):
        own = word(good[i])
        seen = {tuple(own[k : k + 8]) for k in range(len(own) - 7)}
        return any(np.mean([tuple(w[k : k + 8]) in seen for k in range(len(w) - 7)]) >= 0.5 for w in items if len(w) > 7)

    want = {i for i in ids if not leaks(i)}
    got = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    coder = piece_tokenizer(default_tokenizer())
    assert set(got.doc_id) == want
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(coder.whole.encode(good[i], add_special_tokens=False).ids) + 1 for i in want}
