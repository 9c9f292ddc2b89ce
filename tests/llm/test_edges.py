"""Null, empty, very long, tied and repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from riskloom.llm import common, decontam, exact_dedup, licenses, packing, quality, secret_scan, simhash, token_order, toxicity, warc
from riskloom.llm.queries import table
from test_brute_force import QUESTION

LONG = "Erst hende annd orhe, 12 km tion. " * 20_000
ROWS = [(1, "a b c d"), (2, None), (3, ""), (4, LONG), (5, "a b c d"), (5, "a b c d"), (None, "a b  c d"), (None, None), (6, "A B C D"), (7, " \n ")]
CLASH = ["digest", "run", "key", "fp", "score", "size", "bytes", "best", "keep_id", "piece", "length", "slot", "h", "pos", "item_id", "held_out", "doc", "html", "y"]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string")
    return made.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit("x") for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF_SMALL, "labels").unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def bench(spark):
    return table(spark, SF_SMALL, "benchmark").unionByName(spark.createDataFrame([(None, "x y"), (-1, None), (-2, "")], "item_id long, text string"))


ROW_WISE = {
    "toxicity": lambda d, l: toxicity.classify(d, l),
    "quality": lambda d, l: quality.classify(d, l),
    "secrets": lambda d, l: secret_scan.summary(secret_scan.scan(d)),
    "licenses": lambda d, l: licenses.summary(licenses.scan(d)),
    "exact": lambda d, l: exact_dedup.exact_dedup(d),
    "near": lambda d, l: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_a_row_for_each_row(name, docs, none, labels):
    got = ROW_WISE[name](docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    assert ROW_WISE[name](none, labels).count() == 0
    if hasattr(got[0], "score"):
        assert all(0 <= r.score <= 1 for r in got)


def test_exact_dedup_ties(docs):
    got = {}
    for r in exact_dedup.exact_dedup(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[1].keep_id is None and got[1].group_size == 4  # the longest original has a null id
    assert got[2].keep_id == 7 and got[2].group_size == 4
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "6", "7", "None"]


def test_repeated_rows_collapse(spark):
    d = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, "x y"), (3, "z")], "doc_id int, text string")
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(d).collect()) == [1, 3]


def test_simhash_of_no_words(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect() if r.doc_id}
    assert {got[i].fingerprint for i in (2, 3, 7)} == {"0" * 16} and {got[i].component_id for i in (2, 3, 7)} == {2}
    assert got[1].component_id == got[5].component_id == got[6].component_id == 1
    stay = simhash.keep_one(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {1, 2, 4, None}


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {i for i, _ in ROWS}
    assert [(r.piece, r.start, r.length) for r in got if r.doc_id == 3] == [(0, 0, 1)]
    assert packing.pack(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and min(x)[0] == 0 for x in by.values())


def test_training_order(docs, none):
    folder, rows = token_order.write_training_order(docs, seq_len=64, shard_slots=100)
    assert sorted(r.slot for r in rows.collect()) == list(range(rows.count()))
    assert len(list(token_order.read_slots(folder))) == rows.count()
    assert token_order.training_order(none).count() == 0


def test_decontamination(spark, docs, none, bench):
    assert decontam.leaks(docs, bench).count() == 0 == decontam.leaks(none, bench).count()
    assert decontam.leaks(docs, bench.where("item_id = -5")).count() == 0
    item = bench.where("item_id = 3").first().text
    leaky = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit(f"x. {item}\n{item}")}))
    assert [r.doc_id for r in decontam.leaks(leaky, bench).where("leaked").collect()] == [99]
    assert decontam.drop_leaks(leaky, bench).count() == len(ROWS) and decontam.drop_leaks(leaky, bench).columns == docs.columns


def test_leaks_of_repeated_and_null_ids(spark):
    """Slots of one text are never read in another text of the same id; a null id is an id like others."""
    changed = QUESTION.replace("40 km", "75 km").replace("Maria Smith starts", "Peter Jones starts")  # one value of the item, two here
    rows = [(1, QUESTION), (1, "short, clean and with none of it"), (1, "x " * 300 + QUESTION.replace(" 5 ", " 6 ")), (None, QUESTION), (None, "clean"), (2, changed), (None, changed)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"__key": F.lit("a"), "__gone": F.lit("b"), "key": F.lit("c"), "slot": F.lit(1), "word": F.lit(2)})
    bench = spark.createDataFrame([(9, QUESTION)], "item_id int, text string")
    found = [(r.doc_id, r.leaked, r.consistent) for r in decontam.leaks(docs, bench).collect()]
    assert sorted(found, key=str) == sorted([(1, True, True), (1, True, True), (None, True, True), (2, False, False), (None, False, False)], key=str)
    left = decontam.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, "clean"), (0, changed), (1, rows[1][1]), (2, changed)])


def test_near_copies_of_repeated_ids(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3
    rows = [(1, text), (2, text), (2, "something else altogether, about other matters, in other words, of no concern"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"__gone": F.lit("b"), "KEY": F.lit("c"), "fp": F.lit(0)})
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, text), (1, text), (2, rows[2][1])])
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs.where("doc_id > 0")).collect()) == sorted([(1, text), (2, rows[2][1])])


def test_the_labelled_sample_is_bounded_by_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 3, "doc_id int, quality int")
    texts = [(7, f"text {i}") for i in range(4000)] + [(i, f"other {i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = common.labelled_sample(labels, docs, "quality", F.lit(False), 50).collect()
    assert len(got) == 50 == len({r.h for r in got})
    every = common.labelled_sample(labels, docs, "quality", F.lit(False), 5000)
    assert every.count() == 200
    assert [r.text for r in every.collect()] and sum(r.text.startswith("text") for r in every.collect()) <= 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_do_not_depend_on_the_partitions(spark, module):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    one = {r.doc_id: r.score for r in module.classify(docs, labels).collect()}
    two = {r.doc_id: r.score for r in module.classify(docs.repartition(7), labels.repartition(5)).collect()}
    assert max(abs(one[i] - two[i]) for i in one) < 1e-9


def test_archive(spark):
    rows = [(1, "http://a.b/c", "same"), (2, "http://a.b/c", "same"), (2, "http://a.b/c", "same"), (3, None, None), (4, "http://x.y/\n z", ""), (None, "http://a.b/c", "same"),
            (5, "http://long.example/", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "bytes", "run", "keep", "file")})
    got = warc.round_trip(pages).collect()
    told = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert len(got) == len(rows)
    assert told == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), None: ("revisit", 2, 4), 5: ("response", None, 600_000)}
    archive, _ = warc.write_archive(pages, min_revisit_bytes=1)
    texts = spark.createDataFrame([("a\r\nb%", "http://u/", "p"), ("ü", "http://u/", "p"), ("c", "http://u/", None)], "page_id string, url string, html string")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(texts).collect()}
    assert found == {"a\r\nb%": ("revisit", "ü"), "ü": ("response", None), "c": ("response", None)}
    assert warc.round_trip(texts.selectExpr("cast(length(page_id) as int) AS page_id", "url", "html")).schema["page_id"].dataType.simpleString() == "int"
    assert warc.round_trip(pages.where("page_id = -1")).count() == 0 and archive.upper


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, docs, none, stage):
    _, f = corpus_pipeline.STAGES[stage]
    assert f(spark, docs, SF_SMALL).columns == docs.columns
    assert f(spark, none, SF_SMALL).count() == 0


def test_without_labels_nothing_is_rejected(spark, docs, labels):
    assert quality.keep_good(docs, labels.where("doc_id = -1")).count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in toxicity.classify(docs, labels.where("doc_id = -1")).collect())


def test_without_labels_the_lexicon_votes(spark):
    rows = [(i, f"a plain note about gardens number {i} and water" if i % 10 else f"well you stupid moron, what a pathetic loser {i}") for i in range(600)]
    docs, none = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([], "doc_id int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(docs, none).collect()}
    assert min(got[i] for i in got if i % 10 == 0) > 0.5 > max(got[i] for i in got if i % 10)


def test_patterns_alone_move_the_scores(spark):
    """The words are the same in both classes; only shouting tells them apart."""
    import random

    rng = random.Random(5)
    words = [f"word{k}" for k in range(60)]
    rows = []
    for i in range(1500):
        text = " ".join(rng.choices(words, k=40))
        rows.append((i, i % 4 == 0, (text + "!" * 12).upper() if i % 4 == 0 else text))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y, _ in rows], "doc_id int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    one, zero = [got[i] for i, y, _ in rows if y], [got[i] for i, y, _ in rows if not y]
    assert sum(one) / len(one) > 0.5 > 0.2 > sum(zero) / len(zero)
