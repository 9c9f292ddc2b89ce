"""Cases that an operator once cut short."""

import random
import re
import time

import numpy as np
import pytest

from riskloom.llm import decontam, licenses, secret_scan, textbytes
from test_brute_force import QUESTION

ALICE = "Alice has 5 apples. Bob gave Alice 3 apples. Alice ate 2 apples. Alice sold 4 apples to Carl."
GERMAN = ("Der Zug verlässt den Bahnhof um Mittag, und der Lehrer aus Bremen geht mit einem Hund durch den Wald nach Hause, wo der Nachbar auf "
          "einen Brief von der Bank und auf das Geld aus der Stadt wartet.")


def leaking(spark, docs, items):
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    return {(r.doc_id, r.item_id): r for r in found.collect() if r.leaked}


# ---- decontamination -------------------------------------------------------------------------------


def test_names_at_sentence_starts_and_changed_case(spark):
    other = "Bob has 7 apples. Carl gave Bob 6 apples. Bob ate 9 apples. Bob sold 8 apples to Dan."
    row2 = "Before. " + QUESTION.replace("Maria Smith", "John").replace("40", "75").upper().lower() + " After."
    odd = "Bob has 7 apples. Carl gave Eve 6 apples. Finn ate 9 apples. Gus sold 8 apples to Dan."  # one name, four values
    docs = [(1, other), (2, row2), (3, "X. " + ALICE.upper()), (4, ALICE.lower()), (5, GERMAN.lower()), (6, GERMAN.upper()), (7, odd)]
    got = leaking(spark, docs, [(1, ALICE), (2, QUESTION), (3, GERMAN)])
    assert set(got) == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 3), (6, 3)}
    assert got[1, 1].consistent and got[1, 1].coverage == 1.0
    assert got[5, 3].coverage == got[6, 3].coverage == 1.0


def test_items_of_few_literal_words_are_searched(spark):
    items = ["What is 12 + 35?", "Solve 3x + 5 = 20.", "Compute 15 * 3 - 4 / 2 + 17 * 9.", "Define entropy.", ALICE]
    docs = [(i, f"Some text before. {t} And some after it.") for i, t in enumerate(items)]
    docs += [(10, "What is 13 + 35?"), (11, "Solve 3x + 5 = 21."), (12, "Compute 15 * 3 - 4 / 2 + 17 * 8."), (13, "Define it as entropy."), (14, items[2].upper())]
    got = leaking(spark, docs, list(enumerate(items)))
    assert set(got) == {(i, i) for i in range(5)} | {(14, 2)}
    assert all(r.consistent and r.coverage == 1.0 for r in got.values())


# ---- secrets ---------------------------------------------------------------------------------------

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
PLAIN = "the ship went out at dawn and nobody saw it again until the end of the long year in which we met".split()


def random_spans(spark, rows):
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    return {r.doc_id: [s.kind for s in r.spans if s.kind.startswith("random")] for r in found}


def prose(rng, n):
    return " ".join(rng.choices(PLAIN, k=n))


def test_a_key_is_found_without_long_words(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60)) for i in range(400)] + [(1000, f"use {''.join(rng.choices(B64, k=40))} here")]
    found = random_spans(spark, rows)
    assert found[1000] == ["random-base64"] and not any(found[i] for i in range(400))


def test_order_numbers_are_no_keys_and_hide_none(spark):
    rng = random.Random(2)
    number = lambda: "".join(rng.choices("0123456789", k=16))
    rows = [(i, f"order {number()} {prose(rng, 50)} {number()}") for i in range(1000)]
    rows += [(5000 + i, f"key {''.join(rng.choices('0123456789abcdef', k=22))} {prose(rng, 20)}") for i in range(20)]
    found = random_spans(spark, rows)
    assert not any(found[i] for i in range(1000)) and sum(found[5000 + i] == ["random-hex"] for i in range(20)) >= 15


def test_false_discoveries_stay_below_the_rate(spark):
    rng = random.Random(3)
    name = lambda: rng.choice("_-/").join(rng.choices(PLAIN, k=8)).title()[:rng.randrange(18, 60)] + str(rng.randrange(10))
    rows = [(i, f"{prose(rng, 120)} {name()}") for i in range(1500)]
    rows += [(5000 + i, f"{prose(rng, 120)} {''.join(rng.choices(B64, k=rng.randrange(24, 60)))}") for i in range(150)]
    found = random_spans(spark, rows)
    false, true = sum(len(found[i]) for i in range(1500)), sum(bool(found[5000 + i]) for i in range(150))
    assert true > 120 and false <= 0.05 * (true + false)


def test_base_spans_of_a_long_text_are_merged_by_place(spark):
    text = " ".join(f"token={i:06d}abc{'0123456789abcdef' * 2}" for i in range(20_000))
    began = time.time()
    rows = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert len([s for s in rows[0].base if s.kind == "assign"]) == 20_000 and time.time() - began < 60


def test_controls_take_whole_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choices(B64, k=n)) for n in (15, 16, 17, 100, 5003, 300_000)]
    data, starts = textbytes.apart(np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    ends = starts + [len(t) for t in texts]
    tested = []
    battery, secret_scan.battery = secret_scan.battery, lambda d, a, b, code: (tested.append((d, a, b, code)), np.zeros(len(a)))[1]
    try:
        told = list(secret_scan.resampled(data, starts, ends, np.ones(len(data), bool)))
    finally:
        secret_scan.battery = battery
    base64 = secret_scan.NAMES.index("base64")
    drawn = [(d, a, b) for d, a, b, code in tested if code[0] == base64]
    seen = {i for _, a, b in drawn for x, y in zip(a.tolist(), b.tolist(), strict=True) for i in range(x, y)}
    assert seen == set(range(15, sum(map(len, texts))))  # every character; 15 make no control
    assert all((b - a >= secret_scan.LEAST).all() for _, a, b in drawn) and max((b - a).sum() for _, a, b in drawn) < 2 * secret_scan.TESTED
    assert all((own == secret_scan.length_class(b - a)).all() for (_, own, _), (_, a, b, _) in zip(told, tested, strict=True))


# ---- licenses --------------------------------------------------------------------------------------


def samples(parsed):
    """A few texts that a parsed pattern matches: each alternative once, repeats at their least and (if optional) once."""
    made = [""]
    for op, arg in parsed:
        op = str(op)
        if op in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "IN":
            more = [chr(v if str(k) == "LITERAL" else v[0]) if str(k) != "CATEGORY" else " " for k, v in arg]
        elif op == "SUBPATTERN":
            more = samples(arg[-1])
        elif op == "BRANCH":
            more = [t for x in arg[1] for t in samples(x)]
        else:
            low, high, body = arg
            more = [t * max(low, 1) for t in samples(body)] + ([""] if low == 0 else [])
        n = max(len(made), len(more))
        made = [made[i % len(made)] + more[i % len(more)] for i in range(n)]  # each part once, not all combinations
    return made


def test_license_gate_is_necessary():
    gate = [k.decode() for k in licenses.keywords()]
    for name, _, _, needs, pattern in licenses.rules():
        texts = [t for t in samples(re._parser.parse(pattern.pattern)) if pattern.search(t)]
        assert texts, name
        for t in texts:
            assert all(any(k in t for k in group) for group in needs), (name, t)
            assert any(k in t for k in gate), (name, t)


@pytest.mark.parametrize("text, label", [
    ("https://creativecommons.org/publicdomain/zero/1.0", "cc0"), ("SPDX-License-Identifier: PSF-2.0", "psf"), ("the PSF license", "psf"),
    ("under the Expat license", "mit"), ("creativecommons.org/publicdomain/mark/1.0", "public-domain"), ("SPDX-License-Identifier: nlod-1.0", "public-domain"),
    ("SPDX-License-Identifier: LicenseRef-Proprietary", "proprietary"), ("https://copyright.gov/title17/", "proprietary"), ("MIT No Attribution", "mit-0"),
    ("joinup.ec.europa.eu/collection/eupl", "eupl")])
def test_licenses_lost_by_the_gate(text, label):
    assert label in {d[2] for d in licenses.detect(text.lower())}
    assert any(k.decode() in text.lower() for k in licenses.keywords())


@pytest.mark.parametrize("text, labels", [
    ("MIT OR Apache-2.0", {"mit", "apache-2"}), ("Apache-2.0 AND BSD-3-Clause AND MIT", {"mit", "apache-2", "bsd-3"}), ("GPL-2.0-only", {"gpl-2"}),
    ("(MIT OR GPL-3.0-or-later) AND ISC", {"mit", "gpl-3", "isc"}), ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", {"gpl-2", "mit"})])
def test_each_license_of_an_expression(text, labels):
    assert {d[2] for d in licenses.detect(f"// spdx-license-identifier: {text.lower()}\n// spdx")} == labels


@pytest.mark.parametrize("text, labels", [
    ("license: MIT OR Apache-2.0", {"mit", "apache-2"}), ('license = "MIT OR Apache-2.0"', {"mit", "apache-2"}), ("licensed under MIT or Apache-2.0", {"mit", "apache-2"}),
    ('"license": "(MIT OR GPL-3.0-or-later)"', {"mit", "gpl-3"}), ("Dual-licensed under either MIT, ISC/zlib or the Apache-2.0.", {"mit", "isc", "zlib", "apache-2"}),
    ("license: isc", {"isc"}), ("it is licensed under mitigating terms", set())])
def test_expressions_in_every_way_of_stating_a_license(text, labels):
    assert {d[2] for d in licenses.detect(text.lower())} == labels


def test_license_texts_over_comment_lines():
    body = "/*\n * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation\n * files (the \"Software\")"
    assert {d[2] for d in licenses.detect(body.lower())} == {"mit"}
    assert any(k.decode() in body.lower() for k in licenses.keywords())


def test_suppression_is_that_of_all_pairs():
    rng = random.Random(3)
    cover, kept, spans = None, [], [tuple(sorted(rng.sample(range(60), 2))) for _ in range(400)]
    cover = licenses.Cover([a for a, _ in spans])
    for a, b in spans:
        held = any(x <= a and b <= y for x, y in kept)
        assert cover.holds(a, b) == held
        if not held:
            kept.append((a, b))
            cover.add(a, b)


def test_many_license_lines_in_one_text():
    text = "spdx-license-identifier: mit or apache-2.0\n" * 100_000
    began = time.time()
    assert len(licenses.detect(text)) == 200_000 and time.time() - began < 60
