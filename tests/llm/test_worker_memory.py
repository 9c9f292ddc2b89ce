"""Python workers are kept from stage to stage: what a task leaves behind must not stay in their pools."""

import subprocess
import sys

import pytest

PROBE = """
import sys
sys.path.insert(0, {root!r})
import random
import pyarrow as pa
from riskloom.llm import packing, token_ids
from riskloom.llm.common import give_back

def held():
    return next(int(x.split()[1]) / 1024 for x in open("/proc/self/status") if x.startswith("VmRSS"))

rng = random.Random(5)
words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(60000)]
texts = [" ".join(rng.choices(words, k=400)) for _ in range(4000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
del texts, words
give_back()
rows = sum(b.num_rows for b in packing.pieces(iter([batch, batch]), token_ids.default_tokenizer(), 1024, 2))
after = held()
give_back()
print(rows, after - held())
"""


def test_a_packing_task_leaves_nothing_to_give_back():
    pytest.importorskip("public_tokenizers")
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    rows, left = subprocess.run([sys.executable, "-c", PROBE.format(root=root)], capture_output=True, text=True, check=True).stdout.split()
    assert int(rows) >= 8000 and float(left) < 12


def test_memory_is_given_back_when_a_task_breaks_off(monkeypatch):
    from riskloom.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    task = common.lean(lambda n: iter(range(n)))
    assert list(task(3)) == [0, 1, 2] and len(calls) == 1
    half = task(3)
    next(half)
    half.close()
    assert len(calls) == 2
