"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a table of Hamming distances to reference fingerprints: zero, the 64 with one bit, and ``DENSE`` fixed ones with
about half of the bits. By the triangle inequality two fingerprints within ``distance`` differ by no more than that in every
coordinate. Moreover, d(x, 0) - d(x, bit s) tells coordinate by coordinate where two fingerprints can differ, and fingerprints within
``distance`` agree in all but so many; so of ``distance`` + 2 groups of coordinates at least two agree, and each choice of two groups
is a join key. Within a bucket of equal keys, pairs are discarded by the largest coordinate difference and
survivors are verified by their bits. A bucket returns a spanning forest of its links, never all its pairs.

A bucket of more than ``CROWD`` distinct fingerprints is dealt anew: its free coordinates make sub-groups of four bits, of which
all but ``distance`` agree; such a bucket holds at most 2 ** (4 * distance) fingerprints. The result is exact in either case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import lean, materialise, row_key, text_or_empty, without_keys
from riskloom.llm.components import components
from riskloom.llm.textbytes import mix, string_buffers

SHINGLE = 3
DISTANCE = 2
SEED = 42
DENSE = 31
CROWD = 512
RUNS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles: a bit is set if over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words)) - 1
    spans = zip(start[: len(words) - k].tolist(), end[k:].tolist(), strict=True)
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k)
    counts = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 16):  # bits of a bounded number of shingles at a time
        part = h[low : low + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


@lean
def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        found = np.fromiter((fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, len(offsets) - 1)
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(found.view(np.int64))], [*rest, "fp"])


def references() -> np.ndarray:
    """Zero, the single bits, and the dense ones."""
    dense = mix(np.arange(1, DENSE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64), dense])


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances (fingerprints x references, uint8)."""
    return np.bitwise_count(fp[:, None] ^ references()[None, :]).astype(np.uint8)


def _coordinates(table: np.ndarray) -> np.ndarray:
    """Per single-bit reference: half of d(x, 0) - d(x, bit) + 1, read from the table."""
    return ((table[:, :1].astype(np.int16) - table[:, 1:65] + 1) // 2).astype(np.uint64)


def _group_values(table: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    c = _coordinates(table)
    return np.stack([(c[:, g] << np.arange(len(g), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for g in groups], axis=1)


def _key(tag: np.ndarray | int, values: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(values[0]), np.uint64) + np.asarray(tag, np.uint64)
    for v in values:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v + np.uint64(1))
    return h


def _first_groups(distance: int) -> tuple[list[np.ndarray], list[tuple[int, ...]]]:
    n = distance + 2
    return np.array_split(np.arange(64), n), list(combinations(range(n), 2))


@lean
def _keys(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """A row (key, which, fp, table) for each fingerprint and choice of two groups."""
    groups, choices = _first_groups(distance)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        table = pivot_table(fp)
        values = _group_values(table, groups)
        dense = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DENSE + 1), len(fp), [None, pa.py_buffer(np.ascontiguousarray(table[:, [0, *range(65, 65 + DENSE)]]))]).cast(pa.binary())
        for which, choice in enumerate(choices):
            key = _key(which + 1, [values[:, g] for g in choice])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(fp), which, np.int32)), batch.column(0), dense], ["key", "which", "fp", "pivots"])


@lean
def _finer_keys(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """The rows of crowded buckets, dealt by the free coordinates' sub-groups of four that agree."""
    groups, choices = _first_groups(distance)
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        which, parent = batch.column("which").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
        for w in np.unique(which):
            rows = np.flatnonzero(which == w)
            free = np.concatenate([groups[g] for g in range(len(groups)) if g not in choices[w]])
            subs = np.array_split(free, -(-len(free) // 4))
            values = _group_values(pivot_table(fp[rows]), subs)
            for out in combinations(range(len(subs)), distance):
                tag = np.uint64(1 + sum(1 << o for o in out))
                key = _key(mix(parent[rows] + tag), [values[:, s] for s in range(len(subs)) if s not in out])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("fp").take(at), batch.column("pivots").take(at)], ["key", "fp", "pivots"])


def links(fp: np.ndarray, pivots: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links among one bucket's distinct fingerprints."""
    order = np.argsort(pivots[:, 0], kind="stable")
    fp, pivots = fp[order], pivots[order].astype(np.int16)
    root = np.arange(len(fp))
    out_a, out_b = [], []
    last = np.searchsorted(pivots[:, 0], pivots[:, 0] + distance, "right")
    for i in range(len(fp) - 1):
        near = np.arange(i + 1, last[i])
        near = near[root[near] != root[i]]  # linked to it already, by others
        near = near[np.abs(pivots[near] - pivots[i]).max(axis=1, initial=0) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
        for j in near.tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out_a.append(i)
                out_b.append(j)
    return fp[out_a], fp[out_b]


@lean
def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column(0)
        cuts = members.offsets.to_numpy().astype(np.int64)
        inner = members.flatten()
        cuts = cuts - cuts[0]
        fp = inner.field("fp").to_numpy().view(np.uint64)
        pivots = np.frombuffer(b"".join(inner.field("pivots").to_pylist()), np.uint8).reshape(len(fp), DENSE + 1)
        two = np.flatnonzero(np.diff(cuts) == 2)
        x, y = cuts[two], cuts[two] + 1
        near = np.abs(pivots[x].astype(np.int16) - pivots[y]).max(axis=1, initial=0) <= distance
        x, y = x[near], y[near]
        near = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        a, b = [fp[x[near]]], [fp[y[near]]]
        for k in np.flatnonzero(np.diff(cuts) > 2).tolist():
            p, q = links(fp[cuts[k] : cuts[k + 1]], pivots[cuts[k] : cuts[k + 1]], distance)
            a.append(p)
            b.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])


def link_edges(distinct: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct) connected by links."""
    keys = materialise(distinct.select("fp").mapInArrow(partial(_keys, distance=distance), "key long, which int, fp long, pivots binary"), "pivots")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = materialise(sizes.where(F.col("n") > crowd).select("key"), "crowded")
    shared = keys.join(sizes.where(F.col("n") <= crowd).select("key"), "key", "left_semi").select("key", "fp", "pivots")
    finer = (keys.join(crowded, "key", "left_semi").select("key", "which", "fp", "pivots")
             .mapInArrow(partial(_finer_keys, distance=distance), "key long, fp long, pivots binary"))
    buckets = (shared.unionByName(finer).groupBy("key").agg(F.collect_list(F.struct("fp", "pivots")).alias("members"))
               .where(F.size("members") > 1).select("members"))
    return buckets.mapInArrow(partial(_links, distance=distance), "a long, b long")


def _classes(narrow: DataFrame, shingle: int, distance: int) -> DataFrame:
    """``narrow`` (doc_id, text, others) with fp and component_id instead of the text."""
    schema = T.StructType([*[f for f in narrow.schema.fields if f.name != "text"], T.StructField("fp", T.LongType())])
    rows = narrow.mapInArrow(partial(_fingerprints, shingle=shingle), schema)
    rows = materialise(rows.withColumn("run", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(RUNS)).cast("int")), "fingerprints")
    leaves = rows.groupBy("fp", "run").agg(F.min("doc_id").alias("least"))
    distinct = materialise(leaves.groupBy("fp").agg(F.min("least").alias("least")), "distinct")
    found = components(link_edges(distinct, distance), "a", "b")
    member = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    member = materialise(member, "members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    told = leaves.select("fp", "run").join(member.join(least, "component").select("fp", "component_id"), "fp")
    return rows.join(told, ["fp", "run"])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    A null text is empty; texts without words have fingerprint zero and are linked like others. Rows repeated with one id have the component of
    their own text; a null id never is a component's id unless all its ids are null. An empty table gives no rows; other columns aren't read.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    return _classes(narrow, shingle, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
             distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their text's component, all columns unchanged; rows with a null id stay.

    Of rows repeated with one id only those go whose own text is linked to a smaller id.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"), row_key(id_column, text_column).alias("key"))
    gone = materialise(_classes(narrow, shingle, distance).where("doc_id <> component_id").select("key").distinct(), "near")
    return without_keys(docs, row_key(id_column, text_column), gone)
