"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the instance is a histogram of at most ``capacity`` lengths, whatever the number of
documents. On it the driver makes the packing as patterns (the lengths in a sequence, and how many sequences are made so):

1. Reduction: for the longest piece j, take the sets {j}, {j, k} and {j, a, b}. Where one of them dominates all other
   sets that could hold j (a packing with it is no worse), it is fixed, as often as pieces last; repeated until none dominates.
2. The rest goes best-fit: longest first, into the fullest open sequence that has room.

Spark then numbers the pieces within a length (by hash buckets of about the square root of the longest group, so that a length held by a third
of all pieces is many tasks) and the numbers are looked up in the patterns.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import lean, materialise, text_or_empty
from riskloom.llm.textbytes import SCORED_BYTES, row_groups, string_buffers
from riskloom.llm.token_ids import default_tokenizer, piece_tokenizer

CAPACITY = 1024
END_ID = 2

Pattern = tuple[tuple[int, ...], int]


def _dominating(counts: Counter, sizes: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """The set that dominates all sets with j, without j itself; None if none of up to three pieces does.

    sizes: lengths of which pieces are left, ascending. j's own piece is not counted among those that may join it.
    """
    room = capacity - j
    left = lambda s: counts[s] - (s == j)
    top = bisect_right(sizes, room) - 1
    while top >= 0 and not left(sizes[top]):
        top -= 1
    if top < 0:
        return ()
    k = sizes[top]
    if k == room:
        return (k,)
    least: list[int] = []
    for s in sizes:
        least += [s] * min(3 - len(least), left(s))
        if len(least) == 3:
            break
    if len(least) < 2 or least[0] + least[1] > room:
        return (k,)
    if len(least) == 3 and sum(least) <= room:
        return None  # four pieces may share a sequence: no claim
    # at most two more pieces fit: the best partner of each, the longest first
    pairs, high = [], top
    for low in range(len(sizes)):
        a = sizes[low]
        if not left(a) or a > room:
            continue
        while high >= 0 and sizes[high] + a > room:
            high -= 1
        b = high
        while b >= low and left(sizes[b]) < (1 + (sizes[b] == a)):
            b -= 1
        if b >= low:
            pairs.append((sizes[b], a))
    if all(k >= a + b for a, b in pairs):
        return (k,)
    best = next(((a, b) for a, b in pairs if a + b == room and all(x <= a and y <= b or x + y <= a for x, y in pairs)), None)
    best = best or max(pairs, key=sum)
    covers = all((x <= best[0] and y <= best[1]) or x + y <= best[0] for x, y in pairs) and k <= best[0]
    return best if covers else None


def reduce_instance(counts: Counter, capacity: int = CAPACITY) -> list[Pattern]:
    """Fix dominating sets until none is found; ``counts`` keeps what is left."""
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in sorted(counts, reverse=True):
            while counts[j]:
                sizes = sorted(s for s in counts if counts[s])
                others = _dominating(counts, sizes, j, capacity)
                if others is None:
                    break
                each = Counter((j, *others))
                times = min(counts[s] // n for s, n in each.items())
                if not times:  # the last piece of its length would be needed twice
                    break
                for s, n in each.items():
                    counts[s] -= n * times
                fixed.append(((j, *others), times))
                again = True
    return fixed


def best_fit(counts: Counter, capacity: int = CAPACITY) -> list[Pattern]:
    """Longest first into the fullest sequence with room; equal sequences are handled together."""
    open_by_room: dict[int, list[Pattern]] = {}
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        n = counts[size]
        while n:
            room = min((r for r, x in open_by_room.items() if x and r >= size), default=None)
            if room is None:
                room, (pattern, times) = capacity, ((), n)
            else:
                pattern, times = open_by_room[room].pop()
            each = min(room // size, n)
            made = min(times, n // each)
            if times > made and pattern:
                open_by_room[room].append((pattern, times - made))
            open_by_room.setdefault(room - each * size, []).append((pattern + (size,) * each, made))
            n -= made * each
    return [p for x in open_by_room.values() for p in x]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece of the histogram exactly once."""
    rest = Counter({int(s): int(n) for s, n in counts.items() if n > 0})
    fixed = reduce_instance(rest, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Rows (length, first number, sequence of the first, offset), by length and number."""
    taken: Counter = Counter()
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, taken[size], base, offset))
            taken[size] += times
            offset += size
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), cols, strict=True))


@lean
def pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = piece_tokenizer(path)
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for low, high in row_groups(offsets, SCORED_BYTES):
            at = offsets[low : high + 1] - offsets[low]
            ids, cuts = coder.encode(data[offsets[low] : offsets[high]], at)
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], end_id).astype("<u4")
                first = len(own) - (len(own) - 1) // capacity * capacity
                edges = [0, *range(first, len(own) + 1, capacity)]
                for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append(low + i)
                    numbers.append(k)
                    starts.append(x)
                    lengths.append(y - x)
                    sums.append(zlib.crc32(own[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])


@lean
def _look_up(batches: Iterator[pa.RecordBatch], table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    bounds = table["length"] * (1 << 44) + table["first"]
    for batch in batches:
        number = batch.column("number").to_numpy(zero_copy_only=False)
        length = batch.column("length").to_numpy(zero_copy_only=False)
        k = np.searchsorted(bounds, length * (1 << 44) + number, "right") - 1
        own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(table["sequence"][k] + number - table["first"][k]), pa.array(table["offset"][k])],
                                         ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
         tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Longer documents than ``capacity`` are cut;
    the first piece takes the remainder. Rows repeated with one id are packed each. Null ids stay null. An empty table gives no rows; other
    columns are not read. Equal tables give equal sequences up to pieces of equal length, id and number.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    made = materialise(
        narrow.mapInArrow(partial(pieces, path=tokenizer or default_tokenizer(), capacity=capacity, end_id=end_id),
                          f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    table = slots(plan(counts, capacity))
    buckets = max(1, int(max(counts.values(), default=1) ** 0.5))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    numbered = dealt.withColumn("within", within).join(firsts, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("within")).alias("number"))
    return numbered.mapInArrow(partial(_look_up, table=table),
                               f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
