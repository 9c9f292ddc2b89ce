"""Removal of repeated passages by difference-cover anchors.

A difference cover of a period holds, for every shift, two of its members that differ by the shift. So of two equal runs of words, wherever
they start, some place less than a period after their starts lies at a cover position in both texts (positions counted modulo the period).
Only windows of ``window - period + 1`` words at cover positions are hashed and compared over the corpus: 5 of 21 places by default. Every pair of
equal windows of ``window`` words has such an anchor inside both, so no repeat is missed.

From each shared anchor the match then extends: all whole windows around it (those that hold it) are hashed to 96 bits and compared, which
decides exactly which of them start more than once.

Skew: a map task sends one row for each key that it met, and what it met twice is known without asking anyone, so a passage that a
third of the corpus holds makes one row in each group of texts, not one in each text. Rows come back under a key of the text's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise_lean, text_or_empty
from riskloom.llm.textbytes import GROUP_BYTES, RangeHash, mix, row_groups, runs, string_buffers

WINDOW = 35
PERIOD = 21
#: A task's places are compared among themselves in lots of about so many.
LOT = 1 << 20


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences are all residues of the period."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    return (0,)


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with one space between words, compressed: they are written once and shuffled twice."""
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for low, high in row_groups(offsets):
            cut = zip(offsets[low:high].tolist(), offsets[low + 1 : high + 1].tolist(), strict=True)
            text = pa.array([pack(b" ".join(data[a:b].tobytes().split())) for a, b in cut], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), text], ["doc_id", "text"])


def _groups(rows: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of unpacked texts, in groups of about a megabyte packed at most."""
    unpack = zstandard.ZstdDecompressor().decompress
    data, offsets = string_buffers(texts)
    for low, high in row_groups(offsets, GROUP_BYTES // 2):
        cut = zip(offsets[low:high].tolist(), offsets[low + 1 : high + 1].tolist(), strict=True)
        part = [unpack(data[a:b].tobytes()) for a, b in cut]
        yield rows[low:high], np.frombuffer(b"".join(part), np.uint8), np.append(0, np.cumsum([len(x) for x in part]))


def _word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end byte of each word, row's first word number of length n + 1)."""
    start, end = runs(data != 32, offsets[:-1])
    return start, end, np.searchsorted(start, offsets)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position) of the anchors of a group of normal texts."""
    start, end, first = _word_bounds(data, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    place = np.arange(len(start)) - first[row]
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    at = np.flatnonzero(cover[place % period] & (place + length <= words[row]))
    return RangeHash(data)(start[at], end[at + length - 1]), row[at], place[at]


def _sent(key: np.ndarray, check: np.ndarray, row: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each key of the lot, ``known`` if the lot has it twice; further rows of a key are known and dealt at random."""
    order = np.lexsort((check, key))
    key, check, row, place = key[order], check[order], row[order], place[order]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
    known = same.copy()
    known[:-1] |= same[1:]
    own = mix(row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    key = np.where(same, own, key)
    for low in range(0, len(key), 1 << 17):
        part = slice(low, low + (1 << 17))
        rest = place[part].astype(np.int64) << 32 | check[part].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(rest), pa.array(row[part]), pa.array(known[part])], ["key", "rest", "row", "known"])


#: rest: the place, and the check value in the lower 32 bits.
ROWS = "key long, rest long, row long, known boolean"


class _Lots:
    """Places gathered over texts until a lot is full."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append(columns)
            self.size += len(columns[0])
        if self.size >= LOT:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            yield from _sent(*columns)


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, period: int) -> Iterator[pa.RecordBatch]:
    lots = _Lots()
    for batch in batches:
        for rows, data, offsets in _groups(batch.column(0).to_numpy(), batch.column(1)):
            found, row, place = _anchors(data, offsets, window - period + 1, period)
            yield from lots.add(found, np.zeros(len(found), np.uint32), rows[row], place)
    yield from lots.rest()


def _around(places: np.ndarray, words: int, window: int, period: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors."""
    step = np.zeros(words + 1, np.int32)
    np.add.at(step, np.maximum(places - period + 1, 0), 1)
    np.add.at(step, places + 1, -1)
    return np.flatnonzero(np.cumsum(step)[: max(0, words - window + 1)] > 0)


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, period: int) -> Iterator[pa.RecordBatch]:
    lots, unpack = _Lots(), zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for row, packed, places in zip(*batch.columns, strict=True):
            whole = unpack(packed.as_py())
            start, end = runs(np.frombuffer(whole, np.uint8) != 32, np.zeros(1, np.int64))
            at = _around(places.values.to_numpy(), len(start), window, period)
            cuts = zip(start[at].tolist(), end[at + window - 1].tolist(), strict=True)
            found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[a:b]) for a, b in cuts), np.uint64).reshape(-1, 2)
            yield from lots.add(found[:, 0], found[:, 1].astype(np.uint32), np.full(len(at), row.as_py()), at)
    yield from lots.rest()


def _repeated(rows: DataFrame) -> DataFrame:
    """(row, places) of the rows whose key and check value occur more than once; a key has one row for each lot at most."""
    check = F.col("rest").bitwiseAND(0xFFFFFFFF)
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "check"))
    return (rows.repartition("key").withColumn("check", check).withColumn("n", n).where("known or n > 1")
            .select("row", F.shiftright("rest", 32).cast("int").alias("place")).groupBy("row").agg(F.collect_list("place").alias("places")))


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        words, gone, texts = [], [], []
        for packed, places in zip(*batch.columns[1:], strict=True):
            text = unpack(packed.as_py())
            n = text.count(b" ") + 1 if text else 0
            words.append(n)
            starts = places.values
            if starts is None:
                gone.append(0)
                texts.append(text)
                continue
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, starts.to_numpy(), 1)
            np.add.at(step, starts.to_numpy() + window, -1)
            keep = np.cumsum(step)[:n] == 0
            gone.append(n - int(keep.sum()))
            texts.append(b" ".join(w for w, k in zip(text.split(b" "), keep.tolist(), strict=True) if k))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
                   period: int = PERIOD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of ``window`` words that covers it starts at another place too, in any text or its own; every copy goes.
    Words are runs without ASCII white space, unchanged. Null and empty texts have no words; texts shorter than a window lose none. Each row is a text of its
    own, so rows repeated with one id and text are repeats of each other, and null ids are kept. An empty table gives no rows; other columns aren't read.
    """
    if not 1 <= period <= window:
        raise ValueError("the period must be between 1 and the window")
    kind = docs.schema[id_column].dataType.simpleString()
    normal = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")).mapInArrow(_normal, f"doc_id {kind}, text binary")
    # the row numbers hold for good once they are written
    texts = materialise_lean(normal.withColumn("row", F.monotonically_increasing_id()), "texts")
    anchors = texts.select("row", "text").mapInArrow(partial(_anchor_rows, window=window, period=period), ROWS)
    shared = materialise_lean(_repeated(anchors), "anchors")
    windows = (texts.join(shared, "row").select("row", "text", "places")
               .mapInArrow(partial(_window_rows, window=window, period=period), ROWS))
    repeats = materialise_lean(_repeated(windows), "repeats")
    return (texts.join(repeats, "row", "left").select("doc_id", "text", "places")
            .mapInArrow(partial(_kept, window=window), f"doc_id {kind}, n_words long, n_removed long, kept_text string"))


def summary(kept: DataFrame) -> DataFrame:
    """Digests instead of texts."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
s AS (SELECT r, i, sha256(array_to_string(words[i + 1 : i + {WINDOW}], ' ')) AS h FROM (SELECT r, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM w)),
d AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT p.r, p.i, word, coalesce(count(d.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) AS hits
      FROM p LEFT JOIN d ON p.r = d.r AND p.i = d.i),
k AS (SELECT r, count(*) FILTER (hits > 0) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (hits = 0) AS kept FROM c GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""
