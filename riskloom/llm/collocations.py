"""Frequent phrases and collocations from depth-truncated suffix subtrees, by vertical partitioning.

The text's suffixes (the next few words from each word on, inside a piece) are parted by variable-length word prefixes: a prefix is a single word, or longer
where the word begins more suffixes than the memory budget; such a prefix is extended by another word, and so on. Prefixes are
gathered into groups of about a budget's suffixes each. A group's suffixes go to one place as counted runs, where its subtree is built in memory without any other group:
the common beginnings of sorted neighbours give the tree's nodes down to the depth, and a node's count is the total of its leaves.

Suffixes are read only as far as they can be frequent: two fixed tables of cells count the pairs and the triples of neighbouring words by hash, and a suffix ends before
a pair or triple whose cell holds too few. A cell never holds less than its pairs' counts, so no frequent phrase is cut; the tables' size doesn't depend on the corpus.

Words are written as codes of one to three bytes by a dictionary of the most frequent words, whose size is bounded; other words stand in a suffix as they are,
unless the dictionary holds every word that is frequent enough: then the rest can be in no frequent phrase and ends the suffix.

Skew: a map task counts its suffixes before it sends them, so a passage in a third of all texts makes a row for each lot, not for each text, and a
word with a third of all occurrences is cut into longer prefixes.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise_lean, text_or_empty
from riskloom.llm.textbytes import LOWER, apart, mix, row_groups, runs, string_buffers

DEPTH = 5
MIN_COUNT = 100
TOP = 2000
#: Suffixes that a group may hold.
BUDGET = 1 << 19
#: Words in the dictionary.
WORDS = 1 << 17
#: Cells of each table of neighbours (their bits go to every task), how many of them make a row, and the tables: so many words together.
CELLS, CELL_ROW = 1 << 23, 1 << 18
TOGETHER = (2, 3)
#: Distinct words or suffixes that a task counts before it sends them.
LOT = 400_000
#: What ends a piece, and what stands between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Codes: one byte below ONE, two bytes up to TWO, three above; 255 encloses a word as it is (no UTF-8 text holds it).
ONE, TWO, RAW = 192, 240, 255

IS_BREAK, IS_WORD = np.zeros(256, bool), np.ones(256, bool)
IS_BREAK[list(BREAKS)] = True
IS_WORD[list(BREAKS + BLANKS)] = False
TO_BLANK = LOWER.copy()
TO_BLANK[IS_BREAK] = 32


def code(rank: int) -> bytes:
    """Prefix-free, so that the order of codes is a tree's."""
    if rank < ONE:
        return bytes([rank])
    rank -= ONE
    if rank < (TWO - ONE) << 8:
        return bytes([ONE + (rank >> 8), rank & 255])
    rank -= (TWO - ONE) << 8
    if rank >= (RAW - TWO) << 16:
        raise ValueError("the dictionary is too large for its codes")
    return bytes([TWO + (rank >> 16), rank >> 8 & 255, rank & 255])


def cells(rank: np.ndarray, size: int, together: int) -> np.ndarray:
    """The cell of each word and those after it, ``together`` in all."""
    n = max(0, len(rank) - together + 1)
    h = np.full(n, together, np.uint64)
    for k in range(together):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rank[k : k + n].astype(np.uint64))
    return (h % np.uint64(size)).astype(np.int64)


@dataclass
class Dictionary:
    """Words by rank; ``whole`` if no other word is frequent enough; the group of each word; prefixes of more than a budget's suffixes."""

    words: list[bytes]
    whole: bool
    group: np.ndarray
    groups: int
    heavy: set[bytes] = field(default_factory=set)
    bits: list[np.ndarray] = field(default_factory=list)  # for each table, the cells that may hold something frequent

    def __post_init__(self):
        codes = [code(r) for r in range(len(self.words))]
        self.rank = {w: r for r, w in enumerate(self.words)}
        self.size = np.array([*map(len, codes), 0], np.int64)
        self.bytes = np.frombuffer(b"".join(c.ljust(3, b"\0") for c in codes) + b"\0\0\0", np.uint8).reshape(-1, 3)
        self.word_of = dict(zip(codes, self.words, strict=True))
        self.group_of = {c: g for c, g in zip(codes, self.group.tolist(), strict=True) if c not in self.heavy}

    def __reduce__(self):
        return type(self), (self.words, self.whole, self.group, self.groups, self.heavy, self.bits)

    def may_follow(self, rank: np.ndarray, together: int) -> np.ndarray:
        """Whether each word and those after it may be frequent together; with words outside the dictionary they may."""
        bits = self.bits[TOGETHER.index(together)]
        cell = cells(rank, 8 * len(bits), together)
        out = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
        for k in range(together):
            out |= rank[k : k + len(out)] < 0
        return out

    def split(self, key: bytes) -> list[bytes]:
        """The codes of a suffix."""
        out, at = [], 0
        while at < len(key):
            lead = key[at]
            end = at + 1 if lead < ONE else at + 2 if lead < TWO else at + 3 if lead < RAW else key.index(RAW, at + 1) + 1
            out.append(key[at:end])
            at = end
        return out

    def text(self, key: bytes) -> bytes:
        return b" ".join(c[1:-1] if c[0] == RAW else self.word_of[c] for c in self.split(key))

    def place(self, key: bytes) -> int:
        """The group of a suffix: that of its first word, or of the shortest prefix that isn't heavy."""
        lead = key[0]
        found = self.group_of.get(key[:1] if lead < ONE else key[:2] if lead < TWO else key[:3])
        if found is not None and lead != RAW:
            return found
        codes = self.split(key)
        unit = codes[0]
        if unit not in self.heavy:
            return zlib.crc32(unit) % self.groups
        for c in codes[1:]:
            unit += c
            if unit not in self.heavy:
                break
        return zlib.crc32(unit) % self.groups


def _rows_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(lang, bytes with a line feed after each row, row starts) of texts, in groups of bounded size."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = string_buffers(batch.column(1))
        for low, high in row_groups(offsets):
            rows = defaultdict(list)
            for i in range(low, high):
                rows[langs[i].encode()].append(i)
            for lang, at in rows.items():
                part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in at])
                yield lang, *apart(part, np.append(0, np.cumsum([offsets[i + 1] - offsets[i] for i in at])))


def _sent(counts: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, found in counts.items():
        keys = list(found)
        for low in range(0, len(keys), 1 << 16):
            part = keys[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.binary()).cast(pa.string()), pa.array(part, pa.binary()), pa.array([found[k] for k in part], pa.int64())], ["lang", "key", "n"])
    counts.clear()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, Counter] = defaultdict(Counter)
    for lang, data, _ in _rows_by_lang(batches):
        counts[lang].update(TO_BLANK[data].tobytes().split())
        if sum(map(len, counts.values())) > LOT:
            yield from _sent(counts)
    yield from _sent(counts)


def _coded(data: np.ndarray, starts: np.ndarray, words: Dictionary, depth: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all words in order, byte offset of each word of length n + 1, how many words may be read from each, ranks)."""
    start, end = runs(IS_WORD[data], starts)
    found = TO_BLANK[data].tobytes().split()
    rank = np.fromiter(map(words.rank.get, found, repeat(-1)), np.int64, len(found))
    size = words.size[rank]  # -1: the last, of no bytes
    odd = np.flatnonzero(rank < 0)
    if len(odd) and not words.whole:
        size[odd] = end[odd] - start[odd] + 2
    offsets = np.append(0, np.cumsum(size))
    stream = np.zeros(offsets[-1] + 3, np.uint8)
    for k in range(3):
        has = np.flatnonzero((size > k) & (rank >= 0))
        stream[offsets[has] + k] = words.bytes[rank[has], k]
    if not words.whole:
        for i in odd.tolist():
            stream[offsets[i] : offsets[i + 1]] = np.frombuffer(b"\xff" + found[i] + b"\xff", np.uint8)
    ended = np.cumsum(IS_BREAK[data])[start] if len(start) else start
    last = np.ones(len(found), bool)  # no word of the same suffix follows
    last[:-1] = ended[1:] != ended[:-1]
    if words.whole:
        last |= rank < 0
        last[:-1] |= rank[1:] < 0
    if words.bits and len(rank) > 1:
        last[:-1] |= ~words.may_follow(rank, 2)
    stops = np.flatnonzero(last)
    reach = np.minimum(stops[np.searchsorted(stops, np.arange(len(found)))] - np.arange(len(found)) + 1, depth) if len(found) else rank
    if words.whole:
        reach = np.where(rank < 0, 0, reach)
    if words.bits and len(rank) > 2:
        closed = np.append(~words.may_follow(rank, 3), [True, True])
        for k in range(depth - 3, -1, -1):  # the triple k words on: the suffix ends before its third word
            reach[: len(rank) - k] = np.where(closed[k:], np.minimum(reach[: len(rank) - k], k + 2), reach[: len(rank) - k])
    return stream.tobytes(), offsets, reach, rank


def _neighbour_counts(batches: Iterator[pa.RecordBatch], shared, size: int) -> Iterator[pa.RecordBatch]:
    """(block, cells): a task's counts of neighbours by cell, packed; the tables lie one after another."""
    words, table = shared.value, np.zeros((len(TOGETHER), size), np.uint32)
    for _, data, starts in _rows_by_lang(batches):
        _, _, reach, rank = _coded(data, starts, words, max(TOGETHER))
        for i, k in enumerate(TOGETHER):
            found = cells(rank, size, k)
            np.add.at(table[i], found[reach[: len(found)] >= k], 1)
    pack = zstandard.ZstdCompressor().compress
    for low in range(0, table.size, CELL_ROW):
        part = table.ravel()[low : low + CELL_ROW]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([pack(part.tobytes())], pa.binary())], ["block", "cells"])


def _added_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the blocks that come to this task, packed."""
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor().compress
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            x = np.frombuffer(unpack(packed), np.uint32)
            held[block] = np.minimum(held[block].astype(np.uint64) + x, 0xFFFFFFFF).astype(np.uint32) if block in held else x
    for block, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(x.tobytes())], pa.binary())], ["block", "cells"])


def _open_cells(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        bits = [np.packbits(np.frombuffer(unpack(x), np.uint32) >= min_count).tobytes() for x in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(bits, pa.binary())], ["block", "bits"])


def frequent_neighbours(texts: DataFrame, words: Dictionary, min_count: int, size: int) -> list[np.ndarray]:
    """Bits of the cells that hold ``min_count`` together, for each table: tasks' tables added up block by block, in a tree."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    schema = "block long, cells binary"
    leaves = texts.mapInArrow(partial(_neighbour_counts, shared=shared, size=size), schema).withColumn("branch", F.spark_partition_id() % 32)
    branches = leaves.repartition("block", "branch").select("block", "cells").mapInArrow(_added_cells, schema)
    whole = branches.repartition("block").mapInArrow(_added_cells, schema).mapInArrow(partial(_open_cells, min_count=min(min_count, 0xFFFFFFFF)), "block long, bits binary")
    out = np.zeros(len(TOGETHER) * size // 8, np.uint8)
    for r in whole.collect():  # a bit for each cell
        out[r["block"] // 8 : r["block"] // 8 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return np.split(out, len(TOGETHER))


def _prefix_counts(batches: Iterator[pa.RecordBatch], shared, depth: int) -> Iterator[pa.RecordBatch]:
    """Counts of the prefixes of ``depth`` words that extend a heavy one by a heavy word: no other can be heavy."""
    words, counts = shared.value, defaultdict(Counter)
    single = np.array([code(r) in words.heavy for r in range(len(words.words))] + [False])
    for lang, data, starts in _rows_by_lang(batches):
        stream, offsets, reach, rank = _coded(data, starts, words, depth)
        at = np.flatnonzero(reach == depth)
        for k in range(depth):
            at = at[single[rank[at + k]]]
        found = [stream[a:b] for a, b in zip(offsets[at].tolist(), offsets[at + depth].tolist(), strict=True)]
        inner = offsets[at + depth - 1] - offsets[at]
        counts[lang].update(key for key, cut in zip(found, inner.tolist(), strict=True) if key[:cut] in words.heavy)
        if sum(map(len, counts.values())) > LOT:
            yield from _sent(counts)
    yield from _sent(counts)


def pack_run(keys: list[bytes], counts: list[int]) -> bytes:
    """A run of suffixes and their counts: number, lengths, counts, bytes."""
    sizes = np.fromiter(map(len, keys), np.uint32, len(keys))
    return zstandard.ZstdCompressor().compress(b"".join([np.uint64(len(keys)).tobytes(), sizes.tobytes(), np.array(counts, np.uint64).tobytes(), *keys]))


def unpack_run(packed: bytes) -> tuple[list[bytes], list[int]]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 8), dtype=np.int64) + 8 + 12 * n
    starts = np.append(8 + 12 * n, ends[:-1]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.frombuffer(raw[8 + 4 * n : 8 + 12 * n], np.uint64).tolist()


def _suffixes(batches: Iterator[pa.RecordBatch], shared, depth: int) -> Iterator[pa.RecordBatch]:
    """(group, run): the suffixes of two words or more, counted, a packed run for each group and lot. A key is lang, 255, codes."""
    words = shared.value
    counts: dict[bytes, Counter] = defaultdict(Counter)

    def grouped() -> Iterator[pa.RecordBatch]:
        keys, totals = defaultdict(list), defaultdict(list)
        for lang, found in counts.items():
            for k, n in found.items():
                g = words.place(k)
                keys[g].append(lang + b"\xff" + k)
                totals[g].append(n)
        counts.clear()
        for g, own in keys.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([pack_run(own, totals[g])], pa.binary())], ["group", "run"])

    for lang, data, starts in _rows_by_lang(batches):
        stream, offsets, reach, _ = _coded(data, starts, words, depth)
        at = np.flatnonzero(reach > 1)
        counts[lang].update([stream[a:b] for a, b in zip(offsets[at].tolist(), offsets[at + reach[at]].tolist(), strict=True)])
        if sum(map(len, counts.values())) > LOT:
            yield from grouped()
    yield from grouped()


def _ends(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the codes of each key begin, ends of its first, second ... code; past the last code: -1)."""
    marks = np.append(np.flatnonzero(data == RAW), len(data))
    first = marks[np.searchsorted(marks, offsets[:-1])] + 1  # the lang's end
    size = np.full(256, 3)
    size[:TWO], size[:ONE] = 2, 1
    ends, at = np.full((depth, len(first)), -1), first.copy()
    open_rows = np.arange(len(first))
    for k in range(depth):
        open_rows = open_rows[at[open_rows] < offsets[open_rows + 1]]
        lead = data[at[open_rows]]
        end = at[open_rows] + size[lead]
        raw = np.flatnonzero(lead == RAW)
        end[raw] = marks[np.searchsorted(marks, at[open_rows[raw]] + 1)] + 1
        at[open_rows] = end
        ends[k, open_rows] = end
    return first, ends


def _common(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each key and the one before; 0 for the first."""
    size = np.diff(offsets)
    out = np.zeros(len(size), np.int64)
    rows, k = np.arange(1, len(size)), 0
    while len(rows):
        rows = rows[np.minimum(size[rows], size[rows - 1]) > k]
        rows = rows[data[offsets[rows] + k] == data[offsets[rows - 1] + k]]
        k += 1
        out[rows] = k
    return out


def subtree(leaves: Counter, min_count: int, depth: int, heavy: set[bytes]) -> tuple[list[bytes], list[int]]:
    """Frequent nodes of two words or more of a group's subtree, and their leaf totals; nodes that lie in several groups (heavy prefixes) are left out."""
    order = sorted(leaves)
    n = np.array([leaves[k] for k in order], np.int64)
    offsets, whole = np.append(0, np.cumsum([len(k) for k in order])).astype(np.int64), b"".join(order)
    data = np.frombuffer(whole, np.uint8)
    first, ends = _ends(data, offsets, depth)
    common = _common(data, offsets)
    keys, totals = [], []
    for k in range(1, depth):
        rows = np.flatnonzero(ends[k] >= 0)
        if not len(rows):
            break
        new = common[rows] < ends[k, rows] - offsets[rows]
        new[0] = True
        heads = np.flatnonzero(new)
        total = np.add.reduceat(n[rows], heads)
        taken = np.flatnonzero(total >= min_count)
        at = rows[heads[taken]]
        for a, f, b, t in zip(offsets[at].tolist(), first[at].tolist(), ends[k, at].tolist(), total[taken].tolist(), strict=True):
            if whole[f:b] not in heavy:  # counted before, whole
                keys.append(whole[a:b])
                totals.append(t)
    return keys, totals


def _subtrees(batches: Iterator[pa.RecordBatch], min_count: int, depth: int, heavy: set[bytes]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the subtrees' frequent nodes, group after group; a group's runs come one after another and are merged as they come."""
    now, leaves = None, Counter()

    def done() -> Iterator[pa.RecordBatch]:
        if leaves:
            keys, totals = subtree(leaves, min_count, depth, heavy)
            leaves.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(totals, pa.int64())], ["key", "n"])

    for batch in batches:
        for group, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if group != now:
                yield from done()
                now = group
            keys, counts = unpack_run(run.as_py())
            for k, n in zip(keys, counts, strict=True):
                leaves[k] += n
    yield from done()


def _decoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    words = shared.value
    for batch in batches:
        langs, phrases, sizes = [], [], []
        for key in batch.column(0).to_pylist():
            lang, _, codes = key.partition(b"\xff")
            langs.append(lang.decode())
            phrases.append(words.text(codes).decode())
            sizes.append(len(words.split(codes)))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), batch.column(1)], ["lang", "phrase", "size", "a"])


def frequent_phrases(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", min_count: int = MIN_COUNT, depth: int = DEPTH,
                     budget: int = BUDGET, dictionary: int = WORDS, cell_count: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(frequent phrases of 1 to ``depth`` words: lang, phrase, size, a; words: lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_column).alias("text"))
    counted = texts.mapInArrow(_word_counts, "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counted = materialise_lean(counted, "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counted.where(F.col("n") >= min_count)
    ranked = (counted.groupBy("key").agg(F.max("n").alias("most"), F.sum("n").alias("n")).where(F.col("most") >= min_count)
              .orderBy(F.desc("n"), "key").limit(dictionary + 1).collect())
    total = totals.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // dictionary))  # so heavy prefixes are no more than words in the dictionary
    top = ranked[:dictionary]
    size = np.array([r["n"] for r in top], np.int64)
    group = np.cumsum(np.where(size > budget, 0, size)) // budget
    words = Dictionary([bytes(r["key"]) for r in top], len(ranked) <= dictionary, group.astype(np.int32), int(total // budget) + 1)
    words.heavy = {code(r) for r, n in enumerate(size.tolist()) if n > budget}
    words = replace(words, bits=frequent_neighbours(texts, words, min_count, cell_count))

    grown = spark.createDataFrame([], "key binary, n long")
    longest, level = 1, words.heavy
    while level and longest < depth - 1:
        longest += 1
        shared = spark.sparkContext.broadcast(words)
        longer = materialise_lean(texts.mapInArrow(partial(_prefix_counts, shared=shared, depth=longest), "lang string, key binary, n long")
                                  .groupBy("lang", "key").agg(F.sum("n").alias("n")), "prefixes")
        over = longer.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > budget).select("key")
        level = {bytes(r["key"]) for r in over.collect()}
        words = replace(words, heavy=words.heavy | level)
        told = longer.join(over, "key", "left_semi")
        grown = grown.unionByName(told.select(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\xff"), "key").alias("key"), "n"))

    shared = spark.sparkContext.broadcast(words)
    suffixes = texts.mapInArrow(partial(_suffixes, shared=shared, depth=depth), "group int, run binary")
    nodes = (suffixes.repartition("group").sortWithinPartitions("group")
             .mapInArrow(partial(_subtrees, min_count=min_count, depth=depth, heavy={h for h in words.heavy}), "key binary, n long"))
    nodes = materialise_lean(nodes, "subtrees").unionByName(grown.where(F.col("n") >= min_count))
    phrases = nodes.mapInArrow(partial(_decoded, shared=shared), "lang string, phrase string, size int, a long")
    single = frequent.select("lang", F.decode("key", "UTF-8").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("a"))
    return materialise_lean(phrases.unionByName(single), "phrases"), totals


def collocations(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", min_count: int = MIN_COUNT, depth: int = DEPTH,
                 covered: int = 100, top: int | None = TOP, budget: int = BUDGET, dictionary: int = WORDS, cell_count: int = CELLS) -> DataFrame:
    """Per lang the best ``top`` phrases of 2 to ``depth`` words (all if None): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at spaces and tabs; null texts are empty, a null lang is ``und``. A phrase's score is
    floor(1000 a n / (l r)) of its worst cut. A phrase goes if a longer frequent phrase that contains it has ``covered`` percent of its count. Ties: more
    occurrences, then the smaller phrase by UTF-8 bytes. Repeated rows count as often as they occur; ids and other columns aren't read; an empty
    table gives no rows. Counts are exact, and so are scores, whose products are decimals of 38 digits.
    """
    phrases, totals = frequent_phrases(docs, lang_column, text_column, min_count, depth, budget, dictionary, cell_count)
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    several = phrases.where("size > 1")
    cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - size)"))
    scored = (cuts.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
              .join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
              .join(totals, "lang")
              .withColumn("score", F.expr("cast(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")))
    worst = scored.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = (several.where("size > 2").select("lang", "a", F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = worst.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {covered} * a")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
q AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM t),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q),
g AS (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM s),
f AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS a FROM g WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, a FROM f WHERE a >= {MIN_COUNT} AND k > 1),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
x AS (SELECT u.*, n.n, l.a AS l, r.a AS r, ((1000::HUGEINT * u.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM u JOIN n USING (lang) JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1 : cut], ' ')
      JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[cut + 1 :], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM c),
j AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS p FROM i),
o AS (SELECT lang, array_to_string(w[p : p + m - 1], ' ') AS phrase, max(a) AS longer FROM j GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN o ON b.lang = o.lang AND b.phrase = o.phrase WHERE longer IS NULL OR 100 * longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM k QUALIFY rank <= {TOP}
"""
