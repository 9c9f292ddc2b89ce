"""Training-order materialisation: every token sequence gets a global slot, and shards of fixed-stride records hold the slots in order.

Texts are tokenised and cut into sequences of at most ``seq_len`` ids. Sequences are numbered 0..N-1 by input partition and place in it; a keyed Feistel
permutation of the next power of four, walked along its cycle until it falls below N, maps the number to the slot. Slots are dealt to shards
of ``SHARD_SLOTS``; a shard's task sorts its slots and writes one file of records of equal size (id count, ids, padding), so slot s
is at byte (s mod SHARD_SLOTS) * stride of shard s div SHARD_SLOTS. A reader that stopped at any slot goes on from there, and a run is
repeated from the manifest alone.

Numbering takes a first pass that only counts: texts are tokenised twice, which costs less than keeping all ids on disk a second
time. Both passes read the same partitions of the same table; a partition whose count differs in the second pass is an error.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, shared_folder, text_or_empty
from riskloom.llm.storage import RangeReader, make_folder, new_file, open_folder
from riskloom.llm.textbytes import mix, row_groups, string_buffers
from riskloom.llm.token_ids import PART_BYTES, default_tokenizer, piece_tokenizer

SEQ_LEN = 512
SHARD_SLOTS = 1 << 14
END_ID = 2
KEY = 20240607
ROUNDS = 6


def feistel(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``numbers``."""
    half = max(1, -(-int(n - 1).bit_length() // 2))
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << bits) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _sequences(batch: pa.RecordBatch, path: str, seq_len: int, end_id: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, chunk, ids) in order."""
    coder = piece_tokenizer(path)
    data, offsets = string_buffers(batch.column(1))
    for low, high in row_groups(offsets, PART_BYTES):
        ids, cuts = coder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            own = np.append(ids[a:b], end_id)
            for k, x in enumerate(range(0, len(own), seq_len)):
                yield low + i, k, own[x : x + seq_len]


def _count(batches: Iterator[pa.RecordBatch], path: str, seq_len: int) -> Iterator[pa.RecordBatch]:
    n, coder = 0, piece_tokenizer(path)
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for low, high in row_groups(offsets, PART_BYTES):
            _, cuts = coder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            n += int((-(-(np.diff(cuts) + 1) // seq_len)).sum())
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])


def _place(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, end_id: int, firsts: dict[int, tuple[int, int]], total: int, key: int,
           shard_slots: int) -> Iterator[pa.RecordBatch]:
    """Rows with the sequence's number, slot, shard and ids (little-endian)."""
    part = TaskContext.get().partitionId()
    number, expected = firsts.get(part, (0, 0))
    stop = number + expected
    kind = _id_type(path)
    for batch in batches:
        rows, chunks, sizes, packed = [], [], [], []

        def out() -> pa.RecordBatch:
            at = np.arange(number - len(rows), number)  # noqa: B023
            slot = feistel(at, total, key)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(chunks, pa.int32()), pa.array(at), pa.array(slot),  # noqa: B023
                 pa.array((slot // shard_slots).astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())],  # noqa: B023
                ["doc_id", "chunk", "number", "slot", "shard", "n_tokens", "ids"])

        for row, chunk, ids in _sequences(batch, path, seq_len, end_id):
            rows.append(row)
            chunks.append(chunk)
            sizes.append(len(ids))
            packed.append(ids.astype(kind).tobytes())
            number += 1
            if len(rows) == 4096:
                yield out()
                rows, chunks, sizes, packed = [], [], [], []
        if rows:
            yield out()
    if number != stop:
        raise ValueError(f"partition {part} has {number - stop + expected} sequences, counted {expected}")


def _id_type(path: str) -> str:
    return "<u2" if piece_tokenizer(path).whole.get_vocab_size() < 1 << 16 else "<u4"


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(batches: Iterator[pa.RecordBatch], folder: str, stride: int, shard_slots: int) -> Iterator[pa.RecordBatch]:
    """The shards of a partition, whose rows come sorted by slot; yields the rows without ids."""
    open_shard, holder, out, expected = None, None, None, 0
    for batch in batches:
        slots, shards = batch.column("slot").to_pylist(), batch.column("shard").to_pylist()
        sizes, ids = batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist()
        for slot, shard, size, packed in zip(slots, shards, sizes, ids, strict=True):
            if shard != open_shard:
                if holder:
                    holder.__exit__(None, None, None)
                holder = new_file(folder, shard_name(shard))
                out, open_shard, expected = holder.__enter__(), shard, shard * shard_slots
            if slot != expected:
                raise ValueError(f"slot {expected} is missing or twice there")
            expected += 1
            out.write((size.to_bytes(4, "little") + packed).ljust(stride, b"\0"))
        place = pa.array((batch.column("slot").to_numpy() % shard_slots) * stride)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "chunk", "number", "slot", "shard", "n_tokens")), place],
                                         ["doc_id", "chunk", "number", "slot", "shard", "n_tokens", "byte_offset"])
    if holder:
        holder.__exit__(None, None, None)


def write_training_order(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS,
                         key: int = KEY, tokenizer: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Write all sequences; returns the folder (shards and manifest.json) and a row per sequence: doc_id, chunk, number, slot, shard, n_tokens, byte_offset.

    ``docs`` must give the same partitions when read twice, as a table's files do. A null or empty text is one sequence of ``end_id``. Rows repeated with one
    id are sequences each; null ids stay null; an empty table gives a manifest without shards; other columns are not read.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    counts = narrow.mapInArrow(partial(_count, path=path, seq_len=seq_len), "part int, n long").collect()  # a row per partition
    firsts, total = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        firsts[r["part"]] = (total, r["n"])
        total += r["n"]
    stride = 4 + seq_len * np.dtype(_id_type(path)).itemsize
    folder = make_folder(shared_folder(spark, "order"))
    store, at = open_folder(folder)
    with store.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps({"sequences": total, "seq_len": seq_len, "stride": stride, "shard_slots": shard_slots, "key": key, "rounds": ROUNDS,
                              "id_type": _id_type(path)}).encode())
    schema = f"doc_id {kind}, chunk int, number long, slot long, shard int, n_tokens int"
    placed = narrow.mapInArrow(partial(_place, path=path, seq_len=seq_len, end_id=end_id, firsts=firsts, total=total, key=key, shard_slots=shard_slots),
                               f"{schema}, ids binary")
    dealt = placed.repartitionById(max(1, -(-total // shard_slots)), "shard").sortWithinPartitions("slot")
    written = dealt.mapInArrow(partial(_write, folder=folder, stride=stride, shard_slots=shard_slots), f"{schema}, byte_offset long")
    return folder, materialise(written, "order-rows")


def read_slots(folder: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The ids of slots start..stop-1 in training order; begins anywhere."""
    store, at = open_folder(folder)
    with store.open_input_stream(f"{at}/manifest.json") as f:
        m = json.loads(f.read())
    read, stop = RangeReader(folder), m["sequences"] if stop is None else min(stop, m["sequences"])
    while start < stop:
        shard, first = divmod(start, m["shard_slots"])
        n = min(stop - start, m["shard_slots"] - first, max(1, (4 << 20) // m["stride"]))
        raw = read(shard_name(shard), first * m["stride"], n * m["stride"])
        for k in range(n):
            own = raw[k * m["stride"] : (k + 1) * m["stride"]]
            yield np.frombuffer(own, m["id_type"], int.from_bytes(own[:4], "little"), 4)
        start += n
    read.close()


def _checksums(batches: Iterator[pa.RecordBatch], folder: str, stride: int, id_size: int) -> Iterator[pa.RecordBatch]:
    """Adds the CRC-32 of each record's ids, as 32-bit numbers, read from the shards."""
    read, kind = RangeReader(folder), "<u2" if id_size == 2 else "<u4"
    for batch in batches:
        sums = []
        for shard, offset, size in zip(batch.column("shard").to_pylist(), batch.column("byte_offset").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
            raw = read(shard_name(shard), offset, stride)
            if int.from_bytes(raw[:4], "little") != size:
                raise ValueError(f"shard {shard} has another sequence at byte {offset}")
            sums.append(zlib.crc32(np.frombuffer(raw, kind, size, 4).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "ids_crc32"])
    read.close()


def training_order(docs: DataFrame) -> DataFrame:
    """Write all sequences, then read every record back: the rows of ``write_training_order`` with ids_crc32."""
    folder, rows = write_training_order(docs)
    store, at = open_folder(folder)
    with store.open_input_stream(f"{at}/manifest.json") as f:
        m = json.loads(f.read())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(partial(_checksums, folder=folder, stride=m["stride"], id_size=np.dtype(m["id_type"]).itemsize), f"{schema}, ids_crc32 long")
