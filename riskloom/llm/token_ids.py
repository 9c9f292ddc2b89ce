"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library, each distinct piece encoded once.

The byte-level pre-tokeniser cuts a text into pieces that are merged independently of each other. The cuts are found for a
whole group of texts at once with numpy; each distinct piece goes through the tokenizer once per worker (a bounded memo), and its ids
are copied to every place. Texts with characters whose class may differ between Unicode versions, outside the
basic plane, or with the tokenizer's added tokens go through the tokenizer whole. Results equal the tokenizer's own.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from riskloom.llm.textbytes import RangeHash

OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
#: The byte-level pre-tokeniser's pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per worker; beyond it the memo starts anew.
MEMO = 800_000
#: Longer texts are tokenised in parts, cut before a single space between letters.
PART_BYTES = 1 << 20


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    table = np.full(0x10001, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    kind = {"L": LETTER, "N": NUMBER}
    for c in chars:
        if old(c) != "Cn" and old(c)[0] == unicodedata.category(c)[0]:
            table[ord(c)] = kind.get(old(c)[0], OTHER)
    for m in regex.finditer(r"\s", "".join(chars)):
        table[ord(m[0])] = SPACE
    table[0x85] = table[0x180E] = UNSURE
    return table


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte position, code point, class) of every character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    lead = padded[at]
    point = lead.astype(np.int32)
    two, three = np.flatnonzero((lead >= 0xC0) & (lead < 0xE0)), np.flatnonzero((lead >= 0xE0) & (lead < 0xF0))
    for k, mask, more in ((two, 0x1F, 1), (three, 0x0F, 2)):
        value = point[k] & mask
        for i in range(1, more + 1):
            value = (value << 6) | (padded[at[k] + i] & 0x3F)
        point[k] = value
    kind = class_table()[point]
    kind[lead >= 0xF0] = UNSURE
    return at, point, kind


def piece_starts(point: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks of the characters that begin a piece. ``first``: marks of each text's first character."""
    n = len(kind)
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin)
    end = np.append(run[1:], n)
    marks = begin
    ends_text = np.append(first, True)[end]
    white = np.flatnonzero((kind[run] == SPACE) & ~ends_text)
    if len(white):
        a, b = run[white], end[white]
        marks[b[b - a > 1] - 1] = True
        glued = b[point[b - 1] == 32]
        marks[glued] = False
    quote = np.flatnonzero((point[run] == 39) & (end - run == 1) & ~ends_text)
    if len(quote):
        a = run[quote]
        spaced = (a > 0) & ~first[a] & (point[a - 1] == 32)
        a = a[~spaced & (kind[a + 1] == LETTER)]
        one = point[a + 1]
        inner = np.minimum(a + 2, n - 1)
        two = np.where((a + 2 < n) & ~first[inner], point[inner], -1)
        pairs = ((114, 101), (118, 101), (108, 108))  # re, ve, ll
        long = np.logical_or.reduce([(one == x) & (two == y) for x, y in pairs])
        short = np.isin(one, [115, 116, 109, 100])  # s, t, m, d
        marks[a[long | short] + 1] = False
        after = np.concatenate([a[short] + 2, a[long] + 3])
        marks[after[after < n]] = True
    return marks


def ranked_encoding(path: str):
    """The file's merges as a ``tiktoken`` encoding, which is faster on single pieces; None if merges aren't in id order."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab["".join(m)] for m in merges]
    if model["type"] != "BPE" or ids != list(range(256, 256 + len(ids))) or model.get("ignore_merges"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level files
    names = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(names[c] for c in t): i for t, i in vocab.items() if i < 256 + len(ids)}
    return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class PieceTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        self.ranked = ranked_encoding(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the pieces known, sorted
        self.slots = np.zeros(0, np.int64)  # their places in start and size
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)  # ids of all pieces

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if self.ranked:
            ids = list(map(self.ranked.encode_ordinary, pieces))
        else:
            ids = [e.ids for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        where = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, where, hashes)
        self.slots = np.insert(self.slots, where, np.arange(len(self.start), len(self.start) + len(ids)))
        self.start = np.append(self.start, len(self.pool) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.pool = np.append(self.pool, flat)

    def _fast(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray, point: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(at), bool)
        where = np.searchsorted(at, offsets[:-1])
        first[where[where < len(at)]] = True
        start = at[piece_starts(point, kind, first)]
        end = np.append(start[1:], len(data))
        hashes = RangeHash(data)(start, end)
        order = np.argsort(hashes)
        ranked = hashes[order]
        lead = np.append(True, ranked[1:] != ranked[:-1])
        unique, sample = ranked[lead], order[lead]
        if len(self.keys) + len(unique) > MEMO:
            self.forget()
        place = np.searchsorted(self.keys, unique)
        known = np.append(self.keys, np.uint64(0))[place] == unique if len(self.keys) else np.zeros(len(unique), bool)
        known &= place < len(self.keys)
        if not known.all():
            raw, s = data.tobytes(), sample[~known]
            self._learn(unique[~known], [raw[x:y].decode() for x, y in zip(start[s].tolist(), end[s].tolist(), strict=True)])
            place = np.searchsorted(self.keys, unique)
        slot = np.empty(len(start), np.int64)
        slot[order] = self.slots[place][np.cumsum(lead) - 1]
        size = self.size[slot]
        ends = np.cumsum(size, dtype=np.int64)
        flat = self.pool[np.repeat(self.start[slot] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.append(0, ends)[np.searchsorted(start, offsets)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets) for the rows of a byte array."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if len(data) > PART_BYTES:
            return self._in_parts(data, offsets)
        at, point, kind = classes(data)
        slow = np.zeros(n, bool)
        odd = at[kind == UNSURE]
        slow[np.searchsorted(offsets, odd, "right") - 1] = True
        if self.added and (raw := data.tobytes()):
            for m in self.added.finditer(raw):
                slow[np.searchsorted(offsets, m.start(), "right") - 1] = True
        if not slow.any():
            return self._fast(data, offsets, at, point, kind)
        rows: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        for i in np.flatnonzero(slow):
            rows[i] = np.array(self.whole.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
        rest = np.flatnonzero(~slow)
        if len(rest):
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in rest])
            bounds = np.append(0, np.cumsum(offsets[rest + 1] - offsets[rest]))
            flat, cuts = self.encode(part, bounds)
            for k, i in enumerate(rest):
                rows[i] = flat[cuts[k] : cuts[k + 1]]
        return np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))

    def _in_parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, out, total, ends = data.tobytes(), [], 0, [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            whole = self.added and self.added.search(raw, a, b)
            while a < b:
                cut = None if whole or b - a <= PART_BYTES else re.compile(rb"[A-Za-z] [A-Za-z]").search(raw, a + PART_BYTES // 2, b)
                to = cut.start() + 1 if cut else b
                if to - a > PART_BYTES:  # one long run without a safe cut
                    flat = np.array(self.whole.encode(raw[a:to].decode(), add_special_tokens=False).ids, np.int32)
                else:
                    flat, _ = self.encode(data[a:to], np.array([0, to - a]))
                out.append(flat)
                total += len(flat)
                a = to
            ends.append(total)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(ends)


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One per worker and file."""
    return PieceTokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
