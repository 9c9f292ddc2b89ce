"""Secret scan: three fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates are runs of at least ``LEAST`` characters of [A-Za-z0-9+/_-]. From its characters a run's encoding is inferred (hex, base32, base36, base64, or
plain letters or digits), and three tests ask whether it could be drawn evenly from that alphabet: chi-squared uniformity, the runs above and below
the alphabet's middle, and the serial correlation of neighbours. Fisher's method combines the p-values into one; a high value looks random.
Letters of one case (or with a capital) and plain digits are ordinary words and numbers, whatever they look like, and are no candidates.

What ordinary text scores is measured for each encoding and class of length on its own. The controls are resampled from the texts: all of a text's characters of the
encoding's alphabet, one after another without what stands between them and without candidates, cut to lengths of the class (for hex, the text's digits), and letters' long words for encodings of all letters. A candidate's
p-value is the share of its class's controls that score as high, and Benjamini and Hochberg's rule at ``RATE`` over the candidates of the class sets the
threshold, so that many dull candidates of one encoding or length don't shut out another's keys. A class takes the controls of the next shorter one as well, and while these are
few those of all shorter ones of its encoding: longer runs have more powerful tests, so this errs on the safe side. Without any nothing of the encoding is reported.

Counts by encoding, length class and score bucket are summed over all documents (some twenty thousand numbers); one pass reads the texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, text_or_empty
from riskloom.llm.textbytes import LOWER, apart, row_groups, runs, string_buffers, text_points

LEAST = 16
RATE = 0.05
BUCKETS = 200
#: Upper ends of the length classes; the last class is open.
LENGTHS = (18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256)
ENOUGH = 50
#: Characters of controls tested at once; they take some hundred bytes each.
TESTED = 1 << 18

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Lower-case text that every assign match holds.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

_HEX, _RUN = np.zeros((2, 256), bool)
_HEX[48:58] = _HEX[97:103] = True
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = True
_RUN[[43, 45, 47, 95]] = True

#: Encodings from the narrowest alphabet on; a run has the first that holds all its characters. Letters alone are controls.
ALPHABETS = {
    "digits": b"0123456789", "hex": b"0123456789abcdef", "hexu": b"0123456789ABCDEF", "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": b"0123456789abcdefghijklmnopqrstuvwxyz",
    "base36u": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"}
NAMES = tuple(ALPHABETS)
#: Words and numbers: never reported.
ORDINARY = np.isin(NAMES, ["digits", "lower", "upper"])
_INDEX = np.full((len(NAMES), 256), -1, np.int64)
for _k, _a in enumerate(ALPHABETS.values()):
    _INDEX[_k, np.frombuffer(_a, np.uint8)] = np.arange(len(_a))
_INDEX[-1, [45, 95]] = 62, 63  # the URL forms of + and /
_SIZE = np.array([10, 16, 16, 26, 26, 32, 36, 36, 64])


def upper_tail(z: np.ndarray) -> np.ndarray:
    """P(N(0, 1) > z), by the rational approximation of the error function with an error below 2e-7."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * np.exp(-x * x)
    return np.where(z >= 0, tail, 1 - tail)


def battery(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Combined p-value of each run under even, independent draws from its encoding's alphabet."""
    n = end - start
    who = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    x = _INDEX[code[who], data[at]]
    k = _SIZE[code].astype(float)
    counts = np.bincount(who * 64 + x, minlength=len(n) * 64).reshape(-1, 64)
    chi = k / n * (counts.astype(float) ** 2).sum(axis=1) - n
    # Wilson-Hilferty on the exact mean and variance of the statistic for few draws
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    freedom = 2 * mean**2 / var
    z_chi = (np.cbrt(np.maximum(chi, 1e-9) / mean) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom))
    high = (x * 2 >= k[who]).astype(float)
    inner = who[1:] == who[:-1]
    changes = np.bincount(who[1:][inner], (high[1:] != high[:-1])[inner], len(n)) + 1
    n1 = np.bincount(who, high, len(n))
    n2 = n - n1
    expect = 2 * n1 * n2 / n + 1
    spread = np.sqrt(np.maximum((expect - 1) * (expect - 2) / np.maximum(n - 1, 1), 1e-9))
    z_runs = np.where((n1 == 0) | (n2 == 0), 6.0, (changes - expect) / spread)
    centred = x - ((k - 1) / 2)[who]
    product = np.bincount(who[1:][inner], (centred[1:] * centred[:-1])[inner], len(n))
    square = np.bincount(who, centred**2, len(n))
    z_serial = product / np.maximum(square, 1e-9) * np.sqrt(n)
    p = np.stack([upper_tail(z_chi), 2 * upper_tail(np.abs(z_runs)), 2 * upper_tail(np.abs(z_serial))])
    half = -np.log(np.clip(p, 1e-12, 1)).sum(axis=0)
    return np.exp(-half) * (1 + half + half**2 / 2)  # chi-squared tail with six degrees of freedom


def infer(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Each run's encoding (index into NAMES). A capital before lower-case letters doesn't change an ordinary word's class."""
    n = end - start
    code = np.full(len(n), len(NAMES) - 1)
    first_up = (data[start] >= 65) & (data[start] < 91)
    for k in range(len(NAMES) - 2, -1, -1):
        inside = np.append(0, np.cumsum(_INDEX[k][data] >= 0))
        code[inside[end] - inside[start] == n] = k
        if NAMES[k] == "lower":
            code[first_up & (inside[end] - inside[start] == n - 1)] = k
    return code


def length_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, n, "left")


#: Which characters of a text make the controls of an encoding: itself, or for hex the digits.
_DRAWN = {"hex": "digits", "hexu": "digits", "base32": "base32", "base36": "base36", "base36u": "base36u", "base64": "base64"}
#: A length of each class.
_CLASS_SIZE = np.append(LENGTHS, 2 * LENGTHS[-1])


def resampled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, free: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(encoding, length class, score) of each text's own controls: its characters of each alphabet, all of them, cut to one length; text and encoding
    choose the class. The last cut ends with the text, and so may share characters with the one before it.

    free: the bytes that lie in no candidate, so that no key is its own control.
    """
    pick = np.add.reduceat(data.astype(np.int64), starts) if len(starts) else starts
    for k, name in enumerate(NAMES):
        if name not in _DRAWN:
            continue
        inside = free & (_INDEX[NAMES.index(_DRAWN[name])][data] >= 0)
        count = np.append(0, np.cumsum(inside))
        have = count[ends] - count[starts]
        size = _CLASS_SIZE[(pick + ends - starts + 7 * k) % len(_CLASS_SIZE)]
        size = np.where(size > have, _CLASS_SIZE[np.maximum(np.searchsorted(_CLASS_SIZE, have, "right") - 1, 0)], size)  # the longest that the text can fill
        size = np.where(have < LEAST, 1, np.minimum(size, have))
        cuts = np.where(have < LEAST, 0, -(-have // size))
        rows = np.repeat(np.arange(len(starts)), cuts)
        if not len(rows):
            continue
        number = np.arange(len(rows)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        high = np.minimum(count[starts[rows]] + (number + 1) * size[rows], count[ends[rows]])
        low = high - size[rows]
        drawn, total = data[inside], np.cumsum(high - low)
        for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(total // TESTED)) + 1):
            yield k, length_class(high[own] - low[own]), battery(drawn, low[own], high[own], np.full(len(own), k))


def _runs_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, encoding, score) of all candidate and control runs."""
    a, b = runs(_RUN[data], starts)
    long = b - a >= LEAST
    a, b = a[long], b[long]
    if not len(a):
        return a, b, a, np.zeros(0)
    code = infer(data, a, b)
    lowered = data.copy()  # an ordinary word's capital is tested as its letter
    cap = (NAMES.index("lower") == code) & (data[a] >= 65) & (data[a] < 91)
    lowered[a[cap]] += 32
    return a, b, code, battery(lowered, a, b, code)


def base_spans(text: np.ndarray, raw: bytes, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns in bytes that hold rows apart."""
    found = []
    low = raw.lower()
    rows = set()
    for word in ASSIGN_WORDS:
        at = low.find(word)
        while at >= 0:
            row = int(np.searchsorted(starts, at, "right")) - 1
            rows.add(row)
            at = low.find(word, int(starts[row + 1])) if row + 1 < len(starts) else -1
    for row in rows:
        stop = int(starts[row + 1]) if row + 1 < len(starts) else len(raw)
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw, int(starts[row]), stop) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    a, b = runs(_HEX[text], starts)
    long = b - a >= 24
    return found + [(x, y, 2) for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True)]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.int32()), ("bucket", pa.int32())])
_CONTROL = pa.struct([("mark", pa.int32()), ("n", pa.int64())])
#: Length classes of an encoding.
FAMILY = len(LENGTHS) + 1
SCHEMA = ("base array<struct<kind string, start long, end long>>, "
          "candidates array<struct<kind string, start long, end long, family int, bucket int>>, controls array<struct<mark int, n long>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for low, high in row_groups(offsets):
            n = high - low
            text, starts = apart(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            raw, point = text.tobytes(), text_points(text)
            row_of = lambda at: np.searchsorted(starts, at, "right") - 1  # noqa: B023, E731
            base: list[list[dict]] = [[] for _ in range(n)]
            taken: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            for a, b, kind in sorted(base_spans(text, raw, starts), key=lambda s: (s[0], s[2])):
                row = int(row_of(a))
                zero = point[starts[row]]
                base[row].append({"kind": KINDS[kind], "start": int(point[a] - zero), "end": int(point[b] - zero)})
                taken[row].append((a, b))
            a, b, code, score = _runs_of(text, starts)
            size, bucket = length_class(b - a), np.minimum((score * BUCKETS).astype(np.int64), BUCKETS - 1)
            rows = row_of(a)
            ordinary = ORDINARY[code] if len(a) else np.zeros(0, bool)
            found: list[list[dict]] = [[] for _ in range(n)]
            cover = {row: Cover(spans) for row, spans in enumerate(taken) if spans}
            for i in np.flatnonzero(~ordinary).tolist():
                row = int(rows[i])
                if row in cover and cover[row].holds(int(a[i]), int(b[i])):
                    continue
                zero = point[starts[row]]
                found[row].append({"kind": f"random-{NAMES[code[i]]}", "start": int(point[a[i]] - zero), "end": int(point[b[i]] - zero),
                                   "family": int(code[i] * FAMILY + size[i]), "bucket": int(bucket[i])})
            ends = np.append(starts[1:] - 1, len(text) - 1) if n else starts
            marks = [np.zeros(0, np.int64)]
            step = np.zeros(len(text) + 1, np.int64)
            np.add.at(step, a[~ordinary], 1)
            np.add.at(step, b[~ordinary], -1)
            for k, own, high in resampled(text, starts, ends, np.cumsum(step[:-1]) == 0):
                marks.append((k * FAMILY + own) * BUCKETS + np.minimum((high * BUCKETS).astype(np.int64), BUCKETS - 1))
            words = np.flatnonzero(ordinary & (code != NAMES.index("digits"))) if len(a) else rows
            if len(words):  # long words count for the encodings that hold all letters
                low_words, data_words = a[words], LOWER[text]
                for name in ("base36", "base64"):
                    k = NAMES.index(name)
                    high = battery(data_words, low_words, b[words], np.full(len(words), k))
                    marks.append((k * FAMILY + size[words]) * BUCKETS + np.minimum((high * BUCKETS).astype(np.int64), BUCKETS - 1))
            mark, times = np.unique(np.concatenate(marks), return_counts=True)
            controls = [[{"mark": int(m), "n": int(t)} for m, t in zip(mark, times, strict=True)]] + [[]] * (n - 1)  # with the group's first row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, n), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_CANDIDATE)), pa.array(controls, pa.list_(_CONTROL))],
                ["doc_id", "base", "candidates", "controls"])


class Cover:
    """Disjoint kinds of spans by start; tells whether one of them holds another span, by the largest end up to its start."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.most = list(accumulate((b for _, b in spans), max))

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.most[k - 1] >= end


def thresholds(candidates: dict[tuple[int, int], int], controls: dict[tuple[int, int], int], rate: float = RATE) -> list[int]:
    """Lowest passing bucket of each family (encoding, length class), by Benjamini and Hochberg's rule; BUCKETS: none passes.

    candidates, controls: counts by (family, bucket).
    """
    out = []
    for code in range(len(NAMES)):
        shorter = np.zeros(BUCKETS)
        for size in range(FAMILY):
            family = code * FAMILY + size
            own = np.array([controls.get((family, k), 0) for k in range(BUCKETS)], float)
            seen = shorter + own
            shorter = own if own.sum() >= ENOUGH else seen
            cand = np.array([candidates.get((family, k), 0) for k in range(BUCKETS)], float)
            passing, null = cand[::-1].cumsum()[::-1], seen[::-1].cumsum()[::-1]
            p = (null + 1) / (seen.sum() + 1)
            good = np.flatnonzero((passing > 0) & (p * cand.sum() <= rate * passing)) if seen.sum() else np.zeros(0, int)
            out.append(int(good[0]) if len(good) else BUCKETS)
    return out


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (kind, start, end) in code points, by start.

    spans holds the base and the runs that pass the battery and don't lie inside a base span. Null texts are empty and have no spans. Repeated rows
    are scanned each; null ids stay null; an empty table gives no rows; other columns aren't read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    found = materialise(docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
                        .mapInArrow(_scan, f"doc_id {kind}, {SCHEMA}"), "secrets")
    counted = found.select(F.explode("candidates").alias("c")).groupBy("c.family", "c.bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    marks = found.select(F.explode("controls").alias("m")).groupBy("m.mark").agg(F.sum("m.n").alias("n")).collect()
    cut = thresholds({(r[0], r[1]): r[2] for r in counted}, {divmod(r["mark"], BUCKETS): r["n"] for r in marks}, rate)
    passing = F.filter("candidates", lambda c: c["bucket"] >= F.element_at(F.array(*map(F.lit, cut)), c["family"] + 1))
    added = F.transform(passing, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", "base", F.concat("base", added).alias("spans"))


def _joined(spans: str) -> Column:
    """kind:start:end by start, then kind as listed (base kinds first, others by name), comma-joined."""
    order = " ".join(f"WHEN '{k}' THEN '{i}'" for i, k in enumerate(KINDS))
    ranked = F.expr(f"array_sort(transform({spans}, s -> struct(s.start AS start, CASE s.kind {order} ELSE s.kind END AS rank, s.end AS end, s.kind AS kind)))")
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """The digest of a scan: counts of the base kinds, the hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
