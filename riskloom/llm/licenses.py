"""License scan by ordered signature rules.

A rule is a regular expression with a label and a priority; hundreds come from the names below, each in several ways of stating a license (an SPDX
tag, a notice, a link, a bare mention), others are sentences of the license texts. A rule runs only on texts that hold its keywords, which are literals of the pattern that every match holds. Overlapping
detections are resolved in order of priority, then length: one that lies inside an accepted detection is suppressed. Three word phrases are
always reported (the base), wherever their words stand consecutively.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import text_or_empty
from riskloom.llm.textbytes import LOWER, apart, row_groups, runs, string_buffers

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, SPDX identifiers, name, link; fixed texts of the licenses themselves.
NAMES = [
    ("mit", "mit", r"(?:the )?mit(?:/x11)?(?:[- ]style)? licen[sc]e|(?:the )?expat licen[sc]e", r"opensource\.org/licenses/mit"),
    ("mit-0", "mit-0", r"mit no attribution(?: licen[sc]e)?", r"opensource\.org/licenses/mit-0"),
    ("apache-2", r"apache-2\.0", r"(?:the )?apache(?: software)? licen[sc]e,? (?:version |v)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1", r"apache-1\.[01]", r"(?:the )?apache(?: software)? licen[sc]e,? (?:version |v)?1(?:\.[01])?", r"apache\.org/licenses/license-1\.[01]"),
    ("gpl-3", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:the )?(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:the )?(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v)?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl", r"gpl", r"(?:the )?gnu (?:general public licen[sc]e|gpl)", r"gnu\.org/(?:copyleft|licenses)/gpl"),
    ("lgpl-3", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:the )?(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2", r"lgpl-2\.[01](?:-only|-or-later|\+)?", r"(?:the )?(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl),? ?(?:version |v)?2(?:\.[01])?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.[01]"),
    ("agpl-3", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:the )?(?:gnu )?(?:affero general public licen[sc]e|agpl),? ?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", r"gfdl-1\.[0-3](?:-only|-or-later)?", r"(?:the )?gnu free documentation licen[sc]e", r"gnu\.org/(?:copyleft|licenses)/fdl"),
    ("bsd-2", "bsd-2-clause", r"(?:the )?(?:2-clause|two-clause|simplified|freebsd) bsd(?: licen[sc]e)?", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3", "bsd-3-clause", r"(?:the )?(?:3-clause|three-clause|new|modified|revised) bsd(?: licen[sc]e)?", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4", "bsd-4-clause", r"(?:the )?(?:4-clause|four-clause|original) bsd(?: licen[sc]e)?", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", "0bsd", r"(?:the )?bsd(?:[- ]style)? licen[sc]e", r"opensource\.org/licenses/0bsd"),
    ("mpl-2", r"mpl-2\.0", r"(?:the )?(?:mozilla public licen[sc]e|mpl),? ?(?:version |v)?2(?:\.0)?", r"mozilla\.org/mpl/2\.0"),
    ("mpl-1", r"mpl-1\.[01]", r"(?:the )?(?:mozilla public licen[sc]e|mpl),? ?(?:version |v)?1(?:\.[01])?", r"mozilla\.org/mpl/1\.[01]"),
    ("epl-2", r"epl-2\.0", r"(?:the )?(?:eclipse public licen[sc]e|epl)(?: -)?,? ?(?:version |v)?2(?:\.0)?", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("epl-1", r"epl-1\.0", r"(?:the )?(?:eclipse public licen[sc]e|epl)(?: -)?,? ?(?:version |v)?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("eupl", r"eupl-1\.[0-2]", r"(?:the )?european union public licen[sc]e", r"joinup\.ec\.europa\.eu/[a-z/]*eupl"),
    ("cddl", r"cddl-1\.[01]", r"(?:the )?common development and distribution licen[sc]e", r"opensource\.org/licenses/cddl"),
    ("cpl", r"cpl-1\.0", r"(?:the )?common public licen[sc]e", r"opensource\.org/licenses/cpl1\.0"),
    ("isc", "isc", r"(?:the )?isc licen[sc]e", r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)? licen[sc]e", r"opensource\.org/licenses/zlib"),
    ("boost", r"bsl-1\.0", r"(?:the )?boost software licen[sc]e", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"(?:the )?do what the fuck you want to public licen[sc]e|wtfpl", r"wtfpl\.net"),
    ("artistic-2", r"artistic-2\.0", r"(?:the )?artistic licen[sc]e,? ?(?:version |v)?2(?:\.0)?", r"opensource\.org/licenses/artistic-2\.0"),
    ("artistic-1", r"artistic-1\.0(?:-perl)?", r"(?:the )?artistic licen[sc]e", r"opensource\.org/licenses/artistic-1\.0"),
    ("psf", r"psf-2\.0|python-2\.0", r"(?:the )?python software foundation licen[sc]e|psf licen[sc]e", r"docs\.python\.org/[0-9a-z/.]*license"),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[sc]e", r"opensource\.org/licenses/postgresql"),
    ("openssl", "openssl", r"(?:the )?openssl licen[sc]e", r"openssl\.org/source/license"),
    ("ofl", r"ofl-1\.[01]", r"(?:the )?(?:sil )?open font licen[sc]e", r"scripts\.sil\.org/ofl"),
    ("odbl", r"odbl-1\.0", r"(?:the )?open (?:data commons )?open database licen[sc]e|odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"odc-by-1\.0", r"(?:the )?open data commons attribution licen[sc]e|odc-by", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"pddl-1\.0", r"(?:the )?public domain dedication and licen[sc]e", r"opendatacommons\.org/licenses/pddl"),
    ("cc0", r"cc0-1\.0", r"cc0(?: 1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", r"cc-by-[1-4]\.[05]", r"(?:creative commons attribution|cc[- ]by)(?: (?:licen[sc]e|[1-4]\.[05]))", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", r"cc-by-sa-[1-4]\.[05]", r"creative commons attribution[- ]share[- ]?alike|cc[- ]by[- ]sa", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nd", r"cc-by-nd-[1-4]\.[05]", r"creative commons attribution[- ]no[- ]?deriv(?:ative)?s|cc[- ]by[- ]nd", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc", r"cc-by-nc-[1-4]\.[05]", r"creative commons attribution[- ]non[- ]?commercial|cc[- ]by[- ]nc", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1-4]\.[05]", r"creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike|cc[- ]by[- ]nc[- ]sa", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[1-4]\.[05]", r"creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s|cc[- ]by[- ]nc[- ]nd", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("ms-pl", "ms-pl", r"(?:the )?microsoft public licen[sc]e", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "ms-rl", r"(?:the )?microsoft reciprocal licen[sc]e", r"opensource\.org/licenses/ms-rl"),
    ("upl", r"upl-1\.0", r"(?:the )?universal permissive licen[sc]e", r"opensource\.org/licenses/upl"),
    ("ncsa", "ncsa", r"(?:the )?university of illinois/ncsa open source licen[sc]e|ncsa licen[sc]e", r"opensource\.org/licenses/ncsa"),
    ("afl", r"afl-[1-3]\.[01]", r"(?:the )?academic free licen[sc]e", r"opensource\.org/licenses/afl-3\.0"),
    ("osl", r"osl-[1-3]\.[01]", r"(?:the )?open software licen[sc]e", r"opensource\.org/licenses/osl-3\.0"),
    ("sspl", r"sspl-1\.0", r"(?:the )?server side public licen[sc]e", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl", r"busl-1\.1", r"(?:the )?business source licen[sc]e", r"mariadb\.com/bsl"),
    ("elastic", r"elastic-2\.0", r"(?:the )?elastic licen[sc]e", r"elastic\.co/licensing/elastic-license"),
    ("llama", r"llama[23](?:\.[0-9])?", r"(?:the )?llama ?[23](?:\.[0-9])? (?:community )?licen[sc]e", r"llama\.(?:meta\.)?com/[a-z0-9_/-]*license"),
    ("openrail", r"openrail(?:\+\+|-m)?", r"(?:the )?(?:creativeml )?open ?rail(?:\+\+|-m)?(?: licen[sc]e)?", r"huggingface\.co/spaces/[a-z0-9_/-]*license"),
    ("public-domain", "nlod-1\\.0", r"(?:released|dedicated|placed|in) (?:in)?to the public domain|in the public domain", r"creativecommons\.org/publicdomain/mark"),
    ("proprietary", "licenseref-proprietary", r"all rights reserved", r"copyright\.gov/title17"),
]
#: Sentences of the license texts themselves, and of the notices that go before source files; words may be parted by line ends and comment signs.
BODIES = [
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("boost", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an"),
    ("gpl", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl-2", "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("epl-2", "the accompanying program is provided under the terms of this eclipse public license"),
    ("zlib", "the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("ofl", "the font software may be sold as part of a larger software package but no copy of one or more of the font"),
    ("unlicense", "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("proprietary", "unauthorized copying of this file, via any medium is strictly prohibited"),
]
BODY_PRIORITY, BODY_GAP = 95, r"[\s*#/]+"
#: Names before another one in an expression.
_LIST = r"(?:\(*[a-z0-9.+-]+\)* (?:or|and|with) )*\(*"
#: An expression names several licenses, of which each is its own span: a rule with a group ``id`` reports that alone.
#: priority, pattern around the name ({spdx}, {name} or {link})
WAYS = [
    (100, r"spdx-license-identifier:\s*" + _LIST + r"(?P<id>{spdx})(?![a-z0-9.+-])"),
    (90, r"(?:licen[sc]ed|released|distributed|redistributed|provided|available|published|issued|covered|made available)"
                  r" (?:only )?(?:under|by|with)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:{name})"),
    (88, r"licen[sc]ed (?:only )?under(?: the)?(?: terms(?: and conditions)? of)?(?: (?:either|both))?(?: the)? "
         r"(?:[a-z0-9.+-]+(?:,? (?:or|and) (?:the )?|, | ?/ ?))*(?P<id>{spdx})(?![a-z0-9+-]|\.[0-9a-z])"),
    (85, r"(?:licen[sc]es?|licensing)[\"']? ?[:=] ?[\"'(]*" + _LIST + r"(?P<id>{spdx}|{name})(?![a-z0-9-])"),
    (80, r"(?:https?://)?(?:www\.)?{link}[a-z0-9./-]*"),
    (70, r"(?:under|to|accept|with) the terms(?: and conditions)? of (?:the )?(?:{name})"),
    (40, r"(?<![a-z0-9])(?:{name})(?![a-z0-9])"),
]

_WORD = np.ones(256, bool)
_WORD[:128] = False
_WORD[48:58] = _WORD[97:123] = True
_GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: The text gate looks for the first of these that a literal holds in place of the literal, so that it has fewer to look for.
STEMS = ("licen", "gpl", "bsd", "public domain", "cc by", "cc-by", "cc0", "creative commons", "odbl", "odc-by", "wtfpl", "apache", "mozilla", "mpl", "epl",
         "openrail", "open rail", "all rights reserved", "mit no attribution")
_EXPAND = 128


def _least(literals: set[str]) -> frozenset[str]:
    """The literals that hold no other one."""
    return frozenset(x for x in literals if not any(y != x and y in x for y in literals))


def _rank(group: frozenset[str]) -> tuple[int, int]:
    return min(map(len, group)), -len(group)


def _literals(parsed) -> tuple[set[str] | None, list[frozenset[str]]]:
    """(all strings that match, if few; groups of literals: every match holds one of each group) of a parsed pattern."""
    run, whole, groups = {""}, True, []

    def flush(more: list[frozenset[str]]) -> None:
        nonlocal run, whole
        if "" not in run:
            groups.append(_least(run))
        groups.extend(more)
        run, whole = {""}, False

    for op, arg in parsed:
        op, inner, own = str(op), [], None
        if op in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if op == "LITERAL":
            own = {chr(arg)}
        elif op == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            own = {chr(c) for _, c in arg}
        elif op == "SUBPATTERN":
            own, inner = _literals(arg[-1])
        elif op == "BRANCH":
            ways = [_literals(x) for x in arg[1]]
            if all(w is not None for w, _ in ways):
                own = set().union(*(w for w, _ in ways))
            best = [max(([_least(w)] if w and "" not in w else []) + g, key=_rank, default=None) for w, g in ways]
            inner = [_least(set().union(*best))] if all(best) else []
        elif op == "MAX_REPEAT":
            least, most, body = arg
            own, inner = _literals(body)
            if (least, most) == (0, 1) and own is not None:
                own = own | {""}
            elif (least, most) != (1, 1):
                inner = (inner if own is None or "" in own else [_least(own)]) if least else []
                own = None
        if own is not None and len(own) * len(run) > _EXPAND and len(own) <= _EXPAND:
            flush([])
        if own is not None and len(own) <= _EXPAND:
            run = {x + y for x in run for y in own}
        else:
            flush(inner)
    if not whole and "" not in run:
        groups.append(_least(run))
    return (run if whole else None), groups


def must_hold(pattern: str) -> tuple[frozenset[str], ...]:
    """Groups of literals: a text that the pattern matches holds one of each group."""
    whole, groups = _literals(re._parser.parse(pattern))
    return tuple(dict.fromkeys(groups if whole is None else [_least(whole)] if "" not in whole else []))


@lru_cache(maxsize=1)
def rules() -> list[tuple[str, int, str, tuple[frozenset[str], ...], re.Pattern]]:
    """(rule, priority, label, groups of keywords of each of which a text must hold one, pattern), highest priority first."""
    made = []
    for priority, way in WAYS:
        for label, spdx, name, link in NAMES:
            put = lambda g: way.replace("{spdx}", f"{g}{spdx})").replace("{name}", f"{g}{name})").replace("{link}", f"{g}{link})")  # noqa: B023, E731
            # the parser takes groups that capture as units, so the name's literals aren't cut in the middle
            made.append((f"{label}/{priority}", priority, label, must_hold(put("(")), re.compile(put("(?:"))))
    for k, (label, body) in enumerate(BODIES):
        pattern = BODY_GAP.join(map(re.escape, body.split()))
        made.append((f"{label}/text-{k}", BODY_PRIORITY, label, must_hold(pattern), re.compile(pattern)))
    return sorted(made, key=lambda r: -r[1])


@lru_cache(maxsize=1)
def keywords() -> tuple[bytes, ...]:
    """A text without any of these holds no signature."""
    short = lambda group: _least({next((s for s in STEMS if s in k), k) for k in group})
    best = {max(map(short, rule[3]), key=lambda g: (g <= set(STEMS), _rank(g))) for rule in rules()}
    return tuple(sorted(x.encode() for x in _least(set().union(*best))))


class Cover:
    """Intervals over known starts; tells in logarithmic time whether one of those added holds another (prefix maxima of ends in a Fenwick tree)."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.most = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.most):
            self.most[i] = max(self.most[i], end)
            i += i & -i

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        while i:
            if self.most[i] >= end:
                return True
            i -= i & -i
        return False


def detect(text: str) -> list[tuple[int, int, str, str, int]]:
    """Accepted detections (start, end, label, rule, priority) in a lower-case text, by start."""
    found = []
    held: dict[frozenset[str], bool] = {}
    for rule, priority, label, needs, pattern in rules():
        for group in needs:
            if group not in held:
                held[group] = any(k in text for k in group)
            if not held[group]:
                break
        else:
            part = "id" if "id" in pattern.groupindex else 0
            found += [(*m.span(part), label, rule, priority) for m in pattern.finditer(text)]
    found.sort(key=lambda x: (-x[4], x[0] - x[1], x[0], x[2]))
    kept, cover = [], Cover([x[0] for x in found])
    for x in found:
        if not cover.holds(x[0], x[1]):
            kept.append(x)
            cover.add(x[0], x[1])
    return sorted(kept)


@lru_cache(maxsize=1)
def _phrases() -> list[tuple[str, re.Pattern]]:
    return [(label, re.compile(_GAP.join(w.encode() for w in phrase.split()))) for phrase, label in PHRASES.items()]


SCHEMA = ("n_words long, base array<struct<label string, word long>>, "
          "detections array<struct<start long, end long, label string, rule string, priority int>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32())]))
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for low, high in row_groups(offsets):
            n = high - low
            text, starts = apart(LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low])
            begin, _ = runs(_WORD[text], starts)
            first = np.append(np.searchsorted(begin, starts), len(begin))
            raw = text.tobytes()
            base: list[list[dict]] = [[] for _ in range(n)]
            for label, pattern in _phrases():
                for m in pattern.finditer(raw):
                    a, b = m.span()
                    row = int(np.searchsorted(starts, a, "right")) - 1
                    if (a and _WORD[text[a - 1]]) or _WORD[text[b]] or (row + 1 < n and b > starts[row + 1]):
                        continue
                    base[row].append({"label": label, "word": int(np.searchsorted(begin, a)) - int(first[row])})
            marked = set()
            for k in keywords():
                at = raw.find(k)
                while at >= 0:
                    row = int(np.searchsorted(starts, at, "right")) - 1
                    marked.add(row)
                    at = raw.find(k, int(starts[row + 1])) if row + 1 < n else -1
            found: list[list[dict]] = [[] for _ in range(n)]
            for row in marked:
                end = int(starts[row + 1]) - 1 if row + 1 < n else len(raw) - 1
                own = raw[int(starts[row]) : end].decode()
                found[row] = [dict(zip(("start", "end", "label", "rule", "priority"), x, strict=True)) for x in detect(own)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), pa.array(np.diff(first)), pa.array(base, base_type), pa.array(found, found_type)],
                                             ["doc_id", "n_words", "base", "detections"])


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base (label and word place of each phrase), detections (code points, rule, priority).

    Null texts are empty and have no words. Only A-Z is lower-cased. Repeated rows are scanned each; null ids stay null; an empty table gives no rows; other
    columns aren't read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    return (docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
            .mapInArrow(_scan, f"doc_id {kind}, {SCHEMA}"))


def summary(scanned: DataFrame) -> DataFrame:
    """The digest of a scan: counts, first and last place of a phrase, label lists and the strongest priority as a score."""
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*columns))), ",")
    words = "transform(base, x -> x.word)"
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.expr(f"array_min({words})").alias("first_word"),
        F.expr(f"array_max({words})").alias("last_word"), labels(F.col("base.label")).alias("base_labels"),
        labels(F.col("base.label"), F.col("detections.label")).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(0.9)).otherwise(F.lit(0.0)),
                   F.coalesce(F.expr("array_max(transform(detections, x -> x.priority)) / 100.0D"), F.lit(0.0))).cast("double").alias("score"))
