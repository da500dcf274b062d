"""License scans: short notices found word by word, and with few errors.

A text is lower-cased (A-Z), its words are joined by single spaces. Exact places of a phrase are found by search.
For notices with errors, each phrase of k allowed errors is cut into k + 1 pieces: with at most k errors one piece
stands unchanged (pigeonhole). One automaton finds the pieces of all notices; only stretches around them are matched by
the regex library, whose pattern bounds the errors of each part and keeps the words that tell licenses apart exact.

Null and empty texts have no words, no labels and a score of 0. Repeated rows are scanned one by one; extra columns
are not read; an empty table gives an empty result. Texts of any length are scanned whole, in time that grows in
proportion to their length and their matches. Of matches that overlap the one of fewest errors counts, the first of equals.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import ALNUM, LOWER, text_columns

#: Phrase, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_CLEAN = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """A phrase and its label; in the words within braces one error each is allowed, the others must stand as they are."""

    text: str
    label: str

    @property
    def phrase(self) -> str:
        return re.sub("[{}]", "", self.text)

    @property
    def core(self) -> str:
        """The longest stretch that must stand as it is."""
        return max((x.strip() for x in re.sub("{.*?}", "|", self.text).split("|")), key=len)

    @property
    def errors(self) -> int:
        """In all."""
        return self.text.count("{")

    @property
    def pattern(self) -> str:
        return r"(?e)(?<![^ ])(?:" + re.sub(r"\{(.*?)\}", r"(?:\1){e<=1}", self.text) + r")(?![^ ])"


#: Short notices of common licenses as their texts and package files have them, in the licenses' alphabetical order.
NOTICES = (
    Notice("gnu {affero} {general} public license", "agpl"),
    Notice("{apache} license {version} 2", "apache-2"),
    Notice("{licensed} under the apache {license}", "apache-2"),
    Notice("{redistribution} and use in source and {binary} forms", "bsd"),
    Notice("bsd 2 {clause} {license}", "bsd"),
    Notice("bsd 3 {clause} {license}", "bsd"),
    Notice("{boost} {software} license", "bsl"),
    Notice("{licensed} {under} cc by", "cc-by"),
    Notice("{creative commons} {attribution}", "cc-by"),
    Notice("{licensed} {under} cc by nc", "cc-by-nc"),
    Notice("{creative commons} {attribution} noncommercial", "cc-by-nc"),
    Notice("{licensed} {under} cc by nd", "cc-by-nd"),
    Notice("{creative commons} {attribution} noderivatives", "cc-by-nd"),
    Notice("{licensed} {under} cc by sa", "cc-by-sa"),
    Notice("{creative commons} {attribution} sharealike", "cc-by-sa"),
    Notice("cc0 1 0 {universal}", "cc0"),
    Notice("{eclipse} public {license}", "epl"),
    Notice("gnu {general} public {license}", "gpl"),
    Notice("{released} under the isc {license}", "isc"),
    Notice("gnu {lesser} {general} public license", "lgpl"),
    Notice("{under the} mit {license}", "mit"),
    Notice("{permission} is {hereby} granted free of charge", "mit"),
    Notice("{mozilla} public {license}", "mpl"),
    Notice("free and {unencumbered} software released into the public {domain}", "unlicense"),
    *(Notice(f"{{spdx}} {{license}} identifier {name}", label) for name, label in (("agpl 3", "agpl"), ("apache 2", "apache-2"), ("bsd", "bsd"), ("gpl", "gpl"), ("isc", "isc"), ("lgpl", "lgpl"), ("mit", "mit"), ("mpl 2", "mpl"))),
)
SPANS = "array<struct<label:string,first_word:long,last_word:long,errors:int,text:string>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def pieces(phrase: bytes, errors: int) -> list[tuple[int, bytes]]:
    """errors + 1 pieces of phrase with their places in it."""
    n, k = len(phrase), errors + 1
    cut = [i * n // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _places(text: bytes, what: bytes) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _best(found: list[tuple]) -> list[tuple]:
    """found: errors, length below zero, start, end, ...: the matches that no better one overlaps, by errors, then the longest, then the first."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for x in sorted(found):
        i = bisect_right(starts, x[2])
        if (i == 0 or ends[i - 1] <= x[2]) and (i == len(starts) or x[3] <= starts[i]):
            starts.insert(i, x[2])
            ends.insert(i, x[3])
            kept.append(x)
    return kept


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(f" {p} ".encode(), p.encode().count(b" ") + 1, label) for p, label in phrases]
        self.notices = [(n.label, n.phrase.encode(), n.errors, n.core.encode(), regex.compile(n.pattern.encode())) for n in notices]
        # of each piece: the notices that it is of, and its places in them
        of: dict[bytes, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for at, piece in pieces(n.phrase.encode(), n.errors):
                of.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in of.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), places))
        self.automaton.make_automaton()

    def stretches(self, joined: bytes) -> dict[int, list[tuple[int, int]]]:
        """Of each notice that has a piece in the text: the stretches that hold its matches, in order, those that meet made one."""
        found: dict[int, list[tuple[int, int]]] = {}
        margins = [errors + 1 for _, _, errors, _, _ in self.notices]
        ends = [len(phrase) + errors + 1 for _, phrase, errors, _, _ in self.notices]
        for last, (size, places) in self.automaton.iter(joined.decode("latin-1")):
            for k, at in places:
                start = last + 1 - size - at
                found.setdefault(k, []).append((max(0, start - margins[k]), start + ends[k]))
        return {k: _merged(of) for k, of in found.items()}

    def scan(self, text: str) -> tuple:
        """The row of SCHEMA without doc_id."""
        words = text.encode().translate(_CLEAN).split()
        joined = b" " + b" ".join(words) + b" "
        edges: list = []

        def word_at(place: int) -> int:
            """The number of the word behind the space at place."""
            if not edges:
                edges.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32))
            return int(np.searchsorted(edges[0], place))

        starts, base, spans, best = [], set(), [], 0.0
        for phrase, n, label in self.phrases:
            for p in _places(joined, phrase):
                first = word_at(p)
                starts.append(first)
                base.add(label)
                spans.append((label, first, first + n - 1, 0, phrase.strip().decode()))
        found = []
        for k, of in self.stretches(joined).items():
            label, whole, allowed, core, pattern = self.notices[k]
            size = len(whole)
            for a, b in of:
                # whole words only: the stretch is widened to the spaces around it
                a, b = joined.rfind(b" ", 0, a + 1), joined.find(b" ", min(b, len(joined) - 1)) + 1 or len(joined)
                if joined.find(core, a, b) < 0:
                    continue
                places = list(_places(joined[a:b], b" " + whole + b" "))
                found += [(0, -size, a + p + 1, a + p + 1 + size, label, whole) for p in places]
                # what overlaps an exact place would yield to it, so only the gaps between are matched
                for low, high in zip([a, *(a + p + 1 + size for p in places)], [*(a + p + 1 for p in places), b], strict=True):
                    if high - low >= size - allowed:
                        found += [(sum(m.fuzzy_counts), -size, m.start(), m.end(), label, m[0]) for m in pattern.finditer(joined, low, high, overlapped=True)]
        exact = {(x[0], x[1]) for x in spans}
        for errors, below, start, _, label, what in _best(found):
            first = word_at(start - 1)
            best = max(best, 1 + errors / below)
            if (label, first) not in exact:
                spans.append((label, first, first + what.count(b" "), errors, what.decode("utf-8", "replace")))
        labels = base | {x[0] for x in spans}
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best, sorted(spans, key=lambda x: (x[1], x[2], x[0])),
        )


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text)."""
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("text", pa.string())]))
    keys = ("label", "first_word", "last_word", "errors", "text")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            ids, texts = text_columns(batch, "doc_id", "text")
            rows = [scanner.scan(x.as_py() or "") for x in texts]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            arrays.append(pa.array([[dict(zip(keys, s, strict=True)) for s in x] for x in columns[7]], span))
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=re.findall(r"(\w+) (?:long|string|double|array)", SCHEMA))

    return docs.select("doc_id", "text").mapInArrow(scanned, SCHEMA)
