"""Terms that stay in English, of which a list may have very many: found by a look-up of each word's n-grams, not by one pattern of all terms.

A term is an n-gram of runs of letters with what stands between them, and maybe marks before the first and behind the last. Its letters,
in lower case, are the key of a dictionary that is broadcast; a text's runs of letters are looked up with those numbers of
following runs that some term has, so a text costs its words times the different lengths of terms, whatever their number. Texts stay
where they are. Of occurrences that overlap the one that begins first counts, of those that begin together the first in the list.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Terms of a list, at most: each is some hundred bytes in every worker.
MOST = 1 << 20
_RUN = re.compile("[A-Za-z]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: By number of runs and their text in lower case: a term's place in the list, and the marks before and behind.
Index = dict[int, dict[str, list[tuple[int, str, str]]]]


def index(terms: list[str]) -> Index:
    """Terms without a letter are left out: they have no word to look up."""
    if len(terms) > MOST:
        raise ValueError(f"more than {MOST} terms")
    out: Index = {}
    for no, term in enumerate(dict.fromkeys(terms)):
        runs = list(_RUN.finditer(term))
        if runs:
            a, b = runs[0].start(), runs[-1].end()
            out.setdefault(len(runs), defaultdict(list))[term[a:b].translate(_LOWER)].append((no, term[:a], term[b:]))
    return {n: dict(of) for n, of in out.items()}


def _is_letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalpha()


def occurrences(text: str, of: Index) -> list[tuple[int, int]]:
    """First and last + 1 of the terms in a text that stand alone."""
    runs, low, found = [m.span() for m in _RUN.finditer(text)], text.translate(_LOWER), []
    for n, known in of.items():
        for i in range(len(runs) - n + 1):
            a, b = runs[i][0], runs[i + n - 1][1]
            for no, before, behind in known.get(low[a:b], ()):
                start, end = a - len(before), b + len(behind)
                if start >= 0 and text[start:a] == before and text[b:end] == behind and not _is_letter(text, start - 1) and not _is_letter(text, end):
                    found.append((start, no, end))
    out, last = [], 0
    for start, _, end in sorted(found):
        if start >= last:
            out.append((start, end))
            last = end
    return out


def without_terms(texts: DataFrame, terms: list[str], column: str = "text") -> DataFrame:
    """texts with each occurrence of a term in the column as a space; other columns as they are."""
    held = texts.sparkSession.sparkContext.broadcast(index(terms))
    at = texts.columns.index(column)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                spans = occurrences(text, of) if text else []
                edges = [0, *(x for s in spans for x in s), len(text or "")]
                out.append(" ".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return texts.mapInArrow(mapped, texts.schema)
