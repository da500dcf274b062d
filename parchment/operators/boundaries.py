"""Safe ends of chunks by a prefix scan: what a paragraph does to the state of the text is summarised on its own, and summaries combine.

A Stretch tells, for whatever state a stretch of text begins in: which environments it closes that it did not open, which it leaves open,
how far braces fall below their start and where they end, and for each formula that may be open at its start, which one is open at its
end, and what brackets do meanwhile, as they count outside of formulas only. Stretches combine associatively, so paragraphs are
summarised wherever their rows are, blocks of them are combined apart, and a scan over the blocks tells each block its start. As a
chunk ends only where everything is closed, the state of the text there is the state at its beginning, and whether a place is safe
does not hang on where earlier chunks ended. What remains for one task of a file is a fold over lengths and flags.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import boundary_tokens, udf
from ..storage import stored

#: Formulas that may be open, by how they began; none is number 0.
FORMULAS = ("", "(", "[", "$", "$$")
#: Paragraphs and blank lines of a block.
BLOCK = 512
STRETCH = "struct<closers:array<string>,openers:array<string>,clash:boolean,low:int,braces:int,formulas:array<struct<to:int,low:int,brackets:int>>>"


@dataclass(frozen=True)
class Stretch:
    closers: tuple[str, ...] = ()
    openers: tuple[str, ...] = ()
    #: Whether an environment's end met another one's beginning.
    clash: bool = False
    low: int = 0
    braces: int = 0
    #: For each formula at the start: the one at the end, and the least and last depth of brackets.
    formulas: tuple[tuple[int, int, int], ...] = tuple((k, 0, 0) for k in range(len(FORMULAS)))

    def then(self, other: Stretch) -> Stretch:
        openers, closers, clash = list(self.openers), list(self.closers), self.clash or other.clash
        for name in other.closers:
            if not openers:
                closers.append(name)
            elif openers.pop() != name:
                clash = True
        formulas = []
        for to, low, brackets in self.formulas:
            end, below, more = other.formulas[to]
            formulas.append((end, min(low, brackets + below), brackets + more))
        return Stretch(tuple(closers), (*openers, *other.openers), clash, min(self.low, self.braces + other.low), self.braces + other.braces, tuple(formulas))

    @property
    def safe(self) -> bool:
        """Whether a text that is this stretch may end here."""
        return not (self.closers or self.openers or self.clash or self.braces or self.low < 0) and self.formulas[0] == (0, 0, 0)


def _formula(open_: int, mark: str) -> int:
    """The formula that is open behind a mark."""
    if mark in (r"\(", r"\["):
        return FORMULAS.index(mark[1])
    if mark in (r"\)", r"\]"):
        return 0 if FORMULAS[open_] == {")": "(", "]": "["}[mark[1]] else open_
    if open_ == 0:
        return FORMULAS.index(mark)
    return 0 if FORMULAS[open_] == mark else open_


def stretch(text: str) -> Stretch:
    """The summary of a paragraph."""
    closers, openers, clash, low, braces = [], [], False, 0, 0
    formulas = [[k, 0, 0] for k in range(len(FORMULAS))]
    for kind, value in boundary_tokens(text):
        if kind == "begin":
            openers.append(value)
        elif kind == "end":
            if not openers:
                closers.append(value)
            elif openers.pop() != value:
                clash = True
        elif kind == "formula":
            for f in formulas:
                f[0] = _formula(f[0], value)
        elif value in "{}":
            braces += 1 if value == "{" else -1
            low = min(low, braces)
        else:
            for f in formulas:
                if f[0] == 0:
                    f[2] += 1 if value == "[" else -1
                    f[1] = min(f[1], f[2])
    return Stretch(tuple(closers), tuple(openers), clash, low, braces, tuple(map(tuple, formulas)))


def _row(s: Stretch) -> dict:
    return {"closers": list(s.closers), "openers": list(s.openers), "clash": s.clash, "low": s.low, "braces": s.braces, "formulas": [{"to": t, "low": low, "brackets": n} for t, low, n in s.formulas]}


def _of(row) -> Stretch:
    return Stretch(tuple(row["closers"]), tuple(row["openers"]), bool(row["clash"]), int(row["low"]), int(row["braces"]), tuple((int(f["to"]), int(f["low"]), int(f["brackets"])) for f in row["formulas"]))


def _prefixes(rows) -> list[Stretch]:
    """What stands before each of some stretches, and before the end."""
    out = [Stretch()]
    for row in rows:
        out.append(out[-1].then(_of(row)))
    return out


def _packed(lengths, safe, limit: int) -> list[int]:
    """Lengths of chunks of about limit characters, of parts with lengths, behind which a chunk may end where safe says so."""
    if sum(lengths) <= limit:
        return [int(sum(lengths))]
    out, held, before = [], 0, True
    for n, may in zip(lengths, safe, strict=True):
        if held and held + n > limit and before:
            out.append(held)
            held = 0
        fresh = not held
        held += int(n)
        if not fresh and held >= limit and may:
            out.append(held)
            held = 0
        before = may
    return out + [held] * bool(held)


parts_udf = udf(lambda text: regex.split(r"(\n\s*\n)", text), "array<string>")
# a struct goes to and from a function as an array of one
stretch_udf = udf(lambda part: [_row(stretch(part))], f"array<{STRETCH}>")
total_udf = udf(lambda rows: [_row(_prefixes(rows)[-1])], f"array<{STRETCH}>")
starts_udf = udf(lambda rows: [_row(s) for s in _prefixes(rows)[:-1]], f"array<{STRETCH}>")
safe_udf = udf(lambda start, rows: [_of(start[0]).then(s).safe for s in _prefixes(rows)[1:]], "array<boolean>")
packed_udf = udf(_packed, "array<int>")


def safe_chunks(files: DataFrame, keys: list[str], limit: int, text: str = "text", block: int = BLOCK) -> DataFrame:
    """files: keys (no two rows alike), text. keys, idx, offset and length of the chunks of each text, about limit characters that end only at safe places."""
    listed = lambda *of: F.array_sort(F.collect_list(F.struct(*of)))
    parts = files.select(*keys, F.posexplode(parts_udf(F.col(text))).alias("_no", "_part"))
    told = stored(parts.select(*keys, "_no", F.floor(F.col("_no") / block).alias("_block"), F.length("_part").alias("_n"), F.get(stretch_udf(F.col("_part")), F.lit(0)).alias("_s")), "stretches")
    blocks = told.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("_no", "_n", "_s"))).alias("_rows"))
    rows = F.transform("_rows", lambda r: r["_s"])
    blocks = stored(blocks.withColumn("_total", F.get(total_udf(rows), F.lit(0))), "blocks")
    whole = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "_total"))).alias("_b"))
    starts = whole.select(*keys, F.explode(F.arrays_zip(F.transform("_b", lambda b: b["_block"]).alias("_block"), starts_udf(F.transform("_b", lambda b: b["_total"])).alias("_start"))).alias("_at")).select(*keys, "_at._block", "_at._start")
    safe = blocks.join(starts, [*keys, "_block"]).select(*keys, "_block", F.transform("_rows", lambda r: r["_n"]).alias("_n"), safe_udf(F.array("_start"), rows).alias("_safe"))
    flags = safe.groupBy(*keys).agg(listed("_block", "_n", "_safe").alias("_f"))
    ends = flags.select(*keys, packed_udf(F.flatten(F.transform("_f", lambda f: f["_n"])), F.flatten(F.transform("_f", lambda f: f["_safe"])), F.lit(limit)).alias("_sizes"))
    before = lambda i: F.aggregate(F.slice("_sizes", 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
    cut = F.transform("_sizes", lambda n, i: F.struct(i.alias("idx"), before(i).alias("offset"), n.cast("long").alias("length")))
    return ends.select(*keys, F.explode(cut).alias("_c")).select(*keys, "_c.*")
