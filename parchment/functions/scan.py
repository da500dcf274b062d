r"""Scanners for what built-in expressions cannot match: nested groups and state carried from line to line.

Nested groups are recursive patterns of the regex library; each function here takes and gives one text and is small.
udf() makes an Arrow function of it, which Spark feeds batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pandas as pd
import regex
from pyspark.sql import functions as F

from ..constants import BOXES, GLOSSARY, LISTED_DEFINERS, MATH_ENVIRONMENTS, OUTLINE, PLACEHOLDER, TITLES, VERBATIM

#: A group with its nested ones, to be used by name in a pattern that ends with GROUPS; and an escaped character, which ends nothing.
GROUPS = r"(?(DEFINE)(?P<brace>\{(?:[^{}\\]++|\\.|(?&brace))*+\})(?P<bracket>\[(?:[^\[\]\\]++|\\.|(?&bracket))*+\]))"
_FLAGS = regex.DOTALL | regex.VERSION1


def pattern(text: str) -> regex.Pattern:
    """text may call (?&brace) and (?&bracket)."""
    return regex.compile(text + GROUPS, _FLAGS)


def udf(function: Callable, returns: str):
    """A column function from one of plain values; null where its first value is null."""

    def batch(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(x, *more) for x, *more in zip(first, *rest, strict=True)], dtype=object)

    # made at its first use: parsing the type needs a session
    made = cache(lambda: F.pandas_udf(batch, returns))
    return lambda *columns: made()(*columns)


def lines(text: str) -> list[str]:
    r"""Lines with their ends; only \n ends a line."""
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + [parts[-1]] * bool(parts[-1])


_CODE = regex.compile(r"\\(begin|end)\{(" + "|".join(map(regex.escape, VERBATIM)) + r")\}")
_COMMENT = regex.compile(r"[ \t\r\f\v]*+(?<!\\)(?:\\\\)*+%.*", _FLAGS)
_SEEK_COMMENT = regex.compile(r"(?<!\\)((?:\\\\)*+)%")
_OPTIONS = regex.compile(r"\\[A-Za-z@]+\*?(?:\{[^{}\r\n]*\})?\s*\[")
_BRACKETS = regex.compile(r"\\.|([\[\]])", _FLAGS)


def outside_code(text: str, change: Callable[[str], str | None]) -> str:
    """change on every line outside code environments; None drops the line."""
    out, open_names = [], []
    for line in lines(text):
        new = line if open_names else change(line)
        if new is None:
            continue
        out.append(new)
        for kind, name in _CODE.findall(new):
            if kind == "begin":
                open_names.append(name)
            elif open_names and open_names[-1] == name:
                open_names.pop()
    return "".join(out)


def strip_comments(text: str) -> str:
    """Comments go, code environments stay; inside a list of options over several lines, lines left empty go too."""
    depth = 0

    def change(line: str) -> str | None:
        nonlocal depth
        found = _SEEK_COMMENT.search(line)
        if found:
            end = "\r\n" if line.endswith("\r\n") else "\n" if line.endswith("\n") else ""
            line = line[: found.end() - 1].rstrip() + end
        if depth and not line.strip():
            return None
        if depth or _OPTIONS.search(line):
            for b in _BRACKETS.findall(line):
                depth = depth + 1 if b == "[" else max(0, depth - 1) if b == "]" else depth
        return line

    return outside_code(text, change)


_ACCENT = regex.compile(r"(?<!\\)\\(?:[\"'`^~=.]\s*(?:\{([A-Za-z])\}|([A-Za-z]))|[bcdHkrtuv](?:\s*\{([A-Za-z])\}|\s+([A-Za-z])))")


def drop_accents(text: str) -> str:
    return outside_code(text, lambda line: _ACCENT.sub(lambda m: "".join(x or "" for x in m.groups()), line))


def _arity(n: int) -> str:
    return r"(?:\s*(?&bracket))*\s*(?&brace)" * n


_KEPT = pattern(
    "|".join(
        [
            *(rf"\\begin\{{{regex.escape(v)}\}}.*?\\end\{{{regex.escape(v)}\}}" for v in VERBATIM),
            *(rf"\\{name}(?![A-Za-z])\*?{_arity(n)}" for name, n in BOXES.items()),
            *(rf"\\{name}(?![A-Za-z])\*?{_arity(1)}" for name in GLOSSARY),
        ]
    )
)
_PLACE = regex.compile(regex.escape(PLACEHOLDER) + r"\s*\{\s*(\d+)\s*\}")


def kept_spans(text: str) -> list[tuple[int, int]]:
    """Stretches that must not change: code environments, boxes, glossary keys. Touching ones are one."""
    out: list[tuple[int, int]] = []
    for m in _KEPT.finditer(text):
        if out and m.start() <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], m.end()))
        else:
            out.append(m.span())
    return out


def protect(text: str) -> dict:
    """text with a numbered placeholder for each kept stretch, and the stretches."""
    spans = kept_spans(text)
    edges = [0, *(x for s in spans for x in s), len(text)]
    out = "".join(text[a:b] + f"{PLACEHOLDER}{{{k}}}" for k, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True)) if k < len(spans))
    return {"text": out + text[edges[-2] :], "blocks": [text[a:b] for a, b in spans]}


def restore(text: str, blocks) -> str:
    """A placeholder of no known number stays."""
    blocks = [] if blocks is None else list(blocks)
    return _PLACE.sub(lambda m: blocks[int(m[1])] if int(m[1]) < len(blocks) else m[0], text)


def placeholder_numbers(text: str) -> list[int]:
    return sorted(int(x) for x in _PLACE.findall(text))


#: What changes the state of a boundary check, in order of priority.
_TOKEN = regex.compile(
    r"(?P<comment>(?<!\\)%[^\n]*)|\\(?P<env>begin|end)\{(?P<name>[^}]+)\}|(?P<line>\\\\(?:\[[^\[\]]*\])?)|\\(?P<math>[()\[\]])|\\.|(?P<dollar>\$\$?)|(?P<group>[{}\[\]])",
    _FLAGS,
)


def boundary_tokens(text: str):
    r"""What changes the state of a boundary check: (`begin` or `end`, name), (`formula`, \\( \\) \\[ \\] $ or $$) and (`group`, a brace or bracket)."""
    for m in _TOKEN.finditer(text):
        if m["env"]:
            if m["name"] != "document":
                yield m["env"], m["name"]
        elif m["math"]:
            yield "formula", "\\" + m["math"]
        elif m["dollar"]:
            yield "formula", m["dollar"]
        elif m["group"]:
            yield "group", m["group"]


class Boundary:
    """Whether the text fed so far may end a chunk: all groups, environments and formulas are closed."""

    def __init__(self):
        self.braces = self.brackets = 0
        self.environments: list[str] = []
        self.formula: str | None = None
        self.broken = False

    def feed(self, text: str) -> Boundary:
        for m in _TOKEN.finditer(text):
            if m["env"]:
                if m["name"] == "document":
                    continue
                if m["env"] == "begin":
                    self.environments.append(m["name"])
                elif not self.environments or self.environments.pop() != m["name"]:
                    self.broken = True
            elif m["math"]:
                if m["math"] in "([":
                    self.formula = m["math"]
                elif self.formula and self.formula + m["math"] in ("()", "[]"):
                    self.formula = None
            elif m["dollar"]:
                if self.formula is None:
                    self.formula = m["dollar"]
                elif self.formula == m["dollar"]:
                    self.formula = None
            elif m["group"] in ("{", "}"):
                self.braces += 1 if m["group"] == "{" else -1
            elif m["group"] and self.formula is None:
                self.brackets += 1 if m["group"] == "[" else -1
            self.broken |= self.braces < 0 or self.brackets < 0
        return self

    @property
    def safe(self) -> bool:
        return not (self.broken or self.braces or self.brackets or self.environments or self.formula)


def is_boundary(text: str) -> bool:
    return Boundary().feed(text).safe


def chunks(text: str, limit: int) -> list[str]:
    """Paragraphs packed into chunks of about limit characters that end only at safe boundaries; joined they are text."""
    if len(text) <= limit:
        return [text]
    out, held, state = [], "", Boundary()
    for part in regex.split(r"(\n\s*\n)", text):
        if held and len(held) + len(part) > limit and state.safe:
            out.append(held)
            held, state = "", Boundary()
        fresh = not held
        held += part
        state.feed(part)
        if not fresh and len(held) >= limit and state.safe:
            out.append(held)
            held, state = "", Boundary()
    return out + [held] * bool(held)


_MATH = regex.compile(r"\\\(.*?\\\)|\\\[.*?\\\]|(?<!\\)(?:\\\\)*+\K(?:\$\$.*?(?<!\\)(?:\\\\)*+\$\$|\$(?!\$).*?(?<![\\$])(?:\\\\)*+\$(?!\$))", _FLAGS)
_MATH_ENV = regex.compile(r"\\begin\{((?:" + "|".join(MATH_ENVIRONMENTS) + r")\*?)\}.*?\\end\{\1\}", _FLAGS)


def math_contexts(text: str) -> list[str]:
    return [m[0] for m in _MATH.finditer(text)] + [m[0] for m in _MATH_ENV.finditer(text, overlapped=True)]


def math_commands(text: str) -> list[str]:
    """Names of the commands in formulas, each once, in order."""
    return list(dict.fromkeys(name for c in math_contexts(text) for name in regex.findall(r"\\([A-Za-z@]+)", c)))


_DEFINITION = pattern(
    r"\\(?:"
    r"(?P<let>let)(?![A-Za-z@])\s*\\(?P<a>[A-Za-z@]+)[^\n]*"
    r"|(?:def|gdef|edef|xdef)(?![A-Za-z@])\s*\\(?P<b>[A-Za-z@]+)[^{]*(?&brace)"
    r"|(?:" + "|".join(x for x in LISTED_DEFINERS if x not in ("def", "gdef", "edef", "xdef", "let")) + r")\*?(?![A-Za-z@])"
    r"\s*(?:\{\s*\\(?P<c>[A-Za-z@]+)\s*\}|\\(?P<d>[A-Za-z@]+))(?:\s*(?&bracket))*\s*(?&brace))"
)


def macro_definitions(text: str) -> list[dict]:
    """Macros that text defines, inner ones too, but those with @ in their names."""
    found = ((m["a"] or m["b"] or m["c"] or m["d"], m[0].strip()) for m in _DEFINITION.finditer(text, overlapped=True))
    return [{"name": n, "definition": " ".join(d.split())} for n, d in found if "@" not in n]


_SECTION = pattern(r"\\(?P<level>" + "|".join(sorted(OUTLINE, key=len, reverse=True)) + r")\*?\s*(?P<arg>(?&brace))")
_TITLE = pattern(r"\\(?:" + "|".join(TITLES) + r")(?:\[[^\]]*\])?\s*(?P<arg>(?&brace))")


def outline(text: str) -> list[dict]:
    found = ((m["level"], " ".join(m["arg"][1:-1].split())) for m in _SECTION.finditer(text))
    return [{"level": level, "heading": heading} for level, heading in found if heading]


def first_title(text: str) -> str | None:
    m = _TITLE.search(text)
    return " ".join(m["arg"][1:-1].split()) if m else None


def top_level_split(text: str) -> list[str]:
    """Parts between the commas that stand outside all groups."""
    parts, depth = [""], 0
    for m in regex.finditer(r"\\.|[^\\]|\\$", text, flags=_FLAGS):
        depth += (m[0] in tuple("{[(")) - (m[0] in tuple("}])") and depth > 0)
        if m[0] == "," and not depth:
            parts.append("")
        else:
            parts[-1] += m[0]
    return parts


strip_comments_udf = udf(strip_comments, "string")
drop_accents_udf = udf(drop_accents, "string")
#: Both steps in one pass over the text.
clean_udf = udf(lambda t: drop_accents(strip_comments(t)), "string")
restore_udf = udf(restore, "string")
placeholder_numbers_udf = udf(placeholder_numbers, "array<int>")
is_boundary_udf = udf(is_boundary, "boolean")
chunks_udf = udf(chunks, "array<string>")
math_commands_udf = udf(math_commands, "array<string>")
macro_definitions_udf = udf(macro_definitions, "array<struct<name:string,definition:string>>")
outline_udf = udf(outline, "array<struct<level:string,heading:string>>")
first_title_udf = udf(first_title, "string")
kept_spans_udf = udf(lambda t: [{"start": a, "end": b} for a, b in kept_spans(t)], "array<struct<start:int,end:int>>")


def _protected(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([protect(t or "") for t in texts], columns=["text", "blocks"])


def protect_udf(text):
    """A struct of text and blocks."""
    return F.pandas_udf(_protected, "struct<text:string,blocks:array<string>>")(text)
