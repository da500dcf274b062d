"""Compilation of papers by an external TeX engine, a paper per group. Not part of any other plan: it needs the engine on every machine."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame

COMPILED = "paper_id string, status string, log string, pdf binary"
#: One pass of the tool that knows how often to run, or else three of the engine.
TOOL = ("latexmk", "-g", "-xelatex", "-interaction=nonstopmode", "-halt-on-error")
ENGINE = ("xelatex", "-interaction=nonstopmode", "-halt-on-error")


def _run(command: tuple[str, ...], name: str, folder: Path, seconds: float) -> tuple[bool, str]:
    try:
        done = subprocess.run([*command, name], cwd=folder, capture_output=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired) as e:
        return False, f"$ {' '.join(command)}\n{e}\n"
    return done.returncode == 0, f"$ {' '.join(command)}\n{done.stdout.decode(errors='replace')}{done.stderr.decode(errors='replace')}exit code {done.returncode}\n"


def compile_paper(files: dict[str, bytes], main: str, tool=TOOL, engine=ENGINE, seconds: float = 600) -> tuple[str, str, bytes | None]:
    """status (ok, failed or `no engine`), log, and the PDF."""
    if not (shutil.which(tool[0]) or shutil.which(engine[0])):
        return "no engine", "", None
    with tempfile.TemporaryDirectory() as at:
        for path, content in files.items():
            target = Path(at, *PurePosixPath(path).parts)
            if ".." in target.parts or PurePosixPath(path).is_absolute():
                return "failed", f"unsafe path {path}", None
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(content)
        source = Path(at, main)
        pdf, log, done = source.with_suffix(".pdf"), "", False
        if shutil.which(tool[0]):
            done, log = _run(tool, source.name, source.parent, seconds)
        if not (done and pdf.exists()) and shutil.which(engine[0]):
            for _ in range(3):
                done, more = _run(engine, source.name, source.parent, seconds)
                log += more
        return ("ok", log, pdf.read_bytes()) if done and pdf.exists() else ("failed", log, None)


def compile_papers(files: DataFrame, mains: DataFrame, tool=TOOL, engine=ENGINE, seconds: float = 600) -> DataFrame:
    """files: paper_id, path, content. mains: paper_id, path. Returns COMPILED; a failed paper has a row like the others. A paper's files meet in one task, as the engine needs them all."""

    def compiled(key, table):
        rows = table.to_pylist()
        found = {r["path"]: r["content"] or b"" for r in rows}
        row = (key[0].as_py(), *compile_paper(found, rows[0]["main"], tool, engine, seconds))
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["paper_id", "status", "log", "pdf"])

    told = files.select("paper_id", "path", "content").join(mains.selectExpr("paper_id", "path as main"), "paper_id")
    return told.groupBy("paper_id").applyInArrow(compiled, COMPILED)
