"""Source archives as rows of their members, without a local folder.

An archive is a tar, plain or compressed by gzip, bzip2 or xz, a zip, a compressed text, or a plain text. It is read as a stream, twice:
first to its end, to see that it is whole (every header's checksum, every member's length, the tar's end mark, the checksum behind
the compressed data or of the zip's member) and that no member would land outside of its folder; then for the members that are wanted,
unless these are small enough to be kept from the first reading. A task so holds one large member at a time, or some MB of small ones, however large the archive is. A member of more than LARGEST bytes has no content, and `large`
for status; the others of its archive are given.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files

MEMBERS = "paper_id string, path string, content binary, status string"
MAIN = "main.tex"
TEX = (".tex", ".ltx")
#: Bytes of a member that is held as a value, at most.
LARGEST = 1 << 28
#: Bytes of wanted members, all of an archive's, that are kept from its first reading, so that there is no second one.
SMALL = 1 << 22
#: What a compressed stream begins with.
COMPRESSED = ((b"\x1f\x8b", lambda stream: gzip.GzipFile(fileobj=stream, mode="rb")), (b"BZh", bz2.BZ2File), (b"\xfd7zXZ\x00", lzma.LZMAFile))
_STEP = 1 << 20


class Unsafe(ValueError):
    """A member would land outside its archive's folder."""


class Damaged(ValueError):
    """An archive ends too early, or is not what its checksums say."""


#: What the readers of the standard library raise where data is not whole.
BROKEN = (Damaged, OSError, EOFError, zlib.error, lzma.LZMAError, zipfile.BadZipFile, tarfile.TarError, RuntimeError, NotImplementedError)


def _name(name: str) -> str:
    path = posixpath.normpath(name)
    if name.startswith("/") or path == ".." or path.startswith("../"):
        raise Unsafe(name)
    return path


class _Header(tarfile.TarInfo):
    """A member's header. The library takes a header that it can't read for the archive's end; only a block of zeros is."""

    @classmethod
    def fromtarfile(cls, archive: tarfile.TarFile) -> tarfile.TarInfo:
        try:
            return super().fromtarfile(archive)
        except tarfile.EOFHeaderError:
            archive.has_end = True
            raise
        except tarfile.HeaderError as e:
            if archive.offset:
                raise Damaged(str(e)) from e
            raise


#: A member's path, its size, and a stream of its bytes.
Member = tuple[str, int, BinaryIO]


def _tar(stream: BinaryIO) -> Iterator[Member]:
    with tarfile.open(fileobj=stream, mode="r|", tarinfo=_Header) as archive:
        for member in archive:
            if member.isfile():
                yield _name(member.name), member.size, archive.extractfile(member)
            elif member.isdir():
                _name(member.name)
        if not getattr(archive, "has_end", False):
            raise Damaged("no end mark")
    while stream.read(_STEP):  # up to the checksum behind it
        pass


def _zip(stream: BinaryIO) -> Iterator[Member]:
    with zipfile.ZipFile(stream) as archive:
        for member in archive.infolist():
            path = _name(member.filename)
            if not member.is_dir():
                with archive.open(member) as content:
                    yield path, member.file_size, content


def _text(stream: BinaryIO) -> Iterator[Member]:
    """A single text as a member; nothing if it is no TeX. A tar's or zip's head is not taken for a text."""
    head = stream.read(4096)
    if head[257:262] == b"ustar" or head.startswith(b"PK\x03\x04"):
        raise Damaged("not an archive any more")
    if any(x in head for x in (rb"\documentclass", rb"\begin{document}", rb"\input")):
        rest = io.BufferedReader(_Joined(head, stream))
        yield MAIN, -1, rest
    while stream.read(_STEP):
        pass


class _Joined(io.RawIOBase):
    """Some bytes, and what follows them in a stream."""

    def __init__(self, head: bytes, stream: BinaryIO):
        self.head, self.stream = head, stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.head[: len(into)] or self.stream.read(len(into))
        self.head = self.head[len(data) :]
        into[: len(data)] = data
        return len(data)


def _is_tar(stream: BinaryIO) -> bool:
    try:
        tarfile.TarInfo.frombuf(stream.read(tarfile.BLOCKSIZE), "utf-8", "surrogateescape")
        return True
    except tarfile.EOFHeaderError:
        return True  # an empty one
    except tarfile.HeaderError:
        return False


def _inflated(opened: Callable[[], BinaryIO]) -> Callable[[], BinaryIO] | None:
    """A stream of what a compressed one holds, None for another one."""
    with opened() as stream:
        start = stream.read(8)
    kind = next((kind for magic, kind in COMPRESSED if start.startswith(magic)), None)
    return (lambda: kind(opened())) if kind else None


def walk(opened: Callable[[], BinaryIO]) -> Iterator[Member]:
    """The members of the archive that opened gives a new stream of at each call. A member's stream ends with the next step."""
    once = _inflated(opened)
    if once:
        with once() as stream:  # its head tells both that it was compressed again on its way, and what it is
            head = stream.read(tarfile.BLOCKSIZE)
        twice = _inflated(lambda: io.BytesIO(head)) and _inflated(once)
        streams = [(once, lambda: io.BytesIO(head)), (twice, twice)]
    else:
        streams = [(opened, opened)]
    for stream, first in streams:
        if stream:
            with first() as at:
                tar = _is_tar(at)
            if tar:
                with stream() as whole:
                    yield from _tar(whole)
                return
    with (once or opened)() as whole:
        if not once and zipfile.is_zipfile(whole):
            yield from _zip(whole)
            return
    with (once or opened)() as whole:
        yield from _text(whole)


def _checked(opened: Callable[[], BinaryIO], kept: list | None = None, wanted: Callable[[str], bool] = lambda path: True, most: int = 0) -> tuple[str, bool]:
    """What status() tells. kept: gets path and content of the wanted members as they are read; whether it has them all, in most bytes."""
    try:
        with opened() as raw:
            if raw.read(4) == b"%PDF":
                return "pdf", False
        has_tex, left = False, most if kept is not None else -1
        for path, size, content in walk(opened):
            n, parts = 0, []
            while step := content.read(_STEP):
                n += len(step)
                if left >= 0 and wanted(path):
                    left -= len(step)
                    parts.append(step)
                    if left < 0:  # too much to hold: the second reading gives it
                        parts.clear()
                        kept.clear()
            if size >= 0 and n != size:
                raise Damaged(path)
            has_tex |= path.lower().endswith(TEX)
            if left >= 0 and wanted(path):
                kept.append((path, b"".join(parts)))
        return "ok" if has_tex else "no tex", left >= 0
    except Unsafe:
        return "unsafe", False
    except BROKEN:
        return "damaged", False


def status(opened: Callable[[], BinaryIO]) -> str:
    """`ok` for an archive that is whole and has a TeX file; else why it is of no use: pdf, unsafe, damaged or no tex."""
    return _checked(opened)[0]


def members(opened: Callable[[], BinaryIO], suffixes: tuple[str, ...] = (), largest: int = LARGEST) -> Iterator[tuple[str | None, bytes | None, str]]:
    """path, content and status of the members that end in one of suffixes (without regard to case; none: all); one without path where the archive is of no use."""
    wanted = lambda path: not suffixes or path.lower().endswith(suffixes)
    kept: list[tuple[str, bytes]] = []
    told, whole = _checked(opened, kept, wanted, min(largest, SMALL))
    if told != "ok":
        yield None, None, told
        return
    if whole:
        yield from ((path, content, "ok") for path, content in kept)
        return
    for path, _, content in walk(opened):
        if wanted(path):
            parts, left = [], largest + 1
            while left > 0 and (part := content.read(min(left, _STEP))):
                parts.append(part)
                left -= len(part)
            yield (path, b"".join(parts), "ok") if left > 0 else (path, None, "large")


def _rows(source: Callable[[object], Callable[[], BinaryIO]], suffixes: tuple[str, ...], largest: int):
    kinds = (pa.string(), pa.string(), pa.binary(), pa.string())

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paper, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for row in members(source(value.as_py()), suffixes, largest):
                    rows.append((paper, *row))
                    size += len(row[1] or b"")
                    if size >= _STEP:  # a batch is a large member, or some small ones
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["paper_id", "path", "content", "status"])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["paper_id", "path", "content", "status"])

    return expanded


def _value(content: bytes | None) -> Callable[[], BinaryIO]:
    return lambda: io.BytesIO(content or b"")


def _file(address: str) -> Callable[[], BinaryIO]:
    def opened() -> BinaryIO:
        system, path = files.at(address)
        return io.BufferedReader(system.open_input_file(path), _STEP)

    return opened


def expand(archives: DataFrame, suffixes: tuple[str, ...] = (), largest: int = LARGEST) -> DataFrame:
    """archives: paper_id, content. A row per member with its status; one with a null path and the reason for an archive that is of no use."""
    return archives.select("paper_id", "content").mapInArrow(_rows(_value, suffixes, largest), MEMBERS)


def expand_files(archives: DataFrame, suffixes: tuple[str, ...] = (), largest: int = LARGEST) -> DataFrame:
    """archives: paper_id, address. As expand, of archives that tasks read where they lie; a file that is not there is damaged.

    Rows should be dealt out by bytes, not by number, where archives differ much: see spread.
    """
    return archives.select("paper_id", "address").mapInArrow(_rows(_file, suffixes, largest), MEMBERS)


def spread(listed: DataFrame, bytes_per_task: int = 1 << 30) -> DataFrame:
    """listed: length and any other columns. Dealt out to tasks of about as many bytes, large files among small ones at random."""
    total = listed.agg(F.sum("length")).first()[0] or 0
    return listed.repartition(max(1, -(-total // bytes_per_task)), F.xxhash64(*[c for c in listed.columns if c != "length"]))


def looks_gzip(content: Column) -> Column:
    return F.substring(content, 1, 2) == F.lit(b"\x1f\x8b")


def looks_like_tex(content: Column) -> Column:
    return F.rlike(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), F.lit(r"\\documentclass|\\begin\{document\}|\\input"))


def source_status(status: Column, content_type: Column, content: Column) -> Column:
    """Of a landed source response: ok, unavailable, failed, empty, pdf or html."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    return (
        F.when(status.isin(403, 404, 410), "unavailable").when((status < 200) | (status >= 300) | status.isNull(), "failed")
        .when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty").when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf")
        .when(F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html")) & F.contains(head, F.lit("<html")), "html").otherwise("ok")
    )


def pdf_status(status: Column, content_type: Column, content: Column) -> Column:
    """Of a landed PDF response: ok, unavailable, empty or other."""
    is_pdf = (F.substring(content, 1, 4) == F.lit(b"%PDF")) | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))
    return (
        F.when((status < 200) | (status >= 300) | status.isNull(), "unavailable")
        .when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty").when(is_pdf, "ok").otherwise("other")
    )
