"""Responses of a web address for each row, for landing: one request per row, errors as statuses."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import page_url, pdf_url, source_url

RESPONSES = "status int, content_type string, content binary, error string"
AGENT = {"User-Agent": "parchment"}


def get(url: str, timeout: float, use_proxy: bool = True) -> tuple[int | None, str | None, bytes | None, str | None]:
    """status, content type, body and error."""
    opener = urllib.request.build_opener(*([] if use_proxy else [urllib.request.ProxyHandler({})]))
    try:
        with opener.open(urllib.request.Request(url, headers=AGENT), timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type"), r.read(), None
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type") if e.headers else None, None, str(e)
    except (OSError, ValueError) as e:
        return None, None, None, str(e)


def metadata_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://export.arxiv.org/api/query?max_results=1&id_list="), F.url_encode(identifier))


def bibtex_url(identifier: Column) -> Column:
    return F.replace(page_url(identifier), F.lit("/abs/"), F.lit("/bibtex/"))


#: Kind of a response: its address, and the seconds to wait for it.
KINDS = {"pdf": (pdf_url, 60), "source": (source_url, 60), "metadata": (metadata_url, 30), "bibtex": (bibtex_url, 30)}


def fetch(papers: DataFrame, kind: str, parallel: int = 4, getter: Callable = get, use_proxy: bool = True) -> DataFrame:
    """papers: paper_id. Adds RESPONSES; write them down before they are used, since a lost executor asks again. parallel: requests at a time, at most."""
    url, timeout = KINDS[kind]

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paper, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # a row at a time: a body may be large
                row = (paper, *(getter(at, timeout, use_proxy) if at else (None, None, None, "no identifier")))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()), strict=True)], names=["paper_id", "status", "content_type", "content", "error"])

    return papers.select("paper_id", url(F.col("paper_id")).alias("url")).distinct().coalesce(parallel).mapInArrow(fetched, f"paper_id string, {RESPONSES}")
