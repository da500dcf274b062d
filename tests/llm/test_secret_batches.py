"""A worker holds the findings of few texts at a time, and finds the same."""

import pyarrow as pa

from parchment.llm import secrets


def test_scanned_in_slices():
    texts = [f"token = abcdefgh{k:012d}" if k % 3 else None for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(1000)]), pa.array(texts, pa.string())], names=["blob", "text"])
    out = list(secrets._scan(secrets.RULES)(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= 256
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["blob"] for r in rows] == [str(k) for k in range(1000)]
    assert [[(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in rows] == [secrets.find_secrets(t or "") for t in texts]
