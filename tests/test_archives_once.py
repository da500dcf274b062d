"""An archive of small members is inflated once to be told whole and once for its kind's head; a large one is read again."""

import io

from parchment import source_queries as q
from parchment.sources import archives as a


def _counted(data):
    seen = []

    class Stream(io.BytesIO):
        def read(self, *n):
            out = super().read(*n)
            seen.append(len(out))
            return out

    return seen, lambda: Stream(data)


def test_small_archives_are_read_once(monkeypatch):
    # bytes that do not compress, so that whole readings tell in the number of bytes read
    import random

    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=300_000))
    for kind in range(6):
        data = q.archive(kind, 0, text)
        seen, opened = _counted(data)
        found = list(a.members(opened, a.TEX))
        assert [(p.lower().rpartition("/")[2], c.decode(), s) for p, c, s in found] == [("main.tex", f"{q._TEX}\n{text}", "ok")]
        once = sum(seen)
        monkeypatch.setattr(a, "SMALL", 1000)
        seen, opened = _counted(data)
        assert list(a.members(opened, a.TEX)) == found
        monkeypatch.undo()
        assert kind == 4 or once < 0.75 * sum(seen)


def test_bounds_hold():
    data = q.archive(1, 0, "x" * 5000)
    assert [(c, s) for _, c, s in a.members(lambda: io.BytesIO(data), a.TEX, largest=100)] == [(None, "large")]
    assert list(a.members(lambda: io.BytesIO(q.archive(2, 2, "x" * 5000)), a.TEX)) == [(None, None, "damaged")]
