"""Range asymmetric numeral system with a static table: blocks of interleaved lanes, with checkpoints.

A block's symbols are dealt to lanes in turn: symbol i belongs to lane i mod lanes. Each lane has a 64-bit state; all
lanes share one stream of 32-bit words, in the order in which a decoder needs them. A checkpoint holds the states and the
place in the stream before a given step, so that decoding can begin there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of the frequencies' sum; lower bound of a state; bits of a stream word.
PRECISION, LOW, WORD = 20, 1 << 31, 32
#: Lanes of a block of at least so many symbols; steps between checkpoints.
LANES, EVERY = 2048, 64
_MASK = (1 << PRECISION) - 1


def normalized(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**PRECISION, at least 1 where counts is not 0; the largest take up what rounding leaves."""
    total = 1 << PRECISION
    if not counts.sum():
        out = np.zeros(len(counts), np.int64)
        out[:1] = total
        return out
    out = np.where(counts > 0, np.maximum(1, np.floor(counts * (total / counts.sum())).astype(np.int64)), 0)
    over = int(out.sum()) - total
    order = np.argsort(-out, kind="stable")
    if over < 0:
        out[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        take = min(over, int(out[i]) - 1)
        out[i] -= take
        over -= take
    return out


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.int64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """Of each of the 2**PRECISION numbers, in one integer: its symbol, that symbol's frequency less one, and the number's place among those of the symbol."""
        if self._slots is None:
            symbol = np.repeat(np.arange(len(self.freq)), self.freq)
            self._slots = symbol << 2 * PRECISION | (self.freq[symbol] - 1) << PRECISION | (np.arange(len(symbol)) - self.start[symbol])
        return self._slots


@dataclass
class Coded:
    """n symbols: final states of the lanes (from which decoding starts), stream words, and checkpoints (step, word, states)."""

    n: int
    states: np.ndarray
    words: np.ndarray
    checkpoints: list[tuple[int, int, np.ndarray]]


def encode(symbols: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> Coded:
    n = len(symbols)
    lanes = max(1, min(lanes, n))
    state, steps = np.full(lanes, LOW, np.int64), -(-n // lanes)
    f, c = table.freq.take(symbols), table.start.take(symbols)
    most = f << (63 - PRECISION)  # above it a state has a word to give; at most 2**63, so it is compared less one
    parts, sizes, marks = [], [], []
    for k in reversed(range(steps)):
        a, b = k * lanes, min(n, (k + 1) * lanes)
        x, freq = state[: b - a], f[a:b]
        full = x > most[a:b] - 1
        parts.append((x[full] & 0xFFFFFFFF).astype(np.uint32))
        sizes.append(len(parts[-1]))
        x = np.where(full, x >> WORD, x)
        q = x // freq
        state[: b - a] = (q << PRECISION) + (x - q * freq) + c[a:b]
        if k and k % every == 0:
            marks.append((k, sum(sizes), state.copy()))
    total = sum(sizes)
    words = np.concatenate(parts[::-1]) if parts else np.zeros(0, np.uint32)
    return Coded(n, state, words, [(k, total - done, s) for k, done, s in reversed(marks)])


def decode(coded: Coded, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The symbols of steps [start, stop); start is 0 or the step of a checkpoint."""
    lanes, n = len(coded.states), coded.n
    at, state = 0, coded.states.copy()
    if start:
        at, state = next((w, s.copy()) for k, w, s in coded.checkpoints if k == start)
    steps = -(-n // lanes)
    out = np.empty((min(steps, steps if stop is None else stop) - start) * lanes, np.uint32)
    slots = table.slots
    words = coded.words.astype(np.int64)
    for k in range(start, min(steps, steps if stop is None else stop)):
        size = min(n, (k + 1) * lanes) - k * lanes
        x = state[:size]
        slot = slots.take(x & _MASK)
        out[(k - start) * lanes : (k - start) * lanes + size] = slot >> 2 * PRECISION
        x = (x >> PRECISION) * ((slot >> PRECISION & _MASK) + 1) + (slot & _MASK)
        need = np.flatnonzero(x < LOW)
        x[need] = x[need] << WORD | words[at : at + len(need)]
        at += len(need)
        state[:size] = x
    return out[: min(n, start * lanes + len(out)) - start * lanes]
