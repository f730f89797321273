"""Static range asymmetric numeral system over interleaved lanes, in numpy.

States are 64 bits wide, in [2**31, 2**63); words are 32 bits. Token i of a
block belongs to lane i % lanes. A checkpoint holds the lanes' states and the
word offset at a step, so that decoding can start there.
"""

from __future__ import annotations

import numpy as np

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
LANES = 2048
#: Steps between checkpoints; times LANES, the tokens between them.
EVERY = 64


def quantized(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies that add up to 2**bits, at least 1 where counts is not 0; and bits."""
    used = np.flatnonzero(counts)
    bits = min(24, max(16, int(len(used)).bit_length() + 4))
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq, bits
    share = counts[used].astype(np.float64) * (1 << bits) / counts.sum()
    f = np.maximum(1, np.floor(share).astype(np.int64))
    order = np.argsort(-f, kind="stable")
    short = (1 << bits) - int(f.sum())
    if short >= 0:
        f[order[0]] += short
    for i in order:
        if short >= 0:
            break
        take = min(int(f[i]) // 2, -short)
        f[i] -= take
        short += take
    freq[used] = f
    return freq, bits


class Coder:
    """Encodes and decodes blocks with one shared frequency table."""

    def __init__(self, freq: np.ndarray, bits: int, lanes: int = LANES, every: int = EVERY):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.bits, self.lanes, self.every = np.uint64(bits), lanes, every
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """The words, and checkpoints (step, word offset, states); the first is step 0."""
        f_all, c_all = self.freq[ids], self.cum[ids]
        top = ((LOW >> self.bits) << WORD) * f_all
        x, words, sent, marks = np.full(self.lanes, LOW, np.uint64), [], 0, []
        for step in range(-(-len(ids) // self.lanes) - 1, -1, -1):
            at = step * self.lanes
            f, c, t = f_all[at : at + self.lanes], c_all[at : at + self.lanes], top[at : at + self.lanes]
            y = x[: len(f)]
            full = y >= t
            if full.any():
                out = y[full]
                words.append(out.astype(np.uint32))
                sent += len(out)
                y[full] = out >> WORD
            q = y // f
            y[:] = (q << self.bits) + (y - q * f) + c
            if step % self.every == 0:
                marks.append((step, sent, x.copy()))
        if not len(ids):
            marks.append((0, 0, x))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        return stream, [(step, sent - done, states) for step, done, states in marks[::-1]]

    def decode(self, words: np.ndarray, mark: tuple[int, int, np.ndarray], first: int, end: int, n: int) -> np.ndarray:
        """Ids first to end (exclusive) of a block of n ids, from a checkpoint at or before first."""
        step, pos, x = mark[0], mark[1], mark[2].copy()
        begin, out = step * self.lanes, []
        while step * self.lanes < end:
            y = x[: min(self.lanes, n - step * self.lanes)]
            slot = y & self.mask
            ids = self.slots[slot]
            y[:] = self.freq[ids] * (y >> self.bits) + slot - self.cum[ids]
            low = y < LOW
            more = int(np.count_nonzero(low))
            if more:
                y[low] = (y[low] << WORD) | words[pos : pos + more]
                pos += more
            out.append(ids)
            step += 1
        return np.concatenate(out)[first - begin : end - begin] if out else np.empty(0, np.uint32)
