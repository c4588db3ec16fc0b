"""Induced suffix sorting of one block of bytes.

The suffixes that begin a descent (LMS) are sorted first, by recursion on the string of
their names; all others are induced from them in two sweeps over character buckets. The
buckets are a monotone priority queue: they are emptied in order of their character and
filled only at or after it. Each holds arrays of positions; beyond a limit they go to an
anonymous file of the task, so a block may be larger than memory. No file outlives the
task, and no other task reads one.
"""

from __future__ import annotations

import tempfile

import numpy as np


class BucketQueue:
    """A monotone priority queue of positions, with one first-in first-out run per key."""

    def __init__(self, keys: int, memory: int):
        self.runs: list[list] = [[] for _ in range(keys)]
        self.held, self.memory, self.file = 0, memory, None

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds values in order, each behind those of its key."""
        if not len(values):
            return
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for k, part in zip(keys[np.concatenate(([0], cuts))], np.split(values, cuts)):
            self.runs[k].append(part)
        self.held += values.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="induced-")
        self.file.seek(0, 2)
        for run in self.runs:
            for i, part in enumerate(run):
                if isinstance(part, np.ndarray):
                    run[i] = (self.file.tell(), len(part), part.dtype)
                    self.file.write(part.tobytes())
        self.held = 0

    def pop(self, key: int) -> np.ndarray:
        """All values of a key, in order; the key's run is empty then."""
        run, self.runs[key] = self.runs[key], []
        parts = []
        for part in run:
            if isinstance(part, np.ndarray):
                self.held -= part.nbytes
                parts.append(part)
            else:
                at, n, kind = part
                self.file.seek(at)
                parts.append(np.frombuffer(self.file.read(n * kind.itemsize), kind))
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def ascending(text: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the one that follows it (type S); the last is S."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    out = np.ones(n, bool)
    if not len(differs):
        out[: n - 1] = False  # of equal characters, the shorter suffix is less
        return out
    nearest = np.searchsorted(differs, np.arange(n - 1))  # where the run of equals ends
    inside = nearest < len(differs)
    end = differs[np.minimum(nearest, len(differs) - 1)]
    out[: n - 1] = inside & (text[end] < text[end + 1])
    return out


def _induce(text, is_s, lms, keys: int, memory: int) -> np.ndarray:
    """The order of all suffixes, given that of the LMS ones."""
    low = BucketQueue(keys, memory)  # type L, swept upwards
    starts = BucketQueue(keys, memory)
    starts.push(text[lms], lms)
    sorted_l = []
    for c in range(keys):
        wave, bucket = low.pop(c), []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            own = text[before] == c
            low.push(text[before[~own]], before[~own])
            wave = before[own]
        sorted_l.append(np.concatenate(bucket) if bucket else np.empty(0, np.int64))
        before = starts.pop(c)
        before = before[before > 0] - 1
        before = before[~is_s[before]]
        low.push(text[before], before)
    high = BucketQueue(keys, memory)  # type S, swept downwards
    end = np.array([len(text) - 1])  # the end mark, which nothing induces
    high.push(text[end], end)
    out = [None] * keys
    for c in range(keys - 1, -1, -1):
        wave, bucket = high.pop(c), []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            own = text[before] == c
            high.push(text[before[~own]], before[~own])
            wave = before[own]
        before = sorted_l[c][::-1]
        before = before[before > 0] - 1
        before = before[is_s[before]]
        high.push(text[before], before)
        s_part = np.concatenate(bucket)[::-1] if bucket else np.empty(0, np.int64)
        out[c] = np.concatenate((sorted_l[c], s_part))
    for queue in (low, starts, high):
        queue.close()
    return np.concatenate(out)


def _names(text, order, lms) -> tuple[np.ndarray, int]:
    """Names of LMS substrings (to the next LMS place, both ends counted), in text order."""
    n = len(text)
    ends = np.concatenate((lms[1:], [n - 1]))
    size = np.zeros(n, np.int64)
    size[lms] = ends - lms + 1
    ranked = order[size[order] > 0]
    a, b = ranked[:-1], ranked[1:]
    same = size[a] == size[b]
    at = np.flatnonzero(same)
    step = 0
    while len(at):  # byte by byte, among those still equal
        left = size[a[at]] > step
        at = at[left]
        equal = text[a[at] + step] == text[b[at] + step]
        same[at[~equal]] = False
        at = at[equal]
        step += 1
    name = np.zeros(n, np.int64)
    name[ranked] = np.concatenate(([0], np.cumsum(~same)))
    return name[lms], int(name[ranked[-1]]) + 1 if len(ranked) else 0


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of large numbers."""
    n, rank, span = len(names), names.astype(np.int64), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - span] = rank[span:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        span *= 2
        if span >= n or new[-1] == n - 1:
            return order


def suffix_order(text: np.ndarray, memory: int = 1 << 28, small: int = 4096) -> np.ndarray:
    """The places of all suffixes of an array of numbers from 0 on, in ascending order.

    Recursion goes on while the alphabet of names stays below `small`; a string over more
    names, which buckets cannot hold densely, is ordered by rank doubling.
    """
    text = np.concatenate((text.astype(np.int64) + 1, [0]))
    n, keys = len(text), int(text.max()) + 1
    if n == 1:
        return np.empty(0, np.int64)
    is_s = ascending(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    order = _induce(text, is_s, lms, keys, memory)
    names, distinct = _names(text, order, lms)
    if distinct == len(lms):
        ranked = lms[np.argsort(names)]
    elif distinct <= small:
        ranked = lms[suffix_order(names, memory, small)]
    else:
        ranked = lms[_by_doubling(names)]
    return _induce(text, is_s, ranked, keys, memory)[1:]


def repeats(text: np.ndarray, starts: np.ndarray, span: int, **options) -> np.ndarray:
    """Of the places `starts`, those whose `span` numbers stand at another of them too.

    Suffixes that share them are neighbours in suffix order. Common prefixes are compared
    eight bytes at a time, and no further than `span`.
    """
    order = suffix_order(text, **options)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    a, b = order[:-1], order[1:]
    padded = np.concatenate((text.astype(np.uint8), np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alive = np.arange(len(a))
    for at in [*range(0, span - 7, 8), span - 8]:
        alive = alive[(words[a[alive] + at] == words[b[alive] + at]).all(axis=1)]
    found = np.zeros(len(text), bool)
    found[a[alive]] = True
    found[b[alive]] = True
    return np.flatnonzero(found)
