"""Induced sorting of a byte text with disk-backed bucket queues that carry common prefixes.

Suffixes are inserted by decreasing and increasing buckets of their first byte. What a
batch of sorted suffixes induces arrives in each bucket's queue in sorted order, as
tuples of a position and the length of the prefix it shares with the tuple before it,
which follows from the smallest shared prefix between the two that induced them. Queues
move to files when they pass a bound, so that memory holds the text, a batch, and that.
Lengths of common prefixes are exact up to ``CAP``.
"""

from __future__ import annotations

import tempfile

import numpy as np

from docloom.llm.sketch import LETTERS, mix, powers, running

CAP = 255
#: Tuples of queues are kept in memory up to so many bytes in all.
QUEUE_BYTES = 64 << 20
ALPHABET = 257  # 0 ends a window; a byte b is b + 1


class Queues:
    """A first-in, first-out queue of (position, common prefix) for each first byte."""

    def __init__(self, folder: str):
        self.file = tempfile.TemporaryFile(dir=folder)
        self.parts: list[list] = [[] for _ in range(ALPHABET)]
        self.held = 0

    def push(self, char: int, positions: np.ndarray, shared: np.ndarray) -> None:
        self.parts[char].append((positions, shared))
        self.held += positions.nbytes + shared.nbytes
        if self.held > QUEUE_BYTES:
            self.spill()

    def spill(self) -> None:
        for own in self.parts:
            for k, part in enumerate(own):
                if isinstance(part[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    own[k] = (at, len(part[0]))
        self.held = 0

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray]:
        found, self.parts[char] = self.parts[char], []
        out = []
        for part in found:
            if isinstance(part[0], np.ndarray):
                self.held -= part[0].nbytes + part[1].nbytes
                out.append(part)
            else:
                self.file.seek(part[0])
                out.append((np.frombuffer(self.file.read(4 * part[1]), np.int32), np.frombuffer(self.file.read(part[1]), np.uint8)))
        if not out:
            return np.empty(0, np.int32), np.empty(0, np.uint8)
        return np.concatenate([p for p, _ in out]), np.concatenate([s for _, s in out])


class Least:
    """Smallest values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first..last, both included; CAP where that is empty."""
        size = last - first + 1
        out = np.full(len(size), CAP, np.uint8)
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[size > 0]).tolist():
            at = np.flatnonzero((size > 0) & (level == k))
            row = self.rows[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        return out


class Inducer:
    """One pass over the buckets; ``kind`` is the type (True: S) that it inserts."""

    def __init__(self, text: np.ndarray, types: np.ndarray, kind: bool, folder: str):
        self.text, self.types, self.kind = text, types, kind
        self.queues = Queues(folder)
        self.since = np.full(ALPHABET, CAP, np.uint8)  # least shared prefix since a bucket's last tuple
        self.used = np.zeros(ALPHABET, bool)

    def feed(self, positions: np.ndarray, shared: np.ndarray) -> None:
        """Insert what sorted suffixes induce; ``shared`` is of each with the one before it."""
        before = positions - 1
        keep = np.flatnonzero((before >= 0) & (self.types[before] == self.kind))
        chars = self.text[before[keep]]
        order = np.argsort(chars, kind="stable")
        keep, chars = keep[order], chars[order]
        starts = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(chars) else np.empty(0, np.int64)
        least = Least(shared)
        previous = np.concatenate(([-1], keep[:-1]))
        previous[starts] = -1
        low = least.of(previous + 1, keep)
        heads = chars[starts]
        low[starts] = np.minimum(low[starts], self.since[heads])
        low = np.minimum(low, CAP - 1) + 1
        low[starts[~self.used[heads]]] = 0
        ends = np.concatenate((starts[1:], [len(chars)])).astype(np.int64)
        for char, a, b in zip(heads.tolist(), starts.tolist(), ends.tolist()):
            self.queues.push(char, before[keep[a:b]].astype(np.int32), low[a:b].astype(np.uint8))
        if len(shared):
            self.since = np.minimum(self.since, shared.min())
        if len(heads):
            last = keep[ends - 1]
            self.since[heads] = least.of(last + 1, np.full(len(last), len(shared) - 1))
            self.used[heads] = True

    def bucket(self, char: int) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of this kind in a bucket, in order; each round is induced by the round before."""
        rounds = []
        while len((found := self.queues.pop(char))[0]):
            rounds.append(found)
            self.feed(*found)
        if not rounds:
            return np.empty(0, np.int32), np.empty(0, np.uint8)
        return np.concatenate([p for p, _ in rounds]), np.concatenate([s for _, s in rounds])


def run_lengths(text: np.ndarray) -> np.ndarray:
    """How many equal characters start at each place, up to CAP."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text))
    return np.minimum(ends[np.searchsorted(ends, np.arange(len(text)), side="right")] - np.arange(len(text)), CAP).astype(np.uint8)


def induce(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, shared: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, with common prefixes, from the sorted S* suffixes."""
    runs = run_lengths(text)
    bounds = np.searchsorted(text[seeds], np.arange(ALPHABET + 1))
    left = Inducer(text, types, False, folder)
    larger: list[tuple[np.ndarray, np.ndarray]] = []
    for char in range(ALPHABET):
        found = left.bucket(char)
        larger.append(found)
        own, prefix = seeds[bounds[char] : bounds[char + 1]], shared[bounds[char] : bounds[char + 1]].copy()
        if len(own):
            prefix[0] = min(runs[found[0][-1]], runs[own[0]]) if len(found[0]) else 0
            left.feed(own, prefix)
    right = Inducer(text, types, True, folder)
    smaller: list[tuple[np.ndarray, np.ndarray]] = [None] * ALPHABET
    for char in range(ALPHABET - 1, -1, -1):
        found = right.bucket(char)
        smaller[char] = found
        own, prefix = larger[char]
        if len(own):
            down = np.append(prefix[1:], 0)[::-1].astype(np.uint8)  # of each with the next larger one
            down[0] = min(runs[found[0][-1]], runs[own[-1]]) if len(found[0]) else 0
            right.feed(own[::-1], down)
    order, prefixes = [], []
    for char in range(ALPHABET):
        own, prefix = larger[char]
        if len(own):
            prefix = prefix.copy()
            prefix[0] = 0
        order.append(own)
        prefixes.append(prefix)
        found, down = smaller[char]
        if char == 0:  # the last end mark has nothing after it that could induce it
            found, down = np.append(found, np.int32(len(text) - 1)), np.append(down, np.uint8(1 if len(found) else 0))
        if len(found):
            up = np.append(down[1:], 0).astype(np.uint8)
            up[-1] = min(runs[own[-1]], runs[found[-1]]) if len(own) else 0
            order.append(found[::-1])
            prefixes.append(up[::-1])
    return np.concatenate(order), np.concatenate(prefixes)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is."""
    change = np.flatnonzero(text[1:] != text[:-1])
    at = np.searchsorted(change, np.arange(len(text)))
    up = np.append(text[change + 1] > text[change], True)
    return up[at]


def common_prefixes(hashes: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes a and b, up to CAP, by halving steps of equal hashes."""
    size = len(hashes) - 1
    a, b, out = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int64)
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        x, y = a + out, b + out
        fits = np.maximum(x, y) + step <= size
        x, y = np.where(fits, x, 0), np.where(fits, y, 0)
        reach = np.minimum(step, size)
        same = (hashes[x + reach] - hashes[x]) * down[x] == (hashes[y + reach] - hashes[y]) * down[y]
        out += step * (fits & same)
    return out.astype(np.uint8)


def suffix_array(text: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes with the one before) of a text that ends with a 0.

    Suffixes that agree in 256 characters and more may stand in any order.
    """
    types = suffix_types(text)
    stars = (np.flatnonzero(types[1:] & ~types[:-1]) + 1).astype(np.int32)
    values = np.concatenate((LETTERS, mix(LETTERS[:1])))[text]
    hashes, down = running(values), powers(len(text) + 1)[1]
    # First the S* substrings: induced from S* suffixes in order of their first byte only.
    seeds = stars[np.argsort(text[stars], kind="stable")]
    order, _ = induce(text, types, seeds, np.zeros(len(seeds), np.uint8), folder)
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    order = order[is_star[order]]
    # Names by equal substrings, then ranks of twice as many names in each step.
    number = np.searchsorted(stars, order)
    stop = np.append(stars[1:], len(text) - 1).astype(np.int64)[number]
    piece = mix((hashes[stop + 1] - hashes[order]) * down[order] + (stop - order).astype(np.uint64))
    rank = np.empty(len(stars), np.int64)
    rank[number] = np.cumsum(np.concatenate(([0], piece[1:] != piece[:-1])))
    names, reach = len(stars), 1
    while reach <= 128 and len(stars) and rank.max() + 1 < names:
        behind = np.zeros(names, np.int64)
        behind[:-reach] = rank[reach:] + 1
        key = rank * (names + 1) + behind
        number = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[number][1:] != key[number][:-1])))
        rank[number] = new
        reach *= 2
    seeds = stars[np.argsort(rank, kind="stable")]
    shared = np.zeros(len(seeds), np.uint8)
    shared[1:] = common_prefixes(hashes, down, seeds[:-1], seeds[1:])
    return induce(text, types, seeds, shared, folder)


def repeated_starts(windows: list[bytes], starts: list[int], least: int, folder: str) -> list[np.ndarray]:
    """For each window, which of its first ``starts`` places begin a ``least``-byte string that any other owned place begins."""
    sizes = np.array([len(w) + 1 for w in windows])
    at = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int16)
    flat = np.frombuffer(b"".join(windows), np.uint8).astype(np.int16) + 1
    inside = np.ones(len(text), bool)
    inside[at + sizes - 1] = False
    text[inside] = flat
    order, shared = suffix_array(text, folder)
    owned = np.zeros(len(text) + 1, np.int8)
    np.add.at(owned, at, 1)
    np.add.at(owned, at + np.array(starts), -1)
    owned = np.cumsum(owned[:-1], dtype=np.int8).astype(bool)
    group = np.cumsum(shared < least)
    own = owned[order]
    many = np.bincount(group[own], minlength=int(group[-1]) + 1) > 1
    hit = np.zeros(len(text), bool)
    hit[order[own & many[group]]] = True
    return [hit[a : a + n] for a, n in zip(at.tolist(), starts)]
