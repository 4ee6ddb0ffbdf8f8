"""Fixed-size counts of hashes over a whole table, and rolling hashes of bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.arrow import slices, tidy

PART = 1 << 14
BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, and 3 modulo 8
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LETTERS = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 64, 256, dtype=np.uint64)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (BASE, BASE_INVERSE):
            steps = np.full(max(n, (1 << 20) + 1), base)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of letter values times powers: the base of all substring hashes."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][:-1], out=out[1:])
    return out


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the bounds of each; a null text is empty."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def counts(texts: DataFrame, hashes: Callable[[pa.Array], np.ndarray], slots: int, slice_bytes: int = 1 << 20) -> np.ndarray:
    """How many of ``hashes`` (of the first column's slices) fall on each slot (hash modulo slots).

    Tasks count by themselves; parts of the counters are added up by other tasks. What
    comes back has ``slots`` counters, whatever the input.
    """

    def count(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for part in slices(batch, slice_bytes):
                total += np.bincount((hashes(part.column(0)) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        parts = total.reshape(-1, PART)
        for n in np.flatnonzero(parts.any(axis=1)).tolist():
            at = np.flatnonzero(parts[n])
            yield pa.RecordBatch.from_pydict({"part": [n], "at": [at.astype(np.uint16).tobytes()], "n": [parts[n][at].astype(np.uint32).tobytes()]})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = total.setdefault(row["part"], np.zeros(PART, np.int64))
                own[np.frombuffer(row["at"], np.uint16)] += np.frombuffer(row["n"], np.uint32)
        for n, own in total.items():
            yield pa.RecordBatch.from_pydict({"part": [n], "n": [np.minimum(own, 2**32 - 1).astype(np.uint32).tobytes()]})

    rows = texts.mapInArrow(tidy(count), "part bigint, at binary, n binary").repartition(slots // PART, "part")
    out = np.zeros((slots // PART, PART), np.uint32)
    for row in rows.mapInArrow(tidy(add), "part bigint, n binary").collect():
        out[row["part"]] = np.frombuffer(row["n"], np.uint32)
    return out.reshape(-1)
