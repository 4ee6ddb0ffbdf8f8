"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text.

Two zstandard dictionaries of equal size are trained, one on ordinary and one on toxic text.
Both end in a part of their own after a common stretch of ordinary text, so that lengths
differ by what the classes differ in. Toxic documents are mostly ordinary prose: the part of
the toxic dictionary is therefore trained on those runs of their bytes whose ``GRAM``-byte
strings no ordinary text of the sample holds. Every text is cut into overlapping windows,
each window is compressed with both, and the difference of the two lengths is evidence:
its weight is the log of how much commoner at least that difference is in toxic than in
ordinary texts, never below 0, less the average of ordinary windows. Weights are summed over
the whole text and damped by the number of its windows, so that long ordinary texts stay low;
the share of toxic texts at that sum is the score.

Fit: labelled rows outside of the held-out ids, ``SAMPLE`` different texts of each label at
most, those of the smallest SHA-256, of up to ``LONGEST`` bytes each (longer ones are left
out of the fit, not of what is scored). Two of three make the dictionaries, the rest the
weights and the scores. The fit runs on the driver and takes a few seconds, whatever the
input; dictionaries and tables (about 130 KB) go out with the tasks, which share nothing else.

Null and edge cases: a null text is the empty text; an empty or short text is one window
that no dictionary makes shorter, and scores as texts without evidence do; labels without a
document or with a null in doc_id or toxic are not used, a text under both labels counts for
both; with fewer than ``LEAST`` texts of either label nothing is learned and every score is
the smoothed share of toxic labels; repeated rows score alike; an empty table gives an empty
result; other columns of any name are kept if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from docloom.llm.arrow import map_columns

#: Bounds of the fit: texts of each label, bytes of a text, texts of each label to learn from at all.
SAMPLE, LONGEST, LEAST = 1500, 20_000, 4
WINDOW, STEP, LEVEL = 96, 72, 3
#: Bytes of the common stretch and of each class's part, and of the strings that tell novel runs.
COMMON, PART, GRAM = 65_536, 1024, 5
#: A string tells if so many toxic texts hold it, and so many times more of them than of ordinary texts.
SHARED, TIMES = 4, 20
#: Segments that the dictionary trainer picks for the common stretch and for the parts.
SEGMENT, PART_SEGMENT = 64, 12
#: Differences beyond this many bytes count as this many.
REACH = 24
#: Sums are divided by this power of the number of windows.
DAMP = 0.65
CUTOFF = 0.3


@dataclass
class Model:
    prior: float
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    sums: tuple[float, ...] = ()
    shares: tuple[float, ...] = ()


def folded(text: str | None) -> bytes:
    return f" {(text or '').lower()} ".encode()


def windows(body: bytes) -> Iterator[bytes]:
    """Overlapping windows; the last one ends with the text."""
    for at in range(0, max(1, len(body) - WINDOW + STEP), STEP):
        yield body[at : at + WINDOW]


def compressor(dictionary: bytes):
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(dictionary), source_size=WINDOW, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters).compress


def differences(model: Model):
    """A function from a text's bytes to the differences of its windows' two lengths."""
    plain, toxic = compressor(model.ordinary), compressor(model.toxic)
    return lambda body: np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows(body)), np.int64)


def grams(body: bytes) -> np.ndarray:
    """Every string of GRAM bytes as a number."""
    codes = np.frombuffer(body, np.uint8).astype(np.uint64)
    if len(codes) < GRAM:
        return codes[:0]
    return np.bitwise_or.reduce([codes[k : len(codes) - GRAM + 1 + k] << np.uint64(8 * (GRAM - 1 - k)) for k in range(GRAM)])


def spread(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted strings of the texts, and how many texts hold each."""
    found = [np.unique(grams(body)) for body in texts]
    return np.unique(np.concatenate(found or [grams(b"")]), return_counts=True)


def telling(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """The sorted strings that at least SHARED toxic texts hold, at TIMES the rate of ordinary ones or more."""
    strings, times = spread(toxic)
    known, usual = spread(ordinary)
    place = np.minimum(np.searchsorted(known, strings), max(len(known) - 1, 0))
    other = np.where(known[place] == strings, usual[place], 0) if len(known) else np.zeros(len(strings))
    return strings[(times >= SHARED) & (times * (len(ordinary) + 1) > TIMES * (other + 1) * len(toxic))]


def runs_of(body: bytes, wanted: np.ndarray) -> list[bytes]:
    """The runs of a text that are made of wanted strings, which are sorted."""
    found = grams(body)
    if not len(found) or not len(wanted):
        return []
    place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
    inside = np.concatenate([[False], wanted[place] == found, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [body[a : b + GRAM - 1] for a, b in zip(edges[::2], edges[1::2])]


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a trained dictionary, its best segments last; of few samples, their own last bytes."""
    try:
        content = zstandard.train_dictionary(size + 2048, samples, k=segment, d=GRAM, split_point=1.0).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on
        content = b"".join(samples)
    return content[-size:].rjust(size)


def rising(at: np.ndarray, is_toxic: np.ndarray, times: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Sums and shares of toxic texts that rise with them: neighbours out of order are pooled. A text counts ``times``."""
    pools: list[list[float]] = []
    for x, y, n in sorted(zip(at.tolist(), is_toxic.tolist(), times.tolist())):
        pools.append([x * n, y * n, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    # Half a text of either kind keeps shares off 0 and 1.
    return tuple(x / n for x, _, n in pools), tuple((y + 0.5) / (n + 1) for _, y, n in pools)


def learn(ordinary: list[bytes], toxic: list[bytes], of: tuple[int, int] | None = None) -> Model:
    """The model of the folded texts of either label, which come in a fixed order; they stand for ``of`` texts each."""
    of = of or (len(ordinary), len(toxic))
    prior = (of[1] + 1) / (sum(of) + 2)
    if min(len(ordinary), len(toxic)) < LEAST:
        return Model(prior)
    first = lambda texts: [t for k, t in enumerate(texts) if k % 3 != 2]
    second = lambda texts: texts[2::3]
    prose = [w for body in first(ordinary) for w in windows(body)]
    wanted = telling(first(toxic), first(ordinary))
    fragments = [run for body in first(toxic) for run in runs_of(body, wanted)]
    common = trained(prose[::2], COMMON, SEGMENT)
    model = Model(prior, common + trained(prose[1::2], PART, PART_SEGMENT), common + trained(fragments, PART, PART_SEGMENT))

    measure = differences(model)
    rows = [(np.clip(measure(body), -REACH, REACH) + REACH, kind) for kind, texts in enumerate((second(ordinary), second(toxic))) for body in texts]
    counts = np.full((2, 2 * REACH + 1), 0.5)
    for found, kind in rows:
        counts[kind] += np.bincount(found, minlength=2 * REACH + 1)
    # Evidence from the tail: how much commoner is a difference of at least so many bytes.
    tails = counts[:, ::-1].cumsum(1)[:, ::-1]
    ratio = np.log((tails[1] / tails[1, 0]) / (tails[0] / tails[0, 0]))
    weights = np.maximum.accumulate(np.where(np.arange(2 * REACH + 1) > REACH, np.maximum(ratio, 0), 0))
    model.weights = tuple((weights - weights @ counts[0] / counts[0].sum()).tolist())
    sums = np.array([evidence(found - REACH, np.array(model.weights)) for found, _ in rows])
    kinds = np.array([kind for _, kind in rows])
    model.sums, model.shares = rising(sums, kinds, np.array(of)[kinds] / np.array([len(ordinary), len(toxic)])[kinds])
    return model


def evidence(found: np.ndarray, weights: np.ndarray) -> float:
    """The summed weights of a text's windows, of which ordinary windows have none on average."""
    return float(weights[np.clip(found, -REACH, REACH) + REACH].sum() / len(found) ** DAMP)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id is none of them."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Folded texts of label 0 and of label 1, at most SAMPLE different ones each, in the order of their digests."""
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body")).where(F.octet_length("body") <= LONGEST)
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("id"), "toxic").distinct()
    named = texts.select("id", F.sha2("body", 256).alias("digest")).join(marks, "id").groupBy("toxic", "digest").agg(F.min("id").alias("id"))
    out = []
    for kind in (0, 1):
        few = named.where(F.col("toxic") == kind).orderBy("digest").limit(SAMPLE)
        rows = texts.join(F.broadcast(few.select("id", "digest")), "id").where(F.sha2("body", 256) == F.col("digest"))
        bodies = dict(rows.select("digest", "body").dropDuplicates(["digest"]).toLocalIterator())
        out.append([folded(bodies[d]) for d in sorted(bodies)])
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents: (doc_id, text), and (doc_id, toxic)."""
    return learn(*sampled(docs, labels))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns ``keep`` with ``score`` (0 to 1) of every text."""

    def run(batch: pa.RecordBatch) -> dict:
        if not model.weights:
            return {"score": np.full(batch.num_rows, model.prior)}
        measure, weights = differences(model), np.array(model.weights)
        sums = [evidence(measure(folded(text.as_py())), weights) for text in batch.column("text")]
        return {"score": np.interp(sums, model.sums, model.shares)}

    return map_columns(docs.select(*dict.fromkeys([*keep, "text"])), run, keep, "score double")
