"""Substring dedup by sliding spans of sentences.

Texts are cut after sentence and clause marks and at lines, so that a passage that begins or
ends inside a sentence loses little. A span is a run of ``SPAN`` such sentences or more with
``LEAST`` words or more, or any run of ``LONG`` words, that is the shortest from its first
sentence or the shortest up to its last one: every longer run is made of spans. Spans are
hashed (128 bits) and counted over all documents.
Of a span that occurs more than once, the occurrence of smallest (doc_id, place) stays;
sentences covered by any other occurrence are removed.

Null and edge cases: a null text is the empty text and has no sentences; a text too short
for a span is one span; blank sentences belong to the gap before the next
one; rows of equal doc_id count as one document; of a null doc_id every occurrence
counts as a first one (nothing is removed from it, and it doesn't make others repeat);
an empty table gives an empty result; other columns are kept. Sentences compare by
their words, case-sensitively, whatever the white space.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docloom.llm.arrow import map_columns
from docloom.llm.store import join_small, staged

SPAN, LEAST, LONG = 3, 25, 50
#: Hashes of more than this share of all spans (so at most 1,000 of them) are joined by broadcast, the others by a shuffle.
HOT_SHARE = 1000
#: Bytes of files up to which the removed spans are broadcast whole: their arrays take over ten times as much in memory.
SMALL_HITS = 256 << 10
GAP = re.compile(r"\n+|(?<=[.!?,;:]) +")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words joined by blanks) of each sentence that has words; its gap belongs to it."""
    out, at = [], 0
    cuts = [m.span() for m in GAP.finditer(text)] + [(len(text), len(text))]
    for end, following in cuts:
        words = " ".join(text[at:end].split())
        if words:
            out.append((at, following, words))
        elif out:
            out[-1] = (out[-1][0], following, out[-1][2])
        at = following
    return out


def runs(sizes: list[int]) -> set[tuple[int, int]]:
    """(first, end) of the shortest runs from each sentence and up to each sentence; the whole text if none is long enough."""
    out, n = set(), len(sizes)
    enough = lambda words, size: words >= LONG or (words >= LEAST and size >= SPAN)
    end = words = 0
    for first in range(n):
        while end < n and not enough(words, end - first):
            words += sizes[end]
            end += 1
        if enough(words, end - first):
            out.add((first, end))
        words -= sizes[first]
    first, words = n, 0
    for end in range(n, 0, -1):
        while first > 0 and not enough(words, end - first):
            first -= 1
            words += sizes[first]
        if enough(words, end - first):
            out.add((first, end))
        words -= sizes[end - 1]
    return out or ({(0, n)} if n else out)


def spans(found: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(place, sentences, hash, hash) of each span."""
    digests = [xxhash.xxh3_128_digest(w) for _, _, w in found]
    out = []
    for first, end in sorted(runs([w.count(" ") + 1 for _, _, w in found])):
        digest = xxhash.xxh3_128_intdigest(b"".join(digests[first:end]))
        out.append((first, end - first, (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))
    return out


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, place, n, h1, h2) of every span."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [spans(sentences(t or "")) for t in batch.column("text").to_pylist()]
        return {"spans": [[dict(zip(("place", "n", "h1", "h2"), s)) for s in own] for own in rows]}

    every = map_columns(docs.select("doc_id", "text"), run, ("doc_id",), "spans array<struct<place:int,n:int,h1:bigint,h2:bigint>>")
    return every.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of (place, n)) of documents with occurrences that are not the first."""
    every = staged(hashed(docs.where("doc_id is not null")), "sentence-spans")
    hash_ = ["h1", "h2"]
    # Counts meet by hash after they were summed in each task; the first place comes along.
    twice = (
        every.groupBy(*hash_)
        .agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max(F.struct("doc_id", "place")).alias("last"), F.count("*").alias("times"))
        .where("first <> last")
        .select(*hash_, F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("first_place"), "times")
    )
    twice = staged(twice, "repeated-spans")
    often = F.col("times") * HOT_SHARE > every.count()
    hot = F.broadcast(twice.where(often).drop("times"))
    rest = every.join(hot.select(*hash_), hash_, "left_anti").join(twice.where(~often).drop("times"), hash_)
    again = every.join(hot, hash_).unionByName(rest).where("doc_id <> first_doc or place <> first_place")
    return again.groupBy("doc_id").agg(F.collect_set(F.struct("place", "n")).alias("spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with cleaned text in ``kept``, and n_sentences, n_removed and the removed character ranges."""
    hits = staged(removed(docs), "sentence-hits").toDF("_hit_doc", "_hit_spans")
    joined = join_small(docs, hits, docs["doc_id"], "_hit_doc", "left", SMALL_HITS).drop("_hit_doc")
    keep = tuple(docs.columns)

    def run(batch: pa.RecordBatch) -> dict:
        out = {"n_sentences": [], "n_removed": [], "kept": [], "removed": []}
        for text, own in zip(batch.column("text").to_pylist(), batch.column("_hit_spans").to_pylist()):
            found = sentences(text or "")
            gone = bytearray(len(found))
            for s in own or ():
                gone[s["place"] : s["place"] + s["n"]] = b"\1" * s["n"]
            cuts: list[list[int]] = []
            for (a, b, _), off in zip(found, gone):
                if off and cuts and cuts[-1][1] == a:
                    cuts[-1][1] = b
                elif off:
                    cuts.append([a, b])
            left, at = [], 0
            for a, b in cuts:
                left.append((text or "")[at:a])
                at = b
            out["n_sentences"].append(len(found))
            out["n_removed"].append(sum(gone))
            out["kept"].append("".join(left) + (text or "")[at:])
            out["removed"].append(",".join(f"{a}:{b}" for a, b in cuts))
        return out

    return map_columns(joined, run, keep, "n_sentences bigint, n_removed bigint, kept string, removed string")
