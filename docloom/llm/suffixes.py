"""Exact removal of repeated byte strings, by suffix sorting of shards.

A string of ``LEAST`` bytes is owned by its anchor, the ``GRAM``-byte substring of
smallest hash in it (substrings that are very frequent in the corpus, by a fixed-size
sketch, come last), so that equal strings are owned by equal anchors. A run of starts
with one anchor, and the bytes that their strings cover, is a window.

1. Windows of all texts are counted by anchor, after partial sums in each task. An anchor
   that occurs once owns nothing that repeats.
2. Where all windows of an anchor are equal, all their strings repeat.
3. Different windows of an anchor meet in one shard, each content once with its count.
   A shard is sorted by external induced sorting (``induced``): queues in files carry
   suffixes and common prefixes; a string repeats if its suffix shares ``LEAST`` bytes
   with another owned one, or its window's content occurs again.
4. Repeated starts are joined back to all windows, and covered bytes are removed.

Shards are cut at anchors, so that a task sorts ``SHARD_BYTES`` at a time whatever the
size of its partition, and they work in the task's own temporary folder, which is
emptied when they end.

Null and edge cases: a null text is empty; texts shorter than LEAST bytes stay whole;
rows are told apart by doc_id and text, so that a repeated row repeats all of its
strings; a null doc_id is kept; an empty table gives an empty result; other columns are
kept.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docloom.llm import induced
from docloom.llm.arrow import map_columns, slices, tidy
from docloom.llm.sketch import LETTERS, counts, mix, powers, running, utf8
from docloom.llm.store import join_small, staged

LEAST, GRAM = 200, 72
SLOTS, SLICE, SHARD_BYTES = 1 << 20, 1 << 20, 3 << 19
#: A gram is frequent beyond so many times the mean count of the sketch's slots, and so many more.
FREQUENT_TIMES, FREQUENT_LEAST = 4, 64
PLACE_BITS = np.uint64(30)
WINDOWS = "windows array<struct<anchor:bigint,content:bigint,start:bigint,n:int>>"


def grams(run: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place."""
    n = max(0, len(run) - GRAM)
    return mix((run[GRAM:] - run[:n]) * down[:n])


def gram_hashes(texts: pa.Array) -> np.ndarray:
    data, _ = utf8(texts)
    return grams(running(LETTERS[data]), powers(len(data) + 1)[1])


def windows(texts: pa.Array, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, anchor, content, start, number of starts) of every window of the texts."""
    data, bounds = utf8(texts)
    none = np.empty(0, np.int64)
    if len(data) < LEAST:
        return none, none, none, none, none
    run, down = running(LETTERS[data]), powers(len(data) + 1)[1]
    hashes = grams(run, down)
    wide = LEAST - GRAM + 1
    rare = frequent[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
    value = (hashes >> np.uint64(1)) | (rare.astype(np.uint64) << np.uint64(63))
    value = (value >> PLACE_BITS << PLACE_BITS) | np.arange(len(value), dtype=np.uint64)
    # Sliding minima of ``wide`` values, from running minima of blocks in both directions.
    padded = np.full(-(-len(value) // wide) * wide, np.iinfo(np.uint64).max)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(value) - wide + 1
    best = np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])
    anchor = (best & np.uint64((1 << 30) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    valid = np.arange(n) + LEAST <= bounds[1:][text]
    places = np.flatnonzero(valid)
    if not len(places):
        return none, none, none, none, none
    own = anchor[places]
    heads = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (np.diff(places) > 1))))
    first = places[heads]
    size = np.diff(np.append(heads, len(places)))
    end = first + size - 1 + LEAST
    content = mix((run[end] - run[first]) * down[first] + size.astype(np.uint64))
    number = text[first]
    return number, hashes[own[heads]].view(np.int64), content.view(np.int64), first - bounds[number], size


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text, F.reverse(text))


def all_windows(rows: DataFrame) -> DataFrame:
    """(row, windows) of rows(row, text)."""
    seen = counts(rows.select("text"), gram_hashes, SLOTS, SLICE)
    limit = FREQUENT_TIMES * int(seen.sum(dtype=np.int64)) // SLOTS + FREQUENT_LEAST
    frequent = rows.sparkSession.sparkContext.broadcast(seen > limit)  # SLOTS bytes
    fields = pa.struct([("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])

    def run(batch: pa.RecordBatch) -> dict:
        number, anchor, content, start, n = windows(batch.column("text"), frequent.value)
        ends = np.searchsorted(number, np.arange(batch.num_rows + 1)).astype(np.int32)
        columns = [pa.array(anchor), pa.array(content), pa.array(start), pa.array(n.astype(np.int32))]
        return {"windows": pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(fields)))}

    return map_columns(rows, run, ("row",), WINDOWS, limit=SLICE)


def contents(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(anchor, content, times, n, bytes) of chosen(row, take: array of windows)."""
    joined = join_small(rows, chosen.withColumnRenamed("row", "_row"), rows["row"], "_row", "inner")

    def work(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                out = {"anchor": [], "content": [], "times": [], "n": [], "bytes": []}
                texts = batch.column("text").cast(pa.large_binary()).to_pylist()
                for text, take in zip(texts, batch.column("take").to_pylist()):
                    for w in take:
                        for c in ("anchor", "content", "times", "n"):
                            out[c].append(w[c])
                        out["bytes"].append(text[w["start"] : w["start"] + w["n"] - 1 + LEAST])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["anchor"], pa.int64()), pa.array(out["content"], pa.int64()), pa.array(out["times"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["bytes"], pa.binary())],
                    names=list(out),
                )

    return joined.select("text", "take").mapInArrow(tidy(work), "anchor bigint, content bigint, times bigint, n int, bytes binary")


def ranges(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"a": a, "b": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def sorted_shards(found: DataFrame, shards: int) -> DataFrame:
    """(anchor, content, hits: array of (a, b)) of the windows with repeated starts."""

    def flush(held: list[dict], folder: str) -> pa.RecordBatch:
        hits = induced.repeated_starts([w["bytes"] for w in held], [w["n"] for w in held], LEAST, folder)
        rows = [(w["anchor"], w["content"], ranges(np.ones(w["n"], bool) if w["times"] > 1 else h)) for w, h in zip(held, hits)]
        rows = [r for r in rows if r[2]]
        kinds = pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["anchor", "content", "hits"])

    def work(batches):
        held: list[dict] = []
        size = 0
        with tempfile.TemporaryDirectory() as folder:
            for batch in batches:
                for row in batch.to_pylist():
                    if size > SHARD_BYTES and row["anchor"] != held[-1]["anchor"]:
                        yield flush(held, folder)
                        held, size = [], 0
                    held.append(row)
                    size += len(row["bytes"])
            if held:
                yield flush(held, folder)

    rows = found.repartition(shards, "anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(tidy(work), "anchor bigint, content bigint, hits array<struct<a:bigint,b:bigint>>")


def merged(spans: list[dict]) -> list[dict]:
    """Ranges (a, b) in order, those that touch made one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["a"]):
        if out and s["a"] <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], s["b"])
        else:
            out.append(dict(s))
    return out


def repeated(rows: DataFrame) -> DataFrame:
    """(row, spans: array of (a, b)) of the byte ranges that repeated strings cover."""
    listed = staged(all_windows(rows), "windows").select("row", F.explode("windows").alias("w")).select("row", "w.*")
    again = (
        listed.groupBy("anchor")
        .agg(F.count("*").alias("times"), (F.min("content") != F.max("content")).alias("several"))
        .where("times > 1")
        .select("anchor", "several")
    )
    open_windows = staged(listed.join(again, "anchor"), "repeated-windows")
    several = open_windows.where("several")
    chosen = (
        several.groupBy("anchor", "content")
        .agg(F.min(F.struct("row", "start", "n")).alias("at"), F.count("*").alias("times"))
        .groupBy(F.col("at.row").alias("row"))
        .agg(F.collect_list(F.struct("anchor", "content", "times", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("take"))
    )
    # Rows of equal key are equal; a window's bytes are taken from one of them, or twice, which counts once.
    found = staged(contents(rows, staged(chosen, "chosen-windows")).dropDuplicates(["anchor", "content"]), "window-bytes")
    total = found.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(6, total // (4 * SHARD_BYTES) + 1)
    hits = staged(sorted_shards(found, int(shards)), "repeated-starts")
    part = several.join(hits, ["anchor", "content"]).select("row", "start", F.explode("hits").alias("h"))
    part = part.select("row", (F.col("start") + F.col("h.a")).alias("a"), (F.col("start") + F.col("h.b")).alias("b"))
    whole = open_windows.where("not several").select("row", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    every = part.unionByName(whole)
    every = every.groupBy("row").agg(F.collect_list(F.struct("a", (F.col("b") - 1 + LEAST).alias("b"))).alias("spans"))
    run = lambda batch: {"spans": [merged(s) for s in batch.column("spans").to_pylist()]}
    return map_columns(every, run, ("row",), "spans array<struct<a:bigint,b:bigint>>")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, the kept bytes (``kept``) and the removed byte ranges (``removed``)."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    hits = staged(repeated(rows), "repeated-ranges").toDF("_hit_row", "_hit_spans")
    joined = join_small(docs, hits, row_key(docs["doc_id"], docs["text"]), "_hit_row", "left").drop("_hit_row")
    keep = tuple(docs.columns)

    def run(batch: pa.RecordBatch) -> dict:
        out = {"n_bytes": [], "kept": [], "removed": []}
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for text, spans in zip(texts, batch.column("_hit_spans").to_pylist()):
            text = text or b""
            cuts = spans or []
            left, at = [], 0
            for s in cuts:
                left.append(text[at : s["a"]])
                at = s["b"]
            out["n_bytes"].append(len(text))
            out["kept"].append(b"".join(left) + text[at:])
            out["removed"].append(cuts)
        return out

    return map_columns(joined, run, keep, "n_bytes bigint, kept binary, removed array<struct<a:bigint,b:bigint>>")
