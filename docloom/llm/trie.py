"""Conversation prefix trie: every distinct sequence of first turns is a node.

Turns are numbered within their conversation, and blocks of 1, 2, 4, ... aligned turns get
dense names: the names of a block's two halves are joined with the table of distinct pairs,
so that after a logarithmic number of rounds equal names mean equal blocks. A prefix of d
turns is the row of blocks that the binary digits of d ask for; conversations with the same
row of names share the node of depth d, which is known by its smallest conversation.

What is summed over subtrees needs no walk: a node below v has its smallest conversation
among v's own, so every row (conversation, depth) carries what its node adds (on the row of
the node's smallest conversation), rows are summed from the end of each conversation, and
those sums are added up by node.

Hot keys: a conversation may hold any share of the rows, so turns are numbered by ranges,
and sums from the end go by blocks of ``BLOCK`` turns and then over blocks. Nodes that many
conversations share are aggregated partially; joins with them have one row a key on the
other side, which adaptive execution splits; the root is not joined at all. Digests of the
conversations that end at a node are streamed over pieces of ``PIECE`` bytes, sorted by
Spark, so that no list of them is held. The distinct pairs are counted by partition, one
number each, and nothing else comes to the driver. Each round is a written table.

Null and edge cases: rows without a conv_id belong to no conversation and are left out; a
null turn comes first, ties of turn go by the digest of role and text, repeated rows are
turns of their own; null roles and texts are empty; a conversation may be left without turns
and is then a member of the root alone; without conversations there is no node, not even a
root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docloom.llm.arrow import bound_batches, tidy
from docloom.llm.store import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Turns in a block of the sums from the end; bytes of a piece of the lists that are digested.
BLOCK, PIECE = 1024, 1 << 16
#: Of monotonically_increasing_id: the partition is above these bits, the row below.
ROW_BITS = 33
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, key, words) of every turn; key is a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = staged(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            "turn",
            F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "trie-turns",
    )
    order = ("conv_id", "turn", "key", "at")
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("at", "turn")
    ranged = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "trie-ranged").withColumn("part", F.shiftright("at", ROW_BITS))
    # Turns of a conversation in earlier ranges: only one that crosses a border of ranges has any.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.sum("n").over(earlier).alias("before")).where("before > 0")
    here = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("at"))
    placed = ranged.withColumn("here", here.cast("bigint")).join(F.broadcast(before), ["part", "conv_id"], "left")  # fewer rows than ranges
    return placed.select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).alias("place"), "key", "words")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The given conversations as they are: (conv_id, depth, key, words, ends) of turns, and (conv_id, length)."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    rows = turns.join(lengths, "conv_id").select("conv_id", F.col("place").alias("depth"), "key", "words", (F.col("place") == F.col("length")).alias("ends"))
    return staged(rows, "trie-rows"), lengths


def regrown(turns: DataFrame, stride: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """As ``whole``, of conversations rebuilt on common stems.

    Conversation c starts with the first h turns of c - c % stride, h = crc32(c) % (most + 1), and goes on with its own
    turns after its first h. The remainder of a negative c is negative, as in SQL.
    """
    stem = F.col("conv_id") - F.col("conv_id") % stride
    sizes = staged(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-sizes")
    stems = sizes.where(F.col("conv_id") % stride == 0).select(F.col("conv_id").alias("stem"), F.col("own").alias("there"))
    known = sizes.select("conv_id", "own", stem.alias("stem"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"))
    known = known.join(stems, "stem", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    known = staged(known.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-known")
    heads = turns.where((F.col("conv_id") % stride == 0) & (F.col("place") <= most)).select(F.col("conv_id").alias("stem"), "place", "key", "words")
    first = known.join(heads, "stem").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "key", "words", "length")
    rest = turns.join(known, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "key", "words", "length")
    rows = first.unionByName(rest).select("conv_id", "depth", "key", "words", (F.col("depth") == F.col("length")).alias("ends"))
    return staged(rows, "trie-rows"), known.select("conv_id", "length")


def dense(values: DataFrame, label: str) -> DataFrame:
    """The distinct rows of values, none null, with a dense ``name`` from 0."""
    found = staged(values.distinct().withColumn("at", F.monotonically_increasing_id()), label).withColumn("part", F.shiftright("at", ROW_BITS))
    counts = found.groupBy("part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("part", F.coalesce(upto, F.lit(0)).alias("before"))  # as many rows as partitions
    row = F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return found.join(F.broadcast(before), "part").select(*values.columns, (row + F.col("before")).alias("name"))


def blocks(rows: DataFrame, longest: int) -> DataFrame:
    """(conv_id, level, block, name): dense names of the blocks of 2**level turns that prefixes are made of."""
    names = rows.join(dense(rows.select("key"), "trie-keys"), "key").select("conv_id", (F.col("depth") - 1).alias("block"), "name")
    names = staged(names, "trie-level")
    found = names.withColumn("level", F.lit(0))
    for level in range(1, longest.bit_length()):
        half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("name")))
        pairs = names.groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(half(0).alias("one"), half(1).alias("two")).where("two is not null")
        names = pairs.join(dense(pairs.select("one", "two"), "trie-pairs"), ["one", "two"]).select("conv_id", "block", "name")
        names = staged(names, "trie-level")
        found = found.unionByName(names.withColumn("level", F.lit(level)))
    return found.where("block % 2 = 0")


def prefixes(rows: DataFrame, longest: int) -> DataFrame:
    """rows with ``path``, the names of the blocks that make up the prefix: with depth, the same for equal prefixes only."""
    digits = F.expr(f"filter(sequence(0, {longest.bit_length() - 1}), k -> shiftright(depth, k) % 2 = 1)")
    asked = rows.select("conv_id", "depth", "words", "ends", F.explode(digits).alias("level"))
    asked = asked.withColumn("block", F.expr("shiftright(depth, level) - 1"))
    named = asked.join(blocks(rows, longest), ["conv_id", "level", "block"])
    path = F.sort_array(F.collect_list(F.struct("level", "name")))["name"]  # one for each binary digit of depth
    return named.groupBy("conv_id", "depth").agg(F.first("words").alias("words"), F.first("ends").alias("ends"), path.alias("path"))


def members(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, words, ends, top, n_convs) of every conversation and depth from 0; top is the node's smallest conversation."""
    longest, least, count = lengths.agg(F.max("length"), F.min("conv_id"), F.count("*")).first()
    roots = lengths.select(
        "conv_id",
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("words"),
        (F.col("length") == 0).alias("ends"),
        F.lit(least).cast("bigint").alias("top"),
        F.lit(count).cast("bigint").alias("n_convs"),
    )
    if not longest:
        return staged(roots, "trie-members")
    paths = staged(prefixes(rows, longest), "trie-paths")
    nodes = paths.groupBy("depth", "path").agg(F.min("conv_id").alias("top"), F.count("*").alias("n_convs"))
    return staged(paths.join(nodes, ["depth", "path"]).select(*roots.columns).unionByName(roots), "trie-members")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(top, depth, parent, n_convs, n_children) of every node."""
    nodes = rows.where("conv_id = top").select("top", "depth", "n_convs")
    above = rows.select(F.col("conv_id").alias("top"), (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent"))
    nodes = nodes.join(above, ["top", "depth"], "left")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("top"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["top", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    return staged(nodes, "trie-nodes")


def below(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(top, depth, n_leaves, saved_tokens) of every node, over its subtree."""
    leaves = nodes.where("n_children = 0").select(F.col("top").alias("conv_id"), "depth", F.lit(1).cast("bigint").alias("leaf"))
    own = rows.join(leaves, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "top",
        F.coalesce("leaf", F.lit(0).cast("bigint")).alias("leaf"),
        F.when(F.col("conv_id") != F.col("top"), F.col("words")).otherwise(0).alias("saved"),
        F.floor(F.col("depth") / BLOCK).alias("part"),
    )
    own = staged(own, "trie-own")
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    after = own.groupBy("conv_id", "part").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    after = after.select("conv_id", "part", F.sum("leaf").over(later).alias("more_leaf"), F.sum("saved").over(later).alias("more_saved"))
    onward = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = own.select("conv_id", "part", "depth", "top", F.sum("leaf").over(onward).alias("leaf"), F.sum("saved").over(onward).alias("saved"))
    rest = rest.join(after.where("more_leaf is not null"), ["conv_id", "part"], "left")
    total = lambda c: F.sum(F.col(c) + F.coalesce(f"more_{c}", F.lit(0)))
    return rest.groupBy("top", "depth").agg(total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"))


def ends_digests(rows: DataFrame) -> DataFrame:
    """(top, depth, ends_sha256): SHA-256 of the ids that end at a node, ascending and comma-joined."""
    bound_batches(rows.sparkSession)
    key, order = ("top", "depth"), ("top", "depth", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted ids as comma-joined pieces of one node each."""
        out = pa.schema([("top", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.string())])
        at, first, ids, size = None, 0, [], 0
        for batch in batches:
            made = []
            for top, depth, conv in zip(*(batch.column(c).to_pylist() for c in order)):
                if ids and (at != (top, depth) or size >= PIECE):
                    made.append((*at, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    at, first = (top, depth), conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*at, first, ",".join(ids)), out)], schema=out)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One running digest over the pieces of a node, in their order."""
        out = pa.schema([("top", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
        at, running = None, None
        for batch in batches:
            made = []
            for top, depth, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if at == (top, depth):
                    running.update(b",")
                else:
                    if at is not None:
                        made.append((*at, running.hexdigest()))
                    at, running = (top, depth), hashlib.sha256()
                running.update(ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*at, running.hexdigest()), out)], schema=out)

    ending = rows.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = ending.mapInArrow(tidy(pieces), "top bigint, depth bigint, conv_id bigint, ids string")
    return joined.repartition(*key).sortWithinPartitions(*order).mapInArrow(tidy(digests), "top bigint, depth bigint, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations given as ``whole`` or ``regrown`` gives them."""
    rows = members(rows, lengths)
    nodes = nodes_of(rows)
    done = nodes.join(below(rows, nodes), ["top", "depth"]).join(ends_digests(rows), ["top", "depth"], "left")
    return done.select(
        F.col("top").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations as they are."""
    return trie(*whole(staged(numbered(conversations), "trie-numbered")))
