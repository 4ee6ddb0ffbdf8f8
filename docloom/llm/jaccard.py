"""Exact similarity join of word-shingle sets, to connected components.

1. A fixed-size sketch counts the shingles of all documents. It only fixes an order of
   shingles, rare ones first; any order gives the same links.
2. Each document gives its set's digest, a bitmap of hashed shingles as wide as its size
   band asks, and its prefix: sets of similarity 0.8 share one of the 20 % (and one) of
   their shingles that come first in the order. Equal sets become one class.
3. Classes are listed by prefix shingle. Neighbours by size in each list are compared
   first; what links becomes one component.
4. Lists that still hold several components become tiles of size bands, in blocks. A
   tile's bitmaps are compared pair by pair, only between components: bit counts bound
   the overlap from above. Pairs that the bound leaves are decided by intersecting their
   sorted shingle arrays. In the first rounds each class goes, with its array, to the
   tile of its largest list only, where what links is one component from then on; lists
   that were in one tile are closed. What then is left is compared by bitmaps alone, and
   decided after distinct pairs were taken.

Shingles are 64-bit hashes of the words' bytes. Every comparison that is left out is of
two sets that can't be similar or that are already in one component.

Null and edge cases: a null text, or one without words, has an empty set and links with
nothing; up to four words are one shingle; rows of equal text, repeated rows included,
are of one class; a null doc_id is kept, with a null component where it is alone; an
empty table gives an empty result; other columns are not read by ``classes`` and kept by
``first_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from docloom.llm.arrow import bound_batches, map_columns, slices, tidy
from docloom.llm.components import components, joined
from docloom.llm.sketch import LETTERS, counts, mix, powers, running, utf8
from docloom.llm.store import staged

WORDS, PERCENT = 5, 80
#: Counters of the sketch (4 bytes each; the one table that is broadcast besides size-checked ids).
SLOTS = 1 << 20
SLICE = 1 << 20
TILE = 1500
#: Rounds in which each class is compared in its largest list, sets in hand, before the rest goes by bitmaps.
OWN_TILES = 2
#: A set of ids up to this many rows is broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 500_000

CHAIN = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LETTERS = LETTERS[LOWER]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    data, bounds = utf8(texts)
    if not len(data):
        return [np.empty(0, np.uint64)] * len(texts)
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    starts = np.flatnonzero(solid & (first[:-1] | ~np.concatenate(([False], solid[:-1]))))
    stops = np.flatnonzero(solid & (np.concatenate((first[1:-1], [True])) | ~np.concatenate((solid[1:], [False])))) + 1
    run, down = running(LETTERS[data]), powers(len(data) + 1)[1]
    words = mix((run[stops] - run[starts]) * down[starts] + (stops - starts).astype(np.uint64) * CHAIN)
    place = np.searchsorted(starts, bounds)
    chain = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        chain = chain * CHAIN + words[k : k + len(chain)]
    chain = mix(chain)
    out = []
    for a, b in zip(place.tolist(), place[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(chain[a : b - WORDS + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(words[k : k + 1] + whole * CHAIN)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def width(n: int) -> int:
    """Bits of the bitmap of a set of n shingles."""
    return max(64, 1 << (n - 1).bit_length() + 1)


def bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(width(len(hashes)), bool)
    bits[((hashes >> np.uint64(32)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, n_bytes: int) -> bytes:
    """A bitmap brought to a smaller width."""
    rows = np.frombuffer(bits, np.uint8).reshape(-1, n_bytes)
    return np.bitwise_or.reduce(rows, axis=0).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, bits, keys): size, digest, bitmap and prefix of each document's set."""
    seen = docs.sparkSession.sparkContext.broadcast(counts(docs.select("text"), lambda t: np.concatenate(shingle_sets(t)), SLOTS, SLICE))

    def run(batch: pa.RecordBatch) -> dict:
        made = {"n": [], "s1": [], "s2": [], "bits": [], "keys": []}
        for hashes in shingle_sets(batch.column("text")):
            n = len(hashes)
            made["n"].append(n)
            made["s1"].append(int(hashes.sum().astype(np.int64)) if n else 0)
            made["s2"].append(int(mix(hashes ^ CHAIN).sum().astype(np.int64)) if n else 0)
            made["bits"].append(bitmap(hashes) if n else b"")
            rank = seen.value[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
            order = np.lexsort((hashes, rank))
            made["keys"].append(hashes[order[: n - -(-n * PERCENT // 100) + 1]].view(np.int64) if n else np.empty(0, np.int64))
        return made

    schema = "n bigint, s1 bigint, s2 bigint, bits binary, keys array<bigint>"
    return map_columns(docs.select("doc_id", "text"), run, ("doc_id",), schema, limit=SLICE)


def may_link(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the bit counts leave room for an overlap that links; bitmaps are rows of uint64."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    most = np.minimum(n_a - only_a, n_b - only_b)
    return most * (100 + PERCENT) >= PERCENT * (n_a + n_b)


def only(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is among ids, which are broadcast only if they are few."""
    ids = staged(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of staged sets(rep, n, bits) that the bound on bit counts leaves."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def keep(batches):
        for batch in batches:
            d = batch.to_pydict()
            found = []
            for a, b, x, y, n, m in zip(d["bits_a"], d["bits_b"], d["a"], d["b"], d["n_a"], d["n_b"]):
                size = min(len(a), len(b))
                a, b = (np.frombuffer(folded(v, size), np.uint64) for v in (a, b))
                if may_link(a, b, n, m):
                    found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return rows.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidy(keep), "a bigint, b bigint")


def arrays_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the documents in ids(doc_id), which is broadcast only if it is small."""
    texts = only(docs.select("doc_id", "text"), "doc_id", ids)
    run = lambda batch: {"hashes": [h.view(np.int64) for h in shingle_sets(batch.column("text"))]}
    return staged(map_columns(texts, run, ("doc_id",), "hashes array<bigint>", limit=SLICE), "sets")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sorted shingle arrays overlap enough."""
    arrays = arrays_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    side = lambda c: arrays.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"h_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b")

    def keep(batches):
        for whole in batches:
            for batch in slices(whole):
                found = []
                for n in range(batch.num_rows):
                    x, y = (batch.column(c)[n].values.to_numpy().view(np.uint64) for c in (2, 3))
                    if similar(x, y):
                        found.append((batch.column(0)[n].as_py(), batch.column(1)[n].as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return staged(rows.mapInArrow(tidy(keep), "a bigint, b bigint").distinct(), "links")


def labelled(sets: DataFrame, rep: str, named: DataFrame) -> DataFrame:
    """sets with ``component``: the one in named(node, component), or the row's own ``rep``."""
    named = named.withColumnRenamed("node", rep)
    return sets.join(named, rep, "left").withColumn("component", F.coalesce("component", rep))


def tiles(lists: DataFrame, bits: DataFrame, arrays: DataFrame | None = None, alone: bool = False) -> DataFrame:
    """Pairs of different components of staged lists(key, rep, n, component).

    bits(rep, bits) and arrays(rep, hashes) join the rows when their tiles are known.

    A tile is a list's size band (a factor of 1.25) and the next one, in blocks of TILE
    rows. Without ``arrays`` the pairs are those that the bound leaves; with ``alone``
    not they, but their members, each paired with itself. With ``arrays``, each such pair
    is decided in the tile at once, and pairs whose components have met meanwhile are
    passed over, so that only links that join components come out.
    """
    exact = arrays is not None
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
    block = F.floor((F.row_number().over(Window.partitionBy("key", "band").orderBy("n", "rep")) - 1) / TILE).cast("int")
    rows = lists.withColumn("band", band)
    rows = rows.withColumn("block", block)
    blocks = rows.groupBy("key", "band").agg(F.max("block").alias("own"))
    by_band = Window.partitionBy("key").orderBy("band")
    beside = lambda f, step: F.when(f("band").over(by_band) == F.col("band") + step, f("own").over(by_band))
    blocks = blocks.select("key", "band", "own", beside(F.lag, -1).alias("lower"), beside(F.lead, 1).alias("upper"))
    rows = rows.join(blocks, ["key", "band"]).join(bits, "rep")
    if exact:
        rows = rows.join(arrays, "rep")

    def meets(last: str, at: int, left, right, step: int):
        spot = lambda k: F.struct((F.col("band") + at).alias("at"), left(k).alias("i"), right(k).alias("j"), F.lit(step).alias("step"))
        none = F.expr("cast(array() as array<struct<at:int,i:int,j:int,step:int>>)")
        return F.when(F.col(last).isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), spot))

    # A row meets the blocks of its own band, those of the band above as the smaller side, and of the band below as the larger.
    mine = F.col("block")
    every = F.concat(
        meets("own", 0, lambda k: F.least(k, mine), lambda k: F.greatest(k, mine), 0),
        meets("upper", 0, lambda k: mine, lambda k: k, 1),
        meets("lower", -1, lambda k: k, lambda k: mine, 1),
    )
    columns = ["rep", "n", "component", "bits", "band", "block"] + ["hashes"] * exact
    dealt = rows.select("key", *columns, F.explode(every).alias("tile")).select("key", "tile.*", *columns)
    order = ["key", "at", "step", "i", "j"]

    def compare(held: dict) -> set[tuple[int, int]]:
        n, part, rep = (np.array(held[c], np.int64) for c in ("n", "component", "rep"))
        if (part == part[0]).all():
            return set()
        size = min(map(len, held["bits"]))
        bits = np.frombuffer(b"".join(folded(b, size) for b in held["bits"]), np.uint64).reshape(len(n), -1)
        band, block = np.array(held["band"]), np.array(held["block"])
        step, at, i, j = (held[c][0] for c in ("step", "at", "i", "j"))
        left = np.flatnonzero((band == at) & (block == i))
        right = np.flatnonzero((band == at + step) & (block == j))
        found = set()
        for x in left.tolist():
            others = right[(part[right] != part[x]) & (n[right] * 100 >= PERCENT * n[x]) & (n[x] * 100 >= PERCENT * n[right])]
            if not len(others):
                continue
            others = others[may_link(bits[x], bits[others], n[x], n[others])].tolist()
            if alone:
                found.update((rep[y], rep[y]) for y in (others and [x, *others]))
                continue
            for y in others:
                if part[y] == part[x]:
                    continue
                if exact:
                    if not similar(held["hashes"][x], held["hashes"][y]):
                        continue
                    part[part == part[y]] = part[x]
                found.add((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return found

    def work(batches):
        held: dict[str, list] = {}
        at = None
        found: set[tuple[int, int]] = set()
        for batch in batches:
            d = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "hashes"}
            if exact:
                lists_of = batch.column("hashes")
                d["hashes"] = [lists_of[k].values.to_numpy().view(np.uint64) for k in range(batch.num_rows)]
            names = list(zip(*(d[c] for c in order)))
            cut = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[cut]:
                    if at is not None and names[cut] != at:
                        found |= compare(held)
                        held = {}
                    at = names[cut]
                    for c in d:
                        held.setdefault(c, []).extend(d[c][cut:k])
                    cut = k
            if len(found) > 50_000:
                yield pair_batch(found)
                found = set()
        if held:
            found |= compare(held)
        if found:
            yield pair_batch(found)

    bound_batches(lists.sparkSession)
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy(work), "a bigint, b bigint").distinct()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays overlap enough."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def pair_batch(found: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def open_lists(members: DataFrame, named: DataFrame, done: list[DataFrame]) -> DataFrame:
    """(key, rep, n, component) of the lists in which pairs may be left to compare.

    Lists of one component are closed; so are those whose rows were all in one tile. Of
    equal lists one is enough. A list may have lost rows before, so two rows that are left
    of it need not have been neighbours, and stay open.
    """
    rows = labelled(members, "rep", named)
    for k, picks in enumerate(done):
        rows = rows.join(picks.select("rep", F.col("tile").alias(f"tile{k}")), "rep", "left")
    rows = staged(rows, "list-rows")
    whole = [F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.min("component").alias("lo"), F.max("component").alias("hi")]
    again = []
    for k in range(len(done)):
        whole += [F.min(f"tile{k}").alias(f"lo{k}"), F.max(f"tile{k}").alias(f"hi{k}"), F.count(f"tile{k}").alias(f"n{k}")]
        again.append(F.coalesce((F.col(f"n{k}") == F.col("size")) & (F.col(f"lo{k}") == F.col(f"hi{k}")), F.lit(False)))
    keys = rows.groupBy("key").agg(*whole).where("lo <> hi")
    for closed in again:
        keys = keys.where(~closed)
    keys = keys.groupBy("size", "who").agg(F.min("key").alias("key")).select("key")
    return staged(rows.join(keys, "key", "left_semi").select("key", "rep", "n", "component"), "open-lists")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text)."""
    rows = staged(signatures(docs), "shingle-sets")
    equal = ["n", "s1", "s2"]
    named = staged(rows.where("n > 0 and doc_id is not null").groupBy(*equal).agg(F.min("doc_id").alias("doc_id")), "shingle-classes")
    # Each class once, with bitmap and prefix; a repeated row comes twice, which changes no result.
    few = named.count() <= BROADCAST_IDS
    sets = rows.join(F.broadcast(named) if few else named, ["doc_id", *equal], "left_semi").withColumnRenamed("doc_id", "rep")
    order = Window.partitionBy("key").orderBy("n", "rep")
    listed = sets.select(F.explode("keys").alias("key"), "rep", F.col("n").cast("int").alias("n"))
    listed = listed.select("key", "rep", "n", F.lag("rep").over(order).alias("before"), F.lag("n").over(order).alias("n_before"), F.lead("rep").over(order).alias("after"), F.lag("rep", 2).over(order).alias("before_2"), F.lead("rep", 2).over(order).alias("after_2"))
    longer = "before_2 is not null or after_2 is not null or (before is not null and after is not null)"
    listed = listed.withColumn("longer", F.expr(longer)).drop("before_2", "after_2")
    listed = staged(listed.where("before is not null or after is not null"), "shared-keys")
    near = listed.where((F.col("n_before") * 100 >= F.col("n") * PERCENT) & (F.col("rep") != F.col("before")))
    pairs = staged(near.select(F.least("rep", "before").alias("a"), F.greatest("rep", "before").alias("b")).distinct(), "near-pairs")
    bits = staged(sets.select("rep", "n", "bits").distinct(), "class-bitmaps")
    links = verified(staged(bounded(pairs, bits), "pairs"), docs)
    # The two rows of a whole list were neighbours: nothing is left to compare in it.
    members = listed.where("longer").select("key", "rep", F.col("n").cast("bigint").alias("n")).distinct()
    bits = bits.select("rep", "bits")
    joined_sets = staged(components(links), "components")
    rest = open_lists(members, joined_sets, [])
    # A class whose bitmap leaves no pair to another component will never have one: components only grow.
    some = staged(tiles(rest, bits, alone=True).select(F.col("a").alias("rep")), "open-classes")
    few = some.count()
    members = staged(members.join(F.broadcast(some) if few <= BROADCAST_IDS else some, "rep", "left_semi"), "open-members")
    done: list[DataFrame] = []
    for _ in range(OWN_TILES if few else 0):
        rest = open_lists(members, joined_sets, done)
        if rest.isEmpty():
            break
        size = rest.groupBy("key").agg(F.count("*").alias("size"))
        picks = rest.join(size, "key").groupBy("rep", "n", "component").agg(F.max(F.struct("size", "key"))["key"].alias("key"))
        picks = staged(picks, "own-tiles")
        done.append(picks.select("rep", F.col("key").alias("tile")))
        arrays = arrays_of(docs, picks.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
        links = staged(tiles(picks, bits, arrays), "links")
        joined_sets = joined(joined_sets, links)
    if few:
        rest = open_lists(members, joined_sets, done)
        if not rest.isEmpty():
            joined_sets = joined(joined_sets, verified(staged(tiles(rest, bits), "pairs"), docs))
    named = labelled(named.withColumnRenamed("doc_id", "rep"), "rep", joined_sets).select(*equal, "component")
    return rows.join(named, equal, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component; rows without words all stay."""
    gone = classes(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = staged(gone, "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
