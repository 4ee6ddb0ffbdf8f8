"""Byte-level BPE encoding and decoding with DuckDB's recursive queries inside Spark tasks.

A task splits its texts by the tokenizer's pattern. The distinct pieces that are not a
token themselves become token-position rows of a DuckDB table; a recursive query joins
neighbours to the merge table, contracts the leftmost pair of least rank in each piece
and goes on until no piece has a pair. Decoding joins the token-position rows of whole
texts to the vocabulary and aggregates each text's bytes in order.

Vocabularies are read from a path that is a parameter, once in each Python worker, and
pieces that a worker has met are kept there: ``CACHE`` of them that were met last, and as
many of before; tasks of other operators let go of all that. A step of the query for pieces of more than ``LONG`` bytes contracts all
pairs of least rank in a piece, the leftmost first, where the new token forms no pair of a
lower rank with any other, so that one at a time would do the same.

Null and edge cases: a null text is the empty text and has no ids; null ids decode to
null; ids outside the vocabulary decode to nothing; texts of any length are read whole; equal
texts get equal ids; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import base64
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm.arrow import kept, map_columns

CACHE, LONG = 250_000, 1000
#: Rows of DuckDB's tables are bounded: pieces of one recursive query, ids of one decoding query (or one text's).
PIECES_AT_ONCE, IDS_AT_ONCE = 20_000, 150_000
DUCKDB = {"threads": 1, "memory_limit": "160MB", "preserve_insertion_order": False}
#: Texts below this code point are split by an equal pattern of explicit ranges, for speed.
PLAIN_BELOW = 0x250

#: wp holds the piece's number and the token's place in it.
ENCODE = """
with recursive run as (
  select false as done, wp, tok from start
  union all
  (with pair as (
     select l.wp, l.tok, m.c
     from (select wp, tok from run where not done) l
     left join run r on r.wp = l.wp + 1
     left join merges m on m.ab = (l.tok << 20) | r.tok),
   least_pair as (
     select wp >> 24 as w, min((c << 24) | (wp & 16777215)) as best from pair group by 1)
  select best is null,
         case when (p.wp & 16777215) > (best & 16777215) then p.wp - 1 else p.wp end,
         case when (p.wp & 16777215) = (best & 16777215) then p.c else p.tok end
  from pair p join least_pair on w = p.wp >> 24
  where best is null or (p.wp & 16777215) <> (best & 16777215) + 1)
)
select wp >> 24 as w, list(tok order by wp) as ids from run where done group by 1
"""

#: Places keep their numbers here; ``lone`` says that a token may form a pair of lower rank, so that only one pair goes a step.
ENCODE_LONG = """
with recursive run as (
  select false as done, wp, tok from start
  union all
  (with pair as (
     select n.wp, n.tok, m.c, m.lone
     from (select wp, tok, lead(tok) over (partition by wp >> 24 order by wp) as behind from run where not done) n
     left join merges m on m.ab = (n.tok << 20) | n.behind),
   least_pair as (select wp >> 24 as w, min((c << 24) | (wp & 16777215)) as best from pair group by 1),
   hit as (
     select p.wp, p.tok, p.c, best is null as done,
            coalesce(p.c = best >> 24 and (not p.lone or (p.wp & 16777215) = (best & 16777215)), false) as found,
            row_number() over (partition by w order by wp) as place
     from pair p join least_pair on w = p.wp >> 24),
   side as (select *, place - row_number() over (partition by wp >> 24, found order by wp) as chain from hit),
   chosen as (select *, found and row_number() over (partition by wp >> 24, found, chain order by wp) % 2 = 1 as taken from side),
   left_one as (select *, lag(taken, 1, false) over (partition by wp >> 24 order by wp) as gone from chosen)
  select done, wp, case when taken then c else tok end from left_one where not gone)
)
select wp >> 24 as w, list(tok order by wp) as ids from run where done group by 1
"""

DECODE = """
select wp >> 32 as w, string_agg(hex, '' order by wp) as hex
from rows join vocabulary using (tok) group by 1
"""


def explicit(pattern: str) -> re.Pattern | None:
    r"""The pattern with \p{L}, \p{N} and \s as ranges below PLAIN_BELOW, for texts of such characters only."""
    low = [chr(c) for c in range(PLAIN_BELOW)]
    inside = {
        r"\p{L}": "".join(c for c in low if unicodedata.category(c)[0] == "L"),
        r"\p{N}": "".join(c for c in low if unicodedata.category(c)[0] == "N"),
        r"\s": "".join(c for c in low if regex.fullmatch(r"\s", c)),
    }
    out = pattern.replace(r"\S", "[^" + re.escape(inside[r"\s"]) + "]")
    for name, chars in inside.items():
        # Inside a character class the ranges are put in as they are; elsewhere as a class.
        parts = re.split(r"(\[[^\]]*\])", out)
        chars = re.escape(chars)
        out = "".join(p.replace(name, chars) if p.startswith("[") else p.replace(name, f"[{chars}]") for p in parts)
    return None if r"\p" in out else re.compile(out)


class Codec:
    """One vocabulary in one Python worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern, self.plain = regex.compile(pattern), explicit(pattern)
        self.other = re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}]")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (self.ranks[t[:k]] << 20 | self.ranks[t[k:]], r)
            for t, r in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        ab, c = (np.array(x, np.int64) for x in zip(*pairs))
        self.con = duckdb.connect(config=DUCKDB)
        left, right = ab >> 20, ab & ((1 << 20) - 1)
        lone = np.isin(c, np.concatenate((left[c < left], right[c < right])))
        made = pa.table({"ab": ab, "c": c, "lone": lone})
        self.con.register("made", made)
        self.con.execute("create table merges as select * from made")
        words = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.con.register("words", words)
        self.con.execute("create table vocabulary as select * from words")
        self.con.unregister("made")
        self.con.unregister("words")
        self.encoded: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if self.plain is not None and not self.other.search(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the cache."""
        todo, long = [], []
        for piece in pieces:
            known = self.before.get(piece)
            if known is not None:
                self.encoded[piece] = known
                continue
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self.encoded[piece] = rank.to_bytes(4, "little")
            else:
                (long if len(data) > LONG else todo).append((piece, data))
        for at in range(0, len(todo), PIECES_AT_ONCE):
            self._recurse(todo[at : at + PIECES_AT_ONCE], ENCODE)
        for own in long:
            self._recurse([own], ENCODE_LONG)

    def _places(self, lengths: np.ndarray, bits: int) -> np.ndarray:
        w = np.repeat(np.arange(len(lengths)), lengths)
        return (w << bits) | (np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths))

    def _recurse(self, todo: list[tuple[str, bytes]], query: str) -> None:
        flat = np.frombuffer(b"".join(d for _, d in todo), np.uint8)
        places = self._places(np.array([len(d) for _, d in todo]), 24)
        self.con.register("start", pa.table({"wp": places, "tok": self.single[flat]}))
        found = self.con.sql(query).to_arrow_table().combine_chunks()
        lists = found["ids"].combine_chunks()
        ids, ends = lists.flatten().to_numpy().astype("<u4").tobytes(), lists.offsets.to_numpy() * 4
        for w, a, b in zip(found["w"].to_pylist(), ends.tolist(), ends[1:].tolist()):
            self.encoded[todo[w][0]] = ids[a:b]
        self.con.unregister("start")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        new: dict[str, str] = {}
        # Equal pieces are one string, so that the lists of all texts hold little more than references.
        split = [list(map(new.setdefault, pieces, pieces)) if t and (pieces := self.split(t)) else [] for t in texts]
        if len(self.encoded) > CACHE:
            self.before, self.encoded = self.encoded, {}
        self.learn(new.keys() - self.encoded.keys())
        return [b"".join(map(self.encoded.__getitem__, pieces)) for pieces in split]

    def decode(self, values: list[bytes | None]) -> list[bytes | None]:
        """The bytes of each sequence of ids."""
        out = [None if v is None else b"" for v in values]
        held: list[int] = []
        size = 0
        for n, value in enumerate(values):
            if value:
                held.append(n)
                size += len(value) // 4
            if held and (size >= IDS_AT_ONCE or n == len(values) - 1):
                data = [values[k] for k in held]
                ids = np.frombuffer(b"".join(data), "<u4").astype(np.int32)
                self.con.register("rows", pa.table({"wp": self._places(np.array([len(v) // 4 for v in data], np.int64), 32), "tok": ids}))
                found = self.con.sql(DECODE).to_arrow_table()
                self.con.unregister("rows")
                for w, hexes in zip(found["w"].to_pylist(), found["hex"].to_pylist()):
                    out[held[w]] = bytes.fromhex(hexes)
                held, size = [], 0
        return out


KIND = "bpe"


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec of a vocabulary."""
    codecs = kept(KIND)
    if (path, pattern) not in codecs:
        codecs[path, pattern] = Codec(path, pattern)
    return codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] | None = None, back: bool = False) -> DataFrame:
    """Adds ``ids``: the token ids of the whole text, little-endian unsigned 32-bit.

    ``back`` also adds ``decoded``, from the ids, in the same worker, which then holds the vocabulary once.
    """
    keep = tuple(docs.columns) if keep is None else keep

    def run(batch: pa.RecordBatch) -> dict:
        made = {"ids": codec(path, pattern).encode(batch.column(text).to_pylist())}
        return made | ({"decoded": codec(path, pattern).decode(made["ids"])} if back else {})

    return map_columns(docs, run, keep, "ids binary" + ", decoded binary" * back, limit=4 << 20, kind=KIND)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``decoded``: the bytes that the ids stand for."""
    keep = tuple(df.columns) if keep is None else keep

    def run(batch: pa.RecordBatch) -> dict:
        return {"decoded": codec(path, pattern).decode(batch.column(ids).to_pylist())}

    return map_columns(df, run, keep, "decoded binary", limit=16 << 20, kind=KIND)
