"""Citation text in notes: typed anchors, and notes split into their parts.

The patterns are written from public citation forms; they don't claim to equal any
other inventory.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Kinds of anchors and their patterns.
ANCHORS = {
    "neutral": r"\[?(?:1[89]|20)\d\d\]? [A-Z]{2,8} \d{1,5}",
    "reporter": r"\d{1,4} [A-Z][A-Za-z.]{1,12} (?:\(\d[a-z]{1,2}\) )?\d{1,5}",
    "statute": r"(?:RSC|SC|USC|SO|RSO) \d{4},? c [A-Z0-9-]+",
    "cross": r"(?:supra|infra) note \d+",
    "ibid": r"\bibid\b",
    "pinpoint": r"\bat (?:para|paras|p|pp)?\.? ?\d+(?:-\d+)?",
}
PATTERNS = {k: re.compile(p, re.IGNORECASE if k in ("cross", "ibid") else 0) for k, p in ANCHORS.items()}


def anchors(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), overlaps resolved by the longest."""
    found = sorted((m.start(), -m.end(), k) for k, p in PATTERNS.items() for m in p.finditer(text))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if out and a < out[-1][1]:
            if -b - a > out[-1][1] - out[-1][0]:
                out[-1] = (a, -b, kind)
        else:
            out.append((a, -b, kind))
    return out


def split_note(text: str) -> list[tuple[int, int]]:
    """Parts of a note between semicolons outside of quotes and brackets; parts and semicolons rebuild the text."""
    cuts, depth, quoted = [], 0, False
    for k, c in enumerate(text):
        if c in "“”\"":
            quoted = c == "“" or (c == '"' and not quoted)
        elif not quoted:
            depth = max(0, depth + (c in "([") - (c in ")]"))
            if c == ";" and not depth:
                cuts.append(k)
    return list(zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)]))


#: Types as objects: this module is imported before there is a session.
SPAN = T.StructType().add("start", "integer").add("end", "integer")
ANCHOR = T.StructType().add("start", "integer").add("end", "integer").add("kind", "string")


@F.pandas_udf(T.ArrayType(ANCHOR))
def anchors_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in anchors(t or "")])


@F.pandas_udf(T.ArrayType(SPAN))
def parts_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b} for a, b in split_note(t or "")])


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, soft hyphens joined, white space collapsed."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", re.sub("­\\s*", "", t)).split()))


def note_parts(notes: DataFrame, text: Column) -> DataFrame:
    """One row for each part of a note, with its kinds of anchors."""
    rows = notes.withColumn("_text", text).withColumn("_part", F.explode(parts_of("_text")))
    part = F.trim(F.substring("_text", F.col("_part.start") + 1, F.col("_part.end") - F.col("_part.start")))
    rows = rows.withColumn("part", part).withColumn("kinds", F.array_join(F.transform(anchors_of("part"), lambda a: a["kind"]), ","))
    return rows.drop("_text", "_part")
