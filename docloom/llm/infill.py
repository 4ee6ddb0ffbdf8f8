"""Fill-in-the-middle: texts cut into prefix, middle and suffix at seeded places between units.

An Arrow-batched pandas UDF walks each whole text once. The regex library's ``finditer``
yields units side by side, and their end offsets go into one compact array; each of the two
cuts is a lookup in that array. ``hashlib`` gives the seed of a row and the digests. Rows
are independent, so nothing is shuffled and a lost executor costs its own tasks only.

A row's seed is SHA-256 of ``<version>:<decimal id>``; its first four groups of eight hex
digits are the draws h1 to h4. With n units, the prefix ends after the smaller of h1 % (n + 1)
and h2 % (n + 1) units, the middle after the larger. A text is left as it is ("plain") if it
is empty, holds one of the marks, or h3 % 100 reaches ``rate``; else its parts change places,
in the order suffix-prefix-middle ("spm") if h4 % 100 is below ``spm_rate``, or
prefix-suffix-middle ("psm").

Null and edge cases: a null text is the empty text, plain, of no units; a null id has an
empty decimal form; text between units (or none at all matching) stays with the part before
the next unit's end, and what follows the last unit belongs to the last part; repeated rows
give repeated results, equal texts of different ids different cuts; an empty table gives an
empty result; columns of the names that are made here are replaced, all others kept if asked
for. An array of offsets takes four bytes a unit; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from docloom.llm.arrow import bound_batches

#: The marks of the output format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
CODE_POINT = r"(?s:.)"
WORD = r"\S+\s*"
LINE = r"[^\n]*\n|[^\n]+"
VERSION, RATE, SPM_RATE = "1", 90, 20
#: Units that one match of the pattern takes side by side; each is a capture of its own.
ABREAST = 256

DIGESTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def side_by_side(unit: str) -> regex.Pattern:
    """Units one after another, each atomic, so that they are those of ``finditer(unit)``. Groups of ``unit`` need names."""
    return regex.compile(rf"(?:(?>({unit}))){{1,{ABREAST}}}+")


def unit_ends(units: regex.Pattern, text: str) -> array:
    """The end offset of every unit of the text, from left to right."""
    ends = array("I")
    for found in units.finditer(text):
        ends.extend(found.ends(1))
    return ends


def draws(seed: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from a row's seed."""
    digest = hashlib.sha256(seed.encode()).hexdigest()
    return tuple(int(digest[at : at + 8], 16) for at in (0, 8, 16, 24))


def arranged(text: str, ends: array, h: tuple[int, ...], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int | None, int | None, str]:
    """(form, code points of the prefix, of the middle, output) of a text."""
    if not text or h[2] % 100 >= rate or any(mark in text for mark in MARKS):
        return "plain", None, None, text
    first, last = sorted(x % (len(ends) + 1) for x in h[:2])
    # No unit before a cut: it is at the start; all units before it: at the end of the text.
    a, b = (len(text) if k == len(ends) and k else ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text again, from an output and its form."""
    if form == "plain":
        return output
    head, rest = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, more = output.removeprefix(head).partition(rest)
    two, _, middle = more.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def transformer(unit: str, rate: int, spm_rate: int, texts: bool):
    """The pandas UDF of (seed, text): a struct of DIGESTS, and of the output where ``texts`` asks for it."""
    names = [field.split()[0] for field in DIGESTS.split(", ")]

    @F.pandas_udf(DIGESTS + ", output string" * texts)
    def transform(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = side_by_side(unit)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for seeds, bodies in batches:
            rows = []
            for seed, text in zip(seeds, bodies):
                ends = unit_ends(units, text)
                form, prefix, middle, output = arranged(text, ends, draws(seed), rate, spm_rate)
                rows.append((len(ends), form, prefix, middle, sha(output), sha(restore(output, form)), output)[: len(names) + texts])
            made = pd.DataFrame(rows, columns=names + ["output"] * texts)
            yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return transform


def fill_in_middle(
    docs: DataFrame,
    unit: str = CODE_POINT,
    version: str = VERSION,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    keep: tuple[str, ...] = ("doc_id",),
    texts: bool = True,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
) -> DataFrame:
    """docs' columns ``keep`` with n, form, prefix_chars, middle_chars, both digests and (``texts``) the output."""
    bound_batches(docs.sparkSession)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    seed = F.concat(F.lit(f"{version}:"), F.coalesce(column(doc_id).cast("string"), F.lit("")))
    made = transformer(unit, rate, spm_rate, texts)(seed, F.coalesce(column(text), F.lit("")))
    names = [field.split()[0] for field in DIGESTS.split(", ")] + ["output"] * texts
    kept = [c for c in keep if c not in names]
    inner = docs.select(*kept, made.alias("_infill"))
    return inner.select(*kept, *(F.col("_infill")[c].alias(c) for c in names))
