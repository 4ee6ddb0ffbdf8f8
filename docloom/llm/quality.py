"""Line-first quality rules: clean by lines, then judge what is left of the document.

Each line is tested for punctuation (symbols in place of prose), navigation (menus of
short items between separators), shouting, and boilerplate (fixed phrases, lines seen
before in the same text). Failing lines are removed; a document that loses more than
``MAX_LOST`` of its word characters is rejected, as is one that fails the base rules.

Null and edge cases: a null text is the empty text (no words, base rules fail it);
blank lines always stay; repeated rows are judged alike; an empty table gives an empty
result; other columns are kept by ``clean``. Texts of any length are read whole; the
work per text is linear in its length.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docloom.llm.arrow import map_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: A line fails on this share of symbols to words, of separators to words, of capital to all letters.
SYMBOL_SHARE, SEPARATOR_SHARE, CAPITAL_SHARE = 0.5, 0.3, 0.7
MAX_LOST = 0.3
#: Phrases of site furniture.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "sign in to continue",
    "subscribe to our newsletter",
    "enable javascript",
    "click here to",
)
PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
MARKS = re.compile(r"[#*$%&<>!]")
SEPARATORS = re.compile(r"[|»›•]")


def repeated_words(words: list[str]) -> int:
    """Words inside a window of five words that occurs twice or more, the first included."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered = upto = 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + WINDOW - max(at, upto)
            upto = at + WINDOW
    return covered


def line_fault(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words fails."""
    if len(MARKS.findall(line)) >= max(2, SYMBOL_SHARE * len(words)):
        return "punctuation"
    if len(SEPARATORS.findall(line)) >= max(2, SEPARATOR_SHARE * len(words)):
        return "navigation"
    if len(words) >= 4:
        letters = sum(map(str.isalpha, line))
        if letters and sum(map(str.isupper, line)) >= CAPITAL_SHARE * letters:
            return "shouting"
    if PHRASE.search(line):
        return "boilerplate"
    return None


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, cleaned)."""
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    seen: set[str] = set()
    left, duplicates, lost = [], 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            again = line in seen
            duplicates += again
            seen.add(line)
            if again or line_fault(line, own):
                lost += sum(map(len, own))
                continue
        left.append(line)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * len(words)
    kept = not failed and lost <= MAX_LOST * chars
    return len(words), chars, symbols, duplicates, repeats, failed, kept, lost, "\n".join(left)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "cleaned")
SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_chars bigint, cleaned string"


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cleaned: bool = True) -> DataFrame:
    """The columns ``keep`` and the verdict of every row; ``cleaned`` adds the text without failing lines."""
    names = NAMES if cleaned else NAMES[:-1]

    def run(batch: pa.RecordBatch) -> dict:
        rows = [judge(t)[: len(names)] for t in batch.column(len(keep)).to_pylist()]
        return dict(zip(names, zip(*rows)))

    schema = SCHEMA if cleaned else SCHEMA.rpartition(",")[0]
    return map_columns(docs.select(*keep, text), run, keep, schema)


def clean(docs: DataFrame) -> DataFrame:
    """The rows of documents that are kept, their text without the failing lines; n_chars follows if there."""
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = columns.index("text")
    rest = tuple(c for i, c in enumerate(inner.columns) if i != at)
    done = measure(inner, keep=rest, text=f"c{at}").where("kept").withColumnRenamed("cleaned", f"c{at}")
    out = done.select(*inner.columns).toDF(*columns)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
