"""Patterns of legal references, for the regular expressions of the JVM.

Fixed values: court codes, reporters, statute series and cue words must be these for equal
results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

COURTS = "SCC|FCA|FC|TCC|CMAC|BCCA|BCSC|BCPC|ABCA|ABQB|ABKB|ABPC|SKCA|SKQB|SKKB|SKPC|MBCA|MBQB|ONCA|ONSC|ONCJ|QCCA|QCCS|QCCQ|NBCA|NBQB|NSSC|NSCA|PECA|PESC|NLCA|NLSC|YKCA|YKSC|NWTCA|NWTSC|NUCA|NUCJ"
REPORTERS = (
    r"S\.?\s*C\.?\s*R\.?|D\.?\s*L\.?\s*R\.?|C\.?\s*C\.?\s*C\.?|O\.?\s*R\.?|W\.?\s*W\.?\s*R\.?|C\.?\s*R\.?|All\s+E\.?\s*R\.?|A\.?\s*C\.?|K\.?\s*B\.?|Q\.?\s*B\.?|Q\.?\s*B\.?\s*D\.?"
    r"|Ch(?:\s+D)?\.?|App\s+Cas|W\.?\s*L\.?\s*R\.?|E\.?\s*R\.?|T\.?\s*L\.?\s*R\.?|Cox\s+C\.?\s*C\.?|Cr\s+App\s+R\.?|Ex\.?|Eq\.?|H\.?\s*L\.?\s*Cas\.?"
)
STATUTES = "RSC|RSO|RSA|RSBC|RSM|RSNB|RSNS|RSPEI|CQLR|CCSM|SC|SO|SA|SBC|SM|SNB|SNS|SS|SY|SNWT|SNu|RLRQ"
YEAR = r"(?:17|18|19|20)\d{2}"
CUE = (
    r"(?Ui)\b(?:ibid|id\.?|ibidem|supra|infra|op\s+cit|note|notes|para\.?|paras\.?|paragraphs?|pp?\.?|pages?|ss?\.?|secs?\.?|sections?|art\.?|arts\.?|at|see|cf\.?|e\.?g\.?|accord|contra"
    rf"|R\.?\s*v\.?|Rex|Regina|v\.?|vs\.?|CanLII|SCC|SCR|DLR|(?:{COURTS})|(?:{REPORTERS}))\b|\[{YEAR}\]|\({YEAR}\)"
)
CONTINUATION = rf"(?Ui)^\s*(?:{REPORTERS}|U\.?\s*T\.?\s*L\.?|A\.?\s*L\.?\s*R\.?|N\.?\s*R\.?|S\.?\s*E\.?|N\.?\s*E\.?|P\.?\s*\d+d)\b"
#: Spans that no reader of note marks may take apart: reporters with volume and page, neutral citations, statutes, journals, pinpoints.
#: What must stand before and after a span is looked at and left out of it.
PROTECTED = (
    rf"(?Ui)(?:\[{YEAR}\]\s+(?:\d{{1,4}}\s+)?(?:{REPORTERS})\s+\d{{1,4}}|\({YEAR}\)\s+\d{{1,4}}\s+(?:{REPORTERS})\s+\d{{1,4}}|\b\d{{1,4}}\s+(?:{REPORTERS})\s*(?:\(\d{{1,4}}[a-z]{{0,2}}\))?\s+\d{{1,4}})(?=\D|\z)",
    rf"(?Ui)\b{YEAR}\s+(?:CanLII\s+\d{{1,4}}|(?:{COURTS})\s+\d{{1,4}})\b",
    rf"(?Ui)\b(?:{STATUTES})\s+{YEAR},?\s+c(?:h)?\.?\s+[A-Z0-9][A-Z0-9.\-]*",
    rf"(?U)\({YEAR}\)\s+\d{{1,4}}(?::\d{{1,4}})?\s+[A-Z][A-Za-z&.'\-\s]{{2,60}}\s+\d{{1,4}}\b",
    r"(?Ui)(?<![A-Za-z0-9])(?:at\s+|pp?\.?\s+|pages?\s+|paras?\.?\s+|ss?\.?\s+)\d{1,4}[A-Za-z]?(?:\.\d{1,4})?(?:\s*(?:,|and|-|to|–)\s*\d{1,4}[A-Za-z]?(?:\.\d{1,4})?)*(?=\D|\z)",
)
NAMES = r"[A-Z][A-Za-z'.\-]+(?:\s+(?:[A-Z][A-Za-z'.\-]+|of|and|the|for|to|du|de|des|la|le)){0,6}"
#: Signs of a reference: any one is enough.
SIGNALS = (
    rf"(?U)\b\d{{4}}\s+(?:CanLII\s+\d+|(?:{COURTS})\s+\d+)\b",
    r"(?Ui)\[\d{4}\]\s+\d+\s+S\.?\s*C\.?\s*R\.?\s+\d+\b",
    rf"(?Ui)(?:\[\d{{4}}\]\s+(?:\d+\s+)?(?:{REPORTERS})\s+\d+|\(\d{{4}}\)\s+\d+\s+(?:{REPORTERS})\s+\d+|\b\d+\s+(?:{REPORTERS})\s*(?:\(\d+[a-z]{{0,2}}\))?\s+\d+)",
    rf"(?U)\b{NAMES}\s+(?i:v(?:s)?\.?)\s+{NAMES}\b",
    rf"(?Ui)\b(?:{STATUTES})\s+\d{{4}},?\s+c(?:h)?\.?\s+[A-Z0-9][A-Z0-9.\-]*",
    r"(?Ui)(?<![A-Za-z0-9])(?:s|ss|sec|secs|section|sections|silcrow|§+)\.?\s+\d+",
    r"(?Ui)(?<![A-Za-z0-9])(?:paras?|paragraphs?|pilcrow|¶)\.?\s+\d+",
    r"(?Ui)(?<![A-Za-z0-9])(?:at\s+|à\s+la\s+|aux\s+)(?:p{1,2}|pages?)\.?\s+\d{1,4}[A-Za-z]?(?:\.\d{1,4})?(?:\s*(?:,|and|et|-|to|à|–)\s*\d{1,4}[A-Za-z]?(?:\.\d{1,4})?)*(?:\D|\z)",
    r"(?Ui)\b(?:supra\s+(?:note|n\.?|nn\.?)\s+\d+|ibid(?:em)?\.?)(?:\W|\z)",
    r"(?U)\(\d{4}\)\s+\d+(?::\d+)?\s+[A-Z][A-Za-z&.\-\s]{2,45}\s+\d+\b",
)
VISUAL = r"(?Ui)\b(?:diagram|figure|chart|table|graph|map|illustration|image|photo)"


def has_cue(text: Column) -> Column:
    """Whether a text has a cue of a legal reference."""
    return F.regexp_like(text, F.lit(CUE))


def continues(text: Column) -> Column:
    """Whether a text begins as the rest of a reference does."""
    return F.regexp_like(text, F.lit(CONTINUATION))


def protected_spans(lines: DataFrame, key: tuple[str, ...] = ("doc_id", "line")) -> DataFrame:
    """(key, pattern, start_at, end_at): the spans of each of the PROTECTED patterns, by its number, in lines(key, text).

    Matches and the pieces between them give the offsets. A null text has no spans; keys should be unique.
    """
    rows = lines.where(F.regexp_like("text", F.lit(r"(?U)\d")))
    one = []
    for number, pattern in enumerate(PROTECTED):
        found = rows.select(*key, F.lit(number).alias("pattern"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"), F.split("text", pattern, -1).alias("between"))
        one.append(found.where(F.size("hit") > 0).select(*key, "pattern", F.posexplode(F.arrays_zip("between", "hit")).alias("n", "part")))
    parts = one[0]
    for more in one[1:]:
        parts = parts.unionByName(more)
    ends = F.sum(F.length("part.between") + F.coalesce(F.length("part.hit"), F.lit(0))).over(Window.partitionBy(*key, "pattern").orderBy("n")).cast("bigint")
    rows = parts.withColumn("end_at", ends).where("part.hit is not null")
    return rows.select(*key, "pattern", (F.col("end_at") - F.length("part.hit")).alias("start_at"), "end_at")


def merged_spans(spans: DataFrame, key: tuple[str, ...] = ("doc_id", "line")) -> DataFrame:
    """(key, start_at, end_at): spans that overlap or touch as one."""
    along = Window.partitionBy(*key).orderBy("start_at", "end_at")
    reach = F.max("end_at").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("opens", F.coalesce((F.col("start_at") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*key, "island").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).drop("island")


def reporter_pattern(abbreviation: str) -> str:
    """How an abbreviation of a reporter may be written: capitals with or without dots and spaces, signs with any space."""
    signs = {"&": r"\s*&\s*", "-": r"\s*[-/]\s*", "/": r"\s*[-/]\s*", "'": "['’]", "’": "['’]", ".": r"\.?"}
    out = []
    for token in re.findall(r"\s+|\([^)]*\)?|[^\W_]+|.", abbreviation, re.DOTALL):
        if token.isspace():
            out.append(r"\s+")
        elif token.startswith("("):
            out.append(r"\(\s*" + r"\s+".join(map(re.escape, token.strip("()").split(" "))) + r"\s*\)")
        elif len(token) > 1 and token.isupper() and token.isalpha():
            out.append(r"\s*".join(rf"{re.escape(c)}\.?" for c in token))
        else:
            out.append(signs.get(token, re.escape(token)))
    return "".join(out)


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Characters in their compatible form (NFKC)."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def has_signal(text: Column, reporters: Sequence[str] = ()) -> Column:
    """Whether a text has a sign of a reference; ``reporters`` adds abbreviations to those of the patterns. Null for a null text."""
    marks = {"'": "‘’‚‛", '"': "“”„", "-": "‐‑‒–—", " ": " "}
    plain = F.translate(compatible(text), "".join(marks.values()) + "﻿", "".join(to * len(of) for to, of in marks.items()))
    found = F.lit(False)
    for pattern in SIGNALS:
        found = found | F.regexp_like(plain, F.lit(pattern))
    if reporters:
        names = "|".join(map(reporter_pattern, reporters))
        cited = rf"(?U)(?:\[\d{{4}}\]\s+(?:\d+\s+)?(?:{names})\s+\d+|\(\d{{4}}\)\s+\d+\s+(?:{names})\s+\d+|\b\d+\s+(?:{names})\s*(?:\(\d+[A-Za-z]{{0,3}}\))?\s+\d+)"
        found = found | F.regexp_like(plain, F.lit(cited))
    return found
