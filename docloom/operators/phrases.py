"""Lines of a document that no other line of it says again."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of a phrase, and of the words that it is looked up by, at least.
LEAST_PHRASE, LEAST_WORD = 30, 4


def words_of(line: str) -> set[str]:
    """Its words that count."""
    return {w for w in line.split(" ") if len(w) >= LEAST_WORD}


def single_lines(texts: list[str]) -> list[int]:
    """Numbers of the lines that are phrases with a single hit; lines of one number in several texts are one place.

    A phrase is looked for in the places that have its rarest word, the first of these in the
    order of code points. It is in its own line; so it has another hit if there is a copy of
    that line, or a longer line in one of these places that contains it.
    """
    lines: dict[int, list[str]] = defaultdict(list)
    for text in texts:
        for place, line in enumerate(text.split("\n")):
            lines[place].append(line)
    words = {place: words_of(own[0]) if len(own) == 1 else set().union(*map(words_of, own)) for place, own in lines.items()}
    often = Counter(chain.from_iterable(words.values()))
    copies = Counter(chain.from_iterable(lines.values()))
    asked = []
    for place, own in lines.items():
        ranked = []
        for line in own:
            has = words[place] if len(own) == 1 else words_of(line)
            if has and len(line) >= LEAST_PHRASE:
                least = min(map(often.__getitem__, has))
                ranked.append((least, min(w for w in has if often[w] == least), line))
        if ranked:
            asked.append((place, *min(ranked)))
    # A word of one place is at home there; of the others, only those that are asked for are looked up.
    common = {word for _, least, word, _ in asked if least > 1}
    holds: dict[str, list[str]] = defaultdict(list)
    for place, own in words.items() if common else ():
        for word in own & common:
            holds[word] += lines[place]
    return [
        place
        for place, least, word, phrase in asked
        if copies[phrase] == 1 and not any(len(line) > len(phrase) and phrase in line for line in (lines[place] if least == 1 else holds[word]))
    ]


def single_hits(documents: DataFrame) -> DataFrame:
    """(doc_id, phrase_id, line_no) of the phrases of documents(doc_id, text) with a single hit in their own document.

    A document is one row and its words don't move. Where an id is repeated, its texts are
    one document and come together first; of two phrases in one place with the same rarest
    word, which the SQL leaves open, the first by code points is looked for.
    """
    known = documents.where("doc_id is not null and text is not null")
    if documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():  # reads ids only
        rows = known.select("doc_id", F.array("text").alias("texts"))
    else:
        rows = known.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    schema = T.StructType([documents.schema["doc_id"], T.StructField("phrase_id", T.LongType()), T.StructField("line_no", T.LongType())])
    arrow = to_arrow_schema(schema)

    def work(batches):
        for batch in batches:
            found = [single_lines(texts.as_py()) for texts in batch.column("texts")]
            places = pa.array(chain.from_iterable(found), pa.int64())
            owner = pa.array([k for k, own in enumerate(found) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), places, places], schema=arrow)

    return rows.mapInArrow(work, schema)
