"""Phrases with a single hit against the SQL in DuckDB."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docloom.operators import phrases
from docloom.plans.registry import ORACLES, QUERIES

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
WORDS = ["alpha", "betas", "gamma", "delta", "éclair", "日本語文", "😀😀😀😀", "ab", "the", "x", "", "word1", "word12", "alphab", "Alpha", "longerword"]


def made(random_lines):
    """Lines of few words; some are copies, parts or extensions of earlier ones."""
    lines = []
    for _ in range(random_lines):
        k, line = random.random(), random.choice(lines or [""])
        a = random.randrange(len(line) + 1)
        few = WORDS[: random.choice([4, len(WORDS)])]
        if k < 0.5:
            line = " ".join(random.choice(few) for _ in range(random.randrange(12)))
        elif k < 0.7:
            line = line[a : random.randint(a, len(line))]
        elif k < 0.9:
            line = random.choice(["x", " ", "pre ", ""]) + line + random.choice(["x", " ", " post", ""])
        lines.append(line)
    return "\n".join(lines)


def both(spark, folder, documents):
    """Rows of the query and of its SQL."""
    pq.write_table(pa.Table.from_pylist([dict(zip(DOCUMENTS.names, d)) for d in documents], DOCUMENTS), folder / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got = QUERIES["join_phrase"](spark, str(folder))
    assert dict(got.dtypes) == {"doc_id": "bigint", "phrase_id": "bigint", "line_no": "bigint"}
    return got, sorted(map(tuple, got.collect())), sorted(con.execute(ORACLES["join_phrase"]).fetchall())


def test_equals_sql_without_moving_words(spark, tmp_path):
    random.seed(11)
    got, rows, want = both(spark, tmp_path, [*((n, made(random.choice([0, 1, 3, 12, 40]))) for n in range(300)), (None, "alpha betas gamma delta alpha betas"), (900, None), (901, ""), (902, " " * 40)])
    assert rows == want and len(want) > 500
    # Joins of all words dealt out each line with each of its words: over four times the documents on disk.
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_repeated_ids_are_one_document(spark, tmp_path):
    one, two = "alpha betas gamma delta only in the first", "alpha betas gamma delta other in a second"
    texts = [(1, f"{one}\nlead\n{two}"), (1, f"head\nlead\n{two}\n{one} and more"), (2, f"{one}\nlead"), (2, f"short\n{two}"), (3, one), (3, one), (4, one), (None, one), (None, one)]
    _, rows, want = both(spark, tmp_path, texts)
    assert rows == want == [(1, 3, 3), (2, 0, 0), (2, 1, 1), (4, 0, 0)]


@pytest.mark.parametrize(
    ("lines", "single"),
    [
        (["alpha betas gamma delta alpha", "alpha betas gamma delta alpha"], []),  # under 30 characters
        (["alpha betas gamma delta alpha betas", "alpha betas gamma delta alpha betas"], []),
        (["alpha betas gamma delta alpha betas", "so alpha betas gamma delta alpha betas"], [1]),
        (["alpha alpha alpha alpha alpha rare", "alpha alpha alpha alpha alpha rarely"], [0, 1]),  # its rarest word is not there
        (["a b c d e f g h i j k l m n o p q r s t"], []),  # no word to look it up by
    ],
)
def test_single_lines(lines, single):
    assert phrases.single_lines(["\n".join(lines)]) == single
