"""Sentences at offsets against a plain loop over characters."""

import random
import re

from docloom.operators import passages


def plain(text, offset):
    marks, k = [], 0
    while k < len(text):
        start = k
        k += 1
        if text[start] in ".?!":
            while k < len(text) and text[k] in "\"'”’)]":
                k += 1
            if k == len(text) or text[k].isspace() or text.startswith("⟦FN:", k):
                marks.append((start, k))
    before = [0] + [stop for _, stop in marks if stop <= offset]
    if len(before) > 1 and not text[before[-1] : offset].strip():
        low, high = before[-2:]
    else:
        low, high = before[-1], next((stop for start, stop in marks if start >= offset), len(text))
    return re.sub(passages.MARKER, "", text[low:high]).strip()


def test_sentences_at(spark):
    random.seed(5)
    texts = ["One. Two two!” Three⟦FN:3⟧ (four.)⟦FN:4⟧ Five v. Six", "", ". A", "a.b.c", "no end", "x.  y?\n", "😀. 😀!"]
    texts += ["".join(random.choice(["a", "b", " ", ".", "!", ")", "\n", "⟦FN:1⟧", "é"]) for _ in range(random.randrange(60))) for _ in range(60)]
    asked = [(n, k) for n, t in enumerate(texts) for k in range(len(t) + 3)]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (None, "a. b")], "text_id bigint, text string")
    offsets = spark.createDataFrame([*asked, asked[0], (900, 0), (901, 0), (0, -1), (0, None)], "text_id bigint, offset bigint")
    got = passages.sentences_at(df, offsets).collect()
    assert len(got) == len(asked)
    assert {(r.text_id, r.offset): r.sentence for r in got} == {(n, k): plain(texts[n], k) for n, k in asked}
