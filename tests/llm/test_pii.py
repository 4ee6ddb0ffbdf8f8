"""The span model of personal data beside its base patterns: what they miss, and what is no entity."""

import re

from docloom.llm import disguise, pii


def case(text):
    return [(text[a:b], w) for a, b, w, _, _ in pii.islands(text)]


def test_islands_hold_triggers_and_their_line():
    text = "one two three four 12 five six seven eight\nnine anna at mail.example.org ten"
    assert case(text) == [("two three four 12 five six seven", "one"), ("nine anna at mail.example.org ten", "eight")]
    assert case("") == case("no trigger at all, and the end") == []
    assert case("a [at] b") == [("a [at] b", "")]


def test_long_islands_come_in_pieces_that_own_each_place_once():
    text = " ".join(str(k) for k in range(3000))
    pieces = pii.islands(text)
    assert len(pieces) > 10 and all(len(text[a:b].split()) <= pii.PIECE + 2 * pii.MARGIN for a, b, *_ in pieces)
    assert " ".join(text[x:y] for *_, x, y in pieces) == text


def test_a_very_long_token_is_no_candidate():
    text = "a" * 300_000 + "1" + " 12"
    for a, b, w, _, _ in pii.islands(text):
        assert all(span[1] - span[0] <= 320 for own in pii.Island(text[a:b], w).segments.values() for _, span, _ in own)


def test_variants_hide_entities_from_the_patterns():
    text = "write to anna.lee@mail.example.org or +1 (337) 555-7349 now"
    spans = pii.base_spans(text)
    made = disguise.variants(text, spans, 20, pii.base_spans)
    assert made == disguise.variants(text, spans, 20, pii.base_spans) and len(made) > 20
    lost = kept = 0
    for new, own in made:
        base = set(pii.base_spans(new))
        hidden = [s for s in own if s not in base]
        kept += len(hidden)
        lost += len(own) < len(spans)
        assert len(hidden) <= 1 and all(re.search("[0-9a-z]", new[a]) or new[a] == "(" for a, _, b in hidden)
    assert lost and kept


def test_model_finds_what_the_patterns_miss(spark):
    """Held-out texts with planted entities in other forms, and decoys in the same places."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.fit(pii.scan(docs.where("doc_id % 2 = 0")))
    found = planted = quiet = decoys = 0
    for row in docs.where("doc_id % 2 = 1 and doc_id < 6000").collect():
        text = row.text or ""
        spans = pii.base_spans(text)
        for new, own in disguise.variants(text, spans, 1, pii.base_spans) if len(text) < 20_000 else ():
            base = set(pii.base_spans(new))
            got = {(a + s, k, a + e) for a, b, w, _, _ in pii.islands(new) for s, k, e in model.sure(pii.Island(new[a:b], w))}
            hidden = set(own) - base
            planted += len(hidden)
            found += len(hidden & got)
            if not hidden:
                decoys += 1
                quiet += not got - base
    print(f"planted {planted}, found by patterns 0, by the model {found}; decoys {decoys}, left alone {quiet}")
    assert planted > 80 and found >= 0.85 * planted and quiet >= 0.95 * decoys
