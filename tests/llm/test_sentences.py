"""Sentence spans against runs compared by their words, and planted passages against clean texts."""

import numpy as np

from docloom.llm import sentences


def brute_kept(texts):
    """What stays of each text when each run of sentences is compared by its words, not by hashes."""
    found = [sentences.sentences(t or "") for t in texts]
    first, cover = {}, [set() for _ in texts]

    def enough(own, a, b):
        words = sum(len(own[k][2].split()) for k in range(a, b))
        return words >= 50 or (words >= 25 and b - a >= 3)

    for doc, own in enumerate(found):
        n = len(own)
        spans = {(a, min(ends)) for a in range(n) if (ends := [b for b in range(a + 1, n + 1) if enough(own, a, b)])}
        spans |= {(max(starts), b) for b in range(1, n + 1) if (starts := [a for a in range(b) if enough(own, a, b)])}
        for a, b in sorted(spans or ({(0, n)} if n else ())):
            if first.setdefault(tuple(x[2] for x in own[a:b]), (doc, a)) != (doc, a):
                cover[doc].update(range(a, b))
    out = []
    for text, own, gone in zip(texts, found, cover):
        head = own[0][0] if own else len(text or "")
        out.append((text or "")[:head] + "".join(text[a:b] for k, (a, b, _) in enumerate(own) if k not in gone))
    return out


def test_kept_text_equals_brute_force_planted_passages_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(4)
    own = lambda n: " ".join(f"w{w}" + ("." if k % 9 == 8 else ",\n"[k % 2] if k % 14 == 6 else "") for k, w in enumerate(rng.integers(0, 10**6, n).tolist()))
    texts, planted, clean = [], [], []
    for k in range(120):
        if k % 10 == 0:
            passage = own(60)
        if k % 3:
            planted += [len(texts)] * (k % 10 > 2)  # not the first of its passage
            texts.append(f"{own(40)[: -1 - k % 4]} {passage} {own(30)}")
        else:
            clean.append(len(texts))
            texts.append(own(130))
    texts += [None, "", " \n ", "short one", "short one", texts[1], "a. " * 40, "b " * 500, "\n\nblank lines first. " + texts[4], "c, d; e: " * 9]
    got = sentences.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)).collect()
    got = {r["doc_id"]: r for r in got}
    assert [got[k]["kept"] for k in range(len(texts))] == brute_kept(texts)
    gone = {k: len(texts[k].split()) - len(got[k]["kept"].split()) for k in planted}
    assert sum(n >= 35 for n in gone.values()) >= 0.9 * len(planted) > 0
    assert all(got[k]["kept"] == texts[k] for k in clean)
