"""Kernels on literal cases."""

import random

import pytest

from docloom.functions import dialect
from docloom.operators import boxes, chains, citations, markup


def test_rooted_chain():
    rows = [(0, 1, 1.0, 1, False), (10, 2, 100.0, 1, False), (0, 2, 1.0, 1, False), (20, 3, 1.0, 1, False)]
    # Row 2 stands where row 0 does and can't follow it.
    chain, score = chains.numeric_chain(rows, rooted=True)
    assert [rows[i][1] for i in chain] == [1, 2, 3]
    assert score == pytest.approx(102.6)


def test_rooted_chain_passes_over_equal_positions():
    rows = [(0, 1, 1.0, 1, False), (0, 2, 100.0, 1, False), (10, 2, 1.0, 1, False), (20, 3, 1.0, 1, False)]
    chain, score = chains.numeric_chain(rows, rooted=True)
    assert chain == [0, 2, 3] and score == pytest.approx(3.6)


def test_backbone_over_pages():
    rows = [(0, 1, 1.0, 1, False), (10, 3, 1.0, 1, False), (20, 4, 1.0, 2, False)]
    chain, score = chains.numeric_chain(rows, rooted=False)
    assert chain == [0, 1, 2] and score == pytest.approx(2.9)
    assert chains.numeric_chain([(0, 50, 5.0, 1, True)], rooted=False) == ([0], 5.0)


def every_chain(rows, rooted):
    """The best score over all chains, listed one by one."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
    best = 0.0 if not rows else float("-inf")

    def go(chain, total):
        nonlocal best
        best = max(best, total)
        for i in order:
            (p, v, s, page, _), (q, u, _, other, _) = rows[i], rows[chain[-1]]
            gap = v - u - 1
            if p > q and 0 <= gap <= (0 if rooted else 200):
                go([*chain, i], total + s + (0.3 if gap == 0 else max(-4.0, -gap * (0.4 if page == other else 0.12))))

    for i in order:
        _, v, s, _, supported = rows[i]
        if v == 1 or not rooted:
            go([i], s if v == 1 or supported else s + max(-4.0, -0.25 * (v - 1)))
    return best if best > float("-inf") else 0.0


@pytest.mark.parametrize("rooted", [False, True])
def test_numeric_chain_is_the_best_of_all_chains(rooted):
    pick = random.Random(7)
    for _ in range(150):
        rows = []
        for place in range(pick.randint(0, 9)):
            value = pick.choice([1, 2, 3, 4, 5, 9, 22, 40, 230]) if pick.random() < 0.7 else place + 1
            rows.append((pick.randint(max(0, place - 1), place), value, pick.choice([0.5, 1.0, 2.0, 10.0]), place // 4, pick.random() < 0.5))
        rows = [(p, v, s, p // 4, ok) for p, v, s, _, ok in rows]
        chain, score = chains.numeric_chain(rows, rooted)
        assert score == pytest.approx(every_chain(rows, rooted)), rows
        assert all(rows[a][0] < rows[b][0] and rows[a][1] < rows[b][1] for a, b in zip(chain, chain[1:]))


def test_gap_costs_have_a_floor_on_one_page_too():
    rows = [(0, 1, 10.0, 1, False)] + [(k, 21 + k, 1.0, 1, False) for k in range(1, 7)]
    assert chains.numeric_chain(rows, rooted=False) == (list(range(7)), pytest.approx(13.5))


def test_scopes_and_sections():
    assert chains.monotone_scopes([1, 2, 10, 3, 11, 4], 3) == [0, 0, 1, 0, 1, 0]
    assert chains.increasing_chains([(1,), (2,), (1, 1), (3,)]) == [0, 0, -1, 0]


def test_ladder():
    assert [d for d, _ in chains.ladder(["1", "a", "i", "ii", "b", "2"])] == [1, 2, 3, 3, 2, 1]
    assert chains.ladder(["a", "b", "c", "d", "e", "f", "g", "h", "i"])[-1] == (1, "(i)")


def test_boxes(spark):
    rows = [(1, 1, "a", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, "a", 0.8, 0.0, 0.0, 10.0, 9.0), (1, 3, "b", 0.7, 0.0, 0.0, 10.0, 9.0)]
    df = spark.createDataFrame(rows, "page bigint, id bigint, label string, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.id for r in boxes.suppressed(df).collect()) == [1, 3]
    assert {(r.gold_id, r.found_id) for r in boxes.matched(df, df).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_packed(spark):
    df = spark.createDataFrame([(0, k, 60) for k in range(5)], "shard bigint, id bigint, bytes bigint")
    assert [r.batch for r in boxes.packed(df, 25, 130).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_note_parts_rebuild_the_note():
    text = 'See A v B, [2019] SCC 5; "one; two"; (x; y); supra note 3'
    parts = citations.split_note(text)
    assert ";".join(text[a:b] for a, b in parts) == text and len(parts) == 4
    assert [k for _, _, k in citations.anchors(text)] == ["neutral", "cross"]


def test_markup():
    found = markup.render("<html><head><title>x</title></head><body><h1>A &amp; B</h1><p>one<br>two <script>no</script></body>")
    assert [b["text"] for b in found] == ["A & B", "one", "two"]


def test_views_are_put_in_front():
    text = dialect.render("select * from scopes", duck=True)
    assert text.index("doc_lines as") < text.index("marked as") < text.index("markers as") < text.index("scopes as")
