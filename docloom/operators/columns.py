"""One or two columns of a page, from the places of its lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed values of the rule, as shares of the page's width but for counts and heights.
WIDEST_LINE, MOST_WIDE, LEAST_LINES, LEAST_SIDE = 0.55, 0.40, 6, 3
LEAST_GAP, SPLIT_FROM, SPLIT_TO, LEAST_OVERLAP = 0.12, 0.25, 0.75, 0.30
MIDDLE_FROM, MIDDLE_TO, ALIKE = 0.40, 0.60, 0.60
CENTRED_WIDTH, CENTRED_OFF = 0.30, 0.12
#: Pages are looked at together up to about so many lines, a page of more lines by itself.
LINES_AT_ONCE = 1 << 18


def column_models(boxes: np.ndarray, counts: np.ndarray, page_width: np.ndarray, skip_centred: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind, split_x, left and right of each page: single, two_column or margin_column.

    ``boxes`` are the lines' (x0, y0, x1, y1), as four rows, page after page; ``counts`` and
    ``page_width`` are by page. Each gap between neighbouring line centres is a possible
    split. With ``skip_centred`` short lines at the page's middle are not looked at and the
    split is the gutter's middle. The split that fewest lines cross is taken, then the most
    even one, then the widest gap, then the leftmost.
    """
    pages = len(counts)
    kind, split_x, left, right = np.full(pages, "single", object), np.zeros(pages), np.zeros(pages, np.int64), np.zeros(pages, np.int64)
    page = np.repeat(np.arange(pages), counts)
    x0, _, x1, _ = boxes
    across = page_width[page]
    use = across > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        width, centre = (x1 - x0) / across, (x0 + x1) / 2
        if skip_centred:
            use &= ~((width <= CENTRED_WIDTH) & (np.abs(centre / across - 0.5) <= CENTRED_OFF))
    narrow = use & (width <= WIDEST_LINE)
    n, of = (np.bincount(page[m], minlength=pages) for m in (narrow, use))
    fit = (n >= LEAST_LINES) & (1 - n / np.maximum(of, 1) <= MOST_WIDE)
    # By page and centre, each split is a place in this order.
    rows = np.flatnonzero(narrow & fit[page])
    rows = rows[np.lexsort((centre[rows], page[rows]))]
    page, across, width, centre = page[rows], across[rows], width[rows], centre[rows]
    x0, y0, x1, y1 = boxes[:, rows]
    first = np.searchsorted(page, np.arange(pages))
    at = np.flatnonzero((page[1:] == page[:-1]) & (np.diff(centre) / across[1:] >= LEAST_GAP)) + 1
    middle, k, size = (centre[at - 1] + centre[at]) / 2, at - first[page[at]], n[page[at]]
    inside = (middle / across[at] >= SPLIT_FROM) & (middle / across[at] <= SPLIT_TO) & (np.minimum(k, size - k) >= LEAST_SIDE)
    if not inside.any():
        return kind, split_x, left, right
    at, split, k, size = at[inside], middle[inside], k[inside], size[inside]
    # All lines of its page for each split, those on its left first; a page has five splits at most, since gaps are wide.
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(at)), size)
    row = np.arange(size.sum()) - begin[own] + first[page[at]][own]
    sides = np.column_stack((begin, begin + k)).ravel()
    least, most = (lambda v, f=f: f.reduceat(v[row], sides).reshape(-1, 2).T for f in (np.minimum, np.maximum))
    gap, uneven, good = centre[at] - centre[at - 1], np.zeros(len(at)), np.ones(len(at), bool)
    if skip_centred:
        inner, outer = most(x1)[0], least(x0)[1]
        split, gap, uneven, good = (inner + outer) / 2, outer - inner, np.abs(size - 2 * k), outer > inner
    tops, ends = least(y0), most(y1)
    height = ends.max(axis=0) - tops.min(axis=0)
    good &= np.maximum(ends.min(axis=0) - tops.max(axis=0), 0) / height >= LEAST_OVERLAP
    crossing = np.add.reduceat(((x0[row] < split[own]) & (x1[row] > split[own])).astype(np.int64), begin)
    ranked = width[row[np.lexsort((width[row], row >= at[own], own))]]
    usual = ranked[sides + np.column_stack((k, size - k)).ravel() // 2].reshape(-1, 2)
    place = np.round(split / across[at], 4)
    even = usual.min(axis=1) / usual.max(axis=1) >= ALIKE
    two = ((crossing == 0) & (place >= MIDDLE_FROM) & (place <= MIDDLE_TO)) | even
    order = np.lexsort((at, -gap, uneven, crossing, page[at]))
    order = order[good[order]]
    found, top = np.unique(page[at[order]], return_index=True)
    best = order[top]
    kind[found] = np.where(two[best], "two_column", "margin_column")
    split_x[found], left[found], right[found] = split[best], k[best], (size - k)[best]
    return kind, split_x, left, right


def page_columns(lines: DataFrame, skip_centred: bool = False) -> DataFrame:
    """(doc_id, page, kind, split_x, n_left, n_right) of each page of lines(doc_id, page, page_width, x0, y0, x1, y1, region_type, excluded).

    Headers, footers, excluded lines and boxes without an area don't count; a page that has
    nothing else is single. A page's lines are one row before they move, and many pages are
    looked at together.
    """
    schema = "doc_id bigint, page bigint, kind string, split_x double, n_left bigint, n_right bigint"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def work(batches):
        for whole in batches:
            step = max(1, whole.num_rows * LINES_AT_ONCE // max(1, len(whole.column("boxes").flatten())))
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                held = batch.column("boxes")
                boxes = np.stack([c.to_numpy(zero_copy_only=False) for c in held.flatten().flatten()])
                width = batch.column("page_width").to_numpy(zero_copy_only=False)
                found = column_models(boxes, held.value_lengths().to_numpy(zero_copy_only=False), width, skip_centred)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), *(pa.array(v, f.type) for v, f in zip(found, list(arrow)[2:]))], schema=arrow)

    sides = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    use = ~F.coalesce("excluded", F.lit(False)) & F.coalesce(~F.col("region_type").isin("header", "footer"), F.lit(True)) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    for c in ("x0", "y0", "x1", "y1"):
        use &= F.abs(F.col(c)) < float("inf")  # NaN is above all numbers
    pages = lines.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("bigint").alias("page")).agg(
        F.max("page_width").cast("double").alias("page_width"), F.collect_list(F.when(use, F.struct(*sides))).alias("boxes")
    )
    return pages.mapInArrow(work, schema)
