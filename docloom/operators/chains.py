"""Stateful sequence kernels: each is a function of one document's rows.

Documents are the groups; a group's size is that of one document's markers. Sequences that
are many and short are streamed: sorted rows of a partition pass in Arrow batches, and a
document ends where the next one begins.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of the scoring rule: widest gap, what a missing value costs on one page and across pages,
#: what it costs at most, the gain of a value that follows directly, what a start above 1 costs for each value before it.
GAP_MOST, NEAR_COST, FAR_COST, COST_MOST, FOLLOW_GAIN, START_COST = 200, 0.4, 0.12, 4.0, 0.3, 0.25
EPSILON = 1e-9


def link_gains(gaps: np.ndarray) -> np.ndarray:
    """What it adds to a chain to pass over ``gaps`` values: a row across pages and a row on one page."""
    costs = np.minimum(COST_MOST, np.multiply.outer((FAR_COST, NEAR_COST), gaps))
    return np.where(gaps == 0, FOLLOW_GAIN, 0.0) - costs


def numeric_chain(rows: list[tuple[int, int, float, int, bool]], rooted: bool) -> tuple[list[int], float]:
    """The chain of highest score among (position, value, score, page, supported) rows: indices and score.

    A rooted chain starts at 1 and goes up by one. A backbone may skip values, at a
    penalty that depends on the gap and on whether the page changes; a start above 1
    costs a quarter for each value missed unless it is supported. Rows of one position
    don't follow each other. Of equal rooted chains that which ends first is taken; of equal
    backbones that which ends at the earliest position, and there with the greatest value.

    For each different value, two rows of a table hold the best chain that ends with it: on
    earlier pages, and on this page. A row looks at the slice of values within reach at once.
    """
    if not rows:
        return [], 0.0
    position, number, score, page, supported = (np.array(c) for c in zip(*rows))
    values, slot = np.unique(number, return_inverse=True)
    low = np.searchsorted(values, number - 1 if rooted else np.maximum(1, number - 1 - GAP_MOST))
    start = np.where(supported, 0.0, -np.minimum(COST_MOST, START_COST * np.maximum(number - 1, 0)))
    start = np.where(number == 1, 0.0, -np.inf) if rooted else start
    top = np.full(len(rows), -np.inf)
    before = np.full(len(rows), -1)
    table = np.full((2, len(values)), -np.inf)  # scores; row 0: earlier pages, row 1: this page
    owner = np.full((2, len(values)), -1)
    here: list[int] = []
    order = np.lexsort((np.arange(len(rows)), number, position)).tolist()
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    for _, together in groupby(order, key=lambda i: position[i]):
        together = list(together)
        if here and page[here[0]] != page[together[0]]:
            moved = np.unique(slot[here])
            better = moved[table[1, moved] > table[0, moved] + EPSILON]
            table[0, better], owner[0, better] = table[1, better], owner[1, better]
            table[1, moved], here = -np.inf, []
        for i in together:
            top[i] = score[i] + start[i]
            span = slice(low[i], slot[i])
            if low[i] < slot[i]:
                offers = table[:, span] + link_gains(number[i] - 1 - values[span]) + score[i]
                most = offers.max()
                if most > top[i] + EPSILON:
                    ties = owner[:, span][offers >= most - EPSILON]
                    top[i], before[i] = most, ties[np.argmin(place[ties])]
        for i in together:
            if top[i] > table[1, slot[i]] + EPSILON:
                table[1, slot[i]], owner[1, slot[i]] = top[i], i
        here += together
    if not np.isfinite(top).any():
        return [], 0.0
    if rooted:
        last = next(i for i in order if top[i] >= top.max() - EPSILON)
    else:
        ends = [i for i in order if top[i] == top.max()]
        last = [i for i in ends if position[i] == position[ends[0]]][-1]
    chain = [last]
    while before[chain[-1]] >= 0:
        chain.append(int(before[chain[-1]]))
    return chain[::-1], float(top[last])


def monotone_scopes(numbers: list[int], most_gap: int) -> list[int]:
    """The scope of each number: live chains take a number that is at most ``most_gap`` above their last one.

    Of several chains that with the smallest first number takes it, then the oldest.
    """
    chains: list[list[int]] = []
    out = []
    for n in numbers:
        fit = [(c[0], k) for k, c in enumerate(chains) if n - most_gap <= c[1] <= n - 1]
        if fit:
            k = min(fit)[1]
            chains[k][1] = n
        else:
            k = len(chains)
            chains.append([n, n])
        out.append(k)
    return out


def increasing_chains(labels: list[tuple[int, ...]], live: int = 8, least: int = 3) -> list[int]:
    """Chains of strictly greater labels of as many components; a label goes to the chain with the greatest last one.

    At most ``live`` chains are open (the shortest is dropped); chains below ``least`` don't count (-1).
    """
    chains: dict[int, list[int]] = {}
    out = [-1] * len(labels)
    for i, label in enumerate(labels):
        fit = [k for k, c in chains.items() if len(labels[c[-1]]) == len(label) and labels[c[-1]] < label]
        if fit:
            chains[max(fit, key=lambda k: (labels[chains[k][-1]], -k))].append(i)
        else:
            if len(chains) == live:
                chains.pop(min(chains, key=lambda k: (len(chains[k]), k)))
            chains[i] = [i]
        for k, c in chains.items():
            if len(c) >= least:
                for j in c:
                    out[j] = k
    return out


def ladder(tokens: list[str]) -> list[tuple[int, str]]:
    """(depth, path) of enumerator tokens: numbers, then letters, then Roman numerals.

    'i' under a letter opens a Roman level unless the letter before is 'h'.
    """
    roman = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
    stack: list[tuple[str, int, str]] = []
    out = []
    for k, token in enumerate(tokens):
        readings = []
        if token.isdigit():
            readings.append(("number", int(token)))
        if token in roman:
            readings.append(("roman", roman.index(token) + 1))
        if len(token) == 1 and token.isalpha():
            readings.append(("letter", ord(token) - 96))
        after_h = any(f == "letter" and v == 8 for f, v, _ in stack) and not (k + 1 < len(tokens) and tokens[k + 1] == "ii")
        if ("roman", 1) in readings and after_h:
            readings = [r for r in readings if r[0] == "letter"]
        chosen = None
        for family, value in readings:  # go on in an open level
            for d, (f, v, _) in enumerate(stack):
                if f == family and value == v + 1:
                    chosen = (d, family, value)
        if chosen is None:
            for family, value in readings:  # open a level
                if value == 1 and family not in {f for f, _, _ in stack} and len(stack) < 6:
                    chosen = (len(stack), family, value)
                    break
        if chosen is None and readings:  # start again, or jump
            family, value = readings[0]
            depth = next((d for d, (f, _, _) in enumerate(stack) if f == family), 0)
            chosen = (depth, family, value)
        if chosen is None:
            out.append((0, ""))
            continue
        depth, family, value = chosen
        stack = [*stack[:depth], (family, value, token)]
        out.append((depth + 1, "".join(f"({t})" for _, _, t in stack)))
    return out


def by_document(rows: DataFrame, order: tuple[str, ...], run, schema: str) -> DataFrame:
    """``run`` on the rows of each document, in order: from columns (numpy) to columns that ``schema`` names.

    The number of partitions is the session's, whatever their bytes: the work is in the rows, not in their size.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches):
        held: list[dict] = []
        last = None
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            ids = batch.column("doc_id").to_pylist()
            cuts = [k for k in range(1, len(ids)) if ids[k] != ids[k - 1]]
            done = []
            for a, b in zip([0, *cuts], [*cuts, len(ids)]) if ids else ():
                if held and ids[a] != last:
                    done.append(finish(last, held))
                    held = []
                last = ids[a]
                held.append({c: v[a:b] for c, v in columns.items()})
            yield from out(done)
        if held:
            yield from out([finish(last, held)])

    def finish(doc, held: list[dict]) -> dict:
        found = run({c: np.concatenate([h[c] for h in held]) for c in held[0] if c != "doc_id"})
        return {"doc_id": [doc] * len(found[names[1]]), **found}

    def out(done: list[dict]):
        if done:
            yield pa.RecordBatch.from_pydict({c: [v for d in done for v in d[c]] for c in names}, schema=arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(work, schema)


def select_numeric_sequence(markers: DataFrame, rooted: bool) -> DataFrame:
    """(doc_id, place, number, chain_score) of the best chain of markers(doc_id, position, number, score, page, supported)."""
    columns = ["position", "number", "score", "page", "supported"]

    def run(held: dict) -> dict:
        chain, score = numeric_chain(list(zip(*(held[c].tolist() for c in columns))), rooted)
        return {"position": held["position"][chain].tolist(), "number": held["number"][chain].tolist(), "chain_score": [round(score, 6)] * len(chain)}

    return by_document(markers.select("doc_id", *columns), ("position", "number"), run, "doc_id bigint, position bigint, number bigint, chain_score double")


def scoped(markers: DataFrame, most_gap: int) -> DataFrame:
    """markers(doc_id, position, number) with the monotone scope of each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "number"], kind="stable")
        return pdf.assign(scope=monotone_scopes(pdf["number"].tolist(), most_gap))

    return markers.groupBy("doc_id").applyInPandas(run, "doc_id bigint, position bigint, number bigint, scope bigint")


def section_chains(marks: DataFrame) -> DataFrame:
    """marks(doc_id, position, label) with the chain of each label like '4.1', -1 for none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", kind="stable")
        labels = [tuple(int(p) for p in label.split(".")) for label in pdf["label"]]
        return pdf.assign(chain=increasing_chains(labels))

    return marks.groupBy("doc_id").applyInPandas(run, "doc_id bigint, position bigint, label string, chain bigint")


def enumerated_children(marks: DataFrame) -> DataFrame:
    """marks(doc_id, position, token) with depth and path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", kind="stable")
        rungs = ladder(pdf["token"].tolist())
        return pdf.assign(depth=[d for d, _ in rungs], path=[p for _, p in rungs])

    return marks.groupBy("doc_id").applyInPandas(run, "doc_id bigint, position bigint, token string, depth bigint, path string")
