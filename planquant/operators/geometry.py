"""Boxes of four corners: growth, scale, clusters, words that look like pay items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from planquant.workers import workers_find_package

BBOX = "array<array<double>>"


def _edge(bbox: Column, k: int, how) -> Column:
    return how(F.transform(bbox, lambda p: p[k]))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))


def expanded(bbox: Column, factor: float = 1.5) -> Column:
    """The upright box around the mean of the corners, with width and height times factor."""
    mean = lambda k: F.aggregate(bbox, F.lit(0.0), lambda s, p: s + p[k]) / 4
    half = lambda k: (_edge(bbox, k, F.array_max) - _edge(bbox, k, F.array_min)) * factor / 2
    return box(mean(0) - half(0), mean(1) - half(1), mean(0) + half(0), mean(1) + half(1))


def to_points(bbox: Column, dpi: Column | int) -> Column:
    """Pixels at a resolution as points."""
    d = F.lit(dpi) if isinstance(dpi, int) else dpi
    return F.transform(bbox, lambda p: F.transform(p, lambda v: v * 72.0 / d))


def _clusters(edges: np.ndarray, group: np.ndarray, distance: float) -> tuple[np.ndarray, ...]:
    """(seed, cluster number, edges of the cluster, number of boxes) for boxes in order of their group: all groups take their next
    cluster at once."""
    free, out, k = np.arange(len(group)), [], 0
    while len(free):
        g = group[free]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        seed = np.repeat(free[first], np.diff(np.r_[first, len(free)]))
        gap = lambda lo, hi: np.maximum(edges[seed, lo], edges[free, lo]) - np.minimum(edges[seed, hi], edges[free, hi])  # noqa: E731, B023
        near = (np.maximum(gap(0, 2), 0) <= distance) & (np.maximum(gap(1, 3), 0) <= distance)
        near[first] = True
        taken, of = free[near], g[near]
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        around = np.column_stack([how.reduceat(edges[taken, e], at) for e, how in enumerate((np.minimum, np.minimum, np.maximum, np.maximum))])
        out.append((free[first], np.full(len(first), k), around, np.diff(np.r_[at, len(taken)])))
        free, k = free[~near], k + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged_boxes(boxes: DataFrame, keys: list[str], order_col: str = "block_no", distance: float = 50) -> DataFrame:
    """Clusters of a page's boxes in their order: each box not yet taken seeds one and takes the later ones within the
    distance of the seed on both axes (not of one another). The greedy pass is sequential in a page; pages are sorted rows, of which a
    batch is clustered at once."""
    workers_find_package(boxes.sparkSession)
    edge = lambda k, how: _edge(F.col("bbox"), k, how).cast("double")
    by = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(order_col))
    rows = boxes.select(*keys, order_col, edge(0, F.array_min).alias("x1"), edge(1, F.array_min).alias("y1"), edge(0, F.array_max).alias("x2"), edge(1, F.array_max).alias("y2"))
    rows = rows.select(*keys, "x1", "y1", "x2", "y2", F.row_number().over(by).alias("_no"))
    key_schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keys).dtypes)

    def clustered(pages: pa.Table) -> pa.RecordBatch:
        edges = np.column_stack([pages.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")])
        seed, number, around, n = _clusters(edges, np.cumsum(pages.column("_no").to_numpy() == 1), distance)
        found = pages.select(keys).take(pa.array(seed)).combine_chunks()
        columns = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns), pa.array(number, pa.int32()), *(pa.array(around[:, e]) for e in range(4)), pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [*keys, "cluster_no", "x1", "y1", "x2", "y2", "n_boxes"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_no").to_numpy() == 1)
            # The last page of a batch may go on in the next one.
            if len(starts):
                whole = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
                if whole.num_rows:
                    yield clustered(whole)
                held = [batch.slice(starts[-1])]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield clustered(pa.Table.from_batches(held))

    found = rows.mapInArrow(run, f"{key_schema}, cluster_no int, x1 double, y1 double, x2 double, y2 double, n_boxes int")
    return found.select(*keys, "cluster_no", box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("bbox"), "n_boxes")


# Words that look like pay items, by type, in order.
WORD_TYPES = (
    ("pay_item", r"\d{3}-\d{1,3}(?:-\d{1,3})?"),
    ("pipe", r"(?i)\b(?:RCP|PVC|HDPE|CMP|DIP|SRCP|ERCP)\b"),
    ("structure", r"(?i)\b(?:INLET|MANHOLE|MH|CB|JB|ENDWALL|MES)\b"),
    ("size", "\\d{1,2}[\"”]"),
    ("quantity", r"(?i)\d+(?:\.\d+)?\s*(?:LF|EA|SY|CY|SF)\b"),
)


def pay_item_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a page with the first type they look like; words at the same place count once."""
    kind = F.lit(None).cast("string")
    for name, p in reversed(WORD_TYPES):
        kind = F.when(F.regexp_like("text", F.lit(p)), name).otherwise(kind)
    at = words.withColumn("type", kind).filter("type is not null").withColumn("_x", F.round(F.col("bbox")[0][0])).withColumn("_y", F.round(F.col("bbox")[0][1]))
    return at.dropDuplicates([*keys, "type", "_x", "_y"]).drop("_x", "_y")
