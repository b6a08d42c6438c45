"""Quality rules: fixed rules first, then gradient-boosted trees over document statistics.

At most `FIT_ROWS` labelled documents (the first by a hash of their id) are taken; a fifth of them, by another hash, is
held out. The trees are fitted on the others, as depth-limited trees over quantile bins with Newton leaf values. Features in `FALLING` may only lower the score as they grow: a
split that would break this is refused and children's values stay on their side of the split's midpoint. The fitted
model is flattened into numpy node arrays (feature, threshold, left, right, value), and a batch of rows walks
all trees level by level. The verdict keeps a document whose probability of good quality is at least the cut:
the lower of 0.5 and the `KEEP`-quantile of the good documents held out that pass the base rules, so that clean documents
stay. `Trees.held_out` has the number of held-out documents, and of their good ones the share that is kept (recall) and the
share of the kept ones that are good (precision), base rules included.

Null and empty texts have no words and fail the base rule (under 50 words). Without usable labels of both classes the
base rule alone decides. Repeated rows give repeated results; an empty table gives none; labels that are null,
repeated or of unknown documents are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planquant.llm.common import Kept, arrow_map, slices
from planquant.llm.text_stats import FEATURES, NAMES, features, text_stats

FIT_ROWS = 20_000
KEEP = 0.005
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share", "mark_share")
MIN_WORDS = 50


class Trees:
    """A flattened ensemble; all roots are the first nodes."""

    def __init__(self, feature, threshold, left, right, value, n_trees: int, depth: int, base: float, cut: float):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.n_trees, self.depth, self.base, self.cut = n_trees, depth, base, cut
        self.held_out: dict[str, float] = {}

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality, row by row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.n_trees):
            node = np.full(len(x), t)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0, falling: tuple[str, ...] = FALLING) -> Trees | None:
    """Boosted trees on the logistic loss; None if y has one class."""
    if len(y) == 0 or y.min() == y.max():
        return None
    sign = np.array([-1 if n in falling else 0 for n in FEATURES])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    nodes: list[list] = [[0, np.inf, k, k, 0.0] for k in range(n_trees)]

    def best(rows, g, h, low, high):
        """(gain, feature, bin) of the best allowed split of these rows."""
        top = (1e-9, -1, -1)
        G, H = g[rows].sum(), h[rows].sum()
        for j, e in enumerate(edges):
            if not len(e):
                continue
            a = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=len(e) + 1))[:-1]
            b = np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=len(e) + 1))[:-1]
            left, right = np.clip(-a / (b + ridge), low, high), np.clip(-(G - a) / (H - b + ridge), low, high)
            gain = a * a / (b + ridge) + (G - a) ** 2 / (H - b + ridge) - G * G / (H + ridge)
            ok = (b >= least / 4) & (H - b >= least / 4) & (sign[j] * (right - left) >= 0)
            if ok.any() and (k := int(np.argmax(np.where(ok, gain, -np.inf)))) is not None and gain[k] > top[0]:
                top = (float(gain[k]), j, k)
        return top

    for t in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        work = [(t, np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            at, rows, level, low, high = work.pop()
            gain, j, k = best(rows, g, h, low, high) if level < depth else (0, -1, -1)
            if j < 0:
                nodes[at][4] = rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
                margin[rows] += nodes[at][4]
                continue
            side = binned[rows, j] <= k
            mid = 0.0
            if sign[j]:
                values = [float(np.clip(-g[r].sum() / (h[r].sum() + ridge), low, high)) for r in (rows[side], rows[~side])]
                mid = sum(values) / 2
            nodes[at][:4] = [j, float(edges[j][k]), len(nodes), len(nodes) + 1]
            for s, (lo, hi) in ((side, (mid, high) if sign[j] else (low, high)), (~side, (low, mid) if sign[j] else (low, high))):
                work.append((len(nodes), rows[s], level + 1, lo, hi))
                nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(feature.astype(np.int32), threshold, left.astype(np.int32), right.astype(np.int32), value, n_trees, depth, base, 0.5)


def base_failed(stats: np.ndarray) -> np.ndarray:
    """Which rows of counts, in the order of NAMES, the fixed rules reject."""
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > 50 * stats[:, 0])


def judged(trees: Trees, stats: np.ndarray, y: np.ndarray, keep: float = KEEP) -> Trees:
    """The trees with their cut and figures from held-out documents."""
    score, passed = trees.score(features(stats)), ~base_failed(stats)
    good = passed & (y == 1)
    if good.any():
        trees.cut = min(0.5, float(np.quantile(score[good], keep, method="lower")))
    kept = passed & (score >= trees.cut)
    trees.held_out = {"rows": float(len(y)), "recall": float(kept[y == 1].mean()) if (y == 1).any() else 1.0, "precision": float(y[kept].mean()) if kept.any() else 1.0, "bad_kept": float(kept[y == 0].mean()) if (y == 0).any() else 0.0}
    return trees


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of `text_stats` of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = np.array([text_stats(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *NAMES])

    kind = docs.select(id_col).dtypes[0][1]
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES))


def first_labelled(labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id and y of the first `rows` labelled ids, by hash; an id with several labels has their largest."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    return known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees fitted on four fifths of the first `fit_rows` labelled documents, their cut set on the fifth held out. An id with several
    texts counts with the least of them."""
    chosen = first_labelled(labels, "quality", fit_rows)
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen.select(F.col("doc_id").alias(id_col))), id_col, "left_semi").groupBy(id_col).agg(F.min(text_col).alias(text_col))
    known = stats(texts, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    rows = known.select("doc_id", *NAMES, "y", (F.pmod(F.hash("doc_id"), F.lit(5)) == 0).alias("held_out")).toPandas().sort_values("doc_id")
    counts, y, out = rows[list(NAMES)].to_numpy(np.int64).reshape(-1, len(NAMES)), rows["y"].to_numpy(np.float64), rows["held_out"].to_numpy(bool)
    trees = fit(features(counts[~out]), y[~out])
    return judged(trees, counts[out], y[out]) if trees is not None else None


def quality_rules(docs: DataFrame, labels: DataFrame | None, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of every row.

    With `keep_columns`, these columns of docs instead, of the rows that are kept."""
    model = fit_on(docs, labels, fit_rows, id_col, text_col) if labels is not None else None
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, text_col] if keep_columns is None else keep_columns if text_col in keep_columns else [*keep_columns, text_col]
    text_at = columns.index(text_col) if keep_columns is not None else 1

    def run(batches):
        Kept.mine("quality_rules")
        trees = held.value
        for batch in batches:
            for part in slices(batch, text_at):
                rows = np.array([text_stats(t or b"") for t in part.column(text_at).cast(pa.binary()).to_pylist()], dtype=np.int64)
                failed = base_failed(rows)
                score = trees.score(features(rows)) if trees is not None else np.ones(len(rows))
                kept = ~failed & (score >= (trees.cut if trees is not None else 0.5))
                if keep_columns is None:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(rows[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(kept)], ["doc_id", *NAMES[:5], "base_failed", "score", "kept"])
                else:
                    yield part.filter(pa.array(kept)).select(list(range(len(keep_columns))))

    if keep_columns is None:
        kind = docs.select(id_col).dtypes[0][1]
        return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES[:5]) + ", base_failed boolean, score double, kept boolean")
    given = docs.select(*keep_columns)
    return arrow_map(docs.select(*columns), run, given.schema)
