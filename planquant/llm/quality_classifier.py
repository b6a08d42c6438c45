"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Nine labellers vote good, bad or nothing on counts of the whole text. All documents are counted by vote pattern (at
most 3^9 of them, so what is collected is bounded), and expectation-maximisation over two hidden classes gives each
labeller's vote probabilities in either class and each pattern's posterior. The posteriors of the first `FIT_ROWS`
documents (by a hash of their id; one row for each id, as many as have `FIT_SLOTS` distinct slots together) then train a logistic
scorer on hashed words and hashed word shapes, as frequencies, so that it also judges texts on which the labellers
are split. It scores every whole text.

Null and empty texts have no words: score 0, not kept. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planquant.llm.common import Kept, arrow_map, shared_table, slices
from planquant.llm.text_stats import FEATURES, features, text_stats

FIT_ROWS = 6_000
#: Distinct slots (12 bytes each) of all texts that the scorer is fitted on; what reaches the driver has this bound.
FIT_SLOTS = 4 << 20
BITS = 16

ABSTAIN, BAD, GOOD = 0, 1, 2
#: (feature, bad where it is beyond, good where it is within); beyond is above the first and below the second bound.
LABELLERS = (
    ("symbols_per_word", (0.10, None), (0.0, 0.02)),
    ("mark_share", (0.10, None), (0.0, 0.06)),
    ("repeat_share", (0.30, None), (0.0, 0.05)),
    ("distinct_share", (None, 0.25), (0.45, 1.0)),
    ("upper_share", (0.30, None), (0.0, 0.08)),
    ("dup_line_share", (0.30, None), (0.0, 0.0)),
    ("ended_line_share", (None, 0.40), (0.80, 1.0)),
    ("log_words", (None, float(np.log1p(20))), (float(np.log1p(50)), np.inf)),
    ("word_length", (9.0, 3.0), (4.0, 7.0)),
)


def votes(x: np.ndarray) -> np.ndarray:
    """Votes of each labeller (column) on each row of features."""
    out = np.zeros((len(x), len(LABELLERS)), dtype=np.int64)
    for k, (name, (over, under), (low, high)) in enumerate(LABELLERS):
        v = x[:, FEATURES.index(name)]
        out[(v >= low) & (v <= high), k] = GOOD
        if over is not None:
            out[v > over, k] = BAD
        if under is not None:
            out[v < under, k] = BAD
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def unpacked(p: np.ndarray) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class Labelling:
    """What expectation-maximisation finds: the share of good documents, vote probabilities, accuracies."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 1.0):
        v = unpacked(patterns)
        good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
        q = (good + 1) / (good + bad + 2)  # a vote of the majority to begin with
        w = counts.astype(np.float64)
        for _ in range(rounds):
            self.share = (float((w * q).sum()) + prior) / (float(w.sum()) + 2 * prior)
            self.p = np.empty((2, v.shape[1], 3))
            for c, weight in enumerate((w * (1 - q), w * q)):
                for k in range(v.shape[1]):
                    # A labeller is presumed better than chance: one more document of its own class.
                    own = np.array([prior, prior + (c == 0), prior + (c == 1)])
                    n = np.bincount(v[:, k], weights=weight, minlength=3) + own
                    self.p[c, k] = n / n.sum()
            new = self.posterior(patterns)
            done, q = np.abs(new - q).max(initial=0) < 1e-9, new
            if done:
                break
        said = self.p[:, :, 1:].sum(axis=2)
        self.accuracy = (self.share * self.p[1, :, GOOD] + (1 - self.share) * self.p[0, :, BAD]) / (self.share * said[1] + (1 - self.share) * said[0])

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good quality of each pattern."""
        v = unpacked(patterns)
        log = [np.log(s) + np.log(self.p[c][np.arange(v.shape[1]), v]).sum(axis=1) for c, s in ((0, 1 - self.share), (1, self.share))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))
_MASK = (1 << BITS) - 1


class _Slots(Kept):
    """Slots of words (even) or of their shapes (odd)."""

    def __init__(self, odd: int):
        super().__init__("quality_classifier", 100_000)
        self.odd = odd

    def __missing__(self, word: bytes) -> int:
        return self.put(word, (zlib.crc32(word) << 1 | self.odd) & _MASK)


_word_slot, _shape_slot = _Slots(0), _Slots(1)


def slots(text: bytes) -> np.ndarray:
    """A slot for each word and each word's shape (its characters as A, a, 0, marks as they are; six at most)."""
    words = text.split()
    shapes = [s[-6:] for s in text.translate(_SHAPE).split()]
    return np.fromiter((*map(_word_slot.__getitem__, words), *map(_shape_slot.__getitem__, shapes)), dtype=np.int32, count=2 * len(words))


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes) -> float:
        s = slots(text)
        if not len(s):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + 2 * self.weights[s].mean(), -60, 60))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, rate: float = 0.5, decay: float = 1e-6) -> Scorer:
    """Logistic regression on slot frequencies (slots and their counts, text by text) against soft labels, by AdaGrad in a
    fixed order."""
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    order = np.random.RandomState(7)
    for _ in range(epochs):
        for k in order.permutation(len(bags)).tolist():
            at, x = bags[k][0], bags[k][1] * (2.0 / max(1, bags[k][1].sum()))
            miss = 1 / (1 + np.exp(-np.clip(bias + w[at] @ x, -60, 60))) - y[k]
            g = miss * x + decay * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            b2 += miss * miss
            bias -= rate * miss / np.sqrt(b2)
    return Scorer(w, float(bias))


def patterns(docs: DataFrame, with_slots: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and vote pattern of every row that has words, and its distinct slots with their counts."""

    def run(batches):
        Kept.mine("quality_classifier")
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                stats = np.array([text_stats(t) for t in texts], dtype=np.int64)
                some = stats[:, 0] > 0
                ids = part.column(0).filter(pa.array(some))
                columns = [ids, pa.array(pattern(votes(features(stats[some]))))]
                if with_slots:
                    bags = [np.unique(slots(t), return_counts=True) for t, s in zip(texts, some, strict=True) if s]
                    columns += [pa.array([x for x, _ in bags], pa.list_(pa.int32())), pa.array([n for _, n in bags], pa.list_(pa.int64())), pa.array([zlib.crc32(t) for t, s in zip(texts, some, strict=True) if s], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pattern", "slots", "counts", "crc"][: len(columns)])

    kind = docs.select(id_col).dtypes[0][1]
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, pattern long" + ", slots array<int>, counts array<long>, crc long" * with_slots)


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Labelling:
    """Labeller accuracies over all documents."""
    rows = patterns(docs, False, id_col, text_col).groupBy("pattern").count().toPandas().sort_values("pattern")
    return Labelling(rows["pattern"].to_numpy(np.int64), rows["count"].to_numpy(np.int64))


def fit(docs: DataFrame, labelling: Labelling, fit_rows: int = FIT_ROWS, fit_slots: int = FIT_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A scorer fitted on the first `fit_rows` ids, as far as their texts have `fit_slots` distinct slots."""
    chosen = docs.select(F.col(id_col)).filter(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)
    found = patterns(docs.join(F.broadcast(chosen), id_col, "left_semi"), True, id_col, text_col)
    # Of an id with several texts, the one with the smallest checksum.
    rows = shared_table(found.groupBy("doc_id").agg(F.min_by(F.struct("pattern", "slots", "counts"), F.struct("crc", "pattern")).alias("x")).select("doc_id", F.xxhash64("doc_id").alias("place"), "x.*"), "fit-rows")
    sizes = sorted((r["place"], str(r["doc_id"]), r["n"]) for r in rows.select("place", "doc_id", F.size("slots").alias("n")).collect())
    room = np.searchsorted(np.cumsum([n for _, _, n in sizes]), fit_slots, side="right")
    last = sizes[room - 1][0] if room else None
    if last is None:
        return train([], np.zeros(0))
    t = rows.filter(F.col("place") <= last).select("place", F.col("doc_id").cast("string").alias("doc_id"), "pattern", "slots", "counts").toArrow().combine_chunks()
    order = sorted(range(len(t)), key=list(zip(t["place"].to_pylist(), t["doc_id"].to_pylist(), strict=True)).__getitem__)
    column = lambda c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type)
    at, slot, n = (np.asarray(x) for x in (column("slots").offsets, column("slots").values, column("counts").values))
    y = labelling.posterior(np.asarray(column("pattern"), dtype=np.int64))
    return train([(slot[at[k] : at[k + 1]], n[at[k] : at[k + 1]]) for k in order], y[order])


def classify(docs: DataFrame, scorer: Scorer, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of good quality) and kept (score >= cut) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        Kept.mine("quality_classifier")
        s = held.value
        for batch in batches:
            for part in slices(batch):
                score = np.array([s.score(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(score >= cut)], ["doc_id", "score", "kept"])

    kind = docs.select(id_col).dtypes[0][1]
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, score double, kept boolean")
