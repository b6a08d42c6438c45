"""Language ID: prediction by partial matching over per-language variable-order byte context trees.

A language's tree holds the counts of every byte after every context of up to `ORDER` bytes, over its learning
documents or, where they have more text than its share of `LEARN_BYTES`, over a sample of them; a text follows `ORDER` zero bytes. Escapes follow method C: a context seen n times with d different successors
gives a successor seen c times c / (n + d), and escapes with d / (n + d) to the next shorter context, from which what
the longer one predicts is excluded; below the empty context all bytes left are alike. Counts are frozen before anything
is scored, so the code length of a byte after its context is a fixed number, and a text's is their sum.

The sample takes whole rows by a hash of id and text, so it depends on nothing but the rows; it is about as large as the share, and takes no
row that is longer by itself. It bounds the counts that reach the driver (none is dropped: there are at most as many as bytes),
whatever the corpus has. Counts are summed within partitions first and then by key. The frozen trees become hashed tables
(`Tables`) of the contexts and successors that were seen in any language, and what an escape from each context costs.

A text's language is the one with the shortest code (ties: the first by name); the score is its share when code lengths
are taken as probabilities. Null texts and texts without a letter are `und` with score 0, and so is every text when
nothing was learned. Rows without an id are not learned from and count as not held out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planquant.llm.common import Kept, arrow_map, slices

ORDER = 3
#: Bytes of learning text of all languages together; each has the same share. With more than `WIDE` languages, tables have so many cells
#: for each count that shares are smaller in proportion.
LEARN_BYTES = 32 << 20
WIDE = 16
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 2 << 20
HELD_OUT = 2
FOLDS = 4

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in (m[0] for m in _LETTER.finditer(text)))


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes that end at each byte, as one number; where each text starts. A text follows three zero bytes."""
    starts = np.cumsum([0, *(len(t) for t in texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    out = data.copy()
    back = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    for k in range(1, ORDER + 1):
        if len(data) > k:
            out[k:] |= np.where(back[k:] >= k, data[:-k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out, starts[:-1]


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _summed(codes_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes_, kind="stable")
    c, n = codes_[order], n[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, dtype=np.int64)
    return c[first], np.add.reduceat(n, first) if len(c) else n


def learning_rows(docs: DataFrame, learn_bytes: int = LEARN_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) of the rows that are learned from."""
    known = docs.filter((fold(id_col) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = F.octet_length("text")
    sizes = known.groupBy("lang").agg(F.sum(size.cast("long")).alias("all"))
    n = sizes.count()
    share = learn_bytes // max(1, n) * WIDE // max(WIDE, n)
    taken = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.lit(float(share << 30)) / F.greatest("all", F.lit(1))
    return known.join(F.broadcast(sizes), "lang").filter((F.col("all") <= share) | (taken & (size <= share))).select("lang", "text")


def learned_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_bytes: int = LEARN_BYTES) -> DataFrame:
    """(lang, code, n): how often each four bytes occur in the learning documents of each language."""
    known = learning_rows(docs, learn_bytes, id_col, text_col, lang_col)

    def run(batches):
        Kept.mine("language_id")
        kept: dict[str, list] = {}

        def merged(parts):
            return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        def batch_of(lang, held):
            u, n = merged(held)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])

        for batch in batches:
            for part in slices(batch):
                by: dict[str, list] = {}
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, texts in by.items():
                    u, n = np.unique(codes(texts)[0], return_counts=True)
                    held = kept.setdefault(lang, [])
                    held.append((u, n))
                    if len(held) > 8:
                        kept[lang] = [merged(held)]
                if sum(len(c) for held in kept.values() for c, _ in held) > HELD_COUNTS:
                    for lang in list(kept):
                        yield batch_of(lang, kept.pop(lang))
        for lang, held in kept.items():
            yield batch_of(lang, held)

    parts = arrow_map(known, run, "lang string, code long, n long")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class _Index:
    """Places of 32-bit keys in a sorted array: open addressing, looked up for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint32((1 << self.bits) - 1)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._first(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            out = self.slots[at] != todo
            todo, at = todo[out], (at[out] + np.uint32(1)) & self.mask

    def _first(self, q: np.ndarray) -> np.ndarray:
        return (q * np.uint32(2654435761)) >> np.uint32(32 - self.bits)

    def find(self, q: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(q), -1, dtype=np.int32)
        at = self._first(q)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != q))
        while len(todo):
            at[todo] = (at[todo] + np.uint32(1)) & self.mask
            got = self.slots[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != q[todo])]
        return out


class Tables:
    """Frozen code lengths in bits, for all languages side by side."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        #: By order: codes seen in any language and their bits in each; contexts seen in any and what an escape costs in each.
        self.seen: list[_Index] = []
        self.bits_of: list[np.ndarray] = []
        self.contexts: list[_Index] = []
        self.escape: list[np.ndarray] = []
        n_langs = len(langs)
        for order in range(ORDER + 1):
            own = [_summed(c & ((1 << 8 * (order + 1)) - 1), n.astype(np.float64)) for c, n in counts]
            union = np.unique(np.concatenate([c for c, _ in own])) if own else np.zeros(0, dtype=np.int64)
            if order == 0:
                union = np.arange(256)
            contexts, of_context = np.unique(union >> 8, return_inverse=True)
            bits, escape = np.zeros((len(union), n_langs), dtype=np.float32), np.zeros((len(contexts), n_langs), dtype=np.float32)
            shorter = self.bits_of[-1][self.seen[-1].find((union & ((1 << 8 * order) - 1)).astype(np.uint32))] if order else np.full((256, n_langs), 8.0)
            for k, (c, n) in enumerate(own):
                at = np.searchsorted(union, c)
                total, kinds = np.bincount(of_context[at], weights=n, minlength=len(contexts)), np.bincount(of_context[at], minlength=len(contexts))
                freed = np.bincount(of_context[at], weights=np.exp2(-shorter[at, k].astype(np.float64)), minlength=len(contexts))
                total = np.where(kinds < 256, total + kinds, total)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, k] = np.where(kinds > 0, np.log2(total / np.maximum(kinds, 1)) + np.log2(np.maximum(1 - freed, 1e-9)), 0)
                bits[:, k] = escape[of_context, k] + shorter[:, k]
                bits[at, k] = -np.log2(n / total[of_context[at]])
            self.seen.append(_Index(union))
            self.bits_of.append(bits)
            self.contexts.append(_Index(contexts))
            self.escape.append(escape)

    def _cost(self, c: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each code after the `order` bytes before it, by language."""
        at = self.seen[order].find(c)
        out = self.bits_of[order][at]
        new = np.flatnonzero(at < 0)
        if len(new):
            rest = c[new]
            ctx = self.contexts[order].find(rest >> np.uint32(8))
            out[new] = np.where((ctx >= 0)[:, None], self.escape[order][ctx], 0) + self._cost(rest & np.uint32((1 << 8 * order) - 1), order - 1)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(np.array([len(t) > 0 for t in texts], dtype=bool))
        if not len(some) or not self.langs:
            return out
        c, starts = codes([texts[k] for k in some.tolist()])
        step = max(1, (1 << 20) // len(self.langs))
        for a in range(0, len(c), step):
            first, end = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, a + step, side="left")
            cuts = np.maximum(starts[first:end] - a, 0)
            out[some[first:end]] += np.add.reduceat(self._cost(c[a : a + step]), cuts, axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_bytes: int = LEARN_BYTES) -> Tables:
    """The trees of all languages of the learning documents."""
    counts = learned_counts(docs, id_col, text_col, lang_col, learn_bytes)
    rows = counts.toArrow()
    names = sorted(rows.column("lang").unique().to_pylist())
    who, code, n = rows.column("lang").to_numpy(), rows.column("code").to_numpy(), rows.column("n").to_numpy()
    parts = []
    for x in names:
        own = np.flatnonzero(who == x)
        own = own[np.argsort(code[own], kind="stable")]
        parts.append((code[own], n[own]))
    return Tables(names, parts)


def identify(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        Kept.mine("language_id")
        t = held.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                texts = part.column(1).to_pylist()
                langs, scores = [], []
                lengths = t.bits([(x or "").encode() for x in texts])
                for x, bits in zip(texts, lengths, strict=True):
                    if not t.langs or not has_letter(x):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(bits))
                    langs.append(t.langs[best])
                    scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.select(id_col).dtypes[0][1]
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"))
    return arrow_map(given, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
