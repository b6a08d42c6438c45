"""Packing: non-negative least squares over combinations of lengths that fill a window.

Documents are tokenized in Arrow functions (an end token follows each), and packed block by block: a block is a run of
documents of about `block_tokens` tokens within one task, so memory is bounded, nothing is shuffled, no group of
documents can become hot and a lost task is simply run again. In a block:

1. A document of `window` tokens or more gives full pieces of `window`, each a sequence of its own; the rest
   (under `window` tokens) is a remainder.
2. The histogram of remainder lengths is fitted by shallow combinations, each a multiset of one to three lengths that
   fills a sequence without padding: one length that is a power of two, two or three lengths that add up to `window`.
   Columns are enumerated from the lengths that the block has; the repeat counts x >= 0 minimise |A x - h|.
3. The counts are rounded down and, where lengths run short, lowered to what there is.
4. What remains is packed greedily, longest first: remainders follow one another and are cut where a sequence is
   full. The last sequence's tokens are cut into powers of two, which need no padding.

Null and empty texts are one end token. An empty table gives no pieces. Texts of any length are cut into as many
pieces as it takes. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planquant.llm.common import Kept, arrow_map, slices

WINDOW = 2048
END = 1
BLOCK_TOKENS = 4 << 20
#: Pieces, and words, whose ids a worker keeps.
CACHE = 300_000
#: Spacing of the third length in the combinations of three.
THIRD = 64

#: White space as the tokenizer's pattern has it (Python's \s has four more characters).
_WS = "\t-\r \x85\xa0  -     　"
#: Safe boundaries: a run of white space but its last character, a word with the blank before it, a single white space.
_PIECES = re.compile(rf"[{_WS}]+(?![^{_WS}])| ?[^{_WS}]+|[{_WS}]")


#: A word of the first two Unicode blocks with the blank before it, then ASCII marks without an apostrophe.
_SIMPLE = re.compile(r"( ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(Kept):
    """Ids of pieces, as bytes; a piece is encoded when it is first met, and kept while there is room."""

    def __init__(self, tokenizer):
        super().__init__("packing", CACHE)
        self.tokenizer, self.model, self.letters, self.units = tokenizer, tokenizer.model, _byte_letters(), Kept("packing", CACHE)

    def unit(self, s: str) -> bytes:
        out = self.units.get(s)
        if out is None:
            mapped = s.encode().decode("latin-1").translate(self.letters)
            out = self.units.put(s, np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes())
        return out

    def __missing__(self, piece: str) -> bytes:
        if m := _SIMPLE.fullmatch(piece):
            return self.put(piece, self.unit(m[1]) + (self.unit(m[2]) if m[2] else b""))
        return self.put(piece, np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes())


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, _Pieces(t), [x.content for x in t.get_added_tokens_decoder().values()]


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, as the library gives them for the whole text.

    Pieces at safe boundaries are encoded by the library and joined; words go straight to its model. A text that holds
    a special token's string is encoded as a whole, since the library cuts it there first."""
    tokenizer, pieces, special = _tokenizer(path)
    get, find = pieces.__getitem__, _PIECES.findall
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if any(s in t for s in special) else b"".join(map(get, find(t))) for t in texts]


def combinations(lengths: np.ndarray, window: int, third: int = THIRD) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence without padding."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    out = [np.array([[n, 0, 0] for n in lengths if n & (n - 1) == 0 and n < window], dtype=np.int64).reshape(-1, 3)]
    two = lengths[(lengths * 2 <= window) & have[window - lengths]]
    out.append(np.stack([two, window - two, 0 * two], axis=1))
    for c in lengths[lengths % third == 0]:
        a = lengths[(lengths <= window - c - lengths) & (lengths + c < window)]
        a = a[have[window - c - a]]
        out.append(np.stack([a, window - c - a, 0 * a + c], axis=1))
    return np.concatenate(out)


def solve(columns: np.ndarray, histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """x >= 0 that brings A x close to the histogram: accelerated projected gradient on |A x - h|^2 / 2."""
    n = len(histogram)
    if not len(columns):
        return np.zeros(0)
    h = histogram.astype(np.float64)
    h[0] = 0
    used = np.bincount(columns.ravel(), minlength=n)
    used[0] = 0
    # A's entries are small counts: the largest row sum times the largest column sum bounds its squared norm.
    step = 1.0 / max(1.0, 3.0 * used.max())
    scale = np.sqrt(np.maximum(used, 1))
    x = np.min(np.where(columns > 0, (h / scale / scale)[columns], np.inf), axis=1)
    y, t = x, 1.0
    for _ in range(rounds):
        fit = np.bincount(columns.ravel(), weights=np.repeat(y, 3), minlength=n)
        fit[0] = 0
        miss = fit - h
        new = np.maximum(0, y - step * miss[columns].sum(axis=1))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (index of remainder, start in it, length), for remainders of 1 to window - 1 tokens."""
    histogram = np.bincount(lengths, minlength=window)
    columns = combinations(np.flatnonzero(histogram), window)
    x = solve(columns, histogram)
    queues: dict[int, list[int]] = {}
    for k in np.argsort(lengths, kind="stable")[::-1].tolist():
        queues.setdefault(int(lengths[k]), []).append(k)
    out: list[list[tuple[int, int, int]]] = []

    def take(combo: list[int], times: int) -> None:
        need: dict[int, int] = {}
        for n in combo:
            need[n] = need.get(n, 0) + 1
        times = min([times, *(len(queues.get(n, ())) // m for n, m in need.items())])
        for _ in range(times):
            out.append([(queues[n].pop(), 0, n) for n in combo])

    order = np.argsort(-x, kind="stable")
    for k in order[x[order] >= 1].tolist():
        take([n for n in columns[k].tolist() if n], int(x[k]))
    left = [k for n in sorted(queues, reverse=True) for k in queues[n]]
    row, room = [], window
    for k in left:
        at, n = 0, int(lengths[k])
        while n:
            m = min(n, room)
            row.append((k, at, m))
            at, n, room = at + m, n - m, room - m
            if not room:
                out.append(row)
                row, room = [], window
    out += _powers(row)
    return out


def _powers(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cuts the tokens of one sequence that isn't full into sequences whose lengths are powers of two."""
    out, total = [], sum(n for _, _, n in row)
    todo = list(reversed(row))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            k, at, n = todo.pop()
            m = min(n, room)
            part.append((k, at, m))
            room -= m
            if n > m:
                todo.append((k, at + m, n - m))
        out.append(part)
    return out


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _packed(ids: list, tokens: list[np.ndarray], first: int, window: int, with_ids: bool) -> tuple[list[tuple], int]:
    rows, sequence = [], first
    rest, owner = [], []
    for k, t in enumerate(tokens):
        full = len(t) // window * window
        for at in range(0, full, window):
            rows.append((k, at, window, sequence, 0))
            sequence += 1
        if len(t) > full:
            rest.append(len(t) - full)
            owner.append((k, full))
    if rest:
        for seq in plan(np.array(rest, dtype=np.int64), window):
            offset = 0
            for r, at, n in seq:
                k, base = owner[r]
                rows.append((k, base + at, n, sequence, offset))
                offset += n
            sequence += 1
    out = []
    for k, at, n, s, o in rows:
        piece = tokens[k][at : at + n]
        out.append((ids[k], at, n, zlib.crc32(piece.tobytes()), len(tokens[k]), s, o, *([piece.tolist()] if with_ids else [])))
    return out, sequence


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` its ids.

    Sequence ids are unique: the task's number in the upper bits, a count within it in the lower 33."""
    kind = docs.select(id_col).dtypes[0][1]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        Kept.mine("packing")
        sequence = TaskContext.get().partitionId() << 33
        ids, tokens, held, types = [], [], 0, None

        def flush():
            nonlocal sequence, ids, tokens, held
            rows, sequence = _packed(ids, tokens, sequence, window, with_ids)
            ids, tokens, held = [], [], 0
            columns = [list(c) for c in zip(*rows, strict=True)]
            kinds = [types, *[pa.int64()] * 6, *([pa.list_(pa.int64())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*_NAMES, *(["ids"] if with_ids else [])])

        for batch in batches:
            types = batch.schema.field(0).type
            for part in slices(batch, most=2 << 20):
                for key, t in zip(part.column(0).to_pylist(), token_ids([t or "" for t in part.column(1).to_pylist()], tokenizer_path), strict=True):
                    ids.append(key)
                    tokens.append(np.frombuffer(t + end, dtype="<u4"))
                    held += len(tokens[-1])
                if held >= block_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids)
