"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Texts and items are lower-cased (A-Z) and cut into words of ASCII digits, letters and non-ASCII characters.
A window is 13 consecutive words of an item, or the whole of a shorter item. The automaton holds every distinct
window, with a blank on either side of each word, and scans a document's joined words once; overlapping
occurrences are all found. Word positions are mapped to code-point offsets of the original text on demand.

The items are collected only in shards of at most `SHARD_BYTES`; every shard has an automaton of its own, and a
table that needs several is scanned once by each, one Arrow step after the other, without a shuffle.

Null or empty texts have no words and are never contaminated; items that are null, empty, or without an id have no
windows. Items that repeat a text all count; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planquant.llm.common import Kept, arrow_map, slices

SHARD_BYTES = 16 << 20
WINDOW = 13

_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BLANK).split()


def windows_of(text: bytes, size: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Automaton:
    """Windows of items, and what a text has of them."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set] = {}
        for item, text in items:
            if item is not None and text is not None:
                for w in windows_of(text.encode(), size):
                    owners.setdefault(w, set()).add(str(item))
        self.owners, self.lengths = [], []
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (w, who) in enumerate(owners.items()):
            self.find.add_word(f" {w.decode('latin-1')} ", k)
            self.owners.append(who)
            self.lengths.append(w.count(b" ") + 1)
        self.find.make_automaton()
        self.empty = not owners

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged [first, end) word ranges that windows cover, ids of the items they come from."""
        words = words_of(text)
        if not words or self.empty:
            return len(words), [], set()
        joined = b" " + b" ".join(words) + b" "
        hits = list(self.find.iter(joined.decode("latin-1")))
        if not hits:
            return len(words), [], set()
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        ends = np.searchsorted(blanks, [e for e, _ in hits])
        ranges: list[tuple[int, int]] = []
        for a, b in sorted((int(e) - self.lengths[k], int(e)) for e, (_, k) in zip(ends, hits, strict=True)):
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        return len(words), ranges, set().union(*(self.owners[k] for _, k in hits))


def original_spans(text: str, ranges) -> list[dict]:
    """Code-point [start, end) of word ranges in the text as it was."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


_built = Kept("decontamination", 1)


def _automaton(key: str, items, size: int) -> Automaton:
    if key not in _built:
        _built.clear()
        _built.put(key, Automaton(items.value, size))
    return _built[key]


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, share: int = 20, with_spans: bool = False, keep_columns: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), contaminated (n_hit > 0 and share * n_hit >= n_words), and with
    `with_spans` the covered code-point spans of the original text. With `keep_columns`, these columns of docs instead,
    of the rows that aren't contaminated."""
    sc = docs.sparkSession.sparkContext
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-2 * total // SHARD_BYTES)) if total > SHARD_BYTES else 1  # hashed shards are uneven: twice as many
    kind = docs.select(id_col).dtypes[0][1]
    rest = F.struct(*keep_columns) if keep_columns else F.lit(None)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))
    whole = out.schema
    body = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole["rest"].dataType.fields) if keep_columns else ""
    for k in range(n):
        shard = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r[0], r[1]) for r in shard.toLocalIterator()]
        key = hashlib.sha256(repr(sorted(map(repr, rows))).encode()).hexdigest()
        held = sc.broadcast(rows)
        last = k == n - 1

        def run(batches, key=key, held=held, first=k == 0, last=last):
            Kept.mine("decontamination")
            find = _automaton(key, held, size)
            for batch in batches:
                for part in slices(batch):
                    texts = part.column(1).cast(pa.binary()).to_pylist()
                    found = [find.scan(t or b"") for t in texts]
                    n_words = pa.array([x[0] for x in found], pa.int64())
                    ranges, who = [x[1] for x in found], [x[2] for x in found]
                    if not first:
                        ranges = [_merged(r, [(x["first"], x["end"]) for x in old]) for r, old in zip(ranges, part.column(4).to_pylist(), strict=True)]
                        who = [w.union(old) for w, old in zip(who, part.column(5).to_pylist(), strict=True)]
                    if not last:
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), n_words, pa.array([[{"first": a, "end": b} for a, b in r] for r in ranges], _RANGES), pa.array([sorted(w) for w in who], pa.list_(pa.string()))], ["doc_id", "text", "rest", "n_words", "ranges", "items"])
                        continue
                    hit = np.array([sum(b - a for a, b in r) for r in ranges], dtype=np.int64)
                    bad = (hit > 0) & (share * hit >= np.asarray(n_words))
                    if keep_columns:
                        kept = part.column(2).filter(pa.array(~bad))
                        yield pa.RecordBatch.from_arrays(kept.flatten(), keep_columns)
                        continue
                    columns = [part.column(0), n_words, pa.array(hit), pa.array([sorted(w) for w in who], pa.list_(pa.string())), pa.array(bad)]
                    names = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
                    if with_spans:
                        columns.append(pa.array([original_spans((t or b"").decode(), r) for t, r in zip(texts, ranges, strict=True)], _SPANS))
                        names.append("spans")
                    yield pa.RecordBatch.from_arrays(columns, names)

        if not last:
            schema = f"doc_id {kind}, text string, rest {whole['rest'].dataType.simpleString()}, n_words long, ranges array<struct<first: long, end: long>>, items array<string>"
        elif keep_columns:
            schema = body
        else:
            schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, contaminated boolean" + ", spans array<struct<start: long, end: long>>" * with_spans
        out = arrow_map(out, run, schema)
    return out
