"""Ranked lexical search with inverted treaps.

*Index.* Documents are taken in blocks of about `BLOCK_BYTES` of text, each by one task from its own input, without a shuffle. A block has a row
for each of its terms, with the places (ranks by doc_id within the block) of the documents that hold it and its occurrences there, and one
row under the empty term with ids and lengths. The index is a plain table in the shared folder, knows nothing of other blocks, and
serves any items; global counts are sums over its rows.

*Treap.* A term's treap in a block has doc_id as search order and impact as heap order: `1000000000 tf div (1000 tf + 12 m)`, the
part of the score that belongs to a term in a document, without its weight. A treap is determined by keys and priorities, so the index
keeps those, and links are made when a block is read: a node's parent is the lesser of its nearest greater neighbours to either side,
found for all treaps at once by pointer jumping. Equal impacts are ordered by a hash of the document, so depth stays logarithmic
in expectation.

*Search.* An item walks the treaps of its terms at the same time. A range of documents has one node of each treap, the one of greatest
impact in it, so the weighted sum of these is what any document in the range can reach. Ranges under the k-th best score go; of
the others the best `STEP` are taken at a time: the document of the heaviest node is scored and splits its range, and each treap's node
moves down on either side until it is inside. Before the walk, the documents at the treaps' tops are scored, for a first bound.
A task keeps its best k over all its blocks; the k best of all tasks are a window with a limit before its shuffle.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Null and empty texts have no terms. An item
without terms that documents hold has no results; items that are null or have no id are left out; each distinct (id, text) is ranked by
itself. Rows that repeat a doc_id are documents of their own; equal scores go by doc_id, null ids last (equal ids: either order gives
the same rows). Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from planquant.llm.common import arrow_map, compact, parts_for, shared_table
from planquant.llm.decontamination import _BLANK

K = 20
#: Text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
#: Text whose words are held at a time.
PIECE_BYTES = 1 << 20
#: Items of one pass over the index, by their text: what is broadcast of them.
ITEM_BYTES = 16 << 20
#: Ranges that are split at a time; nodes of each treap that are scored before the walk.
STEP, TOPS = 256, 32
#: Rows of the index in an Arrow batch.
ROWS = 512

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# Index.
def _pieces(text: bytes):
    """The text's terms, blanks between them, in pieces of about `PIECE_BYTES`."""
    text = text.translate(_BLANK)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE_BYTES else text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class _Block:
    """Terms and places of the documents that a task has met since the last block."""

    def __init__(self):
        self.ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.texts, self.lengths, self.words, self.bytes = [], [], [], 0

    def add(self, doc_id: pa.Scalar, text: bytes) -> None:
        words = [np.fromiter(map(self.ids.__getitem__, w), np.int32, len(w)) for w in map(bytes.split, _pieces(text))]
        self.texts.append(doc_id)
        self.lengths.append(sum(map(len, words)))
        self.words += words
        self.bytes += len(text) + 64

    def rows(self, block: str, id_type: pa.DataType, schema: pa.Schema):
        """One batch of terms after the other, sorted by term; the empty term first."""
        import pyarrow.compute as pc

        ids = pa.array([x.as_py() for x in self.texts], id_type)
        order = np.asarray(pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end"), np.int64)
        lengths = np.array(self.lengths, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = sorted(self.ids)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter((self.ids[w] for w in names), np.int64, len(names))] = np.arange(len(names))
        word = np.concatenate(self.words) if self.words else np.zeros(0, np.int32)
        pair = rank[word] * len(order) + np.repeat(place, lengths)
        self.words = []
        pair.sort()
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        tf = np.diff(first, append=len(pair)).astype(np.int32)
        term, doc = np.divmod(pair[first], max(len(order), 1))
        starts = np.searchsorted(term, np.arange(len(names) + 1)).astype(np.int32)
        ints = pa.list_(pa.int32())
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([""]), pa.array([len(order)], pa.int32()), pa.nulls(1, ints), whole(pa.array(lengths[order].astype(np.int32))), whole(ids.take(pa.array(order)))], schema=schema)
        for a in range(0, len(names), ROWS):
            at = starts[a : min(a + ROWS, len(names)) + 1]
            n, lo, hi = len(at) - 1, at[0], at[-1]
            lists = [pa.ListArray.from_arrays(pa.array(at - lo), pa.array(x[lo:hi].astype(np.int32))) for x in (doc, tf)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n), pa.array([w.decode() for w in names[a : a + n]]), pa.array(np.diff(at)), *lists, pa.nulls(n, pa.list_(id_type))], schema=schema)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index, written in the shared folder: block, term, df (documents of the block that hold it), places, counts, ids (with the empty term only, where
    df counts all documents and counts are their terms)."""
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches):
        import os

        block, done, number = _Block(), None, itertools.count()
        task = os.urandom(8).hex()
        for batch in batches:
            id_type = batch.schema.field(0).type
            done = pa.schema([("block", pa.string()), ("term", pa.string()), ("df", pa.int32()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(id_type))])
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                if block.texts and block.bytes + len(text) > block_bytes:
                    yield from block.rows(f"{task}-{next(number)}", id_type, done)
                    block = _Block()
                block.add(doc_id, text)
        if block.texts:
            yield from block.rows(f"{task}-{next(number)}", id_type, done)

    return shared_table(arrow_map(docs.select(id_col, text_col), run, f"block string, term string, df int, places array<int>, counts array<int>, ids array<{kind}>"), "index")


# Treaps.
def links(priority: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right child of every node of treaps that stand one behind the other (a new one at each of `starts`, the end last), in order of keys;
    -1 for none. Priorities of a treap differ."""
    n = len(priority)
    own = np.arange(n)
    tree = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    lo, hi = starts[:-1][tree], starts[1:][tree]

    def nearest(step: int, inside) -> np.ndarray:
        """The nearest node of greater priority on one side, or the first place outside the treap."""
        at = own + step
        todo = own[inside(at, own)]
        todo = todo[priority[at[todo]] < priority[todo]]
        while len(todo):
            at[todo] = at[at[todo]]
            todo = todo[inside(at[todo], todo)]
            todo = todo[priority[at[todo]] < priority[todo]]
        return at

    before = nearest(-1, lambda at, k: at >= lo[k])
    after = nearest(1, lambda at, k: at < hi[k])
    has_before, has_after = before >= lo, after < hi
    great = np.iinfo(priority.dtype).max
    p = np.where(has_before, priority[np.where(has_before, before, 0)], great)
    q = np.where(has_after, priority[np.where(has_after, after, 0)], great)
    left, right = np.full(n, -1), np.full(n, -1)
    is_right = has_before & (p < q)
    is_left = has_after & (q < p)
    right[before[is_right]] = own[is_right]
    left[after[is_left]] = own[is_left]
    return left, right


class Treaps:
    """The treaps of a block: for its terms, nodes in order of (term, place)."""

    def __init__(self, starts: np.ndarray, places: np.ndarray, counts: np.ndarray, lengths: np.ndarray, n_documents: int, n_terms: int):
        n = lengths.astype(np.int64)
        m = 75 + (25 * n * n_documents) // max(n_terms, 1)
        tf = counts.astype(np.int64)
        self.starts, self.place = starts.astype(np.int64), places.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.place])
        mixed = (self.place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
        priority = np.empty(len(tf), np.int64)
        priority[np.lexsort((self.place, mixed, self.impact))] = np.arange(len(tf))
        self.left, self.right = links(priority, self.starts)
        # A last node stands for none.
        self.left, self.right = (np.append(np.where(x < 0, len(tf), x), len(tf)) for x in (self.left, self.right))
        self.place = np.append(self.place, -1)
        self.impact = np.append(self.impact, 0)
        self.none = len(tf)
        top = np.ones(len(tf) + 1, bool)
        top[self.left] = top[self.right] = False
        self.roots = np.flatnonzero(top[:-1])  # one a treap, in order

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents that score at least `least`, by score and place."""
        best_place, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return best_place, best_score
        weights = weights.astype(np.int64)
        lo, hi = self.starts[terms], self.starts[terms + 1]
        docs = 1 + int(self.place.max())
        # Nodes of the item's treaps by (term, place), for looking a document up.
        mine = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        keys = np.repeat(np.arange(len(terms)), hi - lo) * docs + self.place[mine]
        column = np.arange(len(terms)) * docs

        def scores(places: np.ndarray) -> np.ndarray:
            want = places[:, None] + column
            at = np.minimum(np.searchsorted(keys, want.ravel()).reshape(want.shape), len(keys) - 1)
            return np.where(keys[at] == want, self.impact[mine[at]] * weights, 0).sum(axis=1)

        def offer(places: np.ndarray, found: np.ndarray) -> None:
            nonlocal best_place, best_score
            places, found = np.append(best_place, places), np.append(best_score, found)
            places, at = np.unique(places, return_index=True)
            found = found[at]
            order = np.lexsort((places, -found))[:k]
            order = order[found[order] >= least]
            best_place, best_score = places[order], found[order]

        level = self.roots[terms]
        tops = [level]
        while sum(map(len, tops)) < TOPS * len(terms) and len(level):
            level = np.concatenate([self.left[level], self.right[level]])
            level = level[level != self.none]
            tops.append(level)
        seeds = np.unique(self.place[np.concatenate(tops)])
        offer(seeds, scores(seeds))

        def open_(nodes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
            """Ranges that can still enter, and what they can reach; ties only with a document before the k-th best."""
            reach = self.impact[nodes] @ weights
            bound, last = (best_score[-1], best_place[-1]) if len(best_place) == k else (least, docs)
            keep = (reach > bound) | ((reach == bound) & (first < last))
            return nodes[keep], first[keep], end[keep], reach[keep]

        nodes, first, end, reach = open_(self.roots[terms][None, :], np.zeros(1, np.int64), np.full(1, docs))
        while len(nodes):
            later = np.zeros(0, np.int64)
            if len(nodes) > STEP:
                order = np.argpartition(-reach, STEP)
                now, later = order[:STEP], order[STEP:]
            else:
                now = slice(None)
            n, f, e = nodes[now], first[now], end[now]
            pivot = self.place[n[np.arange(len(n)), np.argmax(self.impact[n] * weights, axis=1)]]
            offer(pivot, scores(pivot))
            low, high = self._inside(n, f, pivot), self._inside(n, pivot + 1, e)
            nodes, first, end, reach = open_(np.concatenate([nodes[later], low, high]), np.concatenate([first[later], f, pivot + 1]), np.concatenate([end[later], pivot, e]))
        return best_place, best_score

    def _inside(self, nodes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The nodes of greatest impact in the ranges, from nodes above them."""
        shape = nodes.shape
        nodes = nodes.ravel().copy()
        place = self.place[nodes]
        first, end = (np.repeat(x, shape[1]) for x in (first, end))
        at = np.flatnonzero((nodes != self.none) & ((place < first) | (place >= end)))
        while len(at):
            own = nodes[at]
            moved = np.where(self.place[own] < first[at], self.right[own], self.left[own])
            nodes[at] = moved
            place = self.place[moved]
            at = at[(moved != self.none) & ((place < first[at]) | (place >= end[at]))]
        return nodes.reshape(shape)


# Search.
def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, digest, term, n): distinct items with the terms of each and how often it has them."""
    kept = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null and text is not null").distinct()
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = kept.select("item_id", F.sha2("text", 256).alias("digest"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item_id", "digest", "term").agg(F.count(F.lit(1)).alias("n"))


def _passes(items: DataFrame, text_col: str) -> list[DataFrame]:
    """The items in parts of at most `ITEM_BYTES` of text, about."""
    total = items.agg(F.sum(F.octet_length(text_col))).head()[0] or 0
    n = 1 if total <= ITEM_BYTES else -(-2 * total // ITEM_BYTES)
    return [items.filter(F.pmod(F.xxhash64(text_col), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def _groups(batches):
    """(block, terms, starts, places, counts, lengths, ids) of each block in rows that are sorted by block and term."""
    held: list[pa.RecordBatch] = []

    def whole(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        head, body = t.slice(0, 1), t.slice(1)
        if head["term"][0].as_py() != "":
            raise RuntimeError("index: a block without its documents")
        lists = [body[c].combine_chunks() for c in ("places", "counts")]
        flat = [np.asarray(x.flatten(), np.int64) if len(x) else np.zeros(0, np.int64) for x in lists]
        starts = np.concatenate([[0], np.cumsum(np.asarray(body["df"], np.int64))])
        return body["term"].to_pylist(), starts, *flat, np.asarray(head["counts"].combine_chunks().flatten(), np.int64), head["ids"].combine_chunks().flatten()

    for batch in batches:
        a, names = 0, batch.column(0).to_pylist()
        for b in [*(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]:
            if a < b:
                if held and held[0].column(0)[0].as_py() != names[a]:
                    yield whole(held)
                    held = []
                held.append(batch.slice(a, b - a))
            a = b
    if held:
        yield whole(held)


def _best_first(found: tuple) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, 0 if doc_id is None else doc_id


def search(indexed: DataFrame, items: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item that score over 0."""
    spark = indexed.sparkSession
    doc_kind = dict(indexed.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    item_kind = items.select(item_col).dtypes[0][1]
    whole = indexed.filter("term = ''").agg(F.sum(F.size(F.filter("counts", lambda c: c > 0))), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c))).head()
    n_documents, n_terms = whole[0] or 0, whole[1] or 0
    parts = parts_for(indexed)
    found = None
    for some in _passes(items, text_col):
        asked = item_terms(some, item_col, text_col)
        own = F.broadcast(asked.select("term").distinct())  # at most ITEM_BYTES
        df = {r["term"]: r["df"] for r in indexed.select("term", "df").join(own, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n + 1))) for t, n in df.items()}
        queries: dict[tuple, list[tuple[str, int]]] = {}
        for r in asked.collect():
            if weight.get(r["term"], 0) > 0:
                queries.setdefault((r["item_id"], r["digest"]), []).append((r["term"], weight[r["term"]] * r["n"]))
        held = spark.sparkContext.broadcast(list(queries.items()))
        terms = spark.createDataFrame([(t,) for q in ([""], sorted({t for q in queries.values() for t, _ in q})) for t in q], "term string")

        def run(batches, held=held):
            best: dict[int, list[tuple]] = {}
            for names, starts, places, counts, lengths, ids in _groups(batches):
                treaps = Treaps(starts, places, counts, lengths, n_documents, n_terms)
                number = {t: j for j, t in enumerate(names)}
                for q, (_, wanted) in enumerate(held.value):
                    mine = [(number[t], w) for t, w in wanted if t in number]
                    old = best.get(q, [])
                    at, score = treaps.search(np.array([x for x, _ in mine], np.int64), np.array([w for _, w in mine], np.int64), k, max(1, old[-1][0] if len(old) == k else 1))
                    if len(at):
                        new = list(zip(score.tolist(), ids.take(pa.array(at)).to_pylist(), strict=True))
                        best[q] = sorted(old + new, key=_best_first)[:k]
            rows = [(*held.value[q][0], d, s) for q, found in best.items() for s, d in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (item_type, pa.string(), doc_type, pa.int64()), strict=True)], ["item_id", "digest", "doc_id", "score"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type, doc_type = (to_arrow_type(x.schema[c].dataType) if c else to_arrow_type(x.schema["ids"].dataType.elementType) for x, c in ((items, item_col), (indexed, None)))
        blocks = indexed.join(F.broadcast(terms), "term", "left_semi").select("block", "term", "df", "places", "counts", "ids")
        dealt = blocks.repartition(parts, "block").sortWithinPartitions("block", "term")
        one = dealt.mapInArrow(run, f"item_id {item_kind}, digest string, doc_id {doc_kind}, score long")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("item_id", "digest").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
