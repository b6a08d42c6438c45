"""N-gram Jaccard join: MinHash banding, then every pair verified on full shingle sets.

Words are runs other than ASCII white space; a text's set holds the 64-bit hashes of its runs of five words (a shorter
text, if it has words, is one run). Texts with equal sets are copies: they share one digest before anything is paired, and
digests, not ids, stand for texts until classes are named.

1. Bands and rows are chosen for a target recall at the threshold (`banding`): as many rows a band as the number of
   hashes allows. Digests shuffle on band hashes; within a bucket each only meets the smallest, so a bucket
   of any size gives as many rows as it has members. The components of these links are the candidate groups.
2. A candidate group is verified as a whole, on full sets: a group of over `BLOCK` members or `BLOCK_HASHES` hashes is
   dealt into blocks by a hash, and every pair of blocks is a unit of work of its own with bounded memory. Blocks grow with the
   square root of a group, so that neither units nor the times that a set is sent grow in step with it. A unit counts common
   shingles by matrix products and returns one row per member: its links, weighted by copies, and the smallest
   member it hangs together with. No pair is emitted, none is capped or dropped.
3. Components of verified links give the class: its smallest id.

Null and empty texts have no set, no links and a class of their own. Rows that repeat an id and text count as copies.
Texts under a null or repeated id are linked as any other; a null id never names a class while a member has an id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planquant.llm.common import Kept, arrow_map, compact, cut, parts_for, shared_table, slices
from planquant.llm.components import components

SIZE = 5
THRESHOLD = (4, 5)
RECALL = 0.999
HASHES = 144
#: Sets in a block: this many, or three times the root of the group's size where that is more; hashes in a block, about.
BLOCK = 128
BLOCK_HASHES = 1 << 20
#: Words whose hashes a worker keeps.
WORDS = 100_000


def banding(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows with which `hashes` values find a pair at the threshold with this probability."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


class _Words(Kept):
    """Hashes of words; the same on every machine."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        return self.put(word, xxhash.xxh3_64_intdigest(word))


_words = _Words("near_duplicates", WORDS)
_rng = np.random.RandomState(20240501)
_PLACE = _rng.randint(1, 2**62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.randint(1, 2**62, 1024).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        total += h[j : j + n] * _PLACE[j]
    return np.unique(_mixed(total))


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value per band, from bands * rows minima."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 4096):
        part = s[a : a + 4096, None] * _FACTOR[None, : bands * rows]
        np.minimum(least, part.min(axis=0), out=least)
    return _mixed((least.reshape(bands, rows) * _PLACE[:rows]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that differ in id or text, where ids are null or repeated too."""
    return F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.sha2(F.col(text_col), 256)), 256)


def signatures(docs: DataFrame, bands: int, rows: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, digest, size, bands) of every row; digest and bands are null for texts without words."""

    def run(batches):
        Kept.mine("near_duplicates")
        for batch in batches:
            for part in slices(batch):
                keys, found, sizes = [], [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    s = shingles(t or b"", size)
                    keys.append(digest(s) if len(s) else None)
                    found.append(band_hashes(s, bands, rows) if len(s) else None)
                    sizes.append(len(s))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "key", "digest", "size", "bands"])

    kind = docs.select(id_col).dtypes[0][1]
    return arrow_map(docs.select(id_col, text_col, row_key(id_col, text_col).alias("key")), run, f"id {kind}, key string, digest binary, size long, bands array<long>")


def common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Numbers of common hashes of each of `sets` with each of `others`."""
    out = np.zeros((len(sets), len(others)), dtype=np.float32)
    left, right = np.concatenate(sets), np.concatenate(others)
    both = np.intersect1d(left, right)
    if not len(both):
        return out.astype(np.int64)
    row_l, row_r = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.repeat(np.arange(len(others)), [len(s) for s in others])
    at_l, at_r = np.searchsorted(both, left), np.searchsorted(both, right)
    ok_l, ok_r = both[np.minimum(at_l, len(both) - 1)] == left, both[np.minimum(at_r, len(both) - 1)] == right
    row_l, at_l, row_r, at_r = row_l[ok_l], at_l[ok_l], row_r[ok_r], at_r[ok_r]
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    row_l, at_l, row_r, at_r = row_l[order_l], at_l[order_l], row_r[order_r], at_r[order_r]
    step = 4096
    for a in range(0, len(both), step):
        i, j = np.searchsorted(at_l, [a, a + step]), np.searchsorted(at_r, [a, a + step])
        x, y = np.zeros((len(sets), step), dtype=np.float32), np.zeros((len(others), step), dtype=np.float32)
        x[row_l[i[0] : i[1]], at_l[i[0] : i[1]] - a] = 1
        y[row_r[j[0] : j[1]], at_r[j[0] : j[1]] - a] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def linked(sets: list[np.ndarray], others: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least the threshold."""
    both = common(sets, others)
    total = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others])[None, :]
    return both * (threshold[0] + threshold[1]) >= threshold[0] * total


def _unit(ids: list, copies: list[int], sets: list[np.ndarray], mine: list[bool], same: bool, threshold: tuple[int, int]) -> list[tuple]:
    """(id, links weighted by copies, smallest member it hangs together with) of the members of a pair of blocks."""
    a = [k for k, m in enumerate(mine) if m]
    b = a if same else [k for k, m in enumerate(mine) if not m]
    if not a or not b:
        return []
    link = linked([sets[k] for k in a], [sets[k] for k in b], threshold)
    if same:
        np.fill_diagonal(link, False)
    weight = np.array(copies)
    parent = list(range(len(ids)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    # Rows with the same partners need one union each: a member with its first partner, and each partner with it.
    for x, row in zip(a, link, strict=True):
        for y in np.flatnonzero(row).tolist():
            p, q = top(x), top(b[y])
            if p != q:
                p, q = (p, q) if ids[p] < ids[q] else (q, p)
                parent[q] = p
    n = np.zeros(len(ids), dtype=np.int64)
    n[a] += link @ weight[b]
    if not same:
        n[b] += link.T @ weight[a]
    return [(ids[k], int(n[k]), ids[top(k)]) for k in range(len(ids)) if n[k]]


def classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, size: int = SIZE, block: int = BLOCK, block_hashes: int = BLOCK_HASHES, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False) -> DataFrame:
    """(id, class_id, n_links) of every row: the smallest id of its class, and how many other rows it is linked to. With `with_rows` also
    `row_key` of the row, and is_first: whether it is the row that stands for its class, the one of smallest id (null ids last), then
    smallest key; rows that repeat its id and text are so too, and a text without words stands for itself."""
    bands, rows = banding(threshold[0] / threshold[1], recall)
    found = shared_table(signatures(docs, bands, rows, size, id_col, text_col), "signatures")
    sets = found.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key")).alias("rep"), F.min("key").alias("key"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    parts = parts_for(found)  # what follows is smaller
    sets = cut(compact(sets, parts))

    # Candidate groups: in each bucket, every set meets that of the smallest digest.
    marks = found.filter("digest is not null").select("digest", "key", "bands").join(sets.select("digest", "key"), ["digest", "key"], "left_semi")
    marks = marks.dropDuplicates(["digest", "key"]).select("digest", F.posexplode("bands").alias("band", "mark"))
    least = marks.groupBy("band", "mark").agg(F.min("digest").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "mark", "root")
    groups = components(marks.join(least, ["band", "mark"]).select(F.col("digest").alias("a"), F.col("root").alias("b")), parts)

    # Units: pairs of blocks of a group.
    sized = groups.select(F.col("node").alias("digest"), "root").join(sets, "digest")
    n, hashes = F.count(F.lit(1)), F.sum("size")
    blocks = F.greatest(F.ceil(n / F.greatest(F.lit(block), F.ceil(3 * F.sqrt(n)))), F.ceil(hashes / block_hashes)).cast("int")
    members = sized.join(sized.groupBy("root").agg(blocks.alias("n_blocks")), "root")
    members = members.select("key", "root", "n_blocks", F.pmod(F.xxhash64("digest"), "n_blocks").cast("int").alias("own"), "digest", "copies")
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).filter("text is not null")
    chosen = texts.join(members.hint("shuffle_hash"), "key")

    def to_sets(batches):
        Kept.mine("near_duplicates")
        for batch in batches:
            for part in slices(batch):
                out = [shingles(t, size).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("root"), part.column("n_blocks"), part.column("own"), part.column("copies"), pa.array(out, pa.binary())], ["digest", "root", "n_blocks", "own", "copies", "hashes"])

    filled = arrow_map(chosen.select("key", "text", "root", "n_blocks", "own", "digest", "copies"), to_sets, "digest binary, root binary, n_blocks int, own int, copies long, hashes binary", parts_for(docs))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    units = filled.select("digest", "root", "own", "copies", "hashes", other).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "copies", "hashes")
    units = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def to_links(batches):
        key, held = None, {}

        def done():
            ids = list(held)
            return _unit(ids, [held[x][0] for x in ids], [np.frombuffer(held[x][1], np.uint64) for x in ids], [held[x][2] == key[1] for x in ids], key[1] == key[2], threshold)

        for batch in batches:
            out = []
            for root, i, j, own, who, copies, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (root, i, j):
                    if held:
                        out += done()
                    key, held = (root, i, j), {}
                held[who] = (copies, hashes, own)
            if out:
                yield _links(out)
        if held and (out := done()):
            yield _links(out)

    def _links(out):
        a, n, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(b, pa.binary())], ["digest", "n", "least"])

    links = cut(arrow_map(units, to_links, "digest binary, n long, least binary", parts))
    roots = components(links.select(F.col("digest").alias("a"), F.col("least").alias("b")), parts)
    counts = links.groupBy("digest").agg(F.sum("n").alias("n"))
    verdict = counts.join(roots.withColumnRenamed("node", "digest"), "digest")
    placed = sets.join(verdict, "digest", "left").select("digest", "rep", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    firsts = placed.filter("root is not null").groupBy("root").agg(F.min("rep").alias("first"))
    named = placed.join(firsts, "root", "left").select("digest", F.coalesce("first", "rep").alias("first"), "n_links")
    out = compact(found.select("id", "key", "digest").join(named, "digest", "left"), parts)
    own = F.col("first").isNull() | (F.col("key") == F.col("first.key"))
    return out.select("id", F.coalesce("first.id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *([F.col("key"), own.alias("is_first")] if with_rows else []))
