"""Fill-in-middle, ranked search and sharding against brute force, and the awkward inputs."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planquant.llm import fill_in_middle as FM, ranked_search as R, sharding as H
from planquant.llm.queries import QUERIES
from tests.llm.test_ops import ODD, empty, odd, prose  # noqa: F401

MARKED = ["a <P> b", "<S>", "x<M>", "a < b <S", "<<P", "<M <S> y", "\x00 a\x00b", "ünï cödé 漢字 👍🏽 z", "trailing  \n"]


def key(x):
    return tuple((v is not None, v) for v in x)


# Fill-in-middle.
def reordered(doc_id, text):
    text = text or ""
    tokens = re.findall(FM.TOKEN, text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_is_the_brute_force(spark, odd, empty):  # noqa: F811
    more = spark.createDataFrame([(k, t) for k, t in enumerate(MARKED * 30 + [prose(k, 40) for k in range(60)], start=100)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "n_words", "spans").unionByName(more, allowMissingColumns=True)
    out = FM.fill_in_middle(docs)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=key) == sorted((reordered(r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", FM.restored("output", "form").alias("text")).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=key)
    assert FM.fill_in_middle(empty).count() == 0


def test_fill_in_middle_of_other_id_types_and_shares(spark):
    docs = spark.createDataFrame([(f"id{k}", prose(k, 30)) for k in range(20)], "name string, body string")
    out = FM.fill_in_middle(docs, seed=7, share=100, spm_share=0, id_col="name", text_col="body").collect()
    assert len(out) == 20 and {r["form"] for r in out} == {"psm"} and isinstance(out[0]["doc_id"], str)


# Ranked search.
def ranked(docs, items, k=R.K):
    words = lambda t: re.findall(R.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        found = []
        for doc_id, c in docs:
            n = sum(c.values())
            m = 75 + 25 * n * n_docs // n_terms if n_terms else 0
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(words(text)).items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], start=1)]
    return sorted(out, key=key)


@pytest.mark.parametrize("block_bytes", [300, 1 << 25])
def test_ranked_search_is_the_brute_force(spark, odd, empty, block_bytes):  # noqa: F811
    rng = np.random.RandomState(3)
    texts = [" ".join(f"w{min(int(rng.zipf(1.4)), 60)}" for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["w1 w2 w3"] * 90 + ["W5 w6, w7 Ünï"] * 3
    docs = spark.createDataFrame([*[(k, t) for k, t in enumerate(texts, start=1000)], (1000, "w1 w9"), (None, "w2 w2 w2"), (None, None)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    items = spark.createDataFrame([(1, "w1 w2 w3 w2"), (2, "w40 w41 w5 w59"), (3, "nothing here"), (4, None), (None, "w1"), (5, "w1"), (5, "w6 ÜNÏ"), (6, ""), (7, "w3 w7 w9 w11 w13 w2 w1 x")], "item_id long, text string")
    got = sorted(map(tuple, R.search(R.index(docs.repartition(3), block_bytes=block_bytes), items).collect()), key=key)
    assert got == ranked([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert R.search(R.index(empty), items).count() == 0
    assert R.search(R.index(docs), items.filter("item_id < 0")).count() == 0


def test_items_in_several_passes_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k, prose(k, 60)) for k in range(120)], "doc_id long, text string")
    items = spark.createDataFrame([(k, prose(k, 12)) for k in range(20)], "item_id long, text string")
    want = sorted(map(tuple, R.search(R.index(docs), items).collect()), key=key)
    monkeypatch.setattr(R, "ITEM_BYTES", 400)
    assert len(R._passes(items, "text")) > 1
    assert sorted(map(tuple, R.search(R.index(docs), items).collect()), key=key) == want


def test_long_texts_are_indexed_in_pieces(spark, monkeypatch):
    text = ("Alpha beta, gamma_delta ünï " * 500).strip()
    monkeypatch.setattr(R, "PIECE_BYTES", 50)
    assert b"".join(R._pieces(text.encode())).split() == text.encode().translate(R._BLANK).split()
    block = R._Block()
    import pyarrow as pa

    block.add(pa.scalar(1), text.encode())
    assert block.lengths == [2500] and len(block.ids) == 5


def test_treap_links():
    rng = np.random.RandomState(1)
    sizes = [1, 2, 7, 40, 1, 300]
    starts = np.cumsum([0, *sizes])
    priority = rng.permutation(starts[-1])
    left, right = R.links(priority, starts)
    for a, b in zip(starts, starts[1:]):

        def walk(lo, hi):
            if lo == hi:
                return -1
            top = lo + int(np.argmax(priority[lo:hi]))
            assert left[top] == walk(lo, top) and right[top] == walk(top + 1, hi)
            return top

        walk(a, b)


def test_search_prunes():
    """Far fewer documents are scored than match."""
    rng = np.random.RandomState(5)
    docs = 20_000
    lengths = rng.randint(20, 400, docs)
    terms = [np.sort(rng.choice(docs, n, replace=False)) for n in (15_000, 9_000, 400, 30)]
    starts = np.cumsum([0, *map(len, terms)])
    treaps = R.Treaps(starts, np.concatenate(terms), rng.randint(1, 4, starts[-1]), lengths, docs, int(lengths.sum()))
    seen = []
    inside = treaps._inside
    treaps._inside = lambda n, *a: seen.append(len(n)) or inside(n, *a)
    at, score = treaps.search(np.arange(4), np.array([300, 700, 4000, 6500]), 20, 1)
    full = np.zeros(docs, np.int64)
    for t, w in enumerate((300, 700, 4000, 6500)):
        full[terms[t]] += w * treaps.impact[starts[t] : starts[t + 1]]
    order = np.lexsort((np.arange(docs), -full))[:20]
    assert at.tolist() == order.tolist() and score.tolist() == full[order].tolist()
    assert sum(seen) / 2 < docs / 10


# Sharding.
@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_steps_of_one(spark, n, bits):
    points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ", ".join(f"x{k} int" for k in range(n)))
    rows = sorted(points.select("*", H.hilbert_index([F.col(f"x{k}") for k in range(n)], bits).alias("h")).collect(), key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(p[k] - q[k]) for k in range(n)) == 1 for p, q in zip(rows, rows[1:]))


def curve_index(x, bits):
    """The published transposition, on a list of coordinates."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    q = 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def sharded(rows, n_shards, bits=H.BITS):
    """Brute force over (doc_id, text, lang, source, n_chars)."""

    def number(v):
        if v is None:
            return 0
        return 1 if v < 0 else 2 + max(v.bit_length(), 1) * 1024 + ((v >> (v.bit_length() - 11)) if v.bit_length() > 11 else v << (11 - max(v.bit_length(), 1))) % 1024

    def strings(values):
        known = [v for v in values if v is not None]
        same = 0
        while known and all(len(v) > same for v in known) and len({v[same] for v in known}) == 1:
            same += 1
        return [0 if v is None else 1 + int.from_bytes((v[same : same + 2].encode()[:2] + b"\0\0")[:2], "big") for v in values]

    def coordinates(keys):
        counts = Counter(keys)
        at, before = {}, 0
        for k in sorted(counts):
            at[k] = (2 * before + counts[k]) * (1 << bits) // (2 * len(keys))
            before += counts[k]
        return [at[k] for k in keys]

    axes = [coordinates(strings([r[2] for r in rows])), coordinates(strings([r[3] for r in rows])), coordinates([number(r[4]) for r in rows])]
    full = []
    for r, *at in zip(rows, *axes):
        raw = (r[1] or "").encode()
        full.append((curve_index(at, bits), len(raw) + 8, zlib.crc32(raw), (r[0] is not None, r[0])))
    out, total = [], len(rows)
    for rank, (_, size, crc, (_, doc_id)) in enumerate(sorted(full)):
        short, longer = divmod(total, n_shards)
        ends = list(itertools.accumulate([short + (k < longer) for k in range(n_shards)]))
        shard = next(k for k, e in enumerate(ends) if rank < e)
        out.append((doc_id, size, crc, "rows", shard, rank - (ends[shard - 1] if shard else 0), None))
    return sorted(out, key=key)


@pytest.mark.parametrize("n_rows", [0, 5, 500])
def test_sharding_is_the_brute_force(spark, n_rows):
    rng = np.random.RandomState(n_rows)
    langs, sources = ["en", "de", "fr", None, "é"], [None, "src1", "src10", "src2", "s"]
    rows = [(int(k) if k % 50 else None, None if k % 17 == 0 else prose(k % 40, 5 + k % 30), langs[rng.randint(5)], sources[rng.randint(5)], [None, -3, 0, int(rng.randint(1 << 20))][rng.randint(4)]) for k in range(n_rows)]
    rows += rows[: n_rows // 3] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("shard", F.lit("clash")).withColumn("part", F.lit(1))
    own = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    for n_shards in (24, 3):
        want = sharded(rows, n_shards)
        for parts in (1, 7):
            assert sorted((tuple(r) for r in H.shards(docs.repartition(parts), n_shards).select(*own).collect()), key=key) == want


def test_alike_rows_fill_shards_evenly(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 100, "doc_id long, text string, lang string, source string, n_chars long")
    rows = H.shards(docs).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) == 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


def test_shard_files_are_pruned_by_every_dimension(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", F.lit("clash"))
    out = H.shards(docs, columns=["doc_id", "text", "lang", "source", "n_chars", "size"])
    H.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select(docs.columns).exceptAll(docs).count() == 0
    known = H.manifest(out).cache()
    assert known.agg(F.sum("rows")).head()[0] == docs.count()
    for ask in ({"lang": ("de", "de")}, {"source": ("src3", "src3")}, {"n_chars": (10_000, None)}, {"lang": ("fr", "fr"), "n_chars": (0, 500)}):
        read = {r["shard"] for r in H.shards_to_read(known, **ask).collect()}
        fits = " and ".join(f"{d} >= '{a}'" if b is None else f"{d} between '{a}' and '{b}'" for d, (a, b) in ask.items())
        assert {r["shard"] for r in back.filter(fits).select("shard").distinct().collect()} <= read
        assert len(read) <= 14


def test_dimensions_of_other_types(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.expr("date '2020-01-01' + cast(id as int)").alias("day"), (F.col("id") / 7).alias("ratio"), F.expr("timestamp_seconds(id * 1000)").alias("at"))
    rows = H.shards(docs, 4, dimensions=("day", "ratio", "at")).collect()
    assert Counter(r["shard"] for r in rows) == {k: 50 for k in range(4)}
    spans = [max(r["doc_id"] for r in rows if r["shard"] == s) - min(r["doc_id"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(spans) < 100  # all three grow with the id, to the bits that keys keep


def test_registered():
    assert {"op11_fill_in_middle", "op12_ranked_search", "op13_sharding"} <= set(QUERIES)
