"""The operators against brute force on small fixtures, and the awkward inputs: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns with clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planquant.llm import decontamination as D, language_id as L, line_dedup as LD, near_duplicates as N, packing as K, pii as PI, quality_classifier as QC, quality_rules as Q, secret_scan as S, text_stats as TS, token_counts as TC
from planquant.llm.common import tokenizer_file

WORDS = "the of and to in is was for that with on as by at from this be are or an".split()


def prose(seed: int, n: int) -> str:
    r = np.random.RandomState(seed)
    words = [WORDS[r.randint(len(WORDS))] + WORDS[r.randint(len(WORDS))] for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]) for k in range(0, n, 12))


ODD = [None, "", " \n\t", "x", "a b c d", "é ñ ß 漢字 👍 \x85 \x1c", "a\n\n\nb\n", "word " * 30_000, "same", "same", "<|endoftext|> x  <|endoftext|>", "  two  blanks\n\n line's end  "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "text", "kept") for k, t in enumerate(ODD)] + [(8, "same", "text", "kept"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, spans string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# Token counts.
def test_token_counts(odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in texts_of(odd))
    got = TC.token_counts(odd, path).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert TC.token_counts(empty, path).count() == 0


# Packing.
def test_token_ids_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [x or "" for x in ODD] + [prose(k, 300) for k in range(5)] + ["it's I'LL don't\r\n\tx ", "“quoted” — dash…", "a" * 5000]
    for cache in (K.CACHE, 0):
        monkeypatch.setattr(K, "CACHE", cache)
        K._tokenizer.cache_clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in K.token_ids(texts, path)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    K._tokenizer.cache_clear()


def unpack(rows, ids_of, window):
    """Checks the contract of packed pieces."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids_of[doc][at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids_of[doc])
            at += r["length"]
        assert at == len(ids_of[doc])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("block_tokens", [400, 1 << 22])
def test_packing_round_trip(spark, empty, block_tokens):
    path = tokenizer_file("byte_bpe_50k.json")
    texts = {k: prose(k, 20 + 37 * k % 900) for k in range(60)} | {100: None, 101: "", 102: "x " * 40_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = {k: np.append(np.frombuffer(K.token_ids([t or ""], path)[0], "<u4"), np.uint32(1)).astype("<u4") for k, t in texts.items()}
    rows = K.pack(docs, path, block_tokens=block_tokens, with_ids=True).collect()
    assert all(r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist() for r in rows)
    assert unpack(rows, ids, 2048) == 0
    assert K.pack(empty, path).count() == 0


def test_combinations_fill_the_window_and_the_fit_is_nonnegative():
    lengths = np.arange(1, 64)
    c = K.combinations(lengths, 64, third=4)
    total = c.sum(axis=1)
    assert set(total[(c > 0).sum(axis=1) > 1]) == {64}
    h = np.bincount(np.random.RandomState(1).randint(1, 64, 5000), minlength=64)
    x = K.solve(c, h)
    fit = np.bincount(c.ravel(), weights=np.repeat(x, 3), minlength=64)[1:]
    assert (x >= 0).all() and np.abs(fit - h[1:]).sum() < 0.2 * h.sum()
    plan = K.plan(np.repeat(np.arange(64), h), 64)
    assert sum(n for row in plan for _, _, n in row) == (np.arange(64) * h).sum()
    whole = sum(1 for row in plan for _, at, n in row if at == 0)
    assert whole >= h.sum()


# Decontamination.
def brute_hits(text, items, size=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, who = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        if not w or item is None:
            continue
        n = min(size, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                who.add(str(item))
    return len(words), len(hit), sorted(who)


@pytest.mark.parametrize("shard", [1 << 24, 300])
def test_contamination(spark, odd, empty, monkeypatch, shard):
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    items = [(1, prose(900, 40)), (2, "Short Answer é"), (3, None), (None, "word word"), (4, ""), (5, prose(900, 40)), (6, prose(901, 13)), (10, "x")]
    docs = [(k, t) for k, t in enumerate([prose(1, 50) + " " + prose(900, 40).upper(), prose(2, 300) + "\nshort, ANSWER é.", prose(900, 12), prose(901, 13), prose(901, 13) + "s", None, "", "x y x"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in D.contamination(frame, bench, with_spans=True).collect()}
    for k, t in docs:
        n, hit, who = brute_hits(t, items)
        assert got[k] == (n, hit, who, hit > 0 and 20 * hit >= n)
    spans = {r["doc_id"]: r["spans"] for r in D.contamination(frame, bench, with_spans=True).collect()}
    assert [docs[1][1][s["start"] : s["end"]] for s in spans[1]] == ["short, ANSWER é"]
    kept = {r["doc_id"] for r in D.contamination(frame, bench, keep_columns=["doc_id", "text"]).collect()}
    assert kept == {k for k, v in got.items() if not v[3]}
    assert D.contamination(odd, bench).count() == odd.count()
    assert D.contamination(empty, bench).count() == 0 and D.contamination(frame, bench.limit(0)).filter("contaminated").count() == 0


# Secrets.
def test_secrets_base_and_layers(spark, odd, empty):
    import base64
    import gzip
    from urllib.parse import quote

    key = "password = hunter2hunter2"
    b64 = base64.b64encode(key.encode()).decode()
    twice = base64.b64encode(b64.encode()).decode()
    zipped = base64.b64encode(gzip.compress(("AKIA" + "Z9" * 10 + " in it").encode())).decode()
    cases = {
        1: (f"see {key} end", [("assign", 4, 4 + len(key), False)]),
        2: (f"q={quote(key, safe='')} z", None),
        3: (f"data {b64} z", [("assign", 5, 5 + len(b64), True)]),
        4: (f"data {twice} z", [("assign", 5, 5 + len(twice), True)]),
        5: (f"data {zipped} z", [("access", 5, 5 + len(zipped), True)]),
        6: ("pass\\u0077ord: abcdefghij k", [("assign", 0, 25, True)]),
        7: ("token=short token = longenough1 AKIAABCDEFGHIJKL " + "ab" * 16, None),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.secrets(docs).collect()}
    for k, (_, want) in cases.items():
        if want is not None:
            assert got[k] == want, k
    assert [(s[0], s[3]) for s in got[2]] == [("assign", True)]
    assert [s[0] for s in got[7]] == ["assign", "access", "hex"]
    assert S.secrets(odd).count() == odd.count() and S.secrets(empty).count() == 0


@pytest.mark.parametrize("odd_one", ["\u00a0", "\ufeff", "\u00ad", "\u3000", "\x00", "\x1b"])
def test_secret_layers_with_odd_characters(odd_one):
    import base64

    inner = base64.b64encode(f"{odd_one}AKIA{'Z9' * 10}".encode()).decode()
    outer = base64.b64encode(f"{odd_one} password = hunter2hunter2 {inner}".encode()).decode()
    assert S.decoded_spans(f"data {outer} z") == {(5, k, 5 + len(outer)) for k in (0, 1)}


def test_secret_layers_without_bounds():
    import base64
    import gzip

    def scan(data):
        run = base64.b64encode(data).decode()
        return S.decoded_spans(f"data {run} z"), {(5, k, 5 + len(run)) for k in (0, 1)}

    key = "é\npassword%3D%20hunter2hunter2\nAKIA" + "Z9" * 10 + "\n"
    long = ("é word, " * 2_000_000 + key).encode()
    got, want = scan(gzip.compress(long))
    assert len(long) > 16 << 20 and got == want
    deep = key.encode()
    for k in range(20):
        deep = (zlib.compress if k % 2 else gzip.compress)(deep)
    got, want = scan(deep)
    assert got == want
    got, want = scan(gzip.compress(key[:20].encode()) + gzip.compress(key[20:].encode()))
    assert got == want


def test_secret_parts_equal_the_whole(monkeypatch):
    import base64
    import gzip

    b64 = base64.b64encode(b"xx AKIA" + b"Q7" * 30).decode()
    texts = ["one two %74oken%3A%20abcdefgh12 é " + "w " * 9, "secret   :   abcdefgh12", "pass\\u0077ord%3D abcdefgh12", f"a b {b64} c", "0f" * 40, "AKIA" + "Z" * 40, "token%253A abc12345 x", "no words here at all é ü", "token\n: abcdefgh12"]
    for text in texts:
        for pad in range(9):
            run = base64.b64encode(gzip.compress(("p" * pad + " " + text).encode())).decode()
            monkeypatch.setattr(S, "STEP", 1 << 20)
            want = S.decoded_spans(run)
            for step in (1, 2, 3, 7, 16):
                monkeypatch.setattr(S, "STEP", step)
                assert S.decoded_spans(run) == want, (text, pad, step)


@pytest.mark.parametrize("end", ["", "="])
def test_secret_shortest_base64(end):
    import base64

    run = base64.b64encode(b"token=abcdefgh").decode().rstrip("=")
    assert len(run) == 19
    assert S.decoded_spans(f"data {run}{end} z") == {(5, 0, 5 + len(run + end))}


def unescaped_to_the_end(text):
    """One escape after the other, the first that ends first, until there is none; a byte over 127 stands for itself."""
    while m := min(re.finditer(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})", text), key=lambda m: m.end(), default=None):
        text = text[: m.start()] + chr(int(m[1] or m[2] or m[3], 16)) + text[m.end() :]
    return text


def test_secret_escapes_are_replaced_to_the_end():
    import random

    rng = random.Random(3)
    parts = ["%", "2", "5", "%25", "%34", "1", "\\", "x", "u", "0041", "\\x25", "%5C", "%75", "A", "g", " ", "%2", "\\u00", "b"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        layer = S._fully_unescaped(S.Layer(text, [(0, len(text), 0, len(text), False)]))
        got = layer.text if layer else text
        want = unescaped_to_the_end(text)
        if want.isascii():
            assert got == want, text
        if layer:
            assert [p[0] for p in layer.pieces[1:]] == [p[1] for p in layer.pieces[:-1]] and layer.pieces[-1][1] == len(got)
            assert [p[2] for p in layer.pieces[1:]] == [p[3] for p in layer.pieces[:-1]] and layer.pieces[-1][3] == len(text)
    smile = S._fully_unescaped(S.Layer("\\ud83d\\ude00 \\ud83d", [(0, 19, 0, 19, False)]))
    assert smile.text == "\U0001f600 \ufffd"


def test_secret_chains_take_time_in_proportion():
    import time

    for text, span in (("token%" + "25" * 500_000 + "3Dabcdefgh12", None), ("token%2" + "%3" * 300_000 + "5" + "3Aabcdefgh12", None), ("secret=abcd" + "%41" * 200_000, None)):
        began = time.time()
        assert (0, 0, len(text)) in S.decoded_spans(text)
        assert time.time() - began < 20


def test_secret_in_bytes_that_are_no_text():
    import base64

    run = base64.b64encode(b"\xff\xfe\x00 password = hunter2hunter2 \x81").decode()
    assert S.decoded_spans(f"data {run} z") == {(5, 0, 5 + len(run))}
    run = base64.b64encode(zlib.compress(b"\xff\xfe\x00 password = hunter2hunter2 \x81")).decode()
    assert S.decoded_spans(f"data {run} z") == {(5, 0, 5 + len(run))}


def test_secret_worklist_ends():
    assert S.decoded_spans("%2525252541 " * 50) == set()
    assert isinstance(S.decoded_spans("A" * 100_000), set)


# Quality rules and statistics.
def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit)


@pytest.mark.parametrize("text", [t or "" for t in ODD if t is None or len(t) < 1000] + [prose(3, 100), "a b c a b c a b", "x\nx\n x\nx \n\n", "## $$ a|b <c>", "é é é é"])
def test_text_stats(text):
    assert TS.text_stats(text.encode())[:5] == brute_stats(text)


def labelled(spark, n=240):
    docs = [(k, prose(k, 80) if k % 3 else "### $$$ " + "spam spam spam " * 30) for k in range(n)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(n) if k % 4] + [(None, 1, 0), (5, None, None), (99999, 0, 0), (1, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rules(spark, odd, empty):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in Q.quality_rules(docs, labels).collect()}
    assert all(r["kept"] == (k % 3 > 0) for k, r in got.items())
    kept = Q.quality_rules(docs, labels, keep_columns=["doc_id", "text"])
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    o = {r["doc_id"]: r for r in Q.quality_rules(odd, labels).collect()}
    assert o[0]["n_words"] == 0 and o[0]["base_failed"] and not o[0]["kept"]
    assert Q.quality_rules(empty, labels).count() == 0
    assert Q.quality_rules(docs, labels.limit(0)).filter("kept").count() > 0
    assert Q.fit_on(docs, labels).held_out["recall"] == Q.fit_on(docs, labels).held_out["precision"] == 1.0


def test_the_trees_cut_is_set_on_held_out_rows():
    r = np.random.RandomState(4)
    stats = np.zeros((400, len(TS.NAMES)), dtype=np.int64)
    stats[:, 0], stats[:, 1], stats[:, 2], stats[:, 5] = 100, 500, r.randint(0, 40, 400), 10
    y = (stats[:, 2] + r.randint(-8, 9, 400) < 20).astype(float)
    trees = Q.judged(Q.fit(TS.features(stats[:300]), y[:300]), stats[300:], y[300:], keep=0.05)
    kept = (stats[300:, 0] >= 50) & (trees.score(TS.features(stats[300:])) >= trees.cut)
    assert trees.held_out["recall"] == kept[y[300:] == 1].mean() >= 0.94 and trees.held_out["precision"] == y[300:][kept].mean()
    # Scores node by node, from the flattened arrays.
    for row in TS.features(stats[:20]):
        total = trees.base
        for k in range(trees.n_trees):
            while trees.left[k] != k:
                k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            total += trees.value[k]
        assert abs(trees.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_trees_are_monotonic():
    r = np.random.RandomState(0)
    x = r.rand(800, len(TS.FEATURES))
    y = ((x[:, 2] + 0.5 * np.sin(9 * x[:, 4]) + 0.3 * r.rand(800)) < 0.8).astype(float)
    m = Q.fit(x, y)
    for name in Q.FALLING:
        j = TS.FEATURES.index(name)
        for row in x[:40]:
            grid = np.tile(row, (25, 1))
            grid[:, j] = np.linspace(0, 1, 25)
            assert (np.diff(m.score(grid)) <= 1e-12).all()


# Quality classifier.
def test_labelling_finds_the_better_labellers():
    r = np.random.RandomState(1)
    truth = r.rand(6000) < 0.8
    acc = np.linspace(0.95, 0.6, len(QC.LABELLERS))
    v = np.array([[(QC.GOOD if (t if r.rand() < a else not t) else QC.BAD) if r.rand() < 0.9 else QC.ABSTAIN for a in acc] for t in truth])
    p, n = np.unique(QC.pattern(v), return_counts=True)
    m = QC.Labelling(p, n)
    assert np.abs(m.accuracy - acc).max() < 0.06 and abs(m.share - 0.8) < 0.05
    assert ((m.posterior(QC.pattern(v)) > 0.5) == truth).mean() > 0.95


def test_scorer_equals_brute_force():
    """One epoch of AdaGrad, weight by weight, and scores straight from the definition."""
    texts = [prose(k, 30).encode() for k in range(6)] + [b"### $$$ spam spam"] * 2
    y = np.array([1.0] * 6 + [0.0] * 2)
    got = QC.train([np.unique(QC.slots(t), return_counts=True) for t in texts], y, epochs=1)
    w, g2, bias, b2 = {}, {}, 0.0, 1e-8
    for k in np.random.RandomState(7).permutation(len(texts)).tolist():
        bag = {}
        for word in texts[k].split():
            shape = re.sub(rb"[0-9]", b"0", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", word)))[-6:]
            for piece, odd_ in ((word, 0), (shape, 1)):
                s = (zlib.crc32(piece) << 1 | odd_) & 0xFFFF
                bag[s] = bag.get(s, 0) + 1
        total = sum(bag.values())
        x = {s: 2.0 * n / total for s, n in bag.items()}
        miss = 1 / (1 + np.exp(-(bias + sum(w.get(s, 0.0) * v for s, v in x.items())))) - y[k]
        for s, v in x.items():
            g = miss * v + 1e-6 * w.get(s, 0.0)
            g2[s] = g2.get(s, 1e-8) + g * g
            w[s] = w.get(s, 0.0) - 0.5 * g / np.sqrt(g2[s])
        b2 += miss * miss
        bias -= 0.5 * miss / np.sqrt(b2)
    assert abs(got.bias - bias) < 1e-9 and all(abs(got.weights[s] - v) < 1e-9 for s, v in w.items()) and np.count_nonzero(got.weights) == len(w)


def test_quality_classifier(spark, odd, empty):
    docs, _ = labelled(spark)
    s = QC.fit(docs, QC.label(docs))
    got = {r["doc_id"]: r["kept"] for r in QC.classify(docs, s).collect()}
    assert np.mean([got[k] == (k % 3 > 0) for k in got]) > 0.98
    o = {r["doc_id"]: r for r in QC.classify(odd, s).collect()}
    assert o[0]["score"] == 0 and not o[1]["kept"]
    # One row for each id, whatever the order and however often it occurs; as many ids as the bound on slots allows.
    again = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more")))).unionByName(docs).repartition(3)
    assert np.isfinite(QC.fit(again, QC.label(docs)).weights).all()
    assert (QC.fit(docs.repartition(5), QC.label(docs)).weights == s.weights).all()
    assert (QC.fit(docs, QC.label(docs), fit_slots=10).weights == 0).all() and (QC.fit(docs, QC.label(docs), fit_slots=500).weights != s.weights).any()
    assert QC.classify(empty, QC.fit(empty, QC.label(empty))).count() == 0


# Language ID.
def tongue(k, seed):
    r = np.random.RandomState(seed)
    syllables = (["the", "ing", "ation", "er", "wh"], ["éau", "que", "tion", "lle", "oi"], ["sch", "ung", "ü", "ei", "ch"])[k]
    return " ".join("".join(syllables[r.randint(5)] for _ in range(2)) for _ in range(30))


def test_language_id(spark, odd, empty):
    rows = [(n, tongue(n % 3, n), ("en", "fr", "de")[n % 3]) for n in range(150)] + [(1000, None, "en"), (1001, "123 !?", None), (1002, "", "fr"), (None, "the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in L.identify(docs, L.learn(docs)).collect()}
    held = [k for k in range(150) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in held) for k in range(150))
    assert np.mean([got[k]["lang_pred"] == ("en", "fr", "de")[k % 3] for k in held]) == 1.0
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in L.identify(changed, L.learn(changed)).collect()} == {k: r["lang_pred"] for k, r in got.items()}
    nothing = L.learn(empty)
    assert {r["lang_pred"] for r in L.identify(odd, nothing).collect()} == {"und"}


def brute_code_length(counts, text):
    """Bits of a text, byte by byte, straight from the definition; counts: {context: {byte: n}} of contexts of up to three bytes."""

    def p(byte, ctx):
        """Probability of a byte after a context, None below the empty one."""
        if ctx is None:
            return 1 / 256
        seen, shorter = counts.get(ctx, {}), ctx[1:] if ctx else None
        if not seen:
            return p(byte, shorter)
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + d)
        return d / (n + d) * p(byte, shorter) / (1 - sum(p(x, shorter) for x in seen))

    full = bytes(3) + text
    return sum(-np.log2(p(full[k], full[k - 3 : k])) for k in range(3, len(full)))


def brute_counts(texts):
    counts = {}
    for t in texts:
        full = bytes(3) + t
        for k in range(3, len(full)):
            for j in range(4):
                own = counts.setdefault(full[k - j : k], {})
                own[full[k]] = own.get(full[k], 0) + 1
    return counts


def test_code_lengths_equal_brute_force():
    learned = [[tongue(k, s).encode() for s in range(3)] + ["éàü ß 漢字".encode() * (k + 1)] for k in range(3)]
    tables = L.Tables(["a", "b", "c"], [np.unique(L.codes(x)[0].astype(np.int64), return_counts=True) for x in learned])
    texts = [tongue(0, 9).encode(), b"", "é漢 zz\n".encode(), bytes(range(256)), tongue(2, 5).encode()[:7], b"qu\x00"]
    want = np.array([[brute_code_length(brute_counts(x), t) for x in learned] for t in texts])
    got = tables.bits(texts)
    assert np.abs(got - want).max() < 1e-3 * want.max()
    for q in (b"the", b"\xc3\xa9q", b"\x01\x02\x03"):
        c = L.codes([q + bytes([x]) for x in range(256)])[0][3::4]
        assert np.abs(np.exp2(-tables._cost(c)).sum(axis=0) - 1).max() < 1e-4


def test_languages_are_learned_from_a_bounded_sample(spark):
    rows = [(n, tongue(n % 3, n), ("en", "fr", "de")[n % 3]) for n in range(600)] + [(1000, "x" * 50_000, "de"), (1001, "rare words", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sum(len(t) for _, t, _ in rows)
    sample = L.learning_rows(docs, whole // 8).collect()
    by = {x: sum(len(r["text"]) for r in sample if r["lang"] == x) for x in ("en", "fr", "de", "xx")}
    assert by["xx"] == len("rare words") and all(0 < by[x] < whole // 8 // 4 * 2 for x in ("en", "fr", "de"))
    assert sorted(map(tuple, sample)) == sorted(map(tuple, L.learning_rows(docs.repartition(9), whole // 8).collect()))
    assert L.learning_rows(docs).count() == sum(1 for r in docs.filter(L.fold("doc_id") != L.HELD_OUT).collect())
    t = L.learn(docs, learn_bytes=whole // 8)
    assert sum(len(x.keys) for x in t.seen[3:]) <= whole // 8
    got = L.identify(docs, t).filter("held_out and doc_id < 600").collect()
    assert np.mean([r["lang_pred"] == ("en", "fr", "de")[r["doc_id"] % 3] for r in got]) > 0.9


# Personal data.
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(s):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(s))) % 10 == 0


def brute_personal(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), name))
    return [f"{n}:{s}:{e}" for s, _, e, n in sorted(out)]


PERSONAL = [
    "mail bob.smith+x@mail.example.com, a@b.com_x@y.org e@f.g@h.i", "v1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112 79927398713 49927398716000",
    "+1 (415) 555-2671, +49 30 1234567 +1 2 3", "é👍 x@y.zz 漢 1.1.1.1", "@@ a@ @b.c a@b a@b. a@-.-", "+" * 50 + "1" * 40, "a." * 3000 + "@x.y", "1 " * 5000, None, "",
]


def test_personal_base_spans(spark, odd, empty):
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    got = {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]] for r in PI.personal_data(docs).collect()}
    for k, t in enumerate(PERSONAL):
        assert got[k] == brute_personal(t or ""), k
    assert PI.personal_data(odd).count() == odd.count() and PI.personal_data(empty).count() == 0


def test_personal_base_spans_of_mixed_parts(spark):
    import random

    rng = random.Random(5)
    parts = ["a", "b@c.d", "@", ".", "-", "1", "0", "10.0.0.1", "255", "256.", "4111 1111 1111 1111", "4111111111111111", "+", "+49 (0) 30 123456", "é", "😀", " ", "\n", "00.1", "x_", "%", "١", "0.0.0.0", "378282246310005", "(", ")", ":"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    found = PI.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]] == brute_personal(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_personal_spans_of_many_matches(spark):
    import random
    import time

    rng = random.Random(6)
    kinds = ["10.0.0.%d, ", "me%d@site.org; ", "call (415) 555-%04d or ", "+49 30 12345%03d x ", "bob%d (at) site (dot) com\n", "é word %d "]
    for n in (40, 700):
        text = "".join(rng.choice(kinds) % rng.randint(0, 255) for _ in range(n))
        (row,) = PI.labelled_spans(spark.createDataFrame([(text,)], "text string")).collect()
        assert [f"{PI.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in row["spans"] if s["strict"]] == brute_personal(text)
        base, loose = [(s["start"], s["end"]) for s in row["spans"] if s["strict"]], {(s["start"], s["end"]) for s in row["spans"] if not s["strict"]}
        want = set()
        for name, p in PI.LOOSE.items():
            for m in re.finditer(p.replace("(?i)", ""), text, re.I if "(?i)" in p else 0):
                if not any(m.start() < e and s < m.end() for s, e in base):
                    want.add(m.span())
        assert loose == want and len(loose) > n / 10
    text = "".join(f"{k % 256}.0.{k % 199}.1 " for k in range(100_000))
    docs = spark.createDataFrame([(text,)], "text string").withColumn("doc_id", F.lit(1)).cache()
    docs.count()
    began = time.time()
    assert PI.personal_data(docs).select(F.size("spans").alias("n")).head()["n"] == 100_000
    assert time.time() - began < 60


def test_personal_candidates_are_added(spark):
    rows = [(k, f"please call us: +1 (415) 555-{1000 + k} or email me{k}@site{k}.com today") for k in range(60)] + [(k, f"please call us: (415) 555-{1000 + k} today") for k in range(60, 90)]
    found = PI.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    more = [s for r in found for s in r["spans"] if not s["base"]]
    assert len(more) == 30 and {s["kind"] for s in more} == {"phone"}


# Line dedup.
def brute_lines(docs, over=50):
    """Texts after removal; docs: (id, text) with distinct rows, in order."""
    places = {}
    for i, t in docs:
        if t is None:
            continue
        lines = [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(t.split("\n"))]
        lines = [x for x in lines if x[2]]
        runs = set()
        for a in range(len(lines)):
            for step in (1, -1):
                n, b = 0, a
                while 0 <= b < len(lines) and n <= over:
                    n += lines[b][2]
                    b += step
                if n > over:
                    runs.add((min(a, b - step), max(a, b - step)))
        for a, b in runs:
            places.setdefault("\n".join(x for _, x, _ in lines[a : b + 1]), []).append((i, lines[a][0], lines[b][0]))
    gone = {}
    for where in places.values():
        for i, a, b in sorted(set(where))[1:]:
            gone.setdefault(i, set()).update(range(a, b + 1))
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs}


def test_line_dedup(spark, odd, empty):
    long_line, passage = prose(50, 60).replace("\n", " "), prose(51, 60)
    docs = [(0, prose(1, 40)), (1, f"a b\n{long_line}\nc"), (2, f"{long_line}\nz z"), (3, f"q\n{passage}\nr"), (4, f"{prose(9, 24)}\n\n{passage}"), (5, f"{passage}\n{passage}"), (6, None), (7, ""), (8, prose(52, 24)), (9, prose(52, 24)), (10, "tiny\n" * 300)]
    got = {r["doc_id"]: r["text"] for r in LD.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)
    assert passage in got[3] and passage not in got[4] and got[8] == got[9] == docs[8][1]
    out = LD.dedup_lines(odd)
    assert set(odd.columns) <= set(out.columns) and out.count() == odd.count()
    assert LD.dedup_lines(empty).count() == 0


# Near duplicates.
def brute_classes(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    names = {}
    for i in sorted(sets):
        if i not in names:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in names:
                    names[x] = i
                    todo += links[x]
    return {i: (names[i], len(links[i])) for i in sets}


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicates(spark, odd, empty, block):
    base = prose(70, 200).split()
    docs = [(k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(5, 25)] + [(100 + k, prose(80, 120)) for k in range(6)] + [(200 + k, prose(200 + k, 90)) for k in range(10)]
    docs += [(300, " ".join(base[:110])), (301, "one two"), (302, "one two"), (303, None), (304, ""), (305, "one two three"), (3, " ".join(base))]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in N.classes(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()}
    assert got == brute_classes(docs)


def test_near_duplicates_null_and_repeated_ids(spark):
    base, other = prose(5, 300), prose(6, 300)
    near, other_near = base + " one more", other + " one more"
    docs = [(1, base), (None, near), (2, other), (3, base + " and other"), (3, other_near), (None, base + " null too"), (None, base + " null too"), (4, prose(7, 200))]
    texts = [t for _, t in docs]
    sets = [set(N.shingles(t.encode()).tolist()) for t in texts]
    n = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    want = sorted(zip(map(str, [i for i, _ in docs]), [1, 1, 2, 1, 2, 1, 1, 4], n, strict=True))
    got = N.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r["id"]), r["class_id"], r["n_links"]) for r in got) == want


def test_near_duplicates_awkward(spark, odd, empty):
    rows = N.classes(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r["n_links"] for r in rows if r["id"] in (8, 9)) == [2, 2, 2]
    assert N.classes(empty).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = N.banding(0.8)
    assert bands * rows <= N.HASHES and 1 - (1 - 0.8**rows) ** bands >= N.RECALL
    r = np.random.RandomState(3)
    found = 0
    for _ in range(200):
        a = r.randint(1, 2**62, 90).astype(np.uint64)
        b = np.unique(np.concatenate([a[:80], r.randint(1, 2**62, 10).astype(np.uint64)]))
        found += bool((N.band_hashes(np.unique(a), bands, rows) == N.band_hashes(b, bands, rows)).any())
    assert found >= 198


# Pipeline.
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    good = [prose(k, 150) for k in range(40)]
    quiz = prose(901, 30)
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(good)] + [(50, good[0], "en", "s", 1), (51, "### $$$ " * 80, "en", "s", 1), (52, prose(60, 60) + "\n" + quiz, "en", "s", 1), (53, None, None, None, None), (54, "few words", "en", "s", 1), (7, good[7], "en", "s", len(good[7]))]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, quiz)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(51, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    rows = C.run(spark, at).collect()
    assert {r["doc_id"] for r in rows} == set(range(40))
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert all(sum(r["length"] for r in p) == p[0]["doc_tokens"] for p in pieces.values())


def test_digest_columns():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_components(spark):
    from planquant.llm.components import components

    r = np.random.RandomState(8)
    pairs = [(int(a), int(b)) for a, b in r.randint(0, 400, (320, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(100)] + [(5, 5)]
    want = {}
    for a, b in pairs:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(500):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long"), 4).collect()}
    assert got == {k: v for k, v in want.items() if k not in alone}
    assert components(spark.createDataFrame([], "a long, b long"), 4).count() == 0


@pytest.mark.parametrize("missing", ["documents", "labels", "benchmark"])
def test_pipeline_with_an_empty_table(spark, tmp_path, missing):
    import corpus_pipeline as C

    some = {
        "documents": ([(k, prose(k, 150), "en", "s", 1, "n_removed") for k in range(6)] + [(6, None, None, None, None, None), (7, "", "en", "s", 0, ""), (8, " ".join(prose(70 + k, 400) for k in range(60)), "en", "s", 1, "x"), (None, prose(99, 150), "en", "s", 1, "x")], "doc_id long, text string, lang string, source string, n_chars long, n_removed string"),
        "labels": ([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, prose(3, 60))], "item_id long, text string"),
    }
    for name, (rows, schema) in some.items():
        spark.createDataFrame([] if name == missing else rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()}
    assert got == {"documents": set(), "labels": {0, 1, 2, 4, 5, 8, None}, "benchmark": {*range(6), 8, None}}[missing]


def test_near_duplicate_stage_keeps_one_row_of_a_class_whatever_its_ids(spark):
    import corpus_pipeline as C

    a, b, c = (prose(k, 80) for k in (301, 302, 303))
    near = lambda t, word: t + " " + word
    rows = [(1, a), (3, near(a, "one")), (3, b), (None, near(a, "two")), (None, c), (None, near(c, "three")), (3, b), (None, c), (9, near(b, "x")), (4, near(c, "y"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 4):
        got = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in C.near_duplicates(spark, docs.repartition(parts), "").collect()))
        assert got == [(False, 1, a), (False, 3, b), (False, 4, near(c, "y"))]
    nameless = docs.filter("doc_id is null")
    got = {r["text"] for r in C.near_duplicates(spark, nameless, "").collect()}
    assert len(got) == 2 and near(a, "two") in got


def test_quality_fit_does_not_depend_on_partitioning(spark):
    rows = [(k % 60, prose(k, 30 + 7 * (k % 40)), k) for k in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int")
    fits = [Q.fit_on(d, labels) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("n")))]
    assert len({(t.cut, t.value.tobytes(), t.threshold.tobytes()) for t in fits}) == 1


def test_line_dedup_takes_time_in_proportion_to_lines(spark):
    import time

    lines = [f"w{k}" for k in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[50_000:]))], "doc_id long, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: r for r in LD.dedup_lines(docs).collect()}
    assert time.perf_counter() - start < 90
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 50_000 and got[2]["text"] == ""


NESTED = "x = 1; password = 'Zq8Lm2Xv9Kp4', y"


def _found(text):
    return [(a, b) for a, k, b in S.decoded_spans(text)]


def _wrapped(data: bytes, width: int = 76, by: str = "\n") -> str:
    import base64

    run = base64.b64encode(data).decode()
    return by.join(run[k : k + width] for k in range(0, len(run), width))


def test_secret_in_wrapped_base64():
    import gzip

    long = ("filler text " * 9 + NESTED + " more of it" * 9).encode()
    for data in (long, gzip.compress(long), zlib.compress(long), gzip.compress(zlib.compress(long))):
        for by in ("\n", "\r\n", "\n    ", "\n> ", '"\n"'):
            for width in (20, 57, 60, 64, 76):
                run = _wrapped(data, width, by)
                text = f"before\n{run}\nAfter that"
                spans = _found(text)
                assert any(7 <= a < b <= len(text) - 5 for a, b in spans), (width, by)
    pem = "-----BEGIN DATA-----\n" + _wrapped(long, 64) + "\n-----END DATA-----"
    assert _found(pem)


def test_secret_in_base64_behind_its_own_alphabet():
    import base64
    import gzip

    for data in (NESTED.encode(), gzip.compress(NESTED.encode()), zlib.compress(NESTED.encode())):
        run = base64.b64encode(data).decode().rstrip("=")
        for prefix in ("https://h.example/a/", "https://h.example/ab/", "blob_x/", "blob_xy/", "v1-", "abc_", "k/", "-", "abcde"):
            text = f"see {prefix}{run} there"
            assert _found(text), (prefix, data[:3])


def test_secret_in_escaped_compressed_bytes():
    import gzip
    from urllib.parse import quote_from_bytes

    for data in (gzip.compress(NESTED.encode()), zlib.compress(NESTED.encode()), zlib.compress((NESTED + " filler" * 400).encode()), zlib.compress(gzip.compress(NESTED.encode()))):
        for run in (quote_from_bytes(data), "".join(f"%{x:02x}" for x in data), "".join(f"\\x{x:02x}" for x in data), "".join(f"\\u00{x:02x}" for x in data), repr(data)[2:-1]):
            text = f"q={run} then"
            (a, b) = max(_found(text))
            assert a in (2, 3) and b == len(text) - 5


def test_secret_in_utf_16():
    import base64

    for code in ("utf-16", "utf-16-le", "utf-16-be"):
        data = NESTED.encode(code)
        assert _found("a " + base64.b64encode(data).decode() + " b")
        assert _found("a " + "".join(f"%{x:02x}" for x in NESTED.encode("utf-16-le")) + " b")
        assert _found("a /p/" + base64.b64encode(data).decode() + " b")


def test_no_layer_with_a_secret_is_passed_over_as_plain():
    import base64
    import itertools

    words = ["".join(x) for w in ("password", "passwd", "secret", "token", "apikey", "api_key") for x in ([w], [w.upper()], [w.title()])]
    for shift, word in itertools.product(range(3), [*(w + "=" for w in words), "AKIA", *(c * 32 for c in "0123456789abcdef"), "%41%42%43", "\\x41\\x42"]):
        run = base64.b64encode(b"?" * shift + word.encode()).decode()[2 if shift else 0 :].rstrip("=")[:-1]
        assert not S._PLAIN.fullmatch(run), (shift, word, run)


@pytest.mark.parametrize("seed", range(6))
def test_secret_in_random_nestings(seed):
    import base64
    import gzip
    from urllib.parse import quote, quote_from_bytes

    r = np.random.RandomState(seed)
    steps = {
        "url": lambda t: quote(t, safe=""),
        "url2": lambda t: quote(quote(t, safe=""), safe=""),
        "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "hex": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
        "base64": lambda t: base64.b64encode(t.encode()).decode(),
        "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
        "wrapped": lambda t: "data:\n" + _wrapped(t.encode(), 64),
        "behind": lambda t: "/x/yz/" + base64.b64encode(t.encode()).decode(),
        "utf16": lambda t: base64.b64encode(t.encode("utf-16-le")).decode(),
        "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
        "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
        "escaped": lambda t: quote_from_bytes(zlib.compress(t.encode())),
    }
    for _ in range(25):
        names = [sorted(steps)[r.randint(len(steps))] for _ in range(1 + r.randint(3))]
        inner = NESTED
        for name in names:
            inner = steps[name](inner)
        text = f"lead {inner} end"
        assert any(a >= 5 - 0 and b <= len(text) - 4 for a, b in _found(text)), names
