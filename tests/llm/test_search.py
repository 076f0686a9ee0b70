import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import negatives, ranking, terms, winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_hits(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = plain_words(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(words[k : k + n])]
        out.append((doc, len(words), len(hit), sorted(str(i) for i in found if i is not None), bool(hit)))
    return sorted(out, key=str)


def test_words_are_told_apart_by_hash():
    texts = [b"", b"One, two-THREE four", "Ünï 9 ÀÉ".encode(), b"ab ba a\x00b", b"a" * 40 + b" " + b"a" * 41 + b" " + b"b" * 5000 + b" " + b"b" * 5001, b"...", b"12345678 123456789 1234567 two"]
    hashes, ends = terms.words(texts)
    flat = [w for t in texts for w in plain_words(t.decode())]
    assert ends.tolist() == np.cumsum([len(plain_words(t.decode())) for t in texts]).tolist()
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    assert terms.words([])[1].tolist() == [] and len(terms.words([b"", b""])[0]) == 0


def test_windows_of_every_size_share_a_fingerprint_and_never_cross_texts():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for size in range(1, 11):
        marks = winnowing.fingerprints(hashes, size, 5)
        again = winnowing.fingerprints(np.concatenate((rng.integers(0, 1 << 63, 7).astype(np.uint64), hashes)), size, 5)
        assert (again[7:] == marks).all() and len(marks) == 60 - size + 1
        ends = np.array([3, 3, 4, 20, 29, 60])
        fits = [k for k in range(60) if any(a <= k and k + size <= b for a, b in zip(np.append(0, ends[:-1]), ends, strict=True))]
        assert np.flatnonzero(winnowing.inside(ends, 60, size)).tolist() == fits


def test_hits_against_plain_windows(spark):
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(40)] + ["é", "Über", "x9"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, text(rng.choice((1, 2, 4, 5, 9, 10, 11, 30)))) for k in range(30)] + [(5, text(12)), (None, text(14)), (90, None), (91, ""), (92, "  ,. "), (93, "the one")]
    docs = []
    for k in range(60):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            words = plain_words(rng.choice(items)[1])
            cut = rng.randrange(len(words) + 1)
            parts += [rng.choice((", ", " - ", "\n")).join(w.upper() if rng.random() < 0.3 and w.isascii() else w for w in words[cut // 3 :]), text(rng.randrange(6))]
        docs.append((k % 50, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (None, items[10][1]), (103, docs[0][1]), (103, docs[0][1]), (104, " ".join(t or "" for _, t in items) * 20)]
    frame = spark.createDataFrame([(*d, 1, "a") for d in docs], "doc_id long, text string, row int, items string").repartition(5)
    got = winnowing.hits(spark, frame, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, size int"))
    rows = got.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows), key=str) == plain_hits(docs, items)
    for r in rows:
        assert len({k for s in r["spans"] for k in range(s["begin"], s["end"])}) == r["n_hit"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in winnowing.hits(spark, frame, none).collect()} == {0}
    assert winnowing.hits(spark, frame.limit(0), none).count() == 0


def test_a_very_long_text_with_a_passage_at_its_end(spark):
    long = " ".join(f"v{k * 7919 % 100_003}" for k in range(1_500_000))
    passage = " ".join(f"p{k}" for k in range(25))
    docs = spark.createDataFrame([(1, f"{long} {passage}"), (2, "word" * 500_000), (3, passage)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in winnowing.hits(spark, docs, items).collect()}
    assert got == {1: (1_500_025, 25, ["7"]), 2: (1, 0, []), 3: (25, 25, ["7"])}
    ranked = ranking.search(spark, docs, items).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [(1, 3), (2, 1)]


def plain_search(docs, items, k):
    each = [(d, plain_words(t)) for d, t in docs]
    each = [(d, w) for d, w in each if w]
    n_docs, n_terms = len(each), sum(len(w) for _, w in each)
    df = {}
    for _, w in each:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, w in each:
            m = 50 + (50 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in set(plain_words(text)) if t in df)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, n, None if absent else d, -s) for n, (s, absent, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [1, 3, 2048])
def test_search_against_plain_scores(spark, monkeypatch, tile):
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(ranking, "TILE_DOCS", 16)
    rng = random.Random(tile)
    pool = [f"t{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(pool[: rng.choice((5, 60))]) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 40))) for k in range(150)] + [(k, "t1 T2, t3!") for k in range(300, 340)] + [(None, "t1 t2 t3"), (None, "t4"), (20, "t9 t9"), (400, None), (401, ""), (402, "?!"), (403, "only elsewhere")]
    items = [(k, text(rng.randrange(1, 25))) for k in range(10)] + [(3, "t1 t2"), (50, None), (51, ""), (52, "nowhere"), (53, "t1 t1 t1"), (None, "t9")]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(7)
    got = ranking.search(spark, frame, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, term int"), k=12)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, 12)
    vocabulary, weights = np.arange(9), rng.sample(range(1, 40_000), 9)
    at = np.repeat([0, 1, 2], 3)
    scores = ranking.tile_scores(3, 2, at, vocabulary, np.array(weights), np.array([0, 0, 1]), np.array([0, 5, 8]), np.array([999_999, 1_000_000, 7]), tile)
    assert scores.tolist() == [[weights[0] * 999_999, 0], [weights[5] * 1_000_000, 0], [0, weights[8] * 7]]


def test_search_of_empty_tables_and_odd_ids(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranking.search(spark, docs.limit(0), items).count() == 0
    assert ranking.search(spark, docs, items.limit(0)).count() == 0
    with pytest.raises(TypeError):
        ranking.search(spark, docs.withColumn("doc_id", F.col("doc_id").cast("string")), items)


def plain_mine(rows):
    good = [(i, lab, np.floor(256 * np.array(v, float))) for i, lab, v in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all()]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, (i, lab, x) in enumerate(good):
        if i is None or i % 5:
            continue
        scored = [(int(x @ y), j, other == lab) for m, (j, other, y) in enumerate(good) if m != n and len(x) == len(y)]
        for p in sorted((s for s in scored if s[2]), key=order)[:5]:
            fit = sorted((s for s in scored if not s[2] and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)[:3]
            out += [(i, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [8, 1024])
def test_mining_against_plain_scores(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "PACK", 4)
    rng = np.random.default_rng(tile)
    centers = rng.standard_normal((4, 8))
    rows = [(k, int(rng.integers(0, 4)), (centers[rng.integers(0, 4)] + 0.4 * rng.standard_normal(8)).tolist()) for k in range(160)]
    rows += [(1000 + k, 1, rows[3][2]) for k in range(30)] + [(1000 + k, 2, rows[3][2]) for k in range(4)]
    rows += [(2000, None, rows[0][2]), (2005, 1, None), (2010, 1, [1.0, None] * 4), (2015, 1, [float("nan")] * 8), (2020, 2, [float("-inf")] * 8), (2025, 1, [0.0] * 8), (2030, 3, [1.0] * 5), (2031, 3, [0.9] * 5), (2032, 1, [0.8] * 5), (2035, 0, []), (2036, 0, []), (2037, 1, []), (None, 2, rows[7][2]), (None, 1, rows[9][2]), (2045, 1, [4e4] * 8), (2046, 1, [3e4] * 8), (2047, 2, [2e4] * 8)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, near int, data string").repartition(6)
    got = negatives.mine(spark, frame, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == plain_mine(rows)


def test_mining_of_empty_tables_and_scores_beyond_a_long(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert negatives.mine(spark, spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert negatives.mine(spark, spark.createDataFrame([(1, 1, [1.0])], kind), F.lit(True)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(spark, spark.createDataFrame([(1, 1, [1e30])], kind), F.lit(True)).count()


def test_angles_bound_every_score():
    rng = np.random.default_rng(3)
    rows = [np.floor(256 * v) for v in np.concatenate((rng.standard_normal((60, 12)), 1e-3 * rng.standard_normal((5, 12)), np.zeros((1, 12))))]
    rows += [2 * rows[0], -rows[1], rows[2]]
    known = negatives.references([(12, r.astype(np.int64).tobytes()) for r in rows[:30]], 6)[12]

    class Rows(negatives.Side):
        def __init__(self, x):
            self.uid, self.norm, self.data = np.arange(len(x)), np.sqrt((x * x).sum(axis=1)), x
            self.angles = np.arccos(np.clip((x @ known.T) / np.maximum(self.norm, 1e-9)[:, None], -1, 1))

    a = Rows(np.stack(rows))
    exact = a.data @ a.data.T
    least, most = negatives.row_bounds(a, np.arange(len(rows)), a)
    assert (least <= exact).all() and (exact <= most).all() and (most - least < 2 * np.outer(a.norm, a.norm)).mean() > 0.5
    for begin in range(0, len(rows), 10):
        part = Rows(np.stack(rows[begin : begin + 10]))
        least, most = negatives.tile_bounds(a, part)
        assert (least[:, None] <= exact[:, begin : begin + 10]).all() and (exact[:, begin : begin + 10] <= most[:, None]).all()


