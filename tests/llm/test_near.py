import math
import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from terrane.llm import components, cosine, queries, shared, simhash

SF = "/root/testdata/sf0.001"


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_simhash(text, size=4):
    import re

    words = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text))]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_near(rows, most=4):
    fps = [(i, plain_simhash(t or "")) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[:k] if (x ^ y).bit_count() <= most]
    found = roots([i for i, _ in fps], pairs)
    return {i: (f"{x:016x}", found[i]) for i, x in fps}


def test_components_of_a_long_path_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5), (300, 299), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    nodes = set(range(100, 141)) | {7, *range(200, 260)} | {299, 300}
    assert got == roots(nodes, [p for p in pairs if None not in p and p[0] != p[1]])


def test_simhash_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == want


def test_simhash_near_fingerprints_in_small_blocks(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for base in list(fps):
        for _ in range(12):
            fps.add(base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(fps)]
    classes = spark.createDataFrame(signed, "fp long, rep long")
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = roots(range(len(fps)), pairs)
    for block in (3, 2048):
        found = components.connected_components(spark, simhash.links(classes, shared.Scratch(spark, "test"), 4, block))
        got = {r["node"]: r["component"] for r in found.collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_simhash_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one TWO", "x"), (4, "One two", "y"), (5, "a b c d e " * 9000, None), (None, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or 0, r["fp"] == 0, r["component_id"]) for r in simhash.near_duplicates(spark, docs).collect())
    assert got == [(0, False, 4), (1, True, 1), (2, True, 1), (3, True, 1), (4, False, 4), (4, False, 4), (5, False, 5)]
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_documents_against_plain_sets(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(40):
        words = [f"t{rng.randrange(5000)}" for _ in range(300)]
        # each changed word changes five shingles
        for share in (0.0, 0.005, 0.01, 0.08, 0.5):
            rows.append((len(rows) * 3, " ".join("other" + str(rng.random()) if rng.random() < share else w for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark, docs, block=64).collect()}
    sets = {d: shingle_set(t) for d, t in rows}
    close = [(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.8]
    assert len(close) > 60 and sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)
    linked = roots(sets, [(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.75])
    assert all(linked[a] == linked[got[a]] for a in sets)


def test_similar_documents_of_the_tables_against_plain_sets(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {d: shingle_set(t) for d, t in rows}
    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    pairs = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}
    pairs = {(a, b): likeness(sets[a], sets[b]) for a, b in pairs if min(len(sets[a]), len(sets[b])) >= 0.7 * max(len(sets[a]), len(sets[b]))}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    close = [p for p, x in pairs.items() if x >= 0.8]
    assert len(close) > 50 and sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)
    linked = roots(sets, [p for p, x in pairs.items() if x >= 0.75])
    assert all(linked[a] == linked[got[a]] for a in sets if sets[a])


def test_a_link_beside_nearer_candidates_that_fail(spark):
    rng = random.Random(9)
    words = [f"q{k}" for k in range(400)]
    change = lambda base, places: [("z%d" % rng.getrandbits(40) if k in places else w) for k, w in enumerate(base)]
    rows = [(0, words), (1, change(words, set(range(0, 80, 2)))), (2, change(words, {5, 300})), (3, change(words, set(range(200, 300, 3)))), (4, change(words, set(range(300, 400, 3))))]
    rows += [(10 + k, change(words, set(rng.sample(range(400), 24)))) for k in range(40)]
    sets = {d: shingle_set(" ".join(w)) for d, w in rows}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark, spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.8]
    assert got == roots(sets, pairs)


def test_every_link_of_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words, rows = [f"w{k}" for k in range(150)], []
    for d in range(300):
        places = set(rng.sample(range(150), rng.randint(0, 9)))
        own = [f"o{rng.getrandbits(40)}" if k in places else w for k, w in enumerate(words)]
        rows.append((3 * d, own))
        # some have a partner that is near them alone
        rows.append((3 * d + 1, ["p" if k == 75 else w for k, w in enumerate(own)])) if d % 5 == 0 else None
    sets = {d: shingle_set(" ".join(w)) for d, w in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.8]
    want = roots(sets, pairs)
    assert 50 < sum(d == r for d, r in want.items()) and max(list(want.values()).count(r) for r in set(want.values())) > 100
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(spark, docs).collect()} == want


def test_sets_of_different_parts_are_all_compared_in_small_blocks(spark):
    rng = np.random.default_rng(6)
    base, rows = rng.integers(1, 1 << 60, 100), []
    for k in range(90):
        own = base.copy() if k % 3 else rng.integers(1, 1 << 60, 100)
        own[rng.choice(100, rng.integers(0, 16), False)] = rng.integers(1, 1 << 60)
        own = np.unique(own).astype(np.uint64)
        rows.append((k, k % 2, (k // 10) * 10 if k < 20 else k, len(own), own.tobytes()))
    sets = {k: (g, p, set(np.frombuffer(x, np.uint64).tolist())) for k, g, p, _, x in rows}
    same = [(a, b) for a in sets for b in sets if sets[a][:2] == sets[b][:2]]
    close = [(a, b) for a in sets for b in sets if sets[a][0] == sets[b][0] and likeness(sets[a][2], sets[b][2]) >= 0.8]
    frame = spark.createDataFrame(rows, "rep long, group long, part long, n long, shingles binary")
    for block in (1000, 1 << 18):
        found = [(r["src"], r["dst"]) for r in simhash.set_edges(frame, shared.Scratch(spark, "test"), 0.8, block).collect()]
        assert set(found) <= {*close, *((b, a) for a, b in close)} and roots(sets, same + found) == roots(sets, same + close)
        assert len(found) < len(rows) * (1 if block > 1000 else 10)


def test_unlike_rows_of_one_id_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(50)) for c in "abc"]
    docs = spark.createDataFrame([(1, texts[0], 1), (1, texts[1], 2), (1, texts[1], 3), (2, texts[0], 4), (3, texts[2], 5)], "doc_id long, text string, stay_id int")
    assert sorted((r["doc_id"], r["text"][:1]) for r in simhash.one_of_each(spark, docs).collect()) == [(1, "a"), (1, "b"), (3, "c")]


def test_one_of_each_keeps_odd_rows_and_names(spark):
    long = " ".join(f"k{n % 1999}" for n in range(30_000))
    rows = [(1, None), (2, ""), (3, "Some Words"), (4, "some words"), (4, "some words"), (5, long), (6, long + " end"), (None, long), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id long, text string, __id int, n int, row int, stay string")
    kept = simhash.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 3, 5]
    assert simhash.one_of_each(spark, docs.limit(0)).count() == 0
    words = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    assert sorted((r["doc_id"] or "") for r in simhash.one_of_each(spark, words).collect()) == ["", "", "1", "3", "5"]


def plain_cosine(rows, least=0.95):
    good = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float64)
            good.setdefault(len(v), []).append((i, x / math.sqrt((x * x).sum())))
    degree, pairs = {i: 0 for i, _ in rows}, []
    for group in good.values():
        ids, x = [i for i, _ in group], np.stack([x for _, x in group])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            pairs.append((ids[a], ids[b]))
            degree[ids[a]] += 1
            degree[ids[b]] += 1
    found = roots(list(degree), pairs)
    return {i: (degree[i], found[i], found[i] == i) for i in degree}


def test_cosine_query_matches_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op2_cosine(spark, SF).collect()}
    assert got == plain_cosine(rows)


@pytest.mark.parametrize("block", [4, 1024])
def test_cosine_clusters_and_odd_vectors(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for center in rng.standard_normal((6, 16)):
        rows += [(len(rows) + k, (center + rng.standard_normal(16) * 0.25).tolist()) for k in range(15)]
    rows += [(100 + k, rows[0][1]) for k in range(20)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None] * 8), (204, [float("inf")] * 16), (205, []), (206, [2.0] * 15), (207, [3.0] * 15), (208, [x * 4 for x in rows[0][1]]), (209, [1e300] * 16), (210, [2e300] * 16)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, packed string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cosine.near_duplicates(spark, vectors, block=block).collect()}
    scaled = [(i, [x / 1e299 for x in v] if i in (209, 210) else v) for i, v in rows]
    assert got == plain_cosine(scaled)


def test_cosine_of_an_empty_table(spark):
    assert cosine.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
