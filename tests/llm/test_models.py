import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from terrane.llm import entropy, language, lattice, quality, queries

SF = "/root/testdata/sf0.01"


def test_unigram_counts_match_plain_search():
    rng = random.Random(1)
    scores = {bytes([b]): -9_000_000 for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))): -rng.randint(1, 12) * 1_000_000 for _ in range(60)}
    model = lattice.Unigram(scores)
    strings = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 14))) for _ in range(300)]

    def plain(s):
        best = [(0, 0)]
        for end in range(1, len(s) + 1):
            best.append(max((best[k][0] + scores[s[k:end]], best[k][1] - 1) for k in range(end) if s[k:end] in scores))
        return -best[-1][1]

    assert model.counts(strings) == {s: plain(s) for s in strings}
    with pytest.raises(ValueError):
        lattice.Unigram({b"a": -1})


def test_token_counts_of_whole_documents(spark):
    import public_tokenizers
    import regex

    model = lattice.Unigram.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in queries.op6_tokens(spark, "/root/testdata/sf0.001").collect()}
    for doc, text in docs.items():
        words = regex.findall(public_tokenizers.PATTERN, text)
        assert got[doc] == (len(words), sum(model.counts([w.encode()])[w.encode()] for w in words))
    odd = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a b", 0), (3, "x" * 50_000, 0)], "doc_id long, text string, n_tokens int")
    found = sorted((r["doc_id"] or 0, r["n_pretokens"]) for r in lattice.token_counts(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect())
    assert found == [(0, 2), (1, 0), (1, 0), (3, 1)]
    assert lattice.token_counts(odd.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def plain_entropy(rows, target, most=entropy.WORDS):
    split = [(doc, (text or "").encode().lower().split()) for doc, text in rows]
    counts = Counter(w for _, words in split for w in words)
    known = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:most])}
    ident = lambda w: known.get(w, entropy.WORDS + zlib.crc32(w[-2:]) % entropy.CLASSES)
    pairs = [(doc, list(zip([entropy.EDGE, *map(ident, words)], [*map(ident, words), entropy.EDGE], strict=True))) for doc, words in split]
    both = [Counter(p for doc, ps in pairs if (doc in target) == bool(m) for p in ps) for m in (0, 1)]
    first = [Counter() for _ in both]
    second = [Counter() for _ in both]
    for m in (0, 1):
        for (a, b), n in both[m].items():
            first[m][a] += n
            second[m][b] += n
    total = [sum(c.values()) for c in both]

    def loss(m, a, b):
        single = (second[m][b] + 1) / (total[m] + entropy.IDS)
        return -math.log((both[m][a, b] + entropy.PRIOR * single) / (first[m][a] + entropy.PRIOR))

    return [(doc, len(ps) - 1, np.mean([loss(1, *p) for p in ps]), np.mean([loss(0, *p) for p in ps])) for doc, ps in pairs]


def test_cross_entropy_difference_matches_plain_counts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 1}
    got = {r["doc_id"]: r for r in queries.op3_entropy(spark, sf).collect()}
    for doc, n, own, background in plain_entropy(rows, target):
        assert got[doc]["n_tokens"] == n
        assert math.isclose(got[doc]["target_loss"], own, rel_tol=1e-5) and math.isclose(got[doc]["background_loss"], background, rel_tol=1e-5)
        assert math.isclose(got[doc]["score"], got[doc]["target_loss"] - got[doc]["background_loss"], abs_tol=1e-9)


def test_cross_entropy_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A b  a"), (3, "a B"), (None, "b " * 20_000), (4, "c")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    target = spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")
    got = sorted((r["n_tokens"], round(r["target_loss"], 5), round(r["background_loss"], 5)) for r in entropy.scores(spark, docs, target).collect())
    assert got == sorted((n, round(a, 5), round(b, 5)) for _, n, a, b in plain_entropy(rows, {3}))
    assert entropy.scores(spark, docs.limit(0), target).count() == 0
    assert entropy.scores(spark, docs, target.limit(0)).count() == 6


def test_texts_that_differ_only_in_rare_words_are_told_apart(spark):
    # 3,000 common words, so that the others are rare ones with the same ending
    common = " ".join(f"w{k}" for k in range(3000))
    rows = [(k, f"{common} {common}") for k in range(10)]
    rows += [(10 + k, " ".join(f"the {w}ing of" for w in ("sail", "row", "fish"))) for k in range(8)]
    rows += [(20 + k, " ".join(f"the {w}ing of" for w in ("cod", "test", "debugg"))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in entropy.scores(spark, docs, docs.filter("doc_id between 10 and 13")).collect()}
    assert all(got[10 + k] < got[20 + j] - 0.1 for k in range(8) for j in range(8))


def test_held_out_targets_score_below_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality_of = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learnt = [(d,) for d, q in quality_of.items() if q == 1 and zlib.crc32(str(d).encode()) % 2 == 0]
    got = {r["doc_id"]: r["score"] for r in entropy.scores(spark, docs, spark.createDataFrame(learnt, "doc_id long")).collect()}
    held = {q: [got[d] for d, x in quality_of.items() if x == q and zlib.crc32(str(d).encode()) % 2 == 1] for q in (0, 1)}
    wins = np.mean([(a < b) + 0.5 * (a == b) for a in held[1] for b in held[0]])
    assert wins > 0.9


def test_gradients_match_differences():
    net = language.Network({k: v.astype(np.float64) for k, v in language.Network.fresh(3, 4, 1).weights.items()})
    rng = np.random.default_rng(0)
    data, truth = rng.integers(97, 101, (5, 6)).astype(np.uint8), rng.integers(0, 3, 6)
    counted = rng.integers(0, 2, data.shape)
    _, found = net.gradients(data, truth, counted)

    def loss():
        chance = net.labels(data)
        return (-np.log(chance[:, np.arange(6), truth] + 1e-9) * counted).sum() / counted.sum()

    for name, weight in net.weights.items():
        for at in list(np.ndindex(weight.shape))[:: max(1, weight.size // 7)] + [(98, 1)] * (name.endswith("_in")):
            kept, step = weight[at], 1e-3
            weight[at] = kept + step
            up = loss()
            weight[at] = kept - step
            down = loss()
            weight[at] = kept
            assert math.isclose((up - down) / (2 * step), found[name][at], rel_tol=2e-2, abs_tol=2e-5), (name, at)


def plain_labels(net, raw):
    """Probabilities at each byte of one text, unit by unit."""
    squash = lambda x: x / (1 + abs(x))
    gate = lambda x: (1 + squash(x)) / 2
    w = {k: v.astype(float).tolist() for k, v in net.weights.items()}
    width = len(w["ahead_fresh_own"])

    def states(side, data):
        h, out = [0.0] * width, []
        for byte in data:
            through = {g: [sum(h[i] * w[f"{side}_{g}_own"][i][j] for i in range(width)) for j in range(width)] for g in language.GATES}
            a = {g: w[f"{side}_{g}_in"][byte] for g in language.GATES}
            u = [gate(a["update"][j] + through["update"][j]) for j in range(width)]
            r = [gate(a["reset"][j] + through["reset"][j]) for j in range(width)]
            f = [squash(a["fresh"][j] + r[j] * through["fresh"][j]) for j in range(width)]
            h = [h[j] + u[j] * (f[j] - h[j]) for j in range(width)]
            out.append(h)
        return out

    found = []
    for x, y in zip(states("ahead", raw), states("back", raw[::-1])[::-1], strict=True):
        z = [sum((x + y)[i] * w["out"][i][c] for i in range(2 * width)) + w["out_bias"][c] for c in range(len(w["out_bias"]))]
        e = [math.exp(v) for v in z]
        found.append([v / sum(e) for v in e])
    return found


def test_positions_and_pooling_match_plain_loops():
    net, rng = language.Network.fresh(3, 5, 9), random.Random(3)
    blank, edge, inner, window = b" ", language.EDGE, language.INNER, language.WINDOW
    texts = ["", "a", "größe " * 9, "".join(rng.choice("abc é") for _ in range(700)), "x" * inner, "y" * (inner + 1)]
    raws = [language.prepared(t) for t in texts]
    got = language.document_sums(net, raws, 3, rows=2)
    for raw, sums in zip(raws, got, strict=True):
        plain = np.zeros(3)
        for k in range(0, len(raw), inner):
            padded = blank * edge + raw + blank * window
            found = plain_labels(net, padded[k : k + window])
            plain += np.sum(found[edge : edge + min(inner, len(raw) - k)], axis=0)
        assert np.allclose(sums, plain, rtol=1e-4, atol=1e-4)


def test_state_crosses_words():
    net = language.Network.fresh(2, seed=4)
    one, other = (language.document_sums(net, [b"aaa bcd", b"zzz bcd"], 2))
    alone = language.document_sums(net, [b"aaa", b"zzz"], 2)
    assert not np.allclose(one - alone[0], other - alone[1], atol=1e-5)


def test_language_of_long_documents_only(spark):
    from pyspark.sql import functions as F

    rows = [(k, "thing and the other of them " * 3, "en") for k in range(40)]
    rows += [(100 + k, "schöner größer für die und das " * 2000, "de") for k in range(40)]
    docs = spark.createDataFrame([*rows, (999, "für die und das größer schöner und die schöner für das", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.languages(spark, docs, F.lit(True)).collect()}
    assert all(got[d] == lang for d, _, lang in rows) and got[999] == "de"


def test_languages_of_held_out_documents(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_language(spark, SF).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) / len(held) > 0.97


def test_language_edge_cases(spark):
    from pyspark.sql import functions as F

    rows = [(k, "thing and the other " * 3, "en") for k in range(30)] + [(100 + k, "chöner großes für " * 3, "de") for k in range(30)]
    rows += [(200, None, "en"), (201, " 12 !", "en"), (None, "the other thing", None), (203, "größer" * 9000, None), (203, "the", "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language.languages(spark, docs, F.lit(True)).collect()]
    assert (200, "und") in got and (201, "und") in got and (None, "en") in got and (203, "de") in got and (203, "en") in got
    assert {r["lang_pred"] for r in language.languages(spark, docs, F.lit(False)).collect()} == {"und"}
    assert language.languages(spark, docs.limit(0), F.lit(True)).count() == 0


def test_quality_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op8_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_discriminant_matches_plain_densities():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((80, 4)) @ rng.standard_normal((4, 4)), rng.standard_normal((50, 4)) + 1])
    y = np.array([0] * 80 + [1] * 50)
    model = quality.fit({c: (float((y == c).sum()), x[y == c].sum(axis=0), x[y == c].T @ x[y == c]) for c in (0, 1)}, 0.3, 0.05)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (80 * own[0] + 50 * own[1]) / 130
    density = []
    for c in (0, 1):
        s = 0.7 * own[c] + 0.3 * pooled + 0.05 * np.eye(4)
        d = z - z[y == c].mean(axis=0)
        density.append(np.log((y == c).mean()) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(density[0] - density[1])))


def test_quality_edge_cases(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Fine words here.", 0), (3, "Fine words here.", 0), (None, "$$$ !!!", 0), (5, "y z " * 20_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 0), (9, 1), (2, None), (None, 0), (1, 7)], "doc_id long, quality int")
    got = quality.scores(spark, docs, labels, F.lit(True)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.scores(spark, docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert {r["score"] for r in quality.scores(spark, docs, labels.filter("quality = 1"), F.lit(True)).collect()} == {1.0}
    assert quality.scores(spark, docs.limit(0), labels, F.lit(True)).count() == 0
    assert quality.accepted(spark, docs, labels.limit(0)).count() == 6
