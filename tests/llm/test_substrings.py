import hashlib
import random
import re

import pytest

from terrane.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Windows by brute force: doc_id -> (n_words, n_removed, kept_sha256)."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.setdefault(window, (doc, p))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(frame):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in frame.collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_brute_force(spark, sf):
    want = plain([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op5_substrings(spark, sf).collect()}
    assert found == want


@pytest.mark.parametrize("letters", [1, 2, 5, 60])
def test_repeats_of_all_kinds(spark, letters):
    rng = random.Random(letters)
    passages = [[f"w{rng.randrange(letters)}" for _ in range(rng.choice([19, 20, 21, 25, 40, 90]))] for _ in range(12)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.3:
                words += [rng.choice(["w0", "w1"])] * rng.randint(1, 45)
        rows.append((doc * 3 - 50, rng.choice([" ", "  ", "\n"]).join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(substrings.deduplicated(spark, docs)) == plain(rows)


def test_edge_cases(spark):
    long = " ".join(f"x{k % 977}" for k in range(30_000))
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, "one two", "c", 3), (4, long, "d", 4), (5, long, None, 5), (None, long, "f", 6), (7, "é   " * 30, "g", 7), (8, "short " * 19, "h", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, doc int")
    found = {r["doc"]: r for r in substrings.deduplicated(spark, docs).collect()}
    want = plain([r[:2] for r in rows if r[0] is not None])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in found.values() if r["doc_id"]} == {k: v[:2] for k, v in want.items()}
    assert found[6]["n_removed"] == 0 and found[6]["n_words"] == 30_000
    assert substrings.deduplicated(spark, docs.limit(0)).count() == 0
    twice = docs.filter("doc_id = 4").drop("doc")
    assert {r["n_removed"] for r in substrings.deduplicated(spark, twice.unionByName(twice)).collect()} == {want[4][1]}


def test_long_symbols_reveal_and_verify_long_repeats(spark):
    rng = random.Random(4)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    shared, whole = text(600), " ".join(text(400))
    rows = [(k, " ".join(text(rng.randint(3, 40)) + shared + text(rng.randint(3, 40)))) for k in range(6)] + [(10, whole), (11, whole)]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(4)
    gone = {}
    for r in substrings.revealed(substrings.symbol_rows(docs)).collect():
        gone.setdefault(r["doc"], set()).update(range(r["at"], r["at"] + r["n"]))
    assert set(gone) == {1, 2, 3, 4, 5, 11} and len(gone[11]) == 381
    assert all(len(gone[k]) > 300 for k in range(1, 6))
    want = plain(rows)
    assert got(substrings.deduplicated(spark, docs.withColumnRenamed("doc", "doc_id"))) == want
    windows = {}
    for doc, text in rows:
        words = text.split()
        for p in range(len(words) - 19):
            windows.setdefault(tuple(words[p : p + 20]), []).append((doc, p))
    late = {place for places in windows.values() for place in places[1:]}
    assert {(doc, p) for doc, places in gone.items() for p in places} <= late


def test_texts_that_share_an_id_and_clashing_names(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"u{rng.randrange(500)}" for _ in range(n))
    one, two, three = text(90), text(90), text(90)
    # what repeats at the start of a text of id 2 must not hide the first occurrence that starts another text of it
    rows = [(1, one), (2, one), (2, two), (3, two), (3, three), (4, three + " " + two)]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], "doc_id long, text string, `__gone` int, `row` string, gone int, `a.b` int")
    found = substrings.deduplicated(spark, docs)
    assert found.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    removed = {(r["doc_id"], r["text"]): r["n_removed"] for r in found.collect()}
    assert removed == {(1, one): 0, (2, one): 90, (2, two): 90, (3, two): 90, (3, three): 90, (4, three + " " + two): 180}
    with pytest.raises(TypeError):
        substrings.deduplicated(spark, docs.withColumn("doc_id", docs["doc_id"].cast("string")))
