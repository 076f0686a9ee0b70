import random
from collections import Counter, defaultdict

import pytest

from terrane.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def test_quotas_match_seat_by_seat_award():
    rng = random.Random(1)
    for _ in range(60):
        weights = [rng.choice([0, 1, 2, 3, 3.5, 10, rng.random()]) for _ in range(rng.randint(1, 9))]
        seats, held = rng.randint(0, 90), [0] * len(weights)
        if sum(weights):
            for _ in range(seats):
                best = max(range(len(weights)), key=lambda k: (weights[k] / (2 * held[k] + 1), -k))
                held[best] += 1
        assert mixing.sainte_lague(weights, seats).tolist() == held


def test_targets_stop_at_their_cap():
    assert mixing.capped_targets([10, 10, 10], [1, 2, 3], 30, 3).tolist() == [5, 10, 15]
    assert mixing.capped_targets([1, 50, 9], [3, 1, 1], 60, 3).tolist() == [3, 30, 27]
    assert mixing.capped_targets([0, 4], [1, 1], 4, 3).tolist() == [0, 4]
    assert mixing.capped_targets([], [], 0, 3).tolist() == []


def checked(rows, texts, most=3):
    """Holds the rows to the contract."""
    size = Counter()
    for source, text in texts:
        size[source] += len((text or "").encode().split())
    order = sorted([s for s in size if s is not None]) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * size[s]}
        if not over:
            target |= share
            break
        target |= {s: float(most * size[s]) for s in over}
        left -= sum(most * size[s] for s in over)
        free -= over
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= most * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(16, 0.01 * target[s]), (s, taken[s], target[s])


@pytest.mark.parametrize("shard", [300, mixing.SHARD_TOKENS])
def test_mix_of_odd_tables(spark, shard):
    rng = random.Random(2)
    rows = [(k, rng.choice(["b", "a", None, "é", "Z", "hot", "hot", "hot"]), rng.choice(["w " * rng.randint(0, 40), None, "", " \n"])) for k in range(500)]
    rows += [(None, "tiny", "one two"), (7, "b", "repeated row"), (7, "b", "repeated row"), (9, "wide", "x " * 3000), (10, "none", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int").repartition(4)
    found = mixing.mix(spark, docs, shard_tokens=shard).collect()
    assert len(found) == len(rows)
    checked(found, [r[1:3] for r in rows])
    again = mixing.mix(spark, docs.repartition(7), shard_tokens=shard).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), str(r["text"]), r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix(spark, docs.limit(0)).count() == 0
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(spark, docs, shard_tokens=shard).collect())
    want = {r["doc_id"]: round(r["taken"] / r["size"] + 1e-9) for r in found if r["size"] and r["doc_id"] not in (7, None)}
    assert {k: v for k, v in copies.items() if k not in (7, None)} == {k: v for k, v in want.items() if v}


def test_query_keeps_to_the_contract(spark):
    sources = {r["doc_id"]: (r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r.asDict() | {"source": sources[r["doc_id"]][0]} for r in queries.op7_mixing(spark, SF).collect()]
    assert len(got) == len(sources) and all(r["size"] == len((sources[r["doc_id"]][1] or "").encode().split()) for r in got)
    checked(got, sources.values())


def test_clashing_names_and_groups_of_shards(spark):
    names = ["seats", "shards", "tokens", "quota", "nth", "place", "row", "tie", "__source", "a.b"]
    rng = random.Random(7)
    rows = [(str(k), rng.choice("ab"), "w " * rng.randint(0, 30), *range(len(names))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string, " + ", ".join(f"`{n}` int" for n in names))
    found = mixing.mix(spark, docs, shard_tokens=60, group_shards=5)
    assert found.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    checked(found.collect(), [r[1:3] for r in rows], most=3)
    assert all([r[n] for n in names] == list(range(len(names))) for r in found.collect())
    sized = docs.withColumn("size", docs["seats"])
    assert mixing.mixed_documents(spark, sized).columns == sized.columns
    assert {r["size"] for r in mixing.mixed_documents(spark, sized).collect()} == {0}
