import hashlib
import random

import numpy as np
import pytest

from terrane.llm import phrases, queries

SF = "/root/testdata/sf0.001"


def plain_level(names, level):
    """One level of the parse of one text, by plain loops."""
    one = lambda x, salt: int(phrases.mixed(np.array([x % (1 << 64)], np.uint64), salt)[0])
    out, k = [], 0
    while k < len(names):
        n = 1
        while k + n < len(names) and names[k + n] == names[k]:
            n += 1
        x = one(names[k], 16 + level)
        out.append(one(x + n, 1) if n > 1 else x)
        k += n
    label, first = list(out), True
    for _ in range(phrases.TOSSES):
        new = []
        for k, x in enumerate(label):
            left = label[k - 1] if k else (0 if first else x ^ 1)
            bit = ((x ^ left) & -(x ^ left)).bit_length() - 1
            new.append(2 * bit + (x >> bit & 1))
        label, first = new, False
    n = len(out)
    assert max(label) < 6 and all(a != b for a, b in zip(label, label[1:]))
    begins = [k for k in range(n) if k == 0 or 1 < k < n - 1 and label[k] > label[k - 1] and label[k] >= label[k + 1]]
    found = []
    for a, b in zip(begins, begins[1:] + [n]):
        total = sum(x * pow(phrases.BASE, j, 1 << 64) for j, x in enumerate(out[a:b]))
        found.append(one(total + b - a, 2))
    return found


def plain_fingerprint(raw):
    names = [int(x) for x in phrases.mixed(np.frombuffer(raw, np.uint8).astype(np.uint64))]
    found, level = set(), 0
    while names:
        names = plain_level(names, level)
        level += 1
        if level >= phrases.LEVEL or len(names) == 1:
            found.update(x >> 32 for x in names)
        if len(names) == 1:
            break
    return sorted(found)[: phrases.KEPT]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    both = sorted(set(a) | set(b))[: phrases.KEPT]
    return len([x for x in both if x in a and x in b]) / len(both)


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = (plain_fingerprint(t.encode()) for t in (text, new, after))
        show = lambda x: "".join(f"{v:08x}" for v in x)
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), show(a), show(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=str)


def rounded(frame):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in frame.collect()), key=str)


def test_flat_parse_matches_plain_loops():
    rng = random.Random(2)
    texts = ["", "a", "aa", "ab", "aab", "éé", "abcabcabcabc" * 9, "x" * 300] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    got = [x.tolist() for x in phrases.fingerprints([t.encode() for t in texts])]
    assert got == [plain_fingerprint(t.encode()) for t in texts]


def test_equal_substrings_share_their_inside():
    rng = random.Random(4)
    inside = "".join(rng.choice("etaoin shrdlu") for _ in range(4000))
    for before in ("", "q", "some words before ", "x" * 77):
        a, b = phrases.fingerprints([inside.encode(), (before + inside).encode()])
        assert phrases.likeness(a, b) > 0.9
    other = "".join(rng.choice("etaoin shrdlu") for _ in range(4000))
    assert phrases.likeness(*phrases.fingerprints([inside.encode(), other.encode()])) < 0.05


@pytest.mark.parametrize(("range_bytes", "cut_ranges", "large"), [(3_000, 10_000, phrases.LARGE_RANGE_BYTES), (phrases.RANGE_BYTES, 10_000, phrases.LARGE_RANGE_BYTES), (3_000, 3, 700)])
def test_edge_cases_in_few_and_many_ranges(spark, monkeypatch, range_bytes, cut_ranges, large):
    monkeypatch.setattr(phrases, "LARGE_RANGE_BYTES", large)
    rng = random.Random(9)
    rows = [(k * 7, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 300)))) for k in range(60)]
    rows += [(None, "no id"), (14, "repeated id"), (14, "repeated id"), (1000, None), (1001, ""), (1002, "word " * 3000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, range int").repartition(3)
    assert rounded(phrases.compared(spark, docs, range_bytes, cut_ranges)) == plain(rows)
    if large == 700:
        assert phrases.in_ranges(spark, docs, range_bytes, cut_ranges).select("range").distinct().count() > 15
    assert phrases.compared(spark, docs.limit(0), range_bytes).count() == 0
    with pytest.raises(TypeError):
        phrases.compared(spark, docs.withColumn("doc_id", docs["doc_id"].cast("string")))
    alone = phrases.compared(spark, docs.filter("doc_id = 1002")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 15000


def test_query_matches_plain_loops(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {r[0]: r for r in plain(rows)}
    got = rounded(queries.op1_phrases(spark, SF))
    assert len(got) == len(rows)
    assert got == sorted(want.values(), key=str)
