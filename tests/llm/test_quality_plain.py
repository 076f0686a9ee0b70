import math
import re
import zlib

import numpy as np

from terrane.llm import quality, queries

SF = "/root/testdata/sf0.001"


def plain_statistics(text):
    """Character by character and word by word."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in re.split(rb"\n", raw) if x]
    n, m = len(raw), len(words)
    share = lambda a, b: math.sqrt(a / (b + 5))
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    stops = sum(c in b".,;:?'\"()-" for c in raw)
    marks = sum(33 <= c < 127 and not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) and c not in b".,;:?'\"()-" for c in raw)
    return [
        math.log(1 + n), math.log(1 + (n - sum(c == 32 for c in raw)) / m) if m else 0.0, share(upper, upper + lower), share(sum(48 <= c <= 57 for c in raw), n), share(stops, n), share(marks, n),
        share(sum(c >= 128 for c in raw), n), share(len(lines), m), math.log(1 + len(set(words))) / math.log(1 + m) if m else 0.0, share(sum(a == b for a, b in zip(words[1:], words[:-1], strict=True)), m),
        share(max((words.count(w) for w in set(words)), default=0), m), share(len(lines) - len(set(lines)), len(lines)), share(sum(re.search(rb"[A-Z]", w) is not None and re.search(rb"[a-z]", w) is None for w in words), m),
    ]


def test_statistics_of_odd_texts():
    texts = ["", " ", "\n\n", "A", "Aé ÀB \n B B b\nB B b\n\n x!? ##", "WORD word WORD. 12 12 12", "ab\x0bcd\x0cef\tgh", "no lines", "x" * 1000 + " " + "y " * 300]
    for text in texts:
        assert np.allclose(quality.statistics(text.encode()), plain_statistics(text), atol=1e-12), text


def test_query_against_plain_densities(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    x = {d: np.array(plain_statistics(t)) for d, t in docs}
    known = [(x[d], q) for d, q in labels if q in (0, 1) and d in x and zlib.crc32(str(d).encode()) % 3 != 1]
    rows, y = np.array([v for v, _ in known]), np.array([q for _, q in known])
    center = rows.mean(axis=0)
    scale = np.sqrt(np.maximum(rows.var(axis=0), 1e-12))
    z = (rows - center) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(own[c] * (y == c).mean() for c in (0, 1))
    want = {}
    for d, v in x.items():
        density = []
        for c in (0, 1):
            cov = 0.7 * own[c] + 0.3 * pooled + 0.05 * np.eye(len(center))
            off = (v - center) / scale - z[y == c].mean(axis=0)
            density.append(math.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * off @ np.linalg.inv(cov) @ off)
        want[d] = 1 / (1 + math.exp(min(700, density[0] - density[1])))
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[d]["score"], want[d], abs_tol=1e-6) and got[d]["predicted"] == int(got[d]["score"] >= 0.5) and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in want)
