import hashlib
import random

import pytest
import sentencepiece

from terrane.llm import pieces, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def test_codec_matches_the_library(library):
    rng = random.Random(8)
    parts = [" ", "  ", pieces.SPACE, "\n", "\t", "a", "the", "é", "中", "😀", "<s>", "<0x0A>", "1", "23", ".", ",", "\x00", "ing", "ß", "​", "er", "�", "²."]
    texts = ["", " ", "  a"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * n + s for n in range(70) for s in ("", "a", " the", "\n")] + ["x" * 3000, "ab" * 2000, "ererer" * 700]
    codec = pieces.PieceCodec(queries.piece_model())
    for text in texts:
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids) == codec.text_of(codec.ids_text(text)), text


def test_pieces_join_as_merging_does():
    codec = pieces.PieceCodec(queries.piece_model())
    rng = random.Random(5)
    for _ in range(2000):
        unit = pieces.SPACE + "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 14)))
        assert codec.split(unit) == codec._merge(unit)


def test_query_matches_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op10_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edge_cases(spark, library):
    rows = [(1, None, 5), (2, "", 5), (None, "a", 5), (3, "long " * 30_000, 5), (3, "again", 5), (3, "again", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids"], r["decoded"]) for r in pieces.encode_documents(docs, queries.piece_model()).collect())
    assert got == sorted((d or 0, len(library.encode(t or "")), ",".join(map(str, library.encode(t or ""))), t or "") for d, t, _ in rows)
    assert pieces.encode_documents(docs.limit(0), queries.piece_model()).count() == 0
