import re

import sentencepiece

import corpus_pipeline
from terrane.llm import mixing, queries, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
        seen.append((docs.collect(), after.collect()))
        docs = after
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 0}
    kept = {r["doc_id"] for r in seen[0][1]}
    assert len(bad & kept) <= 1 and len(kept) > 150
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark, spark.createDataFrame(seen[1][0])).collect()}
    assert {r["doc_id"] for r in seen[1][1]} == set(groups.values())
    windows = set()
    for r in sorted(seen[2][0], key=lambda r: r["doc_id"]):
        words = r["text"].split()
        gone = set()
        for p in range(len(words) - 19):
            w = tuple(words[p : p + 20])
            gone |= set(range(p, p + 20)) if w in windows else set()
            windows.add(w)
        left = next((x for x in seen[2][1] if x["doc_id"] == r["doc_id"]), None)
        want = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert left is None and not want or (left["text"] == (want if gone else r["text"]) and left["n_chars"] == (len(want) if gone else r["n_chars"]))
    before = {r["doc_id"] for r in seen[3][0]}
    assert {r["doc_id"] for r in seen[3][1]} <= before and len(seen[3][1]) > 0.5 * len(before)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r["doc_id"]: r["text"] for r in seen[4][0]}
    assert len(seen[4][1]) == len(seen[4][0])
    for r in seen[4][1]:
        assert library.encode(texts[r["doc_id"]]) == [int(x) for x in r["ids"].split(",") if x] and r["decoded"] == texts[r["doc_id"]]


def test_run_gives_the_same_as_the_stages(spark):
    one, two = (sorted((r["doc_id"], r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert one == two and one


def test_stages_take_odd_documents(spark):
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (None, "some words here", None, "a", 15), (None, "some words here", None, "a", 15), (4, "word " * 20_000, "en", "b", 100_000), (4, "word " * 20_000, "en", "b", 100_000)]
    rows += [(10 + k, f"plain text number {k} with several words in it.", "en", "a", 40) for k in range(20)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    once = corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()
    assert sum(r["doc_id"] == 4 for r in once) == 1 and sum(r["doc_id"] is None for r in once) == 2
    assert re.search("word", corpus_pipeline.substring_dedup(spark, docs.filter("doc_id = 4").limit(1), SF).first()["text"])
    assert mixing.mixed_documents(spark, docs).columns == docs.columns
