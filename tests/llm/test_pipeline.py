import corpus_pipeline
from wortnetz.llm import queries


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(1)
    clean = [prose(rng, 80) for _ in range(200)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 60).split()) for _ in range(30)] + ["You idiot moron " + prose(rng, 40) + " scum" for _ in range(30)]
    texts = clean + bad + [clean[0], clean[0] + " ", clean[1] + " token=abcdefgh12", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(230 <= i < 260)) for i in range(0, 260, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if k < 4:
            assert kept.columns == docs.columns
        assert set(range(1, 200)) - ids <= {1} and not ids & set(range(200, 260))
        if name == "exact_dedup":
            assert len(ids & {0, 260, 261}) == 1 and len(ids & {263, 264}) == 1
        if name == "secret_scan":
            assert not kept.where("contains(text, 'abcdefgh12')").count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, kept.select("doc_id", "piece", "length").collect()))


def test_extra_columns_with_the_operators_names_stay(spark, tmp_path):
    names = ["keep", "junk_score", "toxic_score", "secrets", "row_key", "digest", "component", "kept", "group_size", "id", "n", "key"]
    texts = ["a plain text of some words that is kept here", "one token=abcdefgh12 in it", "a plain text of some words that is kept here", None, "", "another one, rather different from all that went before"]
    rows = [(i, t, "en", "s", len(t or ""), *(f"{c}{i}" for c in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    got = kept.collect()
    assert {r["doc_id"] for r in got} == {0, 1, 3, 5}
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)
    assert next(r for r in got if r["doc_id"] == 1)["text"] != texts[1]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 13))
    assert set(queries.SQL) <= set(queries.QUERIES)
