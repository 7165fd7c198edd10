import corpus_pipeline
from kpiloom.llm import minhash, mixing, packing


def test_stages_over_a_fixture(spark, tmp_path):
    prose = "the house and the dog are in the garden with the other ones while it is raining over the old town again"
    rows = [(i, " ".join(f"{w}{'' if j % 5 else chr(97 + i % 26) + chr(97 + (i * 7 + j) % 26)}" for j, w in enumerate(prose.split())), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[0][1], "en", "s0") for i in range(4)] + [(200, "1234 !!", "en", "s1"), (201, None, "en", "s1"), (202, "", None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == df.columns
        if name == "language_id":
            assert {r.doc_id for r in df.collect()} - {r.doc_id for r in after.collect()} == {200, 201, 202}
        if name == "near_dedup":
            want = {r.doc_id for r in minhash.similar_sets(docs).where("kept").collect()}
            assert {r.doc_id for r in after.collect()} == want
        if name == "source_mix":
            want = {r.doc_id: r.copies for r in mixing.mix(docs).where("copies > 0").collect()}
            got = after.groupBy("doc_id").count().collect()
            assert {r.doc_id: r["count"] for r in got} == want
        if name == "best_fit_packing":
            assert sorted(after.select("doc_id", "n_words").collect()) == sorted(packing.pack(docs).select("doc_id", "n_words").collect())
        docs = after
        kept.append(after.count())
    assert all(kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1]


def test_equal_rows_are_mixed_once_each_and_deduplicated(spark, tmp_path):
    rows = [(1, "a b c d e f g", "x")] * 4 + [(i, " ".join(f"w{i}_{j}" for j in range(30)), "y") for i in range(2, 12)] + [(None, "no id here", "x"), (None, "no id there", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df).agg({"taken": "sum"}).first()[0]
    out = corpus_pipeline.mix(spark, df, str(tmp_path)).collect()
    assert sum(len(r.text.split()) for r in out) == taken
    left = corpus_pipeline.near(spark, df, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted({(i or 0, t) for i, t, _ in rows})
