from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import queries


def test_stages_and_run(spark, tmp_path):
    rows = [(i, f"the quick brown fox {i} jumps over the lazy dog number {i * 7} and rests near tree {i} today", "en", f"s{i % 3}", 10) for i in range(60)]
    near = " ".join(f"word{k}" for k in range(80))
    rows += [(100 + i, near + f" tail{i}", "en", "s0", 10) for i in range(5)] + [(200, None, "en", "s1", 0), (201, "12 34", "fr", "s1", 5), (202, "my password=abcdef123456 is here with other words around it", "en", "s2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "secret_scan", "source_mixing", "byte_bpe"]
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        read = spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = read
        if k < 4:
            assert read.columns == docs.columns
    ids = lambda n: {r.doc_id for r in held[n].select("doc_id").collect()}
    assert ids("language_id") == set(range(60)) | set(range(100, 105)) | {202}
    assert ids("ngram_jaccard_join") == set(range(60)) | {100, 202}
    assert "abcdef123456" not in {r.doc_id: r.text for r in held["secret_scan"].collect()}[202]
    assert ids("source_mixing") == ids("secret_scan") == ids("byte_bpe")
    assert all(r.n_tokens == len(r.token_ids) for r in held["byte_bpe"].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == held["byte_bpe"].count()


def test_rows_without_a_doc_id_and_clashing_columns(spark, tmp_path):
    near = " ".join(f"word{k}" for k in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, score double, node long, s string, h long, t long"
    rows = [(None, "12 34", "en"), (None, "a clear text of its own kind", "en"), (None, "another clear text with nothing shared", None), (None, "another clear text with nothing shared", None)]
    rows += [(None, near + " tail", "en"), (9, near, "en"), (9, near, "en"), (4, "one more document of a few words", "fr"), (None, None, None)]
    docs = spark.createDataFrame([(*r, None, 5, 1, 0.5, 2, "x", 3, 4) for r in rows], schema)
    known = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert known.columns == docs.columns and known.count() == 7
    kept = corpus_pipeline.keep_one_of_each_group(spark, known, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, rows[1][1]), (0, rows[2][1]), (9, near), (4, rows[7][1])])
    mixed = corpus_pipeline.mix_sources(spark, corpus_pipeline.redact_secrets(spark, kept, ""), "")
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} == {r.text for r in kept.collect()}
    # without labels nothing is rejected but what has no letter; an empty table passes through
    assert corpus_pipeline.keep_known_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 7
    df = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() == 0


def test_rows_with_one_doc_id_and_several_texts(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(60)) for x in ("one", "two"))
    clear = "a clear text that has no copy anywhere at all"
    rows = [(3, one), (7, one + " tail"), (7, clear), (7, clear), (8, two), (8, two + " end"), (9, two), (None, one + " end"), (-4, "a negative number is a doc_id as well")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    assert len(kept) == 4 and {(3, one), (7, clear), rows[8]} <= set(kept)
    assert [t in (two, two + " end") for i, t in kept if i == 8] == [True]


def test_every_operator_is_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLES) <= set(names)
