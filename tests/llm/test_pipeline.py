"""The pipeline against plain versions of its stages on each stage's own input."""

import corpus_pipeline

from cairn.llm import jaccard_join, piece_codec, queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        if name == "n-gram Jaccard join":
            assert jaccard_join.near_duplicates(out).where("component_id <> doc_id").count() == 0
        if name == "benchmark decontamination":
            from cairn.llm import decontamination

            assert decontamination.contamination(out, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").count() == 0
        docs = out
    codec = piece_codec.PieceCodec(queries.tokenizer_file("piece_bpe_32k.model"))
    for r in docs.limit(20).collect():
        assert codec.digest(r.text) == (r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_stages_on_odd_rows(spark, docs):
    """Nulls, empty texts and repeated rows pass through every stage."""
    frame = docs([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y")]).drop("id", "node")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, frame, DATA).count() <= 5, name
    assert all(stage(spark, frame.limit(0), DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_long_passages_under_a_hot_source(spark):
    """A third of all rows is of one source, so copies of a passage lie on few sites; short lines on as many sites stay."""
    passage, edge = (" ".join(f"{c}{k}" for k in range(60)) for c in "pe")
    short = " ".join(f"s{k}" for k in range(50))
    rows = [(i, f"own {i}", "hot" if i % 3 == 0 else f"s{i % 19}") for i in range(90)]
    rows += [(100 + i, f"more {i}\n{passage}\n{short}\n{edge if i < 16 else ''}", "hot" if i < 13 else f"s{i % 4}") for i in range(20)]  # on 5, 5 and 4 sites
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.lines(spark, frame, DATA).collect()}
    assert [i for i, t in got.items() if passage in t] == [100]
    assert sum(short in t for t in got.values()) == 20 and sum(edge in t for t in got.values()) == 16 and len(got) == len(rows)


def test_one_row_of_each_group_of_near_duplicates(spark, docs):
    """Also where ids are null or repeated."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    a, b, c, d, e = map(text, "abcde")
    near = lambda t: t + " more"
    rows = [(1, a), (1, a), (1, c), (2, c), (None, a), (None, near(a)), (3, near(a)), (None, b), (None, b), (None, near(b)), (4, d), (4, e), (5, None), (None, None), (None, None)]
    frame = docs(rows).drop("id", "node")
    got = corpus_pipeline.near_duplicates(spark, frame, DATA)
    kept = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    one_b = [x for x in kept if x[1].startswith("b0")]
    assert len(one_b) == 1 and one_b[0][0] == "None"
    assert [x for x in kept if x not in one_b] == sorted([("1", a), ("1", c), ("4", d), ("4", e), ("5", ""), ("None", "")])
    assert got.columns == frame.columns


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
