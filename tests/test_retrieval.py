import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import blockmax, cells, chunking, fusion, lexical, rerank, vector


def corpus(n=60):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 40))) for _ in range(n)]


def by_hand(docs, query, k1, b, okapi):
    bags = [Counter(t for w in d.split() for t in ([w] if w.isalpha() else [w, w[0], w[1:]])) for d in docs]
    n, sizes = len(docs), [sum(x.values()) for x in bags]
    mean = sum(sizes) / n
    df = Counter(t for x in bags for t in x)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: (raw[t] if raw[t] >= 0 else low) if okapi else math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    terms = [t for w in query.split() for t in [w, w[0], w[1:]]]
    return [sum(idf.get(t, 0) * x[t] * (k1 + 1) / (x[t] + k1 * (1 - b + b * s / mean)) for t in terms) for x, s in zip(bags, sizes)]


def test_bm25_by_hand(spark):
    docs = corpus()
    frame = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    queries = ["w0 w5 w5", "w39 q9", "w1 w2 w3"]
    asked = spark.createDataFrame(list(enumerate(queries)), "qid int, text string")
    for okapi, k1, b in ((False, 1.5, 0.75), (True, 1.2, 0.5), (False, 2.0, 0.9)):
        index = lexical.LexicalIndex.build(frame, "id", F.col("text"), idf="okapi" if okapi else "lucene", k1=k1, b=b)
        got = {(r.query_id, r.id): r.score for r in index.search(asked, "qid", F.col("text"), 1000).collect()}
        for q, text in enumerate(queries):
            for d, score in enumerate(by_hand(docs, text, k1, b, okapi)):
                assert abs(got.get((q, d), 0) - score) < 1e-9


def test_index_survives_saving(spark, tmp_path):
    frame = spark.createDataFrame([(1, "Cart.add_item"), (2, "Cart.total"), (3, "apply_discount")], "id int, text string")
    index = lexical.LexicalIndex.build(frame, "id", F.col("text"))
    index.save(str(tmp_path))
    asked = spark.createDataFrame([(0, "Cart.add_item"), (1, "apply discount"), (2, "zzz_not_present")], "q int, text string")
    got = lexical.LexicalIndex.load(spark, str(tmp_path)).search(asked, "q", F.col("text"), 1).collect()
    assert {(r.query_id, r.id) for r in got} == {(0, 1), (1, 3)}


def test_rrf(spark):
    rows = [("q", "bm25", "c1", 10.0), ("q", "bm25", "c2", 5.0), ("q", "vector", "c2", 0.9), ("q", "vector", "c1", 0.8)]
    hits = fusion.ranked(spark.createDataFrame(rows, "query_id string, method string, id string, score double"))
    got = fusion.rrf(hits, ["query_id"]).orderBy("rank").collect()
    assert [r.id for r in got] == ["c1", "c2"]
    assert all(abs(r.score - (1 / 61 + 1 / 62)) < 1e-12 for r in got)
    assert [r.method for r in got] == ["bm25", "vector"]
    known = fusion.known(hits, spark.createDataFrame([("c2",)], "chunk_id string"))
    assert {r.id for r in known.collect()} == {"c2"}


def test_rerank_prefers_the_target(spark):
    rows = [("q", "fix divide", "divide", "calc.py", "def divide(a, b)", 1, 2, 0.50, 0, "a"), ("q", "fix divide", "noise", "other.py", "pass", 1, 2, 0.55, 2, "b"), ("q", "fix divide", "noise", "other.py", "pass", 1, 2, 0.1, 2, "c")]
    frame = spark.createDataFrame(rows, "query_id string, query string, symbol string, path string, content string, start_line int, end_line int, base_score double, hop int, chunk_id string")
    got = rerank.rerank(frame).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b"]


def test_cosine_matches_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 8))
    m[7] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "vec_id int, embedding array<double>")
    got = vector.cosine_top(frame, frame.where("vec_id < 5"), 3, block_rows=2).orderBy("query_id", "rank").collect()
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    for q in range(5):
        want = sorted(range(50), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:3]
        assert [r.id for r in got if r.query_id == q] == want


def test_hash_embedding_modes(spark):
    frame = spark.createDataFrame([(1, "a b b"), (2, "")], "id int, text string")
    for mode in ("md5", "blake2b"):
        sparse = vector.hash_embed(frame, "id", F.col("text"), mode=mode)
        assert abs(sparse.agg(F.sum(F.col("v") * F.col("v"))).first()[0] - 1) < 1e-9
        assert len(vector.dense(sparse).first().vector) == 384


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    embed = lambda miss: miss.select("key", F.array(F.length("text").cast("float")).alias("vector"))
    every, new = vector.through_cache(texts, cache, "m", embed)
    assert (every.count(), new.count()) == (2, 2)
    assert vector.cache_misses(texts, new, "m").count() == 0


def test_windows_and_residuals(spark):
    text = "\n\n    a\n      b\n\nc\n\n"
    docs = spark.createDataFrame([("f.py", text), ("g.py", " \n ")], "path string, text string")
    spans = chunking.document_spans(docs, F.col("path"), F.col("text"), F.lit("h"))
    got = chunking.windows(spans, 2).orderBy("start_line").collect()
    assert [(r.chunk_id, r.text) for r in got] == [("f.py:3-4", "a\n  b"), ("f.py:5-6", "\nc")]
    lines = docs.where("path = 'f.py'").select("path", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("line"))
    covered = spark.createDataFrame([("f.py", 2, 3), ("f.py", 6, 6)], "path string, start_line int, end_line int")
    runs = chunking.residual_runs(lines, covered).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in runs] == [(1, 1), (4, 5), (7, 8)]


def _shop(spark, n=600):
    """Texts in which a few are about what is asked, and every word is frequent somewhere."""
    dice = random.Random(4)
    say = lambda: " ".join(f"w{min(dice.randrange(80), dice.randrange(80))}" for _ in range(dice.randrange(5, 40)))
    rows = [(i, say() + (" rare rare word" if i % 97 == 0 else "") + (" common" if i % 3 else "")) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(1, "rare word common"), (2, "w1 w1 w40 common"), (3, "none at all"), (4, "word w2")], "q long, text string")


def test_block_maxima_leave_out_what_cannot_win(spark, tmp_path):
    docs, queries = _shop(spark)
    full = lexical.LexicalIndex.build(docs, "id", F.col("text"))
    index = blockmax.BlockIndex.build(docs, "id", F.col("text"), str(tmp_path / "index"))
    plain = lambda found: sorted((r.query_id, r.id, round(r.score, 8), r["rank"]) for r in found.collect())
    for k in (1, 5, 40):
        assert plain(index.search(queries, "q", F.col("text"), k)) == plain(full.search(queries, "q", F.col("text"), k))
    terms, first, second, _ = index.plan(queries, "q", F.col("text"), 2)
    every = terms.join(index.maxima, "term").groupBy("query_id").agg(F.sum("n").alias("n"))
    read = first.unionByName(second).groupBy("query_id").agg(F.sum("n").alias("read"))
    got = {r.query_id: (r.read, r.n) for r in read.join(every, "query_id").collect()}
    assert got[1][0] < got[1][1] / 2 and all(r <= n for r, n in got.values()) and 3 not in got


def test_a_loaded_index_is_not_shuffled(spark, tmp_path):
    docs, queries = _shop(spark)
    path = str(tmp_path / "index")
    blockmax.BlockIndex.build(docs.where("id < 500"), "id", F.col("text"), path).merge(docs.where("id >= 480").unionByName(docs.where("id = 3").withColumn("text", F.lit("rare word"))), "id", F.col("text"))
    for t in spark.catalog.listTables():
        if t.name.startswith(("blocks_", "maxima_")):
            spark.sql(f"DROP TABLE {t.name}")
    index = blockmax.BlockIndex.load(spark, path)
    now = docs.where("id <> 3").unionByName(docs.where("id = 3").withColumn("text", F.lit("rare word")))
    want = lexical.LexicalIndex.build(now, "id", F.col("text")).search(queries, "q", F.col("text"), 10)
    assert sorted((r.query_id, r.id, round(r.score, 8)) for r in index.search(queries, "q", F.col("text"), 10).collect()) == sorted((r.query_id, r.id, round(r.score, 8)) for r in want.collect())
    terms = spark.createDataFrame([(1, "rare", 1.0)], "query_id long, term string, w double")
    slots = spark.createDataFrame([(1, 3)], "query_id long, slot long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        assert "Exchange" not in index.weights()._jdf.queryExecution().executedPlan().toString()
        assert exchanges_below_join(index._bounds(terms), "maxima_") == 0 == exchanges_below_join(index._scores(terms, slots), "blocks_")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def exchanges_below_join(df, scan):
    """How many exchanges lie between a scan and the first join above it, in the plan that runs."""

    def walk(node, over):
        name = node.nodeName()
        if name.startswith("Scan") and scan in node.toString():
            yield over
        over = over + 1 if "Exchange" in name else 0 if "Join" in name else over
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k), over)

    return min(walk(df._jdf.queryExecution().executedPlan(), 0), default=None)


def test_cells_find_what_a_full_search_finds(spark):
    """Clustered vectors, copies, zero vectors, a null; and a query of length 0."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 16))
    rows = [(i, (middle[i % 12] + 0.1 * rng.normal(size=16)).round(3).tolist()) for i in range(700)]
    rows += [(700 + i, rows[i][1]) for i in range(40)] + [(800, [0.0] * 16), (801, [0.0] * 16), (802, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 60 = 0 or vec_id = 801")
    index = cells.CellIndex.build(frame, cells=24)
    plain = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in df.collect())
    full = plain(vector.cosine_top(frame, asked, 7))
    assert plain(index.search(asked, 7)) == full
    assert plain(index.search(asked, 7, probe=1, block_rows=3)) == full
    short = {x[0::2] for x in plain(index.search(asked, 7, probe=4, exact=False))}
    assert len(short & {x[0::2] for x in full}) >= 0.9 * len(full)
    assert index.search(asked.limit(0), 3).count() == 0
    assert cells.CellIndex.build(frame.limit(0)).search(asked, 3).count() == 0
    assert plain(cells.CellIndex.build(frame.where("vec_id in (800, 801)")).search(frame.where("vec_id = 0"), 3)) == [(0, 1, 800, 0.0), (0, 2, 801, 0.0)]


def test_best_breaks_ties_by_id():
    q, v = np.eye(2), np.array([[1, 0], [1, 0], [0, 1], [1, 0], [0.5, 0.5]], float)
    ids = np.array([9, 3, 5, 4, 1])
    assert [x.tolist() for x in vector.best(np.array([70, 71]), ids, q, v, 2)[:2]] == [[70, 70, 71, 71], [3, 4, 5, 1]]
    assert len(vector.best(np.array([70, 71]), ids, q, v, 50)[0]) == 10


def test_scores_are_added_where_postings_lie(spark):
    """Only each task's best rows of a query are shuffled; texts without terms, empty and null ones count as documents."""
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 3} Cart.add_item") for k in range(40)] + [(40, ""), (41, None), (42, "?!")], "id int, text string")
    asked = spark.createDataFrame([(0, "w1 w2"), (1, "cart w5")], "q int, text string")
    index = lexical.LexicalIndex.build(docs, "id", F.col("text"))
    scored = lexical.bm25(lexical.query_terms(asked, "q", F.col("text")), index.index, index.stats, index.corpus, index.weights)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(id" not in plan
    n, mean = index.corpus.first()
    assert n == 43 and abs(mean - index.index.agg(F.sum("tf")).first()[0] / 43) < 1e-12
    few = {tuple(r) for r in index.search(asked, "q", F.col("text"), 5).collect()}
    spread = lexical.LexicalIndex(index.index.drop("dl").repartition(3), index.stats).search(asked, "q", F.col("text"), 5)
    assert len(few) == 10 and {(q, i, round(s, 9), r) for q, i, s, r in few} == {(q, i, round(s, 9), r) for q, i, s, r in spread.collect()}


def test_vectors_of_counted_tokens(spark):
    """Vectors of an index's postings are those of its texts, and what lies by id is not shuffled for them."""
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 3} Cart.add_item w{k % 7}") for k in range(30)] + [(30, ""), (31, None)], "id int, text string")
    got = vector.embed_postings(lexical.LexicalIndex.build(docs, "id", F.col("text")).index)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    cells = lambda df: {(r.id, r.bucket): round(r.v, 9) for r in df.collect()}
    assert cells(got) == cells(vector.hash_embed(docs, "id", F.col("text")))


def test_blocks_are_made_from_two_shuffles(spark, tmp_path):
    """Of the texts to their ids and of whole documents to their slots; postings aren't shuffled by term as well."""
    docs, _ = _shop(spark)

    def shuffled(made):
        store = spark.sparkContext._jsc.sc().statusStore()
        total = lambda: sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))
        before = total()
        made()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return total() - before

    texts = shuffled(lambda: docs.repartition(4, "id").write.format("noop").mode("overwrite").save())
    assert 0 < texts <= shuffled(lambda: blockmax.BlockIndex.build(docs, "id", F.col("text"), str(tmp_path / "index"))) < 10 * texts
