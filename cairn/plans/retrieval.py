"""Queries: tokenisers, BM25, vectors, fusion, reranking, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import blockmax, cells, chunking, fusion, lexical, rerank, vector
from cairn.operators.common import sent, top
from cairn.plans import adapters as ad
from cairn.plans.registry import query, table

TOKENS = f"""
    tok AS (SELECT doc_id AS id, unnest({ad.sql_tokens("text")}) AS term FROM documents),
    post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT doc_id AS id, len({ad.sql_tokens("text")}) AS dl FROM documents),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)
"""
LUCENE = "weights AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, corpus GROUP BY term)"
OKAPI = """
    raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corpus GROUP BY term),
    weights AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""
SCORED = f"""
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({ad.sql_tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
    scored AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN weights USING (term) JOIN post USING (term) JOIN dl USING (id), corpus GROUP BY ALL)
"""


def top_sql(source: str, k: int, by: str = "query_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, id) AS rank FROM {source}) WHERE rank <= {k})"


_INDEXES: dict[tuple, lexical.LexicalIndex | blockmax.BlockIndex] = {}


def _built(spark: SparkSession, sf_dir: str, kind, **options):
    """An index of the documents, built once for an application and then searched by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, *sorted(options.items()))
    if key not in _INDEXES:
        _INDEXES[key] = kind.build(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), **options)
    return _INDEXES[key]


def _index(spark: SparkSession, sf_dir: str, **options) -> lexical.LexicalIndex:
    return _built(spark, sf_dir, lexical.LexicalIndex, **options)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {ad.SQL_IDENTIFIERS} SELECT id, array_to_string({ad.sql_tokens('text')}, ' ') AS tokens FROM identifiers")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.identifiers(spark, sf_dir).select("id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"WITH {TOKENS} SELECT * FROM post")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(f"WITH {TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(lexical.doc_stats(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {TOKENS}, {LUCENE} SELECT term, df, round(idf, 6) AS idf FROM weights")
def idf_lucene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).weights.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {TOKENS}, {OKAPI} SELECT term, df, round(idf, 6) AS idf FROM weights")
def idf_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, idf="okapi").weights.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {TOKENS}, {LUCENE}, {SCORED} SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql('scored', 10)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_index(spark, sf_dir).search(_items(spark, sf_dir), "item_id", F.col("text"), 10))


@query(f"WITH {TOKENS}, {OKAPI}, {SCORED} SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql('scored', 10)}")
def bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_index(spark, sf_dir, idf="okapi").search(_items(spark, sf_dir), "item_id", F.col("text"), 10))


@query(f"WITH {TOKENS}, {LUCENE}, {SCORED} SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql('scored', 10)}")
def bm25_blockmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, reading only the blocks of postings that can hold one of a query's ten best."""
    return _shown(_built(spark, sf_dir, blockmax.BlockIndex).search(_items(spark, sf_dir), "item_id", F.col("text"), 10))


def embed_sql(name: str, source: str, key: str) -> str:
    h = "CAST('0x' || substr(md5(token), 1, 15) AS BIGINT)"
    return f"""
    {name}_w AS (SELECT id, token, 1 + ln(count(*)) AS w FROM (SELECT {key} AS id, unnest({ad.sql_tokens("text")}) AS token FROM {source}) GROUP BY ALL),
    {name}_s AS (SELECT id, CAST({h} % 384 AS INT) AS bucket, sum(w * CASE WHEN ({h} >> 40) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM {name}_w GROUP BY ALL),
    {name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY id),
    {name} AS (SELECT id, bucket, v / CASE WHEN norm = 0 THEN 1 ELSE norm END AS v FROM {name}_s JOIN {name}_n USING (id))"""


DENSE = f"{embed_sql('dv', 'documents', 'doc_id')}, {embed_sql('qv', 'benchmark', 'item_id')}, dense AS (SELECT qv.id AS query_id, dv.id, sum(qv.v * dv.v) AS score FROM qv JOIN dv USING (bucket) GROUP BY ALL)"


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vector.embed_postings(_index(spark, sf_dir).index), vector.hash_embed(_items(spark, sf_dir), "item_id", F.col("text"))


@query(f"WITH {embed_sql('dv', 'documents', 'doc_id')} SELECT id, bucket, round(v, 6) AS v FROM dv")
def hash_embed_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(spark, sf_dir)[0].select("id", "bucket", F.round("v", 6).alias("v"))


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs, items = _embedded(spark, sf_dir)
    return vector.sparse_top(docs, items, k)


@query(f"WITH {DENSE} SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql('dense', 10)}")
def hash_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_dense(spark, sf_dir, 10))


COSINE = """
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    near AS (SELECT q.vec_id AS query_id, d.vec_id AS id, list_dot_product(q.e, d.e) AS score, q.label AS q_label, d.label FROM u q, u d WHERE q.vec_id % 50 = 0)
"""


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector.cosine_top(vectors, vectors.where("vec_id % 50 = 0"), k)  # every fiftieth vector is a query against all


@query(f"WITH {COSINE} SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql('near', 10)}")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_near(spark, sf_dir, 10))


@query(f"WITH {COSINE} SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql('near', 10)}")
def cosine_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cosine_topk, reading only the cells that can hold one of a query's ten nearest."""
    vectors = table(spark, sf_dir, "embeddings")
    return _shown(cells.CellIndex.build(vectors).search(vectors.where("vec_id % 50 = 0"), 10))  # every fiftieth vector is a query against all


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(e[-1] / sqrt(list_dot_product(e, e)), 6) AS last FROM v")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", vector.normalised(F.col("embedding")).alias("e"))
    return unit.select("vec_id", F.round(F.element_at("e", 1), 6).alias("first"), F.round(F.element_at("e", -1), 6).alias("last"))


KEY = "sha256('hashing-384' || chr(0) || text)"


@query(f"WITH have AS (SELECT DISTINCT {KEY} AS key FROM documents WHERE lang = 'en') SELECT DISTINCT {KEY} AS key, length(text) AS n FROM documents WHERE {KEY} NOT IN (SELECT key FROM have)")
def embed_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("lang = 'en'").select(tx.cache_key(F.lit("hashing-384"), F.col("text")).alias("key")).distinct()
    return vector.cache_misses(docs, cache, "hashing-384").select("key", F.length("text").cast("long").alias("n"))


FUSED = f"""{TOKENS}, {LUCENE}, {SCORED}, {DENSE},
    hits AS (SELECT query_id, id, rank, 'bm25' AS method, score FROM {top_sql('scored', 50)} UNION ALL SELECT query_id, id, rank, 'vector', score FROM {top_sql('dense', 50)})"""
LABEL = "CASE WHEN min(rank) FILTER (WHERE method = 'vector') < coalesce(min(rank) FILTER (WHERE method = 'bm25'), 1e9) THEN 'vector' ELSE 'bm25' END AS method"


def _retriever(spark: SparkSession, sf_dir: str, **options) -> fusion.HybridRetriever:
    index = _index(spark, sf_dir)
    return fusion.HybridRetriever(lambda q, k: index.search(q, "query_id", F.col("text"), k), lambda q, k: _dense(spark, sf_dir, k), **options)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 7).alias("topic"))


@query(f"WITH {FUSED}, fused AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, {LABEL} FROM hits GROUP BY ALL) SELECT query_id, id, round(score, 6) AS score, method, rank FROM {top_sql('fused', 10)}")
def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_retriever(spark, sf_dir).search(_queries(spark, sf_dir), 10))


@query(f"WITH {FUSED}, fused AS (SELECT query_id % 7 AS topic, id, sum(CASE method WHEN 'bm25' THEN 0.45 ELSE 0.4 END / (60 + rank)) AS score, {LABEL} FROM hits GROUP BY 1, 2) SELECT topic, id, round(score, 6) AS score, method, rank FROM {top_sql('fused', 10, 'topic')}")
def rrf_weighted_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are grouped into topics, each searched with several queries at once."""
    return _shown(_retriever(spark, sf_dir, w_lexical=0.45, w_dense=0.40).search(_queries(spark, sf_dir), 10, ["topic"]))


@query(f"WITH {TOKENS}, {LUCENE}, {SCORED}, best AS (SELECT query_id % 7 AS topic, id, max(score) AS score FROM {top_sql('scored', 10)} GROUP BY 1, 2) SELECT topic, id, round(score, 6) AS score, rank, 'bm25' AS method FROM {top_sql('best', 10, 'topic')}")
def single_mode_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_retriever(spark, sf_dir, mode="bm25").search(_queries(spark, sf_dir), 10, ["topic"]))


@query(f"WITH {FUSED} SELECT query_id, method, id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")
def search_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_retriever(spark, sf_dir).hits(_queries(spark, sf_dir), 10)).select("query_id", "method", "id", "score", "rank")


def rerank_sql(x: str) -> str:
    found = rf"regexp_extract_all(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-zA-Z0-9_]+')"
    return f"list_distinct(list_filter(list_concat({found}, flatten(list_transform({found}, lambda t: string_split(t, '_')))), lambda t: length(t) > 1))"


@query(f"WITH {ad.SQL_IDENTIFIERS} SELECT id, array_to_string(list_sort({rerank_sql('text')}), ' ') AS tokens FROM identifiers")
def rerank_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.identifiers(spark, sf_dir).select("id", F.array_join(F.array_sort(tx.rerank_tokens(F.col("text"))), " ").alias("tokens"))


CANDIDATES = f"""{TOKENS}, {LUCENE}, {SCORED},
    hit AS (SELECT h.*, b.text AS query, d.source || '/' || d.doc_id || '.txt' AS path, d.text AS content, split_part(d.text, ' ', 1) AS symbol FROM {top_sql('scored', 20)} h JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id),
    sets AS (SELECT *, score / 100.0e0 AS base, CAST(rank % 3 AS INT) AS hop, {rerank_sql('query')} AS q, {rerank_sql('symbol')} AS s, {rerank_sql('path')} AS p, {rerank_sql('content')} AS c FROM hit),
    final AS (SELECT query_id, id, path, hop, CASE WHEN len(q) = 0 THEN base ELSE round(greatest(0, base + 0.35e0 * CASE WHEN length(symbol) > 2 AND contains(lower(query), lower(symbol)) THEN 1.0e0 ELSE len(list_intersect(q, s)) / greatest(len(s), 1) END
              + 0.25e0 * (len(list_intersect(q, p)) / greatest(len(p), 1)) + 0.25e0 * (len(list_intersect(q, c)) / greatest(len(q), 1)) - 0.12e0 * hop), 6) END AS score FROM sets)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = sent(_index(spark, sf_dir).search(_items(spark, sf_dir), "item_id", F.col("text"), 20))  # so texts aren't shuffled
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), ad.doc_path().alias("path"), F.col("text").alias("content"), F.split_part("text", F.lit(" "), F.lit(1)).alias("symbol"))
    items = _items(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return docs.join(hits, "id").join(items, "query_id").select(
        "query_id", "query", "symbol", "path", "content", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), (F.col("score") / 100).alias("base_score"), (F.col("rank") % 3).cast("int").alias("hop"), F.col("id").alias("chunk_id")
    )


@query(f"WITH {CANDIDATES} SELECT query_id, id AS chunk_id, hop, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, hop, path) AS rank FROM final) WHERE rank <= 10")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rerank.rerank(_candidates(spark, sf_dir), 20).withColumn("score", F.round("score", 4)).drop("rank")
    return top(ranked, 10, ["query_id"], F.col("score").desc(), F.col("hop"), F.col("path")).select("query_id", "chunk_id", "hop", "score", "rank")


@query(f"WITH {ad.CHUNKS} SELECT chunk_id, path, start_line, end_line, text, commit FROM chunks")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.chunks(spark, sf_dir).drop("symbol")


@query(f"""
    WITH {ad.CHUNKS}, lines AS (SELECT path, unnest(range(1, len(lines) + 1)) AS line FROM cut), taken AS (SELECT path, unnest(range(start_line, end_line + 1)) AS line FROM chunks WHERE start_line % 2 = 0 OR start_line % 3 = 0),
    free AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM (SELECT * FROM lines EXCEPT SELECT * FROM taken))
    SELECT path, CAST(min(line) AS INT) AS start_line, CAST(max(line) AS INT) AS end_line FROM free GROUP BY path, island
""")
def residual_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(ad.doc_path().alias("path"), F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")))).alias("line"))
    return chunking.residual_runs(lines, ad.chunks(spark, sf_dir).where("start_line % 2 = 0 or start_line % 3 = 0"))


@query(f"WITH {CANDIDATES} SELECT query_id, id AS chunk_id, round(score, 4) AS score FROM final WHERE score >= 0.3")
def rerank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates that reach a least score."""
    ranked = rerank.rerank(_candidates(spark, sf_dir), 20, rerank.RerankConfig(least_score=0.3))
    return ranked.select("query_id", "chunk_id", F.round("score", 4).alias("score"))


@query(f"WITH {TOKENS}, {LUCENE}, {SCORED} SELECT query_id, h.id, round(score, 6) AS score FROM {top_sql('scored', 10)} h JOIN documents d ON d.doc_id = h.id WHERE d.lang = 'en'")
def known_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose id is no longer a chunk's go."""
    hits = _index(spark, sf_dir).search(_items(spark, sf_dir), "item_id", F.col("text"), 10)
    chunks = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return _shown(fusion.known(hits, chunks)).select("query_id", "id", "score")
