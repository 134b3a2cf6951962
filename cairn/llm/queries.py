"""The queries opN_* and `pipeline`, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import centroid_clustering, decontamination, exact_dedup, html_extraction, importance_resampling, jaccard_join, language_id, line_dedup, piece_codec, quality_model, quality_rules, token_counts, url_rules
from cairn.llm.common import table

# The rules that op1 is to apply (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_values(URL_RULES)} AS rules(host, path, verdict)")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Sites from which a line of more than 50 words is boilerplate: one source may hold a third of the rows, so copies lie on few sites.
LONG_SITES = 5


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), long_sites=LONG_SITES).select("doc_id", "text", "n_lines", "n_removed")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return language_id.identify(table(spark, sf_dir, "documents"), held_out)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.sort_means(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_rules": op1_url_rules,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_piece_codec": op5_piece_codec,
    "op6_quality_model": op6_quality_model,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": pipeline,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NO_SPACE = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


ORACLE_SQL: dict[str, str] = {
    "op1_url_rules": rf"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_values(URL_RULES)}),
        parts AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        cut AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        fits AS (SELECT page_id, url, host, path, rule_host || rule_path AS rule, rule_verdict,
                        row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
                 FROM cut LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, url, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE k = 1
    """,
    "op4_line_dedup": rf"""
        WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS y FROM documents),
        spots AS (SELECT doc_id, source, unnest(range(1, len(y) + 1)) AS p, unnest(y) AS line FROM cut),
        occ AS (SELECT doc_id, source, p, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM spots),
        wide AS (SELECT k, min({{'d': doc_id, 'p': p}}) AS first FROM occ WHERE k <> '' GROUP BY k
                 HAVING count(DISTINCT source) >= CASE WHEN len(regexp_extract_all(k, '[\x20\x09-\x0D]+')) >= 50 THEN {LONG_SITES} ELSE 10 END),
        marked AS (SELECT occ.*, wide.k IS NOT NULL AND first <> {{'d': doc_id, 'p': p}} AS gone FROM occ LEFT JOIN wide USING (k))
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text,
               count(*) FILTER (WHERE k <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
        FROM marked GROUP BY doc_id
    """,
    "op3_decontamination": rf"""
        WITH items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        item_at AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM item_at),
        doc_at AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
        hits AS (SELECT doc_id, item_id, p, d.n FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM doc_at) d JOIN windows USING (n, s)),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}


def _rule_sql() -> str:
    bounds = []
    for r in quality_rules.RULES:
        bounds += [f"{r.measure} >= {r.least}"] * (r.least is not None) + [f"{r.measure} <= {r.most}"] * (r.most is not None)
    share = "coalesce({} / nullif(CAST({} AS DOUBLE), 0), 0)"
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: {_NO_SPACE.format("y")} <> '') AS y FROM documents),
        pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM t),
        win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 7], ' ')) AS n FROM pos),
        rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM win WHERE n > 1) GROUP BY doc_id),
        c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length({_NO_SPACE.format("x")}) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     CAST(len(y) - len(list_distinct(y)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(y) AS n_lines,
                     length(x) - length(regexp_replace(x, '\p{{Lu}}', '', 'g')) AS n_upper, len(list_filter(y, lambda l: contains(l, ' | '))) AS n_bar_lines,
                     len(list_filter(w, lambda z: list_contains([{", ".join(f"'{w}', '{w.capitalize()}'" for w in quality_rules.STOP_WORDS)}], z))) AS n_stop,
                     length(x) - length(regexp_replace(x, '[A-Za-z]', '', 'g')) AS n_latin
              FROM t LEFT JOIN rep USING (doc_id)),
        m AS (SELECT *, {share.format("word_chars", "n_words")} AS mean_word_chars, {share.format("n_symbols", "n_words")} AS symbols_per_word,
                     {share.format("n_upper", "word_chars")} AS upper_share, {share.format("n_dup_lines", "n_lines")} AS dup_line_share,
                     {share.format("n_bar_lines", "n_lines")} AS bar_line_share, CASE WHEN 2 * n_latin < word_chars THEN 1 ELSE {share.format("n_stop", "n_words")} END AS stop_word_share,
                     n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM m
    """


ORACLE_SQL["op8_jaccard_join"] = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
    SELECT reach.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY reach.doc_id
"""
ORACLE_SQL["op7_quality_rules"] = _rule_sql()


# CRC-32 byte by byte, from a table that the recursion makes of its polynomial; each distinct word is hashed once.
ORACLE_SQL["op11_importance_resampling"] = rf"""
    WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM step WHERE k < 8),
    tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
    docs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
    items AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS UBIGINT)) AS b FROM (SELECT w FROM docs UNION SELECT w FROM items)),
    hashed AS MATERIALIZED (SELECT w, xor(list_reduce(b, lambda a, x: xor(a >> 8, tab[CAST(xor(a, x) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket FROM bytes, tab),
    s AS (SELECT bucket, count(*) AS s FROM docs JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM items JOIN hashed USING (w) GROUP BY bucket),
    total AS (SELECT (SELECT count(*) FROM docs) AS s_all, (SELECT count(*) FROM items) AS t_all),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), total),
    weighed AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM docs JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
    every AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) AS h FROM documents LEFT JOIN weighed USING (doc_id)),
    scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM every),
    ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""

ORACLE_SQL["op12_exact_dedup"] = f"""
    WITH hashed AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS x FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM hashed
"""


def _lloyd_sql(clusters: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    parts = [
        f"x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: isfinite(c))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM x QUALIFY c < {clusters})",
    ]
    for k in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(x.v, o.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{k} AS MATERIALIZED (SELECT vec_id, x.v, o.c, CAST({apart} AS BIGINT) AS d FROM x, c{k} o QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, o.c) = 1)")
        if k < rounds:
            means = f"SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, CAST((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT c, unnest(range(1, {dims + 1})) AS i, unnest(v) AS y FROM a{k}) GROUP BY c, i) GROUP BY c"
            parts.append(f"m{k} AS ({means}), c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{k} o LEFT JOIN m{k} m ON m.c = o.c)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(o.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} o ON o.c = a.c"""


ORACLE_SQL["op13_centroid_clustering"] = _lloyd_sql()
