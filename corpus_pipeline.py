"""From documents to training text: five stages, each written as Parquet and read again as the next one's documents.

run(spark, sf_dir) applies STAGES to the documents table. Every stage but the last returns the columns of documents; the last adds
what the tokeniser gives. Columns that a stage doesn't read go along in a struct, so their names can't clash with its own.

Odd rows, in every stage: a null text is an empty one, and what becomes of either is said at each stage; a null id is an id like
others; repeated rows are judged each, until the third stage leaves one of them; long texts are read whole; an empty table gives
an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontamination, jaccard_join, line_dedup, piece_codec, quality_model
from cairn.llm.common import delete, shared_dir, table
from cairn.llm.queries import LONG_SITES, tokenizer_file
from cairn.operators.common import top


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go.

    Empty and null texts are scored like others, all alike. Without labels of both classes nothing can be judged: every score is
    then 0.5, and every document goes. Each row is judged by its own text, also where ids are null or repeated.
    """
    labels = table(spark, sf_dir, "labels")
    scores = quality_model.quality_scores(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 == 2, passed=docs.columns)
    return scores.where("predicted = 1").select("__row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go but for their first occurrence; a document that loses every line it had goes with them.

    Null and empty texts have no lines and stay as they are. Of equal lines the first is that of the smallest id (a null id before
    all others), then text hash, then place. n_chars is that of the text that is left, 0 for a null one.
    """
    packed = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = line_dedup.dedup_lines(packed, long_sites=LONG_SITES).where("n_removed = 0 or n_removed < n_lines")
    own = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)}
    return left.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that of the smallest id (a null id is the last), then of the smallest text hash.

    Ids may be null or repeated, so rows are named by id and text hash together; of rows that share both one stays. A null id is
    thus an id like others: copies without an id go where any other copy is, and one stays where all lack an id. Texts without
    words are linked with nothing; of those, too, one of each id and text stays.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))
    kind = f"struct<none:boolean,id:{docs.schema['doc_id'].dataType.simpleString()},of:bigint>"
    named = docs.select(name.cast(kind).alias("name"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = jaccard_join.near_duplicates(named, id_col="name")
    kept = found.where("component_id = name").select("name").distinct()
    # With a limit in each task before the shuffle, so rows that are repeated very often don't gather in one.
    rest = [F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    first = top(named.select("name", "row"), 1, ["name"], *(rest or [F.lit(1)]))
    return first.join(kept, "name", "left_semi").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; those without words, and so null and empty texts, stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, ids_sha256 and decoded_sha256; columns of documents that have these names are replaced.

    A null or empty text has no ids (n_tokens 0) and decodes to the empty text.
    """
    digests = piece_codec.digests(docs, tokenizer_file("piece_bpe_32k.model"), passed=docs.columns)
    new = [c for c in digests.columns if c != "__row"]
    return digests.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns if c not in new), *new)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", pieces),
]

#: The classifier and the tokeniser can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Stages are written below spark.checkpoint.dir, which all executors share; each is deleted once the next is written."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            delete(spark, f"{place}/{k - 1}")
    return docs
