"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents.

Defined results for odd input: null texts count as empty throughout.  A null
identifier is a value of its own.  Repeated rows fall to exact deduplication.
Columns beyond those of documents pass through the filters and the mix, and are
replaced where a stage adds a column of that name.  Empty tables give empty
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality_model
from prismlake.llm.storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality_model.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_model.score(docs.withColumn("__text", F.col("text")), weights, text="__text", drop=("__text",))
    return scored.filter("predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts: the one with the largest identifier."""
    name = lambda sha, i: F.concat_ws("/", sha, F.coalesce(i.cast("string"), F.lit("null")))
    own = exact_dedup.owners(docs).select(name(F.col("sha"), F.col("keep_id")).alias("__owner"))
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), 256)
    kept = docs.withColumn("__owner", name(sha, F.col("doc_id"))).join(own, "__owner")
    # Repeated rows of an owner share its name; the join has dealt and sorted by it already.
    return kept.dropDuplicates(["__owner"]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by 5-word shingle similarity: the smallest identifier."""
    return jaccard_join.firsts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and parts of documents that the mix takes, once for each time."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (binary, little-endian 32-bit); the text is decoded from the ids."""
    import public_tokenizers as P

    coded = byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, drop=("text",), decoded=True)
    return coded.withColumn("text", F.decode("decoded", "UTF-8")).select(*docs.columns, "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The classifier, the permutations and the token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
