"""The corpus pipeline: quality, near duplicates, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents, with whatever further columns the table has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratawise.llm import common, lsh_forest, pareto_mix, prefix_bpe, rule_quality, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the rule ensemble scores at least one half."""
    model = rule_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_quality.score_quality(docs, model).where("__predicted = 1").drop("__score", "__predicted")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class: the one of least id (null last), then of least row key.

    Classes are those of texts, so rows without an id have classes too and another text of a
    repeated id is judged by itself.  Of rows equal in id and text the one of least hash over
    all columns stays.  Rows without words all stay.
    """
    sets, named = lsh_forest.set_classes(docs)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "dk")).alias("least")
    kept = sets.where("n > 0").join(named.select("s1", "s2", "root"), ["s1", "s2"]).groupBy("root").agg(least).select("least.dk")
    rows = sets.where("n > 0").groupBy("dk").agg(F.count("*").alias("rows"))
    kept = common.checkpointed(sets.where("n = 0").select("dk").distinct().withColumn("rows", F.lit(1)).unionByName(kept.join(rows, "dk")))
    key, nth = f"key_{uuid.uuid4().hex}", f"nth_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, lsh_forest.row_key(F.col("doc_id"), F.col("text")))
    single = keyed.join(kept.where("rows = 1").select(F.col("dk").alias(key)), key, "left_semi")
    repeated = keyed.join(kept.where("rows > 1").select(F.col("dk").alias(key)), key, "left_semi")
    hashed = F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in docs.dtypes])
    repeated = repeated.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(hashed))).where(F.col(nth) == 1)
    return single.select(*docs.columns).unionByName(repeated.select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts."""
    return secret_scan.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights."""
    mixed = pareto_mix.mix(docs).where("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digests of the ids and of what they decode to."""
    return prefix_bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, remembered=80_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: No stage but the secret scan could be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.scratch(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
