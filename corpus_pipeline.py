"""From raw documents to shards: five stages, each over all its predecessor kept.

Every stage but the last returns the columns of documents. Decisions are
written before they are joined back; those that grow with the corpus are merged
by sorting at every size, those that follow the benchmark or the sources are
broadcast by Spark only while their files are under its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catlas.llm import decontam, mixing, ngram_join, quality_crf, sharding
from catlas.storage import clearing, last_made, materialize, remove

#: A document stays if its quality score is this or more.
LEAST_QUALITY = 0.3
SHARDS = 24


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct `row`, beside which no column of the table can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose lines' field scores them under LEAST_QUALITY; blank ones score 0."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out_fold=False)
    score = quality_crf.scorer(model)
    return unpacked(packed(docs).withColumn("score", score("row.text")).filter(F.col("score") >= LEAST_QUALITY), docs)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def same_row(right: str) -> Column:
    return F.col("row.doc_id").eqNullSafe(F.col(f"{right}.id")) & (digest(F.col("row.text")) == F.col(f"{right}.h"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document with the least id, once if its row is repeated.

    Of rows of one id and text that differ elsewhere, the one with the least digest stays.
    """
    kept = ngram_join.near_duplicates(docs).filter("first").groupBy("id", "h").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    kept = materialize(kept, "kept")
    joined = packed(docs).join(kept.hint("merge").alias("k"), same_row("k"))
    once = joined.filter(~F.col("k.repeated")).select("row")
    least = joined.filter("k.repeated").groupBy("k.id", "k.h").agg(F.min_by("row", F.md5(F.to_json("row").cast("binary"))).alias("row"))
    return unpacked(once.unionByName(least.select("row")), docs)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontam.decontaminate(docs, benchmark)
    leaks = materialize(found.filter("n_hit > 0").select("id", F.col("digest").alias("h")).distinct(), "leaks")
    return unpacked(packed(docs).join(leaks.alias("k"), same_row("k"), "left_anti"), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window of a benchmark item; null and empty texts have none and stay, as do all if either table is empty."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; repeated rows each count, null and empty texts weigh nothing and are taken with their place."""
    return mixing.apply(mixing.mix(docs), docs)


def put_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and slot for every row: doc_id, size, text_crc32, shard, slot; repeated rows each have a slot, null texts count as empty, no rows give none."""
    rows = sharding.shard(docs, leaves=SHARDS)
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", put_in_shards),
]

#: The field's scores and MinHash candidates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents`; what a stage wrote on its way goes once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        with clearing(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), "stage")
            kept.append(last_made())
        if before:
            remove(spark, before)
        before = last_made()
    return STAGES[-1][1](spark, docs, sf_dir)
