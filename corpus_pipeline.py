"""From documents to training shards: language, near copies, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, directory of the tables) and returns a frame; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's input. All but the last return the
columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivo.llm import decontaminate, langid, minhash, mixing, sharding
from nivo.llm.shared import Scratch, words

#: Texts of so many characters or more are rejected if their best language takes more bits a symbol than this;
#: a letter drawn blindly takes log2(64) = 6.
JUDGED_CHARS, MOST_BITS = 100, 6.0
SHARDS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that are in none of the languages: no letters at all, or nothing like the labelled ones."""
    sample = langid.learn(docs.where(langid.fold() > 0))
    found = langid.identify(docs, sample)
    strange = (F.length("text") >= JUDGED_CHARS) & (F.col("lang_bits") > MOST_BITS)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & ~strange)
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return minhash.deduplicate(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a ten-word window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture of sources takes it: not at all, once or twice."""
    mixed = mixing.mix(docs, F.size(words(F.col("text"))))
    times = F.explode(F.array_repeat(F.lit(1), F.col("taken").cast("int")))
    return mixed.where("taken > 0").select(*docs.columns, times.alias("_time")).drop("_time")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Language models and the order of a hash are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a directory through all stages."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
