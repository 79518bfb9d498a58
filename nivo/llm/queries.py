"""The registered queries of this subpackage: name -> function of (session, directory of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivo.llm import (
    decontaminate,
    exact,
    langid,
    licences,
    minhash,
    mixing,
    passages,
    resampling,
    sharding,
    tokens,
    topk,
    warc,
    whitening,
)
from nivo.llm.shared import Scratch, words
from nivo.llm.vectors import scaled, usable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = 40
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@_register
def op1_near_dedup(spark, directory):
    """Documents linked by a similarity of 85 % of their 3-word shingles."""
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, width=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@_register
def op2_licence_scan(spark, directory):
    """Licence families named in every document, by a classifier of paragraphs."""
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    return licences.per_document(docs, licences.train(docs))


@_register
def op3_repeated_passages(spark, directory):
    """Passages of 50 words or more that documents share."""
    return passages.repeated_passages(_table(spark, directory, "documents").select("doc_id", "text"))


@_register
def op4_decontamination(spark, directory):
    """Documents against all 10-word windows of the benchmark items."""
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, _table(spark, directory, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@_register
def op5_sharding(spark, directory):
    """All documents in 40 shards by proportional interleaving of sources; counts differ by one at most."""
    docs = _table(spark, directory, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    return sharding.shard(docs, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_register
def op6_exact_dedup(spark, directory):
    """Groups of identical texts; the largest doc_id of each stays."""
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    return exact.exact(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_register
def op7_language_id(spark, directory):
    """Language of every document; a fifth of the labelled ones is held out."""
    docs = _table(spark, directory, "documents").select("doc_id", "text", "lang")
    sample = langid.learn(docs.where(langid.fold() > 0))
    found = langid.identify(docs.select("doc_id", "text"), sample)
    return found.select(
        "doc_id",
        (langid.fold() == 0).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


@_register
def op8_warc(spark, directory):
    """Pages written as WARC archives and read back by byte ranges."""
    scratch = Scratch(spark, "warc")
    files = warc.write(_table(spark, directory, "pages"), scratch)
    return warc.resolve(warc.read(files))


@_register
def op9_mixing(spark, directory):
    """Sources mixed by weights 5, 2, 1 to 150 % of all words, a document twice at most."""
    docs = _table(spark, directory, "documents").select(
        "doc_id", "source", F.size(words(F.col("text"))).alias("n_words")
    )
    mixed = mixing.mix(docs, F.col("n_words"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken")).alias("taken")
    )


@_register
def op10_token_counts(spark, directory):
    """Greedy word-piece counts of all documents with a public vocabulary."""
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, VOCABULARY).select("doc_id", "n_bytes", "n_words", "n_tokens")


@_register
def op11_exact_topk(spark, directory):
    """The ten largest integer inner products of every hundredth embedding with all others."""
    vectors = _table(spark, directory, "embeddings").where(usable(F.col("embedding")))
    whole = vectors.select("vec_id", scaled(F.col("embedding")).alias("vector"))
    return topk.search(whole, F.col("vec_id") % 100 == 0)


@_register
def op12_importance_resampling(spark, directory):
    """A tenth of the documents of 20 words or more, drawn towards the word distribution of the benchmark."""
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    found = resampling.resample(docs, _table(spark, directory, "benchmark"), carry=("doc_id",))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@_register
def op13_embedding_whitening(spark, directory):
    """Every embedding on the eight strongest whitening directions of all of them."""
    vectors = _table(spark, directory, "embeddings").select("vec_id", "embedding")
    fits = whitening.fit(vectors)
    white = whitening.whiten(vectors, fits)
    errors = whitening.identity_errors(white)
    of_length = F.create_map(*[F.lit(x) for pair in errors.items() for x in pair] or [F.lit(0), F.lit(0.0)])
    axes = F.posexplode(F.arrays_zip("whitened", "explained")).alias("axis", "found")
    rows = white.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "embedding", axes)
    return rows.select(
        "vec_id",
        (F.col("axis") + 1).alias("component"),
        "n",
        "deviation",
        "found.whitened",
        "found.explained",
        F.try_element_at(of_length, F.size("embedding")).alias("identity_error"),
    )
