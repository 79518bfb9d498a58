"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, lower_ascii, packed, words

#: What separates words: ASCII that is neither a digit nor a letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows and bytes of a table that is broadcast; larger ones are taken in blocks of this size, a pass each.
BLOCK_ROWS, BLOCK_BYTES = 100_000, 64 << 20


def _blocks(table: DataFrame, size: Column) -> Iterator[DataFrame]:
    """The rows of a written table in broadcast blocks of a checked size; ``size``: about the bytes of a row.

    Rows are dealt by a hash of all their columns, so that no word or window fills a block by itself.
    """
    rows, bytes_ = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(-(-rows // BLOCK_ROWS), -(-bytes_ // BLOCK_BYTES))
    for part in range(parts):
        block = table if parts == 1 else table.where(F.pmod(F.xxhash64(*table.columns), F.lit(parts)) == part)
        yield F.broadcast(block)


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.union(frame)
    return whole


def windows(benchmark: DataFrame, size: int, text: str, item: str) -> DataFrame:
    """``item``, ``window`` (its words) and ``number`` (a digest of these), a row per window of an item."""
    tokens = words(lower_ascii(F.col(text)), SEPARATORS)
    long_enough = F.size("tokens") >= size
    slices = F.transform(
        F.sequence(F.lit(1), F.size("tokens") - size + 1), lambda i: F.slice("tokens", i, size)
    )
    return (
        benchmark.select(F.col(item).cast("string").alias("item"), tokens.alias("tokens"))
        .where(F.size("tokens") > 0)
        .select("item", F.explode(F.when(long_enough, slices).otherwise(F.array("tokens"))).alias("window"))
        .select("item", "window", F.md5(F.array_join("window", " ")).alias("number"))
        .distinct()
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item: str = "item_id",
) -> DataFrame:
    """The rows with ``n_words``, ``n_hit``, ``hit_items`` and ``contaminated``.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
    window. A document contains a window whole or not at all, so of a window's words, sorted by
    their frequency in all documents, the rarest alone is a necessary prefix. Documents' words
    are joined with these prefix words; a match fixes where the window would begin, and it must
    lie inside the document (length and position) and agree word for word. A word of the document
    inside any occurrence is hit. Windows are broadcast in blocks of a checked number of rows and
    bytes; the items that have a window are joined to what was found.

    NULL texts have no words; NULL items and items without words have no windows. NULL and
    repeated keys are no trouble: a row's result follows from its text. Items with NULL ids
    count as hits, but are not listed. An empty benchmark hits nothing, and empty documents give no
    rows. Input columns with the names of the results are replaced.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    item_windows = scratch.write(windows(benchmark, size, item_text, item), "windows")
    found_windows = item_windows.select("number", "window").distinct()
    own = docs.select(F.col(f"`{text}`").alias("body")).where("body IS NOT NULL")
    tokens = words(lower_ascii(F.col("body")), SEPARATORS)
    tokens_of = own.select(tokens.alias("tokens"), F.md5("body").alias("print"))

    vocabulary = scratch.write(found_windows.select(F.explode("window").alias("word")).distinct(), "words")
    corpus = tokens_of.select(F.explode("tokens").alias("word"))
    counted = [
        corpus.join(block, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        for block in _blocks(vocabulary, F.octet_length("word") + 32)
    ]
    body = F.col(f"`{text}`")
    base = docs.select(
        packed(docs, "n_words", "n_hit", "hit_items", "contaminated").alias("row"),
        F.size(words(lower_ascii(body), SEPARATORS)).cast("long").alias("n_words"),
        F.md5(body).alias("own_print"),
    )
    if not counted:
        return base.select(
            "row.*",
            "n_words",
            F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("hit_items"),
            F.lit(False).alias("contaminated"),
        )
    frequency = scratch.write(_union(counted), "frequency")
    placed = found_windows.select("number", "window", F.posexplode("window").alias("place", "word"))
    rarest = (
        placed.join(frequency, "word")
        .groupBy("number", "window")
        .agg(
            F.min(F.struct("n", "place", "word")).alias("prefix"),
            F.count(F.lit(1)).alias("known"),
        )
        .where(F.col("known") == F.size("window"))  # A word that no document has rules the window out.
        .select("number", "window", F.col("prefix.word").alias("word"), F.col("prefix.place").alias("place"))
    )
    prefixes = scratch.write(rarest, "prefixes")
    row_bytes = F.octet_length(F.array_join("window", " ")) + 24 * F.size("window") + 128
    seen = tokens_of.select("print", "tokens", F.posexplode("tokens").alias("at", "word"))
    begin = F.col("at") - F.col("place")
    matches = [
        seen.join(block, "word")
        .where(begin >= 0)
        .where(begin + F.size("window") <= F.size("tokens"))
        .where(F.slice("tokens", F.greatest(begin, F.lit(0)) + 1, F.size("window")) == F.col("window"))
        .select("print", begin.alias("begin"), F.size("window").alias("length"), "number")
        for block in _blocks(prefixes, row_bytes)
    ]
    if not matches:
        at = F.col("at")
        matches = [seen.limit(0).select("print", at.alias("begin"), at.alias("length"), F.col("word").alias("number"))]
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda done, span: F.struct(
            F.greatest(done["end"], span["begin"] + span["length"]).alias("end"),
            (
                done["hit"]
                + F.greatest(
                    F.lit(0),
                    span["begin"] + span["length"] - F.greatest(done["end"], span["begin"]),
                )
            ).alias("hit"),
        ),
    )["hit"]
    # Equal texts have equal matches, so sets keep one of each: a text's length bounds its group.
    matched = scratch.write(
        _union(matches)
        .groupBy("print")
        .agg(F.collect_set(F.struct("begin", "length")).alias("spans"), F.collect_set("number").alias("numbers"))
        .select("print", covered.cast("long").alias("n_hit"), "numbers"),
        "matched",
    )
    listed = (
        matched.select("print", F.explode("numbers").alias("number"))
        .join(item_windows.select("number", "item"), "number")
        .groupBy("print")
        .agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    )
    hits = scratch.write(matched.select("print", "n_hit").join(listed, "print"), "hits")
    scratch.drop("windows", "words", "frequency", "prefixes", "matched")
    joined = base.join(hits, F.col("own_print") == F.col("print"), "left")
    return joined.select(
        "row.*",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
