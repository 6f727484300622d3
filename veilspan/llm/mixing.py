"""Mixtures of sources by weight, measured in tokens.

A mix wants weight * (tokens of all documents with a known source) from each of its sources.  A
source is used in whole epochs first; the last, partial epoch is cut in hash-random order where the
running sum of tokens reaches the budget.  The order is the same for all mixes, so the prefix sums
are made once: documents are range-partitioned within their source by the leading bits of the
random key, bucket sums give each bucket its offset, and only rows of one bucket are sorted
together.  There is a bucket per PER_BUCKET rows, so none grows with the corpus and a source that
holds a third of all rows is spread over as many tasks.

Defined results: null or empty texts have 0 tokens and take part; null or blank sources are unknown
and count nowhere; sources compare without case and blanks; a mix row of a source without documents
gets nothing and is short if it wants anything; null weights and repeats count as 0, and a source
with 0 repeats is not used; no document is used more often than max_repeats says; mix rows
repeated for a mix and source (as spelled) count once; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fold_name, spread
from .tokens import VOCABULARY, token_count

PER_BUCKET = 50_000  # rows that are sorted together
MOST_TARGETS = 10_000
_KNOWN = "__known"


def source_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source folded, tokens) of the documents with a known source."""
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), fold_name(F.col("source")).alias("source"), "text",
    ).filter("source IS NOT NULL")
    return spread(rows).select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens"))


def allocations(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: what it wants and what it can have, in tokens."""
    per_source = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    t = targets.select(
        "mix_id",
        F.col("source").alias("target_source"),
        fold_name(F.col("source")).alias("source"),
        F.coalesce(F.col("target_weight"), F.lit(0.0)).alias("target_weight"),
        F.coalesce(F.col("max_repeats"), F.lit(0)).alias("max_repeats"),
    )
    t = t.groupBy("mix_id", "target_source", "source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    total = sizes.agg(F.sum("tokens").alias("n")).first()["n"] or 0  # one number, from the written sizes
    a = t.join(per_source, "source", "left").withColumn("all_tokens", F.lit(int(total)).cast("bigint"))
    a = a.fillna({"source_tokens": 0, "source_docs": 0})
    a = a.withColumn("wanted", F.col("target_weight") * F.col("all_tokens")).withColumn(
        "cap", (F.col("max_repeats") * F.col("source_tokens")).cast("double"),
    )
    a = a.withColumn("budget", F.least("wanted", "cap"))
    epochs = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(0)
    return a.withColumn("epochs", epochs.cast("bigint")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens"))


def prefix_sums(sizes: DataFrame, seed: int = 29, per_bucket: int = PER_BUCKET) -> DataFrame:
    """sizes with ``upto``: tokens of the source up to and with this document, in random order."""
    bits = max(8, (sizes.count() // per_bucket).bit_length())
    keyed = sizes.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("__b", F.shiftrightunsigned("__h", 64 - bits))
    sums = keyed.groupBy("source", "__b").agg(F.sum("tokens").alias("__t"))
    w = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("source", "__b", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__before"))
    # the low bits order a bucket: its rows share the high ones
    inside = Window.partitionBy("source", "__b").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.withColumn("__in", F.sum("tokens").over(inside))
    return run.join(offset.hint("merge"), ["source", "__b"]).select("doc_id", "source", "tokens", (F.col("__before") + F.col("__in")).alias("upto"))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast where the table was counted to be small, else an ordinary join side."""
    return F.broadcast(df) if df.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS else df


def mix_from_sizes(sizes: DataFrame, targets: DataFrame, seed: int = 29) -> DataFrame:
    """(mix_id, target_source, doc_id, tokens, copies): how often each document is used."""
    a = cut(allocations(sizes, targets)).select("mix_id", "target_source", "source", "epochs", "rest", "max_repeats")
    rows = prefix_sums(sizes, seed).join(_small(a), "source")
    last = (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))
    copies = F.least(F.col("epochs") + last.cast("int"), F.col("max_repeats").cast("bigint"))
    return rows.select("mix_id", "target_source", "doc_id", "tokens", copies.alias("copies")).filter("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return mix_from_sizes(cut(source_sizes(documents, vocabulary)), targets)


def mix_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and actual shares of each mix and source, and whether it falls short."""
    used = mix_from_sizes(sizes, targets).groupBy("mix_id", "target_source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"),
    )
    a = allocations(sizes, targets).join(used, ["mix_id", "target_source"], "left").fillna({"tokens": 0, "most_copies": 0})
    # short: every document was used as often as allowed, and the wish is still open
    a = a.withColumn("short", (F.col("tokens") >= F.col("cap")) & (F.col("tokens") < F.col("wanted")))
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_id")), F.lit(0))
    return a.select(
        "mix_id",
        F.col("target_source").alias("source"),
        "target_weight",
        "wanted",
        "tokens",
        F.coalesce(share, F.lit(0.0)).alias("actual_share"),
        "most_copies",
        "short",
    )


def short_sources(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    return mix_report(sizes, targets).filter("short").select("mix_id", "source").distinct()
