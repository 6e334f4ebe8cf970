"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's ``approx_top_k``, a mergeable frequent-items sketch) names the digests
that may be frequent. Their true counts and winners are then computed; those that are frequent are
broadcast and decide their rows on the map side, without a shuffle. The digests that remain are
each rare, so an ordinary shuffle by digest has no hot key.

Texts are equal when identical after lower-casing A-Z. A null text counts as empty; empty texts are
equal to each other. Of equal texts the row with the largest id stays (a null id is smallest). Rows that
repeat both id and text are ties: exactly one of them stays. Texts are read whole, however long, but only their digests are grouped.
Other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import fresh, materialize, may_be_in

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.sha2(folded.cast("binary"), 256)


def heavy_digests(digests: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """Digest, size and kept row of each verified frequent digest: at most ``heavy`` rows.

    The summary has at most ``tracked`` counters, so it misses no digest with more than a
    1/tracked share of the rows; one that turns out to be rarer is left to the ordinary shuffle.
    """
    summary = digests.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top"))
    named = summary.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))
    least = max(2, digests.count() // tracked)
    return (
        digests.join(F.broadcast(named), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "tag")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 64, tracked: int = 4096) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            text_digest(F.col(text_col)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("tag"),
        ),
        "digests",
    )
    winners = materialize(heavy_digests(digests, heavy, tracked), "winners")
    hot = digests.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    cold = (
        digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("best", F.max(F.struct("doc_id", "tag")).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("best.tag")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns. Only texts that may have to go are shuffled."""
    groups = exact_groups(docs, id_col, text_col, **options)
    own_id, digest, key, flag, gone_id, gone_digest = (fresh(docs, x) for x in ("own_id", "digest", "row_key", "may_go", "gone_id", "gone_digest"))
    keys = materialize(groups.select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(digest), "kept"), "groups")
    found = keys.groupBy(own_id, digest).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = found.where("not kept or n > 1").withColumn(key, F.xxhash64(own_id, digest))  # of rows that repeat id and text one stays
    gone = materialize(gone.select(own_id, digest, key, "kept"), "gone")
    keyed = docs.withColumn(own_id, F.col(id_col)).withColumn(digest, text_digest(F.col(text_col))).withColumn(key, F.xxhash64(own_id, digest))
    keyed = may_be_in(keyed, key, gone, key, flag)
    dropped = gone.where("not kept").select(F.col(own_id).alias(gone_id), F.col(digest).alias(gone_digest))
    same = F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_digest))
    doubtful = keyed.where(flag).join(dropped, same, "left_anti").dropDuplicates([own_id, digest])
    return keyed.where(f"not {flag}").select(docs.columns).unionByName(doubtful.select(docs.columns))
