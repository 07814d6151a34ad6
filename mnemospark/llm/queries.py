"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import cooccur, groups, mixing, neighbours, residue, tokens
from mnemospark.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tags carried together by 8 anchors and three times as often as chance, or more."""
    return cooccur.associated_tags(table(spark, folder, "anchors")).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of tags with its counts, lift over chance and log-likelihood ratio."""
    pairs = cooccur.pair_counts(cooccur.baskets(table(spark, folder, "anchors")))
    return pairs.select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round(F.col("lift") + 1e-9, 6).alias("lift"), F.round(F.col("llr") + 1e-9, 4).alias("llr")
    )


def p1_significant(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tags carried together more often than chance explains, at a level of 0.001."""
    return cooccur.significant(cooccur.pair_counts(cooccur.baskets(table(spark, folder, "anchors")))).select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", F.round(F.col("llr") + 1e-9, 4).alias("llr")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of anchors of a cosine of 0.9 or more, one among the 10 nearest of the other."""
    return neighbours.near_pairs(table(spark, folder, "anchors"))


def p2_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest anchors of every anchor, each found with a probability of 0.95 or more."""
    return neighbours.nearest(table(spark, folder, "anchors"), confidence=0.95)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every anchor id that is matched to another."""
    return groups.duplicate_groups(table(spark, folder, "edges"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return tokens.encoded(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a mixture to the target shares, in its order."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The target share and the share really reached of every source."""
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, folder, "documents"), targets), targets)


def p7_shares_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of the largest mixture in which no source that has documents runs out."""
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, folder, "documents"), targets, "exact"), targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with unfilled slots, or of filler, errors or script notices in place of content."""
    return residue.judged(table(spark, folder, "documents")).select("doc_id")


def p8_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The excluded documents with the reason."""
    return residue.judged(table(spark, folder, "documents"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without the excluded ones."""
    return residue.kept(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p1_significant, p2_found, p2_knn, p4_found, p6_ids, p7_mix, p7_shares, p7_shares_exact, p8_found, p8_reasons, p8_kept)}
