"""Grouped folds over label envelopes and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.intervals import ratio, share_band, wilson
from hearsay.views import SENTIMENTS, VERSION


def on_version(version: tuple[str, str, str] = VERSION, origin: str = "survey") -> Column:
    """Only survey envelopes of the exact version triple fold."""
    return (
        (F.col("origin") == origin)
        & (F.col("model_version") == version[0])
        & (F.col("prompt_version") == version[1])
        & (F.col("ontology_version") == version[2])
    )


def mint(envelopes: DataFrame, mentions: DataFrame, floor: int = 1) -> DataFrame:
    """Per app, slot and aspect: distinct reviews, sentiment counts, share of all envelopes, 95 % interval, band.

    Envelopes without mentions count in the denominator. A review that repeats an aspect counts once in
    n_reviews. Aspects under ``floor`` distinct reviews are left out. The mention side is pre-aggregated to
    one row per review and aspect before any exact distinct count, so a hot aspect needs no expand.
    """
    scope = envelopes.filter(on_version()).select("review_id", "app_id")
    sizes = scope.groupBy("app_id").agg(F.count("*").alias("sample_size"))
    sums = [F.sum((F.col("sentiment") == s).cast("long")).alias(f"n_{s}") for s in SENTIMENTS]
    per_review = mentions.join(scope, "review_id").groupBy("app_id", "slot", "aspect", "review_id").agg(*sums)
    folded = per_review.groupBy("app_id", "slot", "aspect").agg(
        F.count("*").alias("n_reviews"), *[F.sum(f"n_{s}").alias(f"n_{s}") for s in SENTIMENTS]
    )
    low, high = wilson(F.col("n_reviews"), F.col("sample_size"))
    share = ratio(F.col("n_reviews"), F.col("sample_size"))
    return (
        folded.filter(F.col("n_reviews") >= floor)
        .join(sizes, "app_id")
        .select("*", share.alias("share"), low.alias("share_low"), high.alias("share_high"), share_band(share).alias("band"))
    )
