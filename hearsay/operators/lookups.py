"""Lookups and joins of stored reviews, envelopes, runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import text as tx


def without(rows: DataFrame, column: str, ids: list) -> DataFrame:
    """Rows whose value is none of a few excluded ones, sorted so that equal lists make equal plans."""
    return rows.filter(~F.col(column).isin(*sorted(ids))) if ids else rows


def served_usable(language: Column, text: Column) -> Column:
    """What serving counts as usable: English and not blank. The corpus scan's test is stricter."""
    return (language == "english") & F.coalesce(tx.strip(text) != "", F.lit(False))


def looked_up(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Rows of the asked keys; keys without a row are left out."""
    return rows.join(asked.select(key).distinct(), key, "left_semi")


def all_or_none(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Rows of the asked keys, or an error at the first key without one."""
    keys = asked.select(key).distinct()
    got = keys.join(rows.withColumn("_here", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit("not stored: "), F.col(key).cast("string"))).cast("boolean")
    return got.withColumn("_here", F.coalesce("_here", lost)).filter("_here").drop("_here")


def with_runs(envelopes: DataFrame, mentions: DataFrame, runs: DataFrame) -> DataFrame:
    """Envelopes with their run, a small dimension, and their mentions in order; an envelope may have none."""
    listed = mentions.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("position", "aspect", "sentiment"))).alias("mentions"))
    out = envelopes.join(runs, "run_id").join(listed, "review_id", "left")
    return out.withColumn("mentions", F.coalesce("mentions", F.array().cast(listed.schema["mentions"].dataType)))


def latest_reports(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """The newest report of each app with its run's version."""
    rows = reports.join(runs, "run_id")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("created_at"), F.desc("run_id")))).filter("rn = 1").drop("rn")


def mentions_per_envelope(envelopes: DataFrame, mentions: DataFrame) -> DataFrame:
    """How many envelopes have how many mentions, none included."""
    n = mentions.groupBy("review_id").agg(F.count("*").alias("n"))
    return envelopes.join(n, "review_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_mentions")).agg(F.count("*").alias("envelopes"))


def backfilled(gold: DataFrame, stored: DataFrame, corpus: DataFrame) -> DataFrame:
    """Gold reviews that the store lacks, fetched from the corpus; in_corpus tells those that are nowhere."""
    owed = gold.select("review_id").join(stored.select("review_id"), "review_id", "left_anti")
    return owed.join(corpus.withColumn("in_corpus", F.lit(True)), "review_id", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))


def since(rows: DataFrame, moment: Column, time: str = "created_at") -> DataFrame:
    """Number, visitors and cost of what came since a moment; nothing costs 0."""
    return rows.filter(F.col(time) >= moment).agg(F.count("*").alias("n"), F.count_distinct("visitor").alias("visitors"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def window_place(created: Column, start: Column, end: Column) -> Column:
    """Where a review lies of a walk's window, both ends of which belong to it."""
    return F.when(created > end, "above").when(created < start, "below").otherwise("in")


def paths_taken(walks: DataFrame) -> DataFrame:
    """Per app how its windows were fetched: primary, fallback, skipped. The primary path counts unless strangers refute it,
    the fallback unless it fails as well."""
    path = F.when(F.col("primary_strangers") == 0, "primary").when(F.col("fallback_ok"), "fallback").otherwise("skipped")
    return walks.groupBy("app_id").agg(*[F.count_if(path == p).alias(p) for p in ("primary", "fallback", "skipped")])


def page_cost(claims: Column, per_page: int = 100) -> Column:
    return F.ceil(claims / per_page).cast("long")


def skip_pages(buckets: DataFrame, end: Column, days: int, per_page: int = 100) -> DataFrame:
    """Per app the pages that a newest-first walk passes before a window's end: of all buckets that may hold newer reviews."""
    newer = F.col("start") + F.make_dt_interval(F.lit(days)) > end
    claims = F.coalesce(F.sum(F.when(newer, F.col("up") + F.col("down"))), F.lit(0))
    return buckets.groupBy("app_id").agg(page_cost(claims, per_page).alias("pages"))


def reservation(prompt: Column, most_output: Column, input_rate: Column, output_rate: Column) -> Column:
    """The most a call can cost, in millionths: three characters a token, and all the output that is allowed."""
    return F.ceil(F.length(prompt) / 3) * input_rate + most_output * output_rate


def decorated(hits: DataFrame, published: DataFrame) -> DataFrame:
    """Hits with whether their app has a report."""
    there = published.select("app_id").distinct().withColumn("_there", F.lit(True))
    return hits.join(there, "app_id", "left").withColumn("published", F.coalesce("_there", F.lit(False))).drop("_there")


def window_populations(windows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Windows with the population of the bucket that starts where they do; a window without one is an error."""
    b = buckets.select("app_id", "start", (F.col("up") + F.col("down")).cast("long").alias("population"))
    lost = F.raise_error(F.concat_ws(" ", F.lit("no bucket starts at"), F.col("start").cast("string"))).cast("long")
    return windows.join(b, ["app_id", "start"], "left").withColumn("population", F.coalesce("population", lost))


def merged_candidates(aggregates: DataFrame) -> DataFrame:
    """Candidate aggregates under their spaced names, added up: app_id, aspect, n_reviews, of (how many were merged). Only names
    whose reviews are disjoint may be merged so; see ``display.rename_plan``."""
    name = F.replace("aspect", F.lit("_"), F.lit(" "))
    return aggregates.groupBy("app_id", name.alias("aspect")).agg(F.sum("n_reviews").alias("n_reviews"), F.count("*").alias("of"))
