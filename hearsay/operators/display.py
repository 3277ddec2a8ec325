"""What a report shows: facts and quotations that are chosen, rows that are folded, timelines, health of a census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import dates, geometry
from hearsay.functions.intervals import ratio

#: Fixed values, in the order that breaks ties of the loudest sentiment.
LOUDEST = ("positive", "negative", "mixed", "neutral")


def dominant(counts: dict[str, Column]) -> Column:
    """The sentiment of the highest count; ties go to the first in order."""
    top = F.greatest(*(counts[s] for s in LOUDEST))
    out = F.lit(None).cast("string")
    for s in reversed(LOUDEST):
        out = F.when(counts[s] == top, s).otherwise(out)
    return out


def facts(aggregates: DataFrame, floor: int) -> DataFrame:
    """Pinned aspects of at least ``floor`` reviews, by support, then name: with place, share in percent, loudest sentiment."""
    order = Window.partitionBy("app_id").orderBy(F.desc("n_reviews"), "aspect")
    own = aggregates.filter((F.col("slot") == "pinned") & (F.col("n_reviews") >= floor))
    return own.select("app_id", "aspect", "n_reviews", "sample_size", (ratio(F.col("n_reviews"), F.col("sample_size")) * 100).alias("share_pct"), *[f"n_{s}" for s in LOUDEST],
                      dominant({s: F.col(f"n_{s}") for s in LOUDEST}).alias("dominant"), F.row_number().over(order).alias("place"))


def themes(aggregates: DataFrame, floor: int, most: int = 5) -> DataFrame:
    """Names, without numbers, of the candidates with most support."""
    order = Window.partitionBy("app_id").orderBy(F.desc("n_reviews"), "aspect")
    own = aggregates.filter((F.col("slot") == "candidate") & (F.col("n_reviews") >= floor)).withColumn("place", F.row_number().over(order))
    return own.filter(F.col("place") <= most).select("app_id", "place", "aspect")


def chosen_quotes(evidence: DataFrame, loudest: DataFrame, most: int = 2, shortest: int = 25, longest: int = 240) -> DataFrame:
    """Up to ``most`` quotations of a readable length for each aspect: of its dominant sentiment first, then by review."""
    rows = evidence.filter(F.length("text").between(shortest, longest)).join(loudest.select("app_id", "aspect", "dominant"), ["app_id", "aspect"])
    order = Window.partitionBy("app_id", "aspect").orderBy((F.col("sentiment") != F.col("dominant")), "review_id", "text")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("app_id", "aspect", "place", "review_id", "sentiment", "text")


def shown_quotes(evidence: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` quotations an aspect in the order of arrival, those of the pool's own majority first; of equal
    majorities the one that was seen first. evidence has arrival, a number that is different for every row of an aspect."""
    tally = evidence.groupBy("app_id", "aspect", "sentiment").agg(F.count("*").alias("n"), F.min("arrival").alias("first"))
    top = tally.groupBy("app_id", "aspect").agg(F.max_by("sentiment", F.struct("n", -F.col("first"))).alias("majority"))
    order = Window.partitionBy("app_id", "aspect").orderBy(F.col("sentiment") != F.col("majority"), "arrival")
    return evidence.join(top, ["app_id", "aspect"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def folded_tail(rows: DataFrame, visible: int = 10) -> DataFrame:
    """The first rows of each app and one that stands for the rest: app_id, place, aspect (null for the rest), n_reviews."""
    kept = F.when(F.col("place") <= visible, F.col("place"))
    out = rows.withColumn("shown", kept).groupBy("app_id", "shown").agg(F.min(F.when(kept.isNotNull(), F.col("aspect"))).alias("aspect"), F.count("*").alias("n_aspects"), F.sum("n_reviews").alias("n_reviews"))
    return out.withColumnRenamed("shown", "place")


def fact_sheet(chosen: DataFrame, names: DataFrame) -> DataFrame:
    """app_id, sheet: the lines a composer may state, and the names of themes."""
    number = lambda c: F.format_number(F.col(c), 0)
    line = F.format_string("- %s: %s reviews (%.1f%%) — positive %s, negative %s, mixed %s, neutral %s", "aspect", number("n_reviews"), "share_pct", *(number(f"n_{s}") for s in LOUDEST))
    lines = chosen.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"), F.first("sample_size").alias("size"))
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    own = names.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("place", "aspect"))).alias("t"))
    tail = F.when(F.col("t").isNotNull(), F.concat(F.lit("\nRecurring themes (name only): "), F.array_join(F.transform("t", lambda x: x["aspect"]), ", "))).otherwise("")
    return lines.join(own, "app_id", "left").select("app_id", F.concat(F.lit("Sample: "), F.format_number("size", 0), F.lit(" reviews\n"), joined, tail).alias("sheet"))


def corrective_prompt(spans: DataFrame, key: str) -> DataFrame:
    """key, prompt: what a second draft must put right, one line for each violation, in the order of the text."""
    line = F.concat(F.lit("- "), F.col("span"), F.lit(": "), F.col("reason"))
    rows = spans.filter("reason IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", line.alias("line")))).alias("all"))
    return rows.select(key, F.concat(F.lit("Rewrite without these:\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("prompt"))


def codebook(vocabulary: DataFrame) -> DataFrame:
    """One text: entries (place, category, label, definition) under their categories in the order of first appearance."""
    entry = F.concat(F.lit("### "), F.col("label"), F.lit("\nDefinition: "), F.col("definition"))
    groups = vocabulary.groupBy("category").agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))).alias("es"))
    part = F.concat(F.lit("## "), F.col("category"), F.lit("\n\n"), F.array_join(F.transform("es", lambda x: x["e"]), "\n\n"))
    return groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("codebook"))


def timeline(buckets: DataFrame, periods: DataFrame, few: int, width: float = 600.0) -> DataFrame:
    """Populated buckets with their label, share, geometry, notes and run: consecutive buckets of at least ``few`` reviews are a
    line (the same run), a single one and those of fewer are dots; empty buckets part lines.

    A bucket is marked if it overlaps a flagged period of its app; periods are few, so the range is tested app by app.
    """
    order = Window.partitionBy("app_id").orderBy("start")
    every = Window.partitionBy("app_id")
    total = (F.col("up") + F.col("down")).cast("long")
    rows = buckets.withColumn("total", total).withColumn("end", F.add_months("start", 1).cast("timestamp_ntz")).withColumn("place", F.row_number().over(order))
    healthy = F.col("total") >= few
    rows = rows.withColumn("breaks", F.sum(F.when(~healthy, 1).otherwise(0)).over(order))
    p = periods.select(F.col("app_id").alias("_app"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    marked = rows.join(p, (F.col("app_id") == F.col("_app")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")), "left_semi").select("app_id", "start").withColumn("marked", F.lit(True))
    rows = rows.withColumn("first", F.min("start").over(every)).withColumn("last", F.max("start").over(every)).withColumn("peak", F.max("total").over(every))
    rows = rows.join(marked, ["app_id", "start"], "left").withColumn("marked", F.coalesce("marked", F.lit(False))).filter("total > 0")
    run = Window.partitionBy("app_id", "breaks", "total_ok")
    rows = rows.withColumn("total_ok", healthy).withColumn("of_run", F.count("*").over(run))
    kind = F.when(~F.col("total_ok"), "faded dot").when(F.col("of_run") == 1, "dot").otherwise("line")
    note = F.concat_ws(" · ", F.when(~F.col("total_ok"), "small sample"), F.when(F.col("marked"), "marked period"))
    return rows.select(
        "app_id", "start", dates.period_label(F.col("start"), "month").alias("period"), "total", ratio(F.col("up"), F.col("total")).alias("share"), kind.alias("kind"), note.alias("note"),
        geometry.along(F.col("start"), F.col("first"), F.col("last"), width).alias("x"), (F.col("total") / F.col("peak")).alias("height"), geometry.volume_step(F.col("peak")).alias("step"),
    )


def census_health(envelopes: DataFrame, mentions: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Per app: envelopes, reviews with any mention, mentions, with evidence, candidates, and the aspect with most mentions."""
    scope = envelopes.select("review_id", "app_id")
    sizes = scope.groupBy("app_id").agg(F.count("*").alias("envelopes"))
    per = mentions.join(scope, "review_id").groupBy("app_id", "review_id").agg(F.count("*").alias("n"), F.count("evidence").alias("e"), F.count_if(F.col("slot") == "candidate").alias("c"))
    per = per.groupBy("app_id").agg(F.count("*").alias("reviews_with_any"), F.sum("n").alias("mentions"), F.sum("e").alias("with_evidence"), F.sum("c").alias("candidates"))
    total = sum((F.col(f"n_{s}") for s in LOUDEST), F.lit(0))
    order = Window.partitionBy("app_id").orderBy(F.desc("total"), "aspect", "slot")
    top = aggregates.withColumn("total", total).withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("app_id", F.col("aspect").alias("top_aspect"), F.col("total").cast("long").alias("top_mentions"))
    return sizes.join(per, "app_id", "left").join(top, "app_id", "left").na.fill(0, ["reviews_with_any", "mentions", "with_evidence", "candidates"])


def supply(reviews: DataFrame, targets: list[int]) -> DataFrame:
    """Per target: what could be drawn if every app gave up to so many, and how many apps fall short."""
    own = reviews.groupBy("app_id").agg(F.count_if(F.col("language") == "english").alias("n"))
    each = own.select("n", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    return each.groupBy("target").agg(F.sum(F.least("n", "target")).alias("drawn"), F.count_if(F.col("n") < F.col("target")).alias("short"), F.count("*").alias("apps"))


def exclusive_quartiles(values: Column) -> Column:
    """The three cuts into quarters by ranks i (n + 1) / 4, values between two ranks in proportion. values: a sorted array."""
    n = F.size(values)

    def cut(i: int) -> Column:
        at = F.greatest(F.lit(1), F.least(n - 1, F.floor(i * (n + 1) / 4.0).cast("int")))
        rest = i * (n + 1) - at * 4
        return (F.get(values, at - 1) * (4 - rest) + F.get(values, at) * rest) / 4.0

    return F.when(n >= 2, F.array(cut(1), cut(2), cut(3)))


def clearance(counts: DataFrame, probed: DataFrame, slices: list[int], floor: float) -> DataFrame:
    """Per slice: how many aspects of an app would have at least ``floor`` mentions in a slice of so many reviews, projected from
    those that were probed: least, quartiles and most over apps. counts: app_id, aspect, n; probed: app_id, probed."""
    each = counts.join(probed, "app_id").select("app_id", "n", "probed", F.explode(F.array(*map(F.lit, slices))).alias("slice"))
    per = each.groupBy("slice", "app_id").agg(F.count_if(F.col("n") / F.col("probed") * F.least("slice", "probed") >= floor).alias("cleared"), F.first("probed").alias("probed"))
    got = per.groupBy("slice").agg(F.array_sort(F.collect_list("cleared")).alias("v"), F.count_if(F.col("slice") >= F.col("probed")).alias("whole"))  # one value an app
    q = exclusive_quartiles(F.col("v"))
    return got.select("slice", F.get("v", 0).alias("least"), F.get(q, 0).alias("p25"), F.get(q, 1).alias("median"), F.get(q, 2).alias("p75"), F.element_at("v", -1).alias("most"), "whole")


def coverage_curve(counts: DataFrame, key: str, tops: list[int]) -> DataFrame:
    """Share of all mentions that the k most frequent labels have. counts: key, n; one row a label."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)))
    each = ranked.withColumn("k", F.explode(F.array(*map(F.lit, tops))))
    return each.groupBy("k").agg((F.sum(F.when(F.col("rank") <= F.col("k"), F.col("n"))) / F.sum("n")).alias("coverage"))


def vocabulary_shape(labels: DataFrame) -> DataFrame:
    """labels (app_id, label, one row a mention) -> labels, mentions, in three apps or more, in one, said once."""
    per = labels.groupBy("label", "app_id").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("apps"))
    return per.agg(F.count("*").alias("labels"), F.sum("n").alias("mentions"), F.count_if(F.col("apps") >= 3).alias("shared"), F.sum(F.when(F.col("apps") >= 3, F.col("n")).otherwise(0)).alias("shared_mentions"),
                   F.count_if(F.col("apps") == 1).alias("single"), F.count_if(F.col("n") == 1).alias("once"))


def prevalence(rows: DataFrame, flag: Column, *of: Column) -> DataFrame:
    """How often conditions hold among flagged rows, among all, and the lift."""
    out = [F.count("*").alias("n"), F.count_if(flag).alias("flagged")]
    for i, c in enumerate(of):
        inside, all_ = ratio(F.count_if(flag & c), F.count_if(flag)), ratio(F.count_if(c), F.count("*"))
        out += [inside.alias(f"inside_{i}"), all_.alias(f"overall_{i}"), (inside / F.nullif(all_, F.lit(0.0))).alias(f"lift_{i}")]
    return rows.agg(*out)


def window_report(windows: DataFrame, buckets: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per window: reviews in it and in flanks of its length before and after, and what overlapping buckets claim. A window that
    was blanked has no reviews but claims. Windows are few and sent to the reviews."""
    w = windows.select("app_id", "start", "end", (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))).alias("length"))
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    joined = reviews.select(F.col("app_id").alias("_a"), "created_at").join(w, F.col("_a") == F.col("app_id"))
    near = joined.filter((t >= at("start") - F.col("length")) & (t < at("end") + F.col("length")))
    part = near.groupBy("app_id", "start", "end").agg(F.count_if((t >= at("start")) & (t < at("end"))).alias("inside"), F.count_if(t < at("start")).alias("before"), F.count_if(t >= at("end")).alias("after"))
    b = buckets.withColumn("b_end", F.coalesce(F.lead("start").over(Window.partitionBy("app_id").orderBy("start")), F.add_months("start", 1).cast("timestamp_ntz")))
    b = b.select(F.col("app_id").alias("_b"), F.col("start").alias("b_start"), "b_end", (F.col("up") + F.col("down")).alias("claim"))
    claims = b.join(w, (F.col("_b") == F.col("app_id")) & (F.col("b_start") < F.col("end")) & (F.col("b_end") > F.col("start"))).groupBy("app_id", "start", "end").agg(F.sum("claim").alias("claimed"), F.count("*").alias("n_buckets"))
    out = w.drop("length").join(part, ["app_id", "start", "end"], "left").join(claims, ["app_id", "start", "end"], "left")
    return out.na.fill(0, ["inside", "before", "after", "claimed", "n_buckets"])


def agreement_by_app(pairs: DataFrame, floor: int) -> DataFrame:
    """pairs (app_id, aspect, tp, fp, fn) -> per app its F1 and what its mix of aspects would lead to expect; and over apps the
    correlation of both, in every row."""
    f1 = 2.0 * F.sum("tp") / F.nullif(F.sum(2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0))
    aspects = pairs.groupBy("aspect").agg(f1.alias("aspect_f1"))
    mix = pairs.groupBy("app_id", "aspect").agg(F.sum(F.col("tp") + F.col("fn")).alias("n")).join(aspects, "aspect")
    expected = mix.groupBy("app_id").agg((F.sum(F.col("aspect_f1") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("expected"))
    apps = pairs.groupBy("app_id").agg(f1.alias("f1"), F.sum(F.col("tp") + F.col("fn")).alias("reference_n")).filter(F.col("reference_n") >= floor).join(expected, "app_id")
    return apps.withColumn("r", F.corr("f1", "expected").over(Window.partitionBy()))  # one row an app


def worst_reviews(pairs: DataFrame, n: int) -> DataFrame:
    """The reviews whose label sets differ most: review_id, difference."""
    per = pairs.groupBy("review_id").agg(F.sum(F.col("fp") + F.col("fn")).alias("difference")).filter("difference > 0")
    return per.orderBy(F.desc("difference"), "review_id").limit(n)


def pinned_evidence(labels: DataFrame, pins: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Labels by the pin that a map leads to, without what is excepted for an app: pin (null: unmapped), mentions, apps."""
    rows = labels.join(exceptions, ["app_id", "label"], "left_anti").join(pins, "label", "left")
    per = rows.groupBy("pin", "app_id").agg(F.count("*").alias("n"))
    return per.groupBy("pin").agg(F.sum("n").alias("mentions"), F.count("*").alias("apps"))


def rename_plan(mentions: DataFrame) -> DataFrame:
    """Candidates with underscores and their spaced names: review_id, aspect, renamed, clash (the review has that name too)."""
    rows = mentions.filter("slot = 'candidate'").select("review_id", "aspect").distinct()
    renamed = rows.filter(F.contains("aspect", F.lit("_"))).withColumn("renamed", F.replace("aspect", F.lit("_"), F.lit(" ")))
    there = rows.select("review_id", F.col("aspect").alias("renamed"), F.lit(True).alias("clash"))
    return renamed.join(there, ["review_id", "renamed"], "left").select("review_id", "aspect", "renamed", F.coalesce("clash", F.lit(False)).alias("clash"))


def gold_diff(drafted: DataFrame, final: DataFrame) -> DataFrame:
    """Drafted labels against final ones (review_id, aspect, sentiment): how many were accepted, flipped, added, deleted."""
    both = drafted.select("review_id", "aspect", F.col("sentiment").alias("d")).join(final.select("review_id", "aspect", F.col("sentiment").alias("f")), ["review_id", "aspect"], "full_outer")
    outcome = F.when(F.col("d").isNull(), "added").when(F.col("f").isNull(), "deleted").when(F.col("d") == F.col("f"), "accepted").otherwise("flipped")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def size_rule(claims: DataFrame, cutoff: int, budget: int, per_page: int = 100) -> DataFrame:
    """claims (app_id, own_claim, all_claim, planned_pages) -> how an app is fetched: all of it up to the cutoff, if its pages are
    in the budget, else by a sample, or not at all."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("all_claim") / per_page))
    whole = (F.col("own_claim") <= cutoff) & (pages <= budget)
    outcome = F.when(whole, "take-all").when(F.col("planned_pages") > budget, "refused").when(F.col("own_claim") <= cutoff, "degraded").otherwise("sampled")
    return claims.select("app_id", outcome.alias("outcome"), F.when(whole, pages).otherwise(F.col("planned_pages")).cast("long").alias("pages"))


def walk_trust(walks: DataFrame) -> DataFrame:
    """walks (app_id, collected, reported, stopped_empty, quota) -> flags: stopped on empty pages; fewer than reported, unless a
    quota was the reason."""
    short = F.col("quota").isNull() & (F.col("collected") < F.col("reported"))
    return walks.select("app_id", "stopped_empty", F.coalesce(short, F.lit(False)).alias("short"), (F.col("stopped_empty") | F.coalesce(short, F.lit(False))).alias("distrusted"))


def language_mix(reviews: DataFrame, *keys: str) -> DataFrame:
    """Languages by number of reviews, ties by name: keys, language, n, place."""
    n = reviews.groupBy(*keys, "language").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "language")))


def shares_phrase(mix: DataFrame, key: str, named: int = 3) -> DataFrame:
    """key, phrase: the first languages with their numbers, and the rest as one."""
    head = F.array_sort(F.collect_list(F.when(F.col("place") <= named, F.struct("place", F.concat_ws(" ", "language", F.format_number("n", 0)).alias("t")))))
    rest = F.sum(F.when(F.col("place") > named, F.col("n")))
    rows = mix.groupBy(key).agg(head.alias("h"), rest.alias("rest"))
    return rows.select(key, F.concat(F.array_join(F.transform("h", lambda x: x["t"]), ", "), F.when(F.col("rest") > 0, F.concat(F.lit(", others "), F.format_number("rest", 0))).otherwise("")).alias("phrase"))


def stage_spans(events: DataFrame) -> DataFrame:
    """First and last moment that each stage of a job spoke: job_id, stage, first, last."""
    return events.groupBy("job_id", "stage").agg(F.min("at").alias("first"), F.max("at").alias("last"))


def job_states(events: DataFrame) -> DataFrame:
    """The latest state of each job of an event log (job_id, at, seq, state), the number of its events, and whether it was
    settled without having been started."""
    return events.groupBy("job_id").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.count("*").alias("events"), (F.count_if(F.col("state") == "queued") == 0).alias("orphan"))


def marked_share(counts: DataFrame, floor: float = 0.02) -> DataFrame:
    """counts (app_id, marked, total) with the share of marked reviews and whether it is worth a remark."""
    share = ratio(F.col("marked"), F.col("total"))
    return counts.withColumn("marked_share", share).withColumn("remark", F.coalesce(share >= floor, F.lit(False)))


def ecdf(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Each value's share of its group's values that are not above it."""
    return rows.withColumn("cume", F.cume_dist().over(Window.partitionBy(group).orderBy(value)))


def list_band(total: Column) -> Column:
    """Which list an app is in, by its reviews: none under 200, true-tail to 2,000, engaging to 20,000, bridge under 60,000."""
    return F.when(total < 200, None).when(total <= 2000, "true-tail").when(total <= 20_000, "engaging").when(total < 60_000, "bridge")


def probe_walk(candidates: DataFrame, quota: dict[str, int], budget: int, seed: str) -> DataFrame:
    """Candidates in seeded order until the budget is spent; of those in a band, the first up to its quota."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("app_id").cast("string")))
    seen = candidates.withColumn("turn", F.row_number().over(Window.orderBy(order, "app_id"))).filter(F.col("turn") <= budget)  # one row an app
    place = F.row_number().over(Window.partitionBy("band").orderBy("turn"))
    most = F.lit(None).cast("int")
    for band, n in quota.items():
        most = F.when(F.col("band") == band, n).otherwise(most)
    return seen.filter("band IS NOT NULL").withColumn("place", place).filter(F.col("place") <= most)


def event_windows(events: DataFrame, run_start: str) -> DataFrame:
    """Windows of flagged events: app_id, start, end, ongoing. One that doesn't end after it starts goes on until the run."""
    ongoing = F.col("end") <= F.col("start")
    return events.select("app_id", "start", F.when(ongoing, F.to_timestamp_ntz(F.lit(run_start))).otherwise(F.col("end")).alias("end"), ongoing.alias("ongoing"))
