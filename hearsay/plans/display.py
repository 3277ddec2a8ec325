"""Queries for what reports, charts and health pages show."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.functions import dates, geometry
from hearsay.functions import text as tx
from hearsay.operators import display, series
from hearsay.operators.aggregates import on_version
from hearsay.plans.journals import BASE as LEDGER
from hearsay.plans.marts import MINT_SQL, SCOPE, mint
from hearsay.plans.prose import evidence
from hearsay.plans.series import MONTHS_SQL, PERIODS_SQL, _periods
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL

FLOOR = 3


def facts(spark, sf_dir):
    return display.facts(mint(spark, sf_dir), FLOOR)


def themes(spark, sf_dir):
    return display.themes(mint(spark, sf_dir), FLOOR)


def chosen_quotes(spark, sf_dir):
    # the given evidence is short
    return display.chosen_quotes(evidence(spark, sf_dir), display.facts(mint(spark, sf_dir), FLOOR), 2, 8, 14)


def shown_quotes(spark, sf_dir):
    e = evidence(spark, sf_dir).withColumn("arrival", F.col("review_id").cast("long") * 100 + F.length("text"))
    e = e.dropDuplicates(["app_id", "aspect", "arrival", "sentiment"]).groupBy("app_id", "aspect", "arrival").agg(F.min("sentiment").alias("sentiment"))
    return display.shown_quotes(e).select("app_id", "aspect", "arrival", "sentiment", "majority", "place")


def folded_tail(spark, sf_dir):
    return display.folded_tail(display.facts(mint(spark, sf_dir), 1).select("app_id", "place", "aspect", "n_reviews"), 4)


def fact_sheets(spark, sf_dir):
    m = mint(spark, sf_dir)
    return display.fact_sheet(display.facts(m, FLOOR), display.themes(m, FLOOR))


def codebook(spark, sf_dir):
    """A vocabulary made of part types: the first brand stands for the category, the first name for the definition."""
    p = views.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("label")).agg(F.min("p_partkey").alias("place"), F.min_by("p_brand", "p_partkey").alias("category"), F.min_by("p_name", "p_partkey").alias("definition"))
    return display.codebook(p)


def timeline(spark, sf_dir):
    return display.timeline(series.histogram(views.reviews(spark, sf_dir)), _periods(spark, sf_dir), 2)


def chart_axes(spark, sf_dir):
    """Axis ceilings and bar parts of each app's pinned aspects."""
    f = display.facts(mint(spark, sf_dir), 1)
    axis = geometry.axis_ceiling(F.col("share_pct") / 100)
    parts = geometry.bar_parts(F.col("n_positive"), F.col("n_mixed") + F.col("n_neutral"), F.col("n_negative"), F.col("sample_size"), axis)
    rows = f.select("app_id", "aspect", axis.alias("axis"), parts.alias("parts"))
    return rows.select("app_id", "aspect", "axis", F.size("parts").alias("n_parts"), F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["pct"]).alias("pct"))


def volume_axis(spark, sf_dir):
    peak = series.histogram(views.reviews(spark, sf_dir)).groupBy("app_id").agg(F.max(F.col("up") + F.col("down")).alias("peak"))
    both = peak.withColumn("peak", F.explode(F.array("peak", F.col("peak") * 37, F.col("peak") * 1000)))
    return both.select("app_id", "peak", geometry.volume_step(F.col("peak")).alias("step"), F.floor(F.col("peak") / geometry.volume_step(F.col("peak"))).alias("marks"))


def census_health(spark, sf_dir):
    return display.census_health(views.envelopes(spark, sf_dir).filter(on_version()), views.mentions(spark, sf_dir), mint(spark, sf_dir))


def supply_counts(spark, sf_dir):
    return display.supply(views.reviews(spark, sf_dir), [50, 100, 130, 5000])


def floor_clearance(spark, sf_dir):
    counts = mint(spark, sf_dir).filter("slot = 'pinned'").select("app_id", "aspect", F.col("n_reviews").alias("n"), "sample_size")
    return display.clearance(counts.drop("sample_size"), counts.select("app_id", F.col("sample_size").alias("probed")).distinct(), [20, 60, 100, 100_000], 8.0)


def _labels(spark, sf_dir):
    scope = views.envelopes(spark, sf_dir).filter(on_version()).select("review_id", "app_id")
    return views.mentions(spark, sf_dir).join(scope, "review_id").select("app_id", F.col("aspect").alias("label"))


def coverage_curve(spark, sf_dir):
    return display.coverage_curve(_labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")), "label", [1, 3, 5, 10, 100])


def vocabulary_shape(spark, sf_dir):
    return display.vocabulary_shape(_labels(spark, sf_dir))


def grouped_shape(spark, sf_dir):
    """The same under groups of labels: a brand's number leads to a group, one of which is left out."""
    group = F.when(F.col("label").startswith("Brand"), F.concat(F.lit("brand "), F.substring("label", 7, 1))).otherwise(F.col("label"))
    return display.vocabulary_shape(_labels(spark, sf_dir).withColumn("label", group).filter("label <> 'brand 1'"))


def pin_evidence(spark, sf_dir):
    """Labels by a map of brands to pins, with exceptions for two apps."""
    labels = _labels(spark, sf_dir)
    names = labels.select("label").distinct()
    pins = names.filter("label LIKE 'Brand%' AND label NOT LIKE '%5'").select("label", F.concat(F.lit("pin "), F.substring("label", 7, 1)).alias("pin"))
    exceptions = names.filter("label LIKE 'Brand#2%'").select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("app_id"), "label")
    return display.pinned_evidence(labels, pins, exceptions)


def template_prevalence(spark, sf_dir):
    """Documents of more than three line feeds against others: labels and quality among them."""
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return display.prevalence(d, lines > 3, F.col("toxic") == 1, F.col("quality") == 1)


def templates(spark, sf_dir):
    """Checklists among documents, a box or marker put into some of them."""
    mark = F.when(F.col("doc_id") % 7 == 1, F.lit(" ☐ a ☑ b ☒")).when(F.col("doc_id") % 7 == 2, F.lit(" ☐ ☐")).when(F.col("doc_id") % 11 == 3, F.lit("---{ x }---")).otherwise("")
    d = views.table(spark, sf_dir, "documents").select("lang", F.concat("text", mark).alias("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(tx.is_template(F.col("text"))).alias("templates"))


def blanked_windows(spark, sf_dir):
    r = views.reviews(spark, sf_dir)
    return display.window_report(_periods(spark, sf_dir), series.histogram(r), r.filter("app_id % 4 <> 1 OR created_at < '1995-01-01'"))


def app_agreement(spark, sf_dir):
    pairs = _app_pairs(spark, sf_dir)
    return display.agreement_by_app(pairs, 5)


def _app_pairs(spark, sf_dir):
    from hearsay.plans.evaluation import _pairs

    apps = views.reviews(spark, sf_dir).select("review_id", "app_id")
    return _pairs(spark, sf_dir).join(apps, "review_id")


def worst_reviews(spark, sf_dir):
    return display.worst_reviews(_app_pairs(spark, sf_dir), 15)


def gold_changes(spark, sf_dir):
    from hearsay.plans.evaluation import _sets

    gold, predicted = _sets(spark, sf_dir)
    return display.gold_diff(predicted, gold)


def rename_plan(spark, sf_dir):
    """Candidates, half of whose brands are written with underscores on purpose."""
    m = views.mentions(spark, sf_dir)
    name = F.when(F.col("position") % 2 == 0, F.replace("aspect", F.lit("#"), F.lit("_"))).otherwise(F.replace("aspect", F.lit("#"), F.lit(" ")))
    return display.rename_plan(m.withColumn("aspect", F.when(F.col("slot") == "candidate", name).otherwise(F.col("aspect")))).groupBy("renamed").agg(F.count("*").alias("n"), F.count_if("clash").alias("clashes"))


def size_rule(spark, sf_dir):
    r = views.reviews(spark, sf_dir).groupBy("app_id").agg(F.count_if(F.col("language") == "english").alias("own_claim"), F.count("*").alias("all_claim"))
    r = r.withColumn("all_claim", F.col("all_claim") * F.when(F.col("app_id") % 5 == 2, 100).otherwise(1)).withColumn("planned_pages", F.when(F.col("app_id") % 5 == 3, 900).otherwise(20).cast("long"))
    return display.size_rule(r.withColumn("own_claim", F.col("own_claim") * F.when(F.col("app_id") % 5 == 4, 1000).otherwise(1)), 100_000, 100)


def walk_trust(spark, sf_dir):
    """Walks made from apps' reviews: collected against reported."""
    r = views.reviews(spark, sf_dir).groupBy("app_id").agg(F.count("*").alias("reported"), F.count_if(F.col("review_id").cast("long") % 50 != 7).alias("collected"))
    r = r.withColumn("collected", F.when(F.col("app_id") % 2 == 0, F.col("reported")).otherwise(F.col("collected"))).withColumn("stopped_empty", F.col("app_id") == 4).withColumn("quota", F.when(F.col("app_id") == 7, 100))
    return display.walk_trust(r)


def language_mix(spark, sf_dir):
    return display.language_mix(views.reviews(spark, sf_dir), "app_id")


def language_phrases(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("source").alias("app_id"), F.col("lang").alias("language"))
    return display.shares_phrase(display.language_mix(d, "app_id"), "app_id", 2)


def _events(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def stage_spans(spark, sf_dir):
    s = display.stage_spans(_events(spark, sf_dir))
    return s.select("*", dates.elapsed(F.col("first"), F.col("last")).alias("took"))


def job_states(spark, sf_dir):
    return display.job_states(_events(spark, sf_dir).withColumn("state", F.when(F.col("stage") == "signup", "queued").when(F.col("stage") == "error", "failed").when(F.col("stage") == "purchase", "done").otherwise("running")))


def marked_shares(spark, sf_dir):
    r = views.reviews(spark, sf_dir)
    marked = F.col("created_at").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-02-01").cast("timestamp_ntz"))
    return display.marked_share(r.groupBy("app_id").agg(F.count_if(marked).alias("marked"), F.count("*").alias("total")))


def volume_ecdf(spark, sf_dir):
    m = series.histogram(views.reviews(spark, sf_dir)).withColumn("volume", (F.col("up") + F.col("down")).cast("long"))
    return display.ecdf(m.select("app_id", "volume"), "app_id", "volume").distinct()


def list_bands(spark, sf_dir):
    """Bands of customers by whole spending, as if it were a number of reviews; a probe walks them by quotas."""
    o = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("app_id")).agg((F.floor(F.sum("o_totalprice").cast("double") / 100)).cast("long").alias("total"))
    return display.probe_walk(o.withColumn("band", display.list_band(F.col("total"))), {"true-tail": 5, "engaging": 7, "bridge": 3}, 60, "p")


def event_windows(spark, sf_dir):
    p = _periods(spark, sf_dir)
    ongoing = F.col("app_id") % 3 == 0
    return display.event_windows(p.withColumn("end", F.when(ongoing, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("end"))), "1998-12-31 00:00:00")


def time_texts(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"), "value")
    text = dates.iso_text(F.col("t"))
    n = lambda c: c.cast("timestamp_ntz")
    return e.select("event_id", text.alias("iso"), (dates.iso_time(text) == F.col("t")).alias("same"), n(dates.day_start(F.col("t"))).alias("day"), n(dates.quota_start(F.col("t"), 8)).alias("quota"),
                    n(dates.quantile_time(dates.day_start(F.col("t")), F.col("t"), F.lit(0.25))).alias("quarter"), dates.elapsed(dates.day_start(F.col("t")), F.col("t")).alias("elapsed"))


def life_windows(spark, sf_dir):
    life = views.reviews(spark, sf_dir).groupBy("app_id").agg(F.min("created_at").alias("a"), F.max("created_at").alias("z"))
    start, end = dates.whole_life(F.col("a"), F.col("z"))
    return life.select("app_id", start.alias("start"), end.alias("end"), F.array_join(dates.year_ticks(F.col("a"), F.col("z")).cast("array<string>"), ",").alias("years"), dates.period_label(F.col("a"), "week").alias("label"))


def identities(spark, sf_dir):
    """Customers' names against changed ones: numbers kept as they are, written in roman, raised by one, or with an ending."""
    c = views.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Saga of "), "c_mktsegment", F.lit(" "), (F.col("c_custkey") % 9 + 1).cast("string")).alias("wanted"), (F.col("c_custkey") % 9 + 1).cast("int").alias("k"))
    base = F.regexp_replace("wanted", " [0-9]+$", "")
    roman = F.element_at(F.array(*map(F.lit, "I II III IV V VI VII VIII IX X".split())), F.col("k"))
    found = (
        F.when(F.col("c_custkey") % 5 == 0, F.upper(F.concat("wanted", F.lit("™")))).when(F.col("c_custkey") % 5 == 1, F.concat(base, F.lit(" "), roman)).when(F.col("c_custkey") % 5 == 2, F.concat(base, F.lit(" "), (F.col("k") + 1).cast("string")))
        .when(F.col("c_custkey") % 5 == 3, F.concat("wanted", F.lit(": The Complete and Unabridged Edition")))
    )
    rows = c.withColumn("found", found)
    named = rows.select("wanted", "found").distinct().withColumn("verdict", tx.same_name(tx.plain_name("wanted"), tx.plain_name("found")))
    return rows.join(named, rows["wanted"].eqNullSafe(named["wanted"]) & rows["found"].eqNullSafe(named["found"])).select("c_custkey", "verdict")


def label_names(spark, sf_dir):
    """Names and marks in labels: shown, snake case, the fence around a text, what backticks name, the first word marked."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("label"), "p_name")
    ticks = F.repeat(F.lit("`"), (F.col("p_partkey") % 6).cast("int"))
    text = F.concat(F.lit("see `"), "label", F.lit("` and `"), "p_name", F.lit("` "), ticks)
    return p.select(
        "p_partkey", tx.display_name(F.col("label")).alias("shown"), tx.is_snake_case(F.col("label")).alias("snake"), tx.is_snake_case(F.col("p_name")).alias("name_snake"), F.length(tx.fence_for(text)).alias("fence"),
        F.array_join(F.slice(tx.backtick_names(text), 1, 2), "|").alias("named"), tx.highlighted(F.col("p_name"), F.substring_index("p_name", " ", 1)).alias("marked"),
        tx.spaced_keys(F.concat(F.lit("a "), "label", F.lit(" of "), "label", F.lit("s")), F.array("label")).alias("spaced"), tx.visitor(F.concat(F.lit("1.1.1.1, "), F.col("p_partkey").cast("string"), F.lit(" ")), F.lit("peer")).alias("visitor"),
    )


def stage_table(spark, sf_dir):
    """Stages and models with the latencies of their stage."""
    from hearsay.operators import journals
    from hearsay.plans.journals import ledger

    rows = ledger(spark, sf_dir)
    return journals.stage_totals(rows).join(journals.stage_latencies(rows.filter("stage <> 'view'")), "stage", "left").select("stage", "model", "calls", "cost", "p50", "p95")


BASE = f"WITH raw AS (WITH {REVIEWS_SQL} SELECT * FROM reviews), reviews AS (SELECT * FROM raw), {ENVELOPES_SQL}, {MENTIONS_SQL}, {MONTHS_SQL}, mint AS ({MINT_SQL}), {PERIODS_SQL}, ev AS (SELECT app_id, review_id, aspect, slot, sentiment, evidence AS text FROM mentions JOIN (SELECT review_id, app_id FROM envelopes WHERE {SCOPE}) e USING (review_id) WHERE evidence IS NOT NULL)"
DOM = "CASE greatest(n_positive, n_negative, n_mixed, n_neutral) WHEN n_positive THEN 'positive' WHEN n_negative THEN 'negative' WHEN n_mixed THEN 'mixed' ELSE 'neutral' END"
FACTS = f"SELECT app_id, aspect, n_reviews, sample_size, share * 100 AS share_pct, n_positive, n_negative, n_mixed, n_neutral, {DOM} AS dominant, row_number() OVER (PARTITION BY app_id ORDER BY n_reviews DESC, aspect)::INT AS place FROM mint WHERE slot = 'pinned' AND n_reviews >= {{0}}"
LABELS = f"labels AS (SELECT app_id, aspect AS label FROM mentions JOIN (SELECT review_id, app_id FROM envelopes WHERE {SCOPE}) e USING (review_id))"
SHAPE = "p AS (SELECT label, app_id, count(*) AS n FROM {0} GROUP BY 1, 2), q AS (SELECT label, sum(n)::BIGINT AS n, count(*) AS apps FROM p GROUP BY 1) SELECT count(*) AS labels, sum(n)::BIGINT AS mentions, count(*) FILTER (apps >= 3) AS shared, coalesce(sum(n) FILTER (apps >= 3), 0)::BIGINT AS shared_mentions, count(*) FILTER (apps = 1) AS single, count(*) FILTER (n = 1) AS once FROM q"
STEP = "CASE WHEN {0} / 4.0 < 1 THEN 1 WHEN power(10, floor(log10({0} / 4.0))) >= {0} / 4.0 THEN power(10, floor(log10({0} / 4.0))) WHEN 2 * power(10, floor(log10({0} / 4.0))) >= {0} / 4.0 THEN 2 * power(10, floor(log10({0} / 4.0))) WHEN 5 * power(10, floor(log10({0} / 4.0))) >= {0} / 4.0 THEN 5 * power(10, floor(log10({0} / 4.0))) ELSE 10 * power(10, floor(log10({0} / 4.0))) END::BIGINT"
PAIRS = f"""WITH {MENTIONS_SQL}, one AS (SELECT review_id, aspect, min(sentiment) AS sentiment, CAST(review_id AS BIGINT) + length(aspect) AS r FROM mentions WHERE slot = 'pinned' GROUP BY 1, 2),
gold AS (SELECT review_id, aspect, sentiment AS g FROM one WHERE r % 8 <> 0), pred AS (SELECT review_id, aspect, CASE WHEN r % 5 = 0 THEN 'mixed' ELSE sentiment END AS p FROM one WHERE r % 7 <> 0),
pairs AS (SELECT review_id, aspect, g, p, (g IS NOT NULL AND p IS NOT NULL)::INT AS tp, (g IS NULL)::INT AS fp, (p IS NULL)::INT AS fn FROM gold FULL JOIN pred USING (review_id, aspect)),
ap AS (SELECT pairs.*, o_custkey % 10 AS app_id FROM pairs JOIN orders ON o_orderkey::VARCHAR = review_id)"""

QUERIES = {
    "compose_facts": facts, "compose_themes": themes, "chosen_quotes": chosen_quotes, "shown_quotes": shown_quotes, "folded_tail": folded_tail, "fact_sheets": fact_sheets, "codebook": codebook, "timeline": timeline,
    "chart_axes": chart_axes, "volume_axis": volume_axis, "census_health": census_health, "supply_counts": supply_counts, "floor_clearance": floor_clearance, "coverage_curve": coverage_curve, "vocabulary_shape": vocabulary_shape,
    "grouped_shape": grouped_shape, "pin_evidence": pin_evidence, "line_prevalence": template_prevalence, "template_reviews": templates, "blanked_windows": blanked_windows, "app_agreement": app_agreement, "worst_reviews": worst_reviews,
    "gold_changes": gold_changes, "rename_plan": rename_plan, "size_rule": size_rule, "walk_trust": walk_trust, "language_mix": language_mix, "language_phrases": language_phrases, "stage_spans": stage_spans, "job_states": job_states,
    "marked_shares": marked_shares, "volume_ecdf": volume_ecdf, "probe_walk": list_bands, "event_windows": event_windows, "time_texts": time_texts, "life_windows": life_windows, "identity_verdicts": identities, "label_names": label_names,
    "stage_table": stage_table,
}
ORACLE = {
    "compose_facts": f"{BASE} {FACTS.format(FLOOR)}",
    "compose_themes": f"{BASE}, t AS (SELECT app_id, row_number() OVER (PARTITION BY app_id ORDER BY n_reviews DESC, aspect)::INT AS place, aspect FROM mint WHERE slot = 'candidate' AND n_reviews >= {FLOOR}) SELECT * FROM t WHERE place <= 5",
    "chosen_quotes": f"""{BASE}, f AS ({FACTS.format(FLOOR)}), q AS (SELECT ev.app_id, ev.aspect, row_number() OVER (PARTITION BY ev.app_id, ev.aspect ORDER BY (sentiment <> dominant), review_id, text)::INT AS place, review_id, sentiment, text
        FROM ev JOIN f ON f.app_id = ev.app_id AND f.aspect = ev.aspect WHERE length(text) BETWEEN 8 AND 14) SELECT * FROM q WHERE place <= 2""",
    "shown_quotes": f"""{BASE}, e AS (SELECT app_id, aspect, CAST(review_id AS BIGINT) * 100 + length(text) AS arrival, min(sentiment) AS sentiment FROM ev GROUP BY 1, 2, 3), t AS (SELECT app_id, aspect, sentiment, count(*) AS n, min(arrival) AS f FROM e GROUP BY 1, 2, 3),
        m AS (SELECT app_id, aspect, sentiment AS majority FROM t QUALIFY row_number() OVER (PARTITION BY app_id, aspect ORDER BY n DESC, f) = 1), q AS (SELECT e.*, majority, row_number() OVER (PARTITION BY app_id, aspect ORDER BY sentiment <> majority, arrival)::INT AS place FROM e JOIN m USING (app_id, aspect)) SELECT * FROM q WHERE place <= 3""",
    "folded_tail": f"{BASE}, f AS ({FACTS.format(1)}), s AS (SELECT *, CASE WHEN place <= 4 THEN place END AS p FROM f) SELECT app_id, p AS place, min(CASE WHEN p IS NOT NULL THEN aspect END) AS aspect, count(*) AS n_aspects, sum(n_reviews)::BIGINT AS n_reviews FROM s GROUP BY 1, 2",
    "fact_sheets": f"""{BASE}, f AS ({FACTS.format(FLOOR)}), l AS (SELECT app_id, any_value(sample_size) AS size, string_agg(format('- {{}}: {{:,}} reviews ({{:.1f}}%) — positive {{:,}}, negative {{:,}}, mixed {{:,}}, neutral {{:,}}', aspect, n_reviews, share_pct, n_positive, n_negative, n_mixed, n_neutral), E'\\n' ORDER BY place) AS lines FROM f GROUP BY 1),
        t AS (SELECT app_id, aspect, row_number() OVER (PARTITION BY app_id ORDER BY n_reviews DESC, aspect) AS place FROM mint WHERE slot = 'candidate' AND n_reviews >= {FLOOR}), n AS (SELECT app_id, string_agg(aspect, ', ' ORDER BY place) AS names FROM t WHERE place <= 5 GROUP BY 1)
        SELECT app_id, 'Sample: ' || format('{{:,}}', size) || E' reviews\\n' || lines || CASE WHEN names IS NOT NULL THEN E'\\nRecurring themes (name only): ' || names ELSE '' END AS sheet FROM l LEFT JOIN n USING (app_id)""",
    "codebook": """WITH v AS (SELECT p_type AS label, min(p_partkey) AS place, arg_min(p_brand, p_partkey) AS category, arg_min(p_name, p_partkey) AS definition FROM part GROUP BY 1),
        g AS (SELECT category, min(place) AS f, '## ' || category || E'\\n\\n' || string_agg('### ' || label || E'\\nDefinition: ' || definition, E'\\n\\n' ORDER BY place) AS p FROM v GROUP BY 1) SELECT string_agg(p, E'\\n\\n' ORDER BY f) AS codebook FROM g""",
    "timeline": f"""{BASE}, a AS (SELECT *, up + down AS total, sum((up + down < 2)::INT) OVER (PARTITION BY app_id ORDER BY start) AS breaks, min(start) OVER w AS f, max(start) OVER w AS l, max(up + down) OVER w AS peak FROM months WINDOW w AS (PARTITION BY app_id)),
        b AS (SELECT a.*, total >= 2 AS ok, EXISTS (SELECT 1 FROM periods p WHERE p.app_id = a.app_id AND p.start < a.start + INTERVAL 1 MONTH AND a.start < p."end") AS marked FROM a WHERE total > 0), c AS (SELECT *, count(*) OVER (PARTITION BY app_id, breaks, ok) AS run FROM b)
        SELECT app_id, start, strftime(start, '%b %Y') AS period, total::BIGINT AS total, up / total::DOUBLE AS share, CASE WHEN NOT ok THEN 'faded dot' WHEN run = 1 THEN 'dot' ELSE 'line' END AS kind, concat_ws(' · ', CASE WHEN NOT ok THEN 'small sample' END, CASE WHEN marked THEN 'marked period' END) AS note,
        (epoch_us(start) - epoch_us(f)) / nullif(epoch_us(l) - epoch_us(f), 0)::DOUBLE * 600 AS x, total / peak::DOUBLE AS height, {STEP.format("peak")} AS step FROM c""",
    "chart_axes": f"""{BASE}, f AS ({FACTS.format(1)}), a AS (SELECT *, least(round(greatest(1, ceil(round(least(share_pct / 100, 1.0) / 0.1, 9))) * 0.1, 2), 1.0) AS axis FROM f)
        SELECT app_id, aspect, axis, ((n_positive > 0)::INT + (n_mixed + n_neutral > 0)::INT + (n_negative > 0)::INT) AS n_parts, (n_positive + n_mixed + n_neutral + n_negative) * 100.0::DOUBLE / (sample_size * axis) AS pct FROM a""",
    "volume_axis": f"""{BASE}, p AS (SELECT app_id, max(up + down) AS k FROM months GROUP BY 1), b AS (SELECT app_id, unnest([k, k * 37, k * 1000]) AS peak FROM p) SELECT app_id, peak, {STEP.format("peak")} AS step, (peak // ({STEP.format("peak")}))::BIGINT AS marks FROM b""",
    "census_health": f"""{BASE}, s AS (SELECT review_id, app_id FROM envelopes WHERE {SCOPE}), n AS (SELECT app_id, count(DISTINCT review_id) AS reviews_with_any, count(*) AS mentions, count(evidence) AS with_evidence, count(*) FILTER (slot = 'candidate') AS candidates FROM mentions JOIN s USING (review_id) GROUP BY 1),
        t AS (SELECT app_id, aspect AS top_aspect, n_positive + n_negative + n_mixed + n_neutral AS top_mentions FROM mint QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY n_positive + n_negative + n_mixed + n_neutral DESC, aspect, slot) = 1)
        SELECT e.*, coalesce(reviews_with_any, 0) AS reviews_with_any, coalesce(mentions, 0) AS mentions, coalesce(with_evidence, 0) AS with_evidence, coalesce(candidates, 0) AS candidates, top_aspect, top_mentions FROM (SELECT app_id, count(*) AS envelopes FROM s GROUP BY 1) e LEFT JOIN n USING (app_id) LEFT JOIN t USING (app_id)""",
    "supply_counts": f"{BASE}, n AS (SELECT app_id, count(*) FILTER (language = 'english') AS n FROM reviews GROUP BY 1) SELECT target, sum(least(n, target))::BIGINT AS drawn, count(*) FILTER (n < target) AS short, count(*) AS apps FROM n, (SELECT unnest([50, 100, 130, 5000]) AS target) GROUP BY 1",
    "floor_clearance": f"""{BASE}, c AS (SELECT app_id, n_reviews AS n, sample_size AS probed FROM mint WHERE slot = 'pinned'), p AS (SELECT slice, app_id, count(*) FILTER (n / probed::DOUBLE * least(slice, probed) >= 8) AS k, any_value(probed) AS probed FROM c, (SELECT unnest([20, 60, 100, 100000]) AS slice) GROUP BY 1, 2),
        g AS (SELECT slice, list_sort(list(k)) AS v, count(*) FILTER (slice >= probed) AS whole, count(*) AS n FROM p GROUP BY 1), q AS (SELECT *, list_transform([1, 2, 3], lambda i: [greatest(1, least(n - 1, i * (n + 1) // 4)), i * (n + 1) - 4 * greatest(1, least(n - 1, i * (n + 1) // 4))]) AS r FROM g)
        SELECT slice, v[1] AS least, (v[r[1][1]] * (4 - r[1][2]) + v[r[1][1] + 1] * r[1][2]) / 4.0::DOUBLE AS p25, (v[r[2][1]] * (4 - r[2][2]) + v[r[2][1] + 1] * r[2][2]) / 4.0::DOUBLE AS median, (v[r[3][1]] * (4 - r[3][2]) + v[r[3][1] + 1] * r[3][2]) / 4.0::DOUBLE AS p75, v[-1] AS most, whole FROM q""",
    "coverage_curve": f"{BASE}, {LABELS}, r AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rk FROM labels GROUP BY 1) SELECT k, sum(n) FILTER (rk <= k) / sum(n)::DOUBLE AS coverage FROM r, (SELECT unnest([1, 3, 5, 10, 100]) AS k) GROUP BY 1",
    "vocabulary_shape": f"{BASE}, {LABELS}, {SHAPE.format('labels')}",
    "grouped_shape": f"{BASE}, {LABELS}, gl AS (SELECT app_id, CASE WHEN label LIKE 'Brand%' THEN 'brand ' || substr(label, 7, 1) ELSE label END AS label FROM labels), {SHAPE.format('''(SELECT * FROM gl WHERE label <> 'brand 1')''')}",
    "pin_evidence": f"""{BASE}, {LABELS}, x AS (SELECT app_id, CASE WHEN label LIKE 'Brand%' AND label NOT LIKE '%5' THEN 'pin ' || substr(label, 7, 1) END AS pin FROM labels WHERE NOT (label LIKE 'Brand#2%' AND app_id IN (1, 2))) SELECT pin, count(*) AS mentions, count(DISTINCT app_id) AS apps FROM x GROUP BY 1""",
    "line_prevalence": r"""WITH d AS (SELECT length(text) - length(replace(text, E'\n', '')) > 3 AS f, toxic = 1 AS a, quality = 1 AS b FROM documents JOIN labels USING (doc_id)), s AS (SELECT count(*) AS n, count(*) FILTER (f) AS flagged, count(*) FILTER (f AND a) / nullif(count(*) FILTER (f), 0)::DOUBLE AS inside_0,
        count(*) FILTER (a) / count(*)::DOUBLE AS overall_0, count(*) FILTER (f AND b) / nullif(count(*) FILTER (f), 0)::DOUBLE AS inside_1, count(*) FILTER (b) / count(*)::DOUBLE AS overall_1 FROM d) SELECT *, inside_0 / nullif(overall_0, 0) AS lift_0, inside_1 / nullif(overall_1, 0) AS lift_1 FROM s""",
    "template_reviews": "SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 7 = 1 OR doc_id % 7 <> 2 AND doc_id % 11 = 3) AS templates FROM documents GROUP BY 1",
    "blanked_windows": f"""{BASE}, k AS (SELECT * FROM reviews WHERE app_id % 4 <> 1 OR created_at < TIMESTAMP '1995-01-01'), b AS (SELECT app_id, start AS s, coalesce(lead(start) OVER (PARTITION BY app_id ORDER BY start), start + INTERVAL 1 MONTH) AS e, up + down AS claim FROM months)
        SELECT p.app_id, p.start, p."end", (SELECT count(*) FROM k WHERE k.app_id = p.app_id AND created_at >= p.start AND created_at < p."end") AS inside, (SELECT count(*) FROM k WHERE k.app_id = p.app_id AND created_at < p.start AND created_at >= p.start - (p."end" - p.start)) AS before,
        (SELECT count(*) FROM k WHERE k.app_id = p.app_id AND created_at >= p."end" AND created_at < p."end" + (p."end" - p.start)) AS after, coalesce((SELECT sum(claim) FROM b WHERE b.app_id = p.app_id AND s < p."end" AND e > p.start), 0)::BIGINT AS claimed, (SELECT count(*) FROM b WHERE b.app_id = p.app_id AND s < p."end" AND e > p.start) AS n_buckets FROM periods p""",
    "app_agreement": f"""{PAIRS}, f AS (SELECT aspect, 2.0 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0) AS f1 FROM ap GROUP BY 1), m AS (SELECT app_id, aspect, sum(tp + fn) AS n FROM ap GROUP BY 1, 2), e AS (SELECT app_id, sum(f1 * n) / nullif(sum(n), 0) AS expected FROM m JOIN f USING (aspect) GROUP BY 1),
        a AS (SELECT app_id, 2.0 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0) AS f1, sum(tp + fn)::BIGINT AS reference_n, any_value(expected) AS expected FROM ap JOIN e USING (app_id) GROUP BY 1 HAVING sum(tp + fn) >= 5) SELECT *, corr(f1, expected) OVER () AS r FROM a""",
    "worst_reviews": f"{PAIRS} SELECT review_id, sum(fp + fn)::BIGINT AS difference FROM ap GROUP BY 1 HAVING sum(fp + fn) > 0 ORDER BY difference DESC, review_id LIMIT 15",
    "gold_changes": f"{PAIRS} SELECT CASE WHEN p IS NULL THEN 'added' WHEN g IS NULL THEN 'deleted' WHEN g = p THEN 'accepted' ELSE 'flipped' END AS outcome, count(*) AS n FROM pairs GROUP BY 1",
    "rename_plan": f"""WITH {MENTIONS_SQL}, c AS (SELECT DISTINCT review_id, CASE WHEN position % 2 = 0 THEN replace(aspect, '#', '_') ELSE replace(aspect, '#', ' ') END AS aspect FROM mentions WHERE slot = 'candidate')
        SELECT replace(aspect, '_', ' ') AS renamed, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM c d WHERE d.review_id = c.review_id AND d.aspect = replace(c.aspect, '_', ' '))) AS clashes FROM c WHERE contains(aspect, '_') GROUP BY 1""",
    "size_rule": f"""{BASE}, r AS (SELECT app_id, count(*) FILTER (language = 'english') * CASE WHEN app_id % 5 = 4 THEN 1000 ELSE 1 END AS own, count(*) * CASE WHEN app_id % 5 = 2 THEN 100 ELSE 1 END AS al, CASE WHEN app_id % 5 = 3 THEN 900 ELSE 20 END AS pl FROM reviews GROUP BY 1), g AS (SELECT *, greatest(1, ceil(al / 100.0)) AS pages FROM r)
        SELECT app_id, CASE WHEN own <= 100000 AND pages <= 100 THEN 'take-all' WHEN pl > 100 THEN 'refused' WHEN own <= 100000 THEN 'degraded' ELSE 'sampled' END AS outcome, (CASE WHEN own <= 100000 AND pages <= 100 THEN pages ELSE pl END)::BIGINT AS pages FROM g""",
    "walk_trust": f"""{BASE}, r AS (SELECT app_id, count(*) AS reported, CASE WHEN app_id % 2 = 0 THEN count(*) ELSE count(*) FILTER (CAST(review_id AS BIGINT) % 50 <> 7) END AS collected FROM reviews GROUP BY 1) SELECT app_id, app_id = 4 AS stopped_empty, app_id <> 7 AND collected < reported AS short, app_id = 4 OR (app_id <> 7 AND collected < reported) AS distrusted FROM r""",
    "language_mix": f"{BASE} SELECT app_id, language, count(*) AS n, row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, language)::INT AS place FROM reviews GROUP BY 1, 2",
    "language_phrases": """WITH n AS (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS p FROM documents GROUP BY 1, 2)
        SELECT source AS app_id, string_agg(lang || ' ' || format('{:,}', n), ', ' ORDER BY p) FILTER (p <= 2) || CASE WHEN sum(n) FILTER (p > 2) > 0 THEN ', others ' || format('{:,}', (sum(n) FILTER (p > 2))::BIGINT) ELSE '' END AS phrase FROM n GROUP BY 1""",
    "stage_spans": """WITH s AS (SELECT user_id AS job_id, event_type AS stage, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2), e AS (SELECT *, (epoch_us(last) - epoch_us(first)) // 1000000 AS s FROM s) SELECT job_id, stage, first, last, (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' AS took FROM e""",
    "job_states": """SELECT user_id AS job_id, arg_max(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END, struct_pack(a := ts, b := event_id)) AS state, count(*) AS events, count(*) FILTER (event_type = 'signup') = 0 AS orphan FROM events GROUP BY 1""",
    "marked_shares": f"""{BASE}, c AS (SELECT app_id, count(*) FILTER (created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-02-01') AS marked, count(*) AS total FROM reviews GROUP BY 1) SELECT *, marked / total::DOUBLE AS marked_share, marked / total::DOUBLE >= 0.02 AS remark FROM c""",
    "volume_ecdf": f"{BASE} SELECT DISTINCT app_id, (up + down)::BIGINT AS volume, cume_dist() OVER (PARTITION BY app_id ORDER BY up + down) AS cume FROM months",
    "probe_walk": """WITH o AS (SELECT o_custkey AS app_id, floor(sum(o_totalprice)::DOUBLE / 100)::BIGINT AS total FROM orders GROUP BY 1), b AS (SELECT *, CASE WHEN total < 200 THEN NULL WHEN total <= 2000 THEN 'true-tail' WHEN total <= 20000 THEN 'engaging' WHEN total < 60000 THEN 'bridge' END AS band, row_number() OVER (ORDER BY md5('p|' || o_custkey), o_custkey)::INT AS turn FROM (SELECT app_id AS o_custkey, app_id, total FROM o)),
        q AS (SELECT app_id, total, band, turn, row_number() OVER (PARTITION BY band ORDER BY turn)::INT AS place FROM b WHERE turn <= 60 AND band IS NOT NULL) SELECT * FROM q WHERE place <= CASE band WHEN 'true-tail' THEN 5 WHEN 'engaging' THEN 7 ELSE 3 END""",
    "event_windows": f"""{BASE} SELECT app_id, start, CASE WHEN app_id % 3 = 0 THEN TIMESTAMP '1998-12-31' ELSE "end" END AS "end", app_id % 3 = 0 AS ongoing FROM periods""",
    "time_texts": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso, true AS same, date_trunc('day', ts)::TIMESTAMP AS day, (date_trunc('day', ts - INTERVAL 8 HOUR) + INTERVAL 8 HOUR)::TIMESTAMP AS quota, make_timestamp(epoch_us(date_trunc('day', ts)) + round(0.25 * (epoch_us(ts) - epoch_us(date_trunc('day', ts))))::BIGINT) AS quarter,
        ((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 60000000) || 'm ' || lpad((((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000000) % 60)::VARCHAR, 2, '0') || 's' AS elapsed FROM events""",
    "life_windows": f"""{BASE}, l AS (SELECT app_id, min(created_at) AS a, max(created_at) AS z FROM reviews GROUP BY 1) SELECT app_id, (a - INTERVAL 45 DAY)::TIMESTAMP AS start, (z + INTERVAL 1 DAY)::TIMESTAMP AS "end", array_to_string(range(year(a) + 1, year(z) + 1), ',') AS years, strftime(a, 'week of %d %b %Y') AS label FROM l""",
    "identity_verdicts": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'ok' ELSE 'no-data' END AS verdict FROM customer""",
    "label_names": r"""WITH p AS (SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS label, p_name FROM part) SELECT p_partkey, replace(label, '_', ' ') AS shown, regexp_full_match(label, '[a-z][a-z0-9_]*') AS snake, regexp_full_match(p_name, '[a-z][a-z0-9_]*') AS name_snake, greatest(3, 2, p_partkey % 6 + 1)::INT AS fence,
        label || '|' || p_name AS named, '**' || string_split(p_name, ' ')[1] || '**' || substr(p_name, length(string_split(p_name, ' ')[1]) + 1) AS marked, CASE WHEN contains(label, '_') THEN 'a ' || replace(label, '_', ' ') || ' of ' || label || 's' ELSE 'a ' || label || ' of ' || label || 's' END AS spaced, p_partkey::VARCHAR AS visitor FROM p""",
    "stage_table": f"""{LEDGER}, st AS (SELECT stage, model, count(*) AS calls, sum(cost)::BIGINT AS cost FROM ledger GROUP BY 1, 2), l AS (SELECT stage, quantile_disc(duration_s, 0.5) AS p50, quantile_disc(duration_s, 0.95) AS p95 FROM ledger WHERE duration_s IS NOT NULL AND stage <> 'view' GROUP BY 1) SELECT stage, model, calls, cost, p50, p95 FROM st LEFT JOIN l USING (stage)""",
}
