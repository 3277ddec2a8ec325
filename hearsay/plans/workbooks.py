"""Queries of workbooks, audits, scopes and report columns: sheets and payloads are made of whole tables, read back and judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import certify, scopes, series, workbooks
from hearsay.operators.aggregates import on_version
from hearsay.plans.marts import MINT_SQL, SCOPE, mint
from hearsay.plans.series import MONTHS_SQL
from hearsay.sources import columns, files
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL


def _r():
    return F.col("review_id").cast("long")


def _texts(spark, sf_dir):
    """Reviews with what their mentions show, a line each, as text."""
    m = views.mentions(spark, sf_dir).filter("evidence IS NOT NULL").groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_list("evidence")), "\n").alias("text"))
    return views.reviews(spark, sf_dir).join(m, "review_id", "left").select("review_id", "app_id", "created_at", F.coalesce("text", F.lit("")).alias("text"))


def _pinned(spark, sf_dir):
    return views.mentions(spark, sf_dir).filter("slot = 'pinned'").select("aspect").distinct()


#: A sheet holds reviews of one app, month and range of this many review numbers, so sheets get more, not longer, as tables grow.
SHEET_RANGE = 50_000


def _workbook():
    """The app and month that a sheet belongs to."""
    return F.concat_ws("/", "app_id", F.date_format("created_at", "yyyy-MM"))


def _sheet():
    return F.concat_ws("/", _workbook(), F.floor(_r() / SHEET_RANGE).cast("string"))


def _sheets(spark, sf_dir):
    """A sheet an app, month and range of reviews: reviews in order, one in 23 skipped, boxes ticked."""
    said = F.concat(F.lit("- "), "aspect", F.lit(" / "), "sentiment", F.lit(" / "), F.coalesce(F.concat(F.lit('"'), "evidence", F.lit('"')), F.lit("(no span)")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", said.alias("s")))), lambda x: x["s"]), "\n")
    m = views.mentions(spark, sf_dir).groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_list("evidence")), "\n").alias("text"), lines.alias("lines"))
    r = views.reviews(spark, sf_dir).join(m, "review_id", "left")
    says = F.when(_r() % 23 == 5, "SKIP: empty_text.").when(F.col("lines").isNull(), "Zero mentions.").otherwise(F.col("lines"))
    block = F.concat(F.lit("## 1 · review "), "review_id", F.lit("\n- [x] reviewed\n````text\n"), F.coalesce("text", F.lit("")), F.lit("\n````\n"), says, F.lit("\n\n---\n"))
    per = r.groupBy(_sheet().alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_r().alias("r"), block.alias("b")))), lambda x: x["b"]), "").alias("text"))
    return per.select("file", F.concat(F.lit("# A workbook\n\n> how to\n\n"), "text").alias("text"))


def _read(spark, sf_dir):
    return files.sheets(_sheets(spark, sf_dir))


def gold_mint(spark, sf_dir):
    """Gold of every sheet, by app."""
    return workbooks.gold_summary(workbooks.gold_records(_read(spark, sf_dir), _texts(spark, sf_dir)), _pinned(spark, sf_dir), "app_id")


def mint_faults(spark, sf_dir):
    """Skipped reviews and what replaces them: the review after, which may be missing or skipped itself."""
    rows = _read(spark, sf_dir)
    skipped = rows.filter("what = 'skip'").select("review_id", (_r() + F.when(_r() % 2 == 0, 23).otherwise(1)).cast("string").alias("replacement_id"))
    return workbooks.mint_faults(rows, skipped).groupBy("problem").agg(F.count("*").alias("n"))


def _outputs(spark, sf_dir):
    """What an assistant proposed, JSON a batch of reviews: mentions lost, turned and new, and faults."""
    p = _r() + F.col("position")
    m = views.mentions(spark, sf_dir).filter(p % 11 != 3)
    m = m.unionByName(m.filter(p % 17 == 2).withColumn("position", F.col("position") + 100)).withColumn("sentiment", F.when(p % 7 == 1, "mixed").when(p % 97 == 5, "cross").otherwise(F.col("sentiment")))
    m = m.withColumn("evidence", F.when(p % 13 == 4, F.concat("evidence", F.lit(" or so"))).otherwise(F.col("evidence")))
    per = m.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "aspect", "sentiment", "evidence"))), lambda x: F.struct(x["aspect"].alias("aspect"), x["sentiment"].alias("sentiment"), x["evidence"].alias("evidence"))).alias("mentions"))
    one = F.struct(_r().alias("r"), F.col("review_id").alias("id"), F.coalesce("mentions", F.array().cast("array<struct<aspect:string,sentiment:string,evidence:string>>")).alias("mentions"), F.when(_r() % 19 == 4, F.array(F.lit("odd"))).when(_r() % 19 == 5, F.array(F.lit("non_english"))).alias("flags"), F.when(_r() % 29 == 1, "see there").alias("note"))
    r = views.reviews(spark, sf_dir).filter(_r() % 101 != 7).join(per, "review_id", "left")
    b = r.groupBy(F.floor(_r() / 64).alias("batch")).agg(F.array_sort(F.collect_list(one)).alias("annotations"))
    says = F.when(F.col("batch") % 10 == 3, F.col("batch") + 1).otherwise(F.col("batch"))
    body = F.to_json(F.struct(says.alias("batch"), "annotations"))
    return b.select("batch", F.when(F.col("batch") % 25 == 6, F.concat(body, F.lit("}"))).otherwise(body).alias("payload"))


def _inputs(spark, sf_dir):
    return _texts(spark, sf_dir).select(F.floor(_r() / 64).alias("batch"), _r().alias("place"), "review_id", "text")


def assist_problems(spark, sf_dir):
    return workbooks.assist_problems(_inputs(spark, sf_dir), _outputs(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"))


def assist_totals(spark, sf_dir):
    return workbooks.assist_totals(_outputs(spark, sf_dir), _pinned(spark, sf_dir))


def assist_changes(spark, sf_dir):
    """How people's sheets differ from what was proposed for their reviews."""
    rows = _read(spark, sf_dir)
    skipped = rows.filter("what = 'skip'").select("review_id")
    current = rows.filter("what = 'mention'").select("review_id", F.col("line").alias("place"), "aspect", "sentiment", "evidence")
    proposed = workbooks.assist_mentions(_outputs(spark, sf_dir)).join(skipped, "review_id", "left_anti")
    return workbooks.assist_diff(current, proposed).groupBy("outcome").agg(F.count("*").alias("n"))


def _audits(spark, sf_dir):
    """An audit sheet an app, month and range of reviews, of a claim for each first mention."""
    m = views.mentions(spark, sf_dir).filter("position = 1").join(views.reviews(spark, sf_dir).select("review_id", "app_id", "created_at"), "review_id")
    r = _r()
    says = F.when(r % 9 == 2, "SKIP: non_english").when(r % 9 == 3, "- aspect_supported: Yes\n- sentiment_supported: NO").when(r % 9 == 4, "- aspect_supported: maybe\n- sentiment_supported:").when(r % 9 == 5, "SKIP: empty_text.\n- aspect_supported: yes").otherwise("- aspect_supported: yes\n- sentiment_supported: yes\n- note: A fine one")
    block = F.concat(F.lit("## "), r.cast("string"), F.lit(" · a claim\n"), F.when(r % 31 != 6, F.concat(F.lit("review `"), "review_id", F.lit("` · mention `1`\n"))).otherwise(F.lit("")), F.lit("> "), "aspect", F.lit("\n\n"), says, F.when(r % 40 == 7, "\nhm").otherwise(""), F.lit("\n---\n"))
    per = m.groupBy(_sheet().alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(r.alias("r"), block.alias("b")))), lambda x: x["b"]), "").alias("text"))
    return per.select("file", F.concat(F.lit("Preamble\n"), "text").alias("text"))


def audit_sheets(spark, sf_dir):
    """What sheets say, in how many claims and in how many apps' months."""
    rows = workbooks.audit_sheets(_audits(spark, sf_dir)).withColumn("file", F.substring_index("file", "/", 2))
    return rows.groupBy("what", F.coalesce("says", F.concat_ws(" ", "aspect_supported", "sentiment_supported", "note")).alias("says")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def report_columns(spark, sf_dir):
    """Reports' JSON columns written and read back."""
    r = views.reviews(spark, sf_dir)
    h = series.histogram(r).groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("timestamp").alias("start"), "up", "down"))).alias("rollups"))
    lang = r.groupBy("app_id", "language").agg(F.count("*").alias("count")).groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("language", "count"))).alias("language_mix"))
    none = F.array()
    reports = h.join(lang, "app_id").select(
        "app_id", F.struct("app_id", F.lit("month").alias("rollup_unit"), "rollups", none.alias("recent_daily"), none.alias("past_events"), F.get("rollups", 0)["start"].alias("fetched_at")).alias("histogram"), "language_mix",
        F.transform("rollups", lambda b: F.struct(b["start"].alias("start"), b["start"].alias("end"), (b["up"] + b["down"]).alias("members_inside"))).alias("marked_windows"),
    )
    back = columns.decode_report(columns.encode_report(reports))
    sums = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x[f])
    return back.select(
        "app_id", F.size("histogram.rollups").cast("long").alias("months"), sums("histogram.rollups", "up").alias("up"), F.col("histogram.fetched_at").cast("timestamp_ntz").alias("first"), sums("marked_windows", "members_inside").alias("members"),
        F.array_join(F.transform("language_mix", lambda x: F.concat_ws(":", x["language"], x["count"].cast("string"))), ",").alias("languages"),
    )


def aspect_yield(spark, sf_dir):
    m = views.mentions(spark, sf_dir).filter("slot = 'pinned'").join(views.envelopes(spark, sf_dir).filter(on_version()).select("review_id", "app_id"), "review_id")
    sizes = views.envelopes(spark, sf_dir).groupBy("app_id").agg(F.count_if(on_version()).alias("sample_size"))
    return scopes.aspect_yield(sizes, m)


def probe_summary(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    calls = e.select("event_type", F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 50 == 9, 429).otherwise(200).alias("status"), (F.col("event_id") * 37 % 1009).cast("long").alias("elapsed_ms"))
    return scopes.probe_summary(calls, "event_type")


def canary_surfaces(spark, sf_dir):
    c = views.table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "both").when(F.col("item_id") % 3 == 1, "label").otherwise("compose").alias("surface"))
    return scopes.for_surface(c, "compose").groupBy("surface").agg(F.count("*").alias("n"), F.sum("item_id").cast("long").alias("ids"))


def planned_totals(spark, sf_dir):
    h = series.histogram(views.reviews(spark, sf_dir)).select(F.col("app_id").alias("plan_id"), (F.col("up") % 7).alias("quota"))
    plans = views.reviews(spark, sf_dir).groupBy(F.col("app_id").alias("plan_id")).agg(F.count("*").alias("target")).withColumn("kind", F.when(F.col("plan_id") % 3 == 1, "cursor-prefix").otherwise("time-proportional"))
    return scopes.planned_totals(plans, h)


def run_ids(spark, sf_dir):
    r = views.reviews(spark, sf_dir)
    return r.groupBy("app_id").agg(F.max(scopes.run_id(F.lit("label"), F.col("created_at"), F.col("review_id"))).alias("newest"))


def manifest_repairs(spark, sf_dir):
    runs = views.envelopes(spark, sf_dir).groupBy("app_id", "ontology_version").agg(F.count("*").alias("labeled"), F.count_if(_r() % 21 == 2).alias("evidence_repairs"))
    body = F.to_json(F.struct(F.struct("labeled", F.when(F.col("app_id") != 4, F.col("evidence_repairs")).alias("evidence_repairs")).alias("reviews")))
    return scopes.manifest_repairs(runs.select(F.when(F.col("app_id") == 5, "{}").otherwise(body).alias("manifest")))


def scope_faults(spark, sf_dir):
    """A sample and gold against stored texts, some of which have changed or gone."""
    t = _texts(spark, sf_dir)
    stored = t.filter(_r() % 53 != 4).withColumn("text", F.when(_r() % 31 == 6, F.concat("text", F.lit("!"))).otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))))
    sample = t.filter(_r() % 5 == 1).select("review_id", F.sha2(F.concat(F.lit(" "), "text", F.lit("\n")), 256).alias("text_sha256"))
    gold = t.filter((_r() % 5 == 2) & ~F.col("app_id").isin(3)).select("review_id", "text")
    both = scopes.scope_faults(sample, stored, "sample").withColumn("scope", F.lit("sample")).unionByName(scopes.scope_faults(gold, stored, "gold").withColumn("scope", F.lit("gold")))
    return both.groupBy("scope", "fault").agg(F.count("*").alias("n"))


def eligible_draw(spark, sf_dir):
    t = _texts(spark, sf_dir).join(views.reviews(spark, sf_dir).select("review_id", "language"), "review_id")
    return scopes.eligible_draw(t, views.reviews(spark, sf_dir).filter(_r() % 6 == 1), 25, "dry", 30, 160)


def pool_gap(spark, sf_dir):
    """What two runs read of the same gold: the stored pool, and a capture in which one review in 20 failed."""
    from hearsay.plans import certify as c

    asked = c._asked(spark, sf_dir).filter("app_id <> 3")
    gold = c._gold(spark, sf_dir).join(asked.select("review_id"), "review_id")
    capture = asked.withColumn("outcome", F.when(_r() % 20 == 8, "failed").otherwise("read"))
    ok = capture.filter("outcome = 'read'").select("review_id")
    rows = certify.tallies(asked.withColumn("outcome", F.lit("read")), gold, c._predicted(spark, sf_dir, 7).join(asked.select("review_id"), "review_id")).withColumn("run", F.lit("pool"))
    rows = rows.unionByName(certify.tallies(capture, gold, c._predicted(spark, sf_dir, 5).join(ok, "review_id")).withColumn("run", F.lit("capture")))
    return certify.score(rows, "run").select("run", "tp", "fp", "fn", "parse_failed", "precision", "recall", "f1")


def report_view(spark, sf_dir):
    """A page an app: its sample, aspects by reviews, candidates, and how many lie in each band."""
    m = mint(spark, sf_dir)
    one = F.struct((-F.col("n_reviews")).alias("k"), "aspect", "n_reviews")
    top = lambda slot: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("slot") == slot, one))), 1, 5), lambda x: F.concat_ws(":", x["aspect"], x["n_reviews"].cast("string"))), ",")
    band = lambda b: F.count_if((F.col("slot") == "pinned") & (F.col("band") == b)).alias(b)
    return m.groupBy("app_id").agg(F.max("sample_size").alias("sample_size"), top("pinned").alias("aspects"), top("candidate").alias("candidates"), *map(band, ("headline", "mid", "tail")))


QUERIES = {f.__name__: f for f in (
    gold_mint, mint_faults, assist_problems, assist_totals, assist_changes, audit_sheets, report_columns, aspect_yield, probe_summary, canary_surfaces, planned_totals, run_ids, manifest_repairs, scope_faults, eligible_draw, pool_gap, report_view,
)}

BASE = f"WITH {REVIEWS_SQL}, {ENVELOPES_SQL}, {MENTIONS_SQL}, {MONTHS_SQL}, v AS (SELECT *, review_id::BIGINT AS r FROM reviews), tx AS (SELECT v.*, coalesce(t, '') AS text FROM v LEFT JOIN (SELECT review_id, string_agg(evidence, chr(10) ORDER BY evidence) AS t FROM mentions GROUP BY 1) USING (review_id))"
PROPOSED = f"""{BASE}, m0 AS (SELECT *, review_id::BIGINT AS r, review_id::BIGINT + position AS p FROM mentions), m1 AS (SELECT * FROM m0 WHERE p % 11 <> 3 UNION ALL SELECT * REPLACE (p + 100 AS p) FROM m0 WHERE p % 11 <> 3 AND p % 17 = 2),
ba AS (SELECT r, r // 64 AS batch FROM v WHERE r % 101 <> 7), rd AS (SELECT *, batch % 25 = 6 AS broken FROM ba),
pm AS (SELECT m1.review_id, m1.r, batch, aspect, CASE WHEN p % 7 = 1 THEN 'mixed' WHEN p % 97 = 5 THEN 'cross' ELSE sentiment END AS sentiment, CASE WHEN p % 13 = 4 THEN evidence || ' or so' ELSE evidence END AS evidence FROM m1 JOIN rd USING (r) WHERE NOT broken)"""
ORACLE = {
    "gold_mint": f"""{BASE}, k AS (SELECT * FROM v WHERE r % 23 <> 5), n AS (SELECT k.app_id, k.review_id, count(aspect) AS n, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'negative') AS g, count(*) FILTER (sentiment = 'mixed') AS x, count(*) FILTER (sentiment = 'neutral') AS u FROM k LEFT JOIN mentions USING (review_id) GROUP BY 1, 2)
      SELECT n.app_id, count(*) AS records, sum(n)::BIGINT AS mentions, count(*) FILTER (n = 0) AS zero, round(count(*) FILTER (n = 0) / count(*)::DOUBLE, 3) AS zero_share, sum(p)::BIGINT AS positive, sum(g)::BIGINT AS negative, sum(x)::BIGINT AS mixed, sum(u)::BIGINT AS neutral,
      any_value(c) AS candidates FROM n LEFT JOIN (SELECT k.app_id, count(DISTINCT aspect) AS c FROM k JOIN mentions USING (review_id) WHERE slot = 'candidate' GROUP BY 1) q USING (app_id) GROUP BY 1""",
    "mint_faults": f"""{BASE}, s AS (SELECT r, r + CASE WHEN r % 2 = 0 THEN 23 ELSE 1 END AS o FROM v WHERE r % 23 = 5), w AS (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE v.r = o) THEN 'replacement is missing' WHEN o % 23 = 5 THEN 'replacement is skipped' END AS problem FROM s) SELECT problem, count(*) AS n FROM w WHERE problem IS NOT NULL GROUP BY 1""",
    "assist_problems": f"""{PROPOSED}, b AS (SELECT r // 64 AS batch, r % 101 = 7 AS lost, count(*) OVER (PARTITION BY r // 64) - count(*) FILTER (r % 101 = 7) OVER (PARTITION BY r // 64) AS n FROM v), q AS (
      SELECT 'unreadable output' AS problem, count(DISTINCT batch) AS n FROM rd WHERE broken UNION ALL SELECT 'no output', count(DISTINCT batch) FROM b WHERE n = 0 UNION ALL SELECT 'batch field differs', count(DISTINCT batch) FROM rd WHERE NOT broken AND batch % 10 = 3
      UNION ALL SELECT 'missing', count(*) FROM b WHERE lost AND n > 0 AND batch % 25 <> 6 UNION ALL SELECT 'unknown flag', count(*) FROM rd WHERE NOT broken AND r % 19 = 4 UNION ALL SELECT 'bad sentiment', count(*) FROM pm WHERE sentiment = 'cross'
      UNION ALL SELECT 'evidence is not in the text', count(*) FROM pm JOIN tx USING (review_id) WHERE NOT contains(text, evidence) UNION ALL SELECT 'out of order', count(*) FROM (SELECT batch, bool_or(r <> x) AS moved, bool_or(r % 101 = 7) AS l FROM (SELECT r, r // 64 AS batch, row_number() OVER (PARTITION BY r // 64 ORDER BY r) - 1 AS x FROM v) GROUP BY 1) WHERE moved AND NOT l AND batch % 25 <> 6)
      SELECT * FROM q WHERE n > 0""",
    "assist_totals": f"""{PROPOSED}, t AS (SELECT batch, count(*) AS mentions, count(DISTINCT r) AS bearing, count(*) FILTER (aspect NOT IN (SELECT aspect FROM mentions WHERE slot = 'pinned')) AS candidates FROM pm GROUP BY 1)
      SELECT rd.batch, count(*) AS reviews, coalesce(any_value(mentions), 0) AS mentions, count(*) - coalesce(any_value(bearing), 0) AS zero, count(*) FILTER (r % 19 IN (4, 5)) AS flags, count(*) FILTER (r % 29 = 1) AS notes, coalesce(any_value(candidates), 0) AS candidates FROM rd LEFT JOIN t USING (batch) WHERE NOT broken GROUP BY 1""",
    "assist_changes": f"""{PROPOSED}, c AS (SELECT review_id, aspect, sentiment, evidence, 1 AS ours FROM mentions WHERE review_id::BIGINT % 23 <> 5 UNION ALL SELECT review_id, aspect, sentiment, evidence, 0 FROM pm WHERE r % 23 <> 5),
      e AS (SELECT review_id, aspect, sum(ours) AS a, sum(1 - ours) AS b, least(sum(ours), sum(1 - ours)) AS s FROM c GROUP BY review_id, aspect, sentiment, evidence), f AS (SELECT sum(s) AS s, sum(a - s) AS a, sum(b - s) AS b FROM e GROUP BY review_id, aspect)
      SELECT unnest(['accepted', 'modified', 'added', 'deleted']) AS outcome, unnest([sum(s), sum(least(a, b)), sum(greatest(a - b, 0)), sum(greatest(b - a, 0))])::BIGINT AS n FROM f""",
    "audit_sheets": f"""{BASE}, c AS (SELECT r, r % 9 AS k, r % 31 = 6 AS bare, r % 40 = 7 AS odd, app_id || '/' || strftime(created_at, '%Y-%m') AS file FROM v JOIN (SELECT review_id FROM mentions WHERE position = 1) USING (review_id)), o AS (
      SELECT file, 'skip' AS what, 'non_english' AS says FROM c WHERE k = 2 UNION ALL SELECT file, 'problem', 'skipped but carries verdicts' FROM c WHERE k = 5 UNION ALL SELECT file, 'problem', 'no id line' FROM c WHERE bare AND k NOT IN (2, 5)
      UNION ALL SELECT file, 'claim', 'yes no' FROM c WHERE k = 3 AND NOT bare UNION ALL SELECT file, 'problem', unnest(['bad verdict aspect_supported: maybe', 'unfilled verdict sentiment_supported']) FROM c WHERE k = 4 AND NOT bare
      UNION ALL SELECT file, 'claim', 'yes yes A fine one' FROM c WHERE k NOT IN (2, 3, 4, 5) AND NOT bare UNION ALL SELECT file, 'problem', 'unparseable line: hm' FROM c WHERE odd) SELECT what, says, count(*) AS n, count(DISTINCT file) AS files FROM o GROUP BY 1, 2""",
    "report_columns": f"""{BASE}, l AS (SELECT app_id, string_agg(language || ':' || n, ',' ORDER BY language) AS languages FROM (SELECT app_id, language, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1)
      SELECT v.app_id, any_value(h.n) AS months, count(*) FILTER (voted_up) AS up, date_trunc('month', min(created_at))::TIMESTAMP AS first, count(*) AS members, any_value(languages) AS languages FROM v JOIN l USING (app_id) JOIN (SELECT app_id, count(*) AS n FROM months GROUP BY 1) h USING (app_id) GROUP BY 1""",
    "aspect_yield": f"""{BASE}, y AS (SELECT e.app_id, count(DISTINCT e.review_id) AS sample_size, count(DISTINCT m.review_id) AS aspect_bearing FROM (SELECT * FROM envelopes WHERE {SCOPE}) e LEFT JOIN (SELECT review_id FROM mentions WHERE slot = 'pinned') m USING (review_id) GROUP BY 1)
      SELECT *, aspect_bearing / sample_size::DOUBLE AS share, format('{{:,}} of {{:,}} analyzed reviews carry at least one aspect', aspect_bearing, sample_size) AS phrase FROM y""",
    "probe_summary": """WITH c AS (SELECT event_type, event_id, event_id * 37 % 1009 AS ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id * 37 % 1009) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
      SELECT event_type, count(*) AS sent, count(*) FILTER (event_id % 50 <> 9) AS ok, min(event_id) FILTER (event_id % 50 = 9) AS first_bad, min(ms) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, min(ms) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, max(ms) AS most FROM c GROUP BY 1""",
    "canary_surfaces": "SELECT CASE WHEN item_id % 3 = 0 THEN 'both' ELSE 'compose' END AS surface, count(*) AS n, sum(item_id)::BIGINT AS ids FROM benchmark WHERE item_id % 3 <> 1 GROUP BY 1",
    "planned_totals": f"{BASE} SELECT app_id AS plan_id, CASE WHEN app_id % 3 = 1 THEN sum(up + down) ELSE sum(up % 7) END::BIGINT AS planned FROM months GROUP BY 1",
    "run_ids": f"{BASE} SELECT app_id, max('label-' || strftime(created_at, '%Y%m%dT%H%M%SZ') || '-' || sha256(review_id)[:8]) AS newest FROM v GROUP BY 1",
    "manifest_repairs": f"{BASE} SELECT count(*) AS labeled, count(*) FILTER (app_id <> 4 AND r % 21 = 2) AS repairs, count(*) FILTER (app_id <> 4 AND r % 21 = 2) / count(*)::DOUBLE AS rate FROM v WHERE app_id <> 5",
    "scope_faults": f"{BASE}, f AS (SELECT CASE r % 5 WHEN 1 THEN 'sample' ELSE 'gold' END AS scope, CASE WHEN r % 53 = 4 THEN 'not stored' WHEN r % 31 = 6 THEN 'another text' END AS fault FROM v WHERE r % 5 = 1 OR r % 5 = 2 AND app_id <> 3) SELECT scope, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2",
    "eligible_draw": f"{BASE}, d AS (SELECT app_id, review_id, row_number() OVER (PARTITION BY app_id ORDER BY md5('dry|' || review_id), review_id) AS rank FROM tx WHERE language = 'english' AND length(trim(text)) BETWEEN 30 AND 160 AND r % 6 <> 1) SELECT * FROM d WHERE rank <= 25",
    "pool_gap": f"""{BASE}, q AS (SELECT review_id, aspect, min(sentiment) AS s, review_id::BIGINT + length(aspect) AS k FROM mentions JOIN v USING (review_id) WHERE r % 4 = 0 AND app_id <> 3 AND slot = 'pinned' GROUP BY 1, 2), z AS (SELECT 'pool' AS run, k % 8 <> 0 AS g, k % 7 <> 0 AS p FROM q UNION ALL SELECT 'capture', k % 8 <> 0, k % 5 <> 0 AND review_id::BIGINT % 20 <> 8 FROM q),
      c AS (SELECT run, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM z GROUP BY 1) SELECT *, CASE WHEN run = 'pool' THEN 0 ELSE (SELECT count(*) FROM v WHERE r % 4 = 0 AND app_id <> 3 AND r % 20 = 8) END AS parse_failed, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM c""",
    "report_view": f"""WITH m AS ({MINT_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY app_id, slot ORDER BY n_reviews DESC, aspect) AS i FROM m) SELECT app_id, max(sample_size) AS sample_size, coalesce(string_agg(aspect || ':' || n_reviews, ',' ORDER BY i) FILTER (slot = 'pinned' AND i <= 5), '') AS aspects, coalesce(string_agg(aspect || ':' || n_reviews, ',' ORDER BY i) FILTER (slot = 'candidate' AND i <= 5), '') AS candidates,
      count(*) FILTER (slot = 'pinned' AND band = 'headline') AS headline, count(*) FILTER (slot = 'pinned' AND band = 'mid') AS mid, count(*) FILTER (slot = 'pinned' AND band = 'tail') AS tail FROM k GROUP BY 1""",
}
