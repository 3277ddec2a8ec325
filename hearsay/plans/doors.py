"""Queries at write doors, over payloads made from reviews, and over requests and walks made from events and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import doors, series
from hearsay.plans.marts import MINT_SQL, SCOPE
from hearsay.plans.series import MONTHS_SQL
from hearsay.sources import files, payloads
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL


def _r():
    return F.col("review_id").cast("long")


def insert_faults(spark, sf_dir):
    """Envelopes of one review in three are stored; others come, some of them stored, twice, or without a review."""
    e = views.envelopes(spark, sf_dir).select("review_id", "app_id")
    stored = e.filter(_r() % 3 == 0)
    arriving = e.filter((_r() % 3 == 1) | (_r() % 30 == 0)).unionByName(e.filter(_r() % 37 == 1))
    arriving = arriving.withColumn("review_id", F.when(_r() % 41 == 2, F.concat(F.lit("x"), "review_id")).otherwise(F.col("review_id")))
    return doors.insert_faults(stored, arriving, ["review_id"], e, "review_id").groupBy("fault").agg(F.count("*").alias("n"))


def archive_puts(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("body"))
    stored = d.filter("key % 2 = 0")
    arriving = d.withColumn("body", F.when(F.col("key") % 14 == 4, F.lit("other")).otherwise(F.col("body"))).unionByName(d.filter("key % 9 = 1")).unionByName(d.filter("key % 25 = 3").withColumn("body", F.lit("third")))
    return doors.put_archive(stored, arriving).groupBy("outcome").agg(F.count("*").alias("n"))


def settlements(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    jobs = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("job_id"), (F.col("event_id") % 12 == 0).alias("settled"))
    s = e.filter("event_id % 6 = 0 OR event_id % 35 = 1").select(F.col("event_id").alias("job_id"))
    return doors.settled(jobs, s.unionByName(s.filter("job_id % 42 = 0"))).groupBy("fault").agg(F.count("*").alias("n"))


def report_faults(spark, sf_dir):
    """A report for each app from its mint, with members lost and counts raised on purpose."""
    from hearsay.operators.aggregates import on_version
    from hearsay.plans.marts import mint

    m = mint(spark, sf_dir)
    reports = m.select(F.col("app_id").alias("report_id"), "app_id", "sample_size").distinct()
    aspects = m.select(F.col("app_id").alias("report_id"), F.when((F.col("app_id") == 4) & (F.col("slot") == "candidate"), 5).otherwise(F.col("app_id")).alias("app_id"), (F.col("n_reviews") + F.when(F.col("app_id") == 6, 10**6).otherwise(0)).alias("n_reviews"))
    members = views.envelopes(spark, sf_dir).filter(on_version()).filter("app_id <> 7 OR CAST(review_id AS BIGINT) % 2 = 0").select(F.col("app_id").alias("report_id"), "review_id")
    return doors.report_faults(reports, aspects, members)


def stored_spans(spark, sf_dir):
    """Spans of narratives against the narratives as they are stored, one in five of which has been changed since."""
    from hearsay.plans.prose import judged

    prose, spans = judged(spark, sf_dir)
    changed = prose.withColumn("text", F.when(F.length("id") % 5 == 1, F.concat(F.lit("  "), "text")).otherwise(F.col("text")))
    faults = doors.span_faults(changed, spans.filter("reason IS NULL"), "id")
    return spans.filter("reason IS NULL").groupBy("id").agg(F.count("*").alias("spans")).join(faults.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", "spans", F.coalesce("n", F.lit(0)).alias("faults"))


def run_metrics(spark, sf_dir):
    """Daily metrics as rows, gathered again, and read: one JSON a day."""
    e = views.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"))
    runs = e.agg(F.struct(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users")).alias("metrics"))
    back = doors.gathered_metrics(doors.long_metrics(runs)).withColumn("m", F.from_json("metrics", "map<string,double>"))
    return back.select("run_id", F.col("m.calls").alias("calls"), F.col("m.errors").alias("errors"), F.col("m.users").alias("users"))


def config_fingerprints(spark, sf_dir):
    """Digests of version triples, and how many envelopes stand under each."""
    e = views.envelopes(spark, sf_dir).groupBy("origin", "model_version", "prompt_version", "ontology_version").agg(F.count("*").alias("n"))
    return doors.fingerprint(e.drop("n").withColumn("k", F.concat_ws("/", "origin", "ontology_version")), ["k"])


def label_regrouping(spark, sf_dir):
    apps = views.reviews(spark, sf_dir).filter(_r() % 50 != 9).select("review_id", "app_id")
    return doors.regrouped(views.mentions(spark, sf_dir).filter("slot = 'pinned'"), apps)


def _pages(spark, sf_dir):
    """Review pages as a store would send them: one JSON an app and month."""
    r = views.reviews(spark, sf_dir).withColumn("m", F.date_format("created_at", "yyyy-MM"))
    one = F.struct(F.col("review_id").alias("recommendationid"), "language", F.col("review_id").alias("review"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("timestamp_created"), "voted_up")
    p = r.groupBy("app_id", "m").agg(F.array_sort(F.collect_list(one)).alias("reviews"))
    body = F.to_json(F.struct(F.lit(1).alias("success"), F.col("m").alias("cursor"), F.struct(F.size("reviews").alias("total_reviews")).alias("query_summary"), "reviews"))
    return p.select("app_id", F.when(F.substring("m", 6, 2) == "07", F.lit('{"success": 2, "query_summary": {"num_reviews": 0}}')).otherwise(body).alias("payload"))


def review_pages(spark, sf_dir):
    p = payloads.review_pages(_pages(spark, sf_dir))
    return p.groupBy("app_id", "success").agg(F.count("*").alias("pages"), F.sum("total_reviews").alias("claimed"), F.sum(F.size("reviews")).alias("reviews"), F.sum(F.size(F.filter("reviews", lambda x: x["voted_up"]))).alias("up"), F.max(F.array_max(F.transform("reviews", lambda x: x["created_at"]))).cast("timestamp_ntz").alias("newest"))


def histogram_payloads(spark, sf_dir):
    """Histograms of both shapes, read back into one."""
    h = series.histogram(views.reviews(spark, sf_dir))
    wire = F.struct(F.unix_seconds(F.col("start").cast("timestamp")).alias("date"), F.col("up").alias("recommendations_up"), F.col("down").alias("recommendations_down"))
    a = h.filter("app_id % 2 = 0").groupBy("app_id").agg(F.array_sort(F.collect_list(wire)).alias("rollups"))
    a = a.select("app_id", F.to_json(F.struct(F.lit(1).alias("success"), F.struct(F.lit("month").alias("rollup_type"), "rollups", F.slice("rollups", 1, 2).alias("recent")).alias("results"))).alias("payload"))
    b = h.filter("app_id % 2 = 1").groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("start", "up", "down"))).alias("rollups"))
    b = b.select("app_id", F.to_json(F.struct(F.lit("month").alias("rollup_unit"), "rollups")).alias("payload"))
    return payloads.any_histograms(a.unionByName(b)).select("app_id", "unit", F.inline("rollups"))


def store_search(spark, sf_dir):
    """Search answers made from parts: apps and bundles; and details, of which some apps have none."""
    p = views.table(spark, sf_dir, "part").withColumn("app_id", F.col("p_partkey") % 10)
    item = F.struct(F.when(F.col("p_size") > 10, "app").otherwise("sub").alias("type"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("i.png").alias("tiny_image"))
    answers = p.groupBy("app_id").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))
    hits = payloads.search_hits(answers).groupBy("app_id").agg(F.count("*").alias("hits"), F.sum("hit_id").alias("ids"))
    entry = F.when(F.col("app_id") % 4 == 3, F.lit('{"success": false}')).otherwise(F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.concat(F.lit("game "), F.col("app_id").cast("string")).alias("name"), F.lit("").alias("header_image")).alias("data"))))
    details = payloads.app_details(p.select("app_id").distinct().select("app_id", F.concat(F.lit('{"'), F.col("app_id").cast("string"), F.lit('": '), entry, F.lit("}")).alias("payload")))
    return hits.join(details, "app_id", "left")


def provider_replies(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    why = F.when(F.col("event_id") % 3 == 0, "STOP").when(F.col("event_id") % 3 == 1, "MAX_TOKENS").otherwise("SAFETY")
    a = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("event_type").alias("text"))).alias("parts")).alias("content"), why.alias("finishReason"))).alias("candidates")))
    b = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("message"), F.when(F.col("event_id") % 3 == 0, "stop").when(F.col("event_id") % 3 == 1, "length").otherwise("content_filter").alias("finish_reason"))).alias("choices")))
    r = payloads.provider_replies(e.select("event_id", F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("payload")))
    return r.groupBy("text", "finish").agg(F.count("*").alias("n"))


def record_faults(spark, sf_dir):
    """Faults of labels as records: twice, without a key, of no such kind."""
    l = views.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 11 == 2, "angry").otherwise("neutral").alias("sentiment"), F.when(F.col("doc_id") % 13 == 5, " ").otherwise("x").alias("note"))
    l = l.unionByName(l.filter("doc_id % 17 = 1"))
    return files.checked(l, "doc_id", {"sentiment": files.SENTIMENTS}, ("note",)).groupBy("problem").agg(F.count("*").alias("n"))


def label_sheets(spark, sf_dir):
    """A sheet for each source and range of 1,000 document numbers, rendered and read back; its faults against the documents."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("text of "), F.col("doc_id").cast("string")).alias("text"))
    k = F.col("doc_id")
    says = (
        F.when(k % 5 == 0, F.lit("Zero mentions.")).when(k % 5 == 1, F.lit("SKIP: empty_text")).when(k % 5 == 2, F.concat(F.lit('- story / positive / "text of '), k.cast("string"), F.lit('"\n- pace / mixed / (no span)')))
        .when(k % 5 == 3, F.lit('- story / angry / "not there"')).otherwise(F.lit("Zero mentions.\n- combat / mixed"))
    )
    block = F.concat(F.lit("## 1 · review "), k.cast("string"), F.when(k % 15 == 4, F.lit("\n- [ ] reviewed")).otherwise(F.lit("\n- [x] reviewed")), F.lit("\n````text\n## 2 · review 99\n"), "text", F.lit("\n````\n"), says, F.when(k % 20 == 7, F.lit("\nhm")).otherwise(""))
    file = F.concat_ws("/", "source", F.floor(k / 1000).cast("string"))
    sheets = d.groupBy(file.alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    rows = files.sheets(sheets.select("file", F.concat(F.lit("A preamble.\n"), "text").alias("text")))
    faults = files.sheet_problems(rows, d.select(k.cast("string").alias("review_id"), "text"))
    return faults.groupBy("problem").agg(F.count("*").alias("n"))


BASE = f"WITH {REVIEWS_SQL}, {ENVELOPES_SQL}, {MENTIONS_SQL}, {MONTHS_SQL}, v AS (SELECT review_id, app_id, CAST(review_id AS BIGINT) AS r FROM reviews)"
QUERIES = {
    "insert_faults": insert_faults, "archive_puts": archive_puts, "settlement_faults": settlements, "report_faults": report_faults, "stored_spans": stored_spans, "run_metrics": run_metrics, "config_fingerprints": config_fingerprints,
    "label_regrouping": label_regrouping, "review_pages": review_pages, "histogram_payloads": histogram_payloads, "store_search": store_search,
    "provider_replies": provider_replies, "record_faults": record_faults, "label_sheets": label_sheets,
}
ORACLE = {
    "insert_faults": f"""{BASE}, a AS (SELECT * FROM v WHERE r % 3 = 1 OR r % 30 = 0 UNION ALL SELECT * FROM v WHERE r % 37 = 1), f AS (SELECT CASE WHEN r % 41 = 2 THEN CASE WHEN count(*) OVER (PARTITION BY r) > 1 THEN 'comes twice' ELSE 'no parent' END WHEN r % 3 = 0 THEN 'stored already' WHEN count(*) OVER (PARTITION BY r) > 1 THEN 'comes twice' END AS fault FROM a)
        SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1""",
    "archive_puts": """SELECT CASE WHEN doc_id % 25 = 3 THEN 'conflict' WHEN doc_id % 14 = 4 AND doc_id % 9 = 1 THEN 'conflict' WHEN doc_id % 2 = 1 THEN 'new' WHEN doc_id % 14 = 4 THEN 'conflict' ELSE 'same' END AS outcome, count(*) AS n FROM documents GROUP BY 1""",
    "settlement_faults": """WITH s AS (SELECT event_id AS j FROM events WHERE event_id % 6 = 0 OR event_id % 35 = 1) SELECT CASE WHEN j % 3 <> 0 THEN 'no such job' WHEN j % 12 = 0 THEN 'settled already' WHEN j % 42 = 0 THEN 'settled twice' END AS fault, count(*) AS n FROM s WHERE j % 3 <> 0 OR j % 12 = 0 OR j % 42 = 0 GROUP BY 1""",
    "report_faults": f"""{BASE}, m AS ({MINT_SQL}), s AS (SELECT app_id, any_value(sample_size) AS size FROM m GROUP BY 1), k AS (SELECT app_id, count(*) FILTER (app_id <> 7 OR review_id::BIGINT % 2 = 0) AS members FROM envelopes WHERE {SCOPE} GROUP BY 1),
        a AS (SELECT app_id AS report_id, CASE WHEN app_id = 4 AND slot = 'candidate' THEN 5 ELSE app_id END AS app_id, n_reviews + CASE WHEN app_id = 6 THEN 1000000 ELSE 0 END AS n_reviews FROM m)
        SELECT s.app_id AS report_id, 'sample is not the members' AS fault FROM s LEFT JOIN k USING (app_id) WHERE size <> coalesce(members, 0)
        UNION SELECT report_id, 'aspect of another app' FROM a WHERE report_id <> app_id UNION SELECT report_id, 'more reviews than the sample' FROM a JOIN s ON s.app_id = report_id WHERE n_reviews > size""",
    "run_metrics": "SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*)::DOUBLE AS calls, (count(*) FILTER (event_type = 'error'))::DOUBLE AS errors, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY 1",
    "config_fingerprints": f"""{BASE} SELECT DISTINCT origin || '/' || ontology_version AS k, sha256('{{"model_version":"' || model_version || '","ontology_version":"' || ontology_version || '","origin":"' || origin || '","prompt_version":"' || prompt_version || '"}}') AS digest FROM envelopes""",
    "label_regrouping": f"{BASE} SELECT CASE WHEN r % 50 <> 9 THEN app_id END AS app_id, aspect, count(DISTINCT review_id) AS n FROM mentions JOIN v USING (review_id) WHERE slot = 'pinned' GROUP BY 1, 2",
    "review_pages": f"""{BASE}, p AS (SELECT app_id, strftime(created_at, '%m') = '07' AS gone, count(*) AS n, count(*) FILTER (voted_up) AS up, max(created_at) AS newest FROM reviews GROUP BY app_id, strftime(created_at, '%Y-%m'), 2)
        SELECT app_id, CASE WHEN gone THEN 2 ELSE 1 END::BIGINT AS success, count(*) AS pages, CASE WHEN NOT gone THEN sum(n) END::BIGINT AS claimed, (CASE WHEN gone THEN 0 ELSE sum(n) END)::BIGINT AS reviews, (CASE WHEN gone THEN 0 ELSE sum(up) END)::BIGINT AS up, CASE WHEN NOT gone THEN max(newest) END AS newest FROM p GROUP BY app_id, gone""",
    "histogram_payloads": f"{BASE} SELECT app_id, 'month' AS unit, start, up, down FROM months",
    "store_search": """SELECT p_partkey % 10 AS app_id, count(*) FILTER (p_size > 10) AS hits, (sum(p_partkey) FILTER (p_size > 10))::BIGINT AS ids, CASE WHEN (p_partkey % 10) % 4 <> 3 THEN 'game ' || (p_partkey % 10) END AS name, NULL::VARCHAR AS header_image FROM part GROUP BY p_partkey % 10""",
    "provider_replies": "SELECT event_type AS text, CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' ELSE 'blocked' END AS finish, count(*) AS n FROM events GROUP BY 1, 2",
    "record_faults": """WITH l AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 17 = 1) SELECT 'sentiment is not allowed' AS problem, count(*) AS n FROM l WHERE doc_id % 11 = 2 GROUP BY 1 UNION ALL SELECT 'note is empty', count(*) FROM l WHERE doc_id % 13 = 5 HAVING count(*) > 0
        UNION ALL SELECT 'key twice', count(*) FROM (SELECT doc_id FROM l GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""",
    "label_sheets": """SELECT unnest(['cannot be read: malformed mention line: - combat / mixed', 'no such sentiment', 'evidence is not in the text', 'cannot be read: hm', 'not reviewed']) AS problem, unnest([count(*) FILTER (doc_id % 5 = 4), count(*) FILTER (doc_id % 5 = 3), count(*) FILTER (doc_id % 5 = 3), count(*) FILTER (doc_id % 20 = 7), count(*) FILTER (doc_id % 15 = 4)]) AS n FROM documents""",
}
