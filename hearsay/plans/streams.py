"""Queries that run a finished table through a stream, and the batch forms of streams."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import logs
from hearsay.operators.selection import numbered
from hearsay.sources import pages
from hearsay.streaming import metrics, ordered, passes, runs
from hearsay.views import MENTIONS_SQL, REVIEWS_SQL


def requests(spark, sf_dir):
    """A job request for each event: 40 visitors, an hour a job, what it costs by its value."""
    e = views.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 40).cast("string").alias("visitor"), F.col("ts").cast("timestamp").alias("at"),
        F.lit(3600.0).alias("seconds"), (F.col("value") / 1500).alias("cost"),
    )


def admission_gate(spark, sf_dir):
    """Requests through the guards: visitors first, each day's pool over what they are let through to."""
    asked = requests(spark, sf_dir)
    at = runs.folder(spark, "gate")
    own = ordered.visitor_verdicts(runs.replayed(asked, {"request_id": -1, "visitor": "tick", "seconds": 0.0}))
    verdicts = runs.to_table(own, f"{at}/verdicts", f"{at}/c1")
    free = verdicts.filter("verdict = 'free'").join(asked.select("request_id", "cost"), "request_id").select("request_id", "day", "at", "cost")
    closings = runs.to_table(ordered.pool_closings(runs.replayed(free, {"request_id": -1, "day": "tick", "cost": 0.0})), f"{at}/closings", f"{at}/c2")
    return ordered.admitted(verdicts, closings).select("request_id", "day", "outcome")


def live_attach(spark, sf_dir):
    """Requests of a user join the job that runs, of ten hours, or start one."""
    e = views.table(spark, sf_dir, "events")
    asked = e.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("app_id"), F.col("ts").cast("timestamp").alias("at"), F.lit(36_000.0).alias("seconds"))
    at = runs.folder(spark, "attach")
    stream = ordered.attachments(runs.replayed(asked, {"request_id": -1, "app_id": "tick", "seconds": 0.0}))
    return runs.to_table(stream, f"{at}/jobs", f"{at}/c").groupBy("job").agg(F.count("*").alias("n"))


def job_log(spark, sf_dir):
    """A log of each user: their events in order, the last of which settles it; one index in 50 is lost."""
    e = views.table(spark, sf_dir, "events").withColumn("job_id", F.col("user_id").cast("string"))
    n = e.withColumns({
        "index": F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1").cast("long"),
        "last": F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    })
    return n.filter("last OR event_id % 50 <> 7").select("job_id", "index", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("last"), "end").otherwise(F.col("event_type")).alias("event"), F.col("event_id").cast("string").alias("data"))


def event_frames(spark, sf_dir):
    """Frames of each user's log, with a heartbeat after three hours of silence."""
    f = logs.frames(job_log(spark, sf_dir), 3 * 3600)
    return f.groupBy("job_id", "event").agg(F.count("*").alias("n"), F.min("place").cast("long").alias("first_place"), F.max("place").cast("long").alias("last_place"), F.max("id").alias("last_id"), F.max("data").alias("last_data"))


def capture(spark, sf_dir, folder):
    """Pages of seven reviews of each app, newest first, as a capture. After every tenth page comes an empty answer; in two apps of
    ten the forty-first page stays empty; in two others page 60 leads back to page 10."""
    r = views.reviews(spark, sf_dir).withColumns({"_new": -F.unix_seconds(F.col("created_at").cast("timestamp")), "_id": -F.col("review_id").cast("long")})
    first = r.groupBy("app_id").agg(F.count("*").alias("n"))
    placed = numbered(r, ["app_id", "_new", "_id"]).join(_starts(first), "app_id")
    own = placed.withColumn("p", F.floor((F.col("_place") - F.col("_first")) / 7).cast("long"))
    one = F.struct("_new", "_id", F.struct(F.col("review_id").alias("id"), (-F.col("_new")).alias("at"), "language", F.col("voted_up").alias("up")).alias("r"))
    full = own.groupBy("app_id", "n", "p").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("reviews"))
    p = F.col("p")
    asked = F.when(p == 0, F.lit(pages.FIRST)).otherwise(F.concat(F.lit("c"), p.cast("string")))
    after = F.when((F.col("app_id") % 5 == 1) & (p == 60), F.lit("c10")).when((p + 1) * 7 < F.col("n"), F.concat(F.lit("c"), (p + 1).cast("string")))
    lines = full.select("app_id", "p", F.lit(9).alias("k"), F.to_json(F.struct(asked.alias("asked"), F.lit(1).alias("success"), after.alias("next"), F.when(p == 0, F.col("n")).alias("total"), "reviews")).alias("value"))
    times = F.when((F.col("app_id") % 5 == 3) & (p == 40), 3).when((p > 0) & (p % 10 == 0), 1).otherwise(0)
    empty = full.select("app_id", "p", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias("k"), F.to_json(F.struct(asked.alias("asked"), F.lit(1).alias("success"), F.array().alias("reviews"))).alias("value"))
    whole = lines.unionByName(empty).repartitionByRange("app_id", "p").sortWithinPartitions("app_id", "p", "k")
    whole.select("app_id", "value").write.partitionBy("app_id").text(folder)


def _starts(sizes):
    """Where each app's rows start; a row an app."""
    before = F.expr("coalesce(sum(n) OVER (ORDER BY app_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return sizes.withColumn("_first", before)


def page_walks(spark, sf_dir):
    """Walks over the capture in three ways: to the window's end, to a quota, and strict."""
    folder = runs.folder(spark, "capture")
    capture(spark, sf_dir, folder)
    spark.dataSource.register(pages.ReviewPages)
    source = spark.read.format("review_pages").option("path", folder).option("start", "1998-01-01T00:00:00+00:00").option("end", "2001-01-01T00:00:00+00:00")
    ways = {"window": {}, "quota": {"quota": 100}, "strict": {"strict": "true"}}
    found = [source.options(quota=way.get("quota", ""), strict=way.get("strict", "false"), table="walks").load().select(F.lit(name).alias("way"), "*") for name, way in ways.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


def walked_reviews(spark, sf_dir):
    """What the walks to the window's end collect, by app and language."""
    folder = runs.folder(spark, "capture")
    capture(spark, sf_dir, folder)
    spark.dataSource.register(pages.ReviewPages)
    r = spark.read.format("review_pages").option("path", folder).option("start", "1998-01-01T00:00:00+00:00").option("end", "2001-01-01T00:00:00+00:00").load()
    return r.groupBy("app_id", "language").agg(F.count("*").alias("n"), F.count_if("voted_up").alias("up"), F.max("created_at").cast("timestamp_ntz").alias("newest"), F.max("page").alias("last_page"))


def _ladder(spark, sf_dir):
    """A run over the reviews of mentions: one in 31 gets a sentiment that is none unless it is asked about alone, one in 97 always,
    and every eleventh full batch comes back as prose."""
    folder = runs.folder(spark, "passes")
    texts = views.mentions(spark, sf_dir).groupBy("review_id").agg(F.concat_ws(" / ", F.array_sort(F.collect_set("evidence"))).alias("text"))
    texts.write.parquet(f"{folder}/in")
    kept = spark.read.schema(texts.schema).parquet(f"{folder}/in")

    def answer(asked):
        r = F.col("review_id").cast("long")
        alone = F.col("size") == 1
        sentiment = F.when((r % 97 == 5) | (r % 31 == 7) & ~alone, "angry").otherwise("positive")
        quote = F.when(r % 5 == 0, F.lit("not in the text")).otherwise(F.substring_index("text", " / ", 1))
        item = F.struct(F.lit("Brand_New").alias("aspect"), sentiment.alias("sentiment"), quote.alias("evidence"))
        one = F.struct("idx", F.array(item).alias("aspects"))
        whole = asked.groupBy("batch", "size").agg(F.to_json(F.array_sort(F.collect_list(F.struct("idx", one.alias("o"))))["o"]).alias("t"))
        return whole.select("batch", "size", F.when((F.col("batch") % 11 == 6) & (F.col("size") > 1), F.lit("I can't say.")).otherwise(F.col("t")).alias("reply"))

    ladder = passes.Passes(spark, folder, answer, spark.createDataFrame([], "key string, label string"))
    ladder.follow(spark.readStream.schema(kept.schema).parquet(f"{folder}/in"), f"{folder}/c")
    ladder.finish()
    return ladder


def labelled_run(spark, sf_dir):
    """How each review came out of the ladder, with its mentions and whether their evidence held."""
    ladder = _ladder(spark, sf_dir)
    m = ladder.mentions().groupBy("review_id").agg(F.count("*").alias("mentions"), F.count("evidence").alias("with_evidence"))
    return ladder.outcomes().join(m, "review_id", "left").groupBy("attempt", "ok").agg(F.count("*").alias("n"), F.sum("mentions").alias("mentions"), F.sum("with_evidence").alias("with_evidence"), F.min("review_id").alias("first"))


def run_totals(spark, sf_dir):
    return _ladder(spark, sf_dir).totals()


#: Pages of the capture, what each is for a walk, and where the walks end.
PAGES_SQL = f"""{REVIEWS_SQL}, pr AS (SELECT *, (row_number() OVER (PARTITION BY app_id ORDER BY created_at DESC, review_id::BIGINT DESC) - 1) // 7 AS p FROM reviews),
  pg AS (SELECT app_id, p, count(*) FILTER (created_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '2001-01-01') AS inside, count(*) AS n, bool_or(created_at < TIMESTAMP '1998-01-01') AS below,
    p = max(p) OVER (PARTITION BY app_id) AS last, CASE WHEN app_id % 5 = 3 AND p = 40 THEN 3 WHEN p > 0 AND p % 10 = 0 THEN 1 ELSE 0 END AS empties FROM pr GROUP BY app_id, p),
  pw AS (SELECT way, pg.*, sum(inside) OVER w AS got, sum(empties) OVER w AS lost, sum(n - inside) OVER w AS strangers,
    CASE WHEN empties = 3 THEN 'empty pages' WHEN below THEN 'below the window' WHEN way = 'strict' AND sum(n - inside) OVER w > 0 THEN 'strangers' WHEN way = 'quota' AND sum(inside) OVER w >= 100 THEN 'quota' WHEN last OR app_id % 5 = 1 AND p = 60 THEN 'cursor' END AS why
    FROM pg, (SELECT unnest(['window', 'quota', 'strict']) AS way) WINDOW w AS (PARTITION BY way, app_id ORDER BY p)),
  ends AS (SELECT way, app_id, min(p) AS p FROM pw WHERE why IS NOT NULL GROUP BY 1, 2)"""
#: The ladder's passes: place among what is asked, whether it failed.
LADDER_SQL = f"""{MENTIONS_SQL}, a AS (SELECT review_id, review_id::BIGINT AS r, count(DISTINCT evidence) > 0 AS has, (row_number() OVER (ORDER BY review_id) - 1) // 10 AS b FROM mentions GROUP BY review_id),
  f0 AS (SELECT * FROM a WHERE b % 11 = 6 AND (SELECT count(*) FROM a z WHERE z.b = a.b) > 1 OR r % 31 = 7 OR r % 97 = 5), g AS (SELECT * EXCLUDE b, (row_number() OVER (ORDER BY review_id) - 1) // 10 AS b FROM f0),
  f1 AS (SELECT * FROM g WHERE b % 11 = 6 AND (SELECT count(*) FROM g z WHERE z.b = g.b) > 1 OR (r % 31 = 7 AND (SELECT count(*) FROM g z WHERE z.b = g.b) > 1) OR r % 97 = 5),
  o AS (SELECT review_id, has AND r % 5 <> 0 AS held, has, r, CASE WHEN review_id IN (SELECT review_id FROM f1) THEN 'isolate' WHEN review_id IN (SELECT review_id FROM f0) THEN 'rebatch' ELSE 'initial' END AS attempt, NOT (review_id IN (SELECT review_id FROM f1) AND r % 97 = 5) AS ok FROM a)"""
def tee_counts(spark, sf_dir):
    """What a batch and a stream over events tell of themselves while they are written."""
    e = views.table(spark, sf_dir, "events")
    at = runs.folder(spark, "tee")
    tee = metrics.Tee(spark)
    errors = F.count_if(F.col("event_type") == "error").alias("errors")
    tee.counted(e, "copy", errors, F.max("value").alias("most")).write.parquet(f"{at}/copy")
    spark.streams.addListener(tee)
    stream = spark.readStream.schema(e.schema).parquet(f"{at}/copy")
    runs.to_table(tee.observed(stream, "stream", errors), f"{at}/out", f"{at}/c")
    rows = tee.rows()
    for _ in range(50):  # progress is told by another thread
        if rows.filter("stage = 'stream'").count():
            break
        time.sleep(0.2)
        rows = tee.rows()
    spark.streams.removeListener(tee)
    return rows.groupBy("stage", "metric").agg(F.sum("value").alias("value"))


QUERIES = {"tee_counts": tee_counts, "labelled_run": labelled_run, "run_totals": run_totals, "page_walks": page_walks, "walked_reviews": walked_reviews, "admission_gate": admission_gate, "live_attach": live_attach, "event_frames": event_frames}
ORACLE = {
    "tee_counts": """WITH c AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (event_type = 'error'))::DOUBLE AS e, max(value) AS most FROM events) SELECT unnest(['copy', 'copy', 'copy', 'stream', 'stream']) AS stage, unnest(['rows', 'errors', 'most', 'rows', 'errors']) AS metric, unnest([n, e, most, n, e]) AS value FROM c""",
    "labelled_run": f"""WITH {LADDER_SQL} SELECT attempt, ok, count(*) AS n, CASE WHEN ok THEN count(*) END AS mentions, CASE WHEN ok THEN count(*) FILTER (held) END AS with_evidence, min(review_id) AS first FROM o GROUP BY 1, 2""",
    "run_totals": f"""WITH {LADDER_SQL} SELECT count(*) AS members, count(*) FILTER (ok) AS labelled, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (attempt <> 'initial') AS rebatched, count(*) FILTER (attempt = 'isolate') AS isolated, count(*) FILTER (ok) AS mentions, count(*) FILTER (ok AND r % 5 = 0) AS repairs FROM o""",
    "page_walks": f"""WITH {PAGES_SQL} SELECT way, app_id, p + lost + (why <> 'empty pages')::INT AS pages, least(got - CASE why WHEN 'empty pages' THEN inside ELSE 0 END, CASE way WHEN 'quota' THEN 100 ELSE 1e9 END)::BIGINT AS collected, CASE WHEN way = 'strict' AND why <> 'empty pages' THEN strangers ELSE 0 END AS out_of_window,
      (SELECT count(*) FROM reviews r WHERE r.app_id = pw.app_id) AS reported, why = 'empty pages' AS stopped_empty, why FROM pw JOIN ends USING (way, app_id, p)""",
    "walked_reviews": f"""WITH {PAGES_SQL} SELECT pr.app_id, language, count(*) AS n, count(*) FILTER (voted_up) AS up, max(created_at) AS newest, max(pr.p + (SELECT sum(empties) FROM pg WHERE pg.app_id = pr.app_id AND pg.p <= pr.p))::BIGINT AS last_page
      FROM pr JOIN ends ON ends.way = 'window' AND ends.app_id = pr.app_id JOIN pw ON pw.way = 'window' AND pw.app_id = pr.app_id AND pw.p = ends.p
      WHERE (pr.p < ends.p OR pr.p = ends.p AND pw.why <> 'empty pages') AND created_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '2001-01-01' GROUP BY 1, 2""",
    "admission_gate": """WITH RECURSIVE e AS (SELECT event_id, (user_id % 40)::VARCHAR AS v, ts, value / 1500 AS cost, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS rn FROM events),
      w AS (SELECT day, 0::BIGINT AS rn, NULL::BIGINT AS event_id, '' AS outcome, MAP {'': 0} AS used, MAP {'': TIMESTAMP '1970-01-01'} AS live, 0 AS n, 0::DOUBLE AS spent FROM e GROUP BY 1
        UNION ALL SELECT day, rn, event_id, o, CASE WHEN o = 'admitted' THEN map_concat(used, MAP {v: coalesce(used[v], 0) + 1}) ELSE used END, CASE WHEN o = 'admitted' THEN map_concat(live, MAP {v: ts + INTERVAL 1 HOUR}) ELSE live END,
          n + (o = 'admitted')::INT, spent + CASE WHEN o = 'admitted' THEN cost ELSE 0 END
          FROM (SELECT e.day, e.rn, e.event_id, e.v, e.ts, e.cost, w.used, w.live, w.n, w.spent, CASE WHEN e.ts < w.live[e.v] THEN 'in_flight' WHEN coalesce(w.used[e.v], 0) >= 5 THEN 'ip_day_cap' WHEN w.n >= 50 THEN 'day_cap' WHEN w.spent >= 2.0 THEN 'backstop' ELSE 'admitted' END AS o
            FROM e JOIN w ON e.day = w.day AND e.rn = w.rn + 1))
      SELECT event_id AS request_id, day, outcome FROM w WHERE rn > 0""",
    "live_attach": """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), w AS (SELECT user_id, rn, event_id AS job, ts AS began, event_id FROM e WHERE rn = 1
        UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.ts >= w.began + INTERVAL 10 HOUR THEN e.event_id ELSE w.job END, CASE WHEN e.ts >= w.began + INTERVAL 10 HOUR THEN e.ts ELSE w.began END, e.event_id FROM e JOIN w ON e.user_id = w.user_id AND e.rn = w.rn + 1) SELECT job, count(*) AS n FROM w GROUP BY 1""",
    "event_frames": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS last FROM events),
      b AS (SELECT user_id::VARCHAR AS job_id, i, ts, CASE WHEN last THEN 'end' ELSE event_type END AS event, event_id FROM a WHERE last OR event_id % 50 <> 7),
      c AS (SELECT *, i - coalesce(lag(i) OVER w, -1) - 1 AS lacking, coalesce(greatest(0, (date_diff('microsecond', lag(ts) OVER w, ts) - 1) // 10800000000), 0) AS beats FROM b WINDOW w AS (PARTITION BY job_id ORDER BY i)),
      f AS (SELECT job_id, i, -1 AS k, NULL AS id, 'gap' AS event, (i - lacking) || '..' || (i - 1) AS data FROM c WHERE lacking > 0
        UNION ALL SELECT job_id, i, unnest(range(beats)), NULL, 'heartbeat', NULL FROM c UNION ALL SELECT job_id, i, beats, CASE WHEN event <> 'end' THEN i END, event, event_id::VARCHAR FROM c),
      p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i, k) - 1 AS place FROM f)
      SELECT job_id, event, count(*) AS n, min(place) AS first_place, max(place) AS last_place, max(id) AS last_id, max(data) AS last_data FROM p GROUP BY 1, 2""",
}
