"""Queries over prose about apps: is what it states backed by results, and how it is cut and shown.

Narratives are made from the mint: a sentence of numbers, a quotation and a percentage for each pinned aspect, some of them
wrong on purpose.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.functions import text as tx
from hearsay.functions.search import parts_of
from hearsay.operators import grounding
from hearsay.operators.aggregates import on_version
from hearsay.plans.marts import MINT_SQL, SCOPE, mint
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL


def evidence(spark, sf_dir):
    """Evidence of survey mentions: app_id, review_id, aspect, sentiment, text."""
    scope = views.envelopes(spark, sf_dir).filter(on_version()).select("review_id", "app_id")
    rows = views.mentions(spark, sf_dir).filter("evidence IS NOT NULL").join(scope, "review_id")
    return rows.select("app_id", "review_id", "aspect", "slot", "sentiment", F.col("evidence").alias("text"))


def narratives(spark, sf_dir):
    own = evidence(spark, sf_dir).filter("slot = 'pinned'").groupBy("app_id", "aspect").agg(F.min("text").alias("q"))
    m = mint(spark, sf_dir).filter("slot = 'pinned'").join(own, ["app_id", "aspect"])
    r = F.length("aspect") + F.col("app_id")
    n = F.col("n_reviews") + F.when(r % 3 == 0, 1_000_000).otherwise(0)
    q = F.concat("q", F.when(r % 4 == 1, F.lit("zz")).otherwise(""))
    share = F.floor(F.col("share") * 100 + 0.5).cast("string")
    tail = F.when(r % 5 == 2, F.lit(' More "')).otherwise("")
    text = F.concat(F.lit("In all, "), n.cast("string"), F.lit(" of "), F.col("sample_size").cast("string"), F.lit(' speak of it. One says "'), q, F.lit('," and leaves. That is '), share, F.lit("% of them."), tail)
    return m.select(F.concat_ws("/", "app_id", "aspect").alias("id"), "app_id", text.alias("text"))


def judged(spark, sf_dir):
    prose = narratives(spark, sf_dir)
    return prose, grounding.grounded(prose, grounding.whitelist(mint(spark, sf_dir)), evidence(spark, sf_dir), "id", "app_id")


def grounded_spans(spark, sf_dir):
    return judged(spark, sf_dir)[1]


def whitelist(spark, sf_dir):
    return grounding.whitelist(mint(spark, sf_dir)).groupBy("app_id").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.sum("value").alias("total"))


def cut_sentences(spark, sf_dir):
    prose, spans = judged(spark, sf_dir)
    return grounding.cut_violations(prose, spans, "id").select("id", "cut")


def narrative_segments(spark, sf_dir):
    prose, spans = judged(spark, sf_dir)
    return grounding.segments(prose, spans, "id").groupBy("id").agg(F.count("*").alias("n"), F.count("kind").alias("certified"), F.sum(F.length("segment")).alias("chars"))


def ladder(spark, sf_dir):
    """The ladder's outcome for each narrative: composed as it is, trimmed to what is backed, or withheld."""
    prose, spans = judged(spark, sf_dir)
    bad = spans.filter("reason IS NOT NULL").select("id").distinct().withColumn("bad", F.lit(True))
    rows = grounding.cut_violations(prose, spans, "id").join(bad, "id", "left")
    outcome = F.when(F.col("bad").isNull(), "composed").when(F.col("cut") == "", "withheld").otherwise("trimmed")
    return rows.groupBy("app_id", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def corrective_prompts(spark, sf_dir):
    """What a second draft of each narrative with violations must put right."""
    from hearsay.operators import display

    return display.corrective_prompt(judged(spark, sf_dir)[1], "id")


def sentence_quotes(spark, sf_dir):
    """Quotations with the rest of their sentence: each document's fifth word in it."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("span", F.get(F.split("text", r"[\s]+"), 4)).filter("length(span) > 3")
    return d.select("doc_id", "span", tx.containing_sentence(F.col("span"), F.col("text")).alias("shown"))


def canary_report(spark, sf_dir):
    """Beacons (the first two words of every benchmark item) in answers of assistants, in any case and anywhere: which leak, and in how
    many answers."""
    words = F.split("text", " ")
    beacons = views.table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.concat_ws(" ", F.get(words, 0), F.get(words, 1))).alias("beacon"))
    kind = F.when(F.col("item_id") % 2 == 0, "blocked").otherwise("counted")
    answers = views.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.lower("text").alias("text"))
    hits = parts_of(answers, "text", beacons, "beacon").groupBy("beacon").agg(F.count("*").alias("hits"))
    rows = beacons.withColumn("expectation", kind).join(hits, "beacon", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select("item_id", "expectation", "hits", (F.col("hits") > 0).alias("breached"), ((F.col("hits") > 0) & (F.col("expectation") == "blocked")).alias("failed"))


def regrounding_plan(spark, sf_dir):
    """What each narrative must lose, sentence by sentence."""
    prose, spans = judged(spark, sf_dir)
    return grounding.regrounding(prose, spans, "id")


def ungrounded(spark, sf_dir):
    """Numbers in documents that no part's retail price, of a quarter of parts for each language, rounds to; a document without a language has no such parts."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    lang = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    v = views.table(spark, sf_dir, "part").select(lang.alias("lang"), F.explode(F.array(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double"))).alias("value"))
    return grounding.ungrounded_numbers(d, v, "doc_id", "lang")


NARRATIVES_SQL = f"""mint AS ({MINT_SQL}), ev AS (SELECT app_id, review_id, aspect, slot, sentiment, evidence AS text FROM ({{0}}) m JOIN (SELECT review_id, app_id FROM envelopes WHERE {SCOPE}) e USING (review_id) WHERE evidence IS NOT NULL),
own AS (SELECT app_id, aspect, min(text) AS q FROM ev WHERE slot = 'pinned' GROUP BY 1, 2),
base AS (SELECT *, length(aspect) + app_id AS r FROM mint JOIN own USING (app_id, aspect) WHERE slot = 'pinned'),
pieces AS (SELECT app_id || '/' || aspect AS id, app_id, n_reviews + CASE WHEN r % 3 = 0 THEN 1000000 ELSE 0 END AS n, sample_size AS size, q || CASE WHEN r % 4 = 1 THEN 'zz' ELSE '' END AS q,
  CAST(floor(share * 100 + 0.5) AS BIGINT) AS pct, r FROM base),
narratives AS (SELECT *, 'In all, ' || n || ' of ' || size || ' speak of it. ' AS s1, 'One says "' || q || '," and leaves. ' AS s2, 'That is ' || pct || '% of them.' AS s3, CASE WHEN r % 5 = 2 THEN ' More "' ELSE '' END AS s4 FROM pieces),
wl AS (SELECT DISTINCT app_id, v FROM (SELECT app_id, unnest([n_reviews, 100.0 * n_reviews::DOUBLE / sample_size, n_positive, n_negative, n_neutral, n_mixed, 100.0 * n_positive / n_reviews::DOUBLE, 100.0 * n_negative / n_reviews::DOUBLE, 100.0 * n_neutral / n_reviews::DOUBLE, 100.0 * n_mixed / n_reviews::DOUBLE,
  100.0 * n_positive / sample_size::DOUBLE, 100.0 * n_negative / sample_size::DOUBLE, 100.0 * n_neutral / sample_size::DOUBLE, 100.0 * n_mixed / sample_size::DOUBLE]::DOUBLE[]) AS v FROM mint WHERE slot = 'pinned'
  UNION ALL SELECT app_id, sample_size::DOUBLE FROM mint)),
rounded AS (SELECT app_id, round(v::VARCHAR::DECIMAL(30, 14), 0)::BIGINT AS w, min(v) AS v FROM wl GROUP BY 1, 2),
nums AS (SELECT id, app_id, 8 AS start, n AS num FROM narratives UNION ALL SELECT id, app_id, 12 + length(n::VARCHAR), size FROM narratives UNION ALL SELECT id, app_id, length(s1 || s2) + 8, pct FROM narratives),
spans AS (SELECT id, start::INT AS start, (start + length(num::VARCHAR))::INT AS "end", num::VARCHAR AS span, 'numeral' AS kind, v AS value, NULL::VARCHAR AS review_id, CASE WHEN v IS NULL THEN 'matches no value at its own precision' END AS reason
    FROM nums LEFT JOIN rounded ON rounded.app_id = nums.app_id AND w = num
  UNION ALL SELECT id, (length(s1) + 9)::INT, (length(s1) + 12 + length(q))::INT, '"' || q || ',"', 'quote', NULL, (SELECT min(review_id) FROM ev WHERE ev.app_id = n.app_id AND contains(ev.text, n.q)),
    CASE WHEN NOT EXISTS (SELECT 1 FROM ev WHERE ev.app_id = n.app_id AND contains(ev.text, n.q)) THEN 'not a part of the evidence' END FROM narratives n
  UNION ALL SELECT id, length(s1 || s2 || s3 || s4) - 1, length(s1 || s2 || s3 || s4), '"', 'quote', NULL, NULL, 'unpaired quotation mark' FROM narratives WHERE r % 5 = 2)"""
MENTIONS_ONLY = MENTIONS_SQL.split(" AS (", 1)[1].rsplit(")", 1)[0]
BASE = f"WITH {ENVELOPES_SQL}, {NARRATIVES_SQL.format(MENTIONS_ONLY)}"
BAD = """bad AS (SELECT n.id, any_value(app_id) AS app_id, any_value(s1) AS s1, any_value(s2) AS s2, any_value(s3) AS s3, any_value(s4) AS s4, bool_or(reason IS NOT NULL AND start < length(s1)) AS b1,
  bool_or(reason IS NOT NULL AND start >= length(s1) AND start < length(s1 || s2)) AS b2, bool_or(reason IS NOT NULL AND start >= length(s1 || s2) AND start < length(s1 || s2 || s3)) AS b3, coalesce(bool_or(reason = 'unpaired quotation mark'), false) AS b4 FROM narratives n JOIN spans USING (id) GROUP BY 1),
cut AS (SELECT id, app_id, (b1 OR b2 OR b3 OR coalesce(b4, false)) AS touched, trim(CASE WHEN b1 THEN '' ELSE s1 END || CASE WHEN b2 THEN '' ELSE s2 END || CASE WHEN b3 THEN '' ELSE s3 END || CASE WHEN b4 THEN '' ELSE s4 END) AS cut FROM bad)"""
TOKEN = tx.NUMERAL

QUERIES = {
    "grounded_spans": grounded_spans, "whitelist_values": whitelist, "cut_sentences": cut_sentences, "narrative_segments": narrative_segments, "compose_ladder": ladder, "corrective_prompts": corrective_prompts,
    "sentence_quotes": sentence_quotes, "canary_report": canary_report, "regrounding_plan": regrounding_plan, "ungrounded_numbers": ungrounded,
}
ORACLE = {
    "grounded_spans": f"{BASE} SELECT * FROM spans",
    "whitelist_values": f"{BASE} SELECT app_id, count(*) AS n, max(v) AS most, sum(v) AS total FROM wl GROUP BY 1",
    "cut_sentences": f"{BASE}, {BAD} SELECT id, cut FROM cut",
    "narrative_segments": f"""{BASE}, g AS (SELECT id, count(*) FILTER (reason IS NULL) AS certified FROM spans GROUP BY 1)
        SELECT id, 2 * certified + 1 AS n, certified, length(s1 || s2 || s3 || s4) AS chars FROM narratives JOIN g USING (id)""",
    "compose_ladder": f"{BASE}, {BAD} SELECT app_id, CASE WHEN NOT touched THEN 'composed' WHEN cut = '' THEN 'withheld' ELSE 'trimmed' END AS outcome, count(*) AS n FROM cut GROUP BY 1, 2",
    "corrective_prompts": f"""{BASE} SELECT id, E'Rewrite without these:\\n' || string_agg('- ' || span || ': ' || reason, E'\\n' ORDER BY start) AS prompt FROM spans WHERE reason IS NOT NULL GROUP BY 1""",
    "sentence_quotes": r"""WITH d AS (SELECT doc_id, text, regexp_split_to_array(text, '[\s\x0b]+')[5] AS span FROM documents), a AS (SELECT doc_id, text, span, strpos(text, span) AS p FROM d WHERE length(span) > 3),
        l AS (SELECT *, regexp_replace(regexp_extract(text[:p - 1], '[^.!?…\n]*$'), '^[\s\x0b\pZ]+', '') AS lead, regexp_replace(regexp_extract(text[p + length(span):], '^[^.!?…\n]*[.!?…]?'), '[\s\x0b\pZ]+$', '') AS tail, (300 - length(span)) // 2 AS m FROM a),
        c AS (SELECT *, regexp_replace(lead || span || tail, '^[\s\x0b\pZ]+|[\s\x0b\pZ]+$', '', 'g') AS whole, CASE WHEN length(lead) <= m THEN lead ELSE '… ' || regexp_replace(right(lead, m), '^[^ ]* ', '') END AS le, CASE WHEN length(tail) <= m THEN tail ELSE regexp_replace(left(tail, m), ' [^ ]*$', '') || ' …' END AS ta FROM l)
        SELECT doc_id, span, CASE WHEN length(whole) <= 300 THEN whole WHEN m <= 0 THEN span ELSE le || span || ta END AS shown FROM c""",
    "canary_report": r"""WITH b AS (SELECT item_id, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS beacon, CASE WHEN item_id % 2 = 0 THEN 'blocked' ELSE 'counted' END AS expectation FROM benchmark),
        h AS (SELECT item_id, count(c.text) AS hits FROM b LEFT JOIN conversations c ON role = 'assistant' AND contains(lower(c.text), beacon) GROUP BY 1)
        SELECT item_id, expectation, hits, hits > 0 AS breached, hits > 0 AND expectation = 'blocked' AS failed FROM b JOIN h USING (item_id)""",
    "regrounding_plan": f"""{BASE}, {BAD}, p AS (SELECT id, unnest([0, 1, 2, 3]) AS place, unnest([s1, s2, s3, s4]) AS s, unnest([0, length(s1), length(s1 || s2), length(s1 || s2 || s3)]) AS a, unnest([b1, b2, b3, coalesce(b4, false)]) AS bad, NOT (b1 AND b2 AND b3) AS stays FROM bad)
        SELECT id, place, trim(s) AS sentence, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons, CASE WHEN stays THEN 'cut' ELSE 'withhold' END AS action FROM p JOIN spans USING (id) WHERE bad AND reason IS NOT NULL AND start >= a AND start < a + length(s) GROUP BY id, place, s, stays""",
    "ungrounded_numbers": f"""WITH p AS (SELECT doc_id, coalesce(lang, '') AS lang, unnest(string_split(text, '"')) AS part, generate_subscripts(string_split(text, '"'), 1) AS i, len(string_split(text, '"')) AS k FROM documents),
        t AS (SELECT doc_id, lang, unnest(regexp_extract_all(part, '{TOKEN}')) AS token FROM p WHERE i % 2 = 1 OR i = k), c AS (SELECT doc_id, lang, token, count(*) AS n FROM t GROUP BY 1, 2, 3),
        z AS (SELECT *, replace(token, ',', '') AS bare, length(regexp_extract(replace(token, ',', ''), '\\.([0-9]+)$', 1)) AS places FROM c),
        v AS (SELECT DISTINCT ['de', 'en', 'es', 'fr'][p_partkey % 4 + 1] AS lang, unnest([p_retailprice::DOUBLE, p_size::DOUBLE])::DECIMAL(30, 6) AS value FROM part)
        SELECT doc_id, token, n FROM z WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.lang = z.lang AND floor(v.value * power(10, least(places, 6))::DECIMAL(20, 0) + 0.5) = z.bare::DECIMAL(38, 12) * power(10, least(places, 6))::DECIMAL(20, 0))""",
}
