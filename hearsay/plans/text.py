"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.functions import text as tx
from hearsay.operators import grounding
from hearsay.views import MENTIONS_SQL


def usable(spark, sf_dir):
    """Corpus scan: per language how many texts are of the wanted one, empty, and usable."""
    d = views.table(spark, sf_dir, "documents")
    content = tx.has_content(F.col("text"))
    return d.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("lang") != "en").alias("other_language"), F.count_if((F.col("lang") == "en") & ~content).alias("empty"), F.count_if((F.col("lang") == "en") & content).alias("usable"))


def numerals(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select(F.explode(tx.numerals(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def quotes(spark, sf_dir):
    """Quotations per text, from item texts set in quotes: an item, a curly quote, and a mark without its pair."""
    b = views.table(spark, sf_dir, "benchmark").withColumn("text", F.concat(F.lit('He said "'), "text", F.lit('," then “no.” and "')))
    return b.select("item_id", F.posexplode(tx.quoted_parts(F.col("text"))).alias("place", "quote"))


def collapsed(spark, sf_dir):
    return grounding.collapse(views.mentions(spark, sf_dir))


def folded_labels(spark, sf_dir):
    """Spellings of aspects that meet under one key: made from brands and types by changing case and separators."""
    p = views.table(spark, sf_dir, "part").select("p_name").distinct()
    forms = p.select("p_name", F.explode(F.array(F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.lit(" "), F.initcap("p_name"), F.lit("  ")), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("label"))
    return forms.groupBy(tx.match_key("label").alias("key")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_forms"))


def pins(spark, sf_dir):
    """Text pins made from documents, with some texts drifted and some ids gone on purpose, against the documents."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    drifted = F.when(F.col("doc_id") % 13 == 4, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    pinned = d.filter("doc_id % 11 <> 3").select(F.when(F.col("doc_id") % 17 == 5, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.sha2(drifted, 256).alias("pin"))
    return grounding.checked_pins(pinned, d, "doc_id").groupBy("outcome").agg(F.count("*").alias("n"))


def slugs(spark, sf_dir):
    """Paths of reports on customers, whose names get accents, marks and punctuation here; distinct names are folded once."""
    accents = F.translate("c_mktsegment", "AEIOU", "ÁÈÎÖÜ")
    name = F.when(F.col("c_custkey") % 9 == 4, F.lit("東方!")).otherwise(F.concat("c_name", F.lit(" -- "), accents, F.lit("™ ® "), F.repeat(F.lit("long-"), (F.col("c_custkey") % 20).cast("int"))))
    c = views.table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    named = c.select("name").distinct().withColumn("slug", tx.slug(F.col("name")))
    return c.join(named, "name").select("c_custkey", "slug", tx.report_path(F.col("c_custkey"), F.col("name")).alias("path"))


def replies(spark, sf_dir):
    """Classifier replies made from mentions, ten reviews a batch, with rows lost, doubled and damaged on purpose."""
    m = views.mentions(spark, sf_dir).select(F.col("review_id").cast("long").alias("r"), "aspect", "sentiment", "position")
    per = m.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("position", "aspect", "sentiment"))).alias("aspects"))
    idx = F.when(F.col("r") % 17 == 3, F.lit("true")).when(F.col("r") % 19 == 4, F.lit("99")).otherwise((F.col("r") % 10).cast("string"))
    row = F.concat(F.lit('{"idx": '), idx, F.lit(', "aspects": '), F.to_json("aspects"), F.lit("}"))
    rows = per.filter("r % 23 <> 5").select((F.col("r") / 10).cast("long").alias("batch"), "r", F.when(F.col("r") % 29 == 6, F.concat(row, F.lit(", "), row)).otherwise(row).alias("row"))
    text = rows.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]), ", ").alias("t"))
    return text.select("batch", F.lit(10).alias("size"), F.concat(F.lit("["), "t", F.lit("]")).alias("reply"))


def attribution(spark, sf_dir):
    return grounding.attributed(replies(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"))


TOKEN = tx.NUMERAL
QUERIES = {
    "usable_corpus": usable, "numeral_tokens": numerals, "quoted_parts": quotes, "collapse_repeats": collapsed,
    "match_keys": folded_labels, "text_pins": pins, "slugs": slugs, "reply_attribution": attribution,
}
ORACLE = {
    "numeral_tokens": f"WITH t AS (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY 1",
    "quoted_parts": r"""WITH b AS (SELECT item_id, replace(replace('He said "' || text || '," then “no.” and "', '“', '"'), '”', '"') AS t FROM benchmark), s AS (SELECT item_id, string_split(t, '"') AS parts FROM b),
        x AS (SELECT item_id, unnest(range(len(parts) // 2)) AS place, parts FROM s)
        SELECT item_id, place::INT AS place, regexp_replace(regexp_replace(trim(parts[2 * place + 2], E' \t\n'), '[.,!?;:…]+$', ''), '\s+$', '') AS quote FROM x WHERE 2 * place + 2 < len(parts)""",
    "collapse_repeats": f"""WITH {MENTIONS_SQL} SELECT review_id, aspect, min(struct_pack(p := position, s := slot)).s AS slot, CASE WHEN count(DISTINCT sentiment) = 1 THEN min(sentiment) ELSE 'mixed' END AS sentiment,
        (min(struct_pack(p := position, e := evidence)) FILTER (evidence IS NOT NULL)).e AS evidence, count(*) AS n FROM mentions GROUP BY 1, 2""",
    "match_keys": r"""WITH f AS (SELECT unnest([upper(p_name), replace(p_name, ' ', '_'), ' ' || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || '  ', replace(p_name, ' ', '-')]) AS label FROM (SELECT DISTINCT p_name FROM part))
        SELECT trim(regexp_replace(regexp_replace(lower(label), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS key, count(*) AS n, count(DISTINCT label) AS n_forms FROM f GROUP BY 1""",
    "slugs": r"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 4 THEN '東方!' ELSE c_name || ' -- ' || translate(c_mktsegment, 'AEIOU', 'ÁÈÎÖÜ') || '™ ® ' || repeat('long-', c_custkey % 20) END AS name FROM customer),
        w AS (SELECT c_custkey, rtrim(left(trim(regexp_replace(lower(strip_accents(replace(name, '™', ''))), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-') AS slug FROM c)
        SELECT c_custkey, slug, '/reports/' || c_custkey || CASE WHEN slug <> '' THEN '/' || slug ELSE '' END AS path FROM w""",
    "usable_corpus": r"""WITH d AS (SELECT lang, coalesce(length(regexp_replace(regexp_replace(text, '\p{C}', '', 'g'), '[\s\p{Z}]', '', 'g')) > 0, false) AS c FROM documents)
        SELECT lang, count(*) AS total, count(*) FILTER (lang <> 'en') AS other_language, count(*) FILTER (lang = 'en' AND NOT c) AS empty, count(*) FILTER (lang = 'en' AND c) AS usable FROM d GROUP BY 1""",
    "text_pins": """WITH p AS (SELECT CASE WHEN doc_id % 17 = 5 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 13 = 4 THEN text || ' ' ELSE text END AS was FROM documents WHERE doc_id % 11 <> 3)
        SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN sha256(d.text) IS NOT DISTINCT FROM sha256(was) THEN 'matching' ELSE 'drifted' END AS outcome, count(*) AS n FROM p LEFT JOIN documents d USING (doc_id) GROUP BY 1""",
    "reply_attribution": f"""WITH {MENTIONS_SQL}, r AS (SELECT DISTINCT CAST(review_id AS BIGINT) AS r FROM mentions WHERE CAST(review_id AS BIGINT) % 23 <> 5), e AS (SELECT r, r // 10 AS batch, unnest(range(CASE WHEN r % 29 = 6 THEN 2 ELSE 1 END)) AS copy FROM r),
        i AS (SELECT batch, CASE WHEN r % 17 = 3 THEN NULL WHEN r % 19 = 4 THEN 99 ELSE r % 10 END AS idx FROM e), o AS (SELECT batch, idx, CASE WHEN idx IS NULL THEN 'bad idx' WHEN idx >= 10 THEN 'out of range' WHEN count(*) OVER (PARTITION BY batch, idx) > 1 THEN 'duplicate' ELSE 'ok' END AS outcome FROM i),
        m AS (SELECT b.batch, n.idx, 'missing' AS outcome FROM (SELECT DISTINCT batch FROM i) b CROSS JOIN range(10) n(idx) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.batch = b.batch AND o.idx = n.idx AND outcome IN ('ok', 'duplicate')))
        SELECT outcome, count(*) AS n FROM (SELECT outcome FROM o UNION ALL SELECT outcome FROM m) GROUP BY 1""",
}
