"""The mint and its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearsay import views
from hearsay.operators import aggregates

Z = "1.959963984540054"
SCOPE = "origin = 'survey' AND model_version = 'lexicon' AND prompt_version = 'p1' AND ontology_version = 'v2'"


def mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mint(views.envelopes(spark, sf_dir), views.mentions(spark, sf_dir))


MINT_SQL = f"""WITH {views.ENVELOPES_SQL}, {views.MENTIONS_SQL},
scope AS (SELECT review_id, app_id FROM envelopes WHERE {SCOPE}),
sizes AS (SELECT app_id, count(*) AS sample_size FROM scope GROUP BY 1),
folded AS (SELECT app_id, slot, aspect, count(DISTINCT review_id) AS n_reviews,
  sum((sentiment = 'positive')::INT) AS n_positive, sum((sentiment = 'negative')::INT) AS n_negative,
  sum((sentiment = 'neutral')::INT) AS n_neutral, sum((sentiment = 'mixed')::INT) AS n_mixed
  FROM mentions JOIN scope USING (review_id) GROUP BY 1, 2, 3),
shared AS (SELECT folded.*, sample_size, n_reviews::DOUBLE / sample_size AS share FROM folded JOIN sizes USING (app_id)),
bounds AS (SELECT *, (share + {Z}*{Z}/(2*sample_size)) / (1 + {Z}*{Z}/sample_size) AS middle,
  {Z} * sqrt(share*(1-share)/sample_size + {Z}*{Z}/(4.0*sample_size*sample_size)) / (1 + {Z}*{Z}/sample_size) AS half FROM shared)
SELECT app_id, slot, aspect, n_reviews, n_positive::BIGINT AS n_positive, n_negative::BIGINT AS n_negative,
  n_neutral::BIGINT AS n_neutral, n_mixed::BIGINT AS n_mixed, sample_size, share,
  greatest(0.0, middle - half) AS share_low, least(1.0, middle + half) AS share_high,
  CASE WHEN share < 0.05 THEN 'tail' WHEN share < 0.15 THEN 'mid' ELSE 'headline' END AS band FROM bounds"""

QUERIES = {"mint": mint}
ORACLE = {"mint": MINT_SQL}
