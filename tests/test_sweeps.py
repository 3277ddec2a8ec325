"""Draws of all plans at once, top rows by hash in parts, and blends of samples."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hearsay.operators import sampling, sweeps


def members(spark, n=90):
    at = F.timestamp_seconds(F.lit(1_500_000_000) + F.col("id") * 86_400 * (F.col("id") % 7 + 1) / 3).cast("timestamp_ntz")
    return spark.range(n).select((F.col("id") % 2).alias("app_id"), F.lit(1.0).alias("quantile"), F.lit(n // 2).cast("long").alias("pool_size"), F.lpad(F.col("id").cast("string"), 4, "0").alias("review_id"), at.alias("created_at"))


def test_draws_are_those_of_each_plan_alone(spark):
    m = members(spark)
    got = {}
    for r in sweeps.policy_draws(m, [5, 20, 45]).collect():
        got.setdefault((r.app_id, r["size"], r.policy), set()).add(r.review_id)
    assert {k[1] for k in got} == {5, 20}  # a size of the whole pool is no draw
    reviews = m.drop("quantile", "pool_size")
    months = reviews.groupBy("app_id", F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("up")).withColumn("down", F.lit(0))
    windows = sampling.plan_windows(months, "2030-01-01 00:00:00")
    for size in (5, 20):
        for policy in sweeps.PLANNED:
            own = sampling.windowed_draw(reviews, sampling.apportion(windows, size, policy)).collect()
            for app in (0, 1):
                assert got[app, size, policy] == {r.review_id for r in own if r.app_id == app} and len(got[app, size, policy]) == size
        newest = sampling.newest(reviews, size).collect()
        for app in (0, 1):
            assert got[app, size, sweeps.NEWEST] == {r.review_id for r in newest if r.app_id == app}


def test_first_by_hash_is_the_first_of_all(spark):
    rows = spark.range(500).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("review_id"))
    got = {r.review_id: r["rank"] for r in sweeps.first_by_hash(rows, ["k"], F.md5("review_id"), 9, "rank").collect()}
    whole = [r.review_id for r in rows.orderBy(F.md5("review_id")).limit(9).collect()]
    assert got == {r: i + 1 for i, r in enumerate(whole)}


def test_blends(spark):
    base = members(spark).select("app_id", "quantile", "review_id").filter("CAST(review_id AS INT) < 40")
    marked = spark.range(12).select(F.when(F.col("id") < 6, "a").otherwise("b").alias("source"), F.concat(F.lit("m"), "id").alias("review_id"))
    rows = sweeps.blends(base, marked, [0.0, 0.1, 0.25], 3, "s").collect()
    cells = {}
    for r in rows:
        cells.setdefault((r.app_id, r.source, r.share, r.repeat), set()).add(r.review_id)
    assert len(cells) == 2 * 2 * (1 + 3 + 3) and all(len(v) == 20 for v in cells.values()) and len(rows) == 20 * len(cells)
    for (app, source, share, repeat), ids in cells.items():
        strangers = {i for i in ids if i.startswith("m")}
        assert len(strangers) == int(share * 20 + 0.5) and all((int(i[1:]) < 6) == (source == "a") for i in strangers)
        if share == 0.25:  # nested: what leaves and comes at a share does so at a larger one
            small = cells[app, source, 0.1, repeat]
            assert {i for i in small if i.startswith("m")} <= strangers and {i for i in ids if not i.startswith("m")} <= small
    assert cells[0, "a", 0.25, 0] != cells[0, "a", 0.25, 1]
    with pytest.raises(PySparkException, match="too few marked"):
        sweeps.blends(base, marked, [0.5], 1, "s").collect()
    with pytest.raises(PySparkException, match="nothing of the sample"):
        sweeps.blends(base.limit(4), marked, [1.0], 1, "s").collect()


def test_marked_pools_are_refused_as_a_whole(spark):
    usable = spark.createDataFrame([("s", "1", "2020-01-02"), ("s", "2", "2020-01-01"), ("s", "3", "2021-01-01"), ("t", "4", "2020-01-02")], "source string, review_id string, at string").select("source", "review_id", F.col("at").cast("timestamp_ntz").alias("created_at"))
    window = spark.createDataFrame([("s", "2020-01-01", "2020-12-31")], "source string, a string, b string").select("source", F.col("a").cast("timestamp_ntz").alias("start"), F.col("b").cast("timestamp_ntz").alias("end"))
    hits = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "y"), ("3", "x")], "review_id string, aspect string")
    labelled = lambda *ids: spark.createDataFrame([("t" if i == "4" else "s", i) for i in ids], "source string, review_id string")
    for ids, why in ((("1", "9"), "labelled but not usable"), (("1", "3"), "outside its window"), (("4",), "no window")):
        with pytest.raises(ValueError, match=why):
            sweeps.marked_pool(usable, labelled(*ids), window, hits)
    pool, index = sweeps.marked_pool(usable, labelled("1", "2", "2"), window, hits)
    assert pool.count() == 2 and {(r.aspect, r.n) for r in index.collect()} == {("x", 2), ("y", 1)}


def test_shares_of_equal_samples_have_equal_means(spark):
    pools = members(spark, 60).filter("app_id = 0")
    base = pools.select("app_id", "quantile", "review_id")  # 30 reviews: shares of 0.02 and 0.04 both swap one
    marked = spark.range(3).select(F.lit("a").alias("source"), F.concat(F.lit("m"), "id").alias("review_id"))
    of = lambda d: d.select("review_id", F.concat(F.lit("x"), F.pmod(F.xxhash64("review_id"), F.lit(7)).cast("string")).alias("aspect"))
    hits = of(base).unionByName(of(marked))
    regime = spark.range(1).select(F.col("id").alias("app_id"), F.lit("calm").alias("regime"))
    got = {r.share: r for r in sweeps.mixing(pools, base, marked, hits, regime, [0.02, 0.04], 3, "s").collect()}
    assert got[0.02].mean_error == got[0.04].mean_error == round(got[0.02].mean_error, 12) > 0


def test_months_are_cut_before_they_are_shuffled(spark):
    pool = spark.range(500).select((F.col("id") % 2).alias("app_id"), F.lit(1.0).alias("quantile"), F.lit(250).cast("long").alias("pool_size"), F.col("id").cast("string").alias("review_id"), F.lit("2020-01-05").cast("timestamp_ntz").alias("created_at"))
    drawn = sweeps.policy_draws(pool, [10, 40])
    assert "WindowGroupLimit" in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["size"], r["count"]) for r in drawn.groupBy("policy", "size").count().collect()} == {(10, 20), (40, 80)}
