import duckdb
from pyspark.sql import functions as F

from itertools import accumulate

from hopline.functions.draws import KEY_WEIGHTS, hash32, multiplier_table, normal_multiplier, unit, weighted_key
from hopline.plans import oracle as O


def test_hash_matches_duckdb(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("r"))
    got = {r["r"]: (r["h"], r["u"]) for r in df.select("r", hash32(42, "Comp", "key", F.col("r")).alias("h"),
                                                         unit(42, "Comp", "key", F.col("r")).alias("u")).collect()}
    con = duckdb.connect()
    sql = (f"SELECT CAST(i AS VARCHAR) AS r, {O.H('42', O.q('Comp'), O.q('key'), 'CAST(i AS VARCHAR)')} AS h, "
           f"{O.U('42', O.q('Comp'), O.q('key'), 'CAST(i AS VARCHAR)')} AS u FROM range(2000) t(i)")
    want = {r: (h, u) for r, h, u in con.execute(sql).fetchall()}
    assert got == want
    assert all(0 <= h < 2 ** 32 for h, _ in got.values())


def test_weighted_key_boundaries(spark):
    # u equal to a cumulative weight picks that key (comparison is >=), u above all cannot happen (<1)
    KEY_CUMULATIVE = list(accumulate(KEY_WEIGHTS))
    vals = [(0.0,), (KEY_CUMULATIVE[0],), (KEY_CUMULATIVE[0] + 1e-12,), (KEY_CUMULATIVE[3],), (0.999999,)]
    df = spark.createDataFrame(vals, "u double").select(weighted_key(F.col("u")).alias("k"))
    assert [r.k for r in df.collect()] == ["A", "A", "B", "D", "P"]


def test_weighted_key_shares(spark):
    df = spark.range(0, 200_000).select(weighted_key(unit(7, "X", "key", F.col("id"))).alias("k"))
    counts = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert abs(counts["A"] / 200_000 - 6 / 32) < 0.01
    assert abs(counts["P"] / 200_000 - 1 / 32) < 0.005


def test_multiplier_mean_and_fallback(spark):
    df = spark.range(0, 100_000).select(normal_multiplier(unit(1, "M", "mult", F.col("id")), 1, 20, 10, 1.0).alias("m"))
    mean = df.agg(F.avg("m")).first()[0]
    assert abs(mean - 10.5) < 0.05  # ceil of a normal: expectation is mean + 0.5
    # at mean 20 the last CDF value is 0.5: about half the draws fall back to 0
    zero = spark.range(0, 20_000).select(normal_multiplier(unit(1, "M", "mult", F.col("id")), 1, 20, 20, 1.0).alias("m"))
    share0 = zero.where("m = 0").count() / 20_000
    assert 0.45 < share0 < 0.55
    values, cdf = multiplier_table(1, 20, 20, 1.0)
    assert cdf[-1] == 0.5 and values[-1] == 20


def test_u_above_last_weight_gives_zero(spark):
    df = spark.createDataFrame([(0.9999,)], "u double").select(normal_multiplier(F.col("u"), 1, 20, 20, 1.0).alias("m"))
    assert df.first().m == 0
