import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freightlens.operators import densities, ranks, sampling, smooth, stats, summaries
from freightlens.operators.lookup import attach


def data(spark, n=800):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 2, n), 1)
    pdf = pd.DataFrame({"x": x, "y": x * 2 + np.round(rng.normal(0, 3, n)), "k": rng.integers(0, 4, n)})
    return pdf, spark.createDataFrame(pdf)


def test_group_stats_leaves_out_absent_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0)], "k string, y double")
    found = {r["k"]: tuple(r)[1:] for r in stats.group_stats(df, ["k"], "y").collect()}
    assert found == {"a": (2.0, pytest.approx(2**0.5), 2), "b": (5.0, None, 1)}


def test_constant_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, 1.0), (1.0, 5.0, 2.0)], "c double, y double, z double")
    found = {r["feature"]: (r["r"], r["rows"]) for r in stats.corr_table(df, ["c", "z"], "y").collect()}
    assert found == {"c": (None, 3), "z": (pytest.approx(1.0), 2)}


@pytest.mark.parametrize("t, rows, p", [(2.228138852, 12, 0.05), (1.0, 3, 0.5), (0.0, 50, 1.0),
                                        (1.959963985, 10**8, 0.05), (6.0, 10**6, 1.9731756e-9)])
def test_p_values(spark, t, rows, p):
    df = spark.createDataFrame([(t, rows)], "t double, rows bigint")
    assert stats.with_p_value(df).first()["p"] == pytest.approx(p, rel=2e-4)


def test_spearman_like_pandas(spark):
    pdf, df = data(spark)
    found = ranks.spearman(df, "x", "y").first()
    assert found["r"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()), abs=1e-12)
    assert found["rows"] == len(pdf)


def test_codes_are_fitted(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string")
    codes = ranks.value_codes(train, "s", "code")
    test = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "s string")
    found = {r["s"]: r["code"] for r in ranks.code_of(test, codes, "s", "code").collect()}
    assert found == {"a": 0, "b": 1, "z": -1, None: -1}


def test_lookup_paths_agree(spark):
    fact = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id").unionByName(
        spark.createDataFrame([(None, 5000)], "k bigint, id bigint"))
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    wanted = sorted(map(tuple, attach(fact, table, ["k"]).collect()), key=str)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert wanted == sorted(map(tuple, attach(fact, table, ["k"]).collect()), key=str)
        assert len(wanted) == 1001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_stacked_lookups_read_the_fact_once(spark, tmp_path):
    spark.range(100).select((F.col("id") % 9).alias("k")).write.parquet(f"{tmp_path}/fact")
    fact = spark.read.parquet(f"{tmp_path}/fact")
    for i in range(8):
        fact = attach(fact, spark.range(9).select(F.col("id").alias("k"), F.lit(i).alias(f"v{i}")), ["k"])
    plan = fact._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and fact.count() == 100


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from freightlens.session import ensure_checkpoint_dir

    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)


def test_sample_and_split(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    sample = sampling.exact_sample(df, 300, seed=1)
    assert sample.count() == 300 and sample.distinct().count() == 300
    assert sorted(sample.collect()) == sorted(sampling.exact_sample(df, 300, seed=1).collect())
    with pytest.raises(ValueError):
        sampling.exact_sample(df, 6000)
    train, test = sampling.hash_split(df, ["id"])
    assert train.count() + test.count() == 5000 and train.intersect(test).isEmpty()
    assert 0.77 < train.count() / 5000 < 0.83


def test_lowess_is_local_least_squares(spark):
    pdf, df = data(spark, 200)
    found = smooth.lowess_grid(df, "x", "y", frac=0.3, grid=[-1.0, 0.5, 2.0]).orderBy("g").collect()
    for row, at in zip(found, [-1.0, 0.5, 2.0]):
        d = (pdf["x"] - at).abs()
        h = np.sort(d)[int(0.3 * 200) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        slope, level = np.polyfit(pdf["x"] - at, pdf["y"], 1, w=np.sqrt(w))
        assert row["fit"] == pytest.approx(level, rel=1e-9)


def test_robust_rounds_resist_an_outlier(spark):
    rows = [(float(i), 2.0 * i) for i in range(60)] + [(30.0, 5000.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    plain = smooth.lowess_grid(df, "x", "y", 0.3, grid=[10.0, 30.0, 50.0]).orderBy("g").collect()
    robust = smooth.lowess_grid(df, "x", "y", 0.3, grid=[10.0, 30.0, 50.0], rounds=3).orderBy("g").collect()
    assert abs(robust[1]["fit"] - 60) < abs(plain[1]["fit"] - 60)


def test_densities_sum_to_one(spark):
    pdf, df = data(spark)
    curve = densities.kde(df, "x", points=200).orderBy("g").toPandas()
    assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(1.0, abs=0.01)
    plane = densities.kde_2d(df, "x", "y", points=40).toPandas()
    steps = [np.diff(np.sort(plane[c].unique()))[0] for c in ("x", "y")]
    assert plane["density"].sum() * steps[0] * steps[1] == pytest.approx(1.0, abs=0.02)


def test_counts_cover_all_rows(spark):
    pdf, df = data(spark)
    assert sum(r["count"] for r in summaries.hexbin(df, "x", "y", 20).collect()) == len(pdf)
    found = summaries.histogram(df, "x", 12).orderBy("bin").collect()
    wanted, _ = np.histogram(pdf["x"], 12)
    assert sum(r["count"] for r in found) == len(pdf) == wanted.sum()


def test_box(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "g string, y double")
    row = summaries.box_stats(df, "g", "y").first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["low_whisker"], row["high_whisker"], row["outliers"]) == (1.0, 4.0, 1)


def test_registered_robust_curve_is_whole(spark, folder, monkeypatch):
    from workloads import queries

    whole, calls = smooth.lowess_grid, []

    def called(*args, **options):
        calls.append(options)
        return whole(*args, **options)

    monkeypatch.setattr(queries.smooth, "lowess_grid", called)
    rows = queries.QUERIES["lowess_robust"](spark, folder).collect()
    assert calls[0]["rounds"] == 3 and calls[0].get("points", 50) == 50
    assert len(rows) == 50 and all(r.fit is not None for r in rows)


def test_p_values_equal_the_integral(spark):
    def integral(low, high, power, reference):
        a = np.linspace(low, high, 100_001)
        w = np.ones(len(a))
        w[1:-1:2], w[2:-1:2] = 4, 2
        heights = np.exp(power * (np.log(np.maximum(np.cos(a), 1e-300)) - reference))
        return (w * heights).sum() * (high - low) / 300_000

    rows = [(n, t) for n in (3, 4, 7, 40, 60_000, 10**8) for t in (0.0, 0.01, -1.5, 2.0, 6.0)]
    odd = [(2, 1.0), (10, None)]
    found = stats.with_p_value(spark.createDataFrame(rows + odd, "rows long, t double")).collect()
    for row in found:
        if (row["rows"], row["t"]) in odd:
            assert row["p"] is None
            continue
        v = row["rows"] - 2
        start, reach = np.arctan(abs(row["t"]) / np.sqrt(v)), 60 / np.sqrt(v)
        peak = np.log(np.cos(start))
        tail = integral(start, min(np.pi / 2, start + reach), v - 1, peak)
        whole = integral(0, min(np.pi / 2, reach), v - 1, 0)
        assert row["p"] == pytest.approx(np.exp((v - 1) * peak) * tail / whole, rel=1e-7)


def test_codes_over_many_partitions(spark):
    words = [f"w{i * 7919 % 1000:03d}" for i in range(1000)] + [None] * 5
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    codes = ranks.value_codes(df, "w", "code")
    assert {r["w"]: r["code"] for r in codes.collect()} == {f"w{i:03d}": i for i in range(1000)}
    assert "SinglePartition" not in codes._jdf.queryExecution().executedPlan().toString()
    assert ranks.value_codes(df.where("w is null"), "w", "code").count() == 0
