import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freightlens.operators.binning import bin_of, cut, cut_width, qcut
from freightlens.operators.quantiles import quantile_edges, quantiles
from freightlens.operators.stats import group_stats

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def frames(spark):
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(3000) < 0.4, 5.0, rng.normal(0, 1e3, 3000))
    narrow = 1.7e9 + rng.random(3000)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "hot": hot, "narrow": narrow,
                        "wide": np.exp(rng.normal(0, 8, 3000))})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_equal_sorting(spark):
    pdf, df = frames(spark)
    for column in ("hot", "narrow", "wide"):
        edges = quantile_edges(df, column, PROBS).first()["edges"]
        assert edges == pytest.approx(list(np.quantile(pdf[column], PROBS)), rel=1e-12)
    grouped = quantile_edges(df, "hot", PROBS, by=["g"]).collect()
    assert len(grouped) == 3
    for row in grouped:
        assert row["edges"] == pytest.approx(
            list(np.quantile(pdf.loc[pdf.g == row["g"], "hot"], PROBS)), rel=1e-12)


def test_quantiles_are_the_same_bits_however_rows_are_dealt(spark):
    _, df = frames(spark)
    df = df.withColumn("cents", F.round("hot", 2))
    probs = [i / 20 for i in range(21)]
    built_in = df.agg(F.percentile("cents", probs).alias("edges")).first()["edges"]
    for parts in (1, 5):
        assert quantiles(df.repartition(parts), "cents", probs) == built_in
        assert quantiles(df.repartition(parts).unionAll(df), "cents", probs) == quantiles(
            df.withColumn("two", F.lit(2)), "cents", probs, weight="two")


def test_weights_and_absent_values(spark):
    df = spark.createDataFrame(
        [(1.0, 3), (2.0, 1), (None, 9), (float("nan"), 9), (float("inf"), 9)], "x double, w int")
    assert quantile_edges(df, "x", [0.5, 1.0], weight="w").first()["edges"] == [1.0, 2.0]
    assert quantiles(df.where("x > 5 and not isnan(x) and x < 9"), "x", [0.5]) == [None]


def test_qcut_like_pandas(spark):
    pdf, df = frames(spark)
    found = {r["bin"]: r["count"] for r in group_stats(qcut(df, "hot", 10), ["bin"], "wide").collect()}
    wanted = pd.qcut(pdf["hot"], 10, duplicates="drop").value_counts(sort=False)
    assert [found[k] for k in sorted(found)] == list(wanted)


def test_degenerate_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(bin_of(F.col("x"), [0.0, 0.0, 1.0])).collect()] == [1, 1, None]
    assert [r[0] for r in df.select(bin_of(F.col("x"), [1.0, 1.0])).collect()] == [None] * 3


def test_fixed_edges(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (99.0,), (None,)], "x double")
    edges = [0, 10, 20, float("inf")]
    assert [r[0] for r in df.select(cut("x", edges)).collect()] == [None, 0, 1, 2, None]
    named = df.select(cut("x", edges, ["low", "mid", "high"])).collect()
    assert [r[0] for r in named] == [None, "low", "mid", "high", None]


def test_equal_width_like_pandas(spark):
    pdf, df = frames(spark)
    found = group_stats(cut_width(df, "hot", 5), ["bin"], "wide").orderBy("bin").collect()
    wanted = pd.cut(pdf["hot"], 5).value_counts(sort=False)
    assert [r["count"] for r in found] == [c for c in wanted if c]
    one = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert {r["bin"] for r in cut_width(one, "x", 5).collect()} == {3}
