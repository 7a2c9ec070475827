import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from freightlens.constants import TARGET
from freightlens.plans.encoders import EncoderModel, FeatureEncoder, base_features
from freightlens.plans.features import holiday_features, with_order_totals
from freightlens.models.inputs import CATEGORY_INPUTS, NUMERIC_INPUTS
from freightlens.operators.lookup import attach, stored
from freightlens.plans.screening import _binned, by_strength, screening_report
from freightlens.plans.star import build_star, store_columns
from freightlens.sources.fixture import fixture_tables
from freightlens.sources import read_category_translation, read_csv_tables
from freightlens.sources.readers import Tables, read_parquet_tables, write_parquet_tables
from workloads.queries import FIXTURE_DOMAIN, Inputs


@pytest.fixture(scope="module")
def star(spark, folder):
    return Inputs(spark, folder).star.persist()


def test_csv_with_mark_and_other_column_order(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(
        "\ufeffproduct_category_name,product_category_name_english\nbrinquedos,toys\n".encode())
    found = read_category_translation(spark, str(tmp_path / "t.csv"))
    assert found.columns[0] == "product_category_name" and found.first()[1] == "toys"


def test_csv_and_parquet_tables(spark, folder, tmp_path):
    tables = Inputs(spark, folder).tables
    paths = {}
    for name in Tables.names():
        df = getattr(tables, name)
        paths[name] = str(tmp_path / name)
        df.select(*reversed(df.columns), F.lit("x").alias("more")).write.csv(
            paths[name], header=True, escape='"')
    read = read_csv_tables(spark, paths)
    write_parquet_tables(read, str(tmp_path / "pq"))
    again = read_parquet_tables(spark, str(tmp_path / "pq"))
    for name in ("orders", "order_reviews", "products"):
        assert getattr(again, name).count() == getattr(tables, name).count()
    a, b = again.orders, tables.orders
    assert a.agg(F.max("order_approved_at")).first() == b.agg(F.max("order_approved_at")).first()


def test_star_keeps_the_item_grain(spark, folder, star):
    assert star.count() == Inputs(spark, folder).tables.order_items.count()


def test_lookups_are_those_of_training(spark, star, tmp_path):
    train, test = star.where("order_id % 5 <> 0"), star.where("order_id % 5 = 0")
    model = FeatureEncoder(FIXTURE_DOMAIN).fit(train)
    model.save(str(tmp_path / "enc"))
    loaded = EncoderModel.load(spark, str(tmp_path / "enc"), FIXTURE_DOMAIN)
    scored = loaded.transform(test)
    assert scored.count() == test.count()
    assert set(NUMERIC_INPUTS + CATEGORY_INPUTS) <= set(scored.columns)
    pair = scored.select("seller_state", "customer_state", "route_frequency").first()
    seen = train.where((F.col("seller_state") == pair[0]) & (F.col("customer_state") == pair[1]))
    assert pair[2] == seen.count()
    new = test.limit(1).withColumns({"seller_id": F.lit(-1).cast("bigint"), "customer_city": F.lit("?")})
    row = loaded.transform(new).first()
    assert row["seller_avg_review"] == 3.0 and row["seller_order_volume"] == 0
    assert row["seller_customer_state_reach"] is None and row["customer_city_order_density"] == 0
    means = loaded.tables["seller"].agg(F.avg("seller_avg_order_value")).first()[0]
    assert row["seller_avg_order_value"] == pytest.approx(means)


def test_screening_verdicts(spark):
    df = spark.range(2000).select(
        (F.col("id") % 20).cast("double").alias("good"), (F.col("id") % 2).alias("two"),
        F.lit(1.0).alias("same"), F.when(F.col("id") < 50, F.col("id")).alias("few"),
        ((F.col("id") % 20) + F.col("id") % 2).cast("bigint").alias(TARGET))
    report, bins = screening_report(df, ["good", "two", "same", "few"])
    found = {r["feature"]: r for r in report.collect()}
    assert (found["good"]["keep"], found["good"]["add"]) == ("YES", "YES")
    # Quintiles of a two-valued column fall into one bin.
    assert (found["two"]["keep"], found["two"]["spread"], found["two"]["add"]) == ("YES", 0.0, "NO")
    assert (found["same"]["r"], found["same"]["keep"]) == (None, "WEAK")
    assert found["few"]["spread"] == 0.0 and found["few"]["add"] == "NO"
    assert sum(r["count"] for r in bins.where("feature = 'good'").collect()) == 2000
    assert by_strength(report).first()["feature"] in ("good", "few")


def test_holiday_windows(spark):
    df = spark.createDataFrame([(0,), (3,), (7,), (8,), (400,), (None,)], "days_to_holiday int")
    found = [(r[1], r[2]) for r in holiday_features(df).collect()]
    assert found == [(1, None), (1, 0), (1, 1), (0, 2), (0, None), (0, None)]


def test_unknown_states(spark, star):
    odd = base_features(star.limit(5).withColumn("seller_state", F.lit(None).cast("string")), FIXTURE_DOMAIN)
    row = odd.first()
    assert row["same_state"] == 0 and row["state_pair"] is None and row["seller_region"] is None


def _largest_method(df):
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code yet
    with io.StringIO() as text, contextlib.redirect_stdout(text):
        df.explain("codegen")
        conf.set("spark.sql.adaptive.enabled", "true")
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())))


def test_bins_of_many_features_are_compiled(spark):
    names = [f"f{i}" for i in range(39)]
    long = spark.range(50).select(F.lit(1.0).alias("__y"), *[
        (F.col("id") + i).cast("double").alias(n) for i, n in enumerate(names)]).unpivot(
        ["__y"], names, "feature", "value")
    edges = {n: [0.0, 10.0, 20.0, 30.0, 40.0, 99.0] for n in names[1:]} | {"f0": [1.0, 1.0, None]}
    found = _binned(long, edges, 5).groupBy("feature", "bin").agg(F.count("__y").alias("n"))
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    assert _largest_method(found) < 8000 and limit == "8000"
    counts = {(r["feature"], r["bin"]): r["n"] for r in found.collect()}
    assert not any(feature == "f0" for feature, _ in counts)
    assert [counts["f1", b] for b in range(1, 6)] == [10, 10, 10, 10, 10]


def test_stored_tables_have_a_known_size(spark):
    # The estimate for a join of joins is far beyond what a broadcast may take.
    many = spark.range(1000).join(spark.range(1000), "id").join(spark.range(1000), "id")
    table, rows = stored(many.groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    with io.StringIO() as text, contextlib.redirect_stdout(text):
        attach(spark.range(10**9).withColumn("k", F.col("id") % 7), table, ["k"]).explain()
        plan = text.getvalue()
    assert rows == 7 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_only_stored_columns_can_be_read(spark):
    star = spark.range(3).selectExpr("id", "cast(id as double) a", "cast(id as string) b")
    kept = store_columns(star, ["id", "a"])
    assert kept.dtypes == star.dtypes
    assert [tuple(r) for r in kept.orderBy("id").select("id", "a").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0)]
    with pytest.raises(Exception, match="b was not stored"):
        kept.select("b").collect()


def test_a_table_of_known_size_is_broadcast(spark):
    fact, table = spark.range(9).withColumnRenamed("id", "k"), spark.range(5).selectExpr("id k", "id v")

    def joins(rows):
        plan = attach(fact, table, ["k"], rows)._jdf.queryExecution().sparkPlan().toString()
        return "BroadcastHashJoin" in plan

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert joins(5) and not joins(10**9) and not joins(None)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_items_meet_their_order_last(spark, folder):
    """Products and sellers meet the items while these are narrow, and order totals find
    rows that are dealt by order already."""
    star = build_star(fixture_tables(spark, folder))
    top = star._jdf.queryExecution().analyzed().toString().splitlines()
    joins = [line for line in top if "Join Inner" in line]
    assert "order_id" in joins[0]
    rows = star.select("order_id", "price").collect()
    totals = with_order_totals(star).select("order_id", "order_total_price", "items_per_order")
    sums = {}
    for r in rows:
        n, total = sums.get(r["order_id"], (0, 0.0))
        sums[r["order_id"]] = n + 1, total + (r["price"] or 0.0)
    found = totals.collect()
    assert len(found) == len(rows)
    for r in found:
        n, total = sums[r["order_id"]]
        assert r["items_per_order"] == n and r["order_total_price"] == pytest.approx(total)
