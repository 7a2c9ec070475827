"""The registered model queries take all inputs and the operators' own sizes."""

import inspect

import pytest
from pyspark.sql import functions as F

from freightlens.models import trees
from freightlens.models.components import principal_components
from freightlens.models.inputs import CATEGORY_INPUTS, NUMERIC_INPUTS
from workloads import queries


class Reached(Exception):
    pass


@pytest.mark.parametrize("query, operator", [
    ("boosted_rmse", "fit_boosted_trees"), ("cv_scores", "cross_validate_trees"),
    ("model_roundtrip", "fit_boosted_trees"), ("forest_residuals", "forest_residuals")])
def test_models_leave_out_no_input(spark, folder, monkeypatch, query, operator):
    signature = inspect.signature(getattr(trees, operator))
    calls = []

    def called(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        calls.append(bound.arguments)
        raise Reached

    monkeypatch.setattr(queries, operator, called)
    with pytest.raises(Reached):
        queries.QUERIES[query](spark, folder)
    got, usual = calls[0], signature.parameters
    sizes = {"numeric", "categories", "depth", "inputs", "trees", "folds"} & set(usual)
    assert {n: got[n] for n in sizes} == {n: usual[n].default for n in sizes}
    if operator == "cross_validate_trees":  # the rest are options of the booster
        assert got["options"]["numeric"] == NUMERIC_INPUTS
        assert got["options"]["categories"] == CATEGORY_INPUTS
        assert set(got["options"]) <= {"numeric", "categories", "rounds"}
    if operator != "forest_residuals":
        rows = got["train"] if "train" in got else got["df"]
        assert set(NUMERIC_INPUTS + CATEGORY_INPUTS) <= set(rows.columns)


@pytest.mark.parametrize("query", ["boosted_rmse", "model_roundtrip"])
def test_boosted_queries_grow_all_rounds(spark, folder, monkeypatch, query):
    signature = inspect.signature(trees.fit_boosted_trees)
    rounds = []
    rows = spark.range(1).select(*[F.lit(0).alias(c) for c in queries.MODEL_COLUMNS])
    monkeypatch.setattr(queries, "_training", lambda t: (None, rows, rows))

    def called(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        rounds.append(bound.arguments["rounds"])
        raise Reached

    monkeypatch.setattr(queries, "fit_boosted_trees", called)
    with pytest.raises(Reached):
        queries.QUERIES[query](spark, folder)
    assert rounds == [signature.parameters["rounds"].default] == [500]


@pytest.mark.parametrize("query, operator", [
    ("one_hot", "fit_preprocessing"), ("pca_scores", "principal_components"),
    ("pca_regimes", "principal_components"), ("forest_residuals", "forest_residuals")])
def test_models_read_items_that_are_joined_once(spark, folder, monkeypatch, query, operator):
    """Every pass of a fit would repeat a join of orders and items."""
    plans = []

    def called(df, *args, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise Reached

    monkeypatch.setattr(queries, operator, called)
    with pytest.raises(Reached):
        queries.QUERIES[query](spark, folder)
    assert "l_orderkey" not in plans[0] and "o_orderkey" not in plans[0]


def test_components_read_their_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("cast(id as double) a", "cast(id * id % 7 as double) b")
    found = principal_components(rows.mapInArrow(count, "a double, b double"), ["a", "b"])
    assert found.scores.count() == 50 and read.value == 50


def test_all_numbers_are_scaled(spark, folder):
    scaled = queries.QUERIES["standardise_impute_all"](spark, folder)
    assert {f"{c}__z" for c in NUMERIC_INPUTS} <= set(scaled.columns)
    sums = scaled.selectExpr("count(*) as rows", *[f"sum({c}__z) as {c}" for c in NUMERIC_INPUTS]).first()
    assert sums["rows"] > 0
    assert max(abs(sums[c]) for c in NUMERIC_INPUTS) < sums["rows"] * 1e-3


def test_all_categories_are_encoded(spark, folder):
    hot = queries.QUERIES["one_hot"](spark, folder)
    assert set(CATEGORY_INPUTS) <= set(hot.columns)
    assert {r.ones for r in hot.collect()} == {float(len(CATEGORY_INPUTS))}


def test_order_totals_are_those_of_each_side(spark, folder, monkeypatch):
    """Rows of test add nothing to the totals of training."""
    class Fitted:
        def fit(self, train, **options):
            return None

    monkeypatch.setattr(queries, "FeatureEncoder", lambda domain: Fitted())
    _, train, test = queries._split(queries.Inputs(spark, folder))
    for side in (train, test):
        assert "items_per_order" not in side.columns
        kept = side.select(*queries.TRAINED)
        assert kept.count() == kept.na.drop(subset=["product_weight_g", "freight_value", "price"]).count() > 0
