"""Source tables derived from the TPC-H-like test tables.

The mapping gives every row of the test tables a place in the delivery schema;
it is arithmetic on keys, so that another SQL engine can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.sources.readers import Tables

DAY = 86_400


def _after(day: str, seconds: str) -> Column:
    return F.expr(f"timestampadd(SECOND, cast({seconds} as int), {day})")


def fixture_tables(spark: SparkSession, folder: str) -> Tables:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders, items, part = table("orders"), table("lineitem"), table("part")
    customer, supplier, nation = table("customer"), table("supplier"), table("nation")
    bought = f"(o_orderkey*7919)%{DAY}"

    f_orders = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _after("o_orderdate", bought).alias("order_purchase_timestamp"),
        F.when(F.expr("o_orderkey%97<>0"), _after(
            "o_orderdate", f"{bought}+(o_orderkey*104729)%{3 * DAY}")).alias("order_approved_at"),
        F.when(F.expr("o_orderstatus<>'P'"), _after(
            "o_orderdate", f"(3+o_orderkey%25)*{DAY}")).alias("order_delivered_customer_date"),
        _after("o_orderdate",
               f"(6+cast(floor((o_custkey%97)/4) as bigint)+o_orderkey%12)*{DAY}",
               ).alias("order_estimated_delivery_date"),
    )
    dated = items.join(
        orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    f_items = dated.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        _after("o_orderdate", f"(2+l_partkey%12)*{DAY}+(l_suppkey%24)*3600",
               ).alias("shipping_limit_date"),
        F.expr("case when l_partkey%400=0 then 0D else l_extendedprice/100 end").alias("price"),
        F.expr("l_quantity*l_tax*20").alias("freight_value"),
    )
    f_payments = items.where("l_orderkey%29<>0").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.expr("case l_returnflag when 'A' then 'credit_card' when 'N' then 'boleto' "
               "else 'voucher' end").alias("payment_type"),
        F.expr("cast(l_quantity as int)%10").alias("payment_installments"),
        F.expr("l_extendedprice/100").alias("payment_value"),
    )
    first_reviews = orders.where("o_orderkey%10<>0").select(
        F.col("o_orderkey").alias("order_id"),
        F.expr("cast(1+(o_orderkey*7)%5 as int)").alias("review_score"),
        F.expr("case when o_orderkey%3<>0 then "
               "concat(o_orderpriority, repeat('x', cast(o_orderkey%40 as int))) end",
               ).alias("review_comment_message"),
    )
    more_reviews = orders.where("o_orderkey%13=0").select(
        F.col("o_orderkey").alias("order_id"),
        F.expr("cast(1+o_orderkey%5 as int)").alias("review_score"),
        F.lit("ok").alias("review_comment_message"),
    )
    f_products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.expr("case when p_partkey%41<>0 then lower(p_type) end").alias("product_category_name"),
        F.expr("case when p_partkey%41<>0 then cast(p_partkey%7 as double) end",
               ).alias("product_photos_qty"),
        F.expr("case when p_partkey%53<>0 then cast(p_size*200 as double) end",
               ).alias("product_weight_g"),
        F.expr("cast(10+2*p_size as double)").alias("product_length_cm"),
        F.expr("cast(p_partkey%60 as double)").alias("product_height_cm"),
        F.expr("cast(5+p_partkey%45 as double)").alias("product_width_cm"),
    )
    f_sellers = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"),
        F.expr("cast(1000+1000*((s_suppkey*7)%97) as int)").alias("seller_zip_code_prefix"),
        F.expr("concat('CITY_', cast(s_suppkey%40 as string))").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )
    f_customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("cast(1000+1000*(c_custkey%97) as int)").alias("customer_zip_code_prefix"),
        F.expr("concat('city_', cast(c_custkey%40 as string))").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )
    f_points = customer.select(
        F.expr("cast(1000+1000*(c_custkey%97) as int)").alias("geolocation_zip_code_prefix"),
        F.expr("-33+cast(38*(c_custkey%97)+c_custkey%7 as double)/100").alias("geolocation_lat"),
        F.expr("-70+cast(31*((c_custkey%97)*53%97)+c_custkey%5 as double)/100",
               ).alias("geolocation_lng"),
    )
    return Tables(
        orders=f_orders, order_items=f_items, order_payments=f_payments,
        order_reviews=first_reviews.unionByName(more_reviews), products=f_products,
        sellers=f_sellers, customers=f_customers, geolocation=f_points,
    )
